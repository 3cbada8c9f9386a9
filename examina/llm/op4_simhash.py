"""SimHash near-duplicates: fingerprints, an index of positional bytes, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written
from .components import components

SHINGLE, SEED = 4, 42


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text: bit i is 1 if it is set in over half the hashes of
    the text's shingles, repeats included. Fewer words than a shingle are one shingle;
    no word gives zero."""
    from xxhash import xxh64_digest

    found = (text or "").encode("utf-8").lower().split()  # bytes.lower() changes A-Z only
    if not found:
        return 0
    if len(found) <= SHINGLE:
        raw = xxh64_digest(b" ".join(found), SEED)
    else:
        raw = b"".join([xxh64_digest(b" ".join(s), SEED) for s in zip(*(found[k:] for k in range(SHINGLE)), strict=False)])
    hashes = np.frombuffer(raw, ">u8").astype(np.uint64)
    return majority(hashes)


_LANES = np.uint64(0x0101010101010101)
_SHIFTS = np.arange(8, dtype=np.uint64)[:, None]


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of hashes, counted in byte lanes of 64-bit words."""
    counts = np.zeros((8, 8), np.int64)  # by bit of a byte, by byte
    for i in range(0, len(hashes), 255):  # a lane holds 255 at most
        lanes = ((hashes[i : i + 255] >> _SHIFTS) & _LANES).sum(axis=1, dtype=np.uint64)
        counts += lanes.astype("<u8").view(np.uint8).reshape(8, 8)
    return int.from_bytes(np.packbits((2 * counts > len(hashes)).T.ravel(), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


#: Fingerprints link at so many differing bits or fewer.
MAX_BITS = 4
BYTES = 8
#: Two fingerprints that link differ in MAX_BITS bytes at most, so they share this many positional bytes.
MIN_SHARED = BYTES - MAX_BITS
#: Positional bytes that one posting list stands for: one fewer than a pair must share.
TOGETHER = 3
#: Fingerprints in a posting list from which on midpoints replace pairs; a bound of work, not of links.
CROWD = 64


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those
    of all links.

    The inverted index has a posting list for each choice of TOGETHER positional bytes and
    their values. Of each pair that meets in a list the shared positional bytes are
    tallied, pairs that reach the guaranteed MIN_SHARED stay, and their bits are compared.
    (Single bytes as keys would put 1/256 of the corpus in every list and tally pairs as
    the square of it; a list of three bytes has 1/16.8 million.)

    Lists longer than CROWD make no pairs. Two fingerprints link if and only if some value
    is within MAX_BITS / 2 bits of both, so every fingerprint of such lists meets the
    others at the 2,081 values around it and is linked to the smallest there; that is
    exact for every pair that meets in a long list, in rows that grow with the number of
    fingerprints. All other pairs meet in short lists only.
    """
    choices = list(combinations(range(BYTES), TOGETHER))
    masks = [sum(0xFF << (8 * p) for p in c) for c in choices]
    keys = F.array(*[F.struct(F.lit(k).alias("choice"), F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))).alias("key")) for k, m in enumerate(masks)])
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = prints.repartition(tasks, "fp")  # small rows lie in few files, and each makes 56 postings
    keyed = spread.select("fp", F.explode(keys).alias("k")).select("fp", "k.*")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # Spark takes the postings for as large as prints, which are 56 times smaller, and would broadcast them
    lists = written(keyed.hint("merge").join(sizes.hint("merge"), "key"), "postings")

    def shared(p):
        """The positions of the bytes that a pair shares, ascending."""
        return F.array_compact(F.array(*[F.when(F.shiftrightunsigned(p.a.bitwiseXOR(p.b), 8 * i).bitwiseAND(F.lit(255)) == 0, i) for i in range(BYTES)]))

    # The bits are compared first, being one operation; a pair is a row in the list of its first shared bytes only
    few = lists.where(F.col("n") <= CROWD).groupBy("key").agg(F.first("choice").alias("choice"), F.sort_array(F.collect_list("fp")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + F.lit(2), F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    own = F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in choices]), F.col("choice") + 1)
    close = F.filter(F.filter(pairs, lambda p: F.bit_count(p.a.bitwiseXOR(p.b)) <= MAX_BITS), lambda p: (F.size(shared(p)) >= MIN_SHARED) & (F.slice(shared(p), 1, TOGETHER) == own))
    by_pair = few.select(F.explode(close).alias("p")).select("p.a", "p.b")

    around = np.array([sum(1 << b for b in bits) for n in range(MAX_BITS // 2 + 1) for bits in combinations(range(64), n)], np.uint64)

    def midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                fps = batch.column(0).to_numpy(zero_copy_only=False)[i : i + 64].view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array((fps[:, None] ^ around).ravel().view(np.int64)), pa.array(np.repeat(fps, len(around)).view(np.int64))], ["mid", "fp"])

    many = lists.where(F.col("n") > CROWD).select("fp").distinct().mapInArrow(midpoints, "mid bigint, fp bigint")
    by_mid = many.select(F.col("fp").alias("a"), F.min("fp").over(W.partitionBy("mid")).alias("b")).where("a <> b").distinct()  # a value has 2,081 around it at most
    return by_pair.unionByName(by_mid)


def roots(prints: DataFrame) -> DataFrame:
    """fp and root of the fingerprints that link to another; a component's root names it."""
    return components(links(prints.select("fp"))).select(F.col("id").alias("fp"), F.col("component").alias("root"))


#: A fingerprint with more than this share of all rows is joined as one of a few broadcast rows.
HOT = 1 / 200


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of docs; columns besides doc_id and
    text go, whatever their names.

    component_id is the smallest doc_id that links reach. Null and empty texts have
    fingerprint zero and link to each other. Rows with one doc_id each give a row; a null
    doc_id is larger than any, so a component of null ids alone has none. Texts of any
    length are whole; an empty table gives no row.
    """
    found = written(fingerprints(docs), "fingerprints")
    prints = written(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "prints")
    named = roots(prints).hint("merge").join(prints.hint("merge"), "fp")
    ids = named.hint("merge").join(named.groupBy("root").agg(F.min("first").alias("component_id")).hint("merge"), "root").select("fp", "component_id")
    of = written(prints.hint("merge").join(ids.hint("merge"), "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), "n"), "components")
    hot = F.broadcast(of.where(F.col("n") > found.count() * HOT).drop("n"))  # fewer than 1 / HOT rows
    rest = found.join(hot, "fp", "left_anti").hint("merge").join(of.drop("n").hint("merge"), "fp")
    return (found.join(hot, "fp").unionByName(rest)
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs less all but one of each component: the first by doc_id, null
    last, then by the digest of its text. Rows of different components stay, also where
    they share an id or have none. Null and empty texts are one component. Columns stay
    as they are; an empty table stays empty."""
    digest = F.coalesce(F.md5(F.col("text").cast("string").cast("binary")), F.lit(""))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "digest", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest.alias("digest"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, digest string, fp bigint")
    prints = written(rows.groupBy("fp").agg(F.min(first).alias("first")), "prints")
    stay = (prints.hint("merge").join(roots(prints).hint("merge"), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
            .select(F.coalesce("first.doc_id", F.lit(0)).alias("__id"), F.col("first.none").alias("__none"), F.col("first.digest").alias("__digest")))
    keys = ["__id", "__none", "__digest"]
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), "__none": F.col("doc_id").cast("bigint").isNull(), "__digest": digest})
    return keyed.hint("merge").join(stay.hint("merge"), keys, "left_semi").dropDuplicates(keys).drop(*keys)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
