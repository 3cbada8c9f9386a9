"""Components of documents by n-gram Jaccard: a parity-sketch join.

A set's sketch has one bit for each cell; a shingle's hash flips one of them, so two
sketches differ in no more bits than the sets differ in shingles. For a band of sizes the
threshold allows a known number D of differing shingles; of a sketch that is cut into more
than D words, one at least is equal in two sets that link: words are the join's keys. What
meets is held against the Hamming distance of whole sketches, then against the sets.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, table, words, written
from .components import components

#: Words of a shingle; the least similarity of a link in percent.
SHINGLE, PERCENT = 3, 90
#: Bits of a sketch's word.
BITS = 64
#: A key with more than this share of all rows is joined as one of a few broadcast rows.
HOT = 1 / 10_000
#: Members of a list that one block of a comparison holds: of the smaller side, of the other.
BLOCK, ACROSS = 250, 2000
#: Rows of one pivot that a task gets; more pivots are copied, not rows.
SPREAD = 500
#: One in so many blocks is compared first, as sets that link mostly do so in several.
FIRST_SHARE = 8
#: Words of the sketch by which pairs are compared before their texts are.
COMPARED = 16

_LOW = np.uint64(0xFFFFFFFF)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _bands() -> list[int]:
    """The least size of each band; each is a quarter wider than the last, so a set and
    any set that may link to it lie in one band or in neighbouring ones."""
    starts = [1]
    while starts[-1] < 1 << 50:
        starts.append(max(starts[-1] + 1, starts[-1] * 5 // 4))
    return starts


BANDS = _bands()


def differing(total: int) -> int:
    """The most shingles in which two sets of `total` shingles together may differ."""
    return (100 - PERCENT) * total // (100 + PERCENT)


def band(size: int) -> int:
    return bisect_right(BANDS, size) - 1


def bands(size: int) -> list[int]:
    """The bands under which a set of that size is listed: its own, and the next one
    where a larger set of it may link."""
    own = band(size)
    return [own, own + 1] if 100 * size // PERCENT >= BANDS[own + 1] else [own]


def width(of: int) -> tuple[int, int]:
    """Words of a sketch in a band, and how many of a set's lightest are not listed. There
    are as many words as two of the band's sets may differ by, one more, and half of that
    again, the lightest, to leave out."""
    least = differing(2 * (BANDS[of + 1] - 1)) + 1
    return least + least // 2, least // 2


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The ascending distinct 64-bit hashes of a text's shingles. Fewer words than a
    shingle are one; no word gives none."""
    from xxhash import xxh64_intdigest

    found = [w.lower() for w in words(text)]  # bytes.lower() changes A-Z only
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < SHINGLE:
        return np.array([xxh64_intdigest(b" ".join(found), len(found))], np.uint64)
    h = np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found))
    return np.unique(_mix(h[:-2] * _A + h[1:-1] * _B + h[2:] * _C))


def sketch(hashes: np.ndarray, n_words: int) -> np.ndarray:
    """The parity sketch: one word of BITS bits for each of n_words."""
    cell = ((hashes & _LOW) * np.uint64(n_words) >> np.uint64(32)) * np.uint64(BITS) + (hashes >> np.uint64(58))
    odd = np.bincount(cell.astype(np.int64), minlength=n_words * BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def keys(hashes: np.ndarray) -> np.ndarray:
    """The keys under which a set is listed: hashes of band, place and value of the words of
    a sketch so wide that a word is told by the XOR of what its odd cells hash to.

    A word of few shingles is equal in many sets by chance, so the lightest words, by number
    of shingles and place, are left out. Of two sets that link, more words are equal than are
    left out, and equal words have equal weights: the heaviest of them is among the lightest
    of neither, so it is listed by both.
    """
    out, values = [], _mix(hashes)
    for b in bands(len(hashes)):
        n_words, light = width(b)
        place = ((hashes & _LOW) * np.uint64(n_words) >> np.uint64(32)).astype(np.int64)
        word = np.zeros(n_words, np.uint64)
        np.bitwise_xor.at(word, place, values)
        listed = np.argsort(np.bincount(place, minlength=n_words), kind="stable")[light:]
        out.append(_mix(word[listed] ^ _mix(listed.astype(np.uint64) + np.uint64(b << 40))))
    return np.concatenate(out).view(np.int64)


def _listed(docs: DataFrame) -> DataFrame:
    """doc_id, n, digest of the set, h (64 bits of the digest), keys of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 2000):
                batch = whole.slice(i, 2000)
                n, digests, lists = [], [], []
                for text in batch.column(1).to_pylist():
                    own = shingles(text)
                    n.append(len(own))
                    digests.append(hashlib.md5(own.tobytes()).digest())
                    lists.append(keys(own) if len(own) else own.view(np.int64))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                h = np.frombuffer(b"".join(d[:8] for d in digests), "<i8")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(h), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists)))], ["doc_id", "n", "digest", "h", "keys"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, digest binary, h bigint, keys array<bigint>")


def _met(rows: DataFrame, small: DataFrame, key: str, hot: Column) -> DataFrame:
    """rows joined with small, of which each key has one row; `hot` holds for a bounded
    number of small's rows, which are broadcast, so that no task gets all rows of a key."""
    few = F.broadcast(small.where(hot))
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(small.where(~hot), key))


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, packed (text), sketch of the nodes, from the texts of their first documents; a
    packed text is a quarter of its hashes."""
    wanted = nodes.select(F.col("first").alias("doc_id")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        pack = ZstdCompressor(level=3).compress
        for whole in batches:
            for i in range(0, len(whole), 500):
                texts = whole.column(0).slice(i, 500).to_pylist()
                found = [shingles(t) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in ([hashlib.md5(f.tobytes()).digest() for f in found], [pack((t or "").encode()) for t in texts], [sketch(f, COMPARED).tobytes() for f in found])], ["digest", "packed", "sketch"])

    texts = docs.alias("d").join(wanted.hint("merge").alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi").select("text")
    return texts.mapInArrow(run, "digest binary, packed binary, sketch binary").join(nodes.select("digest", "node"), "digest").select("node", "packed", "sketch").dropDuplicates(["node"])


class Sets:
    """Sets of packed texts, unpacked once as long as they fit in a bounded cache."""

    def __init__(self, most: int = 8_000_000):
        from zstandard import ZstdDecompressor

        self.unpack, self.known, self.held, self.most = ZstdDecompressor().decompress, {}, 0, most

    def of(self, packed: bytes) -> np.ndarray:
        found = self.known.get(packed)
        if found is None:
            found = shingles(self.unpack(packed).decode())
            if self.held > self.most:
                self.known, self.held = {}, 0
            self.known[packed] = found
            self.held += len(found)
        return found

    def link(self, x: bytes, y: bytes) -> bool:
        """Whether two sets are similar enough."""
        a, b = self.of(x), self.of(y)
        merged = np.sort(np.concatenate([a, b]))
        common = int((merged[1:] == merged[:-1]).sum())
        return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b, c: rows that b may stand in) those whose sets link. A pivot b of
    many pairs is copied to as many tasks."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.ceil(F.col("c") / SPREAD)))
    right = salted.select("b", "salt").distinct().join(sets.select(F.col("node").alias("b"), F.col("packed").alias("pb")), "b")
    both = salted.join(sets.select(F.col("node").alias("a"), F.col("packed").alias("pa")), "a").join(right, ["b", "salt"]).select("a", "b", "pa", "pb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets()
        for batch in batches:
            keep = [sets.link(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def _named(edges: DataFrame) -> DataFrame:
    return written(components(edges).select(F.col("id").alias("node"), F.col("component").alias("comp")), "named")


def _crossing(lists: DataFrame, nodes: DataFrame, named: DataFrame) -> DataFrame:
    """key, node, n, comp and the list's figures of the lists in which components meet:
    main (the component with most members), n_main, n_rest, c (members). Of lists with the
    same members, told by two hashes over them, one stays."""
    of = nodes.join(named, "node", "left").select("h", "node", "n", F.coalesce("comp", "node").alias("comp"))
    members = lists.select("key", "h").join(of, "h").select("key", "node", "n", "comp")
    by = (members.groupBy("key", "comp").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
          .groupBy("key").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.max("k").alias("n_main"), F.sum("k").alias("c"), F.count("*").alias("comps"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("comps > 1"))
    one = by.groupBy("x", "y", "c").agg(F.min(F.struct("key", "main", "n_main")).alias("r")).select("r.*", (F.col("c") - F.col("r.n_main")).alias("n_rest"), "c")
    cross = written(one, "cross")
    total = cross.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    out = written(_met(members, cross, "key", F.col("c") > max(SPREAD, total * HOT)), "crossing")
    dropped(cross)
    return out


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Rows that follow each other with equal columns `by`, whole groups at a time; one may
    go on in the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        last = {x: batch.column(x)[-1] for x in by}
        same = np.logical_and.reduce([batch.column(x).to_numpy() == last[x].as_py() for x in by])
        begin = int(np.flatnonzero(same)[0])
        if begin or (held and any(held[-1].column(x)[-1] != last[x] for x in by)):
            yield pa.Table.from_batches([*held, batch.slice(0, begin)])
            held = []
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _cuts(table: pa.Table, by: list[str]) -> Iterator[slice]:
    """The groups of a table, whose rows follow each other."""
    new = np.logical_or.reduce([np.diff(table.column(x).to_numpy()) != 0 for x in by])
    ends = [0, *(np.flatnonzero(new) + 1).tolist(), len(table)]
    return map(slice, ends, ends[1:])


def _possible(side: np.ndarray, n: np.ndarray, comp: np.ndarray, values: np.ndarray) -> np.ndarray:
    """x, y, distance of a block's pairs, one of side 0 and one of side 1, of different
    components, whose sketches and sizes allow a link."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    found = [np.zeros((0, 3), np.int64)]
    for k in range(0, len(left), 128):
        x = left[k : k + 128]
        distance = np.zeros((len(x), len(right)), np.int64)
        for w in range(COMPARED):
            distance += np.bitwise_count(values[x, w][:, None] ^ values[right, w][None, :])
        a, b = n[x][:, None], n[right][None, :]
        may = (comp[x][:, None] != comp[right][None, :]) & ((100 + PERCENT) * distance <= (100 - PERCENT) * (a + b)) & (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b))
        p, q = np.nonzero(may)
        found.append(np.stack([x[p], right[q], distance[p, q]], axis=1))
    return np.concatenate(found)


COLUMNS = ["side", "node", "n", "comp"]


def _sketches(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(table), -1)


def _blocks(crossing: DataFrame, sets: DataFrame) -> DataFrame:
    """block, side, node, n, comp: the members of lists that may join components.

    The members outside a list's main component are compared with it and with each other,
    in blocks of BLOCK by ACROSS members; no other pair can join components. Members without
    a possible partner go, and of blocks of which the same members are left one stays: its
    name is a hash over them.
    """
    rest_blocks, main_blocks = F.ceil(F.col("n_rest") / BLOCK), F.ceil(F.col("n_main") / ACROSS)
    own = F.pmod(F.xxhash64("node"), F.when(F.col("comp") == F.col("main"), main_blocks).otherwise(rest_blocks))

    def cells(low: Column, high: Column, cell) -> Column:
        return F.transform(F.sequence(low, high), cell)

    def cell(kind: int, i: Column, j: Column, side: int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.cast("bigint").alias("i"), j.cast("bigint").alias("j"), F.lit(side).cast("bigint").alias("side"))

    o, zero = F.col("own"), F.lit(0).cast("bigint")
    main = cells(zero, rest_blocks - 1, lambda i: cell(0, i, o, 1))
    rest = F.concat(cells(zero, main_blocks - 1, lambda j: cell(0, o, j, 0)), cells(o, rest_blocks - 1, lambda j: cell(1, o, j, 0)), cells(zero, o, lambda i: cell(1, i, o, 1)))
    by = ["key", "kind", "i", "j"]
    placed = (crossing.join(sets.select("node", "sketch"), "node").withColumn("own", own).withColumn("cell", F.explode(F.when(F.col("comp") == F.col("main"), main).otherwise(rest)))
              .select("key", "cell.*", "node", "n", "comp", "sketch").repartition(*by).sortWithinPartitions(*by, "side", "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, by):
            columns, values, found = [table.column(x).to_numpy() for x in COLUMNS], _sketches(table), []
            for cut in _cuts(table, by):
                side, node, n, comp = (c[cut] for c in columns)
                stay = np.unique(_possible(side, n, comp, values[cut])[:, :2])
                if len(stay):
                    rows = np.stack([c[stay] for c in (side, node, n, comp)])
                    name = int.from_bytes(hashlib.md5(rows[:2].tobytes()).digest()[:8], "little", signed=True)
                    found.append(np.concatenate([np.full((1, len(stay)), name), rows]))
            rows = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows.astype(np.int64)], ["block", *COLUMNS])

    return placed.mapInArrow(run, "block bigint, side bigint, node bigint, n bigint, comp bigint").distinct()


def _joining(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between members of blocks by which components join. A block takes its
    possible pairs nearest first, and verifies those whose ends it hasn't joined yet: it
    gives fewer links than it has members."""
    placed = blocks.join(sets, "node").select("block", *COLUMNS, "sketch", "packed").repartition("block").sortWithinPartitions("block")

    def links_of(node: np.ndarray, comp: np.ndarray, pairs: np.ndarray, packed: list[bytes], sets: Sets) -> list[tuple[int, int]]:
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = c = root.get(up, up)
            return c

        out, apart = [], len(np.unique(comp)) - 1
        for k in np.argsort(pairs[:, 2], kind="stable"):
            x, y = pairs[k, 0], pairs[k, 1]
            a, b = find(comp[x]), find(comp[y])
            if a != b and sets.link(packed[x], packed[y]):
                root[a] = b
                out.append((int(node[x]), int(node[y])))
                apart -= 1
                if not apart:
                    break
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets()
        for table in _groups(batches, ["block"]):
            columns, values, packed, found = [table.column(x).to_numpy() for x in COLUMNS], _sketches(table), table.column("packed").to_pylist(), []
            for cut in _cuts(table, ["block"]):
                side, node, n, comp = (c[cut] for c in columns)
                found += links_of(node, comp, _possible(side, n, comp, values[cut]), packed[cut], sets)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return placed.mapInArrow(run, "a bigint, b bigint").distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles (distinct shingles), component_id of every row of docs; columns
    besides doc_id and text go, whatever their names.

    component_id is the smallest doc_id that links reach. Equal sets are one node, copies
    make no pairs. Null and empty texts have no shingle and link with nothing: their
    component is their own doc_id. Rows with one doc_id each give a row; a null doc_id is
    larger than any, so a component of null ids alone has none. Sets that differ by
    exactly as much as the threshold allows link. Texts of any length are whole; an empty
    table gives no row.

    Links are looked for in two steps, so that a list of near copies makes pairs as its
    members, not as their square. First each set meets the smallest set with which it
    shares most words. Lists whose members are then in one component are done. In the
    others the members of different components are compared where they lie, first in a
    share of the lists, then, with the components that this leaves, in all: every link lies
    in some list, so no component stays apart from one that it links to.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(_listed(docs), "listed")
    heads = written(rows.where("n > 0").groupBy("digest").agg(F.min("h").alias("h"), F.max("n").alias("n"), F.min("doc_id").alias("first"), F.count("*").alias("copies"))
                    .withColumn("node", F.monotonically_increasing_id()), "heads")
    postings = rows.where("n > 0").select("h", F.explode("keys").alias("key"))
    common = written(postings.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("c")).where("lo <> hi").drop("hi"), "common")
    total = common.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    lists = written(_met(postings, common, "key", F.col("c") > max(SPREAD, total * HOT)).distinct(), "lists")
    dropped(common)
    nodes = written(heads.join(lists.select("h").distinct(), "h", "left_semi").select("node", "h", "n", "digest", "first"), "nodes")
    sets = written(_sets(docs, nodes), "sets")

    met = lists.where("h <> lo").groupBy("h", "lo").agg(F.count("*").alias("k"), F.max("c").alias("c")).groupBy("h").agg(F.max_by(F.struct("lo", "c"), F.struct("k", -F.col("lo"))).alias("p")).select("h", "p.*")
    name = nodes.select("h", "node")
    few = met.groupBy("lo").agg(F.count("*").alias("pairs"))  # one row for each pivot
    hot = few.join(name.withColumnRenamed("h", "lo"), "lo").select("lo", F.col("node").alias("b"), "pairs")
    pairs = written(_met(met.join(name.withColumnRenamed("node", "a"), "h"), hot, "lo", F.col("pairs") > max(SPREAD, total * HOT)).select("a", "b", F.col("pairs").alias("c")), "pairs")
    edges = [written(_verified(pairs, sets), "links")]
    dropped(pairs)
    named = written(edges[0].select(F.col("a").alias("node"), F.col("b").alias("comp")), "named")  # sets of one pivot; whole components come below
    for share in (FIRST_SHARE, 1):
        crossing = _crossing(lists, nodes, named)
        blocks = written(_blocks(crossing, sets), "blocks")
        edges.append(written(_joining(blocks.where(F.pmod("block", F.lit(share)) == 0), sets), "links"))
        for done in (blocks, crossing, named):
            dropped(done)
        named = _named(reduce(DataFrame.unionByName, edges))
    for done in (lists, nodes, sets, *edges):
        dropped(done)

    rooted = heads.join(named, "node", "left").withColumn("root", F.coalesce("comp", "node"))
    least = rooted.where("comp IS NOT NULL").groupBy("root").agg(F.min("first").alias("component_id"))
    of = written(rooted.join(least, "root", "left").select("digest", F.coalesce("component_id", "first").alias("component_id"), "copies"), "components")
    dropped(named)
    dropped(heads)
    n_rows = rows.count()
    full = _met(rows.where("n > 0").select("doc_id", "n", "digest"), of, "digest", F.col("copies") > max(SPREAD, n_rows * HOT)).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
