"""Quality rules: counts of words, symbols and repeats, and a hashed n-gram classifier.

The classifier compares two multinomials over BUCKETS hashed word unigrams and bigrams:
one of trusted documents, one of the whole raw corpus. A document's score is the mean
log2 ratio of its n-grams, so long texts are not favoured. It is kept if the score is not
below a threshold: the same documents are kept in every run.

Raw counts cover every n-gram of every document, the trusted side every document with
label 1, and the threshold every labelled document that passes the base rules.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, table, without, words, written

BUCKETS = 1 << 16
#: Into how many ranges of about as many distinct scores the search for the threshold cuts them; the threshold doesn't depend on it.
RANGES = 256
#: The share of trusted documents that the threshold may at most reject.
MAX_TRUSTED_LOSS = 0.002
#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
COLUMNS = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "llr": "double", "kept": "boolean"}


def ngrams(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The buckets of a text's unigrams and bigrams, from the hashes of its words."""
    h = hashes.astype(np.uint64)
    mixed = [h * np.uint64(0x9E3779B97F4A7C15)]
    if len(h) > 1:
        mixed.append((h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return ((np.concatenate(mixed) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def repeat_words(found: list[bytes], hashes: np.ndarray) -> int:
    """How many words lie in a three-word window that occurs twice or more."""
    n = len(found) - 2
    if n < 2:
        return 0
    h = hashes.astype(np.uint64)
    codes = np.sort((h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:])
    if not (codes[1:] == codes[:-1]).any():
        return 0  # equal windows have equal codes
    ids: dict[bytes, int] = {}
    at = np.array([ids.setdefault(w, len(ids)) for w in found], np.int64)
    _, pairs = np.unique(at[:-1] * len(ids) + at[1:], return_inverse=True)
    _, windows, times = np.unique(pairs[:-1] * len(ids) + at[2:], return_inverse=True, return_counts=True)
    again = times[windows] > 1
    covered = np.zeros(len(found), bool)
    for k in range(3):
        covered[k : k + n] |= again
    return int(covered.sum())


def measures(text: str | None) -> tuple[int, int, int, int, int, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words' hashes."""
    text = text or ""
    found = words(text)
    hashes = np.fromiter(map(zlib.crc32, found), np.uint32, len(found))
    dup, seen = 0, set()
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dup += bool(line.strip(SPACES))
            seen.add(line)
    return len(found), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeat_words(found, hashes), hashes


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def score(hashes: np.ndarray, ratios: np.ndarray | None) -> float | None:
    """The mean log2 ratio of a text's n-grams; none for a text without words or without a model."""
    if ratios is None or not len(hashes):
        return None
    return float(ratios[ngrams(hashes, len(ratios))].mean())


def ngram_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many n-grams of the text column fall into each bucket.

    Each task counts its documents' n-grams into `buckets` counters; Spark adds up those.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for i in range(0, len(batch), 1024):
                grams = [np.empty(0, np.int64)]
                for text in batch.column(0).slice(i, 1024).to_pylist():
                    found = words(text)
                    grams.append(ngrams(np.fromiter(map(zlib.crc32, found), np.uint32, len(found)), buckets))
                total += np.bincount(np.concatenate(grams), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    sums = texts.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets)  # as many rows as buckets at most
    counts[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return counts


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, loss: float = MAX_TRUSTED_LOSS) -> tuple[np.ndarray | None, float]:
    """The log2 ratios by bucket, and the threshold, from all documents and all labels.

    The threshold is the one that best tells apart the labelled documents that pass the base rules (the sum of the
    shares of trusted kept and of others rejected, the lowest of equals) of those that
    reject a share of at most `loss` of the trusted. A document that has both labels counts as both; one of several
    rows counts once, by its lowest score. Without trusted documents there is
    no model, and the base rules alone decide.
    """
    flags = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max((F.col("quality") == 1).cast("bigint")).alias("good"), F.max((F.col("quality") == 0).cast("bigint")).alias("bad"))
    )
    trusted = flags.where("good = 1").select("doc_id")
    if trusted.isEmpty():
        return None, 0.0
    pairs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw = ngram_counts(pairs, buckets)
    target = ngram_counts(pairs.where("text IS NOT NULL").join(trusted.hint("merge"), "doc_id"), buckets)  # ids never gather in one place
    ratios = np.log2((target + 1) / (target.sum() + buckets)) - np.log2((raw + 1) / (raw.sum() + buckets))
    model = docs.sparkSession.sparkContext.broadcast(ratios)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1024):
                some, got = batch.slice(i, 1024), []
                for text in some.column(1).to_pylist():
                    found = words(text)
                    hashes = np.fromiter(map(zlib.crc32, found), np.uint32, len(found))
                    got.append(None if base_failed(len(found), repeat_words(found, hashes)) else score(hashes, model.value))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(got, pa.float64())], ["doc_id", "llr"])

    # every text is scored where it lies, so that only ids and scores are shuffled
    scores = pairs.mapInArrow(scored, "doc_id bigint, llr double").where("llr IS NOT NULL").groupBy("doc_id").agg(F.min("llr").alias("llr"))
    points = written(scores.join(flags, "doc_id").groupBy("llr").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "quality-scores")
    try:
        return ratios, threshold(points, loss)
    finally:
        dropped(points)


def threshold(points: DataFrame, loss: float, ranges: int = RANGES) -> float:
    """points: a row for each distinct score llr, with how many trusted (good) and other (bad) documents have it.

    Exact over all points: they are cut into ranges of scores, and counted before each range on the driver (a row for
    a range) and within it by Spark.
    """
    quantiles = points.agg(F.percentile_approx("llr", [k / ranges for k in range(ranges)], 4 * ranges).alias("x")).first().x
    edges = sorted(set(quantiles or [0.0]))
    placed = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="llr", outputCol="range").transform(points)
    sums = placed.groupBy("range").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("llr").alias("last")).orderBy("range").collect()
    n_good, n_bad = sum(r.good for r in sums), sum(r.bad for r in sums)
    if not n_good:
        return float("-inf")
    starts, good, bad, last = [], 0, 0, None
    for r in sums:
        starts.append((r.range, good, bad, last))
        good, bad, last = good + r.good, bad + r.bad, r.last
    starts = points.sparkSession.createDataFrame([s for s in starts if s[1] / n_good <= loss], "range double, good_start bigint, bad_start bigint, last double")
    within = Window.partitionBy("range").orderBy("llr")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    cuts = placed.join(F.broadcast(starts), "range").select(
        "llr",
        "good",
        ((F.col("good_start") + F.coalesce(F.sum("good").over(before), F.lit(0))) / n_good).alias("lost"),
        ((F.col("bad_start") + F.coalesce(F.sum("bad").over(before), F.lit(0))) / max(1, n_bad)).alias("rejected"),
        F.coalesce(F.lag("llr").over(within), "last").alias("below"),
    )
    best = cuts.where((F.col("good") > 0) & (F.col("lost") <= loss)).orderBy((F.col("rejected") - F.col("lost")).desc(), "llr").first()
    below = best.llr - 0.1 if best.below is None else best.below
    half = (best.llr + below) / 2  # halfway to the next lower score
    return half if half > below else best.llr


def quality_rules(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, **fitted) -> DataFrame:
    """docs (its columns in keep, or all) with the COLUMNS of this module added.

    Null text counts as empty and fails the base rules. Input columns with the names of
    added ones are left out. Every row gives one row, repeated ones too; a doc_id that is
    null is never trusted. llr is null without words or without trusted documents.
    """
    ratios, least = fit(docs, labels, **fitted)
    source = without(docs, *COLUMNS)
    kept = source.select([F.col(f"`{c}`") for c in (source.columns if keep is None else keep)])
    names = kept.columns
    model = docs.sparkSession.sparkContext.broadcast((ratios, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, least = model.value
        for whole in batches:
            for i in range(0, len(whole), 1024):
                batch = whole.slice(i, 1024)
                rows = []
                for text in batch.column(len(names)).to_pylist():
                    n, chars, symbols, lines, repeats, hashes = measures(text)
                    failed = base_failed(n, repeats)
                    llr = score(hashes, ratios)
                    rows.append((n, chars, symbols, lines, repeats, failed, llr, not failed and (ratios is None or llr >= least)))
                types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
                new = [pa.array(v, t) for v, t in zip(zip(*rows) if rows else [[]] * 8, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *new], [*names, *COLUMNS])

    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([*kept.schema.fields, *_parse_datatype_string(", ".join(f"{k} {v}" for k, v in COLUMNS.items())).fields])
    return source.select([F.col(f"`{c}`") for c in names] + [F.col("text").cast("string").alias("__text")]).mapInArrow(run, schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])
