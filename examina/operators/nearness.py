"""Near locality digests without candidate pairs: a banded index with an exact bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: A digest's 128 two-bit codes are 64 hexadecimal digits from this place on: four words of 16, each of four bands.
CODES_AT, WORDS, BANDS, BAND_DIGITS = 9, 4, 16, 4
#: The largest distance of a near digest.
NEAR = 30
#: Pairs that a task measures at a time.
MEASURED = 1 << 20


def _number(digest: Column, at: int, digits: int, signed: bool = False) -> Column:
    return F.conv(F.substring(digest, at, digits), 16, -10 if signed else 10).cast("bigint")


def unary(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of words (uint64) with a bit for each step that a code has taken, so the sum of
    two digests' code differences is the number of bits in which they differ."""
    low = np.uint64(0x5555555555555555)
    ones, twos = words & low, (words >> np.uint64(1)) & low
    return ones | twos | (twos << np.uint64(1)), ones & twos


def moved(value: np.ndarray):
    """The band values, then these with one code a step up or down; -1 where it has no such step."""
    yield value
    for k in range(2 * BAND_DIGITS):
        code = (value >> (2 * k)) & 3
        yield np.where(code < 3, value + (1 << (2 * k)), -1)
        yield np.where(code > 0, value - (1 << (2 * k)), -1)


def near_in_cell(t: pa.Table, most: int) -> pa.Table:
    """i, j, distance of near pairs whose codes differ by a step at most in a band of the cell's
    word: of rows of the cell's own span with each other and with visiting ones."""
    t = t.sort_by([("own", "descending"), ("id", "ascending")])
    own = int(np.count_nonzero(t["own"].to_numpy()))
    ids, check, length, q1, q2 = (t[c].to_numpy().astype(np.int64) for c in ("id", "check", "length", "q1", "q2"))
    words = np.stack([t[f"w{k}"].to_numpy().view(np.uint64) for k in range(WORDS)])
    first, third = unary(words)
    found = []

    def measure(x: np.ndarray, y: np.ndarray) -> None:
        step = np.abs(length[x] - length[y])
        distance = (check[x] != check[y]) + np.where(step > 1, step * 12, step) + np.abs(q1[x] - q1[y]) + np.abs(q2[x] - q2[y])
        keep = distance <= most
        x, y, distance = x[keep], y[keep], distance[keep]
        for codes in (first, third):
            distance = distance + np.bitwise_count(codes[:, x] ^ codes[:, y]).sum(axis=0, dtype=np.int64)
        keep = distance <= most
        if keep.any():
            found.append(np.stack([ids[x[keep]], ids[y[keep]], distance[keep]]))

    word = words[t["word"][0].as_py()] if own else words[0]
    for shift in range(0, 64, 64 * WORDS // BANDS) if own else ():
        band = ((word >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)
        listed = np.argsort(band[:own], kind="stable")
        begin = np.concatenate([[0], np.cumsum(np.bincount(band[:own], minlength=1 << 16))])
        for value in moved(band):
            n = np.where(value >= 0, begin[value + 1] - begin[value], 0)
            ends = np.cumsum(n)
            at = 0
            while at < len(n):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MEASURED, side="right")))
                x = np.repeat(np.arange(at, to), n[at:to])
                y = listed[np.arange(len(x)) - np.repeat(ends[at:to] - n[at:to] - (ends[at - 1] if at else 0), n[at:to]) + np.repeat(begin[value[at:to]], n[at:to])]
                once = (x >= own) | (x < y)  # both sides of an own pair are looked up
                measure(x[once], y[once])
                at = to
    i, j, d = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((3, 0), np.int64)
    return pa.table({"i": i, "j": j, "distance": d})


def near_digests(digests: DataFrame, most: int = NEAR) -> DataFrame:
    """a, b, distance of every two distinct digests (column digest, a < b) at a distance of
    `most` or less; which rows have a digest is the caller's own table.

    The codes fall into BANDS bands. Of two digests whose codes differ by less than twice
    as many steps one band differs by one step at most, so digests of a length are listed by
    their bands and looked up by the same bands with no code or one of them moved by a step,
    among lengths that the distance allows. That finds every pair; what meets is then
    measured in full. A cell is a span of lengths and a word of four bands: a digest goes to
    its own span's cells and visits the next one's, eight rows in all, and is looked up where
    they lie, so neither the moved bands nor what meets is ever a row. Rows without a digest
    take no part, copies count once, and `most` must be below 2 * BANDS.
    """
    if most >= 2 * BANDS:
        raise ValueError(f"near_digests finds distances below {2 * BANDS}")
    d = F.col("digest")
    rows = written(digests.select("digest").where("digest IS NOT NULL").distinct().select(
        "digest", _number(d, 3, 2).cast("int").alias("check"), _number(d, 5, 2).cast("int").alias("length"), _number(d, 7, 1).cast("int").alias("q1"), _number(d, 8, 1).cast("int").alias("q2"),
        *[_number(d, CODES_AT + 16 * k, 16, signed=True).alias(f"w{k}") for k in range(WORDS)]).withColumn("id", F.monotonically_increasing_id()), "digests")
    reach = 1 if most < 24 else most // 12  # steps of length that a near digest may be away
    span = F.floor(F.col("length") / (reach + 1))
    cells = F.explode(F.array(*[F.struct((span + k).alias("span"), F.lit(w).alias("word"), F.lit(k == 0).alias("own")) for k in (0, 1) for w in range(WORDS)]))
    dealt = rows.drop("digest").withColumn("cell", cells).select("*", "cell.*").drop("cell")
    near = dealt.groupBy("span", "word").applyInArrow(lambda t: near_in_cell(t, most), "i bigint, j bigint, distance bigint").distinct()
    # Spark can't know how few or many rows these are, so none is broadcast
    name = rows.select("id", "digest").hint("merge")
    found = near.hint("merge").join(name.select(F.col("id").alias("i"), F.col("digest").alias("p")), "i").hint("merge").join(name.select(F.col("id").alias("j"), F.col("digest").alias("q")), "j")
    return found.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "distance")
