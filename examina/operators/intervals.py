"""Joins of moments with intervals by bins of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of the finest bin; each level's bins are eight times as long.
FINEST, LEVELS = 86_400, 7


def _level(seconds: Column) -> Column:
    """The finest level on which an interval of that length touches nine bins at most; the
    last level's bins are centuries."""
    out = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        out = F.when(seconds <= FINEST * 8 ** (k + 1), k).otherwise(out)
    return out


def _bin(seconds: Column, level: Column) -> Column:
    return F.floor(seconds / (F.lit(FINEST) * F.pow(F.lit(8), level))).cast("bigint")


def within(moments: DataFrame, intervals: DataFrame, keys: list[str], at: str, begin: str, end: str) -> DataFrame:
    """The rows of moments that lie in an interval with the same keys, both ends included.

    Intervals are listed by the bins that they touch, on a level that fits their length,
    and a moment asks for its bin on every level, so the join has an equality on keys and
    bin, and rows of one hot key spread over its bins; the times themselves decide. A row
    comes once for each level on which an interval holds it: take its key's distinct
    values. Null times are in no interval; one that ends before it begins holds none.
    """
    seconds = {c: F.unix_timestamp(c) for c in (at, begin, end)}
    right = (intervals.where(F.col(begin) <= F.col(end)).withColumn("__l", _level(seconds[end] - seconds[begin]))
             .withColumn("__b", F.explode(F.sequence(_bin(seconds[begin], F.col("__l")), _bin(seconds[end], F.col("__l")))))
             .select(*[F.col(c).alias(f"__{c}") for c in keys], F.col(begin).alias("__begin"), F.col(end).alias("__end"), "__l", "__b"))
    bins = F.array(*[F.struct(F.lit(k).alias("level"), _bin(seconds[at], F.lit(k)).alias("bin")) for k in range(LEVELS)])
    asked = moments.where(F.col(at).isNotNull()).withColumn("__at", F.explode(bins))
    on = (F.col("__at.level") == F.col("__l")) & (F.col("__at.bin") == F.col("__b")) & (F.col(at) >= F.col("__begin")) & (F.col(at) <= F.col("__end"))
    for c in keys:
        on = on & (F.col(c) == F.col(f"__{c}"))
    return asked.join(right, on, "left_semi").drop("__at")
