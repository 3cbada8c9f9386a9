"""Exact order statistics of large groups in bounded memory.

A group's range is cut into buckets that are counted where the rows lie; the bucket that
holds a wanted place is cut again; only values of the last bucket are put in order. No
task holds a group's values, and counting combines before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets of a range, and how often a range is cut before its values are put in order.
BUCKETS, CUTS = 4096, 1


def _bucket(v: Column, low: Column, high: Column) -> Column:
    """The bucket of v in a range; never falls while v rises. Halves keep the width finite."""
    width = high / 2 - low / 2
    part = F.floor((v / 2 - low / 2) / F.nullif(width, F.lit(0.0)) * BUCKETS)
    return F.least(F.lit(BUCKETS - 1), F.coalesce(part, F.when(v == high, BUCKETS - 1).otherwise(0))).cast("bigint")


def _found(counted: DataFrame, places: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of counted (by, order, c, ...) the row in which each place (by, name, k) lies, with
    k less what comes before it."""
    running = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = counted.withColumn("upto", F.sum("c").over(running))
    met = places.join(upto, by).where((F.col("k") <= F.col("upto")) & (F.col("k") > F.col("upto") - F.col("c")))
    return met.withColumn("k", F.col("k") - (F.col("upto") - F.col("c"))).drop("upto", "c")


def order_statistics(rows: DataFrame, key: str, value: str, places: dict[str, Column]) -> DataFrame:
    """key, n and for each name of places the value at that place (from 1, an expression of
    n) in the ascending values of the key's rows, as doubles. Places below 1 and above n
    are the first and the last. Nulls and values that aren't finite take no part, a group
    of none but those gives no row, equal values count each; a null key is a group.

    rows is read CUTS + 2 times; give a table.
    """
    v = F.col(value).cast("double")
    values = rows.select(F.col(key).alias("g"), v.alias("v")).where(F.col("v").isNotNull() & (F.abs("v") < float("inf"))).withColumn("g", F.struct("g"))
    ranges = values.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.least(F.greatest(place.cast("bigint"), F.lit(1)), F.col("n")).alias("k")) for name, place in places.items()])
    now = ranges.select("g", "n", "low", "high", F.explode(wanted).alias("p")).select("g", "n", "low", "high", "p.*")
    for _ in range(CUTS):
        spans = now.select("g", "low", "high").distinct()
        inside = values.join(spans, "g").where("v >= low AND v <= high")
        counted = inside.groupBy("g", "low", "high", _bucket(F.col("v"), F.col("low"), F.col("high")).alias("b")).agg(F.count("*").alias("c"), F.min("v").alias("first"), F.max("v").alias("last"))
        now = _found(counted, now, ["g", "low", "high"], "b").select("g", "n", "name", "k", F.col("first").alias("low"), F.col("last").alias("high"))
    spans = now.select("g", "low", "high").distinct()
    counted = values.join(spans, "g").where("v >= low AND v <= high").groupBy("g", "low", "high", "v").agg(F.count("*").alias("c"))
    found = _found(counted, now, ["g", "low", "high"], "v")
    return found.groupBy("g", "n").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in places]).select(F.col("g.g").alias(key), "n", *places)


def medians(rows: DataFrame, key: str, value: str, name: str = "med") -> DataFrame:
    """key, name: the median, which lies half-way between the two middle values of an even number."""
    n = F.col("n")
    found = order_statistics(rows, key, value, {"below": F.floor((n + 1) / 2), "above": F.floor(n / 2) + 1})
    return found.select(key, (F.col("below") * 0.5 + F.col("above") * 0.5).alias(name))


def quartiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, q25, median, q75 by the exclusive method, linear at k (n + 1) / 4; null where
    there are fewer than two values."""
    n = F.col("n")

    def at(k: int) -> Column:
        return F.greatest(F.lit(1), F.least(n - 1, F.floor((n + 1) * k / 4)))

    places = {f"{side}{k}": at(k) + step for k in (1, 2, 3) for side, step in (("a", 0), ("b", 1))}
    found = order_statistics(rows, key, value, places)

    def q(k: int) -> Column:
        d = (n + 1) * k - at(k) * 4
        return F.when(n >= 2, (F.col(f"a{k}") * (4 - d) + F.col(f"b{k}") * d) / 4)

    return found.select(key, "n", q(1).alias("q25"), q(2).alias("median"), q(3).alias("q75"))
