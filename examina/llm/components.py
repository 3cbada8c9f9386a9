"""Connected components of a graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Of edges (a, b): id, component for every id in an edge between two ids; component
    is the smallest id reachable.

    A large star links every larger neighbour of a node to its smallest neighbour, a small
    star every smaller one and the node itself; the edges are then stars around the
    smallest ids after a number of rounds that grows with the log of a path's length.
    Every round is one job that writes its edges to the shared folder; edges as large as
    their file lets Spark expect aren't broadcast. Raises if the edges still change after
    most_rounds.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").hint("merge").join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.hint("merge").join(low.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        after = written(small, "edges")
        dropped(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            roots = now.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component"))
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
    raise RuntimeError(f"components: still changing after {most_rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    """A count and an order-free checksum."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
