"""Append-only checkpoints of custody logs: a frontier of perfect subtrees.

A log's tree splits at the largest power of two, so a log of n events is one perfect
subtree for each bit of n, its peaks, largest first. New events only ever pair up with
peaks and with each other: nothing below a peak is read again. Every perfect node is
kept once, which gives the root at any length from as many nodes as the length has bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import written
from .integrity import leaf_hash, node_hash

NODES = "entity_id string, level int, idx bigint, h string"
PEAKS = "array<struct<level:int,h:string>>"
FRONTIER = f"entity_id string, size bigint, peaks {PEAKS}"


def folded(peaks: Column) -> Column:
    """The root over a log's peaks, smallest first; null for an empty log."""
    return F.aggregate(F.slice(peaks, 2, 64), F.get(peaks, F.lit(0))["h"], lambda below, peak: node_hash(peak["h"], below))


def frontier(spark: SparkSession, path: str, number: int) -> DataFrame:
    """entity_id, size, peaks (smallest first) of every log after a batch."""
    return spark.read.schema(FRONTIER).parquet(f"{path}/frontier/batch={number}") if number >= 0 else spark.createDataFrame([], FRONTIER)


def append(events: DataFrame, path: str, number: int) -> DataFrame:
    """Appends a batch of events (entity_id, seq, digest), numbered from 0, to the logs at
    path; returns entity_id, size, root of the logs that grew.

    The work grows with the new events and with the number of logs, not with their
    length: each level pairs the new nodes of the one below with the peak that waited
    there. A batch reads the frontier of the one before and writes its own, so one that is
    tried again replaces itself. An event whose number doesn't follow its log's last one,
    or comes twice, is an error, and nothing is appended. A batch may be empty.
    """
    spark = events.sparkSession
    before = frontier(spark, path, number - 1)
    came = written(events.groupBy("entity_id").agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.count("*").alias("n"), F.count_distinct("seq").alias("kinds"))
                   .join(before, "entity_id", "left").withColumn("had", F.coalesce("size", F.lit(0))), "came")
    wrong = came.where("low <> had + 1 OR high <> had + n OR kinds <> n").limit(5).collect()
    if wrong:
        raise ValueError("events out of sequence in: " + ", ".join(r.entity_id for r in wrong))
    waiting = written(came.select("entity_id", "had", F.explode("peaks").alias("p")).select("entity_id", F.col("p.level").alias("level"), F.expr("shiftright(had, p.level) - 1").alias("idx"), F.col("p.h").alias("h")), "waiting")
    grown = written(events.select("entity_id", F.lit(0).alias("level"), (F.col("seq") - 1).cast("bigint").alias("idx"), leaf_hash(F.col("digest")).alias("h")), "leaves")
    nodes, peaks = grown, None
    for level in range((came.agg(F.max("high")).first()[0] or 0).bit_length()):
        both = grown.unionByName(waiting.where(F.col("level") == level))
        pairs = written(both.groupBy("entity_id", F.shiftright("idx", 1).alias("up")).agg(F.min_by("h", "idx").alias("l"), F.max_by("h", "idx").alias("r"), F.count("*").alias("n")), "pairs")
        left = pairs.where("n = 1").select("entity_id", F.lit(level).alias("level"), F.col("l").alias("h"))
        grown = pairs.where("n = 2").select("entity_id", F.lit(level + 1).alias("level"), F.col("up").alias("idx"), node_hash(F.col("l"), F.col("r")).alias("h"))
        nodes, peaks = nodes.unionByName(grown), left if peaks is None else peaks.unionByName(left)
    nodes.write.mode("overwrite").parquet(f"{path}/nodes/batch={number}")
    size = came.select("entity_id", F.col("high").alias("size"))
    now = size.limit(0).withColumn("peaks", F.array().cast(PEAKS)) if peaks is None else peaks.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("level", "h"))).alias("peaks")).join(size, "entity_id").select("entity_id", "size", "peaks")
    now.unionByName(before.join(size, "entity_id", "left_anti")).write.mode("overwrite").parquet(f"{path}/frontier/batch={number}")
    return frontier(spark, path, number).join(size.select("entity_id"), "entity_id", "left_semi").select("entity_id", "size", folded(F.col("peaks")).alias("root"))


def roots_at(spark: SparkSession, path: str, lengths: DataFrame) -> DataFrame:
    """entity_id, size, root of logs as they were at given lengths (entity_id, size): the
    nodes over the bits of a length are looked up and folded. Null for lengths of 0 or
    beyond the log."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.call_function("shiftright", F.col("size"), k).bitwiseAND(F.lit(1)) == 1)
    asked = lengths.select("entity_id", F.col("size").cast("bigint").alias("size")).distinct()
    wanted = asked.select("entity_id", "size", F.explode(bits).alias("level")).withColumn("idx", F.expr("shiftright(size, level) - 1"))
    nodes = spark.read.schema(NODES).parquet(f"{path}/nodes")
    found = wanted.join(nodes.select("entity_id", "level", "idx", "h"), ["entity_id", "level", "idx"]).groupBy("entity_id", "size").agg(F.sort_array(F.collect_list(F.struct("level", "h"))).alias("peaks"))
    whole = F.size("peaks") == F.bit_count("size")
    return asked.join(found, ["entity_id", "size"], "left").select("entity_id", "size", F.when(whole, folded(F.col("peaks"))).alias("root"))
