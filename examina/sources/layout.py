"""Contract tables by entity and submission, read through a table of grants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def laid_out(rows: DataFrame, path: str) -> None:
    """Writes rows (with entity_id and submission_id) in a folder for each entity, in files
    that hold ranges of submissions; a large entity falls into several."""
    ordered = rows.repartitionByRange("entity_id", "submission_id").sortWithinPartitions("entity_id", "submission_id")
    ordered.write.mode("overwrite").partitionBy("entity_id").parquet(path)


def scoped(spark: SparkSession, path: str, grants: DataFrame, user: str) -> DataFrame:
    """The rows of a laid-out table that grants (user, entity_id, submission_id) let a user
    see: an entity of `*` is every one, a null submission all of its entity; none without a
    grant. Only granted entities' folders are read: the grants prune them when the query
    runs, as long as Spark finds the user's grants small enough to broadcast, which it
    decides by their size."""
    rows = spark.read.parquet(path)
    own = grants.where(F.col("user") == user)
    if not own.where("entity_id = '*'").isEmpty():
        return rows
    g = own.select(F.col("entity_id").alias("__entity"), F.col("submission_id").alias("__submission"))
    return rows.join(g, (F.col("entity_id") == F.col("__entity")) & (F.col("__submission").isNull() | (F.col("submission_id") == F.col("__submission"))), "left_semi")
