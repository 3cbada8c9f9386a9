"""Helpers that the operators share: shared scratch tables, words, clashing columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import dropped, shared_dir, shuffles_removed  # noqa: F401

#: Fixed value: a word is a run of characters outside space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to a new table in the shared folder and read again; cuts lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return reread(spark, df.schema, path)


def reread(spark: SparkSession, schema, path: str) -> DataFrame:
    """The table at path; its place is kept so that `dropped` can remove it."""
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns whose names an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() cuts at exactly space and \\t..\\r."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

