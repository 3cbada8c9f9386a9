"""Anomaly hypotheses per submission or entity (D16-D21) in one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import Tables
from ..shared import written
from .quantiles import medians

NARRATIVE_CHARS, NARRATIVE_COPIES = 20, 3


def hypothesis(df: DataFrame, scope: str, code: Column | str, severity: Column | str, observed: Column, baseline: Column, sample: Column) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(F.col(scope).alias("scope_id"), lit(code).alias("pattern"), lit(severity).alias("severity"), observed.cast("double").alias("observed"), baseline.cast("double").alias("baseline"), sample.cast("bigint").alias("sample"))


def minutes() -> Column:
    return (F.unix_timestamp("closed_at") - F.unix_timestamp("created_at")) / 60.0


def around_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """Adds med and mad of value by key: the median, then the median distance from it, both
    exact and without a group's values in one task."""
    with_med = df.join(written(medians(df, key, value), "medians"), key)
    distances = with_med.select(key, F.abs(F.col(value) - F.col("med")).alias("away"))
    return with_med.join(written(medians(distances, key, "away", "mad"), "medians"), key)


def durations(cases: DataFrame) -> DataFrame:
    """Outliers beyond 3 MAD, or a MAD of zero with 60 percent alike; five cases at least."""
    timed = cases.withColumn("m", minutes()).where("m > 0").select("submission_id", "m")
    g = (around_median(timed, "submission_id", "m").groupBy("submission_id", "med", "mad")
         .agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("m") - F.col("med")) < 0.01).alias("same"), F.count_if(F.abs(F.col("m") - F.col("med")) > 3 * F.col("mad")).alias("far")).where("n >= 5"))
    uniform = g.where("mad = 0 AND same >= n * 0.6")
    outlying = g.where("mad > 0 AND far >= 2")
    return hypothesis(uniform, "submission_id", "PAT-DURATION-ZERO-MAD", "ELEVATED", F.col("same"), F.col("n") * 0.1, F.col("n")).unionByName(hypothesis(outlying, "submission_id", "PAT-DURATION-OUTLIERS", "INFORMATIONAL", F.col("far"), F.round("med", 4), F.col("n")))


def spikes(cases: DataFrame, scope: str = "entity_id") -> DataFrame:
    """Days of five cases or more beyond the median by over 3 MAD (1 if zero); four days at least."""
    days = cases.groupBy(scope, F.to_date("created_at").alias("day")).count()
    g = around_median(days, scope, "count").withColumn("mad", F.when(F.col("mad") == 0, 1.0).otherwise(F.col("mad")))
    spike = (F.col("count") > F.col("med") + 3 * F.col("mad")) & (F.col("count") >= 5)
    out = g.groupBy(scope, "med").agg(F.count("*").alias("n"), F.max(F.when(spike, F.col("count"))).alias("top")).where("n >= 4 AND top IS NOT NULL")
    return hypothesis(out, scope, "PAT-WORKLOAD-SPIKE", "ELEVATED", F.col("top"), F.col("med"), F.col("n"))


def rapid(cases: DataFrame) -> DataFrame:
    """Two cases or more closed within two minutes; severe from 20 percent of all."""
    g = cases.groupBy("submission_id").agg(F.count("*").alias("n"), F.count_if(minutes() <= 2).alias("fast")).where("fast >= 2")
    return hypothesis(g, "submission_id", "PAT-RAPID-CLOSURE", F.when(F.round(F.col("fast") / F.col("n") * 100, 1) >= 20, "HIGH").otherwise("ELEVATED"), F.col("fast"), F.lit(0), F.col("n"))


def narratives(cases: DataFrame, scope: str = "entity_id") -> DataFrame:
    """Closing texts of 20 characters or more, alike but for case and spaces, in three cases or more."""
    text = F.lower(F.trim(F.coalesce("notes", F.lit(""))))
    groups = cases.where(F.length(text) >= NARRATIVE_CHARS).groupBy(scope, F.regexp_replace(text, r"\s+", " ").alias("text")).count().where(F.col("count") >= NARRATIVE_COPIES)
    g = groups.groupBy(scope).agg(F.count("*").alias("clusters"), F.sum("count").alias("n"))
    return hypothesis(g, scope, "PAT-REPEATED-NARRATIVE", "ELEVATED", F.col("n"), F.col("clusters"), F.col("n"))


def silence(t: Tables) -> DataFrame:
    """Entities with five assets or more and one case at most."""
    g = t.assets.groupBy("entity_id").agg(F.count("*").alias("assets")).join(t.cases.groupBy("entity_id").agg(F.count("*").alias("n")), "entity_id", "left").na.fill(0).where("assets >= 5 AND n <= 1")
    return hypothesis(g, "entity_id", "PAT-ACTIVITY-DROP", "HIGH", F.col("n"), F.lit(1), F.col("assets"))


def after_remediation(t: Tables) -> DataFrame:
    """D21 with C11: alerts on an asset after the last case that remediated it closed."""
    disposition, notes = F.lower(F.coalesce("disposition", F.lit(""))), F.lower(F.coalesce("notes", F.lit("")))
    fixed = t.cases.where((disposition.contains("remediat") | notes.contains("remediat") | disposition.contains("resolved")) & F.col("closed_at").isNotNull()).groupBy("entity_id", "asset_id").agg(F.max("closed_at").alias("fixed_at"))
    g = t.alerts.join(fixed, "asset_id").where("ts > fixed_at").groupBy("entity_id").agg(F.count("*").alias("n"), F.count_distinct("asset_id").alias("assets"))
    return hypothesis(g, "entity_id", "PAT-POST-REMEDIATION", "HIGH", F.col("n"), F.lit(0), F.col("assets"))


def hypotheses(t: Tables) -> DataFrame:
    out = None
    for part in (durations(t.cases), spikes(t.cases), rapid(t.cases), narratives(t.cases), silence(t), after_remediation(t)):
        out = part if out is None else out.unionByName(part)
    return out
