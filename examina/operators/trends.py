"""Trends over reporting periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..adapters import Tables
from .scorecard import adverse, completeness

#: Days between two periods from which on a gap is reported.
GAP_DAYS = 35


def period_label(start: Column, last: Column) -> Column:
    """A calendar quarter, else both dates; last is the period's last day."""
    whole = (F.month(start) % 3 == 1) & (F.month(last) == F.month(start) + 2)
    return F.when(whole, F.concat(F.year(start).cast("string"), F.lit("-Q"), F.quarter(start).cast("string"))).otherwise(F.concat(F.date_format(start, "yyyy-MM-dd"), F.lit(" to "), F.date_format(last, "yyyy-MM-dd")))


def points(t: Tables, findings: DataFrame) -> DataFrame:
    """D22 per submission: completeness, density, rates and the trend index, which isn't
    the attention index of a scorecard."""
    def n(rule: str) -> Column:
        return F.count_if(F.col("rule_id") == rule)

    bad = findings.where(adverse()).groupBy("submission_id").agg(F.count("*").alias("adverse"), n("POL-INV-001").alias("inv"), n("POL-ESC-002").alias("esc"))
    rows = (t.submissions.join(completeness(t.sources, t.cases).select("submission_id", F.round(F.col("received") / F.col("declared") * 100, 1).alias("completeness_pct"), (F.col("parsed") - F.col("quarantined")).alias("cases")), "submission_id")
            .join(bad, "submission_id", "left").na.fill(0, ["adverse", "inv", "esc"]))

    def per(c: str, digits: int) -> Column:
        return F.when(F.col("cases") > 0, F.round(F.col(c) / F.col("cases") * 100, digits)).otherwise(0.0)

    closing, overdue = per("inv", 1), per("esc", 1)
    index = F.least(F.lit(100.0), F.round(F.col("adverse") * 8.0 + F.greatest(F.lit(0.0), 100 - F.col("completeness_pct")) * 0.4 + closing * 0.5 + overdue * 0.5 + 1e-9, 1))  # the last term keeps ties from falling by binary fractions
    return rows.select("entity_id", "submission_id", "period_start", "period_end", period_label(F.col("period_start"), F.col("period_end") - F.expr("INTERVAL 1 DAY")).alias("label"), "completeness_pct", "cases", "adverse", per("adverse", 2).alias("density"), closing.alias("closure_rate"), overdue.alias("escalation_rate"), index.alias("trend_index"))


def with_gaps(of: DataFrame) -> DataFrame:
    """The points, and a row without figures for every gap of over GAP_DAYS days."""
    following = F.lead("period_start").over(W.partitionBy("entity_id").orderBy("period_start"))
    days = F.datediff(following, "period_end")
    rows = of.select("entity_id", F.col("label"), F.col("trend_index"), "period_end", following.alias("following"), days.alias("days"))
    gap = F.when(F.col("days") > GAP_DAYS, F.struct(period_label(F.date_add("period_end", 1).cast("timestamp"), F.date_sub("following", 1).cast("timestamp")).alias("label"), F.lit(None).cast("double").alias("trend_index"), F.col("days").alias("gap_days")))
    own = F.struct(F.col("label"), F.col("trend_index"), F.lit(None).cast("int").alias("gap_days"))
    return rows.select("entity_id", F.explode(F.array_compact(F.array(own, gap))).alias("p")).select("entity_id", "p.*")


def trajectories(of: DataFrame) -> DataFrame:
    """E5 per entity: from the first to the last period's index and adverse findings."""
    g = of.groupBy("entity_id").agg(F.count("*").alias("periods"), *[f(c, "period_start").alias(f"{k}_{c}") for k, f in (("first", F.min_by), ("last", F.max_by)) for c in ("trend_index", "adverse")])
    delta = F.col("last_trend_index") - F.col("first_trend_index")
    state = (F.when(F.col("periods") < 2, "INSUFFICIENT_HISTORY").when((delta <= -15) | ((delta < 0) & (F.col("last_adverse") == 0) & (F.col("first_adverse") > 0)), "IMPROVING")
             .when((delta >= 15) | (F.col("last_adverse") > F.col("first_adverse") + 2), "DETERIORATING").otherwise("STABLE"))
    return g.select("entity_id", "periods", F.round(delta, 1).alias("change"), state.alias("trajectory"))


def canonical(submissions: DataFrame) -> DataFrame:
    """Of an entity's submissions for one period the last committed, else the last
    made (entity_id, period_start, revision, status)."""
    order = W.partitionBy("entity_id", "period_start").orderBy(F.when(F.col("status") == "committed", 0).otherwise(1), F.desc("revision"))
    return submissions.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def next_revision(submissions: DataFrame) -> DataFrame:
    """The revision that a resend of each period would get."""
    return submissions.groupBy("entity_id", "period_start").agg((F.max("revision") + 1).alias("next_revision"))


def policy_changes(runs: DataFrame) -> DataFrame:
    """Runs whose policy version differs from the one before (entity_id, period_start, policy_version)."""
    before = F.lag("policy_version").over(W.partitionBy("entity_id").orderBy("period_start"))
    return runs.withColumn("before", before).where("before <> policy_version").select("entity_id", "period_start", "before", "policy_version")
