"""Entity scorecards from findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..adapters import Tables


def adverse() -> Column:
    return F.col("evidence_state").isin(*policy.ADVERSE)


def completeness(sources: DataFrame, cases: DataFrame) -> DataFrame:
    """D6 per submission: received sources of those declared, less 0.3 times the
    quarantined share of rows; verdict at 90 and 60 percent."""
    files = sources.groupBy("submission_id").agg(F.count("*").alias("declared"), F.count("actual_rows").alias("received"))
    rows = cases.groupBy("submission_id").agg(F.count("*").alias("parsed"), F.count_if("is_quarantined").alias("quarantined"))
    penalty = F.when(F.col("parsed") > 0, F.col("quarantined") / F.col("parsed") * 0.3).otherwise(0.0)
    pct = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("received") / F.col("declared") - penalty) * 100))
    out = files.join(rows, "submission_id", "left").na.fill(0, ["parsed", "quarantined"]).withColumn("pct", pct)
    verdict = F.when((F.col("pct") >= 90) & (F.col("received") == F.col("declared")), "SUFFICIENT").when(F.col("pct") >= 60, "PARTIALLY_SUFFICIENT").otherwise("INSUFFICIENT_EVIDENCE")
    return out.select("submission_id", "declared", "received", "parsed", "quarantined", F.round("pct", 1).alias("completeness_pct"), verdict.alias("verdict"))


def gaps(findings: DataFrame) -> DataFrame:
    """D7 per submission: adverse findings by rule, and their weight by severity."""
    bad = findings.where(adverse())

    def n(rule: str) -> Column:
        return F.count_if(F.col("rule_id") == rule)

    weight = F.sum(F.when(F.col("severity") == "critical", 35).when(F.col("severity") == "high", 20).when(F.col("severity") == "medium", 10).when(F.col("severity") == "low", 5).otherwise(0))
    return bad.groupBy("submission_id").agg(F.count("*").alias("adverse"), n("POL-INV-001").alias("unsubstantiated"), n("POL-ESC-002").alias("overdue"), n("POL-REC-005").alias("unlinked"), F.least(F.lit(100), weight).cast("double").alias("gap_score"))


def negative_space(assets: DataFrame, findings: DataFrame) -> DataFrame:
    """D8 per entity: assets with a broken sensor or no telemetry, and the rest."""
    of = findings.where("rule_id = 'POL-COV-003'")
    seen = of.groupBy("entity_id").agg(F.count_distinct(F.when(adverse(), F.col("object_id"))).alias("broken"), F.count_distinct(F.when(F.col("evidence_state") == "insufficient_evidence", F.col("object_id"))).alias("missing"))
    out = assets.groupBy("entity_id").agg(F.count_distinct("asset_id").alias("total")).join(seen, "entity_id", "left").na.fill(0)
    healthy = F.greatest(F.lit(0), F.col("total") - F.col("broken") - F.col("missing"))
    return out.select("entity_id", "total", "broken", "missing", healthy.alias("healthy"), F.round(healthy / F.col("total") * 100, 1).alias("coverage_pct"), ((F.col("broken") > 0) | (F.col("missing") > 0)).alias("blind_spot"))


def claim_outcomes(findings: DataFrame) -> DataFrame:
    """D9 per submission."""
    def n(state: str) -> Column:
        return F.count_if(F.col("evidence_state") == state)

    return findings.where("rule_id = 'POL-KPI-004'").groupBy("submission_id").agg(F.count("*").alias("claims"), n("contradictory").alias("contradicted"), n("insufficient_evidence").alias("open"), n("supported").alias("supported"))


def overview(t: Tables, findings: DataFrame) -> DataFrame:
    """D31 with D10 per entity's latest submission: all summaries, the attention index
    0.35 gap + 0.25 negative space + 0.20 claims + 0.20 evidence, and its band."""
    from .rules import latest_submission

    out = (latest_submission(t).select("entity_id", "submission_id").join(completeness(t.sources, t.cases), "submission_id")
           .join(gaps(findings), "submission_id", "left").join(claim_outcomes(findings), "submission_id", "left")
           .join(negative_space(t.assets, findings), "entity_id", "left")
           .na.fill(0, ["adverse", "unsubstantiated", "overdue", "unlinked", "gap_score", "claims", "contradicted", "open", "supported", "total", "broken", "missing"])
           .na.fill(100.0, ["coverage_pct"]).na.fill(False, ["blind_spot"]))

    def bounded(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))

    index = 0.35 * F.col("gap_score") + 0.25 * bounded(100 - F.col("coverage_pct") + F.col("broken") * 20) + 0.2 * bounded(F.col("contradicted") * 40.0 + F.col("open") * 15.0) + 0.2 * bounded(100 - F.col("completeness_pct"))
    index = F.round(bounded(index), 1)
    return out.select("entity_id", "submission_id", "completeness_pct", "verdict", "adverse", "unsubstantiated", "overdue", "unlinked", "gap_score", "contradicted", "open", "supported", "broken", "missing", "coverage_pct", "blind_spot", index.alias("attention_index"),
                      F.when(index >= 65, "CRITICAL_ATTENTION").when(index >= 30, "ELEVATED").otherwise("ROUTINE").alias("band"))


def capabilities(t: Tables, findings: DataFrame) -> DataFrame:
    """D11 per entity's latest submission: eight statuses. Of a rule's findings the worst state counts."""
    worst = F.when(adverse(), 3).when(F.col("evidence_state") == "insufficient_evidence", 2).otherwise(1)
    by_rule = (findings.groupBy("submission_id").pivot("rule_id", list(policy.RULES)).agg(F.max_by("evidence_state", F.struct(worst, "evidence_state"))))
    card = overview(t, findings).join(by_rule, "submission_id", "left")

    def of(rule: str, otherwise: Column) -> Column:
        return F.coalesce(F.col(f"`{rule}`"), otherwise)

    ok, concern, unsure = F.lit("supported"), F.lit("potential_concern"), F.lit("insufficient_evidence")
    low = F.col("completeness_pct") < 60
    inv, esc = of("POL-INV-001", ok), of("POL-ESC-002", ok)
    rows = {
        "CAP-DET": of("POL-COV-003", F.when(low, unsure).otherwise(ok)), "CAP-INV": inv, "CAP-ESC": esc, "CAP-RESP": of("POL-REC-005", ok),
        "CAP-OPS": F.when(F.col("broken") > 0, concern).when(F.col("verdict") == "INSUFFICIENT_EVIDENCE", unsure).otherwise(ok),
        "CAP-GOV": of("POL-KPI-004", F.lit("not_assessed")), "CAP-DISC": F.when((inv == concern) | (esc == concern), concern).otherwise(ok),
        "CAP-RES": F.when(F.col("blind_spot") | low, concern).otherwise(ok),
    }
    return card.select("entity_id", "submission_id", F.explode(F.array(*[F.struct(F.lit(k).alias("capability"), v.alias("status")) for k, v in rows.items()])).alias("c")).select("entity_id", "submission_id", "c.*")


def rates(findings: DataFrame, submissions: DataFrame) -> DataFrame:
    """D12 per submission: four rates from counts of adverse findings."""
    def n(rule: str) -> Column:
        return F.coalesce(F.count_if(adverse() & (F.col("rule_id") == rule)), F.lit(0))

    counts = findings.groupBy("submission_id").agg(n("POL-ESC-002").alias("esc"), n("POL-INV-001").alias("inv"), n("POL-COV-003").alias("cov"), F.count_if(adverse()).alias("bad"))
    c = submissions.join(counts, "submission_id", "left").na.fill(0, ["esc", "inv", "cov", "bad"])
    return c.select("entity_id", "submission_id", F.least(F.lit(100.0), c.esc * 15.0).alias("overdue_escalation"), F.greatest(F.lit(0.0), 100.0 - c.inv * 20.0).alias("investigation_depth"), F.greatest(F.lit(0.0), 100.0 - c["cov"] * 25.0).alias("sensor_coverage"), (c.bad * 5.0).alias("concern_density"))
