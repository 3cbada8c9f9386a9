"""Queries and oracles of review selection, decisions and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import Tables
from ..operators import reports, review, rules
from .assess import FINDINGS


_units = review.population


def _with(f):
    """f over all findings, which a query may read several times."""
    def query(spark, sf):
        t = Tables(spark, sf)
        return f(t, rules.findings_of(t))

    return query


def _plain(f):
    return lambda spark, sf: f(Tables(spark, sf))


def sampling_frame(t, f):
    """Eligible units by stratum, and exclusions by reason."""
    units = _units(t, f).groupBy("stratum").agg(F.count("*").alias("n"), F.count_distinct("submission_id").alias("submissions"))
    assets = t.assets.join(rules.latest_submission(t).select("entity_id", "submission_id"), "entity_id")
    gone = review.excluded(rules.valid(t.cases), assets, f).groupBy(F.col("reason").alias("stratum")).agg(F.count("*").alias("n"), F.count_distinct("submission_id").alias("submissions"))
    return units.unionByName(gone)


def decisions(t: Tables):
    """A decision log: each order with an odd key was decided again, some about another."""
    base = t.cases.select(F.col("case_id").cast("bigint").alias("k"), F.col("created_at").alias("decided_at"))
    first = base.select(F.concat(F.lit("d"), "k").alias("decision_id"), F.concat(F.lit("t"), F.floor(F.col("k") / 2).cast("string")).alias("target_id"), "decided_at", F.lit(None).cast("string").alias("supersedes"))
    again = base.where("k % 3 = 0").select(F.concat(F.lit("e"), "k").alias("decision_id"), F.concat(F.lit("t"), F.floor((F.col("k") + F.col("k") % 2) / 2).cast("string")).alias("target_id"), (F.col("decided_at") + F.expr("INTERVAL 1 DAY")).alias("decided_at"), F.concat(F.lit("d"), (F.col("k") - F.col("k") % 4).cast("string")).alias("supersedes"))
    return first.unionByName(again)


_DECISIONS = """decisions AS (SELECT 'd' || k AS decision_id, 't' || (k // 2) AS target_id, created_at AS decided_at, NULL AS supersedes FROM (SELECT case_id::bigint AS k, created_at FROM cases)
UNION ALL SELECT 'e' || k, 't' || ((k + k % 2) // 2), created_at + INTERVAL 1 DAY, 'd' || (k - k % 4) FROM (SELECT case_id::bigint AS k, created_at FROM cases) WHERE k % 3 = 0)"""
_MAP = lambda values, key: f"CASE {key} " + " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else f"{v}::double") for k, v in values.items()) + " END"
_UNITS = f"""asset_of AS (SELECT case_id, min(asset_id) AS first FROM links JOIN alerts USING (alert_id) WHERE asset_id IS NOT NULL GROUP BY case_id),
own_assets AS (SELECT a.*, l.submission_id FROM assets a JOIN latest l USING (entity_id)),
flagged_assets AS (SELECT object_id FROM findings WHERE object_type = 'asset'), flagged_cases AS (SELECT object_id FROM findings WHERE object_type = 'case'),
units AS (SELECT submission_id, 'finding|' || rule_id || '|' || object_id AS unit_id, 'targeted' AS stratum, CASE WHEN object_type = 'asset' THEN object_id WHEN object_type = 'case' AND rule_id = 'POL-INV-001' THEN coalesce(first, 'unassigned') ELSE 'unassigned' END AS asset,
  rule_id AS category, {_MAP(review.HYPOTHESES, 'rule_id')} AS hypothesis, 1.0::double AS weight, {_MAP(review.MINUTES, 'severity')} AS minutes, {_MAP(review.VALUES, 'severity')} AS value FROM findings LEFT JOIN asset_of ON case_id = object_id
UNION ALL SELECT submission_id, 'coverage|' || asset_id, 'targeted', asset_id, 'absence_of_coverage', 'hyp:absence_of_coverage', 1.0, 12.0, CASE WHEN criticality IN ('CRITICAL', 'HIGH') THEN 2.0 ELSE 1.0 END FROM own_assets WHERE upper(agent_status) IN ('UNHEALTHY', 'DISCONNECTED', 'MISSING') AND coalesce(status, 'ACTIVE') = 'ACTIVE' AND asset_id NOT IN (SELECT object_id FROM flagged_assets)
UNION ALL SELECT submission_id, 'source|' || source_id, 'targeted', 'telemetry-pipeline', 'source_omission', 'hyp:optional_source_omission', 1.0, 8.0, 0.8 FROM sources WHERE is_optional AND declared_rows = 0
UNION ALL SELECT submission_id, 'control-case|' || case_id, 'control', coalesce(assigned_analyst, 'analyst'), 'baseline_control', 'hyp:baseline_compliance', 0.5, 7.0, 0.5 FROM valid_cases WHERE case_id NOT IN (SELECT object_id FROM flagged_cases)
UNION ALL SELECT submission_id, 'control-asset|' || asset_id, 'control', asset_id, 'baseline_control', 'hyp:baseline_healthy_silence', 0.5, 6.0, 0.4 FROM own_assets WHERE upper(agent_status) = 'HEALTHY' AND asset_id NOT IN (SELECT object_id FROM flagged_assets)
UNION ALL SELECT submission_id, 'claim|' || claim_id, 'exploratory', 'kpi-reporting', 'exploratory', 'hyp:exploratory_metric', 1.0, 10.0, 0.6 FROM claims
UNION ALL SELECT submission_id, 'edge-case|' || case_id, 'exploratory', 'edge-cases', 'exploratory', 'hyp:exploratory_edge_case', 0.8, 8.0, 0.5 FROM (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY case_id) AS n FROM valid_cases) WHERE n <= 2 AND case_id NOT IN (SELECT object_id FROM flagged_cases))"""


def observed_against_cases(t, f):
    """Urgent closed cases are expected to be a concern of closure."""
    expected = t.cases.where("severity = 'CRITICAL' AND status = 'CLOSED'").select(F.lit("POL-INV-001").alias("rule_id"), F.col("case_id").alias("object_id"), F.array(F.lit("potential_concern")).alias("acceptable"))
    return review.expected_against(expected, f.where("rule_id = 'POL-INV-001'").select("rule_id", "object_id", "evidence_state"))


def citations(t: Tables):
    c = t.cases.withColumn("digest", F.sha2("status", 256))
    findings = c.select(F.col("case_id").alias("finding_id"), "entity_id", F.array(F.struct(F.col("case_id").alias("record_id"), F.when(F.col("case_id").cast("bigint") % 9 == 0, "x").otherwise(F.col("digest")).alias("digest")), F.struct((F.col("case_id").cast("bigint") + 1).cast("string").alias("record_id"), F.col("digest"))).alias("refs"))
    return review.resolved_citations(findings, c.select(F.col("case_id").alias("record_id"), "entity_id", "digest"))


QUERIES = {
    "p1_candidates": _with(_units), "d23_sampling_frame": _with(sampling_frame),
    "d24_set_value": _with(lambda t, f: review.set_value(_units(t, f))), "d25_coverage": _with(lambda t, f: (lambda u: review.coverage_breakdown(u.where("stratum <> 'exploratory'"), u))(_units(t, f))),
    "p8_portfolios": _with(lambda t, f: review.portfolio(_units(t, f))), "p9_seeded_order": _plain(lambda t: t.cases.select("case_id", review.seeded_order(F.col("case_id"), 7).alias("place"))),
    "p6_quotas": _plain(lambda t: t.raw("part").select("p_partkey", review.quotas(F.col("p_size")).alias("q")).select("p_partkey", "q.targeted", "q.control", "q.exploratory")),
    "e6_active_decisions": _plain(lambda t: review.active_decisions(decisions(t), F.lit("1997-01-01").cast("timestamp")).select("target_id", "decision_id")),
    "e7_lineage_conflicts": _plain(lambda t: review.lineage_conflicts(decisions(t))), "e9_prior_runs": _plain(lambda t: review.prior_runs(t.submissions.select("entity_id", F.col("submission_id").alias("run_id"), F.col("period_start").alias("at"))).select("run_id", F.col("n").cast("bigint").alias("n"), "prior")),
    "c14_citations": _plain(citations), "c16_expected_findings": _with(observed_against_cases), "d26_accuracy": _plain(lambda t: review.accuracy(t.cases.select((F.col("status") == "OPEN").alias("is_control"), (F.col("severity") != "LOW").alias("passed")))),
    "d27_entity_periods": _plain(lambda t: reports.entity_periods(t.submissions, t.sources)), "e6_decision_versions": _plain(lambda t: review.decision_versions(decisions(t))),
}
ORACLE = {
    "p1_candidates": f"{FINDINGS}, {_UNITS} SELECT * FROM units",
    "d23_sampling_frame": f"{FINDINGS}, {_UNITS} SELECT stratum, count(*) AS n, count(DISTINCT submission_id) AS submissions FROM units GROUP BY stratum UNION ALL SELECT 'flagged_by_machine_finding', count(*), count(DISTINCT submission_id) FROM valid_cases WHERE case_id IN (SELECT object_id FROM flagged_cases) UNION ALL SELECT 'flagged_by_coverage_or_asset_finding', count(*), count(DISTINCT submission_id) FROM own_assets WHERE asset_id IN (SELECT object_id FROM flagged_assets)",
    "d24_set_value": f"{FINDINGS}, {_UNITS} SELECT *, alpha * 2 + beta + gamma * 0.5 AS score FROM (SELECT submission_id, sum(least(1, w)) AS alpha FROM (SELECT submission_id, hypothesis, sum(weight) AS w FROM units GROUP BY submission_id, hypothesis) GROUP BY submission_id) JOIN (SELECT submission_id, (count(DISTINCT asset) + count(DISTINCT category) + 1)::double AS beta, sum(value) AS gamma FROM units GROUP BY submission_id) USING (submission_id)",
    "d25_coverage": f"{FINDINGS}, {_UNITS} SELECT submission_id, hypothesis, CASE WHEN w >= 1 THEN 'covered' WHEN w > 0 THEN 'partial' ELSE 'uncovered' END AS state FROM (SELECT submission_id, hypothesis, sum(CASE WHEN stratum <> 'exploratory' THEN weight ELSE 0 END) AS w FROM units GROUP BY submission_id, hypothesis)",
    "p9_seeded_order": FINDINGS + " SELECT case_id, sha256('7:' || case_id) AS place FROM cases",
    "p6_quotas": "SELECT p_partkey, CASE WHEN p_size <= 3 THEN p_size ELSE p_size - c - e END AS targeted, CASE WHEN p_size <= 3 THEN 0 ELSE c END AS control, CASE WHEN p_size <= 3 THEN 0 ELSE e END AS exploratory FROM (SELECT *, greatest(1, round_even(p_size * 0.2, 0))::int AS c, greatest(1, round_even(p_size * 0.1, 0))::int AS e FROM part)",
    "e6_active_decisions": f"{FINDINGS}, {_DECISIONS} SELECT target_id, decision_id FROM decisions WHERE decided_at <= TIMESTAMP '1997-01-01' QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY decided_at DESC, decision_id DESC) = 1",
    "e7_lineage_conflicts": f"{FINDINGS}, {_DECISIONS}, d AS (SELECT *, count(*) OVER (PARTITION BY supersedes) AS rivals FROM decisions WHERE supersedes IS NOT NULL) SELECT d.decision_id, CASE WHEN rivals > 1 THEN 'REPLACED_TWICE' ELSE 'OTHER_TARGET' END AS issue FROM d LEFT JOIN decisions p ON p.decision_id = d.supersedes WHERE rivals > 1 OR p.target_id IS NULL OR p.target_id <> d.target_id",
    "e9_prior_runs": FINDINGS + ", r AS (SELECT submission_id, entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY period_start) AS k FROM submissions) SELECT a.submission_id AS run_id, a.k - b.k - 1 AS n, b.submission_id AS prior FROM r a JOIN r b ON a.entity_id = b.entity_id AND a.k - b.k BETWEEN 1 AND 3",
    "c14_citations": FINDINGS + """, cited AS (SELECT case_id AS finding_id, entity_id, case_id AS record_id, CASE WHEN case_id::bigint % 9 = 0 THEN 'x' ELSE sha256(status) END AS digest FROM cases UNION ALL SELECT case_id, entity_id, (case_id::bigint + 1)::varchar, sha256(status) FROM cases)
SELECT c.finding_id, c.record_id, CASE WHEN r.case_id IS NULL THEN 'RECORD_ABSENT' WHEN r.entity_id <> c.entity_id THEN 'FOREIGN_RECORD' WHEN c.digest <> sha256(r.status) THEN 'DIGEST_MISMATCH' END AS reason FROM cited c LEFT JOIN cases r ON r.case_id = c.record_id""",
    "c16_expected_findings": FINDINGS + """ SELECT coalesce(e.rule_id, o.rule_id) AS rule_id, coalesce(e.object_id, o.object_id) AS object_id, CASE WHEN o.rule_id IS NULL THEN 'missing' WHEN e.rule_id IS NULL THEN 'unexpected' WHEN evidence_state = 'potential_concern' THEN 'matched' ELSE 'wrong_state' END AS outcome
FROM (SELECT 'POL-INV-001' AS rule_id, case_id AS object_id FROM cases WHERE severity = 'CRITICAL' AND status = 'CLOSED') e FULL JOIN r1 o ON e.object_id = o.object_id""",
    "d26_accuracy": FINDINGS + " SELECT count(*) FILTER (WHERE status = 'OPEN' AND severity <> 'LOW') / count(*) FILTER (WHERE status = 'OPEN') AS specificity, count(*) FILTER (WHERE status <> 'OPEN' AND severity <> 'LOW') / count(*) FILTER (WHERE status <> 'OPEN') AS sensitivity FROM cases",
    "d27_entity_periods": FINDINGS + " SELECT entity_id, count(*) AS submissions, arg_max(submission_id, period_end) AS latest, sum(n_cases)::bigint AS cases, (SELECT count(actual_rows) FROM sources f WHERE f.entity_id = s.entity_id) AS files FROM submissions s GROUP BY entity_id",
    "e6_decision_versions": f"{FINDINGS}, {_DECISIONS} SELECT target_id, decision_id, row_number() OVER w AS version, lag(decision_id) OVER w AS before FROM decisions WINDOW w AS (PARTITION BY target_id ORDER BY decided_at, decision_id)",
}
