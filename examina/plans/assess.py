"""Queries and oracles of the assessment: rules, claims, exceptions, completeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import policy
from ..adapters import Tables, ctes
from ..operators import exceptions, rules

_ACCEPTED = """accepted AS (
SELECT exception_id, entity_id, policy_reference, target_type, target_id, valid_from, valid_to FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, exception_id ORDER BY row_id) AS n FROM (
    SELECT row_id, exception_id, entity_id, policy_reference, coalesce(nullif(target_type, ''), CASE WHEN affected_scope LIKE '%:%' THEN split_part(affected_scope, ':', 1) END) AS target_type,
      coalesce(nullif(target_id, ''), CASE WHEN affected_scope LIKE '%:%' THEN substring(affected_scope, strpos(affected_scope, ':') + 1) END) AS target_id, valid_from, coalesce(valid_to, expiry_date) AS valid_to
    FROM exceptions WHERE lower(trim(status)) IN ('approved', 'active') AND trim(approved_by) <> '' AND trim(reason) <> '')
  WHERE target_type IS NOT NULL AND target_id IS NOT NULL AND valid_from IS NOT NULL AND valid_to IS NOT NULL) WHERE n = 1),
valid_cases AS (SELECT * FROM cases WHERE NOT is_quarantined)"""


def _excused(rule: str, kind: str, key: str, at: str, alias: str = "o") -> str:
    return f"EXISTS (SELECT 1 FROM accepted x WHERE x.entity_id = {alias}.entity_id AND x.policy_reference IN ('{rule}', '*') AND x.target_type IN ('{kind}', '*') AND x.target_id IN ({alias}.{key}, '*') AND {alias}.{at} BETWEEN x.valid_from AND x.valid_to)"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _says(column: str) -> str:
    return f"coalesce(upper(trim({column})) NOT IN {_in(policy.PLACEHOLDERS)}, false)"


_LIMIT = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in policy.ESCALATION_SECONDS.items()) + " ELSE 86400 END"
_CLOSE = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in policy.CLOSURE_SECONDS.items()) + " ELSE 86400 END"
_STATUS = f"""kept AS (SELECT source_id, count(*) AS kept, count(DISTINCT native_id) AS ids, bool_or(is_quarantined) AS quarantined FROM records GROUP BY source_id),
shared AS (SELECT submission_id, record_type, count(*) > count(DISTINCT native_id) AS shared FROM records GROUP BY submission_id, record_type),
reasons AS (
  SELECT s.submission_id, s.record_type, s.source_id, CASE WHEN actual_rows IS NULL THEN 'not_submitted' WHEN sampling_method <> 'full_population' THEN 'sampled'
    WHEN regexp_matches(lower(export_scope), 'sample|subset|partial|filtered|incomplete|selected') THEN 'partial_scope'
    WHEN actual_rows <> declared_rows OR coalesce(kept, 0) <> actual_rows THEN 'count_mismatch' WHEN quarantined THEN 'quarantined_records' WHEN ids < kept THEN 'duplicate_ids'
    WHEN EXISTS (SELECT 1 FROM issues i WHERE i.source_id = s.source_id AND (i.severity = 'error' OR i.issue_type IN {_in(policy.BLOCKING_ISSUES)})) THEN 'blocking_issue'
    WHEN s.period_start <> p.period_start OR s.period_end <> p.period_end THEN 'period_not_covered' END AS reason
  FROM sources s JOIN submissions p USING (submission_id) LEFT JOIN kept k ON k.source_id = s.source_id),
status AS (
SELECT submission_id, record_type, reason IS NULL AS complete, reason FROM (
  SELECT s.submission_id, v.record_type, CASE WHEN NOT EXISTS (SELECT 1 FROM reasons r WHERE r.submission_id = s.submission_id AND r.record_type = v.record_type) THEN 'not_declared'
    ELSE coalesce((SELECT arg_min(reason, source_id) FROM reasons r WHERE r.submission_id = s.submission_id AND r.record_type = v.record_type AND reason IS NOT NULL), CASE WHEN h.shared THEN 'overlapping_ids' END) END AS reason
  FROM submissions s CROSS JOIN (VALUES {", ".join(f"('{r}')" for r in policy.RECORD_TYPES)}) v(record_type) LEFT JOIN shared h ON h.submission_id = s.submission_id AND h.record_type = v.record_type))"""
_LATEST = "latest AS (SELECT entity_id, arg_max(submission_id, period_end) AS submission_id, max(period_end) AS period_end FROM submissions GROUP BY entity_id)"


def _whole(kind: str, column: str = "submission_id") -> str:
    return f"coalesce((SELECT complete FROM status s WHERE s.submission_id = o.{column} AND s.record_type = '{kind}'), false)"


_R1 = f"""r1 AS (
SELECT entity_id, submission_id, 'POL-INV-001' AS rule_id, 'case' AS object_type, case_id AS object_id,
  CASE WHEN {_whole('investigation_actions')} THEN 'potential_concern' ELSE 'insufficient_evidence' END AS evidence_state,
  CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'high' ELSE 'medium' END AS severity, missing::double AS measure
FROM (SELECT c.*, CASE WHEN severity = 'CRITICAL' AND NOT coalesce(iso, false) THEN 1 ELSE 0 END + CASE WHEN severity = 'CRITICAL' AND NOT coalesce(tri_hash, false) THEN 1 ELSE 0 END
    + CASE WHEN severity = 'HIGH' AND NOT coalesce(tri, false) THEN 1 ELSE 0 END
    + CASE WHEN NOT ({_says('disposition')} OR {_says('root_cause')} OR {_says('resolution')} OR {_says('closing_notes')}) AND NOT coalesce(triage, false) THEN 1 ELSE 0 END AS missing
  FROM valid_cases c LEFT JOIN (SELECT case_id, bool_or(action_type = 'HOST_ISOLATION' AND {_says('artifact_hash')}) AS iso, bool_or(action_type = 'FORENSIC_TRIAGE') AS tri,
      bool_or(action_type = 'FORENSIC_TRIAGE' AND {_says('artifact_hash')}) AS tri_hash, bool_or(lower(action_type) LIKE '%triage%') AS triage FROM actions GROUP BY case_id) a USING (case_id)
  WHERE status IN ('CLOSED', 'RESOLVED')) o
WHERE missing > 0 AND NOT {_excused('POL-INV-001', 'case', 'case_id', 'created_at')}
UNION ALL SELECT entity_id, submission_id, 'POL-INV-001', 'submission', submission_id, 'insufficient_evidence', 'medium', 1.0 FROM submissions WHERE submission_id NOT IN (SELECT submission_id FROM valid_cases))"""
_R2 = f"""r2 AS (
SELECT entity_id, submission_id, 'POL-ESC-002' AS rule_id, 'case' AS object_type, case_id AS object_id,
  CASE WHEN n IS NULL AND (told OR NOT whole) THEN 'insufficient_evidence' ELSE 'potential_concern' END AS evidence_state,
  CASE WHEN n IS NULL AND NOT told AND whole THEN 'high' ELSE 'medium' END AS severity, round(coalesce(late, 0), 4) AS measure
FROM (SELECT o.*, n, epoch(first - due) / 3600.0 AS late, {_whole('escalations')} AS whole,
    regexp_matches(lower(concat_ws(' ', investigation_notes, closing_notes, notes, disposition)), '{"|".join(policy.OUT_OF_BAND)}') AS told
  FROM (SELECT c.*, created_at + to_seconds({_LIMIT}) AS due, period_end FROM valid_cases c JOIN submissions USING (submission_id, entity_id)) o
  LEFT JOIN (SELECT case_id, min(ts) AS first, count(*) AS n FROM (SELECT DISTINCT case_id, escalation_id, ts FROM escalations) GROUP BY case_id) USING (case_id)
  WHERE severity IN ('CRITICAL', 'HIGH') AND due <= period_end AND NOT coalesce(closed_at <= due, false) AND NOT {_excused('POL-ESC-002', 'case', 'case_id', 'created_at')})
WHERE n IS NULL OR late > 0)"""
_R3 = f"""r3 AS (
SELECT entity_id, submission_id, 'POL-COV-003' AS rule_id, 'asset' AS object_type, asset_id AS object_id,
  CASE WHEN broken THEN 'potential_concern' ELSE 'insufficient_evidence' END AS evidence_state, CASE WHEN broken THEN 'high' ELSE 'medium' END AS severity, 1.0::double AS measure
FROM (SELECT *, upper(coalesce(agent_status, '')) IN {_in(policy.BROKEN_AGENTS)} AS broken FROM assets) JOIN latest USING (entity_id)
WHERE criticality IN ('HIGH', 'CRITICAL') AND coalesce(status, 'ACTIVE') = 'ACTIVE' AND (broken OR (agent_status IS NULL AND last_heartbeat IS NULL AND last_seen IS NULL))
UNION ALL SELECT entity_id, submission_id, 'POL-COV-003', 'submission', submission_id, 'insufficient_evidence', 'high', 1.0 FROM latest WHERE entity_id NOT IN (SELECT entity_id FROM assets))"""
_TRIAGED = f"""triaged AS (
SELECT *, CASE WHEN kind IS NULL THEN 'out_of_scope_metric' WHEN claim_entity <> entity_id THEN 'out_of_scope_entity' WHEN claim_start >= claim_end THEN 'invalid_claim_period'
  WHEN claim_end <= period_start OR claim_start >= period_end THEN 'out_of_scope_period' WHEN claim_start < period_start OR claim_end > period_end THEN 'claim_period_not_fully_covered'
  WHEN lower(unit) NOT IN {_in(policy.PERCENT_UNITS)} THEN 'unsupported_metric_unit' WHEN claimed IS NULL THEN 'malformed_missing_value'
  WHEN value IS NULL THEN 'malformed_non_numeric_value' WHEN value < 0 OR value > 100 THEN 'malformed_value_out_of_range' END AS exclusion_reason
FROM (SELECT *, CASE WHEN lower(metric_name) IN {_in(policy.CLOSURE_METRICS)} THEN 'closure' WHEN lower(metric_name) IN {_in(policy.ESCALATION_METRICS)} THEN 'escalation' END AS kind,
  try_cast(claimed AS double) AS value FROM claims))"""
_CLAIMS = f"""met AS (
SELECT v.claim_id, v.kind, o.*, v.period_end, o.created_at + to_seconds(CASE WHEN v.kind = 'escalation' THEN {_LIMIT} ELSE {_CLOSE} END) AS due FROM valid_cases o
JOIN (SELECT * FROM triaged WHERE exclusion_reason IS NULL) v ON v.submission_id = o.submission_id AND o.created_at >= v.claim_start AND o.created_at < v.claim_end
WHERE (kind = 'closure' OR severity IN ('CRITICAL', 'HIGH'))
  AND NOT (kind = 'escalation' AND {_excused('POL-ESC-002', 'case', 'case_id', 'created_at')}) AND NOT (kind = 'closure' AND {_excused('POL-INV-001', 'case', 'case_id', 'created_at')})),
outcomes AS (
SELECT claim_id, CASE WHEN kind = 'escalation' THEN CASE WHEN EXISTS (SELECT 1 FROM escalations e WHERE e.case_id = o.case_id AND e.ts >= o.created_at AND e.ts < o.period_end AND e.ts <= o.due) THEN 'yes'
    WHEN due <= period_end AND {_whole('escalations')} THEN 'no' ELSE 'unknown' END
  WHEN closed_at < created_at THEN 'unknown' WHEN closed_at <= due AND closed_at < period_end THEN 'yes' WHEN due <= period_end THEN 'no' ELSE 'unknown' END AS outcome FROM met o),
reconciled AS (
SELECT *, CASE WHEN population = 0 THEN 'insufficient_evidence' WHEN value > upper_pct THEN 'contradictory' WHEN lower_pct >= value THEN 'supported' WHEN unknown > 0 THEN 'insufficient_evidence' ELSE 'supported' END AS evidence_state
FROM (SELECT *, CASE WHEN population > 0 THEN round(yes / population * 100, 2) ELSE 0 END AS lower_pct, CASE WHEN population > 0 THEN round((yes + unknown) / population * 100, 2) ELSE 0 END AS upper_pct
  FROM (SELECT o.entity_id, o.submission_id, o.claim_id, o.kind, o.value, CASE WHEN {_whole('cases')} THEN coalesce(n, 0) ELSE 0 END AS population, coalesce(yes, 0) AS yes, coalesce(unknown, 0) AS unknown
    FROM triaged o LEFT JOIN (SELECT claim_id, count(*) AS n, count(*) FILTER (WHERE outcome = 'yes') AS yes, count(*) FILTER (WHERE outcome = 'unknown') AS unknown FROM outcomes GROUP BY claim_id) USING (claim_id)
    WHERE exclusion_reason IS NULL)))"""
_R4 = """r4 AS (SELECT entity_id, submission_id, 'POL-KPI-004' AS rule_id, 'claim' AS object_type, claim_id AS object_id, evidence_state, CASE WHEN evidence_state = 'contradictory' THEN 'high' ELSE 'medium' END AS severity, upper_pct::double AS measure FROM reconciled
UNION ALL SELECT min(entity_id), submission_id, 'POL-KPI-004', 'source', min(source_id), 'insufficient_evidence', 'medium', 0.0 FROM sources WHERE record_type = 'reported_claims' AND submission_id NOT IN (SELECT submission_id FROM claims) GROUP BY submission_id)"""
_R5 = f"""r5 AS (
SELECT o.entity_id, submission_id, 'POL-REC-005' AS rule_id, 'asset' AS object_type, asset_id AS object_id, 'potential_concern' AS evidence_state, 'medium' AS severity, cases::double AS measure
FROM (SELECT asset_id, a.entity_id, submission_id, period_end FROM assets a JOIN latest USING (entity_id)) o
JOIN (SELECT asset_id, count(DISTINCT alert_id) AS alerts, count(DISTINCT case_id) AS cases FROM alerts LEFT JOIN links USING (alert_id) GROUP BY asset_id HAVING count(DISTINCT alert_id) >= {policy.RECURRENCE}) USING (asset_id)
WHERE NOT {_excused('POL-REC-005', 'asset', 'asset_id', 'period_end')})"""

BASE = ("cases", "submissions", "actions", "escalations", "links", "assets", "alerts", "exceptions", "claims", "records", "sources", "issues", "remediations")
#: All common table expressions that end in `findings`.
FINDINGS = ",\n".join(["WITH " + ctes(*BASE), _ACCEPTED, _STATUS, _LATEST, _R1, _R2, _R3, _TRIAGED, _CLAIMS, _R4, _R5,
                       "findings AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4 UNION ALL SELECT * FROM r5)"])


def _q(rule):
    return lambda spark, sf: rule(Tables(spark, sf))


def exceptions_in_force(t: Tables):
    return exceptions.accepted(t.exceptions).select("exception_id", "entity_id", "policy_reference", "target_type", "target_id")


def excused_cases(t: Tables):
    return exceptions.excused(t.cases, t.exceptions, "POL-ESC-002", "case", "case_id", "created_at")


def source_completeness(t: Tables):
    return rules.source_status(t)


def claim_triage(t: Tables):
    return rules.triaged_claims(t.claims).select("claim_id", "submission_id", "kind", "value", "exclusion_reason")


def findings_by_state(t: Tables):
    """D4, pivoted by state, with severities counted."""
    f = rules.assess(t)
    states = ("potential_concern", "contradictory", "insufficient_evidence", "supported")
    return f.groupBy("rule_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("evidence_state") == s).alias(s) for s in states], F.count_if(F.col("severity") == "high").alias("high"))


def affected_assets(t: Tables):
    """R7 with F4: each asset's first three linked cases and how many there are."""
    pairs = t.alerts.select("alert_id", "asset_id").join(t.links, "alert_id").select("asset_id", "case_id").distinct()
    ids = F.array_sort(F.collect_set("case_id"))
    return pairs.groupBy("asset_id").agg(F.array_join(F.slice(ids, 1, 3), ",").alias("first_cases"), F.count("*").alias("n_cases"))


QUERIES = {
    "r1_closure_evidence": _q(rules.closure), "r2_escalation_deadline": _q(rules.escalation), "r3_monitoring_coverage": _q(rules.coverage),
    "r4_kpi_claims": _q(rules.kpi), "r4_reconciled_claims": _q(rules.reconciled_claims), "r5_recurrence": _q(rules.recurrence), "r6_all_findings": _q(rules.assess),
    "c6_excused_cases": _q(excused_cases), "c7_exceptions_in_force": _q(exceptions_in_force), "d3_source_completeness": _q(source_completeness), "b32_source_predicates": _q(rules.source_predicates),
    "b27_claim_triage": _q(claim_triage), "d4_findings_by_state": _q(findings_by_state), "r7_affected_assets": _q(affected_assets),
    "g2_escalation_times": _q(lambda t: rules.escalation_times(t).select("case_id", "escalation_id", F.unix_timestamp("ts").alias("ts"))),
}
ORACLE = {
    "r1_closure_evidence": FINDINGS + " SELECT * FROM r1", "r2_escalation_deadline": FINDINGS + " SELECT * FROM r2", "r3_monitoring_coverage": FINDINGS + " SELECT * FROM r3",
    "r4_kpi_claims": FINDINGS + " SELECT * FROM r4", "r5_recurrence": FINDINGS + " SELECT * FROM r5", "r6_all_findings": FINDINGS + " SELECT * FROM findings",
    "r4_reconciled_claims": FINDINGS + " SELECT entity_id, submission_id, claim_id, kind, value, population, yes, unknown, lower_pct, upper_pct, evidence_state FROM reconciled",
    "g2_escalation_times": FINDINGS + " SELECT case_id, escalation_id, epoch(min(ts))::bigint AS ts FROM escalations GROUP BY case_id, escalation_id",
    "c6_excused_cases": FINDINGS + f" SELECT DISTINCT case_id FROM cases o WHERE {_excused('POL-ESC-002', 'case', 'case_id', 'created_at')}",
    "c7_exceptions_in_force": FINDINGS + " SELECT exception_id, entity_id, policy_reference, target_type, target_id FROM accepted",
    "d3_source_completeness": FINDINGS + " SELECT * FROM status",
    "b32_source_predicates": FINDINGS + """ SELECT s.submission_id, coalesce((SELECT string_agg(DISTINCT record_type, ',' ORDER BY record_type) FROM (SELECT submission_id, record_type FROM records UNION SELECT submission_id, record_type FROM sources WHERE actual_rows IS NOT NULL) x WHERE x.submission_id = s.submission_id), '') AS available,
  coalesce(bool_or(record_type = 'reported_claims'), false) AS claims_declared, coalesce(bool_or(record_type = 'escalations' OR contains(lower(export_scope), 'escalat')), false) AS escalations_declared FROM submissions s LEFT JOIN sources USING (submission_id) GROUP BY s.submission_id""",
    "b27_claim_triage": FINDINGS + " SELECT claim_id, submission_id, kind, value, exclusion_reason FROM triaged",
    "d4_findings_by_state": FINDINGS + " SELECT rule_id, count(*) AS n, count(*) FILTER (WHERE evidence_state = 'potential_concern') AS potential_concern, count(*) FILTER (WHERE evidence_state = 'contradictory') AS contradictory, count(*) FILTER (WHERE evidence_state = 'insufficient_evidence') AS insufficient_evidence, count(*) FILTER (WHERE evidence_state = 'supported') AS supported, count(*) FILTER (WHERE severity = 'high') AS high FROM findings GROUP BY rule_id",
    "r7_affected_assets": FINDINGS + " SELECT asset_id, array_to_string(list_slice(list_sort(list(case_id)), 1, 3), ',') AS first_cases, count(*) AS n_cases FROM (SELECT DISTINCT asset_id, case_id FROM alerts JOIN links USING (alert_id)) GROUP BY asset_id",
}
