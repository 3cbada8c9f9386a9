"""Contract tables from the driver's star schema.

Each adapter is a SELECT in the SQL that Spark and DuckDB share, so a query and its
oracle start from the same rows. Times are UTC.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_CASE_TIME = "CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' MINUTE * (o_orderkey % 1440)"
_ENTITY = "'CSE-' || CAST(c_nationkey AS STRING)"
_SUBMISSION = _ENTITY + " || '-' || CAST(year(o_orderdate) AS STRING) || 'Q' || CAST(quarter(o_orderdate) AS STRING)"

#: name -> SELECT over the driver's tables and adapters above it.
SQL: dict[str, str] = {
    "entities": """
SELECT 'CSE-' || CAST(n_nationkey AS STRING) AS entity_id, n_name AS name, r_name AS sector, CASE WHEN n_nationkey % 8 = 0 THEN 'TIER-2' ELSE 'TIER-1' END AS tier
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "cases": f"""
SELECT CAST(o_orderkey AS STRING) AS case_id, {_ENTITY} AS entity_id, {_SUBMISSION} AS submission_id, {_CASE_TIME} AS created_at,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'P' THEN 'IN_PROGRESS' ELSE 'OPEN' END AS status,
  CASE WHEN o_orderstatus = 'F' THEN {_CASE_TIME} + INTERVAL '1' MINUTE * (CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey % 3 ELSE CAST(floor(o_totalprice) AS BIGINT) % 6000 END) END AS closed_at,
  CASE o_orderkey % 7 WHEN 0 THEN 'phishing mail' WHEN 1 THEN 'n/a' WHEN 2 THEN 'stolen password' WHEN 3 THEN ' ' END AS root_cause,
  CASE o_orderkey % 5 WHEN 0 THEN 'true positive' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'pending' WHEN 3 THEN 'Resolved by remediation' END AS disposition,
  CASE o_orderkey % 11 WHEN 0 THEN 'Phoned on-call lead before any record' WHEN 1 THEN 'Reviewed  the alert and  closed it as routine' WHEN 2 THEN 'reviewed the alert and closed it as Routine' WHEN 3 THEN 'ok' END AS notes,
  CASE o_orderkey % 13 WHEN 4 THEN 'Host rebuilt' WHEN 7 THEN 'pending' END AS resolution,
  CASE o_orderkey % 17 WHEN 5 THEN 'Verbal escalation to the L2 lead' WHEN 9 THEN '-' END AS closing_notes,
  CASE o_orderkey % 23 WHEN 2 THEN 'Escalated via phone at 02:10' END AS investigation_notes,
  CASE o_orderkey % 6 WHEN 0 THEN 'Beacon from a workstation' WHEN 3 THEN ' ' END AS title, 'A' || CAST(o_orderkey % 7 AS STRING) AS assigned_analyst,
  CAST(o_custkey AS STRING) AS asset_id, o_orderkey % 29 = 0 AND c_nationkey % 3 = 0 AS is_quarantined
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "submissions": """
SELECT entity_id, submission_id, min(CAST(date_trunc('quarter', created_at) AS TIMESTAMP)) AS period_start,
  min(CAST(date_trunc('quarter', created_at) AS TIMESTAMP)) + INTERVAL '3' MONTH AS period_end, count(*) AS n_cases
FROM cases GROUP BY entity_id, submission_id
UNION ALL SELECT 'CSE-' || CAST(n_nationkey AS STRING), 'CSE-' || CAST(n_nationkey AS STRING) || '-2005Q1', CAST('2005-01-01 00:00:00' AS TIMESTAMP), CAST('2005-04-01 00:00:00' AS TIMESTAMP), 0 FROM nation WHERE n_nationkey % 8 = 3""",
    "actions": """
SELECT DISTINCT CAST(l_orderkey AS STRING) AS case_id, CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) AS action_id,
  CASE l_returnflag WHEN 'A' THEN 'FORENSIC_TRIAGE' WHEN 'R' THEN 'HOST_ISOLATION' ELSE 'NOTE' END AS action_type,
  CASE WHEN l_linestatus = 'F' THEN 'sha-' || CAST(l_partkey AS STRING) END AS artifact_hash, CAST(l_shipdate AS TIMESTAMP) AS ts,
  CASE l_partkey % 5 WHEN 0 THEN '{"notes": "Checked the mail headers ' || CAST(l_partkey AS STRING) || '", "summary": " "}' WHEN 1 THEN '{"comment": "no further steps", "description": "Blocked the sender"}' WHEN 2 THEN 'plain words' WHEN 3 THEN '{"triage_notes": "Benign scanner", "score": 3}' END AS details
FROM lineitem""",
    "remediations": """
SELECT DISTINCT CAST(l_orderkey AS STRING) AS case_id, 'RM-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS remediation_id, CAST(l_shipdate AS TIMESTAMP) AS ts
FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber <= 2""",
    "escalations": """
SELECT DISTINCT case_id, CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS escalation_id,
  created_at + INTERVAL '1' MINUTE * CAST(l_linenumber * l_quantity AS BIGINT) AS ts
FROM lineitem JOIN cases ON case_id = CAST(l_orderkey AS STRING) WHERE l_returnflag = 'R'""",
    "links": """
SELECT DISTINCT CAST(l_orderkey AS STRING) AS case_id, CAST(l_partkey * CASE WHEN l_suppkey % 9 = 0 THEN 6 ELSE 1 END AS STRING) AS alert_id FROM lineitem""",
    "assets": """
SELECT CAST(c_custkey AS STRING) AS asset_id, 'CSE-' || CAST(c_nationkey AS STRING) AS entity_id,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'CRITICAL' WHEN 'MACHINERY' THEN 'HIGH' WHEN 'AUTOMOBILE' THEN 'MEDIUM' ELSE 'LOW' END AS criticality,
  CASE WHEN c_custkey % 13 = 0 THEN 'RETIRED' END AS status,
  CASE WHEN c_acctbal < 0 THEN 'Disconnected' WHEN c_acctbal < 500 THEN 'unhealthy' WHEN c_acctbal < 7000 THEN 'HEALTHY' END AS agent_status,
  CASE WHEN c_acctbal < 9000 THEN CAST('1998-08-02 00:00:00' AS TIMESTAMP) END AS last_heartbeat,
  CASE WHEN c_acctbal > 9500 THEN CAST('1998-08-01 00:00:00' AS TIMESTAMP) END AS last_seen
FROM customer WHERE c_nationkey <> 24""",
    "alerts": """
SELECT CAST(event_id AS STRING) AS alert_id, CAST(user_id AS STRING) AS asset_id, CAST(ts AS TIMESTAMP) - INTERVAL '25' YEAR AS ts,
  CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'purchase' THEN 'MEDIUM' ELSE 'LOW' END AS severity, event_type AS title, value, props FROM events""",
    "exceptions": """
SELECT s_suppkey AS row_id, 'EX-' || CAST(CASE WHEN s_suppkey % 20 = 19 THEN s_suppkey - 1 ELSE s_suppkey END AS STRING) AS exception_id, 'CSE-' || CAST(s_nationkey AS STRING) AS entity_id,
  CASE s_suppkey % 4 WHEN 0 THEN 'POL-INV-001' WHEN 1 THEN 'POL-ESC-002' WHEN 2 THEN 'POL-REC-005' ELSE '*' END AS policy_reference,
  CASE WHEN s_suppkey % 15 = 1 THEN 'by agreement' WHEN s_suppkey % 3 = 0 THEN 'case:' || CAST(s_suppkey * 7 AS STRING) WHEN s_suppkey % 3 = 1 THEN 'case:*' ELSE 'asset:' || CAST(s_suppkey AS STRING) END AS affected_scope,
  CASE WHEN s_suppkey % 30 = 1 THEN 'case' END AS target_type, CASE WHEN s_suppkey % 30 = 1 THEN '*' END AS target_id,
  CASE WHEN s_suppkey % 6 = 5 THEN 'revoked' WHEN s_suppkey % 2 = 0 THEN 'Approved' ELSE 'active' END AS status,
  CASE WHEN s_suppkey % 10 = 9 THEN ' ' ELSE 'ciso' END AS approved_by, CASE s_suppkey % 14 WHEN 13 THEN '' WHEN 12 THEN NULL ELSE 'legacy system' END AS reason,
  CAST('1992-01-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' DAY * (s_suppkey * 37 % 2300) AS valid_from,
  CASE WHEN s_suppkey % 5 <> 0 THEN CAST('1992-01-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' DAY * (s_suppkey * 37 % 2300 + 120) END AS valid_to,
  CASE WHEN s_suppkey % 2 = 0 THEN CAST('1992-01-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' DAY * (s_suppkey * 37 % 2300 + 150) END AS expiry_date
FROM supplier""",
    "claims": """
SELECT 'CL-' || submission_id AS claim_id, entity_id, submission_id,
  CASE WHEN CAST(substring(entity_id, 5, 2) AS INT) % 6 = 5 THEN 'mean_time_to_detect' WHEN CAST(substring(entity_id, 5, 2) AS INT) % 2 = 0 THEN 'Escalation_SLA_Compliance_Rate' ELSE 'sla_compliance' END AS metric_name,
  CASE WHEN CAST(substring(entity_id, 5, 2) AS INT) % 9 = 8 THEN 'CSE-99' ELSE entity_id END AS claim_entity,
  CASE WHEN CAST(substring(entity_id, 5, 2) AS INT) % 8 = 7 THEN 'hours' ELSE 'percent' END AS unit,
  CASE WHEN n_cases % 17 = 0 THEN NULL WHEN n_cases % 19 = 0 THEN 'n/a' WHEN n_cases % 23 = 0 THEN '130' ELSE CAST(CAST(substring(entity_id, 5, 2) AS INT) * 3 + n_cases % 20 AS STRING) END AS claimed,
  period_start + INTERVAL '1' MONTH * (n_cases % 2) AS claim_start, period_end + INTERVAL '1' MONTH * CASE WHEN n_cases % 13 = 0 THEN 1 ELSE 0 END AS claim_end,
  period_start, period_end
FROM submissions WHERE n_cases > 0 AND NOT (CAST(substring(entity_id, 5, 2) AS INT) = 13 AND n_cases % 2 = 0)""",
    "records": """
SELECT submission_id, 'cases' AS record_type, submission_id || '/cases' AS source_id, case_id AS native_id, is_quarantined FROM cases
UNION ALL SELECT c.submission_id, 'investigation_actions', c.submission_id || '/investigation_actions', a.action_id, c.entity_id = 'CSE-5' AND a.action_type = 'NOTE' AND c.severity = 'LOW' FROM actions a JOIN cases c ON a.case_id = c.case_id
UNION ALL SELECT c.submission_id, 'escalations', c.submission_id || '/escalations', e.escalation_id, false FROM escalations e JOIN cases c ON e.case_id = c.case_id WHERE NOT (c.entity_id = 'CSE-10' AND c.severity = 'LOW')
UNION ALL SELECT c.submission_id, 'escalations', c.submission_id || '/escalations-b', e.escalation_id, false FROM escalations e JOIN cases c ON e.case_id = c.case_id WHERE c.entity_id IN ('CSE-10', 'CSE-22') AND c.severity = 'LOW'
UNION ALL SELECT s.submission_id, 'assets', s.submission_id || '/assets', a.asset_id, false FROM assets a JOIN submissions s ON a.entity_id = s.entity_id WHERE s.period_start >= CAST('2001-07-01 00:00:00' AS TIMESTAMP)
UNION ALL SELECT submission_id, 'reported_claims', submission_id || '/reported_claims', claim_id, false FROM claims""",
    "sources": """
SELECT s.entity_id, s.submission_id, t.record_type, s.submission_id || '/' || t.record_type || t.suffix AS source_id,
  CASE WHEN e % 7 = 3 AND t.record_type = 'investigation_actions' THEN 'random_sample' ELSE 'full_population' END AS sampling_method,
  CASE WHEN e % 11 = 4 AND t.record_type = 'escalations' THEN 'Selected escalations' ELSE 'all records' END AS export_scope,
  coalesce(r.n, 0) + CASE WHEN e % 7 = 0 AND t.record_type = 'cases' THEN 1 WHEN e % 19 = 18 AND t.record_type = 'cases' THEN 2 ELSE 0 END AS declared_rows,
  CASE WHEN e = 6 AND t.record_type = 'investigation_actions' THEN NULL ELSE coalesce(r.n, 0) + CASE WHEN e % 19 = 18 AND t.record_type = 'cases' THEN 2 ELSE 0 END END AS actual_rows,
  t.is_optional,
  CASE WHEN e % 2 = 0 THEN s.period_start END AS period_start,
  CASE WHEN e % 13 = 12 AND t.record_type = 'escalations' AND month(s.period_start) = 1 THEN s.period_end - INTERVAL '1' MONTH WHEN e % 2 = 0 THEN s.period_end END AS period_end
FROM (SELECT *, CAST(substring(entity_id, 5, 2) AS INT) AS e FROM submissions) s
CROSS JOIN (VALUES ('cases', '', false), ('investigation_actions', '', false), ('escalations', '', false), ('escalations', '-b', false), ('assets', '', true), ('reported_claims', '', true)) AS t(record_type, suffix, is_optional)
LEFT JOIN (SELECT source_id, record_type, count(*) AS n FROM records GROUP BY source_id, record_type) r ON r.source_id = s.submission_id || '/' || t.record_type || t.suffix AND r.record_type = t.record_type
WHERE (t.suffix = '' OR e IN (10, 22)) AND NOT (t.record_type = 'assets' AND s.period_start < CAST('2001-07-01 00:00:00' AS TIMESTAMP)) AND NOT (e = 16 AND t.record_type = 'escalations' AND month(s.period_start) = 4)""",
    "issues": """
SELECT submission_id, source_id, severity, issue_type FROM sources JOIN (VALUES ('investigation_actions', 'CSE-1%', '%Q2', 'warning', 'TIMESTAMP_OUT_OF_PERIOD'), ('escalations', 'CSE-17', '%Q3', 'error', 'INVALID_FIELD_TYPE'), ('cases', '%', '%', 'warning', 'PLACEHOLDER_TEXT')) AS v(kind, entities, periods, severity, issue_type)
  ON record_type = kind AND entity_id LIKE entities AND submission_id LIKE periods""",
}

_RAW = "region nation customer supplier part orders lineitem events documents embeddings".split()


def needed(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]


class Tables:
    """The contract tables of a folder of parquet files, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SQL:
            raise AttributeError(name)
        if name not in self._made:
            sql = SQL[name]
            inputs = {n: self.raw(n) for n in needed(sql, _RAW)} | {n: getattr(self, n) for n in needed(sql, SQL) if n != name}
            text = sql.replace("{", "{{").replace("}", "}}")
            for n in inputs:
                text = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", text)
            self._made[name] = self.spark.sql(text, **inputs)
        return self._made[name]


def ctes(*names: str) -> str:
    """The adapters that names need, as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for n in needed(SQL[name], SQL):
            if n != name:
                add(n)
        order.append(name)

    for n in names:
        add(n)
    return ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
