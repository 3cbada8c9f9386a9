"""Queries and oracles of runs, registries, snapshots and checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..adapters import Tables
from ..operators import chains, integrity, intake, patterns, reports, review, rules, text
from ..shared import shared_dir
from ..sources import readers
from . import evidence, select, supervise
from .assess import FINDINGS
from .evidence import _CHAIN, _COMMIT, _LEVELS
from .select import _DECISIONS, _UNITS, _units


def _plain(f):
    return lambda spark, sf: f(Tables(spark, sf))


def _with(f):
    def query(spark, sf):
        t = Tables(spark, sf)
        return f(t, rules.findings_of(t))

    return query


def provenance(t: Tables):
    raw = t.raw("orders").select((F.col("o_orderkey") + 3).alias("raw_id"), F.concat(F.lit("row:"), F.col("o_orderkey").cast("string")).alias("locator"), F.md5("o_orderpriority").alias("raw_hash"))
    return chains.provenance(t.cases.select("case_id", F.col("case_id").cast("bigint").alias("raw_id")), raw).select("case_id", "locator", "raw_hash")


def record_lookup(t: Tables):
    rows = t.raw("lineitem").select(F.col("l_orderkey").cast("string").alias("native_id"), (F.col("l_partkey") % 2 == 0).alias("is_quarantined"), F.col("l_partkey").alias("content_hash"))
    return chains.lookup(rows, "7")


def file_registry(t: Tables):
    """Files as the lines of an order; the last shipped is the last that arrived."""
    files = t.raw("lineitem").select(F.col("l_orderkey").alias("submission_id"), F.col("l_linenumber").alias("source_id"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("arrived_at"), F.col("l_partkey").alias("digest"))
    return intake.file_registry(files).select("submission_id", "source_id", "digest").distinct()


def first_long_cases(t: Tables):
    timed = t.cases.withColumn("m", -F.round(patterns.minutes(), 4)).where("m IS NOT NULL")
    return reports.first_records(timed, "submission_id", "m", "case_id")


def decisions_of_runs(t: Tables):
    items = t.cases.select(F.col("case_id").alias("item_id"), F.col("asset_id").alias("portfolio_id"))
    portfolios = t.assets.select(F.col("asset_id").alias("portfolio_id"), F.col("entity_id").alias("run_id"))
    return reports.decision_counts(t.actions.select(F.col("case_id").alias("item_id")), items, portfolios)


def report_states(t: Tables):
    events = t.actions.select(F.col("case_id").alias("object_id"), F.col("action_id").alias("event_id"), F.unix_timestamp("ts").alias("seq"))
    outbox = t.actions.groupBy(F.col("action_id").alias("event_id")).agg(F.max(F.when(F.col("artifact_hash").isNotNull(), "anchored")).alias("status"))
    return reports.report_status(t.cases.select(F.col("case_id").alias("report_id")), events, outbox)


def commitments_checked(t: Tables):
    own = evidence.committed_cases(t).select(F.col("case_id").alias("key"), "commitment")
    stored = own.withColumn("commitment", F.when(F.col("key").cast("bigint") % 12 == 0, "0").otherwise(F.col("commitment")))
    return reports.verified(stored, own)


def submission_roots(t: Tables):
    """A file for each submission, which lists its sources, with the digest of its bytes."""
    path = f"{shared_dir(t.spark)}/submitted-{uuid.uuid4().hex[:12]}"
    listed = t.sources.groupBy("submission_id").agg(F.array_join(F.sort_array(F.collect_list("source_id")), "\n").alias("value"))
    listed.repartition("submission_id").write.partitionBy("submission_id").text(path)
    files = readers.file_digests(t.spark, path).select(F.regexp_extract("file", "submission_id=([^/]+)", 1).alias("submission_id"), "digest")
    return reports.submission_commitments(files, evidence.committed_cases(t))


def gains(t, f):
    units = _units(t, f)
    return reports.marginal_gains(units.where("stratum = 'targeted'"), units.where("stratum = 'control'"))


def exclusions(t, f):
    assets = t.assets.join(rules.latest_submission(t).select("entity_id", "submission_id"), "entity_id")
    return review.excluded(rules.valid(t.cases), assets, f)


BUDGET = review.Budget(items=10, minutes=90.0)


def documents_of_runs(t, f):
    d = select.decisions(t).withColumn("submission_id", F.lit(None).cast("string"))
    of = t.cases.select(F.concat(F.lit("d"), "case_id").alias("decision_id"), F.col("submission_id").alias("s"))
    d = d.join(of, "decision_id").withColumn("submission_id", F.col("s")).drop("s")
    files = t.sources.where("actual_rows IS NOT NULL").select("submission_id", "source_id", "actual_rows")
    items = t.cases.where("severity = 'CRITICAL'").select("submission_id", F.col("case_id").alias("item_id"), F.col("created_at").alias("at"))
    out = reports.snapshot(t.submissions, f, d, F.lit("1997-01-01").cast("timestamp"), files=files, items=items, requests=requests(t).withColumn("at", F.col("at").cast("timestamp")))
    shape = "findings array<struct<rule_id:string>>, decisions array<struct<target_id:string>>, files array<struct<source_id:string>>, items array<struct<item_id:string>>, requests array<struct<request_id:string>>"
    p = out.withColumn("p", F.from_json("document", shape))
    first = {"findings": "rule_id", "decisions": "target_id", "files": "source_id", "items": "item_id", "requests": "request_id"}
    return p.select("submission_id", *[F.size(F.col("p")[k]).cast("bigint").alias(k) for k in first], *[F.md5(F.array_join(F.array_sort(F.col("p")[k][c]), ",")).alias(f"{k}_digest") for k, c in first.items()])


def requests(t: Tables):
    """Requests for more evidence, one for a case in fifty."""
    k = F.col("case_id").cast("bigint")
    return t.cases.where(k % 50 == 3).select("submission_id", F.concat(F.lit("q"), "case_id").alias("request_id"), F.when(k % 100 == 3, "open").otherwise("answered").alias("status"), F.col("created_at").alias("at"))


def full_overview(t: Tables, f):
    from ..operators import scorecard

    d = select.decisions(t).join(t.cases.select(F.concat(F.lit("d"), "case_id").alias("decision_id"), "submission_id"), "decision_id")
    return reports.with_review_counts(scorecard.overview(t, f), t.cases.where("severity = 'CRITICAL'").select("submission_id"), d, requests(t)).select("entity_id", "submission_id", "attention_index", "band", "items", "decisions", "open_requests")


def listed_evidence(t: Tables, f):
    return reports.evidence_lists(t, f).select("rule_id", "case_id", F.array_join("assets", ",").alias("assets"), F.array_join("refs", ",").alias("refs"))


def spans(t: Tables):
    d = t.raw("documents").select("doc_id", "text")
    return text.find_spans(d.select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "no such words here").otherwise(F.substring("text", 11, 12)).alias("query"))).select("doc_id", "start_char", "end_char")


def artifacts(t: Tables):
    expected = t.raw("nation").where("n_nationkey % 6 <> 5").select(F.col("n_name").alias("name"), F.sha2(F.when(F.col("n_nationkey") % 4 == 1, "x").otherwise(F.col("n_name")), 256).alias("digest"))
    return reports.artifact_checks(expected, t.raw("nation").where("n_nationkey % 7 <> 6").select(F.col("n_name").alias("name"), F.col("n_name").alias("content")))


QUERIES = {
    "c1_provenance": _plain(provenance), "c20_lookup": _plain(record_lookup), "a14_file_registry": _plain(file_registry), "f2_first_records": _plain(first_long_cases), "c18_decision_counts": _plain(decisions_of_runs),
    "c19_report_status": _plain(report_states), "d29_fingerprints": _plain(lambda t: reports.fingerprint(t.sources, "demo-v1", "rules-v1")), "i3_verified": _plain(commitments_checked), "i7_submission_roots": _plain(submission_roots),
    "i10_checkpoints": _plain(lambda t: reports.checkpoints(integrity.chain(evidence.custody_events(t)))), "i11_verdicts": _plain(lambda t: reports.audit_verdicts(evidence.tampered_log(t))), "i13_artifacts": _plain(artifacts),
    "p2_unhealthy_assets": _with(lambda t, f: reports.unhealthy_assets(t.assets, f)), "p3_omitted_sources": _plain(lambda t: review.omitted_sources(t.sources.withColumn("declared_rows", F.when(F.col("source_id").like("CSE-_-%"), 0).otherwise(F.col("declared_rows"))))),
    "p4_exclusions": _with(exclusions), "p7_marginal_gains": _with(gains), "p10_portfolio_items": _with(lambda t, f: reports.portfolio_items(review.portfolio(reports.valid_units(_units(t, f))))),
    "p10_portfolio_summary": _with(lambda t, f: reports.portfolio_summary(review.portfolio(reports.valid_units(_units(t, f)), BUDGET), BUDGET)), "w1_snapshots": _with(documents_of_runs), "d31_overview": _with(full_overview), "r7_evidence_lists": _with(listed_evidence), "g6_covered_assets": _plain(lambda t: reports.covered_assets(t.assets, t.alerts)),
    "t14_spans": _plain(spans), "f3_listing": _plain(lambda t: reports.listing(t.cases.select("case_id", "entity_id", "severity", F.unix_timestamp("created_at").alias("made")), [F.desc("made"), "case_id"], 2, 50, severity="HIGH")),
    "d4_adverse_share": _with(lambda t, f: reports.adverse_share(f)),
}
_TREE10 = ",\n".join(["e0 AS (SELECT entity_id AS batch, seq - 1 AS idx, sha256('\\x00'::blob || digest::blob) AS h FROM steps)"] + [f"e{k} AS (SELECT batch, idx // 2 AS idx, CASE WHEN count(*) = 2 THEN sha256('\\x01'::blob || unhex(min_by(h, idx)) || unhex(max_by(h, idx))) ELSE min(h) END AS h FROM e{k - 1} GROUP BY batch, idx // 2)" for k in range(1, 17)])
_TREE7 = ",\n".join(["i0 AS (SELECT submission_id AS batch, row_number() OVER (PARTITION BY submission_id ORDER BY item) - 1 AS idx, sha256('\\x00'::blob || item::blob) AS h FROM (SELECT submission_id, sha256(string_agg(source_id || chr(10), '' ORDER BY source_id)) AS item FROM sources GROUP BY submission_id UNION ALL SELECT submission_id, commitment FROM commits))"] + [f"i{k} AS (SELECT batch, idx // 2 AS idx, CASE WHEN count(*) = 2 THEN sha256('\\x01'::blob || unhex(min_by(h, idx)) || unhex(max_by(h, idx))) ELSE min(h) END AS h FROM i{k - 1} GROUP BY batch, idx // 2)" for k in range(1, _LEVELS)])
ORACLE = {
    "c1_provenance": FINDINGS + " SELECT case_id, 'row:' || o_orderkey AS locator, md5(o_orderpriority) AS raw_hash FROM cases LEFT JOIN orders ON o_orderkey + 3 = case_id::bigint",
    "c20_lookup": "SELECT '7' AS native_id, l_partkey % 2 = 0 AS is_quarantined, l_partkey AS content_hash FROM lineitem WHERE l_orderkey = 7 ORDER BY 2, 3 LIMIT 1",
    "a14_file_registry": "SELECT DISTINCT l_orderkey AS submission_id, l_linenumber AS source_id, first_value(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC) AS digest FROM lineitem",
    "f2_first_records": FINDINGS + " SELECT submission_id, string_agg(case_id, ',' ORDER BY n) AS first FROM (SELECT submission_id, case_id, row_number() OVER (PARTITION BY submission_id ORDER BY -epoch(closed_at - created_at), case_id) AS n FROM cases WHERE closed_at IS NOT NULL) WHERE n <= 10 GROUP BY submission_id",
    "c18_decision_counts": FINDINGS + " SELECT s.entity_id AS run_id, count(*) AS decisions FROM actions JOIN cases USING (case_id) JOIN assets s USING (asset_id) GROUP BY s.entity_id",
    "c19_report_status": FINDINGS + " SELECT case_id AS report_id, event_id, r.status FROM cases LEFT JOIN (SELECT case_id, action_id AS event_id, (SELECT max(CASE WHEN artifact_hash IS NOT NULL THEN 'anchored' END) FROM actions b WHERE b.action_id = a.action_id) AS status FROM actions a QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, action_id DESC) = 1) r USING (case_id)",
    "d29_fingerprints": FINDINGS + " SELECT submission_id, sha256(string_agg(source_id || '|' || declared_rows || '|' || coalesce(actual_rows::varchar, '-'), ';' ORDER BY source_id || '|' || declared_rows) || '#demo-v1#rules-v1') AS fingerprint FROM sources GROUP BY submission_id",
    "i3_verified": FINDINGS + " SELECT case_id AS key, case_id::bigint % 12 <> 0 AS holds FROM cases",
    "i7_submission_roots": f"{FINDINGS}, {_COMMIT}, {_TREE7} SELECT batch, h AS root FROM i{_LEVELS - 1}",
    "i10_checkpoints": f"{FINDINGS}, {_CHAIN}, {_TREE10} SELECT batch, h AS root, n AS size FROM e16 JOIN (SELECT batch, count(*) AS n FROM e0 GROUP BY batch) USING (batch)",
    "i11_verdicts": "WITH issues AS (" + evidence.ORACLE["i9_chain_audit"] + """), ids AS (SELECT DISTINCT 'CSE-' || c_nationkey AS entity_id FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT entity_id, CASE WHEN i IS NULL THEN 'VALID' ELSE 'TAMPERED' END AS verdict, coalesce(i, '') AS issues FROM ids LEFT JOIN (SELECT entity_id, string_agg(DISTINCT issue, ',' ORDER BY issue) AS i FROM issues GROUP BY entity_id) USING (entity_id)""",
    "i13_artifacts": "SELECT n_name AS name, CASE WHEN n_nationkey % 7 = 6 THEN 'absent' WHEN n_nationkey % 6 = 5 THEN 'undeclared' WHEN n_nationkey % 4 = 1 THEN 'changed' ELSE 'ok' END AS state FROM nation WHERE n_nationkey % 6 <> 5 OR n_nationkey % 7 <> 6",
    "p2_unhealthy_assets": FINDINGS + " SELECT entity_id, asset_id FROM assets WHERE upper(agent_status) IN ('UNHEALTHY', 'DISCONNECTED', 'MISSING') AND coalesce(status, 'ACTIVE') = 'ACTIVE' AND asset_id NOT IN (SELECT object_id FROM findings WHERE object_type = 'asset')",
    "p3_omitted_sources": FINDINGS + " SELECT submission_id, 'source|' || source_id AS unit_id, 'targeted' AS stratum, 'telemetry-pipeline' AS asset, 'source_omission' AS category, 'hyp:optional_source_omission' AS hypothesis, 1.0::double AS weight, 8.0::double AS minutes, 0.8::double AS value FROM sources WHERE is_optional AND (declared_rows = 0 OR source_id LIKE 'CSE-_-%')",
    "p4_exclusions": f"{FINDINGS}, {_UNITS} SELECT submission_id, 'cases' AS record_type, case_id AS id, 'flagged_by_machine_finding' AS reason FROM valid_cases WHERE case_id IN (SELECT object_id FROM flagged_cases) UNION ALL SELECT submission_id, 'assets', asset_id, 'flagged_by_coverage_or_asset_finding' FROM own_assets WHERE asset_id IN (SELECT object_id FROM flagged_assets)",
    "p7_marginal_gains": f"{FINDINGS}, {_UNITS}, ctl AS (SELECT * FROM units WHERE stratum = 'control'), g AS (SELECT u.submission_id, unit_id, minutes, 2.0 * (least(1, coalesce(have, 0) + weight) - least(1, coalesce(have, 0))) + (CASE WHEN EXISTS (SELECT 1 FROM ctl c WHERE c.submission_id = u.submission_id AND c.asset = u.asset) THEN 0 ELSE 1 END) + (CASE WHEN EXISTS (SELECT 1 FROM ctl c WHERE c.submission_id = u.submission_id AND c.category = u.category) THEN 0 ELSE 1 END) + (CASE WHEN EXISTS (SELECT 1 FROM ctl c WHERE c.submission_id = u.submission_id) THEN 0 ELSE 1 END) + value * 0.5 AS gain FROM units u LEFT JOIN (SELECT submission_id, hypothesis, sum(weight) AS have FROM ctl GROUP BY submission_id, hypothesis) h USING (submission_id, hypothesis) WHERE stratum = 'targeted') SELECT submission_id, unit_id, round(gain, 6)::double AS gain, round(gain / minutes, 9)::double AS efficiency FROM g",
    "w1_snapshots": f"""{FINDINGS}, {_DECISIONS}, act AS (SELECT c.submission_id, target_id FROM decisions d JOIN cases c ON d.decision_id = 'd' || c.case_id WHERE decided_at <= TIMESTAMP '1997-01-01' QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY decided_at DESC, decision_id DESC) = 1),
parts AS (SELECT 'findings' AS part, submission_id, rule_id AS k FROM findings UNION ALL SELECT 'decisions', submission_id, target_id FROM act UNION ALL SELECT 'files', submission_id, source_id FROM sources WHERE actual_rows IS NOT NULL
  UNION ALL SELECT 'items', submission_id, case_id FROM cases WHERE severity = 'CRITICAL' AND created_at <= TIMESTAMP '1997-01-01' UNION ALL SELECT 'requests', submission_id, 'q' || case_id FROM cases WHERE case_id::bigint % 50 = 3 AND created_at <= TIMESTAMP '1997-01-01')
SELECT submission_id, """ + ", ".join(f"count(k) FILTER (WHERE part = '{p}') AS {p}, md5(coalesce(string_agg(k, ',' ORDER BY k) FILTER (WHERE part = '{p}'), '')) AS {p}_digest" for p in ("findings", "decisions", "files", "items", "requests")) + " FROM submissions LEFT JOIN parts USING (submission_id) GROUP BY submission_id",
    "d31_overview": supervise.CARDS + f""", {_DECISIONS} SELECT entity_id, submission_id, attention_index, band, (SELECT count(*) FROM cases c WHERE c.submission_id = o.submission_id AND severity = 'CRITICAL') AS items,
  (SELECT count(*) FROM decisions d JOIN cases c ON d.decision_id = 'd' || c.case_id WHERE c.submission_id = o.submission_id) AS decisions, (SELECT count(*) FROM cases c WHERE c.submission_id = o.submission_id AND case_id::bigint % 100 = 3) AS open_requests FROM overview o""",
    "r7_evidence_lists": FINDINGS + """, refs AS (SELECT case_id, 'action:' || action_id AS ref FROM actions UNION SELECT case_id, 'escalation:' || escalation_id FROM escalations UNION SELECT case_id, 'case:' || case_id FROM cases), named AS (SELECT DISTINCT case_id, asset_id FROM links JOIN alerts USING (alert_id) WHERE asset_id IS NOT NULL),
a AS (SELECT case_id, string_agg(asset_id, ',' ORDER BY asset_id) AS assets FROM named GROUP BY case_id), r AS (SELECT case_id, string_agg(ref, ',' ORDER BY ref) AS refs FROM refs GROUP BY case_id)
SELECT rule_id, object_id AS case_id, coalesce(assets, '') AS assets, refs FROM findings LEFT JOIN a ON a.case_id = object_id JOIN r ON r.case_id = object_id WHERE object_type = 'case'""",
    "g6_covered_assets": FINDINGS + " SELECT asset_id FROM assets WHERE upper(agent_status) = 'HEALTHY' OR asset_id IN (SELECT asset_id FROM alerts)",
    "t14_spans": "SELECT doc_id, CASE WHEN at > 0 THEN at - 1 ELSE 0 END AS start_char, CASE WHEN at > 0 THEN at - 1 + length(q) ELSE length(text) END AS end_char FROM (SELECT *, instr(lower(text), lower(q)) AS at FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'no such words here' ELSE substring(text, 11, 12) END AS q FROM documents))".replace(" at ", " pos ").replace("AS at", "AS pos"),
    "f3_listing": FINDINGS + " SELECT case_id, entity_id, severity, epoch(created_at)::bigint AS made FROM cases WHERE severity = 'HIGH' ORDER BY made DESC, case_id LIMIT 50 OFFSET 50",
    "d4_adverse_share": FINDINGS + " SELECT rule_id, round(count(*) FILTER (WHERE evidence_state IN ('potential_concern', 'contradictory')) / count(*), 6) AS share FROM findings GROUP BY rule_id",
}
