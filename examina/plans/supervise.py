"""Queries and oracles of scorecards, peers, trends and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import SQL, Tables
from ..operators import patterns, peers, rules, scorecard, trends
from .assess import FINDINGS

_ADVERSE = "evidence_state IN ('potential_concern', 'contradictory')"
_COMPLETE = """complete AS (
SELECT submission_id, declared, received, parsed, quarantined, round(pct, 1) AS completeness_pct,
  CASE WHEN pct >= 90 AND received = declared THEN 'SUFFICIENT' WHEN pct >= 60 THEN 'PARTIALLY_SUFFICIENT' ELSE 'INSUFFICIENT_EVIDENCE' END AS verdict
FROM (SELECT *, greatest(0, least(100, (received / declared - CASE WHEN parsed > 0 THEN quarantined / parsed * 0.3 ELSE 0 END) * 100)) AS pct
  FROM (SELECT submission_id, declared, received, coalesce(parsed, 0) AS parsed, coalesce(quarantined, 0) AS quarantined FROM (SELECT submission_id, count(*) AS declared, count(actual_rows) AS received FROM sources GROUP BY submission_id)
  LEFT JOIN (SELECT submission_id, count(*) AS parsed, count(*) FILTER (WHERE is_quarantined) AS quarantined FROM cases GROUP BY submission_id) USING (submission_id))))"""
_GAPS = f"""gaps AS (
SELECT submission_id, count(*) AS adverse, count(*) FILTER (WHERE rule_id = 'POL-INV-001') AS unsubstantiated, count(*) FILTER (WHERE rule_id = 'POL-ESC-002') AS overdue, count(*) FILTER (WHERE rule_id = 'POL-REC-005') AS unlinked,
  least(100, sum(CASE severity WHEN 'critical' THEN 35 WHEN 'high' THEN 20 WHEN 'medium' THEN 10 WHEN 'low' THEN 5 ELSE 0 END))::double AS gap_score
FROM findings WHERE {_ADVERSE} GROUP BY submission_id)"""
_SPACE = f"""space AS (
SELECT entity_id, total, broken, missing, greatest(0, total - broken - missing) AS healthy, round(greatest(0, total - broken - missing) / total * 100, 1) AS coverage_pct, broken > 0 OR missing > 0 AS blind_spot
FROM (SELECT entity_id, total, coalesce(broken, 0) AS broken, coalesce(missing, 0) AS missing FROM (SELECT entity_id, count(DISTINCT asset_id) AS total FROM assets GROUP BY entity_id)
  LEFT JOIN (SELECT entity_id, count(DISTINCT CASE WHEN {_ADVERSE} THEN object_id END) AS broken, count(DISTINCT CASE WHEN evidence_state = 'insufficient_evidence' THEN object_id END) AS missing
    FROM findings WHERE rule_id = 'POL-COV-003' GROUP BY entity_id) USING (entity_id)))"""
_OUTCOMES = """outcomes9 AS (
SELECT submission_id, count(*) AS claims, count(*) FILTER (WHERE evidence_state = 'contradictory') AS contradicted, count(*) FILTER (WHERE evidence_state = 'insufficient_evidence') AS open, count(*) FILTER (WHERE evidence_state = 'supported') AS supported
FROM findings WHERE rule_id = 'POL-KPI-004' GROUP BY submission_id)"""
_OVERVIEW = """overview AS (
SELECT *, CASE WHEN attention_index >= 65 THEN 'CRITICAL_ATTENTION' WHEN attention_index >= 30 THEN 'ELEVATED' ELSE 'ROUTINE' END AS band FROM (
  SELECT *, round(greatest(0, least(100, 0.35 * gap_score + 0.25 * greatest(0, least(100, 100 - coverage_pct + broken * 20)) + 0.2 * least(100, contradicted * 40.0 + open * 15.0) + 0.2 * greatest(0, least(100, 100 - completeness_pct)))), 1) AS attention_index
  FROM (SELECT l.entity_id, l.submission_id, completeness_pct, verdict, coalesce(adverse, 0) AS adverse, coalesce(unsubstantiated, 0) AS unsubstantiated, coalesce(overdue, 0) AS overdue, coalesce(unlinked, 0) AS unlinked,
      coalesce(gap_score, 0)::double AS gap_score, coalesce(contradicted, 0) AS contradicted, coalesce(open, 0) AS open, coalesce(supported, 0) AS supported, coalesce(broken, 0) AS broken, coalesce(missing, 0) AS missing, coalesce(coverage_pct, 100)::double AS coverage_pct, coalesce(blind_spot, false) AS blind_spot
    FROM latest l JOIN complete USING (submission_id) LEFT JOIN gaps USING (submission_id) LEFT JOIN outcomes9 USING (submission_id) LEFT JOIN space ON space.entity_id = l.entity_id)))"""
_WORST = f"""worst AS (
SELECT submission_id, rule_id, arg_max(evidence_state, (CASE WHEN {_ADVERSE} THEN '3' WHEN evidence_state = 'insufficient_evidence' THEN '2' ELSE '1' END) || evidence_state) AS state FROM findings GROUP BY submission_id, rule_id)"""
_POINTS = f"""points AS (
SELECT *, least(100, round(adverse * 8.0 + greatest(0, 100 - completeness_pct) * 0.4 + closure_rate * 0.5 + escalation_rate * 0.5 + 1e-9, 1)) AS trend_index FROM (
  SELECT s.entity_id, s.submission_id, s.period_start, s.period_end, CAST(year(s.period_start) AS VARCHAR) || '-Q' || CAST(quarter(s.period_start) AS VARCHAR) AS label, round(received / declared * 100, 1) AS completeness_pct,
    parsed - quarantined AS cases, coalesce(n, 0) AS adverse,
    CASE WHEN parsed > quarantined THEN round(coalesce(n, 0) / (parsed - quarantined) * 100, 2) ELSE 0 END AS density,
    CASE WHEN parsed > quarantined THEN round(coalesce(inv, 0) / (parsed - quarantined) * 100, 1) ELSE 0 END AS closure_rate,
    CASE WHEN parsed > quarantined THEN round(coalesce(esc, 0) / (parsed - quarantined) * 100, 1) ELSE 0 END AS escalation_rate
  FROM submissions s JOIN complete USING (submission_id)
  LEFT JOIN (SELECT submission_id, count(*) AS n, count(*) FILTER (WHERE rule_id = 'POL-INV-001') AS inv, count(*) FILTER (WHERE rule_id = 'POL-ESC-002') AS esc FROM findings WHERE {_ADVERSE} GROUP BY submission_id) USING (submission_id)))"""
_RATES = f"""rates AS (
SELECT entity_id, submission_id, least(100.0, coalesce(esc, 0) * 15.0)::double AS overdue_escalation, greatest(0.0, 100.0 - coalesce(inv, 0) * 20.0)::double AS investigation_depth, greatest(0.0, 100.0 - coalesce(cov, 0) * 25.0)::double AS sensor_coverage, (coalesce(bad, 0) * 5.0)::double AS concern_density
FROM submissions LEFT JOIN (SELECT submission_id, count(*) FILTER (WHERE rule_id = 'POL-ESC-002') AS esc, count(*) FILTER (WHERE rule_id = 'POL-INV-001') AS inv, count(*) FILTER (WHERE rule_id = 'POL-COV-003') AS cov, count(*) AS bad FROM findings WHERE {_ADVERSE} GROUP BY submission_id) USING (submission_id))"""
_PATTERNS = """timed AS (SELECT submission_id, entity_id, epoch(closed_at - created_at) / 60.0 AS m FROM cases WHERE closed_at IS NOT NULL),
dur AS (
SELECT submission_id, med, mad, count(*) AS n, count(*) FILTER (WHERE abs(m - med) < 0.01) AS same, count(*) FILTER (WHERE abs(m - med) > 3 * mad) AS far FROM (
  SELECT *, median(abs(m - med)) OVER (PARTITION BY submission_id) AS mad FROM (SELECT *, median(m) OVER (PARTITION BY submission_id) AS med FROM timed WHERE m > 0)) GROUP BY submission_id, med, mad HAVING count(*) >= 5),
daily AS (
SELECT entity_id, c, med, CASE WHEN mad = 0 THEN 1 ELSE mad END AS mad FROM (SELECT *, median(abs(c - med)) OVER (PARTITION BY entity_id) AS mad FROM (
  SELECT *, median(c) OVER (PARTITION BY entity_id) AS med FROM (SELECT entity_id, CAST(created_at AS DATE) AS d, count(*) AS c FROM cases GROUP BY entity_id, CAST(created_at AS DATE))))),
fixed AS (SELECT entity_id, asset_id, max(closed_at) AS fixed_at FROM cases WHERE closed_at IS NOT NULL AND (lower(coalesce(disposition, '')) LIKE '%remediat%' OR lower(coalesce(notes, '')) LIKE '%remediat%' OR lower(coalesce(disposition, '')) LIKE '%resolved%') GROUP BY entity_id, asset_id),
told AS (SELECT entity_id, regexp_replace(lower(trim(coalesce(notes, ''))), '\\s+', ' ', 'g') AS text, count(*) AS n FROM cases WHERE length(trim(coalesce(notes, ''))) >= 20 GROUP BY 1, 2 HAVING count(*) >= 3),
hypotheses AS (
SELECT submission_id AS scope_id, 'PAT-DURATION-ZERO-MAD' AS pattern, 'ELEVATED' AS severity, same::double AS observed, (n * 0.1)::double AS baseline, n::bigint AS sample FROM dur WHERE mad = 0 AND same >= n * 0.6
UNION ALL SELECT submission_id, 'PAT-DURATION-OUTLIERS', 'INFORMATIONAL', far, round(med, 4), n FROM dur WHERE mad > 0 AND far >= 2
UNION ALL SELECT entity_id, 'PAT-WORKLOAD-SPIKE', 'ELEVATED', max(c) FILTER (WHERE c > med + 3 * mad AND c >= 5), min(med), count(*) FROM daily GROUP BY entity_id HAVING count(*) >= 4 AND max(c) FILTER (WHERE c > med + 3 * mad AND c >= 5) IS NOT NULL
UNION ALL SELECT submission_id, 'PAT-RAPID-CLOSURE', CASE WHEN round(fast / n * 100, 1) >= 20 THEN 'HIGH' ELSE 'ELEVATED' END, fast, 0, n FROM (SELECT submission_id, count(*) AS n, count(*) FILTER (WHERE epoch(closed_at - created_at) <= 120) AS fast FROM cases GROUP BY submission_id) WHERE fast >= 2
UNION ALL SELECT entity_id, 'PAT-REPEATED-NARRATIVE', 'ELEVATED', sum(n), count(*), sum(n) FROM told GROUP BY entity_id
UNION ALL SELECT entity_id, 'PAT-ACTIVITY-DROP', 'HIGH', coalesce(n, 0), 1, a FROM (SELECT entity_id, count(*) AS a FROM assets GROUP BY entity_id) LEFT JOIN (SELECT entity_id, count(*) AS n FROM cases GROUP BY entity_id) USING (entity_id) WHERE a >= 5 AND coalesce(n, 0) <= 1
UNION ALL SELECT entity_id, 'PAT-POST-REMEDIATION', 'HIGH', count(*), 0, count(DISTINCT asset_id) FROM alerts JOIN fixed USING (asset_id) WHERE ts > fixed_at GROUP BY entity_id)"""
CARDS = ",\n".join([FINDINGS, f"entities AS ({SQL['entities']})", _COMPLETE, _GAPS, _SPACE, _OUTCOMES, _OVERVIEW, _WORST, _POINTS, _RATES, _PATTERNS])


def _with_findings(f):
    def query(spark, sf):
        t = Tables(spark, sf)
        return f(t, rules.findings_of(t))

    return query


def _plain(f):
    return lambda spark, sf: f(Tables(spark, sf))


def _latest_rates(t, findings):
    return scorecard.rates(findings, t.submissions).join(rules.latest_submission(t).select("submission_id"), "submission_id", "left_semi")


def peer_comparison(t, findings):
    return peers.comparisons(_latest_rates(t, findings).drop("submission_id"), t.entities)


def revisions(t: Tables):
    """Submissions with resends: every period of a fourth of the entities came twice or more."""
    s = t.submissions
    times = F.sequence(F.lit(1), 1 + (F.col("n_cases") % 3).cast("int"))
    return s.withColumn("revision", F.explode(times)).withColumn("status", F.when((F.col("revision") + F.col("n_cases")) % 2 == 0, "committed").otherwise("draft"))


def runs(t: Tables):
    return t.submissions.select("entity_id", "period_start", F.concat(F.lit("v"), (F.year("period_start") - F.year("period_start") % 2).cast("string")).alias("policy_version"))


_REVISIONS = "revisions AS (SELECT *, CASE WHEN (revision + n_cases) % 2 = 0 THEN 'committed' ELSE 'draft' END AS status FROM (SELECT *, unnest(range(1, 2 + n_cases % 3)) AS revision FROM submissions))"

QUERIES = {
    "d6_evidence_completeness": _plain(lambda t: scorecard.completeness(t.sources, t.cases)),
    "d7_execution_gaps": _with_findings(lambda t, f: scorecard.gaps(f)),
    "d8_negative_space": _with_findings(lambda t, f: scorecard.negative_space(t.assets, f)),
    "d9_claim_outcomes": _with_findings(lambda t, f: scorecard.claim_outcomes(f)),
    "d10_attention_index": _with_findings(scorecard.overview),
    "d11_capabilities": _with_findings(scorecard.capabilities),
    "d12_entity_rates": _with_findings(lambda t, f: scorecard.rates(f, t.submissions)),
    "c17_peer_cohort": _plain(lambda t: peers.cohort(t.entities)),
    "d13_peer_comparison": _with_findings(peer_comparison),
    "b28_sectors": _plain(lambda t: t.entities.select("entity_id", peers.sector_of(F.col("entity_id"), F.col("name"), F.when(F.col("sector") != "ASIA", F.col("sector"))).alias("sector"))),
    "d22_trend_points": _with_findings(lambda t, f: trends.points(t, f).drop("period_start", "period_end")),
    "e4_reporting_gaps": _with_findings(lambda t, f: trends.with_gaps(trends.points(t, f))),
    "e5_trajectories": _with_findings(lambda t, f: trends.trajectories(trends.points(t, f))),
    "e3_canonical_submission": _plain(lambda t: trends.canonical(revisions(t)).select("submission_id", "revision", "status")),
    "e2_next_revision": _plain(lambda t: trends.next_revision(revisions(t)).select("entity_id", F.year("period_start").alias("y"), F.quarter("period_start").alias("q"), F.col("next_revision").cast("bigint").alias("next_revision"))),
    "e8_policy_changes": _plain(lambda t: trends.policy_changes(runs(t)).select("entity_id", F.year("period_start").alias("y"), F.quarter("period_start").alias("q"), "before", "policy_version")),
    "d30_hypotheses": _plain(patterns.hypotheses),
}
ORACLE = {
    "d6_evidence_completeness": CARDS + " SELECT * FROM complete", "d7_execution_gaps": CARDS + " SELECT * FROM gaps", "d8_negative_space": CARDS + " SELECT * FROM space",
    "d9_claim_outcomes": CARDS + " SELECT * FROM outcomes9", "d10_attention_index": CARDS + " SELECT * FROM overview", "d12_entity_rates": CARDS + " SELECT * FROM rates",
    "d11_capabilities": CARDS + """, card AS (SELECT o.*, max(state) FILTER (WHERE rule_id = 'POL-INV-001') AS inv, max(state) FILTER (WHERE rule_id = 'POL-ESC-002') AS esc, max(state) FILTER (WHERE rule_id = 'POL-COV-003') AS cov, max(state) FILTER (WHERE rule_id = 'POL-KPI-004') AS kpi, max(state) FILTER (WHERE rule_id = 'POL-REC-005') AS rec
FROM overview o LEFT JOIN worst USING (submission_id) GROUP BY ALL)
SELECT entity_id, submission_id, 'CAP-DET' AS capability, coalesce(cov, CASE WHEN completeness_pct < 60 THEN 'insufficient_evidence' ELSE 'supported' END) AS status FROM card
UNION ALL SELECT entity_id, submission_id, 'CAP-INV', coalesce(inv, 'supported') FROM card UNION ALL SELECT entity_id, submission_id, 'CAP-ESC', coalesce(esc, 'supported') FROM card UNION ALL SELECT entity_id, submission_id, 'CAP-RESP', coalesce(rec, 'supported') FROM card
UNION ALL SELECT entity_id, submission_id, 'CAP-OPS', CASE WHEN broken > 0 THEN 'potential_concern' WHEN verdict = 'INSUFFICIENT_EVIDENCE' THEN 'insufficient_evidence' ELSE 'supported' END FROM card
UNION ALL SELECT entity_id, submission_id, 'CAP-GOV', coalesce(kpi, 'not_assessed') FROM card
UNION ALL SELECT entity_id, submission_id, 'CAP-DISC', CASE WHEN inv = 'potential_concern' OR esc = 'potential_concern' THEN 'potential_concern' ELSE 'supported' END FROM card
UNION ALL SELECT entity_id, submission_id, 'CAP-RES', CASE WHEN blind_spot OR completeness_pct < 60 THEN 'potential_concern' ELSE 'supported' END FROM card""",
    "c17_peer_cohort": CARDS + " SELECT a.entity_id AS target_id, b.entity_id AS peer_id, CASE WHEN a.tier <> b.tier THEN 'tier_mismatch' END AS reason FROM entities a JOIN entities b ON a.sector = b.sector AND a.entity_id <> b.entity_id",
    "d13_peer_comparison": CARDS + """, long AS (SELECT entity_id, 'overdue_escalation' AS metric, overdue_escalation AS value, true AS low FROM rates WHERE submission_id IN (SELECT submission_id FROM latest) UNION ALL SELECT entity_id, 'investigation_depth', investigation_depth, false FROM rates WHERE submission_id IN (SELECT submission_id FROM latest)
  UNION ALL SELECT entity_id, 'sensor_coverage', sensor_coverage, false FROM rates WHERE submission_id IN (SELECT submission_id FROM latest) UNION ALL SELECT entity_id, 'concern_density', concern_density, true FROM rates WHERE submission_id IN (SELECT submission_id FROM latest)),
grouped AS (SELECT t.entity_id AS target_id, t.metric, t.value, t.low, count(s.value) AS n, list_sort(list(s.value) FILTER (WHERE s.value IS NOT NULL)) AS v, count(*) FILTER (WHERE s.value < t.value) AS less, count(*) FILTER (WHERE s.value = t.value) AS equal
  FROM long t LEFT JOIN (SELECT a.entity_id AS a, b.entity_id AS b FROM entities a JOIN entities b ON a.sector = b.sector AND a.tier = b.tier AND a.entity_id <> b.entity_id) p ON p.a = t.entity_id LEFT JOIN long s ON s.entity_id = p.b AND s.metric = t.metric GROUP BY t.entity_id, t.metric, t.value, t.low),
stats AS (SELECT *, CASE WHEN n >= 4 THEN (v[j1] * (4 - d1) + v[j1 + 1] * d1) / 4 WHEN n = 3 THEN v[1] END AS q25, CASE WHEN n >= 4 THEN (v[j3] * (4 - d3) + v[j3 + 1] * d3) / 4 WHEN n = 3 THEN v[3] END AS q75, CASE WHEN n >= 3 THEN list_median(v) END AS med
  FROM (SELECT *, (n + 1) - j1 * 4 AS d1, (n + 1) * 3 - j3 * 4 AS d3 FROM (SELECT *, greatest(1, least(n - 1, (n + 1) // 4)) AS j1, greatest(1, least(n - 1, (n + 1) * 3 // 4)) AS j3 FROM grouped)))
SELECT target_id, metric, value, n AS peers, round(q25, 2) AS q25, round(med, 2) AS median, round(q75, 2) AS q75, round(q75 - q25, 2) AS iqr, CASE WHEN n >= 3 THEN round((less + 0.5 * equal) / n * 100, 1) END AS percentile_rank,
  CASE WHEN n < 3 THEN 'UNAVAILABLE' WHEN (low AND value <= med) OR (NOT low AND value >= med) THEN 'FAVORABLE' WHEN (low AND value > q75) OR (NOT low AND value < q25) THEN 'OUTLIER_CONCERN' ELSE 'ALIGNED_WITH_PEERS' END AS state FROM stats""",
    "b28_sectors": CARDS + " SELECT entity_id, CASE WHEN sector <> 'ASIA' THEN sector ELSE 'Financial / Banking' END AS sector FROM entities",
    "d22_trend_points": CARDS + " SELECT * EXCLUDE (period_start, period_end) FROM points",
    "e4_reporting_gaps": CARDS + """, following AS (SELECT *, lead(period_start) OVER (PARTITION BY entity_id ORDER BY period_start) AS next FROM points)
SELECT entity_id, label, trend_index, NULL::bigint AS gap_days FROM points
UNION ALL SELECT entity_id, CASE WHEN month(period_end + INTERVAL 1 DAY) % 3 = 1 AND month(next - INTERVAL 1 DAY) = month(period_end + INTERVAL 1 DAY) + 2 THEN year(period_end) || '-Q' || quarter(period_end) ELSE strftime(period_end + INTERVAL 1 DAY, '%Y-%m-%d') || ' to ' || strftime(next - INTERVAL 1 DAY, '%Y-%m-%d') END, NULL, date_diff('day', period_end, next)
FROM following WHERE date_diff('day', period_end, next) > 35""",
    "e5_trajectories": CARDS + """, ends AS (SELECT entity_id, count(*) AS periods, arg_min(trend_index, period_start) AS fi, arg_max(trend_index, period_start) AS li, arg_min(adverse, period_start) AS fa, arg_max(adverse, period_start) AS la FROM points GROUP BY entity_id)
SELECT entity_id, periods, round(li - fi, 1) AS change, CASE WHEN periods < 2 THEN 'INSUFFICIENT_HISTORY' WHEN li - fi <= -15 OR (li < fi AND la = 0 AND fa > 0) THEN 'IMPROVING' WHEN li - fi >= 15 OR la > fa + 2 THEN 'DETERIORATING' ELSE 'STABLE' END AS trajectory FROM ends""",
    "e3_canonical_submission": CARDS + ", " + _REVISIONS + " SELECT submission_id, revision, status FROM revisions QUALIFY row_number() OVER (PARTITION BY submission_id ORDER BY status = 'committed' DESC, revision DESC) = 1",
    "e2_next_revision": CARDS + ", " + _REVISIONS + " SELECT entity_id, year(period_start) AS y, quarter(period_start) AS q, max(revision) + 1 AS next_revision FROM revisions GROUP BY entity_id, period_start",
    "e8_policy_changes": CARDS + " SELECT entity_id, year(period_start) AS y, quarter(period_start) AS q, before, policy_version FROM (SELECT *, lag(policy_version) OVER (PARTITION BY entity_id ORDER BY period_start) AS before FROM (SELECT *, 'v' || (year(period_start) - year(period_start) % 2) AS policy_version FROM submissions)) WHERE before <> policy_version",
    "d30_hypotheses": CARDS + " SELECT * FROM hypotheses",
}
