"""The five rule detectors (R1-R5), each over every submission at once, and their union.

All give the columns of FINDINGS. "insufficient_evidence" is a state of its own: what a
missing or incomplete source leaves open is never a concern.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy
from ..adapters import Tables
from ..shared import written
from ..functions.clean import metric_kind, number, severity_map, substantive
from .exceptions import excused
from .intake import TYPE_ALIASES, canonical_type

FINDINGS = ("entity_id", "submission_id", "rule_id", "object_type", "object_id", "evidence_state", "severity", "measure")


def findings(df: DataFrame, rule: str, kind: str, key: str, state: Column, severity: Column, measure: Column) -> DataFrame:
    return df.select("entity_id", "submission_id", F.lit(rule).alias("rule_id"), F.lit(kind).alias("object_type"), F.col(key).alias("object_id"), state.alias("evidence_state"), severity.alias("severity"), measure.cast("double").alias("measure"))


def source_status(t: Tables, record_types: tuple = policy.RECORD_TYPES) -> DataFrame:
    """D3: per submission and record type asked for whether all declared sources are whole,
    and the first reason against it.

    A source's checks have a fixed order; the first source by id that fails one gives the
    reason. What no source declares is not_declared; ids that two sources share are found
    last. Records are counted by id once, in a written table from which all counts come, so
    no check gathers a source's rows, and only records of the types asked for are read. A
    type's other names count as it (G5).
    """
    named = [*record_types, *(other for other, name in TYPE_ALIASES.items() if name in record_types)]

    def typed(rows: DataFrame) -> DataFrame:  # plain names first, which reach the scans
        return rows.where(F.col("record_type").isin(*named)).withColumn("record_type", canonical_type(F.col("record_type")))

    ids = written(typed(t.records).groupBy("submission_id", "record_type", "native_id", "source_id").agg(F.count("*").alias("n"), F.bool_or("is_quarantined").alias("bad")), "record-ids")
    kept = ids.groupBy("source_id").agg(F.sum("n").alias("kept"), F.count("*").alias("distinct_ids"), F.bool_or("bad").alias("quarantined"))
    # more records than ids: an id comes twice in one source, which is a reason of its own, or in two
    shared = ids.groupBy("submission_id", "record_type").agg((F.sum("n") > F.count_distinct(F.struct("native_id"))).alias("shared"))
    blocked = t.issues.where((F.col("severity") == "error") | F.col("issue_type").isin(*policy.BLOCKING_ISSUES)).select("source_id", F.lit(True).alias("blocked")).distinct()
    period = t.submissions.select("submission_id", F.col("period_start").alias("from"), F.col("period_end").alias("to"))
    scope = F.lower(F.coalesce("export_scope", F.lit("")))
    rows = typed(t.sources).join(kept, "source_id", "left").join(blocked, "source_id", "left").join(period, "submission_id")
    reason = (F.when(F.col("actual_rows").isNull(), "not_submitted")
              .when(~F.coalesce(F.col("sampling_method") == "full_population", F.lit(False)), "sampled")
              .when(scope.rlike("|".join(policy.PARTIAL_SCOPES)), "partial_scope")
              .when((F.col("actual_rows") != F.col("declared_rows")) | (F.coalesce("kept", F.lit(0)) != F.col("actual_rows")), "count_mismatch")
              .when(F.col("quarantined"), "quarantined_records")
              .when(F.col("distinct_ids") < F.col("kept"), "duplicate_ids")
              .when(F.col("blocked"), "blocking_issue")
              .when((F.col("period_start") != F.col("from")) | (F.col("period_end") != F.col("to")), "period_not_covered"))
    declared = rows.withColumn("reason", reason).groupBy("submission_id", "record_type").agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("source_id"))).alias("reason"), F.lit(True).alias("declared"))
    every = t.submissions.select("submission_id", F.explode(F.array(*map(F.lit, record_types))).alias("record_type"))
    found = every.join(declared, ["submission_id", "record_type"], "left").join(shared, ["submission_id", "record_type"], "left")
    reason = F.when(F.col("declared").isNull(), "not_declared").when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("shared"), "overlapping_ids")
    return found.select("submission_id", "record_type", reason.isNull().alias("complete"), reason.alias("reason"))


def source_predicates(t: Tables) -> DataFrame:
    """B32 per submission: which record types are available (records came, or a file of a
    declared source), whether claims and an escalation source are declared, the latter by
    its type or its scope's wording."""
    sent = t.sources.where("actual_rows IS NOT NULL").select("submission_id", "record_type").unionByName(t.records.select("submission_id", "record_type")).withColumn("record_type", canonical_type(F.col("record_type")))
    by = sent.groupBy("submission_id").agg(F.array_sort(F.collect_set("record_type")).alias("available"))
    told = F.lower(F.coalesce("export_scope", F.lit(""))).contains("escalat")
    said = t.sources.groupBy("submission_id").agg(F.bool_or(canonical_type(F.col("record_type")) == "reported_claims").alias("claims_declared"), F.bool_or((F.col("record_type") == "escalations") | told).alias("escalations_declared"))
    no = F.lit(False)
    return (t.submissions.select("submission_id").join(by, "submission_id", "left").join(said, "submission_id", "left")
            .select("submission_id", F.array_join(F.coalesce("available", F.array().cast("array<string>")), ",").alias("available"), F.coalesce("claims_declared", no).alias("claims_declared"), F.coalesce("escalations_declared", no).alias("escalations_declared")))


def status_of(t: Tables, *record_types: str) -> DataFrame:
    """source_status of record types as a written table, worked out once for each."""
    known = t._status = getattr(t, "_status", None) or {}
    lacking = tuple(r for r in record_types if r not in known)
    if lacking:
        known |= dict.fromkeys(lacking, written(source_status(t, lacking), "source-status"))
    return known[record_types[0]]


def with_status(df: DataFrame, t: Tables, record_type: str, name: str) -> DataFrame:
    status = status_of(t, record_type).where(F.col("record_type") == record_type).select("submission_id", F.col("complete").alias(name))
    return df.join(status, "submission_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def valid(cases: DataFrame) -> DataFrame:
    """Cases that count as evidence: those that are not quarantined."""
    return cases.where(~F.col("is_quarantined"))


def without_rows(t: Tables, rows: DataFrame, key: str = "submission_id", submissions: DataFrame | None = None) -> DataFrame:
    """Submissions for which rows hold nothing."""
    return (t.submissions if submissions is None else submissions).join(rows.select(key), key, "left_anti")


def of_submission(rows: DataFrame, rule: str, severity: str) -> DataFrame:
    """A finding on the submission itself: the evidence that a rule asks for is absent."""
    return findings(rows, rule, "submission", "submission_id", F.lit("insufficient_evidence"), F.lit(severity), F.lit(1))


def closure(t: Tables) -> DataFrame:
    """Closed cases without the actions, digests or texts that their severity asks for,
    and submissions without cases."""
    status = F.coalesce(F.nullif(F.upper("status"), F.lit("")), F.when(F.col("closed_at").isNotNull(), "CLOSED"))
    cases = valid(t.cases).where(status.isin("CLOSED", "RESOLVED"))
    cases = cases.join(excused(cases, t.exceptions, "POL-INV-001", "case", "case_id", "created_at"), "case_id", "left_anti")
    names = sorted({a for actions, _ in policy.REQUIRED_ACTIONS.values() for a in actions})
    kind = F.lower("action_type")
    done = t.actions.groupBy("case_id").agg(
        *[F.bool_or(kind.contains(n.lower())).alias(f"has_{n}") for n in names],
        *[F.bool_or(kind.contains(n.lower()) & substantive(F.col("artifact_hash"))).alias(f"hash_{n}") for n in names],
        F.bool_or(kind.contains("triage")).alias("triage"))
    no = F.lit(False)
    missing = F.lit(0)
    for severity, (actions, hashed) in policy.REQUIRED_ACTIONS.items():
        for a in actions:
            lacks = ~F.coalesce(f"{'hash' if hashed else 'has'}_{a}", no)
            missing = missing + F.when((F.col("severity") == severity) & lacks, 1).otherwise(0)
    said = no
    for column in ("disposition", "resolution", "closing_notes", "root_cause"):
        said = said | substantive(F.col(column))
    missing = missing + F.when(~said & ~F.coalesce("triage", no), 1).otherwise(0)
    judged = with_status(cases.join(done, "case_id", "left").withColumn("missing", missing).where("missing > 0"), t, "investigation_actions", "whole")
    own = findings(judged, "POL-INV-001", "case", "case_id", F.when(F.col("whole"), "potential_concern").otherwise("insufficient_evidence"), F.when(F.col("severity").isin("CRITICAL", "HIGH"), "high").otherwise("medium"), F.col("missing"))
    return own.unionByName(of_submission(without_rows(t, valid(t.cases)), "POL-INV-001", "medium"))


def escalation_times(t: Tables) -> DataFrame:
    """case_id, escalation_id, ts of escalations and of actions that escalate (G2); of one id the earliest."""
    acted = t.actions.where(F.lower("action_type").contains("escalat")).select("case_id", F.col("action_id").alias("escalation_id"), "ts")
    return t.escalations.unionByName(acted).groupBy("case_id", "escalation_id").agg(F.min("ts").alias("ts"))


def escalation(t: Tables) -> DataFrame:
    """R2: cases that had to be escalated before the period's end and were not in time."""
    limit = severity_map(policy.ESCALATION_SECONDS, F.col("severity"), policy.ESCALATION_SECONDS["MEDIUM"])
    cases = (valid(t.cases).where(F.col("severity").isin(*policy.ESCALATING)).withColumn("due", F.timestamp_add("SECOND", limit, "created_at"))
             .join(t.submissions.select("submission_id", "period_end"), "submission_id")
             .where((F.col("due") <= F.col("period_end")) & ~F.coalesce(F.col("closed_at") <= F.col("due"), F.lit(False))))
    cases = cases.join(excused(cases, t.exceptions, "POL-ESC-002", "case", "case_id", "created_at"), "case_id", "left_anti")
    first = escalation_times(t).groupBy("case_id").agg(F.min("ts").alias("first"), F.count("*").alias("n"))
    judged = with_status(cases.join(first, "case_id", "left"), t, "escalations", "whole")
    told = F.lower(F.concat_ws(" ", "investigation_notes", "closing_notes", "notes", "disposition")).rlike("|".join(policy.OUT_OF_BAND))
    late = (F.unix_timestamp("first") - F.unix_timestamp("due")) / 3600.0
    state = F.when(F.col("n").isNull() & (told | ~F.col("whole")), "insufficient_evidence").when(F.col("n").isNull() | (late > 0), "potential_concern")
    severity = F.when(F.col("n").isNull() & ~told & F.col("whole"), "high").otherwise("medium")
    return findings(judged.where(state.isNotNull()), "POL-ESC-002", "case", "case_id", state, severity, F.round(F.coalesce(late, F.lit(0.0)), 4))


def latest_submission(t: Tables) -> DataFrame:
    return t.submissions.groupBy("entity_id").agg(F.max_by("submission_id", "period_end").alias("submission_id"), F.max("period_end").alias("period_end"))


def coverage(t: Tables) -> DataFrame:
    """Active important assets with a broken agent, or without any sign of one; an
    entity's latest submission, if it has no inventory at all."""
    agent = F.upper(F.coalesce("agent_status", F.lit("")))
    broken = agent.isin(*policy.BROKEN_AGENTS)
    silent = (agent == "") & F.col("last_heartbeat").isNull() & F.col("last_seen").isNull()
    assets = t.assets.where(F.upper("criticality").isin("HIGH", "CRITICAL") & (F.upper(F.coalesce("status", F.lit("ACTIVE"))) == "ACTIVE") & (broken | silent))
    latest = latest_submission(t)
    own = findings(assets.join(latest, "entity_id"), "POL-COV-003", "asset", "asset_id", F.when(broken, "potential_concern").otherwise("insufficient_evidence"), F.when(broken, "high").otherwise("medium"), F.lit(1))
    return own.unionByName(of_submission(without_rows(t, t.assets, "entity_id", latest), "POL-COV-003", "high"))


def triaged_claims(claims: DataFrame) -> DataFrame:
    """Adds kind, value and exclusion_reason (B27): the first check that a claim fails."""
    text = F.col("claimed")
    value = number(text)
    reason = (F.when(metric_kind(F.col("metric_name")).isNull(), "out_of_scope_metric")
              .when(F.col("claim_entity") != F.col("entity_id"), "out_of_scope_entity")
              .when(F.col("claim_start").isNull() | F.col("claim_end").isNull() | (F.col("claim_start") >= F.col("claim_end")), "invalid_claim_period")
              .when((F.col("claim_end") <= F.col("period_start")) | (F.col("claim_start") >= F.col("period_end")), "out_of_scope_period")
              .when((F.col("claim_start") < F.col("period_start")) | (F.col("claim_end") > F.col("period_end")), "claim_period_not_fully_covered")
              .when(~F.lower(F.coalesce("unit", F.lit("percent"))).isin(*policy.PERCENT_UNITS), "unsupported_metric_unit")
              .when(text.isNull(), "malformed_missing_value")
              .when(value.isNull() | F.isnan(value), "malformed_non_numeric_value")
              .when((value < 0) | (value > 100), "malformed_value_out_of_range"))
    return claims.withColumn("kind", metric_kind(F.col("metric_name"))).withColumn("value", value).withColumn("exclusion_reason", reason)


def interval(n: Column, yes: Column, unknown: Column, claimed: Column) -> tuple[Column, Column, Column]:
    """Bounds of compliance in percent, and what they say of a claim."""
    low, high = F.round(yes / n * 100, 2), F.round((yes + unknown) / n * 100, 2)
    state = (F.when(n == 0, "insufficient_evidence").when(claimed > high, "contradictory").when(low >= claimed, "supported")
             .when(unknown > 0, "insufficient_evidence").otherwise("supported"))
    return low, high, state


def reconciled_claims(t: Tables) -> DataFrame:
    """R4 in full: every valid claim with counts, bounds and state.

    Claims meet cases by submission, and by time in a residual predicate. A case counts
    once, as failed before unknown before compliant.
    """
    status_of(t, "escalations", "cases")
    claims = triaged_claims(t.claims).where("exclusion_reason IS NULL").select("claim_id", "submission_id", "entity_id", "kind", "value", "claim_start", "claim_end", "period_end")
    to_escalate, to_close = (severity_map(x, F.col("severity"), 86400) for x in (policy.ESCALATION_SECONDS, policy.CLOSURE_SECONDS))
    of_entity = valid(t.cases)
    cases = of_entity.drop("entity_id")
    excuses = [excused(of_entity, t.exceptions, rule, "case", "case_id", "created_at").withColumn("excused_kind", F.lit(kind)) for rule, kind in (("POL-ESC-002", "escalation"), ("POL-INV-001", "closure"))]
    met = claims.join(cases, "submission_id").withColumn("due", F.timestamp_add("SECOND", F.when(F.col("kind") == "escalation", to_escalate).otherwise(to_close), "created_at")).where("created_at >= claim_start AND created_at < claim_end")
    met = met.where((F.col("kind") == "closure") | F.col("severity").isin(*policy.ESCALATING))
    met = met.join(excuses[0].unionByName(excuses[1]).withColumnRenamed("excused_kind", "kind"), ["case_id", "kind"], "left_anti")
    first = t.escalations.groupBy("case_id").agg(F.sort_array(F.collect_set("ts")).alias("times"))
    met = with_status(met.join(first, "case_id", "left"), t, "escalations", "escalations_whole")
    times = F.filter(F.coalesce("times", F.array().cast("array<timestamp>")), lambda x: (x >= F.col("created_at")) & (x < F.col("period_end")) & (x <= F.col("due")))
    by_escalation = F.when(F.size(times) > 0, "yes").when((F.col("due") <= F.col("period_end")) & F.col("escalations_whole"), "no").otherwise("unknown")
    by_closure = (F.when(F.col("closed_at") < F.col("created_at"), "unknown").when((F.col("closed_at") <= F.col("due")) & (F.col("closed_at") < F.col("period_end")), "yes")
                  .when(F.col("due") <= F.col("period_end"), "no").otherwise("unknown"))
    met = met.withColumn("outcome", F.when(F.col("kind") == "escalation", by_escalation).otherwise(by_closure))
    counts = met.groupBy("claim_id").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "yes").alias("yes"), F.count_if(F.col("outcome") == "unknown").alias("unknown"))
    whole = with_status(claims.join(counts, "claim_id", "left"), t, "cases", "cases_whole").na.fill(0, ["n", "yes", "unknown"])
    n = F.when(F.col("cases_whole"), F.col("n")).otherwise(0)
    low, high, state = interval(n, F.col("yes"), F.col("unknown"), F.col("value"))
    return whole.select("entity_id", "submission_id", "claim_id", "kind", "value", n.alias("population"), "yes", "unknown", F.when(n > 0, low).otherwise(0.0).alias("lower_pct"), F.when(n > 0, high).otherwise(0.0).alias("upper_pct"), state.alias("evidence_state"))


def kpi(t: Tables) -> DataFrame:
    """Claims of compliance against what the cases allow, and declared sources of
    claims for which none came: of a submission's the first."""
    empty = without_rows(t, t.claims, submissions=t.sources.where("record_type = 'reported_claims'").groupBy("submission_id").agg(F.first("entity_id").alias("entity_id"), F.min("source_id").alias("source_id")))
    return findings(empty, "POL-KPI-004", "source", "source_id", F.lit("insufficient_evidence"), F.lit("medium"), F.lit(0)).unionByName(findings(reconciled_claims(t), "POL-KPI-004", "claim", "claim_id", F.col("evidence_state"), F.when(F.col("evidence_state") == "contradictory", "high").otherwise("medium"), F.col("upper_pct")))


def recurrence(t: Tables, least: int = policy.RECURRENCE) -> DataFrame:
    """Assets with `least` alerts or more; measure: distinct linked cases."""
    latest = latest_submission(t)
    assets = t.assets.select("asset_id", "entity_id").join(latest, "entity_id")
    free = assets.join(excused(assets, t.exceptions, "POL-REC-005", "asset", "asset_id", "period_end"), "asset_id", "left_anti")
    linked = t.alerts.select("alert_id", "asset_id").join(t.links, "alert_id", "left")
    counts = linked.groupBy("asset_id").agg(F.count_distinct("alert_id").alias("alerts"), F.count_distinct("case_id").alias("cases")).where(F.col("alerts") >= least)
    return findings(free.join(counts, "asset_id"), "POL-REC-005", "asset", "asset_id", F.lit("potential_concern"), F.lit("medium"), F.col("cases"))


#: rule id -> detector; a new rule is one more entry.
REGISTRY = {"POL-INV-001": closure, "POL-ESC-002": escalation, "POL-COV-003": coverage, "POL-KPI-004": kpi, "POL-REC-005": recurrence}


def assess(t: Tables, rules: dict = REGISTRY) -> DataFrame:
    """The findings of all rules, lazily; `findings_of` writes them once."""
    status_of(t, "cases", "investigation_actions", "escalations")
    out = None
    for rule in rules.values():
        own = rule(t)
        out = own if out is None else out.unionByName(own)
    return out


def findings_of(t: Tables) -> DataFrame:
    """The findings of all rules as written tables, for what reads them several times; a
    table for each rule, so no two rules' shuffles are on disk at once."""
    if getattr(t, "_findings", None) is None:
        status_of(t, "cases", "investigation_actions", "escalations")
        t._findings = reduce(DataFrame.unionByName, [written(rule(t), "findings") for rule in REGISTRY.values()])
    return t._findings
