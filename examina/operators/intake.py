"""Intake: normalization of eleven record types, issues, quarantine, identity."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clean import cleaned, foreign_entities, iso_time, month_claim_period, number, percentage_metric


@dataclass(frozen=True)
class Spec:
    """required: fields without which a row is rejected. times: field -> severity of a bad
    value (None: silently null). event: the time that must lie in the period. alias:
    field -> fields that may stand for it. key: the record's own id, which native_id fills (B21)."""

    required: tuple = ()
    times: dict = field(default_factory=dict)
    numbers: tuple = ()
    others: tuple = ()
    event: str | None = None
    alias: dict = field(default_factory=dict)
    key: str | None = None


# The fields of the eleven record types.
SPECS = {
    "assets": Spec(("hostname",), {"last_heartbeat": "error", "last_seen": "error", "timestamp": "error"}, (), ("ip_address", "criticality", "owner", "environment", "agent_status", "status"), "timestamp", key="asset_id"),
    "alerts": Spec(("timestamp", "title", "severity", "source_tool", "triage_status"), {"timestamp": "error"}, (), ("affected_asset_id",), "timestamp", {"affected_asset_id": ("asset_id",)}, key="alert_id"),
    "cases": Spec(("created_at", "severity", "status"), {"created_at": "error", "closed_at": "warning"}, (), ("assigned_analyst", "root_cause", "disposition", "resolution", "investigation_notes", "closing_notes", "notes", "title", "asset_id"), "created_at", key="case_id"),
    "case_alert_links": Spec(("case_id", "alert_id"), {"linked_at": "warning"}, (), (), "linked_at"),
    "investigation_actions": Spec(("case_id", "action_type", "actor", "timestamp"), {"timestamp": "error"}, (), ("artifact_hash",), "timestamp", key="action_id"),
    "escalations": Spec(("case_id", "escalation_level", "notified_party", "timestamp"), {"timestamp": "error"}, (), (), "timestamp", key="escalation_id"),
    "coverage_observations": Spec(("sensor_name", "status", "timestamp"), {"timestamp": "error"}, ("expected_eps", "observed_eps"), (), "timestamp"),
    "ownership": Spec(("asset_id", "owner_team"), {"effective_date": None}, (), ("contact_email",)),
    "exceptions": Spec(("policy_reference", "affected_scope", "approved_by", "expiry_date", "status"), {"expiry_date": "error", "valid_from": "warning"}, (), ("target_type", "target_id", "reason"), None, {"valid_from": ("effective_date",)}, key="exception_id"),
    "remediations_validations": Spec(("case_id", "action_summary", "validated_by", "validation_date", "result"), {"validation_date": "error"}, (), (), "validation_date", key="remediation_id"),
    "reported_claims": Spec(("metric_name", "period", "metric_value"), {"period_start": "error", "period_end": "error"}, ("metric_value",), ("unit", "entity_id", "notes"), None, {"metric_value": ("claimed_value",)}, key="claim_id"),
}


def issue(kind: str, severity: str, name: str) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(name).alias("field"))


def normalized(raw: DataFrame, record_type: str) -> DataFrame:
    """raw (all strings, with native_id, entity_id of the submission as `submitter`, and the
    period's `period_start` and `period_end`) with typed fields, `issues` and
    `is_quarantined` added. Missing columns count as null. A row with an error stays, for
    provenance, and is quarantined; unknown columns go.
    """
    spec = SPECS[record_type]
    have = {c.lower() for c in raw.columns}

    def text(name: str) -> Column:
        names = [n for n in (name, *spec.alias.get(name, ())) if n.lower() in have]
        return F.coalesce(*[cleaned(F.col(n).cast("string")) for n in names]) if names else F.lit(None).cast("string")

    issues, out = [], []
    for name in ("native_id", *spec.required):
        issues.append(F.when(text(name).isNull(), issue("MISSING_REQUIRED_FIELD", "error", name)))
    for name, severity in spec.times.items():
        value = iso_time(text(name))
        if severity:
            issues.append(F.when(text(name).isNotNull() & value.isNull(), issue("MALFORMED_TIMESTAMP", severity, name)))
        out.append(value.alias(name))
    for name in spec.numbers:
        value = number(text(name))
        issues.append(F.when(text(name).isNotNull() & value.isNull(), issue("INVALID_FIELD_TYPE", "error", name)))
        out.append(value.alias(name))
    if spec.event:
        at = iso_time(text(spec.event))
        issues.append(F.when((at < F.col("period_start")) | (at >= F.col("period_end")), issue("TIMESTAMP_OUT_OF_PERIOD", "warning", spec.event)))
    if record_type == "reported_claims":
        value = number(text("metric_value"))
        high = percentage_metric(F.coalesce(text("metric_name"), F.lit("")), text("unit")) & (value > 100)
        issues.append(F.when(F.isnan(value) | (value < 0) | high | (value == float("inf")), issue("CLAIM_VALUE_OUT_OF_RANGE", "error", "metric_value")))
        period = month_claim_period(text("period"), iso_time(text("period_start")), iso_time(text("period_end")))
        issues.append(F.when(text("period").isNotNull() & period.isNull(), issue("INVALID_CLAIM_PERIOD", "error", "period")))
    texts = [*(n for n in spec.required if n not in spec.times and n not in spec.numbers), *spec.others]
    cells = [F.col(n).cast("string") for n in dict.fromkeys(["native_id", *spec.required, *spec.others]) if n.lower() in have]
    issues.append(F.when(F.size(foreign_entities(cells, F.col("submitter"))) > 0, issue("CROSS_ENTITY_REFERENCE", "error", "")))
    found = F.array_compact(F.array(*issues))
    own = [F.coalesce(text(spec.key), text("native_id")).alias(spec.key)] if spec.key else []
    texts = [n for n in texts if n != spec.key]
    return raw.select("row_id", "submitter", text("native_id").alias("native_id"), *own, *[text(n).alias(n) for n in texts if n != "entity_id"], *out, found.alias("issues")).withColumn("is_quarantined", F.exists("issues", lambda i: i["severity"] == "error"))


def content_digest(content: list[str]) -> Column:
    """The digest by which records of one key are compared."""
    return F.md5(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}))


def identities(rows: DataFrame, key: list[str], order: list[str], content: list[str], known: DataFrame | None = None) -> DataFrame:
    """Adds identity: NEW, DUPLICATE_RECORD (equal to the first accepted row of its key,
    kept) or CONFLICTING_IDENTITY (different from it, quarantined). rejected rows (bool
    column `rejected`) have none and aren't first (E1). known: the key columns and `digest`
    (content_digest) of the first rows of keys that came before; no row of theirs is NEW."""
    w = W.partitionBy(*key).orderBy(F.col("rejected"), *order)
    rows = rows.withColumn("digest", content_digest(content)).withColumn("n", F.row_number().over(w)).withColumn("first", F.first_value("digest").over(w))
    if known is not None:
        rows = rows.join(known.select(*key, F.col("digest").alias("before")), key, "left").withColumn("first", F.coalesce("before", "first")).withColumn("n", F.when(F.col("before").isNull(), F.col("n"))).drop("before")
    return rows.withColumn("identity", F.when(F.col("rejected"), None).when(F.col("n") == 1, "NEW").when(F.col("digest") == F.col("first"), "DUPLICATE_RECORD").otherwise("CONFLICTING_IDENTITY")).drop("n", "first", "digest")


# Other names of record types.
TYPE_ALIASES = {"actions": "investigation_actions", "claims": "reported_claims", "remediations": "remediations_validations"}


def canonical_type(name: Column) -> Column:
    """The record type that a name stands for."""
    known = F.create_map(*[F.lit(x) for kv in TYPE_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, name), name)


def counts(rows: DataFrame) -> DataFrame:
    """D1 over normalized rows (record_type, issues, is_quarantined, identity, is_orphan)."""
    def has(kind: str) -> Column:
        return F.count_if(F.exists("issues", lambda i: i["type"].startswith(kind)))

    return rows.groupBy("record_type").agg(F.count("*").alias("parsed"), F.count_if(~F.col("is_quarantined")).alias("accepted"), F.count_if("is_quarantined").alias("quarantined"), has("MALFORMED_TIMESTAMP").alias("bad_times"), has("TIMESTAMP_OUT").alias("out_of_period"), has("MISSING").alias("missing_fields"), has("CROSS").alias("foreign"),
                                         F.count_if(F.col("identity") == "DUPLICATE_RECORD").alias("duplicates"), F.count_if(F.col("identity") == "CONFLICTING_IDENTITY").alias("conflicts"), F.count_if("is_orphan").alias("orphans"))


def source_issues(sources: DataFrame) -> DataFrame:
    """Declared sources that were not sent, or with another number of rows."""
    kind = (F.when(F.col("actual_rows").isNull() & F.col("is_optional"), "MISSING_OPTIONAL_SOURCE").when(F.col("actual_rows").isNull(), "MISSING_REQUIRED_SOURCE")
            .when(F.col("actual_rows") != F.col("declared_rows"), "ROW_COUNT_MISMATCH"))
    return sources.select("submission_id", "source_id", kind.alias("issue")).where("issue IS NOT NULL")


def file_registry(files: DataFrame) -> DataFrame:
    """Of every (submission_id, source_id) the file that arrived last."""
    w = W.partitionBy("submission_id", "source_id").orderBy(F.desc("arrived_at"), F.desc("digest"))
    return files.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def in_scope(rows: DataFrame, grants: list[str] | None) -> DataFrame:
    """None or "*" is every entity, an empty list none."""
    if grants is None or "*" in grants:
        return rows
    return rows.where(F.col("entity_id").isin(*grants)) if grants else rows.where(F.lit(False))
