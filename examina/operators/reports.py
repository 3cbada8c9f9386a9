"""Runs, snapshots, registries and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import written
from ..sources import versions
from . import integrity, review
from .scorecard import adverse


def fingerprint(sources: DataFrame, policy_version: str, rule_version: str) -> DataFrame:
    """D29 per submission: the digest of its sorted sources and of what the run uses."""
    files = F.array_join(F.sort_array(F.collect_list(F.concat_ws("|", "source_id", F.col("declared_rows").cast("string"), F.coalesce(F.col("actual_rows").cast("string"), F.lit("-"))))), ";")
    return sources.groupBy("submission_id").agg(F.sha2(F.concat_ws("#", files, F.lit(policy_version), F.lit(rule_version)), 256).alias("fingerprint"))


def listing(rows: DataFrame, order: list, page: int, size: int, **equal) -> DataFrame:
    """Rows that equal all given values, newest first, one page of them."""
    for k, v in equal.items():
        if v is not None:
            rows = rows.where(F.col(k) == v)
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def page_after(rows: DataFrame, order: dict[str, bool], size: int, after: dict | None = None) -> DataFrame:
    """the `size` rows that follow the row of keys `after` (the first ones if None) in
    an order of columns without nulls, True for descending, the last of them unique.

    Each task keeps its own first rows, so a page costs one scan of what the keys let
    through, whatever its number; nothing is sorted as a whole and none of the pages before
    it is read again.
    """
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for name, falling in order.items():
            value = F.lit(after[name])
            beyond = beyond | (equal & ((F.col(name) < value) if falling else (F.col(name) > value)))
            equal = equal & (F.col(name) == value)
        rows = rows.where(beyond)
    return rows.orderBy(*[F.desc(name) if falling else F.asc(name) for name, falling in order.items()]).limit(size)


def first_records(rows: DataFrame, scope: str, value: str, key: str, most: int = 10) -> DataFrame:
    """the first rows of each scope by value, as one text."""
    w = W.partitionBy(scope).orderBy(value, key)
    top = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return top.groupBy(scope).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", key))), lambda r: r[key]), ",").alias("first"))


def decision_counts(decisions: DataFrame, items: DataFrame, portfolios: DataFrame) -> DataFrame:
    """Decisions of each run over items and portfolios."""
    return decisions.join(items, "item_id").join(portfolios, "portfolio_id").groupBy("run_id").agg(F.count("*").alias("decisions"))


def report_status(reports: DataFrame, events: DataFrame, outbox: DataFrame) -> DataFrame:
    """Each report with the queue state of its last custody event."""
    last = events.groupBy("object_id").agg(F.max_by("event_id", F.struct("seq", "event_id")).alias("event_id"))
    return reports.join(last, reports.report_id == last.object_id, "left").join(outbox.select("event_id", "status"), "event_id", "left").select("report_id", "event_id", "status")


def unhealthy_assets(assets: DataFrame, findings: DataFrame) -> DataFrame:
    """Active assets with a broken agent that no finding flags."""
    from .. import policy

    flagged = findings.where("object_type = 'asset'").select(F.col("object_id").alias("asset_id")).distinct()
    broken = assets.where(F.upper(F.coalesce("agent_status", F.lit(""))).isin(*policy.BROKEN_AGENTS) & (F.coalesce("status", F.lit("ACTIVE")) == "ACTIVE"))
    return broken.join(flagged, "asset_id", "left_anti").select("entity_id", "asset_id")


def marginal_gains(units: DataFrame, chosen: DataFrame) -> DataFrame:
    """What each unit would add to its submission's chosen units, and per minute."""
    covered = chosen.groupBy("submission_id", "hypothesis").agg(F.sum("weight").alias("have"))
    out = units.join(covered, ["submission_id", "hypothesis"], "left").na.fill(0.0, ["have"])
    for c in ("asset", "category"):
        out = out.join(chosen.select("submission_id", c, F.lit(0).alias(f"new_{c}")).distinct(), ["submission_id", c], "left").na.fill(1, [f"new_{c}"])
    out = out.join(chosen.select("submission_id", F.lit(0).alias("new_period")).distinct(), "submission_id", "left").na.fill(1, ["new_period"])
    alpha = F.least(F.lit(1.0), F.col("have") + F.col("weight")) - F.least(F.lit(1.0), F.col("have"))
    gain = review.ALPHA * alpha + review.BETA * (F.col("new_asset") + F.col("new_category") + F.col("new_period")) + review.GAMMA * F.col("value")
    return out.select("submission_id", "unit_id", F.round(gain, 6).alias("gain"), F.round(gain / F.col("minutes"), 9).alias("efficiency"))


def portfolio_items(portfolio: DataFrame) -> DataFrame:
    """P10 per item: its place, what it would teach, and the minutes spent up to it."""
    w = W.partitionBy("submission_id").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    return portfolio.select("submission_id", "rank", "unit_id", "stratum", "hypothesis", "minutes", "gain", F.sum("minutes").over(w).alias("minutes_so_far"))


def portfolio_summary(portfolio: DataFrame, budget: review.Budget) -> DataFrame:
    """P10 per portfolio: items, minutes, gain, items of each stratum and how far each fell
    short of its quota, and minutes left (null without a limit)."""
    q = budget.quota
    n = {s: F.count_if(F.col("stratum") == s) for s in review.STRATA}
    left = (F.lit(budget.minutes) - F.sum("minutes")) if budget.minutes is not None else F.lit(None).cast("double")
    return portfolio.groupBy("submission_id").agg(
        F.count("*").alias("items"), F.sum("minutes").alias("minutes"), F.round(F.sum("gain"), 6).alias("gain"), *[n[s].alias(s) for s in review.STRATA],
        *[F.greatest(F.lit(0), F.lit(q[s]) - n[s]).alias(f"{s}_short") for s in review.STRATA], left.alias("minutes_left"))


def valid_units(units: DataFrame) -> DataFrame:
    """Units with a positive cost and no negative value."""
    return units.where("minutes > 0 AND value >= 0")


def verified(commitments: DataFrame, records: DataFrame) -> DataFrame:
    """Whether a stored commitment (key, commitment) equals the record's own."""
    return commitments.join(records.select("key", F.col("commitment").alias("own")), "key", "left").select("key", F.coalesce(F.col("commitment") == F.col("own"), F.lit(False)).alias("holds"))


def submission_commitments(files: DataFrame, records: DataFrame) -> DataFrame:
    """I7 per submission: the root over its files' digests and its records' commitments."""
    items = files.select("submission_id", F.col("digest").alias("item")).unionByName(records.select("submission_id", F.col("commitment").alias("item")))
    return integrity.roots(integrity.leaves(items, "submission_id", ["item"], "item"))


def checkpoints(log: DataFrame) -> DataFrame:
    """I10 per entity: root and size over all event digests."""
    leaves = integrity.leaves(log, "entity_id", ["seq"], "digest")
    return integrity.roots(leaves).join(leaves.groupBy("batch").agg(F.count("*").alias("size")), "batch")


def byte_issues(recorded: DataFrame, actual: DataFrame, kind: str) -> DataFrame:
    """entity_id, issue of rows (entity_id, key, digest) against what is there now (key,
    digest): `kind`_MISSING or `kind`_DIGEST_MISMATCH, case of digests aside (I11)."""
    j = recorded.select("entity_id", "key", F.lower("digest").alias("digest")).join(actual.select("key", F.lower("digest").alias("now")), "key", "left")
    return j.select("entity_id", F.when(F.col("now").isNull(), f"{kind}_MISSING").when(F.col("now") != F.col("digest"), f"{kind}_DIGEST_MISMATCH").alias("issue")).where("issue IS NOT NULL")


def audit_verdicts(log: DataFrame, checkpoints: DataFrame | None = None, *others: DataFrame) -> DataFrame:
    """I11 per entity of the log: VALID, or TAMPERED with the kinds of issues of its chain,
    its checkpoint if one is given, and of files and records (entity_id, issue) in others."""
    found = integrity.audit(log).select("entity_id", "issue")
    for more in [*([integrity.checkpoint_issues(log, checkpoints)] if checkpoints is not None else []), *others]:
        found = found.unionByName(more.select("entity_id", "issue"))
    issues = found.groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_set("issue")), ",").alias("issues"))
    return log.select("entity_id").distinct().join(issues, "entity_id", "left").select("entity_id", F.when(F.col("issues").isNull(), "VALID").otherwise("TAMPERED").alias("verdict"), F.coalesce("issues", F.lit("")).alias("issues"))


def artifact_checks(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Artifacts by name, expected digest against the content's."""
    return expected.join(actual, "name", "full_outer").select("name", F.when(F.col("content").isNull(), "absent").when(F.col("digest").isNull(), "undeclared").when(F.sha2("content", 256) == F.col("digest"), "ok").otherwise("changed").alias("state"))


def snapshot(runs: DataFrame, findings: DataFrame, decisions: DataFrame, cutoff: Column, **others: DataFrame) -> DataFrame:
    """One JSON document for each run, of its findings, of the decisions that were
    active at the cutoff, and of the rows of `others` (files, items, requests: all columns,
    with submission_id, and `at` where they have a time). What came after the cutoff
    doesn't change it."""
    parts = {"findings": findings.select("submission_id", "rule_id", "object_id", "evidence_state"), "decisions": review.active_decisions(decisions, cutoff).select("submission_id", "target_id", "decision_id")}
    for name, rows in others.items():
        parts[name] = rows.where(F.coalesce(F.col("at") <= cutoff, F.lit(True))) if "at" in rows.columns else rows
    out = runs.select("submission_id")
    for name, rows in parts.items():
        own = [c for c in rows.columns if c != "submission_id"]
        out = out.join(rows.groupBy("submission_id").agg(F.sort_array(F.collect_list(F.struct(*own))).alias(name)), "submission_id", "left")
    columns = {name: F.coalesce(name, F.array().cast(out.schema[name].dataType)) for name in parts} | {"submission_id": F.col("submission_id")}
    return out.select("submission_id", F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)])).alias("document"))


def entity_periods(submissions: DataFrame, sources: DataFrame) -> DataFrame:
    """D27 per entity: submissions, the latest, cases and files that came."""
    files = sources.where("actual_rows IS NOT NULL").groupBy("entity_id").agg(F.count("*").alias("files"))
    own = submissions.groupBy("entity_id").agg(F.count("*").alias("submissions"), F.max_by("submission_id", "period_end").alias("latest"), F.sum("n_cases").alias("cases"))
    return own.join(files, "entity_id", "left").na.fill(0, ["files"])


def with_review_counts(overview: DataFrame, items: DataFrame, decisions: DataFrame, requests: DataFrame) -> DataFrame:
    """An overview with its submission's review items, decisions and open requests."""
    for name, rows in (("items", items), ("decisions", decisions), ("open_requests", requests.where("status = 'open'"))):
        overview = overview.join(rows.groupBy("submission_id").agg(F.count("*").alias(name)), "submission_id", "left").na.fill(0, [name])
    return overview


def evidence_lists(t, findings: DataFrame) -> DataFrame:
    """R7 per finding of a case: the assets that its alerts name, and references to the
    case, its actions and its escalations. A finding's lists are as long as its case's records."""
    cases = findings.where("object_type = 'case'").select("rule_id", F.col("object_id").alias("case_id"))
    links = t.links.join(cases, "case_id", "left_semi")  # before they meet all alerts
    named = written(links.join(t.alerts.select("alert_id", "asset_id"), "alert_id").where("asset_id IS NOT NULL").groupBy("case_id").agg(F.array_sort(F.collect_set("asset_id")).alias("assets")), "named-assets")
    refs = [t.actions.select("case_id", F.concat(F.lit("action:"), F.col("action_id")).alias("ref")), t.escalations.select("case_id", F.concat(F.lit("escalation:"), F.col("escalation_id")).alias("ref")), cases.select("case_id", F.concat(F.lit("case:"), F.col("case_id")).alias("ref")).distinct()]
    asked = [written(r.join(cases, "case_id", "left_semi"), "references") for r in refs[:2]]
    every = asked[0].unionByName(asked[1]).unionByName(refs[2])
    support = every.groupBy("case_id").agg(F.array_sort(F.collect_set("ref")).alias("refs"))
    none = F.array().cast("array<string>")
    return cases.join(named, "case_id", "left").join(support, "case_id", "left").select("rule_id", "case_id", F.coalesce("assets", none).alias("assets"), F.coalesce("refs", none).alias("refs"))


def covered_assets(assets: DataFrame, alerts: DataFrame) -> DataFrame:
    """Assets that are covered: their agent is healthy, or an alert came from them."""
    healthy = assets.where(F.upper("agent_status") == "HEALTHY").select("asset_id")
    return healthy.union(assets.select("asset_id").join(alerts.select("asset_id"), "asset_id", "left_semi")).distinct()


def adverse_share(findings: DataFrame) -> DataFrame:
    """Adverse findings of all, per rule."""
    return findings.groupBy("rule_id").agg(F.round(F.count_if(adverse()) / F.count("*"), 6).alias("share"))


def _replaced(rows: DataFrame, path: str, *keys: str) -> None:
    """Writes rows by their keys; what a key held before is replaced, other keys stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_submissions(path: str, submissions: DataFrame, **tables: DataFrame) -> int:
    """Raw, normalized and issue rows (each with entity_id and submission_id), a table
    each below path; what the tables held of submissions is replaced in one commit, also
    where nothing comes in its place. `versions.read` gives a table's rows."""
    return versions.replace(submissions.sparkSession, path, submissions, **tables)


def write_run(path: str, run_id: str, **tables: DataFrame) -> None:
    """A run's own row, its findings and its matches, a table each below path; a run
    that is written again replaces itself."""
    for name, rows in tables.items():
        _replaced(rows.withColumn("run_id", F.lit(run_id)), f"{path}/{name}", "run_id")
