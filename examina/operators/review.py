"""Review portfolios: candidates, objective, budgeted choice, lineage of decisions
(P1-P10, D23-D25, E6, E7, E9, C14-C16, D26)."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..adapters import Tables
from ..shared import written

# Hypothesis, value and minutes of a candidate.
HYPOTHESES = {"POL-INV-001": "hyp:investigation_quality", "POL-ESC-002": "hyp:escalation_timeliness", "POL-COV-003": "hyp:monitoring_coverage", "POL-KPI-004": "hyp:claim_reconciliation", "POL-REC-005": "hyp:recurrence_loop"}
VALUES = {"critical": 3.0, "high": 2.0, "medium": 1.0, "low": 0.5}
MINUTES = {"critical": 15.0, "high": 12.0, "medium": 10.0, "low": 6.0}
# Weights of hypotheses covered, groups met and value in the objective.
ALPHA, BETA, GAMMA = 2.0, 1.0, 0.5
STRATA = ("targeted", "control", "exploratory")
UNITS = ("submission_id", "unit_id", "stratum", "asset", "category", "hypothesis", "weight", "minutes", "value")


def mapped(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def unit(rows: DataFrame, kind: str, key: str, stratum: str, asset: Column, category: Column, hypothesis: Column, weight: float, minutes: Column, value: Column) -> DataFrame:
    """Candidates with the columns of UNITS; a candidate covers one hypothesis with its weight."""
    return rows.select("submission_id", F.concat(F.lit(f"{kind}|"), F.col(key)).alias("unit_id"), F.lit(stratum).alias("stratum"), asset.alias("asset"), category.alias("category"), hypothesis.alias("hypothesis"), F.lit(weight).alias("weight"), minutes.cast("double").alias("minutes"), value.cast("double").alias("value"))


def targeted(findings: DataFrame, case_assets: DataFrame) -> DataFrame:
    """A candidate for each finding. Its asset is the finding's own, or the first asset
    that the case's alerts name (case_id, asset_id), else unassigned."""
    first = case_assets.groupBy(F.col("case_id").alias("object_id")).agg(F.min("asset_id").alias("first"))
    f = findings.withColumn("key", F.concat_ws("|", "rule_id", "object_id")).join(first, "object_id", "left")
    asset = F.when(F.col("object_type") == "asset", F.col("object_id")).otherwise(F.coalesce(F.when((F.col("object_type") == "case") & (F.col("rule_id") == "POL-INV-001"), F.col("first")), F.lit("unassigned")))
    return unit(f, "finding", "key", "targeted", asset, F.col("rule_id"), mapped(HYPOTHESES, F.col("rule_id")), 1.0, mapped(MINUTES, F.col("severity")), mapped(VALUES, F.col("severity")))


def broken_assets(assets: DataFrame) -> DataFrame:
    """Assets (with submission_id) that no finding flags and whose agent is broken."""
    value = F.when(F.upper("criticality").isin("CRITICAL", "HIGH"), 2.0).otherwise(1.0)
    return unit(assets, "coverage", "asset_id", "targeted", F.col("asset_id"), F.lit("absence_of_coverage"), F.lit("hyp:absence_of_coverage"), 1.0, F.lit(12), value)


def omitted_sources(sources: DataFrame) -> DataFrame:
    """Optional sources that were declared with no rows."""
    return unit(sources.where("is_optional AND declared_rows = 0"), "source", "source_id", "targeted", F.lit("telemetry-pipeline"), F.lit("source_omission"), F.lit("hyp:optional_source_omission"), 1.0, F.lit(8), F.lit(0.8))


def flagged(findings: DataFrame, kind: str) -> DataFrame:
    return findings.where(F.col("object_type") == kind).select(F.col("object_id").alias(f"{kind}_id")).distinct()


def controls(cases: DataFrame, assets: DataFrame, findings: DataFrame) -> DataFrame:
    """Cases, and healthy assets (with submission_id), that no finding flags."""
    free = cases.join(flagged(findings, "case"), "case_id", "left_anti")
    quiet = assets.where(F.upper("agent_status") == "HEALTHY").join(flagged(findings, "asset"), "asset_id", "left_anti")
    baseline = F.lit("baseline_control")
    return (unit(free, "control-case", "case_id", "control", F.coalesce("assigned_analyst", F.lit("analyst")), baseline, F.lit("hyp:baseline_compliance"), 0.5, F.lit(7), F.lit(0.5))
            .unionByName(unit(quiet, "control-asset", "asset_id", "control", F.col("asset_id"), baseline, F.lit("hyp:baseline_healthy_silence"), 0.5, F.lit(6), F.lit(0.4))))


def excluded(cases: DataFrame, assets: DataFrame, findings: DataFrame) -> DataFrame:
    """What may be no control, with the reason: record_type, id, reason."""
    a = cases.join(flagged(findings, "case"), "case_id", "left_semi").select("submission_id", F.lit("cases").alias("record_type"), F.col("case_id").alias("id"), F.lit("flagged_by_machine_finding").alias("reason"))
    return a.unionByName(assets.join(flagged(findings, "asset"), "asset_id", "left_semi").select("submission_id", F.lit("assets").alias("record_type"), F.col("asset_id").alias("id"), F.lit("flagged_by_coverage_or_asset_finding").alias("reason")))


def exploratory(cases: DataFrame, claims: DataFrame, findings: DataFrame, most: int = 2) -> DataFrame:
    """P5: claims, and those of a submission's first cases that no finding flags."""
    first = cases.withColumn("n", F.row_number().over(W.partitionBy("submission_id").orderBy("case_id"))).where(F.col("n") <= most).join(flagged(findings, "case"), "case_id", "left_anti")
    category = F.lit("exploratory")
    return (unit(claims, "claim", "claim_id", "exploratory", F.lit("kpi-reporting"), category, F.lit("hyp:exploratory_metric"), 1.0, F.lit(10), F.lit(0.6))
            .unionByName(unit(first, "edge-case", "case_id", "exploratory", F.lit("edge-cases"), category, F.lit("hyp:exploratory_edge_case"), 0.8, F.lit(8), F.lit(0.5))))


def population(t: Tables, findings: DataFrame) -> DataFrame:
    """G1: all candidates of all submissions. Assets stand with their entity's latest submission."""
    from .reports import unhealthy_assets
    from .rules import latest_submission, valid

    cases, assets = valid(t.cases), t.assets.join(latest_submission(t).select("entity_id", "submission_id"), "entity_id")
    # links of the cases whose finding names an asset, before they meet all alerts; written, so that shuffle ends here
    asked = findings.where((F.col("object_type") == "case") & (F.col("rule_id") == "POL-INV-001")).select(F.col("object_id").alias("case_id"))
    links = t.links.join(asked, "case_id", "left_semi")
    named = written(links.join(t.alerts.select("alert_id", "asset_id"), "alert_id").where("asset_id IS NOT NULL").groupBy("case_id").agg(F.min("asset_id").alias("asset_id")), "first-assets")
    gone = assets.join(unhealthy_assets(t.assets, findings).select("asset_id"), "asset_id", "left_semi")
    healthy = assets.join(gone.select("asset_id"), "asset_id", "left_anti")
    return (targeted(findings, named).unionByName(broken_assets(gone)).unionByName(omitted_sources(t.sources))
            .unionByName(controls(cases, healthy, findings)).unionByName(exploratory(cases, t.claims, findings)))


def quotas(max_items: Column) -> Column:
    """70/20/10 by stratum, halves to even, at least one control and one exploratory;
    three items or fewer are all targeted."""
    one = F.lit(1)
    c, e = (F.greatest(one, F.bround(max_items * x).cast("int")) for x in (0.2, 0.1))
    few = F.struct(max_items.cast("int").alias("targeted"), F.lit(0).alias("control"), F.lit(0).alias("exploratory"))
    return F.when(max_items <= 3, few).otherwise(F.struct((max_items - c - e).cast("int").alias("targeted"), c.alias("control"), e.alias("exploratory")))


def seeded_order(unit_id: Column, seed: int) -> Column:
    """An order that only the seed and the id decide."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), unit_id), 256)


def set_value(chosen: DataFrame, key: str = "submission_id") -> DataFrame:
    """Hypotheses covered (each at most once), groups met (assets, categories and the
    period), and value of chosen units, weighed by ALPHA, BETA and GAMMA."""
    cov = chosen.groupBy(key, "hypothesis").agg(F.least(F.lit(1.0), F.sum("weight")).alias("w")).groupBy(key).agg(F.sum("w").alias("alpha"))
    groups = chosen.select(key, F.explode(F.array(F.concat(F.lit("asset:"), "asset"), F.concat(F.lit("category:"), "category"), F.lit("period"))).alias("g")).groupBy(key).agg(F.count_distinct("g").cast("double").alias("beta"))
    return cov.join(groups, key).join(chosen.groupBy(key).agg(F.sum("value").alias("gamma")), key).withColumn("score", F.col("alpha") * ALPHA + F.col("beta") * BETA + F.col("gamma") * GAMMA)


def coverage_breakdown(chosen: DataFrame, every: DataFrame, key: str = "submission_id") -> DataFrame:
    """D25 per hypothesis that any of a submission's candidates (every) has: covered,
    partial or uncovered by the chosen ones."""
    got = chosen.groupBy(key, "hypothesis").agg(F.sum("weight").alias("w"))
    rows = every.select(key, "hypothesis").distinct().join(got, [key, "hypothesis"], "left")
    return rows.select(key, "hypothesis", F.when(F.col("w") >= 1, "covered").when(F.col("w") > 0, "partial").otherwise("uncovered").alias("state"))


@dataclass(frozen=True)
class Budget:
    """Positive items and minutes (none: any), caps per group, quotas within items."""

    items: int = 20
    minutes: float | None = None
    per_asset: int = 3
    per_category: int = 4
    allocation: tuple[int, int, int] | None = None

    def __post_init__(self) -> None:
        if self.items <= 0 or (self.minutes is not None and self.minutes <= 0):
            raise ValueError("items and minutes must be positive")
        if self.allocation is not None and (min(self.allocation) < 0 or sum(self.allocation) > self.items):
            raise ValueError("quotas must not be negative nor exceed the items")

    @property
    def quota(self) -> dict[str, int]:
        if self.allocation is not None:
            return dict(zip(STRATA, self.allocation))
        if self.items <= 3:
            return dict(zip(STRATA, (self.items, 0, 0)))
        c, e = max(1, round(self.items * 0.2)), max(1, round(self.items * 0.1))
        return dict(zip(STRATA, (self.items - c - e, c, e)))


def pruned(units: DataFrame, budget: Budget, seed: int) -> DataFrame:
    """Rows that the choice can take at all, with their `place` in their stratum's order
    (ids for targeted ones, the seeded order for others).

    Of units of a submission alike but for id and asset, the first per_asset of each
    asset, and of those the first 2 items assets. An earlier unit of a class is passed
    over only for what is passed over for a later one too, or for its asset's cap, which
    at most items / per_asset assets reach; so nothing that could be chosen goes, and what
    is left of a submission is bounded by its classes.
    """
    place = F.when(F.col("stratum") == "targeted", F.col("unit_id")).otherwise(seeded_order(F.col("unit_id"), seed))
    alike = ["submission_id", "stratum", "category", "minutes", "value", "hypothesis", "weight"]
    u = units.withColumn("place", place).withColumn("in_asset", F.row_number().over(W.partitionBy(*alike, "asset").orderBy("place", "unit_id"))).where(F.col("in_asset") <= budget.per_asset)
    lead = u.where("in_asset = 1").withColumn("n", F.row_number().over(W.partitionBy(*alike).orderBy("place", "unit_id"))).where(F.col("n") <= 2 * budget.items)
    return u.join(lead.select(*alike, "asset"), [*alike, "asset"], "left_semi").drop("in_asset")


def choose(units: pd.DataFrame, budget: Budget) -> pd.DataFrame:
    """P8 for one submission, in three phases: targeted units by gain a minute, ties by
    value then id; then controls and exploratory ones by place. Each phase ends at its
    quota; a unit that exceeds the minutes or a cap is passed over."""
    hyp: dict[str, float] = {}
    groups: set[tuple[str, str]] = set()
    assets: dict[str, int] = {}
    kinds: dict[str, int] = {}
    spent, out = 0.0, []

    def gain(r) -> float:
        have = hyp.get(r.hypothesis, 0.0)
        fresh = (("asset", r.asset) not in groups) + (("category", r.category) not in groups) + (not out)
        return ALPHA * (min(1.0, have + r.weight) - min(1.0, have)) + BETA * fresh + GAMMA * r.value

    def fits(r) -> bool:
        return (budget.minutes is None or spent + r.minutes <= budget.minutes) and assets.get(r.asset, 0) < budget.per_asset and kinds.get(r.category, 0) < budget.per_category

    def take(r) -> None:
        nonlocal spent
        g = gain(r)
        hyp[r.hypothesis] = hyp.get(r.hypothesis, 0.0) + r.weight
        groups.update((("asset", r.asset), ("category", r.category)))
        assets[r.asset], kinds[r.category] = assets.get(r.asset, 0) + 1, kinds.get(r.category, 0) + 1
        spent += r.minutes
        out.append((r.submission_id, len(out) + 1, r.unit_id, r.stratum, r.hypothesis, r.minutes, round(g, 6), round(g / r.minutes, 9)))

    left = {s: sorted((r for r in units.itertuples() if r.stratum == s), key=lambda r: (r.place, r.unit_id)) for s in STRATA}
    for stratum in STRATA:
        quota = budget.quota[stratum]
        pool, start = left[stratum], len(out)
        while pool and len(out) - start < quota:
            pool = [r for r in pool if fits(r)]  # what no longer fits never will
            if not pool:
                break
            best = min(pool, key=lambda r: (-round(gain(r) / r.minutes, 9), -r.value, r.unit_id)) if stratum == "targeted" else pool[0]
            pool.remove(best)
            take(best)
    return pd.DataFrame(out, columns=["submission_id", "rank", "unit_id", "stratum", "hypothesis", "minutes", "gain", "efficiency"])


def portfolio(units: DataFrame, budget: Budget = Budget(), seed: int = 42) -> DataFrame:
    """Every submission's portfolio, all at once; what meets in one call is the
    bounded remainder of `pruned`."""
    return pruned(units, budget, seed).groupBy("submission_id").applyInPandas(lambda u: choose(u, budget), "submission_id string, rank int, unit_id string, stratum string, hypothesis string, minutes double, gain double, efficiency double")


def active_decisions(decisions: DataFrame, cutoff: Column) -> DataFrame:
    """The last decision on each target up to a cutoff."""
    w = W.partitionBy("target_id").orderBy(F.desc("decided_at"), F.desc("decision_id"))
    return decisions.where(F.col("decided_at") <= cutoff).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def decision_versions(decisions: DataFrame) -> DataFrame:
    """Every decision's version on its target from 1, and the one before it."""
    w = W.partitionBy("target_id").orderBy("decided_at", "decision_id")
    return decisions.select("target_id", "decision_id", F.row_number().over(w).alias("version"), F.lag("decision_id").over(w).alias("before"))


def lineage_conflicts(decisions: DataFrame) -> DataFrame:
    """Decisions that replace one that another replaces too, or one on another target."""
    d = decisions.where("supersedes IS NOT NULL").withColumn("rivals", F.count("*").over(W.partitionBy("supersedes")))
    parent = decisions.select(F.col("decision_id").alias("supersedes"), F.col("target_id").alias("parent_target"))
    j = d.join(parent, "supersedes", "left")
    issue = F.when(F.col("rivals") > 1, "REPLACED_TWICE").when(F.coalesce(F.col("parent_target") != F.col("target_id"), F.lit(True)), "OTHER_TARGET")
    return j.withColumn("issue", issue).where("issue IS NOT NULL").select("decision_id", "issue")


def prior_runs(runs: DataFrame, most: int = 3) -> DataFrame:
    """Of every run the latest earlier ones of its entity (entity_id, run_id, at)."""
    w = W.partitionBy("entity_id").orderBy("at")
    before = runs.select("run_id", F.array(*[F.lag("run_id", k).over(w) for k in range(1, most + 1)]).alias("before"))
    return before.select("run_id", F.posexplode(F.filter("before", lambda r: r.isNotNull())).alias("n", "prior"))


def resolved_citations(findings: DataFrame, records: DataFrame) -> DataFrame:
    """Every cited reference (finding_id, entity_id, refs) with the first reason
    why it doesn't hold, null if it does. records: record_id, entity_id, digest."""
    cited = findings.select("finding_id", "entity_id", F.explode("refs").alias("ref")).select("finding_id", "entity_id", "ref.*")
    j = cited.join(records.select("record_id", F.col("entity_id").alias("owner"), F.col("digest").alias("actual")), "record_id", "left")
    return j.select("finding_id", "record_id", F.when(F.col("owner").isNull(), "RECORD_ABSENT").when(F.col("owner") != F.col("entity_id"), "FOREIGN_RECORD").when(F.col("digest") != F.col("actual"), "DIGEST_MISMATCH").alias("reason"))


def expected_against(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Full outer match on rule and object: matched, wrong_state, missing, unexpected."""
    j = expected.join(observed, ["rule_id", "object_id"], "full_outer")
    return j.select("rule_id", "object_id", F.when(F.col("evidence_state").isNull(), "missing").when(F.col("acceptable").isNull(), "unexpected").when(F.array_contains("acceptable", F.col("evidence_state")), "matched").otherwise("wrong_state").alias("outcome"))


def accuracy(worlds: DataFrame) -> DataFrame:
    """Specificity over controls and sensitivity over the others (is_control, passed); null without any."""
    return worlds.agg(F.try_divide(F.count_if(F.col("is_control") & F.col("passed")), F.count_if("is_control")).alias("specificity"), F.try_divide(F.count_if(~F.col("is_control") & F.col("passed")), F.count_if(~F.col("is_control"))).alias("sensitivity"))
