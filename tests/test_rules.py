"""Hand-written rows for evidence states and their boundaries."""

from __future__ import annotations

import datetime as dt
import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from examina import policy
from examina.functions import clean
from examina.operators import chains, exceptions, integrity, intake, peers, patterns, reports, review, rules, scorecard, text, trends

T0 = dt.datetime(2026, 1, 10)


class Some:
    """Stands for Tables with tables given by hand."""

    def __init__(self, **tables):
        self.__dict__.update(tables)


def cases(spark, *rows):
    base = {"case_id": "1", "entity_id": "E", "submission_id": "S", "created_at": T0, "severity": "CRITICAL", "status": "CLOSED", "closed_at": None, "root_cause": None, "disposition": "done", "notes": None, "resolution": None, "closing_notes": None, "investigation_notes": None, "asset_id": "a", "is_quarantined": False}
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], "case_id string, entity_id string, submission_id string, created_at timestamp, severity string, status string, closed_at timestamp, root_cause string, disposition string, notes string, resolution string, closing_notes string, investigation_notes string, asset_id string, is_quarantined boolean")


def sources(spark, *broken, rows=None):
    rows = rows or [("E", "S", t, f"S/{t}", "full_population", "all", 1, None if t in broken else 1, False, None, None) for t in ("cases", "investigation_actions", "escalations")]
    return spark.createDataFrame(rows, "entity_id string, submission_id string, record_type string, source_id string, sampling_method string, export_scope string, declared_rows bigint, actual_rows bigint, is_optional boolean, period_start timestamp, period_end timestamp")


RECORDS = "submission_id string, record_type string, source_id string, native_id string, is_quarantined boolean"
ISSUES = "submission_id string, source_id string, severity string, issue_type string"
START, END = dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1)


def tables(spark, case_rows, actions=(), escalations=(), excuses=(), broken=()):
    return Some(
        cases=cases(spark, *case_rows), sources=sources(spark, *broken),
        records=spark.createDataFrame([("S", t, f"S/{t}", "1", False) for t in ("cases", "investigation_actions", "escalations")], RECORDS), issues=spark.createDataFrame([], ISSUES),
        submissions=spark.createDataFrame([("E", "S", START, END, 1)], "entity_id string, submission_id string, period_start timestamp, period_end timestamp, n_cases bigint"),
        actions=spark.createDataFrame(list(actions), "case_id string, action_id string, action_type string, artifact_hash string, ts timestamp"),
        escalations=spark.createDataFrame(list(escalations), "case_id string, escalation_id string, ts timestamp"),
        exceptions=spark.createDataFrame([(i, *r, "agreed", None, None, None) for i, r in enumerate(excuses)], "row_id bigint, exception_id string, entity_id string, policy_reference string, affected_scope string, status string, approved_by string, valid_from timestamp, valid_to timestamp, reason string, target_type string, target_id string, expiry_date timestamp"))


def states(df):
    return {r.object_id: r.evidence_state for r in df.collect()}


def test_closure(spark):
    full = [("1", "x", "forensic_triage (lead)", "sha", T0), ("1", "y", "HOST_ISOLATION", "sha", T0)]
    assert states(rules.closure(tables(spark, [{}], full))) == {}
    assert states(rules.closure(tables(spark, [{}], full[:1]))) == {"1": "potential_concern"}
    assert states(rules.closure(tables(spark, [{}], [(*r[:3], "n/a", r[4]) for r in full]))) == {"1": "potential_concern"}
    assert states(rules.closure(tables(spark, [{}], full[:1], broken=("investigation_actions",)))) == {"1": "insufficient_evidence"}
    assert states(rules.closure(tables(spark, [{"severity": "LOW", "disposition": " pending "}]))) == {"1": "potential_concern"}
    assert states(rules.closure(tables(spark, [{"severity": "LOW", "disposition": None, "root_cause": "mail"}, {"case_id": "2", "status": "OPEN"}]))) == {}
    assert states(rules.closure(tables(spark, [{"severity": "LOW", "disposition": None, "closing_notes": "rebuilt"}]))) == {}
    assert states(rules.closure(tables(spark, [{"severity": "LOW", "disposition": None, "status": None, "closed_at": T0}]))) == {"1": "potential_concern"}
    assert states(rules.closure(tables(spark, [{"is_quarantined": True}]))) == {"S": "insufficient_evidence"}  # no case that counts


def test_first_reason_against_a_source(spark):
    """Ten checks in their order; each row has its own fault and all later ones."""
    def status(rows, records, issues=()):
        t = tables(spark, [{}])
        t.sources, t.records, t.issues = sources(spark, rows=rows), spark.createDataFrame(records, RECORDS), spark.createDataFrame(list(issues), ISSUES)
        return {r.record_type: r.reason for r in rules.source_status(t).collect()}

    def row(source="s", kind="cases", method="full_population", scope="all", declared=2, actual=2, start=START, end=END):
        return ("E", "S", kind, source, method, scope, declared, actual, False, start, end)

    late = dt.datetime(2026, 1, 2)
    twice = [("S", "cases", "s", "1", True), ("S", "cases", "s", "1", False)]
    same = [("S", "cases", "s", "1", False)] * 2
    good = [("S", "cases", "s", k, False) for k in "12"]
    error, late_issue, fine = ("S", "s", "error", "X"), ("S", "s", "warning", "TIMESTAMP_OUT_OF_PERIOD"), ("S", "s", "warning", "X")
    worst = {"method": "sample", "scope": "Partial", "declared": 3, "start": late}
    assert status([row(actual=None, **worst)], twice, [error])["cases"] == "not_submitted"
    assert status([row(**worst)], twice, [error])["cases"] == "sampled"
    assert status([row(**{**worst, "method": "full_population"})], twice, [error])["cases"] == "partial_scope"
    assert status([row(declared=3, start=late)], twice, [error])["cases"] == "count_mismatch"
    assert status([row(declared=3, actual=3, start=late)], twice, [error])["cases"] == "count_mismatch"  # fewer rows were kept
    assert status([row(start=late)], twice, [error])["cases"] == "quarantined_records"
    assert status([row(start=late)], same, [error])["cases"] == "duplicate_ids"
    assert status([row(start=late)], good, [error])["cases"] == status([row()], good, [late_issue])["cases"] == "blocking_issue"
    assert status([row(start=late)], good, [fine])["cases"] == "period_not_covered"
    other = [("S", "cases", "t", k, False) for k in "23"]
    assert status([row(), row("t", start=None, end=None)], good + other)["cases"] == "overlapping_ids"
    got = status([row(), row("t")], good + [("S", "cases", "t", k, False) for k in "34"])
    assert got["cases"] is None and got["assets"] == "not_declared"
    assert status([row(), row("a", actual=None)], good)["cases"] == "not_submitted"  # one of two is enough
    acted = [("S", "actions", "s", k, False) for k in "12"]
    got = status([row(kind="investigation_actions")], acted)  # a type's other name, in records or sources
    assert got["investigation_actions"] is None and status([row(kind="claims")], [("S", "reported_claims", "s", k, False) for k in "12"])["reported_claims"] is None


@pytest.mark.parametrize("scope, at, found", [("case:1", 0, False), ("case:*", 0, False), ("case:2", 0, True), ("asset:*", 0, True), ("case:1", -1, True), ("case:1", 1, False), ("case:1", 2, True)])
def test_exception_window_is_closed(spark, scope, at, found):
    """at: days of the case after the exception's start; it lasts one day."""
    ex = [("x", "E", "*", scope, "Approved", "boss", T0 - dt.timedelta(days=at), T0 - dt.timedelta(days=at - 1))]
    assert bool(states(rules.closure(tables(spark, [{}], excuses=ex)))) == found


def test_unsigned_or_revoked_exceptions_do_not_count(spark):
    ex = [("a", "E", "*", "case:*", "revoked", "boss", T0, T0), ("b", "E", "*", "case:*", "active", None, T0, T0), ("c", "E", "*", "case", "active", "boss", T0, T0), ("d", "F", "*", "case:*", "active", "boss", T0, T0)]
    t = tables(spark, [{}], excuses=ex)
    assert [r.exception_id for r in exceptions.accepted(t.exceptions).collect()] == ["d"] and states(rules.closure(t))


def test_exceptions_need_a_reason_and_count_once(spark):
    base = {"row_id": 1, "exception_id": "x", "entity_id": "E", "policy_reference": "P", "affected_scope": "case:7:8", "status": "ACTIVE", "approved_by": "boss", "valid_from": T0, "valid_to": None, "reason": "why", "target_type": None, "target_id": None, "expiry_date": T0}
    rows = [{"reason": " "}, {"row_id": 2, "reason": None}, {"row_id": 3, "approved_by": " "}, {"row_id": 4, "expiry_date": None}, {"row_id": 5}, {"row_id": 6, "policy_reference": "Q"}, {"row_id": 7, "exception_id": "y", "affected_scope": "all", "target_type": "asset", "target_id": "9"}, {"row_id": 8, "exception_id": "z", "affected_scope": "all"}]
    df = spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], tables(spark, [{}]).exceptions.select(*base).schema)
    got = {r.exception_id: (r.policy_reference, r.target_type, r.target_id, r.valid_to) for r in exceptions.accepted(df).collect()}
    assert got == {"x": ("P", "case", "7:8", T0), "y": ("P", "asset", "9", T0)}


def test_escalation(spark):
    due = T0 + dt.timedelta(seconds=policy.ESCALATION_SECONDS["CRITICAL"])
    open_ = {"status": "OPEN"}
    assert states(rules.escalation(tables(spark, [open_]))) == {"1": "potential_concern"}
    assert states(rules.escalation(tables(spark, [open_], broken=("escalations",)))) == {"1": "insufficient_evidence"}
    assert states(rules.escalation(tables(spark, [{**open_, "notes": "Phoned ON-CALL lead"}]))) == {"1": "insufficient_evidence"}
    assert states(rules.escalation(tables(spark, [open_], escalations=[("1", "e", due)]))) == {}
    assert states(rules.escalation(tables(spark, [open_], escalations=[("1", "e", due + dt.timedelta(seconds=1))]))) == {"1": "potential_concern"}
    assert states(rules.escalation(tables(spark, [open_], actions=[("1", "x", "Escalate to L3", None, due)]))) == {}
    assert states(rules.escalation(tables(spark, [{"closed_at": due}]))) == {}
    end = dt.datetime(2026, 2, 1) - dt.timedelta(seconds=1800)
    assert states(rules.escalation(tables(spark, [{**open_, "created_at": end}]))) == {"1": "potential_concern"}  # due at the cutoff
    assert states(rules.escalation(tables(spark, [{**open_, "created_at": end + dt.timedelta(seconds=1)}]))) == {}  # not yet due
    assert states(rules.escalation(tables(spark, [{**open_, "severity": "LOW"}]))) == {}


@pytest.mark.parametrize("n, yes, unknown, claimed, state", [(0, 0, 0, 50, "insufficient_evidence"), (10, 5, 0, 50, "supported"), (10, 5, 0, 50.01, "contradictory"), (10, 5, 2, 60, "insufficient_evidence"), (10, 5, 2, 70.01, "contradictory"), (3, 2, 0, 66.67, "supported"), (10, 5, 2, 70, "insufficient_evidence"), (10, 9, 0, 5, "supported")])
def test_interval(spark, n, yes, unknown, claimed, state):
    row = spark.createDataFrame([(n, yes, unknown, float(claimed))], "n int, y int, u int, c double")
    assert row.select(rules.interval(*(F.col(c) for c in "nyuc"))[2].alias("s")).first().s == state


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8])
def test_quartiles_equal_the_exclusive_method(spark, n):
    import statistics

    v = sorted(float(x * x % 17) for x in range(n))
    row = spark.createDataFrame([(v,)], "v array<double>")
    if n >= 4:
        got = row.select(*[peers.quartile(F.col("v"), k).alias(f"q{k}") for k in (1, 3)]).first()
        want = statistics.quantiles(v, n=4)
        assert (got.q1, got.q3) == (want[0], want[2])


@pytest.mark.parametrize("n, found", [(4, set()), (5, {"PAT-DURATION-ZERO-MAD"})])
def test_uniform_durations_need_five_cases(spark, n, found):
    rows = [{"case_id": str(i), "closed_at": T0 + dt.timedelta(minutes=30)} for i in range(n)]
    assert {r.pattern for r in patterns.durations(cases(spark, *rows)).collect()} == found


def test_rapid_closures_and_narratives(spark):
    rows = [{"case_id": str(i), "closed_at": T0 + dt.timedelta(seconds=120 + (i > 1)), "notes": "Closed  after ROUTINE review " if i < 3 else "short"} for i in range(12)]
    got = patterns.rapid(cases(spark, *rows)).first()
    assert (got.observed, got.severity) == (2, "ELEVATED")
    assert patterns.narratives(cases(spark, *rows)).first().observed == 3


def merkle(leaves):
    if len(leaves) == 1:
        return hashlib.sha256(b"\0" + leaves[0].encode()).digest()
    k = 1 << ((len(leaves) - 1).bit_length() - 1)
    return hashlib.sha256(b"\1" + merkle(leaves[:k]) + merkle(leaves[k:])).digest()


def test_merkle_trees_and_proofs(spark):
    rows = [(f"b{n:02}", i, f"leaf-{n}-{i}") for n in range(1, 20) for i in range(n)]
    of = integrity.leaves(spark.createDataFrame(rows, "b string, i int, t string"), "b", ["i"], "t")
    want = {f"b{n:02}": merkle([f"leaf-{n}-{i}" for i in range(n)]).hex() for n in range(1, 20)}
    assert {r.batch: r.root for r in integrity.roots(of).collect()} == want
    proofs = integrity.proofs(of).select("batch", integrity.proof_root(F.col("h"), F.col("proof")).alias("root")).collect()
    assert len(proofs) == len(rows) and all(r.root == want[r.batch] for r in proofs)


def test_chain_audit(spark):
    e = spark.createDataFrame([("E", f"e{i}", i, f"b{i}") for i in range(6)] + [("F", "x", 0, "b")], "entity_id string, event_id string, at int, body string")
    log = integrity.chain(e).join(e.select("event_id", "body"), "event_id")
    assert integrity.audit(log).count() == 0
    changed = integrity.audit(log.withColumn("body", F.when(F.col("event_id") == "e2", "no").otherwise(F.col("body")))).collect()
    assert [(r.seq, r.issue) for r in changed] == [(3, "PAYLOAD_MISMATCH")]
    assert {(r.seq, r.issue) for r in integrity.audit(log.where("event_id <> 'e3'")).collect()} == {(5, "SEQUENCE_GAP"), (5, "BROKEN_LINK"), (6, "SEQUENCE_GAP")}


def brute_portfolio(rows, budget, seed):
    """The three phases over the whole pool, written from their definition."""
    def f(units):
        cover, groups = {}, set()
        for u in units:
            cover[u["hypothesis"]] = cover.get(u["hypothesis"], 0.0) + u["weight"]
            groups |= {("a", u["asset"]), ("c", u["category"]), "period"}
        return 2.0 * sum(min(1.0, w) for w in cover.values()) + len(groups) + 0.5 * sum(u["value"] for u in units)

    def allowed(u, chosen):
        if budget.minutes is not None and sum(c["minutes"] for c in chosen) + u["minutes"] > budget.minutes:
            return False
        return sum(c["asset"] == u["asset"] for c in chosen) < budget.per_asset and sum(c["category"] == u["category"] for c in chosen) < budget.per_category

    chosen, gains = [], []
    for stratum in ("targeted", "control", "exploratory"):
        pool = [u for u in rows if u["stratum"] == stratum]
        pool.sort(key=lambda u: hashlib.sha256(f"{seed}:{u['unit_id']}".encode()).hexdigest())
        for _ in range(budget.quota[stratum]):
            fit = [u for u in pool if u not in chosen and allowed(u, chosen)]
            if not fit:
                break
            u = min(fit, key=lambda u: (-round((f(chosen + [u]) - f(chosen)) / u["minutes"], 9), -u["value"], u["unit_id"])) if stratum == "targeted" else fit[0]
            gains.append(round(f(chosen + [u]) - f(chosen), 6))
            chosen.append(u)
    return [(u["unit_id"], g) for u, g in zip(chosen, gains)]


@pytest.mark.parametrize("budget", [review.Budget(items=8, minutes=60.0, per_asset=1, per_category=3), review.Budget(items=5), review.Budget(items=2, minutes=25.0), review.Budget(items=10, per_asset=2, per_category=9, allocation=(2, 4, 3))])
def test_portfolios_equal_the_whole_choice(spark, budget):
    rng = random.Random(7)
    rows = []
    for s in range(8):
        for i in range(rng.randint(1, 90)):
            kind, minutes = rng.choice([("A", 10.0), ("B", 12.0), ("C", 8.0)])
            rows.append({"submission_id": f"s{s}", "unit_id": f"u{i:03}", "stratum": rng.choice(review.STRATA), "asset": f"{rng.randint(0, 12)}", "category": kind, "hypothesis": "h" + rng.choice("xyz"), "weight": rng.choice([0.5, 1.0]), "minutes": minutes, "value": rng.choice([0.5, 1.0, 2.0])})
    units = spark.createDataFrame([tuple(r.values()) for r in rows], "submission_id string, unit_id string, stratum string, asset string, category string, hypothesis string, weight double, minutes double, value double").select(*review.UNITS)
    got = review.portfolio(units, budget, seed=5)
    of = {}
    for r in got.orderBy("submission_id", "rank").collect():
        of.setdefault(r.submission_id, []).append((r.unit_id, r.gain))
    want = {s: brute_portfolio([r for r in rows if r["submission_id"] == s], budget, 5) for s in {r["submission_id"] for r in rows}}
    assert of == {s: w for s, w in want.items() if w}
    card = {r.submission_id: r for r in reports.portfolio_summary(got, budget).collect()}
    for s, w in of.items():
        n = [sum(1 for u, _ in w for r in rows if r["submission_id"] == s and r["unit_id"] == u and r["stratum"] == k) for k in review.STRATA]
        assert [card[s][k] for k in review.STRATA] == n and [card[s][f"{k}_short"] for k in review.STRATA] == [max(0, budget.quota[k] - m) for k, m in zip(review.STRATA, n)]


def test_quotas_and_budgets():
    assert [tuple(review.Budget(items=n).quota.values()) for n in (1, 3, 4, 5, 10, 15, 20, 25)] == [(1, 0, 0), (3, 0, 0), (2, 1, 1), (3, 1, 1), (7, 2, 1), (10, 3, 2), (14, 4, 2), (18, 5, 2)]
    for bad in ({"items": 0}, {"minutes": 0.0}, {"items": 3, "allocation": (2, 1, 1)}, {"allocation": (-1, 0, 0)}):
        with pytest.raises(ValueError):
            review.Budget(**bad)


def test_predicates(spark):
    rows = [("2026-01-05", True), ("2026-1-5", False), ("2026-01-05T10:00:00Z", True), ("2026-01-05 10:00:00.123+02:00", True), ("2026-02-30", False), ("soon", False), (None, False)]
    got = spark.createDataFrame(rows, "t string, ok boolean").select("ok", clean.iso_time(F.col("t")).isNotNull().alias("is")).collect()
    assert all(r.ok == r["is"] for r in got)
    p = clean.month_claim_period(F.col("p"), F.col("s").cast("timestamp"), F.col("e").cast("timestamp")).isNotNull()
    rows = [("2026-04", None, None, True), ("2026-13", None, None, False), ("2026-04", "2026-04-01", "2026-05-01", True), ("2026-04", "2026-04-01", "2026-04-30 23:59:59", True), ("2026-04", "2026-04-01", "2026-04-30 23:59:58", False), ("Q2", "2026-04-01", "2026-07-01", True), ("Q2", None, None, False), ("Q2", "2026-04-01", None, False), ("Q2", "2026-04-02", "2026-04-01", False)]
    assert all(r.ok == r["is"] for r in spark.createDataFrame(rows, "p string, s string, e string, ok boolean").select("ok", p.alias("is")).collect())


def test_identities(spark):
    rows = [("a", 1, "x", True), ("a", 2, "y", False), ("a", 3, "y", False), ("a", 4, "z", False), ("b", 1, "q", False)]
    got = intake.identities(spark.createDataFrame(rows, "k string, o int, c string, rejected boolean"), ["k"], ["o"], ["c"]).collect()
    assert {(r.k, r.o): r.identity for r in got} == {("a", 1): None, ("a", 2): "NEW", ("a", 3): "DUPLICATE_RECORD", ("a", 4): "CONFLICTING_IDENTITY", ("b", 1): "NEW"}


def test_gaps_and_labels(spark):
    rows = [("E", "a", 1.0, dt.datetime(2026, 1, 1), dt.datetime(2026, 4, 1)), ("E", "b", 2.0, dt.datetime(2026, 5, 6), dt.datetime(2026, 7, 1)), ("E", "c", 3.0, dt.datetime(2026, 10, 1), dt.datetime(2027, 1, 1))]
    got = trends.with_gaps(spark.createDataFrame(rows, "entity_id string, label string, trend_index double, period_start timestamp, period_end timestamp")).collect()
    assert [(r.label, r.gap_days) for r in got] == [("a", None), ("b", None), ("2026-Q3", 92), ("c", None)]


def test_lexical_pairs_in_parts_of_groups(spark, monkeypatch):
    """Clusters of near copies, cut into parts: a pair is compared once, and exactly."""
    rng = random.Random(5)
    docs = {}
    for c in range(4):
        base = [f"c{c}w{i}" for i in range(30)]
        for k in range(12):
            docs[len(docs)] = " ".join(w if rng.random() > k / 40 else f"x{rng.randint(0, 999)}" for w in base)
    df = spark.createDataFrame([*docs.items()], "doc_id bigint, text string")
    sets = {i: set(zip(x.split(), x.split()[1:])) for i, x in docs.items()}
    first = {}
    for i, s in sets.items():
        first.setdefault(frozenset(s), i)
    want = {(a, b): len(x & y) / len(x | y) for x, a in first.items() for y, b in first.items() if a < b and len(x & y) / len(x | y) >= 0.5}
    kept, sizes = text.compared, []

    def seen(near, of, least):
        sizes.append(near.count())
        return kept(near, of, least)

    monkeypatch.setattr(text, "compared", seen)
    for held in (100, text.HELD):
        monkeypatch.setattr(text, "HELD", held)
        got = [tuple(r) for r in text.lexical_pairs(df).collect()]
        assert len(got) == len(want) > 30 and {(a, b): score for a, b, score in got} == want
    met = sum(1 for a in sets for b in sets if a < b and sets[a] & sets[b])
    assert len(want) <= sizes[0] < met


def test_text(spark):
    t = spark.createDataFrame([("The well-known -x- café WON'T fail_over 9",)], "t string").select(text.tokens(F.col("t")).alias("w")).first().w
    assert t == ["the", "well-known", "x", "won", "t", "fail_over", "9"]
    rng = random.Random(2)
    docs = {i: " ".join(rng.choice(["log", "scan", "host", "mail", "user"]) + str(rng.randint(0, 3)) for _ in range(rng.randint(0, 14))) for i in range(60)}
    df = spark.createDataFrame([*docs.items(), (99, None)], "doc_id bigint, text string")
    def sh(x):
        w = x.split()
        return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else set(w)
    first = {}
    for i, x in docs.items():
        first.setdefault(frozenset(sh(x)), i)
    want = {(a, b) for sa, a in first.items() for sb, b in first.items() if a < b and sa and sb and len(sa & sb) / len(sa | sb) >= 0.3}
    assert {(r.a, r.b) for r in text.lexical_pairs(df, 0.3).collect()} == want
    words = " ".join(f"w{i}" for i in range(400))
    got = {r.chunk: r for r in text.chunks(spark.createDataFrame([(1, f" {words} "), (2, " "), (3, "one")], "doc_id bigint, text string")).where("doc_id = 1").collect()}
    assert sorted(got) == [0, 1, 2] and all(f" {words} "[r.start_char : r.end_char].split() == words.split()[170 * k : 170 * k + 195] for k, r in got.items())


def test_digests(spark):
    rng = np.random.default_rng(1)
    a = " ".join(map(str, rng.integers(0, 9999, 200)))
    rows = [(1, a), (2, a.replace("7", "8", 3)), (3, " ".join(map(str, rng.integers(0, 9999, 200)))), (4, "short"), (5, None), (6, "ab" * 100)]
    d = {r.doc_id: r.digest for r in text.digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert d[4] is None and d[5] is None and d[6] is None
    def far(x, y):
        return spark.createDataFrame([(d[x], d[y])], "a string, b string").select(text.digest_distance(F.col("a"), F.col("b")).alias("d")).first().d
    assert far(1, 1) == 0 and 0 < far(1, 2) < far(1, 3)


def test_composite(spark):
    def s(*row):
        return spark.createDataFrame([row], "e boolean, s double, l double, d int, n boolean").select(text.composite(*(F.col(c) for c in "esldn")).alias("v")).first().v
    assert s(True, 0.1, 0.1, None, True) == 1.0 and s(False, 0.5, 0.5, None, False) == 0.5 and s(False, 0.5, 0.5, 30, False) == 0.85 and s(False, 0.9, 0.9, 151, False) == 0.6 and s(False, 0.9, 0.9, 10, True) == 0.45


def test_scope(spark):
    rows = spark.createDataFrame([("E",), ("F",)], "entity_id string")
    assert [intake.in_scope(rows, g).count() for g in (None, [], ["E"], ["*"])] == [2, 0, 1, 2]


def test_completeness(spark):
    got = scorecard.completeness(sources(spark, "cases"), cases(spark, {}, {"is_quarantined": True})).first()
    assert (got.declared, got.received, got.quarantined, got.completeness_pct, got.verdict) == (3, 2, 1, 51.7, "INSUFFICIENT_EVIDENCE")


def test_orphans_need_the_parent_source(spark):
    e = spark.createDataFrame([], "case_id string, alert_id string")
    t = tables(spark, [{}], actions=[("9", "x", "NOTE", None, T0)])
    t.links, t.alerts, t.assets = e, spark.createDataFrame([], "alert_id string"), spark.createDataFrame([], "asset_id string")
    sent = spark.createDataFrame([("cases",)], "record_type string")
    assert [(r.child, r.ref) for r in chains.orphans(t, sent).collect()] == [("actions", "9")]
    assert chains.orphans(t, sent.limit(0)).count() == 0


def test_nearest_vectors_of_any_label(spark):
    """Against brute force over all rows, in blocks, with ties and a null vector."""
    x = np.random.default_rng(3).normal(size=(90, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[50] = x[41] = x[40]
    rows = [(i, [float(e) for e in v], i % 7) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (100, None, 1)], "vec_id bigint, embedding array<double>, label int")
    dots = np.round(x @ x.T, 6)
    want = {(q, int(o), r + 1) for q in range(0, 90, 20) for r, o in enumerate(sorted((o for o in range(90) if o != q and dots[q, o] >= 0.15), key=lambda o: (-dots[q, o], o))[:5])}
    for block in (4096, 3):
        got = text.nearest_vectors(df, block=block).collect()
        assert {(r.target, r.vec_id, r["rank"]) for r in got} == want and len(got) == len(want)
        assert all(abs(r.score - dots[r.target, r.vec_id]) < 1e-9 for r in got)
    assert any(q % 7 != o % 7 for q, o, _ in want)


def test_runs_replace_their_own_rows(spark, tmp_path):
    rows = spark.createDataFrame([("E", "S", 1), ("E", "S", 2), ("F", "T", 3)], "entity_id string, submission_id string, n int")
    path = f"file://{tmp_path}"
    for run in ("a", "b", "a"):
        reports.write_run(path, run, runs=rows.limit(1), findings=rows, matches=rows.where("n > 1"))
    assert [spark.read.parquet(f"{path}/{t}").count() for t in ("runs", "findings", "matches")] == [2, 6, 4]


def test_other_records(spark):
    rows = spark.createDataFrame([(1, "r1", "s", "x"), (2, "r1", "t", "y"), (3, "r3", "s", " x "), (4, "r4", "s", "z"), (5, "r5", "t", "x")], "doc_id bigint, record_id string, source_id string, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 5)], "a bigint, b bigint")
    assert {(r.a, r.b) for r in text.other_records(pairs, rows).collect()} == {(1, 4), (1, 5)}
