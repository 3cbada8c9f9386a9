"""Order statistics, interval joins, spans, pages, scopes, nodes and walks against brute force."""

from __future__ import annotations

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from examina.operators import chains, intervals, quantiles, reports, spans
from examina.sources import layout


def test_order_statistics_are_exact(spark):
    rng = random.Random(1)
    groups = {"ties": [rng.randint(0, 5) for _ in range(301)], "one": [7.5], "two": [2.0, -1.0], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(200)], "tiny": [5e-324, 0.0, 1e-323, 5e-324],
              "line": [rng.gauss(0, 1) for _ in range(1000)], "outlier": [1e308, -1e308, *[rng.random() for _ in range(500)]], None: [1.0, 2.0, 4.0]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("line", None), ("line", float("nan")), ("line", float("inf")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in quantiles.order_statistics(df, "g", "v", {"first": F.lit(1), "mid": F.floor((F.col("n") + 1) / 2), "last": F.col("n"), "below": F.lit(-3), "above": F.col("n") + 9}).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        v = sorted(map(float, vs))
        assert (got[g].n, got[g].first, got[g].mid, got[g].last, got[g].below, got[g].above) == (len(v), v[0], v[(len(v) + 1) // 2 - 1], v[-1], v[0], v[-1])
    med = {r.g: r.med for r in quantiles.medians(df, "g", "v").collect()}
    assert all(med[g] == pytest.approx(statistics.median(map(float, vs))) for g, vs in groups.items())
    q = {r.g: r for r in quantiles.quartiles(df, "g", "v").collect()}
    assert q["one"].q25 is None and q["one"].median is None
    for g in ("ties", "line"):
        assert [q[g].q25, q[g].median, q[g].q75] == pytest.approx(statistics.quantiles(groups[g], n=4, method="exclusive"))
    assert quantiles.medians(df.limit(0), "g", "v").count() == 0


def test_moments_within_intervals(spark):
    rng = random.Random(2)
    t0 = dt.datetime(2020, 1, 1)
    def at():
        return t0 + dt.timedelta(seconds=rng.randint(-10**8, 10**8))
    moments = [(i, rng.choice("ab"), at()) for i in range(400)] + [(900, "a", None), (901, None, t0)]
    spells = []
    for _ in range(40):
        begin = at()
        spells.append((rng.choice("abc"), begin, begin + dt.timedelta(seconds=rng.choice([0, 5, 86400, 10**6, 10**7, 3 * 10**9, -5]))))
    spells += [("a", moments[0][2], moments[0][2]), ("a", None, t0), ("b", dt.datetime(1, 1, 2), dt.datetime(1, 1, 3))]
    m, s = spark.createDataFrame(moments, "id int, k string, at timestamp"), spark.createDataFrame(spells, "k string, f timestamp, u timestamp")
    got = {r.id for r in intervals.within(m, s, ["k"], "at", "f", "u").collect()}
    want = {i for i, k, a in moments if a and any(k == x and f and f <= a <= u for x, f, u in spells)}
    assert got == want and 0 < len(want) < 400
    assert intervals.within(m, s.limit(0), ["k"], "at", "f", "u").count() == 0
    plan = intervals.within(m, s, ["k"], "at", "f", "u")._jdf.queryExecution().executedPlan().toString()
    assert "__b#" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_spans_keep_the_texts_own_places(spark, monkeypatch):
    monkeypatch.setattr(spans, "TEXTS", 3)
    monkeypatch.setattr(spans, "QUERIES", 2)
    texts = [("s", 1, "İİ Alpha beta ALPHA"), ("s", 2, "aaaa"), ("s", 3, "ΣΑΣ σας ΣΑΣ"), ("t", 4, "alpha"), ("s", 5, None), ("s", 6, ""), (None, 7, "alpha"), ("s", 2, "aaaa"), ("s", 8, "x" * 50_000 + "beta")]
    queries = [("s", 10, "alpha"), ("s", 11, "AA"), ("s", 12, "aaa"), ("s", 13, "σασ"), ("s", 14, ""), ("s", 15, None), ("t", 16, "lph"), ("u", 17, "x"), ("s", 18, "alpha"), ("s", 19, "İ a"), ("s", 20, "beta"), (None, 21, "alpha")]
    q, t = spark.createDataFrame(queries, "scope string, query_id bigint, query string"), spark.createDataFrame(texts, "scope string, text_id bigint, text string")

    want = []
    for scope in "stu":
        for _, i, text in (x for x in texts if x[0] == scope and x[2]):
            for _, k, query in (x for x in queries if x[0] == scope and x[2]):
                text_, query_ = spans.folded(text), spans.folded(query)
                assert len(text_) == len(text)
                want += [(scope, i, k, p, p + len(query)) for p in range(len(text)) if text_.startswith(query_, p)]
    got = spans.search(q, t).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert ("s", 1, 10, 3, 8) in want and ("s", 1, 19, 1, 4) in want  # places in the text as it is
    own = sorted((r["rank"], r.end_char - r.start_char, r.start_char, r.query_id) for r in got if (r.scope, r.text_id) == ("s", 1))
    assert [r[0] for r in own] == list(range(1, len(own) + 1)) and [r[1:] for r in own] == sorted((r[1:] for r in own), key=lambda r: (-r[0], r[1], r[2]))
    assert spans.search(q.limit(0), t).count() == spans.search(q, t.limit(0)).count() == 0


def test_spans_of_a_query_apart_from_each_other(spark):
    q = spark.createDataFrame([("s", 10, "aa"), ("s", 11, "aba"), ("s", 12, "AA"), ("s", 13, "on on")], "scope string, query_id bigint, query string")
    t = spark.createDataFrame([("s", 1, "aaaaa"), ("s", 2, "abababa"), ("s", 3, "On on on on on")], "scope string, text_id bigint, text string")
    got = sorted(tuple(r) for r in spans.search(q, t, overlapping=False).collect())
    want = {1: [(0, 2, 10), (0, 2, 12), (2, 4, 10), (2, 4, 12)], 2: [(0, 3, 11), (4, 7, 11)], 3: [(0, 5, 13), (6, 11, 13)]}
    assert got == sorted(("s", i, k, a, b, n) for i, own in want.items() for n, (a, b, k) in enumerate(own, 1))
    assert spans.search(q, t).count() > len(got)


def test_single_span_with_letters_that_grow(spark):
    from examina.operators.text import find_spans

    pairs = spark.createDataFrame([("İİ Alpha", "alpha"), ("alpha", "none"), ("ΣΑΣ x", "σ")], "text string, query string")
    assert [(r.start_char, r.end_char) for r in find_spans(pairs).collect()] == [(3, 8), (0, 5), (0, 1)]


def test_pages_by_key_equal_pages_by_offset(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 9), f"k{i:03}") for i in range(95)]
    df = spark.createDataFrame(rows, "made int, id string")
    want, last, pages = sorted(rows, key=lambda r: (-r[0], r[1])), None, []
    while page := reports.page_after(df, {"made": True, "id": False}, 20, last).collect():
        pages += [tuple(r) for r in page]
        last = page[-1].asDict()
    assert pages == want
    plan = reports.page_after(df, {"made": True, "id": False}, 20, last)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_grants_prune_folders(spark, tmp_path):
    rows = spark.createDataFrame([(f"E{i % 7}", f"E{i % 7}-{i % 3}", i) for i in range(210)], "entity_id string, submission_id string, n int")
    layout.laid_out(rows, f"{tmp_path}/t")
    grants = [("u", "E1", None), ("u", "E2", "E2-0"), ("u", "E2", "E2-0"), ("u", "E9", None), ("all", "*", None), ("v", "E3", "E3-1")]
    spark.createDataFrame(grants, "user string, entity_id string, submission_id string").write.parquet(f"{tmp_path}/g")
    g = spark.read.parquet(f"{tmp_path}/g")
    def seen(user):
        return {r.n for r in layout.scoped(spark, f"{tmp_path}/t", g, user).collect()}
    assert seen("u") == {i for i in range(210) if i % 7 == 1 or (i % 7 == 2 and i % 3 == 0)}
    assert seen("v") == {i for i in range(210) if i % 7 == 3 and i % 3 == 1} and len(seen("all")) == 210 and seen("nobody") == set()
    plan = layout.scoped(spark, f"{tmp_path}/t", g, "u")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_walks(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 40)}") for _ in range(50)] + [("n1", "n1"), ("n1", "n2"), ("n1", "n2"), (None, "n3")] + [("hub", f"n{i}") for i in range(20)]
    near: dict = {}
    for a, b in edges:
        if a and b and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def brute(starts, hops, most):
        out = set()
        for s in starts:
            seen, last = {s: 0}, [s]
            for hop in range(1, hops + 1):
                last = [y for x in last if most is None or len(near.get(x, ())) <= most for y in near.get(x, ()) if y not in seen]
                seen |= dict.fromkeys(last, hop)
            out |= {(s, n, h) for n, h in seen.items()}
        return out

    e, starts = spark.createDataFrame(edges, "source string, target string"), ["n1", "n7", "elsewhere"]
    s = spark.createDataFrame([(x,) for x in [*starts, "n1", None]], "node string")
    for hops, most in ((3, None), (3, 15), (0, None)):
        got = [(r.start, r.node, r.hop) for r in chains.walk(e, s, hops, most).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(starts, hops, most)


def test_a_walks_steps_shuffle_no_other_edges(spark, monkeypatch):
    """Of 2,000 edges apart from the walk few come to a step's join; shuffle files go with their jobs."""
    e = spark.createDataFrame([("a", "b"), ("b", "c"), (None, "a"), *[(f"x{i}", f"y{i}") for i in range(2000)]], "source string, target string")
    reaches = chains.reach_filter(spark.createDataFrame([("a",), ("c",)], "node string"))
    assert e.where(reaches(F.col("source")) | reaches(F.col("target"))).where("source IS NOT NULL").count() < 20
    folders, kept = [], chains.written

    def seen(df, name):
        out = kept(df, name)
        folders.append(name)
        return out

    monkeypatch.setattr(chains, "written", seen)
    got = {tuple(r) for r in chains.walk(e, spark.createDataFrame([("a",)], "node string"), 3).collect()}
    assert got == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2)} and folders.count("reached") == 6 and "steps" not in folders


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    from examina.shared import dropped, written

    def stored() -> int:
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return sum(1 for i in range(manager.getAllFiles().size()) if manager.getAllFiles().apply(i).getName().startswith("shuffle_"))

    spark._jvm.System.gc()
    before = stored()
    out = written(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count(), "counts")
    assert stored() <= before and out.count() == 700
    dropped(out)
    with pytest.raises(Exception):
        out.count()
