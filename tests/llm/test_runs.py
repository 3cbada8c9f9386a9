"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from examina.llm import op12_runs


def all_runs(w: list) -> list[tuple[int, int, int]]:
    """Every stretch of at least two smallest periods that no neighbour extends, by trying each period."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            own = w[i : j + q]
            if j - i >= q and not any(own[r:] == own[:-r] for r in range(1, q)):
                out.append((i, len(own), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def long_runs(w: list) -> list[tuple[int, int, int]]:
    return [r for r in all_runs(w) if r[1] >= max(6, 4 * r[2])]


def collapse(w: list, runs: list[tuple[int, int, int]]) -> list:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def test_automaton_finds_every_run():
    rng = random.Random(12)
    for _ in range(1500):
        w = [rng.randint(1, rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 40))]
        w[5:5] = [rng.randint(1, 3) for _ in range(rng.randint(0, 6))] * rng.randint(0, 7)
        assert op12_runs.squares_to_runs(w) == all_runs(w)
        found = [b"%d" % x for x in w]
        assert op12_runs.runs_of(found) == long_runs(w)
        assert op12_runs.collapsed_words(found, long_runs(w)) == collapse(found, long_runs(w))


def test_cuts_lose_no_run_whatever_their_number(monkeypatch):
    rng = random.Random(5)
    texts = [[rng.randint(0, 25) for _ in range(60)] + [1, 2, 3, 4, 5, 6] * 4 + [rng.randint(0, 25) for _ in range(60)] for _ in range(40)]
    for passes in (0, 1, 12):
        monkeypatch.setattr(op12_runs, "PASSES", passes)
        assert all(op12_runs.runs_of([b"%d" % x for x in w]) == long_runs(w) for w in texts)
    assert op12_runs.stretches(np.arange(100)) == [] or op12_runs.PASSES == 0


def test_long_texts_take_linear_time():
    for w in ([1] * 60_000, [1, 2, 3, 4, 5] * 12_000):
        q = len(set(w))
        assert op12_runs.squares_to_runs(w) == [(0, 60_000, q)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [None, "", "  \t\n ", "one", "a a a a a", "a a a a a a", "x y x y x y x y", " x\ty x y\nx y x y z z z z z z z ", "ü é " * 9, "n\x1co n\x1co " * 5, "A a A a A a A a", "w" * 70_000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)] + [" ".join(f"w{rng.randint(0, 400)}" for _ in range(3000))]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "b b b b b b b"), (3, "one"), (5, "a a a a a a")]


def test_operator(spark, rows):
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id bigint, text string, RUNS int, note string")
    got = sorted(((r.doc_id, r.text, r.note, r.n_words, r.n_runs, [tuple(x) for x in r.runs], r.collapsed) for r in op12_runs.periodic_runs(df).collect()), key=repr)
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        runs = long_runs(w)
        want.append((i, t, "x", len(w), len(runs), runs, b" ".join(collapse(w, runs)).decode()))
    assert got == sorted(want, key=repr)
    assert op12_runs.periodic_runs(df.limit(0)).count() == 0


def test_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op12_runs.op12_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = long_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                     hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapse(w, runs))).hexdigest()))
    assert got == sorted(want, key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows if t)
