"""The parity-sketch join against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from examina.llm import op13_jaccard as op


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def brute(rows):
    """doc_id, n_shingles, component_id of every row, all pairs compared."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 90 * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    least: dict = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted(((i, len(sets[x]), least.get(find(x)) if sets[x] else i) for x, (i, _) in enumerate(rows)), key=repr)


def edited(rng, w, edits):
    w = list(w)
    for _ in range(edits):
        k = rng.randrange(len(w))
        w[k : k + rng.randint(0, 1)] = [f"n{rng.randint(0, 10**6)}"] * rng.randint(0, 1)
    return w


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    texts = [None, "", " \t", "one", "One", "one two", "two one", "a b c", "A B C", "a b c d", "a b c a b c a b c", "x" * 9000, "Ä b c", "ä b c", "w\x1cx y z"]
    for size in (5, 10, 12, 20, 40, 60, 100, 200, 700):
        for _ in range(3):  # chains and stars of near copies around the threshold
            w = [f"w{rng.randint(0, 10**5)}" for _ in range(size)]
            for _ in range(7):
                texts.append(" ".join(w))
                w = edited(rng, w, rng.randint(0, max(1, size // 40)))
    base = [f"b{rng.randint(0, 10**5)}" for _ in range(90)]
    texts += [" ".join(edited(rng, base, rng.randint(0, 5))) for _ in range(90)]  # a dense group
    for k in range(1, 12):  # exactly at the threshold and beside it: sets of 19 k + r shingles that share all but some
        w = [f"t{k}-{i}" for i in range(19 * k + 2)]
        texts += [" ".join(w), " ".join(w[: -k] + ["z"] * k), " ".join(w[:-k - 1]), " ".join(w[:-2 * k])]
    texts += [f"common passage of some words {' '.join(base[:30])} {' '.join(f'u{rng.randint(0, 10**5)}' for _ in range(40))}" for _ in range(20)]
    texts.append(" ".join(f"l{rng.randint(0, 10**5)}" for _ in range(20_000)))
    texts.append(texts[-1] + " and more words here")
    out = [(1000 - i, t) for i, t in enumerate(texts)]
    return out + [(None, "a b c"), (None, "only null ids here"), (None, "only null ids here"), out[9], (out[40][0], out[60][1]), *[(2000 + i, texts[30].upper()) for i in range(30)]]


def test_components(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id bigint, text string, n int, keys string")
    want = brute(rows)
    assert len({c for *_, c in want}) < len(rows) - 100
    assert sorted((tuple(r) for r in op.jaccard_components(df).collect()), key=repr) == want
    assert op.jaccard_components(df.limit(0)).count() == 0
    assert op.jaccard_components(df.where("doc_id = 1000")).collect()[0].n_shingles == 0


def test_second_step_and_small_blocks(spark, rows, monkeypatch):
    """Nothing verified in the first step, blocks of a few members, hot keys apart, no room
    for unpacked texts: the same components."""
    monkeypatch.setattr(op, "BLOCK", 2)
    monkeypatch.setattr(op, "ACROSS", 3)
    monkeypatch.setattr(op, "SPREAD", 4)
    real = op._verified
    monkeypatch.setattr(op, "_verified", lambda pairs, sets: real(pairs, sets).where("false"))
    some = [r for r in rows if len((r[1] or "").split()) < 150]
    df = spark.createDataFrame(some, "doc_id bigint, text string")
    assert sorted((tuple(r) for r in op.jaccard_components(df).collect()), key=repr) == brute(some)


def test_unpacked_sets_are_bounded():
    from zstandard import ZstdCompressor

    sets, packed = op.Sets(most=50), [ZstdCompressor().compress(" ".join(f"w{k}-{i}" for i in range(40)).encode()) for k in range(9)]
    for p in packed * 2:
        assert sets.link(p, p) and sets.held <= 50 + 38
    assert not sets.link(packed[0], packed[1])


def test_bands_hold_every_pair():
    """Two sets that may link are listed under one band whose words outnumber what they may differ by."""
    for small in [*range(1, 700), 5000, 99_999]:
        for large in range(small, 100 * small // 90 + 1):
            both = set(op.bands(small)) & set(op.bands(large))
            assert both and all(op.width(b)[0] - op.width(b)[1] > op.differing(small + large) for b in both)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[: -int(rng.integers(1, 60))], rng.integers(0, 1 << 63, int(rng.integers(0, 40)), dtype=np.uint64)]))
        d = len(np.setxor1d(x, y))
        a, b = op.sketch(x, 33), op.sketch(y, 33)
        assert np.bitwise_count(a ^ b).sum() <= d and (d >= 33 or (a == b).any())


def test_sets_that_link_share_a_key_and_others_none():
    rng = np.random.default_rng(2)
    for size in (1, 2, 9, 10, 13, 19, 25, 60, 150, 400, 2000):
        for _ in range(30):
            x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            d = op.differing(2 * len(x))
            gone = int(rng.integers(0, d + 1))
            y = np.unique(np.concatenate([x[gone:], rng.integers(0, 1 << 63, d - gone, dtype=np.uint64)]))
            links = 100 * len(np.intersect1d(x, y)) >= 90 * len(np.union1d(x, y))
            assert not links or set(op.keys(x)) & set(op.keys(y))
    others = [np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(300)]
    listed = np.concatenate([op.keys(x) for x in others])
    assert len(np.unique(listed)) == len(listed)
