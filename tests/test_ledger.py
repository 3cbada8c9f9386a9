"""Proofs by index and size, append-only checkpoints, and the search among digests."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from examina.operators import checkpoints, integrity, nearness, text


def leaf(x: str) -> bytes:
    return hashlib.sha256(b"\x00" + x.encode()).digest()


def root(hs: list[bytes]) -> bytes:
    """The tree that splits at the largest power of two below its size."""
    if len(hs) == 1:
        return hs[0]
    k = 1 << ((len(hs) - 1).bit_length() - 1)
    return hashlib.sha256(b"\x01" + root(hs[:k]) + root(hs[k:])).digest()


def path(hs: list[bytes], i: int) -> list[tuple[str, str]]:
    if len(hs) == 1:
        return []
    k = 1 << ((len(hs) - 1).bit_length() - 1)
    return [*path(hs[:k], i), ("right", root(hs[k:]).hex())] if i < k else [*path(hs[k:], i - k), ("left", root(hs[:k]).hex())]


def test_proofs_are_held_against_index_and_size(spark):
    rows, want = [], []

    def add(h, i, n, proof, top, verdict):
        rows.append((h, i, n, proof, top))
        want.append(verdict)

    for n in range(1, 20):
        hs = [leaf(f"{n}-{i}") for i in range(n)]
        top = root(hs).hex()
        for i in range(n):
            p, h = path(hs, i), hs[i].hex()
            add(h, i, n, p, top, "VALID")
            add(h, i, n, p, top.upper(), "VALID")
            add(h, n, n, p, top, "INDEX")
            add(h, -1, n, p, top, "INDEX")
            add(h, None, n, p, top, "INDEX")
            add(h, i, n, None, top, "LENGTH")
            add(h, i, n, [*p, ("left", h)], top, "LENGTH")
            add(h, i, n, p, None, "ROOT")
            add(leaf("other").hex(), i, n, p, top, "ROOT")
            if p:
                add(h, i, n, p[:-1], top, "LENGTH")
                add(h, i, n, [({"left": "right", "right": "left"}[p[0][0]], p[0][1]), *p[1:]], top, "SIDE")
                add(h, i, n, [(p[0][0], "zz"), *p[1:]], top, "ROOT")
                add(h, i, n, [(None, p[0][1]), *p[1:]], top, "SIDE")
                other = i ^ 1 if i ^ 1 < n else i - 1
                moved = [s for s, _ in path(hs, other)]
                add(h, other, n, p, top, "LENGTH" if len(moved) != len(p) else "SIDE")
    df = spark.createDataFrame(rows, "h string, i bigint, n bigint, proof array<struct<side:string,h:string>>, top string").coalesce(1)
    got = [r.v for r in df.select(integrity.proof_verdict(F.col("h"), F.col("i"), F.col("n"), F.col("proof"), F.col("top")).alias("v")).collect()]
    assert got == want


def test_appended_checkpoints_equal_whole_trees(spark, tmp_path):
    rng = random.Random(6)
    logs: dict[str, list[str]] = {}
    for number in range(5):
        came = []
        for entity in "abcd":
            for _ in range(rng.choice([0, 1, 2, 5, 17])):
                log = logs.setdefault(entity, [])
                log.append(f"{entity}{len(log)}")
                came.append((entity, len(log), log[-1]))
        df = spark.createDataFrame(came, "entity_id string, seq bigint, digest string")
        for _ in range(2 if number == 2 else 1):  # a batch that is tried again replaces itself
            got = {r.entity_id: (r["size"], r.root) for r in checkpoints.append(df, f"{tmp_path}", number).collect()}
        assert got == {e: (len(logs[e]), root([leaf(x) for x in logs[e]]).hex()) for e in {c[0] for c in came}}
    none = checkpoints.append(spark.createDataFrame([], "entity_id string, seq bigint, digest string"), f"{tmp_path}", 5)
    assert none.count() == 0 and {r.entity_id: r["size"] for r in checkpoints.frontier(spark, str(tmp_path), 5).collect()} == {e: len(x) for e, x in logs.items()}
    asked = [(e, n) for e, x in logs.items() for n in range(len(x) + 2)] + [("nobody", 1)]
    at = {(r.entity_id, r["size"]): r.root for r in checkpoints.roots_at(spark, str(tmp_path), spark.createDataFrame(asked, "entity_id string, size bigint")).collect()}
    assert at == {(e, n): root([leaf(x) for x in logs[e][:n]]).hex() if e in logs and 0 < n <= len(logs[e]) else None for e, n in asked}
    size = len(logs["a"])
    for wrong in ([("a", size + 2, "x")], [("a", size + 1, "x"), ("a", size + 1, "y")], [("a", size, "x")], [("new", 2, "x")]):
        with pytest.raises(ValueError, match=wrong[0][0]):
            checkpoints.append(spark.createDataFrame(wrong, "entity_id string, seq bigint, digest string"), f"{tmp_path}", 6)


def steps(a: str, b: str) -> int:
    """The distance of two digests, code by code."""
    length = abs(int(a[4:6], 16) - int(b[4:6], 16))
    codes = sum(abs((int(x, 16) >> s & 3) - (int(y, 16) >> s & 3)) for x, y in zip(a[8:], b[8:], strict=True) for s in (0, 2))
    return (a[2:4] != b[2:4]) + (length * 12 if length > 1 else length) + sum(abs(int(a[k], 16) - int(b[k], 16)) for k in (6, 7)) + codes


def test_all_near_digests_are_found(spark):
    rng = random.Random(9)

    def moved(d: str, most: int) -> str:
        codes = [int(x, 16) >> s & 3 for x in d[8:] for s in (0, 2)]
        for _ in range(rng.randint(0, most)):
            k = rng.randrange(128)
            codes[k] = max(0, min(3, codes[k] + rng.choice([-1, 1])))
        head = f"T1{rng.choice([d[2:4], 'A7'])}{(int(d[4:6], 16) + rng.randint(-3, 3)) % 256:02X}{max(0, min(15, int(d[6], 16) + rng.randint(-1, 1))):X}{d[7]}"
        return head + "".join(f"{codes[2 * k] | codes[2 * k + 1] << 2:X}" for k in range(64))

    seeds = ["T1" + "".join(rng.choice("0123456789ABCDEF") for _ in range(70)) for _ in range(6)]
    seeds[0] = "T1" + "0" * 70
    seeds[1] = "T1" + "F" * 70
    digests = [*seeds, *[moved(s, 34) for s in seeds for _ in range(25)], seeds[2], seeds[2], None]
    distinct = sorted({d for d in digests if d})
    df = spark.createDataFrame([(d,) for d in digests], "digest string")
    for most in (30, 23, 0, 31):
        want = {(a, b, steps(a, b)) for k, a in enumerate(distinct) for b in distinct[k + 1:] if steps(a, b) <= most}
        got = [tuple(r) for r in nearness.near_digests(df, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert most < 23 or len(want) > 30
    assert nearness.near_digests(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        nearness.near_digests(df, 32)
    pair = spark.createDataFrame([(a, b) for a in distinct[:20] for b in distinct[:20]], "a string, b string")
    assert all(r.d == steps(r.a, r.b) for r in pair.select("a", "b", text.digest_distance(F.col("a"), F.col("b")).alias("d")).collect())


def test_digests_take_any_table():
    """The table is a parameter: another one gives other digests of the same form."""
    data = ("The quick brown fox jumps over the lazy dog, and " * 5 + "then some 0123456789 more words.").encode()
    one, other = text.locality_digest(data, text.digest_table()), text.locality_digest(data, np.arange(256, dtype=np.uint8)[::-1].copy())
    assert one != other and len(one) == len(other or one) == 72


def test_near_digests_broadcast_nothing(spark):
    """The moved bands are hundreds of times the digests by whose file Spark sizes them."""
    df = spark.createDataFrame([(f"T1{i:02X}1042" + f"{i:02X}" * 32,) for i in range(40)], "digest string")
    assert "Broadcast" not in nearness.near_digests(df)._jdf.queryExecution().executedPlan().toString()
