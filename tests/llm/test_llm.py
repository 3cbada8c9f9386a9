"""Each operator against a brute-force version, with nulls, empty and long texts, ties,
repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from examina.llm import op1_tokens, op2_lm, op3_chat, op4_simhash, op5_quality, op6_html, op7_ann, op8_mixing, op9_wordpiece, op10_bpe
from examina.llm.chunks import ChunkEncoder
from examina.llm.components import components

DOCS = "doc_id bigint, text string, source string, n_tokens int, kept string, size string"
TEXTS = [None, "", " ", "a", "two words", "the of and to in " * 30, "Das ist über <|endoftext|> alles.\n\n  Ja!", "the of and to in " * 30, "x" * 5000, "a\tb\nc \n d\x1ce", "  lead", "tail  ", "don't 123 45,6 ...", "日本語 текст"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, 1, "k", "z") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, "no id here", "s1", 1, "k", "z")], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    return op10_bpe.tokenizer_text()


def library(tokenizer):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(tokenizer)


# 1 ---------------------------------------------------------------------------------
@pytest.mark.parametrize("values", [[], [0] * 500, [1 << 63, 5, 1 << 60, (1 << 60) - 1, 0], list(range(3000)), [1, 0] * 77])
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, starts = op1_tokens.pack(v)
    assert (op1_tokens.unpack(words, len(v)) == v).all() and len(starts) == len(words)


def test_any_range_decodes_from_its_offset():
    rng = np.random.default_rng(3)
    v = np.where(rng.random(6000) < 0.3, rng.integers(1 << 60, 1 << 63, 6000), rng.integers(0, 60_000, 6000)).astype(np.uint64)
    words, starts = op1_tokens.pack(v)
    offsets = op1_tokens.strides(words, starts)
    assert (offsets >= op1_tokens.ESCAPED).any()  # some strides begin with an escaped value
    for low, high in [(0, 6000), (0, 0), (6000, 6000), *(sorted(p) for p in rng.integers(0, 6001, (300, 2)).tolist())]:
        assert (op1_tokens.ids_between(words, offsets, low, high, len(v)) == v[low:high]).all()


def test_blocks(spark, docs, none, tokenizer, tmp_path):
    op1_tokens.write_blocks(docs, tokenizer, f"file://{tmp_path}/b", block_ids=50)
    got = op1_tokens.read_blocks(spark, f"file://{tmp_path}/b").orderBy("start").collect()
    tok, start = library(tokenizer), 0
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    for (doc, text), r in zip(rows, got, strict=True):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    op1_tokens.write_blocks(none, tokenizer, f"file://{tmp_path}/e")
    assert op1_tokens.read_blocks(spark, f"file://{tmp_path}/e").count() == 0


def test_small_cache_gives_the_same_ids(tokenizer):
    full = op1_tokens.library_encoder(tokenizer)
    small = ChunkEncoder(full.encode, full.special, capacity=20)
    texts = [t or "" for t in TEXTS] + [" ".join(f"w{i * k % 97}." for i in range(50)) for k in range(5)]
    assert small.batch(texts) == full.batch(texts) == [e for t in texts for e in small.batch([t])]


# 10 --------------------------------------------------------------------------------
def test_bpe_equals_library(docs, none, tokenizer):
    tok = library(tokenizer)
    rows = op10_bpe.encode_decode(docs, tokenizer).collect()
    assert len(rows) == docs.count() and "kept" in rows[0].asDict()
    for r in rows:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == text == (r.text or "")
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert op10_bpe.encode_decode(none, tokenizer).count() == 0


def test_backtracking_equals_merging(tokenizer):
    bpe, _ = op10_bpe.model(tokenizer)
    tok, rng = library(tokenizer), random.Random(4)
    for _ in range(400):
        word = "".join(rng.choice("abcdehilnorst") for _ in range(rng.randint(1, 40)))
        assert bpe.piece(word) == tok.encode(word, add_special_tokens=False).ids
    assert bpe.piece("ab" * 3000) == tok.encode("ab" * 3000, add_special_tokens=False).ids


# 2 ---------------------------------------------------------------------------------
def test_language_model(spark, none):
    rng = random.Random(1)
    def line(k):
        return " ".join(x for _ in range(rng.randint(5, 40)) for x in ((f"a{rng.randint(0, 9)}", "follows") if k % 2 else (f"B{rng.randint(0, 9)}", "trails")))
    texts = {i: line(i) for i in range(300)} | {300: None, 301: "", 302: "z" * 3000}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r for r in op2_lm.scored(df).collect()}
    toks = {i: (t or "").lower().split() + [None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = collections.Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in toks.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert op2_lm.scored(none).count() == 0


def test_score_equals_brute_force(spark, monkeypatch):
    """The score from the trained parameters, token by token over all units; and all words
    with one unknown word a class add up to 1 after any two units."""
    import xxhash

    rng = random.Random(8)
    words = [f"{rng.choice('abcdefgh')}{rng.choice('klmnop')}{k}" for k in range(1500)]
    texts = {i: " ".join(rng.choices(words, weights=range(1500, 0, -1), k=rng.randint(1, 60))) for i in range(400)} | {400: "Never seen BEFORE", 401: None}
    trained = {}
    whole = op2_lm.train
    monkeypatch.setattr(op2_lm, "train", lambda coded, shares: trained.setdefault("m", whole(coded, shares)))
    got = {r.doc_id: r for r in op2_lm.scored(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    m = trained["m"]
    toks = {i: (t or "").lower().encode().split() for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = collections.Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    key = {w: int.from_bytes(xxhash.xxh64_digest(w), "big", signed=True) for w in c}
    listed = {w: k for k, w in enumerate(sorted(c, key=lambda w: (-c[w], key[w]))[: op2_lm.SHORTLIST])}
    n, v = collections.Counter(), collections.Counter()
    for w in c:
        if w not in listed:
            n[op2_lm.ending(w)] += c[w]
            v[op2_lm.ending(w)] += 1
    def unit(w):
        return (listed[w], 0.0) if w in listed else (op2_lm.SHORTLIST + op2_lm.ending(w), math.log10((c[w] + 1) / (n[op2_lm.ending(w)] + v[op2_lm.ending(w)] + 1)))
    def logs(one, two):
        x = (m["Q"][one] @ m["C"][0] + m["Q"][two] @ m["C"][1]) @ m["R"].T + m["b"]
        return x - x.max() - np.log(np.exp(x - x.max()).sum())
    for i in [*range(0, 400, 7), 400, 401]:
        one = two = op2_lm.BEGIN
        total = 0.0
        for u, inside in [*map(unit, toks[i]), (op2_lm.END, 0.0)]:
            total += inside + logs(one, two)[u] / math.log(10)
            one, two = u, one
        assert abs(got[i].score - total) < 1e-3 * max(1, len(toks[i]))
    share = np.exp(logs(5, op2_lm.END))
    every = sum(share[listed[w]] for w in listed) + share[op2_lm.END] + sum(share[op2_lm.SHORTLIST + k] * (sum((c[w] + 1) for w in c if w not in listed and op2_lm.ending(w) == k) + 1) / (n[k] + v[k] + 1) for k in range(op2_lm.CLASSES))
    assert abs(every + share[len(listed) : op2_lm.SHORTLIST].sum() - 1) < 1e-6


def test_normalised():
    rng = np.random.default_rng(0)
    m = op2_lm.initial(np.full(op2_lm.UNITS, 1 / op2_lm.UNITS))
    one, two, total = op2_lm.normalisers(m)
    for a, b in rng.integers(0, op2_lm.UNITS + 1, (20, 2)):
        assert abs(np.exp(one[a].astype(float) + two[b] - total[a, b]).sum() - 1) < 1e-3


# 3 ---------------------------------------------------------------------------------
def test_chat(spark):
    rows = [(1, 0, "user", "hi <|end|>\n <\\|x <\\\\|"), (1, 1, "user", None), (1, 2, "assistant", "<|text|> ok"), (1, 3, "assistant", "é<"), (2, 0, None, ""), (2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"), (None, 5, "<|turn|>", "\n")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    back = {r.conv_id: r for r in op3_chat.parsed(op3_chat.formatted(df)).collect()}
    for conv in (1, 2, None):
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [(t.role, t.text) for t in back[conv].turns] == [(r, x) for _, r, x in own]
        assert back[conv].loss_text == "".join(x for _, r, x in own if r == "assistant")
    assert back[1].formatted.count("<|turn|>") == 2  # neighbours of one role are merged
    assert op3_chat.parsed(op3_chat.formatted(df.limit(0))).count() == 0


# 4 ---------------------------------------------------------------------------------
def brute_print(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def brute_components(ids, prints):
    root = {i: i for i in ids}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_broadcasts_no_postings(spark, monkeypatch):
    """The postings are 56 times as many as the fingerprints by whose file Spark sizes them."""
    kept, plans = op4_simhash.written, []

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, name)

    monkeypatch.setattr(op4_simhash, "written", seen)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    docs = spark.createDataFrame([(i, f"a b c {i // 3} d e") for i in range(30)], "doc_id bigint, text string")
    assert op4_simhash.near_duplicates(docs).count() == 30
    assert "postings" in dict(plans) and all("BroadcastHashJoin" not in plan for _, plan in plans)
    plans.clear()
    stay = op4_simhash.without_duplicates(docs)  # the pipeline's
    assert "postings" in dict(plans) and all("BroadcastHashJoin" not in plan for _, plan in [*plans, ("", stay._jdf.queryExecution().executedPlan().toString())])


def test_simhash(spark, none):
    rng = random.Random(3)
    base = [" ".join(rng.choice(("alpha", "beta", "gamma", "delta", "eps")) + str(rng.randint(0, 60)) for _ in range(300)) for _ in range(12)]
    texts = {i: t for i, t in enumerate([*TEXTS, *base])}
    for k in range(60):
        w = base[k % 4].split()
        w[rng.randrange(len(w))] = "changed"
        texts[100 + k] = " ".join(w)
    df = spark.createDataFrame([*texts.items(), (3, texts[3])], "doc_id bigint, text string")
    prints = {i: brute_print(t) for i, t in texts.items()}
    expected = brute_components(sorted(texts), prints)
    for crowd in (128, 3):  # posting lists as pairs, and by midpoints
        old, op4_simhash.CROWD = op4_simhash.CROWD, crowd
        try:
            got = op4_simhash.near_duplicates(df).collect()
        finally:
            op4_simhash.CROWD = old
        assert len(got) == len(texts) + 1
        assert all(int(r.fingerprint, 16) == prints[r.doc_id] and r.component_id == expected[r.doc_id] for r in got)
    stay = op4_simhash.without_duplicates(df)
    assert sorted(r.doc_id for r in stay.collect()) == sorted(set(expected.values()))
    assert op4_simhash.near_duplicates(none).count() == 0


def test_one_row_of_each_component_stays(spark):
    text = {k: " ".join(hashlib.md5(f"{k}:{i}".encode()).hexdigest() for i in range(30)) for k in "abcde"}
    rows = [(None, text["a"]), (None, text["b"]), (None, text["c"]), (1, text["c"]), (1, text["d"]), (2, text["d"]), (7, text["e"]), (7, text["e"]), (None, None), (None, "")]
    stay = op4_simhash.without_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    got = collections.Counter((r.doc_id, r.text or "") for r in stay)
    assert got == collections.Counter([(None, text["a"]), (None, text["b"]), (1, text["c"]), (1, text["d"]), (7, text["e"]), (None, "")])


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501)], "a bigint, b bigint")
    assert {r.id: r.component for r in components(edges).collect()} == {i: 0 for i in range(201)} | {500: 500, 501: 500}


# 5 ---------------------------------------------------------------------------------
def brute_measures(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {g for g, n in collections.Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in many for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality(spark, none):
    rng = random.Random(5)
    good = {i: " ".join(rng.choice(("sun", "moon", "star", "sky", "rain")) + rng.choice("abcdefgh") for _ in range(80)) for i in range(60)}
    bad = {100 + i: " ".join(rng.choice(("buy", "now", "cheap", "deal")) + rng.choice("xyz") + "!!" for _ in range(80)) for i in range(20)}
    texts = good | bad | {200 + i: t for i, t in enumerate([*TEXTS, "a b c\na b c\n\n\na b c #*", "x y " * 40])}
    df = spark.createDataFrame([(i, t, "old", 1.0) for i, t in texts.items()], "doc_id bigint, text string, kept string, llr double")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(12)] + [(None, 1)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in op5_quality.quality_rules(df, labels).collect()}
    for i, t in texts.items():
        r = got[i]
        n, chars, symbols, dup, repeats = brute_measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n) and (not r.kept or not r.base_failed)
    assert all(got[i].kept for i in good if not got[i].base_failed) and not any(got[i].kept for i in bad)
    assert op5_quality.quality_rules(none, labels).count() == 0
    assert {r.kept for r in op5_quality.quality_rules(df.where("doc_id < 5"), labels.limit(0)).collect()} <= {True, False}


def brute_threshold(good, bad, loss):
    """The cut by trying each trusted score, whole lists at once."""
    best = None
    for cut in sorted(set(good)):
        lost = sum(x < cut for x in good) / len(good)
        gain = sum(x < cut for x in bad) / max(1, len(bad)) - lost
        if lost <= loss and (best is None or gain > best[0]):
            best = gain, cut
    below = max((x for x in good + bad if x < best[1]), default=best[1] - 0.1)
    return (best[1] + below) / 2


@pytest.mark.parametrize("seed, n_good, n_bad, loss, ranges", [(1, 300, 200, 0.1, 7), (2, 40, 40, 1.0, 64), (3, 50, 0, 0.2, 5), (4, 1, 30, 0.0, 3), (5, 400, 90, 0.002, 256), (6, 200, 200, 0.5, 1)])
def test_threshold_equals_trying_every_cut(spark, seed, n_good, n_bad, loss, ranges):
    rng = random.Random(seed)
    good, bad = [rng.randrange(-10, 40) / 4 for _ in range(n_good)], [rng.randrange(-40, 20) / 4 for _ in range(n_bad)]  # many ties
    points = [(x, good.count(x), bad.count(x)) for x in set(good + bad)]
    assert op5_quality.threshold(spark.createDataFrame(points, "llr double, good bigint, bad bigint"), loss, ranges) == brute_threshold(good, bad, loss)


def test_threshold_lies_above_the_next_lower_score(spark):
    low, high = math.nextafter(1.0, 0.0), 1.0  # no number lies between them
    points = spark.createDataFrame([(low, 0, 1), (high, 1, 0)], "llr double, good bigint, bad bigint")
    assert op5_quality.threshold(points, 0.0) == high
    assert op5_quality.threshold(points.where("good = 0"), 0.0) == op5_quality.threshold(points.limit(0), 0.0) == float("-inf")


def test_quality_learns_from_every_label(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    texts = {i: " ".join(words[int(400 * rng.random() ** (1.5 if i % 9 else 0.7))] for _ in range(52)) for i in range(10_400)}  # label 1, more than 10,000
    texts |= {20_000 + i: " ".join(words[int(400 * rng.random() ** (0.6 if i % 5 else 1.2))] for _ in range(52)) for i in range(10_300)}  # label 0
    texts |= {40_000: "w1 w2 w3 " * 40, 40_001: None, 40_002: "w5", 40_003: texts[3], 40_004: texts[20_003]}
    labels = [(i, int(i < 20_000)) for i in texts if i < 40_003] + [(5, 1), (6, 0), (40_000, 1), (99_999, 1), (99_998, 0), (None, 1), (40_003, None), (40_004, 2)]
    rows = [*texts.items(), (8, texts[8]), (9, texts[20_009]), (None, texts[10])]
    grams = {}
    for text in {t for _, t in rows}:
        h = [zlib.crc32(w.encode()) for w in (text or "").split()]
        mixed = [x * 0x9E3779B97F4A7C15 for x in h] + [(a * 0xC2B2AE3D27D4EB4F + b + 1) * 0x9E3779B97F4A7C15 for a, b in zip(h, h[1:])]
        grams[text] = np.array([((x & (1 << 64) - 1) >> 40) % 65_536 for x in mixed], np.int64)
    good, bad = ({i for i, q in labels if q == k and i is not None} for k in (1, 0))
    raw, target = np.zeros(65_536), np.zeros(65_536)
    for i, t in rows:
        np.add.at(raw, grams[t], 1)
        if i in good:
            np.add.at(target, grams[t], 1)
    ratios = np.log2((target + 1) / (target.sum() + 65_536)) - np.log2((raw + 1) / (raw.sum() + 65_536))
    score, lowest = {t: ratios[g].mean() if len(g) else None for t, g in grams.items()}, {}
    for i, t in rows:
        if t and not op5_quality.base_failed(brute_measures(t)[0], brute_measures(t)[4]):
            lowest[i] = min(score[t], lowest.get(i, 99))
    bounds = [sorted(lowest[i] for i in side if i in lowest) for side in (good, bad)]
    best = None
    for k, cut in enumerate(bounds[0]):
        if k and cut == bounds[0][k - 1]:
            continue
        gain = np.searchsorted(bounds[1], cut) / len(bounds[1]) - k / len(bounds[0])
        if k / len(bounds[0]) <= 0.002 and (best is None or gain > best[0]):
            best = gain, cut
    least = (best[1] + max((x for side in bounds for x in side if x < best[1]), default=best[1] - 0.1)) / 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = op5_quality.quality_rules(df, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    assert len(got) == len(rows) and 0 < sum(r.kept for r in got) < len(rows)
    for r in got:
        assert r.llr == score[r.text] and r.kept == (not r.base_failed and r.llr >= least)


# 6 ---------------------------------------------------------------------------------
def test_html(spark):
    shared = "<p>Subscribe to our newsletter for more of this every day</p>"
    pages = [(i, "http://h.org/%d" % i, f"<html><head><title>t</title></head><body><nav>a b c d e f g</nav><div>All about the very same site here today</div><article><h1>T{i} &amp; co</h1><p>w{i} x{i}  y{i}<br>z{i}{shared if i else ''}<aside>no</aside></article><footer>f</footer>") for i in range(5)]
    pages += [(10 + i, "http://g.org/", f"<div>one two three four five six seven</div><p>own{i} text</p><script>var a = '<p>';</script>") for i in range(3)]
    pages += [(20, None, None), (21, "", ""), (22, "x", "<p>a<p class=ad>b<ul><li>c<li>d</ul>&nbsp;e &lt;f&gt;"), (22, "x", "<!-- never ends <p>q")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = op6_html.main_text(df).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    text = collections.defaultdict(set)
    for r in got:
        text[r.page_id].add(r.text)
    assert text[3] == {"T3 & co\nw3 x3 y3 z3\nSubscribe to our newsletter for more of this every day"}
    assert text[11] == {"own1 text"} and text[20] == text[21] == {""} and text[22] == {"a\nc\nd\ne <f>", ""}
    assert op6_html.main_text(df, shard_chars=100).count() == len(pages)
    assert op6_html.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("source, text", [
    ('<div class="layout has-sidebar"><nav>x</nav><article><p>a</p></article></div>', "a"),
    ('<article><p>a</p><h2 id="search">Search</h2><h3 id="related">Related</h3><p>b</p></article>', "a\nSearch\nRelated\nb"),
    ('<article><section id="sharing"><p>about sharing data</p></section><section id="comments"><p>x</p></section><div id="share">x</div></article>', "about sharing data"),
    ('<article><div class="widget">a</div><table class="menu"><tr><td>b</td></tr></table><div class="comments">x</div></article>', "a\nb"),
    ('<div class="menu">x</div>', ""),
    ('<article><h2 class="ad">x</h2><p>a</p></article>', "a"),
    ('<div class="post-share-enabled content"><p>a</p></div>', "a"),
    ('<article><section class="related-work"><p>a</p></section><div class="related-posts">b</div></article>', "a"),
    ('<div class="sidebar wrap"><main><p>a</p></main><p>b</p></div>', "a"),
    ('<form id="aspnet"><h1>T</h1><p>a</p></form>', "T\na"),
    ('<p>a</p><form><p>b</p><input></form>', "a"),
    ('<article>a<div class="comment-list"><article class="comment">b</article></div></article><section id="comments"><article>c</article></section>', "a"),
    ('<p>a</p><div class="site-footer">b</div><div id="mainNav">c</div><div class="ad_slot--1">d</div><ul class="menu-items"><li>e</ul><div role="navigation">f</div><div class="cookie-notice">g</div>', "a"),
    ('<p>a <span class="ad">b</span> c<math><mi>x</mi></math></p>', "a cx"),
    ('<div data-class="ad">a</div>', "a"),
])
def test_marks(source, text):
    assert op6_html.content(source)[1] == text


def brute_main_text(rows):
    """rows: page, host, html. The share of a host's distinct pages that hold each run, counted at once."""
    own = [(p, h, *op6_html.content(s)) for p, h, s in rows]
    out = {}
    for host in {h for _, h, *_ in own}:
        distinct = {t for _, h, _, t in own if h == host and t}
        grams = {t: {tuple(w[i : i + 6]) for i in range(len(w) - 5)} for t in distinct for w in [t.split()]}
        pages = collections.Counter(g for s in grams.values() for g in s)
        for p, h, article, t in own:
            if h != host:
                continue
            least = max(10, 0.6 * len(distinct)) if article else max(3, 0.5 * len(distinct))
            w, gone = t.split(), set()
            for i in range(len(w) - 5):
                if pages[tuple(w[i : i + 6])] >= least:
                    gone.update(range(i, i + 6))
            at, lines = 0, []
            for line in t.split("\n") if t else []:
                n = len(line.split())
                if not gone.issuperset(range(at, at + n)):
                    lines.append(line)
                at += n
            out[p] = "\n".join(lines) or t
    return out


def test_html_boilerplate(spark):
    rng = random.Random(12)
    def words(n):
        return " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(n))
    menu, note, quote = [words(2) for _ in range(5)], words(9), words(30)
    rows = []
    for i in range(48):  # menu and note stand unmarked on most pages of a host, a quotation on some
        parts = "".join(f"<div>{m}</div>" for m in menu) + f"<p>{words(12)}</p>" + (f"<p>{quote}</p>" if i % 5 == 0 else "") + (f"<p>{note}</p>" if i % 4 else "") + f"<p>{words(rng.randint(1, 20))}</p>"
        rows.append((i, "h.org", parts if i % 6 else f"<article>{parts}</article>"))
    rows += [(100 + k, "h.org", rows[1][2]) for k in range(40)]  # copies count once
    rows += [(200 + k, "same.org", f"<div>{quote}</div>") for k in range(6)]  # and stay, where a host has no others
    rows += [(300 + k, "two.org", f"<div>{words(4)}</div><p>{quote}</p>") for k in range(2)] + [(400, "two.org", "<p>" + words(30_000) + "</p>"), (401, "two.org", None)]
    df = spark.createDataFrame([(p, f"https://{h}/{p}", s, "x", "y", "z", 1) for p, h, s in rows], "page_id bigint, url string, html string, text string, host string, group string, n_chars int").repartition(5)
    want = brute_main_text(rows)
    assert want[1] != op6_html.content(rows[1][2])[1] and note not in want[1] and all(m not in want[1] for m in menu) and want[100] == want[1]
    assert all(quote in want[p] for p in (0, 5, 200, 300))
    for chars in (op6_html.SHARD_CHARS, 500):  # one shard a host, and several
        got = op6_html.main_text(df, shard_chars=chars).collect()
        assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
        assert got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}


def test_covered_equals_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        streams = [np.array([rng.randint(0, 3) for _ in range(rng.randint(0, 14))], np.int64) for _ in range(4)]
        run, least = rng.randint(2, 4), rng.randint(2, 3)
        pages = collections.defaultdict(set)
        for p, s in enumerate(streams):
            for i in range(len(s) - run + 1):
                pages[tuple(s[i : i + run])].add(p)
        for s, got in zip(streams, op6_html.covered(streams, run, least), strict=True):
            want = [any(len(pages[tuple(s[i : i + run])]) >= least for i in range(max(0, k - run + 1), min(k, len(s) - run) + 1)) for k in range(len(s))]
            assert got.tolist() == want


# 7 ---------------------------------------------------------------------------------
def test_nearest(spark):
    """Against brute force over rows: more copies than a result holds, repeated rows, one id
    with two vectors, two lengths, unusable vectors, columns that clash."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    x[:40] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, x[20].tolist()), (60, rng.normal(size=12).astype(np.float32).tolist())] + [(600 + i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(30)]
    bad = [(500, None), (520, [0.0] * 12), (540, [float("nan")] * 12), (560, [1.0, None] + [0.0] * 10), (580, [float("inf")] * 12), (None, x[3].tolist())]
    df = spark.createDataFrame([(*r, 1, "r") for r in rows + bad], "vec_id bigint, embedding array<float>, rank int, score string")
    got = collections.defaultdict(list)
    for r in op7_ann.nearest(df, 20).orderBy("query_id", "rank", "vec_id").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == [*range(0, 400, 20), 600, 620]
    want, hit, every = collections.defaultdict(list), 0, 0
    for k, (q, v) in enumerate(rows):
        if q % 20 == 0:
            scores = sorted((-float(np.dot(np.float64(v), np.float64(w))), o) for j, (o, w) in enumerate(rows) if j != k and len(w) == len(v))
            want[q] += [(n + 1, o, -s) for n, (s, o) in enumerate(scores[:20])]
    for q, best in want.items():
        found = got[q]
        assert sorted(r for r, *_ in found) == sorted(r for r, *_ in best)
        hit += sum((collections.Counter(o for _, o, _ in found) & collections.Counter(o for _, o, _ in best)).values())
        every += len(best)
        if q in (0, 20, 600, 620):
            assert sorted((r, o) for r, o, _ in found) == sorted((r, o) for r, o, _ in best)
    known = {(q, o, round(s, 9)) for q, rs in want.items() for _, o, s in rs}
    assert hit / every >= 0.95 and sum((q, o, round(s, 9)) in known for q, rs in got.items() for _, o, s in rs) >= 0.95 * every
    assert op7_ann.nearest(df.where("vec_id >= 500 AND vec_id < 600"), 20).count() == 0
    assert op7_ann.nearest(df.limit(0), 20).count() == 0


# 8 ---------------------------------------------------------------------------------
def brute_targets(sizes):
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        over = {s for s in free if left * weights[s] / sum(weights[f] for f in free) >= 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else left * weights[s] / sum(weights[f] for f in free) for s in sizes}
        capped |= over


def test_mixing(spark, docs, none):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(0, 9)), rng.choice(("b", "a", "ü", None, "b", "b", "c"))) for i in range(600)] + [(700, None, "empty")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = op8_mixing.plan(df).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    targets = brute_targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6 and r.copies * r.size <= 3 * r.size
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - targets[s]) <= 9 for s in sizes)
    mixed = op8_mixing.mix(df)
    assert mixed.columns == ["doc_id", "text", "source", "shard", "place"]
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({r.doc_id: r.copies for r in got if r.copies})
    assert sorted(map(tuple, mixed.select("doc_id", "shard", "place").collect())) == sorted(map(tuple, op8_mixing.mix(df).select("doc_id", "shard", "place").collect()))
    assert op8_mixing.plan(docs).count() == docs.count() and op8_mixing.plan(none).count() == 0 and op8_mixing.mix(none).count() == 0


def test_taken_is_what_the_mix_holds(spark, docs, none, monkeypatch):
    rng = random.Random(10)
    rows = [(None if i % 3 == 0 else i % 50, " ".join(["w"] * rng.randint(0, 9)), rng.choice(("b", "a", None, "b"))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")

    def counted(rows):
        return collections.Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in rows)

    planned = op8_mixing.plan(df).withColumn("taken", F.col("copies") * F.col("size")).collect()
    assert counted(op8_mixing.held(df).collect()) == counted(planned)
    assert op8_mixing.held(docs).count() == docs.count() and op8_mixing.held(none).count() == 0
    mixed, drawn = op8_mixing.mix(df), op8_mixing.plan(df).where("copies > 0")  # blocks stand in one shard a pass, as many as the quotas
    blocks = drawn.withColumn("pass", F.explode(F.sequence(F.lit(1), "copies"))).select(F.coalesce("source", F.lit("")).alias("s"), "pass", "block").distinct().groupBy("s").count().orderBy("s").collect()
    quotas = op8_mixing.shard_quotas(np.array([r["count"] for r in blocks]), op8_mixing.SHARDS, op8_mixing.SEED)
    assert {r.shard for r in mixed.select("shard").distinct().collect()} == {k for k in range(op8_mixing.SHARDS) if quotas[k].sum()}
    quota = op8_mixing.shard_quotas
    monkeypatch.setattr(op8_mixing, "shard_quotas", lambda blocks, shards, seed: quota(blocks, shards, seed) // 2)  # loses blocks
    lost = op8_mixing.held(df).collect()
    assert len(lost) == len(planned) and sum(r.taken for r in lost) < sum(r.taken for r in planned)


def test_quotas_add_up():
    blocks = np.array([1024, 7, 0, 300])
    q = op8_mixing.shard_quotas(blocks, 16, 8)
    assert (q.sum(axis=0) == blocks).all() and q.sum(axis=1).max() - q.sum(axis=1).min() <= 5


# 9 ---------------------------------------------------------------------------------
def brute_pieces(word, vocab, ends=True):
    s, i, n = [*word, *[256] * ends], 0, 0
    while i < len(s):
        j = next((j for j in range(len(s), i, -1) if tuple(s[i:j]) in vocab), None)
        if j is None:
            return 0
        n, i = n + 1, j
    return n


def test_longest_match_equals_brute_force():
    rng = random.Random(6)
    for _ in range(150):
        entries = [(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 5))), rng.random() < 0.3) for _ in range(rng.randint(1, 8))]
        vocab, automaton = {tuple([*t] + [256] * e) for t, e in entries}, op9_wordpiece.LongestMatch(entries)
        for _ in range(40):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
            assert automaton.count(w) == brute_pieces(w, vocab)


def test_piece_counts(docs, none):
    text = op10_bpe.tokenizer_text("word_bpe_49k.json")
    vocab = {tuple([*t] + [256] * e) for t, e in op9_wordpiece.vocabulary(text)}
    rows = op9_wordpiece.piece_counts(docs, text).collect()
    assert len(rows) == docs.count()
    for r in rows:
        counts = [brute_pieces(w, vocab) for w in (r.text or "").encode().lower().split() if len(w) < 100]
        if len(counts) == r.n_words:
            assert (r.n_pieces, r.n_unknown) == (sum(counts) + counts.count(0), counts.count(0))
    assert op9_wordpiece.piece_counts(none, text).count() == 0


def test_clashing_columns_nulls_and_long_texts(spark):
    """What other columns are called changes nothing; null ids, repeated rows, long texts."""
    rng = random.Random(21)
    long = " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(40_000)) + " " + "q" * 30_000
    rows = [(1, "some words here and there"), (1, "some words here and there"), (None, "no id"), (2, None), (3, long), (4, "")]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string")
    names = ("score", "n_tokens", "round", "chunk", "key", "units", "fp", "fingerprint", "component_id", "first", "n", "n_words", "n_pieces", "id")
    clash = plain.select("*", *[F.lit("x").alias(c) for c in names])
    vocab = op10_bpe.tokenizer_text("word_bpe_49k.json")
    for f in (op2_lm.scored, op4_simhash.near_duplicates, lambda d: op9_wordpiece.piece_counts(d, vocab, keep=["doc_id"])):
        a, b = (sorted(str({k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()}) for r in f(d).collect()) for d in (plain, clash))
        assert a == b and len(a) == len(rows)
    near = {r.doc_id: r for r in op4_simhash.near_duplicates(plain).collect()}
    assert near[2].component_id == near[4].component_id == 2 and near[None].component_id is None and int(near[3].fingerprint, 16) == brute_print(long)
    pieces, table = {tuple([*t] + [256] * e) for t, e in op9_wordpiece.vocabulary(vocab)}, {}
    counts = {r.doc_id: r for r in op9_wordpiece.piece_counts(plain, vocab).collect()}
    def greedy(word):
        if word not in table:  # entries have 30 symbols at most, so places further on needn't be tried
            i, n, s = 0, 0, [*word, 256]
            while n >= 0 and i < len(s):
                j = next((j for j in range(min(len(s), i + 40), i, -1) if tuple(s[i:j]) in pieces), None)
                i, n = (j, n + 1) if j else (len(s), -1)
            table[word] = max(n, 0)
        return table[word]
    assert max(map(len, pieces)) <= 40
    got = [greedy(w) for w in long.encode().split()]
    assert (counts[3].n_words, counts[3].n_pieces, counts[3].n_unknown) == (len(got), sum(got) + got.count(0), got.count(0))
    talk = [(1, 0, "user", long), (1, 1, "assistant", long + "<|x|>"), (None, None, None, None)]
    chat = spark.createDataFrame([(*r, "f", "t", 1) for r in talk], "conv_id bigint, turn bigint, role string, text string, formatted string, turns string, pieces int")
    back = {r.conv_id: r for r in op3_chat.parsed(op3_chat.formatted(chat)).collect()}
    assert [t.text for t in back[1].turns] == [long, long + "<|x|>"] and back[1].loss_text == long + "<|x|>" and len(back) == 2


# pipeline --------------------------------------------------------------------------
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    p.quality(spark, docs, sf).write.parquet(f"file://{tmp_path}/q")
    kept = spark.read.parquet(f"file://{tmp_path}/q")
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    one = p.deduplicate(spark, kept, sf)
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(brute_components(sorted(texts), {i: brute_print(t) for i, t in texts.items()}).values()))
    last = p.token_ids(spark, p.mixture(spark, one, sf), sf)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(last.columns) and last.count() > 0
    for r in last.limit(50).collect():
        assert hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256 and len(r.ids) == r.n_tokens
    assert [k for k, _ in p.STAGES] == ["quality_rules", "near_duplicates", "source_mix", "bpe_round_trip"]


def test_pipeline_edges(spark, tmp_path, none):
    """Nulls, repeated rows, a very long text, clashing columns, an empty table."""
    import corpus_pipeline as p

    rng = random.Random(4)
    def prose(n, k=0):
        return " ".join(rng.choice(("river", "stone", "light", "walks", "under", "green")) + str(rng.randint(0, 400 + k)) for _ in range(n))
    texts = [prose(80), prose(90), prose(60_000), None, "", prose(70)]
    rows = [(1, texts[0], "en", "a", 1, True, "x"), (1, texts[0], "en", "a", 1, True, "x"), (None, texts[1], "en", None, 1, True, "x"), (3, texts[2], "en", "b", 1, True, "x"), (4, None, "en", "b", 1, True, "x"), (5, "", "en", "b", 1, True, "x"), (6, texts[5], None, "a", 1, True, "x")]
    schema = "doc_id bigint, text string, lang string, source string, size int, kept boolean, component_id string"
    sf = f"file://{tmp_path}"
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (6, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = p.quality(spark, docs, sf)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} <= {1, None, 3, 6}
    two = p.deduplicate(spark, docs, sf)
    assert two.columns == docs.columns and collections.Counter(r.doc_id for r in two.collect()) == {1: 1, None: 1, 3: 1, 4: 1, 6: 1}
    assert p.mixture(spark, two, sf).columns == docs.columns
    out = p.run(spark, sf).collect()
    tok = library(op10_bpe.tokenizer_text())
    of = {r[0]: r[1] for r in rows}
    assert out and all(r.ids == tok.encode(of[r.doc_id] or "", add_special_tokens=False).ids for r in out)
    empty = f"{sf}/empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{empty}/labels.parquet")
    assert p.run(spark, empty).count() == 0
