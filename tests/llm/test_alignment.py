"""Alignment of two tokenizers against the libraries and brute force."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest

from examina.llm import op11_alignment as op
from examina.llm.op10_bpe import tokenizer_text

TEXTS = [None, "", " ", "   ", "a", "a  b   c ", " lead", "<s> x </s> <unk> <0x0A>", "<|endoftext|> and <|endoftext|>", "a▁b", "\n\n x\t y  \r\n", "é" * 50, "日本語 текст 🙂", "don't 123 45,6 ...", "\x00a\x01", "x" * 5000,
         "the of and to in " * 40, "Das ist über alles. Êtes-vous là?", "café ﬁ 　   z", "a▁", "the of and to in " * 40]


def test_diagonal_groups_are_common_ends():
    rng = random.Random(2)
    for k in range(3000):
        n = rng.randint(1, 80)
        share = rng.choice([0.05, 0.5, 0.95])
        ea = sorted({e for e in range(1, n) if rng.random() < 0.6} | {n})
        eb = sorted({e for e in ea if rng.random() < share} | {e for e in range(1, n) if rng.random() < 1 - share} | {n})
        ga, gb = op.diagonal_groups(np.array(ea), np.array(eb))
        assert [ea[i - 1] for i in ga] == [eb[i - 1] for i in gb] == sorted(set(ea) & set(eb))


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_text())
    tok.encode_special_tokens = True
    return tok, SentencePieceProcessor(model_proto=op.piece_model())


def brute(text, libraries):
    """ids of both sides as groups, by the ends of bytes that both have."""
    tok, sp = libraries
    letters = op.byte_letters()
    a = tok.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
    b = sp.encode(text) if text else []
    ba = [bytes(letters[c] for c in tok.id_to_token(i)) for i in a]
    bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not text or b"".join(ba) != b" " + text.encode() or b"".join(bb) != b" " + text.encode():
        return []
    ends = [np.cumsum([len(x) for x in side]).tolist() for side in (ba, bb)]
    common = sorted(set(ends[0]) & set(ends[1]))
    low, out = 0, []
    for c in common:
        out.append(tuple([i for i, e in zip(ids, es) if low < e <= c] for ids, es in zip((a, b), ends)))
        low = c
    return out


def test_query_equals_libraries(spark, libraries, tmp_path):
    rng = random.Random(7)
    texts = TEXTS + [" ".join("".join(rng.choice("abcdeéèlnort.,#") for _ in range(rng.randint(1, 9))) for _ in range(60)) for _ in range(30)]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "no id here", 1, "x"), (4, "a", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_a int, links string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = [(i, brute(t, libraries)) for i, t, *_ in rows]
    assert sum(bool(g) for _, g in found) > 40 and not dict(found)[9] and not dict(found)[19]  # a mark of spaces in a text is changed
    counts = collections.Counter((a[-1], b[-1]) for _, g in found for a, b in g)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    want = []
    for i, g in found:
        links = [(a[-1], b[-1]) for a, b in g]
        spelled = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        want.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(spelled.encode()).hexdigest() if g else ""))
    got = op.op11_token_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    spelled = op.alignments(df, tokenizer_text(), op.piece_model(), keep=["doc_id", "text"]).where("doc_id = 13").first()
    assert spelled.groups == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in dict(found)[13])
    rows = op.alignments(df.limit(0), tokenizer_text(), op.piece_model())
    assert rows.count() == 0 and op.link_sums(rows, 32000, ["doc_id"]).count() == 0


def test_small_caches_give_the_same_ids(libraries):
    both = op.encoder(tokenizer_text(), op.piece_model())
    tok, sp = libraries
    texts = [t for t in TEXTS if t and "▁" not in t] + [" ".join(f"w{i * k % 97}." for i in range(50)) for k in range(5)]
    for capacity in (1, 3, 40, 10_000):
        small = op.Encoder(both.a, both.b, capacity)
        for some in (texts, texts[::-1], *([t] for t in texts)):
            for t, (x, y) in zip(some, small.batch(some), strict=True):
                assert x.tolist() == tok.encode(" " + t, add_special_tokens=False).ids and y.tolist() == sp.encode(t)
            assert len(small.index) <= capacity and len(small.ids[0]) == len(small.index) and not small.index.extra
        assert [len(x) for x, _ in small.batch(["", "a▁b", "fine a▁ b", "▁  ▁", "fine"])] == [0, 0, 0, 0, len(tok.encode(" fine", add_special_tokens=False).ids)]


def test_pairs_are_bounded_by_the_vocabularies():
    """A pair is a token and a suffix of it, so there are as many as suffixes that are tokens, at most."""
    both = op.encoder(tokenizer_text(), op.piece_model())
    a, b = both.a, both.b
    known_a, known_b = set(a.bytes), set(b.bytes)
    pairs = sum(t[k:] in known_b for t in a.bytes for k in range(len(t))) + sum(t[k:] in known_a for t in b.bytes for k in range(1, len(t)))
    assert pairs < a.length.sum() + b.length.sum()
