"""Alignment of two tokenizers' tokens by diagonal run skipping, and link counts.

Both token sequences of a text are arrays of byte ends. Where their tokens run one to
one, the arrays are equal at one shift of the index; doubling slices are compared at
that shift, so a stretch is jumped in a number of steps that is logarithmic in its
length. At a difference the group is closed by stepping whichever array is behind, and
the walk goes on at the new shift.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import _UNSAFE, SPACES, _Index
from .common import table, without, written
from .op1_tokens import library_encoder
from .op10_bpe import byte_letters, tokenizer_text

#: Parts of texts that a Python worker keeps; a bound of memory, not of results.
CACHE = 150_000
#: Parts that are encoded at a time.
JOINED = 64
_WHITE = re.compile(rf"[\s{SPACES}]")
#: The mark of a space in sentencepiece vocabularies.
SPACE = "▁"
COLUMNS = {"n_a": "bigint", "n_b": "bigint", "groups": "string", "links": "binary"}


#: Tokens that the first probe of a stretch compares.
FIRST = 16


def diagonal_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For two arrays of ascending byte ends with one last end: of each smallest group of
    tokens that ends together, how many tokens of each side lie before its end.

    Ends are compared as numbers of many digits, so a probe that fails tells its first
    difference at once.
    """
    ea, eb = ends_a.tolist(), ends_b.tolist()
    da, db = ends_a.astype(">u4").tobytes(), ends_b.astype(">u4").tobytes()
    number = int.from_bytes
    i, j, n, m = 0, 0, len(ea), len(eb)
    found = []  # stretches of groups of one token each but the first: tokens before their end, number of groups
    while i < n:
        at, step = i, FIRST
        while i < n and j < m:
            k = min(step, n - i, m - j)
            apart = number(da[4 * i : 4 * (i + k)]) ^ number(db[4 * j : 4 * (j + k)])
            same = k - (apart.bit_length() + 31) // 32
            i += same
            j += same
            if apart:
                break
            step *= 2
        if i > at:
            found.append((i, j, i - at))
        if i < n:
            a, b = ea[i], eb[j]
            while a != b:
                if a < b:
                    i += 1
                    a = ea[i]
                else:
                    j += 1
                    b = eb[j]
            i += 1
            j += 1
            found.append((i, j, 1))
    last_a, last_b, many = np.array(found, np.int64).reshape(-1, 3).T
    back = np.repeat(np.cumsum(many), many) - np.arange(1, many.sum() + 1)
    return np.repeat(last_a, many) - back, np.repeat(last_b, many) - back


class Side:
    """One tokenizer: ids of texts with a space before them, the bytes of its tokens, and how they are spelled."""

    def __init__(self, token_bytes: list[bytes], last: str):
        self.bytes = token_bytes
        self.length = np.array([len(t) for t in token_bytes], np.int64)
        self.size = len(token_bytes)
        #: Each token's id with a comma, then each one's with `last`, which ends its side of a group.
        self.spelled = np.array([f"{i}{c}" for c in (",", last) for i in range(self.size)], object)


class ByteLevel(Side):
    """A byte-level BPE model of the tokenizers library; special tokens are plain text."""

    def __init__(self, tokenizer_json: str):
        spec, letters = json.loads(tokenizer_json), byte_letters()
        special = {t["content"] for t in spec.get("added_tokens") or []}
        vocab = spec["model"]["vocab"]
        raw = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            raw[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        super().__init__(raw, "|")
        self.library = library_encoder(json.dumps(spec | {"added_tokens": []})).encode
        self.begins = np.array([t[:1] == b" " for t in raw])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of a space and each text, as little-endian uint32."""
        return self.library([" " + t for t in texts])

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """The same of parts without a space: those without any white space are encoded
        many at a time, joined by spaces, and each begins with the next token that does."""
        out, joined = [b""] * len(parts), []
        for k, p in enumerate(parts):
            if p and _WHITE.search(p) is None:
                joined.append(k)
            else:
                out[k] = self.encode([p])[0]
        runs = [joined[i : i + JOINED] for i in range(0, len(joined), JOINED)]
        for own, ids in zip(runs, self.encode([" ".join([parts[k] for k in own]) for own in runs]), strict=True):
            begins = np.flatnonzero(self.begins[np.frombuffer(ids, "<u4")]).tolist()
            for k, low, high in zip(own, begins, [*begins[1:], len(ids) // 4], strict=True):
                out[k] = ids[4 * low : 4 * high]
        return out


class Pieces(Side):
    """A sentencepiece BPE model that adds a space before a text."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(len(self.model))]
        super().__init__([bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)], ";")
        #: Whether no piece holds a space after another character.
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.space = np.array(self.model.encode("a ")[1:], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The same; an empty text is the space alone."""
        found = self.model.encode(texts, num_threads=1) if texts else []
        return [struct.pack(f"<{len(ids)}I", *ids) if t else self.space for t, ids in zip(texts, found, strict=True)]

    encode_parts = encode


class Encoder:
    """Both sides' ids of texts, through one bounded cache of the parts between spaces.

    Neither tokenizer has a token across a single space between other characters, so such
    texts are cut there and their parts, most of them seen before, are encoded once. Texts
    with several spaces in a row, or other white space beside one, are encoded whole; so
    are all if a model's pieces may hold inner spaces. What no longer fits in the cache is
    encoded anew in every call that has it, so ids don't depend on the cache.
    """

    def __init__(self, a: Side, b: Side, capacity: int):
        self.a, self.b = a, b
        self.index = _Index(capacity)
        self.ids: tuple[list[bytes], list[bytes]] = ([], [])
        self.changed: set[int] = set()  # parts of which a side changes a byte

    def whole(self, text: str, ids: bytes, side: Side) -> bool:
        """Whether a side's tokens spell a space and the text."""
        return b"".join(map(side.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())) == b" " + text.encode()

    def batch(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each text's ids of both sides; none where a side changes a byte, or of no text."""
        index, number = self.index, self.index.__getitem__
        plain = [bool(t) and self.b.apart and t[0] != " " and "  " not in t and not _UNSAFE.search(t) for t in texts]
        split = [list(map(number, t.split(" "))) if p else None for t, p in zip(texts, plain, strict=True)]
        new, base = index.pending, index.known
        for known, side in zip(self.ids, (self.a, self.b), strict=True):
            found = side.encode_parts(new)
            known += found
            if new and not self.whole(" ".join(new), b"".join(found), side):
                self.changed.update(base + k for k, (part, ids) in enumerate(zip(new, found, strict=True)) if not self.whole(part, ids, side))
        index.pending, index.known = [], base + len(new)
        none, out = np.zeros(0, "<u4"), []
        for text, own in zip(texts, split, strict=True):
            if own is not None:
                good = self.changed.isdisjoint(own)
                pair = [b"".join(map(known.__getitem__, own)) for known in self.ids] if good else None
            else:
                pair = [side.encode([text])[0] for side in (self.a, self.b)] if text else None
                good = bool(text) and all(self.whole(text, ids, side) for ids, side in zip(pair, (self.a, self.b), strict=True))
            out.append(tuple(np.frombuffer(ids, "<u4") for ids in pair) if good else (none, none))
        if index.extra:
            index.extra.clear()
            for known in self.ids:
                del known[len(index):]
            index.known = len(index)
            self.changed = {k for k in self.changed if k < len(index)}
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer_json: str, model: bytes) -> Encoder:
    """Both tokenizers, once for each Python worker."""
    key = f"{zlib.crc32(tokenizer_json.encode())}-{zlib.crc32(model)}"
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(ByteLevel(tokenizer_json), Pieces(model), CACHE)
    return _ENCODERS[key]


def aligned(ids_a: np.ndarray, ids_b: np.ndarray, a: Side, b: Side) -> tuple[int, int, str, bytes]:
    """n_a, n_b, groups, links of a text's tokens."""
    if not len(ids_a):
        return 0, 0, "", b""
    ga, gb = diagonal_groups(np.cumsum(a.length[ids_a]), np.cumsum(b.length[ids_b]))
    links = ids_a[ga - 1].astype("<i8") * b.size + ids_b[gb - 1]
    out = np.empty(len(ids_a) + len(ids_b), object)
    for side, ids, own, shift in ((a, ids_a, ga, np.concatenate([[0], gb[:-1]])), (b, ids_b, gb, ga)):
        last = np.zeros(len(ids), np.int64)
        last[own - 1] = side.size
        out[np.arange(len(ids)) + np.repeat(shift, np.diff(own, prepend=0))] = side.spelled[ids + last]
    return len(ids_a), len(ids_b), "".join(out.tolist())[:-1], links.astype("<i4").tobytes()


def alignments(docs: DataFrame, tokenizer_json: str, model: bytes, keep: list[str] | None = None) -> DataFrame:
    """Adds n_a, n_b, groups (`a1,a2|b1;a3|b2,b3`: ids of the tokens that end together)
    and links (int32 each, id of a * size of b's vocabulary + id of b: the two tokens that
    end a group) to every row of docs; keep names the columns to pass on (all).

    Null and empty texts, and texts of which either tokenizer changes a byte, have no
    tokens. Tokens hold a byte at least, so a group has one link. Input columns with the
    names of added ones are left out; every row gives one row, repeated ones and null ids
    too; texts of any length are whole, and an empty table gives no row. The product of
    both vocabularies must lie below 2^31.
    """
    source = without(docs, *COLUMNS, "__text")
    kept = source.select([F.col(f"`{c}`") for c in (source.columns if keep is None else keep)])
    names = kept.columns
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = encoder(*shared.value)
        a, b = both.a, both.b
        if a.size * b.size >= 1 << 31:
            raise ValueError("the product of both vocabularies must lie below 2^31")
        for whole in batches:
            for i in range(0, len(whole), 256):
                batch = whole.slice(i, 256)
                texts = [t or "" for t in batch.column(len(names)).to_pylist()]
                rows = [aligned(x, y, a, b) for x, y in both.batch(texts)]
                n_a, n_b, groups, links = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(groups, pa.string()), pa.array(links, pa.binary())], [*names, *COLUMNS])

    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([*kept.schema.fields, *_parse_datatype_string(", ".join(f"{k} {v}" for k, v in COLUMNS.items())).fields])
    return source.select([F.col(f"`{c}`") for c in names] + [F.col("text").cast("string").alias("__text")]).mapInArrow(run, schema)


def link_counts(rows: DataFrame) -> DataFrame:
    """pair, n: how many links of all rows (column links) hold each pair.

    Each task counts its own pairs first. Two tokens that end together lie one within the
    other, so a pair is a token and one of its suffixes: there are no more pairs than both
    vocabularies have bytes, whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, sums = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in batches:
            own = np.frombuffer(b"".join(x for x in batch.column(0).to_pylist() if x), "<i4")
            new, n = np.unique(own, return_counts=True)
            pairs, where = np.unique(np.concatenate([pairs, new]), return_inverse=True)
            sums = np.bincount(where, np.concatenate([sums, n]), len(pairs)).astype(np.int64)  # exact below 2^53
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(sums)], ["pair", "n"])

    return rows.select("links").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def link_sums(rows: DataFrame, size_b: int, keep: list[str]) -> DataFrame:
    """The columns keep of rows (which have `links`) with n_links, n_best (links whose
    count is the highest of their b id) and count_sum (the sum of the links' counts).

    The counts are broadcast; `link_counts` bounds them by the vocabularies.
    """
    counted = link_counts(rows).toArrow()
    pairs, n = counted.column("pair").to_numpy(), counted.column("n").to_numpy()
    order = np.argsort(pairs)
    pairs, n = pairs[order], n[order]
    most = np.zeros(size_b, np.int64)
    np.maximum.at(most, pairs % size_b, n)
    shared = rows.sparkSession.sparkContext.broadcast((pairs, n, n == most[pairs % size_b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in batches:
            sizes = np.array([len(x) // 4 if x else 0 for x in batch.column(len(keep)).to_pylist()], np.int64)
            at = np.searchsorted(pairs, np.frombuffer(b"".join(x for x in batch.column(len(keep)).to_pylist() if x), "<i4"))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            sums, bests = np.concatenate([[0], np.cumsum(n[at])]), np.concatenate([[0], np.cumsum(best[at])])
            new = [pa.array(sizes), pa.array(bests[ends[1:]] - bests[ends[:-1]], pa.int64()), pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], [*keep, "n_links", "n_best", "count_sum"])

    kept = rows.select(*keep)
    schema = kept.schema.add("n_links", "long").add("n_best", "long").add("count_sum", "long")
    return rows.select(*keep, "links").mapInArrow(run, schema)


def piece_model(name: str = "piece_bpe_32k.model") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sentencepiece import SentencePieceProcessor

    model = piece_model()
    rows = alignments(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_text(), model)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    stored = written(rows.select("doc_id", "n_a", "n_b", digest.alias("groups_sha256"), "links"), "links")
    keep = ["doc_id", "n_a", "n_b", "groups_sha256"]
    return link_sums(stored, len(SentencePieceProcessor(model_proto=model)), keep).select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")
