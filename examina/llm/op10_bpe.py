"""Byte-level BPE by backtracking, and decoding through an offset table.

An Aho-Corasick automaton over the vocabulary finds the tokens at every place of a
piece. The encoder takes the longest token at its place if it may stand beside the one
before it, else the next shorter one, and steps back where none fits; places from which
no way leads on are marked, so each is left once and the work is linear. Two tokens may
stand side by side if merging their bytes in rank order leaves them apart, which walking
down their two merge trees shows. The result is that of merging in rank order.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ChunkEncoder
from .common import table, without

#: Fixed value: how byte-level BPE cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Chunks that a Python worker's cache holds; workers of a pipeline keep it beside the other stages' memory.
CACHE = 250_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it
    is printable Latin-1, else the next unused one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """The tables of a byte-level BPE model in the tokenizers library's JSON."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        size = 1 + max([*vocab.values(), *self.special.values()])
        raw = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                raw[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            raw[i] = token.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
        self.blob = np.frombuffer(b"".join(raw), np.uint8)
        # order: a byte's is below every merge's; merges keep their rank
        self.order: dict[int, int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        of_bytes = {t: i for i, t in enumerate(raw) if t and i not in self.special.values()}
        for b in range(256):
            if bytes([b]) in of_bytes:
                i = of_bytes[bytes([b])]
                self.order[i], self.split[i] = b, (i, i)
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            i = vocab[left + right]
            if i in self.split:
                raise ValueError(f"two merges make {left + right!r}")
            self.split[i], self.order[i] = (vocab[left], vocab[right]), 256 + rank
            self.pairs[vocab[left], vocab[right]] = 256 + rank
        self.compatible: dict[tuple[int, int], bool] = {}
        self.made = {self.order[i]: i for i in self.order}
        kept = {t: i for t, i in of_bytes.items() if i in self.split and (len(t) == 1 or self.merged(t, of_bytes) == [i])}
        self.whole = {t.decode("latin-1"): i for t, i in kept.items()}
        self.length = {i: len(t) for t, i in kept.items()}
        self.shorter: dict[int, int] = {}
        for t, i in kept.items():
            for n in range(len(t) - 1, 0, -1):
                if t[:n] in kept:
                    self.shorter[i] = kept[t[:n]]
                    break
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for t, i in self.whole.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()

    def merged(self, raw: bytes, of_bytes: dict[bytes, int]) -> list[int]:
        """Merging in rank order, step by step; used on vocabulary entries only."""
        ids = [of_bytes[bytes([b])] for b in raw]
        while len(ids) > 1:
            best = min((self.pairs.get(p, 1 << 60), k) for k, p in enumerate(zip(ids, ids[1:])))
            if best[0] == 1 << 60:
                break
            ids[best[1] : best[1] + 2] = [self.made[best[0]]]
        return ids

    def beside(self, left: int, right: int) -> bool:
        """The pair-compatibility table, filled as pairs come up and of bounded size."""
        found = self.compatible.get((left, right))
        if found is None:
            found = self.apart(left, right)
            if len(self.compatible) < 150_000:
                self.compatible[left, right] = found
        return found

    def apart(self, left: int, right: int) -> bool:
        """Whether left and right stay apart when their bytes are merged in rank order."""
        order, split, pairs = self.order, self.split, self.pairs
        limit = 1 << 60
        while True:
            if pairs.get((left, right), limit) < limit:
                return False
            # undo the later of the two last merges; a merge across must not come before it
            if order[left] > order[right]:
                limit, parts = order[left], split[left]
                if parts[1] != left:
                    left = parts[1]
                    continue
                turn = "right"
            else:
                limit, parts = order[right] + 1, split[right]
                if parts[0] != right:
                    right = parts[0]
                    continue
                turn = "left"
            if turn == "right":
                parts, limit = split[right], order[right] + 1
                if parts[0] == right:
                    return True
                right = parts[0]
            else:
                parts, limit = split[left], order[left]
                if parts[1] == left:
                    return True
                left = parts[1]

    def piece(self, text: str) -> list[int]:
        """The ids of a piece, given as one Latin-1 character for each byte."""
        if text in self.whole:
            return [self.whole[text]]
        size, at, out = len(text), 0, []
        longest: list[int | None] = [None] * size
        for end, (i, n) in self.automaton.iter(text):
            longest[end - n + 1] = i  # ends come in ascending order: the last is the longest
        open_ = bytearray(b"\1" * (size + 1))
        token = longest[0]
        length, shorter, beside = self.length, self.shorter, self.beside
        while at < size:
            if token is None:
                raise ValueError("a byte without a token")
            last = out[-1] if out else None
            while True:
                end = at + length[token]
                if open_[end] and (last is None or beside(last, token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < size else None
                    break
                if token in shorter:
                    token = shorter[token]
                    continue
                open_[at] = 0
                token = out.pop()
                at -= length[token]
                break
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered from the offset table."""
        ids = ids.astype(np.int64)
        begin = self.offsets[ids]
        sizes = self.offsets[ids + 1] - begin
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(begin - (ends - sizes), sizes) + np.arange(total)].tobytes()


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_MODELS: dict[str, tuple[Bpe, ChunkEncoder]] = {}


def model(tokenizer_json: str) -> tuple[Bpe, ChunkEncoder]:
    """The tables and a chunk encoder over them, one for each Python worker."""
    key = str(zlib.crc32(tokenizer_json.encode()))
    if key not in _MODELS:
        import regex

        bpe, cut = Bpe(tokenizer_json), regex.compile(PIECES).findall
        known: dict[str, bytes] = {}

        def encode(strings: list[str]) -> list[bytes]:
            out = []
            for s in strings:
                ids = b""
                for p in cut(s):
                    own = known.get(p)
                    if own is None:
                        own = packed(bpe.piece(p.encode().decode("latin-1")))
                        if len(p) <= 3:
                            known[p] = own  # few, so bounded
                    ids += own
                out.append(ids)
            return out

        _MODELS[key] = (bpe, ChunkEncoder(encode, {t: np.array([i], "<u4").tobytes() for t, i in bpe.special.items()}, CACHE))
    return _MODELS[key]


def encode_decode(docs: DataFrame, tokenizer_json: str, keep: list[str] | None = None, with_ids: bool = True, with_text: bool | None = None) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>) and
    decoded (as ids, unless with_text says otherwise) to every row of docs; keep names the
    columns to pass on (all).

    Null text counts as empty: no ids, and the digests of nothing. Input columns with
    the names of added ones are left out. Every row gives one row, repeated ones too;
    texts of any length are encoded whole, and an empty table gives no row.
    """
    with_text = with_ids if with_text is None else with_text
    added = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if with_ids else {}) | ({"decoded": "string"} if with_text else {})
    source = without(docs, *added, "__text")
    kept = source.select([F.col(f"`{c}`") for c in (source.columns if keep is None else keep)])
    kept_fields = kept.schema
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    columns = kept.columns
    fed = source.select([F.col(f"`{c}`") for c in columns] + [F.col("text").cast("string").alias("__text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = model(shared.value)
        for whole in batches:
            for i in range(0, len(whole), 512):
                batch = whole.slice(i, 512)
                encoded = encoder.batch([t or "" for t in batch.column(len(columns)).to_pylist()])
                arrays = [np.frombuffer(e, "<u4") for e in encoded]
                decoded = [bpe.decode(a).decode("utf-8", "replace") for a in arrays]
                new = [pa.array([len(a) for a in arrays], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in encoded]), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded])]
                if with_ids:
                    new.append(pa.array([a.astype(np.int32) for a in arrays], pa.list_(pa.int32())))
                if with_text:
                    new.append(pa.array(decoded, pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *new], [*columns, *added])

    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([*kept_fields.fields, *_parse_datatype_string(", ".join(f"{k} {v}" for k, v in added.items())).fields])
    return fed.mapInArrow(run, schema)


def tokenizer_text(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_text(), keep=["doc_id"], with_ids=False)
