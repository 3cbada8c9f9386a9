"""Counts of greedy word pieces by a linear longest-match automaton.

The vocabulary is a trie. Where no longer entry can match at a node, its failure link
tells where matching goes on, and how many entries are complete by then is worked out
beforehand; so a word's pieces are counted in one pass over its bytes, and never built.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, without
from .op10_bpe import byte_letters, tokenizer_text

#: The symbol after a word's last byte.
END = 256
COLUMNS = {"n_words": "bigint", "n_pieces": "bigint", "n_unknown": "bigint"}


class LongestMatch:
    """entries: byte strings, and whether an entry ends a word (and then only fits there)."""

    def __init__(self, entries: Iterable[tuple[bytes, bool]], ends: bool = True):
        self.ends = ends
        self.next: dict[int, int] = {}  # node << 9 | symbol
        whole, children = {0: False}, {0: []}
        for text, last in entries:
            node = 0
            for symbol in [*text, *[END] * last]:
                after = self.next.get(node << 9 | symbol)
                if after is None:
                    after = len(whole)
                    self.next[node << 9 | symbol] = after
                    whole[after], children[after] = False, []
                    children[node].append((symbol, after))
                node = after
            if node:
                whole[node] = True
        self.fail = [-1] * len(whole)  # -1: no way on
        self.popped = [0] * len(whole)
        todo = deque([0])
        while todo:
            parent = todo.popleft()
            for symbol, node in children[parent]:
                todo.append(node)
                if whole[node]:
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                at, count = self.fail[parent], self.popped[parent]
                while at >= 0 and (at << 9 | symbol) not in self.next:
                    count += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.next[at << 9 | symbol], count

    def count(self, word: bytes) -> int:
        """The pieces of a word; 0 if greedy matching can't get through it."""
        step, fail, popped = self.next, self.fail, self.popped
        node = count = 0
        for symbol in [*word, END] if self.ends else word:
            after = step.get(node << 9 | symbol)
            while after is None:
                count += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
                after = step.get(node << 9 | symbol)
            node = after
        while node:
            count += popped[node]
            node = fail[node]
            if node < 0:
                return 0
        return count


class Counts(dict):
    """Piece counts of words seen; bounded, so more are counted anew."""

    def __init__(self, automaton: LongestMatch, capacity: int = 600_000):
        super().__init__()
        self.automaton, self.capacity = automaton, capacity

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word)
        if len(self) < self.capacity:
            self[word] = n
        return n


def vocabulary(tokenizer_json: str, end: str = "</w>") -> list[tuple[bytes, bool]]:
    """The entries of a byte-level vocabulary whose word ends are marked by `end`."""
    spec, letters = json.loads(tokenizer_json), byte_letters()
    special = {t["content"] for t in spec.get("added_tokens") or []}
    out = []
    for token in spec["model"]["vocab"]:
        stem = token.removesuffix(end)
        if token not in special and stem:
            out.append((bytes(letters[c] for c in stem), stem != token))
    return out


_COUNTS: dict[str, Counts] = {}


def piece_counts(docs: DataFrame, tokenizer_json: str, keep: list[str] | None = None) -> DataFrame:
    """Adds n_words, n_pieces and n_unknown to every row of docs; keep names the columns
    to pass on (all).

    Words are runs outside space and \\t..\\r with A-Z lower-cased. A word that greedy
    matching can't get through is one piece and unknown. Null and empty texts have none.
    Input columns with the names of added ones are left out; repeated rows stay, texts
    and words of any length count whole, and an empty table gives no row.
    """
    source = without(docs, *COLUMNS)
    kept = source.select([F.col(f"`{c}`") for c in (source.columns if keep is None else keep)])
    names = kept.columns
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = str(zlib.crc32(shared.value.encode()))
        if key not in _COUNTS:
            _COUNTS[key] = Counts(LongestMatch(vocabulary(shared.value)))
        look = _COUNTS[key].__getitem__
        for batch in batches:
            rows = []
            for text in batch.column(len(names)).to_pylist():
                counts = list(map(look, (text or "").encode("utf-8").lower().split()))  # bytes.lower() changes A-Z only
                unknown = counts.count(0)
                rows.append((len(counts), sum(counts) + unknown, unknown))
            new = [pa.array(v, pa.int64()) for v in (zip(*rows) if rows else [[]] * 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *new], [*names, *COLUMNS])

    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([*kept.schema.fields, *_parse_datatype_string(", ".join(f"{k} {v}" for k, v in COLUMNS.items())).fields])
    return source.select([F.col(f"`{c}`") for c in names] + [F.col("text").cast("string").alias("__text")]).mapInArrow(run, schema)


def op9_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_text("word_bpe_49k.json"), keep=["doc_id"])
