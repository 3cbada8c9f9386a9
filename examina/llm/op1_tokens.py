"""Token-ID output: Simple-8b words in blocks, written as a table of blocks.

A 64-bit word holds a selector in its top four bits and, in the other 60, as many ids as
fit at the selector's width. A value too wide for 60 bits is escaped: selector 0, then
the value in a word of its own. A block row holds whole documents in order:

    part, block      place in the output; a block belongs to the task that wrote it
    part_start       ids of the part before this block
    n_ids            ids in the block
    doc_ids          the documents, ascending
    lengths          ids of each document, as Simple-8b words
    words            the ids, as Simple-8b words
    offsets          uint32: ids before every STRIDE-th word, so that words can be decoded from any of them on;
                     the top bit is set where that word is an escaped value

Reading cuts a block at offsets: the words of many strides are a matrix whose rows decode
independently, as each starts at its offset.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chunks import ChunkEncoder
from .common import reread, scratch, table, without
from .op10_bpe import byte_letters

#: Fixed values of the format: ids in a word and bits of each, by selector; 0 escapes.
PACKS = ((1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
STRIDE = 256
#: Added to an offset whose word is the value of an escape before it.
ESCAPED = 1 << 31
BLOCK_IDS = 131_072
#: Ids that reading decodes at a time, about; documents stay whole.
READ_IDS = 32_768
#: Chunks that a Python worker's cache holds: the CPU seconds of a larger corpus depend on it.
CACHE = 1_000_000
_WIDTHS = np.array([b for _, b in PACKS[1:]], np.uint64)
_COUNTS = np.array([n for n, _ in PACKS], np.int64)
SCHEMA = "part int, block int, part_start bigint, n_ids bigint, doc_ids array<bigint>, lengths binary, words binary, offsets binary"


def _classes(values: np.ndarray) -> np.ndarray:
    """The selector of the narrowest width that holds each value; 16 for an escape."""
    limits = np.left_shift(np.uint64(1), _WIDTHS)  # a value below limits[k] fits selector k + 1
    return (np.searchsorted(limits, values, side="right") + 1).astype(np.uint8)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words of values, and how many values stand before each word.

    Every word takes the most values that fit. Values of 2^60 and over take two words.
    """
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    need = np.zeros(n + 128, np.uint8)  # the padding fits anywhere
    if values.max() < 1 << 17:
        need[:n] = _classes(np.arange(int(values.max()) + 1, dtype=np.uint64))[values.astype(np.int64)]
    else:
        need[:n] = _classes(values)
    most = {1: need}  # the widest among the next k values
    for k, a, b in ((2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 4, 1), (6, 4, 2), (7, 4, 3), (8, 4, 4), (10, 8, 2), (12, 8, 4), (15, 8, 7), (20, 10, 10), (30, 15, 15), (60, 30, 30), (120, 60, 60)):
        left, right = most[a], most[b]
        most[k] = np.maximum(left[: len(right) - a], right[a:])
    step, chosen = np.ones(n, np.uint8), np.full(n, 15, np.uint8)
    chosen[need[:n] == 16] = 0
    for selector in range(14, 0, -1):
        k = PACKS[selector][0]
        fits = np.zeros(n, bool)
        have = most[k][:n]
        fits[: len(have)] = have <= selector
        if fits.any():
            step[fits], chosen[fits] = k, selector
    at, i, ahead = [], 0, step.tobytes()
    while i < n:
        at.append(i)
        i += ahead[i]
    at = np.array(at, np.int64)
    picked = chosen[at]
    place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(picked == 0)[:-1]])
    words = np.zeros(len(at) + int((picked == 0).sum()), np.uint64)
    starts = np.zeros(len(words), np.int64)
    padded = np.concatenate([values, np.zeros(128, np.uint64)])
    for selector in np.unique(picked):
        rows = np.flatnonzero(picked == selector)
        k, bits = PACKS[selector]
        if selector == 0:
            words[place[rows] + 1] = values[at[rows]]
            starts[place[rows] + 1] = at[rows] + 1
        else:
            word = np.full(len(rows), np.uint64(selector) << np.uint64(60), np.uint64)
            for j in range(k if bits else 0):
                word |= padded[at[rows] + j] << np.uint64(j * bits)
            words[place[rows]] = word
        starts[place[rows]] = at[rows]
    return words, starts


def strides(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The offsets of words, of which pack() said how many values stand before each."""
    return (starts[::STRIDE].astype(np.uint32) + _literals(words)[::STRIDE] * np.uint32(ESCAPED)).astype("<u4")


def _literals(words: np.ndarray, first: bool = False) -> np.ndarray:
    """Which words are values that an escape precedes; first: whether words[0] is one."""
    literal = np.zeros(len(words), bool)
    literal[:1] = first
    zeros = np.flatnonzero((words >> np.uint64(60)) == 0)
    i = int(first and len(zeros) > 0 and zeros[0] == 0)
    while i < len(zeros):  # the word after an escape is no selector
        if zeros[i] + 1 < len(words):
            literal[zeros[i] + 1] = True
        i = np.searchsorted(zeros, zeros[i] + 2)
    return literal


def unpack(words: np.ndarray, n: int, first: bool = False, starts: np.ndarray | None = None) -> np.ndarray:
    """The n values that pack() put into words; every selector's words decode at once.

    first: words[0] is the value of an escape before words, and is passed over. starts:
    values before every STRIDE-th of words, counted from words[0] on, so that every stride
    counts for itself; without it they are summed up over all words.
    """
    words = np.asarray(words, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    literal = _literals(words, first)
    counts = np.where(literal, 0, _COUNTS[selectors])
    if starts is None:
        place = np.cumsum(counts) - counts
    else:
        rows = np.zeros(-(-len(counts) // STRIDE) * STRIDE, np.int64)
        rows[: len(counts)] = counts
        rows = rows.reshape(-1, STRIDE)[: len(starts)]
        place = (np.cumsum(rows, axis=1) - rows + starts[:, None]).ravel()
    out = np.zeros(n + 128, np.uint64)
    for selector in np.unique(selectors[~literal]):
        rows = np.flatnonzero((selectors == selector) & ~literal)
        k, bits = PACKS[selector]
        at = place[rows]
        if selector == 0:
            out[at] = words[rows + 1]
        elif bits:
            mask = np.uint64((1 << bits) - 1)
            for j in range(k):
                out[at + j] = (words[rows] >> np.uint64(j * bits)) & mask
    return out[:n]


def ids_between(words: np.ndarray, offsets: np.ndarray, low: int, high: int, n: int) -> np.ndarray:
    """Ids low..high of a block of n, decoded from the last offset at or before low on."""
    before, follows = (offsets & np.uint32(ESCAPED - 1)).astype(np.int64), offsets >= ESCAPED
    a, b = int(np.searchsorted(before, low, side="right")) - 1, int(np.searchsorted(before, high))
    begin, end, last = before[a], n, len(words)
    if b < len(before):
        end, last = before[b], b * STRIDE + int(follows[b])  # with the value of an escape that ends a stride
    found = unpack(words[a * STRIDE : last], int(end - begin), bool(follows[a]), before[a:b] - begin)
    return found[low - begin : high - begin]


_ENCODERS: dict[str, ChunkEncoder] = {}


def library_encoder(tokenizer_json: str) -> ChunkEncoder:
    """A chunk encoder over the tokenizers library, one for each Python worker."""
    key = str(zlib.crc32(tokenizer_json.encode()))
    if key not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(tokenizer_json)
        tok.no_truncation()
        tok.no_padding()
        special = {t.content: np.array([i], "<u4").tobytes() for i, t in tok.get_added_tokens_decoder().items()}

        model, letter = tok.model.tokenize, {b: c for c, b in byte_letters().items()}

        def encode(strings: list[str]) -> list[bytes]:
            """A space and letters are one piece, which the library's model takes as it is; anything else goes through the whole library."""
            out, rest = [b""] * len(strings), []
            for k, s in enumerate(strings):
                if s[:1] == " " and s[1:].isalpha():
                    ids = [t.id for t in model(s.encode().decode("latin-1").translate(letter))]
                    out[k] = struct.pack(f"<{len(ids)}I", *ids)
                else:
                    rest.append(k)
            for i in range(0, len(rest), 2000):
                some = rest[i : i + 2000]
                for k, e in zip(some, tok.encode_batch_fast([strings[k] for k in some], add_special_tokens=False), strict=True):
                    out[k] = struct.pack(f"<{len(e.ids)}I", *e.ids)
            return out

        _ENCODERS[key] = ChunkEncoder(encode, special, CACHE)
    return _ENCODERS[key]


def write_blocks(docs: DataFrame, tokenizer_json: str, path: str, end_id: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Encodes docs.text, appends end_id to each and writes the blocks to path.

    Null text counts as empty; rows come in ascending order of doc_id (nulls first),
    those with one doc_id by text. Every range of doc_ids is one task's part, so parts
    ascend too. No row is left out and no text is cut; an empty table gives no block.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(shared.value)
        part, block, before = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        ids: list[bytes] = []
        owners: list[int | None] = []
        lengths: list[int] = []
        held = 0

        def full() -> pa.RecordBatch:
            nonlocal block, before, ids, owners, lengths, held
            words, starts = pack(np.frombuffer(b"".join(ids), "<u4"))
            row = [part, block, before, held, owners, pack(np.array(lengths, np.uint64))[0].tobytes(), words.tobytes(), strides(words, starts).tobytes()]
            out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "block", "part_start", "n_ids", "doc_ids", "lengths", "words", "offsets"])
            block, before, ids, owners, lengths, held = block + 1, before + held, [], [], [], 0
            return out

        for batch in batches:
            for i in range(0, len(batch), 512):
                some = batch.slice(i, 512)
                texts = [t or "" for t in some.column(1).to_pylist()]
                for doc, own in zip(some.column(0).to_pylist(), encoder.batch(texts), strict=True):
                    ids += (own, end)
                    owners.append(doc)
                    lengths.append(len(own) // 4 + 1)
                    held += lengths[-1]
                    if held >= block_ids:
                        yield full()
        if owners:
            yield full()

    (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
     .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(encode, SCHEMA).write.parquet(path))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of the blocks at path: doc_id, start, n_tokens, ids_crc32.

    A part's start is the sum over the parts before it: one row for each part, of which
    there are as many as tasks wrote, is summed up and joined to the blocks.
    """
    blocks = reread(spark, _schema(), path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = parts.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))).alias("before"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                lengths = unpack(np.frombuffer(row["lengths"], np.uint64), len(row["doc_ids"])).astype(np.int64)
                words, offsets = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["offsets"], "<u4")
                ends = np.cumsum(lengths)
                sums: list[int] = []
                while len(sums) < len(lengths):
                    a = len(sums)
                    low = int(ends[a] - lengths[a])
                    b = max(a + 1, int(np.searchsorted(ends, low + READ_IDS, side="right")))
                    raw = memoryview(ids_between(words, offsets, low, int(ends[b - 1]), row["n_ids"]).astype("<u4").tobytes())
                    sums += [zlib.crc32(raw[4 * (e - n - low) : 4 * (e - low)]) for e, n in zip(ends[a:b].tolist(), lengths[a:b].tolist(), strict=True)]
                first = (row["before"] or 0) + row["part_start"]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(first + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return (blocks.join(F.broadcast(starts), "part")  # a row for each task that wrote
            .select("before", "part_start", "n_ids", "doc_ids", "lengths", "words", "offsets")
            .mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))


def _schema():
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(SCHEMA)


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer_json = f.read()
    path = scratch(spark, "op1")
    write_blocks(without(table(spark, sf_dir, "documents"), "lang", "source", "n_chars"), tokenizer_json, path)
    return read_blocks(spark, path)
