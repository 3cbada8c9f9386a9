"""A log-bilinear language model, trained by noise-contrastive estimation in numpy.

Tokens are words with A-Z lower-cased, then one end for each text. The model predicts
units: SHORTLIST frequent words, CLASSES classes of all others by their ending, and the
end. From the two units before a token it predicts a vector, q = Q[u1] C1 + Q[u2] C2, and
gives unit u the score q . R[u] + b[u]; its logarithm's sum over all units, worked out by
batched matrix products for every pair of units, normalises it. In a class a word has the
share (c + 1) / (n + v + 1) of the class's n training tokens and v words; the rest is an
unknown word's, so probabilities of all words and one unknown word a class add up to 1.

Counts cover every training token. Words travel as 64-bit hashes (two of a million words
share one with a chance under 3e-8). Texts are dealt to chunks of bounded size; the
distinct words of a chunk are joined with the counts and meet its texts again, so no task
holds the vocabulary. Training makes one pass over all training tokens in ROUNDS rounds:
each partition trains from the same parameters, and Spark averages what they reach.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, table, written

SHORTLIST, CLASSES = 767, 256
UNITS = SHORTLIST + CLASSES + 1
END, BEGIN = UNITS - 1, UNITS
DIM, NOISE, BATCH, RATE = 16, 48, 2048, 0.15
#: Remainders of crc32 mod 7 that each round trains on; together all but the held out.
HELD_OUT, ROUNDS = 2, ((0,), (1, 3), (4, 5, 6))
#: Characters of text in a chunk, about.
CHUNK_CHARS = 12_000_000


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()  # bytes.lower() changes A-Z only


def ending(word: bytes) -> int:
    """A word's class: by its last two bytes before a full stop or comma, and whether there is one."""
    stem = word.rstrip(b".,;:!?")
    return zlib.crc32(stem[-2:] + (b"." if len(stem) < len(word) else b"")) % CLASSES


def hashed(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_digest

    return np.frombuffer(b"".join(map(xxh64_digest, words)), ">u8").astype(np.uint64).view(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """key, class, c of every word of docs.text; tasks count before they send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = list(held)
            rows = pa.RecordBatch.from_arrays([pa.array(hashed(words)), pa.array([ending(w) for w in words], pa.int32()), pa.array(list(held.values()), pa.int64())], ["key", "class", "c"])
            held.clear()
            return rows

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(tokens(text))
                if len(held) > 500_000:  # bounds a task's memory
                    yield out()
        if held:
            yield out()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "key bigint, class int, c bigint").groupBy("key", "class").agg(F.sum("c").alias("c"))


def chunk_words(tagged: DataFrame) -> DataFrame:
    """chunk, key: the distinct words of each chunk of tagged (doc_id, text, chunk, round)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, set[bytes]] = {}

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(held), np.int64), [len(s) for s in held.values()])), pa.array(hashed([w for s in held.values() for w in s]))], ["chunk", "key"])
            held.clear()
            return rows

        for batch in batches:
            for chunk, text in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(chunk, set()).update(tokens(text))
            if sum(map(len, held.values())) > 1_000_000:
                yield out()
        if held:
            yield out()

    return tagged.mapInArrow(run, "chunk bigint, key bigint").distinct()


def initial(shares: np.ndarray, seed: int = 2) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {"Q": rng.normal(0, 0.3, (UNITS + 1, DIM)), "R": rng.normal(0, 0.1, (UNITS, DIM)), "b": np.log(shares), "C": np.stack([np.eye(DIM), np.eye(DIM)]) * 0.5}


def flat(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in ("Q", "R", "b", "C")])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in (("Q", (UNITS + 1, DIM)), ("R", (UNITS, DIM)), ("b", (UNITS,)), ("C", (2, DIM, DIM))):
        n = int(np.prod(shape))
        out[k], at = values[at : at + n].reshape(shape), at + n
    return out


def contexts(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units one and two before each of a text's units."""
    one = np.concatenate([[BEGIN], units[:-1]])
    return one, np.concatenate([[BEGIN], one[:-1]])


def added(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index."""
    return np.stack([np.bincount(index, weights=rows[:, j], minlength=n) for j in range(rows.shape[1])], axis=1)


class Trainer:
    """Noise-contrastive estimation with Adagrad; a batch's tokens share their noise."""

    def __init__(self, model: dict[str, np.ndarray], noise: np.ndarray, seed: int):
        self.m = {k: v.astype(np.float32) for k, v in model.items()}
        self.seen = {k: np.full(v.shape, 0.01, np.float32) for k, v in self.m.items()}
        self.noise, self.offset = np.cumsum(noise), (np.log(NOISE) + np.log(noise)).astype(np.float32)
        self.rng = np.random.default_rng(seed)

    def step(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m, n = self.m, np.minimum(np.searchsorted(self.noise, self.rng.random(NOISE)), UNITS - 1)
        q1, q2 = m["Q"][one], m["Q"][two]
        q = q1 @ m["C"][0] + q2 @ m["C"][1]
        right = np.einsum("ij,ij->i", q, m["R"][w]) + m["b"][w] - self.offset[w]
        wrong = q @ m["R"][n].T + (m["b"][n] - self.offset[n])
        up = 1 / (1 + np.exp(np.clip(right, -30, 30)))  # 1 - p(data)
        down = 1 / (1 + np.exp(-np.clip(wrong, -30, 30)))
        size = np.float32(1 / len(w))
        g = up[:, None] * m["R"][w] - down @ m["R"][n]
        grad = {
            "R": added(w, up[:, None] * q, UNITS) - added(n, down.T @ q, UNITS),
            "b": np.bincount(w, weights=up, minlength=UNITS) - np.bincount(n, weights=down.sum(axis=0), minlength=UNITS),
            "Q": added(one, g @ m["C"][0].T, UNITS + 1) + added(two, g @ m["C"][1].T, UNITS + 1),
            "C": np.stack([q1.T @ g, q2.T @ g]),
        }
        for k, d in grad.items():
            d = (d * size).astype(np.float32)
            self.seen[k] += d * d
            m[k] += RATE * d / np.sqrt(self.seen[k])


def train(coded: DataFrame, shares: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters after all rounds; coded has units (binary) and round of every document."""
    model, sc = initial(shares), coded.sparkSession.sparkContext
    for number, own in enumerate(ROUNDS):
        start = sc.broadcast(flat(model))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(shaped(start.value), shares, 1000 * number + TaskContext.get().partitionId())
            held, size, total = [], 0, 0

            def steps() -> None:
                w, one, two = (np.concatenate(x).astype(np.int64) for x in zip(*held))
                order = trainer.rng.permutation(len(w))
                for i in range(0, len(w), BATCH):
                    some = order[i : i + BATCH]
                    trainer.step(w[some], one[some], two[some])

            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    units = np.frombuffer(raw, "<u2")
                    held.append((units, *contexts(units)))
                    size, total = size + len(units), total + len(units)
                    if size >= 64 * BATCH:
                        steps()
                        held, size = [], 0
            if held:
                steps()
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(start.value), dtype=np.int32)), pa.array(flat(trainer.m).astype(np.float64) * total), pa.array(np.full(len(start.value), total, np.int64))], ["i", "v", "n"])

        got = coded.where(F.col("round").isin(*own)).select("units").mapInArrow(run, "i int, v double, n bigint").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).toArrow()
        if len(got):  # one row for each parameter
            values = flat(model)
            values[got["i"].to_numpy()] = got["v"].to_numpy()
            model = shaped(values)
    return model


def normalisers(model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of a unit by the one before and by the one before that (the bias is in the
    first), and the log of their sum over units for every pair: a matrix product each."""
    one, two = (((model["Q"] @ model["C"][k]) @ model["R"].T).astype(np.float32) for k in (0, 1))
    one += model["b"].astype(np.float32)
    top_one, top_two = one.max(axis=1, keepdims=True), two.max(axis=1, keepdims=True)
    total = np.exp(one - top_one) @ np.exp(two - top_two).T
    return one, two, np.log(total) + top_one + top_two.T


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Null text counts as empty (its end is its one token) and a null doc_id as the empty
    text; repeated rows count as often as they stand. Columns besides doc_id and text go,
    whatever their names; texts of any length are scored whole; words that are equally
    frequent stand in the order of their hashes. Without training documents all counts are
    0 and the model is that of an unknown word; an empty table gives no row.
    """
    spark = docs.sparkSession
    part = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7).cast("int")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), part.alias("round"))
    chars, documents = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count_if(F.col("round") != HELD_OUT)).first()
    counts = written(word_counts(rows.where(F.col("round") != HELD_OUT)), "counts")
    frequent = counts.orderBy(F.desc("c"), "key").limit(SHORTLIST).collect()  # SHORTLIST rows
    keys = np.array(sorted((r["key"] for r in frequent)), np.int64)
    of_key = {r["key"]: k for k, r in enumerate(frequent)}
    unit_of = np.array([of_key[k] for k in keys.tolist()], np.int64)
    listed = spark.createDataFrame([(int(k),) for k in keys], "key bigint")
    by_class = counts.join(F.broadcast(listed), "key", "left_anti").groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # CLASSES rows
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        n_class[r["class"]], v_class[r["class"]] = r["n"], r["v"]
    n = int(sum(r["c"] for r in frequent) + n_class.sum()) + documents
    v = len(frequent) + int(v_class.sum()) + (1 if documents else 0)
    per_unit = np.ones(UNITS)
    per_unit[: len(frequent)] += [r["c"] for r in frequent]
    per_unit[SHORTLIST:END] += n_class
    per_unit[END] += documents
    shares = per_unit / per_unit.sum()

    chunks = max(1, -(-chars // CHUNK_CHARS))
    tagged = rows.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), "round").repartition("chunk")
    known = chunk_words(tagged).join(counts.select("key", "c"), "key").select("chunk", "key", "c")

    def code(texts: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found["key"].to_numpy())
        have, times = found["key"].to_numpy()[order], found["c"].to_numpy()[order]
        number: dict[bytes, int] = {}
        per_doc = [[number.setdefault(w, len(number)) for w in tokens(t)] for t in texts["text"].to_pylist()]
        words = list(number)
        key = hashed(words)

        def look(sorted_: np.ndarray, values: np.ndarray, missing: int) -> np.ndarray:
            if not len(sorted_) or not len(key):
                return np.full(len(key), missing, np.int64)
            at = np.minimum(np.searchsorted(sorted_, key), len(sorted_) - 1)
            return np.where(sorted_[at] == key, values[at], missing)

        c, unit = look(have, times, 0), look(keys, unit_of, -1)
        other = np.flatnonzero(unit < 0)
        class_ = np.array([ending(words[i]) for i in other], np.int64)
        unit[other] = SHORTLIST + class_
        inside = np.zeros(len(words))
        inside[other] = np.log10((c[other] + 1) / (n_class[class_] + v_class[class_] + 1))
        base = np.log10((c + 1) / (n + v + 1))
        end = np.log10((documents + 1) / (n + v + 1))
        out = []
        for ids in per_doc:
            at = np.array(ids, np.int64)
            out.append((len(at) + 1, int((c[at] > 0).sum()) + (documents > 0), float(base[at].sum() + end), float(inside[at].sum()), np.concatenate([unit[at], [END]]).astype("<u2").tobytes()))
        columns = list(zip(*out, strict=True))
        return pa.table({"doc_id": texts["doc_id"], "round": texts["round"], "n_tokens": pa.array(columns[0], pa.int64()), "n_known": pa.array(columns[1], pa.int64()), "base_score": columns[2], "inside": columns[3], "units": pa.array(columns[4], pa.binary())}) if out else _no_rows()

    coded = written(tagged.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(code, "doc_id bigint, round int, n_tokens bigint, n_known bigint, base_score double, inside double, units binary"), "units")
    dropped(counts)
    parts = spark.sparkContext.broadcast(normalisers(train(coded, shares)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_score, two_score, total = parts.value
        for batch in batches:
            out = []
            for raw, inside in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                units = np.frombuffer(raw, "<u2").astype(np.int64)
                one, two = contexts(units)
                out.append(inside + float((one_score[one, units] + two_score[two, units] - total[one, two]).sum(dtype=np.float64)) / np.log(10))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.float64())], ["doc_id", "round", "n_tokens", "n_known", "base_score", "score"])

    result = coded.select("doc_id", "round", "n_tokens", "n_known", "base_score", "units", "inside").mapInArrow(score, "doc_id bigint, round int, n_tokens bigint, n_known bigint, base_score double, score double")
    return result.select("doc_id", (F.col("round") == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")


def _no_rows() -> pa.Table:
    return pa.table({"doc_id": pa.array([], pa.int64()), "round": pa.array([], pa.int32()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "inside": pa.array([], pa.float64()), "units": pa.array([], pa.binary())})


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"))
