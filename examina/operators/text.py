"""Text reuse between passages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..adapters import Tables
from ..shared import dropped, written

# What a leading header begins with, in brackets or before a colon.
HEADERS = ("TRIAGE", "INVESTIGATION", "NOTE", "CLOSURE", "ACTION")
PREFIXES = ("NOTE", "DISPOSITION")
# Words by which a match is explained.
PLAYBOOK = ("playbook", "automated", "scanner", "script", "rule", "signature", "cron")
BENIGN = ("benign", "false positive", "authorized", "maintenance", "normal activity")
EXTERNAL = ("vendor", "external", "soc-tier3", "cert", "forensic lab", "third-party")
# Keys of an action's details that hold a narrative.
NARRATIVE_KEYS = ("notes", "triage_notes", "description", "summary", "comment")
# Words that turn a statement round.
NEGATIONS = ("not", "never", "no", "neither")
#: Words of a chunk and of the step from one to the next.
CHUNK_WORDS, STEP_WORDS = 195, 170


def tokens(text: Column) -> Column:
    """The ASCII tokens of lower-cased text. A run of letters, digits, _ and - with any
    other letter in it is none; hyphens at its ends go."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_-]+)"), 1)
    return F.filter(F.transform(F.filter(runs, lambda r: r.rlike("^[a-z0-9_-]+$")), lambda r: F.regexp_replace(r, "^-+|-+$", "")), lambda r: r != "")


def normalized(text: Column) -> Column:
    """One leading header goes, white space is one space, lower case."""
    header = rf"(?i)^(\[({'|'.join(HEADERS)})[^\]]*\]\s*|" + "|".join(rf"{p}:\s*" for p in PREFIXES) + ")"
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, header, ""), r"\s+", " ")))


def shingles(words: Column) -> Column:
    """Distinct bigrams; single words of a text with one."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 1)), F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 1)), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(F.size(words) < 2, words).otherwise(pairs))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection by union of two shingle sets; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / union).otherwise(0.0)


def passages(t: Tables) -> DataFrame:
    """Narrative texts of cases that count (disposition, root cause, title) and of
    actions: the values of NARRATIVE_KEYS in their details, else the kind of action."""
    from .rules import valid

    says = [F.when(F.coalesce(F.trim(c), F.lit("")) != "", c) for c in map(F.col, ("disposition", "root_cause", "title"))]
    texts = F.array(F.concat(F.lit("Disposition: "), says[0]), F.when(F.col("root_cause") != "UNKNOWN", F.concat(F.lit("Root cause: "), says[1])), says[2])
    of_cases = valid(t.cases).select("submission_id", F.concat(F.lit("case:"), F.col("case_id")).alias("record"), "case_id", F.explode(F.array_compact(texts)).alias("text"))
    found = F.array(*[F.nullif(F.trim(F.get_json_object("details", f"$.{k}")), F.lit("")) for k in NARRATIVE_KEYS])
    acted = t.actions.join(t.cases.select("case_id", "submission_id"), "case_id").withColumn("texts", F.array_compact(found))
    kind = F.array(F.concat(F.lit("Action: "), F.col("action_type")))
    of_actions = acted.select("submission_id", F.concat(F.lit("action:"), F.col("action_id")).alias("record"), "case_id", F.explode(F.when(F.size("texts") > 0, F.col("texts")).otherwise(F.array_compact(kind))).alias("text"))
    return of_cases.unionByName(of_actions).select("submission_id", "record", "case_id", F.trim("text").alias("text")).where("text <> ''")


def chunks(docs: DataFrame) -> DataFrame:
    """Overlapping windows of words with exact character spans; the last one
    reaches the end. doc_id, chunk, start_char, end_char, words."""
    found = F.regexp_extract_all("text", F.lit(r"(\S+)"), 1)
    gaps = F.split("text", r"\S+")
    words = docs.select("doc_id", F.posexplode(F.arrays_zip(found.alias("w"), F.slice(gaps, 1, F.size(found)).alias("g"))).alias("i", "p"))
    w = W.partitionBy("doc_id").orderBy("i")
    spans = words.select("doc_id", "i", F.length("p.w").alias("n"), F.sum(F.length("p.w") + F.length("p.g")).over(w).alias("end"), F.count("*").over(W.partitionBy("doc_id")).alias("total"))
    last = F.greatest(F.lit(0), F.ceil((F.col("total") - CHUNK_WORDS) / STEP_WORDS)).cast("int")
    ids = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("i") - (CHUNK_WORDS - 1)) / STEP_WORDS).cast("int")), F.least(last, F.floor(F.col("i") / STEP_WORDS).cast("int")))
    placed = spans.withColumn("chunk", F.explode(F.when((F.col("i") - (CHUNK_WORDS - 1)) / STEP_WORDS <= F.least(last, F.floor(F.col("i") / STEP_WORDS)), ids)))
    return placed.groupBy("doc_id", "chunk").agg(F.min(F.col("end") - F.col("n")).alias("start_char"), F.max("end").alias("end_char"), F.count("*").alias("words"))


def exact_copies(docs: DataFrame) -> DataFrame:
    """T5: documents whose tokens agree, by the digest of the tokens; the first is their source."""
    d = docs.select("doc_id", F.sha2(F.array_join(tokens(F.col("text")), " "), 256).alias("key"), F.size(tokens(F.col("text"))).alias("n")).where("n > 0")
    return d.withColumn("first", F.min("doc_id").over(W.partitionBy("key"))).where("doc_id <> first").select("doc_id", "first")


def lexical_pairs(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of different shingle sets with a Jaccard of `least` or more.

    Shingles travel as 64-bit hashes. Equal sets are one row beforehand, so copies make no
    pairs among each other. A pair that reaches `least` shares one of the rarest
    n - ceil(least n) + 1 shingles of each side, so only those are joined. What a pair shares
    beyond these lies in what one side has left of its own, so a pair goes for which they and
    that are too few, before any set is read. What is left is compared exactly in groups, to
    which a set goes once and not once a pair. Every step is written, and its shuffle files
    go when it ends.
    """
    d = docs.select("doc_id", F.transform(shingles(tokens(F.col("text"))), lambda g: F.xxhash64(g)).alias("s")).where(F.size("s") > 0)
    whole = F.array_sort(F.array_distinct("s"))
    d = written(d.select("doc_id", whole.alias("s")).groupBy(F.size("s").alias("n"), F.md5(F.array_join("s", ",")).alias("set")).agg(F.min("doc_id").alias("doc_id"), F.first("s").alias("s")).drop("set"), "shingles")
    rows = d.select("doc_id", "n", F.explode("s").alias("g"))
    df = written(rows.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"), "shingle-counts")
    common = written(rows.hint("merge").join(df.hint("merge"), "g"), "common-shingles")
    dropped(df)
    # shingles of one document alone come first in the order of rarity; they are in no other's list
    w = W.partitionBy("doc_id")
    alone = F.col("n") - F.count("*").over(w)
    rank = alone + F.row_number().over(w.orderBy("df", "g"))
    prefix = written(common.withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("doc_id", "n", "g"), "rare-shingles")
    dropped(common)
    a, b = (prefix.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), "g") for x in "ab")
    met = a.hint("merge").join(b.hint("merge"), "g").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * least))
    left = F.greatest(F.ceil(F.col("na") * least), F.ceil(F.col("nb") * least)) - 1
    need = F.ceil(F.round(F.lit(least / (1 + least)) * (F.col("na") + F.col("nb")), 9))
    near = written(met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c")).where(F.col("c") + left >= need).select("a", "b", "na", "nb"), "near-sets")
    dropped(prefix)
    return compared(near, d.select("doc_id", "s"), least)


#: Shingles of a part of a group that a task holds; it compares two parts at a time.
HELD = 4_000_000


def compared(near: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b, score of pairs near (a, b, na, nb, the sizes of their sets) whose sets
    (doc_id, s: sorted and distinct) have a Jaccard of `least` or more.

    A pair's group is the smallest document that its first has a pair with, so a cluster
    is one group or few and a set goes to few groups. Groups of over HELD shingles are cut
    into parts, and a task takes two parts.
    """
    pivot = near.select(F.col("a").alias("doc_id"), F.col("b").alias("o")).unionByName(near.select(F.col("b").alias("doc_id"), F.col("a").alias("o"))).groupBy("doc_id").agg(F.min("o").alias("o"))
    pivot = pivot.select(F.col("doc_id").alias("a"), F.least("doc_id", "o").alias("group"))
    grouped = written(near.hint("merge").join(pivot.hint("merge"), "a"), "grouped-pairs")
    members = grouped.select("group", F.col("a").alias("doc_id"), F.col("na").alias("n")).unionByName(grouped.select("group", F.col("b").alias("doc_id"), F.col("nb").alias("n"))).distinct()
    parts = written(members.groupBy("group").agg(F.ceil(F.sum("n") / HELD).alias("parts")), "group-parts")

    def part(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.col("parts"))

    pairs = grouped.hint("merge").join(parts.hint("merge"), "group").select("group", F.least(part("a"), part("b")).alias("i"), F.greatest(part("a"), part("b")).alias("j"), "a", "b")
    asked = pairs.select("group", "i", "j", F.col("a").alias("doc_id")).unionByName(pairs.select("group", "i", "j", F.col("b").alias("doc_id"))).distinct()
    held = asked.hint("merge").join(sets.hint("merge"), "doc_id").select(*[F.col(c).alias(c) for c in (*asked.columns, "s")])  # names of its own: both sides of a cogroup come from pairs

    def score(given: pa.Table, read: pa.Table) -> pa.Table:
        a, b, scores = [], [], []
        if len(given) and len(read):
            own = dict(zip(read["doc_id"].to_pylist(), (x.values.to_numpy() for chunk in read["s"].chunks for x in chunk), strict=True))
            for x, y in zip(given["a"].to_pylist(), given["b"].to_pylist(), strict=True):
                both = len(np.intersect1d(own[x], own[y], assume_unique=True))
                jaccard_ = both / (len(own[x]) + len(own[y]) - both)
                if jaccard_ >= least:
                    a.append(x), b.append(y), scores.append(jaccard_)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "score": pa.array(scores, pa.float64())})

    cell = ["group", "i", "j"]
    return pairs.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(score, "a bigint, b bigint, score double")


def other_records(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs (a, b) less those of one record and of equal texts of one source; records:
    doc_id, record_id, source_id, text."""
    def side(x: str) -> DataFrame:
        return records.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("record_id", "source_id")], F.sha2(F.trim("text"), 256).alias(f"text_{x}"))  # a pair carries no text

    j = pairs.join(side("a"), "a").join(side("b"), "b")
    again = (F.col("record_id_a") == F.col("record_id_b")) | ((F.col("source_id_a") == F.col("source_id_b")) & (F.col("text_a") == F.col("text_b")))
    return j.where(~F.coalesce(again, F.lit(False))).select(*pairs.columns)


def tf_cosine(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Cosine of sublinear term counts of given pairs (a, b); tokens of two characters or more."""
    words = docs.select("doc_id", F.explode(F.filter(tokens(F.col("text")), lambda x: F.length(x) > 1)).alias("w")).groupBy("doc_id", "w").agg((1 + F.ln(F.count("*"))).alias("tf"))
    norms = words.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    a, b = words.select(F.col("doc_id").alias("a"), "w", F.col("tf").alias("ta")), words.select(F.col("doc_id").alias("b"), "w", F.col("tf").alias("tb"))
    dots = pairs.select("a", "b").join(a, "a").join(b, ["b", "w"]).groupBy("a", "b").agg(F.sum(F.col("ta") * F.col("tb")).alias("dot"))
    return (dots.join(norms.select(F.col("doc_id").alias("a"), F.col("norm").alias("na")), "a").join(norms.select(F.col("doc_id").alias("b"), F.col("norm").alias("nb")), "b")
            .select("a", "b", F.least(F.lit(1.0), F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine")))


#: Vectors of a block of queries and of a block of candidates.
VECTOR_BLOCK = 4096


def nearest_vectors(vectors: DataFrame, every: int = 20, most: int = 5, least: float = 0.15, block: int = VECTOR_BLOCK) -> DataFrame:
    """For vectors whose id is divisible by `every`, the `most` of highest cosine
    (a dot product, vectors are unit) among all others, whatever their label; ties by id.

    Each block of queries meets each block of candidates of its dimension once, in a
    matrix product that leaves `most` a query; these are merged. Vectors that are null
    or hold a null have no score.
    """
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    v = v.where(F.col("vec_id").isNotNull() & F.forall("x", lambda e: e.isNotNull())).withColumn("dim", F.size("x"))
    query = F.col("vec_id") % every == 0
    n = v.agg(F.count("*").alias("all"), F.count_if(query).alias("queries")).first()
    q_blocks, c_blocks = max(1, -(-n["queries"] // block)), max(1, -(-n["all"] // block))
    deal = F.xxhash64("vec_id", "x")
    q = v.where(query).select("dim", F.pmod(deal, F.lit(q_blocks)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(c_blocks - 1).cast("bigint"))).alias("cb"), "vec_id", "x")
    c = v.select("dim", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q_blocks - 1).cast("bigint"))).alias("qb"), F.pmod(deal, F.lit(c_blocks)).alias("cb"), "vec_id", "x")

    def best(queries: pa.Table, others: pa.Table) -> pa.Table:
        targets, ids, scores = [], [], []
        if len(queries) and len(others):
            dim = queries["dim"][0].as_py()
            qid, oid = (t["vec_id"].to_numpy() for t in (queries, others))
            qx, ox = (t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), dim) for t in (queries, others))
            by_id = np.argsort(oid, kind="stable")
            oid, ox = oid[by_id], ox[by_id]
            for i in range(0, len(qid), 256):
                dots = np.round(qx[i : i + 256] @ ox.T, 6)
                dots[qid[i : i + 256, None] == oid] = -np.inf
                floor = np.maximum(np.partition(dots, -most, axis=1)[:, -most] if len(oid) > most else -np.inf, least)
                for k, (row, at_least) in enumerate(zip(dots, np.broadcast_to(floor, len(dots)), strict=True)):
                    found = np.flatnonzero(row >= at_least)
                    found = found[np.argsort(-row[found], kind="stable")[:most]]
                    targets += [int(qid[i + k])] * len(found)
                    ids += oid[found].tolist()
                    scores += row[found].tolist()
        return pa.table({"target": pa.array(targets, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})

    keys = ["dim", "qb", "cb"]
    scored = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(best, "target bigint, vec_id bigint, score double")
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("target").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= most)


def negation_mismatch(a: Column, b: Column) -> Column:
    """Whether one token list has a negation and the other none."""
    words = F.array(*map(F.lit, NEGATIONS))
    return F.arrays_overlap(a, words) != F.arrays_overlap(b, words)


def composite(exact: Column, semantic: Column, lexical: Column, distance: Column, negation: Column) -> Column:
    """0.6 semantic + 0.4 lexical, at least 0.85 for a near digest, at most 0.60 for a
    far one, at most 0.45 if negations differ; 1 for equal tokens."""
    s = 0.6 * semantic + 0.4 * lexical
    s = F.when(distance <= 30, F.greatest(s, F.lit(0.85))).when(distance > 150, F.least(s, F.lit(0.6))).otherwise(s)
    return F.when(exact, 1.0).otherwise(F.round(F.when(negation, F.least(s, F.lit(0.45))).otherwise(s), 4))


def explanation(target: Column, other: Column, score: Column) -> Column:
    """What a match may be, by words of either text, first match wins."""
    both = F.concat_ws("\n", F.lower(target), F.lower(other))
    def has(words: tuple) -> Column:
        return both.rlike("|".join(words))

    return (F.when(score < 0.35, "insufficient_evidence").when(has(PLAYBOOK), "possible_playbook_template").when(has(BENIGN), "possible_repeated_benign")
            .when(has(EXTERNAL), "possible_external_investigation").when(score > 0.7, "possible_playbook_template").otherwise("possible_repeated_benign"))


def find_spans(pairs: DataFrame) -> DataFrame:
    """Where query stands in text, case ignored, in the text's own offsets; the whole
    text if nowhere. `spans.search` finds many queries in many texts."""
    def fold(c: str) -> Column:
        """Lower case, letter by letter where a letter's lower case may be longer than it."""
        letters = F.transform(F.split(c, ""), lambda x: F.when(F.length(F.lower(x)) == 1, F.lower(x)).otherwise(x))
        return F.when(F.col(c).rlike(r"[^\x00-\x7F]"), F.array_join(letters, "")).otherwise(F.lower(c))

    at = F.call_function("locate", fold("query"), fold("text"))
    return pairs.withColumn("start_char", F.when(at > 0, at - 1).otherwise(0)).withColumn("end_char", F.when(at > 0, at - 1 + F.length("query")).otherwise(F.length("text")))


def digest_table(seed: int = 0) -> np.ndarray:
    """A permutation of bytes for locality digests. Pass the published table of a digest
    format to get digests of that format; this one only agrees with itself."""
    return np.random.default_rng(seed).permutation(256).astype(np.uint8)


def locality_digest(data: bytes, table: np.ndarray) -> str | None:
    """Checksum, log length, quartile ratios and 128 two-bit bucket codes of a text's
    five-byte windows; none for texts that are too short or too plain."""
    x = np.frombuffer(data, np.uint8)
    if len(x) < 50 or len(np.unique(x)) < 10:
        return None

    def mapped(salt: int, *parts: np.ndarray) -> np.ndarray:
        h = np.full(len(parts[0]), table[salt], np.uint8)
        for p in parts:
            h = table[h ^ p]
        return h

    c = [x[i : len(x) - 4 + i] for i in range(5)]
    sets = ((2, 0, 1, 2), (3, 0, 1, 3), (5, 0, 2, 3), (7, 0, 2, 4), (11, 0, 1, 4), (13, 0, 3, 4))
    counts = np.bincount(np.concatenate([mapped(s, *(c[k] for k in ks)) % 128 for s, *ks in sets]), minlength=128)
    if (counts > 0).sum() < 32:
        return None
    q1, q2, q3 = np.sort(counts)[[32, 64, 96]]
    if q3 == 0:
        return None
    check = 0
    lead = table[table[1] ^ c[0]]
    for a in table[lead ^ c[1]].tolist():
        check = int(table[a ^ check])
    rate = 0.05 if len(x) <= 656 else 0.04 if len(x) <= 3199 else 0.03
    codes = (counts > q1).astype(int) + (counts > q2) + (counts > q3)
    packed = (codes.reshape(32, 4) << np.array([0, 2, 4, 6])).sum(axis=1).astype(np.uint8)
    return f"T1{check:02X}{int(np.log(len(x)) / rate) % 256:02X}{int(q1 * 100 / q3) % 16:X}{int(q2 * 100 / q3) % 16:X}{packed.tobytes().hex().upper()}"


def digests(docs: DataFrame, table: np.ndarray | None = None) -> DataFrame:
    """doc_id, digest of every row."""
    shared = digest_table() if table is None else table

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([locality_digest((t or "").encode(), shared) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "digest"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, digest string")


def digest_distance(a: Column, b: Column) -> Column:
    """One for another checksum, the length step (twelvefold beyond one), the quartile
    ratios, and the differences of the two-bit codes."""
    def part(c: Column, at: int, n: int) -> Column:
        return F.conv(F.substring(c, at, n), 16, 10).cast("int")

    step = F.abs(part(a, 5, 2) - part(b, 5, 2))
    codes = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0), lambda s, i: s + _code_difference(F.conv(a.substr(i + 9, F.lit(1)), 16, 10).cast("int"), F.conv(b.substr(i + 9, F.lit(1)), 16, 10).cast("int")))
    return (part(a, 3, 2) != part(b, 3, 2)).cast("int") + F.when(step > 1, step * 12).otherwise(step) + F.abs(part(a, 7, 1) - part(b, 7, 1)) + F.abs(part(a, 8, 1) - part(b, 8, 1)) + codes


def _code_difference(x: Column, y: Column) -> Column:
    return F.abs(F.floor(x / 4) - F.floor(y / 4)).cast("int") + F.abs(x % 4 - y % 4)
