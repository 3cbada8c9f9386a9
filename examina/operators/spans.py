"""Many queries in many texts: every span, in the text's own offsets, ranked."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Texts and queries that one task compares at a time.
TEXTS, QUERIES = 500, 20_000


def folded(text: str) -> str:
    """Lower case letter by letter: as long as the text, so places stay; a letter whose
    lower case is longer stays as it is."""
    if text.isascii():
        return text.lower()
    return "".join(low if len(low := c.lower()) == 1 else c for c in text)


def _shards(rows: DataFrame, name: str, size: int) -> DataFrame:
    """Each scope's number of shards."""
    return rows.groupBy("scope").agg(F.ceil(F.count("*") / size).alias(name))


def search(queries: DataFrame, texts: DataFrame, overlapping: bool = True) -> DataFrame:
    """scope, text_id, query_id, start_char, end_char, rank of every place where a query
    (scope, query_id, query) stands in a text (scope, text_id, text) of its scope, case
    ignored; rank numbers a text's spans by length, longest first, then place, then query.

    A scope's texts are dealt to shards of about TEXTS, its queries of about QUERIES, and a
    task runs one automaton over all queries of its cell, so it holds no more of a large
    scope. Overlapping places all count, unless `overlapping` is False: then a query's places
    in a text are taken from left to right, each from the end of the one before on. Null and
    empty queries and texts have no place, rows that come twice have theirs twice, a null
    scope is none.
    """
    q = queries.where("query <> ''").select("scope", F.col("query_id").cast("bigint").alias("query_id"), F.col("query").cast("string").alias("query"))
    t = texts.where("text <> ''").select("scope", F.col("text_id").cast("bigint").alias("text_id"), F.col("text").cast("string").alias("text"))
    sizes = _shards(q, "nq", QUERIES).join(_shards(t, "nt", TEXTS), "scope")
    left = q.join(sizes, "scope").withColumn("i", F.pmod(F.xxhash64("query_id", "query"), F.col("nq"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nt") - 1))).drop("nq", "nt")
    right = t.join(sizes, "scope").withColumn("j", F.pmod(F.xxhash64("text_id", "text"), F.col("nt"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nq") - 1))).drop("nq", "nt")

    def run(asked: pa.Table, read: pa.Table) -> pa.Table:
        import ahocorasick

        found: list[tuple[int, int, int, int]] = []
        if len(asked) and len(read):
            ids: dict[str, list[int]] = {}
            for i, query in zip(asked.column("query_id").to_pylist(), asked.column("query").to_pylist(), strict=True):
                ids.setdefault(folded(query), []).append(i)
            automaton = ahocorasick.Automaton()
            for query, own in ids.items():
                automaton.add_word(query, (len(query), own))
            automaton.make_automaton()
            for i, text in zip(read.column("text_id").to_pylist(), read.column("text").to_pylist(), strict=True):
                past: dict[int, int] = {}  # of a query's rows, which share a list, the end of the place before
                for end, (n, own) in automaton.iter(folded(text)):
                    if overlapping or end + 1 - n >= past.get(id(own), 0):
                        past[id(own)] = end + 1
                        found += [(i, query, end + 1 - n, end + 1) for query in own]
        columns = [list(c) for c in zip(*found, strict=True)] or [[]] * 4
        scope = pa.array([asked.column("scope")[0].as_py()] * len(found) if found else [], asked.schema.field("scope").type)
        return pa.table([scope, *[pa.array(c, pa.int64()) for c in columns]], ["scope", "text_id", "query_id", "start_char", "end_char"])

    kind = q.schema["scope"].dataType.simpleString()
    cells = ["scope", "i", "j"]
    spans = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(run, f"scope {kind}, text_id bigint, query_id bigint, start_char bigint, end_char bigint")
    order = W.partitionBy("scope", "text_id").orderBy(F.desc(F.col("end_char") - F.col("start_char")), "start_char", "query_id")
    return spans.withColumn("rank", F.row_number().over(order).cast("bigint"))
