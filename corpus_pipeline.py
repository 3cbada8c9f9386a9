"""A corpus pipeline: quality rules, near-duplicates, source mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept,
and returns a DataFrame; all but the last return the columns of documents, whatever else
those are. Null and empty texts fail the quality rules, a null doc_id or source is kept
like any other, repeated rows become one in near_duplicates, ties there go to the smaller
doc_id, then text digest, texts of any length are whole, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from examina.llm.common import dropped, reread, scratch, table
from examina.llm.op4_simhash import without_duplicates
from examina.llm.op5_quality import quality_rules
from examina.llm.op8_mixing import mix
from examina.llm.op10_bpe import encode_decode, tokenizer_text


#: Columns that stages read; others have their names kept out of an operator's way.
READ = ("doc_id", "text", "source")


def apart(docs: DataFrame) -> DataFrame:
    """docs with neutral names for the columns that no operator reads."""
    return docs.toDF(*[c if c in READ else f"column_{k}" for k, c in enumerate(docs.columns)])


def back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from rows, which an operator made from apart(docs)."""
    return rows.select(apart(docs).columns).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the n-gram classifier reject go."""
    return back(quality_rules(apart(docs), table(spark, sf_dir, "labels")).where("kept"), docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document of smallest doc_id stays."""
    return back(without_duplicates(apart(docs)), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, dealt to shards and shuffled there."""
    return back(mix(apart(docs)), docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids, with their digest and that of the text decoded from them."""
    return encode_decode(docs, tokenizer_text(), keep=["doc_id", "source"], with_ids=True, with_text=False)


STAGES = [("quality_rules", quality), ("near_duplicates", deduplicate), ("source_mix", mixture), ("bpe_round_trip", token_ids)]

#: The classifier, the components and the encoder are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next; a stage's
    table goes once the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out, path = stage(spark, docs, sf_dir), scratch(spark, f"stage-{name}")
        out.write.parquet(path)
        dropped(docs)
        docs = reread(spark, out.schema, path)
    return STAGES[-1][1](spark, docs, sf_dir)
