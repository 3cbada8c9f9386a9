"""Chat formatting with Spark expressions only: turns of a conversation are collected as
structs and sorted, neighbours of one role are merged, and everything is concatenated.

    <|turn|>role<|text|>text<|next|>text of the same role<|end|>\\n ...

Control strings are those that start with `<|`. In a role or a text, `<|` gets a
backslash in its middle, and `<`, backslashes, `|` one backslash more, so no `<|` is left
and nothing else changes; taking one backslash away restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, reread, table

#: The template's control strings.
TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>\n"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def formatted(rows: DataFrame, trained: str = TRAINED) -> DataFrame:
    """Of rows (conv_id, turn, role, text): conv_id, formatted, loss_mask.

    loss_mask has the places (start from 0, length, in code points) of the texts of the
    trained role in formatted. Turns stand in ascending order, nulls first, those with one
    number by role and text; each row is a turn, repeated ones too. A null role or text
    counts as empty. Null conv_ids are one conversation. A conversation is one value, so
    its turns meet in one task whatever the plan; no task needs two of them. Texts of any
    length are whole, columns besides the four go, and an empty table gives no row.
    """
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    talks = (rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
             .groupBy("conv_id").agg(turns.alias("turns")))

    def opening(t: Column, i: Column) -> Column:
        merged = (i > 0) & (F.get("turns", i - 1)["role"] == t["role"])
        return F.when(merged, F.lit(NEXT)).otherwise(F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(TURN), escaped(t["role"]), F.lit(TEXT)))

    pieces = F.transform("turns", lambda t, i: F.struct(opening(t, i).alias("open"), escaped(t["text"]).alias("text"), (t["role"] == trained).alias("trained")))
    place = F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("length"))
    mask = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.slice(F.array(place), 1, 0).alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["open"]) + F.length(p["text"])).alias("at"),
            F.when(p["trained"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(p["open"])).alias("start"), F.length(p["text"]).cast("bigint").alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    whole = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["open"], p["text"])), ""), F.lit(END))
    return talks.select("conv_id", pieces.alias("pieces")).select("conv_id", whole.alias("formatted"), mask.alias("loss_mask"))


def parsed(talks: DataFrame) -> DataFrame:
    """Adds turns, array<struct<role, text>>, one for each input row, and loss_text, all that the mask covers."""
    own = F.split("formatted", END.replace("|", r"\|"))
    blocks = F.slice(own, 1, F.size(own) - 1)

    def turns(block: Column) -> Column:
        role = unescaped(F.substring_index(F.substring(block, len(TURN) + 1, 1 << 30), TEXT, 1))
        texts = F.split(F.element_at(F.split(block, TEXT.replace("|", r"\|")), 2), NEXT.replace("|", r"\|"))
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    covered = F.transform("loss_mask", lambda s: unescaped(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    return talks.withColumn("turns", F.flatten(F.transform(blocks, turns))).withColumn("loss_text", F.array_join(covered, ""))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    out, path = formatted(rows.unionByName(more)), scratch(spark, "chat")
    out.write.parquet(path)
    back = parsed(reread(spark, out.schema, path))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS merged,
         length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS text_chars, length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) AS role_chars
  FROM rows)
SELECT conv_id, count(*)::bigint AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::bigint AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       sum(text_chars + CASE WHEN merged THEN 8 ELSE 24 + role_chars END)::bigint AS formatted_chars
FROM marked GROUP BY conv_id
"""
