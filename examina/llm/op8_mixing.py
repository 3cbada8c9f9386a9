"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents stand in an order permuted by a digest of their id, cut into BLOCKS
blocks by that digest. Its target asks for so many whole passes over it and a part of
one more, which ends in one block, at the document where the words come nearest to the
target. The blocks drawn, by source and pass, are the quotas; a binary tree over the output shards splits
each node's quotas between its halves by a multivariate hypergeometric draw, so the
shards' quotas add up exactly. A source's blocks, permuted again, then go to the shards
in disjoint runs as long as the quotas, and rows are shuffled within their shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, dropped, reread, scratch, table, without, written

#: Weights of the sources, by code point of their name, null last; repeated as needed.
WEIGHTS = (5, 2, 1)
#: A source gives no more than this many times its words.
MOST = 3
BLOCKS = 1024
SHARDS = 16
SEED = 8
#: Groups of sources that the tree on the driver splits; a group's quotas are then split among its sources by one task each.
GROUPS = 1024
#: Columns that plan() or mix() add; input columns with these names are left out.
ADDED = ("size", "source_size", "target", "digest", "block", "copies", "pass", "shard", "place", "__key")


def with_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds `target` to sizes (source, source_size): shares of all words by weight, none
    above `most` times its source's words, the excess reshared by weight.

    Sources whose limit is small for their weight are capped first: in the order of
    limit / weight a source is capped if an equal share of what the ones before it leave
    would exceed its limit. One row for each source; the window over all of them is as
    small as that.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    ranked = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size").cast("double"))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    levelled = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") < F.col("cap"))
    shared = F.max(F.when(F.col("free"), F.col("level"))).over(W.partitionBy())  # the first free source's; later ones assume it capped
    return levelled.select("source", "source_size", "w", F.when(F.col("free"), F.col("w") * shared).otherwise(F.col("cap")).alias("target"))


def plan(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target, digest, block and copies added: how many times
    the mix takes a row. A lazy DataFrame over docs and one small row for each source.

    Size is the number of words; null text has none. A null source is a source. Rows with
    one doc_id are rows of their own that lie side by side. Input columns with the names
    of added ones are left out. Without any words every target and every copy is 0.
    """
    docs = without(docs, *ADDED)
    sized = (docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint"))
             .withColumn("digest", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
             .withColumn("block", F.floor(F.conv(F.substring("digest", 1, 3), 16, 10).cast("int") * BLOCKS / 4096).cast("int"))  # in the order of digests
             .withColumn("source", F.col("source").cast("string")))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = written(sized.select(key.alias("__key"), "source", "block", "digest", F.col("doc_id").cast("bigint").alias("doc_id"), "size"), "sizes")
    sums = rows.groupBy("__key", "block").agg(F.min("source").alias("source"), F.sum("size").alias("words"))
    sums = written(sums, "blocks")
    sources = with_targets(sums.groupBy("__key").agg(F.min("source").alias("source"), F.sum("words").alias("source_size")).select("source", "source_size"), weights, most)
    sources = (sources.withColumn("__key", key)
               .withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.greatest("source_size", F.lit(1))))).otherwise(0).cast("int"))
               .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    # The block in which the part of a pass ends, then the document
    running = F.coalesce(F.sum("words").over(W.partitionBy("__key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = (sums.withColumn("before", running).drop("source").join(sources, "__key")
            .where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("words")))
            .select("__key", "block", "before", "rest"))
    near = rows.join(edge, ["__key", "block"])
    cum = F.col("before") + F.sum("size").over(W.partitionBy("__key").orderBy("digest", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow))
    last = (near.withColumn("cum", cum).where(F.col("cum") - F.col("size") / 2 < F.col("rest"))
            .groupBy("__key").agg(F.max(F.struct("block", "digest", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "size")).alias("last")))
    edges = edge.select("__key", F.col("block").alias("edge_block")).join(last, "__key", "left")
    limits = written(sources.drop("source", "w").join(edges, "__key", "left"), "limits")
    dropped(rows)
    dropped(sums)
    at = F.struct(F.col("block"), F.col("digest"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("doc_id"), F.col("size"))
    partly = F.when(F.col("last").isNotNull(), at <= F.col("last")).otherwise(F.coalesce(F.col("block") < F.col("edge_block"), F.lit(False)))
    return (sized.withColumn("__key", key).join(limits, "__key")
            .withColumn("copies", (F.col("passes") + F.when(partly & (F.col("passes") < most) & (F.col("size") > 0), 1).otherwise(0)).cast("int"))
            .drop("__key", "passes", "rest", "edge_block", "last"))


def drawn(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of each kind n of all are, drawn without replacement; numpy draws from
    fewer than 10^9, so of more every kind gives its share and chance has the remainder."""
    total = int(counts.sum())
    if not total:
        return counts.copy()
    if total < 1_000_000_000:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    share = np.array([int(c) * n // total for c in counts], np.int64)
    return share + drawn(rng, (counts > share).astype(np.int64), n - int(share.sum()))


def source_quotas(counts: np.ndarray, quotas: np.ndarray, seed: int) -> np.ndarray:
    """Splits a group's blocks of each shard among its sources: shards x sources."""
    rng, out, left = np.random.default_rng(seed), [], np.asarray(counts, np.int64)
    for n in quotas:
        out.append(drawn(rng, left, int(n)))
        left = left - out[-1]
    return np.array(out)


def shard_quotas(blocks: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Splits the blocks of each source (a count each) among shards: shards x sources."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(blocks)), np.int64)

    def split(counts: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = counts
            return
        mid = (low + high) // 2
        draws = int(counts.sum()) * (mid - low) // (high - low)
        left = drawn(rng, counts, draws)
        split(left, low, mid)
        split(counts - left, mid, high)

    split(np.asarray(blocks, np.int64), 0, shards)
    return out


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, shards: int = SHARDS, seed: int = SEED, planned: DataFrame | None = None) -> DataFrame:
    """The mixed rows: those of docs with `shard` and `place` added, each as often as
    `plan` takes it, dealt to shards by blocks and in random order within a shard.

    Sources stand in at most GROUPS groups, in the order of their names; the driver gets
    one count of blocks for each group and splits those among the shards, and a task for
    each group splits its quotas among its sources. planned is what plan gives for the
    same arguments, where the caller has it.
    """
    spark = docs.sparkSession
    planned = plan(docs, weights, most, seed) if planned is None else planned
    taken = planned.where("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    dealable = written(taken.select(key.alias("__key"), "pass", "block").distinct(), "drawn")  # sources x passes x BLOCKS at most
    every = W.partitionBy()
    sources = dealable.groupBy("__key").agg(F.count("*").alias("n"))  # a row for each source, as in with_targets
    place, total = F.row_number().over(W.orderBy("__key")) - 1, F.count("*").over(every)
    grouped = written(sources.withColumn("group", F.floor(place * F.least(total, F.lit(GROUPS)) / total).cast("int")), "groups")
    sums = grouped.groupBy("group").agg(F.sum("n").alias("n")).orderBy("group").collect()  # GROUPS rows at most
    quotas = shard_quotas(np.array([r["n"] for r in sums], np.int64), shards, seed)

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__key", ignore_index=True)
        group = int(rows["group"][0])
        own = source_quotas(rows["n"].to_numpy(), quotas[:, group], seed + 1 + group)
        return pd.DataFrame({"__key": rows["__key"], "ends": np.cumsum(own, axis=0).T.tolist()})

    ends = grouped.groupBy("group").applyInPandas(split, "__key string, ends array<bigint>")
    order = W.partitionBy("__key").orderBy(F.xxhash64("__key", "pass", "block", F.lit(seed)), "pass", "block")
    dealt = (dealable.withColumn("n", F.row_number().over(order)).join(ends, "__key")
             .select("__key", "pass", "block", F.size(F.filter("ends", lambda e: e < F.col("n"))).alias("shard")))
    # One row a source and pass, with the shard of each block in its place: a small side, so texts needn't be dealt for the join
    of_block = dealt.groupBy("__key", "pass").agg(F.map_from_entries(F.collect_list(F.struct("block", "shard"))).alias("m"))
    of_block = written(of_block.select("__key", "pass", F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda b: F.try_element_at("m", b)).alias("shards")), "dealt")
    placed = (taken.withColumn("__key", key).join(of_block, ["__key", "pass"]).withColumn("shard", F.get("shards", F.col("block"))).where("shard IS NOT NULL")
              .withColumn("place", F.xxhash64("digest", "pass", "text", F.lit(seed))))  # by text too: rows of one id are spread
    own = [c for c in docs.columns if c.lower() not in ADDED]
    return placed.select([F.col(f"`{c}`") for c in own] + ["shard", "place"]).repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")


def held(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs: its words in the mix.

    The mix is written by shard, and the rows read back from its shards are counted by
    what they hold: id, source and text. Rows of docs that agree in these share their
    count. A row of the mix that docs lacks would show as one without a size.
    """
    planned = plan(docs, weights, most, seed)
    mixed, path = mix(docs, weights, most, shards, seed, planned), scratch(docs.sparkSession, "mix")
    mixed.write.partitionBy("shard").parquet(path)
    mixed = reread(docs.sparkSession, mixed.schema, path)
    own = ["doc_id", "source", F.xxhash64("text").alias("body")]
    found = written(mixed.where(F.col("shard").between(0, shards - 1)).select(*own).groupBy("doc_id", "source", "body").agg(F.count("*").alias("n")), "held")
    dropped(mixed)
    rows = planned.select(*own, "size", "source_size", "target", F.lit(1).alias("rows"), F.lit(0).cast("bigint").alias("n"))
    both = (rows.unionByName(found, allowMissingColumns=True).groupBy("doc_id", "source", "body")
            .agg(*[F.min(c).alias(c) for c in ("size", "source_size", "target")], F.greatest(F.sum("rows"), F.lit(1)).alias("rows"), F.sum("n").alias("n")))
    each = both.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1)))
    copies = F.floor(F.col("n") / F.col("rows")) + (F.col("k") < F.col("n") % F.col("rows")).cast("int")
    return each.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("bigint").alias("taken"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('8:' || coalesce(doc_id::varchar, '')) AS digest
  FROM documents),
sources AS (SELECT source, sum(size)::bigint AS source_size FROM docs GROUP BY source),
ranked AS (
  SELECT *, ([5.0, 2.0, 1.0]::double[])[(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS w, 3 * source_size::double AS cap
  FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
targets AS (
  SELECT source, source_size, CASE WHEN level * w < cap THEN w * max(CASE WHEN level * w < cap THEN level END) OVER () ELSE cap END AS target
  FROM levels),
passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::bigint ELSE 0 END AS passes FROM targets),
running AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.doc_id) AS cum
  FROM docs d JOIN passes p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::bigint AS size, source_size, target, (size * (passes + CASE WHEN cum - size / 2.0 < rest AND passes < 3 THEN 1 ELSE 0 END))::bigint AS taken
FROM running
"""
