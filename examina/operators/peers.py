"""Peer cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metrics of a comparison and whether less is better.
METRICS = {"overdue_escalation": True, "investigation_depth": False, "sensor_coverage": False, "concern_density": True}
LEAST_PEERS = 3


def sector_of(entity_id: Column, name: Column, explicit: Column) -> Column:
    """The stated sector, else one that the name or id tells."""
    i, n = F.upper(entity_id), F.upper(name)
    return F.coalesce(explicit, F.when(i.contains("HEALTH") | n.contains("HEALTH"), "Healthcare Services").when(i.contains("ENERGY") | i.contains("POWER") | n.contains("GRID") | n.contains("ENERGY"), "Energy & Utilities")
                      .when(i.contains("TELECOM"), "Telecommunications").when(i.contains("FINTECH"), "Fintech Services").otherwise("Financial / Banking"))


def cohort(entities: DataFrame) -> DataFrame:
    """Each entity with every other of its sector, and why one of them is no peer. The
    entity dimension is small, and pairs stay within a sector."""
    a = entities.select(F.col("entity_id").alias("target_id"), F.lower("sector").alias("s"), F.lower("tier").alias("target_tier"))
    b = entities.select(F.col("entity_id").alias("peer_id"), F.lower("sector").alias("s"), F.lower("tier").alias("peer_tier"))
    return a.join(b, "s").where("target_id <> peer_id").select("target_id", "peer_id", F.when(F.col("target_tier") != F.col("peer_tier"), "tier_mismatch").alias("reason"))


def quartile(values: Column, k: int) -> Column:
    """The k-th quartile of sorted values by the exclusive method: linear at k (n + 1) / 4."""
    n = F.size(values)
    j = F.greatest(F.lit(1), F.least(n - 1, F.floor((n + 1) * k / 4).cast("int")))
    d = (n + 1) * k - j * 4
    return (F.element_at(values, j) * (4 - d) + F.element_at(values, j + 1) * d) / 4


def comparisons(rates: DataFrame, entities: DataFrame) -> DataFrame:
    """D13-D15 per target and metric: the peers' distribution, the target's percentile
    rank, and a state; UNAVAILABLE below LEAST_PEERS peers. rates: entity_id and METRICS,
    a row for each entity; a cohort is as small as a sector."""
    long = rates.select("entity_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(low).alias("low")) for m, low in METRICS.items()])).alias("m")).select("entity_id", "m.*")
    peers = cohort(entities).where("reason IS NULL")
    joined = (long.withColumnRenamed("entity_id", "target_id").join(peers, "target_id", "left")
              .join(long.select(F.col("entity_id").alias("peer_id"), "metric", F.col("value").alias("sample")), ["peer_id", "metric"], "left"))
    g = joined.groupBy("target_id", "metric", "value", "low").agg(F.sort_array(F.collect_list("sample")).alias("v"), F.count_if(F.col("sample") < F.col("value")).alias("less"), F.count_if(F.col("sample") == F.col("value")).alias("equal"))
    n, enough = F.size("v"), F.size("v") >= LEAST_PEERS
    q25 = F.when(n >= 4, quartile(F.col("v"), 1)).otherwise(F.element_at("v", 1))
    q75 = F.when(n >= 4, quartile(F.col("v"), 3)).otherwise(F.element_at("v", -1))
    mid = (F.element_at("v", F.floor((n + 1) / 2).cast("int")) + F.element_at("v", F.floor(n / 2).cast("int") + 1)) / 2
    g = g.select("*", n.alias("n"), F.when(enough, q25).alias("q25"), F.when(enough, mid).alias("median"), F.when(enough, q75).alias("q75"))
    good = F.when(F.col("low"), F.col("value") <= F.col("median")).otherwise(F.col("value") >= F.col("median"))
    outlier = F.when(F.col("low"), F.col("value") > F.col("q75")).otherwise(F.col("value") < F.col("q25"))
    state = F.when(~enough, "UNAVAILABLE").when(good, "FAVORABLE").when(outlier, "OUTLIER_CONCERN").otherwise("ALIGNED_WITH_PEERS")
    return g.select("target_id", "metric", "value", F.col("n").cast("bigint").alias("peers"), F.round("q25", 2).alias("q25"), F.round("median", 2).alias("median"), F.round("q75", 2).alias("q75"), F.round(F.col("q75") - F.col("q25"), 2).alias("iqr"),
                    F.when(enough, F.round((F.col("less") + 0.5 * F.col("equal")) / F.col("n") * 100, 1)).alias("percentile_rank"), state.alias("state"))
