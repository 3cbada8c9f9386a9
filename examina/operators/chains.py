"""Evidence chains of cases and assets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..adapters import Tables
from ..shared import dropped, shuffles_removed, written


def case_edges(t: Tables) -> DataFrame:
    """Chain (a case), kind, source, target; edges to records that aren't there go."""
    return reduce(DataFrame.unionByName, case_edge_kinds(t)).distinct()


def case_edge_kinds(t: Tables) -> list[DataFrame]:
    """The edges of `case_edges`, a table for each kind, in which one may come twice."""
    links = t.links.join(t.alerts.select("alert_id"), "alert_id", "left_semi")

    def edges(df: DataFrame, kind: str, source: Column, target: Column) -> DataFrame:
        return df.select(F.col("case_id").alias("chain"), F.lit(kind).alias("kind"), source.alias("source"), target.alias("target"))

    case = F.concat(F.lit("case:"), F.col("case_id"))
    return [
        edges(links.join(t.cases.select("case_id"), "case_id", "left_semi"), "triaged_into", F.concat(F.lit("alert:"), F.col("alert_id")), case),
        edges(t.cases.join(t.assets.select("asset_id"), "asset_id", "left_semi"), "affected_by", case, F.concat(F.lit("asset:"), F.col("asset_id"))),
        edges(t.actions.join(t.cases.select("case_id"), "case_id", "left_semi"), "performed_action", case, F.concat(F.lit("action:"), F.col("action_id"))),
        edges(t.escalations.join(t.cases.select("case_id"), "case_id", "left_semi"), "escalated_to", case, F.concat(F.lit("escalation:"), F.col("escalation_id"))),
        edges(t.remediations.join(t.cases.select("case_id"), "case_id", "left_semi"), "remediated_by", case, F.concat(F.lit("remediation:"), F.col("remediation_id"))),
    ]


def asset_edges(t: Tables) -> DataFrame:
    """Alerts observed on an asset."""
    return t.alerts.join(t.assets.select("asset_id"), "asset_id", "left_semi").select(F.col("asset_id").alias("chain"), F.lit("alert_observed").alias("kind"), F.concat(F.lit("asset:"), F.col("asset_id")).alias("source"), F.concat(F.lit("alert:"), F.col("alert_id")).alias("target"))


def nodes(t: Tables) -> DataFrame:
    """Node, kind, record_id, entity_id, label, at of every record that chains are
    made of, once each; a record sent twice is its first by label and time."""
    def of(df: DataFrame, kind: str, key: str, entity: Column, label: Column, at: Column) -> DataFrame:
        return df.where(F.col(key).isNotNull()).select(F.concat(F.lit(f"{kind}:"), key).alias("node"), F.lit(kind).alias("kind"), F.col(key).alias("record_id"), entity.alias("entity_id"), label.alias("label"), at.alias("at"))

    def name(what: str, *parts: Column) -> Column:
        return F.concat(F.lit(what), F.lit(" "), *parts)

    def of_case(df: DataFrame) -> DataFrame:
        return df.join(t.cases.groupBy("case_id").agg(F.min("entity_id").alias("entity_id")), "case_id", "left")

    none, known = F.lit(None).cast("timestamp"), lambda c: F.coalesce(c, F.lit("UNKNOWN"))
    parts = [
        of(t.cases, "case", "case_id", F.col("entity_id"), name("Case", "case_id", F.lit(" ("), known("severity"), F.lit(")")), F.col("created_at")),
        of(t.alerts.join(t.assets.select("asset_id", "entity_id"), "asset_id", "left"), "alert", "alert_id", F.col("entity_id"), name("Alert", "alert_id", F.lit(" ("), known("title"), F.lit(")")), F.col("ts")),
        of(t.assets, "asset", "asset_id", F.col("entity_id"), name("Asset", "asset_id", F.lit(" ("), known("criticality"), F.lit(")")), none),
        of(of_case(t.actions), "action", "action_id", F.col("entity_id"), name("Action", known("action_type")), F.col("ts")),
        of(of_case(t.escalations), "escalation", "escalation_id", F.col("entity_id"), name("Escalation", "escalation_id"), F.col("ts")),
        of(of_case(t.remediations), "remediation", "remediation_id", F.col("entity_id"), name("Remediation", "remediation_id"), F.col("ts")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first = F.struct("label", "at", "entity_id")
    return out.groupBy("node", "kind", "record_id").agg(F.min(first).alias("r")).select("node", "kind", "record_id", "r.entity_id", "r.label", "r.at")


def walk(edges: DataFrame, starts: DataFrame, hops: int, most: int | None = None) -> DataFrame:
    """start, node, hop of all that up to `hops` steps along edges (source, target), either
    way, reach from starts (node): each node once for a start, at its least number of steps,
    the start itself at 0.

    A step joins the last step's new nodes with the edges, each way in a job of its own, and
    drops what was seen; all is written. Of the edges only those at the last step's nodes
    are shuffled, as far as a filter of REACH_BITS bits tells. With `most`, nodes of more edges are
    reached but not left, so that an asset that everything touches joins nothing; they are
    known before the walk and the same for every start. Edges that come twice or lead back
    to their node count once or not; a null start or end is no node.
    """
    ways = [edges.select(F.col(x).alias("node"), F.col(y).alias("next")).where("node <> next") for x, y in (("source", "target"), ("target", "source"))]
    if most is not None:
        both = written(ways[0].unionByName(ways[1]).distinct(), "steps")
        ways = [written(both.join(both.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > most), "node", "left_anti"), "steps")]
    seen = written(starts.where("node IS NOT NULL").select(F.col("node").alias("start"), "node", F.lit(0).alias("hop")).distinct(), "walk")
    last = seen
    for hop in range(1, hops + 1):
        reaches = reach_filter(last)
        found = [written(last.select("start", "node").join(way.where(reaches(F.col("node"))), "node").select("start", F.col("next").alias("node")).distinct(), "reached") for way in ways]
        reached = reduce(DataFrame.unionByName, found).distinct()
        last = written(reached.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hop", F.lit(hop)), "walk")
        for table in found:
            dropped(table)
        seen = seen.unionByName(last)
    return seen


#: Bits of the filter that tells which edges a step may follow; a bound of its memory.
REACH_BITS = 1 << 26


def reach_filter(rows: DataFrame) -> Callable[[Column], Column]:
    """Whether a node may be one of rows: true for all that are, and for others by chance.
    It holds a bit for the hash of each."""
    per = 1 << 16

    def pack(t: pa.Table) -> pa.Table:
        bits = np.zeros(per, bool)
        bits[t["bit"].to_numpy() % per] = True
        return pa.table({"part": pa.array(t["bit"].to_numpy()[:1] // per, pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    def bit(node: Column) -> Column:
        return F.pmod(F.xxhash64(node), F.lit(REACH_BITS))

    spark = rows.sparkSession
    with shuffles_removed(spark):
        found = rows.select(bit(F.col("node")).alias("bit")).distinct().groupBy(F.floor(F.col("bit") / per)).applyInArrow(pack, "part bigint, bits binary").collect()
    whole = np.zeros(REACH_BITS // 8, np.uint8)
    for r in found:
        whole[r["part"] * per // 8 : (r["part"] + 1) * per // 8] = np.frombuffer(r["bits"], np.uint8)
    held = spark.sparkContext.broadcast(whole)

    @F.pandas_udf("boolean")
    def reaches(bits: pd.Series) -> pd.Series:
        at = bits.to_numpy()
        return pd.Series((held.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

    return lambda node: reaches(bit(node))


def omissions(t: Tables) -> DataFrame:
    """Linked alerts that weren't sent, cases without any link, assets that weren't sent."""
    absent = t.links.join(t.alerts.select("alert_id"), "alert_id", "left_anti").select("case_id", F.lit("LINKED_ALERT_ABSENT").alias("issue"), F.col("alert_id").alias("ref"))
    unlinked = t.cases.join(t.links.select("case_id"), "case_id", "left_anti").select("case_id", F.lit("NO_ALERT_LINKED").alias("issue"), F.lit("").alias("ref"))
    no_asset = t.cases.join(t.assets.select("asset_id"), "asset_id", "left_anti").select("case_id", F.lit("ASSET_ABSENT").alias("issue"), F.col("asset_id").alias("ref"))
    return absent.unionByName(unlinked).unionByName(no_asset)


def timeline(t: Tables) -> DataFrame:
    """Everything that happened to a case, numbered in order of time."""
    rows = (t.cases.select("case_id", F.col("created_at").alias("ts"), F.lit("created").alias("event"), F.col("case_id").alias("ref"))
            .unionByName(t.cases.where("closed_at IS NOT NULL").select("case_id", F.col("closed_at").alias("ts"), F.lit("closed").alias("event"), F.col("case_id").alias("ref")))
            .unionByName(t.actions.select("case_id", "ts", F.lit("action").alias("event"), F.col("action_id").alias("ref")))
            .unionByName(t.escalations.select("case_id", "ts", F.lit("escalation").alias("event"), F.col("escalation_id").alias("ref"))))
    return rows.withColumn("n", F.row_number().over(W.partitionBy("case_id").orderBy("ts", "event", "ref"))).select("case_id", "n", "event", "ref")


def summary(t: Tables) -> DataFrame:
    """Nodes and edges of each case's chain by kind."""
    e = case_edges(t)
    def n(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind).alias(kind)

    return e.groupBy("chain").agg(F.count("*").alias("edges"), n("triaged_into"), n("affected_by"), n("performed_action"), n("escalated_to"), n("remediated_by"))


def orphans(t: Tables, sent: DataFrame) -> DataFrame:
    """Child records whose parent wasn't sent, with severity by child type, only where
    the parent's source came at all. sent: record_type."""
    rows = None
    for child, key, parent, parent_key, severity in (("links", "case_id", "cases", "case_id", "error"), ("links", "alert_id", "alerts", "alert_id", "warning"), ("actions", "case_id", "cases", "case_id", "error"), ("escalations", "case_id", "cases", "case_id", "error"), ("cases", "asset_id", "assets", "asset_id", "warning")):
        own = (getattr(t, child).select(F.col(key).alias("ref")).join(getattr(t, parent).select(F.col(parent_key).alias("ref")), "ref", "left_anti")
               .groupBy("ref").agg(F.count("*").alias("n")).select(F.lit(child).alias("child"), F.lit(parent).alias("parent"), "ref", "n", F.lit(severity).alias("severity")))
        rows = own if rows is None else rows.unionByName(own)
    return rows.join(sent.select(F.col("record_type").alias("parent")), "parent", "left_semi")


def provenance(records: DataFrame, raw: DataFrame) -> DataFrame:
    """Records with the locator and hash of the raw row they came from; raw_id is the key."""
    return records.join(raw.select("raw_id", "locator", "raw_hash"), "raw_id", "left")


def lookup(records: DataFrame, key: str) -> DataFrame:
    """C20: of rows with one native id, the unquarantined first, then by hash."""
    order = W.partitionBy("native_id").orderBy("is_quarantined", "content_hash")
    return records.where(F.col("native_id") == key).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
