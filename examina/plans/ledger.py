"""Queries and oracles of checked proofs and append-only checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..adapters import Tables
from ..operators import checkpoints, integrity
from ..shared import shared_dir
from .evidence import _BASE, _CHAIN, _TREE, case_leaves, custody_events


def _plain(f):
    return lambda spark, sf: f(Tables(spark, sf))


def checked_proofs(t: Tables):
    """Proofs of all leaves, most of them claimed for another index or size, shortened,
    turned round, with another sibling or against another root."""
    leaves = case_leaves(t)
    sizes = leaves.groupBy("batch").agg(F.count("*").alias("size"))
    p = integrity.proofs(leaves).join(sizes, "batch").join(integrity.roots(leaves), "batch")
    k, proof, first = F.col("idx") % 9, F.col("proof"), F.get("proof", F.lit(0))
    rest = F.slice("proof", 2, 64)
    turned = F.struct(F.when(first["side"] == "left", "right").otherwise("left").alias("side"), first["h"].alias("h"))
    other = F.struct(first["side"].alias("side"), F.lit("0" * 64).alias("h"))
    any_step = F.size("proof") > 0
    claimed = {
        "at": F.when(k == 1, F.col("idx") + 1).when(k == 6, -1).when(k == 8, F.col("idx").bitwiseXOR(F.lit(1))).otherwise(F.col("idx")),
        "of": F.when(k == 2, F.col("size") + 1).otherwise(F.col("size")),
        "path": F.when((k == 3) & any_step, F.slice("proof", F.lit(1), F.size("proof") - 1)).when((k == 4) & any_step, F.concat(F.array(turned), rest)).when((k == 5) & any_step, F.concat(F.array(other), rest)).otherwise(proof),
        "root": F.when(k == 7, F.reverse("root")).otherwise(F.upper("root")),
    }
    return p.withColumns(claimed).select("batch", "idx", integrity.proof_verdict(F.col("h"), F.col("at"), F.col("of"), F.col("path"), F.col("root")).alias("verdict"))


def _thirds(t: Tables):
    """The custody log with the batch in which each event comes."""
    log = integrity.chain(custody_events(t))
    n = log.groupBy("entity_id").agg(F.count("*").alias("n"))
    return log.join(n, "entity_id").select("entity_id", "seq", "digest", F.floor((F.col("seq") - 1) * 3 / F.col("n")).alias("batch"))


def _appended(t: Tables):
    path, log = f"{shared_dir(t.spark)}/ledger-{uuid.uuid4().hex[:12]}", _thirds(t)
    return path, [checkpoints.append(log.where(F.col("batch") == k), path, k).withColumn("batch", F.lit(k).cast("bigint")) for k in range(3)]


def appended_checkpoints(t: Tables):
    """Three batches of events appended to all logs, with each batch's roots."""
    _, (a, b, c) = _appended(t)
    return a.unionByName(b).unionByName(c)


def prefix_roots(t: Tables):
    """The roots that the logs had at one, two, a fifth and all of their events, and beyond."""
    path, _ = _appended(t)
    last = checkpoints.frontier(t.spark, path, 2)
    lengths = last.select("entity_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2), F.ceil(F.col("size") / 5), F.col("size"), F.col("size") + 1)).alias("size"))
    return checkpoints.roots_at(t.spark, path, lengths)


QUERIES = {"i6_checked_proofs": _plain(checked_proofs), "i10_appended_checkpoints": _plain(appended_checkpoints), "i10_prefix_roots": _plain(prefix_roots)}

_DEPTH = 17


def _tree(leaves: str) -> str:
    """The levels over leaves (batch, idx, h) as tables p0, p1, ..."""
    up = [f"p{k} AS (SELECT batch, idx // 2 AS idx, CASE WHEN count(*) = 2 THEN sha256('\\x01'::blob || unhex(min_by(h, idx)) || unhex(max_by(h, idx))) ELSE min(h) END AS h FROM p{k - 1} GROUP BY batch, idx // 2)" for k in range(1, _DEPTH)]
    return ",\n".join([f"p0 AS ({leaves})", *up])


_LEAF = "sha256('\\x00'::blob || digest::blob) AS h"
_THIRDS = f"counted AS (SELECT entity_id, seq, {_LEAF}, (seq - 1) * 3 // count(*) OVER (PARTITION BY entity_id) AS batch, count(*) OVER (PARTITION BY entity_id) AS n FROM steps)"
ORACLE = {
    # the sides by splitting at the largest power of two below the size, from the root down
    "i6_checked_proofs": f"""{_BASE}, {_TREE}, sizes AS (SELECT batch, count(*) AS size FROM lv0 GROUP BY batch),
asserted AS (SELECT batch, idx, size, idx % 9 AS k, CASE idx % 9 WHEN 1 THEN idx + 1 WHEN 6 THEN -1 WHEN 8 THEN xor(idx, 1) ELSE idx END AS slot, CASE WHEN idx % 9 = 2 THEN size + 1 ELSE size END AS n FROM lv0 JOIN sizes USING (batch)),
asked AS (SELECT DISTINCT i, n FROM (SELECT idx AS i, size AS n FROM asserted UNION ALL SELECT slot, n FROM asserted WHERE slot >= 0 AND slot < n)),
ways AS (WITH RECURSIVE w(i, n, low, high, sides) AS (SELECT i, n, 0::bigint, n, []::varchar[] FROM asked UNION ALL
  SELECT i, n, CASE WHEN i < mid THEN low ELSE mid END, CASE WHEN i < mid THEN mid ELSE high END, list_prepend(CASE WHEN i < mid THEN 'right' ELSE 'left' END, sides)
  FROM (SELECT *, low + (1::bigint << (length(bin(high - low - 1)) - 1)::int) AS mid FROM w WHERE high - low > 1)) SELECT i, n, sides FROM w WHERE high - low = 1),
held AS (SELECT c.*, own.sides AS own, claimed.sides AS claimed FROM asserted c JOIN ways own ON own.i = c.idx AND own.n = c.size LEFT JOIN ways claimed ON claimed.i = c.slot AND claimed.n = c.n)
SELECT batch, idx, CASE WHEN slot < 0 OR slot >= n THEN 'INDEX' WHEN len(own) - CASE WHEN k = 3 AND len(own) > 0 THEN 1 ELSE 0 END <> len(claimed) THEN 'LENGTH'
  WHEN own <> claimed OR (k = 4 AND len(own) > 0) THEN 'SIDE' WHEN k = 7 OR (k = 5 AND len(own) > 0) THEN 'ROOT' ELSE 'VALID' END AS verdict FROM held""",
    "i10_appended_checkpoints": f"""{_BASE}, {_CHAIN}, {_THIRDS}, {_tree("SELECT entity_id || '|' || b AS batch, seq - 1 AS idx, h FROM counted JOIN (SELECT unnest([0, 1, 2]) AS b) ON batch <= b")},
ends AS (SELECT entity_id, b, count(*) AS size, max(batch) AS last FROM counted JOIN (SELECT unnest([0, 1, 2]) AS b) ON batch <= b GROUP BY entity_id, b)
SELECT entity_id, size, h AS root, b::bigint AS batch FROM ends JOIN p{_DEPTH - 1} ON p{_DEPTH - 1}.batch = entity_id || '|' || b WHERE last = b""",
    "i10_prefix_roots": f"""{_BASE}, {_CHAIN}, {_THIRDS}, asked AS (SELECT DISTINCT entity_id, unnest([0, 1, 2, ceil(n / 5)::bigint, n, n + 1]) AS size, n FROM counted),
{_tree("SELECT entity_id || '|' || size AS batch, seq - 1 AS idx, h FROM counted JOIN asked USING (entity_id) WHERE seq <= size AND size <= asked.n")}
SELECT entity_id, size, h AS root FROM asked LEFT JOIN p{_DEPTH - 1} ON p{_DEPTH - 1}.batch = entity_id || '|' || size""",
}
