"""Tamper evidence: canonical records, Merkle trees, custody chains."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import written

#: Fixed value: the digest before a chain's first event.
GENESIS = "0" * 64
MAX_RETRIES = 5


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode NFC, which Spark has no expression for."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def canonical_value(c: Column, kind: T.DataType) -> Column:
    """A value in the form that commitments take (I1): text in NFC, floats at eight places
    without trailing zeros, times as UTC seconds, dates as ISO. Nulls stay; a number that
    is not finite is an error."""
    if isinstance(kind, T.StringType):
        return nfc(c)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        finite = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit("a number that is not finite has no canonical form"))).otherwise(c.cast("double"))
        return F.when(c.isNotNull(), finite.cast("decimal(38,8)"))
    if isinstance(kind, T.TimestampType):
        return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    return c


def canonical_rows(rows: DataFrame, columns: list[str]) -> Column:
    """The canonical JSON of a row's columns: sorted keys, nulls kept, values in canonical form."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    text = F.to_json(F.struct(*[canonical_value(F.col(k), kinds[k]).alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})
    floats = [k for k in columns if isinstance(kinds[k], (T.DoubleType, T.FloatType))]
    for k in floats:  # zeros at the end of a decimal go
        text = F.regexp_replace(F.regexp_replace(text, rf'("{k}":-?\d+\.\d*?)0+(?=[,}}])', "$1"), rf'("{k}":-?\d+)\.(?=[,}}])', "$1")
    return text


def canonical_json(columns: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys and nulls kept, of values in canonical form."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def commitment(entity: Column, record_type: str, native_id: Column, payload: Column, nonce: Column) -> Column:
    """The digest of a record's envelope (I2); the nonce is given, so runs agree."""
    return F.sha2(canonical_json({"entity_id": entity, "record_type": F.lit(record_type), "native_id": native_id, "payload_digest": F.sha2(payload, 256), "version": F.lit("v1"), "nonce": nonce}), 256)


def leaf_hash(text: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("00")), F.encode(text, "UTF-8")), 256)


def node_hash(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)


def leaves(rows: DataFrame, batch: str, order: list[str], text: str) -> DataFrame:
    """batch, idx from 0, h of every row; a batch without rows has no leaf."""
    n = F.row_number().over(W.partitionBy(batch).orderBy(*order)) - 1
    return rows.select(F.col(batch).alias("batch"), n.cast("bigint").alias("idx"), leaf_hash(F.col(text)).alias("h"))


def levels(of: DataFrame) -> list[DataFrame]:
    """The tree's levels from the leaves to the roots, all batches at once (I4). A last
    node without a partner goes up as it is, which gives the tree that splits at the
    largest power of two. The loop runs over log2 of the largest batch; every level is
    written, so none is worked out again for those above it."""
    of = written(of, "leaves")
    most = of.groupBy("batch").count().agg(F.max("count")).first()[0] or 0
    out = [of]
    while most > 1:
        below = out[-1]
        up = (below.withColumn("up", F.floor(F.col("idx") / 2)).groupBy("batch", "up")
              .agg(F.min_by("h", "idx").alias("l"), F.max_by("h", "idx").alias("r"), F.count("*").alias("n")))
        out.append(written(up.select("batch", F.col("up").cast("bigint").alias("idx"), F.when(F.col("n") == 2, node_hash(F.col("l"), F.col("r"))).otherwise(F.col("l")).alias("h")), "level"))
        most = -(-most // 2)
    return out


def roots(of: DataFrame) -> DataFrame:
    """batch, root."""
    return levels(of)[-1].select("batch", F.col("h").alias("root"))


def proofs(of: DataFrame) -> DataFrame:
    """batch, idx, h and proof, an array of (side, h) from the leaf up."""
    every = levels(of)
    step = of.select("batch", "idx", "h", F.col("idx").alias("at"), F.array().cast("array<struct<side:string,h:string>>").alias("proof"))
    for level in every[:-1]:
        other = level.select("batch", F.col("idx").alias("sibling"), F.col("h").alias("s"))
        step = step.withColumn("sibling", F.col("at").bitwiseXOR(F.lit(1))).join(other, ["batch", "sibling"], "left")
        side = F.when(F.col("at") % 2 == 0, "right").otherwise("left")
        step = step.select("batch", "idx", "h", F.floor(F.col("at") / 2).cast("bigint").alias("at"), F.when(F.col("s").isNotNull(), F.array_append("proof", F.struct(side.alias("side"), F.col("s").alias("h")))).otherwise(F.col("proof")).alias("proof"))
    return step.select("batch", "idx", "h", "proof")


def proof_root(h: Column, proof: Column) -> Column:
    """The root that a leaf's hash and its proof lead to."""
    return F.aggregate(proof, h, lambda a, p: F.when(p["side"] == "right", node_hash(a, p["h"])).otherwise(node_hash(p["h"], a)))


def audit_sides(idx: Column, size: Column) -> Column:
    """The side of each sibling on the way from leaf idx to the root of a tree of `size`
    leaves. At each level a node of odd number has its sibling at the left, one of even
    number at the right unless it is the last, which goes up as it is."""
    def side(k: Column) -> Column:
        at, last = F.call_function("shiftright", idx.cast("bigint"), k), F.call_function("shiftright", size.cast("bigint") - 1, k)
        return F.when(at % 2 == 1, "left").when(at < last, "right")

    return F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(62)), side))


def proof_verdict(h: Column, idx: Column, size: Column, proof: Column, root: Column) -> Column:
    """VALID, or what is wrong first with a proof that leaf idx of a tree of `size`
    leaves with this root has the hash h: INDEX (outside the tree, or no size), LENGTH,
    SIDE (not those of that index and size), ROOT (another root, or a hash that is no
    hexadecimal). A null proof has the wrong length."""
    sides = audit_sides(idx, size)
    inside = F.coalesce((idx >= 0) & (idx < size), F.lit(False))
    return (F.when(~inside, "INDEX").when(F.coalesce(F.size(proof), F.lit(-1)) != F.size(sides), "LENGTH")
            .when(~F.coalesce(F.transform(proof, lambda p: p["side"]) == sides, F.lit(False)), "SIDE")
            .when(~F.coalesce(proof_root(h, proof) == F.lower(root), F.lit(False)), "ROOT").otherwise("VALID"))


CHAIN = "entity_id string, seq bigint, digest string, previous string, event_id string"


def chain(events: DataFrame) -> DataFrame:
    """entity_id, seq, digest, previous, event_id of events (entity_id, event_id, at, body):
    each digest covers the one before (I8, E13).

    A chain is sequential in its entity, so an entity's events pass through one task, in
    order; that task keeps the last digest and number only, so memory doesn't grow with
    the log. Entities run beside each other. Null ids and bodies count as empty.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity, seq, last = None, 0, GENESIS
        for batch in batches:
            rows = []
            for own, event, body in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if own != entity:
                    entity, seq, last = own, 0, GENESIS
                seq, before = seq + 1, last
                last = hashlib.sha256(f"{before}{event}{body}".encode()).hexdigest()
                rows.append((own, seq, last, before, event))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["entity_id", "seq", "digest", "previous", "event_id"])

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("event_id", "body")]
    ordered = events.select("entity_id", *text, "at").repartition("entity_id").sortWithinPartitions("entity_id", "at", "event_id", "body")
    return ordered.select("entity_id", "event_id", "body").mapInArrow(fold, CHAIN)


def audit(log: DataFrame) -> DataFrame:
    """What is wrong with each row of log (entity_id, seq, digest, previous, event_id,
    body): a gap in the sequence, a broken link or a changed body (I9, E12)."""
    w = W.partitionBy("entity_id").orderBy("seq")
    rows = log.withColumn("n", F.row_number().over(w)).withColumn("before", F.coalesce(F.lag("digest").over(w), F.lit(GENESIS)))
    issues = F.array_compact(F.array(F.when(F.col("seq") != F.col("n"), "SEQUENCE_GAP"), F.when(F.col("previous") != F.col("before"), "BROKEN_LINK"),
                                     F.when(F.sha2(F.concat("previous", "event_id", "body"), 256) != F.col("digest"), "PAYLOAD_MISMATCH")))
    return rows.select("entity_id", "seq", F.explode(issues).alias("issue"))


def checkpoint_issues(log: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """entity_id, issue: logs that are shorter than their checkpoint (batch, root, size)
    says, or whose first `size` events have another root (I9)."""
    held = checkpoints.select(F.col("batch").alias("entity_id"), F.col("root").alias("expected"), "size")
    n = F.row_number().over(W.partitionBy("entity_id").orderBy("seq"))
    prefix = log.select("entity_id", "seq", "digest", n.alias("n")).join(held, "entity_id").where("n <= size")
    now = roots(leaves(prefix, "entity_id", ["seq"], "digest")).select(F.col("batch").alias("entity_id"), "root")
    lengths = log.groupBy("entity_id").agg(F.count("*").alias("have"))
    j = held.join(lengths, "entity_id").join(now, "entity_id", "left")
    issue = F.when(F.col("have") < F.col("size"), "ROLLBACK").when(F.col("root") != F.col("expected"), "CHECKPOINT_ROOT_MISMATCH")
    return j.select("entity_id", issue.alias("issue")).where("issue IS NOT NULL")


def queue_step(queue: DataFrame, receipts: DataFrame) -> DataFrame:
    """The next state of every job (job_id, status, retries): pending and failed ones below
    MAX_RETRIES are anchored if a receipt has come, else failed once more (I12)."""
    due = F.col("status").isin("pending", "failed") & (F.col("retries") < MAX_RETRIES)
    has = receipts.select("job_id", F.lit(True).alias("received")).distinct()
    j = queue.join(has, "job_id", "left")
    return j.select("job_id", F.when(due & F.col("received"), "anchored").when(due, "failed").otherwise(F.col("status")).alias("status"), (F.col("retries") + F.when(due & F.col("received").isNull(), 1).otherwise(0)).alias("retries"))


def next_batch(queue: DataFrame, size: int = 50) -> DataFrame:
    """the oldest jobs that may be tried."""
    return queue.where(F.col("status").isin("pending", "failed") & (F.col("retries") < MAX_RETRIES)).orderBy("at", "job_id").limit(size)


def queue_counts(queue: DataFrame) -> DataFrame:
    """Jobs by status."""
    return queue.groupBy("status").agg(F.count("*").alias("n"))
