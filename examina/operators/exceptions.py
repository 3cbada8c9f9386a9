"""Dated policy exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import within


def accepted(exceptions: DataFrame) -> DataFrame:
    """Exceptions in force: approved or active, signed, reasoned, dated, with a target of
    their own or in a scope of the form type:id. The last day is valid_to, else expiry_date.

    Of an entity's rows with one exception_id the first that is accepted counts, by row_id.
    """
    scope = F.split("affected_scope", ":", 2)
    kind, target = (F.coalesce(F.nullif(F.col(c), F.lit("")), F.when(F.size(scope) == 2, scope[k])) for k, c in enumerate(("target_type", "target_id")))
    says = [F.trim(c) != "" for c in ("approved_by", "reason")]
    rows = exceptions.select("row_id", "exception_id", "entity_id", "policy_reference", "status", kind.alias("target_type"), target.alias("target_id"), "valid_from", F.coalesce("valid_to", "expiry_date").alias("valid_to"), (says[0] & says[1]).alias("says"))
    good = rows.where(F.lower(F.trim("status")).isin("approved", "active") & F.col("says")).drop("status", "says").dropna()
    return good.groupBy("entity_id", "exception_id").agg(*[F.min_by(c, "row_id").alias(c) for c in ("policy_reference", "target_type", "target_id", "valid_from", "valid_to")])


def excused(objects: DataFrame, exceptions: DataFrame, rule: str, target_type: str, key: str, when: str) -> DataFrame:
    """Distinct keys of objects (entity_id, key, when) that an accepted exception covers at
    `when`, both ends included. Exceptions with a target are joined by it, wildcards by the
    entity and bins of time."""
    of_rule = accepted(exceptions).where(F.col("policy_reference").isin(rule, "*") & F.col("target_type").isin(target_type, "*"))
    objects = objects.select("entity_id", F.col(key).alias("__key"), F.col(when).alias("__when")).where("__when IS NOT NULL")
    inside = (F.col("__when") >= F.col("valid_from")) & (F.col("__when") <= F.col("valid_to"))
    own = of_rule.where("target_id <> '*'").withColumnRenamed("entity_id", "e")
    a = objects.join(own, (F.col("entity_id") == F.col("e")) & (F.col("__key") == F.col("target_id")) & inside, "left_semi")
    b = within(objects, of_rule.where("target_id = '*'"), ["entity_id"], "__when", "valid_from", "valid_to")
    return a.unionByName(b).select(F.col("__key").alias(key)).distinct()
