"""Scalar expressions over columns: cleaning, dates, predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import policy

#: ISO 8601 dates and times as intake takes them: full digits, `T` or a space, optional zone.
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"


def cleaned(text: Column) -> Column:
    """Trimmed text; empty and UNKNOWN are null."""
    t = F.trim(text)
    return F.when((t != "") & (F.upper(t) != "UNKNOWN"), t)


def substantive(text: Column) -> Column:
    """Whether text says something; never null."""
    return F.coalesce(~F.upper(F.trim(text)).isin(*policy.PLACEHOLDERS), F.lit(False))


def iso_time(text: Column) -> Column:
    """The time of an ISO 8601 text, else null; one without a zone is UTC."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & (F.length(text) > 10)
    utc = F.concat(text, F.when(F.length(text) == 10, "T00:00:00").otherwise(""), F.lit("Z"))  # whatever the session's zone is
    return F.when(text.rlike(ISO), F.when(zoned, text).otherwise(utc).try_cast("timestamp"))


def number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def metric_kind(name: Column) -> Column:
    n = F.lower(F.trim(name))
    return F.when(n.isin(*policy.CLOSURE_METRICS), "closure").when(n.isin(*policy.ESCALATION_METRICS), "escalation")


def percentage_metric(name: Column, unit: Column) -> Column:
    words = F.split(F.lower(name), "_")
    return metric_kind(name).isNotNull() | F.coalesce(F.lower(unit).isin(*policy.PERCENT_UNITS), F.lit(False)) | F.arrays_overlap(words, F.array(*map(F.lit, ("pct", "percent", "percentage"))))


def foreign_entities(columns: list[Column], entity: Column) -> Column:
    """The parts of any cell, cut at `/`, that name another entity."""
    parts = F.flatten(F.array(*[F.split(F.coalesce(c, F.lit("")), "/") for c in columns]))
    return F.array_distinct(F.filter(parts, lambda p: (p.startswith("CSE-") | p.startswith("ENTITY-")) & (p != entity)))


def severity_map(values: dict, severity: Column, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(severity == k, F.lit(v)).otherwise(out)
    return out


def month_claim_period(period: Column, start: Column, end: Column) -> Column:
    """struct<start, end> of a claim: an explicit interval or YYYY-MM; null if neither
    holds, if only one bound is given, or if the interval contradicts the month. An end on
    the month's last second counts as the month's end."""
    month = F.when(period.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.to_timestamp(F.concat(period, F.lit("-01 00:00:00"))))
    following = F.add_months(month, 1).cast("timestamp")
    explicit = F.when(start.isNotNull() & end.isNotNull() & (start < end), F.struct(start.alias("start"), end.alias("end")))
    fits = month.isNull() | ((start == month) & (end >= following - F.expr("INTERVAL 1 SECOND")) & (end <= following))
    return F.when(start.isNotNull() | end.isNotNull(), F.when(fits, explicit)).when(month.isNotNull(), F.struct(month.alias("start"), following.alias("end")))
