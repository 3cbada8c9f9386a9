"""Queries and oracles of intake: each record type from rows made bad on purpose."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import Tables, ctes
from ..functions import clean
from ..operators import intake

_DAY = "CAST(CAST({c} AS DATE) AS STRING)"


def _time(column: str, key: str, bad: int) -> str:
    """An ISO time of a day column; every bad-th row has a form that isn't ISO 8601."""
    day = _DAY.format(c=column)
    return f"CASE WHEN {key} % {bad} = 0 THEN '2026-1-5' WHEN {key} % {bad} = 1 THEN {day} ELSE {day} || 'T10:30:00Z' END"


#: record type -> SELECT of raw string rows in the SQL that Spark and DuckDB share.
RAW = {
    "assets": f"SELECT c_custkey AS row_id, 'CSE-' || CAST(c_nationkey AS STRING) AS submitter, CASE WHEN c_custkey % 41 = 0 THEN ' ' ELSE CAST(c_custkey AS STRING) END AS native_id, CASE WHEN c_custkey % 17 = 0 THEN 'UNKNOWN' WHEN c_custkey % 23 = 0 THEN 'share/CSE-77/x' ELSE c_name END AS hostname, c_mktsegment AS criticality, CASE WHEN c_custkey % 19 = 0 THEN 'CSE-78/team' ELSE 'team ' || c_mktsegment END AS owner, CASE WHEN c_custkey % 13 = 0 THEN 'soon' WHEN c_custkey % 3 = 0 THEN '1995-06-01T00:00:00+02:00' END AS last_heartbeat, CASE WHEN c_custkey % 4 = 0 THEN '1997-02-02' END AS timestamp FROM customer",
    "alerts": f"SELECT event_id AS row_id, 'CSE-1' AS submitter, CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(event_id AS STRING) END AS native_id, {_time('ts', 'event_id', 37)} AS timestamp, CASE WHEN event_id % 43 = 0 THEN 'seen in ENTITY-9/log' ELSE event_type END AS title, CASE WHEN event_id % 41 = 0 THEN '' ELSE 'HIGH' END AS severity, 'siem' AS source_tool, CASE WHEN event_id % 29 = 0 THEN 'unknown' ELSE 'open' END AS triage_status, CAST(user_id AS STRING) AS asset_id FROM events",
    "cases": f"SELECT o_orderkey AS row_id, 'CSE-2' AS submitter, CAST(o_orderkey AS STRING) AS native_id, {_time('o_orderdate', 'o_orderkey', 31)} AS created_at, CASE WHEN o_orderkey % 19 = 0 THEN 'never' END AS closed_at, o_orderpriority AS severity, CASE WHEN o_orderkey % 47 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 53 = 0 THEN 'see CSE-3' WHEN o_orderkey % 59 = 0 THEN 'CSE-2' WHEN o_orderkey % 61 = 0 THEN 'CSE-4/notes' END AS notes FROM orders",
    "case_alert_links": f"SELECT l_orderkey * 10 + l_linenumber AS row_id, 'CSE-1' AS submitter, CAST(l_orderkey AS STRING) AS native_id, CAST(l_orderkey AS STRING) AS case_id, CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE CAST(l_partkey AS STRING) END AS alert_id, {_time('l_shipdate', 'l_partkey', 89)} AS linked_at FROM lineitem",
    "investigation_actions": f"SELECT l_orderkey * 10 + l_linenumber AS row_id, 'CSE-1' AS submitter, CAST(l_partkey AS STRING) AS native_id, CAST(l_orderkey AS STRING) AS case_id, l_returnflag AS action_type, CASE WHEN l_suppkey % 11 = 0 THEN '' ELSE CAST(l_suppkey AS STRING) END AS actor, {_time('l_shipdate', 'l_partkey', 71)} AS timestamp FROM lineitem",
    "escalations": f"SELECT o_orderkey AS row_id, 'CSE-1' AS submitter, CAST(o_orderkey AS STRING) AS native_id, CAST(o_orderkey AS STRING) AS case_id, CASE WHEN o_orderkey % 21 = 0 THEN NULL ELSE 'L2' END AS escalation_level, 'duty officer' AS notified_party, {_time('o_orderdate', 'o_orderkey', 27)} AS timestamp FROM orders",
    "coverage_observations": "SELECT event_id AS row_id, 'CSE-1' AS submitter, CAST(event_id AS STRING) AS native_id, event_type AS sensor_name, 'UP' AS status, '1995-03-03T00:00:00' AS timestamp, CASE WHEN event_id % 15 = 0 THEN 'many' WHEN event_id % 16 = 0 THEN 'UNKNOWN' ELSE CAST(user_id AS STRING) END AS expected_eps, CAST(user_id AS STRING) AS observed_eps FROM events",
    "ownership": "SELECT c_custkey AS row_id, 'CSE-1' AS submitter, CAST(c_custkey AS STRING) AS native_id, CAST(c_custkey AS STRING) AS asset_id, CASE WHEN c_custkey % 25 = 0 THEN 'Unknown' ELSE c_mktsegment END AS owner_team, 'some day' AS effective_date FROM customer",
    "exceptions": "SELECT s_suppkey AS row_id, 'CSE-1' AS submitter, CAST(s_suppkey AS STRING) AS native_id, 'POL-INV-001' AS policy_reference, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 'case:*' END AS affected_scope, 'ciso' AS approved_by, CASE WHEN s_suppkey % 8 = 0 THEN '31/12/1999' ELSE '1999-12-31' END AS expiry_date, 'active' AS status, CASE WHEN s_suppkey % 7 = 0 THEN 'x' END AS effective_date FROM supplier",
    "remediations_validations": f"SELECT o_orderkey AS row_id, 'CSE-1' AS submitter, CAST(o_orderkey AS STRING) AS native_id, CAST(o_orderkey AS STRING) AS case_id, 'patched' AS action_summary, CASE WHEN o_orderkey % 33 = 0 THEN ' unknown ' ELSE 'audit' END AS validated_by, {_time('o_orderdate', 'o_orderkey', 45)} AS validation_date, 'ok' AS result FROM orders",
    "reported_claims": "SELECT o_orderkey AS row_id, 'CSE-1' AS submitter, CAST(o_orderkey AS STRING) AS native_id, CASE WHEN o_orderkey % 2 = 0 THEN 'sla_compliance' ELSE 'mean_hours' END AS metric_name, CASE WHEN o_orderkey % 7 = 0 THEN '1995-13' ELSE '1995-04' END AS period, CASE WHEN o_orderkey % 5 = 0 THEN 'high' WHEN o_orderkey % 11 = 0 THEN '-1' WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 140 AS STRING) END AS metric_value, CASE WHEN o_orderkey % 6 = 1 THEN 'pct' WHEN o_orderkey % 6 = 3 THEN 'percent' END AS unit FROM orders",
}
_ISO = clean.ISO


def _raw(t: Tables, record_type: str):
    from ..adapters import _RAW, needed

    sql = RAW[record_type]
    inputs = {n: t.raw(n) for n in needed(sql, _RAW)}
    for n in inputs:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}")
    rows = t.spark.sql(sql, **inputs)
    if intake.SPECS[record_type].event:
        rows = rows.withColumns({"period_start": F.lit("1995-01-01").cast("timestamp"), "period_end": F.lit("1996-01-01").cast("timestamp")})
    return rows


def normalized(t: Tables, record_type: str):
    rows = intake.normalized(_raw(t, record_type), record_type)
    codes = F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["type"], i["field"])), ",")
    return rows.select("row_id", "native_id", codes.alias("codes"), "is_quarantined")


def _oracle(record_type: str, extra: str = "") -> str:
    """The same rows and checks in SQL."""
    spec, sql = intake.SPECS[record_type], RAW[record_type]
    have = {n for n in ["native_id", *spec.required, *spec.times, *spec.numbers, *spec.others] if f" AS {n}" in sql}

    def text(n: str) -> str:
        names = [x for x in (n, *spec.alias.get(n, ())) if f" AS {x}" in sql]
        return "coalesce(" + ", ".join(f"CASE WHEN trim({x}) <> '' AND upper(trim({x})) <> 'UNKNOWN' THEN trim({x}) END" for x in names) + ")" if names else "NULL::varchar"

    def iso(n: str) -> str:
        return f"CASE WHEN regexp_matches({text(n)}, '{_ISO}') THEN try_cast({text(n)} AS TIMESTAMPTZ) END"

    checks = [(f"{text(n)} IS NULL", f"MISSING_REQUIRED_FIELD:{n}", True) for n in ("native_id", *spec.required)]
    for n, severity in spec.times.items():
        if severity:
            checks.append((f"{text(n)} IS NOT NULL AND {iso(n)} IS NULL", f"MALFORMED_TIMESTAMP:{n}", severity == "error"))
    for n in spec.numbers:
        checks.append((f"{text(n)} IS NOT NULL AND try_cast({text(n)} AS DOUBLE) IS NULL", f"INVALID_FIELD_TYPE:{n}", True))
    if spec.event:
        checks.append((f"({iso(spec.event)}) < TIMESTAMPTZ '1995-01-01 00:00:00+00' OR ({iso(spec.event)}) >= TIMESTAMPTZ '1996-01-01 00:00:00+00'", f"TIMESTAMP_OUT_OF_PERIOD:{spec.event}", False))
    if record_type == "reported_claims":
        v = f"try_cast({text('metric_value')} AS DOUBLE)"
        checks.append((f"{v} < 0 OR ({v} > 100 AND (metric_name = 'sla_compliance' OR unit = 'percent'))", "CLAIM_VALUE_OUT_OF_RANGE:metric_value", True))
        checks.append(("period = '1995-13'", "INVALID_CLAIM_PERIOD:period", True))
    cells = " || '/' || ".join(f"coalesce({n}, '')" for n in dict.fromkeys(["native_id", *spec.required, *spec.others]) if n in have)
    checks.append((f"len(list_filter(string_split({cells}, '/'), lambda p: (p LIKE 'CSE-%' OR p LIKE 'ENTITY-%') AND p <> submitter)) > 0", "CROSS_ENTITY_REFERENCE:", True))
    codes = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for c, k, _ in checks) + "], lambda x: x IS NOT NULL), ',')"
    bad = " OR ".join(f"coalesce({c}, false)" for c, _, e in checks if e)
    return f"WITH raw AS ({sql}) SELECT row_id, {text('native_id')} AS native_id{extra}, {codes} AS codes, ({bad}) AS is_quarantined FROM raw"


def intake_counts(t: Tables):
    """Rows of all types, identities by native id, and children of cases that
    weren't accepted."""
    out, cases = None, None
    for r in ("cases", *(x for x in intake.SPECS if x != "cases")):
        rows = intake.normalized(_raw(t, r), r)
        child = "case_id" in rows.columns and r != "cases"
        rows = rows.select("row_id", "native_id", F.col("case_id").alias("parent") if child else F.lit(None).cast("string").alias("parent"), "issues", "is_quarantined", F.col("is_quarantined").alias("rejected"))
        if cases is None:
            cases = rows.where("NOT is_quarantined").select(F.col("native_id").alias("parent"), F.lit(True).alias("known")).distinct()
        own = intake.identities(rows, ["native_id"], ["row_id"], ["native_id"]).join(cases, "parent", "left").withColumn("is_orphan", F.col("parent").isNotNull() & F.col("known").isNull() & ~F.col("is_quarantined"))
        own = own.select(F.lit(r).alias("record_type"), "issues", "is_quarantined", "identity", "is_orphan")
        out = own if out is None else out.unionByName(own)
    return intake.counts(out)


def line_identities(t: Tables):
    rows = t.raw("lineitem").withColumn("rejected", F.col("l_partkey") % 50 == 0)
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    found = intake.identities(rows, ["l_orderkey", "l_linenumber"], order, ["l_returnflag", "l_linestatus"])
    return found.groupBy(F.coalesce("identity", F.lit("REJECTED")).alias("identity")).agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


def predicates(t: Tables):
    """B13, B17, B18, B22, B31 over columns of the driver's tables."""
    e = t.raw("orders")
    text = F.concat(F.lit(" "), F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'Pending' WHEN 1 THEN '3.50' WHEN 2 THEN 'unknown' WHEN 3 THEN 'n/a' ELSE o_orderpriority END"))
    metric = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'SLA_Compliance' WHEN 1 THEN 'detect_pct_rate' WHEN 2 THEN 'escalation_sla_compliance_rate' ELSE 'hours' END")
    return e.select("o_orderkey", clean.substantive(text).alias("substantive"), clean.number(text).alias("value"), clean.cleaned(text).alias("cleaned"), clean.metric_kind(metric).alias("kind"), clean.percentage_metric(metric, F.lit(None).cast("string")).alias("is_percent"))


QUERIES = {f"b_normalize_{r}": (lambda spark, sf, r=r: normalized(Tables(spark, sf), r)) for r in RAW}
QUERIES |= {
    "d1_intake_counts": lambda spark, sf: intake_counts(Tables(spark, sf)), "d2_source_issues": lambda spark, sf: intake.source_issues(Tables(spark, sf).sources),
    "e1_identities": lambda spark, sf: line_identities(Tables(spark, sf)), "b22_predicates": lambda spark, sf: predicates(Tables(spark, sf)),
}
ORACLE = {f"b_normalize_{r}": _oracle(r) for r in RAW}


def _counts_sql() -> str:
    def part(r: str) -> str:
        child = r != "cases" and " AS case_id" in RAW[r]
        again = "NOT is_quarantined AND row_number() OVER (PARTITION BY native_id, is_quarantined) > 1"
        orphan = "parent IS NOT NULL AND NOT is_quarantined AND parent NOT IN (SELECT native_id FROM good)" if child else "false"
        return f"SELECT '{r}' AS record_type, codes, is_quarantined, {again} AS again, {orphan} AS orphan FROM ({_oracle(r, ', case_id AS parent' if child else '')})"

    parts = " UNION ALL ".join(part(r) for r in RAW)
    has = lambda k: f"count(*) FILTER (WHERE contains(codes, '{k}'))"
    return f"WITH good AS (SELECT DISTINCT native_id FROM ({_oracle('cases')}) WHERE NOT is_quarantined) SELECT record_type, count(*) AS parsed, count(*) FILTER (WHERE NOT is_quarantined) AS accepted, count(*) FILTER (WHERE is_quarantined) AS quarantined, {has('MALFORMED_TIMESTAMP')} AS bad_times, {has('TIMESTAMP_OUT')} AS out_of_period, {has('MISSING')} AS missing_fields, {has('CROSS')} AS foreign, count(*) FILTER (WHERE again) AS duplicates, 0 AS conflicts, count(*) FILTER (WHERE orphan) AS orphans FROM ({parts}) GROUP BY record_type"


ORACLE |= {
    "d1_intake_counts": _counts_sql().replace("AS foreign", 'AS "foreign"'),
    "d2_source_issues": "WITH " + ctes("sources") + " SELECT submission_id, source_id, CASE WHEN actual_rows IS NULL AND is_optional THEN 'MISSING_OPTIONAL_SOURCE' WHEN actual_rows IS NULL THEN 'MISSING_REQUIRED_SOURCE' ELSE 'ROW_COUNT_MISMATCH' END AS issue FROM sources WHERE actual_rows IS NULL OR actual_rows <> declared_rows",
    "e1_identities": """WITH r AS (SELECT *, l_partkey % 50 = 0 AS rejected FROM lineitem),
o AS (SELECT *, row_number() OVER w AS n, first_value(l_returnflag || l_linestatus) OVER w AS f FROM r WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY rejected, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate))
SELECT CASE WHEN rejected THEN 'REJECTED' WHEN n = 1 THEN 'NEW' WHEN l_returnflag || l_linestatus = f THEN 'DUPLICATE_RECORD' ELSE 'CONFLICTING_IDENTITY' END AS identity, count(*) AS n, sum(l_partkey)::bigint AS parts FROM o GROUP BY 1""",
    "b22_predicates": """WITH t AS (SELECT o_orderkey, ' ' || CASE o_orderkey % 5 WHEN 0 THEN 'Pending' WHEN 1 THEN '3.50' WHEN 2 THEN 'unknown' WHEN 3 THEN 'n/a' ELSE o_orderpriority END AS x FROM orders)
SELECT o_orderkey, upper(trim(x)) NOT IN ('PENDING', 'UNKNOWN', 'N/A') AS substantive, try_cast(trim(x) AS double) AS value, CASE WHEN trim(x) <> 'unknown' THEN trim(x) END AS cleaned,
  CASE o_orderkey % 4 WHEN 0 THEN 'closure' WHEN 2 THEN 'escalation' END AS kind, o_orderkey % 4 <> 3 AS is_percent FROM t""",
}
