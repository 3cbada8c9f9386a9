"""Queries and oracles of locality digests and of the search among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import Tables
from ..operators import nearness, text
from ..shared import written
from .evidence import _DISTANCE


def near_documents(t: Tables):
    """Digests of all documents, pairs of distinct ones within distance 30, and how
    many documents have each."""
    d = text.digests(t.raw("documents").select("doc_id", "text")).where("digest IS NOT NULL")
    n = written(d.groupBy("digest").agg(F.count("*").alias("n")), "digest-counts")
    found = nearness.near_digests(n)
    n = n.hint("merge")
    return found.hint("merge").join(n.select(F.col("digest").alias("a"), F.col("n").alias("n_a")), "a").hint("merge").join(n.select(F.col("digest").alias("b"), F.col("n").alias("n_b")), "b").select("a", "b", "distance", "n_a", "n_b")


QUERIES = {"t9_digests": lambda spark, sf: text.digests(Tables(spark, sf).raw("documents")), "t10_near_digests": lambda spark, sf: near_documents(Tables(spark, sf))}


def _digests_sql() -> str:
    """The digests over the same table of bytes, built in SQL from windows of five bytes."""
    table = "[" + ", ".join(map(str, text.digest_table().tolist())) + "]"

    def mapped(salt: int, *parts: str) -> str:
        out = str(int(text.digest_table()[salt]))
        for p in parts:
            out = f"t[xor({out}, {p}) + 1]"
        return out

    salted = ((2, 0, 1, 2), (3, 0, 1, 3), (5, 0, 2, 3), (7, 0, 2, 4), (11, 0, 1, 4), (13, 0, 3, 4))
    buckets = ", ".join(mapped(s, *(f"c{k}" for k in ks)) + " % 128" for s, *ks in salted)
    return f"""raw AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::int) AS bytes FROM documents WHERE octet_length(encode(text)) >= 50),
fit AS (SELECT doc_id, bytes, len(bytes) AS n, {table} AS t FROM raw WHERE len(list_distinct(bytes)) >= 10),
places AS (SELECT doc_id, t, unnest(bytes) AS c0, generate_subscripts(bytes, 1) AS i FROM fit),
windows AS (SELECT * FROM (SELECT doc_id, t, i, c0, lead(c0, 1) OVER w AS c1, lead(c0, 2) OVER w AS c2, lead(c0, 3) OVER w AS c3, lead(c0, 4) OVER w AS c4 FROM places WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE c4 IS NOT NULL),
hits AS (SELECT doc_id, b, count(*) AS c FROM (SELECT doc_id, unnest([{buckets}]) AS b FROM windows) GROUP BY doc_id, b),
counted AS (SELECT doc_id, list(coalesce(c, 0) ORDER BY b) AS cs, count(c) AS used FROM (SELECT doc_id, b FROM fit, (SELECT unnest(range(128)) AS b)) LEFT JOIN hits USING (doc_id, b) GROUP BY doc_id),
cut AS (SELECT doc_id, cs, list_sort(cs)[33] AS q1, list_sort(cs)[65] AS q2, list_sort(cs)[97] AS q3 FROM counted WHERE used >= 32),
coded AS (SELECT *, list_transform(cs, lambda c: (c > q1)::int + (c > q2)::int + (c > q3)::int) AS codes FROM cut WHERE q3 > 0),
leads AS (SELECT doc_id, list({mapped(1, "c0", "c1")} ORDER BY i) AS ls FROM windows GROUP BY doc_id),
checked AS (SELECT doc_id, list_reduce(list_prepend(0, ls), lambda x, y: t[xor(x, y) + 1]) AS ck FROM leads JOIN fit USING (doc_id)),
digests AS (SELECT doc_id, 'T1' || printf('%02X', ck) || printf('%02X', floor(ln(n) / CASE WHEN n <= 656 THEN 0.05 WHEN n <= 3199 THEN 0.04 ELSE 0.03 END)::int % 256) || printf('%X', floor(q1 * 100 / q3)::int % 16) || printf('%X', floor(q2 * 100 / q3)::int % 16)
  || array_to_string(list_transform(range(32), lambda k: printf('%02X', codes[4 * k + 1] + 4 * codes[4 * k + 2] + 16 * codes[4 * k + 3] + 64 * codes[4 * k + 4])), '') AS digest FROM coded JOIN checked USING (doc_id) JOIN fit USING (doc_id))"""


ORACLE = {
    "t9_digests": f"WITH {_digests_sql()} SELECT doc_id, digest FROM documents LEFT JOIN digests USING (doc_id)",
    "t10_near_digests": f"""WITH {_digests_sql()}, kinds AS (SELECT digest, count(*) AS n FROM digests GROUP BY digest)
SELECT * FROM (SELECT x.digest AS a, y.digest AS b, {_DISTANCE} AS distance, x.n AS n_a, y.n AS n_b
FROM kinds x JOIN kinds y ON x.digest < y.digest) WHERE distance <= {nearness.NEAR}""",
}
