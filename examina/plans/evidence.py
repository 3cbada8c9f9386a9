"""Queries and oracles of chains, tamper evidence and text reuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import Tables, ctes
from ..operators import chains, integrity, reports, text
from ..shared import written

_BASE = "WITH " + ctes("cases", "submissions", "actions", "escalations", "links", "assets", "alerts", "remediations", "sources")


def _plain(f):
    return lambda spark, sf: f(Tables(spark, sf))


def committed_cases(t: Tables):
    """Commitments of all cases; the nonce comes from the key."""
    payload = integrity.canonical_json({"case_id": F.col("case_id"), "severity": F.col("severity"), "status": F.col("status"), "root_cause": F.col("root_cause")})
    return t.cases.select("submission_id", "case_id", integrity.commitment(F.col("entity_id"), "cases", F.col("case_id"), payload, F.concat(F.lit("n"), F.col("case_id"))).alias("commitment"))


def case_leaves(t: Tables):
    return integrity.leaves(committed_cases(t), "submission_id", ["commitment"], "commitment")


def verified_proofs(t: Tables):
    """Each leaf's proof length and the root it leads to."""
    p = integrity.proofs(case_leaves(t))
    return p.select("batch", "idx", F.size("proof").cast("bigint").alias("steps"), integrity.proof_root(F.col("h"), F.col("proof")).alias("root"))


def custody_events(t: Tables):
    return t.cases.select("entity_id", F.col("case_id").alias("event_id"), F.unix_timestamp("created_at").alias("at"), F.col("status").alias("body"))


def tampered_log(t: Tables):
    """A custody log in which some events lost their place or had their body changed."""
    e = custody_events(t)
    log = integrity.chain(e).join(e.select("event_id", "body"), "event_id")
    return log.where("seq % 40 <> 17").withColumn("body", F.when(F.col("seq") % 55 == 3, "CHANGED").otherwise(F.col("body")))


def queue(t: Tables):
    return t.cases.select(F.col("case_id").alias("job_id"), F.when(F.col("severity") == "LOW", "anchored").when(F.col("severity") == "HIGH", "failed").otherwise("pending").alias("status"), (F.col("case_id").cast("bigint") % 7).alias("retries"), F.unix_timestamp("created_at").alias("at"))


def receipts(t: Tables):
    return t.escalations.select(F.col("case_id").alias("job_id"))


def docs(t: Tables):
    return t.raw("documents").select("doc_id", "text")


_COMMIT = """commits AS (SELECT submission_id, case_id, entity_id, created_at, status, sha256('{"entity_id":"' || entity_id || '","native_id":"' || case_id || '","nonce":"n' || case_id || '","payload_digest":"' ||
  sha256('{"case_id":"' || case_id || '","root_cause":' || CASE WHEN root_cause IS NULL THEN 'null' ELSE '"' || root_cause || '"' END || ',"severity":"' || severity || '","status":"' || status || '"}') || '","record_type":"cases","version":"v1"}') AS commitment FROM cases)"""
_LEVELS = 11
_TREE = ",\n".join([_COMMIT, "lv0 AS (SELECT submission_id AS batch, row_number() OVER (PARTITION BY submission_id ORDER BY commitment) - 1 AS idx, sha256('\\x00'::blob || commitment::blob) AS h FROM commits)"]
                   + [f"lv{k} AS (SELECT batch, idx // 2 AS idx, CASE WHEN count(*) = 2 THEN sha256('\\x01'::blob || unhex(min_by(h, idx)) || unhex(max_by(h, idx))) ELSE min(h) END AS h FROM lv{k - 1} GROUP BY batch, idx // 2)" for k in range(1, _LEVELS)])
_CHAIN = """folded AS (SELECT entity_id, list(case_id ORDER BY epoch(created_at), case_id, status) AS ids, list(status ORDER BY epoch(created_at), case_id, status) AS bodies FROM cases GROUP BY entity_id),
steps AS (WITH RECURSIVE s(entity_id, seq, digest, previous, event_id, ids, bodies) AS (
  SELECT entity_id, 1, sha256(repeat('0', 64) || ids[1] || bodies[1]), repeat('0', 64), ids[1], ids, bodies FROM folded
  UNION ALL SELECT entity_id, seq + 1, sha256(digest || ids[seq + 1] || bodies[seq + 1]), digest, ids[seq + 1], ids, bodies FROM s WHERE seq < len(ids)) SELECT entity_id, seq::bigint AS seq, digest, previous, event_id, bodies[seq] AS body FROM s)"""
_EDGES = """edges AS (
SELECT DISTINCT case_id AS chain, 'triaged_into' AS kind, 'alert:' || alert_id AS source, 'case:' || case_id AS target FROM links WHERE alert_id IN (SELECT alert_id FROM alerts) AND case_id IN (SELECT case_id FROM cases)
UNION ALL SELECT case_id, 'affected_by', 'case:' || case_id, 'asset:' || asset_id FROM cases WHERE asset_id IN (SELECT asset_id FROM assets)
UNION ALL SELECT DISTINCT case_id, 'performed_action', 'case:' || case_id, 'action:' || action_id FROM actions WHERE case_id IN (SELECT case_id FROM cases)
UNION ALL SELECT DISTINCT case_id, 'escalated_to', 'case:' || case_id, 'escalation:' || escalation_id FROM escalations
UNION ALL SELECT DISTINCT case_id, 'remediated_by', 'case:' || case_id, 'remediation:' || remediation_id FROM remediations WHERE case_id IN (SELECT case_id FROM cases))"""
_TOKENS = r"list_filter(list_transform(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_-]+'), lambda x: regexp_full_match(x, '[a-z0-9_-]+')), lambda x: regexp_replace(x, '^-+|-+$', '', 'g')), lambda x: x <> '')"
_SHINGLES = f"""toks AS (SELECT doc_id, {_TOKENS} AS w FROM documents), sh AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM toks),
uniq AS (SELECT min(doc_id) AS doc_id, list_sort(s) AS s FROM sh WHERE len(s) > 0 GROUP BY list_sort(s)),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM uniq),
lexical AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) / (a.n + b.n - count(*)) AS score FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.n, b.n) >= greatest(a.n, b.n) * 0.5 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.5)"""


def sent_digests(t: Tables):
    """Locality digests as entities send them with their documents, in a form that SQL can
    make too: checksum of the whole text, steps of its length, two digits of it, and codes
    of the first words, so that copies are near and differ in every part; short texts have
    none."""
    n = F.length("text")
    head = F.concat(F.substring(F.md5("text"), 1, 2), F.lpad(F.lower(F.hex(F.floor(n / 100) % 256)), 2, "0"), F.lower(F.hex(F.floor(n / 10) % 4)), F.lower(F.hex((n % 4).cast("bigint"))))
    codes = F.concat(F.md5(F.substring("text", 1, 30)), F.md5(F.substring("text", 1, 60)))
    return t.raw("documents").select("doc_id", F.when(n >= 50, F.concat(F.lit("T1"), F.upper(F.concat(head, codes)))).alias("digest"))


_DIGESTS = """digests AS (SELECT doc_id, CASE WHEN length(text) >= 50 THEN 'T1' || upper(substring(md5(text), 1, 2) || printf('%02x', length(text) // 100 % 256) || printf('%x', length(text) // 10 % 4) || printf('%x', length(text) % 4)
  || md5(substring(text, 1, 30)) || md5(substring(text, 1, 60))) END AS digest FROM documents)"""
_HEX = "(strpos('0123456789ABCDEF', substring({0}, {1}, 1)) - 1)"


def _apart(at: str) -> str:
    return f"abs(('0x' || x.digest[{at}])::int - ('0x' || y.digest[{at}])::int)"


#: The distance of x.digest and y.digest.
_DISTANCE = (f"((x.digest[3:4] <> y.digest[3:4])::bigint + CASE WHEN {_apart('5:6')} > 1 THEN 12 * {_apart('5:6')} ELSE {_apart('5:6')} END + {_apart('7:7')} + {_apart('8:8')} + "
             + "list_sum(list_transform(range(9, 73), lambda i: abs({a} // 4 - {b} // 4) + abs({a} % 4 - {b} % 4))))".format(a=_HEX.format("x.digest", "i"), b=_HEX.format("y.digest", "i")))


def matches(t: Tables):
    """T11-T13 over lexical pairs: both scores, digest distance, the composite, a class."""
    d = docs(t)
    pairs = written(text.lexical_pairs(d), "pairs")
    cos = written(text.tf_cosine(pairs, d), "cosines")
    toks = d.select("doc_id", "text", text.tokens(F.col("text")).alias("w")).join(sent_digests(t), "doc_id")
    j = (pairs.join(cos, ["a", "b"]).join(toks.select(F.col("doc_id").alias("a"), F.col("w").alias("wa"), F.col("text").alias("ta"), F.col("digest").alias("da")), "a")
         .join(toks.select(F.col("doc_id").alias("b"), F.col("w").alias("wb"), F.col("text").alias("tb"), F.col("digest").alias("db")), "b"))
    score = text.composite(F.col("wa") == F.col("wb"), F.col("cosine"), F.col("score"), text.digest_distance(F.col("da"), F.col("db")), text.negation_mismatch(F.col("wa"), F.col("wb")))
    return j.select("a", "b", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("lexical"), text.digest_distance(F.col("da"), F.col("db")).alias("distance"), text.negation_mismatch(F.col("wa"), F.col("wb")).alias("negation"), score.alias("composite"), text.explanation(F.col("ta"), F.col("tb"), score).alias("explanation"))


def near_digests(t: Tables):
    """T10 over lexical pairs."""
    d = sent_digests(t)
    j = text.lexical_pairs(docs(t)).join(d.select(F.col("doc_id").alias("a"), F.col("digest").alias("da")), "a").join(d.select(F.col("doc_id").alias("b"), F.col("digest").alias("db")), "b")
    return j.select("a", "b", text.digest_distance(F.col("da"), F.col("db")).alias("distance"))


def other_records(t: Tables):
    """T15 over lexical pairs: documents are records of their source, several to a record."""
    records = t.raw("documents").select("doc_id", F.floor(F.col("doc_id") / 3).alias("record_id"), F.col("source").alias("source_id"), "text")
    return text.other_records(text.lexical_pairs(docs(t)).select("a", "b"), records)


def registered_files(t: Tables):
    """Files as the bytes of documents, each a source of an entity; digests as they were recorded."""
    d = t.raw("documents").select(F.concat(F.lit("CSE-"), F.col("doc_id") % 25).alias("entity_id"), F.col("doc_id").alias("key"), F.sha2("text", 256).alias("digest"))
    return d


def audit_everything(t: Tables):
    """I11 of entities whose log, checkpoint, files and records were changed in places."""
    log, e = integrity.chain(custody_events(t)), custody_events(t)
    full = log.join(e.select("event_id", "body"), "event_id")
    kept = full.where("NOT (entity_id = 'CSE-3' AND seq > 5)").withColumn("body", F.when((F.col("entity_id") == "CSE-4") & (F.col("seq") == 2), "CHANGED").otherwise(F.col("body")))
    held = reports.checkpoints(log).withColumn("root", F.when(F.col("batch") == "CSE-5", "0").otherwise(F.col("root")))
    files = registered_files(t)
    now = files.where("key % 50 <> 6").withColumn("digest", F.when(F.col("key") % 50 == 7, F.lit("0")).otherwise(F.upper("digest")))
    rows = t.cases.select("entity_id", F.col("case_id").alias("key"), F.sha2("status", 256).alias("digest"))
    changed = rows.withColumn("digest", F.when(F.col("entity_id") == "CSE-8", "0").otherwise(F.col("digest")))
    return reports.audit_verdicts(kept, held, reports.byte_issues(files, now, "FILE"), reports.byte_issues(rows, changed, "RECORD"))


def canonical_orders(t: Tables):
    """The digest of every order's canonical JSON."""
    o = t.raw("orders").select("o_orderkey", "o_orderpriority", (F.col("o_totalprice") / 7).alias("o_totalprice"), F.col("o_orderdate").cast("timestamp").alias("o_orderdate"), F.when(F.col("o_orderkey") % 3 == 0, "e\u0301").alias("o_note"))
    return o.select("o_orderkey", F.sha2(integrity.canonical_rows(o, o.columns), 256).alias("digest"))


QUERIES = {
    "n1_case_edges": _plain(chains.case_edges), "n2_asset_edges": _plain(chains.asset_edges), "n3_omissions": _plain(chains.omissions), "n4_chain_summary": _plain(chains.summary),
    "e10_timeline": _plain(chains.timeline), "c5_orphans": _plain(lambda t: chains.orphans(t, t.spark.createDataFrame([("cases",), ("alerts",)], "record_type string"))),
    "i2_commitments": _plain(lambda t: committed_cases(t).drop("submission_id")), "i4_merkle_roots": _plain(lambda t: integrity.roots(case_leaves(t))), "i5_inclusion_proofs": _plain(verified_proofs),
    "i8_custody_chain": _plain(lambda t: integrity.chain(custody_events(t))), "i9_chain_audit": _plain(lambda t: integrity.audit(tampered_log(t))),
    "i11_evidence_audit": _plain(audit_everything), "i1_canonical_digests": _plain(canonical_orders), "i12_queue_step": _plain(lambda t: integrity.queue_step(queue(t), receipts(t))), "f6_next_batch": _plain(lambda t: integrity.next_batch(queue(t)).select("job_id", F.col("at").alias("made_at"))), "d28_queue_counts": _plain(lambda t: integrity.queue_counts(queue(t))),
    "i1_nfc_digests": _plain(lambda t: docs(t).select("doc_id", F.sha2(integrity.nfc("text"), 256).alias("digest"))),
    "t1_passages": _plain(text.passages), "t2_tokens": _plain(lambda t: docs(t).select("doc_id", F.size(text.tokens(F.col("text"))).cast("bigint").alias("n"), F.sha2(F.array_join(text.tokens(F.col("text")), " "), 256).alias("digest"))),
    "t3_normalized": _plain(lambda t: docs(t).select("doc_id", F.sha2(text.normalized(F.concat(F.lit("[Triage note 7]  "), F.col("text"))), 256).alias("digest"))),
    "t4_chunks": _plain(lambda t: text.chunks(docs(t))), "t5_exact_copies": _plain(lambda t: text.exact_copies(docs(t))),
    "t6_lexical_pairs": _plain(lambda t: text.lexical_pairs(docs(t)).select("a", "b", F.round("score", 6).alias("score"))), "t8_nearest_vectors": _plain(lambda t: text.nearest_vectors(t.raw("embeddings"))),
    "t10_digest_distances": _plain(near_digests), "t15_other_records": _plain(other_records), "t11_matches": _plain(matches),
}
ORACLE = {
    "n1_case_edges": f"{_BASE}, {_EDGES} SELECT * FROM edges", "n2_asset_edges": _BASE + " SELECT asset_id AS chain, 'alert_observed' AS kind, 'asset:' || asset_id AS source, 'alert:' || alert_id AS target FROM alerts WHERE asset_id IN (SELECT asset_id FROM assets)",
    "n3_omissions": _BASE + """ SELECT case_id, 'LINKED_ALERT_ABSENT' AS issue, alert_id AS ref FROM links WHERE alert_id NOT IN (SELECT alert_id FROM alerts)
UNION ALL SELECT case_id, 'NO_ALERT_LINKED', '' FROM cases WHERE case_id NOT IN (SELECT case_id FROM links) UNION ALL SELECT case_id, 'ASSET_ABSENT', asset_id FROM cases WHERE asset_id NOT IN (SELECT asset_id FROM assets)""",
    "n4_chain_summary": f"{_BASE}, {_EDGES} SELECT chain, count(*) AS edges, count(*) FILTER (WHERE kind = 'triaged_into') AS triaged_into, count(*) FILTER (WHERE kind = 'affected_by') AS affected_by, count(*) FILTER (WHERE kind = 'performed_action') AS performed_action, count(*) FILTER (WHERE kind = 'escalated_to') AS escalated_to, count(*) FILTER (WHERE kind = 'remediated_by') AS remediated_by FROM edges GROUP BY chain",
    "e10_timeline": _BASE + """ SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY ts, event, ref) AS n, event, ref FROM (SELECT case_id, created_at AS ts, 'created' AS event, case_id AS ref FROM cases UNION ALL SELECT case_id, closed_at, 'closed', case_id FROM cases WHERE closed_at IS NOT NULL
UNION ALL SELECT case_id, ts, 'action', action_id FROM actions UNION ALL SELECT case_id, ts, 'escalation', escalation_id FROM escalations)""",
    "c5_orphans": _BASE + """ SELECT 'links' AS child, 'cases' AS parent, case_id AS ref, count(*) AS n, 'error' AS severity FROM links WHERE case_id NOT IN (SELECT case_id FROM cases) GROUP BY case_id
UNION ALL SELECT 'links', 'alerts', alert_id, count(*), 'warning' FROM links WHERE alert_id NOT IN (SELECT alert_id FROM alerts) GROUP BY alert_id
UNION ALL SELECT 'actions', 'cases', case_id, count(*), 'error' FROM actions WHERE case_id NOT IN (SELECT case_id FROM cases) GROUP BY case_id
UNION ALL SELECT 'escalations', 'cases', case_id, count(*), 'error' FROM escalations WHERE case_id NOT IN (SELECT case_id FROM cases) GROUP BY case_id""",
    "i2_commitments": f"{_BASE}, {_COMMIT} SELECT case_id, commitment FROM commits",
    "i4_merkle_roots": f"{_BASE}, {_TREE} SELECT batch, h AS root FROM lv{_LEVELS - 1}",
    "i5_inclusion_proofs": f"{_BASE}, {_TREE} SELECT l.batch, l.idx, " + " + ".join(f"(SELECT count(*) FROM lv{k} s WHERE s.batch = l.batch AND s.idx = xor(l.idx >> {k}, 1))" for k in range(_LEVELS - 1)) + f" AS steps, r.h AS root FROM lv0 l JOIN lv{_LEVELS - 1} r ON r.batch = l.batch",
    "i8_custody_chain": f"{_BASE}, {_CHAIN} SELECT entity_id, seq, digest, previous, event_id FROM steps",
    "i9_chain_audit": f"{_BASE}, {_CHAIN}, log AS (SELECT * REPLACE (CASE WHEN seq % 55 = 3 THEN 'CHANGED' ELSE body END AS body) FROM steps WHERE seq % 40 <> 17)," + """ checked AS (SELECT *, row_number() OVER w AS n, coalesce(lag(digest) OVER w, repeat('0', 64)) AS before FROM log WINDOW w AS (PARTITION BY entity_id ORDER BY seq))
SELECT entity_id, seq, 'SEQUENCE_GAP' AS issue FROM checked WHERE seq <> n UNION ALL SELECT entity_id, seq, 'BROKEN_LINK' FROM checked WHERE previous <> before UNION ALL SELECT entity_id, seq, 'PAYLOAD_MISMATCH' FROM checked WHERE sha256(previous || event_id || body) <> digest""",
    "i12_queue_step": _BASE + """, q AS (SELECT case_id AS job_id, CASE severity WHEN 'LOW' THEN 'anchored' WHEN 'HIGH' THEN 'failed' ELSE 'pending' END AS status, case_id::bigint % 7 AS retries, case_id IN (SELECT case_id FROM escalations) AS received FROM cases)
SELECT job_id, CASE WHEN status <> 'anchored' AND retries < 5 THEN CASE WHEN received THEN 'anchored' ELSE 'failed' END ELSE status END AS status, retries + CASE WHEN status <> 'anchored' AND retries < 5 AND NOT received THEN 1 ELSE 0 END AS retries FROM q""",
    "f6_next_batch": _BASE + " SELECT case_id AS job_id, epoch(created_at)::bigint AS made_at FROM cases WHERE severity <> 'LOW' AND case_id::bigint % 7 < 5 ORDER BY made_at, job_id LIMIT 50",
    "d28_queue_counts": _BASE + " SELECT CASE severity WHEN 'LOW' THEN 'anchored' WHEN 'HIGH' THEN 'failed' ELSE 'pending' END AS status, count(*) AS n FROM cases GROUP BY 1",
    "i1_nfc_digests": "SELECT doc_id, sha256(nfc_normalize(text)) AS digest FROM documents",
    "t1_passages": _BASE + """, c AS (SELECT submission_id, 'case:' || case_id AS record, case_id, unnest(['Disposition: ' || CASE WHEN trim(disposition) <> '' THEN disposition END, CASE WHEN root_cause <> 'UNKNOWN' AND trim(root_cause) <> '' THEN 'Root cause: ' || root_cause END, CASE WHEN trim(title) <> '' THEN title END]) AS text FROM cases WHERE NOT is_quarantined),
acted AS (SELECT submission_id, 'action:' || action_id AS record, case_id, action_type, list_filter(list_transform(['notes', 'triage_notes', 'description', 'summary', 'comment'], lambda k: trim(CASE WHEN json_valid(details) THEN json_extract_string(details, '$.' || k) END)), lambda x: x <> '') AS texts FROM actions JOIN cases USING (case_id))
SELECT submission_id, record, case_id, trim(text) AS text FROM (SELECT * FROM c UNION ALL SELECT submission_id, record, case_id, unnest(CASE WHEN len(texts) > 0 THEN texts ELSE ['Action: ' || action_type] END) FROM acted) WHERE trim(text) <> ''""",
    "t2_tokens": f"SELECT doc_id, len({_TOKENS}) AS n, sha256(array_to_string({_TOKENS}, ' ')) AS digest FROM documents",
    "t3_normalized": r"SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS digest FROM documents",
    "t4_chunks": r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w, regexp_split_to_array(text, '\S+') AS g FROM documents),
p AS (SELECT doc_id, len(w) AS total, unnest(range(0, len(w))) AS i, unnest(list_transform(range(1, len(w) + 1), lambda k: length(w[k]))) AS n, unnest(list_transform(range(1, len(w) + 1), lambda k: length(g[k]))) AS gap FROM w WHERE len(w) > 0),
q AS (SELECT *, sum(n + gap) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM p)
SELECT doc_id, k AS chunk, min(stop - n)::bigint AS start_char, max(stop)::bigint AS end_char, count(*) AS words FROM q JOIN range(0, 2000) r(k) ON i >= k * 170 AND i < k * 170 + 195 AND k <= greatest(0, ceil((total - 195) / 170)) GROUP BY doc_id, k""",
    "t5_exact_copies": f"WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents) SELECT doc_id, first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY w) AS first FROM d WHERE len(w) > 0) WHERE doc_id <> first",
    "t6_lexical_pairs": f"WITH {_SHINGLES} SELECT a, b, round(score, 6) AS score FROM lexical",
    "t8_nearest_vectors": "SELECT target, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS target, v.vec_id, round(list_dot_product(q.embedding::double[], v.embedding::double[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) WHERE score >= 0.15) WHERE rank <= 5",
    "t10_digest_distances": f"WITH {_SHINGLES}, {_DIGESTS} SELECT a, b, {_DISTANCE} AS distance FROM lexical JOIN digests x ON x.doc_id = a JOIN digests y ON y.doc_id = b",
    "t15_other_records": f"WITH {_SHINGLES} SELECT a, b FROM lexical JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b WHERE x.doc_id // 3 <> y.doc_id // 3 AND NOT (x.source = y.source AND trim(x.text) = trim(y.text))",
    "i1_canonical_digests": """SELECT o_orderkey, sha256('{"o_note":' || CASE WHEN o_orderkey % 3 = 0 THEN '"é"' ELSE 'null' END || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '","o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_totalprice":' ||
  regexp_replace(regexp_replace(round((o_totalprice / 7), 8)::decimal(28, 8)::varchar, '0+$', ''), '[.]$', '') || '}') AS digest FROM orders""",
    "i11_evidence_audit": f"""{_BASE}, ids AS (SELECT DISTINCT entity_id FROM cases), found AS (SELECT 'CSE-3' AS entity_id, 'ROLLBACK' AS issue FROM cases WHERE entity_id = 'CSE-3' GROUP BY entity_id HAVING count(*) > 5 UNION SELECT 'CSE-4', 'PAYLOAD_MISMATCH' FROM cases WHERE entity_id = 'CSE-4' GROUP BY entity_id HAVING count(*) > 1 UNION SELECT 'CSE-5', 'CHECKPOINT_ROOT_MISMATCH' UNION SELECT 'CSE-8', 'RECORD_DIGEST_MISMATCH'
  UNION SELECT 'CSE-' || (doc_id % 25), CASE WHEN doc_id % 50 = 6 THEN 'FILE_MISSING' ELSE 'FILE_DIGEST_MISMATCH' END FROM documents WHERE doc_id % 50 IN (6, 7))
SELECT entity_id, CASE WHEN i IS NULL THEN 'VALID' ELSE 'TAMPERED' END AS verdict, coalesce(i, '') AS issues FROM ids LEFT JOIN (SELECT entity_id, string_agg(DISTINCT issue, ',' ORDER BY issue) AS i FROM found GROUP BY entity_id) USING (entity_id)""",
    "t11_matches": f"""WITH {_SHINGLES}, {_DIGESTS}, tf AS (SELECT doc_id, w, 1 + ln(count(*)) AS tf FROM (SELECT doc_id, unnest(w) AS w FROM toks) WHERE length(w) > 1 GROUP BY doc_id, w), norms AS (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM tf GROUP BY doc_id),
cos AS (SELECT l.a, l.b, least(1.0, sum(x.tf * y.tf) / (min(na.norm) * min(nb.norm))) AS cosine FROM lexical l JOIN tf x ON x.doc_id = l.a JOIN tf y ON y.doc_id = l.b AND y.w = x.w JOIN norms na ON na.doc_id = l.a JOIN norms nb ON nb.doc_id = l.b GROUP BY l.a, l.b),
j AS (SELECT l.a, l.b, cosine, score, ta.w AS wa, tb.w AS wb, lower(da.text) || chr(10) || lower(db.text) AS texts, {_DISTANCE} AS distance, list_has_any(ta.w, ['not', 'never', 'no', 'neither']) <> list_has_any(tb.w, ['not', 'never', 'no', 'neither']) AS negation
  FROM lexical l JOIN cos USING (a, b) JOIN toks ta ON ta.doc_id = l.a JOIN toks tb ON tb.doc_id = l.b JOIN documents da ON da.doc_id = l.a JOIN documents db ON db.doc_id = l.b JOIN digests x ON x.doc_id = l.a JOIN digests y ON y.doc_id = l.b),
m AS (SELECT *, 0.6::double * cosine + 0.4::double * score AS mixed FROM j),
n AS (SELECT *, CASE WHEN distance <= 30 THEN greatest(mixed, 0.85) WHEN distance > 150 THEN least(mixed, 0.6) ELSE mixed END AS bounded FROM m),
k AS (SELECT *, CASE WHEN wa = wb THEN 1.0 ELSE round(CASE WHEN negation THEN least(bounded, 0.45) ELSE bounded END, 4) END AS composite FROM n)
SELECT a, b, round(cosine, 6) AS cosine, round(score, 6) AS lexical, distance, negation, composite, CASE WHEN composite < 0.35 THEN 'insufficient_evidence' WHEN regexp_matches(texts, 'playbook|automated|scanner|script|rule|signature|cron') THEN 'possible_playbook_template'
  WHEN regexp_matches(texts, 'benign|false positive|authorized|maintenance|normal activity') THEN 'possible_repeated_benign' WHEN regexp_matches(texts, 'vendor|external|soc-tier3|cert|forensic lab|third-party') THEN 'possible_external_investigation' WHEN composite > 0.7 THEN 'possible_playbook_template' ELSE 'possible_repeated_benign' END AS explanation FROM k""",
}
