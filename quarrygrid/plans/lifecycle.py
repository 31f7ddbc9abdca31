"""Registered queries: index lifecycle. Earlier states are derived from the tables by moduli of the ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrygrid.common import table
from quarrygrid.operators import lexical as lx
from quarrygrid.operators import lifecycle as lc
from quarrygrid.plans import base



def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "source", F.sha2("text", 256).alias("content_hash"))


def _snapshots(spark, sf):
    d = _docs(spark, sf)
    cur = d.select(F.col("doc_id").alias("path"), "content_hash")
    prev = d.where(F.col("doc_id") % 10 != 0).select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 7 == 1, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.col("content_hash")).alias("content_hash"))
    return cur, prev.unionByName(d.where(F.col("doc_id") % 11 == 2).select((F.col("doc_id") + 1000000).alias("path"), "content_hash"))


def detect_changes(spark, sf):
    return lc.detect_changes(*_snapshots(spark, sf))


def _plan(spark, sf):
    p = F.col("path")
    changes = lc.detect_changes(*_snapshots(spark, sf))
    states = changes.where("change_type <> 'added'").select("path", F.when(p % 13 == 0, "deleted").when(p % 13 == 1, "failed").otherwise("indexed").alias("index_status"), F.when(p % 5 == 0, "p1").otherwise("p2").alias("parser_version"), F.lit("c1").alias("chunking_version"))
    failures = changes.where(p % 29 == 3).select("path", F.lit("hash").alias("stage"))
    return lc.sync_plan(changes, states, failures, "p2", "c1")


def sync_plan(spark, sf):
    return _plan(spark, sf)


def run_summary(spark, sf):
    return lc.run_summary(_plan(spark, sf))


def purge_deleted(spark, sf):
    d = _docs(spark, sf)
    chunks = d.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index"))
    return lc.purge_deleted(chunks, d.where(F.col("doc_id") % 9 != 0).select("doc_id", F.when(F.col("doc_id") % 4 == 0, "deleted").otherwise("indexed").alias("index_status")))


def stale_embeddings(spark, sf):
    e, i = table(spark, sf, "embeddings"), F.col("vec_id")
    chunks = e.select(i.alias("chunk_id"), F.when(i % 5 != 0, F.when(i % 7 == 3, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))).alias("embedding"), F.when(i % 5 == 1, "old").otherwise("m").alias("embedding_model"), F.when(i % 5 == 2, "h0").otherwise("h1").alias("input_hash"))
    return lc.stale_embeddings(chunks, e.select(i.alias("chunk_id"), F.lit("h1").alias("input_hash")), "m", 64)


def _index(spark, sf):
    c = F.col("chunk_id")
    chunks = base.chunks(spark, sf).withColumn("kb_id", F.col("lang"))
    terms = lx.term_frequencies(chunks)
    stats = lx.chunk_statistics(terms).where(c % 19 != 0).select("kb_id", "chunk_id", (F.col("document_length") + F.when((c % 23 == 5) & (F.col("kb_id") != "en"), 1).otherwise(0)).alias("document_length"), F.when((c % 31 == 7) & (F.col("kb_id") != "en"), "f0").otherwise("f1").alias("fingerprint"))
    return chunks, terms, stats


def lexical_staleness(spark, sf):
    chunks, terms, stats = _index(spark, sf)
    return lc.lexical_staleness(chunks, stats, terms, "f1")


def lexical_readiness(spark, sf):
    chunks, terms, stats = _index(spark, sf)
    chunks = chunks.where("chunk_id % 19 <> 0 or kb_id = 'de'")
    return lc.lexical_readiness(chunks, stats, terms, lx.corpus_statistics(stats), "f1")


def corpus_drift(spark, sf):
    d = _docs(spark, sf)
    source = d.where(F.col("doc_id") % 12 != 0).select("doc_id", "content_hash", F.lit(2).alias("n_chunks"))
    docs = d.where(F.col("doc_id") % 15 != 1).select("doc_id", F.when(F.col("doc_id") % 8 == 3, "changed").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("doc_id") % 24 == 0, "deleted").when(F.col("doc_id") % 10 == 7, "pending").otherwise("indexed").alias("index_status"))
    docs = docs.unionByName(docs.where(F.col("doc_id") % 50 == 9))
    vec = F.when(F.col("doc_id") % 6 == 5, F.lit(None)).when(F.col("doc_id") % 14 == 2, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))
    chunks = d.where(F.col("doc_id") % 20 != 4).select((F.col("doc_id") * 2).alias("chunk_id"), "doc_id", vec.alias("embedding")).unionByName(d.where(F.col("doc_id") % 3 != 0).select((F.col("doc_id") * 2 + 1).alias("chunk_id"), "doc_id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding")))
    return lc.corpus_drift(source, docs, chunks, 2)


def chunk_boundary_audit(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "line"))
    e = d.select("doc_id", "chunk_index", F.sha2("line", 256).alias("content_hash"), (F.col("chunk_index") + 1).alias("start_line"), (F.col("chunk_index") + 1).alias("end_line"))
    k = F.col("doc_id") + F.col("chunk_index")
    a = e.where(k % 17 != 0).select("doc_id", "chunk_index", F.when(k % 5 == 1, "x").otherwise(F.col("content_hash")).alias("content_hash"), "start_line", (F.col("end_line") + F.when(k % 11 == 3, 1).otherwise(0)).alias("end_line"))
    return lc.chunk_boundary_audit(e, a)


def snapshot_delta(spark, sf):
    d = _docs(spark, sf)
    prev = d.where(F.col("doc_id") % 10 != 0).select(F.col("doc_id").alias("source_id"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("canonical_id"), "content_hash")
    cur = d.where(F.col("doc_id") % 9 != 1).select(F.when(F.col("doc_id") % 40 == 5, -F.col("doc_id")).otherwise(F.col("doc_id")).alias("source_id"), F.when(F.col("doc_id") % 6 == 2, F.concat(F.lit("n"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("c"), F.col("doc_id").cast("string"))).alias("canonical_id"), F.when(F.col("doc_id") % 7 == 3, "z").otherwise(F.col("content_hash")).alias("content_hash"))
    return lc.snapshot_delta(prev, cur)


def graph_freshness(spark, sf):
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("graph_id"), F.col("c_nationkey").alias("corpus_id"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey") % 4).alias("revision"), F.concat(F.lit("d"), (F.col("c_custkey") % 5).cast("string")).alias("digest"))
    c = table(spark, sf, "nation").where("n_nationkey % 6 <> 0").select(F.col("n_nationkey").alias("corpus_id"), (F.col("n_nationkey") % 3).alias("revision"), F.concat(F.lit("d"), (F.col("n_nationkey") % 5).cast("string")).alias("digest"))
    return lc.graph_freshness(b, c)


def graph_impact(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("source_id"), (F.col("o_orderkey") % 97 + 1000000).alias("target_id"))
    ch = table(spark, sf, "customer").where("c_custkey % 12 < 4").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 12 == 0, "removed").when(F.col("c_custkey") % 12 == 1, "identity_changed").otherwise("content_changed").alias("delta"))
    return lc.graph_impact(o, ch.unionByName(spark.range(1000000, 1000097, 10).select(F.col("id").alias("doc_id"), F.lit("content_changed").alias("delta"))))


QUERIES = {f.__name__: f for f in (detect_changes, sync_plan, run_summary, purge_deleted, stale_embeddings, lexical_staleness, lexical_readiness, corpus_drift, chunk_boundary_audit, snapshot_delta, graph_freshness, graph_impact)}

_CH = """cur AS (SELECT doc_id AS path, sha256(text) AS h FROM documents), prv AS (SELECT doc_id AS path, CASE WHEN doc_id % 7 = 1 THEN sha256(text || 'x') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id + 1000000, sha256(text) FROM documents WHERE doc_id % 11 = 2),
ch AS (SELECT coalesce(c.path, p.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' WHEN c.h <> p.h THEN 'modified' ELSE 'unchanged' END AS change_type FROM cur c FULL JOIN prv p USING (path))"""
_PLAN = f"""{_CH}, pl AS (SELECT path, CASE WHEN path % 29 = 3 THEN 'keep' WHEN change_type = 'deleted' AND path % 13 = 0 THEN 'skip' WHEN change_type = 'deleted' THEN 'delete' WHEN change_type <> 'added' AND path % 13 = 0 THEN 'restore' WHEN change_type = 'added' THEN 'create' WHEN change_type = 'modified' THEN 'update' WHEN path % 13 = 1 THEN 'retry' WHEN path % 5 = 0 THEN 'reprocess' ELSE 'skip' END AS action FROM ch)"""
_LX = f"""t AS (SELECT lang AS kb, doc_id AS c, unnest({base.sql_tokens('text')}) AS term FROM documents), n AS (SELECT kb, c, count(*) AS total FROM t GROUP BY 1, 2),
s AS (SELECT kb, c, total + CASE WHEN c % 23 = 5 AND kb <> 'en' THEN 1 ELSE 0 END AS len, CASE WHEN c % 31 = 7 AND kb <> 'en' THEN 'f0' ELSE 'f1' END AS fp FROM n WHERE c % 19 <> 0),
st AS (SELECT d.doc_id AS chunk_id, d.lang, s.len, CASE WHEN s.len IS NULL THEN 'no_stats' WHEN fp <> 'f1' THEN 'fingerprint' WHEN len <= 0 THEN 'empty' WHEN total <> len THEN 'mismatch' END AS reason FROM documents d LEFT JOIN s ON s.c = d.doc_id LEFT JOIN n ON n.c = d.doc_id)"""
ORACLE_SQL = {
    "detect_changes": f"WITH {_CH} SELECT * FROM ch",
    "sync_plan": f"WITH {_PLAN} SELECT * FROM pl",
    "run_summary": f"WITH {_PLAN} SELECT count(*) AS discovered, count(*) FILTER (WHERE action IN ('create', 'restore')) AS created, count(*) FILTER (WHERE action IN ('update', 'reprocess', 'retry')) AS updated, count(*) FILTER (WHERE action = 'delete') AS deleted, count(*) FILTER (WHERE action = 'skip') AS skipped, count(*) FILTER (WHERE action = 'keep') AS failed FROM pl",
    "purge_deleted": "SELECT doc_id, CAST(i AS INTEGER) AS chunk_index FROM documents JOIN (SELECT unnest([0, 1]) AS i) ON true WHERE doc_id % 9 <> 0 AND doc_id % 4 <> 0",
    "stale_embeddings": "SELECT * FROM (SELECT vec_id AS chunk_id, CASE WHEN vec_id % 5 = 0 THEN 'missing' WHEN vec_id % 5 = 1 THEN 'model' WHEN vec_id % 7 = 3 THEN 'dimension' WHEN vec_id % 5 = 2 THEN 'input' END AS reason FROM embeddings) WHERE reason IS NOT NULL",
    "lexical_staleness": f"WITH {_LX} SELECT chunk_id, reason FROM st WHERE reason IS NOT NULL",
    "lexical_readiness": f"""WITH {_LX}, g AS (SELECT lang AS kb_id, count(*) AS n_expected, count(len) AS n_indexed, count(reason) AS n_stale, coalesce(sum(len), 0) AS length FROM st WHERE chunk_id % 19 <> 0 OR lang = 'de' GROUP BY 1), c AS (SELECT kb AS kb_id, count(*) AS n, sum(len) AS total FROM s GROUP BY 1)
SELECT kb_id, n_expected, n_indexed, n_stale, coalesce(n = n_indexed AND total = length, false) AS corpus_ok, n_expected = n_indexed AND n_stale = 0 AND coalesce(n = n_indexed AND total = length, false) AS ready FROM g LEFT JOIN c USING (kb_id)""",
    "corpus_drift": f"""WITH x AS (SELECT doc_id AS i, doc_id % 12 <> 0 AS src, doc_id % 15 <> 1 AS idx, doc_id % 8 = 3 AS chg, CASE WHEN doc_id % 24 = 0 THEN 'deleted' WHEN doc_id % 10 = 7 THEN 'pending' ELSE 'indexed' END AS st, doc_id % 20 <> 4 AS c1, doc_id % 3 <> 0 AS c2 FROM documents),
y AS (SELECT *, idx AND st <> 'deleted' AS live, CAST(c1 AS INTEGER) + CAST(c2 AS INTEGER) AS n FROM x),
z AS (SELECT i, unnest(list_filter_placeholder) AS issue FROM y)
SELECT z.i AS doc_id, z.issue, k.risk, k.action FROM z JOIN (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in lc.DRIFT_CONTRACT)}) k(issue, risk, action) ON k.issue = z.issue""".replace(
        "list_filter_placeholder",
        """[q FOR q IN [CASE WHEN src AND NOT idx THEN 'missing_document' END, CASE WHEN idx AND i % 50 = 9 THEN 'duplicate_document' END, CASE WHEN src AND live AND chg THEN 'stale_content' END, CASE WHEN NOT src AND live THEN 'unexpected_document' END,
  CASE WHEN NOT src AND idx AND st = 'deleted' AND n > 0 THEN 'residual_deleted' END, CASE WHEN src AND live AND st <> 'indexed' THEN 'not_active' END, CASE WHEN src AND live AND n <> 2 THEN 'chunk_count' END, CASE WHEN live AND c1 AND i % 6 = 5 THEN 'missing_embedding' END,
  CASE WHEN live AND c1 AND i % 6 <> 5 AND i % 14 = 2 THEN 'embedding_size' END, CASE WHEN NOT idx AND n > 0 THEN 'orphan_chunk' END] IF q IS NOT NULL]""",
    ),
    "chunk_boundary_audit": """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), k AS (SELECT doc_id, doc_id + i AS k FROM l)
SELECT doc_id, count(*) AS n_expected, count(*) FILTER (WHERE k % 17 <> 0) AS n_actual, count(*) FILTER (WHERE k % 17 <> 0 AND (k % 5 = 1 OR k % 11 = 3)) AS n_changed,
  concat_ws(',', CASE WHEN count(*) FILTER (WHERE k % 17 <> 0 AND k % 5 = 1) > 0 THEN 'content_hash' END, CASE WHEN count(*) FILTER (WHERE k % 17 <> 0 AND k % 11 = 3) > 0 THEN 'end_line' END) AS fields, count(*) <> count(*) FILTER (WHERE k % 17 <> 0) AS count_mismatch FROM k GROUP BY 1""",
    "snapshot_delta": """WITH p AS (SELECT doc_id AS s, 'c' || doc_id AS i, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0), c AS (SELECT CASE WHEN doc_id % 40 = 5 THEN -doc_id ELSE doc_id END AS s, CASE WHEN doc_id % 6 = 2 THEN 'n' || doc_id ELSE 'c' || doc_id END AS i, CASE WHEN doc_id % 7 = 3 THEN 'z' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 9 <> 1)
SELECT coalesce(p.s, c.s) AS source_id, CASE WHEN p.i IS NULL AND c.i IN (SELECT i FROM p) THEN 'moved' WHEN p.i IS NULL THEN 'added' WHEN c.i IS NULL THEN 'removed' WHEN p.i <> c.i THEN 'identity_changed' WHEN p.h <> c.h THEN 'content_changed' ELSE 'unchanged' END AS delta FROM p FULL JOIN c USING (s)""",
    "graph_freshness": """WITH b AS (SELECT c_custkey AS g, c_nationkey AS c, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 4 END AS r, c_custkey % 5 AS d FROM customer), r AS (SELECT g, CASE WHEN b.r IS NULL THEN 'binding_incomplete' WHEN n_nationkey IS NULL THEN 'corpus_unknown' WHEN b.r > n_nationkey % 3 THEN 'revision_ahead' WHEN b.r < n_nationkey % 3 THEN 'revision_behind' WHEN d <> n_nationkey % 5 THEN 'digest_differs' ELSE 'current' END AS reason FROM b LEFT JOIN nation ON n_nationkey = c AND n_nationkey % 6 <> 0)
SELECT g AS graph_id, CASE WHEN reason = 'current' THEN 'fresh' WHEN reason IN ('binding_incomplete', 'corpus_unknown') THEN 'unassessable' WHEN reason IN ('revision_ahead', 'digest_differs') THEN 'invalid' ELSE 'stale' END AS freshness, reason FROM r""",
    "graph_impact": """WITH c AS (SELECT c_custkey AS d, CASE WHEN c_custkey % 12 = 0 THEN 'removed' WHEN c_custkey % 12 = 1 THEN 'identity_changed' ELSE 'content_changed' END AS k FROM customer WHERE c_custkey % 12 < 4), e AS (SELECT o_orderkey AS edge_id, o_custkey AS s, o_orderkey % 97 AS t FROM orders),
j AS (SELECT e.*, CASE WHEN k = 'removed' THEN 'remove' WHEN k = 'identity_changed' THEN 'rebind' WHEN k = 'content_changed' THEN 'revalidate' WHEN t % 10 = 0 THEN 'recheck' ELSE 'none' END AS impact FROM e LEFT JOIN c ON c.d = e.s)
SELECT edge_id, impact, impact = 'none' AND (s IN (SELECT s FROM j WHERE impact <> 'none') OR t IN (SELECT t FROM j WHERE impact <> 'none')) AS secondary FROM j""",
}
