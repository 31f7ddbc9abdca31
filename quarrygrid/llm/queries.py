"""Registered queries of the training-data operators, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrygrid.llm import bpe, fingerprint, licenses, neardup, packing, quality, ranked, secrets, toxicity, url_filter, vecdup, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_knn": quality.op1_quality_knn,
    "op2_url_bloom_cascade": url_filter.op2_url_bloom_cascade,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_setsketch_dedup": neardup.op4_setsketch_dedup,
    "op5_nnls_packing": packing.op5_nnls_packing,
    "op6_crosspolytope_dedup": vecdup.op6_crosspolytope_dedup,
    "op7_bpe_transducer": bpe.op7_bpe_transducer,
    "op8_warc_chain": warc.op8_warc_chain,
    "op9_prefix_fingerprint": fingerprint.op9_prefix_fingerprint,
    "op10_secret_forest": secrets.op10_secret_forest,
    "op11_kneser_ney_toxicity": toxicity.op11_kneser_ney_toxicity,
    "op12_cholesky_jacobi_whitening": whitening.op12_cholesky_jacobi_whitening,
    "op13_term_pipeline_search": ranked.op13_term_pipeline_search,
}

#: All pairs by shared shingles or by brute force, and components by a recursive walk: for small tables.
_WALK = """, e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
walk AS (SELECT id, id AS reach FROM ids UNION SELECT w.id, e.b FROM walk w JOIN e ON e.a = w.reach),
parts AS (SELECT id, min(reach) AS component_id FROM walk GROUP BY 1)"""
OP4_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x09-\\x0D\\x20]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
p AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
ids AS (SELECT doc_id AS id FROM documents){_WALK}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = id AS kept FROM parts LEFT JOIN n ON doc_id = id
"""
OP6_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL),
p AS (SELECT l.vec_id AS a, r.vec_id AS b FROM v l JOIN v r ON l.label = r.label AND l.vec_id < r.vec_id WHERE list_cosine_similarity(l.x, r.x) >= 0.93),
ids AS (SELECT vec_id AS id FROM embeddings){_WALK}
SELECT id AS vec_id, (SELECT count(*) FROM e WHERE e.a = id) AS n_links, component_id, component_id = id AS kept FROM parts
"""

ORACLE_SQL: dict[str, str] = {
    "op4_setsketch_dedup": OP4_SQL,
    "op6_crosspolytope_dedup": OP6_SQL,
    "op2_url_bloom_cascade": url_filter.OP2_SQL,
    "op3_license_scan": licenses.OP3_SQL,
    "op8_warc_chain": warc.OP8_SQL,
    "op13_term_pipeline_search": ranked.OP13_SQL,
}
