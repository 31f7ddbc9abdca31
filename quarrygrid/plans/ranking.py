"""Registered queries: fusion, reranking and selection over the BM25 list (a) and the overlap list (b) of every benchmark text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrygrid.common import table
from quarrygrid.operators import lexical as lx
from quarrygrid.operators import ranking as rk
from quarrygrid.plans import base

long = lambda c: F.col(c).cast("long").alias(c)
r6 = lambda c: F.round(c, 6).alias(c)


def _lists(spark, sf):
    a = base.bm25(spark, sf).select("query_id", "chunk_id", "rank", "score", "n_matched")
    b = base.overlap(spark, sf).select("query_id", "chunk_id", "rank", F.col("score").cast("double").alias("score"))
    return a, b


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.floor(F.col("doc_id") / 10).cast("long").alias("section_id"), F.col("text").alias("content"), "n_chars", "lang")


def rrf_hybrid(spark, sf):
    a, b = _lists(spark, sf)
    out = rk.rrf_hybrid(a, b)
    return out.select("query_id", "chunk_id", long("rank"), long("vector_rank"), long("bm25_rank"), r6("rrf_score"), F.array_join("sources", "+").alias("sources"))


def rrf_many(spark, sf):
    a, b = _lists(spark, sf)
    return rk.rrf_many([a, b, a.where("rank <= 5")]).select("query_id", "chunk_id", long("rank"), r6("score"), "n_lists")


def rank_fusion(spark, sf):
    a, b = _lists(spark, sf)
    both = a.select("query_id", "chunk_id", F.col("rank").alias("retrieval_rank")).join(b.select("query_id", "chunk_id", F.col("rank").alias("rerank_rank")), ["query_id", "chunk_id"])
    return rk.rank_fusion(both).select("query_id", "chunk_id", long("retrieval_rank"), long("rerank_rank"), r6("fusion_score"), long("final_rank"))


def rerank(spark, sf):
    a, _ = _lists(spark, sf)
    rows = a.select("query_id", "chunk_id", F.col("rank").alias("retrieval_rank")).join(base.search_queries(spark, sf).select("query_id", F.col("text").alias("query_text")), "query_id").join(_docs(spark, sf).select("chunk_id", "content"), "chunk_id")
    return rk.rerank(rows, 10).select("query_id", "chunk_id", long("retrieval_rank"), r6("rerank_score"), long("rerank_rank"))


def _maxsim(spark, sf):
    return rk.token_maxsim(base.search_queries(spark, sf), base.chunks(spark, sf))


def token_maxsim(spark, sf):
    return _maxsim(spark, sf).select("query_id", "chunk_id", long("rank"), r6("score"))


def late_rerank_pool(spark, sf):
    a, _ = _lists(spark, sf)
    return rk.late_rerank_pool(a, _maxsim(spark, sf)).select("query_id", "chunk_id", long("dense_rank"), r6("late_score"), long("rank"))


def candidate_union(spark, sf):
    a, b = _lists(spark, sf)
    return rk.candidate_union({"bm25": a, "overlap": b}).select("query_id", "chunk_id", long("best_rank"), long("rank"), F.array_join("sources", "+").alias("sources"))


def tiered_fusion(spark, sf):
    a, b = _lists(spark, sf)
    return rk.tiered_fusion(a, b).select("query_id", "chunk_id", "tier", r6("score"), long("rank"))


def _lanes(spark, sf):
    a, b = _lists(spark, sf)
    both = a.select("query_id", "chunk_id", F.col("rank").alias("x")).join(b.select("query_id", "chunk_id", F.col("rank").alias("y")), ["query_id", "chunk_id"], "full_outer")
    lane = F.when(F.col("x").isNull(), "late").when(F.col("y").isNull(), "dense").otherwise("overlap")
    return both.select("query_id", "chunk_id", lane.alias("lane"), F.least("x", "y").alias("rank"))


def lane_quota(spark, sf):
    return rk.lane_quota(_lanes(spark, sf), {"dense": 3, "late": 2, "overlap": 4}, 12).select("query_id", "chunk_id", "lane", long("rank"), "seeded", long("slot"))


VARIANT_RULES = (("synonym", "the", "this"), ("expansion", r"^", "about "), ("style", r"[.]", ";"))


def query_variants(spark, sf):
    return rk.query_variants(base.search_queries(spark, sf), VARIANT_RULES).select("query_id", long("variant"), "kind", "text")


def multi_query_merge(spark, sf):
    a, b = _lists(spark, sf)
    hits = a.select("query_id", F.lit(0).alias("variant"), "chunk_id", "rank", "score").unionByName(b.select("query_id", F.lit(1).alias("variant"), "chunk_id", "rank", "score"))
    return rk.multi_query_merge(hits).select("query_id", "chunk_id", long("best_rank"), F.round("best_score", 4).alias("best_score"), F.array_join(F.transform("variants", lambda v: v.cast("string")), ",").alias("variants"), r6("score"), long("rank"))


def _spanned(spark, sf):
    """The union's candidates with made-up line spans of their document (the source)."""
    u = rk.candidate_union(dict(zip(("bm25", "overlap"), _lists(spark, sf), strict=True)))
    d = _docs(spark, sf).select("chunk_id", "doc_id", F.sha2("content", 256).alias("content_hash"), (F.col("chunk_id") % 40).alias("start_line"), (F.col("chunk_id") % 40 + F.col("n_chars") % 17).alias("end_line"), F.ceil(F.col("n_chars") / 4).cast("int").alias("n_tokens"), "section_id")
    return u.select("query_id", "chunk_id", "rank").join(d, "chunk_id")


def dedup_candidates(spark, sf):
    return rk.dedup_candidates(_spanned(spark, sf)).select("query_id", "chunk_id", "rank", "dedup_rank")


def context_budget(spark, sf):
    return rk.context_budget(_spanned(spark, sf).select("query_id", "chunk_id", "doc_id", "rank", "n_tokens"), 1500, 5, 1).where("context_rank is not null").select("query_id", "chunk_id", long("rank"), long("context_rank"))


def evidence_compose(spark, sf):
    rows = _lanes(spark, sf).join(_docs(spark, sf).select("chunk_id", "doc_id", "section_id"), "chunk_id")
    return rk.evidence_compose(rows.select("query_id", "chunk_id", "doc_id", "section_id", "lane", "rank"))


def evidence_signals(spark, sf):
    a, b = _lists(spark, sf)
    n = lx.query_terms(base.search_queries(spark, sf)).groupBy("query_id").agg(F.count("*").alias("n_terms"))
    rows = a.join(b.select("query_id", "chunk_id", F.lit(1).alias("other")), ["query_id", "chunk_id"], "left").join(n, "query_id").join(_docs(spark, sf).select("chunk_id", "doc_id"), "chunk_id")
    out = rk.evidence_signals(rows.withColumn("n_sources", 1 + F.coalesce("other", F.lit(0))))
    return out.select("query_id", *[F.round(c, 4).alias(c) for c in ("top_score", "second_score", "min_score", "mean_score", "margin", "term_coverage")], "n_dual", "n_documents", "n_candidates")


def _scored(spark, sf):
    return _lists(spark, sf)[0].join(_docs(spark, sf).select("chunk_id", "doc_id"), "chunk_id")


def score_guard(spark, sf):
    out = rk.score_guard(_scored(spark, sf), 0.4, 0.97)
    return out.select("query_id", *[F.round(c, 4).alias(c) for c in ("margin", "margin5", "entropy", "diversity", "mean_score", "confidence")], "trigger", "trigger_v2")


def guarded_retrieval(spark, sf):
    a, _ = _lists(spark, sf)
    guard = rk.score_guard(_scored(spark, sf), 0.4, 0.97)
    postings = lx.term_frequencies(base.chunks(spark, sf))
    out = rk.guarded_retrieval(a, base.search_queries(spark, sf), lambda q: lx.term_set_scores(q, postings, 20), guard, 10)
    return out.select("query_id", "chunk_id", long("rank"), "guarded")


def hierarchical_topk(spark, sf):
    a, _ = _lists(spark, sf)
    return rk.hierarchical_topk(a.select("query_id", "chunk_id", "rank", "score"), _docs(spark, sf).select("chunk_id", "doc_id", "section_id")).select("query_id", "chunk_id", "doc_id", "section_id", long("rank"))


def parent_child_topk(spark, sf):
    out = rk.parent_child_topk(base.vector_queries(spark, sf), table(spark, sf, "embeddings"), "label")
    return out.select("query_id", "label", "vec_id", F.round("similarity", 6).alias("similarity"), long("rank"))


def _lines(spark, sf):
    """The lines of the documents as chunks, and every third line as a heading of a section of three lines."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where("line <> ''")
    chunks = lines.select((F.col("doc_id") * 100000 + F.col("i")).alias("chunk_id"), "doc_id", (F.col("i") + 1).alias("start_line"), (F.col("i") + 1).alias("end_line"))
    sections = chunks.where("(start_line - 1) % 3 = 0").select("doc_id", F.col("chunk_id").alias("section_id"), F.when(F.col("start_line") == 1, 1).otherwise(2).alias("level"), "start_line", (F.col("start_line") + 2).alias("end_line"))
    return chunks, sections


def _structure(spark, sf):
    seeds = _lists(spark, sf)[0].where("rank <= 3").select("query_id", F.col("chunk_id").alias("doc_id"))
    chunks, sections = _lines(spark, sf)
    return rk.section_lane(seeds, sections, chunks)


def section_lane(spark, sf):
    return _structure(spark, sf)


GUARD_PHRASES = ("the and", "one", "tion")


def lane_guard(spark, sf):
    return rk.lane_guard(base.search_queries(spark, sf), GUARD_PHRASES, _structure(spark, sf))


def merge_lanes(spark, sf):
    a, b = _lists(spark, sf)
    return rk.merge_lanes(a, b.where("rank <= 4"), a.where("rank > 10").unionByName(b.where("rank between 8 and 12"), allowMissingColumns=True)).select("query_id", "chunk_id", long("rank"), F.array_join("sources", "+").alias("sources"))


def hydrate_chunks(spark, sf):
    a, _ = _lists(spark, sf)
    ranked = a.select("query_id", F.when(F.col("chunk_id") % 13 == 0, -F.col("chunk_id")).otherwise(F.col("chunk_id")).alias("chunk_id"), "rank")
    d = table(spark, sf, "documents")
    chunks = d.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("source").alias("path"), F.col("text").alias("content"))
    docs = d.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "deleted").otherwise("indexed").alias("index_status"))
    return rk.hydrate_chunks(ranked, chunks, docs).select("query_id", "chunk_id", long("rank"), "path", F.sha2("content", 256).alias("content_sha"), "known")


def score_features(spark, sf):
    out = rk.score_features(_scored(spark, sf))
    return out.select("query_id", *[F.round(c, 4).alias(c) for c in ("s1", "s2", "s5", "s10", "s20", "mean_score", "std_score", "range_score", "slope", "entropy", "same_value_ratio", "margin12", "margin15")], "n_documents")


QUERIES = {f.__name__: f for f in (
    rrf_hybrid, rrf_many, rank_fusion, rerank, token_maxsim, late_rerank_pool, candidate_union, tiered_fusion, lane_quota, query_variants, multi_query_merge, dedup_candidates, context_budget, evidence_compose,
    evidence_signals, score_guard, guarded_retrieval, hierarchical_topk, parent_child_topk, section_lane, lane_guard, merge_lanes, hydrate_chunks, score_features,
)}

_FULL = "j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS x, b.rank AS y FROM bm a FULL JOIN ov b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id)"
_MAX = f"""
qm AS (SELECT item_id AS query_id, unnest(list_distinct({base.sql_tokens("text")})) AS token FROM benchmark),
dm AS (SELECT doc_id AS chunk_id, unnest(list_distinct({base.sql_tokens("text")})) AS token FROM documents),
qn AS (SELECT query_id, count(*) AS n FROM qm GROUP BY 1),
ms AS (SELECT query_id, chunk_id, round(2.0 * count(*) / any_value(n), 9) AS score FROM qm JOIN dm USING (token) JOIN qn USING (query_id) GROUP BY 1, 2),
mx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ms) WHERE rank <= 20)"""
_LANE = f"{_FULL}, lanes AS (SELECT query_id, chunk_id, CASE WHEN x IS NULL THEN 'late' WHEN y IS NULL THEN 'dense' ELSE 'overlap' END AS lane, least(x, y) AS rank FROM j)"
_GUARD = """
t AS (SELECT b.*, d.source AS doc_id, b.score / sum(b.score) OVER (PARTITION BY query_id) AS share FROM bm b JOIN documents d ON d.doc_id = b.chunk_id),
g AS (SELECT query_id, max(score) FILTER (WHERE rank = 1) AS s1, max(score) FILTER (WHERE rank = 2) AS s2, max(score) FILTER (WHERE rank = 5) AS s5, count(*) AS n, sum(-share * ln(share)) AS h, avg(score) AS mean_score,
  count(DISTINCT doc_id) FILTER (WHERE rank <= 5) / count(*) FILTER (WHERE rank <= 5) AS diversity FROM t GROUP BY 1),
gg AS (SELECT *, CASE WHEN n > 1 THEN h / ln(n) ELSE 1 END AS entropy, (s1 - coalesce(s2, 0)) / s1 AS margin, (s1 - coalesce(s5, 0)) / s1 AS margin5 FROM g),
guard AS (SELECT *, 0.5 * margin + 0.3 * (1 - entropy) + 0.2 * diversity AS confidence FROM gg)"""
_STRUCT = """
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
ch AS (SELECT doc_id * 100000 + i AS chunk_id, doc_id, i + 1 AS start_line FROM ln WHERE line <> ''),
sec AS (SELECT doc_id, chunk_id AS section_id, start_line, start_line + 2 AS end_line, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) AS n FROM ch WHERE (start_line - 1) % 3 = 0 AND start_line <> 1),
struct_lane AS (SELECT s.query_id, c.doc_id, x.section_id, c.chunk_id FROM bm s JOIN sec x ON x.doc_id = s.chunk_id AND x.n <= 2 JOIN ch c ON c.doc_id = x.doc_id AND c.start_line BETWEEN x.start_line AND x.end_line WHERE s.rank <= 3)"""
_TIER = f"{_FULL}, tf AS (SELECT query_id, chunk_id, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 0 WHEN x <= 5 THEN 1 ELSE 2 END AS tier, round(coalesce(1.0 / (60 + x), 0) + coalesce(1.0 / (60 + y), 0), 9) AS score FROM j), tr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, chunk_id) AS rank FROM tf)"
_CAND = f"{_FULL}, cu AS (SELECT query_id, chunk_id, least(x, y) AS best_rank, concat_ws('+', CASE WHEN x IS NOT NULL THEN 'bm25' END, CASE WHEN y IS NOT NULL THEN 'overlap' END) AS sources, row_number() OVER (PARTITION BY query_id ORDER BY least(x, y), chunk_id) AS rank FROM j)"
ORACLE_SQL = {
    "rrf_hybrid": f"""WITH {base.LEX}, {_FULL}, s AS (SELECT *, round(coalesce(1.0 / (60 + x), 0) + coalesce(1.0 / (60 + y), 0), 9) AS z FROM j)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY z DESC, chunk_id) AS rank, x AS vector_rank, y AS bm25_rank, round(z, 6) AS rrf_score,
  concat_ws('+', CASE WHEN x IS NOT NULL THEN 'vector' END, CASE WHEN y IS NOT NULL THEN 'bm25' END) AS sources FROM s""",
    "rrf_many": f"""WITH {base.LEX}, u AS (SELECT query_id, chunk_id, rank FROM bm UNION ALL SELECT query_id, chunk_id, rank FROM ov UNION ALL SELECT query_id, chunk_id, rank FROM bm WHERE rank <= 5),
s AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS z, count(*) AS n_lists FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY z DESC, chunk_id) AS rank FROM s)
SELECT query_id, chunk_id, rank, round(z, 6) AS score, n_lists FROM r WHERE rank <= 20""",
    "rank_fusion": f"""WITH {base.LEX}, s AS (SELECT a.query_id, a.chunk_id, a.rank AS x, b.rank AS y, round(1.0 / (60 + a.rank) + 0.75 / (60 + b.rank), 9) AS z FROM bm a JOIN ov b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id)
SELECT query_id, chunk_id, x AS retrieval_rank, y AS rerank_rank, round(z, 6) AS fusion_score, row_number() OVER (PARTITION BY query_id ORDER BY z DESC, x, chunk_id) AS final_rank FROM s""",
    "rerank": f"""WITH {base.LEX}, p AS (
  SELECT b.query_id, b.chunk_id, b.rank, list_distinct({base.sql_tokens("q.text")}) AS qq, {base.sql_tokens("d.text")} AS dd FROM bm b JOIN benchmark q ON q.item_id = b.query_id JOIN documents d ON d.doc_id = b.chunk_id WHERE b.rank <= 10
), s AS (SELECT query_id, chunk_id, rank, CASE WHEN len(qq) = 0 THEN 0 ELSE round(len(list_intersect(qq, dd)) / len(qq), 9) END AS z FROM p)
SELECT query_id, chunk_id, rank AS retrieval_rank, round(z, 6) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY z DESC, rank, chunk_id) AS rerank_rank FROM s""",
    "token_maxsim": f"WITH {_MAX.strip()} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM mx",
    "late_rerank_pool": f"""WITH {base.LEX}, {_MAX.strip()}, s AS (SELECT b.query_id, b.chunk_id, b.rank AS dense_rank, m.score FROM bm b LEFT JOIN mx m ON m.query_id = b.query_id AND m.chunk_id = b.chunk_id)
SELECT query_id, chunk_id, dense_rank, round(score, 6) AS late_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, dense_rank) AS rank FROM s""",
    "candidate_union": f"WITH {base.LEX}, {_CAND} SELECT query_id, chunk_id, best_rank, rank, sources FROM cu",
    "tiered_fusion": f"WITH {base.LEX}, {_TIER} SELECT query_id, chunk_id, tier, round(score, 6) AS score, rank FROM tr WHERE rank <= 20",
    "lane_quota": f"""WITH {base.LEX}, {_LANE}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id, lane ORDER BY rank, chunk_id) <= CASE lane WHEN 'dense' THEN 3 WHEN 'late' THEN 2 ELSE 4 END AS seeded FROM lanes),
b AS (SELECT *, greatest(12 - sum(CAST(seeded AS INTEGER)) OVER (PARTITION BY query_id), 0) AS room, row_number() OVER (PARTITION BY query_id, seeded ORDER BY rank, chunk_id) AS spare FROM a),
c AS (SELECT query_id, chunk_id, lane, rank, seeded, row_number() OVER (PARTITION BY query_id ORDER BY seeded DESC, rank, chunk_id) AS slot FROM b WHERE seeded OR spare <= room)
SELECT * FROM c WHERE slot <= 12""",
    "query_variants": """WITH v AS (
  SELECT item_id AS query_id, 0 AS i, 'original' AS kind, text FROM benchmark UNION ALL SELECT item_id, 1, 'synonym', replace(text, 'the', 'this') FROM benchmark
  UNION ALL SELECT item_id, 2, 'expansion', 'about ' || text FROM benchmark UNION ALL SELECT item_id, 3, 'style', replace(text, '.', ';') FROM benchmark
), f AS (SELECT query_id, text, min(i) AS i, min_by(kind, i) AS kind FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS r FROM f)
SELECT query_id, r - 1 AS variant, kind, text FROM r WHERE r <= 3""",
    "multi_query_merge": f"""WITH {base.LEX}, {_FULL}, s AS (SELECT j.*, greatest(a.score, CAST(b.score AS DOUBLE)) AS best_score, round(coalesce(1.0 / (60 + x), 0) + coalesce(1.0 / (60 + y), 0), 9) AS z FROM j
  LEFT JOIN bm a ON a.query_id = j.query_id AND a.chunk_id = j.chunk_id LEFT JOIN ov b ON b.query_id = j.query_id AND b.chunk_id = j.chunk_id)
SELECT query_id, chunk_id, least(x, y) AS best_rank, round(best_score, 4) AS best_score, concat_ws(',', CASE WHEN x IS NOT NULL THEN '0' END, CASE WHEN y IS NOT NULL THEN '1' END) AS variants, round(z, 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY z DESC, least(x, y), chunk_id) AS rank FROM s""",
    "dedup_candidates": f"""WITH RECURSIVE {base.LEX}, {_CAND},
s AS (SELECT cu.query_id, cu.chunk_id, cu.rank, d.source, d.text, d.doc_id % 40 AS a, d.doc_id % 40 + d.n_chars % 17 AS b FROM cu JOIN documents d ON d.doc_id = cu.chunk_id),
p AS (SELECT x.query_id, x.rank, list(y.rank) AS prior FROM s x JOIN s y ON y.query_id = x.query_id AND y.rank < x.rank AND y.source = x.source
  WHERE y.text IS NOT DISTINCT FROM x.text OR (least(x.b, y.b) - greatest(x.a, y.a) + 1) / least(x.b - x.a + 1, y.b - y.a + 1) >= 0.8 GROUP BY 1, 2),
k AS (
  SELECT query_id, CAST(0 AS BIGINT) AS rank, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS chunk_id FROM s GROUP BY 1
  UNION ALL
  SELECT k.query_id, s.rank, CASE WHEN list_has_any(k.kept, coalesce(p.prior, [])) THEN k.kept ELSE list_append(k.kept, s.rank) END, s.chunk_id
  FROM k JOIN s ON s.query_id = k.query_id AND s.rank = k.rank + 1 LEFT JOIN p ON p.query_id = s.query_id AND p.rank = s.rank
)
SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, CAST(len(kept) AS INTEGER) AS dedup_rank FROM k WHERE rank > 0 AND kept[len(kept)] = rank""",
    "evidence_compose": f"""WITH {base.LEX}, {_LANE},
e AS (SELECT l.query_id, l.chunk_id, l.lane, d.source AS doc, d.doc_id // 10 AS sec, row_number() OVER (PARTITION BY l.query_id ORDER BY l.rank, l.chunk_id) AS i FROM lanes l JOIN documents d ON d.doc_id = l.chunk_id),
hd AS (SELECT query_id, doc, count(*) AS n FROM e WHERE i <= 3 GROUP BY 1, 2), hl AS (SELECT query_id FROM e WHERE i <= 3 GROUP BY 1 HAVING NOT bool_or(lane = 'late')),
lt AS (SELECT e.query_id, e.i, coalesce(hd.n, 0) >= 2 AS crowded FROM e JOIN hl USING (query_id) LEFT JOIN hd ON hd.query_id = e.query_id AND hd.doc = e.doc WHERE e.i > 3 AND e.lane = 'late'),
sd AS (SELECT query_id, min(i) AS i FROM lt WHERE NOT crowded GROUP BY 1),
f AS (SELECT e.*, CASE WHEN e.i <= 3 THEN 'selected_head' WHEN e.i = sd.i THEN 'selected_protected' WHEN lt.crowded AND (sd.i IS NULL OR e.i < sd.i) THEN 'rejected_displacement' END AS r
  FROM e LEFT JOIN lt ON lt.query_id = e.query_id AND lt.i = e.i LEFT JOIN sd ON sd.query_id = e.query_id),
tk AS (SELECT DISTINCT query_id, doc, sec FROM f WHERE r LIKE 'selected%'), c AS (SELECT query_id, count(*) AS n FROM f WHERE r LIKE 'selected%' GROUP BY 1),
rest AS (SELECT f.query_id, f.chunk_id, f.doc, f.sec, f.i, tk.doc IS NOT NULL AS known, row_number() OVER (PARTITION BY f.query_id, f.doc, f.sec ORDER BY f.i) AS nth
  FROM f LEFT JOIN tk ON tk.query_id = f.query_id AND tk.doc = f.doc AND tk.sec = f.sec WHERE f.r IS NULL),
fresh AS (SELECT query_id, doc, sec, row_number() OVER (PARTITION BY query_id ORDER BY i) AS o FROM rest WHERE NOT known AND nth = 1),
q AS (SELECT r.query_id, r.chunk_id, CASE WHEN r.known OR (r.nth > 1 AND o <= 5 - c.n) THEN 'rejected_redundant' WHEN r.nth = 1 AND o <= 5 - c.n THEN 'selected_rank' ELSE 'rejected_budget' END AS reason
  FROM rest r JOIN c ON c.query_id = r.query_id LEFT JOIN fresh h ON h.query_id = r.query_id AND h.doc = r.doc AND h.sec = r.sec),
u AS (SELECT query_id, chunk_id, r AS reason FROM f WHERE r IS NOT NULL UNION ALL SELECT * FROM q)
SELECT query_id, chunk_id, reason LIKE 'selected%' AS selected, reason FROM u""",
    "context_budget": f"""WITH RECURSIVE {base.LEX}, {_CAND},
c AS (SELECT cu.query_id, cu.chunk_id, cu.rank, d.source, CAST(ceil(d.n_chars / 4) AS INTEGER) AS n FROM cu JOIN documents d ON d.doc_id = cu.chunk_id),
w AS (
  SELECT query_id, CAST(0 AS BIGINT) AS rank, 1500 AS room, 0 AS taken, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS BIGINT) AS chunk_id, false AS fits FROM c GROUP BY 1
  UNION ALL
  SELECT w.query_id, c.rank, CASE WHEN w.taken < 5 AND NOT list_contains(w.used, c.source) AND c.n <= w.room THEN w.room - c.n ELSE w.room END,
    CASE WHEN w.taken < 5 AND NOT list_contains(w.used, c.source) AND c.n <= w.room THEN w.taken + 1 ELSE w.taken END,
    CASE WHEN w.taken < 5 AND NOT list_contains(w.used, c.source) AND c.n <= w.room THEN list_append(w.used, c.source) ELSE w.used END, c.chunk_id,
    w.taken < 5 AND NOT list_contains(w.used, c.source) AND c.n <= w.room
  FROM w JOIN c ON c.query_id = w.query_id AND c.rank = w.rank + 1
)
SELECT query_id, chunk_id, rank, CAST(taken AS BIGINT) AS context_rank FROM w WHERE fits""",
    "evidence_signals": f"""WITH {base.LEX}, n AS (SELECT query_id, count(*) AS n_terms FROM qt GROUP BY 1), t AS (
  SELECT b.*, d.source, n_terms, o.chunk_id IS NOT NULL AS dual FROM bm b JOIN documents d ON d.doc_id = b.chunk_id JOIN n USING (query_id) LEFT JOIN ov o ON o.query_id = b.query_id AND o.chunk_id = b.chunk_id
), g AS (SELECT query_id, max(score) FILTER (WHERE rank = 1) AS s1, max(score) FILTER (WHERE rank = 2) AS s2, min(score) AS lo, avg(score) AS m, count(*) FILTER (WHERE dual) AS n_dual, count(DISTINCT source) AS n_documents, max(n_matched / n_terms) AS cov, count(*) AS n_candidates FROM t GROUP BY 1)
SELECT query_id, round(s1, 4) AS top_score, round(s2, 4) AS second_score, round(lo, 4) AS min_score, round(m, 4) AS mean_score, round(s1 - coalesce(s2, 0), 4) AS margin, round(cov, 4) AS term_coverage, n_dual, n_documents, n_candidates FROM g""",
    "score_guard": f"""WITH {base.LEX}, {_GUARD.strip()}
SELECT query_id, round(margin, 4) AS margin, round(margin5, 4) AS margin5, round(entropy, 4) AS entropy, round(diversity, 4) AS diversity, round(mean_score, 4) AS mean_score, round(confidence, 4) AS confidence, confidence < 0.4 AS trigger, entropy > 0.97 AS trigger_v2 FROM guard""",
    "guarded_retrieval": f"""WITH {base.LEX}, {_GUARD.strip()}, {_TIER}
SELECT r.query_id, r.chunk_id, r.rank, true AS guarded FROM tr r JOIN guard USING (query_id) WHERE confidence < 0.4 AND r.rank <= 10
UNION ALL SELECT b.query_id, b.chunk_id, b.rank, false FROM bm b JOIN guard USING (query_id) WHERE NOT confidence < 0.4 AND b.rank <= 10""",
    "hierarchical_topk": f"""WITH {base.LEX}, m AS (SELECT b.query_id, b.chunk_id, b.rank, b.score, d.source AS doc_id, CAST(floor(d.doc_id / 10) AS BIGINT) AS section_id FROM bm b JOIN documents d ON d.doc_id = b.chunk_id),
d3 AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS k FROM m GROUP BY 1, 2) WHERE k <= 3),
s5 AS (SELECT * FROM (SELECT query_id, doc_id, section_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS k FROM m SEMI JOIN d3 USING (query_id, doc_id) GROUP BY 1, 2, 3) WHERE k <= 5),
f AS (SELECT query_id, chunk_id, doc_id, section_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m SEMI JOIN s5 USING (query_id, doc_id, section_id))
SELECT * FROM f WHERE rank <= 10""",
    "parent_child_topk": """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT label, unnest(v) AS z, generate_subscripts(v, 1) AS i FROM e),
m AS (SELECT label, i, avg(z) AS a FROM x GROUP BY 1, 2), c AS (SELECT label, list(a ORDER BY i) AS v FROM m GROUP BY 1), q AS (SELECT vec_id AS query_id, v FROM e WHERE vec_id % 20 = 0),
p AS (SELECT * FROM (SELECT query_id, c.label, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q.v, c.v), 6) DESC, c.label) AS k FROM q JOIN c ON true) WHERE k <= 2),
s AS (SELECT p.query_id, e.label, e.vec_id, round(list_cosine_similarity(q.v, e.v), 6) AS z FROM p JOIN q USING (query_id) JOIN e ON e.label = p.label), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY z DESC, vec_id) AS rank FROM s)
SELECT query_id, label, vec_id, z AS similarity, rank FROM r WHERE rank <= 10""",
    "section_lane": f"WITH {base.LEX}, {_STRUCT.strip()} SELECT * FROM struct_lane",
    "lane_guard": f"""WITH {base.LEX}, {_STRUCT.strip()}, h AS (SELECT item_id AS query_id, contains(lower(text), 'the and') OR contains(lower(text), 'one') OR contains(lower(text), 'tion') AS phrase_hit, item_id IN (SELECT query_id FROM struct_lane) AS has_structure FROM benchmark)
SELECT query_id, phrase_hit, has_structure, phrase_hit AND has_structure AS trigger FROM h""",
    "merge_lanes": f"""WITH {base.LEX}, u AS (SELECT query_id, chunk_id, CASE WHEN rank <= 3 THEN 0 ELSE 3 END AS lane, rank, 'base' AS s FROM bm UNION ALL SELECT query_id, chunk_id, 1, rank, 'structure' FROM ov WHERE rank <= 4
  UNION ALL SELECT query_id, chunk_id, 2, rank, 'graph' FROM bm WHERE rank > 10 UNION ALL SELECT query_id, chunk_id, 2, rank, 'graph' FROM ov WHERE rank BETWEEN 8 AND 12),
g AS (SELECT query_id, chunk_id, min(lane * 1000 + rank) AS o, string_agg(DISTINCT s, '+' ORDER BY s) AS sources FROM u GROUP BY 1, 2)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY o, chunk_id) AS rank, sources FROM g""",
    "hydrate_chunks": f"""WITH {base.LEX}, r AS (SELECT query_id, CASE WHEN chunk_id % 13 = 0 THEN -chunk_id ELSE chunk_id END AS chunk_id, rank FROM bm)
SELECT r.query_id, r.chunk_id, r.rank, d.source AS path, sha256(d.text) AS content_sha, k.doc_id IS NOT NULL AS known
FROM r LEFT JOIN documents k ON k.doc_id = r.chunk_id LEFT JOIN documents d ON d.doc_id = r.chunk_id AND d.doc_id % 5 <> 0 WHERE d.doc_id IS NOT NULL OR k.doc_id IS NULL""",
    "score_features": f"""WITH {base.LEX}, t AS (SELECT b.*, d.source, b.score / sum(b.score) OVER (PARTITION BY query_id) AS share FROM bm b JOIN documents d ON d.doc_id = b.chunk_id),
g AS (SELECT query_id, max(score) FILTER (WHERE rank = 1) AS s1, max(score) FILTER (WHERE rank = 2) AS s2, max(score) FILTER (WHERE rank = 5) AS s5, max(score) FILTER (WHERE rank = 10) AS s10, max(score) FILTER (WHERE rank = 20) AS s20,
  avg(score) AS m, stddev_pop(score) AS sd, max(score) - min(score) AS rg, regr_slope(score, rank) AS sl, sum(-share * ln(share)) AS h, count(DISTINCT source) AS n_documents, 1 - count(DISTINCT score) / count(score) AS sv FROM t GROUP BY 1)
SELECT query_id, round(s1, 4) AS s1, round(s2, 4) AS s2, round(s5, 4) AS s5, round(s10, 4) AS s10, round(s20, 4) AS s20, round(m, 4) AS mean_score, round(sd, 4) AS std_score, round(rg, 4) AS range_score, round(sl, 4) AS slope,
  round(h, 4) AS entropy, round(sv, 4) AS same_value_ratio, round(s1 - s2, 4) AS margin12, round(s1 - s5, 4) AS margin15, n_documents FROM g""",
}
