"""Registered queries: evaluation and monitoring analytics.

Lists a and b are the BM25 and the overlap list of every benchmark text; gold are the documents that hold it verbatim.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrygrid.common import table
from quarrygrid.operators import evaluation as ev
from quarrygrid.plans import base
from quarrygrid.plans.ranking import _lists, long, r6


def _span(df, doc="doc_id"):
    """Made-up line spans of a chunk in its document (the source)."""
    return df.withColumns({"start_line": F.col("chunk_id") % 40, "end_line": F.col("chunk_id") % 40 + 5})


def _sources(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"))


def gold_match(spark, sf):
    a, _ = _lists(spark, sf)
    src = _sources(spark, sf)
    gold = _span(base.gold(spark, sf).join(src, "chunk_id")).withColumn("gold_id", F.col("chunk_id"))
    out = ev.gold_match(_span(a.join(src, "chunk_id")), gold)
    return out.select("query_id", "gold_id", "chunk_id", long("rank"), "match")


def retrieval_metrics(spark, sf):
    out = ev.retrieval_metrics(_lists(spark, sf)[0], base.gold(spark, sf))
    return out.select(*[r6(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def _first(rows, gold):
    return gold.select("query_id").distinct().join(rows.join(gold, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("rank")), "query_id", "left")


def slice_metrics(spark, sf):
    a, b = _lists(spark, sf)
    gold = base.gold(spark, sf)
    ranks = _first(a, gold).withColumn("arm", F.lit("bm25")).unionByName(_first(b, gold).withColumn("arm", F.lit("overlap")))
    ranks = ranks.join(_first(a, gold).withColumnRenamed("rank", "baseline_rank"), "query_id").withColumnRenamed("query_id", "unit_id")
    tags = gold.select(F.col("query_id").alias("unit_id")).distinct().withColumn("tag", F.explode(F.array(F.concat(F.lit("m3_"), F.col("unit_id") % 3), F.concat(F.lit("m2_"), F.col("unit_id") % 2))))
    out = ev.slice_metrics(ranks, tags)
    return out.select("tag", "arm", "n_units", r6("hit_rate"), r6("mrr"), "n_regressions")


def ndcg(spark, sf):
    a, _ = _lists(spark, sf)
    rows = a.join(base.gold(spark, sf).withColumn("g", F.lit(True)), ["query_id", "chunk_id"], "left").select("query_id", "rank", F.coalesce("g", F.lit(False)).alias("relevant"))
    return ev.ndcg(rows).select("query_id", r6("ndcg"))


def _labelled(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.size(F.split("text", " ")).alias("n_words"), F.size(F.array_distinct(F.split("text", " "))).alias("n_distinct"))
    return d.join(table(spark, sf, "labels").where("quality is not null"), "doc_id").select("doc_id", "n_chars", "n_words", "n_distinct", (F.col("n_distinct") / F.col("n_words")).alias("score"), F.col("quality").alias("label"))


def ranking_auc(spark, sf):
    return ev.ranking_auc(_labelled(spark, sf).withColumn("score", F.round("score", 3))).select("n_rows", r6("auc"), r6("average_precision"))


def identity_match(spark, sf):
    a, _ = _lists(spark, sf)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("digest"), F.col("source").alias("doc"))
    gold = base.gold(spark, sf).join(d, "chunk_id").select("query_id", F.col("chunk_id").alias("gold_id"), F.when(F.col("chunk_id") % 2 == 0, F.col("chunk_id")).alias("chunk_id"), F.when(F.col("chunk_id") % 3 == 0, F.col("digest")).alias("digest"), "doc")
    return ev.identity_match(gold, a.join(d, "chunk_id").where("rank <= 10"), (("chunk", "chunk_id"), ("digest", "digest"), ("document", "doc")))


def loss_funnel(spark, sf):
    a, b = _lists(spark, sf)
    both = a.join(b.select("query_id", "chunk_id"), ["query_id", "chunk_id"])
    return ev.loss_funnel(base.gold(spark, sf), [("candidates", a), ("confirmed", both), ("top", both.where("rank <= 2"))]).select("stage", "n_alive", "n_lost", r6("survival"))


def threshold_sweep(spark, sf):
    out = ev.threshold_sweep(_labelled(spark, sf), ["n_chars", "n_words", "n_distinct"])
    return out.select("feature", "quantile", "threshold", "op", "n_fired", "tp", r6("precision"), r6("recall"), r6("trigger_rate"), r6("f1"))


def routing_curve(spark, sf):
    out = ev.routing_curve(_labelled(spark, sf).withColumn("label", 1 - F.col("label")).withColumn("score", -F.col("score")))
    return out.select("budget", "n_routed", "n_hits", r6("coverage"), r6("precision"))


def section_ambiguity(spark, sf):
    gold = base.gold(spark, sf).join(base.search_queries(spark, sf), "query_id").select(F.col("query_id").alias("gold_id"), F.col("chunk_id").alias("doc_id"), "text")
    sections = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("section_id", "text"))
    return ev.section_ambiguity(gold, sections)


def query_features(spark, sf):
    return ev.query_features(table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "text"))


def required_evidence(spark, sf):
    a, b = _lists(spark, sf)
    out = ev.required_evidence(a.where("rank <= 5"), b.where("rank <= 3"), b.where("rank > 15"))
    return out.select("query_id", "n_required", "n_found", r6("recall"), "complete", "n_forbidden")


def _event_spans(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") * 7919 % 2000).alias("start_line"), (F.col("event_id") * 7919 % 2000 + F.col("event_id") % 23).alias("end_line"))


def merge_spans(spark, sf):
    return ev.merge_spans(_event_spans(spark, sf), 2)


def span_coverage(spark, sf):
    users = table(spark, sf, "events").select(F.col("user_id").alias("doc_id")).distinct()
    gold = users.select(F.col("doc_id").alias("gold_id"), "doc_id", (F.col("doc_id") * 31 % 1900).alias("start_line"), (F.col("doc_id") * 31 % 1900 + F.col("doc_id") % 40).alias("end_line"))
    out = ev.span_coverage(gold, _event_spans(spark, sf))
    return out.select("gold_id", "coverage", r6("best_ratio"), "split")


def paired_transitions(spark, sf):
    a, b = _lists(spark, sf)
    gold = base.gold(spark, sf)
    hit = lambda rows, k: _first(rows, gold).select(F.col("query_id").alias("unit_id"), F.coalesce(F.col("rank") <= k, F.lit(False)).alias("hit"))
    variants = hit(a, 1).withColumn("variant", F.lit("bm25")).unionByName(hit(b, 5).withColumn("variant", F.lit("overlap")))
    return ev.paired_transitions(variants, hit(b, 1))


def complementarity(spark, sf):
    a, b = _lists(spark, sf)
    segments = base.search_queries(spark, sf).select("query_id", F.concat(F.lit("m"), F.col("query_id") % 3).alias("segment"))
    return ev.complementarity(a, b, base.gold(spark, sf), segments).withColumn("union_recall", F.round("union_recall", 6))


def rank_buckets(spark, sf):
    return ev.rank_buckets(_first(_lists(spark, sf)[1], base.gold(spark, sf)))


def budget_curve(spark, sf):
    a, b = _lists(spark, sf)
    out = ev.budget_curve(a, b, base.gold(spark, sf))
    return out.select("depth", r6("mean_size"), "p50_size", "p95_size", "max_size", r6("mean_duplicates"), r6("union_recall"))


def bootstrap_ci(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), (F.col("vec_id") * 37 % 11).cast("double").alias("a"), (F.col("vec_id") * 53 % 7).cast("double").alias("b"))
    out = ev.bootstrap_ci(rows, 200)
    return out.select(*[r6(c) for c in ("low", "high", "center", "observed")])


def rank_correlation(spark, sf):
    a, b = _lists(spark, sf)
    return ev.rank_correlation(a, b).select("query_id", "n_common", r6("spearman"), r6("overlap_at_k"))


def _run(spark, sf, k):
    d = table(spark, sf, "documents")
    return d.where(F.col("doc_id") % 17 != k).select(F.col("doc_id").alias("sample_id"), F.array(F.col("doc_id"), F.col("doc_id") % (5 + k)).alias("candidates"), F.array(F.col("doc_id") % (3 + 3 * k)).alias("evidence"), F.when(F.col("doc_id") % (7 * k + 7) == 0, "failed").otherwise("ok").alias("status"), (F.col("n_chars") % 10).cast("double").alias("metric"))


def compare_runs(spark, sf):
    return ev.compare_runs(_run(spark, sf, 0), _run(spark, sf, 1))


def failure_attribution(spark, sf):
    d = table(spark, sf, "documents")
    m = lambda k: F.col("doc_id") % k == 0
    return ev.failure_attribution(d.select(F.col("doc_id").alias("sample_id"), (~m(5)).alias("answerable"), (~m(7)).alias("answered"), (F.col("doc_id") % 11).alias("n_candidates"), (~m(4)).alias("gold_in_candidates"), (~m(6)).alias("gold_in_evidence"), (~m(9)).alias("cited"), (~m(13)).alias("correct")))


def _replicates(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("replicate")).withColumn("outcome", ((F.col("sample_id") * 7 + F.col("replicate") * (F.col("sample_id") % 3)) % 4).cast("string"))


def replicate_stability(spark, sf):
    out = ev.replicate_stability(_replicates(spark, sf))
    return out.select("sample_id", "n_outcomes", r6("modal_share"), "stable", r6("entropy"), "first_outcome", "last_outcome")


def set_jaccard(spark, sf):
    rows = _replicates(spark, sf).select("sample_id", F.col("replicate").alias("run"), F.when(F.col("sample_id") % 6 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("sample_id") % 3, F.col("replicate") % (F.col("sample_id") % 4 + 1), F.lit(9).cast("bigint"))).alias("items"))
    return ev.set_jaccard(rows).select("sample_id", r6("jaccard"), "n_pairs")


def leakage_scan(spark, sf):
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    items = b.select("item_id", "text").unionByName(d.where("doc_id % 20 = 0").select((F.col("doc_id") + 1000000).alias("item_id"), F.when(F.col("doc_id") % 40 == 0, F.upper("text")).otherwise(F.col("text")).alias("text")))
    return ev.leakage_scan(items, d)


def containment_scan(spark, sf):
    return base.gold(spark, sf).withColumnsRenamed({"query_id": "item_id", "chunk_id": "doc_id"})


def secret_scan(spark, sf):
    return ev.secret_scan(table(spark, sf, "documents"))


def redact_text(spark, sf):
    return ev.redact_text(table(spark, sf, "documents"), ["example.com"]).select("doc_id", F.sha2("text", 256).alias("text_sha"), "n_replaced")


def text_fidelity(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    cand = d.select("doc_id", F.regexp_replace("text", "the|ou", "THE ").alias("text"))
    return ev.text_fidelity(d, cand).withColumn("retention", F.round("retention", 6))


def text_corruption(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    cand = d.select("doc_id", F.regexp_replace("text", "the|ou", "THE ").alias("text"))
    return ev.text_corruption(d, cand).withColumn("corruption", F.round("corruption", 6))


def reading_order(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    snippets = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "snippet")).where("snippet <> ''").select("doc_id", F.pmod(F.col("i") * 7, F.lit(5)).alias("ordinal"), "snippet")
    return ev.reading_order(snippets, d)


def answer_scores(spark, sf):
    d = table(spark, sf, "documents")
    m = lambda k: F.col("doc_id") % k
    out = ev.answer_scores(d.select(F.col("doc_id").alias("sample_id"), F.when(m(4) == 0, "abstain").otherwise("answer").alias("expected"), F.when(m(5) == 0, "abstain").otherwise("answer").alias("action"), F.array(m(2)).alias("required"), F.array(m(6)).alias("claimed"), F.when(m(7) == 0, F.array().cast("array<bigint>")).otherwise(F.array(m(3))).alias("cited"), F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint")).alias("available")))
    return out.withColumn("rate", F.round("rate", 6))


def router_scores(spark, sf):
    d = table(spark, sf, "documents")
    out = ev.router_scores(d.select(F.col("source").alias("arm"), (F.col("doc_id") % 3 == 0).alias("activated"), (F.col("doc_id") % 4 == 0).alias("beneficial"), (F.col("doc_id") % 5).alias("before"), (F.col("doc_id") % 7).alias("after")))
    return out.select("arm", "net_gain", "n_regressions", r6("precision"), r6("recall"), r6("f1"))


def latency_summary(spark, sf):
    out = ev.latency_summary(table(spark, sf, "events").select("event_type", F.col("value").alias("latency_ms")), ["event_type"])
    return out.select("event_type", "n", *[r6(c) for c in ("mean", "p50", "p95", "p99", "max", "std")])


def stage_profile(spark, sf):
    traces = table(spark, sf, "events").select(F.concat_ws(":", F.col("user_id"), F.date_format("ts", "yyyy-MM-dd")).alias("request_id"), F.col("event_type").alias("stage"), F.round(F.col("value"), 2).cast("decimal(18,2)").alias("latency_ms"))
    out = ev.stage_profile(traces)
    return out.select("stage", F.col("p50").cast("double").alias("p50"), F.col("p95").cast("double").alias("p95"), F.round(F.col("share").cast("double"), 5).alias("share"), F.round("corr_total", 5).alias("corr_total"), F.round(F.col("slow_share").cast("double"), 5).alias("slow_share"))


def _obs(spark, sf):
    return table(spark, sf, "events").select("*", F.concat(F.lit("r"), F.col("user_id") % 3).alias("release"), F.when(F.col("event_id") % 2 == 0, "search").otherwise("ask").alias("scope"))


def traffic_monitor(spark, sf):
    return ev.traffic_monitor(_obs(spark, sf)).select("release", "scope", "n_requests", "n_errors", "n_completed", r6("mean_value"), r6("max_value"), r6("error_rate"))


SAFETY = ("unsafe_answers", "leaked_values")


def requests(events):
    """Events as requests with a terminal, a fallback and safety counters."""
    i, kind = F.col("event_id"), F.col("event_type")
    return events.select(
        "ts", F.concat(F.lit("r"), F.col("user_id") % 3).alias("release"), F.when(i % 2 == 0, "search").otherwise("ask").alias("scope"), F.when(i % 19 != 5, kind).alias("terminal"), ((kind == "error") | (i % 7 == 0)).alias("fallback_required"),
        F.when(i % 5 != 0, F.col("value") >= 20).alias("fallback_success"), F.when(i % 23 != 0, F.col("value")).alias("latency_ms"), (i % 997 == 0).cast("int").alias("unsafe_answers"), F.when(i % 3 == 0, i % 2).alias("leaked_values"),
    )


def shown_report(report):
    """A report with its map of terminals as text and rounded numbers."""
    shown = F.array_join(F.transform(F.map_entries("terminals"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return report.withColumns({"terminals": shown, "fallback_rate": F.round("fallback_rate", 6), "mean_ms": F.round("mean_ms", 4)})


def release_report(spark, sf):
    return shown_report(ev.release_report(requests(table(spark, sf, "events")), SAFETY))


def decision_stability(spark, sf):
    rows = _obs(spark, sf).select("user_id", "scope", "event_type", (F.col("event_id") % 2).alias("x"))
    return ev.decision_stability(rows, ["user_id", "scope"], ["event_type", "x"])


def drift_gates(spark, sf):
    m = ev.traffic_monitor(_obs(spark, sf))
    return ev.drift_gates(m, {"error_rate": 0.05, "mean_value": 50.0, "n_requests": 3000.0}).select("release", "scope", "drifts", "decision")


def _evidence(spark, sf):
    a, b = _lists(spark, sf)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.floor(F.col("doc_id") / 10).cast("long").alias("section_id"))
    return [x.select("query_id", "chunk_id", "rank").where("rank <= 10").join(d, "chunk_id") for x in (a, b)]


def evidence_rounds(spark, sf):
    return ev.evidence_rounds(*_evidence(spark, sf)).select("query_id", "chunk_id", long("round"), long("rank"), "gain")


def evidence_delta(spark, sf):
    return ev.evidence_delta(*_evidence(spark, sf))


QUERIES = {f.__name__: f for f in (
    gold_match, retrieval_metrics, slice_metrics, ndcg, ranking_auc, identity_match, loss_funnel, threshold_sweep, routing_curve, section_ambiguity, query_features, required_evidence, merge_spans, span_coverage,
    paired_transitions, complementarity, rank_buckets, budget_curve, bootstrap_ci, rank_correlation, compare_runs, failure_attribution, replicate_stability, set_jaccard, leakage_scan, containment_scan, secret_scan,
    redact_text, text_fidelity, text_corruption, reading_order, answer_scores, router_scores, latency_summary, stage_profile, traffic_monitor, release_report, decision_stability, drift_gates, evidence_rounds, evidence_delta,
)}

_G = f"{base.LEX}, {base.GOLD}"
_FIRST = "fa AS (SELECT g.query_id, min(b.rank) AS rank FROM gold g LEFT JOIN bm b USING (query_id, chunk_id) GROUP BY 1), fb AS (SELECT g.query_id, min(b.rank) AS rank FROM gold g LEFT JOIN ov b USING (query_id, chunk_id) GROUP BY 1)"
_LAB = "lab AS (SELECT doc_id, n_chars, len(string_split(text, ' ')) AS n_words, len(list_distinct(string_split(text, ' '))) AS n_distinct, len(list_distinct(string_split(text, ' '))) / len(string_split(text, ' ')) AS score, quality AS label FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"
_SPANS = "sp AS (SELECT user_id AS doc_id, event_id * 7919 % 2000 AS s, event_id * 7919 % 2000 + event_id % 23 AS e FROM events)"
_NORM = "trim(regexp_replace(" + base.sql_low("text") + ", '[^a-z0-9À-ÖØ-öø-ÿ]+', ' ', 'g'))"
_OBS = "obs AS (SELECT *, 'r' || (user_id % 3) AS release, CASE WHEN event_id % 2 = 0 THEN 'search' ELSE 'ask' END AS scope FROM events)"
_MON = f"{_OBS}, mon AS (SELECT CASE WHEN grouping(release) = 1 THEN '*' ELSE release END AS release, CASE WHEN grouping(scope) = 1 THEN '*' ELSE scope END AS scope, count(*) AS n_requests, count(*) FILTER (WHERE event_type = 'error') AS n_errors, count(*) FILTER (WHERE event_type = 'purchase') AS n_completed, avg(value) AS mean_value, max(value) AS max_value FROM obs GROUP BY ROLLUP (release, scope))"
_EVI = "d AS (SELECT doc_id AS chunk_id, source AS doc_id, CAST(floor(doc_id / 10) AS BIGINT) AS section_id FROM documents), ea AS (SELECT query_id, chunk_id, rank, doc_id, section_id FROM bm JOIN d USING (chunk_id) WHERE rank <= 10), eb AS (SELECT query_id, chunk_id, rank, doc_id, section_id FROM ov JOIN d USING (chunk_id) WHERE rank <= 10)"


def sql_report(by: str, groups: str, terminals: str) -> str:
    """``shown_report`` in SQL: ``by`` gives the columns of ``groups``, which may be grouping sets; ``terminals`` are the same groups by terminal."""
    return f"""WITH q AS (SELECT ts, 'r' || (user_id % 3) AS release, CASE WHEN event_id % 2 = 0 THEN 'search' ELSE 'ask' END AS scope, CASE WHEN event_id % 19 <> 5 THEN event_type ELSE 'unknown' END AS terminal, event_type = 'error' OR event_id % 7 = 0 AS need,
  event_id % 5 <> 0 AND value >= 20 AS done, CASE WHEN event_id % 23 <> 0 THEN value END AS ms, CASE WHEN event_id % 997 = 0 THEN 1 ELSE 0 END AS unsafe, CASE WHEN event_id % 3 = 0 THEN event_id % 2 ELSE 0 END AS leaked FROM events),
h AS (SELECT {by}, terminal, count(*) AS n FROM q GROUP BY {terminals}), t AS (SELECT * EXCLUDE (terminal, n), string_agg(terminal || '=' || n, ',' ORDER BY terminal) AS terminals FROM h GROUP BY ALL),
r AS (SELECT {by}, count(*) AS n_requests, count(*) FILTER (WHERE need) AS n_fallbacks, count(*) FILTER (WHERE need AND done) AS n_fallbacks_done, round(avg(ms), 4) AS mean_ms, CAST(sum(unsafe) AS BIGINT) AS unsafe_answers, CAST(sum(leaked) AS BIGINT) AS leaked_values FROM q GROUP BY {groups})
SELECT *, CASE WHEN n_fallbacks > 0 THEN round(n_fallbacks_done / n_fallbacks, 6) ELSE 1.0 END AS fallback_rate, unsafe_answers = 0 AND leaked_values = 0 AS safe FROM r NATURAL JOIN t"""


def _rules(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{n}'" for n, p in ev.FEATURE_RULES) + " ELSE 'plain' END"


def _q(p: str) -> str:
    return p.replace("'", "''")


_SECRETS = " UNION ALL ".join(f"SELECT doc_id, text, '{n}' AS kind, unnest(regexp_extract_all(text, '{_q(p)}')) AS value, generate_subscripts(regexp_extract_all(text, '{_q(p)}'), 1) - 1 AS ordinal FROM documents" for n, p in ev.SECRET_RULES)


def _redacted() -> tuple[str, str]:
    text, n = "replace(coalesce(text, ''), 'example.com', '[REDACTED]')", "CAST((length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'example.com', ''))) / 11 AS INTEGER)"
    for _, p in ev.SECRET_RULES:
        n = f"{n} + len(regexp_extract_all({text}, '{_q(p)}'))"
        text = f"regexp_replace({text}, '{_q(p)}', '[REDACTED]', 'g')"
    return text, n


_MS = """ms AS (SELECT doc_id, s, e, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
mi AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 + {0} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM ms)"""
ORACLE_SQL = {
    "gold_match": f"""WITH {_G}, c AS (SELECT b.query_id, b.chunk_id, b.rank, d.source, b.chunk_id % 40 AS s FROM bm b JOIN documents d ON d.doc_id = b.chunk_id), g AS (SELECT g.query_id, g.chunk_id AS gold_id, d.source, g.chunk_id % 40 AS s FROM gold g JOIN documents d ON d.doc_id = g.chunk_id)
SELECT c.query_id, gold_id, chunk_id, rank, CASE WHEN chunk_id = gold_id THEN 'chunk' WHEN c.s <= g.s + 5 AND c.s + 5 >= g.s THEN 'lines' ELSE 'document' END AS match FROM c JOIN g ON c.query_id = g.query_id AND c.source = g.source""",
    "retrieval_metrics": f"""WITH {_G}, f AS (SELECT g.query_id, count(DISTINCT g.chunk_id) AS n_gold, min(b.rank) AS first_rank, {", ".join(f"count(DISTINCT g.chunk_id) FILTER (WHERE b.rank <= {k}) AS n{k}" for k in (1, 3, 5, 10))} FROM gold g LEFT JOIN bm b USING (query_id, chunk_id) GROUP BY 1)
SELECT query_id, n_gold, first_rank, round(coalesce(1.0 / first_rank, 0), 6) AS reciprocal_rank, {", ".join(f"CAST(n{k} > 0 AS INTEGER) AS hit_at_{k}, round(n{k} / n_gold, 6) AS recall_at_{k}" for k in (1, 3, 5, 10))} FROM f""",
    "slice_metrics": f"""WITH {_G}, {_FIRST}, r AS (SELECT query_id, 'bm25' AS arm, rank FROM fa UNION ALL SELECT query_id, 'overlap', rank FROM fb), t AS (SELECT DISTINCT query_id, unnest(['m3_' || query_id % 3, 'm2_' || query_id % 2, '*']) AS tag FROM gold),
j AS (SELECT tag, arm, r.rank, coalesce(CAST(r.rank <= 5 AS INTEGER), 0) AS hit, coalesce(CAST(fa.rank <= 5 AS INTEGER), 0) AS base FROM r JOIN t USING (query_id) JOIN fa USING (query_id))
SELECT tag, arm, count(*) AS n_units, round(avg(hit), 6) AS hit_rate, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, count(*) FILTER (WHERE base = 1 AND hit = 0) AS n_regressions FROM j GROUP BY 1, 2""",
    "ndcg": f"""WITH {_G}, r AS (SELECT b.query_id, b.rank, g.chunk_id IS NOT NULL AS rel FROM bm b LEFT JOIN gold g USING (query_id, chunk_id)), s AS (SELECT query_id, sum(CASE WHEN rel AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, least(count(*) FILTER (WHERE rel), 10) AS n FROM r GROUP BY 1)
SELECT query_id, round(CASE WHEN n > 0 THEN dcg / list_sum([1 / log2(i + 1) FOR i IN range(1, n + 1)]) ELSE 0 END, 6) AS ndcg FROM s""",
    "ranking_auc": f"""WITH {_LAB}, x AS (SELECT round(score, 3) AS s, label FROM lab), p AS (SELECT s FROM x WHERE label = 1), n AS (SELECT s FROM x WHERE label = 0),
auc AS (SELECT avg(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0 END) AS a FROM p JOIN n ON true),
g AS (SELECT s, sum(label) AS h, count(*) AS c FROM x GROUP BY 1), r AS (SELECT h, sum(h) OVER (ORDER BY s DESC) AS hs, sum(c) OVER (ORDER BY s DESC) AS cs FROM g)
SELECT (SELECT count(*) FROM x) AS n_rows, round((SELECT a FROM auc), 6) AS auc, round((SELECT sum(h * hs / cs) / sum(h) FROM r), 6) AS average_precision""",
    "identity_match": f"""WITH {_G}, d AS (SELECT doc_id AS chunk_id, sha256(text) AS digest, source AS doc FROM documents), g AS (SELECT query_id, chunk_id AS gold_id, CASE WHEN chunk_id % 2 = 0 THEN chunk_id END AS c, CASE WHEN chunk_id % 3 = 0 THEN digest END AS s, doc FROM gold JOIN d USING (chunk_id)),
r AS (SELECT query_id, chunk_id, digest, doc FROM bm JOIN d USING (chunk_id) WHERE rank <= 10), m AS (SELECT g.query_id, gold_id, min(CASE WHEN r.chunk_id = g.c THEN 1 WHEN r.digest = g.s THEN 2 WHEN r.doc = g.doc THEN 3 END) AS l FROM g LEFT JOIN r ON r.query_id = g.query_id GROUP BY 1, 2)
SELECT query_id, gold_id, true AS verifiable, CASE l WHEN 1 THEN 'chunk' WHEN 2 THEN 'digest' WHEN 3 THEN 'document' END AS matched_by FROM m""",
    "loss_funnel": f"""WITH {_G}, s AS (SELECT b.rank IS NOT NULL AS x, b.rank IS NOT NULL AND o.rank IS NOT NULL AS y, b.rank <= 2 AND o.rank IS NOT NULL AS z FROM (SELECT DISTINCT query_id, chunk_id FROM gold) g LEFT JOIN bm b USING (query_id, chunk_id) LEFT JOIN ov o USING (query_id, chunk_id)),
l AS (SELECT CASE WHEN NOT x THEN 0 WHEN NOT y THEN 1 WHEN NOT coalesce(z, false) THEN 2 ELSE 3 END AS a FROM s), n AS (SELECT * FROM (VALUES (0, 'candidates'), (1, 'confirmed'), (2, 'top')) v(i, stage))
SELECT stage, count(*) FILTER (WHERE a > i) AS n_alive, count(*) FILTER (WHERE a = i) AS n_lost, round(count(*) FILTER (WHERE a > i) / count(*), 6) AS survival FROM l JOIN n ON true GROUP BY 1, i""",
    "threshold_sweep": f"""WITH {_LAB}, l AS (SELECT label, 'n_chars' AS feature, CAST(n_chars AS DOUBLE) AS v FROM lab UNION ALL SELECT label, 'n_words', n_words FROM lab UNION ALL SELECT label, 'n_distinct', n_distinct FROM lab),
c AS (SELECT feature, q AS quantile, list_sort(list(v))[greatest(CAST(ceil(round(q * count(*), 9)) AS BIGINT), 1)] AS threshold FROM l JOIN (SELECT unnest([0.1::DOUBLE, 0.25, 0.5, 0.75, 0.9]) AS q) ON true GROUP BY 1, 2),
o AS (SELECT feature, quantile, threshold, op, CASE WHEN op = '<=' THEN v <= threshold ELSE v >= threshold END AS fired, label FROM l JOIN c USING (feature) JOIN (SELECT unnest(['<=', '>=']) AS op) ON true),
g AS (SELECT feature, quantile, threshold, op, count(*) FILTER (WHERE fired) AS n_fired, CAST(coalesce(sum(label) FILTER (WHERE fired), 0) AS BIGINT) AS tp, sum(label) AS pos, count(*) AS n FROM o GROUP BY 1, 2, 3, 4), p AS (SELECT *, CASE WHEN n_fired > 0 THEN tp / n_fired ELSE 0 END AS pr, CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS re FROM g)
SELECT feature, quantile, threshold, op, n_fired, tp, round(pr, 6) AS precision, round(re, 6) AS recall, round(n_fired / n, 6) AS trigger_rate, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM p""",
    "routing_curve": f"""WITH {_LAB}, x AS (SELECT -score AS s, 1 - label AS y FROM lab), g AS (SELECT s, sum(y) AS h, count(*) AS c FROM x GROUP BY 1), r AS (SELECT h, c, sum(c) OVER (ORDER BY s DESC) AS cs FROM g), t AS (SELECT count(*) AS n, sum(y) AS p FROM x),
b AS (SELECT unnest(range(1, 11)) / 10 AS budget), o AS (SELECT budget, any_value(n) AS n, any_value(p) AS p, coalesce(sum(c) FILTER (WHERE cs <= ceil(round(budget * n, 6))), 0) AS nr, coalesce(sum(h) FILTER (WHERE cs <= ceil(round(budget * n, 6))), 0) AS nh FROM b JOIN t ON true JOIN r ON true GROUP BY 1)
SELECT CAST(budget AS DOUBLE) AS budget, CAST(nr AS BIGINT) AS n_routed, CAST(nh AS BIGINT) AS n_hits, round(nh / p, 6) AS coverage, round(CASE WHEN nr > 0 THEN nh / nr ELSE 0 END, 6) AS precision FROM o""",
    "section_ambiguity": f"""WITH {base.GOLD}, w AS (SELECT DISTINCT g.query_id AS gold_id, g.chunk_id AS doc_id, unnest({base.sql_tokens("b.text")}) AS token FROM gold g JOIN benchmark b ON b.item_id = g.query_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents SEMI JOIN w USING (doc_id)), h AS (SELECT DISTINCT doc_id, i, unnest({base.sql_tokens("line")}) AS token FROM l),
s AS (SELECT gold_id, token, count(DISTINCT i) AS n FROM w JOIN h USING (doc_id, token) GROUP BY 1, 2), m AS (SELECT gold_id, max(n) AS n FROM s GROUP BY 1), f AS (SELECT g.gold_id, coalesce(n, 0) AS n_sections FROM (SELECT DISTINCT query_id AS gold_id FROM gold) g LEFT JOIN m USING (gold_id))
SELECT gold_id, n_sections, CASE WHEN n_sections = 0 THEN 'absent' WHEN n_sections = 1 THEN 'unique' WHEN n_sections <= 3 THEN 'low' ELSE 'high' END AS bucket FROM f""",
    "query_features": f"SELECT doc_id AS query_id, {_rules('text')} AS feature FROM documents",
    "required_evidence": f"""WITH {base.LEX}, r AS (SELECT o.query_id, count(*) AS n_required, count(b.rank) FILTER (WHERE b.rank <= 5) AS n_found FROM ov o LEFT JOIN bm b USING (query_id, chunk_id) WHERE o.rank <= 3 GROUP BY 1), x AS (SELECT query_id, count(*) AS n FROM ov o JOIN bm b USING (query_id, chunk_id) WHERE o.rank > 15 AND b.rank <= 5 GROUP BY 1)
SELECT r.query_id, n_required, n_found, round(n_found / n_required, 6) AS recall, n_found = n_required AS complete, coalesce(n, 0) AS n_forbidden FROM r LEFT JOIN x USING (query_id)""",
    "merge_spans": f"WITH {_SPANS}, {_MS.format(2)} SELECT doc_id, min(s) AS start_line, max(e) AS end_line, count(*) AS n_spans FROM mi GROUP BY doc_id, k",
    "span_coverage": f"""WITH {_SPANS}, g AS (SELECT DISTINCT user_id AS gold_id, user_id * 31 % 1900 AS gs, user_id * 31 % 1900 + user_id % 40 AS ge FROM events), c AS (SELECT gold_id, gs, ge, greatest(s, gs) AS s, least(e, ge) AS e FROM g JOIN sp ON doc_id = gold_id AND s <= ge AND e >= gs),
l AS (SELECT gold_id, count(DISTINCT i) AS covered FROM (SELECT gold_id, unnest(range(s, e + 1)) AS i FROM c) GROUP BY 1), b AS (SELECT gold_id, max(e - s + 1) AS best, count(*) AS n FROM c GROUP BY 1)
SELECT gold_id, CASE WHEN best = ge - gs + 1 THEN 'contained' WHEN covered = ge - gs + 1 THEN 'union' WHEN covered > 0 THEN 'partial' ELSE 'none' END AS coverage, round(coalesce(best, 0) / (ge - gs + 1), 6) AS best_ratio, coalesce(n, 0) > 1 AS split FROM g LEFT JOIN l USING (gold_id) LEFT JOIN b USING (gold_id)""",
    "paired_transitions": f"""WITH {_G}, {_FIRST}, v AS (SELECT query_id, 'bm25' AS variant, coalesce(rank <= 1, false) AS hit FROM fa UNION ALL SELECT query_id, 'overlap', coalesce(rank <= 5, false) FROM fb)
SELECT variant, CASE WHEN coalesce(b.rank <= 1, false) THEN 'hit' ELSE 'miss' END || '->' || CASE WHEN hit THEN 'hit' ELSE 'miss' END AS transition, count(*) AS n FROM v JOIN fb b USING (query_id) GROUP BY 1, 2""",
    "complementarity": f"""WITH {_G}, {_FIRST}, r AS (SELECT d AS depth, 'm' || fa.query_id % 3 AS segment, coalesce(fa.rank <= d, false) AS x, coalesce(fb.rank <= d, false) AS y FROM fa JOIN fb USING (query_id) JOIN (SELECT unnest([1, 5, 10, 20]) AS d) ON true)
SELECT depth, CASE WHEN grouping(segment) = 1 THEN '*' ELSE segment END AS segment, count(*) FILTER (WHERE x AND NOT y) AS only_a, count(*) FILTER (WHERE y AND NOT x) AS only_b, count(*) FILTER (WHERE x AND y) AS "both", count(*) FILTER (WHERE NOT x AND NOT y) AS neither, round(1 - count(*) FILTER (WHERE NOT x AND NOT y) / count(*), 6) AS union_recall FROM r GROUP BY GROUPING SETS ((depth, segment), (depth))""",
    "rank_buckets": f"""WITH {_G}, {_FIRST}, b AS (SELECT * FROM (VALUES ('001-005', 1, 5), ('006-010', 6, 10), ('011-020', 11, 20), ('021-050', 21, 50), ('051-100', 51, 100), ('>100', 101, 1000000000), ('absent', 0, 0)) v(bucket, lo, hi))
SELECT bucket, count(r.query_id) AS n FROM b LEFT JOIN (SELECT query_id, coalesce(rank, 0) AS rank FROM fb) r ON r.rank BETWEEN lo AND hi GROUP BY 1""",
    "budget_curve": f"""WITH {_G}, u AS (SELECT d AS depth, x.query_id, x.chunk_id FROM (SELECT query_id, chunk_id, rank FROM bm UNION ALL SELECT query_id, chunk_id, rank FROM ov) x JOIN (SELECT unnest([5, 10, 20]) AS d) ON rank <= d),
p AS (SELECT depth, query_id, count(DISTINCT u.chunk_id) AS size, count(*) AS n, max(CASE WHEN (u.query_id, u.chunk_id) IN (SELECT (query_id, chunk_id) FROM gold) THEN 1 ELSE 0 END) AS hit FROM u GROUP BY 1, 2)
SELECT depth, round(avg(size), 6) AS mean_size, quantile_disc(size, 0.5) AS p50_size, quantile_disc(size, 0.95) AS p95_size, max(size) AS max_size, round(avg(n - size), 6) AS mean_duplicates, round(sum(hit) FILTER (WHERE query_id IN (SELECT query_id FROM gold)) / count(*) FILTER (WHERE query_id IN (SELECT query_id FROM gold)), 6) AS union_recall FROM p GROUP BY 1""",
    "bootstrap_ci": """WITH u AS (SELECT vec_id AS i, CAST(vec_id * 37 % 11 AS DOUBLE) - CAST(vec_id * 53 % 7 AS DOUBLE) AS d FROM embeddings), m AS (SELECT count(*) AS m FROM u), r AS (SELECT unnest(range(0, 200)) AS r),
s AS (SELECT r, round(avg(v.d), 12) AS mean FROM u JOIN m ON true JOIN r ON true JOIN u v ON v.i = (u.i * (2 * r + 1) + r) % m GROUP BY 1)
SELECT round(list_sort(list(mean))[greatest(CAST(ceil(round(0.025 * count(*), 9)) AS BIGINT), 1)], 6) AS low, round(list_sort(list(mean))[CAST(ceil(round(0.975 * count(*), 9)) AS BIGINT)], 6) AS high, round(avg(mean), 6) AS center, round((SELECT avg(d) FROM u), 6) AS observed FROM s""",
    "rank_correlation": f"""WITH {base.LEX}, c AS (SELECT a.query_id, a.rank AS ra, b.rank AS rb, row_number() OVER (PARTITION BY a.query_id ORDER BY a.rank) AS xa, row_number() OVER (PARTITION BY a.query_id ORDER BY b.rank) AS xb FROM bm a JOIN ov b USING (query_id, chunk_id)),
g AS (SELECT query_id, count(*) AS n, sum((xa - xb) * (xa - xb)) AS d2, count(*) FILTER (WHERE ra <= 10 AND rb <= 10) AS top FROM c GROUP BY 1)
SELECT query_id, n AS n_common, round(CASE WHEN n > 1 THEN 1 - 6 * d2 / (n * (n * n - 1)) END, 6) AS spearman, round(top / 10, 6) AS overlap_at_k FROM g""",
    "compare_runs": """WITH a AS (SELECT doc_id, [doc_id, doc_id % 5] AS c, [doc_id % 3] AS e, CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'ok' END AS s, n_chars % 10 AS m FROM documents WHERE doc_id % 17 <> 0),
b AS (SELECT doc_id, [doc_id, doc_id % 6] AS c, [doc_id % 6] AS e, CASE WHEN doc_id % 14 = 0 THEN 'failed' ELSE 'ok' END AS s, n_chars % 10 AS m FROM documents WHERE doc_id % 17 <> 1)
SELECT coalesce(a.doc_id, b.doc_id) AS sample_id, concat_ws(',', CASE WHEN a.doc_id IS NULL THEN 'missing_in_a' END, CASE WHEN b.doc_id IS NULL THEN 'missing_in_b' END, CASE WHEN a.c <> b.c THEN 'candidates' END, CASE WHEN a.e <> b.e THEN 'evidence' END, CASE WHEN a.s <> b.s THEN 'status' END, CASE WHEN a.m <> b.m THEN 'metric' END) AS changes FROM a FULL JOIN b USING (doc_id)""",
    "failure_attribution": """WITH s AS (SELECT doc_id, doc_id % 5 <> 0 AS able, doc_id % 7 <> 0 AS ans, doc_id % 11 AS n, doc_id % 4 <> 0 AS gc, doc_id % 6 <> 0 AS ge, doc_id % 9 <> 0 AS ci, doc_id % 13 <> 0 AS co FROM documents),
f AS (SELECT doc_id, concat_ws(',', CASE WHEN NOT able AND ans THEN 'false_answer' END, CASE WHEN able AND n = 0 THEN 'no_candidates' END, CASE WHEN able AND NOT gc THEN 'retrieval_miss' END, CASE WHEN able AND gc AND NOT ge THEN 'selection_miss' END, CASE WHEN able AND NOT ans THEN 'false_abstention' END, CASE WHEN ans AND NOT ci THEN 'citation_missing' END, CASE WHEN ans AND NOT co THEN 'wrong_answer' END) AS flags FROM s)
SELECT doc_id AS sample_id, CASE WHEN flags = '' THEN 'none' ELSE split_part(flags, ',', 1) END AS "primary", flags FROM f""",
    "replicate_stability": """WITH r AS (SELECT doc_id AS sample_id, k, CAST((doc_id * 7 + k * (doc_id % 3)) % 4 AS VARCHAR) AS o FROM documents JOIN (SELECT unnest([1, 2, 3]) AS k) ON true), c AS (SELECT sample_id, o, count(*) / 3 AS p FROM r GROUP BY 1, 2),
g AS (SELECT sample_id, count(*) AS n, max(p) AS m, sum(-p * log2(p)) AS h FROM c GROUP BY 1), e AS (SELECT sample_id, min_by(o, k) AS f, max_by(o, k) AS l FROM r GROUP BY 1)
SELECT sample_id, n AS n_outcomes, round(m, 6) AS modal_share, n = 1 AS stable, round(CASE WHEN n > 1 THEN h / log2(n) ELSE 0 END, 6) AS entropy, f AS first_outcome, l AS last_outcome FROM g JOIN e USING (sample_id)""",
    "set_jaccard": """WITH r AS (SELECT doc_id, k, CASE WHEN doc_id % 6 = 0 THEN CAST([] AS BIGINT[]) ELSE list_distinct([doc_id % 3, k % (doc_id % 4 + 1), 9]) END AS x FROM documents JOIN (SELECT unnest([1, 2, 3]) AS k) ON true),
p AS (SELECT a.doc_id, CASE WHEN len(list_distinct(list_concat(a.x, b.x))) = 0 THEN 1 ELSE len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))) END AS j FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.k < b.k)
SELECT doc_id AS sample_id, round(avg(j), 6) AS jaccard, count(*) AS n_pairs FROM p GROUP BY 1""",
    "leakage_scan": f"""WITH i AS (SELECT item_id, text FROM benchmark UNION ALL SELECT doc_id + 1000000, CASE WHEN doc_id % 40 = 0 THEN upper(text) ELSE text END FROM documents WHERE doc_id % 20 = 0),
n AS (SELECT item_id, text, {_NORM} AS norm, list_distinct([t FOR t IN string_split({_NORM}, ' ') IF t <> '']) AS ts FROM i), d AS (SELECT doc_id, text AS body, {_NORM} AS norm_d, list_distinct([t FOR t IN string_split({_NORM}, ' ') IF t <> '']) AS td FROM documents),
p AS (SELECT item_id, doc_id, text = body AS ex, norm <> '' AND norm = norm_d AS no, len(ts) AS ni, len(td) AS nd, CASE WHEN len(ts) > 0 AND least(len(ts), len(td)) >= 0.82 * greatest(len(ts), len(td)) THEN len(list_intersect(ts, td)) ELSE 0 END AS c FROM n JOIN d ON true)
SELECT item_id, doc_id, CASE WHEN ex THEN 'exact' WHEN no THEN 'normalized' ELSE 'near' END AS kind FROM p WHERE ex OR no OR (c > 0 AND c >= 0.82::DOUBLE * (ni + nd - c))""",
    "containment_scan": f"WITH {base.GOLD} SELECT query_id AS item_id, chunk_id AS doc_id FROM gold",
    "secret_scan": f"WITH s AS ({_SECRETS}) SELECT doc_id, kind, CAST(ordinal AS BIGINT) AS ordinal, sha256(value) AS value_sha256, CAST(position(value IN text) AS BIGINT) AS position FROM s WHERE NOT regexp_matches(value, '{ev.PLACEHOLDER}')",
    "redact_text": f"SELECT doc_id, sha256({_redacted()[0]}) AS text_sha, CAST({_redacted()[1]} AS INTEGER) AS n_replaced FROM documents",
    "text_fidelity": f"""WITH r AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest({base.sql_tokens("text")}) AS t FROM documents) GROUP BY 1, 2),
c AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest({base.sql_tokens("regexp_replace(text, 'the|ou', 'THE ', 'g')")}) AS t FROM documents) GROUP BY 1, 2),
g AS (SELECT doc_id, sum(least(coalesce(r.n, 0), coalesce(c.n, 0))) AS k, sum(coalesce(r.n, 0)) AS nr, sum(coalesce(c.n, 0)) AS nc FROM r FULL JOIN c USING (doc_id, t) GROUP BY 1)
SELECT doc_id, round(CASE WHEN nr > 0 THEN k / nr ELSE 1 END, 6) AS retention, CAST(nr - k AS BIGINT) AS n_omitted, CAST(nc - k AS BIGINT) AS n_added FROM g""",
    "answer_scores": """WITH s AS (SELECT doc_id % 4 = 0 AS ea, doc_id % 5 <> 0 AS an, doc_id % 2 = doc_id % 6 AS cl, doc_id % 7 = 0 OR doc_id % 3 < 2 AS va, doc_id % 7 <> 0 AS ci FROM documents),
m AS (SELECT unnest([{'metric': 'action_correct', 'x': CAST(ea <> an AS INTEGER), 'y': 1}, {'metric': 'claims_complete', 'x': CAST(an AND cl AS INTEGER), 'y': CAST(an AS INTEGER)}, {'metric': 'citations_valid', 'x': CAST(an AND va AS INTEGER), 'y': CAST(an AS INTEGER)}, {'metric': 'cited', 'x': CAST(an AND ci AS INTEGER), 'y': CAST(an AS INTEGER)}, {'metric': 'false_answers', 'x': CAST(an AND ea AS INTEGER), 'y': CAST(ea AS INTEGER)}], recursive := true) FROM s)
SELECT metric, CAST(sum(x) AS BIGINT) AS numerator, CAST(sum(y) AS BIGINT) AS denominator, round(sum(x) / sum(y), 6) AS rate FROM m GROUP BY 1""",
    "router_scores": """WITH g AS (SELECT source AS arm, count(*) FILTER (WHERE doc_id % 3 = 0 AND doc_id % 4 = 0) AS tp, count(*) FILTER (WHERE doc_id % 3 = 0) AS f, count(*) FILTER (WHERE doc_id % 4 = 0) AS w, CAST(sum(CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 - doc_id % 5 ELSE 0 END) AS BIGINT) AS net_gain, count(*) FILTER (WHERE doc_id % 3 = 0 AND doc_id % 7 < doc_id % 5) AS n_regressions FROM documents GROUP BY 1),
p AS (SELECT *, CASE WHEN f > 0 THEN tp / f ELSE 0 END AS pr, CASE WHEN w > 0 THEN tp / w ELSE 0 END AS re FROM g)
SELECT arm, net_gain, n_regressions, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM p""",
    "latency_summary": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.99), 6) AS p99, round(max(value), 6) AS max, round(stddev_pop(value), 6) AS std FROM events WHERE value IS NOT NULL GROUP BY 1",
    "stage_profile": """WITH t AS (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS r, event_type AS stage, CAST(round(value, 2) AS DECIMAL(18,2)) AS v FROM events WHERE value IS NOT NULL), p AS (SELECT r, stage, sum(v) AS ms FROM t GROUP BY 1, 2), o AS (SELECT r, sum(ms) AS total FROM p GROUP BY 1), c AS (SELECT quantile_disc(total, 0.95) AS cut FROM o),
a AS (SELECT sum(total) AS al, sum(total) FILTER (WHERE total >= cut) AS sl FROM o JOIN c ON true)
SELECT stage, CAST(quantile_disc(ms, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(ms, 0.95) AS DOUBLE) AS p95, round(CAST(sum(ms) AS DOUBLE) / any_value(al), 5) AS share, round(corr(ms, total), 5) AS corr_total, round(CAST(coalesce(sum(ms) FILTER (WHERE total >= cut), 0) AS DOUBLE) / any_value(sl), 5) AS slow_share FROM p JOIN o USING (r) JOIN c ON true JOIN a ON true GROUP BY 1""",
    "traffic_monitor": f"WITH {_MON} SELECT release, scope, n_requests, n_errors, n_completed, round(mean_value, 6) AS mean_value, round(max_value, 6) AS max_value, round(n_errors / n_requests, 6) AS error_rate FROM mon",
    "release_report": sql_report("CASE WHEN grouping(release) = 1 THEN '*' ELSE release END AS release, CASE WHEN grouping(scope) = 1 THEN '*' ELSE scope END AS scope", "GROUPING SETS ((release, scope), (release), ())", "GROUPING SETS ((release, scope, terminal), (release, terminal), (terminal))"),
    "decision_stability": f"WITH {_OBS}, g AS (SELECT user_id, scope, count(*) AS n, count(DISTINCT event_type || event_id % 2) AS n_decisions FROM obs GROUP BY 1, 2) SELECT *, n_decisions = 1 AS stable FROM g WHERE n > 1",
    "drift_gates": f"""WITH {_MON}, f AS (SELECT release, scope, concat_ws(',', CASE WHEN n_errors / n_requests > 0.05 THEN 'error_rate' END, CASE WHEN mean_value > 50 THEN 'mean_value' END, CASE WHEN n_requests > 3000 THEN 'n_requests' END) AS drifts FROM mon)
SELECT release, scope, drifts, CASE WHEN drifts = '' THEN 'release' WHEN NOT contains(drifts, ',') THEN 'watch' ELSE 'block' END AS decision FROM f""",
    "evidence_rounds": f"""WITH {base.LEX}, {_EVI}, u AS (SELECT *, 1 AS round FROM ea UNION ALL SELECT *, 2 FROM eb), w AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY round, rank, chunk_id) AS c, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round, rank, chunk_id) AS d, row_number() OVER (PARTITION BY query_id, doc_id, section_id ORDER BY round, rank, chunk_id) AS s FROM u)
SELECT query_id, chunk_id, CAST(round AS BIGINT) AS round, rank, CASE WHEN c > 1 THEN 'duplicate' WHEN d = 1 THEN 'new_document' WHEN s = 1 THEN 'new_section' ELSE 'new_chunk' END AS gain FROM w""",
    "evidence_delta": f"""WITH {base.LEX}, {_EVI}, g AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, count(*) FILTER (WHERE a.rank IS NOT NULL AND b.rank IS NOT NULL) AS n_common, count(*) FILTER (WHERE a.rank IS NULL) AS n_new, count(*) FILTER (WHERE b.rank IS NULL) AS n_removed, count(*) FILTER (WHERE a.rank <> b.rank) AS n_moved, count(DISTINCT b.doc_id) - count(DISTINCT a.doc_id) AS diversity_change
  FROM ea a FULL JOIN eb b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id GROUP BY 1)
SELECT *, CASE WHEN n_common = 0 THEN 'replaced' WHEN n_new = 0 AND n_removed = 0 THEN CASE WHEN n_moved = 0 THEN 'unchanged' ELSE 'reordered' END WHEN n_removed = 0 THEN 'extended' WHEN n_new = 0 THEN 'reduced' ELSE 'mixed' END AS outcome FROM g""",
}
