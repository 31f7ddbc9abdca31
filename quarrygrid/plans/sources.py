"""Registered queries: sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrygrid.common import scratch_path, table
from quarrygrid.operators.evaluation import monitor_report
from quarrygrid.plans import base
from quarrygrid.plans.evaluation import SAFETY, requests, shown_report, sql_report
from quarrygrid.sources import corpus as src
from quarrygrid.streaming import jobs


def scan_corpus(spark, sf):
    return src.scan_corpus(spark, sf, ("parquet",)).drop("modified")


def _manifest(spark, sf):
    return src.corpus_manifest(table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text"))


def corpus_manifest(spark, sf):
    rows, _ = _manifest(spark, sf)
    return rows


def corpus_digest(spark, sf):
    _, whole = _manifest(spark, sf)
    return whole


def replace_doc_chunks(spark, sf):
    d = table(spark, sf, "documents")
    chunk = lambda n, v: d.select("doc_id", F.posexplode(F.array_repeat(F.lit(v), n)).alias("chunk_index", "version"))
    return src.replace_doc_chunks(chunk(3, "old"), chunk(2, "new").where("doc_id % 15 <> 0"), d.where("doc_id % 5 = 0").select("doc_id"))


def materialize_vectors(spark, sf):
    e = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    i = F.col("chunk_id")
    chunks = e.where(i % 10 != 0).select("chunk_id", (i % 50).alias("doc_id"), F.when(i % 11 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("embedding"), F.array(F.lit("t"), F.col("label").cast("string")).alias("heading_path"))
    existing = e.where(i % 3 != 0).select("chunk_id", F.when(i % 7 == 0, F.reverse("embedding")).otherwise(F.col("embedding")).alias("embedding"))
    return src.materialize_vectors(chunks, existing, 64)[1]


FIXTURE = "fixture_schema_version int, sample_id long, question string, retrieval_configuration map<string,string>"


def read_eval_fixture(spark, sf):
    path = scratch_path(spark, "fixture")
    rows = base.search_queries(spark, sf).select(F.when(F.col("query_id") % 9 == 0, 1).otherwise(2).alias("fixture_schema_version"), F.col("query_id").alias("sample_id"), F.col("text").alias("question"), F.create_map(F.lit("mode"), F.when(F.col("query_id") % 5 == 0, "bm25").otherwise("hybrid")).alias("retrieval_configuration"))
    src.write_eval_fixture(rows, path)
    return src.read_eval_fixture(spark, path, FIXTURE, 2, {"mode": "hybrid"}).select("sample_id", "question", "problem")


def write_eval_fixture(spark, sf):
    path = scratch_path(spark, "fixture")
    src.write_eval_fixture(table(spark, sf, "benchmark"), path)
    return spark.read.schema("item_id long, text string").json(path)


def read_observation_log(spark, sf):
    path = scratch_path(spark, "observations")
    e = table(spark, sf, "events")
    i = F.col("event_id")
    line = F.when(i % 50 == 0, "{broken").otherwise(F.to_json(F.struct("event_id", "event_type", F.when(i % 20 == 3, F.lit("x")).alias("password"))))
    e.select(line.alias("value")).write.text(path)
    return src.read_observation_log(spark, path, "event_id long, event_type string")


def stream_ingest(spark, sf):
    return jobs.stream_ingest(jobs.read_stream(spark, sf, "documents").select("doc_id", "text"))


def stream_monitor(spark, sf):
    out = jobs.run_to_table(jobs.stream_monitor(jobs.read_stream(spark, sf, "events")), "monitor", "update", ["window_start", "event_type"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_requests", F.round("mean_value", 6).alias("mean_value"), F.round("max_value", 6).alias("max_value"))


def stream_report(spark, sf):
    counts = jobs.stream_report_counts(requests(jobs.read_stream(spark, sf, "events")), SAFETY)
    held = jobs.run_to_table(counts, "report", "update", ["window_start", "release", "scope", "terminal"])
    return shown_report(monitor_report(held.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), ["window_start", "release"], SAFETY))


def stream_request_dedup(spark, sf):
    e = jobs.read_stream(spark, sf, "events").select("ts", F.col("user_id").alias("session_id"), F.concat(F.lit("r"), (F.col("event_id") % 40).cast("string")).alias("client_request_id"))
    return jobs.run_to_table(jobs.stream_request_dedup(e), "dedup").select("session_id", "client_request_id")


def stream_sessions(spark, sf):
    out = jobs.run_to_table(jobs.stream_sessions(jobs.read_stream(spark, sf, "events")), "sessions", "complete")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n_events", F.round("total_value", 4).alias("total_value"))


def stream_turn_state(spark, sf):
    t = jobs.read_stream(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "text")
    return jobs.run_to_table(jobs.stream_turn_state(t), "turns")


def stream_turns(spark, sf):
    """Each turn asked for once, every third one of a conversation twice."""
    t = jobs.read_stream(spark, sf, "conversations").withColumn("again", F.explode(F.sequence(F.lit(0), (F.col("turn") % 3 == 0).cast("int"))))
    asked = t.select(F.col("conv_id").alias("session_id"), F.concat(F.lit("r"), "turn").alias("client_request_id"), (F.col("turn") * 2 + F.col("again") * 3).alias("arrived"), "text", F.lit("completed").alias("status"))
    with jobs.stored_states(spark):
        return jobs.run_to_table(jobs.stream_turns(asked, 6, 900), "asked-turns")


def _traces(df):
    return df.where("event_id % 17 <> 4").select(F.col("user_id").alias("trace_id"), (F.col("event_id") % 101 + 1).alias("sequence"))


def stream_trace_order(spark, sf):
    return jobs.run_to_table(jobs.stream_trace_order(_traces(jobs.read_stream(spark, sf, "events"))), "traces", "update", ["trace_id"])


QUERIES = {f.__name__: f for f in (scan_corpus, corpus_manifest, corpus_digest, replace_doc_chunks, materialize_vectors, read_eval_fixture, write_eval_fixture, read_observation_log, stream_ingest, stream_monitor, stream_report, stream_request_dedup, stream_sessions, stream_turn_state, stream_turns, stream_trace_order)}

_MAN = "r AS (SELECT doc_id AS path, sha256(CAST(doc_id AS VARCHAR)) AS path_sha, sha256(coalesce(text, '')) AS content_sha, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, left(sha256(CAST(doc_id AS VARCHAR)), 4) AS bucket FROM documents)"
ORACLE_SQL = {
    "corpus_manifest": f"WITH {_MAN} SELECT * FROM r",
    "corpus_digest": f"""WITH {_MAN}, l1 AS (SELECT bucket AS b, bucket || ':' || sha256(string_agg(path_sha || ':' || content_sha || ':' || n_bytes, chr(10) ORDER BY path_sha || ':' || content_sha || ':' || n_bytes)) AS d, count(*) AS n, sum(n_bytes) AS nb FROM r GROUP BY 1),
l2 AS (SELECT left(b, 2) AS c, left(b, 2) || ':' || sha256(string_agg(d, chr(10) ORDER BY d)) AS d, sum(n) AS n, sum(nb) AS nb FROM l1 GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_documents, CAST(sum(nb) AS BIGINT) AS n_bytes, sha256(string_agg(d, chr(10) ORDER BY d)) AS corpus_digest FROM l2""",
    "replace_doc_chunks": "SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, 'old' AS version FROM documents JOIN (SELECT unnest([0, 1, 2]) AS i) ON true WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, CAST(i AS INTEGER), 'new' FROM documents JOIN (SELECT unnest([0, 1]) AS i) ON true WHERE doc_id % 5 = 0 AND doc_id % 15 <> 0",
    "materialize_vectors": """WITH w AS (SELECT vec_id, vec_id % 11 = 0 AS bad FROM embeddings WHERE vec_id % 10 <> 0), h AS (SELECT vec_id, vec_id % 7 = 0 AS other FROM embeddings WHERE vec_id % 3 <> 0)
SELECT CASE WHEN h.vec_id IS NULL THEN 'insert' WHEN other THEN 'update' ELSE 'keep' END AS action, count(*) AS n FROM w LEFT JOIN h USING (vec_id) WHERE NOT bad GROUP BY 1 UNION ALL SELECT 'delete', count(*) FROM h WHERE vec_id NOT IN (SELECT vec_id FROM w WHERE NOT bad) UNION ALL SELECT 'reject', count(*) FROM w WHERE bad""",
    "read_eval_fixture": "SELECT item_id AS sample_id, text AS question, CASE WHEN item_id % 9 = 0 THEN 'version' WHEN item_id % 5 = 0 THEN 'configuration' END AS problem FROM benchmark",
    "write_eval_fixture": "SELECT item_id, text FROM benchmark",
    "read_observation_log": "SELECT event_id, event_type, CASE WHEN event_id % 20 = 3 THEN 'password' ELSE '' END AS sensitive FROM events WHERE event_id % 50 <> 0",
    "stream_ingest": f"WITH t AS (SELECT doc_id AS chunk_id, unnest({base.sql_tokens('text')}) AS term FROM documents) SELECT chunk_id, term, count(*) AS tf FROM t GROUP BY 1, 2",
    "stream_monitor": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n_requests, round(avg(value), 6) AS mean_value, round(max(value), 6) AS max_value FROM events GROUP BY 1, 2",
    "stream_report": sql_report("date_trunc('day', ts) AS window_start, release", "date_trunc('day', ts), release", "date_trunc('day', ts), release, terminal"),
    "stream_request_dedup": "SELECT DISTINCT user_id AS session_id, 'r' || event_id % 40 AS client_request_id FROM events",
    "stream_sessions": """WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n_events, round(sum(value), 4) AS total_value FROM s GROUP BY user_id, k""",
    "stream_turn_state": """WITH t AS (SELECT conv_id AS s, turn, length(CASE WHEN coalesce(text, '') = '' THEN '-' ELSE text END) AS l, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT s AS session_id, turn, n AS turn_number, least(n - 1, 6) AS n_context, CAST(coalesce(sum(l) OVER (PARTITION BY s ORDER BY n ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS context_chars FROM t""",
    "stream_turns": """WITH t AS (SELECT conv_id AS s, turn, text, turn * 2 AS arrived, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE trim(text) <> ''),
p AS (SELECT t.s, t.n, b.n AS k, row_number() OVER (PARTITION BY t.s, t.n ORDER BY b.n DESC) AS r, CASE WHEN b.n = t.n - 1 THEN left(b.text, 900) ELSE b.text END AS x FROM t JOIN t b ON b.s = t.s AND b.n BETWEEN t.n - 6 AND t.n - 1),
u AS (SELECT *, sum(length(x)) OVER (PARTITION BY s, n ORDER BY r) AS used FROM p),
g AS (SELECT s, n, count(*) AS c, sum(length(x)) AS l, string_agg(x, chr(10) ORDER BY k) AS txt FROM u WHERE used <= 900 GROUP BY 1, 2)
SELECT t.s AS session_id, 'r' || turn AS client_request_id, arrived, 'created' AS outcome, t.n AS turn_number, CAST(coalesce(c, 0) AS INTEGER) AS n_context, CAST(coalesce(l, 0) AS INTEGER) AS context_chars, sha256(coalesce(txt, '')) AS context_sha FROM t LEFT JOIN g ON g.s = t.s AND g.n = t.n
UNION ALL SELECT s, 'r' || turn, arrived + 3, 'repeated', n, NULL, NULL, NULL FROM t WHERE turn % 3 = 0
UNION ALL SELECT conv_id, 'r' || turn, turn * 2 + a, 'refused_empty', NULL, NULL, NULL, NULL FROM conversations JOIN (SELECT unnest([0, 3]) AS a) ON a = 0 OR turn % 3 = 0 WHERE coalesce(trim(text), '') = '' AND text IS NOT NULL""",
    "stream_trace_order": "WITH r AS (SELECT DISTINCT user_id AS trace_id, event_id % 101 + 1 AS s FROM events WHERE event_id % 17 <> 4), g AS (SELECT *, CAST(s > coalesce(lag(s) OVER (PARTITION BY trace_id ORDER BY s), 0) + 1 AS INTEGER) AS gap FROM r) SELECT trace_id, count(*) AS n_events, max(s) AS last_sequence, CAST(sum(gap) AS BIGINT) AS n_gaps FROM g GROUP BY 1",
}
