"""Registered queries: answer checks and conversations. Answers are assistant turns with markers added by their number."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrygrid.common import table
from quarrygrid.operators import answers as an
from quarrygrid.operators import conversation as cv
from quarrygrid.plans import base


def _answers(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    q = F.col("conv_id") * 100 + F.col("turn")
    k = F.col("conv_id") % 7
    head = F.regexp_replace("text", r"[\[\]`]", "")
    text = F.when(k == 0, F.concat(head, F.lit(" [C1]. More about it [C2][C9]."))).when(k == 1, F.concat(head, F.lit(". See [C1](http://x) now. [c2]"))).when(k == 2, F.concat(F.lit("- one item of 42% here\n2) "), head, F.lit(" [C1]\n\nAnd a second paragraph."))).when(k == 3, F.concat(F.lit("```\n[C3]\n```\n"), head, F.lit(". [C2]"))).otherwise(F.concat(head, F.lit(". Again [C1].")))
    return c.select(q.alias("query_id"), text.alias("answer_text"), F.when(k == 5, F.array(F.lit("C2"))).when(k == 0, F.array(F.lit("C1"), F.lit("C2"), F.lit("C9"))).when(k == 3, F.array(F.lit("C2"))).otherwise(F.array(F.lit("C1"))).alias("structured"))


def _evidence(spark, sf):
    c = table(spark, sf, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"))
    e = c.select("conv_id", F.concat(F.lit("C"), (F.col("turn") + 1).cast("string")).alias("citation_id"), F.col("text").alias("content"))
    return a.join(e, "conv_id").select("query_id", "citation_id", "content")


def _questions(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text")


def parse_citations(spark, sf):
    return an.parse_citations(_answers(spark, sf)).select("query_id", F.array_join("citations", ",").alias("citations"), F.array_join("invalid", ",").alias("invalid"))


def citation_check(spark, sf):
    return an.citation_check(_answers(spark, sf), _evidence(spark, sf))


def citation_coverage(spark, sf):
    return an.citation_coverage(_answers(spark, sf), _evidence(spark, sf)).withColumn("coverage", F.round("coverage", 6))


def split_claims(spark, sf):
    return an.split_claims(_answers(spark, sf)).withColumn("claim_no", F.col("claim_no").cast("long"))


def claim_support(spark, sf):
    return an.claim_support(an.split_claims(_answers(spark, sf)), _evidence(spark, sf))


def query_coverage(spark, sf):
    return an.query_coverage(_questions(spark, sf), _evidence(spark, sf)).withColumn("coverage", F.round("coverage", 6))


def conflicting_values(spark, sf):
    e = _evidence(spark, sf).withColumn("content", F.concat("content", F.lit(" "), (F.col("query_id") % 3 + F.length("content") % 2).cast("string")))
    return an.conflicting_values(_questions(spark, sf), e, 1)


def answerability(spark, sf):
    d, m = table(spark, sf, "documents"), lambda k, r=0: F.col("doc_id") % k == r
    s = d.select(F.col("doc_id").alias("query_id"), (F.col("doc_id") % 9).alias("n_items"), F.col("n_chars"), m(14, 3).cast("int").alias("n_invalid"), (F.col("doc_id") % 5).alias("n_sources"), m(17).alias("degraded"), m(16, 5).alias("exact_missing"), m(15, 7).alias("inference"), m(13, 2).alias("false_premise"), m(12, 1).alias("conflict"), (F.col("doc_id") % 10 / 10).alias("top_score"), (F.col("doc_id") % 11 / 10).alias("coverage"))
    return an.answerability(s).withColumn("confidence", F.round("confidence", 6))


def query_screen(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id") % 12
    text = F.when(k == 0, F.concat(F.lit("Select a from b "), "text")).when(k == 1, F.concat("text", F.lit(" | sh"))).when(k == 2, F.concat(F.lit("please IGNORE previous "), "text")).otherwise(F.col("text"))
    return an.query_screen(d.select(F.col("doc_id").alias("query_id"), text.alias("text")))


def _turns(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_number"), "text")


def conversation_context(spark, sf):
    return cv.conversation_context(_turns(spark, sf), 6, 900)


def followup_rewrite(spark, sf):
    k = (F.col("session_id") + F.col("turn_number")) % 4
    text = F.when(k == 1, F.concat(F.lit("And "), "text")).when(k == 2, F.concat("text", F.lit(" [C1]"))).otherwise(F.col("text"))
    # turns are longer than follow-ups usually are; beyond 400 characters none is
    out = cv.followup_rewrite(_turns(spark, sf).select("session_id", "turn_number", text.alias("text")), max_chars=400)
    return out.select("session_id", "turn_number", "is_followup", F.sha2("standalone", 256).alias("standalone_sha"))


def turn_idempotency(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.concat(F.lit("r"), (F.col("event_id") % 40).cast("string")).alias("client_request_id"), F.col("event_id").alias("arrived"))
    return cv.turn_idempotency(e).withColumn("turn_number", F.col("turn_number").cast("long"))


def turn_lifecycle(spark, sf):
    k = F.col("conv_id") * 7 + F.col("turn") * 3
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_number"), F.when(k % 11 == 0, "running").when(k % 11 == 1, "failed").when(k % 11 == 2, "odd").otherwise("completed").alias("status"), (k % 5 != 0).alias("completed"), F.when(k % 13 < 3, "e").alias("error_code"))
    return cv.turn_lifecycle(t)


def turn_citations(spark, sf):
    d = table(spark, sf, "documents")
    c = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("conv_id") * 10 + F.col("turn")).alias("chunk_id")).join(d.select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("h")), "chunk_id", "left").select("conv_id", "turn", "chunk_id", F.when(F.col("chunk_id") % 4 == 0, "old").otherwise(F.col("h")).alias("content_hash"))
    return cv.turn_citations(c, d.where("doc_id % 6 <> 1").select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("content_hash"))).drop("content_hash")


QUERIES = {f.__name__: f for f in (parse_citations, citation_check, citation_coverage, split_claims, claim_support, query_coverage, conflicting_values, answerability, query_screen, conversation_context, followup_rewrite, turn_idempotency, turn_lifecycle, turn_citations)}

_A = """ca AS (SELECT conv_id, conv_id * 100 + turn AS query_id, conv_id % 7 AS k, regexp_replace(text, '[\\[\\]`]', '', 'g') AS h, text AS full_text FROM conversations WHERE role = 'assistant'),
ans AS (SELECT query_id, conv_id, k, CASE k WHEN 0 THEN h || ' [C1]. More about it [C2][C9].' WHEN 1 THEN h || '. See [C1](http://x) now. [c2]' WHEN 2 THEN '- one item of 42% here' || chr(10) || '2) ' || h || ' [C1]' || chr(10) || chr(10) || 'And a second paragraph.' WHEN 3 THEN '```' || chr(10) || '[C3]' || chr(10) || '```' || chr(10) || h || '. [C2]' ELSE h || '. Again [C1].' END AS t FROM ca),
evd AS (SELECT a.query_id, 'C' || (c.turn + 1) AS citation_id, c.text AS content FROM ca a JOIN conversations c USING (conv_id)), kn AS (SELECT query_id, list(DISTINCT citation_id) AS known FROM evd GROUP BY 1),
cl AS (SELECT query_id, conv_id, k, t, replace(regexp_replace(t, '(?s)```.*?(```|$)', ' ', 'g'), '][', '] [') AS u FROM ans),
pc AS (SELECT query_id, k, [regexp_extract(m, 'C[0-9]+') FOR m IN regexp_extract_all(u, '\\[C[0-9]+\\](?:[^(]|$)')] AS c0, regexp_extract_all(u, '\\[(?:c[0-9]+|C[ ]+[0-9]+|C[0-9]+[,;][^\\]\\n]*|C)\\]') AS i0 FROM cl),
pd AS (SELECT query_id, k, [c0[i] FOR i IN range(1, len(c0) + 1) IF list_position(c0, c0[i]) = i] AS c, [i0[i] FOR i IN range(1, len(i0) + 1) IF list_position(i0, i0[i]) = i] AS inv FROM pc),
pg AS (SELECT query_id, unnest(string_split_regex(regexp_replace(t, '(?s)```.*?(```|$)', ' ', 'g'), '\\n[ \\t]*\\n')) AS p FROM ans), pn AS (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE list_has_any(regexp_extract_all(p, '\\[(C[0-9]+)\\]', 1), coalesce(known, []))) AS c FROM pg LEFT JOIN kn USING (query_id) WHERE length(trim(p)) >= 20 GROUP BY 1),
cov AS (SELECT a.query_id, coalesce(n, 0) AS n_paragraphs, coalesce(c, 0) AS n_cited, coalesce(c / n, 0) AS coverage FROM ans a LEFT JOIN pn USING (query_id))"""
_Q = "qs AS (SELECT conv_id, conv_id * 100 + turn AS query_id, text FROM conversations WHERE role = 'assistant'), ev AS (SELECT q.query_id, c.text AS content FROM qs q JOIN conversations c USING (conv_id))"
ORACLE_SQL = {
    "parse_citations": f"WITH {_A} SELECT query_id, array_to_string(c, ',') AS citations, array_to_string(inv, ',') AS invalid FROM pd",
    "citation_coverage": f"WITH {_A} SELECT query_id, n_paragraphs, n_cited, round(coverage, 6) AS coverage FROM cov",
    "citation_check": f"""WITH {_A}, s AS (SELECT query_id, CASE k WHEN 5 THEN ['C2'] WHEN 0 THEN ['C1', 'C2', 'C9'] WHEN 3 THEN ['C2'] ELSE ['C1'] END AS st, c, inv FROM pd),
r AS (SELECT s.query_id, CASE WHEN len(inv) > 0 THEN 'malformed' WHEN len(c) = 0 THEN 'missing' WHEN NOT list_has_all(coalesce(known, []), c) THEN 'unknown' WHEN NOT list_has_all(st, c) OR NOT list_has_all(c, st) THEN 'mismatch' WHEN coverage < 0.5 THEN 'coverage' END AS reason FROM s LEFT JOIN kn USING (query_id) JOIN cov USING (query_id))
SELECT query_id, reason IS NULL AS valid, reason FROM r""",
    "split_claims": f"""WITH {_A}, l AS (SELECT query_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS ln FROM ans), m AS (SELECT query_id, ln, regexp_replace(regexp_replace(line, '^[ ]*(?:[-*+]|[0-9]+[.)])[ ]+', ''), '([.!?。！？](?:[ ]*\\[C[0-9]+\\])*)[ ]*', '\\1' || chr(10), 'g') AS x FROM l),
p AS (SELECT query_id, ln, trim(unnest(string_split(x, chr(10)))) AS claim, generate_subscripts(string_split(x, chr(10)), 1) AS part FROM m), o AS (SELECT *, nullif(array_to_string(regexp_extract_all(claim, '\\[(C[0-9]+)\\]', 1), ','), '') AS own FROM p WHERE claim <> '')
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY ln, part) - 1 AS claim_no, trim(regexp_replace(claim, '[ ]*\\[C[0-9]+\\]', '', 'g')) AS claim, coalesce(first_value(own IGNORE NULLS) OVER (PARTITION BY query_id, ln ORDER BY part ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), '') AS citations FROM o""",
    "query_coverage": f"""WITH {_Q}, t AS (SELECT query_id, list_distinct({base.sql_tokens("text")}) AS terms FROM qs), s AS (SELECT query_id, lower(string_agg(content, chr(10))) AS sup FROM ev GROUP BY 1), f AS (SELECT query_id, len(terms) AS n, len([x FOR x IN terms IF contains(coalesce(sup, ''), x)]) AS k FROM t LEFT JOIN s USING (query_id))
SELECT query_id, CAST(n AS INTEGER) AS n_terms, CAST(k AS INTEGER) AS n_found, round(CASE WHEN n > 0 THEN k / n ELSE 0 END, 6) AS coverage FROM f""",
    "conflicting_values": f"""WITH {_Q}, e AS (SELECT query_id, content || ' ' || (query_id % 3 + length(content) % 2) AS content FROM ev), x AS (SELECT e.query_id, list_distinct(regexp_extract_all(e.content, '{an.NUMBER}')) AS nums, len(list_intersect(list_distinct({base.sql_tokens("q.text")}), {base.sql_tokens("e.content")})) AS c FROM e JOIN qs q USING (query_id)),
g AS (SELECT query_id, count(DISTINCT nums[1]) AS n FROM x WHERE len(nums) = 1 AND c >= 1 GROUP BY 1) SELECT query_id, coalesce(n, 0) AS n_values, coalesce(n, 0) > 1 AS conflict FROM qs LEFT JOIN g USING (query_id)""",
    "answerability": """WITH s AS (SELECT doc_id AS i, n_chars, doc_id % 10 / 10 AS top, doc_id % 11 / 10 AS cov FROM documents), r AS (SELECT *, CASE WHEN i % 9 < 1 THEN 'no_evidence' WHEN i % 17 = 0 THEN 'degraded_retrieval' WHEN n_chars < 40 THEN 'too_little_context' WHEN i % 14 = 3 THEN 'invalid_items' WHEN i % 5 < 1 THEN 'too_few_sources' WHEN i % 16 = 5 THEN 'missing_exact_value' WHEN i % 15 = 7 THEN 'unsupported_inference'
  WHEN i % 13 = 2 THEN 'false_premise' WHEN i % 12 = 1 THEN 'conflicting_evidence' WHEN top < 0.2 THEN 'low_score' WHEN cov >= 0.8 THEN 'full_coverage' WHEN cov >= 0.4 THEN 'partial_coverage' ELSE 'low_coverage' END AS reason FROM s),
t AS (SELECT *, CASE WHEN reason = 'full_coverage' THEN 'answerable' WHEN reason = 'partial_coverage' THEN 'partial' WHEN reason = 'false_premise' THEN 'correct_premise' WHEN reason IN ('degraded_retrieval', 'invalid_items', 'too_few_sources', 'conflicting_evidence') THEN 'uncertain' ELSE 'unanswerable' END AS status FROM r)
SELECT i AS query_id, status, reason, round(CASE status WHEN 'answerable' THEN cov WHEN 'partial' THEN cov * 0.8 WHEN 'uncertain' THEN 0.5 ELSE 1 - cov END, 6) AS confidence FROM t""",
    "query_screen": "WITH d AS (SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN 'Select a from b ' || text WHEN 1 THEN text || ' | sh' WHEN 2 THEN 'please IGNORE previous ' || text ELSE text END AS text FROM documents), f AS (SELECT doc_id, text, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in an.SCREEN_RULES) + ") AS flags FROM d) SELECT doc_id AS query_id, flags, flags <> '' AS blocked, sha256(text) AS digest, CAST(length(text) AS INTEGER) AS n_chars FROM f",
    "conversation_context": """WITH p AS (SELECT t.conv_id AS s, t.turn AS n, b.turn AS k, row_number() OVER (PARTITION BY t.conv_id, t.turn ORDER BY b.turn DESC) AS r, b.text FROM conversations t JOIN conversations b ON b.conv_id = t.conv_id AND b.turn < t.turn),
c AS (SELECT *, CASE WHEN r = 1 THEN left(text, 900) ELSE text END AS x FROM p WHERE r <= 6), u AS (SELECT *, sum(length(x)) OVER (PARTITION BY s, n ORDER BY r) AS used FROM c), v AS (SELECT *, max(CASE WHEN used > 900 THEN 1 ELSE 0 END) OVER (PARTITION BY s, n ORDER BY r) AS over FROM u),
g AS (SELECT s, n, count(*) AS k, sum(length(x)) AS l, string_agg(x, chr(10) ORDER BY k) AS txt FROM v WHERE over = 0 GROUP BY 1, 2)
SELECT conv_id AS session_id, turn AS turn_number, CAST(coalesce(k, 0) AS INTEGER) AS n_context, CAST(coalesce(l, 0) AS INTEGER) AS context_chars, sha256(coalesce(txt, '')) AS context_sha FROM conversations LEFT JOIN g ON s = conv_id AND n = turn""",
    "followup_rewrite": f"""WITH t AS (SELECT conv_id AS s, turn AS n, CASE (conv_id + turn) % 4 WHEN 1 THEN 'And ' || text WHEN 2 THEN text || ' [C1]' ELSE text END AS x FROM conversations),
f AS (SELECT *, length(x) <= 400 AND (regexp_matches(x, '{cv.FOLLOW_UP}') OR regexp_matches(x, '\\[C[0-9]+\\]')) AND row_number() OVER (PARTITION BY s ORDER BY n) > 1 AS is_followup FROM t), a AS (SELECT *, sum(CAST(NOT is_followup AS INTEGER)) OVER (PARTITION BY s ORDER BY n) AS anchor FROM f)
SELECT s AS session_id, n AS turn_number, is_followup, sha256((SELECT string_agg(b.x, ' ' ORDER BY b.n) FROM a b WHERE b.s = a.s AND b.anchor = a.anchor AND b.n <= a.n)) AS standalone_sha FROM a""",
    "turn_idempotency": "WITH f AS (SELECT user_id AS session_id, 'r' || event_id % 40 AS client_request_id, min(event_id) AS a FROM events GROUP BY 1, 2) SELECT session_id, client_request_id, row_number() OVER (PARTITION BY session_id ORDER BY a) AS turn_number, count(*) OVER (PARTITION BY session_id) AS turn_count FROM f",
    "turn_lifecycle": """WITH t AS (SELECT conv_id AS s, turn AS n, CASE (conv_id * 7 + turn * 3) % 11 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' WHEN 2 THEN 'odd' ELSE 'completed' END AS st, (conv_id * 7 + turn * 3) % 5 <> 0 AS co, (conv_id * 7 + turn * 3) % 13 < 3 AS er FROM conversations),
u AS (SELECT *, coalesce(max(CAST(st = 'running' AS INTEGER)) OVER (PARTITION BY s ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS prev FROM t),
i AS (SELECT s, n, unnest([CASE WHEN st = 'odd' THEN 'unknown_status' END, CASE WHEN st IN ('completed', 'failed') AND NOT co THEN 'missing_completion' END, CASE WHEN st = 'running' AND co THEN 'early_completion' END, CASE WHEN st = 'failed' AND NOT er THEN 'missing_error' END, CASE WHEN st <> 'failed' AND er THEN 'unexpected_error' END, CASE WHEN prev THEN 'previous_turn_active' END]) AS issue FROM u)
SELECT s AS session_id, n AS turn_number, issue FROM i WHERE issue IS NOT NULL""",
    "turn_citations": "SELECT conv_id * 10 + turn AS chunk_id, conv_id, turn, CASE WHEN d.doc_id IS NULL OR d.doc_id % 6 = 1 THEN 'deleted' WHEN (conv_id * 10 + turn) % 4 = 0 THEN 'changed' ELSE 'current' END AS source_status FROM conversations LEFT JOIN documents d ON d.doc_id = conv_id * 10 + turn",
}
