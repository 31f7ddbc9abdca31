"""Registered queries: lexical index and BM25."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrygrid.common import materialize, table
from quarrygrid.operators import lexical as lx
from quarrygrid.operators import segmentation as sg
from quarrygrid.plans import base


def _kb_chunks(spark, sf):
    return base.chunks(spark, sf).withColumn("kb_id", F.col("lang"))


def tokenize_text(spark, sf):
    found = lx.tokenize_text(table(spark, sf, "documents"))
    return found.select("doc_id", F.size("tokens").alias("n_tokens"), F.sha2(F.array_join(F.array_sort("tokens"), " "), 256).alias("tokens_sha"))


def term_frequencies(spark, sf):
    return lx.term_frequencies(_kb_chunks(spark, sf)).select("kb_id", "chunk_id", "term", "tf")


def document_frequencies(spark, sf):
    return lx.document_frequencies(lx.term_frequencies(_kb_chunks(spark, sf)))


def corpus_statistics(spark, sf):
    stats = lx.corpus_statistics(lx.chunk_lengths(_kb_chunks(spark, sf)))
    return stats.withColumn("avg_length", F.round("avg_length", 6))


def lexical_delta(spark, sf):
    """The index without documents of id % 10 = 0, then those added and those of id % 7 = 1 removed."""
    every = materialize(lx.term_frequencies(_kb_chunks(spark, sf)), "lexical-postings")
    old = every.where("chunk_id % 10 <> 0")
    corpus = lx.corpus_statistics(lx.chunk_statistics(old))
    df, _ = lx.lexical_delta(lx.document_frequencies(old), corpus, every.where("chunk_id % 10 = 0"), old.where("chunk_id % 7 = 1"))
    return df


def cohesive_words(spark, sf):
    """Sequences of letters that hold together in the whole corpus."""
    return sg.cohesive_words(table(spark, sf, "documents"), longest=3, least=5, runs=sg.RUN)


def segment_text(spark, sf):
    """Every document without its blanks, cut into words that are counted in the corpus with them."""
    d = table(spark, sf, "documents")
    words = materialize(sg.spaced_words(d), "segment-lexicon")
    found = sg.segment_text(d.select("doc_id", F.regexp_replace("text", r"\s+", "").alias("text")), words)
    return found.select("doc_id", F.size("words").alias("n_words"), F.sha2(F.array_join("words", " "), 256).alias("words_sha"))


def bm25_topk(spark, sf):
    return base.bm25(spark, sf, 10).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "n_matched", F.array_join("matched_terms", " ").alias("matched"))


def term_set_scores(spark, sf):
    return base.overlap(spark, sf, 10).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "score")


QUERIES = {f.__name__: f for f in (tokenize_text, term_frequencies, document_frequencies, corpus_statistics, lexical_delta, cohesive_words, segment_text, bm25_topk, term_set_scores)}

_KB = f"t AS (SELECT lang AS kb_id, doc_id AS chunk_id, unnest({base.sql_tokens('text')}) AS term FROM documents), p AS (SELECT kb_id, chunk_id, term, count(*) AS tf FROM t GROUP BY 1, 2, 3)"
ORACLE_SQL = {
    "tokenize_text": f"SELECT doc_id, CAST(len(k) AS INTEGER) AS n_tokens, sha256(array_to_string(list_sort(k), ' ')) AS tokens_sha FROM (SELECT doc_id, {base.sql_tokens('text')} AS k FROM documents)",
    "term_frequencies": f"WITH {_KB} SELECT * FROM p",
    "document_frequencies": f"WITH {_KB} SELECT kb_id, term, count(*) AS df FROM p GROUP BY 1, 2",
    "corpus_statistics": f"WITH {_KB}, s AS (SELECT kb_id, chunk_id, sum(tf) AS n FROM p GROUP BY 1, 2) SELECT kb_id, count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS total_length, round(avg(n), 6) AS avg_length FROM s GROUP BY 1",
    "lexical_delta": f"WITH {_KB} SELECT kb_id, term, count(*) AS df FROM p WHERE NOT (chunk_id % 10 <> 0 AND chunk_id % 7 = 1) GROUP BY 1, 2",
    "cohesive_words": f"""WITH r AS (SELECT unnest(regexp_extract_all({base.sql_low("text")}, '\\p{{L}}+')) AS run FROM documents), rc AS (SELECT run, count(*) AS n FROM r GROUP BY 1),
p AS (SELECT substr(run, i, l) AS word, n FROM (SELECT run, n, unnest(range(1, length(run) + 1)) AS i FROM rc) JOIN (SELECT unnest([1, 2, 3]) AS l) ON i + l - 1 <= length(run)), c AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1), tot AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM c WHERE length(word) = 1),
k AS (SELECT c.word, c.n, min(c.n * t / (CAST(l.n AS DOUBLE) * r.n)) AS g FROM c JOIN (SELECT unnest([1, 2]) AS b) ON b < length(c.word) JOIN c l ON l.word = substr(c.word, 1, b) JOIN c r ON r.word = substr(c.word, b + 1) CROSS JOIN tot WHERE c.n >= 5 GROUP BY 1, 2)
SELECT word, n FROM c WHERE length(word) = 1 UNION ALL SELECT word, n FROM k WHERE g >= 8""",
    "bm25_topk": f"WITH {base.LEX} SELECT query_id, chunk_id, rank, round(score, 6) AS score, n_matched, matched FROM bm WHERE rank <= 10",
    "term_set_scores": f"WITH {base.LEX} SELECT query_id, chunk_id, rank, score FROM ov WHERE rank <= 10",
}
