"""Inputs that the registered queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygrid.common import table
from quarrygrid.operators import lexical as lx

def sql_low(x: str) -> str:
    return f"translate(coalesce({x}, ''), '{lx.UPPER}', '{lx.LOWER}')"


def sql_tokens(x: str) -> str:
    joined = "[p FOR p IN string_split_regex(t, '[/.]+')[2:] IF regexp_matches(p, '[_-]')]"
    parts = f"[p FOR p IN string_split_regex(t, '{lx.SEPARATOR}+') IF p <> '']"
    shown = f"CASE WHEN regexp_matches(t, '{lx.SEPARATOR}') THEN list_concat([t], list_distinct(list_concat({joined}, {parts}))) ELSE [t] END"
    return f"flatten([{shown} FOR t IN regexp_extract_all({sql_low(x)}, '{lx.TECHNICAL}')])"


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks: one for each document."""
    return table(spark, sf, "documents").select(F.lit("kb").alias("kb_id"), F.col("doc_id").alias("chunk_id"), "doc_id", F.col("source").alias("path"), F.lit(None).cast("int").alias("start_line"), F.col("text").alias("content"), "lang", "n_chars")


def search_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("kb").alias("kb_id"), "text")


def bm25(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    return lx.bm25_topk(search_queries(spark, sf), chunks(spark, sf), k)


def overlap(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    q = search_queries(spark, sf)
    return lx.term_set_scores(q, lx.term_frequencies(chunks(spark, sf), terms=lx.query_terms(q)), k)


#: CTEs: bm(query_id, chunk_id, score, n_matched, rank) and ov(query_id, chunk_id, score, rank), 20 rows a query.
LEX = f"""
tok AS (SELECT doc_id AS chunk_id, unnest({sql_tokens("text")}) AS term FROM documents),
post AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
stat AS (SELECT chunk_id, sum(tf) AS len FROM post GROUP BY 1),
dfr AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
corp AS (SELECT count(*) AS n, avg(len) AS avg_len FROM stat),
qtok AS (SELECT item_id AS query_id, unnest({sql_tokens("text")}) AS term FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS qtf FROM qtok GROUP BY 1, 2),
hit AS (SELECT q.query_id, p.chunk_id, q.term, q.qtf, p.tf FROM qt q JOIN post p USING (term)),
bms AS (
  SELECT h.query_id, h.chunk_id, count(*) AS n_matched, string_agg(h.term, ' ' ORDER BY h.term) AS matched,
         round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 9) AS score
  FROM hit h JOIN dfr USING (term) JOIN stat USING (chunk_id) CROSS JOIN corp GROUP BY 1, 2
),
bmr AS (SELECT b.*, d.source AS path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, d.source, b.chunk_id) AS rank FROM bms b JOIN documents d ON d.doc_id = b.chunk_id),
bm AS (SELECT * FROM bmr WHERE rank <= 20),
ovs AS (SELECT query_id, chunk_id, CAST(sum(least(qtf, tf)) AS BIGINT) AS score FROM hit GROUP BY 1, 2),
ovr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ovs),
ov AS (SELECT * FROM ovr WHERE rank <= 20)
"""


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, chunk_id): documents that hold the benchmark text verbatim.

    The join is on the rarest 3-word window that both have (see ``containment_scan``), not items times documents.
    """
    from quarrygrid.operators.evaluation import containment_scan

    items = table(spark, sf, "benchmark").select("item_id", "text")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return containment_scan(items, docs).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("chunk_id"))


GOLD = "gold AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) >= 12)"


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector whose id is divisible by 20 is a query against all."""
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("query_label"))
