"""Registered queries: structure and chunking, over Markdown derived from the documents' lines and over the pages' HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrygrid.common import table
from quarrygrid.operators import chunking as ck
from quarrygrid.operators import structure as st


def markdown(spark, sf):
    """Documents with headings, fences and blank lines put between their lines, by the line's number; whole lines are headings, too.

    Fences of both markers and of several lengths, some left open by a marker that doesn't fit.
    """

    def lines(x, i):
        fence = F.when(i % 130 == 70, "~~~").when(i % 39 == 18, "  ````").when(i % 39 == 21, "`````").when((i % 13 == 5) | (i % 13 == 8), "```").when(i % 26 == 6, "~~~")
        return F.when(fence.isNotNull(), F.array(fence, x)).when(i % 4 == 0, F.array(F.concat(F.repeat(F.lit("#"), 1 + i % 3), F.lit(" "), x, F.when(i % 8 == 0, " ##").otherwise("")))).when(i % 11 == 7, F.array(F.lit(""), x)).otherwise(F.array(x))

    return table(spark, sf, "documents").select("doc_id", F.array_join(F.flatten(F.transform(F.split("text", "\n"), lines)), "\n").alias("text"))


def _sections(spark, sf):
    return st.md_sections(markdown(spark, sf))


def md_sections(spark, sf):
    return _sections(spark, sf).select("doc_id", "section_no", F.array_join("heading_path", " > ").alias("path"), "level", "start_line", "end_line", F.sha2("content", 256).alias("content_sha"))


def _front(spark, sf):
    d = table(spark, sf, "documents")
    head = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("---\ntitle: t"), F.col("doc_id").cast("string"), F.lit("\n---\n"))).when(F.col("doc_id") % 5 == 1, "---\nopen: 1\n").when(F.col("doc_id") % 5 == 2, "---\n- a\n---\n").otherwise("")
    return st.md_frontmatter(d.select("doc_id", F.concat(head, "text").alias("text")))


def md_frontmatter(spark, sf):
    return _front(spark, sf)


def doc_title(spark, sf):
    return st.doc_title(_front(spark, sf), _sections(spark, sf))


def html_blocks(spark, sf):
    return st.html_blocks(table(spark, sf, "pages"))


def block_types(spark, sf):
    out = st.block_types(st.md_blocks(markdown(spark, sf)))
    return out.select("doc_id", "block_no", "block_type", F.array_join("block_labels", ",").alias("labels"))


def md_blocks(spark, sf):
    return st.md_blocks(markdown(spark, sf)).select("doc_id", "block_no", "start_line", "end_line", F.sha2("text", 256).alias("text_sha"))


def blocks_to_sections(spark, sf):
    b = st.md_blocks(markdown(spark, sf)).select("doc_id", (F.col("block_no") % 3).alias("section_id"), F.col("block_no").alias("ordinal"), "text", "start_line", "end_line")
    s = table(spark, sf, "documents").select("doc_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("section_id"))
    return st.blocks_to_sections(b, s).select("doc_id", "section_id", F.sha2("text", 256).alias("text_sha"), "start_line", "end_line")


def ir_integrity(spark, sf):
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    s = d.select("doc_id", F.posexplode(F.array(F.lit(-1), F.when(i % 7 == 0, 3).otherwise(0), F.when(i % 11 == 0, 9).otherwise(1), F.lit(1))).alias("section_id", "parent_id")).select("doc_id", F.when((i % 13 == 0) & (F.col("section_id") == 2), 1).otherwise(F.col("section_id")).alias("section_id"), F.when(F.col("parent_id") >= 0, F.col("parent_id")).alias("parent_id"))
    b = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select("doc_id", F.when((i % 17 == 0) & (F.col("k") == 2), 1).otherwise(F.col("k")).alias("block_id"), F.when((i % 19 == 0) & (F.col("k") == 0), 8).otherwise(F.col("k") % 2).alias("section_id"), F.when(i % 23 == 0, F.col("k") - 1).otherwise(F.col("k")).alias("ordinal"), (F.col("k") + 1).alias("start_line"), (F.col("k") + 1 - F.when(i % 29 == 0, 1).otherwise(0)).alias("end_line"))
    c = d.select("doc_id", F.lit(0).alias("table_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("row"), F.lit(0).alias("col"), F.when(i % 31 == 0, 2).otherwise(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit(2).alias("n_rows"), F.lit(1).alias("n_cols"))
    return st.ir_integrity(s, b, c)


def stable_ids(spark, sf):
    return st.stable_ids(table(spark, sf, "documents"), ["source", "lang", "doc_id"], "doc").select("doc_id", "stable_id")


def _lines(spark, sf):
    """The documents' lines as sections."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("section_no", "content"))
    h = F.col("section_no")
    return d.where("content <> ''").select("doc_id", "section_no", F.array(F.concat(F.lit("a"), F.floor(h / 6).cast("string")), F.concat(F.lit("b"), F.floor(h / 2).cast("string")), F.concat(F.lit("c"), h.cast("string"))).alias("heading_path"), "content", (h + 1).alias("start_line"), (h + 1).alias("end_line"))


def chunk_sections(spark, sf):
    return ck.chunk_sections(_lines(spark, sf)).select("doc_id", "chunk_index", "content_hash", "start_line", "end_line")


def split_oversized(spark, sf):
    return ck.split_oversized(_lines(spark, sf), 400).select("doc_id", "section_no", "piece_no", F.length("content").alias("n_chars"))


def chunk_blocks(spark, sf):
    b = st.block_types(st.md_blocks(markdown(spark, sf))).select("doc_id", F.col("block_no").alias("block_id"), F.col("block_no").alias("ordinal"), F.floor(F.col("block_no") / 3).cast("long").alias("section_id"), "block_type", "text", F.floor(F.col("block_no") / 5).cast("long").alias("page"))
    return ck.chunk_blocks(b, 600, 900)


def heading_enrich(spark, sf):
    return ck.heading_enrich(_lines(spark, sf), 6).select("doc_id", "section_no", F.sha2("inline_text", 256).alias("inline_sha"), "context")


def chunk_variants(spark, sf):
    return ck.chunk_variants(_lines(spark, sf)).select("variant", "doc_id", "chunk_index", "start_line", "end_line", F.length("content").alias("n_chars"))


def _chunks(spark, sf):
    return _lines(spark, sf).select((F.col("doc_id") * 100000 + F.col("section_no")).alias("chunk_id"), "doc_id", F.col("section_no").alias("chunk_index"), F.slice("heading_path", 1, 2).alias("heading_path"), "content", "start_line", "end_line")


def chunk_overlap(spark, sf):
    return ck.chunk_overlap(_chunks(spark, sf), 50).select("doc_id", "chunk_index", "overlap", "start_line", "end_line", F.sha2("content", 256).alias("content_sha"))


def parent_records(spark, sf):
    return ck.parent_records(_chunks(spark, sf).withColumn("heading_path", F.slice("heading_path", 1, 1)), 500).select("doc_id", F.array_join("parent_path", " > ").alias("parent_path"), F.array_join(F.transform("child_ids", lambda x: x.cast("string")), ",").alias("child_ids"), "n_children", "text_sha", "n_chars")


def hierarchy_index(spark, sf):
    return ck.hierarchy_index(_chunks(spark, sf))


def chunk_inventory(spark, sf):
    rows = _lines(spark, sf).select(F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("variant"), "doc_id", "content")
    out = ck.chunk_inventory(rows)
    return out.select("variant", "n_chunks", F.round("mean_length", 6).alias("mean_length"), "p50_length", "p95_length", "max_length", F.round("repeated_share", 6).alias("repeated_share"), "n_documents", F.round("mean_per_document", 6).alias("mean_per_document"), "max_per_document", F.round("single_share", 6).alias("single_share"))


QUERIES = {f.__name__: f for f in (
    md_sections, md_frontmatter, doc_title, html_blocks, block_types, md_blocks, blocks_to_sections, ir_integrity, stable_ids, chunk_sections, split_oversized, chunk_blocks, heading_enrich, chunk_variants, chunk_overlap,
    parent_records, hierarchy_index, chunk_inventory,
)}

_RAW = "raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)"


def sql_fences(lines: str) -> str:
    """CTEs that end in ff(doc_id, n, line, m, inside, closes, fenced) of lines (doc_id, n, line): a walk over each document's fences alone."""
    closes = "s.mark <> '' AND f.m[1] = s.mark[1] AND length(f.m) >= length(s.mark)"
    return f"""fl AS (SELECT doc_id, n, line, regexp_extract(line, '{st.FENCE}', 1) AS m FROM {lines}), fk AS (SELECT doc_id, n, m, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM fl WHERE m <> ''),
fs AS (SELECT doc_id, n, k, m AS mark, false AS closes FROM fk WHERE k = 1 UNION ALL SELECT f.doc_id, f.n, f.k, CASE WHEN s.mark = '' THEN f.m WHEN {closes} THEN '' ELSE s.mark END, {closes} FROM fs s JOIN fk f ON f.doc_id = s.doc_id AND f.k = s.k + 1),
fi AS (SELECT l.*, coalesce(s.closes, false) AS closes, coalesce(last_value(s.mark IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') <> '' AS inside FROM fl l LEFT JOIN fs s ON s.doc_id = l.doc_id AND s.n = l.n),
ff AS (SELECT *, inside OR m <> '' AS fenced FROM fi)"""


_FENCE_LINE = "CASE WHEN i % 130 = 70 THEN '~~~' WHEN i % 39 = 18 THEN '  ````' WHEN i % 39 = 21 THEN '`````' WHEN i % 13 IN (5, 8) THEN '```' WHEN i % 26 = 6 THEN '~~~' END"
_MD = f"""{_RAW}, mx AS (SELECT doc_id, i, x, {_FENCE_LINE} AS f FROM raw),
my AS (SELECT doc_id, i, unnest(CASE WHEN f IS NOT NULL THEN [f, x] WHEN i % 4 = 0 THEN [repeat('#', CAST(1 + i % 3 AS INTEGER)) || ' ' || x || CASE WHEN i % 8 = 0 THEN ' ##' ELSE '' END] WHEN i % 11 = 7 THEN ['', x] ELSE [x] END) AS line, unnest(CASE WHEN f IS NOT NULL OR (i % 4 <> 0 AND i % 11 = 7) THEN [0, 1] ELSE [0] END) AS j FROM mx),
ml AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS n FROM my), {sql_fences("ml")}"""
_SEC = f"""{_MD}, hl AS (SELECT *, CASE WHEN NOT fenced AND regexp_matches(line, '{st.HEADING}') THEN length(regexp_extract(line, '{st.HEADING}', 1)) ELSE 0 END AS lv, trim(regexp_extract(line, '{st.HEADING}', 2)) AS title FROM ff),
sl AS (SELECT *, sum(CAST(lv > 0 AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY n) AS sn FROM hl), sg AS (SELECT doc_id, sn, max(lv) AS lv, min(n) AS s, max(n) AS e, regexp_replace(string_agg(line, chr(10) ORDER BY n), '^\n+|\n+$', '', 'g') AS content FROM sl GROUP BY 1, 2),
hp AS (SELECT g.doc_id, g.sn, h.n, h.lv, h.title, max(h.n) OVER (PARTITION BY g.doc_id, g.sn, h.lv) AS last FROM sg g JOIN sl h ON h.doc_id = g.doc_id AND h.lv > 0 AND h.n <= g.s),
hk AS (SELECT * FROM hp WHERE n = last), hv AS (SELECT a.* FROM hk a WHERE NOT EXISTS (SELECT 1 FROM hk b WHERE b.doc_id = a.doc_id AND b.sn = a.sn AND b.lv < a.lv AND b.n > a.n)),
pp AS (SELECT doc_id, sn, string_agg(title, ' > ' ORDER BY lv) AS path, max_by(title, lv) AS deepest FROM hv GROUP BY 1, 2),
sx AS (SELECT g.doc_id, g.sn AS section_no, coalesce(path, '') AS path, deepest, g.lv AS level, s AS start_line, e AS end_line, content FROM sg g LEFT JOIN pp USING (doc_id, sn) WHERE trim(regexp_replace(content, '\\s+', '', 'g')) <> '')"""
_BLK = f"""{_MD}, bl AS (SELECT *, NOT fenced AND trim(regexp_replace(line, '\\s+', '', 'g')) = '' AS blank FROM ff), bn AS (SELECT *, NOT blank AND coalesce(lag(blank OR closes) OVER (PARTITION BY doc_id ORDER BY n), true) AS new FROM bl),
bm AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY n) AS block_no FROM bn), blk AS (SELECT doc_id, block_no, min(n) AS start_line, max(n) AS end_line, regexp_replace(string_agg(line, chr(10) ORDER BY n), '^\n+|\n+$', '', 'g') AS text FROM bm WHERE NOT blank GROUP BY 1, 2)"""
_LN = f"{_RAW}, ln AS (SELECT doc_id, i, x AS content, 'a' || CAST(floor(i / 6) AS BIGINT) AS a, 'b' || CAST(floor(i / 2) AS BIGINT) AS b, 'c' || i AS c FROM raw WHERE x <> '')"
_glue = "regexp_replace(acc[-1], '\\s+$', '') || chr(10) || chr(10) || regexp_replace(x, '^\\s+|\\s+$', '', 'g')"
_fill = lambda xs: f"list_reduce({xs}[2:], lambda acc, x: CASE WHEN length({_glue}) > 1800 THEN list_concat(acc, [x]) ELSE list_concat(acc[1:len(acc) - 1], [{_glue}]) END, [regexp_replace({xs}[1], '^\\s+|\\s+$', '', 'g')])"
_any = lambda p: f"len([z FOR z IN string_split(text, chr(10)) IF regexp_matches(z, '{p}')]) > 0"
_FIRSTLINE = "split_part(trim(text), chr(10), 1)"
ORACLE_SQL = {
    "md_sections": f"WITH RECURSIVE {_SEC} SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, path, CAST(level AS INTEGER) AS level, start_line, end_line, sha256(content) AS content_sha FROM sx",
    "md_frontmatter": """SELECT doc_id, CASE WHEN k = 0 THEN '{"title": "t' || doc_id || '"}' END AS frontmatter_json, CAST(CASE WHEN k IN (0, 2) THEN 4 ELSE 1 END AS BIGINT) AS body_start, CASE k WHEN 1 THEN 'unclosed' WHEN 2 THEN 'not_a_mapping' END AS error
FROM (SELECT doc_id, CASE WHEN text IS NOT NULL THEN doc_id % 5 END AS k FROM documents)""",
    "doc_title": f"WITH RECURSIVE {_SEC}, f AS (SELECT doc_id, min_by(deepest, section_no) AS heading FROM sx WHERE path <> '' GROUP BY 1) SELECT d.doc_id, CASE WHEN d.doc_id % 5 = 0 THEN 't' || d.doc_id ELSE heading END AS title FROM documents d LEFT JOIN f USING (doc_id)",
    "block_types": f"""WITH RECURSIVE {_BLK} SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, CASE WHEN regexp_matches({_FIRSTLINE}, '^#{{1,6}} ') THEN 'heading' WHEN regexp_matches({_FIRSTLINE}, '^(```|~~~)') THEN 'code' WHEN regexp_matches({_FIRSTLINE}, '^([-*+]|[0-9]+[.)]) ') THEN 'list'
  WHEN {_any("^[^|]*[|][^|]*[|]")} THEN 'table' ELSE 'paragraph' END AS block_type,
  concat_ws(',', CASE WHEN {_any("^[ ]*([-*+]|[0-9]+[.)]) ")} THEN 'list' END, CASE WHEN {_any("^[^|]*[|][^|]*[|]")} THEN 'table' END, CASE WHEN {_any("^(```|~~~)")} THEN 'code' END, CASE WHEN {_any("^>")} THEN 'quote' END) AS labels FROM blk""",
    "md_blocks": f"WITH RECURSIVE {_BLK} SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, start_line, end_line, sha256(text) AS text_sha FROM blk",
    "blocks_to_sections": f"""WITH RECURSIVE {_BLK}, s AS (SELECT doc_id, CASE WHEN block_no % 3 < 2 THEN CAST(block_no % 3 AS BIGINT) END AS section_id, block_no, text, start_line, end_line FROM blk)
SELECT doc_id, section_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY block_no)) AS text_sha, min(start_line) AS start_line, max(end_line) AS end_line FROM s GROUP BY 1, 2""",
    "ir_integrity": """WITH d AS (SELECT doc_id, doc_id AS i FROM documents), s AS (SELECT doc_id, i, CASE WHEN i % 13 = 0 AND k = 2 THEN 1 ELSE k END AS sid, CASE k WHEN 1 THEN CASE WHEN i % 7 = 0 THEN 3 ELSE 0 END WHEN 2 THEN CASE WHEN i % 11 = 0 THEN 9 ELSE 1 END WHEN 3 THEN 1 END AS par FROM d JOIN (SELECT unnest([0, 1, 2, 3]) AS k) ON true),
b AS (SELECT doc_id, CASE WHEN i % 17 = 0 AND k = 2 THEN 1 ELSE k END AS bid, CASE WHEN i % 19 = 0 AND k = 0 THEN 8 ELSE k % 2 END AS sid, CASE WHEN i % 23 = 0 THEN k - 1 ELSE k END AS o, i % 29 = 0 AS bad FROM d JOIN (SELECT unnest([0, 1, 2]) AS k) ON true)
SELECT doc_id, 'duplicate_section' AS issue, CAST(sid AS VARCHAR) AS item_id FROM s GROUP BY doc_id, sid HAVING count(*) > 1
UNION ALL SELECT doc_id, 'duplicate_block', CAST(bid AS VARCHAR) FROM b GROUP BY doc_id, bid HAVING count(*) > 1
UNION ALL SELECT doc_id, 'missing_parent', CAST(sid AS VARCHAR) FROM s WHERE par IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s x WHERE x.doc_id = s.doc_id AND x.sid = s.par)
UNION ALL SELECT doc_id, 'missing_section', CAST(bid AS VARCHAR) FROM b WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.doc_id = b.doc_id AND x.sid = b.sid)
UNION ALL SELECT doc_id, 'negative_ordinal', CAST(bid AS VARCHAR) FROM b WHERE o < 0 UNION ALL SELECT doc_id, 'bad_span', CAST(bid AS VARCHAR) FROM b WHERE bad
UNION ALL SELECT doc_id, 'cell_out_of_range', '0' FROM d WHERE i % 31 = 0 UNION ALL SELECT doc_id, 'cell_overlap', '0' FROM d WHERE i % 31 = 0
UNION ALL SELECT doc_id, 'cycle', CAST(c AS VARCHAR) FROM (SELECT doc_id, i, unnest(CASE WHEN i % 7 = 0 THEN CASE WHEN i % 11 <> 0 AND i % 13 <> 0 THEN [1, 2, 3] ELSE [1, 3] END WHEN i % 13 = 0 AND i % 11 <> 0 THEN [1, 3] ELSE CAST([] AS INTEGER[]) END) AS c FROM d)""",
    "stable_ids": "SELECT doc_id, 'doc_' || left(sha256(concat_ws(chr(31), coalesce('doc_id=' || doc_id, 'doc_id!'), coalesce('lang=' || lang, 'lang!'), coalesce('source=' || source, 'source!'))), 32) AS stable_id FROM documents",
    "chunk_sections": f"""WITH RECURSIVE {_LN}, t AS (SELECT doc_id, i, content, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS body FROM ln),
sp AS (SELECT *, length(body) > 1800 AS long, [a FOR a IN string_split(regexp_replace(content, '([。！？.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) IF a <> ''] AS atoms FROM t WHERE body <> ''),
s1 AS (SELECT doc_id, i, CASE WHEN len(atoms) > 1 THEN {_fill("atoms")} ELSE [content] END AS packed FROM sp WHERE long),
s2 AS (SELECT doc_id, i, flatten([[substr(p, 1 + 1800 * j, 1800) FOR j IN range(0, CAST(ceil(length(p) / 1800) AS BIGINT))] FOR p IN packed]) AS cut FROM s1), s3 AS (SELECT doc_id, i, {_fill("cut")} AS done FROM s2),
it AS (SELECT doc_id, i, 0 AS j, body, false AS solo FROM sp WHERE NOT long UNION ALL SELECT doc_id, i, generate_subscripts(done, 1), unnest(done), true FROM s3),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k FROM it),
w AS (SELECT doc_id, k, CAST(0 AS BIGINT) AS chunk_index, length(body) AS size, NOT solo AND length(body) < 1200 AS open FROM q WHERE k = 1
  UNION ALL SELECT q.doc_id, q.k, CASE WHEN NOT solo AND w.open AND w.size + 2 + length(body) <= 1800 THEN w.chunk_index ELSE w.chunk_index + 1 END, CASE WHEN NOT solo AND w.open AND w.size + 2 + length(body) <= 1800 THEN w.size + 2 + length(body) ELSE length(body) END,
    CASE WHEN solo THEN false WHEN w.open AND w.size + 2 + length(body) <= 1800 THEN w.size + 2 + length(body) < 1200 WHEN w.open THEN true ELSE length(body) < 1200 END FROM w JOIN q ON q.doc_id = w.doc_id AND q.k = w.k + 1)
SELECT w.doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, sha256(regexp_replace(string_agg(body, chr(10) || chr(10) ORDER BY w.k), '^\\s+|\\s+$', '', 'g')) AS content_hash, CAST(CASE WHEN NOT any_value(solo) THEN min(i) + 1 END AS INTEGER) AS start_line, CAST(CASE WHEN NOT any_value(solo) THEN max(i) + 1 END AS INTEGER) AS end_line FROM w JOIN q ON q.doc_id = w.doc_id AND q.k = w.k GROUP BY 1, 2""",
    "heading_enrich": f"""WITH {_LN} SELECT doc_id, CAST(i AS INTEGER) AS section_no, sha256(a || ' > ' || b || ' > ' || c || chr(10) || chr(10) || content) AS inline_sha,
  CASE WHEN length(c) > 6 THEN '' WHEN length(c || ' > ' || b) <= 6 THEN CASE WHEN length(c || ' > ' || b || ' > ' || a) <= 6 THEN c || ' > ' || b || ' > ' || a ELSE c || ' > ' || b END WHEN length(c || ' > ' || a) <= 6 THEN c || ' > ' || a ELSE c END AS context FROM ln""",
    "chunk_overlap": f"""WITH {_LN}, p AS (SELECT *, lag(content) OVER w AS prev, lag(i) OVER w AS pi FROM ln WINDOW w AS (PARTITION BY doc_id, a, b ORDER BY i)), o AS (SELECT *, coalesce(CASE WHEN length(prev) <= 50 THEN prev ELSE regexp_replace(right(prev, 50), '^[^ \\n]*[ \\n]+', '') END, '') AS overlap FROM p)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, overlap, CAST(coalesce(least(pi + 1, i + 1), i + 1) AS INTEGER) AS start_line, CAST(i + 1 AS INTEGER) AS end_line, sha256(CASE WHEN overlap <> '' THEN overlap || chr(10) || content ELSE content END) AS content_sha FROM o""",
    "parent_records": f"""WITH {_LN} SELECT doc_id, a AS parent_path, string_agg(CAST(doc_id * 100000 + i AS VARCHAR), ',' ORDER BY i) AS child_ids, CAST(count(*) AS INTEGER) AS n_children, sha256(left(string_agg(content, chr(10) || chr(10) ORDER BY i), 500)) AS text_sha, CAST(length(left(string_agg(content, chr(10) || chr(10) ORDER BY i), 500)) AS INTEGER) AS n_chars FROM ln GROUP BY 1, 2""",
    "hierarchy_index": f"""WITH {_LN} SELECT DISTINCT doc_id, '' AS node, CAST(NULL AS VARCHAR) AS parent, 'document' AS kind, false AS orphan FROM ln UNION ALL SELECT DISTINCT doc_id, a, '', 'section', false FROM ln
UNION ALL SELECT DISTINCT doc_id, a || ' > ' || b, a, 'section', false FROM ln UNION ALL SELECT doc_id, '#' || i, a || ' > ' || b, 'chunk', false FROM ln""",
    "chunk_inventory": f"""WITH {_LN}, v AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS variant, doc_id, content, length(content) AS n FROM ln), p AS (SELECT variant, doc_id, count(*) AS k FROM v GROUP BY 1, 2),
g AS (SELECT variant, count(*) AS n_documents, round(avg(k), 6) AS mean_per_document, max(k) AS max_per_document, round(avg(CAST(k = 1 AS INTEGER)), 6) AS single_share FROM p GROUP BY 1)
SELECT variant, count(*) AS n_chunks, round(avg(n), 6) AS mean_length, CAST(quantile_disc(n, 0.5) AS INTEGER) AS p50_length, CAST(quantile_disc(n, 0.95) AS INTEGER) AS p95_length, CAST(max(n) AS INTEGER) AS max_length, round(1 - count(DISTINCT content) / count(*), 6) AS repeated_share, any_value(n_documents) AS n_documents, any_value(mean_per_document) AS mean_per_document, any_value(max_per_document) AS max_per_document, any_value(single_share) AS single_share FROM v JOIN g USING (variant) GROUP BY 1""",
}
