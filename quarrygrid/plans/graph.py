"""Registered queries: graphs. Links are derived from the documents' lines; edges also from the foreign keys of the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrygrid.common import table
from quarrygrid.operators import graph as g
from quarrygrid.plans import base
from quarrygrid.plans.structure import sql_fences


def _linked(spark, sf):
    """Documents whose lines carry links, by the line's number."""

    def line(x, i):
        n = F.regexp_replace(F.split(x, " ")[0], r"[^A-Za-z0-9]", "")
        return F.when(i % 27 == 15, "~~~").when(i % 45 == 24, F.lit("  ````")).when(i % 9 == 6, "```").when(i % 5 == 0, F.concat(x, F.lit(" [["), n, F.lit("#Top|see]] #tag"))).when(i % 5 == 1, F.concat(F.lit("![["), n, F.lit("]] "), x)).when(i % 5 == 2, F.concat(F.lit("[a](http://h/"), n, F.lit(") [b]("), n, F.lit(".md) "), x)).otherwise(x)

    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


def extract_links(spark, sf):
    return g.extract_links(_linked(spark, sf)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "kind", "raw", "target", "heading", "alias", "valid")


def extract_hrefs(spark, sf):
    return g.extract_hrefs(table(spark, sf, "pages")).select("page_id", F.col("ordinal").cast("long").alias("ordinal"), "href")


def _index(spark, sf):
    first = F.regexp_replace(F.split("text", " ")[0], r"[^A-Za-z0-9]", "")
    return g.name_index(table(spark, sf, "documents").select("doc_id", F.array(F.concat(F.lit("Doc"), F.col("doc_id").cast("string")), first).alias("keys")))


def name_index(spark, sf):
    return _index(spark, sf)


def resolve_links(spark, sf):
    links = g.extract_links(_linked(spark, sf)).where("kind <> 'tag'").select(F.sha2(F.concat_ws("|", "doc_id", "line_no", "kind", "raw"), 256).alias("link_id"), "target", "valid").dropDuplicates(["link_id"])
    return g.resolve_links(links, _index(spark, sf))


def _edges(spark, sf):
    nation, cust, sup = (table(spark, sf, t) for t in ("nation", "customer", "supplier"))
    return g.build_edges({
        "CONTAINS": nation.select(F.col("n_regionkey").alias("source_id"), (F.col("n_nationkey") + 100).alias("target_id")),
        "LINKS_TO": cust.where("c_custkey % 3 <> 0").select((F.col("c_nationkey") + 100).cast("long").alias("source_id"), (F.col("c_custkey") + 1000).cast("long").alias("target_id")),
        "RELATED_TO": sup.where("s_suppkey % 2 = 0").select((F.col("s_suppkey") + 10000000).cast("long").alias("source_id"), (F.col("s_suppkey") * 7 % 50 + 1000).cast("long").alias("target_id")),
        "ALIASES": cust.where("c_custkey % 40 = 1").select((F.col("c_custkey") + 1000).cast("long").alias("source_id"), (F.col("c_custkey") * 3 % 900 + 1000).cast("long").alias("target_id")),
    })


def _nodes(spark, sf):
    return table(spark, sf, "customer").select((F.col("c_custkey") + 1000).cast("long").alias("id")).unionByName(table(spark, sf, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"))).unionByName(table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id")))


def build_edges(spark, sf):
    return _edges(spark, sf)


def graph_hygiene(spark, sf):
    return g.graph_hygiene(_nodes(spark, sf), _edges(spark, sf))


def connected_components(spark, sf):
    return g.connected_components(_nodes(spark, sf), _edges(spark, sf).where("edge_type <> 'CONTAINS'"))


def _seeds(spark, sf):
    return base.search_queries(spark, sf).select("query_id", F.posexplode(F.array(F.col("query_id") % 25 + 100, F.col("query_id") * 7 % 25 + 100, F.col("query_id") % 5)).alias("r", "node_id")).select("query_id", "node_id", (F.col("r") + 1).alias("rank"))


def graph_expand(spark, sf):
    units = _nodes(spark, sf).select(F.col("id").alias("node_id"), F.explode(F.array(F.col("id") * 10, F.col("id") * 10 + 1)).alias("chunk_id"))
    out = g.graph_expand(_seeds(spark, sf), _edges(spark, sf), units, ["CONTAINS", "LINKS_TO", "ALIASES"])
    return out.select("query_id", "chunk_id", "seed_id", "edge_type", "target_id", F.col("rank").cast("long").alias("rank"))


def graph_paths(spark, sf):
    out = g.graph_paths(_seeds(spark, sf).select("query_id", "node_id"), _edges(spark, sf))
    return out.select("query_id", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("nodes"), F.array_join("types", ">").alias("types"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def path_score(spark, sf):
    o = table(spark, sf, "orders")
    names = F.array(*[F.lit(t) for t in g.EDGE_TYPES], F.lit("OTHER"))
    types = F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 3 + 1).cast("int")), lambda i: F.element_at(names, ((F.col("o_orderkey") * i) % 8 + 1).cast("int")))
    return o.select("o_orderkey", g.path_score(types).alias("score"))


def graph_distance(spark, sf):
    pairs = base.search_queries(spark, sf).select((F.col("query_id") % 25 + 100).alias("a"), F.explode(F.array(F.col("query_id") * 3 % 25 + 100, F.col("query_id") % 30 + 1000)).alias("b"))
    return g.graph_distance(pairs, _edges(spark, sf), 3)


def graph_router(spark, sf):
    return g.graph_router(base.search_queries(spark, sf), _seeds(spark, sf), _edges(spark, sf), ("ment", "tion"), ("and the", "of the"))


def edge_provenance(spark, sf):
    o = F.col("o_orderkey")
    e = table(spark, sf, "orders").select(o.alias("edge_id"), (o % 1100).alias("source_id"), (o % 900).alias("target_id"), F.when(o % 7 != 0, o % 1050).alias("evidence_id"), F.when(o % 3 == 0, F.concat(F.lit("d"), (o % 2).cast("string"))).alias("evidence_digest"))
    c = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), (F.col("doc_id") % 2).cast("string")).alias("digest"))
    return g.edge_provenance(e, c)


def dangling_refs(spark, sf):
    d = table(spark, sf, "documents")
    target = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("img"), F.col("doc_id").cast("string"), F.lit(".png"))).when(F.col("doc_id") % 6 == 1, "todo later").when(F.col("doc_id") % 6 == 2, "http://x/y").otherwise(F.concat(F.lit("note "), (F.col("doc_id") % 150).cast("string")))
    edges = d.where("doc_id % 7 = 0").select(F.col("doc_id").alias("source_id"), (F.col("doc_id") + 1).alias("target_id"))
    return g.dangling_refs(d.select("doc_id", target.alias("target")), edges)


QUERIES = {f.__name__: f for f in (extract_links, extract_hrefs, name_index, resolve_links, build_edges, graph_hygiene, connected_components, graph_expand, graph_paths, path_score, graph_distance, graph_router, edge_provenance, dangling_refs)}

_N = "regexp_replace(split_part(x, ' ', 1), '[^A-Za-z0-9]', '', 'g')"
_LINKS = f"""rw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
ll AS (SELECT doc_id, i + 1 AS line_no, CASE WHEN i % 27 = 15 THEN '~~~' WHEN i % 45 = 24 THEN '  ````' WHEN i % 9 = 6 THEN '```' WHEN i % 5 = 0 THEN x || ' [[' || {_N} || '#Top|see]] #tag' WHEN i % 5 = 1 THEN '![[' || {_N} || ']] ' || x WHEN i % 5 = 2 THEN '[a](http://h/' || {_N} || ') [b](' || {_N} || '.md) ' || x ELSE x END AS line FROM rw),
li AS (SELECT doc_id, line_no AS n, line FROM ll), {sql_fences("li")}, lg AS (SELECT doc_id, n AS line_no, line, fenced FROM ff),
lx AS (SELECT doc_id, line_no, fenced, 'w' AS k, unnest(regexp_extract_all(line, '{g.WIKI}')) AS raw FROM lg UNION ALL SELECT doc_id, line_no, fenced, 'markdown', unnest(regexp_extract_all(line, '{g.MARKDOWN}')) FROM lg UNION ALL SELECT doc_id, line_no, fenced, 'tag', trim(unnest(regexp_extract_all(line, '{g.TAG}'))) FROM lg),
ly AS (SELECT doc_id, line_no, fenced, CASE WHEN k = 'w' THEN CASE WHEN raw[1] = '!' THEN 'embed' ELSE 'wiki' END ELSE k END AS kind, raw, CASE k WHEN 'w' THEN regexp_replace(raw, '^!?\\[\\[|\\]\\]$', '', 'g') WHEN 'markdown' THEN regexp_extract(raw, '\\(([^()]+)\\)$', 1) ELSE substr(raw, 2) END AS inn FROM lx),
lz AS (SELECT *, CASE WHEN kind IN ('wiki', 'embed') THEN split_part(inn, '|', 1) ELSE inn END AS place FROM ly),
links AS (SELECT doc_id, line_no, kind, raw, CASE WHEN kind = 'tag' THEN place ELSE split_part(place, '#', 1) END AS target, CASE WHEN kind <> 'tag' AND contains(place, '#') THEN substr(place, position('#' IN place) + 1) END AS heading, CASE WHEN kind IN ('wiki', 'embed') AND contains(inn, '|') THEN split_part(inn, '|', -1) END AS alias, NOT fenced AS valid FROM lz)"""
_IDX = "ik AS (SELECT doc_id, lower(trim(unnest(['Doc' || doc_id, regexp_replace(split_part(text, ' ', 1), '[^A-Za-z0-9]', '', 'g')]))) AS key FROM documents), idx AS (SELECT key, min(doc_id) AS doc_id, count(DISTINCT doc_id) AS n_documents, count(DISTINCT doc_id) > 1 AS ambiguous FROM ik WHERE key <> '' GROUP BY 1)"
_E = """ed AS (SELECT DISTINCT * FROM (SELECT CAST(n_regionkey AS BIGINT) AS source_id, 'CONTAINS' AS edge_type, CAST(n_nationkey + 100 AS BIGINT) AS target_id, 'G0' AS authority FROM nation
UNION ALL SELECT c_nationkey + 100, 'LINKS_TO', c_custkey + 1000, 'G1' FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT s_suppkey + 10000000, 'RELATED_TO', s_suppkey * 7 % 50 + 1000, 'G2' FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT c_custkey + 1000, 'ALIASES', c_custkey * 3 % 900 + 1000, 'G1' FROM customer WHERE c_custkey % 40 = 1)),
nd AS (SELECT c_custkey + 1000 AS id FROM customer UNION ALL SELECT n_nationkey + 100 FROM nation UNION ALL SELECT r_regionkey FROM region)"""
_SEED = "sd AS (SELECT item_id AS query_id, unnest([item_id % 25 + 100, item_id * 7 % 25 + 100, item_id % 5]) AS node_id, unnest([1, 2, 3]) AS rank FROM benchmark)"
_W = "CASE {0} " + " ".join(f"WHEN '{t}' THEN {w}" for t, (_, w) in g.EDGE_TYPES.items()) + " ELSE 0.5 END"
ORACLE_SQL = {
    "extract_links": f"WITH RECURSIVE {_LINKS} SELECT * FROM links",
    "extract_hrefs": """WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), 1) - 1 AS ordinal FROM pages) SELECT page_id, ordinal, href FROM h""",
    "name_index": f"WITH {_IDX} SELECT * FROM idx",
    "resolve_links": f"""WITH RECURSIVE {_LINKS}, {_IDX}, l AS (SELECT DISTINCT sha256(doc_id || '|' || line_no || '|' || kind || '|' || raw) AS link_id, target, valid FROM links WHERE kind <> 'tag'),
k AS (SELECT link_id, unnest([lower(target), regexp_replace(lower(target), '\\.md$', ''), regexp_extract(lower(target), '([^/]+?)(?:\\.md)?$', 1)]) AS key, unnest([0, 1, 2]) AS o FROM l), h AS (SELECT link_id, min_by(doc_id, o) AS hit, min_by(ambiguous, o) AS ambiguous FROM k JOIN idx USING (key) GROUP BY 1),
s AS (SELECT l.link_id, hit, CASE WHEN NOT valid THEN 'invalid' WHEN regexp_matches(target, '^[a-z]+://|^mailto:') THEN 'external' WHEN coalesce(target, '') = '' THEN 'invalid' WHEN hit IS NULL THEN 'unresolved' WHEN ambiguous THEN 'ambiguous' ELSE 'resolved' END AS status FROM l LEFT JOIN h USING (link_id))
SELECT link_id, status, CASE WHEN status = 'resolved' THEN hit END AS target_id FROM s""",
    "build_edges": f"WITH {_E} SELECT * FROM ed",
    "graph_hygiene": f"""WITH {_E}, en AS (SELECT source_id AS id, target_id AS o FROM ed UNION ALL SELECT target_id, source_id FROM ed), dg AS (SELECT id, count(DISTINCT o) AS d FROM en GROUP BY 1)
SELECT 'orphans' AS measure, count(*) AS n FROM nd WHERE id NOT IN (SELECT id FROM dg) UNION ALL SELECT 'self_links', count(*) FROM ed WHERE source_id = target_id UNION ALL SELECT 'broken_links', count(*) FROM ed WHERE target_id NOT IN (SELECT id FROM nd)
UNION ALL SELECT 'repeated_targets', count(*) FROM (SELECT source_id, target_id FROM ed GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'high_degree', count(*) FROM dg WHERE d >= 10 UNION ALL SELECT 'edges:' || edge_type, count(*) FROM ed GROUP BY edge_type""",
    "connected_components": f"""WITH RECURSIVE {_E}, ee AS (SELECT source_id AS a, target_id AS b FROM ed WHERE edge_type <> 'CONTAINS' UNION SELECT target_id, source_id FROM ed WHERE edge_type <> 'CONTAINS'), st AS (SELECT DISTINCT a AS root, a AS node FROM ee WHERE a < 1000 OR a >= 10000000 OR a % 40 = 1 UNION SELECT root, b FROM st JOIN ee ON a = node),
rc AS (SELECT node, min(root) AS m, list(DISTINCT root) AS rs FROM st GROUP BY 1), lo AS (SELECT r.root, min(s.node) AS low FROM (SELECT DISTINCT root FROM st) r JOIN st s USING (root) GROUP BY 1), cp AS (SELECT node, min(low) AS component FROM st JOIN lo USING (root) GROUP BY 1),
al AS (SELECT id, coalesce(component, id) AS component FROM nd LEFT JOIN cp ON node = id), sz AS (SELECT component, count(*) AS size FROM al GROUP BY 1)
SELECT id, component, size, (SELECT count(*) FROM sz x WHERE x.size > sz.size) + 1 AS size_rank FROM al JOIN sz USING (component)""",
    "graph_expand": f"""WITH {_E}, {_SEED}, h AS (SELECT s.query_id, e.source_id, s.rank, e.edge_type, e.target_id FROM sd s JOIN ed e ON e.source_id = s.node_id WHERE e.edge_type IN ('CONTAINS', 'LINKS_TO', 'ALIASES') AND NOT EXISTS (SELECT 1 FROM sd t WHERE t.query_id = s.query_id AND t.node_id = e.target_id)),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, target_id ORDER BY rank, edge_type, source_id) AS k FROM h) WHERE k = 1), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY edge_type, target_id) AS nr FROM o) WHERE nr <= 20),
u AS (SELECT n.*, n.target_id * 10 + j AS chunk_id FROM n JOIN nd ON nd.id = n.target_id JOIN (SELECT unnest([0, 1]) AS j) ON true), r AS (SELECT query_id, chunk_id, source_id AS seed_id, edge_type, target_id, row_number() OVER (PARTITION BY query_id ORDER BY nr, chunk_id) AS rank FROM u) SELECT * FROM r WHERE rank <= 5""",
    "graph_paths": f"""WITH {_E}, {_SEED}, nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY edge_type, target_id) AS k FROM ed) WHERE k <= 3), a AS (SELECT DISTINCT s.query_id, [n.source_id, n.target_id] AS nodes, [n.edge_type] AS types, n.target_id AS at FROM sd s JOIN nr n ON n.source_id = s.node_id WHERE n.source_id <> n.target_id),
b AS (SELECT query_id, nodes, types FROM a UNION ALL SELECT a.query_id, list_append(nodes, n.target_id), list_append(types, n.edge_type) FROM a JOIN nr n ON n.source_id = a.at WHERE NOT list_contains(nodes, n.target_id)),
s AS (SELECT *, round(list_sum([{_W.format("t")} FOR t IN types]) / len(types) / len(types), 6) AS score FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, nodes, types) AS rank FROM s)
SELECT query_id, array_to_string(nodes, '>') AS nodes, array_to_string(types, '>') AS types, score, rank FROM r WHERE rank <= 8""",
    "path_score": f"""WITH t AS (SELECT o_orderkey, [[{", ".join(f"'{t}'" for t in g.EDGE_TYPES)}, 'OTHER'][o_orderkey * i % 8 + 1] FOR i IN range(1, o_orderkey % 3 + 2)] AS types FROM orders) SELECT o_orderkey, round(list_sum([{_W.format("t")} FOR t IN types]) / len(types) / len(types), 6) AS score FROM t""",
    "graph_distance": f"""WITH {_E}, p AS (SELECT DISTINCT item_id % 25 + 100 AS a, unnest([item_id * 3 % 25 + 100, item_id % 30 + 1000]) AS b FROM benchmark), bo AS (SELECT source_id AS x, target_id AS y FROM ed UNION SELECT target_id, source_id FROM ed), s AS (SELECT DISTINCT a FROM p),
h1 AS (SELECT DISTINCT a, y AS n FROM s JOIN bo ON x = a), h2 AS (SELECT DISTINCT a, y AS n FROM h1 JOIN bo ON x = n), h3 AS (SELECT DISTINCT a, y AS n FROM h2 JOIN bo ON x = n), d AS (SELECT a, a AS n, 0 AS h FROM s UNION ALL SELECT a, n, 1 FROM h1 UNION ALL SELECT a, n, 2 FROM h2 UNION ALL SELECT a, n, 3 FROM h3), m AS (SELECT a, n, min(h) AS h FROM d GROUP BY 1, 2)
SELECT p.a, p.b, m.h AS hops FROM p LEFT JOIN m ON m.a = p.a AND m.n = p.b""",
    "graph_router": f"""WITH {_E}, {_SEED}, oe AS (SELECT DISTINCT s.query_id, e.source_id, e.target_id, EXISTS (SELECT 1 FROM sd t WHERE t.query_id = s.query_id AND t.node_id = e.target_id) AS own FROM sd s JOIN ed e ON e.source_id = s.node_id),
q AS (SELECT item_id AS query_id, CAST(contains(lower(text), 'ment') AS INTEGER) + CAST(contains(lower(text), 'tion') AS INTEGER) AS n_relation, CAST(contains(lower(text), 'and the') AS INTEGER) + CAST(contains(lower(text), 'of the') AS INTEGER) AS n_phrase, CAST(len(regexp_extract_all(text, '[A-Z][a-z]+')) AS INTEGER) AS n_entities,
  item_id IN (SELECT query_id FROM oe WHERE own AND source_id <> target_id) AS connected, item_id IN (SELECT query_id FROM oe WHERE NOT own) AS expandable FROM benchmark),
r AS (SELECT *, CASE WHEN NOT expandable THEN 'nothing_to_expand' WHEN n_relation > 0 THEN 'relation_term' WHEN n_phrase > 0 THEN 'structure_phrase' WHEN n_entities >= 2 AND connected THEN 'connected_entities' ELSE 'no_signal' END AS reason FROM q) SELECT *, reason IN ('relation_term', 'structure_phrase', 'connected_entities') AS activate FROM r""",
    "edge_provenance": """WITH e AS (SELECT o_orderkey AS edge_id, o_orderkey % 1100 AS s, o_orderkey % 900 AS t, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 1050 END AS v, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 END AS d FROM orders), x AS (SELECT e.*, a.doc_id AS hs, b.doc_id AS ht, c.doc_id AS hv FROM e LEFT JOIN documents a ON a.doc_id = s LEFT JOIN documents b ON b.doc_id = t LEFT JOIN documents c ON c.doc_id = v)
SELECT edge_id, CASE WHEN v IS NULL THEN 'none' WHEN d IS NULL THEN 'document' ELSE 'content' END AS provenance, CASE WHEN hs IS NULL OR ht IS NULL THEN 'dangling' WHEN v IS NULL THEN 'unassessable' WHEN hv IS NULL THEN 'evidence_missing' WHEN d IS NOT NULL AND d <> v % 2 THEN 'evidence_changed' ELSE 'consistent' END AS consistency FROM x""",
    "dangling_refs": """WITH l AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'img' || doc_id || '.png' WHEN 1 THEN 'todo later' WHEN 2 THEN 'http://x/y' ELSE 'note ' || doc_id % 150 END AS target, CASE doc_id % 6 WHEN 0 THEN 'attachment' WHEN 1 THEN 'placeholder' WHEN 2 THEN 'external' ELSE 'missing' END AS kind, doc_id % 7 = 0 OR (doc_id % 7 = 1) AS linked FROM documents),
g AS (SELECT target, kind, count(*) AS n, count(*) FILTER (WHERE linked) AS k FROM l GROUP BY 1, 2)
SELECT target, kind, CASE WHEN kind = 'missing' THEN CASE WHEN n > 1 THEN 'high' ELSE 'medium' END ELSE 'low' END AS severity, n AS n_links, CASE WHEN kind <> 'missing' THEN 'none' WHEN k > 1 THEN 'joins_components' WHEN k = 1 THEN 'extends_component' WHEN n > 1 THEN 'new_chain' ELSE 'new_edge' END AS effect FROM g""",
}
