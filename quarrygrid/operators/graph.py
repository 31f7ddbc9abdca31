"""Link graphs: links and their resolution, edges, hygiene, components, bounded expansion, paths, routing and provenance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrygrid.common import topk
from quarrygrid.operators.graph_core import min_label_components
from quarrygrid.operators.structure import text_lines

#: Authority and weight of the edge types (fixed values).
EDGE_TYPES = {"CONTAINS": ("G0", 1.0), "LINKS_TO": ("G1", 0.9), "EMBEDS": ("G1", 0.9), "TAGGED_WITH": ("G1", 0.9), "ALIASES": ("G1", 0.9), "RELATED_TO": ("G2", 0.8), "MENTIONS": ("G2", 0.8)}
WIKI, MARKDOWN, TAG = r"!?\[\[[^\[\]\n]+\]\]", r"\[[^\[\]\n]*\]\([^()\n ]+\)", r"(?:^|[ \t])#[A-Za-z][A-Za-z0-9_/-]*"


def extract_links(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind, raw, target, heading, alias, valid): wiki links, embeds, Markdown links and tags; those in code are not valid."""
    lines = text_lines(docs)

    def found(pattern: str, kind: Column) -> Column:
        return F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(0)), lambda r: F.struct(r.alias("raw"), kind.alias("kind") if not callable(kind) else kind(r).alias("kind")))

    every = F.concat(found(WIKI, lambda r: F.when(F.startswith(r, F.lit("!")), "embed").otherwise("wiki")), found(MARKDOWN, F.lit("markdown")), found(TAG, F.lit("tag")))
    rows = lines.select("doc_id", "line_no", "fenced", F.explode(every).alias("l")).select("doc_id", "line_no", "fenced", "l.kind", F.trim("l.raw").alias("raw"))
    wiki = F.col("kind").isin("wiki", "embed")
    inner = F.when(wiki, F.regexp_replace("raw", r"^!?\[\[|\]\]$", "")).when(F.col("kind") == "markdown", F.regexp_extract("raw", r"\(([^()]+)\)$", 1)).otherwise(F.expr("substring(raw, 2)"))
    rows = rows.withColumn("inner", inner)
    place = F.when(wiki, F.substring_index("inner", "|", 1)).otherwise(F.col("inner"))
    rows = rows.withColumn("place", place)
    return rows.select(
        "doc_id", "line_no", "kind", "raw", F.when(F.col("kind") == "tag", F.col("place")).otherwise(F.substring_index("place", "#", 1)).alias("target"),
        F.when((F.col("kind") != "tag") & F.contains("place", F.lit("#")), F.expr("substring(place, instr(place, '#') + 1)")).alias("heading"), F.when(wiki & F.contains("inner", F.lit("|")), F.substring_index("inner", "|", -1)).alias("alias"), (~F.col("fenced")).alias("valid"),
    )


def extract_hrefs(pages: DataFrame) -> DataFrame:
    """(page_id, ordinal, href) of the pages' anchors."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))).alias("ordinal", "href"))


def name_index(names: DataFrame) -> DataFrame:
    """(key, doc_id, n_documents, ambiguous) from (doc_id, keys array): lower-cased keys; an ambiguous key shows its smallest document."""
    rows = names.select("doc_id", F.explode(F.transform("keys", lambda k: F.lower(F.trim(k)))).alias("key")).where("key <> ''")
    return rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count_distinct("doc_id").alias("n_documents")).withColumn("ambiguous", F.col("n_documents") > 1)


def resolve_links(links: DataFrame, index: DataFrame) -> DataFrame:
    """(link_id, status, target_id) of links (link_id, target, valid): external, invalid, resolved, ambiguous or unresolved."""
    keys = F.array_distinct(F.array(F.lower("target"), F.regexp_replace(F.lower("target"), r"\.md$", ""), F.regexp_extract(F.lower("target"), r"([^/]+?)(?:\.md)?$", 1)))
    rows = links.select("link_id", "target", "valid", F.posexplode(keys).alias("o", "key"))
    hits = rows.join(index.select("key", F.col("doc_id").alias("hit"), "ambiguous"), "key", "left")
    g = hits.groupBy("link_id").agg(F.first("target").alias("target"), F.first("valid").alias("valid"), F.min(F.when(F.col("hit").isNotNull(), F.struct("o", "hit", "ambiguous"))).alias("b"))
    status = F.when(~F.col("valid"), "invalid").when(F.col("target").rlike(r"^[a-z]+://|^mailto:"), "external").when(F.coalesce("target", F.lit("")) == "", "invalid").when(F.col("b").isNull(), "unresolved").when(F.col("b.ambiguous"), "ambiguous").otherwise("resolved")
    return g.select("link_id", status.alias("status"), F.when(status == "resolved", F.col("b.hit")).alias("target_id"))


def build_edges(parts: dict[str, DataFrame]) -> DataFrame:
    """(source_id, edge_type, target_id, authority) of named edge lists (source_id, target_id); repeated edges count once."""
    rows = [d.select("source_id", F.lit(t).alias("edge_type"), "target_id", F.lit(EDGE_TYPES[t][0]).alias("authority")) for t, d in parts.items()]
    return reduce(DataFrame.unionByName, rows).where("source_id is not null and target_id is not null").distinct()


def graph_hygiene(nodes: DataFrame, edges: DataFrame, high_degree: int = 10) -> DataFrame:
    """(measure, n): orphans, self links, broken ends, repeated targets, nodes of high degree, and edges by type."""
    ends = edges.select("source_id", "target_id", F.explode(F.array("source_id", "target_id")).alias("id"))
    other = F.when(F.col("id") == F.col("source_id"), F.col("target_id")).otherwise(F.col("source_id"))
    degree = ends.withColumn("other", other).groupBy("id").agg(F.count_distinct("other").alias("d"))

    def one(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")

    parts = [
        one(nodes.join(degree, "id", "left_anti"), "orphans"), one(edges.where("source_id = target_id"), "self_links"), one(edges.join(nodes.withColumnRenamed("id", "target_id"), "target_id", "left_anti"), "broken_links"),
        one(edges.groupBy("source_id", "target_id").count().where("count > 1"), "repeated_targets"), one(degree.where(F.col("d") >= high_degree), "high_degree"), edges.groupBy(F.concat(F.lit("edges:"), "edge_type").alias("measure")).agg(F.count("*").alias("n")),
    ]
    return reduce(DataFrame.unionByName, parts)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, size, size_rank): components by their smallest id, the largest first; nodes without edges are their own."""
    found = min_label_components(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")), tag="graph")
    rows = nodes.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    sizes = rows.groupBy("component").agg(F.count("*").alias("size"))
    # components of one size share a rank, so no window over all of them is needed
    per_size = sizes.groupBy("size").agg(F.count("*").alias("n")).withColumn("size_rank", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    return rows.join(sizes, "component").join(F.broadcast(per_size.select("size", "size_rank")), "size").select("id", "component", "size", "size_rank")


def graph_expand(seeds: DataFrame, edges: DataFrame, units: DataFrame, types: Sequence[str], authorities: Sequence[str] = ("G0", "G1"), n_seeds: int = 3, n_nodes: int = 20, n_added: int = 5) -> DataFrame:
    """(query_id, chunk_id, seed_id, edge_type, target_id, rank): units of the neighbours of the first seeds, at most ``n_added``.

    ``seeds``: query_id, node_id, rank; ``units``: node_id, chunk_id. Neighbours come by (edge type, target); a target that is a seed
    adds nothing, and one reached twice counts once.
    """
    first = seeds.where(F.col("rank") <= n_seeds).select("query_id", F.col("node_id").alias("source_id"), F.col("rank").alias("seed_rank"))
    hops = first.join(edges.where(F.col("edge_type").isin(*types) & F.col("authority").isin(*authorities)), "source_id")
    hops = hops.join(first.select("query_id", F.col("source_id").alias("target_id")), ["query_id", "target_id"], "left_anti")
    once = topk(hops, ["query_id", "target_id"], [F.asc("seed_rank"), F.asc("edge_type"), F.asc("source_id")], 1, "k").drop("k")
    nodes = topk(once, ["query_id"], [F.asc("edge_type"), F.asc("target_id")], n_nodes, "node_rank")
    added = nodes.join(units.withColumnRenamed("node_id", "target_id"), "target_id")
    return topk(added, ["query_id"], [F.asc("node_rank"), F.asc("chunk_id")], n_added).select("query_id", "chunk_id", F.col("source_id").alias("seed_id"), "edge_type", "target_id", "rank")


def path_score(types: Column) -> Column:
    """The mean authority weight of a path's edge types (0.5 for unknown ones) by its number of hops, rounded to 6 places."""
    weights = F.create_map(*[F.lit(x) for t, (_, w) in EDGE_TYPES.items() for x in (t, w)])
    each = F.transform(types, lambda t: F.coalesce(F.try_element_at(weights, t), F.lit(0.5)))
    return F.round(F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(types) / F.size(types), 6)


def graph_paths(seeds: DataFrame, edges: DataFrame, per_node: int = 3, n_paths: int = 8) -> DataFrame:
    """(query_id, nodes, types, score, rank): paths of one or two hops from the seeds, without visiting a node twice.

    Each node leads on to its first ``per_node`` neighbours by (edge type, target).
    """
    near = topk(edges.select("source_id", "edge_type", "target_id"), ["source_id"], [F.asc("edge_type"), F.asc("target_id")], per_node, "k").drop("k")
    one = seeds.select("query_id", F.col("node_id").alias("source_id")).distinct().join(near, "source_id").where("source_id <> target_id")
    one = one.select("query_id", F.array("source_id", "target_id").alias("nodes"), F.array("edge_type").alias("types"), F.col("target_id").alias("at"))
    two = one.join(near.withColumnsRenamed({"source_id": "at", "target_id": "next"}), "at").where(~F.array_contains("nodes", F.col("next")))
    two = two.select("query_id", F.array_append("nodes", F.col("next")).alias("nodes"), F.array_append("types", F.col("edge_type")).alias("types"))
    every = one.drop("at").unionByName(two).withColumn("score", path_score(F.col("types")))
    return topk(every, ["query_id"], [F.desc("score"), F.asc("nodes"), F.asc("types")], n_paths)


def graph_distance(pairs: DataFrame, edges: DataFrame, max_hops: int = 3) -> DataFrame:
    """(a, b, hops): the smallest number of undirected hops between each pair, null beyond ``max_hops``. The hops are a constant number of joins."""
    both = edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("next")).unionByName(edges.select(F.col("target_id").alias("at"), F.col("source_id").alias("next"))).distinct()
    wanted = pairs.select("a", "b").distinct()
    front = wanted.select("a", F.col("a").alias("at")).distinct()
    seen = front.select("a", "at", F.lit(0).alias("hops"))
    for h in range(1, max_hops + 1):
        front = front.join(both, "at").select("a", F.col("next").alias("at")).distinct().join(seen.select("a", "at"), ["a", "at"], "left_anti")
        seen = seen.unionByName(front.select("a", "at", F.lit(h).alias("hops")))
    return wanted.join(seen.withColumnRenamed("at", "b"), ["a", "b"], "left")


def graph_router(queries: DataFrame, seeds: DataFrame, edges: DataFrame, relation_terms: Sequence[str], phrases: Sequence[str]) -> DataFrame:
    """(query_id, n_relation, n_phrase, n_entities, connected, expandable, activate, reason): should the graph be used for a query?"""
    low = F.lower("text")
    count = lambda words: reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in words], F.lit(0))
    own = seeds.select("query_id", F.col("node_id").alias("source_id")).distinct()
    out_edges = own.join(edges.select("source_id", "target_id").distinct(), "source_id")
    linked = out_edges.join(own.withColumnRenamed("source_id", "target_id"), ["query_id", "target_id"], "left_semi").where("source_id <> target_id").select("query_id", F.lit(True).alias("c")).distinct()
    more = out_edges.join(own.withColumnRenamed("source_id", "target_id"), ["query_id", "target_id"], "left_anti").select("query_id", F.lit(True).alias("x")).distinct()
    q = queries.select("query_id", count(relation_terms).alias("n_relation"), count(phrases).alias("n_phrase"), F.regexp_count("text", F.lit("[A-Z][a-z]+")).alias("n_entities"))
    q = q.join(linked, "query_id", "left").join(more, "query_id", "left").select("query_id", "n_relation", "n_phrase", "n_entities", F.coalesce("c", F.lit(False)).alias("connected"), F.coalesce("x", F.lit(False)).alias("expandable"))
    reason = F.when(~F.col("expandable"), "nothing_to_expand").when(F.col("n_relation") > 0, "relation_term").when(F.col("n_phrase") > 0, "structure_phrase").when((F.col("n_entities") >= 2) & F.col("connected"), "connected_entities").otherwise("no_signal")
    return q.withColumn("reason", reason).withColumn("activate", F.col("reason").isin("relation_term", "structure_phrase", "connected_entities"))


def edge_provenance(edges: DataFrame, corpus: DataFrame) -> DataFrame:
    """(edge_id, provenance, consistency) of edges (edge_id, source_id, target_id, evidence_id, evidence_digest) against a corpus (doc_id, digest)."""
    s, t, e = (corpus.select(F.col("doc_id").alias(f"{n}_id"), F.lit(True).alias(f"has_{n}")) for n in ("source", "target", "evidence"))
    d = corpus.select(F.col("doc_id").alias("evidence_id"), F.col("digest").alias("now"))
    j = edges.join(s, "source_id", "left").join(t, "target_id", "left").join(e, "evidence_id", "left").join(d, "evidence_id", "left")
    level = F.when(F.col("evidence_id").isNull(), "none").when(F.col("evidence_digest").isNull(), "document").otherwise("content")
    state = F.when(F.col("has_source").isNull() | F.col("has_target").isNull(), "dangling").when(F.col("evidence_id").isNull(), "unassessable").when(F.col("has_evidence").isNull(), "evidence_missing").when(F.col("evidence_digest").isNotNull() & (F.col("evidence_digest") != F.col("now")), "evidence_changed").otherwise("consistent")
    return j.select("edge_id", level.alias("provenance"), state.alias("consistency"))


def dangling_refs(links: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, kind, severity, n_links, effect) of unresolved targets (doc_id, target): what sort it is, and what the graph would gain from it."""
    kind = F.when(F.col("target").rlike(r"\.(png|jpe?g|gif|pdf|svg)$"), "attachment").when(F.col("target").rlike(r"^[a-z]+://"), "external").when(F.col("target").rlike(r"(?i)(todo|tbd|placeholder)"), "placeholder").otherwise("missing")
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("doc_id")).distinct().withColumn("linked", F.lit(1))
    g = links.select("doc_id", "target", kind.alias("kind")).distinct().join(ends, "doc_id", "left").groupBy("target", "kind").agg(F.count("*").alias("n_links"), F.coalesce(F.sum("linked"), F.lit(0)).alias("n_linked"))
    severity = F.when(F.col("kind") == "missing", F.when(F.col("n_links") > 1, "high").otherwise("medium")).otherwise("low")
    effect = F.when(F.col("kind") != "missing", "none").when(F.col("n_linked") > 1, "joins_components").when(F.col("n_linked") == 1, "extends_component").when(F.col("n_links") > 1, "new_chain").otherwise("new_edge")
    return g.select("target", "kind", severity.alias("severity"), "n_links", effect.alias("effect"))
