"""Fusion, reranking, quotas, deduplication and selection of candidates, for whole tables of queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrygrid.common import broadcast_if_few, materialize, topk, with_rank
from quarrygrid.operators.evaluation import overlap_join
from quarrygrid.operators.lexical import tokens

RRF_K = 60
DIGITS = 9


def _r(c: Column) -> Column:
    return F.round(c, DIGITS)


def rrf_hybrid(vec: DataFrame, bm25: DataFrame, k: int = RRF_K, weight_vec: float = 1.0, weight_bm25: float = 1.0) -> DataFrame:
    """Weighted reciprocal-rank fusion of two lists (query_id, chunk_id, rank, score); keeps both ranks and scores and the sources."""
    a = vec.select("query_id", "chunk_id", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    b = bm25.select("query_id", "chunk_id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    both = a.join(b, ["query_id", "chunk_id"], "full_outer")
    score = F.coalesce(weight_vec / (k + F.col("vector_rank")), F.lit(0.0)) + F.coalesce(weight_bm25 / (k + F.col("bm25_rank")), F.lit(0.0))
    sources = F.array_compact(F.array(F.when(F.col("vector_rank").isNotNull(), "vector"), F.when(F.col("bm25_rank").isNotNull(), "bm25")))
    return with_rank(both.withColumns({"rrf_score": _r(score), "sources": sources}), ["query_id"], [F.desc("rrf_score"), F.asc("chunk_id")])


def rrf_many(lists: Sequence[DataFrame], k: int = RRF_K, limit: int = 20) -> DataFrame:
    """Reciprocal-rank fusion of any number of lists; ties by id."""
    every = reduce(DataFrame.unionByName, [x.select("query_id", "chunk_id", "rank") for x in lists])
    fused = every.groupBy("query_id", "chunk_id").agg(_r(F.sum(1.0 / (k + F.col("rank")))).alias("score"), F.count("*").alias("n_lists"))
    return topk(fused, ["query_id"], [F.desc("score"), F.asc("chunk_id")], limit)


def rank_fusion(cands: DataFrame, k: int = RRF_K, lam: float = 0.75) -> DataFrame:
    """Final order from the retrieval rank and the reranker's rank: 1/(k+r1) + lam/(k+r2); ties by retrieval rank, id."""
    score = 1.0 / (k + F.col("retrieval_rank")) + lam / (k + F.col("rerank_rank"))
    return with_rank(cands.withColumn("fusion_score", _r(score)), ["query_id"], [F.desc("fusion_score"), F.asc("retrieval_rank"), F.asc("chunk_id")], "final_rank")


def overlap_score(query_tokens: Column, passage_tokens: Column) -> Column:
    """The default reranker: the share of the query's distinct tokens that the passage has."""
    q = F.array_distinct(query_tokens)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, passage_tokens)) / F.size(q))


def rerank(cands: DataFrame, top_n: int = 20, score_fn: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """Score (query_text, passage) of the first ``top_n`` candidates and order them; ``rerank_rank`` keeps that order.

    ``cands``: query_id, chunk_id, retrieval_rank, query_text, heading_path, content. ``score_fn`` is an Arrow-batched function of
    two Series; by default query-term overlap, in the JVM. Candidates beyond ``top_n`` are left out.
    """
    first = cands.where(F.col("retrieval_rank") <= top_n)
    passage = F.concat_ws("\n", F.concat_ws(" > ", "heading_path"), "content") if "heading_path" in cands.columns else F.col("content")
    if score_fn is None:
        score = overlap_score(tokens(F.col("query_text")), tokens(passage))
    else:
        score = F.pandas_udf(score_fn, "double")(F.col("query_text"), passage)
    return with_rank(first.withColumn("rerank_score", _r(score)), ["query_id"], [F.desc("rerank_score"), F.asc("retrieval_rank"), F.asc("chunk_id")], "rerank_rank")


def capped_tokens(df: DataFrame, key: str, text: str, cap: int | None) -> DataFrame:
    """(key, token): distinct tokens, all or the first ``cap`` in alphabetical order."""
    own = F.array_distinct(tokens(F.col(text)))
    return df.select(key, F.explode(own if cap is None else F.slice(F.array_sort(own), 1, cap)).alias("token"))


def token_maxsim(queries: DataFrame, chunks: DataFrame, k: int = 20, query_cap: int | None = None, passage_cap: int | None = None) -> DataFrame:
    """Late interaction over distinct tokens: best matches and shared tokens coincide on sets, so the score is 2 |q and d| / |q|.

    All tokens count; caps of 32 and 96 give the form for short passages. A chunk's tokens meet the queries' where they are, if the
    latter are few enough to broadcast, so that counting is done before the shuffle.
    """
    q = materialize(capped_tokens(queries, "query_id", "text", query_cap), "maxsim-queries")
    size = q.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = capped_tokens(chunks, "chunk_id", "content", passage_cap).join(broadcast_if_few(q), "token").groupBy("query_id", "chunk_id").agg(F.count("*").alias("shared"))
    scored = hits.join(size, "query_id").select("query_id", "chunk_id", _r(2.0 * F.col("shared") / F.col("n")).alias("score"))
    return topk(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def late_rerank_pool(dense: DataFrame, late: DataFrame) -> DataFrame:
    """The dense pool in the order of late scores; who is in it doesn't change, and rows without late score come last."""
    joined = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank")).join(late.select("query_id", "chunk_id", F.col("score").alias("late_score")), ["query_id", "chunk_id"], "left")
    return with_rank(joined, ["query_id"], [F.desc_nulls_last("late_score"), F.asc("dense_rank")])


def candidate_union(lists: dict[str, DataFrame]) -> DataFrame:
    """Union of named lists: best rank, all sources, ordered by best rank, then id."""
    every = reduce(DataFrame.unionByName, [x.select("query_id", "chunk_id", "rank", F.lit(name).alias("source")) for name, x in lists.items()])
    merged = every.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("best_rank"), F.array_sort(F.collect_set("source")).alias("sources"))
    return with_rank(merged, ["query_id"], [F.asc("best_rank"), F.asc("chunk_id")])


def tiered_fusion(dense: DataFrame, late: DataFrame, prefix: int = 5, top: int = 20, k: int = RRF_K) -> DataFrame:
    """Found by both: tier 0; dense rank up to ``prefix``: tier 1; the rest: tier 2; inside a tier by fused score, then id."""
    both = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank")).join(late.select("query_id", "chunk_id", F.col("rank").alias("late_rank")), ["query_id", "chunk_id"], "full_outer")
    tier = F.when(F.col("dense_rank").isNotNull() & F.col("late_rank").isNotNull(), 0).when(F.col("dense_rank") <= prefix, 1).otherwise(2)
    score = F.coalesce(1.0 / (k + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("late_rank")), F.lit(0.0))
    return topk(both.withColumns({"tier": tier, "score": _r(score)}), ["query_id"], [F.asc("tier"), F.desc("score"), F.asc("chunk_id")], top)


def lane_quota(cands: DataFrame, quotas: dict[str, int], budget: int) -> DataFrame:
    """Each lane (query_id, chunk_id, lane, rank) gets its quota; unused slots and the rest of the budget go to the best of all others."""
    quota = F.create_map(*[F.lit(x) for item in quotas.items() for x in item])
    ranked = with_rank(cands, ["query_id", "lane"], [F.asc("rank"), F.asc("chunk_id")], "lane_rank")
    ranked = ranked.withColumn("seeded", F.col("lane_rank") <= F.coalesce(F.try_element_at(quota, F.col("lane")), F.lit(0)))
    w = Window.partitionBy("query_id")
    ranked = ranked.withColumn("room", F.greatest(F.lit(budget) - F.sum(F.col("seeded").cast("int")).over(w), F.lit(0)))
    ranked = ranked.withColumn("spare_rank", F.row_number().over(Window.partitionBy("query_id", "seeded").orderBy("rank", "chunk_id")))
    chosen = ranked.where(F.col("seeded") | (F.col("spare_rank") <= F.col("room")))
    return topk(chosen, ["query_id"], [F.desc("seeded"), F.asc("rank"), F.asc("chunk_id")], budget, "slot").drop("room", "spare_rank")


def query_variants(queries: DataFrame, rules: Sequence[tuple[str, str, str]], n: int = 3) -> DataFrame:
    """(query_id, variant, kind, text): the query and its rewrites by rules (kind, pattern, replacement), distinct, at most ``n``."""
    text = F.col("text")
    made = [F.struct(F.lit(0).alias("i"), F.lit("original").alias("kind"), text.alias("text"))]
    for i, (kind, pattern, replacement) in enumerate(rules, 1):
        made.append(F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), F.regexp_replace(text, pattern, replacement).alias("text")))
    rows = queries.select("query_id", F.explode(F.array(*made)).alias("v")).select("query_id", "v.*")
    first = topk(rows, ["query_id", "text"], [F.asc("i")], 1, "r").drop("r")
    return topk(first, ["query_id"], [F.asc("i")], n, "r").select("query_id", (F.col("r") - 1).alias("variant"), "kind", "text")


def multi_query_merge(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """Hits of several variants (query_id, variant, chunk_id, rank, score) as one list: best rank and score, variants, summed 1/(k+rank)."""
    merged = hits.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("best_rank"), F.max("score").alias("best_score"), F.array_sort(F.collect_set("variant")).alias("variants"), _r(F.sum(1.0 / (k + F.col("rank")))).alias("score"))
    return with_rank(merged, ["query_id"], [F.desc("score"), F.asc("best_rank"), F.asc("chunk_id")])


def dedup_candidates(cands: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Greedy, in rank order: a candidate goes if it has a kept row's chunk, or in one document its lines, its content, or an overlap of
    lines of ``threshold`` or more of the smaller span. A fold, because only *kept* rows count; groups are one query's candidates.

    ``cands``: query_id, chunk_id, doc_id, rank, start_line, end_line, content_hash.
    """

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for row in g.sort_values(["rank", "chunk_id"]).itertuples():
            for other in kept:
                if row.chunk_id == other.chunk_id:
                    break
                if row.doc_id != other.doc_id:
                    continue
                if row.content_hash == other.content_hash:
                    break
                spans = (row.start_line, row.end_line, other.start_line, other.end_line)
                if any(pd.isna(x) for x in spans):
                    continue
                common = min(spans[1], spans[3]) - max(spans[0], spans[2]) + 1
                if common > 0 and common / min(spans[1] - spans[0] + 1, spans[3] - spans[2] + 1) >= threshold:
                    break
            else:
                kept.append(row)
        out = g.loc[[r.Index for r in kept]].copy()
        out["dedup_rank"] = range(1, len(out) + 1)
        return out


    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cands.schema)
    return cands.groupBy("query_id").applyInPandas(fold, f"{fields}, dedup_rank int")


def context_budget(cands: DataFrame, budget: int = 4096, limit: int = 5, per_document: int = 2) -> DataFrame:
    """Adds ``context_rank`` (null if not selected): rank order, at most ``limit`` chunks and ``per_document`` of a document, within
    ``budget`` tokens; a row that doesn't fit is passed over and the next is tried.

    ``cands``: query_id, chunk_id, doc_id, rank, n_tokens.
    """

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["rank", "chunk_id"])
        left, per, place = budget, {}, []
        for row in g.itertuples():
            n = len([p for p in place if p])
            fits = n < limit and per.get(row.doc_id, 0) < per_document and row.n_tokens <= left
            if fits:
                left -= row.n_tokens
                per[row.doc_id] = per.get(row.doc_id, 0) + 1
            place.append(n + 1 if fits else None)
        g["context_rank"] = pd.array(place, "Int32")
        return g

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cands.schema)
    return cands.groupBy("query_id").applyInPandas(fold, f"{fields}, context_rank int")


def evidence_compose(cands: DataFrame, budget: int = 5, head: int = 3, protected: Sequence[str] = ("late", "graph")) -> DataFrame:
    """A decision and its reason for every candidate (query_id, chunk_id, doc_id, section_id, lane, rank).

    The first ``head`` candidates by rank are in. Then each protected lane that has none there seeds its best one, unless that
    would repeat a document that has already two. The remaining slots fill by rank; a second row of one section is redundant.
    """

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["rank", "chunk_id"]).reset_index(drop=True)
        decision: dict[int, str] = {}
        sections, docs, lanes = set(), {}, set()

        def take(i: int, why: str) -> None:
            decision[i] = why
            sections.add((g.doc_id[i], g.section_id[i]))
            docs[g.doc_id[i]] = docs.get(g.doc_id[i], 0) + 1
            lanes.add(g.lane[i])

        def full() -> bool:
            return sum(w.startswith("selected") for w in decision.values()) >= budget

        for i in range(min(head, len(g))):
            take(i, "selected_head")
        for lane in protected:
            if lane not in lanes and not full():
                for i in g.index[(g.lane == lane) & ~g.index.isin(list(decision))]:
                    if docs.get(g.doc_id[i], 0) >= 2:
                        decision[i] = "rejected_displacement"
                        continue
                    take(i, "selected_protected")
                    break
        for i in g.index:
            if i in decision:
                continue
            if (g.doc_id[i], g.section_id[i]) in sections:
                decision[i] = "rejected_redundant"
            elif full():
                decision[i] = "rejected_budget"
            else:
                take(i, "selected_rank")
        why = [decision[i] for i in g.index]
        return pd.DataFrame({"query_id": g.query_id, "chunk_id": g.chunk_id, "selected": [w.startswith("selected") for w in why], "reason": why})

    kinds = cands.schema
    return cands.groupBy("query_id").applyInPandas(fold, f"query_id {kinds['query_id'].dataType.simpleString()}, chunk_id {kinds['chunk_id'].dataType.simpleString()}, selected boolean, reason string")


def evidence_signals(cands: DataFrame) -> DataFrame:
    """Per query: top and second score, margin, mean, lowest, how many lists found a row, documents, and the share of terms matched.

    ``cands``: query_id, chunk_id, doc_id, rank, score, n_sources, n_matched, n_terms.
    """
    out = cands.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second_score"), F.min("score").alias("min_score"), F.avg("score").alias("mean_score"),
        F.count(F.when(F.col("n_sources") > 1, 1)).alias("n_dual"), F.count_distinct("doc_id").alias("n_documents"), F.max(F.col("n_matched") / F.col("n_terms")).alias("term_coverage"), F.count("*").alias("n_candidates"),
    )
    return out.withColumn("margin", F.col("top_score") - F.coalesce("second_score", F.lit(0.0)))


def score_guard(cands: DataFrame, min_confidence: float = 0.5, max_entropy: float = 0.98, min_mean: float = 0.0) -> DataFrame:
    """Confidence of each ranked list (query_id, doc_id, rank, score) and whether a second retriever should run.

    Entropy is that of the scores of the first 20 as shares, by the logarithm of their number (1 for an empty or single list);
    confidence blends margin, concentration and diversity.
    """
    w = Window.partitionBy("query_id")
    top = cands.where("rank <= 20").withColumn("share", F.col("score") / F.sum("score").over(w))
    out = top.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"), F.max(F.when(F.col("rank") == 5, F.col("score"))).alias("s5"),
        F.count("*").alias("n"), F.sum(-F.col("share") * F.log("share")).alias("h"), F.avg("score").alias("mean_score"), (F.count_distinct(F.when(F.col("rank") <= 5, F.col("doc_id"))) / F.count(F.when(F.col("rank") <= 5, 1))).alias("diversity"),
    )
    entropy = F.when(F.col("n") > 1, F.col("h") / F.log(F.col("n").cast("double"))).otherwise(1.0)
    margin = (F.col("s1") - F.coalesce("s2", F.lit(0.0))) / F.col("s1")
    out = out.withColumns({"entropy": entropy, "margin": margin, "margin5": (F.col("s1") - F.coalesce("s5", F.lit(0.0))) / F.col("s1")})
    out = out.withColumn("confidence", 0.5 * F.col("margin") + 0.3 * (1 - F.col("entropy")) + 0.2 * F.col("diversity"))
    trigger, trigger2 = F.col("confidence") < min_confidence, (F.col("entropy") > max_entropy) | (F.col("mean_score") < min_mean)
    return out.select("query_id", "margin", "margin5", "entropy", "diversity", "mean_score", "confidence", trigger.alias("trigger"), trigger2.alias("trigger_v2"))


def guarded_retrieval(dense: DataFrame, queries: DataFrame, late_fn: Callable[[DataFrame], DataFrame], guard: DataFrame, top: int = 20) -> DataFrame:
    """Run the second retriever only for the queries whose guard fires, and fuse; the others keep the dense list."""
    fired = guard.where("trigger").select("query_id")
    late = late_fn(queries.join(fired, "query_id", "left_semi"))
    fused = tiered_fusion(dense.join(fired, "query_id", "left_semi"), late, top=top).select("query_id", "chunk_id", "rank", F.lit(True).alias("guarded"))
    plain = dense.join(fired, "query_id", "left_anti").where(F.col("rank") <= top).select("query_id", "chunk_id", "rank", F.lit(False).alias("guarded"))
    return fused.unionByName(plain)


def hierarchical_topk(cands: DataFrame, members: DataFrame, n_documents: int = 3, n_sections: int = 5, k: int = 10) -> DataFrame:
    """Top documents, then top sections in them, by first appearance; then their chunks by score.

    ``cands``: query_id, chunk_id, rank, score; ``members``: chunk_id, doc_id, section_id.
    """
    rows = cands.join(members, "chunk_id")
    docs = topk(rows.groupBy("query_id", "doc_id").agg(F.min("rank").alias("first")), ["query_id"], [F.asc("first")], n_documents, "doc_rank")
    inside = rows.join(docs.select("query_id", "doc_id", "doc_rank"), ["query_id", "doc_id"])
    sections = topk(inside.groupBy("query_id", "doc_id", "section_id").agg(F.min("rank").alias("first")), ["query_id"], [F.asc("first")], n_sections, "section_rank")
    final = inside.join(sections.select("query_id", "doc_id", "section_id"), ["query_id", "doc_id", "section_id"], "left_semi")
    return topk(final.drop("rank", "doc_rank"), ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def centroids(vectors: DataFrame, parent: str, vector: str = "embedding") -> DataFrame:
    """(parent, centroid): the normalised mean of the members' vectors, position by position."""
    mean = vectors.select(parent, F.posexplode(vector).alias("i", "x")).groupBy(parent, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = mean.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v")).select(parent, F.transform("v", lambda z: z["m"]).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return packed.select(parent, F.transform("v", lambda x: x / size).alias("centroid"))


def parent_child_topk(queries: DataFrame, vectors: DataFrame, parent: str, n_parents: int = 2, k: int = 10, key: str = "vec_id") -> DataFrame:
    """Parents by the cosine of their centroid, then the best parents' children by their own.

    Children meet the queries of their parent in the tasks that read them (``best_in_tasks``), so a parent's children don't come together.
    """
    from quarrygrid.operators.vectors import best_in_tasks, vector_topk

    groups = materialize(centroids(vectors, parent).select(F.col(parent).cast("long").alias("parent_id"), "centroid"), "centroids")
    best = vector_topk(queries, groups, n_parents, key="parent_id", vector="centroid").groupBy("query_id").agg(F.collect_list("parent_id").alias("parents"))
    asked = materialize(queries.select("query_id", "query_vector").join(best, "query_id"), "parent-queries")

    def chooser(q: np.ndarray, parents: list) -> Callable:
        of: dict[int, list[int]] = {}
        for i, own in enumerate(parents):
            for p in own:
                of.setdefault(p, []).append(i)
        positions = {p: np.array(i) for p, i in of.items()}
        return lambda part, x: [(positions[p], at, None) for p, at in part.groupby(parent).indices.items() if p in positions]

    scored = best_in_tasks(asked, vectors.where(F.col(parent).isNotNull()), k, key, "embedding", chooser, parent, "parents")
    return topk(scored.select("query_id", parent, key, "similarity"), ["query_id"], [F.desc("similarity"), F.asc(key)], k)


def section_lane(seeds: DataFrame, sections: DataFrame, chunks: DataFrame, per_document: int = 2) -> DataFrame:
    """Chunks that overlap the first sub-headings (level over 1) of each seed document.

    ``seeds``: query_id, doc_id; ``sections``: doc_id, section_id, level, start_line, end_line; ``chunks``: chunk_id, doc_id, start_line, end_line.
    """
    first = topk(sections.where("level > 1"), ["doc_id"], [F.asc("start_line"), F.asc("section_id")], per_document, "n").drop("n", "level")
    picked = seeds.select("query_id", "doc_id").distinct().join(first.withColumnsRenamed({"start_line": "s", "end_line": "e"}), "doc_id")
    joined = overlap_join(picked, chunks.select("chunk_id", "doc_id", "start_line", "end_line"), ["doc_id"], ("s", "e"), ("start_line", "end_line"))
    return joined.select("query_id", "doc_id", "section_id", "chunk_id")


def lane_guard(queries: DataFrame, phrases: Sequence[str], structure: DataFrame) -> DataFrame:
    """(query_id, phrase_hit, has_structure, trigger): a phrase rule fits and structure candidates exist."""
    low = F.lower("text")
    hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in phrases], F.lit(False))
    has = structure.select("query_id").distinct().withColumn("has", F.lit(True))
    return queries.select("query_id", hit.alias("phrase_hit")).join(has, "query_id", "left").select("query_id", "phrase_hit", F.coalesce("has", F.lit(False)).alias("has_structure"), (F.col("phrase_hit") & F.coalesce("has", F.lit(False))).alias("trigger"))


def merge_lanes(base: DataFrame, structure: DataFrame, graph: DataFrame, seeds: int = 3) -> DataFrame:
    """Seeds, structure, graph, then the rest of the base; the first place counts, sources add up, ranks are new."""
    parts = (
        base.select("query_id", "chunk_id", F.when(F.col("rank") <= seeds, 0).otherwise(3).alias("lane"), "rank", F.lit("base").alias("source")),
        structure.select("query_id", "chunk_id", F.lit(1).alias("lane"), "rank", F.lit("structure").alias("source")),
        graph.select("query_id", "chunk_id", F.lit(2).alias("lane"), "rank", F.lit("graph").alias("source")),
    )
    merged = reduce(DataFrame.unionByName, parts).groupBy("query_id", "chunk_id").agg(F.min(F.struct("lane", "rank")).alias("first"), F.array_sort(F.collect_set("source")).alias("sources"))
    return with_rank(merged, ["query_id"], [F.asc("first.lane"), F.asc("first.rank"), F.asc("chunk_id")]).select("query_id", "chunk_id", "rank", "sources")


def hydrate_chunks(ranked: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Path, heading and content of ranked ids, of indexed documents alone; ``known`` is false for ids that no chunk has."""
    live = chunks.join(docs.where("index_status = 'indexed'").select("doc_id"), "doc_id", "left_semi")
    known = chunks.select("chunk_id", F.lit(True).alias("known"))
    joined = ranked.join(known, "chunk_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return joined.join(live, "chunk_id", "left").where("doc_id is not null or not known")


def score_features(cands: DataFrame) -> DataFrame:
    """Features of each query's scores (query_id, doc_id, rank, score): scores at ranks, margins, spread, slope, entropy, documents."""
    w = Window.partitionBy("query_id")
    rows = cands.where("rank <= 20").withColumn("share", F.col("score") / F.sum("score").over(w))

    def at(r: int) -> Column:
        return F.max(F.when(F.col("rank") == r, F.col("score")))

    out = rows.groupBy("query_id").agg(
        at(1).alias("s1"), at(2).alias("s2"), at(5).alias("s5"), at(10).alias("s10"), at(20).alias("s20"), F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"), (F.max("score") - F.min("score")).alias("range_score"),
        F.regr_slope(F.col("score"), F.col("rank").cast("double")).alias("slope"), F.sum(-F.col("share") * F.log("share")).alias("entropy"), F.count_distinct("doc_id").alias("n_documents"), (1 - F.count_distinct("score") / F.count("score")).alias("same_value_ratio"),
    )
    return out.withColumns({"margin12": F.col("s1") - F.col("s2"), "margin15": F.col("s1") - F.col("s5")})
