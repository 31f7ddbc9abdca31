"""Retrieval quality, stability, leakage, drift and latency analytics over tables of runs."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrygrid.common import bound_batches, broadcast_if_few, materialize, nearest_rank, shuffle_partitions, topk
from quarrygrid.operators.lexical import ascii_lower, tokens

# --- gold and ranking metrics ----------------------------------------------------------------------------------------


def gold_match(cands: DataFrame, gold: DataFrame) -> DataFrame:
    """Candidates with the way they match a gold item: by chunk, by overlapping lines of its document, by document, or not.

    ``cands``: query_id, chunk_id, doc_id, start_line, end_line, rank; ``gold``: query_id, gold_id, chunk_id, doc_id, start_line, end_line.
    """
    g = gold.select("query_id", "gold_id", F.col("chunk_id").alias("g_chunk"), "doc_id", F.col("start_line").alias("g_start"), F.col("end_line").alias("g_end"))
    joined = cands.join(g, ["query_id", "doc_id"])
    level = F.when(F.col("chunk_id") == F.col("g_chunk"), "chunk").when((F.col("start_line") <= F.col("g_end")) & (F.col("end_line") >= F.col("g_start")), "lines").otherwise("document")
    return joined.select("query_id", "gold_id", "chunk_id", "rank", level.alias("match"))


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Per query with gold: rank of the first relevant row, reciprocal rank, hit and set recall at each k.

    ``ranked``: query_id, chunk_id, rank; ``gold``: query_id, chunk_id. Queries without any found row have no first rank.
    """
    size = gold.groupBy("query_id").agg(F.count_distinct("chunk_id").alias("n_gold"))
    found = ranked.join(gold.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"])
    per = found.groupBy("query_id").agg(F.min("rank").alias("first_rank"), *[F.count_distinct(F.when(F.col("rank") <= k, F.col("chunk_id"))).alias(f"n{k}") for k in ks])
    out = size.join(per, "query_id", "left")
    cols = [F.col("query_id"), "n_gold", F.col("first_rank").cast("long").alias("first_rank"), F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank")]
    for k in ks:
        n = F.coalesce(f"n{k}", F.lit(0))
        cols += [(n > 0).cast("int").alias(f"hit_at_{k}"), (n / F.col("n_gold")).alias(f"recall_at_{k}")]
    return out.select(*cols)


def slice_metrics(ranks: DataFrame, tags: DataFrame, k: int = 5) -> DataFrame:
    """Hit rate, mean reciprocal rank and regressions by tag and arm, with a row for all tags ('*').

    ``ranks``: unit_id, arm, rank (null: absent), baseline_rank; ``tags``: unit_id, tag; a unit may have several.
    """
    joined = ranks.join(tags, "unit_id")
    every = joined.unionByName(ranks.withColumn("tag", F.lit("*")))
    hit, base = F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0)), F.coalesce((F.col("baseline_rank") <= k).cast("int"), F.lit(0))
    return every.groupBy("tag", "arm").agg(F.count("*").alias("n_units"), F.avg(hit).alias("hit_rate"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.sum(((base == 1) & (hit == 0)).cast("int")).alias("n_regressions"))


def ndcg(ranked: DataFrame, k: int = 10) -> DataFrame:
    """Binary nDCG@k of (query_id, rank, relevant); the ideal has the relevant rows of the list itself first."""
    gain = 1.0 / F.log2(F.col("rank") + 1.0)
    got = ranked.groupBy("query_id").agg(F.sum(F.when(F.col("relevant") & (F.col("rank") <= k), gain).otherwise(0.0)).alias("dcg"), F.least(F.sum(F.col("relevant").cast("int")), F.lit(k)).alias("n"))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1)).cast("int")), lambda i: 1.0 / F.log2(i + 1.0)), F.lit(0.0), lambda s, x: s + x)
    return got.select("query_id", F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def average_ranks(df: DataFrame, score: str, descending: bool = False) -> DataFrame:
    """Adds avg_rank, the mean position of each score among all rows, without one global window.

    Distinct scores are counted first; positions are prefix sums of the counts over ranges of scores.
    """
    counts = df.groupBy(score).agg(F.count("*").alias("__n"))
    parts = counts.repartitionByRange(shuffle_partitions(df.sparkSession), F.desc(score) if descending else F.asc(score)).withColumn("__part", F.spark_partition_id())
    parts = materialize(parts, "ranks")
    order = F.desc(score) if descending else F.asc(score)
    inner = parts.withColumn("__inner", F.sum("__n").over(Window.partitionBy("__part").orderBy(order)))
    totals = parts.groupBy("__part").agg(F.sum("__n").alias("__t"))
    before = totals.withColumn("__before", F.coalesce(F.sum("__t").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__t")
    placed = inner.join(F.broadcast(before), "__part").select(score, (F.col("__before") + F.col("__inner") - (F.col("__n") - 1) / 2).alias("avg_rank"), (F.col("__before") + F.col("__inner")).alias("last_rank"))
    return df.join(placed, score)


def ranking_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: ROC-AUC (ties count half) and average precision of scores against 0/1 labels."""
    ranked = average_ranks(df.select(score, label), score)
    auc = ranked.agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"), F.sum(F.when(F.col(label) == 1, F.col("avg_rank"))).alias("r"))
    auc = auc.select((F.col("p") + F.col("n")).alias("n_rows"), ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n"))).alias("auc"))
    grouped = df.groupBy(score).agg(F.sum(label).alias("hits"))
    down = average_ranks(grouped.join(df.groupBy(score).agg(F.count("*").alias("n")), score).select(score, "hits", "n"), score, True)
    # precision at the end of each group of ties, weighted by its positives
    ranked_hits = average_ranks(df.where(F.col(label) == 1).select(score), score, True).select(score, F.col("last_rank").alias("hits_so_far")).distinct()
    all_ranks = average_ranks(df.select(score), score, True).select(score, "last_rank").distinct()
    ap = down.select(score, "hits").where("hits > 0").join(ranked_hits, score).join(all_ranks, score).agg((F.sum(F.col("hits") * F.col("hits_so_far") / F.col("last_rank")) / F.sum("hits")).alias("average_precision"))
    return auc.join(ap)


def identity_match(gold: DataFrame, runtime: DataFrame, levels: Sequence[tuple[str, str]]) -> DataFrame:
    """The strongest identity (name, column) by which each gold unit is among a query's evidence; null where none is.

    ``verifiable`` is false where the gold unit has none of the columns.
    """
    parts = []
    for i, (name, column) in enumerate(levels):
        hit = gold.where(F.col(column).isNotNull()).select("query_id", "gold_id", column).join(runtime.select("query_id", column).distinct(), ["query_id", column])
        parts.append(hit.select("query_id", "gold_id", F.lit(i).alias("level"), F.lit(name).alias("matched_by")))
    best = reduce(DataFrame.unionByName, parts).groupBy("query_id", "gold_id").agg(F.min_by("matched_by", "level").alias("matched_by"))
    verifiable = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for _, c in levels])
    return gold.select("query_id", "gold_id", verifiable.alias("verifiable")).join(best, ["query_id", "gold_id"], "left")


def loss_funnel(gold: DataFrame, stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Per stage in order: how many gold items (query_id, chunk_id) survive up to it, are lost there, and the rate of survival."""
    joined = gold.select("query_id", "chunk_id").distinct()
    for i, (_, rows) in enumerate(stages):
        joined = joined.join(rows.select("query_id", "chunk_id", F.lit(True).alias(f"in{i}")).distinct(), ["query_id", "chunk_id"], "left")
    lost = F.coalesce(*[F.when(F.col(f"in{i}").isNull(), F.lit(i)) for i in range(len(stages))], F.lit(len(stages)))
    per = joined.select(lost.alias("lost_at"))
    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("stage")) for i, (n, _) in enumerate(stages)])
    long = per.select("lost_at", F.explode(names).alias("s"))
    out = long.groupBy("s.i", "s.stage").agg(F.sum((F.col("lost_at") > F.col("s.i")).cast("int")).alias("n_alive"), F.sum((F.col("lost_at") == F.col("s.i")).cast("int")).alias("n_lost"), F.count("*").alias("n"))
    return out.select("stage", "n_alive", "n_lost", (F.col("n_alive") / F.col("n")).alias("survival"))


def threshold_sweep(features: DataFrame, names: Sequence[str], label: str = "label", quantiles: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Precision, recall, F1 and trigger rate of every feature, nearest-rank quantile and direction (<=, >=)."""
    long = features.select(label, F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select(label, "x.*").where("value is not null")
    cuts = long.groupBy("feature").agg(*[nearest_rank("value", q).alias(f"q{i}") for i, q in enumerate(quantiles)])
    cuts = cuts.select("feature", F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.col(f"q{i}").alias("threshold")) for i, q in enumerate(quantiles)])).alias("c")).select("feature", "c.*")
    rows = long.join(F.broadcast(cuts), "feature").withColumn("op", F.explode(F.array(F.lit("<="), F.lit(">="))))
    fired = F.when(F.col("op") == "<=", F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold")).cast("int")
    out = rows.withColumn("fired", fired).groupBy("feature", "quantile", "threshold", "op").agg(F.sum("fired").alias("n_fired"), F.sum(F.col("fired") * F.col(label)).alias("tp"), F.sum(label).alias("positives"), F.count("*").alias("n"))
    precision, recall = F.when(F.col("n_fired") > 0, F.col("tp") / F.col("n_fired")).otherwise(0.0), F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(0.0)
    out = out.withColumns({"precision": precision, "recall": recall, "trigger_rate": F.col("n_fired") / F.col("n")})
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def routing_curve(scores: DataFrame, score: str = "score", label: str = "label", budgets: Sequence[float] = tuple(i / 10 for i in range(1, 11))) -> DataFrame:
    """For each share of calls: what routing the rows of the highest scores covers of the positives, and its precision.

    Rows of one score are routed together, if their last is within the budget.
    """
    ranked = average_ranks(scores.select(score, label), score, True)
    table = ranked.sparkSession.createDataFrame([(b,) for b in budgets], "budget double")
    size = scores.agg(F.count("*").alias("n"), F.sum(label).alias("positives"))
    rows = ranked.groupBy("last_rank").agg(F.sum(label).alias("hits"), F.count("*").alias("rows"))
    joined = F.broadcast(table).join(F.broadcast(size)).join(rows, F.col("last_rank") <= F.ceil(F.round(F.col("budget") * F.col("n"), 6)), "left")
    out = joined.groupBy("budget", "n", "positives").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n_routed"), F.coalesce(F.sum("hits"), F.lit(0)).alias("n_hits"))
    return out.select("budget", "n_routed", "n_hits", (F.col("n_hits") / F.col("positives")).alias("coverage"), F.when(F.col("n_routed") > 0, F.col("n_hits") / F.col("n_routed")).otherwise(0.0).alias("precision"))


def section_ambiguity(gold: DataFrame, sections: DataFrame) -> DataFrame:
    """In how many sections of its document the most widespread token of each gold text occurs, and the bucket.

    ``gold``: gold_id, doc_id, text; ``sections``: doc_id, section_id, text.
    """
    want = gold.select("gold_id", "doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    have = sections.select("doc_id", "section_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    spread = want.join(have, ["doc_id", "token"]).groupBy("gold_id", "token").agg(F.count_distinct("section_id").alias("n"))
    most = spread.groupBy("gold_id").agg(F.max("n").alias("n_sections"))
    out = gold.select("gold_id").distinct().join(most, "gold_id", "left").withColumn("n_sections", F.coalesce("n_sections", F.lit(0)))
    return out.withColumn("bucket", F.when(F.col("n_sections") == 0, "absent").when(F.col("n_sections") == 1, "unique").when(F.col("n_sections") <= 3, "low").otherwise("high"))


#: Rules by priority: name and Java/RE2 pattern on the text (fixed values).
FEATURE_RULES = (
    ("file_name", r"[A-Za-z0-9_-]+\.(md|txt|py|js|json|html|pdf|csv)([^A-Za-z0-9]|$)"), ("path", r"[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+"), ("version", r"(^|[^0-9.])v?[0-9]+\.[0-9]+(\.[0-9]+)?([^0-9.]|$)"),
    ("code_symbol", r"[a-z]+_[a-z]+|[a-z]+[A-Z][a-z]+|[A-Za-z]+\(\)"), ("acronym", r"(^|[^A-Za-z])[A-Z]{2,5}([^A-Za-z]|$)"), ("number", r"[0-9]"),
)


def query_features(queries: DataFrame, rules: Sequence[tuple[str, str]] = FEATURE_RULES) -> DataFrame:
    """(query_id, feature): the first rule that fits, else 'plain'."""
    feature = F.coalesce(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in rules], F.lit("plain"))
    return queries.select("query_id", feature.alias("feature"))


def required_evidence(cands: DataFrame, required: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """Per query: share of the required units found, whether all are, and forbidden ones found."""
    own = cands.select("query_id", "chunk_id").distinct()
    hit = required.select("query_id", "chunk_id").distinct().join(own.withColumn("found", F.lit(1)), ["query_id", "chunk_id"], "left")
    out = hit.groupBy("query_id").agg(F.count("*").alias("n_required"), F.coalesce(F.sum("found"), F.lit(0)).alias("n_found"))
    out = out.withColumns({"recall": F.col("n_found") / F.col("n_required"), "complete": F.col("n_found") == F.col("n_required")})
    if forbidden is None:
        return out
    bad = own.join(forbidden.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"]).groupBy("query_id").agg(F.count("*").alias("n_forbidden"))
    return out.join(bad, "query_id", "left").withColumn("n_forbidden", F.coalesce("n_forbidden", F.lit(0)))


# --- spans -------------------------------------------------------------------------------------------------------------


#: Start lines of spans that are merged in one task before the islands of a document meet.
MERGE_BLOCK = 4096


def _islands(spans: DataFrame, gap: int, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start_line", "end_line")
    reach = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("__new", F.when(F.col("start_line") > reach + 1 + gap, 1).when(reach.isNull(), 1).otherwise(0))
    rows = rows.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "__island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.sum("n_spans").alias("n_spans")).drop("__island")


def merge_spans(spans: DataFrame, gap: int = 0, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Line ranges (keys, start_line, end_line) of a document merged where at most ``gap`` lines lie between.

    Equal spans are counted first, then those that begin in one block of ``MERGE_BLOCK`` lines are merged; what meets in a
    document's last step are the islands of its blocks.
    """
    rows = spans.groupBy(*keys, "start_line", "end_line").agg(F.count("*").alias("n_spans"))
    rows = rows.withColumn("__block", F.floor(F.col("start_line") / MERGE_BLOCK))
    return _islands(_islands(rows, gap, [*keys, "__block"]).drop("__block"), gap, keys)


#: Widths of the bins of ``overlap_join``: a span belongs to the first that is as wide, so it lies in at most two of its bins.
BIN_WIDTHS = tuple(16**i for i in range(1, 15))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """All pairs of rows with equal ``keys`` whose inclusive spans of whole numbers overlap; both sides' columns, keys once.

    An equi-join on (keys, width, bin), so one document's spans are spread over tasks. Pairs meet at the wider one's bins: a span is put
    into at most two bins of its own width and of each wider one that the other side has. A pair counts in the first bin
    that both lie in. Spans that end before they begin, or with a null, overlap nothing. Both sides are read twice.
    """

    def level(span: tuple[str, str]) -> Column:
        length = F.col(span[1]).cast("long") - F.col(span[0]).cast("long") + 1
        return F.coalesce(*[F.when(length <= w, F.lit(w)) for w in BIN_WIDTHS], F.lit(BIN_WIDTHS[-1]))

    def present(df: DataFrame, span: tuple[str, str]) -> list[int]:
        # at most one row for each of the fourteen widths
        return sorted(r[0] for r in df.where(F.col(span[0]) <= F.col(span[1])).select(level(span).alias("w")).distinct().collect())

    def binned(df: DataFrame, span: tuple[str, str], own: str, others: list[int]) -> DataFrame:
        wider = F.filter(F.array(*[F.lit(w).cast("long") for w in others]), lambda w: w > F.col(own)) if others else F.array().cast("array<long>")
        rows = df.where(F.col(span[0]) <= F.col(span[1])).withColumn(own, level(span).cast("long"))
        rows = rows.withColumn("__w", F.explode(F.array_append(wider, F.col(own))))
        first, last = (F.floor(F.col(c).cast("long") / F.col("__w")) for c in span)
        return rows.withColumn("__bin", F.explode(F.sequence(first, last)))

    a = binned(left, left_span, "__lw", present(right, right_span))
    b = binned(right, right_span, "__rw", present(left, left_span))
    pairs = a.join(b, [*keys, "__w", "__bin"]).where(F.col("__w") == F.greatest("__lw", "__rw"))
    start = F.greatest(F.col(left_span[0]).cast("long"), F.col(right_span[0]).cast("long"))
    pairs = pairs.where((F.col("__bin") == F.floor(start / F.col("__w"))) & (F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(right_span[0]) <= F.col(left_span[1])))
    return pairs.drop("__w", "__bin", "__lw", "__rw")


def span_coverage(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """How chunks (doc_id, start_line, end_line) cover each gold span (gold_id, doc_id, start_line, end_line).

    Classes: contained (in one chunk), union, partial, none; with the best share of one chunk and the number of chunks.
    """
    g = gold.select("gold_id", "doc_id", F.col("start_line").alias("gs"), F.col("end_line").alias("ge"))
    parts = overlap_join(g, chunks.select("doc_id", "start_line", "end_line"), ["doc_id"], ("gs", "ge"), ("start_line", "end_line"))
    clipped = parts.select("gold_id", "gs", "ge", F.greatest("start_line", "gs").alias("start_line"), F.least("end_line", "ge").alias("end_line"))
    merged = merge_spans(clipped, 0, ["gold_id"]).groupBy("gold_id").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("covered"))
    best = clipped.groupBy("gold_id").agg(F.max(F.col("end_line") - F.col("start_line") + 1).alias("best"), F.count("*").alias("n_chunks"))
    out = g.join(best, "gold_id", "left").join(merged, "gold_id", "left")
    size = F.col("ge") - F.col("gs") + 1
    kind = F.when(F.col("best") == size, "contained").when(F.col("covered") == size, "union").when(F.col("covered") > 0, "partial").otherwise("none")
    return out.select("gold_id", kind.alias("coverage"), (F.coalesce("best", F.lit(0)) / size).alias("best_ratio"), (F.coalesce("n_chunks", F.lit(0)) > 1).alias("split"))


# --- comparison of runs ------------------------------------------------------------------------------------------------


def paired_transitions(hits: DataFrame, baseline: DataFrame) -> DataFrame:
    """(variant, transition, n) of hits (unit_id, variant, hit) against the baseline (unit_id, hit)."""
    joined = hits.join(baseline.select("unit_id", F.col("hit").alias("base")), "unit_id")
    name = F.concat(F.when(F.col("base"), "hit").otherwise("miss"), F.lit("->"), F.when(F.col("hit"), "hit").otherwise("miss"))
    return joined.groupBy("variant", name.alias("transition")).agg(F.count("*").alias("n"))


def complementarity(a: DataFrame, b: DataFrame, gold: DataFrame, segments: DataFrame, depths: Sequence[int] = (1, 5, 10, 20)) -> DataFrame:
    """By depth and segment (and over all, segment '*'): queries whose gold only a, only b, both or neither finds, and the union's recall."""
    first = gold.select("query_id").distinct()
    for name, rows in (("a", a), ("b", b)):
        hit = rows.join(gold.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias(f"first_{name}"))
        first = first.join(hit, "query_id", "left")
    rows = first.join(segments, "query_id").withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths])))
    x, y = (F.coalesce(F.col(f"first_{n}") <= F.col("depth"), F.lit(False)) for n in "ab")
    rows = rows.select("depth", "segment", x.alias("x"), y.alias("y"))
    n = lambda c: F.sum(c.cast("int"))
    out = rows.rollup("depth", "segment").agg(n(F.col("x") & ~F.col("y")).alias("only_a"), n(~F.col("x") & F.col("y")).alias("only_b"), n(F.col("x") & F.col("y")).alias("both"), n(~F.col("x") & ~F.col("y")).alias("neither"), F.count("*").alias("n"))
    return out.where("depth is not null").select("depth", F.coalesce("segment", F.lit("*")).alias("segment"), "only_a", "only_b", "both", "neither", (1 - F.col("neither") / F.col("n")).alias("union_recall"))


BUCKETS = ((1, 5), (6, 10), (11, 20), (21, 50), (51, 100))


def rank_buckets(ranks: DataFrame) -> DataFrame:
    """(bucket, n) of the best ranks (query_id, rank; null for absent); every bucket has a row."""
    name = F.coalesce(*[F.when(F.col("rank").between(a, b), F.lit(f"{a:03d}-{b:03d}")) for a, b in BUCKETS], F.when(F.col("rank") > 100, F.lit(">100")), F.lit("absent"))
    every = ranks.sparkSession.createDataFrame([(f"{a:03d}-{b:03d}",) for a, b in BUCKETS] + [(">100",), ("absent",)], "bucket string")
    return every.join(ranks.groupBy(name.alias("bucket")).agg(F.count("*").alias("n")), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def budget_curve(a: DataFrame, b: DataFrame, gold: DataFrame, depths: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Per candidate depth: mean, median, p95 and largest union of both lists, mean number of duplicates, recall of the union."""
    both = a.select("query_id", "chunk_id", "rank").unionByName(b.select("query_id", "chunk_id", "rank"))
    rows = both.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]))).where("rank <= depth")
    g = gold.select("query_id", "chunk_id", F.lit(1).alias("g")).distinct()
    per = rows.join(g, ["query_id", "chunk_id"], "left").groupBy("depth", "query_id").agg(F.count_distinct("chunk_id").alias("size"), F.count("*").alias("n"), F.max("g").alias("hit"))
    judged = gold.select("query_id").distinct().withColumn("judged", F.lit(1))
    out = per.join(judged, "query_id", "left").groupBy("depth").agg(
        F.avg("size").alias("mean_size"), nearest_rank("size", 0.5).alias("p50_size"), nearest_rank("size", 0.95).alias("p95_size"), F.max("size").alias("max_size"), F.avg(F.col("n") - F.col("size")).alias("mean_duplicates"),
        (F.sum(F.when(F.col("judged") == 1, F.coalesce("hit", F.lit(0)))) / F.sum("judged")).alias("union_recall"),
    )
    return out


def bootstrap_ci(rows: DataFrame, n: int = 1000, level: float = 0.95) -> DataFrame:
    """Confidence interval of the mean difference a - b of (unit index ``i`` from 0, a, b), by strided resamples.

    Resample r takes unit (i * (2 r + 1) + r) mod m for each i of the m units: fixed strides, no random numbers. So with
    g = gcd(2 r + 1, m) it draws each unit that is r modulo g g times and no other: sums by remainder are all that is needed, and
    they are added up in each task before the shuffle.
    """
    spark, m = rows.sparkSession, rows.count()
    steps = [(r, math.gcd(2 * r + 1, m)) for r in range(n)]
    resamples = spark.createDataFrame([(r, g, r % g) for r, g in steps], "r int, g int, remainder long")
    strides = F.array(*[F.lit(g) for g in sorted({g for _, g in steps})])
    sums = rows.select("i", (F.col("a") - F.col("b")).alias("d"), F.explode(strides).alias("g")).groupBy("g", F.pmod("i", "g").alias("remainder")).agg(F.sum("d").alias("total"))
    means = resamples.join(sums, ["g", "remainder"]).select("r", F.round(F.col("total") * F.col("g") / m, 12).alias("mean"))
    tail = (1 - level) / 2
    return means.agg(nearest_rank("mean", tail).alias("low"), nearest_rank("mean", 1 - tail).alias("high"), F.avg("mean").alias("center")).join(rows.agg(F.avg(F.col("a") - F.col("b")).alias("observed")))


def rank_correlation(a: DataFrame, b: DataFrame, k: int = 10, key: str = "chunk_id") -> DataFrame:
    """Per query: Spearman's correlation on common items (by their ranks among these) and the overlap at k."""
    common = a.select("query_id", key, F.col("rank").alias("ra")).join(b.select("query_id", key, F.col("rank").alias("rb")), ["query_id", key])
    w = Window.partitionBy("query_id")
    common = common.withColumns({"xa": F.row_number().over(w.orderBy("ra", key)), "xb": F.row_number().over(w.orderBy("rb", key))})
    out = common.groupBy("query_id").agg(F.count("*").alias("n"), F.sum((F.col("xa") - F.col("xb")) ** 2).alias("d2"), F.sum(((F.col("ra") <= k) & (F.col("rb") <= k)).cast("int")).alias("top"))
    rho = F.when(F.col("n") > 1, 1 - 6 * F.col("d2") / (F.col("n") * (F.col("n") * F.col("n") - 1)))
    return out.select("query_id", F.col("n").alias("n_common"), rho.alias("spearman"), (F.col("top") / k).alias("overlap_at_k"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per sample: what differs between two runs (sample_id, candidates array, evidence array, status, metric).

    ``changes`` lists missing_in_a, missing_in_b, candidates, evidence, status and metric, joined by commas ('' if nothing does).
    """
    x, y = (r.select("sample_id", *[F.col(c).alias(f"{n}_{c}") for c in ("candidates", "evidence", "status", "metric")], F.lit(True).alias(f"in_{n}")) for n, r in (("a", a), ("b", b)))
    j = x.join(y, "sample_id", "full_outer")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    parts = [F.when(F.col("in_a").isNull(), F.lit("missing_in_a")), F.when(F.col("in_b").isNull(), F.lit("missing_in_b"))]
    parts += [F.when(both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in ("candidates", "evidence", "status", "metric")]
    return j.select("sample_id", F.array_join(F.array_compact(F.array(*parts)), ",").alias("changes"))


def failure_attribution(samples: DataFrame) -> DataFrame:
    """The first failure class of each sample and all that apply, from ordered rules.

    ``samples``: sample_id, answerable, answered, n_candidates, gold_in_candidates, gold_in_evidence, cited, correct.
    """
    rules = (
        ("false_answer", ~F.col("answerable") & F.col("answered")), ("no_candidates", F.col("answerable") & (F.col("n_candidates") == 0)), ("retrieval_miss", F.col("answerable") & ~F.col("gold_in_candidates")),
        ("selection_miss", F.col("answerable") & F.col("gold_in_candidates") & ~F.col("gold_in_evidence")), ("false_abstention", F.col("answerable") & ~F.col("answered")),
        ("citation_missing", F.col("answered") & ~F.col("cited")), ("wrong_answer", F.col("answered") & ~F.col("correct")),
    )
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    return samples.select("sample_id", F.coalesce(F.try_element_at(flags, F.lit(1)), F.lit("none")).alias("primary"), F.array_join(flags, ",").alias("flags"))


def replicate_stability(runs: DataFrame) -> DataFrame:
    """Per sample over its replicates (sample_id, replicate, outcome): distinct outcomes, modal share, entropy (log2 over classes), first and last."""
    counts = runs.groupBy("sample_id", "outcome").agg(F.count("*").alias("n"), F.min("replicate").alias("lo"), F.max("replicate").alias("hi"))
    total = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("sample_id")))
    out = total.groupBy("sample_id").agg(F.count("*").alias("n_outcomes"), F.max("p").alias("modal_share"), F.sum(-F.col("p") * F.log2("p")).alias("h"), F.min_by("outcome", "lo").alias("first_outcome"), F.max_by("outcome", "hi").alias("last_outcome"))
    entropy = F.when(F.col("n_outcomes") > 1, F.col("h") / F.log2(F.col("n_outcomes").cast("double"))).otherwise(0.0)
    return out.select("sample_id", "n_outcomes", "modal_share", (F.col("n_outcomes") == 1).alias("stable"), entropy.alias("entropy"), "first_outcome", "last_outcome")


def set_jaccard(sets: DataFrame) -> DataFrame:
    """The mean Jaccard similarity of all pairs of runs of a sample (sample_id, run, items array); two empty sets are alike."""
    x = sets.select("sample_id", "run", F.array_distinct("items").alias("x"))
    y = sets.select("sample_id", F.col("run").alias("other"), F.array_distinct("items").alias("y"))
    union = F.size(F.array_union("x", "y"))
    pairs = x.join(y, "sample_id").where("run < other").select("sample_id", F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("x", "y")) / union).alias("j"))
    return pairs.groupBy("sample_id").agg(F.avg("j").alias("jaccard"), F.count("*").alias("n_pairs"))


# --- leakage -----------------------------------------------------------------------------------------------------------


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), "[^a-z0-9À-ÖØ-öø-ÿ]+", " "))


def leakage_scan(items: DataFrame, corpus: DataFrame, threshold: float = 0.82) -> DataFrame:
    """(item_id, doc_id, kind): items equal to a document, equal when normalized, or near it (token Jaccard of ``threshold`` or more).

    One pass over the corpus counts the documents of each token of an item, another looks each document's tokens and the digest of its
    normal form up among the items' keys; only documents that may be near are read again. An item's tokens stand in the order of
    their frequency, and the first n - ceil(threshold n) + 1 are looked up. The overlap of a pair is at most the number of
    those in common and all that follow, and only pairs for which that is enough for both sizes are verified. Null
    texts have no tokens and equal nothing.
    """
    words = lambda norm: F.filter(F.array_distinct(F.split(norm, " ")), lambda t: t != "")
    key = lambda norm: F.concat(F.lit("#"), F.sha2(norm, 256))
    i = items.select("item_id", "text", normalized(F.col("text")).alias("norm"))
    i = i.select("item_id", F.sha2("text", 256).alias("sha"), (F.col("norm") == "").alias("bare"), key(F.col("norm")).alias("key"), words(F.col("norm")).alias("x"))
    i = materialize(i.withColumn("ni", F.size("x")), "leakage-items")

    def keyed(docs: DataFrame) -> DataFrame:
        # every array has the digest at least, so that explode_outer makes the same rows and, unlike explode, no filter that splits the text anew
        d = docs.select("doc_id", F.col("text").alias("body"), normalized(F.col("text")).alias("norm_d"))
        return d.select("doc_id", "body", F.array_append(words(F.col("norm_d")), key(F.col("norm_d"))).alias("y")).withColumn("nd", F.size("y") - 1)

    own = keyed(corpus)
    asked = materialize(i.select("item_id", "ni", F.explode("x").alias("token")), "leakage-tokens")
    df = own.select(F.explode_outer("y").alias("token")).join(broadcast_if_few(asked.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    placed = asked.join(df, "token", "left").withColumn("p", F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "token")))
    first = placed.where(F.col("p") <= F.col("ni") - F.ceil(F.round(threshold * F.col("ni"), 9)) + 1).select("token", "item_id", "ni", F.lit(None).cast("string").alias("sha"), F.lit(None).cast("boolean").alias("bare"))
    probes = materialize(first.unionByName(i.select(F.col("key").alias("token"), "item_id", "ni", F.coalesce("sha", F.lit("")).alias("sha"), "bare")), "leakage-probes")

    fits = F.least("ni", "nd") >= threshold * F.greatest("ni", "nd")
    met = own.select("doc_id", "nd", "body", F.explode_outer("y").alias("token")).join(broadcast_if_few(probes), "token").where(F.col("sha").isNotNull() | fits)
    order = F.when(F.col("sha").isNotNull(), F.when(F.sha2("body", 256) == F.col("sha"), 0).when(~F.col("bare"), 1))
    pairs = met.select("item_id", "doc_id", "ni", "nd", order.alias("o"), F.col("sha").isNull().cast("int").alias("shared")).groupBy("item_id", "doc_id", "ni", "nd").agg(F.min("o").alias("o"), F.sum("shared").alias("shared"))
    most = F.col("shared") + F.ceil(F.round(threshold * F.col("ni"), 9)) - 1
    enough = (F.col("shared") > 0) & (most * (1 + threshold) >= threshold * (F.col("ni") + F.col("nd")) - 1e-6)
    pairs = materialize(pairs.where(F.col("o").isNotNull() | enough).select("item_id", "doc_id", "o"), "leakage-pairs")

    open_pairs = pairs.where("o is null").select("item_id", "doc_id").distinct()
    again = keyed(corpus.join(broadcast_if_few(open_pairs.select("doc_id").distinct()), "doc_id", "left_semi")).select("doc_id", "nd", "y")
    c = F.size(F.array_intersect("x", "y"))
    near = again.join(broadcast_if_few(open_pairs), "doc_id").join(broadcast_if_few(i.select("item_id", "x", "ni")), "item_id").where(c >= threshold * (F.col("ni") + F.col("nd") - c))
    best = pairs.where("o is not null").unionByName(near.select("item_id", "doc_id", F.lit(2).alias("o"))).groupBy("item_id", "doc_id").agg(F.min("o").alias("o"))
    return best.select("item_id", "doc_id", F.when(F.col("o") == 0, "exact").when(F.col("o") == 1, "normalized").otherwise("near").alias("kind"))


def containment_scan(items: DataFrame, docs: DataFrame, min_len: int = 12, words: int = 3) -> DataFrame:
    """(item_id, doc_id): items of ``min_len`` characters or more that stand verbatim in a document.

    Candidates share the item's rarest run of ``words`` inner words, or its longest inner word where it has fewer; inner words are
    those that no item boundary can cut. Items without one share their first characters with some place of the document. What is
    asked is broadcast if it is few enough, so that runs are made and matched where the document is read; every candidate is
    then verified on the whole texts.
    """
    ws = r"[ \t\r\n]+"

    def runs(array: Column) -> Column:
        # zipped with its own tails, so that the words are not split anew for every run
        joined = array
        for j in range(1, words):
            tail = F.slice(array, j + 1, F.greatest(F.size(array), F.lit(1)))
            joined = F.zip_with(joined, tail, lambda x, y: F.concat(x, F.lit(" "), y))
        return F.filter(joined, lambda x: x.isNotNull())

    long = items.where(F.length("text") >= min_len).select("item_id", "text")
    inner = F.filter(F.slice(F.split("text", ws), 2, F.greatest(F.size(F.split("text", ws)) - 2, F.lit(0))), lambda w: w != "")
    long = materialize(long.withColumn("inner", inner), "containment-items")
    split = F.filter(F.split("text", ws), lambda w: w != "")

    def found(asked: DataFrame, grams: Column) -> DataFrame:
        """Documents that hold what is asked (item_id, gram), by each item's rarest."""
        every = docs.select("doc_id", F.explode(F.array_distinct(grams)).alias("gram"))
        hits = materialize(every.join(broadcast_if_few(asked.select("gram").distinct()), "gram", "left_semi"), "containment-hits")
        rare = topk(asked.join(hits.groupBy("gram").agg(F.count("*").alias("df")), "gram", "left").withColumn("df", F.coalesce("df", F.lit(0))), ["item_id"], [F.asc("df"), F.asc("gram")], 1, "r").select("item_id", "gram")
        return rare.join(hits, "gram").select("item_id", "doc_id")

    pairs = found(materialize(long.where(F.size("inner") >= words).select("item_id", F.explode(F.array_distinct(runs(F.col("inner")))).alias("gram")), "containment-grams"), runs(split))
    some = long.where((F.size("inner") > 0) & (F.size("inner") < words)).select("item_id", F.array_max(F.transform("inner", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("gram"))
    if some.limit(1).count():
        pairs = pairs.unionByName(found(some, split))
    none = long.where(F.size("inner") == 0).select("item_id", F.left("text", F.lit(min_len)).alias("gram"))
    if none.limit(1).count():
        last = F.length("text") - min_len + 1
        places = F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(F.col("text"), i, F.lit(min_len)))).otherwise(F.array().cast("array<string>"))
        pairs = pairs.unionByName(found(none, places))
    asked = materialize(pairs.distinct().join(broadcast_if_few(long.select("item_id", "text")), "item_id"), "containment-pairs")
    return docs.select("doc_id", F.col("text").alias("body")).join(broadcast_if_few(asked), "doc_id").where(F.contains("body", "text")).select("item_id", "doc_id")


#: Kinds and patterns (fixed values), written so that Java and RE2 agree.
SECRET_RULES = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), ("cloud_key", r"AKIA[0-9A-Z]{16}"), ("assigned_secret", r"(?i)(?:token|password|secret|api_key)[ ]*[=:][ ]*[\"']?[A-Za-z0-9_+/-]{12,}"),
    ("database_url", r"(?i)(?:postgres|postgresql|mysql|mongodb)://[^ \t\r\n\"']+"), ("personal_path", r"(?:/home|/Users)/[A-Za-z0-9_.-]+"),
)
PLACEHOLDER = r"(?i)(example|placeholder|changeme|xxxx|your[_-])"


def secret_scan(docs: DataFrame, rules: Sequence[tuple[str, str]] = SECRET_RULES) -> DataFrame:
    """(doc_id, kind, ordinal, value_sha256, position) of secrets by rule; placeholders are left out. Position is 1-based, of the value's first occurrence."""

    def hits(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda v, i: F.struct(F.lit(name).alias("kind"), i.alias("ordinal"), v.alias("value")))

    found = F.flatten(F.array(*[hits(n, p) for n, p in rules]))
    rows = docs.where("text is not null").select("doc_id", "text", F.explode(found).alias("x")).where(~F.col("x.value").rlike(PLACEHOLDER))
    return rows.select("doc_id", "x.kind", F.col("x.ordinal").cast("long").alias("ordinal"), F.sha2("x.value", 256).alias("value_sha256"), F.expr("cast(instr(text, x.value) as bigint)").alias("position"))


def redact_text(docs: DataFrame, literals: Sequence[str] = (), rules: Sequence[tuple[str, str]] = SECRET_RULES, mask: str = "[REDACTED]") -> DataFrame:
    """(doc_id, text, n_replaced): literals first, then patterns."""
    text, n = F.coalesce("text", F.lit("")), F.lit(0)
    for lit in literals:
        n = n + (F.length(text) - F.length(F.replace(text, F.lit(lit), F.lit("")))) / len(lit)
        text = F.replace(text, F.lit(lit), F.lit(mask))
    rows = docs.select("doc_id", text.alias("text"), n.cast("int").alias("n_replaced"))
    for _, p in rules:
        rows = rows.select("doc_id", F.regexp_replace("text", p, mask).alias("text"), (F.col("n_replaced") + F.regexp_count("text", F.lit(p))).alias("n_replaced"))
    return rows


def text_fidelity(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Per document: share of the reference's tokens kept, missing ones, ones too many; tokens count with their multiplicity."""
    r, c = (d.select("doc_id", F.explode(tokens(F.col("text"))).alias("t")).groupBy("doc_id", "t").agg(F.count("*").alias(n)) for d, n in ((reference, "nr"), (candidate, "nc")))
    j = r.join(c, ["doc_id", "t"], "full_outer").na.fill(0, ["nr", "nc"])
    out = j.groupBy("doc_id").agg(F.sum(F.least("nr", "nc")).alias("kept"), F.sum("nr").alias("n_reference"), F.sum("nc").alias("n_candidate"))
    return out.select("doc_id", F.when(F.col("n_reference") > 0, F.col("kept") / F.col("n_reference")).otherwise(1.0).alias("retention"), (F.col("n_reference") - F.col("kept")).alias("n_omitted"), (F.col("n_candidate") - F.col("kept")).alias("n_added"))


def edit_counts(a: Sequence[str], b: Sequence[str]) -> tuple[int, int, int]:
    """(changed, omitted, added) of the tokens of ``a`` on the way to ``b``: as few as possible in all, and of such ways the one with the most changed.

    What both begin and end with is left aside. Of the table of prefixes only a band about the diagonal is computed, twice as wide each time until the way
    is shorter than the band, so time grows with the tokens by the differences and memory with the differences.
    """
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    n, m = len(a), len(b)
    if not n or not m:
        return 0, n, m
    ids: dict[str, int] = {}
    x, y = (np.fromiter((ids.setdefault(t, len(ids)) for t in s), np.int64, len(s)) for s in (a, b))
    # an omitted or added token weighs ``unit``, a changed one a little less, which all of them together don't make up for
    unit, never = n + m + 1, np.int64(1) << 60
    band = abs(n - m) + 16
    while True:
        places = np.arange(2 * band + 1)
        side = np.concatenate([np.full(band, -1), y, np.full(band + max(0, n - m) + 1, -1)])
        row = np.where((places >= band) & (places <= band + m), (places - band) * unit, never)
        for i in range(1, n + 1):
            new = row + np.where(side[i - 1 : i + 2 * band] == x[i - 1], 0, unit - 1)
            new[:-1] = np.minimum(new[:-1], row[1:] + unit)
            j = places + (i - band)
            new[(j < 0) | (j > m)] = never
            row = np.minimum.accumulate(new - places * unit) + places * unit
            row[(j < 0) | (j > m)] = never
        weight = int(row[m - n + band])
        steps = -(-weight // unit)
        if steps <= band:
            changed = unit * steps - weight
            return changed, (steps - changed + n - m) // 2, (steps - changed - n + m) // 2
        band *= 2


_NEVER = np.int64(-1) << 40


def _equal_ahead(x: np.ndarray, y: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """How many numbers from ``x[at]`` and ``y[to]`` on are equal, for each pair of places; windows grow while all of one is."""
    found, live, width = np.zeros(len(at), np.int64), np.flatnonzero(x[at] == y[to]), 8
    while len(live):
        steps = np.arange(width)
        same = x[(at[live] + found[live])[:, None] + steps] == y[(to[live] + found[live])[:, None] + steps]
        whole = same.all(axis=1)
        found[live] += np.where(whole, width, same.argmin(axis=1))
        live, width = live[whole], min(4 * width, _WINDOW)
    return found


#: Longest window in which tokens are compared, and so the room after the last text.
_WINDOW = 512


def _reach(x, y, docs, most, below, above, layers: int = 1, free: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``docs`` (columns: start and length in ``x``, start and length in ``y``, the longer one) the fewest steps, at most ``most``, and the layer.

    On every diagonal it is kept how far one gets with the steps made so far, from ``below`` the first diagonal to ``above`` the last one. A changed token stays on its
    diagonal, an added one goes one up, and an omitted one goes one down and one layer on (``free``: no layer on; without further layers, never). -1: not reached.
    """
    steps, layer = np.full(len(docs), -1), np.zeros(len(docs), np.int64)
    own = np.arange(len(docs))
    (xo, n, yo, m), most = docs.T, most.copy()
    gap = m - n
    below, above = np.minimum(below, n), np.minimum(above, n)
    # one empty place on each side of a text's diagonals
    width = below + gap + above + 3
    start = np.cumsum(width) - width
    text = np.repeat(own, width)
    k = np.arange(len(text)) - start[text] - 1 - below[text]
    edge = (k < -below[text]) | (k > (gap + above)[text])
    limit = np.where(edge, _NEVER, np.minimum(n[text], m[text] - k))
    far = np.full((layers, len(text)), _NEVER)
    last = start + 1 + below + gap
    origin = start + 1 + below
    far[0, origin] = _equal_ahead(x, y, xo, yo)
    e = 0
    while True:
        done = far[:, last] >= n
        hit = done.any(axis=0)
        steps[own[hit]], layer[own[hit]] = e, done.argmax(axis=0)[hit]
        over = hit | (e >= most)
        if over.any():
            # what is settled leaves the tables
            keep = ~over
            if not keep.any():
                return steps, layer
            cells = keep[text]
            far, k, limit, edge, number = far[:, cells], k[cells], limit[cells], edge[cells], np.cumsum(keep) - 1
            text = number[text[cells]]
            own, xo, n, yo, gap, most, width, below = (v[keep] for v in (own, xo, n, yo, gap, most, width, below))
            start = np.cumsum(width) - width
            last = start + 1 + below + gap
        e += 1
        new = np.minimum(far + 1, limit)
        up = far[:, :-1]
        new[:, 1:] = np.maximum(new[:, 1:], np.where(up > limit[1:], _NEVER, up))
        down = far[:, 1:] + 1
        down = np.where(down > limit[:-1], _NEVER, down)
        if free:
            new[:, :-1] = np.maximum(new[:, :-1], down)
        elif layers > 1:
            new[1:, :-1] = np.maximum(new[1:, :-1], down[:-1])
        # what is too far from the last diagonal for the steps left is passed over
        new[:, np.abs(k - gap[text]) > (most - e)[text]] = _NEVER
        new[:, edge] = _NEVER
        which, at = np.nonzero((new >= 0) & (new > far))
        i = new[which, at]
        new[which, at] = i + _equal_ahead(x, y, xo[text[at]] + i, yo[text[at]] + i + k[at])
        far = new


def edit_counts_of_many(x: np.ndarray, xn: np.ndarray, y: np.ndarray, yn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``edit_counts`` of many pairs of texts in step: numbers of the tokens one text after the other, and the texts' lengths.

    Of each pair: the fewest steps without a step back to a lower diagonal, whether fewer do with such steps, and if so, with how few of them; time grows with the tokens
    and with the square of the differences, not with their product. Pairs that need many steps back go through ``edit_counts``.
    """

    def laid_out(values: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        starts = np.cumsum(lengths + 1) - lengths - 1
        out = np.full(int((lengths + 1).sum()) + _WINDOW, end, np.int64)
        out[np.arange(len(values)) + np.repeat(np.arange(len(lengths)), lengths)] = values
        return out, starts

    # in one table, so that the shorter text of a pair can be the first; no end equals the other's
    table, starts = laid_out(np.concatenate((x, y)), np.concatenate((xn, yn)), -1)
    n_texts, swapped = len(xn), xn > yn
    other = table.copy()
    other[other < 0] = -2
    so, to = starts[:n_texts], starts[n_texts:]
    docs = np.column_stack((np.where(swapped, to, so), np.minimum(xn, yn), np.where(swapped, so, to), np.maximum(xn, yn))).astype(np.int64)
    gap = docs[:, 3] - docs[:, 1]
    nothing = np.zeros(n_texts, np.int64)

    def reach(which: np.ndarray, most: np.ndarray, below, above, **more) -> tuple[np.ndarray, np.ndarray]:
        return _reach(table, other, docs[which], most, below, above, **more) if len(which) else (nothing[:0], nothing[:0])

    every = np.arange(n_texts)
    # no way is shorter than the tokens of the longer text that the other one lacks
    text = np.concatenate((np.repeat(every, xn), np.repeat(every, yn)))
    kinds, place = np.unique(text * (1 + max(x.max(initial=0), y.max(initial=0))) + np.concatenate((x, y)), return_inverse=True)
    shared = np.minimum(np.bincount(place[: len(x)], minlength=len(kinds)), np.bincount(place[len(x) :], minlength=len(kinds)))
    of = np.zeros(len(kinds), np.int64)
    of[place] = text
    least = docs[:, 3] - np.bincount(of, shared, minlength=n_texts).astype(np.int64)
    bound = 2 * (gap + least) + 32
    steps, _ = reach(every, bound, nothing, nothing)
    back = np.where(steps >= 0, 0, -1)
    # a step back costs one more forward: only where there is room for both can it save any
    open_, most = np.flatnonzero((steps < 0) | (steps > np.maximum(least, gap + 2))), np.where(steps >= 0, steps - 1, np.maximum(2 * gap, least + least // 4) + 32)
    while len(open_):
        slack = (most[open_] - gap[open_]) // 2
        fewer, _ = reach(open_, most[open_], slack, slack, free=True)
        found = fewer >= 0
        steps[open_[found]], back[open_[found]] = fewer[found], -1
        open_ = open_[~found & (steps[open_] < 0)]
        most[open_] *= 4
    left, layers = np.flatnonzero(back < 0), 2
    while len(left):
        slow = layers * (gap + 2 * layers)[left] * steps[left] > 4 * docs[left, 1] * (2 * steps[left] + 1)
        for t in left[slow]:
            a, b = (table[docs[t, c] : docs[t, c] + docs[t, c + 1]].tolist() for c in (0, 2))
            back[t] = edit_counts(a, b)[1]
        left = left[~slow]
        room = np.full(len(left), layers - 1)
        got, layer = reach(left, steps[left], room, room, layers=layers)
        back[left[got >= 0]] = layer[got >= 0]
        left, layers = left[got < 0], 2 * layers
    forth = back + gap
    return steps - back - forth, np.where(swapped, forth, back), np.where(swapped, back, forth)


def text_corruption(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Per document (doc_id, text on both sides): tokens changed, omitted and added on the shortest way from one text to the other, and their share of the longer one.

    A text that is null or has no row is empty; two empty texts have the share 0. Ids that repeat are aligned row by row. Both sides are joined by document and
    aligned in the task, the texts of an Arrow batch in step; time grows with the square of the differences (``edit_counts_of_many``).
    """
    # texts are shuffled, not tokens, which take several times their space
    r, c = (d.select("doc_id", F.col("text").alias(n)) for d, n in ((reference, "r"), (candidate, "c")))
    pairs = r.join(c, "doc_id", "full_outer").select("doc_id", tokens(F.col("r")).alias("r"), tokens(F.col("c")).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = [pc.fill_null(pc.list_value_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2)]
            texts = pa.concat_arrays([batch.column(i).flatten() for i in (1, 2)])
            # whatever stands for a token is one for null, too
            ids = texts.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
            cut = int(lengths[0].sum())
            counts = edit_counts_of_many(ids[:cut], lengths[0], ids[cut:], lengths[1])
            share = sum(counts) / np.maximum(np.maximum(*lengths), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64()) for v in counts), pa.array(share, pa.float64())], ["doc_id", "n_changed", "n_omitted", "n_added", "corruption"])

    bound_batches(reference.sparkSession)
    kind = dict(reference.dtypes)["doc_id"]
    return pairs.mapInArrow(run, f"doc_id {kind}, n_changed long, n_omitted long, n_added long, corruption double")


def reading_order(snippets: DataFrame, texts: DataFrame) -> DataFrame:
    """Per document: the share of its snippets (doc_id, ordinal, snippet) that stand in the text in reading order.

    The longest increasing run of the snippets' offsets, by patience sorting; a group is one document's snippets.
    """
    found = snippets.join(texts, "doc_id").select("doc_id", "ordinal", F.expr("instr(text, snippet)").alias("at"))

    def longest(g: pd.DataFrame) -> pd.DataFrame:
        from bisect import bisect_left

        tails: list[int] = []
        for at in g.sort_values("ordinal")["at"]:
            if at > 0:
                k = bisect_left(tails, at)
                tails[k : k + 1] = [at]
        return pd.DataFrame({"doc_id": [g["doc_id"].iloc[0]], "order_fidelity": [len(tails) / len(g)]})

    return found.groupBy("doc_id").applyInPandas(longest, "doc_id long, order_fidelity double")


# --- answers, routing, monitoring -------------------------------------------------------------------------------------


def answer_scores(samples: DataFrame) -> DataFrame:
    """One row for each metric: numerator, denominator, rate.

    ``samples``: sample_id, expected (answer or abstain), action, required array, claimed array, cited array, available array.
    """
    ok_action = (F.col("expected") == F.col("action")).cast("int")
    answered = F.col("action") == "answer"
    parts = {
        "action_correct": (ok_action, F.lit(1)),
        "claims_complete": (F.when(answered & (F.size(F.array_except("required", "claimed")) == 0), 1).otherwise(0), F.when(answered, 1).otherwise(0)),
        "citations_valid": (F.when(answered & (F.size(F.array_except("cited", "available")) == 0), 1).otherwise(0), F.when(answered, 1).otherwise(0)),
        "cited": (F.when(answered & (F.size("cited") > 0), 1).otherwise(0), F.when(answered, 1).otherwise(0)),
        "false_answers": (F.when(answered & (F.col("expected") == "abstain"), 1).otherwise(0), F.when(F.col("expected") == "abstain", 1).otherwise(0)),
    }
    long = samples.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), a.alias("x"), b.alias("y")) for n, (a, b) in parts.items()])).alias("m")).select("m.*")
    out = long.groupBy("metric").agg(F.sum("x").alias("numerator"), F.sum("y").alias("denominator"))
    return out.withColumn("rate", F.when(F.col("denominator") > 0, F.col("numerator") / F.col("denominator")))


def router_scores(rows: DataFrame) -> DataFrame:
    """Per arm: precision, recall and F1 of activation (arm, activated, beneficial, before, after), net gain, regressions."""
    n = lambda c: F.sum(c.cast("int"))
    out = rows.groupBy("arm").agg(
        n(F.col("activated") & F.col("beneficial")).alias("tp"), n(F.col("activated")).alias("fired"), n(F.col("beneficial")).alias("wanted"),
        F.sum(F.when(F.col("activated"), F.col("after") - F.col("before")).otherwise(0)).alias("net_gain"), n(F.col("activated") & (F.col("after") < F.col("before"))).alias("n_regressions"),
    )
    p, r = F.when(F.col("fired") > 0, F.col("tp") / F.col("fired")).otherwise(0.0), F.when(F.col("wanted") > 0, F.col("tp") / F.col("wanted")).otherwise(0.0)
    out = out.withColumns({"precision": p, "recall": r})
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)).drop("tp", "fired", "wanted")


def exact_percentiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, one column for each share): nearest-rank percentiles of each group, exact at any size.

    Equal values are counted in each task first. The counts, now of different keys, are dealt by ranges of (by, value) and written with the
    number of their range, so a large group lies in many ranges of fair size. Running counts over a group's ranges, of which there
    are at most as many as shuffle partitions, tell which range holds a percentile, and only that one is looked through.
    """
    parts = shuffle_partitions(df.sparkSession)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    dealt = materialize(counts.repartitionByRange(parts, *by, value).withColumn("__range", F.spark_partition_id()), "percentiles")
    group = Window.partitionBy(*by)
    ranges = dealt.groupBy(*by, "__range").agg(F.sum("__n").alias("__in"))
    ranges = ranges.withColumns({"__upto": F.sum("__in").over(group.orderBy("__range")), "__all": F.sum("__in").over(group)})
    targets = {name: F.greatest(F.ceil(F.col("__all") * q), F.lit(1)) for name, q in shares.items()}
    # the rank that is looked for in this range, null where it lies in another
    wanted = [F.when((t > F.col("__upto") - F.col("__in")) & (t <= F.col("__upto")), t - F.col("__upto") + F.col("__in")).alias(f"__at_{name}") for name, t in targets.items()]
    ranges = ranges.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__range").alias("__kr"), *wanted)
    ranges = ranges.where(F.coalesce(*[F.col(f"__at_{name}") for name in shares]).isNotNull())
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)], F.col("__range") == F.col("__kr"))
    inside = dealt.join(ranges, same).withColumn("__run", F.sum("__n").over(Window.partitionBy(*by, "__range").orderBy(value)))
    return inside.groupBy(*by).agg(*[F.min(F.when(F.col("__run") >= F.col(f"__at_{name}"), F.col(value))).alias(name) for name in shares])


def latency_summary(df: DataFrame, by: Sequence[str], value: str = "latency_ms", exact: bool = True) -> DataFrame:
    """count, mean, p50, p95, p99, max and population deviation by group; percentiles are elements (nearest rank), not interpolated.

    ``exact=False`` takes approximate percentiles, to 1/10000 of the ranks, in one pass.
    """
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    rows = df.where(F.col(value).isNotNull())
    near = [] if exact else [F.percentile_approx(value, q, 10_000).alias(name) for name, q in shares.items()]
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.stddev_pop(value).alias("std"), *near)
    return out.join(exact_percentiles(rows, by, value, shares), list(by)) if exact else out


def stage_profile(traces: DataFrame) -> DataFrame:
    """Per pipeline stage of (request_id, stage, latency_ms): percentiles, share of the total, correlation with it, share of the slowest 5 %."""
    per = traces.where("latency_ms is not null").groupBy("request_id", "stage").agg(F.sum("latency_ms").alias("ms"))
    total = per.groupBy("request_id").agg(F.sum("ms").alias("total"))
    cut = total.agg(nearest_rank("total", 0.95).alias("cut"))
    rows = per.join(total, "request_id").join(F.broadcast(cut))
    slow = F.when(F.col("total") >= F.col("cut"), F.col("ms"))
    out = rows.groupBy("stage").agg(nearest_rank("ms", 0.5).alias("p50"), nearest_rank("ms", 0.95).alias("p95"), F.sum("ms").alias("sum_ms"), F.corr("ms", "total").alias("corr_total"), F.sum(slow).alias("slow_ms"))
    whole = total.agg(F.sum("total").alias("all_ms"))
    slow_all = total.join(F.broadcast(cut)).where("total >= cut").agg(F.sum("total").alias("slow_all"))
    return out.join(F.broadcast(whole)).join(F.broadcast(slow_all)).select("stage", "p50", "p95", (F.col("sum_ms").cast("double") / F.col("all_ms").cast("double")).alias("share"), "corr_total", (F.coalesce(F.col("slow_ms").cast("double"), F.lit(0.0)) / F.col("slow_all").cast("double")).alias("slow_share"))


def monitor_aggregates() -> list[Column]:
    """The measures of ``traffic_monitor``, for batches and streams alike."""
    return [
        F.count("*").alias("n_requests"), F.sum((F.col("event_type") == "error").cast("int")).alias("n_errors"), F.sum((F.col("event_type") == "purchase").cast("int")).alias("n_completed"),
        F.avg("value").alias("mean_value"), F.max("value").alias("max_value"),
    ]


def traffic_monitor(obs: DataFrame, release: str = "release", scope: str = "scope") -> DataFrame:
    """Requests, errors, completions and values by release and scope, with subtotals ('*')."""
    out = obs.rollup(release, scope).agg(*monitor_aggregates(), F.grouping_id().alias("g"))
    out = out.select(F.when(F.col("g") == 3, "*").otherwise(F.col(release)).alias("release"), F.when(F.col("g") >= 1, "*").otherwise(F.col(scope)).alias("scope"), "n_requests", "n_errors", "n_completed", "mean_value", "max_value")
    return out.withColumn("error_rate", F.col("n_errors") / F.col("n_requests"))


def monitor_counts(obs: DataFrame, by: Sequence[str | Column], safety: Sequence[str] = ()) -> DataFrame:
    """Requests of one terminal, by ``by``: n, fallbacks required and with success, summed latency with how many have one, and a sum of each safety counter.

    ``obs``: terminal, fallback_required, fallback_success, latency_ms, and the safety counters. Every column but ``terminal`` and ``by`` is a sum, so counts of parts add up to those of the
    whole: batches, windows of a stream and releases go through ``monitor_report`` alike. A null terminal is ``unknown``; null flags and counters are false and 0.
    """
    needed, done = F.coalesce("fallback_required", F.lit(False)), F.coalesce("fallback_success", F.lit(False))
    return obs.groupBy(*by, F.coalesce("terminal", F.lit("unknown")).alias("terminal")).agg(
        F.count("*").alias("n"), F.sum(needed.cast("long")).alias("n_required"), F.sum((needed & done).cast("long")).alias("n_success"), F.count("latency_ms").alias("n_timed"),
        F.coalesce(F.sum(F.col("latency_ms").cast("double")), F.lit(0.0)).alias("sum_ms"), *[F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0))).alias(c) for c in safety],
    )


def monitor_report(counts: DataFrame, by: Sequence[str], safety: Sequence[str] = ()) -> DataFrame:
    """Per ``by`` of ``monitor_counts``: n_requests, fallbacks and their rate of success (1 where none was required), mean latency (null without any), the distribution of
    terminals as a map in the order of their names, safety totals, and ``safe``: all of these are 0.

    Counts are summed by terminal first; what a group then holds is one entry for each terminal.
    """
    sums = ["n", "n_required", "n_success", "n_timed", "sum_ms", *safety]
    merged = counts.groupBy(*by, "terminal").agg(*[F.sum(c).alias(c) for c in sums])
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("terminal", "n")))).alias("terminals")
    out = merged.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums], entries)
    rate = F.when(F.col("n_required") > 0, F.col("n_success") / F.col("n_required")).otherwise(1.0)
    return out.select(
        *by, F.col("n").alias("n_requests"), F.col("n_required").alias("n_fallbacks"), F.col("n_success").alias("n_fallbacks_done"), rate.alias("fallback_rate"),
        F.when(F.col("n_timed") > 0, F.col("sum_ms") / F.col("n_timed")).alias("mean_ms"), "terminals", *safety, reduce(lambda x, y: x & y, [F.col(c) == 0 for c in safety], F.lit(True)).alias("safe"),
    )


def release_report(obs: DataFrame, safety: Sequence[str] = (), release: str = "release", scope: str = "scope") -> DataFrame:
    """``monitor_report`` by release and scope, by release, and of all, the subtotals as ``*``: observations are read and shuffled once, their counts are what is rolled up."""
    counts = monitor_counts(obs, [release, scope], safety)
    levels = F.array(*[F.struct(r.alias("r"), s.alias("s")) for r, s in ((F.col(release), F.col(scope)), (F.col(release), F.lit("*")), (F.lit("*"), F.lit("*")))])
    rolled = counts.withColumn("level", F.explode(levels)).withColumns({"release": F.col("level.r"), "scope": F.col("level.s")})
    return monitor_report(rolled, ["release", "scope"], safety)


def decision_stability(obs: DataFrame, keys: Sequence[str], signature: Sequence[str]) -> DataFrame:
    """Groups of equal input (keys) that were seen more than once, and how many different decisions (signature) they have."""
    out = obs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*signature)).alias("n_decisions"))
    return out.where("n > 1").withColumn("stable", F.col("n_decisions") == 1)


def drift_gates(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Adds ``drifts`` (metrics over their threshold, by name) and ``decision``: release, watch (one drift) or block."""
    flags = F.array_compact(F.array(*[F.when(F.col(m) > t, F.lit(m)) for m, t in sorted(thresholds.items())]))
    out = metrics.withColumn("drifts", F.array_join(flags, ","))
    return out.withColumn("decision", F.when(F.size(flags) == 0, "release").when(F.size(flags) == 1, "watch").otherwise("block"))


def evidence_rounds(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two retrieval rounds (query_id, doc_id, section_id, chunk_id, rank) in order of arrival: what each row brings.

    new_document, new_section, new_chunk, or duplicate of what came before.
    """
    rows = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    order = ["round", "rank", "chunk_id"]

    def nth(*keys: str) -> Column:
        return F.row_number().over(Window.partitionBy("query_id", *keys).orderBy(*order))

    kind = F.when(nth("chunk_id") > 1, "duplicate").when(nth("doc_id") == 1, "new_document").when(nth("doc_id", "section_id") == 1, "new_section").otherwise("new_chunk")
    return rows.select("query_id", "chunk_id", "round", "rank", kind.alias("gain"))


def evidence_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per query: common, new and removed rows, moves of rank, change of document diversity, and a class."""
    x = before.select("query_id", "chunk_id", F.col("doc_id").alias("da"), F.col("rank").alias("ra"))
    y = after.select("query_id", "chunk_id", F.col("doc_id").alias("db"), F.col("rank").alias("rb"))
    j = x.join(y, ["query_id", "chunk_id"], "full_outer")
    out = j.groupBy("query_id").agg(
        F.sum((F.col("ra").isNotNull() & F.col("rb").isNotNull()).cast("int")).alias("n_common"), F.sum(F.col("ra").isNull().cast("int")).alias("n_new"), F.sum(F.col("rb").isNull().cast("int")).alias("n_removed"),
        F.sum(F.coalesce((F.col("ra") != F.col("rb")).cast("int"), F.lit(0))).alias("n_moved"), (F.count_distinct("db") - F.count_distinct("da")).alias("diversity_change"),
    )
    kind = F.when(F.col("n_common") == 0, "replaced").when((F.col("n_new") == 0) & (F.col("n_removed") == 0), F.when(F.col("n_moved") == 0, "unchanged").otherwise("reordered")).when(F.col("n_removed") == 0, "extended").when(F.col("n_new") == 0, "reduced").otherwise("mixed")
    return out.withColumn("outcome", kind)
