"""Change detection, sync planning, staleness, drift and freshness of an indexed corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first(*rules: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds."""
    return F.coalesce(*[F.when(c, F.lit(n)) for c, n in rules], F.lit(otherwise) if otherwise is not None else F.lit(None).cast("string"))


def detect_changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, change_type) from two snapshots (path, content_hash): added, modified, unchanged, deleted."""
    c = current.select("path", F.col("content_hash").alias("new"), F.lit(True).alias("in_new"))
    p = previous.select("path", F.col("content_hash").alias("old"), F.lit(True).alias("in_old"))
    j = c.join(p, "path", "full_outer")
    return j.select("path", _first((F.col("in_old").isNull(), "added"), (F.col("in_new").isNull(), "deleted"), (~F.col("old").eqNullSafe(F.col("new")), "modified"), otherwise="unchanged").alias("change_type"))


def sync_plan(changes: DataFrame, states: DataFrame, failures: DataFrame, parser_version: str, chunking_version: str) -> DataFrame:
    """(path, action) of every path: create, update, restore, retry, reprocess, skip, delete, keep.

    ``states``: path, index_status, parser_version, chunking_version; ``failures``: path, stage. A failed discovery suppresses all
    deletions; a path that failed itself is kept as it is.
    """
    blocked = failures.agg(F.coalesce(F.max((F.col("stage") == "discover").cast("int")), F.lit(0)).alias("blocked"))
    own = failures.where("stage <> 'discover'").select("path", F.lit(True).alias("failed")).distinct()
    j = changes.join(states, "path", "left").join(own, "path", "left").join(F.broadcast(blocked))
    kind, status = F.col("change_type"), F.coalesce("index_status", F.lit("none"))
    action = _first(
        (F.col("failed").isNotNull(), "keep"), ((kind == "deleted") & (status == "deleted"), "skip"), ((kind == "deleted") & (F.col("blocked") == 1), "keep"), (kind == "deleted", "delete"),
        (status == "deleted", "restore"), (kind == "added", "create"), (kind == "modified", "update"), (status == "failed", "retry"),
        (~F.col("parser_version").eqNullSafe(F.lit(parser_version)) | ~F.col("chunking_version").eqNullSafe(F.lit(chunking_version)), "reprocess"), otherwise="skip",
    )
    return j.select("path", action.alias("action"))


def run_summary(plan: DataFrame) -> DataFrame:
    """One row of counters over the actions of a run."""
    n = lambda *names: F.sum(F.col("action").isin(*names).cast("int"))
    return plan.agg(F.count("*").alias("discovered"), n("create", "restore").alias("created"), n("update", "reprocess", "retry").alias("updated"), n("delete").alias("deleted"), n("skip").alias("skipped"), n("keep").alias("failed"))


def purge_deleted(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks without those of deleted documents and of documents that are gone."""
    return chunks.join(docs.where("index_status <> 'deleted'").select("doc_id"), "doc_id", "left_semi")


def stale_embeddings(chunks: DataFrame, inputs: DataFrame, model: str, dimension: int) -> DataFrame:
    """(chunk_id, reason) of chunks to embed: missing, model, dimension, input or invalid.

    ``chunks``: chunk_id, embedding, embedding_model, input_hash; ``inputs``: chunk_id, input_hash as it should be.
    """
    j = chunks.join(inputs.select("chunk_id", F.col("input_hash").alias("want")), "chunk_id")
    v = F.col("embedding")
    reason = _first(
        (v.isNull(), "missing"), (~F.col("embedding_model").eqNullSafe(F.lit(model)), "model"), (F.size(v) != dimension, "dimension"), (~F.col("input_hash").eqNullSafe(F.col("want")), "input"),
        (F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "invalid"),
    )
    return j.select("chunk_id", reason.alias("reason")).where("reason is not null")


def lexical_staleness(chunks: DataFrame, stats: DataFrame, terms: DataFrame, fingerprint: str) -> DataFrame:
    """(chunk_id, reason) of chunks to tokenize again: no_stats, fingerprint, empty or mismatch (sum of tf against the stored length)."""
    sums = terms.groupBy("chunk_id").agg(F.sum("tf").alias("total"))
    j = chunks.select("chunk_id").join(stats.select("chunk_id", "document_length", "fingerprint"), "chunk_id", "left").join(sums, "chunk_id", "left")
    reason = _first(
        (F.col("document_length").isNull(), "no_stats"), (~F.col("fingerprint").eqNullSafe(F.lit(fingerprint)), "fingerprint"), (F.col("document_length") <= 0, "empty"), (~F.col("total").eqNullSafe(F.col("document_length")), "mismatch"),
    )
    return j.select("chunk_id", reason.alias("reason")).where("reason is not null")


def lexical_readiness(chunks: DataFrame, stats: DataFrame, terms: DataFrame, corpus: DataFrame, fingerprint: str) -> DataFrame:
    """One row for each kb: expected, indexed, stale, whether the corpus row agrees, and ready."""
    stale = lexical_staleness(chunks, stats, terms, fingerprint).select("chunk_id", F.lit(1).alias("stale"))
    j = chunks.select("kb_id", "chunk_id").join(stats.select("chunk_id", "document_length"), "chunk_id", "left").join(stale, "chunk_id", "left")
    g = j.groupBy("kb_id").agg(F.count("*").alias("n_expected"), F.count("document_length").alias("n_indexed"), F.coalesce(F.sum("stale"), F.lit(0)).alias("n_stale"), F.coalesce(F.sum("document_length"), F.lit(0)).alias("length"))
    g = g.join(corpus.select("kb_id", "n_chunks", "total_length"), "kb_id", "left")
    same = F.coalesce((F.col("n_chunks") == F.col("n_indexed")) & (F.col("total_length") == F.col("length")), F.lit(False))
    return g.select("kb_id", "n_expected", "n_indexed", "n_stale", same.alias("corpus_ok"), ((F.col("n_expected") == F.col("n_indexed")) & (F.col("n_stale") == 0) & same).alias("ready"))


#: Kind of drift, its risk and the action (fixed values).
DRIFT_CONTRACT = (
    ("missing_document", "high", "index"), ("duplicate_document", "medium", "deduplicate"), ("stale_content", "high", "reindex"), ("unexpected_document", "medium", "remove"), ("residual_deleted", "high", "purge"),
    ("not_active", "low", "activate"), ("chunk_count", "medium", "rechunk"), ("missing_embedding", "medium", "embed"), ("embedding_size", "high", "embed"), ("orphan_chunk", "high", "purge"),
)


def corpus_drift(source: DataFrame, docs: DataFrame, chunks: DataFrame, dimension: int) -> DataFrame:
    """Issues (doc_id, issue, risk, action) between a source (doc_id, content_hash, n_chunks) and an index.

    ``docs``: doc_id, content_hash, index_status (a doc_id may repeat); ``chunks``: chunk_id, doc_id, embedding.
    """
    d = docs.groupBy("doc_id").agg(F.count("*").alias("copies"), F.max("content_hash").alias("have"), F.max("index_status").alias("status"))
    c = chunks.groupBy("doc_id").agg(F.count("*").alias("n_have"), F.sum(F.col("embedding").isNull().cast("int")).alias("n_null"), F.sum(F.coalesce((F.size("embedding") != dimension) & F.col("embedding").isNotNull(), F.lit(False)).cast("int")).alias("n_size"))
    s = source.select("doc_id", F.col("content_hash").alias("want"), "n_chunks")
    j = s.join(d, "doc_id", "full_outer").join(c, "doc_id", "full_outer")
    live = F.coalesce(F.col("status") != "deleted", F.lit(False))
    rules = [
        (F.col("want").isNotNull() & F.col("status").isNull(), "missing_document"), (F.col("copies") > 1, "duplicate_document"), (F.col("want").isNotNull() & live & (F.col("want") != F.col("have")), "stale_content"),
        (F.col("want").isNull() & live, "unexpected_document"), (F.col("want").isNull() & (F.col("status") == "deleted") & (F.col("n_have") > 0), "residual_deleted"), (F.col("want").isNotNull() & live & (F.col("status") != "indexed"), "not_active"),
        (F.col("want").isNotNull() & live & (F.coalesce("n_have", F.lit(0)) != F.col("n_chunks")), "chunk_count"), (live & (F.col("n_null") > 0), "missing_embedding"), (live & (F.col("n_size") > 0), "embedding_size"), (F.col("status").isNull() & (F.col("n_have") > 0), "orphan_chunk"),
    ]
    issues = j.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))).alias("issue"))
    contract = source.sparkSession.createDataFrame(list(DRIFT_CONTRACT), "issue string, risk string, action string")
    return issues.join(F.broadcast(contract), "issue").select("doc_id", "issue", "risk", "action")


def chunk_boundary_audit(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per document: chunks expected and found, positions that differ, and the fields that do.

    Both: doc_id, chunk_index, content_hash, start_line, end_line.
    """
    fields = ("content_hash", "start_line", "end_line")
    e = expected.select("doc_id", "chunk_index", *[F.col(f).alias(f"e_{f}") for f in fields], F.lit(1).alias("e"))
    a = actual.select("doc_id", "chunk_index", *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(1).alias("a"))
    j = e.join(a, ["doc_id", "chunk_index"], "full_outer")
    both = F.col("e").isNotNull() & F.col("a").isNotNull()
    changed = F.array_compact(F.array(*[F.when(both & ~F.col(f"e_{f}").eqNullSafe(F.col(f"a_{f}")), F.lit(f)) for f in fields]))
    g = j.select("doc_id", "e", "a", changed.alias("changed")).groupBy("doc_id").agg(
        F.count("e").alias("n_expected"), F.count("a").alias("n_actual"), F.sum((F.size("changed") > 0).cast("int")).alias("n_changed"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("changed")))).alias("fields"))
    return g.select("doc_id", "n_expected", "n_actual", "n_changed", F.array_join("fields", ",").alias("fields"), (F.col("n_expected") != F.col("n_actual")).alias("count_mismatch"))


def snapshot_delta(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(source_id, delta) between two revisions (source_id, canonical_id, content_hash): added, removed, identity_changed, content_changed, unchanged; moved if a canonical id turns up under another source."""
    p, c = (d.select("source_id", F.col("canonical_id").alias(f"{n}_id"), F.col("content_hash").alias(f"{n}_hash")) for n, d in (("p", previous), ("c", current)))
    other = previous.select(F.col("canonical_id").alias("c_id"), F.lit(True).alias("was")).distinct()
    j = p.join(c, "source_id", "full_outer").join(other, "c_id", "left")
    kind = _first(
        (F.col("p_id").isNull() & F.col("was").isNotNull(), "moved"), (F.col("p_id").isNull(), "added"), (F.col("c_id").isNull(), "removed"), (F.col("p_id") != F.col("c_id"), "identity_changed"), (~F.col("p_hash").eqNullSafe(F.col("c_hash")), "content_changed"), otherwise="unchanged",
    )
    return j.select("source_id", kind.alias("delta"))


def graph_freshness(bindings: DataFrame, corpus: DataFrame) -> DataFrame:
    """(graph_id, freshness, reason): a derived graph (graph_id, corpus_id, revision, digest) against the corpus (corpus_id, revision, digest)."""
    c = corpus.select("corpus_id", F.col("revision").alias("now"), F.col("digest").alias("now_digest"))
    j = bindings.join(c, "corpus_id", "left")
    reason = _first(
        (F.col("revision").isNull() | F.col("digest").isNull(), "binding_incomplete"), (F.col("now").isNull(), "corpus_unknown"), (F.col("revision") > F.col("now"), "revision_ahead"), (F.col("revision") < F.col("now"), "revision_behind"),
        (F.col("digest") != F.col("now_digest"), "digest_differs"), otherwise="current",
    )
    state = F.when(reason == "current", "fresh").when(reason.isin("binding_incomplete", "corpus_unknown"), "unassessable").when(reason.isin("revision_ahead", "digest_differs"), "invalid").otherwise("stale")
    return j.select("graph_id", state.alias("freshness"), reason.alias("reason"))


def graph_impact(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """(edge_id, impact, secondary): what a delta of documents (doc_id, delta) asks of each edge (edge_id, source_id, target_id).

    remove, rebind, revalidate, recheck or none; secondary edges aren't touched themselves but share a node with one that is.
    """
    s, t = (changes.select(F.col("doc_id").alias(f"{n}_id"), F.col("delta").alias(f"{n}_delta")) for n in ("source", "target"))
    j = edges.join(s, "source_id", "left").join(t, "target_id", "left")
    either = lambda v: F.coalesce((F.col("source_delta") == v) | (F.col("target_delta") == v), F.col("source_delta") == v, F.col("target_delta") == v, F.lit(False))
    j = j.withColumn("impact", _first((either("removed"), "remove"), (either("identity_changed"), "rebind"), (F.coalesce(F.col("source_delta") == "content_changed", F.lit(False)), "revalidate"), (F.coalesce(F.col("target_delta") == "content_changed", F.lit(False)), "recheck"), otherwise="none"))
    hit = j.where("impact <> 'none'")
    nodes = hit.select(F.col("source_id").alias("n")).unionByName(hit.select(F.col("target_id").alias("n"))).distinct()
    near = j.where("impact = 'none'").select("edge_id", F.explode(F.array("source_id", "target_id")).alias("n")).join(nodes, "n").select("edge_id", F.lit(True).alias("near")).distinct()
    return j.join(near, "edge_id", "left").select("edge_id", "impact", F.coalesce("near", F.lit(False)).alias("secondary"))
