"""Lexical index and BM25: tokens, postings, document frequencies, corpus statistics, their maintenance, and top-k."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrygrid.common import FEW_ROWS, bound_batches, broadcast_if_few, drop_scratch, materialize, spread_if_small, topk

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[a-z0-9À-ÖØ-öø-ÿ]+"
#: A flag, or a word, also of parts joined by dots, underscores, slashes or hyphens: emitted whole, and its parts as well.
TECHNICAL = f"--[a-z0-9][a-z0-9-]*|{WORD}(?:[._/-]{WORD})*"
SEPARATOR = "[._/-]"
#: The same for Java: no run is given back, so that a match of any length needs no stack.
POSSESSIVE = f"--[a-z0-9][a-z0-9-]*+|{WORD}+(?:{SEPARATOR}{WORD}+)*+"
#: Particles that are no tokens (fixed values); they only come from a segmenter.
STOP_WORDS = ("的", "了", "和", "与", "及", "或", "在")
#: Characters that compatibility normalization leaves as they are, so that texts of nothing else need no normalizer.
STABLE = r"^[\x00-\x7FÀ-ÖØ-öø-ÿ–—‘’“”€]*$"
K1, B = 1.2, 0.75
MAX_K = 100
DIGITS = 9  # scores are rounded before they are ranked, so that ties don't depend on the order of a sum

_TECHNICAL, _SEPARATOR, _JOINT, _STABLE = (re.compile(p) for p in (TECHNICAL, f"{SEPARATOR}+", "[/.]+", STABLE))
_ASCII_LOWER = str.maketrans(UPPER, LOWER)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def tokens(text: Column) -> Column:
    """The token array of a short text (Latin path) as a column expression; null gives an empty array. Whole corpora go through ``counted_terms``.

    All tokens in order, whole, and after them for each joined one its joined parts after a slash or dot and its single parts, each once.
    """

    def inner(t: Column) -> Column:
        parts = F.filter(F.split(t, f"{SEPARATOR}+"), lambda p: p != "")
        joined = F.filter(F.split(t, "[/.]+"), lambda p, i: (i > 0) & (F.contains(p, F.lit("_")) | F.contains(p, F.lit("-"))))
        return F.array_distinct(F.concat(joined, parts))

    low = ascii_lower(F.coalesce(text, F.lit("")))
    found = F.regexp_extract_all(low, F.lit(POSSESSIVE), F.lit(0))
    return F.flatten(F.transform(F.array(found), lambda f: F.concat(f, F.flatten(F.transform(F.filter(f, lambda t: F.translate(t, "._/-", "") != t), inner)))))


def text_tokens(text: str) -> list[str]:
    """``tokens`` of a normalized text inside an Arrow task: the same tokens in the same order."""
    found = _TECHNICAL.findall(text.translate(_ASCII_LOWER))
    parts: list[str] = []
    for t in found:
        if not t.isalnum():  # word characters are all letters or digits, but for the signs between them
            joined = [p for p in _JOINT.split(t)[1:] if "_" in p or "-" in p]
            parts += dict.fromkeys(joined + [p for p in _SEPARATOR.split(t) if p])
    return found + parts


def nfkc(column):
    """The normalizer for compatibility characters."""
    import unicodedata

    return column.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def character_bigrams(column):
    """A segmenter for scripts without spaces: pairs of neighbouring characters that are not ASCII; single ones stay alone."""
    import re

    def cut(t: str | None) -> list[str]:
        out = []
        for run in re.findall(r"[^\x00-\x7f]+", t or ""):
            out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
        return out

    return column.map(cut)


def _tokenized(texts: pa.Array, normalizer: Callable | None, segmenter: Callable | None) -> Iterator[list[str]]:
    """The tokens of each text of an Arrow column, and after them what ``segmenter`` cuts from what is no Latin token.

    Only texts with a character outside of ``STABLE`` pass through the normalizer.
    """
    shown = ["" if t is None else t for t in texts.to_pylist()]
    if normalizer is not None:
        odd = [i for i, t in enumerate(shown) if not t.isascii() and not _STABLE.match(t)]
        for i, t in zip(odd, normalizer(pd.Series([shown[i] for i in odd], dtype=object)), strict=True):
            shown[i] = t
    if segmenter is None:
        yield from map(text_tokens, shown)
        return
    rest = segmenter(pd.Series([_TECHNICAL.sub(" ", t.translate(_ASCII_LOWER)) for t in shown], dtype=object))
    for t, own in zip(shown, rest, strict=True):
        yield text_tokens(t) + [x for x in own if x not in STOP_WORDS]


def with_tokens(df: DataFrame, text: Column, out: str, normalizer=nfkc, segmenter=None) -> DataFrame:
    """``df`` with the tokens of ``text``, in one pass."""

    @F.pandas_udf("array<string>")
    def cut(column: pd.Series) -> pd.Series:
        return pd.Series(list(_tokenized(pa.array(column, pa.string()), normalizer, segmenter)), dtype=object)

    return df.withColumn(out, cut(F.coalesce(text, F.lit(""))))


def tokenize_text(df: DataFrame, col: str = "text", out: str = "tokens", normalizer=nfkc, segmenter=None) -> DataFrame:
    """Adds the token array. ``normalizer`` (Series -> Series of str) and ``segmenter`` (Series -> Series of lists, e.g. character
    n-grams) are Arrow-batched hooks; ``None`` keeps a text as it is. Every operator of this module takes them.
    """
    return with_tokens(df, F.col(col), out, normalizer, segmenter)


def counted_terms(df: DataFrame, key: str, text: Column, normalizer=nfkc, segmenter=None, terms: DataFrame | None = None) -> DataFrame:
    """(kb_id, key, document_length, terms, counts) of every row: how many tokens its text has, and its distinct terms with their counts.

    A text is tokenized once, where it is read, and nothing is shuffled. With ``terms`` (kb_id, term) only those are listed, if they are few enough
    to be broadcast (``broadcast_if_few``); the length counts all.
    """
    bound_batches(df.sparkSession)
    wanted = None
    if terms is not None:
        asked = materialize(terms.select("kb_id", "term").distinct(), "lexical-terms")
        if broadcast_if_few(asked) is not asked:
            by: dict[str, set[str]] = {}
            for kb, names in asked.groupBy("kb_id").agg(F.collect_list("term")).collect():
                by[kb] = set(names)
            wanted = df.sparkSession.sparkContext.broadcast(by)
        drop_scratch(df.sparkSession, asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kbs = batch.column(0).to_pylist()
            sizes, ends, names, counts = [], [0], [], []
            for kb, found in zip(kbs, _tokenized(batch.column(2), normalizer, segmenter), strict=True):
                sizes.append(len(found))
                if wanted is not None:
                    own = wanted.value.get(kb, ())
                    found = [t for t in found if t in own]
                held = Counter(found)
                names += held.keys()
                counts += held.values()
                ends.append(len(names))
            bounds = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(v, k)) for v, k in ((names, pa.string()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *lists], ["kb_id", key, "document_length", "terms", "counts"])

    rows = spread_if_small(df.select("kb_id", key, F.coalesce(text, F.lit("")).alias("__text")))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("kb_id", key)]
    return rows.mapInArrow(run, f"kb_id {kinds[0]}, {key} {kinds[1]}, document_length long, terms array<string>, counts array<long>")


def chunk_terms(chunks: DataFrame, normalizer=nfkc, segmenter=None, terms: DataFrame | None = None) -> DataFrame:
    """``counted_terms`` of chunks (kb_id, chunk_id, heading_path, content)."""
    heading = F.concat_ws(" ", "heading_path") if "heading_path" in chunks.columns else F.lit("")
    return counted_terms(chunks, "chunk_id", F.concat_ws("\n", heading, F.coalesce("content", F.lit(""))), normalizer, segmenter, terms)


def postings_of(counted: DataFrame) -> DataFrame:
    """Postings (kb_id, chunk_id, term, tf, document_length) of a table of ``chunk_terms``."""
    pairs = counted.select("kb_id", "chunk_id", "document_length", F.explode(F.arrays_zip("terms", "counts")).alias("p"))
    return pairs.select("kb_id", "chunk_id", F.col("p.terms").alias("term"), F.col("p.counts").alias("tf"), "document_length")


def term_frequencies(chunks: DataFrame, normalizer=nfkc, segmenter=None, terms: DataFrame | None = None) -> DataFrame:
    """Postings (kb_id, chunk_id, term, tf, document_length) of chunks (kb_id, chunk_id, heading_path, content); chunks without tokens have none.

    With ``terms`` (kb_id, term) only the postings of those; the length still counts all tokens.
    """
    found = postings_of(chunk_terms(chunks, normalizer, segmenter, terms))
    return found if terms is None else found.join(broadcast_if_few(terms.select("kb_id", "term").distinct()), ["kb_id", "term"], "left_semi")


def chunk_lengths(chunks: DataFrame, normalizer=nfkc, segmenter=None) -> DataFrame:
    """(kb_id, chunk_id, document_length) of chunks that have tokens, counted in place."""
    return chunk_terms(chunks, normalizer, segmenter).select("kb_id", "chunk_id", "document_length").where("document_length > 0")


def chunk_statistics(postings: DataFrame) -> DataFrame:
    """(kb_id, chunk_id, document_length)."""
    return postings.groupBy("kb_id", "chunk_id").agg(F.sum("tf").alias("document_length"))


def document_frequencies(postings: DataFrame, stats: DataFrame | None = None, fingerprint: str | None = None) -> DataFrame:
    """(kb_id, term, df), of chunks with the current tokenizer fingerprint where ``stats`` holds one."""
    if stats is not None and fingerprint is not None:
        postings = postings.join(stats.where(F.col("fingerprint") == fingerprint).select("kb_id", "chunk_id"), ["kb_id", "chunk_id"], "left_semi")
    return postings.groupBy("kb_id", "term").agg(F.count("*").alias("df"))


def corpus_statistics(stats: DataFrame) -> DataFrame:
    """(kb_id, n_chunks, total_length, avg_length)."""
    return stats.groupBy("kb_id").agg(F.count("*").alias("n_chunks"), F.sum("document_length").alias("total_length"), F.avg("document_length").alias("avg_length"))


def lexical_delta(df: DataFrame, corpus: DataFrame, added: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New document frequencies and corpus statistics after postings were added and removed, without reading the other postings."""

    def signed(postings: DataFrame, sign: int) -> DataFrame:
        return document_frequencies(postings).withColumn("df", F.col("df") * sign)

    frequencies = df.unionByName(signed(added, 1)).unionByName(signed(removed, -1)).groupBy("kb_id", "term").agg(F.sum("df").alias("df")).where("df > 0")

    def totals(postings: DataFrame, sign: int) -> DataFrame:
        return chunk_statistics(postings).groupBy("kb_id").agg((F.count("*") * sign).alias("n_chunks"), (F.sum("document_length") * sign).alias("total_length"))

    sums = corpus.select("kb_id", "n_chunks", "total_length").unionByName(totals(added, 1)).unionByName(totals(removed, -1))
    sums = sums.groupBy("kb_id").agg(F.sum("n_chunks").alias("n_chunks"), F.sum("total_length").alias("total_length")).where("n_chunks > 0")
    return frequencies, sums.withColumn("avg_length", F.col("total_length") / F.col("n_chunks"))


def query_terms(queries: DataFrame, normalizer=nfkc, segmenter=None) -> DataFrame:
    """Distinct terms (query_id, kb_id, term, qtf) of queries (query_id, kb_id, text)."""
    counted = counted_terms(queries, "query_id", F.col("text"), normalizer, segmenter)
    pairs = counted.select("query_id", "kb_id", F.explode(F.arrays_zip("terms", "counts")).alias("p")).select("query_id", "kb_id", F.col("p.terms").alias("term"), F.col("p.counts").alias("qtf"))
    return pairs.groupBy("query_id", "kb_id", "term").agg(F.sum("qtf").alias("qtf"))


class Index:
    """Chunks with their terms, and what BM25 needs of the corpus.

    ``chunks``: kb_id, chunk_id, document_length, terms, counts of chunks that have tokens; ``corpus``: as ``corpus_statistics``; ``df``: kb_id, term, df.
    """

    def __init__(self, chunks: DataFrame, corpus: DataFrame, df: DataFrame):
        self.chunks, self.corpus, self.df = chunks, corpus, df


def build_index(chunks: DataFrame, terms: DataFrame | None = None, normalizer=nfkc, segmenter=None) -> Index:
    """The index of chunks (kb_id, chunk_id, heading_path, content), whose texts are tokenized once; with ``terms`` only what concerns them."""
    held = materialize(chunk_terms(chunks, normalizer, segmenter, terms).where("document_length > 0"), "bm25-terms")
    df = held.select("kb_id", F.explode("terms").alias("term")).groupBy("kb_id", "term").agg(F.count("*").alias("df"))
    return Index(held, materialize(corpus_statistics(held), "bm25-corpus"), materialize(df, "bm25-df"))


#: Scores that a task holds in one table, and the pairs of postings and queries that it adds up at a time.
CELLS, PAIRS = 4_000_000, 4_000_000
#: Slack of the bounds, as sums of the same numbers may differ in their last places and scores are rounded.
SLACK = 1e-6


class Asked:
    """The queries of one kb as a sparse table: which queries ask for a term, and with what weight."""

    def __init__(self, rows: pd.DataFrame, average: float):
        self.average = average
        self.names, term = np.unique(rows["term"].to_numpy(object), return_inverse=True)
        query, self.queries = pd.factorize(rows["query_id"], sort=True)
        order = np.lexsort((query, term))
        self.query, self.weight = query[order], rows["idf"].to_numpy(np.float64)[order]
        self.first = np.searchsorted(term[order], np.arange(len(self.names) + 1))
        self.term = term[order]


def _block_scores(asked: Asked, row: np.ndarray, term: np.ndarray, part: np.ndarray, rows: int, active: np.ndarray, pairs: int) -> np.ndarray:
    """The scores (row, query) of a block: the parts of its postings times the weights of the active queries that ask for the term."""
    wide = len(asked.queries)
    out = np.zeros(rows * wide)
    size = np.diff(asked.first)[term]
    cut = np.searchsorted(np.cumsum(size), np.arange(pairs, int(size.sum()) + pairs, pairs), "right")
    for lo, hi in zip([0, *cut[:-1]], cut, strict=True):
        n = size[lo:hi]
        at = np.arange(n.sum()) + np.repeat(asked.first[term[lo:hi]] - np.cumsum(n) + n, n)
        keep = active[asked.query[at]]
        at, posting = at[keep], np.repeat(np.arange(lo, hi), n)[keep]
        out += np.bincount(row[posting] * wide + asked.query[at], asked.weight[at] * part[posting], len(out))
    return out.reshape(rows, wide)


def bm25_block_best(index: Index, weighted: DataFrame, ties: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, kb_id, chunk_id, path, start_line, score): of each block of chunks those that may be among a query's first ``k``.

    Scores are added up where the chunks are, in tables of chunks by queries, so that pairs of postings and queries never become rows. For each term of a
    block the largest part of a score is known before; a query that could not reach its k-th best score of the task with all of its terms'
    largest parts is passed over. Equal scores at the end are cut by ``ties`` (path, start_line, chunk_id) when there are many.
    """
    spark = weighted.sparkSession
    rows = weighted.toArrow().to_pandas()
    held = {kb: Asked(own, float(own["avg_length"].iloc[0])) for kb, own in rows.groupby("kb_id")}
    shared, cells, pairs = spark.sparkContext.broadcast(held), CELLS, PAIRS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = {kb: np.zeros(len(a.queries)) for kb, a in shared.value.items()}
        for batch in batches:
            kbs = batch.column(0).to_pandas()
            for kb in kbs.unique():
                if kb in shared.value:
                    part = batch if (kbs == kb).all() else batch.filter(pa.array((kbs == kb).to_numpy()))
                    for lo in range(0, part.num_rows, step := max(1, cells // len(shared.value[kb].queries))):
                        yield from one(part.slice(lo, step), shared.value[kb], floors[kb])

    def one(block: pa.RecordBatch, asked: Asked, floor: np.ndarray) -> Iterator[pa.RecordBatch]:
        lists = block.column(3)
        at = pc.index_in(lists.flatten(), value_set=pa.array(asked.names, pa.string())).fill_null(-1).to_numpy()
        known = at >= 0
        row = np.repeat(np.arange(block.num_rows), np.diff(lists.offsets.to_numpy()))[known]
        tf, term, length = block.column(4).flatten().to_numpy()[known], at[known], block.column(2).to_numpy()[row]
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / asked.average))
        most = np.zeros(len(asked.names))
        np.maximum.at(most, term, part)
        bound = np.bincount(asked.query, asked.weight * most[asked.term], len(asked.queries))
        active = (bound > 0) & (bound + SLACK >= floor)
        if not active.any():
            return
        scores = np.round(_block_scores(asked, row, term, part, block.num_rows, active, pairs), DIGITS)
        if len(scores) >= k:
            np.maximum(floor, np.partition(scores, -k, axis=0)[-k], out=floor)
        place, query = np.nonzero((scores > 0) & (scores >= floor))
        path, line, chunk = (block.column(i).to_pylist() for i in (5, 6, 1))
        if len(place) > 2 * k * len(asked.queries):  # many equal scores: the ties decide here
            order = {p: r for r, p in enumerate(sorted(range(len(path)), key=lambda p: (path[p] is not None, path[p] or "", line[p] is None, line[p] or 0, chunk[p])))}
            by = np.lexsort((np.array([order[p] for p in range(len(path))])[place], -scores[place, query], query))
            place, query = place[by], query[by]
            first = np.arange(len(query)) - np.searchsorted(query, query) < k
            place, query = place[first], query[first]
        pick = pa.array(place)
        yield pa.RecordBatch.from_arrays([
            pa.array(asked.queries[query], block_query), *(block.column(i).take(pick) for i in (0, 1, 5, 6)), pa.array(scores[place, query]),
        ], ["query_id", "kb_id", "chunk_id", "path", "start_line", "score"])

    kinds = {c: ties.schema[c].dataType.simpleString() for c in ("kb_id", "chunk_id", "path", "start_line")}
    query_kind = weighted.schema["query_id"].dataType.simpleString()
    block_query = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(query_kind)
    table = index.chunks.join(ties, ["kb_id", "chunk_id"]) if "path" not in index.chunks.columns else index.chunks
    table = table.select("kb_id", "chunk_id", "document_length", "terms", "counts", "path", "start_line")
    return table.mapInArrow(run, f"query_id {query_kind}, kb_id {kinds['kb_id']}, chunk_id {kinds['chunk_id']}, path {kinds['path']}, start_line {kinds['start_line']}, score double")


def bm25_topk(queries: DataFrame, chunks: DataFrame, k: int = 10, k1: float = K1, b: float = B, index: Index | None = None, normalizer=nfkc, segmenter=None) -> DataFrame:
    """Top-k chunks of every query by BM25: ties by path, start_line (nulls last), chunk_id; k is clamped to 1..100.

    ``chunks``: kb_id, chunk_id (unique in its kb), path, start_line, content, and index_status where not all are indexed. ``index`` is a ready-made one of
    ``build_index``; else one of the queries' terms alone is made. Queries come in blocks of about ``FEW_ROWS`` terms. The
    matched terms are gathered for the winners alone.
    """
    k = max(1, min(k, MAX_K))
    if "index_status" in chunks.columns:
        chunks = chunks.where("index_status = 'indexed'")
    terms = materialize(query_terms(queries, normalizer, segmenter), "bm25-queries")
    index = index or build_index(chunks, terms, normalizer, segmenter)
    ties = chunks.select("kb_id", "chunk_id", "path", "start_line")
    weighted = terms.join(index.df, ["kb_id", "term"]).join(broadcast_if_few(index.corpus), "kb_id")
    weighted = materialize(weighted.select("query_id", "kb_id", "term", "avg_length", F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "bm25-weighted")
    blocks = -(-weighted.count() // FEW_ROWS)
    order = [F.desc("score"), F.asc("path"), F.asc_nulls_last("start_line"), F.asc("chunk_id")]
    best = None
    for i in range(max(1, blocks)):
        own = weighted if blocks < 2 else weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        found = bm25_block_best(index, own, ties, k, k1, b)
        best = found if best is None else best.unionByName(found)
    winners = materialize(topk(best, ["query_id"], order, k), "bm25-winners")
    asked = terms.groupBy("query_id", "kb_id").agg(F.collect_set("term").alias("asked"))
    held = index.chunks.select("kb_id", "chunk_id", "terms").join(broadcast_if_few(winners), ["kb_id", "chunk_id"])
    matched = held.join(asked, ["query_id", "kb_id"]).withColumn("matched_terms", F.array_sort(F.array_intersect("terms", "asked")))
    return matched.withColumn("n_matched", F.size("matched_terms").cast("long")).select("query_id", "kb_id", "chunk_id", "path", "start_line", "score", "rank", "n_matched", "matched_terms")


def term_set_scores(queries: DataFrame, postings: DataFrame, k: int = 10) -> DataFrame:
    """Multiset overlap: the sum of the smaller of both term counts; ties by chunk_id."""
    hits = postings.join(broadcast_if_few(materialize(query_terms(queries), "overlap-queries")), ["kb_id", "term"])
    return topk(hits.groupBy("query_id", "chunk_id").agg(F.sum(F.least("qtf", "tf")).alias("score")), ["query_id"], [F.desc("score"), F.asc("chunk_id")], max(1, k))
