"""Ranked lexical search by pipelined term partitioning.

The terms of all items are dealt to a row of owners, the rarest terms first; each owner holds the postings of its terms. Items travel in
bundles: a bundle carries sparse accumulators, a score for each (document, item) met so far, through the owners one after
another. At each of them a cogroup brings the bundle's accumulators for a block of documents together with the owner's postings of that
block, and the owner's integer contributions are added. The last owner, with the most frequent terms, selects
instead of passing on: so what travels are the few documents that hold rarer terms. All arithmetic is in 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygrid.common import bound_batches, materialize, table, topk
from quarrygrid.llm import textkernel as tk

TOP = 10
OWNERS = 4
#: An owner has at most this share of the contributions of its owner and all before it, but for the last one: so accumulators stay sparse until then.
GROWTH = 12
#: Items that travel in one bundle; documents of a block (a power of two); terms that a pass over the documents looks for.
BUNDLE, BLOCK_BITS, PASS_TERMS = 256, 12, 1_000_000

_LETTER = np.zeros(256, bool)
_LETTER[ord("0") : ord("9") + 1] = _LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True
#: Bytes for the word kernel: lower-cased, what is no part of a term is a space.
_TERM_BYTES = np.where(_LETTER, tk.LOWER, np.uint8(32)).astype(np.uint8)
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every term of the rows, in order, and the number of terms before each row. Terms are alike byte for byte, so UTF-8 needs no decoding."""
    form = _TERM_BYTES[data]
    starts, ends, before = tk.word_spans(form, offsets)
    return tk.span_hashes(form, starts, ends).view(np.int64), before


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term long) of items, each once; rows of one item_id count as one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tk.blocks(*tk.buffers(batch.column(1))):
                hashes, before = term_hashes(data, offsets)
                row = np.repeat(np.arange(lo, hi), np.diff(before))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(hashes)], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term long").distinct()


def posted(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(row, doc_id, n, terms array<int>, counts array<int>) of every document with a term at all: its terms among ``terms`` (sorted) by position, and how often each occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for lo, hi, data, offsets in tk.blocks(*tk.buffers(batch.column(2))):
                hashes, before = term_hashes(data, offsets)
                n = np.diff(before)
                row = np.repeat(np.arange(hi - lo), n)
                at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                pairs, count = np.unique(row[hit].astype(np.int64) * (len(known) + 1) + at[hit], return_counts=True)
                of = pairs // (len(known) + 1)
                bounds = pa.array(np.searchsorted(of, np.arange(hi - lo + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(v.astype(np.int32))) for v in (pairs % (len(known) + 1), count)]
                full = pa.array(n > 0)
                found = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n.astype(np.int64)), *lists]
                yield pa.RecordBatch.from_arrays([c.filter(full) for c in found], ["row", "doc_id", "n", "terms", "counts"])
        tk.release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInArrow(run, f"row long, doc_id {kind}, n long, terms array<int>, counts array<int>")


class Owners:
    """Which owner holds a term, its weight, and which items of each bundle ask for it."""

    def __init__(self, df: np.ndarray, asked: np.ndarray, item: np.ndarray, term: np.ndarray, documents: int, length: int, owners: int):
        """``df`` and ``asked``: documents and items of each term; ``item`` and ``term``: the pairs of both."""
        self.documents, self.length, self.stages, self.bundle, self.bits = documents, max(length, 1), owners, BUNDLE, BLOCK_BITS
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        made = df * asked
        order = np.argsort(df, kind="stable")
        share = np.cumsum(made[order]) / max(int(made.sum()), 1)
        self.owner = np.zeros(len(df), np.int64)
        self.owner[order] = owners - 1 - np.minimum(np.floor(-np.log(np.maximum(share, 1e-300)) / math.log(GROWTH)), owners - 1).astype(np.int64)
        by = np.lexsort((item, term))
        self.items, self.first = item[by], np.searchsorted(term[by], np.arange(len(df) + 1))

    def of(self, term: int, bundle: int) -> np.ndarray:
        """Places within the bundle of its items that ask for the term."""
        own = self.items[self.first[term] : self.first[term + 1]]
        lo, hi = np.searchsorted(own, (bundle * self.bundle, (bundle + 1) * self.bundle))
        return own[lo:hi] - bundle * self.bundle

    def parts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a posting is worth before the term's weight."""
        m = 100 - 90 + (90 * n * self.documents) // self.length
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def dealt(postings: DataFrame, owners, stage: int) -> DataFrame:
    """(bundle, block, place, term, part, docs, ids) of the owner's postings, arrays but for the first two: a row for each bundle that asks for any, block of documents and batch.

    Only the last owner's rows hold the documents' places and ids, of all documents.
    """
    last, kind = stage == owners.value.stages - 1, postings.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = owners.value
        bundles = int(o.items.max(initial=-1)) // o.bundle + 1
        wanted = [np.unique(np.repeat(np.arange(len(o.weight)), np.diff(o.first))[o.items // o.bundle == b]) for b in range(bundles)] if bundles > 1 else []
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(batch.column(0).to_numpy(), kind="stable")))  # a task may read several files
            rows, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(2)
            size = np.diff(lists.offsets.to_numpy())
            term, tf = lists.flatten().to_numpy(zero_copy_only=False), batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(rows)), size)
            own = np.flatnonzero(o.owner[term] == stage)
            term, row = term[own], row[own]
            part = o.parts(tf[own], n[row])
            block, place = rows >> o.bits, (rows & ((1 << o.bits) - 1)).astype(np.int32)
            for b in range(bundles):
                pick = np.isin(term, wanted[b]) if wanted else slice(None)
                bs, columns = block[row[pick]], [place[row[pick]], term[pick], part[pick].astype(np.int32)]
                keys = np.unique(block) if last else np.unique(bs)
                bounds = np.append(np.searchsorted(bs, keys), len(bs)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(v)) for v in columns]
                bounds = np.append(np.searchsorted(block, keys), len(block)).astype(np.int32) if last else np.zeros(len(keys) + 1, np.int32)
                lists += [pa.ListArray.from_arrays(pa.array(bounds), v) for v in (pa.array(place), batch.column(4))]
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), b)), pa.array(keys), *lists], ["bundle", "block", "place", "term", "part", "docs", "ids"])

    return postings.select("row", "n", "terms", "counts", "doc_id").mapInArrow(run, f"bundle long, block long, place array<int>, term array<int>, part array<int>, docs array<int>, ids array<{kind}>")


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, np.int64)


def _added(key: tuple, carried: pa.Table, postings: pa.Table, o: Owners) -> np.ndarray:
    """The table of scores (place of the document, place of the item) of a bundle and block with what an owner adds."""
    bundle = key[0].as_py()
    scores = np.zeros((1 << o.bits, o.bundle), np.int64)
    cell = _flat(carried, "cell")
    scores.ravel()[cell] = _flat(carried, "score")
    place, term, part = _flat(postings, "place"), _flat(postings, "term"), _flat(postings, "part").astype(np.int64)
    order = np.argsort(term, kind="stable")
    place, term, part = place[order], term[order], part[order]
    bounds = [*np.flatnonzero(np.diff(term, prepend=-1)).tolist(), len(term)]
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        items = o.of(term[lo], bundle)
        if len(items):  # a document has each term once
            scores[place[lo:hi, None], items] += (o.weight[term[lo]] * part[lo:hi])[:, None]
    return scores


BUNDLES = "bundle long, block long, cell array<int>, score array<long>"


def passed_on(carried: DataFrame, postings: DataFrame, owners) -> DataFrame:
    """The bundles after an owner: their scores that aren't 0, and where they stand."""

    def visit(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        scores = _added(key, left, right, owners.value).ravel()
        cell = np.flatnonzero(scores)
        lists = [pa.ListArray.from_arrays(pa.array(np.array([0, len(cell)], np.int32)), pa.array(v)) for v in (cell.astype(np.int32), scores[cell])]
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()]), *lists], names=["bundle", "block", "cell", "score"])

    return carried.groupBy("bundle", "block").cogroup(postings.groupBy("bundle", "block")).applyInArrow(visit, BUNDLES)


def selected(carried: DataFrame, postings: DataFrame, owners, k: int) -> DataFrame:
    """(item, row, doc_id, score): the last owner's additions, and of each item the block's first ``k`` documents."""
    kind = postings.schema["ids"].dataType.elementType.simpleString()

    def visit(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        o = owners.value
        scores = _added(key, left, right, o)
        least = np.maximum(np.partition(scores, -k, axis=0)[-k], 1) if k <= len(scores) else 1
        place, item = np.nonzero(scores >= least)
        ids = pa.nulls(len(scores), right.schema.field("ids").type.value_type)
        docs, at = np.unique(_flat(right, "docs"), return_index=True)  # each pass over the documents has brought them
        ids = pc.replace_with_mask(ids, pa.array(np.isin(np.arange(len(scores)), docs)), right.column("ids").combine_chunks().flatten().take(pa.array(at)))
        order = pc.rank(ids, "ascending", null_placement="at_end", tiebreaker="first").to_numpy()  # the smallest id first
        by = np.lexsort((order[place], -scores[place, item], item))
        place, item = place[by], item[by]
        first = np.arange(len(item)) - np.searchsorted(item, item) < k
        place, item = place[first], item[first]
        return pa.table([
            pa.array((item + key[0].as_py() * o.bundle).astype(np.int64)), pa.array((place + (key[1].as_py() << o.bits)).astype(np.int64)), ids.take(pa.array(place)), pa.array(scores[place, item]),
        ], names=["item", "row", "doc_id", "score"])

    return carried.groupBy("bundle", "block").cogroup(postings.groupBy("bundle", "block")).applyInArrow(visit, f"item long, row long, doc_id {kind}, score long")


def search(items: DataFrame, docs: DataFrame, k: int = TOP, owners: int = OWNERS) -> DataFrame:
    """(item_id, rank, doc_id, score) of the first ``k`` documents of every item, scores above 0 only, equal ones by doc_id (nulls last).

    Null and empty texts have no terms. Rows of one item_id are one item with the terms of all; a null item_id is an item like others.
    Rows of ``docs`` are documents each, also with one doc_id. Items are a query set: their pairs of items and terms go through the driver
    and are broadcast (some 20 bytes each), and their terms are looked for in passes of ``PASS_TERMS``. Other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long"
    pairs = item_terms(items).toArrow().to_pandas()
    if not len(pairs):
        return spark.createDataFrame([], schema)
    item, names = pairs["item_id"].factorize(sort=True, use_na_sentinel=False)
    terms, term = np.unique(pairs["term"].to_numpy(np.int64), return_inverse=True)
    postings, df = [], np.zeros(len(terms), np.int64)
    for lo in range(0, len(terms), PASS_TERMS):
        held = materialize(posted(docs, terms[lo : lo + PASS_TERMS]), "ranked-postings")
        counted = held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toArrow().to_pandas()
        df[counted["t"].to_numpy(np.int64) + lo] = counted["n"].to_numpy()
        postings.append(held.withColumn("terms", F.transform("terms", lambda t: t + F.lit(lo))) if lo else held)
    documents, length = postings[0].agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shared = spark.sparkContext.broadcast(Owners(df, np.bincount(term, minlength=len(terms)), item.astype(np.int64), term, documents, length, owners))
    every = postings[0]
    for more in postings[1:]:
        every = every.unionByName(more)
    carried = spark.createDataFrame([], BUNDLES)
    for stage in range(owners - 1):
        carried = passed_on(carried, dealt(every, shared, stage), shared)
    best = selected(carried, dealt(every, shared, owners - 1), shared, k)
    named = spark.createDataFrame([(i, None if n != n else n) for i, n in enumerate(names.tolist())], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
    ranked = topk(best, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], k)
    return ranked.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_term_pipeline_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item; see ``search`` for nulls, repeats and ties."""
    return search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM_PATTERN}') AS ts FROM documents
), n AS (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
total AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS length FROM n),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM_PATTERN}')) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, CAST(sum(
    CAST(floor(1000 * ln((2 * documents + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * documents) // length))))
  ) AS BIGINT) AS score
  FROM asked JOIN post USING (term) JOIN df USING (term) JOIN n USING (doc_id) CROSS JOIN total GROUP BY 1, 2
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
