"""Quality classifier by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words, the shapes of its words, and which words repeat the one before; terms are hashed to bins,
counts are damped and weighted by rarity, and a truncated singular value decomposition of the labelled texts gives the
latent space. The labelled vectors are broadcast (at most ``TRAIN_ROWS``), every document is compared with all of them by
exact cosine products, block by block, and its nearest neighbours vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygrid.common import bound_batches, bounded_choice, table
from quarrygrid.llm import textkernel as tk

WORD_BINS, SHAPE_BINS, REPEAT_BINS = 2048, 512, 16
BINS = WORD_BINS + SHAPE_BINS + REPEAT_BINS
#: Labelled rows that the model is fitted on, at most; a fixed pseudo-random choice by doc_id.
TRAIN_ROWS = 4000
DIMENSIONS, NEIGHBOURS, SHARPNESS = 48, 15, 4

_SHAPE = np.full(256, ord("a"), np.uint8)
_SHAPE[:128] = np.arange(128)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed terms, one row for each text, cut off at 65535."""
    n = len(offsets) - 1
    out = np.zeros((n, BINS), np.uint16)
    low = tk.LOWER[data]
    starts, ends, before = tk.word_spans(low, offsets)
    if not len(starts):
        return out
    row = np.repeat(np.arange(n), np.diff(before))
    word = tk.span_hashes(low, starts, ends)
    shape = _SHAPE[data]
    keep = np.zeros(len(data), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    keep &= ~tk.WHITE[data]
    place = np.concatenate(([0], np.cumsum(keep)))
    form = tk.span_hashes(shape[keep], place[starts], place[ends])
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    columns = np.concatenate((
        word % np.uint64(WORD_BINS), WORD_BINS + form % np.uint64(SHAPE_BINS),
        WORD_BINS + SHAPE_BINS + word[same] % np.uint64(REPEAT_BINS),
    )).astype(np.int64)
    rows = np.concatenate((row, row, row[same]))
    for lo in range(0, n, 256):  # a dense table of a few texts at a time
        pick = (rows >= lo) & (rows < lo + 256) if n > 256 else slice(None)
        size = min(n - lo, 256)
        out[lo : lo + 256] = np.minimum(np.bincount((rows[pick] - lo) * BINS + columns[pick], minlength=size * BINS), 65535).reshape(size, BINS)
    return out


class Model:
    """Rarity weights, latent projection, and the labelled vectors."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        present = (counts > 0).sum(0)
        self.rarity = (np.log((1 + len(counts)) / (1 + present)) + 1).astype(np.float32)
        x = self._weighted(counts)
        rng = np.random.default_rng(7)
        basis = rng.standard_normal((BINS, DIMENSIONS + 16)).astype(np.float32)
        for _ in range(6):
            basis, _ = np.linalg.qr(x.T @ (x @ basis))
        small = x @ basis
        _, _, right = np.linalg.svd(small, full_matrices=False)
        self.projection = (basis @ right[:DIMENSIONS].T).astype(np.float32)
        self.vectors = self._unit(x @ self.projection)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts.astype(np.float32)) * self.rarity
        for lo, hi in ((0, WORD_BINS), (WORD_BINS, BINS)):  # words and forms have equal weight
            x[:, lo:hi] = self._unit(x[:, lo:hi])
        return x

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The similarity-weighted share of label 1 among the nearest labelled vectors; the prior for texts without terms."""
        out = np.full(len(counts), self.prior)
        if not len(self.labels):
            return out
        vectors = self._unit(self._weighted(counts) @ self.projection)
        k = min(NEIGHBOURS, len(self.labels))
        for lo in range(0, len(vectors), 256):
            cosine = vectors[lo : lo + 256] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS
            total = weight.sum(1)
            vote = (weight * self.labels[near]).sum(1)
            out[lo : lo + 256] = np.where(total > 1e-9, vote / np.maximum(total, 1e-9), self.prior)
        return np.clip(out, 0, 1)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows that no model learns from: crc32(doc_id as text) mod 3 = 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality") -> Model:
    """The model of at most ``TRAIN_ROWS`` labelled texts that are not held out; what reaches the driver is bounded by that."""
    bound_batches(docs.sparkSession)
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(target).alias("label"))
    chosen = bounded_choice(known, TRAIN_ROWS, "doc_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tk.blocks(*tk.buffers(batch.column(1))):
                counts = np.minimum(term_counts(data, offsets), 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([c.tobytes() for c in counts], pa.binary())], ["doc_id", "label", "counts"])

    found = rows.mapInArrow(run, "doc_id long, label int, counts binary").limit(2 * TRAIN_ROWS).toPandas().sort_values(["doc_id", "counts"], kind="stable")
    counts = np.frombuffer(b"".join(found["counts"]), np.uint8).reshape(len(found), BINS)
    return Model(counts, found["label"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score double) of every row; null texts count as empty, and empty ones have the prior."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tk.blocks(*tk.buffers(batch.column(1))):
                counts = np.minimum(term_counts(data, offsets), 255)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(shared.value.scores(counts))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns.

    The score depends on the text alone, so it is computed beside the row and no join is needed.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for _, _, data, offsets in tk.blocks(*tk.buffers(batch.column(at))):
                keep.append(model.value.scores(np.minimum(term_counts(data, offsets), 255)) >= 0.5)
            yield batch.filter(pa.array(np.concatenate(keep)))
        tk.release()

    return docs.mapInArrow(run, docs.schema)


def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document by its labelled neighbours."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
