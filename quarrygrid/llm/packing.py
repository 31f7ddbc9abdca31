"""Packing of token sequences into fixed windows.

Every document is cut into full windows and one remainder. Remainders are gathered up to ``GATHER`` tokens; shallow
combinations of their lengths that fill a window exactly are enumerated, non-negative least squares finds how often to
repeat each so that the histogram of lengths is used up, the counts are rounded down to what is there, and the rest is
packed greedily. What no longer fills a window with whole remainders goes to one stream that is cut at window ends; its
last, open window is cut into powers of two, which need no padding.

Every task packs its own rows in one pass: nothing is shuffled, joined, broadcast or written in between, a task holds
``GATHER`` tokens at most, and sequence ids begin with the partition's number, so a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygrid.common import bound_batches, table
from quarrygrid.llm import bpe
from quarrygrid.llm import textkernel as tk

WINDOW, END_ID = 2048, 1
#: Lengths that serve as the middle one of three; rounds of the solver; tokens of padding that a packed window may have.
COMMON, ROUNDS, SLACK = 32, 300, 8
#: Tokens of remainders (4 bytes each) that a task gathers before it plans for them; sequence ids that a partition may use.
GATHER, PART_BITS = 1 << 22, 33
#: Pieces in a batch that goes back to Spark (8 KB each at most).
PIECES = 1024


def combinations(histogram: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths (columns a, b, c; 0 for none) and repeats of shallow combinations that fill ``window`` exactly."""
    have = np.flatnonzero(histogram)
    have = have[have > 0]
    rows = []
    if len(have):
        rest = window - have
        pair = have[(have <= rest) & (histogram[rest] > 0)]
        rows.append(np.stack([pair, window - pair, 0 * pair, 1 + 0 * pair], 1))
        for m in have[np.argsort(-histogram[have], kind="stable")][:COMMON].tolist():
            rest = window - m - have
            ok = (rest >= have) & (histogram[np.clip(rest, 0, window - 1)] > 0)
            one = have[ok]
            rows.append(np.stack([one, rest[ok], 0 * one + m, 1 + 0 * one], 1))
        times = window // have  # as many copies of one length as fit, and the rest
        for less in (0, 1):
            k = times - less
            rest = window - k * have
            ok = (k > 1) & ((rest == 0) | (histogram[np.clip(rest, 0, window - 1)] > 0)) & (rest < window)
            rows.append(np.stack([have[ok], rest[ok], 0 * have[ok], k[ok]], 1))
    found = np.concatenate(rows) if rows else np.zeros((0, 4), np.int64)
    return found[:, :3], np.stack([found[:, 3], found[:, 1] > 0, found[:, 2] > 0], 1).astype(np.int64)


def least_squares(lengths: np.ndarray, repeats: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative x that minimises |A x - histogram|^2, by accelerated projected gradients; A is sparse."""
    flat, weight, n = lengths.ravel(), repeats.ravel().astype(np.float64), len(lengths)
    if not n:
        return np.zeros(0)

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, 3) * weight, len(histogram))

    def backward(r: np.ndarray) -> np.ndarray:
        return (r[flat] * weight).reshape(n, 3).sum(1)

    goal = histogram.astype(np.float64)
    goal[0] = 0
    v = np.ones(n)
    for _ in range(20):  # largest eigenvalue, for the step
        v = backward(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(ROUNDS):
        new = np.maximum(y - backward(forward(y) - goal) / (norm * 1.01), 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x


class Plan:
    """How many windows hold which lengths, made from a histogram of remainders: combinations by least squares, then greedily.

    ``windows``: (times, ((length, copies), ...)); ``left``: the histogram of what is in none of them.
    """

    def __init__(self, histogram: np.ndarray, window: int):
        self.left = histogram.astype(np.int64).copy()
        self.left[0] = 0
        self.windows: list[tuple[int, tuple[tuple[int, int], ...]]] = []
        lengths, repeats = combinations(self.left, window)
        x = least_squares(lengths, repeats, self.left)
        for i in np.argsort(-x, kind="stable").tolist():
            if x[i] < 1:
                break
            self._take(list(zip(lengths[i].tolist(), repeats[i].tolist(), strict=True)), int(x[i]))
        while True:  # greedy: the largest first, then the largest that fits
            room, chosen = window, []
            for l in np.flatnonzero(self.left)[::-1].tolist():
                k = min(room // l, int(self.left[l]))
                if k:
                    chosen.append((l, k))
                    room -= k * l
                if not room:
                    break
            if not chosen or room > SLACK:
                break
            self._take(chosen, 1 << 62)

    def _take(self, chosen: list[tuple[int, int]], most: int) -> None:
        need: dict[int, int] = {}
        for l, k in chosen:
            if l and k:
                need[l] = need.get(l, 0) + k
        times = min([most, *(int(self.left[l]) // k for l, k in need.items())])
        if times < 1:
            return
        for l, k in need.items():
            self.left[l] -= times * k
        self.windows.append((times, tuple(need.items())))


class Packer:
    """Packs the rows of one task; ``out`` collects (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of finished pieces."""

    def __init__(self, window: int, first: int):
        self.window, self.sequence, self.out = window, first, []
        self.held: dict[int, list[tuple]] = {}  # remainders by length: doc_id, start, doc_tokens, ids
        self.tokens = 0
        self.open: list[tuple] = []  # pieces of the stream's open window: doc_id, start, doc_tokens, ids
        self.open_tokens = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        for start in range(0, n - w + 1, w):
            self._emit([(doc_id, start, n, ids[start : start + w])])
        rest = n % w
        if rest:
            self.held.setdefault(rest, []).append((doc_id, n - rest, n, ids[n - rest :].copy()))
            self.tokens += rest
            if self.tokens >= GATHER:
                self.plan()

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, n, ids in pieces:
            self.out.append((doc_id, start, len(ids), n, self.sequence, offset, ids.tobytes()))
            offset += len(ids)
        self.sequence += 1

    def plan(self) -> None:
        """Place all remainders that are held."""
        histogram = np.zeros(self.window, np.int64)
        for l, rows in self.held.items():
            histogram[l] = len(rows)
        for times, content in Plan(histogram, self.window).windows:
            for _ in range(times):
                self._emit([self.held[l].pop() for l, k in content for _ in range(k)])
        for l in sorted(self.held, reverse=True):
            for row in self.held[l]:
                self._stream(*row)
        self.held, self.tokens = {}, 0

    def _stream(self, doc_id, start: int, n: int, ids: np.ndarray) -> None:
        while len(ids):
            size = min(len(ids), self.window - self.open_tokens)
            self.open.append((doc_id, start, n, ids[:size]))
            self.open_tokens += size
            start, ids = start + size, ids[size:]
            if self.open_tokens == self.window:
                self._emit(self.open)
                self.open, self.open_tokens = [], 0

    def finish(self) -> None:
        """Place what is left; the stream's open window becomes sequences whose lengths are powers of two."""
        self.plan()
        left, self.open = self.open[::-1], []
        while self.open_tokens:
            room, pieces = 1 << (self.open_tokens.bit_length() - 1), []
            self.open_tokens -= room
            while room:
                doc_id, start, n, ids = left.pop()
                pieces.append((doc_id, start, n, ids[:room]))
                if len(ids) > room:
                    left.append((doc_id, start + room, n, ids[room:]))
                room -= len(pieces[-1][3])
            self._emit(pieces)


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int | None = END_ID) -> DataFrame:
    """Pieces of all documents: (doc_id, start, length, doc_tokens, sequence_id, offset, ids binary of little-endian uint32).

    Null and empty texts are ``end_id`` alone (nothing where that is None). Rows are packed as they are: repeated rows and
    repeated or null doc_ids each get their own pieces. Sequences are full, but for those that the plan leaves up to
    ``SLACK`` tokens short and the last ones of a task, whose lengths are powers of two. Sequence ids are unique, not
    consecutive. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    tail = np.array([] if end_id is None else [end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.worker_encoder(vocabulary)
        packer = Packer(window, TaskContext.get().partitionId() << PART_BITS)
        id_type = None

        def finished(least: int = 1) -> Iterator[pa.RecordBatch]:
            while len(packer.out) >= least:
                rows, packer.out = packer.out[:PIECES], packer.out[PIECES:]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:6]), pa.array(columns[6], pa.binary())], names)

        for batch in batches:
            id_type = batch.column(0).type
            for lo, hi, data, offsets in tk.blocks(*tk.buffers(batch.column(1))):
                ids, at = encoder.encode(data, offsets)
                for i, doc_id in enumerate(batch.column(0).slice(lo, hi - lo).to_pylist()):
                    packer.add(doc_id, np.concatenate((ids[at[i] : at[i + 1]], tail)).astype("<u4"))
                yield from finished(PIECES)
        packer.finish()
        yield from finished()
        tk.release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def packed_digests(docs: DataFrame) -> DataFrame:
    from public_tokenizers import path

    packed = pack(docs, path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048, with the CRC-32 of each piece's ids; see ``pack`` for nulls, repeats and empty texts."""
    return packed_digests(table(spark, sf_dir, "documents"))
