"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds the polynomial hash of each of its prefixes modulo a prime. From two entries follows the hash
of any span, so spans of one or two texts are compared in constant time, and the longest common extension of two
positions is found by binary search.

A fingerprint keeps the array at a fixed grid of lengths (each about a tenth longer than the one before), from the front
and from the back, with the hash of the whole text, and the prefix hashes at inner positions that the characters before
them choose. Two fingerprints show by binary search how far the texts agree from either end, and by the spans between
inner positions what else agrees in order; the greater share of the longer text is their likeness.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygrid.common import bound_batches, table

PRIME = (1 << 31) - 1
BASES = (1_103_515_245 % PRIME, 69_069_433)
GROWTH = 1.1
#: Characters that choose an inner position, and inner positions of a text: so many about, twice that at most but for short texts.
WINDOW, INNER = 8, 128
#: Lengths that one step of a search compares.
PROBES = 64
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, by doubling."""
    if base not in _TABLES or len(_TABLES[base][0]) <= n:
        both = []
        for b in (base, pow(base, -1, PRIME)):
            out = np.ones(1, np.uint64)
            while len(out) <= max(n, 1 << 16):
                out = np.concatenate((out, out * np.uint64(pow(b, len(out), PRIME)) % np.uint64(PRIME)))
            both.append(out)
        _TABLES[base] = (both[0], both[1])
    return _TABLES[base]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class PrefixArray:
    """Hashes of all prefixes of one text."""

    def __init__(self, points: np.ndarray, base: int = BASES[0]):
        self.n, self.base = len(points), base
        up, self.down = power_tables(base, self.n)
        terms = (points.astype(np.uint64) + np.uint64(1)) * up[: self.n] % np.uint64(PRIME)
        self.hash = np.zeros(self.n + 1, np.uint64)
        np.cumsum(terms, out=self.hash[1:])
        self.hash %= np.uint64(PRIME)
        self.inner: tuple[int, np.ndarray] | None = None

    def span(self, start, end):
        """The hash of [start, end), the same wherever the span stands; also for arrays."""
        return (self.hash[end] + np.uint64(PRIME) - self.hash[start]) % np.uint64(PRIME) * self.down[start] % np.uint64(PRIME)


def span_equal(a: PrefixArray, i: int, b: PrefixArray, j: int, length: int) -> bool:
    """Do a[i:i+length] and b[j:j+length] agree? False if either runs over its end."""
    if i + length > a.n or j + length > b.n:
        return False
    return bool(a.span(i, i + length) == b.span(j, j + length))


def _longest(equal, most: int) -> int:
    """The largest length up to ``most`` for which ``equal`` (of an array of lengths) holds, if it holds for all shorter ones.

    A binary search that asks for ``PROBES`` lengths at a time, after a first look at one character.
    """
    if most < 1 or not equal(np.array([1]))[0]:
        return 0
    low, high = 1, most
    while low < high:
        n = min(high - low, PROBES)
        probe = low + (np.arange(1, n + 1) * (high - low) + n - 1) // n
        same = equal(probe)
        if same.all():
            return high
        k = int(same.argmin())
        low, high = int(probe[k - 1]) if k else low, int(probe[k]) - 1
    return low


def common_extension(a: PrefixArray, i: int, b: PrefixArray, j: int) -> int:
    """The longest common extension of a[i:] and b[j:]."""
    return _longest(lambda n: a.span(i, i + n) == b.span(j, j + n), min(a.n - i, b.n - j))


def common_extension_back(a: PrefixArray, i: int, b: PrefixArray, j: int, most: int) -> int:
    """The longest common extension of a[:i] and b[:j] to the left, up to ``most``."""
    return _longest(lambda n: a.span(i - n, np.full(len(n), i)) == b.span(j - n, np.full(len(n), j)), most)


def grid(n: int) -> np.ndarray:
    """The fixed lengths up to n."""
    out, x = [], 1
    while x <= n:
        out.append(x)
        x = max(x + 1, int(x * GROWTH))
    return np.array(out, np.int64)


_GRID = grid(1 << 30)


def inner_positions(points: PrefixArray) -> tuple[int, np.ndarray]:
    """The level and (choice, position, prefix hash) of the inner positions and the end.

    At level k a position counts if the mixed hash of the characters before it is below 2^(32-k); all do in texts of up to
    ``INNER`` characters. A higher level's positions are among a lower one's, so texts of different lengths compare.
    """
    if points.inner is None:
        points.inner = _inner_positions(points)
    return points.inner


def _inner_positions(points: PrefixArray) -> tuple[int, np.ndarray]:
    n = points.n
    at = np.arange(1, n + 1)
    mixed = points.span(np.maximum(at - WINDOW, 0), at)
    mixed = (mixed ^ mixed >> np.uint64(15)) * np.uint64(2_654_435_769) & np.uint64(0xFFFFFFFF)
    mixed = (mixed ^ mixed >> np.uint64(16)) * np.uint64(0x45D9F3B) & np.uint64(0xFFFFFFFF)
    level = max(0, (max(n, 1) - 1) // INNER).bit_length()
    while True:
        chosen = mixed < np.uint64(1 << 32 >> level)
        if level == 32 or chosen.sum() <= 2 * INNER:
            break
        level += 1
    chosen[-1:] = True
    at = at[chosen]
    return level, np.stack((mixed[chosen].astype(np.int64), at, points.hash[at].astype(np.int64)), 1) if n else np.zeros((0, 3), np.int64)


def _spans(level: int, packed: str, base: int = BASES[0]) -> list[tuple]:
    """(choice of the end, length, hash) of the spans between the inner positions of a level."""
    rows = np.frombuffer(bytes.fromhex(packed), ">u4").reshape(-1, 3).astype(np.uint64)
    keep = rows[:, 0] < np.uint64(1 << 32 >> level)
    keep[-1:] = True
    rows = rows[keep]
    starts = np.concatenate((np.zeros(1, np.int64), rows[:-1, 1].astype(np.int64)))
    before = np.concatenate((np.zeros(1, np.uint64), rows[:-1, 2]))
    hashes = (rows[:, 2] + np.uint64(PRIME) - before) % np.uint64(PRIME) * power_tables(base, int(rows[-1, 1]))[1][starts] % np.uint64(PRIME)
    return list(zip(rows[:, 0].tolist(), (rows[:, 1].astype(np.int64) - starts).tolist(), hashes.tolist(), strict=True))


def _in_order(a: list[tuple], b: list[tuple]) -> int:
    """Characters in equal spans that stand in one order in both: the heaviest rising run of the places in ``b``.

    What agrees from either end is paired at once; of the rest, the equal spans with their places, as many as there are.
    """
    same, low = 0, min(len(a), len(b))
    front = next((i for i in range(low) if a[i] != b[i]), low)
    back = next((i for i in range(low - front) if a[-1 - i] != b[-1 - i]), low - front)
    same = sum(x[1] for x in a[:front]) + sum(x[1] for x in a[len(a) - back :])
    a, b = a[front : len(a) - back], b[front : len(b) - back]
    places: dict[tuple, list[int]] = {}
    for j, y in enumerate(b):
        places.setdefault(y, []).append(j)
    # ends rise with weights: the best weight of a run that ends at a place or before it
    ends: list[int] = []
    best: list[int] = []
    for x in a:
        for j in reversed(places.get(x, ())):
            k = bisect_left(ends, j)
            weight = x[1] + (best[k - 1] if k else 0)
            if k < len(ends) and ends[k] == j:
                if best[k] >= weight:
                    continue
                best[k] = weight
            elif k and best[k - 1] >= weight:
                continue
            else:
                ends.insert(k, j)
                best.insert(k, weight)
            stop = k + 1
            while stop < len(ends) and best[stop] <= weight:
                stop += 1
            del ends[k + 1 : stop], best[k + 1 : stop]
    return same + (best[-1] if best else 0)


def arrays(text: str) -> tuple[PrefixArray, PrefixArray]:
    """The prefix arrays of a text for both bases."""
    points = code_points(text)
    return PrefixArray(points, BASES[0]), PrefixArray(points, BASES[1])


def fingerprint(text: str) -> str:
    """``length:hash:prefixes:suffixes:level:inner positions``, all in hex; two texts have the same one if they are equal."""
    return array_fingerprint(*arrays(text))


def array_fingerprint(first: PrefixArray, second: PrefixArray) -> str:
    n = first.n
    lengths = _GRID[: np.searchsorted(_GRID, n, "right")]
    front = first.hash[lengths].astype(">u4").tobytes().hex()
    back = first.span(n - lengths, np.full(len(lengths), n)).astype(">u4").tobytes().hex()
    level, inner = inner_positions(first)
    return f"{n:x}:{int(first.hash[n]):08x}{int(second.hash[n]):08x}:{front}:{back}:{level:x}:{inner.astype('>u4').tobytes().hex()}"


def _agree(a: str, b: str) -> int:
    """How many of the leading 8-digit hashes agree: by binary search, as equal prefixes have equal shorter prefixes."""
    low, high = 0, min(len(a), len(b)) // 8
    while low < high:
        mid = (low + high + 1) // 2
        if a[8 * mid - 8 : 8 * mid] == b[8 * mid - 8 : 8 * mid]:
            low = mid
        else:
            high = mid - 1
    return low


def likeness(a: str, b: str) -> float:
    """From 0 to 1: the share of the longer text that the two agree in, from either end or in inner spans of one order, as far as the fingerprints show it."""
    if a == b:
        return 1.0
    n_a, _, front_a, back_a, level_a, inner_a = a.split(":")
    n_b, _, front_b, back_b, level_b, inner_b = b.split(":")
    sizes = int(n_a, 16), int(n_b, 16)
    if not min(sizes):
        return 0.0
    front, back = _agree(front_a, front_b), _agree(back_a, back_b)
    same = (int(_GRID[front - 1]) if front else 0) + (int(_GRID[back - 1]) if back else 0)
    level = max(int(level_a, 16), int(level_b, 16))
    same = max(same, _in_order(_spans(level, inner_a), _spans(level, inner_b)))
    return min(same, min(sizes)) / max(sizes)


def text_likeness(a: PrefixArray, b: PrefixArray) -> float:
    """The likeness of two texts from their whole prefix arrays: the share of the longer one that agrees.

    What agrees from either end is the longest common extension, exact to the character. Between the two, equal spans of inner
    positions in one order are anchors; each stretch between anchors adds its own extensions from either end.
    """
    longer = max(a.n, b.n)
    if not longer:
        return 1.0
    if not min(a.n, b.n):
        return 0.0
    front = common_extension(a, 0, b, 0)
    back = common_extension_back(a, a.n, b, b.n, min(a.n, b.n) - front)
    same = front + back
    low, high = (front, front), (a.n - back, b.n - back)
    if high[0] - low[0] and high[1] - low[1]:
        same += _between(a, b, low, high)
    return same / longer


def _between(a: PrefixArray, b: PrefixArray, low: tuple[int, int], high: tuple[int, int]) -> int:
    """Characters of equal spans, in one order, between two places of each text."""
    level, spans = 0, []
    for array, lo, hi in ((a, low[0], high[0]), (b, low[1], high[1])):
        own, positions = inner_positions(array)
        level = max(level, own)
        spans.append((array, lo, hi, positions))
    runs = []
    for array, lo, hi, rows in spans:
        rows = rows[rows[:, 0] < (1 << 32 >> level)]
        at = rows[(rows[:, 1] > lo) & (rows[:, 1] <= hi), 1]
        starts = np.concatenate(([lo], at))[:-1]
        values = array.span(starts, at) if len(at) else np.zeros(0, np.uint64)
        runs.append([(int(h), int(e - s), int(e)) for h, s, e in zip(values.tolist(), starts.tolist(), at.tolist(), strict=True)])
    chosen = _rising([x[:2] for x in runs[0]], [x[:2] for x in runs[1]])
    same, i, j = 0, low[0], low[1]
    for x, y in [*chosen, (None, None)]:
        stop = (high[0], high[1]) if x is None else (runs[0][x][2] - runs[0][x][1], runs[1][y][2] - runs[1][y][1])
        room = min(stop[0] - i, stop[1] - j)
        if room > 0:
            ahead = min(common_extension(a, i, b, j), room)
            same += ahead + common_extension_back(a, stop[0], b, stop[1], room - ahead)
        if x is not None:
            same += runs[0][x][1]
            i, j = runs[0][x][2], runs[1][y][2]
    return same


def _rising(a: list[tuple], b: list[tuple]) -> list[tuple[int, int]]:
    """Pairs of places of equal spans that occur once in either list, in the longest run that rises in both."""
    left, right = ({x: i for x, i, n in _counted(xs) if n == 1} for xs in (a, b))
    pairs = sorted((i, right[x]) for x, i in left.items() if x in right)
    tails: list[int] = []
    back: list[int] = []
    at: list[int] = []
    for k, (_, j) in enumerate(pairs):
        place = bisect_left(tails, j)
        back.append(at[place - 1] if place else -1)
        tails[place : place + 1] = [j]
        at[place : place + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _counted(xs: list[tuple]) -> list[tuple]:
    seen: dict[tuple, list[int]] = {}
    for i, x in enumerate(xs):
        seen.setdefault(x, [i, 0])[1] += 1
    return [(x, i, n) for x, (i, n) in seen.items()]


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the start of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row; null texts count as empty, repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t) for t in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_chars long, fingerprint string")


def in_descending_ranges(docs: DataFrame) -> DataFrame:
    """The rows of (doc_id, text) in ranges of doc_id, each range sorted descending and followed by the next range's first row.

    Adds ``range int`` and ``extra boolean`` (the row that follows). Range ends are quantiles of doc_id, a few for each shuffle
    partition; they and the first id of each range are all that reaches the driver. A row finds its range by binary search, and
    texts are shuffled once.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = docs.select(F.percentile_approx("doc_id", [i / (4 * parts) for i in range(1, 4 * parts)], 100_000).alias("q")).first().q or []
    ends = sorted(set(ends))
    bounds = np.array(ends, np.int64)

    @F.pandas_udf("int")
    def place(ids):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), "left").astype(np.int32))

    ranges = docs.select("doc_id", place("doc_id").alias("range")).groupBy("range").agg(F.max("doc_id").alias("first")).orderBy("range").collect()
    # the first row of each range also stands at the end of the range above; that of the highest after the lowest
    firsts, goes = np.array([r.first for r in ranges], np.int64), np.array([ranges[(i + 1) % len(ranges)].range for i in range(len(ranges))], np.int32)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(firsts, ids), len(firsts) - 1)
            also = np.flatnonzero(firsts[at] == ids)
            rows = pa.array(np.concatenate((np.arange(len(ids)), also)))
            spot = np.concatenate((np.searchsorted(bounds, ids, "left").astype(np.int32), goes[at[also]]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(spot), pa.array(np.arange(len(rows)) >= len(ids))], ["doc_id", "text", "range", "extra"])

    # the texts pass through the task's batches: a scalar function beside them would queue them on the executor's disk
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = docs.select("doc_id", "text").mapInArrow(dealt, f"doc_id {kind}, text string, range int, extra boolean")
    return placed.repartition(parts, "range").sortWithinPartitions("range", "extra", F.desc("doc_id"), "text")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The next document is the one with the next smaller doc_id; after the smallest comes the largest, so a single document
    follows itself. Null texts count as empty; rows with a null doc_id are left out, as they have no place in the order. Of
    rows with one doc_id the texts stand in ascending order, and each row is followed by the next of them. Other columns
    are ignored.
    """
    rows = in_descending_ranges(docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held: tuple | None = None  # the row that waits for its follower: id, text, fingerprint, range, prefix array
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, place, extra in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = arrays(text)
                mark = array_fingerprint(*own)
                if held and held[3] == place:
                    new = edited(held[1], text)
                    other = arrays(new)
                    new_mark = array_fingerprint(*other)
                    near = [1.0 if m == held[2] else text_likeness(held[4], x) for m, x in ((new_mark, other[0]), (mark, own[0]))]
                    out.append((held[0], len(held[1]), hashlib.sha256(new.encode("utf-8")).hexdigest(), held[2], new_mark, *near))
                held = None if extra else (doc_id, text, mark, place, own[0])
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op9_prefix_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))
