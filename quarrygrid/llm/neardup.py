"""Near-duplicate documents by SetSketch registers.

Every distinct text has one sketch of ``REGISTERS`` registers. A register is a truncated minimum on an exponentially
spaced scale, ``K = floor(OFFSET - log_BASE(x))`` with x the smallest exponential value that the register's hash gives to
any shingle; two sketches merge by the register-wise maximum. Registers agree with a probability that grows with the
Jaccard similarity, so equal bands of registers bring candidates together; of a candidate pair the counts of larger,
smaller and equal registers, with both set sizes, give the maximum-likelihood similarity; what passes is confirmed on
full shingle sets.

Copies are collapsed first, to one text each. Large buckets are cut into blocks of about ``BLOCK`` members, so no task and
no row holds a bucket. A first round compares each block with itself and with the next one and tests only a spanning forest
of their likeliest pairs, so its work is linear in the size of a group; a second one compares all blocks that may hold
members of different components and tests every pair that is still in two of them, so no link that matters is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygrid.common import bound_batches, drop_scratch, hot_limit, join_by_hot_keys, materialize, shuffle_partitions, table
from quarrygrid.llm import textkernel as tk
from quarrygrid.operators.graph_core import min_label_components

REGISTERS, BASE, OFFSET = 448, 1.1, 20
#: A pair of similarity 0.8 shares one of 42 bands of 6 registers with probability 1 - 3e-6, one of the first 12 with 0.97.
BAND_ROWS, BANDS, FIRST_BANDS = 6, 42, 12
#: Pairs whose likeliest similarity is lower by four standard deviations (sqrt(.8 * .2 / 448)) are no candidates.
MARGIN = 0.076
BLOCK, SMALL = 512, 48
#: Partners of a text that one task confirms together.
FAN = 256
WORDS, SIMILARITY = 5, 0.8

_LOW = (tk.mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_HIGH = (tk.mix(np.arange(1001, REGISTERS + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit hashes; the empty set has zeros everywhere."""
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint8)
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        value = low[None, i : i + 1024] * _LOW[:, None]
        value += high[None, i : i + 1024] * _HIGH[:, None]
        np.minimum(least, value.min(1), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(OFFSET - np.log(x) / np.log(BASE)), 0, 255).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def _share(x: np.ndarray) -> np.ndarray:
    """p_b(x) = -log_b(1 - x (b - 1) / b)."""
    return -np.log1p(-np.clip(x, 1e-12, 1 - 1e-12) * (BASE - 1) / BASE) / np.log(BASE)


def likelihood_slope(j: np.ndarray, u: np.ndarray, v: np.ndarray, more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Slope at similarity j of the log-likelihood of ``more`` larger and ``less`` smaller of the registers, with shares u and v
    of the sizes. The log-likelihood is concave: the likeliest similarity is above j where the slope is positive.
    """
    equal = REGISTERS - more - less
    scale = (BASE - 1) / BASE
    x, y = np.clip(u - v * j, 1e-9, None), np.clip(v - u * j, 1e-9, None)
    px, py = _share(x), _share(y)
    dx, dy = -v * scale / ((1 - x * scale) * np.log(BASE)), -u * scale / ((1 - y * scale) * np.log(BASE))
    p0 = np.clip(1 - px - py, 1e-9, None)
    return more * dx / px + less * dy / py - equal * (dx + dy) / p0


def likely_similarity(u: np.ndarray, v: np.ndarray, more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """The maximum-likelihood Jaccard similarity, by bisection of the slope."""
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(12):
        mid = (lo + hi) / 2
        up = likelihood_slope(mid, u, v, more, less) > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def band_values(registers: np.ndarray) -> np.ndarray:
    """Each band's registers as one number, for each row of registers."""
    rows = registers[:, : BANDS * BAND_ROWS].reshape(len(registers), BANDS, BAND_ROWS)
    value = np.zeros(rows.shape[:2], np.uint64)
    for j in range(BAND_ROWS):
        value = value << np.uint64(8) | rows[:, :, j]
    return value


def register_matrix(column: pa.Array) -> np.ndarray:
    """The registers of an Arrow column of binaries, one row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), REGISTERS)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, digest of the shingle set, registers) of every row of (doc_id, text_key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for lo, hi, data, offsets in tk.blocks(*tk.buffers(batch.column(2))):
                n, digest, registers = [], [], []
                for s in tk.shingle_sets(data, offsets, words):
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    registers.append(sketch(s).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(registers, pa.binary())],
                    ["doc_id", "text_key", "n_shingles", "digest", "registers"],
                )
        tk.release()

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id long, text_key long, n_shingles long, digest binary, registers binary")


def banded(reps: DataFrame, bands: int) -> DataFrame:
    """(node, label, band, bucket) of every band of the representatives' sketches."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("registers", BAND_ROWS * i + 1, BAND_ROWS)) for i in range(bands)])
    return reps.select("node", "label", F.posexplode(keys).alias("band", "bucket"))


class Members:
    """Members of block pairs, sorted so that a block pair's rows stand together."""

    FIELDS = ("bucket", "left", "right", "block", "node", "n_shingles", "label", "band")

    def __init__(self, columns: dict[str, np.ndarray], registers: np.ndarray):
        self.c, self.registers = columns, registers
        self.keys = band_values(registers)

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Members:
        return cls({f: batch.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(cls.FIELDS)}, register_matrix(batch.column(8)))

    def __len__(self) -> int:
        return len(self.registers)

    def cuts(self) -> np.ndarray:
        """Where block pairs begin, and the end."""
        c = self.c
        new = (c["bucket"][1:] != c["bucket"][:-1]) | (c["left"][1:] != c["left"][:-1]) | (c["right"][1:] != c["right"][:-1])
        return np.concatenate(([0], np.flatnonzero(new) + 1, [len(self)]))

    def part(self, lo: int, hi: int) -> Members:
        out = object.__new__(Members)
        out.c, out.registers, out.keys = {f: x[lo:hi] for f, x in self.c.items()}, self.registers[lo:hi], self.keys[lo:hi]
        return out

    def joined(self, other: Members) -> Members:
        out = object.__new__(Members)
        out.c = {f: np.concatenate((x, other.c[f])) for f, x in self.c.items()}
        out.registers, out.keys = np.concatenate((self.registers, other.registers)), np.concatenate((self.keys, other.keys))
        return out

    def judged(self, a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of rows (of one block pair each) that may be links, with their likeliest similarity."""
        size, label, found = self.c["n_shingles"], self.c["label"], []
        ok = (label[a] != label[b]) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]))
        a, b = a[ok], b[ok]
        for k in range(0, len(a), 8192):
            x, y = a[k : k + 8192], b[k : k + 8192]
            mine = (self.keys[x] == self.keys[y]).argmax(1) == self.c["band"][x]
            x, y = x[mine], y[mine]
            rx, ry = self.registers[x], self.registers[y]
            more, less = (rx > ry).sum(1), (rx < ry).sum(1)
            total = size[x] + size[y]
            u, v = size[x] / total, size[y] / total
            fits = likelihood_slope(np.minimum(similarity - MARGIN, np.minimum(u / v, v / u) - 1e-6), u, v, more, less) > 0
            x, y, u, v, more, less = (z[fits] for z in (x, y, u, v, more, less))
            found.append((x, y, likely_similarity(u, v, more, less)))
        if not found:
            return a[:0], a[:0], np.zeros(0)
        return tuple(np.concatenate(z) for z in zip(*found, strict=True))

    def pairs(self, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates in all block pairs: small ones together, by the distance of the rows; large ones one by one."""
        cuts = self.cuts()
        sizes = np.diff(cuts)
        group = np.repeat(np.arange(len(sizes)), sizes)
        small = np.repeat(sizes <= SMALL, sizes) & (self.c["left"] == self.c["right"])
        rows = np.flatnonzero(small)
        found = []
        for d in range(1, min(SMALL, len(rows))):
            same = group[rows[:-d]] == group[rows[d:]]
            if not same.any():
                break
            found.append(self.judged(rows[:-d][same], rows[d:][same], similarity))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if small[lo]:
                continue
            own = np.arange(lo, hi)
            one, other = (own, own) if self.c["left"][lo] == self.c["right"][lo] else (own[self.c["block"][lo:hi] == self.c["left"][lo]], own[self.c["block"][lo:hi] == self.c["right"][lo]])
            for i in range(0, len(one), 64):
                a, b = (x.ravel() for x in np.meshgrid(one[i : i + 64], other, indexing="ij"))
                if one is other:
                    a, b = a[a < b], b[a < b]
                found.append(self.judged(a, b, similarity))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which pairs, the heaviest first, join two parts of n rows that weren't joined before.

    Each round every part takes its heaviest pair to another part, so the rounds grow with the logarithm of n. Pairs of one
    weight stand in a mixed order, so that no row becomes the hub of all its equals.
    """
    order = np.lexsort((tk.mix(np.arange(len(a), dtype=np.uint64)), -weight))
    a, b, label, keep = a[order], b[order], np.arange(n), []
    while True:
        x, y = label[a], label[b]
        live = np.flatnonzero(x != y)
        if not len(live):
            return np.concatenate(keep) if keep else np.zeros(0, np.int64)
        a, b, order, x, y = a[live], b[live], order[live], x[live], y[live]
        best = np.full(n, len(a))
        np.minimum.at(best, x, np.arange(len(a)))
        np.minimum.at(best, y, np.arange(len(a)))
        part = np.flatnonzero(best < len(a))
        chosen = best[part]
        keep.append(order[np.unique(chosen)])
        up = np.arange(n)
        up[part] = np.where(x[chosen] == part, y[chosen], x[chosen])
        both = part[(up[up[part]] == part) & (part < up[part])]  # two parts that chose one pair
        up[both] = both
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def compare_blocks(rows: DataFrame, similarity: float, forest: bool) -> DataFrame:
    """Candidate pairs (a, b) among the members of each block pair.

    ``rows``: the fields of ``Members`` and registers; sorted by bucket, left and right block. A pair counts in the first band that
    it shares, so no pair comes from two buckets. With ``forest`` only a spanning forest of each block pair's likeliest pairs.
    """

    def closed(m: Members) -> pa.RecordBatch:
        a, b, estimate = m.pairs(similarity)
        if forest:
            # beyond the margin all are as good: else the text that all others come from would be the hub of the forest
            keep = spanning_forest(len(m), a, b, np.minimum(estimate, similarity + MARGIN))
            a, b = a[keep], b[keep]
        ids = m.c["node"]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Members | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = Members.of(batch)
            held = held.joined(now) if held else now
            last = int(held.cuts()[-2])  # the last block pair may go on
            if last:
                yield closed(held.part(0, last))
                held = held.part(last, len(held))
        if held:
            yield closed(held)
        tk.release()

    return rows.mapInArrow(run, "a long, b long")


def candidates(reps: DataFrame, labels: DataFrame | None, bands: int, similarity: float, temporary: list[DataFrame]) -> DataFrame:
    """Candidate pairs of representatives that share a band.

    Without ``labels`` (the first round) the forests of each block with itself and with the next. With labels (node, component)
    every pair of different labels: a member of its bucket's smallest label goes only to the blocks that hold other ones.
    ``temporary`` gets the scratch tables that can go once the pairs are written.
    """
    first = labels is None
    if first:
        named = reps.withColumn("label", F.col("node"))
    else:
        named = reps.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    member = banded(named, bands)
    open_buckets = member.groupBy("bucket").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    open_buckets = materialize(open_buckets.select("bucket", "size", "low", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "neardup-buckets")
    temporary.append(open_buckets)
    total = bands * reps.count()
    held = join_by_hot_keys(member, open_buckets, "bucket", "size", total).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    if first:
        step = lambda k: F.pmod(F.col("block") + k, F.col("blocks"))
        held = held.withColumn("other", F.explode(F.array_distinct(F.array(step(0), step(1), step(-1)))))
    else:
        held = materialize(held, "neardup-members")
        mixed = materialize(held.where("blocks > 1 and label <> low").groupBy("bucket").agg(F.collect_set("block").alias("mixed"), F.first("size").alias("size")), "neardup-buckets")
        temporary += [held, mixed]
        wide = join_by_hot_keys(held.where("blocks > 1").drop("size"), mixed, "bucket", "size", total)
        everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
        wide = wide.withColumn("other", F.explode(F.when(F.col("label") == F.col("low"), F.col("mixed")).otherwise(everywhere))).drop("mixed")
        held = held.where("blocks = 1").withColumn("other", F.lit(0)).unionByName(wide.select(*held.columns, "other"))
    held = held.select("bucket", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "node", "label", "band")
    rows = held.join(reps.select("node", "n_shingles", "registers"), "node")
    spread = rows.repartition(shuffle_partitions(reps.sparkSession), "bucket", "left", "right").sortWithinPartitions("bucket", "left", "right")
    return compare_blocks(spread.select(*Members.FIELDS, "registers"), similarity, first)


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words: int, percent: int, temporary: list[DataFrame]) -> DataFrame:
    """The pairs (a, b) of representatives whose full shingle sets have 100 * common >= percent * union.

    Every row that travels carries one text: that of ``a`` once for each ``FAN`` of its partners, then those of the partners.
    """
    pairs = materialize(pairs, "neardup-pairs")
    temporary.append(pairs)
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(reps.select("node", "doc_id", "text_key"), "node")
    needed = needed.select("node", F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    # one text for each representative, however often its row is repeated
    texts = docs.join(needed, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))).groupBy("node").agg(F.first("text").alias("text"))
    fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("parts"))
    heads = fan.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(texts.withColumnRenamed("node", "a"), "a")
    partners = pairs.join(fan, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")).join(texts.withColumnRenamed("node", "b"), "b")
    rows = heads.select("a", "part", F.lit(None).cast("long").alias("b"), "text").unionByName(partners.select("a", "part", "b", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: np.ndarray | None = None
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            head = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in tk.blocks(*tk.buffers(batch.column(2))):
                for i, found in enumerate(tk.shingle_sets(data, offsets, words), lo):
                    if head[i]:
                        own = found
                    else:
                        common = len(own) + len(found) - len(np.union1d(own, found))
                        keep[i] = 100 * common >= percent * (len(own) + len(found) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))
        tk.release()

    spread = rows.repartition(shuffle_partitions(docs.sparkSession), "a", "part").sortWithinPartitions("a", "part", "b")
    return spread.select("a", "b", "text").mapInArrow(run, "a long, b long")


def _rank() -> Column:
    """The order in which rows name a group: by doc_id, nulls last, then by the text's hash."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_key").alias("text_key"))


def marked(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_key, n_shingles, best) of every row: ``best`` is the first (none, doc_id, text_key) of the row's group.

    ``text_key`` is the text's 64-bit hash; with doc_id it tells rows of one id apart. A group are the rows whose sets are linked;
    rows without shingles are groups of their own.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    sets = materialize(sketches(docs, words), "neardup-sets")
    full = sets.where("n_shingles > 0")
    # one representative of each distinct set, with a number of its own
    reps = full.groupBy("digest").agg(F.min(_rank()).alias("best"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"), F.count("*").alias("copies"))
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("node"), "digest", "best", "best.doc_id", "best.text_key", "n_shingles", "registers", "copies"), "neardup-reps")
    percent = round(100 * similarity)

    def links(labels: DataFrame | None, bands: int) -> DataFrame:
        temporary: list[DataFrame] = []
        found = materialize(confirmed(candidates(reps, labels, bands, similarity, temporary), reps, docs, words, percent, temporary), "neardup-links")
        for df in temporary:
            drop_scratch(spark, df)
        return found

    first = links(None, FIRST_BANDS)
    labels = min_label_components(first, tag="neardup")
    second = links(labels, BANDS)
    final = min_label_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second), tag="neardup")
    for df in (first, second, labels):
        drop_scratch(spark, df)
    linked = reps.select("node", "digest", "best", "copies").join(final, "node", "left")
    groups = linked.where("component is not null").groupBy("component").agg(F.min("best").alias("group_best"))
    named = materialize(linked.join(groups, "component", "left").select("digest", "copies", F.coalesce("group_best", "best").alias("best")).where("copies > 1 or group_best is not null"), "neardup-named")
    drop_scratch(spark, reps)
    shown = sets.select("doc_id", "text_key", "n_shingles", "digest")
    total = sets.count()
    limit = hot_limit(spark, total)
    hot, cold = named.where(F.col("copies") > limit), named.where(F.col("copies") <= limit)
    alone = shown.where("n_shingles = 0").withColumn("best", _rank())
    many = shown.where("n_shingles > 0").join(F.broadcast(hot.select("digest", "best")), "digest")
    others = shown.where("n_shingles > 0").join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold.select("digest", F.col("best").alias("named")), "digest", "left").withColumn("best", F.coalesce("named", _rank()))
    columns = ["doc_id", "text_key", "n_shingles", "best"]
    return alone.select(*columns).unionByName(many.select(*columns)).unionByName(others.select(*columns))


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Links rows whose sets of ``words``-word shingles (A-Z lower-cased) have a Jaccard similarity of ``similarity`` or more; a
    component is named by its smallest doc_id, and ``kept`` tells whether that is the row's. Texts that are null or hold no word
    link with nothing. Rows of one doc_id with different texts are documents of their own, repeated rows copies of each other. A
    row with a null doc_id takes part, but names a component only where no row of it has an id. Other columns are ignored.
    """
    found = marked(docs, words, similarity).select("doc_id", "n_shingles", F.col("best.doc_id").alias("component_id"))
    return found.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def without_near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near duplicates, with all its columns.

    The row with the smallest doc_id stays (nulls last); of several texts under that id the one whose hash is smallest, of repeated
    rows the one whose columns, written as JSON, are smallest: columns may be of any type. Rows without any word all stay.
    """
    rows = marked(docs, words, similarity).groupBy("doc_id", "text_key", "n_shingles", "best").agg(F.count("*").alias("n"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    go = materialize(rows.where((F.col("n_shingles") > 0) & (~stays | (F.col("n") > 1))).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "n", stays.alias("__stays")), "neardup-go")
    keyed = docs.withColumn("__text", F.xxhash64("text"))
    match = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key"))
    limit = hot_limit(docs.sparkSession, docs.count())
    rest = keyed.join(F.broadcast(go.where(F.col("n") > limit)), match, "left_anti").join(go.where(F.col("n") <= limit), match, "left_anti")
    # repeated rows: the smallest by all columns as text, put together per task first
    again = keyed.join(go.where("__stays").select("__id", "__key"), match).groupBy("doc_id", "__text").agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("row"))
    return rest.select(*docs.columns).unionByName(again.select("row.*"))


def op4_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents on 4-word shingles at 100 * intersection >= 80 * union; see ``near_duplicates`` for nulls, repeats and empty texts."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, similarity=0.8)
