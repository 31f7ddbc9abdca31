"""Near-duplicate vectors by cross-polytope hashing.

Each hash rotates the vector by three rounds of random signs and a fast Hadamard transform and takes the closest signed
axis; two hashes make a table's bucket. Besides its own bucket a vector also visits those with the second-closest axis of
either hash (multiprobe). Vectors of one label that meet in a bucket are candidates; their cosine is computed in double
precision. Equal vectors are collapsed first.

Only a number, a bucket and 64 signs of random projections travel to the buckets. A member whose signs are like no other's
there goes no further; the others' vectors are fetched and compared exactly. Large buckets are cut into blocks that are
compared block by block inside tasks, which return counts and a spanning forest of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygrid.common import bound_batches, drop_scratch, hot_limit, join_by_hot_keys, materialize, shuffle_partitions, table
from quarrygrid.llm import textkernel as tk
from quarrygrid.llm.neardup import spanning_forest
from quarrygrid.operators.graph_core import min_label_components

#: With 6 tables and these probes, random pairs at a cosine of exactly 0.93 meet with probability 0.9997 (3000 trials in 64 dimensions).
TABLES, HASHES, COSINE, BLOCK, SMALL = 6, 2, 0.93, 2048, 48
#: Signs of random projections, and the standard deviations beyond the mean within which the signs of a link may differ.
SIGNS, DEVIATIONS = 64, 4.5


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of every row; the width is a power of two."""
    n, width, h = len(x), x.shape[1], 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(n, width)
        h *= 2
    return x


def bucket_keys(vectors: np.ndarray, salt: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """For every row the keys of its bucket in each table, followed by those of the probes: (rows, 3 * tables)."""
    n, d = vectors.shape
    width = 1 << max(1, (d - 1).bit_length())
    base = np.zeros((n, width))
    base[:, :d] = vectors
    rng = np.random.default_rng(width)
    out = np.zeros((n, 3, tables), np.uint64)
    for t in range(tables):
        best, second = [], []
        for _ in range(HASHES):
            y = base
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width)) / np.sqrt(width)
            size = np.abs(y)
            top = size.argmax(1)
            rows = np.arange(n)
            first = top * 2 + (y[rows, top] < 0)
            size[rows, top] = -1
            top = size.argmax(1)
            best.append(first.astype(np.uint64))
            second.append((top * 2 + (y[rows, top] < 0)).astype(np.uint64))
        for p, (a, b) in enumerate(((best[0], best[1]), (second[0], best[1]), (best[0], second[1]))):
            out[:, p, t] = tk.mix(tk.mix(salt + np.uint64(t)) ^ (a * np.uint64(1 << 20) + b))
    return out.reshape(n, 3 * tables).view(np.int64)


def signs(vectors: np.ndarray) -> np.ndarray:
    """The signs of 64 random projections of every row as one number."""
    directions = np.random.default_rng(vectors.shape[1] + 1).standard_normal((vectors.shape[1], SIGNS))
    return np.packbits(vectors @ directions > 0, axis=1).view(np.uint64).ravel()


def sign_limit(cosine: float) -> int:
    """Signs that may differ between two vectors of that cosine."""
    share = np.arccos(np.clip(cosine, -1, 1)) / np.pi
    return int(SIGNS * share + DEVIATIONS * np.sqrt(SIGNS * share * (1 - share)))


def hashed(vectors: DataFrame) -> DataFrame:
    """(node, vector binary, keys binary, signs) of distinct vectors (node, embedding, label); the label and the dimension are part of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            size = np.array([len(r) for r in rows], np.int64)
            salts = tk.mix(batch.column(2).to_numpy().astype(np.int64).view(np.uint64)) + size.astype(np.uint64)
            unit_all, keys_all, signs_all = [b""] * len(rows), [b""] * len(rows), np.zeros(len(rows), np.uint64)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = np.array([rows[i] for i in at], np.float64)
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                signs_all[at] = signs(x)
                for i, u, k in zip(at, x, bucket_keys(x, salts[at]), strict=True):
                    unit_all[i], keys_all[i] = u.tobytes(), k.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(unit_all, pa.binary()), pa.array(keys_all, pa.binary()), pa.array(signs_all.view(np.int64))], ["node", "vector", "keys", "signs"])

    return vectors.select("node", "embedding", "label").mapInArrow(run, "node long, vector binary, keys binary, signs long")


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One shared key of each pair of rows, the same in whichever bucket they meet.

    The first slot in which both have the same key; only pairs without such a slot are compared across slots.
    """
    same = a == b
    slot = same.argmax(1)
    out = a[np.arange(len(a)), slot]
    rest = np.flatnonzero(~same[np.arange(len(a)), slot])
    x, y = a[rest], b[rest]
    out[rest] = np.where((x[:, :, None] == y[:, None, :]).any(2), x, np.iinfo(np.int64).max).min(1)
    return out


class Group:
    """Members of block pairs, sorted so that a block pair's rows stand together. ``columns`` are arrays of one length."""

    PLACE = ("bucket", "left", "right", "block", "node")

    def __init__(self, columns: dict[str, np.ndarray]):
        self.c = columns

    def __len__(self) -> int:
        return len(self.c["bucket"])

    def cuts(self) -> np.ndarray:
        c = self.c
        new = (c["bucket"][1:] != c["bucket"][:-1]) | (c["left"][1:] != c["left"][:-1]) | (c["right"][1:] != c["right"][:-1])
        return np.concatenate(([0], np.flatnonzero(new) + 1, [len(self)]))

    def part(self, lo: int, hi: int) -> Group:
        return Group({f: x[lo:hi] for f, x in self.c.items()})

    def joined(self, other: Group) -> Group:
        return Group({f: np.concatenate((x, other.c[f])) for f, x in self.c.items()})

    def pairs(self, within_crossed: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of one block pair, some ten thousand at a time: small groups together, by distance; large ones row by row.

        Of two blocks the pairs across; with ``within_crossed`` also those inside either block.
        """
        cuts = self.cuts()
        sizes = np.diff(cuts)
        group = np.repeat(np.arange(len(sizes)), sizes)
        crossed = self.c["left"] != self.c["right"]
        small = np.flatnonzero(np.repeat(sizes <= SMALL, sizes) & ~crossed)
        for d in range(1, min(SMALL, len(small))):
            same = group[small[:-d]] == group[small[d:]]
            if not same.any():
                break
            yield small[:-d][same], small[d:][same]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if hi - lo <= SMALL and not crossed[lo]:
                continue
            own = np.arange(lo, hi)
            if not crossed[lo] or within_crossed:
                one, other = own, own
            else:
                first = self.c["block"][lo:hi] == self.c["left"][lo]
                one, other = own[first], own[~first]
            step = max(1, 65536 // max(1, len(other)))
            for i in range(0, len(one), step):
                a, b = (x.ravel() for x in np.meshgrid(one[i : i + step], other, indexing="ij"))
                if one is other:
                    a, b = a[a < b], b[a < b]
                yield a, b


def grouped(batches: Iterator[pa.RecordBatch], of) -> Iterator[Group]:
    """Groups of whole block pairs from sorted batches; ``of`` makes a group of a batch. No more than a batch and a block pair is held."""
    held: Group | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = of(batch)
        held = held.joined(now) if held else now
        last = int(held.cuts()[-2])  # the last block pair may go on
        if last:
            yield held.part(0, last)
            held = held.part(last, len(held))
    if held:
        yield held


def _columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {f: batch.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(names)}


def survivors(rows: DataFrame, limit: int) -> DataFrame:
    """The members (bucket, left, right, block, node) whose signs differ from another's of the block pair in at most ``limit`` places."""
    names = (*Group.PLACE, "signs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in grouped(batches, lambda b: Group(_columns(b, names))):
            near, own = np.zeros(len(m), bool), m.c["signs"].view(np.uint64)
            for a, b in m.pairs(False):
                hit = np.bitwise_count(own[a] ^ own[b]) <= limit
                near[a[hit]] = True
                near[b[hit]] = True
            yield pa.RecordBatch.from_arrays([pa.array(m.c[f][near]) for f in Group.PLACE], list(Group.PLACE))

    return rows.select(*names).mapInArrow(run, "bucket long, left int, right int, block int, node long")


def block_links(rows: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n): rows of ``b`` null hold the links of a (weighted by copies) in a block pair; the others a spanning forest.

    A pair counts only in the bucket of ``first_shared``. Of two blocks only edges come back that join what the bucket's links inside
    the blocks leave apart: those links come from the blocks' own comparison.
    """
    names = (*Group.PLACE, "copies")

    def of(batch: pa.RecordBatch) -> Group:
        columns = _columns(batch, names)
        columns["width"] = np.array([len(v) for v in batch.column(6).to_pylist()], np.int64)
        size = int(columns["width"].max())
        flat = b"".join(v.ljust(size, b"\0") for v in batch.column(6).to_pylist())  # the products of padded vectors are the same
        columns["vector"] = np.frombuffer(flat, np.float64).reshape(len(batch), -1)
        columns["keys"] = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.int64).reshape(len(batch), -1)
        return Group(columns)

    def wide(m: Group, other: Group) -> tuple[Group, Group]:
        size = max(m.c["vector"].shape[1], other.c["vector"].shape[1])
        pad = lambda g: Group({**g.c, "vector": np.pad(g.c["vector"], ((0, 0), (0, size - g.c["vector"].shape[1])))})
        return pad(m), pad(other)

    class Vectors(Group):
        def joined(self, other: Group) -> Group:
            a, b = wide(self, other)
            return Vectors(Group.joined(a, b).c)

        def part(self, lo: int, hi: int) -> Group:
            return Vectors(Group.part(self, lo, hi).c)

    def links(m: Group) -> pa.RecordBatch:
        x, keys, found = m.c["vector"], m.c["keys"], []
        for a, b in m.pairs(True):
            hit = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
            a, b = a[hit], b[hit]
            mine = first_shared(keys[a], keys[b]) == m.c["bucket"][a] if len(a) else hit[:0]
            found.append((a[mine], b[mine]))
        a, b = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        block, ids, copies = m.c["block"], m.c["node"], m.c["copies"]
        crossed = m.c["left"] != m.c["right"]
        inner = crossed[a] & (block[a] == block[b])  # of two blocks, what either one's own comparison counts
        total = np.bincount(a[~inner], copies[b[~inner]], len(ids)).astype(np.int64) + np.bincount(b[~inner], copies[a[~inner]], len(ids)).astype(np.int64)
        keep = spanning_forest(len(ids), a, b, inner.astype(np.float64))  # the inner ones first
        keep = keep[~inner[keep]]
        some = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate((ids[some], ids[a[keep]]))), pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[b[keep]], pa.int64())]),
            pa.array(np.concatenate((total[some], np.zeros(len(keep), np.int64)))),
        ], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in grouped(batches, lambda b: Vectors(of(b).c)):
            yield links(m)

    return rows.select(*names, "vector", "keys").mapInArrow(run, "a long, b long, n long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Only vectors with equal labels are compared. A vector that is null, empty, zero, or holds a null, infinite or NaN component, and
    one without label, links with nothing: it has no links and is its own kept component. Vectors of different
    dimensions don't link. Equal vectors link with each other; repeated rows of one vec_id count as vectors of their own, also with
    different vectors. Rows with a null vec_id link with nothing. Other columns are ignored.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    parts = shuffle_partitions(spark)
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    good = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
        & ~F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("embedding", lambda e: e != 0), F.lit(False)
    )
    # equal vectors of a label have one key: 96 bits of two hashes
    rows = rows.withColumns({"good": good, "key": F.struct(F.xxhash64("label", "embedding"), F.hash("embedding", "label"))})
    distinct = rows.where("good").groupBy("key").agg(F.min("vec_id").alias("best"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"), F.first("label").alias("label"))
    reps = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "vecdup-reps")
    held = materialize(hashed(reps.repartition(parts, "node")), "vecdup")
    raw = held.select("node", "keys", "signs").mapInArrow(_explode_keys, "node long, bucket long, signs long")
    large = raw.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    large = materialize(large, "vecdup-large")
    total = 3 * TABLES * reps.count()
    zero = F.lit(0)
    placed = raw.join(large.select("bucket"), "bucket", "left_anti").select("bucket", zero.alias("left"), zero.alias("right"), zero.alias("block"), "node", "signs")
    cut = join_by_hot_keys(raw, large, "bucket", "size", total).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("bucket", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "node", "signs")
    order = ("bucket", "left", "right")
    spread = placed.unionByName(cut).repartition(parts, *order).sortWithinPartitions(*order)
    near = survivors(spread, sign_limit(cosine)).join(reps.select("node", "copies"), "node").join(held.select("node", "vector", "keys"), "node")
    found = materialize(block_links(near.repartition(parts, *order).sortWithinPartitions(*order), cosine), "vecdup-links")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    comps = min_label_components(found.where("b is not null"), tag="vecdup")
    linked = comps.join(links, "node", "left").join(reps.select("node", "key", "best", "copies"), "node")
    groups = linked.groupBy("component").agg(F.min("best").alias("group_best"))
    linked = linked.join(groups, "component").select("key", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.col("group_best").alias("component_id"))
    copied = reps.where("copies > 1").join(comps.select("node"), "node", "left_anti").select("key", "copies", F.lit(0).alias("n"), F.col("best").alias("component_id"))
    named = materialize(linked.unionByName(copied).select("key", "copies", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id"), "vecdup-named")
    for df in (held, large, found, comps, reps):
        drop_scratch(spark, df)
    shown = rows.select("vec_id", "good", "key")
    limit = hot_limit(spark, shown.count())
    hot, cold = named.where(F.col("copies") > limit), named.where(F.col("copies") <= limit)
    alone = shown.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    many = shown.where("good").join(F.broadcast(hot), "key").select("vec_id", "n_links", "component_id")
    others = shown.where("good").join(F.broadcast(hot.select("key")), "key", "left_anti").join(cold, "key", "left")
    others = others.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return alone.unionByName(many).unionByName(others).withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))


def _explode_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [np.unique(np.frombuffer(k, np.int64)) for k in batch.column(1).to_pylist()]
        size = [len(k) for k in keys]
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), size)), pa.array(flat), pa.array(np.repeat(batch.column(2).to_numpy(), size))], ["node", "bucket", "signs"])


def op6_crosspolytope_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.93 or more within a label; see ``near_vectors`` for nulls and repeats."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
