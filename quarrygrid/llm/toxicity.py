"""Toxicity by class-conditional Kneser-Ney models of characters.

A text is its normal form: A-Z lower-cased, digits alike, all else that is no letter one space between words. Grams of six bytes are
counted over the whole corpus, and beside that how many toxic and ordinary texts of the labelled rows hold each (texts, not places: a
word that one text repeats is no evidence). Both classes have a model of their own at the highest order and share everything below:
the probability of a byte after four bytes and fewer comes from continuation counts of all documents, discounted at each order
(Kneser-Ney). So an expression that neither class has, or few texts of one, is judged by shared counts and tells nothing or little.

A gram's log ratio is a number of the model. A text is compared by its length-normalised log ratio as a whole and by that of its most
toxic passage of ``PASSAGE`` bytes, since a few words make a long text toxic; a logistic function of both, fitted on labelled rows that
the class counts leave out, gives the score.

Tasks hold the log ratios of what most labelled texts have. Where there are more, the texts are dealt in blocks, and the other log ratios that
a block asks for come to it by a join, so every text is measured by the whole model.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrygrid.common import bound_batches, bounded_choice, broadcast_if_few, drop_scratch, materialize, shuffle_partitions, table
from quarrygrid.llm import textkernel as tk

ORDER, PASSAGE = 6, 32
#: Grams, and contexts, with their log ratios that the broadcast model holds at most (12 bytes each); the most frequent ones. Others stay in a table.
MODEL_GRAMS = 4_000_000
#: Bytes of rows from which a block asks for log ratios that the model does not hold, and bits of its number that count the blocks of a task.
ASKING_BYTES, BLOCK_BITS = 16 << 20, 33
#: One labelled row of so many is left out of the class counts and calibrates; at most so many rows do.
CALIBRATE_ONE_OF, CALIBRATION_ROWS = 6, 20_000
#: Distinct grams that a task holds before it passes them on.
HELD_GRAMS = 2_000_000
TOXIC, ORDINARY, UNKNOWN = 1, 0, -1

_FORM = np.full(256, 32, np.uint8)
_FORM[128:] = np.arange(128, 256)
_FORM[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FORM[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FORM[ord("0") : ord("9") + 1] = ord("0")


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams of every row's normal form as numbers, the last byte lowest, and the place of each row's first; one for each byte and for the end.

    A row without any letter or digit has none. Before a text stand ``ORDER - 1`` spaces.
    """
    n = len(offsets) - 1
    form = _FORM[data]
    inside = form != 32
    first, _ = tk.edge_flags(len(data), offsets)
    first[1:] |= ~inside[:-1]
    starts = np.flatnonzero(first & inside)
    before = np.searchsorted(starts, offsets)
    later = np.ones(len(starts), bool)
    later[before[:-1][before[1:] > before[:-1]]] = False  # all but each row's first word have a space before them
    inside[starts[later] - 1] = True
    kept = np.concatenate(([0], np.cumsum(inside)))[offsets]
    size = np.diff(kept)
    row = np.where(size > 0, size + ORDER, 0)
    ends = np.concatenate(([0], np.cumsum(row)))
    out = np.full(ends[-1], 32, np.uint64)
    out[np.arange(kept[-1]) + np.repeat(ends[:-1] - kept[:-1] + ORDER - 1, size)] = form[inside]
    if not len(out):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    keys = out[ORDER - 1 :].copy()
    for j in range(1, ORDER):
        keys |= out[ORDER - 1 - j : len(out) - j] << np.uint64(8 * j)
    count = np.where(size > 0, size + 1, 0)
    places = np.concatenate(([0], np.cumsum(count)))
    own = np.arange(places[-1]) + np.repeat(ends[:-1] - places[:-1], count)
    return keys[own].view(np.int64), places


class Tally:
    """In how many toxic and in how many ordinary texts grams are, merged as they come."""

    def __init__(self):
        self.keys, self.counts, self.waiting = np.zeros(0, np.int64), np.zeros((0, 2), np.int64), []

    def add(self, keys: np.ndarray, row: np.ndarray, labels: np.ndarray) -> None:
        """``row``: the text of each gram, of which there are at most 65536; ``labels``: the class of each text."""
        label = labels[row]
        for kind in (TOXIC, ORDINARY, UNKNOWN):
            own = label == kind
            once = keys[own] if kind == UNKNOWN else np.unique(keys[own].view(np.uint64) << np.uint64(16) | row[own].astype(np.uint64)) >> np.uint64(16)
            found, n = np.unique(once.astype(np.int64), return_counts=True)
            counts = np.zeros((len(found), 2), np.int64)
            if kind != UNKNOWN:
                counts[:, kind] = n
            self.waiting.append((found, counts))

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.waiting = keys[new], []
        self.counts = np.add.reduceat(counts[order], new) if len(new) else self.counts[:0]

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for lo in range(0, len(self.keys), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(self.keys[part]), pa.array(self.counts[part, TOXIC]), pa.array(self.counts[part, ORDINARY])], ["key", "toxic", "ordinary"])
        self.__init__()


def gram_counts(docs: DataFrame) -> DataFrame:
    """(key, toxic, ordinary) of every gram in rows (text, label): how many toxic and ordinary texts have it; 0 and 0 if only texts without label do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, since = Tally(), 0
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in tk.blocks(*tk.buffers(batch.column(0))):
                keys, places = grams(data, offsets)
                for first in range(0, hi - lo, 1 << 16):
                    size = np.diff(places[first : first + (1 << 16) + 1])
                    part = slice(places[first], places[first + len(size)])
                    tally.add(keys[part], np.repeat(np.arange(len(size)), size), labels[lo + first : lo + first + len(size)])
                since += len(keys)
                if since > 4 * tk.BLOCK_BYTES:
                    tally.merge()
                    since = 0
                    if len(tally.keys) > HELD_GRAMS:
                        yield from tally.batches()
        yield from tally.batches()
        tk.release()

    partial = docs.select("text", "label").mapInArrow(run, "key long, toxic long, ordinary long")
    return partial.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _last(key: str, n: int) -> Column:
    return F.col(key).bitwiseAND((1 << (8 * n)) - 1)


def _discount(one: int, two: int) -> float:
    """The discount of a table of counts of which ``one`` and ``two`` are 1 and 2: n1 / (n1 + 2 n2), within bounds."""
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5


def _ones_and_twos(count: str) -> list[Column]:
    return [F.count(F.when(F.col(count) == k, 1)) for k in (1, 2)]


def pair_probabilities(counts: np.ndarray) -> np.ndarray:
    """The probability of the second byte after the first, from the continuation counts of pairs of bytes (256 by 256)."""

    def smoothed(c: np.ndarray, lower: np.ndarray | float) -> np.ndarray:
        d = _discount(int((c == 1).sum()), int((c == 2).sum()))
        total = np.maximum(c.sum(-1, keepdims=True), 1)
        return (np.maximum(c - d, 0) + d * (c > 0).sum(-1, keepdims=True) * lower) / total

    return smoothed(counts, smoothed((counts > 0).sum(0), 1 / 256))


def shared_probabilities(counts: DataFrame) -> DataFrame:
    """(key, p): the probability of the last byte of each gram of ``ORDER - 1`` bytes after the others, from continuation counts of all texts.

    Pairs of bytes, of which there are 65536, pass through the driver; longer grams stay in tables.
    """
    spark, levels, types = counts.sparkSession, {}, counts
    for n in range(ORDER - 1, 2, -1):  # of how many different bytes before it a gram is the continuation
        types = levels[n] = materialize(types.groupBy(_last("key", n).alias("key")).agg(F.count("*").alias("c")), f"toxicity-{n}")
    found = reduce(DataFrame.unionAll, [df.agg(F.lit(n).alias("n"), *_ones_and_twos("c")) for n, df in levels.items()])
    discounts = {n: _discount(one, two) for n, one, two in found.collect()}
    pairs = types.groupBy(_last("key", 2).alias("key")).agg(F.count("*").alias("c")).toArrow().to_pandas()
    table = np.zeros((256, 256), np.int64)
    table.ravel()[pairs["key"].to_numpy(np.int64)] = pairs["c"].to_numpy()
    held = pairs["key"].to_numpy(np.int64)
    p = spark.createDataFrame(list(zip(held.tolist(), pair_probabilities(table).ravel()[held].tolist(), strict=True)), "key long, p double").hint("broadcast")
    w = Window.partitionBy(F.shiftright("key", 8))
    for n in range(3, ORDER):
        rows = levels[n].select("key", "c", F.sum("c").over(w).alias("total"), F.count("*").over(w).alias("types"), _last("key", n - 1).alias("shorter"))
        rows = rows.join(p.select(F.col("key").alias("shorter"), F.col("p").alias("below")), "shorter")
        d = discounts[n]
        p = rows.select("key", ((F.greatest(F.col("c") - d, F.lit(0.0)) + d * F.col("types") * F.col("below")) / F.col("total")).alias("p"))
    p = materialize(p, "toxicity-shared")
    for df in levels.values():
        drop_scratch(spark, df)
    return p


def log_ratios(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, seen, ratio) of the grams and of the contexts that labelled texts have: the log of the toxic by the ordinary probability.

    A context's ratio is that of what neither class has after it: the ratio of both shares that go to the shared counts.
    """
    kinds = ("toxic", "ordinary")
    w = Window.partitionBy("context")
    known = counts.where("toxic + ordinary > 0").withColumn("context", F.shiftright("key", 8))
    shared = shared_probabilities(counts)
    seen = known.agg(*(c for k in kinds for c in _ones_and_twos(k))).first()
    d = {k: _discount(seen[2 * i], seen[2 * i + 1]) for i, k in enumerate(kinds)}
    sums = {f"all_{k}": F.sum(k) for k in kinds} | {f"types_{k}": F.count(F.when(F.col(k) > 0, 1)) for k in kinds}
    left = {k: F.when(F.col(f"all_{k}") > 0, d[k] * F.col(f"types_{k}") / F.col(f"all_{k}")).otherwise(1.0) for k in kinds}
    rows = known.withColumns({name: c.over(w) for name, c in sums.items()}).withColumn("shorter", _last("key", ORDER - 1)).join(shared.select(F.col("key").alias("shorter"), "p"), "shorter")
    own = {k: F.when(F.col(f"all_{k}") > 0, F.greatest(F.col(k) - d[k], F.lit(0.0)) / F.col(f"all_{k}")).otherwise(0.0) + left[k] * F.col("p") for k in kinds}
    found = rows.select("key", (F.col("toxic") + F.col("ordinary")).alias("seen"), F.log(own["toxic"] / own["ordinary"]).cast("float").alias("ratio"))
    contexts = known.groupBy("context").agg(*(c.alias(name) for name, c in sums.items()))
    return found, contexts.select(F.col("context").alias("key"), (F.col("all_toxic") + F.col("all_ordinary")).alias("seen"), F.log(left["toxic"] / left["ordinary"]).cast("float").alias("ratio"))


def most_seen(rows: DataFrame, most: int = MODEL_GRAMS) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame | None]:
    """Keys and ratios of at most ``most`` rows, and a table of all others: none, or those seen no more often than a count that a histogram of the counts gives."""
    rows = materialize(rows.select("key", F.least("seen", F.lit(100_000)).alias("seen"), "ratio"), "toxicity-ratios")
    least, total = 1, 0
    for seen, n in rows.groupBy("seen").agg(F.count("*").alias("n")).orderBy(F.desc("seen")).collect():
        total += n
        if total > most:
            least = seen + 1
            break
    found = rows.where(F.col("seen") >= least).select("key", "ratio").toArrow()
    rest = rows.where(F.col("seen") < least).select("key", "ratio") if total > most else None
    if rest is None:
        drop_scratch(rows.sparkSession, rows)
    return (found["key"].to_numpy(), found["ratio"].to_numpy()), rest


class Lookup:
    """Numbers by key: a row of hash tables, each for the keys that found their place taken in the one before; unknown keys give NaN."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        while len(keys):
            bits = max(4, int(np.ceil(np.log2(2 * len(keys)))))
            at = self._slots(keys, bits, len(self.levels))
            _, pick = np.unique(at, return_index=True)
            own, held = np.full(1 << bits, -1, np.int64), np.full(1 << bits, np.nan, np.float32)
            own[at[pick]], held[at[pick]] = keys[pick], values[pick]
            self.levels.append((bits, own, held))
            rest = np.ones(len(keys), bool)
            rest[pick] = False
            keys, values = keys[rest], values[rest]

    @staticmethod
    def _slots(keys: np.ndarray, bits: int, level: int) -> np.ndarray:
        odd = np.uint64((0x9E3779B97F4A7C15 + 0x6A09E667F3BCC908 * level) & 0xFFFFFFFFFFFFFFFF | 1)
        return ((keys.view(np.uint64) * odd) >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), np.nan, np.float32)
        left = None
        for i, (bits, own, held) in enumerate(self.levels):
            asked = keys if left is None else keys[left]
            at = self._slots(asked, bits, i)
            hit = own[at] == asked
            if left is None:
                out[hit] = held[at[hit]]
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] = held[at[hit]]
                left = left[~hit]
            if not len(left):
                break
        return out


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class Model:
    """Log ratios of grams and contexts, all or the most frequent ones, and the logistic function of a text's measures."""

    def __init__(self, grams: tuple[np.ndarray, np.ndarray], contexts: tuple[np.ndarray, np.ndarray], all_contexts: bool = True):
        self.grams, self.contexts, self.all_contexts = Lookup(*grams), Lookup(*contexts), all_contexts
        self.weights = np.zeros(4)

    def asked(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The grams and contexts of the rows that are not held and may be known, once each. No gram is known without its context."""
        keys = np.unique(grams(data, offsets)[0])
        keys = keys[np.isnan(self.grams(keys))]
        unheld = np.isnan(self.contexts(keys >> 8))
        return keys[~unheld] if self.all_contexts else np.concatenate((keys, np.unique(keys[unheld] >> 8)))

    def measures(self, data: np.ndarray, offsets: np.ndarray, answers: Lookup | None = None) -> np.ndarray:
        """Of each row the mean log ratio, that of its most toxic passage, and the logarithm of its length; 0 for a row without grams.

        ``answers``: log ratios of what the rows ask for. A gram's first byte is 32 at least, so no context has the number of a gram.
        """
        keys, places = grams(data, offsets)
        ratio = self.grams(keys)
        sources = [(self.contexts, 8)] if answers is None else [(answers, 0), (self.contexts, 8), (answers, 8)]
        missing = np.flatnonzero(np.isnan(ratio))
        for source, bits in sources:
            ratio[missing] = source(keys[missing] >> bits)
            missing = missing[np.isnan(ratio[missing])]
        ratio[missing] = 0
        run = np.concatenate(([0.0], np.cumsum(ratio, dtype=np.float64)))
        size = np.diff(places)
        out = np.zeros((len(size), 3))
        full = np.flatnonzero(size)
        if not len(full):
            return out
        out[full, 0] = (run[places[1:]] - run[places[:-1]])[full] / size[full]
        # the passage that ends at each place, or the whole beginning where that is shorter
        begin = np.maximum(np.arange(1, len(run)) - PASSAGE, np.repeat(places[:-1], size))
        out[full, 1] = np.maximum.reduceat(run[1:] - run[begin], places[:-1][full]) / PASSAGE
        out[full, 2] = np.log1p(size[full]) / 10
        return out

    def calibrate(self, measures: np.ndarray, labels: np.ndarray) -> None:
        """Logistic regression by Newton steps, drawn towards no weight by a thousandth."""
        if not len(labels) or labels.min() == labels.max():
            share = (labels.sum() + 0.5) / (len(labels) + 1)
            self.weights = np.array([4.0, 4.0, 0.0, np.log(share / (1 - share))])
            return
        self.centre, self.scale = measures.mean(0), measures.std(0) + 1e-9
        x = np.column_stack(((measures - self.centre) / self.scale, np.ones(len(labels))))
        w = np.zeros(4)
        ridge = np.diag([1e-3 * len(labels)] * 3 + [1e-6])
        for _ in range(50):
            p = logistic(x @ w)
            step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (labels - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        slopes = w[:3] / self.scale
        self.weights = np.append(slopes, w[3] - slopes @ self.centre)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows whose labels no model learns: crc32(doc_id as text) mod 5 = 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def measured(docs: DataFrame, model: Model, rest: DataFrame | None) -> DataFrame:
    """(doc_id, a, b, c): the measures of every row (doc_id, text) by the model's log ratios and those of ``rest`` (key, ratio).

    Without a rest each task measures the rows that it reads. Else runs of Arrow batches are blocks (block, rows, asked), which ask once for
    each gram that the model does not hold; they are written, as both their requests and their rows, compressed, are read again.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    schema, shared = f"doc_id {kind}, a double, b double, c double", spark.sparkContext.broadcast(model)

    def measure(ids: pa.Array, texts: pa.Array | pa.ChunkedArray, answers: Lookup | None = None) -> Iterator[pa.RecordBatch]:
        for lo, hi, data, offsets in tk.blocks(*tk.buffers(texts)):
            m = shared.value.measures(data, offsets, answers)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *(pa.array(c) for c in m.T)], ["doc_id", "a", "b", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from measure(batch.column(0), batch.column(1))
        tk.release()

    if rest is None:
        return docs.select("doc_id", "text").mapInArrow(run, schema)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size = TaskContext.get().partitionId() << BLOCK_BITS, [], 0
        for i, batch in enumerate(chain(batches, (None,))):
            if held and (batch is None or size >= ASKING_BYTES):
                sink, parts = pa.BufferOutputStream(), [np.zeros(0, np.int64)]
                with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    for one in held:
                        out.write_batch(one)
                        parts += [shared.value.asked(data, offsets) for _, _, data, offsets in tk.blocks(*tk.buffers(one.column(1)))]
                yield pa.RecordBatch.from_pylist([{"block": first + i, "rows": sink.getvalue().to_pybytes(), "asked": np.unique(np.concatenate(parts))}], asking)
                held, size = [], 0
            if batch is not None and batch.num_rows:
                held.append(batch)
                size += batch.nbytes
        tk.release()

    def answer(blocks: pa.Table, found: pa.Table) -> pa.Table:
        answers = Lookup(found.column("key").to_numpy(), found.column("ratio").to_numpy())
        rows = (batch for block in blocks.column("rows") for batch in pa.ipc.open_stream(block.as_buffer()))
        return pa.Table.from_batches(m for batch in rows for m in measure(batch.column(0), batch.column(1), answers))

    asking = pa.schema([("block", pa.int64()), ("rows", pa.binary()), ("asked", pa.list_(pa.int64()))])
    blocks = materialize(docs.select("doc_id", "text").mapInArrow(ask, "block long, rows binary, asked array<long>"), "toxicity-blocks", "snappy")
    found = blocks.select(F.col("block").alias("by"), F.explode("asked").alias("key")).join(rest, "key").select("by", "key", "ratio")
    texts, found = (df.repartition(shuffle_partitions(spark), c).groupBy(c) for df, c in ((blocks.select("block", "rows"), "block"), (found, "by")))
    out = materialize(texts.cogroup(found).applyInArrow(answer, schema), "toxicity-measures")
    drop_scratch(spark, blocks)
    return out


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", most: int = MODEL_GRAMS) -> tuple[Model, DataFrame | None]:
    """The model of all labelled texts that are not held out and of the whole corpus' shared counts, and the table (key, ratio) of the log ratios
    beyond ``most`` grams and as many contexts, which ``measured`` adds; none if the model holds all.

    Of contradicting labels of one doc_id the larger holds; rows that repeat a labelled doc_id all have its label. To the driver come only
    the ratios that the model holds and the measures of ``CALIBRATION_ROWS`` rows at most.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    known = materialize(known.withColumn("calibrates", F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE_ONE_OF)) == 0), "toxicity-labels")
    joined = docs.select("doc_id", "text").join(broadcast_if_few(known.where("not calibrates").select("doc_id", "label")), "doc_id", "left")
    counts = materialize(gram_counts(joined.select("text", F.coalesce("label", F.lit(UNKNOWN)).cast("int").alias("label"))), "toxicity-counts")
    found, contexts = log_ratios(counts)
    (held, more), (held_contexts, more_contexts) = most_seen(found, most), most_seen(contexts, most)
    model = Model(held, held_contexts, more_contexts is None)
    rest = reduce(DataFrame.unionAll, tables) if (tables := [df for df in (more, more_contexts) if df is not None]) else None
    drop_scratch(spark, counts)
    chosen = bounded_choice(known.where("calibrates").select("doc_id", "label"), CALIBRATION_ROWS, "doc_id")
    rows = measured(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi"), model, rest)
    # one row for each doc_id, so that the bound holds whatever repeats
    rows = rows.groupBy("doc_id").agg(F.max(F.struct("a", "b", "c")).alias("m")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", "label", "m.*").toArrow().to_pandas().sort_values("doc_id")
    model.calibrate(rows[["a", "b", "c"]].to_numpy(np.float64), rows["label"].to_numpy(np.float64))
    return model, rest


def classify(docs: DataFrame, labels: DataFrame, most: int = MODEL_GRAMS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; ``most``: log ratios that tasks hold, which changes no score.

    Null and empty texts, and those without letter or digit, have all measures 0 and thereby one score. Repeated rows have equal scores.
    Without any labels, or with those of one class only, scores follow the share of label 1 (one half if there is none). Other columns are ignored.
    """
    model, rest = fit(docs, labels, most=most)
    rows = measured(docs, model, rest)
    if rest is not None:
        drop_scratch(docs.sparkSession, rest)
    weights = [float(w) for w in model.weights]
    z = sum((F.lit(w) * F.col(c) for w, c in zip(weights[:3], "abc", strict=True)), F.lit(weights[3]))
    return rows.select("doc_id", held_out().alias("held_out"), (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document; see ``classify`` for nulls, empty texts and repeats."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
