"""Structured Streaming twins of the batch operators; each equals its batch form on the rows that it accepts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from quarrygrid.common import drop_scratch, materialize, scratch_path
from quarrygrid.operators.evaluation import monitor_aggregates, monitor_counts


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files of one table."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # a glob takes a single file as well as a folder
    stream = reader.parquet(f"{sf_dir}/{name}.parque[t]")
    # event time needs instants
    return stream.select(*[F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in stream.dtypes])


def run_to_table(stream: DataFrame, tag: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there and return its table; in update mode the newest row of each key, in complete mode the last result."""
    spark = stream.sparkSession
    path, marks = scratch_path(spark, tag), scratch_path(spark, f"{tag}-marks")
    spark.createDataFrame([], stream.schema).withColumn("__batch", F.lit(0).cast("long")).write.parquet(path)

    def save(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch overwrites its own folder
        batch.withColumn("__batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(stream.schema.add("__batch", "long")).option("recursiveFileLookup", "true").parquet(path)
    if mode == "complete":
        out = out.join(out.agg(F.max("__batch").alias("__batch")), "__batch", "left_semi")
    if mode == "update" and keys:
        out = out.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__batch")))).where("__r = 1").drop("__r")
    return out.drop("__batch")


def stream_monitor(events: DataFrame, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """``traffic_monitor`` over event-time windows; rows later than the watermark are dropped."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(*monitor_aggregates())
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n_requests", "mean_value", "max_value")


def stream_report_counts(obs: DataFrame, safety: tuple[str, ...] = (), window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """``monitor_counts`` of event-time windows (window_start, release, scope, terminal, sums); ``monitor_report`` of what comes out is the report of windows, or with other keys of whatever they add up to.

    State is one row for each window, release, scope and terminal, and goes with the watermark.
    """
    grouped = monitor_counts(obs.withWatermark("ts", late), [F.window("ts", window).alias("w"), "release", "scope"], safety)
    return grouped.select(F.col("w.start").alias("window_start"), *[c for c in grouped.columns if c != "w"])


def stream_request_dedup(requests: DataFrame, late: str = "1 day") -> DataFrame:
    """One row for each (session_id, client_request_id) within the watermark."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "client_request_id"])


def stream_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Activity sessions of each user, closed by a gap.

    In append mode a session comes out once the watermark has passed its end, and its state goes; in complete mode, which also
    shows open sessions, all stay in state: that is for bounded inputs.
    """
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n_events"), F.sum("value").alias("total_value"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events", "total_value")


def _timed(state: GroupState, idle_ms: int | None) -> bool:
    """Has the state's key been idle for too long? Then the state goes. Else the clock starts anew."""
    if idle_ms is not None and state.hasTimedOut:
        state.remove()
        return True
    return False


def _with_state(df: DataFrame, key: str, fold, schema: str, state: str, mode: str, idle_ms: int | None) -> DataFrame:
    """``fold(key, frames, old state or None)`` -> (rows, new state) for each key; a key that is idle for ``idle_ms`` is forgotten."""

    def run(name: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if _timed(held, idle_ms):
            return
        rows, new = fold(name[0], frames, held.get if held.exists else None)
        held.update(new)
        if idle_ms is not None:
            held.setTimeoutDuration(idle_ms)
        yield rows

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return df.groupBy(key).applyInPandasWithState(run, schema, state, mode, timeout)


def _turn_fold(session, frames: Iterator[pd.DataFrame], old: tuple | None) -> tuple[pd.DataFrame, tuple]:
    n, held = old or (0, [])
    recent, out = list(held), []
    for f in frames:
        for row in f.sort_values("turn").itertuples():
            out.append((session, row.turn, n + 1, len(recent), sum(map(len, recent))))
            n, recent = n + 1, [*recent, row.text or "-"][-6:]
    return pd.DataFrame(out, columns=["session_id", "turn", "turn_number", "n_context", "context_chars"]), (n, recent)


def stream_turn_state(turns: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Per session its turn counter and the size of the context of the last 6 turns (session_id, turn, text), kept in state.

    State is a counter and six turns a session; with ``idle_ms`` a session that is quiet for so long is forgotten.
    """
    return _with_state(turns, "session_id", _turn_fold, "session_id long, turn long, turn_number long, n_context long, context_chars long", "n long, recent array<string>", "append", idle_ms)


#: A turn whose status is one of these is still at work, and its session takes no other (fixed values).
ACTIVE = ("pending", "running")
TURNS = "session_id long, client_request_id string, arrived long, outcome string, turn_number long, n_context int, context_chars int, context_sha string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def turn_context(recent: list[str], budget: int, count: Callable[[str], int]) -> tuple[int, int, str]:
    """(texts, their sum of ``count``, digest) of the newest of ``recent`` that fit the budget, up to the first that doesn't; the newest always counts, at most as the budget."""
    kept, used = [], 0
    for text in reversed(recent):
        size = count(text)
        if not kept and size > budget:
            text, size = text[:budget] if count is len else text, budget
        if used + size > budget:
            break
        kept.append(text)
        used += size
    return len(kept), used, hashlib.sha256("\n".join(reversed(kept)).encode()).hexdigest()


class Turns(StatefulProcessor):
    """One session's turns: a value (how many turns, the newest one's request and status), the turn of each request, the texts of the last ``n`` turns."""

    def __init__(self, n: int, budget: int, count: Callable[[str], int], ttl_ms: int | None):
        self.n, self.budget, self.count, self.ttl_ms = n, budget, count, ttl_ms

    def init(self, handle) -> None:
        self.newest = handle.getValueState("newest", "n long, request string, status string", self.ttl_ms)
        self.requests = handle.getMapState("requests", "request string", "turn_number long", self.ttl_ms)
        self.recent = handle.getListState("recent", "text string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, newest, status = self.newest.get() if self.newest.exists() else (0, None, None)
        recent = [t for (t,) in self.recent.get()] if self.recent.exists() else []
        out = []
        for row in pd.concat(list(rows)).sort_values("arrived", kind="stable").itertuples():
            request, text, told = (None if pd.isna(x) else x for x in (row.client_request_id, row.text, row.status))
            held = self.requests.getValue((request,)) if request is not None and self.requests.containsKey((request,)) else None
            if text is None and told is not None:
                # news of a turn; of the newest one alone it changes what the session takes
                if held is not None and request == newest:
                    status = told
                continue
            made = (None, None, None)
            if not (text or "").strip():
                outcome, number = "refused_empty", None
            elif held is not None:
                outcome, number = "repeated", held[0]
            elif status in ACTIVE:
                outcome, number = "refused_active", None
            else:
                made = turn_context(recent, self.budget, self.count)
                n, newest, status = n + 1, request, told or ACTIVE[0]
                outcome, number = "created", n
                recent = [*recent, text][-self.n :]
                if request is not None:
                    self.requests.updateValue((request,), (n,))
            out.append((key[0], request, row.arrived, outcome, number, *made))
        self.newest.update((n, newest, status))
        if recent:
            self.recent.put([(t,) for t in recent])
        frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in TURNS.split(", ")])
        yield frame.astype({"turn_number": "Int64", "n_context": "Int32", "context_chars": "Int32"})

    def close(self) -> None:
        pass


@contextmanager
def stored_states(spark: SparkSession):
    """Streams that start inside keep their states in RocksDB, which named states need and which holds more than memory does."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def stream_turns(turns: DataFrame, n: int = 6, budget: int = 1200, count: Callable[[str], int] = len, ttl_ms: int | None = None) -> DataFrame:
    """What becomes of each turn that is asked for, in the columns ``TURNS``; start it inside ``stored_states``.

    ``turns``: session_id, client_request_id, arrived, text, status. A row with a text asks for a turn, which is ``created`` with the next number and the
    context of the last ``n`` texts within ``budget`` (by ``count``: characters, or a token counter), ``repeated`` with the number that its request has, or refused:
    ``refused_active`` while the newest turn is pending or running, ``refused_empty`` without a text. Its status is pending if it tells none. A row with
    a status alone is news of the turn of its request and gives no row. A null request id repeats nothing. Within a batch a session's rows go by ``arrived``. With ``ttl_ms`` what was not
    touched for so long is forgotten, request ids each by themselves.
    """
    rows = turns.select("session_id", "client_request_id", F.col("arrived").cast("long").alias("arrived"), "text", "status")
    return rows.groupBy("session_id").transformWithStateInPandas(Turns(n, budget, count, ttl_ms), TURNS, "append", "none" if ttl_ms is None else "processingTime")


def merged_runs(runs: list[tuple[int, int]], more: list[int]) -> list[tuple[int, int]]:
    """Runs of consecutive numbers (first, last), in order, after more numbers have come."""
    out: list[tuple[int, int]] = []
    for first, last in sorted([*runs, *((s, s) for s in more)]):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _trace_fold(trace, frames: Iterator[pd.DataFrame], old: tuple | None) -> tuple[pd.DataFrame, tuple]:
    runs = list(zip(*old, strict=True)) if old else []
    for f in frames:
        runs = merged_runs(runs, [int(s) for s in f["sequence"].dropna()])
    if not runs:
        return pd.DataFrame({"trace_id": [], "n_events": [], "last_sequence": [], "n_gaps": []}), ([], [])
    n, gaps = sum(b - a + 1 for a, b in runs), len(runs) - int(runs[0][0] <= 1)
    return pd.DataFrame({"trace_id": [trace], "n_events": [n], "last_sequence": [runs[-1][1]], "n_gaps": [gaps]}), ([a for a, _ in runs], [b for _, b in runs])


def stream_trace_order(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Per trace (trace_id, sequence): how many events there are, the last sequence, and gaps; equal to ``trace_order`` in whatever order and batches they come.

    State is the runs of consecutive sequences that a trace has so far, so it grows with open gaps alone: an event that comes late inside a gap closes
    it or parts it in two, and a repeated one changes nothing. With ``idle_ms`` a trace that is quiet for so long is forgotten.
    """
    return _with_state(events, "trace_id", _trace_fold, "trace_id long, n_events long, last_sequence long, n_gaps long", "firsts array<long>, lasts array<long>", "update", idle_ms)


def stream_trace_events(events: DataFrame, resume_after: int = 0, idle_ms: int | None = None) -> DataFrame:
    """Events (trace_id, sequence, payload, terminal) of each trace in the order of their sequence, each once: (trace_id, position, sequence, payload).

    Events that come early wait in state until those before them have come; sequences up to ``resume_after`` were delivered before and are passed over. A
    trace ends with its terminal event, and what has a later sequence is dropped. With ``idle_ms`` a trace that is quiet for so long gives up its gaps:
    what waits is delivered in order and the trace goes on behind it.
    """
    columns = ["trace_id", "position", "sequence", "payload"]

    def run(name: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        done, position, ended, waiting, payloads, ends = held.get if held.exists else (resume_after, 0, False, [], [], [])
        early = dict(zip(waiting, zip(payloads, ends, strict=True), strict=True))
        out = []

        def deliver(sequence: int) -> None:
            nonlocal done, position, ended
            payload, last = early.pop(sequence)
            position += 1
            out.append((name[0], position, sequence, payload))
            done, ended = sequence, bool(last)

        if held.hasTimedOut:
            for sequence in sorted(early):
                if not ended:
                    deliver(sequence)
        else:
            for f in frames:
                for row in f.dropna(subset=["sequence"]).itertuples():
                    if row.sequence > done and row.sequence not in early and not ended:
                        early[int(row.sequence)] = (row.payload, bool(row.terminal))
                while not ended and done + 1 in early:
                    deliver(done + 1)
        if ended:
            early.clear()
        order = sorted(early)
        held.update((done, position, ended, order, [early[x][0] for x in order], [early[x][1] for x in order]))
        if idle_ms is not None and early:
            held.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=columns)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    state = "done long, position long, ended boolean, waiting array<long>, payloads array<string>, ends array<boolean>"
    return events.groupBy("trace_id").applyInPandasWithState(run, "trace_id long, position long, sequence long, payload string", state, "append", timeout)


def trace_order(events: DataFrame) -> DataFrame:
    """The batch form of ``stream_trace_order``."""
    rows = events.distinct()
    w = Window.partitionBy("trace_id").orderBy("sequence")
    rows = rows.withColumn("gap", (F.col("sequence") > F.coalesce(F.lag("sequence").over(w), F.lit(0)) + 1).cast("int"))
    return rows.groupBy("trace_id").agg(F.count("*").alias("n_events"), F.max("sequence").alias("last_sequence"), F.sum("gap").alias("n_gaps"))


def whole_documents(docs: DataFrame) -> DataFrame:
    """A chunker that takes each document as one chunk: (doc_id, chunk_id, content) of (doc_id, text)."""
    return docs.select("doc_id", F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content"))


class Ingest:
    """An index that is kept up to date by batches of documents, in tables below one folder.

    A batch is a chain: its newest text of each document is compared with the state by digest; those that are new or changed are chunked and tokenized; their
    postings replace the old ones as a whole, and the differences of both go to the document frequencies and the corpus statistics. Every batch writes
    folders of its own, made from batches before it alone, so a replayed batch writes the same again. After ``compact_every``
    batches one folder takes the place of all before it, and those go.

    Tables: ``documents`` (doc_id, digest, n_chunks), ``postings`` (doc_id, chunk_id, term, tf, document_length; a document's chunk without tokens has none),
    ``frequencies`` (term, df) and ``statistics`` (n_chunks, total_length) as signed differences.
    """

    TABLES = {
        "documents": "doc_id long, digest string, n_chunks long", "postings": "doc_id long, chunk_id long, term string, tf long, document_length long",
        "frequencies": "term string, df long", "statistics": "n_chunks long, total_length long",
    }

    def __init__(self, spark: SparkSession, path: str, chunker=whole_documents, compact_every: int = 8):
        self.spark, self.path, self.chunker, self.compact_every = spark, path, chunker, compact_every

    def _folders(self, kind: str) -> dict[int, str]:
        """Finished folders by batch number: ``batch`` or ``base``."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return {}
        found = {int(f.getPath().getName()): f"{self.path}/{kind}/{f.getPath().getName()}" for f in fs.listStatus(root)}
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return {n: p for n, p in found.items() if fs.exists(done(f"{p}/done/_SUCCESS"))}

    def _write(self, folder: str, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            df.select(*[c.split(" ")[0] for c in self.TABLES[name].split(", ")]).write.mode("overwrite").parquet(f"{folder}/{name}")
        # the mark comes last: a folder without it is none
        self.spark.createDataFrame([], "n int").write.mode("overwrite").parquet(f"{folder}/done")

    def _layers(self, before: int | None = None) -> dict[int, str]:
        """The last base and the batches after it, up to but without ``before``."""
        limit = before if before is not None else 1 << 62
        bases = {n: p for n, p in self._folders("base").items() if n < limit}
        newest = max(bases, default=-1)
        out = {n: p for n, p in self._folders("batch").items() if newest < n < limit}
        return out | ({newest: bases[newest]} if bases else {})

    def _read(self, name: str, layers: dict[int, str]) -> DataFrame:
        """All rows of the layers, with the number of theirs."""
        out = self.spark.createDataFrame([], f"{self.TABLES[name]}, layer long")
        for n, p in sorted(layers.items()):
            out = out.unionByName(self.spark.read.schema(self.TABLES[name]).parquet(f"{p}/{name}").withColumn("layer", F.lit(n).cast("long")))
        return out

    def documents(self, layers: dict[int, str] | None = None) -> DataFrame:
        """(doc_id, digest, n_chunks, layer) as they are now."""
        every = self._read("documents", self._layers() if layers is None else layers)
        return every.groupBy("doc_id").agg(F.max_by(F.struct("digest", "n_chunks"), "layer").alias("d"), F.max("layer").alias("layer")).select("doc_id", "d.*", "layer")

    def postings(self, layers: dict[int, str] | None = None) -> DataFrame:
        """(doc_id, chunk_id, term, tf, document_length) as they are now: those of each document's newest layer."""
        layers = self._layers() if layers is None else layers
        return self._read("postings", layers).join(self.documents(layers).select("doc_id", "layer"), ["doc_id", "layer"], "left_semi").drop("layer")

    def frequencies(self) -> DataFrame:
        """(term, df) as they are now."""
        return self._read("frequencies", self._layers()).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def statistics(self) -> DataFrame:
        """(n_chunks, total_length) of chunks with tokens, as they are now."""
        return self._read("statistics", self._layers()).agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("total_length"), F.lit(0)).alias("total_length"))

    def apply(self, batch: DataFrame, batch_id: int, version: str | None = None) -> None:
        """Take in a batch of (doc_id, text); a null doc_id is passed over. Of several texts of one document the one with the largest ``version`` counts, without such a column the last one read."""
        from quarrygrid.operators.lexical import chunk_terms, postings_of

        if any(n >= batch_id for n in self._folders("base")):
            return  # a replay of what is in the base already
        layers = self._layers(batch_id)
        order = F.struct(*([version] if version else []), F.monotonically_increasing_id().alias("__read"))
        newest = batch.where("doc_id is not null").withColumn("__order", order).groupBy("doc_id").agg(F.max_by(F.struct("text"), "__order").alias("d"))
        newest = newest.select("doc_id", "d.text", F.sha2(F.coalesce("d.text", F.lit("")), 256).alias("digest"))
        held = self.documents(layers).select("doc_id", F.col("digest").alias("was"))
        changed = materialize(newest.join(held, "doc_id", "left").where("was is null or was <> digest"), "ingest-changed")
        chunks = materialize(self.chunker(changed.select("doc_id", "text")), "ingest-chunks")
        counted = chunk_terms(chunks.select(F.lit("kb").alias("kb_id"), "chunk_id", "content")).where("document_length > 0")
        postings = materialize(postings_of(counted).join(chunks.select("doc_id", "chunk_id"), "chunk_id"), "ingest-postings")
        n_chunks = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
        replaced = self.postings(layers).join(changed.where("was is not null").select("doc_id"), "doc_id", "left_semi")
        signed = materialize(postings.select("doc_id", "chunk_id", "term", "document_length", F.lit(1).cast("long").alias("sign")).unionByName(replaced.select("doc_id", "chunk_id", "term", "document_length", F.lit(-1).cast("long").alias("sign"))), "ingest-signed")
        lengths = signed.select("doc_id", "chunk_id", "document_length", "sign").distinct()
        self._write(f"{self.path}/batch/{batch_id}", {
            "documents": changed.join(n_chunks, "doc_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0))), "postings": postings,
            "frequencies": signed.groupBy("term").agg(F.sum("sign").alias("df")).where("df <> 0"),
            "statistics": lengths.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum(F.col("sign") * F.col("document_length")), F.lit(0)).alias("total_length")),
        })
        for df in (signed, postings, chunks, changed):
            drop_scratch(self.spark, df)
        if len([n for n in self._layers() if n >= 0]) > self.compact_every:
            self.compact(batch_id)

    def compact(self, batch_id: int) -> None:
        """One base of all up to ``batch_id``; the folders that it replaces go once it is finished."""
        layers = self._layers(batch_id + 1)
        self._write(f"{self.path}/base/{batch_id}", {"documents": self.documents(layers), "postings": self.postings(layers), "frequencies": self.frequencies(), "statistics": self.statistics()})
        for folder in [p for n, p in self._folders("batch").items() if n <= batch_id] + [p for n, p in self._folders("base").items() if n < batch_id]:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def stream_ingest(docs: DataFrame, tag: str = "ingest", version: str | None = None, chunker=whole_documents, compact_every: int = 8) -> DataFrame:
    """Incremental indexing of documents (doc_id, text) as they arrive; see ``Ingest``. Returns (chunk_id, term, tf) after all that is there."""
    return run_ingest(docs, tag, version, chunker, compact_every).postings().select("chunk_id", "term", "tf")


def run_ingest(docs: DataFrame, tag: str = "ingest", version: str | None = None, chunker=whole_documents, compact_every: int = 8) -> Ingest:
    """Run the stream of documents over what is there and give its index."""
    spark = docs.sparkSession
    index, marks = Ingest(spark, scratch_path(spark, tag), chunker, compact_every), scratch_path(spark, f"{tag}-marks")
    docs.writeStream.foreachBatch(lambda batch, n: index.apply(batch, n, version)).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return index
