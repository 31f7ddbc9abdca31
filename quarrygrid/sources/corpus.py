"""Sources and sinks: corpus scans and manifests, document-atomic replacement, vector reconciliation, fixtures and observation logs."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarrygrid.common import shuffle_partitions

IGNORED_DIRS = (".git", ".obsidian", "node_modules", "__pycache__", ".trash")
#: Bytes of the largest file whose content is read where a store gives it in one piece only.
WHOLE_BYTES = 1 << 30
#: Bytes of a file that are held at once while it is digested.
BLOCK_BYTES = 1 << 20
SENSITIVE = ("token", "password", "api_key", "secret", "raw_query", "answer_text")
LISTED = "relative_path string, size long, modified timestamp, stage string, error string, message string"
SCANNED = "relative_path string, size long, modified timestamp, content_hash string, stage string, error string, message string"


def open_store(root: str) -> tuple[pafs.FileSystem, str] | None:
    """The file system and path behind a URI or an absolute path; None for a store that only Spark reads."""
    if root.startswith("file:"):
        # all of file:/a, file:///a and file://a mean the same folder
        root = "/" + root[5:].lstrip("/")
    try:
        return pafs.FileSystem.from_uri(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


def _links(store: pafs.FileSystem, path: str) -> dict[str, bool]:
    """The symbolic links in a folder of a local disk, and whether their targets exist; the listing itself leaves broken ones out."""
    if store.type_name != "local":
        return {}
    with os.scandir(path) as entries:
        return {e.path: os.path.exists(e.path) for e in entries if e.is_symlink()}


def list_directory(store: pafs.FileSystem, base: str, path: str, rules: dict) -> tuple[list[str], list[tuple]]:
    """The subdirectories of ``path`` to go on with, and its rows of ``LISTED``: files with a wanted extension, and what can't be listed.

    An ignored directory is named by its parent and never opened itself. Symbolic links are passed over; a broken one is an error.
    """

    def relative(p: str) -> str:
        return p[len(base) :].strip("/")

    def ignored(p: str) -> bool:
        return any(fnmatch.fnmatchcase(relative(p), glob) for glob in rules["globs"])

    try:
        entries, links = store.get_file_info(pafs.FileSelector(path)), _links(store, path)
    except OSError as e:
        return [], [(relative(path), None, None, "discover", type(e).__name__, str(e))]
    directories = []
    rows = [(relative(p), None, None, "discover", "broken_symlink", "the target of the link does not exist") for p, whole in sorted(links.items()) if not whole and not ignored(p)]
    for entry in sorted(entries, key=lambda x: x.path):
        name = entry.base_name
        if entry.path in links:
            continue
        if entry.type == pafs.FileType.Directory:
            if not name.startswith(".") and name not in rules["directories"] and not ignored(entry.path):
                directories.append(entry.path)
        elif entry.type == pafs.FileType.File and not name.startswith(".") and entry.extension.lower() in rules["extensions"] and not ignored(entry.path):
            large = rules["most"] is not None and entry.size > rules["most"]
            rows.append((relative(entry.path), entry.size, entry.mtime, *(("metadata", "too_large", f"more than {rules['most']} bytes") if large else (None, None, None))))
    return directories, rows


class Subtrees(InputPartition):
    """Directories that one task lists with all below them, and rows that were found on the way to them."""

    def __init__(self, directories: list[str], rows: list[tuple]):
        self.directories, self.rows = directories, rows


class CorpusListing(DataSourceReader):
    def __init__(self, root: str, rules: dict, tasks: int):
        self.root, self.rules, self.tasks = root, rules, tasks

    def partitions(self) -> list[InputPartition]:
        """Levels of the tree are listed from the top until there are directories enough for all tasks; each task lists the trees below its own."""
        store, base = open_store(self.root)
        level, rows = [base], []
        while level and len(level) < self.tasks:
            below = []
            for path in level:
                more, own = list_directory(store, base, path, self.rules)
                below += more
                rows += own
            level = below
        return [Subtrees(level[i :: self.tasks], rows[i :: self.tasks]) for i in range(self.tasks)]

    def read(self, partition: Subtrees) -> Iterator[tuple]:
        store, base = open_store(self.root)
        yield from partition.rows
        waiting = list(partition.directories)
        while waiting:
            more, rows = list_directory(store, base, waiting.pop(), self.rules)
            waiting += more
            yield from rows


class CorpusFiles(DataSource):
    """``spark.read.format("corpus_files")``: the files of a folder by path, extension and size, with one row for each failure; no content is opened.

    Options: path, extensions, directories and globs to ignore (JSON arrays), most (bytes), tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "corpus_files"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        rules = {k: json.loads(o.get(k, "[]")) for k in ("extensions", "directories", "globs")} | {"most": int(o["most"]) if "most" in o else None}
        return CorpusListing(o["path"], rules, int(o.get("tasks", 8)))


def digest_file(store: pafs.FileSystem, path: str, attempts: int = 2) -> tuple:
    """(size, modified, digest, stage, error, message) of one file, read in blocks of ``BLOCK_BYTES``; a file that changes meanwhile is read again."""
    for _ in range(attempts):
        try:
            before = store.get_file_info(path)
            digest = hashlib.sha256()
            with store.open_input_stream(path) as stream:
                while block := stream.read(BLOCK_BYTES):
                    digest.update(block)
            after = store.get_file_info(path)
        except OSError as e:
            return None, None, None, "hash", type(e).__name__, str(e)
        if (before.size, before.mtime_ns) == (after.size, after.mtime_ns):
            return after.size, after.mtime, digest.hexdigest(), None, None, None
    return None, None, None, "hash", "unstable_file", "the file changed while it was read"


def _digests(root: str):
    """Adds digests to batches of (relative_path, ...) of ``LISTED``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        schema = pa.schema([("relative_path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", tz="UTC")), ("content_hash", pa.string()), ("stage", pa.string()), ("error", pa.string()), ("message", pa.string())])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["error"] is None:
                    rows.append((r["relative_path"], *digest_file(store, f"{base.rstrip('/')}/{r['relative_path']}")))
                else:
                    rows.append((r["relative_path"], r["size"], r["modified"], None, r["stage"], r["error"], r["message"]))
            columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _spark_only(spark: SparkSession, root: str, rules: dict) -> DataFrame:
    """``SCANNED`` of a store that only Spark reads: names and sizes first, without content, and then content where its reader can open it.

    Spark's reader lists ignored directories too, passes over names that begin with a dot or underscore, and holds a file in one row, so files of more
    than ``WHOLE_BYTES`` have an error.
    """
    names = "*.{" + ",".join(rules["extensions"]) + "}"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    found = reader.load(root)
    most = WHOLE_BYTES if rules["most"] is None else min(rules["most"], WHOLE_BYTES)
    # the filter on the length reaches the reader, which then opens no larger file
    digests = found.where(F.col("length") <= most).select("path", F.sha2("content", 256).alias("content_hash"))
    target = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString().rstrip("/") + "/"
    relative = F.when(F.startswith("path", F.lit(base)), F.substring("path", len(base) + 1, 1 << 30)).otherwise(F.substring_index("path", "/", -1))
    parts = F.split("relative_path", "/")
    outside = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda d: F.startswith(d, F.lit(".")) | d.isin(*rules["directories"]))
    listed = found.select("path", relative.alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    listed = listed.where(~outside & ~F.startswith(F.element_at(parts, -1), F.lit(".")))
    for glob in rules["globs"]:
        listed = listed.where(~F.col("relative_path").rlike(fnmatch.translate(glob).replace("(?s:", "(?s)(?:").replace(r"\z", r"\Z")))
    rows = listed.join(digests, "path", "left")
    large, missing = F.col("size") > most, F.col("content_hash").isNull()

    def where(big: str, gone: str) -> Column:
        return F.when(large, big).when(missing, gone)

    return rows.select("relative_path", "size", "modified", "content_hash", where("metadata", "hash").alias("stage"), where("too_large", "unreadable").alias("error"), where(f"more than {most} bytes", "the store gave no content").alias("message"))


def scan_corpus(spark: SparkSession, root: str, extensions: Sequence[str] = ("md",), ignored_dirs: Sequence[str] = IGNORED_DIRS, ignored_globs: Sequence[str] = (), max_bytes: int | None = None) -> DataFrame:
    """(relative_path, extension, size, modified, content_hash, error, stage, message) of the files below ``root``.

    Hidden and ignored directories are not opened; globs are matched against the path below ``root``. What can't be listed (``discover``), is larger than
    ``max_bytes`` (``metadata``), or can't be read, is gone or changes under the reader (``hash``) has one row with an error, and the scan goes on. Tasks list
    subtrees; the files found are then dealt to all tasks by a hash of their path, whatever folder they lie in, and read in blocks. A folder that is empty or
    missing gives no file; a missing one has one error row.
    """
    rules = {"extensions": [e.lower().lstrip(".") for e in extensions], "directories": list(ignored_dirs), "globs": list(ignored_globs), "most": max_bytes}
    if open_store(root) is None:
        rows = _spark_only(spark, root, rules)
    else:
        spark.dataSource.register(CorpusFiles)
        tasks = shuffle_partitions(spark)
        reader = spark.read.format("corpus_files").option("path", root).option("tasks", tasks)
        for k in ("extensions", "directories", "globs"):
            reader = reader.option(k, json.dumps(rules[k]))
        if max_bytes is not None:
            reader = reader.option("most", max_bytes)
        rows = reader.load().repartition(tasks, "relative_path").mapInArrow(_digests(root), SCANNED)
    extension = F.lower(F.substring_index("relative_path", ".", -1))
    return rows.select("relative_path", extension.alias("extension"), "size", "modified", "content_hash", "error", "stage", "message")


def corpus_manifest(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (path, path_sha, content_sha, n_bytes, bucket) and one corpus digest, the root of a tree of digests.

    A leaf holds the rows whose path digests begin with the same hex digits: four, and one more for each sixteenfold beyond a
    billion rows, so no leaf has much over 16,384. A node above holds up to 256 digests.
    """
    digits = 4
    n = docs.count()
    while n > 16384 << (4 * digits):
        digits += 1
    rows = docs.select("path", F.sha2(F.col("path").cast("string"), 256).alias("path_sha"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    rows = rows.withColumn("bucket", F.left("path_sha", F.lit(digits)))
    level = rows.select("bucket", F.concat_ws(":", "path_sha", "content_sha", "n_bytes").alias("line"), F.lit(1).cast("long").alias("n"), "n_bytes")
    for width in [*range(digits, 0, -2), 0]:
        level = level.groupBy(F.left("bucket", F.lit(width)).alias("bucket")).agg(F.array_sort(F.collect_list("line")).alias("lines"), F.sum("n").alias("n"), F.sum("n_bytes").alias("n_bytes"))
        level = level.select("bucket", F.concat_ws(":", "bucket", F.sha2(F.array_join("lines", "\n"), 256)).alias("line"), "n", "n_bytes")
    return rows, level.select(F.col("n").alias("n_documents"), "n_bytes", F.substring_index("line", ":", -1).alias("corpus_digest"))


def replace_doc_chunks(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """All chunks of changed documents replaced, the others kept; a document without new chunks loses its old ones."""
    ids = changed.select("doc_id").distinct()
    return old.join(ids, "doc_id", "left_anti").unionByName(new.join(ids, "doc_id", "left_semi"))


def materialize_vectors(chunks: DataFrame, existing: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Points that the vector table should have (chunk_id, doc_id, embedding, section, action) and the counters of the reconciliation.

    ``action``: insert, update or keep; points of chunks that are gone are deleted, chunks without a vector of ``dimension`` rejected.
    """
    good = F.coalesce(F.size("embedding") == dimension, F.lit(False))
    want = chunks.where(good).select("chunk_id", "doc_id", "embedding", F.array_join("heading_path", " > ").alias("section"))
    have = existing.select("chunk_id", F.col("embedding").alias("old"), F.lit(True).alias("there"))
    points = want.join(have, "chunk_id", "left").select("chunk_id", "doc_id", "embedding", "section", F.when(F.col("there").isNull(), "insert").when(~F.col("old").eqNullSafe(F.col("embedding")), "update").otherwise("keep").alias("action"))
    counts = points.groupBy("action").agg(F.count("*").alias("n"))
    gone = existing.join(want, "chunk_id", "left_anti").agg(F.lit("delete").alias("action"), F.count("*").alias("n"))
    bad = chunks.where(~good).agg(F.lit("reject").alias("action"), F.count("*").alias("n"))
    return points, counts.unionByName(gone).unionByName(bad)


def write_eval_fixture(df: DataFrame, path: str) -> None:
    """Write fixture rows as JSON lines; an existing path is refused."""
    df.write.mode("errorifexists").json(path)


def read_eval_fixture(spark: SparkSession, path: str, schema: str, version: int, configuration: dict[str, str]) -> DataFrame:
    """Fixture rows with ``problem``: version or configuration where they aren't what is expected, corrupt where a line can't be read."""
    rows = spark.read.schema(f"{schema}, __bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").json(path)
    wrong = [~F.coalesce(F.col("retrieval_configuration")[k].eqNullSafe(F.lit(v)), F.lit(False)) for k, v in configuration.items()]
    other = F.lit(False)
    for w in wrong:
        other = other | w
    problem = F.when(F.col("__bad").isNotNull(), "corrupt").when(~F.col("fixture_schema_version").eqNullSafe(F.lit(version)), "version").when(other, "configuration")
    return rows.withColumn("problem", problem).drop("__bad")


def read_observation_log(spark: SparkSession, path: str, schema: str, forbidden: Sequence[str] = SENSITIVE) -> DataFrame:
    """Observations of append-only JSON lines: lines that can't be read are passed over; ``sensitive`` names a forbidden key of a line."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    keys = F.json_object_keys("value")
    rows = lines.withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("keys", keys).where(F.col("keys").isNotNull())
    return rows.select("row.*", F.array_join(F.array_sort(F.array_intersect("keys", F.array(*[F.lit(f) for f in forbidden]))), ",").alias("sensitive"))
