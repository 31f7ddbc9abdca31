"""Helpers shared by all operators: tables, scratch space, top-k windows and stable digests."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where the session names none, a local one serves a local master (tests); a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/quarrygrid-scratch"


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, df: DataFrame) -> None:
    """Delete the scratch table behind ``df`` (made by ``materialize``) once nothing reads it any more."""
    root = scratch_root(spark)
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if folder.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            target = spark._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes of rows in an Arrow batch between Spark and Python, and the setting that bounds them.
BATCH_BYTES, BATCH_SETTING = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session hold at most ``BATCH_BYTES`` (or one row), unless the session has a bound of its own.

    By default they hold ten thousand rows, whatever a row's text takes in the JVM and in Python.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions for work that is heavy for its bytes: named in ``repartition``, they are not coalesced."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_choice(df: DataFrame, n: int, *cols: str) -> DataFrame:
    """At most ``n`` rows: those whose hash of ``cols`` is below a threshold that the number of rows sets, the smallest hashes first.

    What is above the threshold is gone before anything is sorted, so the ordered limit sees about ``n`` rows. Rows with
    equal hashes are ordered by ``cols`` themselves, so the choice is the same in every run.
    """
    total = df.count()
    if total <= n:
        return df
    hashed = F.xxhash64(*cols)
    return df.where(F.shiftrightunsigned(hashed, 1) < int(0.9 * n / total * (1 << 63))).orderBy(hashed, *cols).limit(n)


#: Rows and bytes of a table up to which ``broadcast_if_few`` broadcasts it.
FEW_ROWS, FEW_BYTES = 1_000_000, 256 << 20


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes: the bytes of its strings, eight for each number, nested columns by their JSON."""
    total = F.lit(0).cast("long")
    for field in df.schema.fields:
        kind, c = field.dataType.simpleString(), F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            width = F.octet_length(c)
        elif kind == "array<string>":
            width = F.octet_length(F.array_join(c, "")) + 8 * F.size(c)
        elif kind.startswith(("array<double", "array<float", "array<bigint", "array<int")):
            width = 8 * F.size(c)
        elif kind.startswith(("array", "map", "struct")):
            width = F.octet_length(F.to_json(F.struct(c)))
        else:
            width = F.lit(0)
        total = total + 8 + F.coalesce(width, F.lit(0))
    return total


def is_few(df: DataFrame, most: int = FEW_ROWS, most_bytes: int = FEW_BYTES) -> bool:
    """Has ``df`` at most ``most`` rows and ``most_bytes`` bytes? One number a row is looked at, of at most one row more than ``most``."""
    n, size = df.select(row_bytes(df).alias("b")).limit(most + 1).agg(F.count("*"), F.sum("b")).first()
    return n <= most and (size or 0) <= most_bytes


def broadcast_if_few(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``most`` rows and ``FEW_BYTES`` bytes; else as it is, so that a join shuffles it. Give it materialized or cheap: it is read."""
    return F.broadcast(df) if is_few(df, most) else df


#: Rows up to which ``spread_if_small`` deals a table to all tasks.
SMALL_ROWS = 100_000


def spread_if_small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` dealt to all tasks if it has at most ``most`` rows; a small file is often one row group, and so one task's. A large table stays where it is read."""
    return df.repartition(shuffle_partitions(df.sparkSession)) if df.select(F.lit(1)).limit(most + 1).count() <= most else df


def hot_limit(spark: SparkSession, total: int) -> float:
    """Rows from which a key counts as hot: more than a quarter of a fair partition. Fewer than 4 x shuffle partitions keys are hot."""
    return max(1.0, total / (4 * shuffle_partitions(spark)))


def join_by_hot_keys(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """The inner join of ``left`` with ``right`` (unique keys, with the number ``n`` of their rows in ``left``).

    Hot keys, of which there are fewer than 4 x shuffle partitions, are broadcast, so that their rows stay spread as they are; the
    other keys are joined by a shuffle. ``right`` is read twice: give it materialized.
    """
    limit = hot_limit(left.sparkSession, total)
    hot, cold = right.where(F.col(n) > limit), right.where(F.col(n) <= limit)
    spread = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return left.join(F.broadcast(hot), key).unionByName(spread)


def topk(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each key; Spark prunes before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def with_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def nearest_rank(col: str | Column, q: float) -> Column:
    """Nearest-rank percentile (ceil form): an element of the data, never interpolated; exact up to a million values a group, then to a millionth of the ranks."""
    c = F.col(col) if isinstance(col, str) else col
    return F.percentile_approx(c, q, 1_000_000)


def round6(col: Column | str) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)
