"""Helpers that decide where intermediate tables live and what may be broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after it was counted and found at or below this.
BROADCAST_ROW_LIMIT = 20_000


_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def keep_methods_compilable(spark: SparkSession) -> None:
    """Fuse operators only while the JVM still compiles the generated method.

    The text expressions are large. Beyond 8000 bytes of bytecode HotSpot runs
    a method interpreted, which costs far more than fusing saves. A limit the
    user has chosen is left alone.
    """
    if spark.conf.get(_METHOD_LIMIT, "65535") == "65535":
        spark.conf.set(_METHOD_LIMIT, "8000")


_LIST_LIMIT = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"


def keep_lists_hashed(spark: SparkSession) -> None:
    """Let an aggregation with lists hold this many groups a task before it sorts all rows.

    The default of 128 sorts the raw rows of nearly every task. What is beyond
    the limit is sorted and spilled as before. A limit the user has chosen is
    left alone.
    """
    if spark.conf.get(_LIST_LIMIT, "128") == "128":
        spark.conf.set(_LIST_LIMIT, "32768")


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given.

    Only a local session with neither gets a temporary folder, one per
    application; on a cluster a machine-local path would be lost with its
    executor. The session's settings are left as they are.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="recordloom-")
    return _local_folders[app]


def new_table_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/{app}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage, survives executor loss, and gives later plans the
    true table size.
    """
    spark = df.sparkSession
    path = new_table_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it comes in fewer splits, else unchanged.

    A table of one file with one row group is read by one task, whatever the
    work that follows. Large tables come in many splits and are not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def in_tasks_of(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df``, known to hold ``rows`` rows, in tasks of about ``most`` rows.

    For rows that grow in the same task: a split of a file is cut by its bytes,
    which say nothing of what its rows become.
    """
    return df.repartition(-(-rows // most))


def few_rows_or_none(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> list | None:
    """All rows of ``df``, or None if it holds more than ``limit``.

    At most ``limit + 1`` rows ever reach the driver.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def small_side(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """A broadcast copy of ``df`` if it holds at most ``limit`` rows.

    A larger table is returned unchanged and without a hint, so Spark joins it
    with a shuffle.
    """
    rows = few_rows_or_none(df, limit)
    if rows is None:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def settled(df: DataFrame, label: str, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """The rows of ``df`` fixed: in memory if few, else as a written table."""
    rows = few_rows_or_none(df, limit)
    if rows is None:
        return staged(df, label)
    return df.sparkSession.createDataFrame(rows, df.schema)
