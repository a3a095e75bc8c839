"""Shared-storage tables: where they live, how they are written, read back and exported."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _local_dirs:
        _local_dirs[application] = tempfile.mkdtemp(prefix="martwright-")
    return _local_dirs[application]


def by_partition(df: DataFrame, partition_by: str) -> DataFrame:
    """Rows brought together for a table in partitions: adaptive execution splits a month that holds
    much of the data over several tasks and merges small months."""
    return df.hint("rebalance", partition_by)


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a write in here leaves the disks with its end, not whenever the driver next
    collects garbage."""
    before = spark.conf.get(_DROP_SHUFFLES)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def write_table(
    df: DataFrame, path: str, partition_by: str | None = None, moved: bool = False
) -> Observation:
    """Replaces a Parquet table. The row count is observed during the write, not in a second job.

    The rows of a table in partitions go through by_partition first, unless they were moved before
    columns were added that follow from the others. Shuffled files of the write are gone after it.
    """
    written = Observation()
    df = df.observe(written, F.count(F.lit(1)).alias("rows"))
    if partition_by and not moved:
        df = by_partition(df, partition_by)
    with shuffles_dropped(df.sparkSession):
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return written


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table with a known schema: no inference, and partition values keep their type."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or an empty one of the same shape if it was never written."""
    if path_exists(spark, path):
        return read_table(spark, path, schema)
    return spark.createDataFrame([], schema)


def is_complete(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/_SUCCESS")


def export_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Writes a (filtered) table as CSV with a header."""
    chosen = df.select(*columns) if columns else df
    chosen.write.mode("overwrite").option("header", True).csv(path)


def remove_table(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that export_csv wrote; a file with other columns or unreadable cells fails."""
    return (
        spark.read.schema(schema).option("header", True).option("enforceSchema", False)
        .option("mode", "FAILFAST").csv(path)
    )


def export_results(results: dict[str, DataFrame], folder: str, optional: set[str]) -> list[str]:
    """Writes result tables as CSV. Optional ones without rows are left out; what an earlier export
    left in their place goes, so a folder holds the tables of one export.

    Results are segment-sized; they are persisted so that the emptiness check costs no second pass.
    """
    saved = []
    for name, table in results.items():
        kept = table.persist()
        if name not in optional or not kept.isEmpty():
            export_csv(kept, f"{folder}/{name}")
            saved.append(name)
        else:
            remove_table(table.sparkSession, f"{folder}/{name}")
        kept.unpersist()
    return saved
