"""Cutting the lineage of iterative plans, and the shared folder that cut tables are written to."""

from __future__ import annotations

import os
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Rows of one file of a cut table: a reader splits no further than files and row groups, so tables of any size are read by many tasks.
FILE_ROWS = 100_000
#: Rows of one partition where a stored table is dealt anew: partitions by bytes hold ever more rows, the better they compress.
PART_ROWS = 250_000
#: Folders that a task writes side by side; rows of more of them are sorted by folder first, all rows of the task together.
OPEN_FOLDERS = 32


def scratch_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, one of our own in local mode, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file:///tmp/checkpoints/ledgerloom-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one intermediate table."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and a lost executor costs a file read.

    With ``partition`` the files lie in one folder for each value of that column, so filters on it prune the scan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.options(compression="zstd", maxRecordsPerFile=FILE_ROWS)
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, OPEN_FOLDERS)
    try:
        (writer.partitionBy(partition) if partition else writer).parquet(path)
    finally:
        spark.conf.set(key, before)
    table = spark.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


def parts(table: DataFrame) -> int:
    """Partitions for the rows of a stored table, so that a task's memory doesn't grow with the table; only footers are read."""
    return max(1, -(-table.count() // PART_ROWS))


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can reach it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stamp(spark: SparkSession, paths: list[str]) -> tuple[str, ...]:
    """Name, length and time of change of the files at some paths: equal stamps, equal tables."""
    found = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(place):
            found += [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in system.listStatus(place)]
    return tuple(sorted(found))


def discard(*tables: DataFrame) -> None:
    """Delete cut tables that no plan will read again; other tables are left alone."""
    for table in tables:
        path = _written.pop(table, None)
        if path:
            delete_path(table.sparkSession, path)
