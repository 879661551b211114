"""A projection that grows with the stream: new positions are appended, and earlier ones are proved unchanged by digests.

Positions are dealt to ranges of a fixed size. The manifest holds, for each range and version, how many rows were projected
and a multiset digest of them: two sums of independent 64-bit row hashes, which don't depend on order and combine where
the rows are. A refresh reads the stream once: below the high-water mark it only adds up digests by range, above it it
projects. A range whose sums differ has lost, changed or gained rows; only such ranges are compared row by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_ROWS = 1_000_000
MANIFEST = "version long, range long, rows long, low long, high long, first decimal(38,0), second decimal(38,0)"


def row_hash(columns: list[str], seed: int) -> Column:
    """A 64-bit hash of a row; null and empty differ, and so do the same values in other columns."""
    parts = [F.lit(seed)]
    for c in sorted(columns):
        parts += [F.col(c).isNull(), F.col(c).cast("string")]
    return F.xxhash64(*parts).cast("decimal(38,0)")


def range_digests(rows: DataFrame, range_rows: int) -> DataFrame:
    """range, rows, low, high, first, second: count, positions and both sums of each range of positions."""
    columns = rows.columns
    dealt = rows.select(F.expr(f"(_stream_position - 1) div {range_rows}").alias("range"), F.col("_stream_position").alias("at"), row_hash(columns, 1).alias("a"), row_hash(columns, 2).alias("b"))
    return dealt.groupBy("range").agg(
        F.count(F.lit(1)).alias("rows"), F.min("at").alias("low"), F.max("at").alias("high"), F.sum("a").cast("decimal(38,0)").alias("first"), F.sum("b").cast("decimal(38,0)").alias("second")
    )


class Projection:
    """A projected copy of a stream in a folder, refreshed version by version.

    Each refresh writes its rows and then its part of the manifest; readers see versions that are in the manifest, so a
    refresh that died half-way leaves nothing visible and is done anew. ``project`` maps stream rows to what is kept, with
    ``activity`` among the columns; it is partitioned by activity.
    """

    def __init__(self, spark: SparkSession, path: str, project: Callable[[DataFrame], DataFrame], range_rows: int = RANGE_ROWS) -> None:
        self.spark, self.path, self.project, self.range_rows = spark, path.rstrip("/"), project, range_rows

    def manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{self.path}/manifest")
        except AnalysisException:  # nothing projected yet
            return self.spark.createDataFrame([], MANIFEST)

    def changed_ranges(self, stream: DataFrame) -> DataFrame:
        """Ranges whose rows below the high-water mark aren't those that were projected: range, was, now (numbers of rows)."""
        held = self.manifest().groupBy("range").agg(F.sum("rows").alias("was"), F.sum("first").cast("decimal(38,0)").alias("was_first"), F.sum("second").cast("decimal(38,0)").alias("was_second"))
        mark = self.high_water()
        now = range_digests(stream.filter(F.col("_stream_position") <= mark), self.range_rows).select("range", F.col("rows").alias("now"), "first", "second")
        both = held.join(now, "range", "full")
        same = F.col("was").eqNullSafe(F.col("now")) & F.col("was_first").eqNullSafe(F.col("first")) & F.col("was_second").eqNullSafe(F.col("second"))
        return both.filter(~same).select("range", F.coalesce("was", F.lit(0)).alias("was"), F.coalesce("now", F.lit(0)).alias("now"))

    def high_water(self) -> int:
        return self.manifest().agg(F.max("high")).first()[0] or 0

    def vanished(self, stream: DataFrame) -> DataFrame:
        """Ids that were projected and are no longer in the stream, looked for in changed ranges only."""
        ranges = self.changed_ranges(stream).select("range")
        of = lambda df: df.withColumn("range", F.expr(f"(_stream_position - 1) div {self.range_rows}")).join(F.broadcast(ranges), "range", "left_semi")
        return of(self.rows()).select("activity_id").join(of(stream).select("activity_id"), "activity_id", "left_anti")

    def rows(self) -> DataFrame:
        """All rows of complete versions; only their folders are read."""
        versions = [r[0] for r in self.manifest().select("version").distinct().collect()]
        folders = [f"{self.path}/rows/version={v}" for v in sorted(versions)]
        if not folders:
            raise ValueError("nothing has been projected yet")
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(*folders)

    def refresh(self, stream: DataFrame) -> int:
        """Append what the stream has beyond the high-water mark; returns how many rows. Fails where earlier rows changed."""
        broken = [r["range"] for r in self.changed_ranges(stream).orderBy("range").limit(10).collect()]
        if broken:
            raise ValueError(f"rows projected before have changed or are gone, in ranges {broken}")
        version = self.manifest().agg(F.max("version")).first()[0]
        version = 0 if version is None else version + 1
        fresh = stream.filter(F.col("_stream_position") > self.high_water())
        self.project(fresh).write.mode("overwrite").partitionBy("activity").parquet(f"{self.path}/rows/version={version}")
        digests = range_digests(fresh, self.range_rows).select(F.lit(version).cast("long").alias("version"), "*")
        digests.write.mode("overwrite").parquet(f"{self.path}/manifest/{version}")
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{version}").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
