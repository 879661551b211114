"""The stream as text in total order, with a manifest of ranges, and its restoration.

Rows are dealt to ranges of positions, each ordered in its own folder, so the whole export is in order and no task holds more
than a range. A line is canonical: sorted fields, absent values written as null, times in microseconds. The manifest, written
last, has for each range its count, first and last position and the sum of its lines' hashes; restoring proves every range
against it, the ranges to be 1 to n without a gap, and every line to be what its own row would be written as.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.plans.lineage import cut

MANIFEST = "part int, n long, low long, high long, digest decimal(38,0), schema string"
OPTIONS = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def canonical_line(columns: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), OPTIONS)


def _digest(value: str = "value") -> Column:
    return F.sum(F.xxhash64(value).cast("decimal(38,0)")).cast("decimal(38,0)").alias("digest")


def export_ordered(act: DataFrame, path: str, ranges: int = 8) -> None:
    """Write activities with their positions as ordered lines below ``path``; ``ranges`` grows with the stream."""
    dealt = act.repartitionByRange(ranges, "_stream_position").sortWithinPartitions("_stream_position")
    lines = dealt.select("_stream_position", canonical_line(act.columns).alias("value"), F.spark_partition_id().alias("part"))
    lines = cut(lines, "export", "part")  # what is counted is what is written, whatever executors are lost in between
    lines.repartition(ranges, "part").sortWithinPartitions("part", "_stream_position").select("part", "value").write.partitionBy("part").text(f"{path}/lines")
    ends = lines.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("_stream_position").alias("low"), F.max("_stream_position").alias("high"), _digest())
    schema = act.schema.json()
    ends.withColumn("schema", F.lit(schema)).coalesce(1).write.parquet(f"{path}/manifest")


def damage(spark: SparkSession, path: str) -> DataFrame:
    """(part, what) of ranges that are not as the manifest says: missing, unknown or changed lines, gaps, lines not canonical."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    lines = spark.read.schema("value string, part int").text(f"{path}/lines")
    rows = _rows(spark, path)
    now = lines.groupBy("part").agg(F.count(F.lit(1)).alias("now"), _digest().alias("now_digest"))
    both = manifest.join(now, "part", "full")
    changed = both.filter(~(F.col("n").eqNullSafe(F.col("now")) & F.col("digest").eqNullSafe(F.col("now_digest")))).select("part", F.lit("changed").alias("what"))
    # One row for each range: ranges follow each other from 1 on.
    order = manifest.select("part", "low", F.expr("high - low + 1 - n").alias("holes"), (F.coalesce(F.expr("lag(high) OVER (ORDER BY low)"), F.lit(0)) + 1).alias("due"))
    gaps = order.filter("holes <> 0 OR low <> due").select("part", F.lit("gap").alias("what"))
    odd = rows.filter(~F.col("value").eqNullSafe(canonical_line([c for c in rows.columns if c not in ("value", "part")]))).select("part", F.lit("not canonical").alias("what")).distinct()
    return changed.unionByName(gaps).unionByName(odd)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    schema = StructType.fromJson(json.loads(spark.read.schema(MANIFEST).parquet(f"{path}/manifest").first()["schema"]))
    lines = spark.read.schema("value string, part int").text(f"{path}/lines")
    return lines.select("value", "part", F.from_json("value", schema, OPTIONS).alias("r")).select("value", "part", "r.*")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The activities of an export; an error names damaged ranges."""
    found = damage(spark, path).orderBy("part", "what").limit(20).collect()
    if found:
        raise ValueError("the export is damaged: " + ", ".join(f"range {r.part} {r.what}" for r in found))
    return _rows(spark, path).drop("value", "part")
