"""Reading, admitting and appending activities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.plans.lineage import cut

ACTIVITY = T.StructType([
    T.StructField("activity_id", T.StringType(), False), T.StructField("ts", T.TimestampType(), False), T.StructField("customer", T.StringType()),
    T.StructField("anonymous_customer_id", T.StringType()), T.StructField("activity", T.StringType(), False), T.StructField("feature_json", T.StringType(), False),
    T.StructField("revenue_impact", T.DecimalType(18, 2)), T.StructField("link", T.StringType()), T.StructField("_recorded_at", T.TimestampType(), False),
    T.StructField("_stream_position", T.LongType(), False), T.StructField("_source", T.StringType(), False), T.StructField("_actor", T.StringType(), False),
    T.StructField("_lane", T.StringType(), False), T.StructField("_schema_hash", T.StringType(), False),
])
#: What must be the same in an exact retry; the time of arrival too, but only for simulated activities, which state it themselves.
CONTENT = ["ts", "customer", "anonymous_customer_id", "activity", "feature_json", "revenue_impact", "link", "_source", "_actor", "_lane", "_schema_hash"]


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ACTIVITY).parquet(path)


def with_positions(rows: DataFrame, after: int = 0) -> DataFrame:
    """Consecutive positions by id: rows are ordered by range, and each range starts after the ones before it.

    Only one count per range is ordered in one task; the rows themselves are numbered where they are. The ranges are
    written first, so a lost executor can't deal them anew between the count and the numbering.
    """
    dealt = cut(rows.repartitionByRange("activity_id").withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    start = counts.withColumn("_start", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    numbered = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy("activity_id")))
    return numbered.join(F.broadcast(start), "_range").withColumn("_stream_position", (F.lit(after) + F.col("_start") + F.col("_k")).cast("long")).drop("_range", "_start", "_k")


def content_digest(rows: DataFrame) -> Column:
    """The digest of what must be the same in an exact retry."""
    parts = [F.col(c) for c in CONTENT if c in rows.columns]
    if {"_lane", "_recorded_at"} <= set(rows.columns):
        parts.append(F.when(F.col("_lane") == "sim", F.col("_recorded_at")).alias("_recorded_at"))
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def append_batch(existing: DataFrame | None, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new rows with positions, conflicting rows): an exact retry adds nothing, the same id with other content is a conflict."""
    content = content_digest(incoming)
    keyed = incoming.withColumn("_content", content)
    once = keyed.groupBy("activity_id").agg(F.min("_content").alias("low"), F.max("_content").alias("high"))
    after = 0
    if existing is not None:
        stored = existing.select("activity_id", content.alias("_stored"))
        once = once.join(stored, "activity_id", "left")
        after = existing.agg(F.max("_stream_position")).first()[0] or 0
    else:
        once = once.withColumn("_stored", F.lit(None).cast("string"))
    graded = once.withColumn("grade", F.when((F.col("low") != F.col("high")) | (F.col("_stored") != F.col("low")), "conflict").when(F.col("_stored").isNotNull(), "duplicate").otherwise("new"))
    rows = keyed.join(graded.select("activity_id", "grade"), "activity_id")
    fresh = rows.filter("grade = 'new'").dropDuplicates(["activity_id"]).drop("grade", "_content")
    return with_positions(fresh, after), rows.filter("grade = 'conflict'").drop("grade", "_content")
