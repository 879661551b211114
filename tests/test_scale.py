"""Work is dealt to tasks by rows, not by how well the rows compress."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.operators import accounting
from ledgerloom.plans import lineage, queries
from ledgerloom.plans.context import Context
from ledgerloom.streaming import jobs


def test_a_table_written_by_one_task_is_read_by_many(spark):
    table = lineage.cut(spark.range(250_000).coalesce(1).select("id", F.lit("x").alias("kind")), "spread", "kind")
    assert table.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= lineage.FILE_ROWS
    assert table.agg(F.count_distinct("id")).first()[0] == 250_000
    lineage.discard(table)


def test_a_part_arrives_as_one_batch_of_many_files(spark, monkeypatch):
    monkeypatch.setattr(queries, "FILE_ROWS", 10)
    seen, root = [], lineage.scratch_path(spark, "arrive-test")
    look = lambda batch, number: seen.append((number, batch.count(), batch.select(F.input_file_name()).distinct().count()))
    start = lambda source: source.writeStream.foreachBatch(look).option("checkpointLocation", root).trigger(availableNow=True).start()
    queries.arriving(spark, spark.range(35).select("id", F.when(F.col("id") < 30, 0).otherwise(1).alias("part")).coalesce(1), 2, start)
    assert seen == [(0, 30, 3), (1, 5, 1)]


def test_identifiers_of_one_bucket_are_admitted_each_by_itself(spark, monkeypatch):
    monkeypatch.setattr(jobs, "BUCKETS", 1)
    rows = [("a", "1", 0), ("b", "1", 0), ("c", "1", 0), ("c", "2", 0), ("a", "1", 1), ("b", "2", 1), ("c", "3", 1), ("d", "1", 1), ("d", "1", 1)]
    root = lineage.scratch_path(spark, "bucket-test")
    start = lambda source: jobs.stream_append(source, f"{root}/rows", f"{root}/conflicts", f"{root}/checkpoint")
    queries.arriving(spark, spark.createDataFrame(rows, "activity_id string, customer string, part int"), 2, start)
    read = lambda name: sorted(tuple(r) for r in spark.read.parquet(f"{root}/{name}").select("batch", "activity_id", "customer").collect())
    assert read("rows") == [(0, "a", "1"), (0, "b", "1"), (1, "c", "3"), (1, "d", "1")]
    assert read("conflicts") == [(0, "c", "1"), (0, "c", "2"), (1, "b", "2")]


def test_months_of_one_subscription_are_dealt_to_several_tasks(spark):
    ctx = Context(dt.date(2001, 7, 31), dt.date(2001, 8, 1), dt.date(1995, 1, 1))
    rows = [("s", "c", "k", dt.datetime(1995, 1, 15), 0, "a", dt.date(2001, 8, 1), 100, 2)]
    events = spark.createDataFrame(rows, "_source string, customer string, subscription_id string, ts timestamp, priority int, activity_id string, period_end date, price_cents long, paid_seats long")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        months = accounting.subscription_months(accounting.subscription_states(events, ctx), ctx).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset(key)
    assert len(months) == 79 and len({r.task for r in months}) == 2
    assert sum(r.numerator for r in months) == 200 * (dt.date(2001, 8, 1) - dt.date(1995, 1, 15)).days


def test_rounding_is_exact_on_both_sides_of_the_narrow_range(spark):
    amounts = [0, 1, 7, 31, money.SAFE - 1, money.SAFE, money.SAFE + 1, 9 * 10**16]
    rows = [(a, e, d) for a in amounts for e, d in ((0, 31), (1, 31), (15, 30), (31, 31), (999_999, 1_000_000), (1_000_001, 1_000_001))]
    found = spark.createDataFrame(rows, "a long, e long, d long").select("a", "e", "d", money.half_up("a", "e", "d").alias("x")).collect()
    assert all(r.x == (2 * r.a * r.e + r.d) // (2 * r.d) for r in found)
