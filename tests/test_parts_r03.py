"""Rows of streams and subscriptions are dealt by their number, whatever the session's shuffle partitions."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import accounting
from ledgerloom.plans import lineage
from ledgerloom.plans.context import Context
from ledgerloom.sources.testdata import token_events

DATA = Path("/root/testdata/sf0.001")


def largest(rows: DataFrame) -> int:
    return rows.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]


@pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")
def test_token_events_lie_in_parts_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(lineage, "PART_ROWS", 300)
    events = token_events(spark, str(DATA)).select("activity_id")
    assert events.count() > 3000 and largest(events) < 600


def test_states_and_months_of_subscriptions_lie_in_parts_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(lineage, "PART_ROWS", 100)
    ctx = Context(dt.date(2001, 7, 31), dt.date(2001, 8, 1), dt.date(1995, 1, 1))
    k, day = F.col("id"), F.to_timestamp(F.lit("1995-01-15"))
    events = spark.range(2000).select(
        F.lit("s").alias("_source"), F.concat(F.lit("c"), k).alias("customer"), F.concat(F.lit("sub"), k).alias("subscription_id"), F.concat(F.lit("e"), k).alias("activity_id"), day.alias("ts"),
        F.lit(0).alias("priority"), F.lit(None).cast("date").alias("period_end"), F.lit(100).cast("long").alias("price_cents"), F.lit(3).cast("long").alias("paid_seats"),
    )
    events = spark.createDataFrame(events.collect(), events.schema)  # no column is a literal, as in a stored stream
    states = accounting.subscription_states(events, ctx)
    assert states.count() == 2000 and largest(states) < 400
    months = accounting.subscription_months(states, ctx, lineage.parts(events))
    assert months.count() == 2000 * 79 and largest(months) < 400 * 12
