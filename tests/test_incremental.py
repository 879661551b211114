"""The growing projection: refreshes, interrupted ones, and rows that vanished, changed or came in below the mark."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources.incremental import Projection

ROWS = "activity_id string, activity string, n long, _stream_position long"


def test_projection_grows_and_finds_what_vanished(spark, tmp_path):
    stream = lambda *at: spark.createDataFrame([(f"a{k}", "xyz"[k % 3], None if k % 5 == 0 else k, k) for k in at], ROWS)
    copy = Projection(spark, f"file://{tmp_path}/p", lambda df: df.select("activity_id", "activity", "_stream_position", (F.col("n") * 2).alias("twice")), range_rows=10)
    assert copy.refresh(stream(*range(1, 16))) == 15 and copy.high_water() == 15
    assert copy.refresh(stream(*range(1, 41))) == 25 and copy.high_water() == 40
    assert copy.refresh(stream(*range(1, 41))) == 0
    assert {(r.activity_id, r.twice) for r in copy.rows().collect()} == {(f"a{k}", None if k % 5 == 0 else 2 * k) for k in range(1, 41)}
    short = stream(*[k for k in range(1, 51) if k != 23])
    assert [tuple(r) for r in copy.changed_ranges(short).collect()] == [(2, 10, 9)]
    assert [r[0] for r in copy.vanished(short).collect()] == ["a23"]
    with pytest.raises(ValueError, match=r"\[2\]"):
        copy.refresh(short)
    changed = stream(*range(1, 41)).withColumn("n", F.when(F.col("_stream_position") == 5, 0).otherwise(F.col("n")))
    assert [r["range"] for r in copy.changed_ranges(changed).collect()] == [0]
    doubled = stream(*range(1, 41)).unionByName(stream(7))
    assert [tuple(r) for r in copy.changed_ranges(doubled).collect()] == [(0, 10, 11)]


def test_projection_survives_an_interrupted_refresh(spark, tmp_path):
    stream = lambda n: spark.createDataFrame([(f"a{k}", "x", k, k) for k in range(1, n + 1)], ROWS)
    copy = Projection(spark, f"file://{tmp_path}/p", lambda df: df, range_rows=4)
    copy.refresh(stream(6))
    stream(9).filter("_stream_position > 6").write.parquet(f"file://{tmp_path}/p/rows/version=1/activity=x")  # died before the manifest
    again = Projection(spark, f"file://{tmp_path}/p", lambda df: df, range_rows=4)
    assert again.rows().count() == 6
    assert again.refresh(stream(12)) == 6 and again.rows().count() == 12
