"""Lines of a captured file are numbered where they lie: the lines of one split are no single task's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.plans import lineage
from ledgerloom.sources import captures


def test_lines_of_one_file_are_numbered_without_moving_to_one_task(spark):
    folder = lineage.scratch_path(spark, "capture-test")
    spark.range(5000).select(F.concat(F.lit("line "), F.col("id").cast("string"))).coalesce(1).write.text(folder)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        lines = captures.numbered_lines(spark, folder)
        found = lines.collect()
        plan = lines._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert sorted((r.observation, r.value) for r in found) == [(i + 1, f"line {i}") for i in range(5000)]
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
