"""Streaming jobs over files that arrive in several micro-batches, against the same work on stored rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.compare import attribute_changes, yield_bridge
from ledgerloom.operators.usage import KEY, usage_intervals
from ledgerloom.streaming import jobs
from ledgerloom.streaming.jobs import month_usage, split_late, stream_append, stream_counter_growth, stream_restate

UTC = dt.timezone.utc
ROWS = "activity_id string, ts timestamp, customer string, activity string, feature_json string"
DAY = dt.datetime(2024, 1, 5, tzinfo=UTC)


def arriving(spark, folder, schema, *batches):
    """A stream of one file for each micro-batch, oldest first."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in-{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in-*")


def done(query):
    query.awaitTermination()
    assert query.exception() is None


def test_append_keeps_its_state_across_restarts(spark, tmp_path):
    act = lambda k, n, at=DAY: (k, at, "c", "k", str(n))
    odd = DAY + dt.timedelta(microseconds=7)
    source = arriving(spark, tmp_path, ROWS, [act("a", 1), act("b", 2, odd)], [act("a", 1), act("b", 9), act("c", 4), act("d", 1), act("d", 2)])
    run = lambda: done(stream_append(source, f"{tmp_path}/s", f"{tmp_path}/c", f"{tmp_path}/k"))
    run()
    spark.createDataFrame([act("a", 1), act("b", 2, odd), act("a", 5), act("d", 2), act("e", 6), act("e", 6)], ROWS).coalesce(1).write.parquet(f"{tmp_path}/in-2")
    run()
    stored = sorted((r._stream_position, r.activity_id, r.feature_json, r.batch) for r in spark.read.parquet(f"{tmp_path}/s").collect())
    assert stored == [(1, "a", "1", 0), (2, "b", "2", 0), (3, "c", "4", 1), (4, "d", "2", 2), (5, "e", "6", 2)]
    clashes = sorted((r.batch, r.activity_id, r.feature_json) for r in spark.read.parquet(f"{tmp_path}/c").collect())
    assert clashes == [(1, "b", "9"), (1, "d", "1"), (1, "d", "2"), (2, "a", "5")]
    assert spark.read.parquet(f"{tmp_path}/s").filter(F.unix_micros("ts") % 1000 == 7).count() == 1  # whole microseconds


def test_restatement_by_deltas_equals_full_evaluation(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT", 2)
    rng = random.Random(3)
    batches = [[(f"a{k}-{i}", DAY, rng.choice(["x", "y", None, f"z{k}"]), "k", str(rng.randint(1, 9))) for i in range(rng.randint(1, 6))] for k in range(6)]
    batches[3].append(batches[0][0])  # a retry moves nothing
    number = F.col("feature_json").cast("long")
    parts = lambda df: df.select("customer", number.alias("cents"), F.lit(1).alias("n"))
    measures = {"total": "cents", "mean": "cents / n"}
    source = arriving(spark, tmp_path, ROWS, *batches)
    done(stream_restate(source, f"{tmp_path}/s", f"{tmp_path}/c", f"{tmp_path}/moved", f"{tmp_path}/k", parts, ["customer"], ["cents", "n"], measures))
    seen, found = {}, {}
    for r in spark.read.parquet(f"{tmp_path}/moved").collect():
        found.setdefault(r.batch, set()).add((r.customer, r.measure, r.change, r.old_value and float(r.old_value), float(r.new_value)))
    evaluate = lambda rows: {(c, m): v for c in {r[2] for r in rows} for own in [[int(r[4]) for r in rows if r[2] == c]] for m, v in (("total", sum(own)), ("mean", sum(own) / len(own)))}
    for k in range(6):
        now = evaluate(list(dict.fromkeys(r for batch in batches[: k + 1] for r in batch)))
        want = {(*key, "changed" if key in seen else "added", seen.get(key), v) for key, v in now.items() if seen.get(key) != v}
        near = lambda rows: {(*r[:3], r[3] and round(r[3], 5), round(r[4], 5)) for r in rows}
        assert near(found.get(k, set())) == near(want)
        seen = now


def test_counter_growth_equals_stored_intervals_on_shuffled_arrival(spark, tmp_path):
    schema = "account string, source string, scope_id string, token_kind string, temporality string, ts timestamp, source_line long, quantity long"
    at = lambda d, line, n, scope="s", kind="cumulative": ("a", "cli", scope, "input", kind, dt.datetime(2024, 1, d, tzinfo=UTC), line, n)
    big = (1 << 60) + 1
    rows = [at(8, 1, 5), at(11, 2, 9), at(11, 3, None), at(12, 4, big, "t"), at(12, 9, 1, kind="delta"), at(13, 5, 20), at(14, 7, 12), at(14, 6, 30), at(15, 8, big + 2, "t"), at(12, 1, 1, "u"), at(13, 2, 0, "u")]
    random.Random(5).shuffle(rows)
    closing = [at(25, 99, 0, "end")]  # moves the watermark past all of them
    start, end = dt.datetime(2024, 1, 10, tzinfo=UTC), dt.datetime(2024, 1, 25, tzinfo=UTC)
    grown = stream_counter_growth(arriving(spark, tmp_path, schema, rows[:4], rows[4:7], rows[7:], closing, closing), start, "9 days")
    columns = [*KEY, "source_line", "quantity", "previous", "status", "growth"]
    done(grown.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/k").trigger(availableNow=True).start())
    wanted = usage_intervals(spark.createDataFrame(rows, schema), start, end).select(columns)
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").select(columns).collect())) == sorted(map(str, wanted.collect()))


def test_windows_and_late_rows(spark, tmp_path):
    schema = "ts timestamp, _recorded_at timestamp, model string, tokens long"
    rows = [(DAY, DAY, "m", 5), (DAY, DAY + dt.timedelta(days=40), "m", 7), (DAY + dt.timedelta(days=100), DAY + dt.timedelta(days=100), "m", 1)]
    source = arriving(spark, tmp_path, schema, rows)
    done(month_usage(source).writeStream.format("parquet").option("path", f"{tmp_path}/w").option("checkpointLocation", f"{tmp_path}/k1").trigger(availableNow=True).start())
    assert [(r.model, r.tokens, r.n) for r in spark.read.parquet(f"{tmp_path}/w").collect()] == [("m", 12, 2)]
    keep = lambda name: lambda df: df.write.mode("append").parquet(f"{tmp_path}/{name}")
    done(split_late(source, DAY + dt.timedelta(days=20), keep("on"), keep("late"), f"{tmp_path}/k2"))
    assert spark.read.parquet(f"{tmp_path}/on").count() == 2 and [r.tokens for r in spark.read.parquet(f"{tmp_path}/late").collect()] == [7]


def test_attribution_finds_the_fewest_documents(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "activity_id string, customer string, document string, n long")
    old = rows(("a", "x", "d0", 1), ("b", "y", "d0", 1))
    total = lambda df, by: df.groupBy(*by, "customer").agg(F.sum("n").alias("n"))
    new = old.unionByName(rows(("c", "x", "d1", 2), ("d", "x", "d1", 3), ("e", "z", None, 4), ("f", "y", "d2", 5), ("g", "y", "d2", -5)))
    for within in (None, ["customer"]):
        found = {r.customer: (r.status, r.documents) for r in attribute_changes(old, new, F.col("document"), total, ["customer"], within).collect()}
        assert found == {"x": ("proven_minimum_group_set", ["d1"]), "z": ("proven_minimum_group_set", ["activity:e"])}
    many = new.unionByName(rows(*[(f"m{k}", "y", f"e{k}", 1) for k in range(5)]))
    found = {r.customer: (r.status, r.documents) for r in attribute_changes(old, many, F.col("document"), total, ["customer"], ["customer"]).collect()}
    assert found == {"x": ("proven_minimum_group_set", ["d1"]), "z": ("proven_minimum_group_set", ["activity:e"]), "y": ("unresolved_candidates", [])}
    assert {r.status for r in attribute_changes(old, many, F.col("document"), total, ["customer"]).collect()} == {"unresolved_candidates"}
    with pytest.raises(ValueError):
        attribute_changes(new, old, F.col("document"), total, ["customer"])


def test_attribution_of_rows_that_go_and_of_equal_sets(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "activity_id string, customer string, document string, n long")
    old = rows(("a", "x", "d0", 1), ("b", "y", "d0", 1), ("c", None, "d0", 1))
    full = lambda df, by: df.groupBy(*by, "customer").agg(F.sum("n").alias("n"), F.max("n").alias("most")).filter("n <> 0")
    new = old.unionByName(rows(("d", "x", "d2", -1), ("e", "x", "d1", 0), ("f", "y", "d3", 4), ("g", "y", "d1", 2), ("h", "y", "d2", 2), ("i", "y", "d4", -4), ("j", None, "d5", 3)))
    found = {r.customer: (r.status, r.documents) for r in attribute_changes(old, new, F.col("document"), full, ["customer"], ["customer"]).collect()}
    # x is gone by d2 alone; y has 1 + 4 + 2 + 2 - 4 with 4 the largest, which d3 alone gives too.
    assert found == {"x": ("proven_minimum_group_set", ["d2"]), "y": ("proven_minimum_group_set", ["d3"]), None: ("proven_minimum_group_set", ["d5"])}
    odd = new.unionByName(rows(("k", "y", "d1", 1)))
    assert {r.customer: r.documents for r in attribute_changes(old, odd, F.col("document"), full, ["customer"], ["customer"]).collect()}["y"] == ["d1", "d2", "d3", "d4"]
    size = lambda df, by: df.groupBy(*by, "customer").agg(F.max("n").alias("most"))
    ties = old.unionByName(rows(("d", "x", "d2", 9), ("e", "x", "d1", 9)))
    assert [r.documents for r in attribute_changes(old, ties, F.col("document"), size, ["customer"], ["customer"]).collect()] == [["d1"]]
    same = attribute_changes(old, old, F.col("document"), lambda df, by: df.groupBy(*by, "customer").agg(F.first("n").alias("n")), ["customer"], ["customer"])
    assert same.count() == 0


def test_yield_bridge_must_tie(spark):
    side = lambda n, net, fee: spark.createDataFrame([(n, net, fee)], "tokens long, net_revenue_cents long, channel_fee_cents long")
    moved = lambda a, b: spark.createDataFrame([("4000", a), ("4095", b), ("1100", -a - b)], "account string, delta_cents long")
    row = yield_bridge(side(100, 50, 5), side(100, 80, 15), moved(-40, 10)).first()
    assert (row.delta_net_revenue_cents, row.delta_channel_fee_cents, row.delta_before_fees_cents, row.delta_after_fees_per_mtok) == (30, 10, 40, 3000.0)
    for wrong in ((side(100, 80, 15), moved(-40, 11)), (side(101, 80, 15), moved(-40, 10))):
        with pytest.raises(ValueError):
            yield_bridge(side(100, 50, 5), *wrong)
