"""The ledger on hand-made rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.money import apportion
from ledgerloom.operators import compare, usage
from ledgerloom.operators.entities import roots
from ledgerloom.plans.context import snapshot, with_occurrence
from ledgerloom.sources.activity import append_batch

UTC = dt.timezone.utc


def test_apportion_is_exact_and_gives_cents_to_the_largest_remainders(spark):
    rows = [("g", "a", 100, 1), ("g", "b", 100, 1), ("g", "c", 100, 1), ("n", "a", -7, 3), ("n", "b", -7, 4), ("z", "a", 5, 0)]
    df = spark.createDataFrame(rows, "g string, id string, amount long, w long")
    out = {(r.g, r.id): r.share for r in apportion(df, ["g"], "amount", "w", "id", "share").collect()}
    assert out == {("g", "a"): 34, ("g", "b"): 33, ("g", "c"): 33, ("n", "a"): -3, ("n", "b"): -4, ("z", "a"): 0}


def test_apportion_many_rows_sums_to_the_amount(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id"), F.lit(987_654_321).cast("long").alias("amount"), (F.col("id") * 7919 % 1009).alias("w"))
    sums = apportion(df, ["g"], "amount", "w", "id", "share").groupBy("g").agg(F.sum("share").alias("s")).collect()
    assert {r.s for r in sums} == {987_654_321}


def test_roots_of_chains_cycles_and_strays(spark):
    chain = [(f"c{k}", f"c{k - 1}" if k else None) for k in range(40)]
    rows = chain + [("x", "y"), ("y", "x"), ("above", "x"), ("s", "unknown")]
    found = {r.customer: r.ultimate_parent for r in roots(spark.createDataFrame(rows, "customer string, parent string"), 12).collect()}
    assert all(found[f"c{k}"] == "c0" for k in range(40)) and found["s"] == "unknown"
    assert not {"x", "y", "above"} & set(found)


def visits(spark):
    day = lambda m, d: dt.datetime(2024, m, d, tzinfo=UTC)
    rows = [("e1", day(2, 1), day(2, 1)), ("e2", day(2, 2), day(3, 10)), ("e3", day(2, 3), day(2, 3))]
    return spark.createDataFrame([(i, t, r, None, "v", "trial_started", k + 1) for k, (i, t, r) in enumerate(rows)], "activity_id string, ts timestamp, _recorded_at timestamp, customer string, anonymous_customer_id string, activity string, _stream_position long")


def test_windows_come_after_the_knowledge_filter(spark):
    asof = dt.date(2024, 2, 29)
    early = {r.activity_id: (r.activity_occurrence, r.activity_repeated_at) for r in with_occurrence(snapshot(visits(spark), asof)).collect()}
    assert set(early) == {"e1", "e3"} and early["e1"][1].day == 3
    late = {r.activity_id: (r.activity_occurrence, r.activity_repeated_at) for r in with_occurrence(snapshot(visits(spark), asof, dt.datetime(2024, 3, 11, tzinfo=UTC))).collect()}
    assert [late[k][0] for k in ("e1", "e2", "e3")] == [1, 2, 3] and late["e1"][1].day == 2 and late["e3"][1] is None
    assert snapshot(visits(spark), asof, watermark=1).count() == 1


def test_append_retry_and_conflict(spark):
    schema = "activity_id string, ts timestamp, customer string, anonymous_customer_id string, activity string, feature_json string, revenue_impact decimal(18,2), link string"
    now = dt.datetime(2024, 1, 1, tzinfo=UTC)
    rows = lambda *who: spark.createDataFrame([(i, now, c, None, "x", "{}", None, None) for i, c in who], schema)
    fresh, clash = append_batch(None, rows(("a", "c1"), ("a", "c1"), ("b", "c2")))
    assert {(r.activity_id, r._stream_position) for r in fresh.collect()} == {("a", 1), ("b", 2)} and clash.count() == 0
    more, clash = append_batch(fresh, rows(("a", "c1"), ("b", "other"), ("c", "c3")))
    assert [(r.activity_id, r._stream_position) for r in more.collect()] == [("c", 3)] and [r.activity_id for r in clash.collect()] == ["b"]


def test_compare_fingerprint_and_restate(spark):
    a = spark.createDataFrame([(1, 10, 0.5), (2, 20, None), (3, 5, 1.0), (None, 1, 1.0)], "k int, cents long, ratio double")
    b = spark.createDataFrame([(1, 10, 0.5 + 1e-9), (2, 21, None), (4, 5, 1.0), (None, 1, 1.0)], "k int, cents long, ratio double")
    row = compare.compare_tables(a, b, ["k"]).first()
    assert (row.only_left, row.only_right, row.repeated_left, row.different) == (1, 1, 0, 1)
    assert compare.fingerprint(a).first() == compare.fingerprint(a.repartition(3).orderBy(F.desc("k"))).first()
    assert compare.fingerprint(a).first().fingerprint != compare.fingerprint(b).first().fingerprint
    kinds = {(r.k, r.measure): r.change for r in compare.restate(a, b, ["k"], ["cents"]).collect()}
    assert kinds == {(1, "cents"): "unchanged", (2, "cents"): "changed", (3, "cents"): "removed", (4, "cents"): "added", (None, "cents"): "unchanged"}


@pytest.mark.parametrize(("second", "status"), [(15, "observed"), (3, "counter_reset"), (None, "missing_counter")])
def test_usage_intervals(spark, second, status):
    day = lambda d: dt.datetime(2024, 1, d, tzinfo=UTC)
    rows = [("u", "s", "a", "input", "cumulative", day(2), 1, 10), ("u", "s", "b", "input", "cumulative", day(2), 9, 99), ("u", "s", "a", "input", "cumulative", day(3), 2, second), ("u", "s", "a", "input", "interval_total", day(3), 3, 7)]
    schema = "account string, source string, scope_id string, token_kind string, temporality string, ts timestamp, source_line long, quantity long"
    found = usage.usage_intervals(spark.createDataFrame(rows, schema), day(1), day(31))
    by_line = {r.source_line: (r.status, r.growth) for r in found.collect()}
    assert by_line[9] == ("opening_balance", None) and 3 not in by_line
    assert by_line[1] == ("opening_balance", None) and by_line[2] == (status, 5 if status == "observed" else None)
