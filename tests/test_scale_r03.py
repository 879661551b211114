"""What large tables must not do: write token events, move wide rows more than once, order more than one bin of a group."""

from __future__ import annotations

from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.money import apportion
from ledgerloom.plans import context, queries
from ledgerloom.plans.books import Books

DATA = "/root/testdata/sf0.001"


def shared(rows):
    """Largest-remainder shares in plain integers."""
    groups, out = defaultdict(list), {}
    for g, i, amount, w in rows:
        groups[g].append((i, amount, w))
    for g, held in groups.items():
        total, amount = sum(w for _, _, w in held), held[0][1]
        order = sorted(held, key=lambda r: (-(r[1] * r[2] % total), r[0]))
        left = amount - sum(amount * w // total for _, _, w in held)
        out |= {(g, i): amount * w // total + (k < left) for k, (i, _, w) in enumerate(order)}
    return out


def test_shares_are_exact_and_only_the_bin_where_cents_run_out_is_moved(spark):
    rows = [(f"g{i % 3}", i, 1_234_567 + i % 3, 1 + i * 7919 % 1009) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, i long, amount long, w long").repartition(3).withColumn("before", F.spark_partition_id())
    stored = queries.cut(df, "apportion-test", "before")
    at = F.struct(F.input_file_name().alias("file"))
    found = apportion(stored.withColumn("at", at), ["g"], "amount", "w", "i", "share").withColumn("task", F.spark_partition_id()).collect()
    assert {(r.g, r.i): r.share for r in found} == shared(rows)
    tasks = defaultdict(set)
    for r in found:
        tasks[r.task].add(r.before)
    mixed = sum(1 for r in found if len(tasks[r.task]) > 1 and r.task > 2)
    assert mixed < 60


@pytest.mark.skipif(not Path(DATA).exists(), reason="the tables are not here")
def test_token_events_are_read_from_the_tables_and_not_written(spark):
    act = queries.stored_stream(spark, DATA)
    assert not any("tokens_processed" in f for f in act.inputFiles())
    assert act.filter("activity = 'tokens_processed'").count() == spark.read.parquet(f"{DATA}/lineitem.parquet").count()


@pytest.mark.skipif(not Path(DATA).exists(), reason="the tables are not here")
def test_tokens_are_shared_out_without_being_written(spark):
    book = Books(queries.stored_stream(spark, DATA), queries.ASOF)
    assert not any("/tokens-" in f for f in book.tokens.inputFiles())
    cost = book.compute.filter("row_kind = 'consumption' AND purpose = 'inference'").agg(F.sum("cost_cents")).first()[0]
    assert book.tokens.agg(F.sum("allocated_cost_cents")).first()[0] == cost
    assert context.allocation(spark).count() == 20


def test_small_groups_are_shared_exactly_in_longs_and_beyond(spark):
    from ledgerloom.functions import money

    sizes = {"s": (1_234_567, 1_000), "e": (money.NARROW, money.NARROW // 7), "w": (money.NARROW + 5, 10**12), "x": (9 * 10**15, 3)}
    rows = [(g, i, amount, 1 + i * 7919 % 13 * unit) for g, (amount, unit) in sizes.items() for i in range(7)]
    df = spark.createDataFrame(rows, "g string, i long, amount long, w long")
    found = money.apportion_small(df, ["g"], {"amount": "share"}, "w", "i").collect()
    assert {(r.g, r.i): r.share for r in found} == shared(rows)
    odd = spark.createDataFrame([("z", 1, 5, 0), ("z", 2, 5, 0), ("n", 1, -7, 3), ("n", 2, -7, 4)], "g string, i long, amount long, w long")
    found = money.apportion_small(odd, ["g"], {"amount": "share"}, "w", "i").collect()
    assert {(r.g, r.i): r.share for r in found} == {("z", 1): 0, ("z", 2): 0, ("n", 1): -3, ("n", 2): -4}
