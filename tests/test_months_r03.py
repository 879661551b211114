"""Months of subscriptions are spread after their states are grouped by years; parents without revenue count without a join."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import accounting, entities, metrics
from ledgerloom.plans import context, lineage, queries
from ledgerloom.plans.books import Books
from ledgerloom.plans.context import Context

CTX = Context(dt.date(2001, 7, 31), dt.date(2001, 8, 1), dt.date(1995, 1, 1))
STATE = "_source string, customer string, subscription_id string, activity_id string, start_day date, stop_day date, price_cents long, paid_seats long"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def states():
    day = lambda k: dt.date(1995, 1, 1) + dt.timedelta(days=k)
    rows = []
    for c in range(12):
        cuts = sorted({0, 31, *[(c * 97 + k * k * 53) % 2400 for k in range(9)], 2404})
        rows += [("s", f"c{c}", f"k{c}", f"e{c}:{a}", day(a), day(b), 10**13 if c == 3 else 1000 + c * 7 + a, 3 + a % 5) for a, b in zip(cuts, cuts[1:], strict=False)]
    return rows


def test_months_of_states_equal_their_days_and_no_month_is_aggregated(spark):
    wanted, of = defaultdict(int), defaultdict(set)
    for s, c, k, e, a, b, price, seats in states():
        while a < b:
            if a < CTX.period_end:
                wanted[(c, a.replace(day=1))] += price * seats
                of[(c, a.replace(day=1))].add(e)
            a += dt.timedelta(days=1)
    months = accounting.subscription_months(spark.createDataFrame(states(), STATE), CTX)
    found = accounting.subscription_amounts(months).collect()
    assert {(r.customer, r.month): int(r.numerator) for r in found} == wanted and len(found) == len(wanted)
    assert all(r.upstream_ids == sorted(of[(r.customer, r.month)]) for r in found)
    small = [r for r in found if r.numerator < 2**52]
    assert len(small) > 700 and all(r.amount == (2 * int(r.numerator) + r.days) // (2 * r.days) for r in small)
    one = spark.createDataFrame([("s", "c", "k", "e", dt.date(1995, 1, 1), dt.date(2001, 8, 1), 100, 2)], STATE)
    months = accounting.subscription_months(one, CTX)
    assert months.count() == 79
    grouped = [line for line in plan(months).splitlines() if "Aggregate(keys=" in line]
    assert grouped and not any("month#" in line.split("functions=")[0] for line in grouped)


def test_revenue_by_parent_is_dealt_by_rows_and_members_are_not_joined(spark, monkeypatch):
    monkeypatch.setattr(lineage, "PART_ROWS", 40)
    lines = [(f"c{i % 20}", dt.date(2000, 1 + i % 12, 1), "usage" if i % 3 else "subscription", "usage" if i % 3 else "subscription", 10_000_000 + i) for i in range(400)]
    recognized = lineage.cut(spark.createDataFrame(lines, "customer string, month date, source string, recognition_kind string, revenue_cents long"), "recognized-test")
    identity = lineage.cut(spark.createDataFrame([(f"c{i}", f"c{i // 3}") for i in range(40)], "customer string, ultimate_parent string"), "identity-test")
    parents = entities.parent_month(recognized, context.recognition_policy(spark), identity)
    wanted = defaultdict(lambda: [0, 0, 0])
    for c, m, source, _, cents in lines:
        cell = wanted[(f"c{int(c[1:]) // 3}", m)]
        cell[source == "subscription"] += cents
        cell[2] += cents
    assert {(r.ultimate_parent, r.month): [r.consumption_cents, r.subscription_cents, r.net_revenue_cents] for r in parents.collect()} == wanted
    exchanges = [line for line in plan(parents).splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) >= 3 and all(", 10), REPARTITION_BY_NUM" in line for line in exchanges)
    ctx = Context(dt.date(2001, 7, 31), dt.date(2001, 8, 1), dt.date(1999, 1, 1))
    members = metrics.nrr_members(parents, identity, context.nrr_lenses(spark), ctx)
    rows = members.collect()
    assert len(rows) == 4 * 14 and sum(r.base_cents == 0 and not r.in_cohort for r in rows if r.lens == "base_t12m") == 7
    base = sum(v[0] for (p, m), v in wanted.items() if dt.date(1999, 8, 1) <= m < dt.date(2000, 8, 1))
    assert sum(r.base_cents for r in rows if r.lens == "base_t12m") == base
    assert "SortMergeJoin [lens" not in plan(members)
    assert members.groupBy("lens").agg(F.count("*")).count() == 4


def test_the_first_month_is_found_without_reading_lines_of_orders(spark):
    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("the tables are not here")
    act = queries.stored_stream(spark, data)
    book = Books(act, queries.ASOF)
    assert not any("lineitem" in f for f in book.times.inputFiles())
    assert context.context(book.snap, queries.ASOF) == book.ctx
    lines = act.filter("activity = 'tokens_processed'").select("ts", "_recorded_at").distinct()
    assert lines.exceptAll(queries.token_times(act).distinct()).isEmpty() and queries.token_times(act).distinct().exceptAll(lines).isEmpty()
