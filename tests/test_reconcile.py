from __future__ import annotations

import datetime as dt

from ledgerloom.operators.reconcile import erp_bridge, reconcile_sources


def test_erp_bridge_adds_the_fee_back_once(spark):
    month = dt.date(2024, 1, 1)
    revenue = spark.createDataFrame([(month, "commit_drawdown", "usage", 300), (month, "usage", "usage", 600), (month, "subscription", "subscription", 50)], "month date, source string, recognition_kind string, revenue_cents long")
    amounts = spark.createDataFrame([(month, 100)], "month date, fee long")
    erp = spark.createDataFrame([("2024-01", "4000", "usage", "7.00"), ("2024-01", "4000", "commit_drawdown", "3.00"), ("2024-01", "4010", "subscription", "0.49")], "period string, account string, source string, amount_usd string")
    found = {(r.account, r.source): r.difference_cents for r in erp_bridge(revenue, amounts, erp).collect()}
    assert found == {("4000", "usage"): 0, ("4000", "commit_drawdown"): 0, ("4010", "subscription"): 1}


def test_reconcile_sources(spark):
    now = dt.datetime(2024, 1, 5)
    rows = lambda *x: spark.createDataFrame([(i, now, "k", c) for i, c in x], "activity_id string, ts timestamp, activity string, content string")
    found = {r.status: r.n for r in reconcile_sources(rows(("a", "1"), ("b", "2"), ("d", "4")), rows(("a", "1"), ("b", "x"), ("c", "3"))).collect()}
    assert found == {"matched": 1, "altered": 1, "missing": 1, "unexpected": 1}


def test_reconcile_sources_compares_arrival_and_cents(spark):
    now, later = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 6)
    rows = lambda *x: spark.createDataFrame([(i, now, "k", "same", at, n) for i, at, n in x], "activity_id string, ts timestamp, activity string, content string, _recorded_at timestamp, cents long")
    found = {r.status: (r.n, r.our_cents, r.their_cents) for r in reconcile_sources(rows(("a", now, 5), ("b", now, 7)), rows(("a", now, 5), ("b", later, 7), ("c", now, 9))).collect()}
    assert found == {"matched": (1, 5, 5), "altered_arrival": (1, 7, 7), "missing": (1, None, 9)}
