"""Findings of round 4: what made queries slow or large at size."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.sources.admission import validate_activity


def lambdas(text: str) -> list[str]:
    """The functions over lists in a plan."""
    found, at = [], text.find("lambdafunction(")
    while at >= 0:
        depth, end = 0, at + len("lambdafunction")
        while True:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
            if not depth:
                break
        found.append(text[at:end])
        at = text.find("lambdafunction(", end)
    return found


def test_field_rules_are_compiled(spark):
    """rules of fields were a function over a list, evaluated uncompiled, and read every text as a number."""
    texts = [json.dumps({"reason": "r"}), "no json", json.dumps({"reason": None}), json.dumps({"reason": "r", "period_start": "2024-02-01", "period_end": "2024-01-01", "start": "2024-02-01", "end": "2024-01-01"})]
    rows = spark.createDataFrame([(k, "customer_churned", text) for k, text in enumerate(texts)], "k int, activity string, feature_json string")
    found = validate_activity(rows)
    assert [r.errors for r in found.orderBy("k").collect()] == [[], ["missing reason"], ["null reason"], ["unknown field", "period order", "period order"]]
    seats = spark.createDataFrame([("seat_added", json.dumps({"subscription_id": "s", "plan": "pro", "seats": "many", "seats_after": 0}))], "activity string, feature_json string")
    assert validate_activity(seats).first().errors == ["bad seats", "low seats_after"]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "RLIKE" in plan and not any("RLIKE" in f or "as double" in f for f in lambdas(plan))


def test_facts_are_added_up_without_sorting(spark):
    """facts held a text, so their sums were sorted; token events were read from the stream again."""
    from ledgerloom.operators import asserted
    from ledgerloom.plans import queries

    book = []
    whole = asserted.AssertedBooks
    asserted.AssertedBooks = lambda *args: book.append(whole(*args)) or book[0]
    try:
        found = queries.asserted_checks(faults=True)(spark, "/root/testdata/sf0.001")
    finally:
        asserted.AssertedBooks = whole
    plan = found._jdf.queryExecution().executedPlan().toString()
    sums = [line for line in plan.splitlines() if "Aggregate(keys=[reason" in line]
    assert sums and not any("SortAggregate" in line for line in sums)
    assert "lineitem.parquet" not in plan and book[0].usage.count() == book[0].allocated.count()


def test_small_groups_total_in_longs(spark):
    """weights of a group are added up in longs, and right where they don't fit."""
    rows = [("a", k, 100, w) for k, w in enumerate([1, 1, 1])] + [("b", k, 7, w) for k, w in enumerate([2**61, 2**61, 2**61])] + [("c", k, -5, w) for k, w in enumerate([3_000_000_000, 1, 0])]
    rows += [("d", 0, 9, 0), ("e", 0, 5, None), ("f", 0, 10, -3), ("f", 1, 10, -1)]
    df = spark.createDataFrame(rows, "g string, k long, amount long, w long")
    found = money.apportion_small(df, ["g"], {"amount": "x"}, "w", "k")
    wide = money.apportion_small(df.withColumn("w", F.col("w").cast("decimal(19,0)")), ["g"], {"amount": "x"}, "w", "k")
    shares = lambda table: {(r.g, r.k): r.x for r in table.select("g", "k", "x").collect()}
    assert shares(found) == shares(wide)
    assert [shares(found)["a", k] for k in range(3)] == [34, 33, 33] and [shares(found)["b", k] for k in range(3)] == [3, 2, 2] and [shares(found)["c", k] for k in range(3)] == [-5, 0, 0]
    assert "sum(cast(w" not in found._jdf.queryExecution().analyzed().toString()


def test_one_month_of_tokens_is_priced(spark):
    """both sides of the bridge wrote all token events, priced, and their ledgers lay on disk together."""
    from ledgerloom.plans import lineage, queries

    root = lineage.scratch_root(spark).removeprefix("file://")
    queries.stored_stream(spark, "/root/testdata/sf0.001")
    before = set(os.listdir(root))
    assert queries.yield_bridge(spark, "/root/testdata/sf0.001").count() == 1
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(root)) - before}
    assert not left & {"usage", "priced", "priced-month", "month-tokens", "recognized", "funding", "invoices", "invoice-amounts", "identity"}


def test_token_population(spark):
    """token events were joined with all their shares to find lost ones, and shared again to find doubled ones."""
    from ledgerloom.operators import checks

    ids = lambda text: spark.createDataFrame([(c,) for c in text], "activity_id string")
    found = {r.reason: r.failures for r in checks.token_population(ids("abcdd"), ids("abbbce")).collect()}
    assert found == {"token_population_complete": 2, "token_population_unique": 2}
    none = {r.reason: r.failures for r in checks.token_population(ids("a"), ids("a")).collect()}
    assert set(none.values()) == {0} and checks.token_population(ids("a"), ids("a")).dtypes == [("reason", "string"), ("failures", "bigint")]
