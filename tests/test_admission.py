"""Admission rules on hand-made payloads."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ledgerloom.sources.admission import canonical_features, inventory, pack_long, restore_check, validate_activity

INVOICE = {"invoice_id": "i", "usage_batch_id": "b", "contract_id": None, "period_start": "2024-01-01", "period_end": "2024-02-01", "gross_usd": "10.00", "discount_usd": "1.00", "net_usd": "9.00", "channel_fee_usd": "0.50", "commit_applied_usd": "0.00", "cash_due_usd": "9.00", "channel": "direct"}


def errors(spark, activity, payload):
    row = spark.createDataFrame([(activity, json.dumps(payload))], "activity string, feature_json string")
    return validate_activity(row).first().errors


def test_payload_rules(spark):
    assert errors(spark, "usage_invoiced", INVOICE) == []
    assert errors(spark, "nothing", {}) == ["unknown activity"]
    assert errors(spark, "usage_invoiced", INVOICE | {"net_usd": "9.001"})[0] == "bad net_usd"
    assert errors(spark, "usage_invoiced", INVOICE | {"gross_usd": "11.00"}) == ["invoice arithmetic"]
    assert errors(spark, "usage_invoiced", INVOICE | {"period_end": "2023-01-01"}) == ["period order"]
    assert errors(spark, "usage_invoiced", INVOICE | {"channel_fee_usd": "9.50"}) == ["fee above net"]
    assert errors(spark, "usage_invoiced", INVOICE | {"more": 1}) == ["unknown field"]
    short = {k: v for k, v in INVOICE.items() if k != "channel"}
    assert errors(spark, "usage_invoiced", short) == ["missing channel"]
    assert errors(spark, "usage_invoiced", INVOICE | {"channel": None}) == ["null channel"]
    assert errors(spark, "seat_added", {"subscription_id": "s", "plan": "pro", "seats": 0, "seats_after": 2}) == ["low seats"]
    renewed = {"contract_id": "k", "term_months": 12, "commit_usd": "5.00", "discount_pct": 0.1, "channel": "direct", "start": "2024-01-01", "end": "2024-12-31"}
    assert errors(spark, "contract_renewed", renewed) == []
    assert errors(spark, "contract_renewed", renewed | {"discount_pct": 1.5, "channel": "fax"}) == ["high discount_pct", "bad channel"]
    assert errors(spark, "usage_invoiced", INVOICE | {"cash_due_usd": "8.00"}) == ["commitment and cash"]
    assert errors(spark, "usage_invoiced", INVOICE | {"commit_applied_usd": "1.00", "cash_due_usd": "8.00"}) == ["drawdown without contract"]
    assert errors(spark, "customer_churned", {"reason": " "}) == ["empty reason"]
    recognised = {"period": "2024-01-01", "net_usd": "5.00", "source": "usage", "source_document": "i", "recognition_kind": "usage", "channel": "direct"}
    rows = spark.createDataFrame([("revenue_recognized", json.dumps(recognised), i) for i in ("5.00", "4.00", None)] + [("customer_churned", '{"reason": "r"}', "1.00")], "activity string, feature_json string, impact string")
    assert [r.errors for r in validate_activity(rows.withColumn("revenue_impact", F.col("impact").cast("decimal(18,2)"))).collect()] == [[], ["revenue impact"], ["revenue impact"], ["revenue impact"]]


def test_payloads_of_usage_counters(spark):
    times = {"interval_start": "2024-01-01T00:00:00Z", "interval_end": "2024-01-01T01:00:00Z"}
    seen = times | {"observation_id": "o", "source": "s", "scope_id": "x", "model": None, "token_kind": "total", "quantity": None, "temporality": "delta", "revision": 0, "supersedes": None, "evidence_sha256": "0" * 64}
    assert errors(spark, "usage_observed", seen) == []
    assert errors(spark, "usage_observed", seen | {"evidence_sha256": "xyz", "quantity": -1}) == ["low quantity", "bad evidence_sha256"]
    assert errors(spark, "usage_observed", seen | {"interval_end": "2023-01-01T00:00:00Z"}) == ["period order"]
    charge = times | {"observation_id": "o", "source": "s", "scope_id": "x", "amount_decimal": "1.23456", "currency": "USD", "basis": "credit", "revision": 0, "supersedes": None, "evidence_sha256": "a" * 64}
    assert errors(spark, "usage_charge", charge) == [] and errors(spark, "usage_charge", charge | {"amount_decimal": "1e3"}) == ["bad amount_decimal"]


def test_canonical_payload(spark):
    row = spark.createDataFrame([("credit_issued", '{"reason":"r","amount_usd":"1.5","period":"2024-01-01","invoice_id":"i","credit_id":"c"}')], "activity string, feature_json string")
    assert canonical_features(row).first().feature_json == '{"amount_usd":"1.50","credit_id":"c","invoice_id":"i","period":"2024-01-01","reason":"r"}'


def test_inventory_restore_and_pack(spark):
    rows = [(1, "a", "x", True), (2, "a", "x", True), (3, "a", "y", True), (4, "b", "z", False), (5, "b", "z", True)]
    found = {r.observation: r.status for r in inventory(spark.createDataFrame(rows, "observation long, activity_id string, content string, sound boolean")).collect()}
    assert found == {1: "accepted", 2: "duplicate", 3: "conflict", 4: "rejected", 5: "accepted"}
    act = spark.createDataFrame([("a", 1), ("b", 2)], "activity_id string, _stream_position long")
    assert restore_check(act).first().complete and not restore_check(act.filter("_stream_position = 2")).first().complete
    seen = act.select(F.lit("usage_charge").alias("activity"), F.lit('{"interval_start": "2024-05-01T02:30:00.5+02:00", "scope_id": "s", "amount_decimal": "1.5"}').alias("feature_json"))
    times = json.loads(canonical_features(seen).first().feature_json)
    assert times["interval_start"] == "2024-05-01T00:30:00.500000Z" and times["supersedes"] is None and list(times) == sorted(times)
    paid = pack_long("m", spark.createDataFrame([(500, "held", 1234), (700, "defined", None)], "floor_cents long, status string, net_cents long"), ["floor_cents"], {"net_cents": "cents"})
    assert {tuple(r) for r in paid.select("dimensions", "measure", "value", "status").collect()} == {('{"floor_usd":"5.00"}', "net_usd", "12.34", "held"), ('{"floor_usd":"7.00"}', "net_usd", None, "undefined")}
    long = pack_long("m", spark.createDataFrame([("g1", 1234, None)], "model string, net long, ratio double"), ["model"], {"net": "cents", "ratio": "ratio"})
    assert {(r.measure, r.value, r.unit, r.status) for r in long.collect()} == {("net", "12.34", "USD", "defined"), ("ratio", None, "ratio", "undefined")}
