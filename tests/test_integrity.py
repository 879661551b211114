"""Controls that the planted stream can't reach, diagnostics, admission of counters, and strict comparisons."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.money import apportion, apportion_small
from ledgerloom.operators import checks, compare, integrity, usage
from ledgerloom.plans.context import LENSES
from ledgerloom.sources.activity import append_batch

UTC = dt.timezone.utc
NAMES = [lens[0] for lens in LENSES["v3"]]
ASOF, FIRST = dt.date(2026, 7, 31), dt.date(2026, 7, 1)


def test_journal_checks_fire_on_an_open_month_and_on_unbooked_revenue(spark):
    class Doctored:
        class ctx:
            period_end = dt.date(2000, 3, 1)

        journals = spark.createDataFrame([(dt.date(2000, 1, 1), "1100", 10), (dt.date(2000, 1, 1), "4000", -10), (dt.date(2000, 2, 1), "4000", -7)], "month date, account string, amount_cents long")
        recognized = spark.createDataFrame([(dt.date(2000, 1, 1), 10), (dt.date(2000, 2, 1), 8)], "month date, revenue_cents long")

    found = {r.reason: r.failures for r in checks.journal_errors(Doctored()).collect()}
    assert found == {"journals_balance": 1, "recognized_equals_revenue_accounts": 1}


def test_revenue_without_exposure_fires(spark):
    key = "_source string, customer string, subscription_id string, month date"
    month = dt.date(2000, 1, 1)

    class Doctored:
        revenue = spark.createDataFrame([("s", "c", "x", month, "subscription", 5)], "_source string, customer string, source_document string, month date, family string, revenue_cents long")
        seats = spark.createDataFrame([("s", "c", "x", month, 5, 0, 1, 1, 0, 0, 0, 0, 0)], f"{key}, revenue_cents long, seat_days long, beginning_seats long, ending_seats long, gross_adds long, cancelled_seats long, seat_removals long, transfer_in long, transfer_out long")
        snap = spark.createDataFrame([], "activity_id string, _source string, customer string, ts timestamp, activity string, feature_json string")

    found = {r.reason: r.failures for r in checks.seat_errors(Doctored()).collect()}
    assert found == {"subscription_reconciles": 0, "seat_rollforward": 0, "revenue_has_exposure": 1, "unique_trials": 0}


def test_identity_monotony_and_the_gate(spark):
    nrr = spark.createDataFrame([(10, 8, 3, 1, 0), (10, 9, 0, 0, 0)], "base_revenue_cents long, current_revenue_cents long, expansion_cents long, contraction_cents long, churn_cents long")
    assert checks.nrr_identity(nrr).first().failures == 2
    cohorts = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 5), (2, 2, 5)], "month int, threshold_cents long, customers long")
    assert checks.cohort_monotone(cohorts).first().failures == 1
    checks.require_clean(spark.createDataFrame([("a", 0)], "reason string, failures long"))
    with pytest.raises(ValueError, match="b=2"):
        checks.require_clean(spark.createDataFrame([("a", 0), ("b", 2)], "reason string, failures long"))


CASES = {
    "selected": (ASOF, "nrr", "selected", None),
    "wrong-grain": (FIRST, "nrr", "date_grain_mismatch", "2026-07-31"),
    "other-date": (dt.date(2026, 6, 30), "nrr", "no_matching_date", None),
    "empty": (ASOF, "nrr", "no_population", None),
    "one-missing": (ASOF, "nrr", "incomplete_population", None),
    "one-twice": (ASOF, "nrr", "incomplete_population", None),
    "unknown-lens": (ASOF, "nrr", "incomplete_population", None),
    "two-dates": (ASOF, "nrr", "ambiguous_population", None),
    "undefined": (ASOF, "nrr", "selected_unavailable", None),
    "null-ratio": (ASOF, "nrr", "selected_unavailable", None),
    "other-population": (ASOF, "seats", "unsupported_population", None),
}


def test_nrr_date_diagnostic(spark):
    rows = []
    for case in CASES:
        lines = [[case, ASOF, lens, "defined", 0.95] for lens in NAMES]
        if case == "empty":
            lines = []
        elif case == "one-missing":
            lines.pop()
        elif case == "one-twice":
            lines.append(list(lines[0]))
        elif case == "unknown-lens":
            lines[0][2] = "none"
        elif case == "two-dates":
            lines[0][1] = FIRST
        elif case == "undefined":
            lines[0][3] = "insufficient_history"
        elif case == "null-ratio":
            lines[0][4] = None
        rows += lines
    asked = spark.createDataFrame([(c, p, d) for c, (d, p, _, _) in CASES.items()], "case_id string, population string, requested_date date")
    found = integrity.nrr_date_diagnostic(asked, spark.createDataFrame(rows, "case_id string, month date, lens string, status string, nrr double"), NAMES)
    assert {r.case_id: (r.status, r.suggested_date) for r in found.collect()} == {c: (s, h) for c, (_, _, s, h) in CASES.items()}


NOTHING = "account string, session string, line long, packet string, collected_at timestamp, observed_at timestamp, content string, temporality string, token_kind string, quantity long"


def test_admission_of_usage_counters(spark):
    day = lambda n: dt.datetime(2024, 1, n, tzinfo=dt.timezone.utc)
    shape = "packet string, account string, collected_at timestamp, session string, line long, observed_at timestamp, counters string"
    row = lambda p, line, text, session="s", account="a", seen=2, got=9: (p, account, day(got), session, line, day(seen), text)
    good = '{"cumulative": {"input": 5, "output": 2, "total": 7, "cache_read": 1}}'
    rows = [
        row("fine", 1, good), row("fine", 2, '{"last": {"input": 1, "output": 1, "total": 9}}'), row("fine", 3, '{"cumulative": {"input": null, "output": 2, "total": 9}, "last": {}}'),
        row("sum", 1, '{"cumulative": {"input": 5, "output": 2, "total": 8}}', "t"), row("sum", 2, good, "t"), row("part", 1, '{"last": {"input": 1, "cache_read": 2}}', "u"),
        row("reason", 1, '{"last": {"output": 1, "reasoning_output": 2}}', "u"), row("name", 1, good, "no way"), row("line", 0, good, "u"), row("late", 1, good, "u", seen=8, got=7),
        row("field", 1, '{"last": {"inputs": 1}}', "u"), row("kind", 1, '{"other": {"input": 1}}', "u"), row("none", 1, "{}", "u"), row("text", 1, "so", "u"), row("size", 1, '{"last": {"input": -1}}', "u"),
        row("order", 1, good, "v", seen=3), row("order", 2, good, "v", seen=2), row("order", 3, good, "v", seen=4), row("twice", 1, good, "w"), row("twice", 1, '{"last": {"input": 1}}', "w"),
        row("other", 1, good, "held", account="b"), row("stored", 7, good, "held"),
    ]
    stored, _ = usage.admit_usage(spark.createDataFrame([row("old", 7, '{"last": {"input": 1}}', "held"), row("old", 8, good, "held")], shape), spark.createDataFrame([], NOTHING))
    admitted, quarantined = usage.admit_usage(spark.createDataFrame([*rows, row("again", 8, good, "held")], shape), stored)
    assert {r.packet: r.reasons for r in quarantined.collect()} == {
        "sum": ["total"], "part": ["part above whole"], "reason": ["part above whole"], "name": ["identity"], "line": ["identity"], "late": ["observed after collection"], "field": ["undeclared field"],
        "kind": ["undeclared field"], "none": ["no counter"], "text": ["no counter"], "size": ["quantity"], "order": ["session order"], "twice": ["conflicting lines"],
        "other": ["session of another account"], "stored": ["contradicts a stored observation"],
    }
    found = {(r.line, r.temporality, r.token_kind): r.quantity for r in admitted.collect()}
    assert {r.packet for r in admitted.collect()} == {"fine"} and len(found) == 20
    assert (found[1, "cumulative", "total"], found[1, "cumulative", "reasoning_output"], found[2, "interval_total", "total"], found[3, "cumulative", "input"]) == (7, None, 9, None)
    seen = usage.usage_observations(usage.usage_activities(admitted, "src"), "src")
    assert [(r.source_line, r.residual) for r in usage.counter_residuals(seen).collect()] == [(2, 7)]


def test_a_quarantined_packet_contradicts_nobody(spark):
    day = lambda n: dt.datetime(2024, 1, n, tzinfo=dt.timezone.utc)
    shape = "packet string, account string, collected_at timestamp, session string, line long, observed_at timestamp, counters string"
    says = lambda p, at, line, n: (p, "a", day(at), "s", line, day(1), f'{{"last": {{"input": {n}}}}}')
    # Each says something else about the line before, so every second one falls; the last repeats what a fallen one said.
    chain = [x for k in range(1, 7) for x in (says(f"p{k}", k + 1, k, 10 + k), says(f"p{k}", k + 1, k + 1, 20 + k))] + [says("last", 20, 3, 22)]
    admitted, quarantined = usage.admit_usage(spark.createDataFrame(chain, shape), spark.createDataFrame([], NOTHING))
    assert {r.packet for r in admitted.collect()} == {"p1", "p3", "p5"}
    assert {r.packet: r.reasons for r in quarantined.collect()} == dict.fromkeys(("p2", "p4", "p6", "last"), ["contradicts an earlier packet"])


def test_both_apportionments_agree_and_add_up(spark):
    rows = [(g, k, (g * 37 + k * 11) % 9, a) for g, a in ((1, 100), (2, -101), (3, 7), (4, 0)) for k in range(13)] + [(5, k, 0, 50) for k in range(3)]
    df = spark.createDataFrame([(g, f"{k:02}", w, a, 2 * a) for g, k, w, a in rows], "g int, k string, w long, a long, b long")
    small = {(r.g, r.k): (r.x, r.y) for r in apportion_small(df, ["g"], {"a": "x", "b": "y"}, "w", "k").collect()}
    large = {(r.g, r.k): r.x for r in apportion(df, ["g"], "a", "w", "k", "x").collect()}
    assert {k: v[0] for k, v in small.items()} == large
    for g, a in ((1, 100), (2, -101), (3, 7), (4, 0), (5, 0)):
        assert (sum(v[0] for k, v in small.items() if k[0] == g), sum(v[1] for k, v in small.items() if k[0] == g)) == (a, 2 * a)


def test_newly_visible_is_strict(spark):
    rows = lambda *pairs: spark.createDataFrame(pairs, "activity_id string, feature_json string")
    assert [r.activity_id for r in compare.newly_visible(rows(("a", "1")), rows(("a", "1"), ("b", "2"))).collect()] == ["b"]
    for now in (rows(("a", "9"), ("b", "2")), rows(("b", "2"))):
        with pytest.raises(ValueError, match="1 rows"):
            compare.newly_visible(rows(("a", "1")), now)


def test_append_conflicts_on_provenance(spark):
    columns = "activity_id string, ts string, customer string, anonymous_customer_id string, activity string, feature_json string, revenue_impact decimal(18,2), link string, _recorded_at string, _source string, _actor string, _lane string, _schema_hash string"
    row = lambda name, at, source, lane: (name, "2024-01-01", "c", None, "x", "{}", None, None, at, source, "me", lane, "h")
    stored, _ = append_batch(None, spark.createDataFrame([row("a", "1", "s", "dev"), row("b", "1", "s", "sim"), row("c", "1", "s", "dev")], columns))
    fresh, clash = append_batch(stored, spark.createDataFrame([row("a", "2", "s", "dev"), row("b", "2", "s", "sim"), row("c", "1", "t", "dev")], columns))
    assert fresh.count() == 0 and {r.activity_id for r in clash.collect()} == {"b", "c"}
