"""Data controls: each returns rows of (reason, failures), one per named check; a report is held while any is not zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.entities import parent_edges
from ledgerloom.plans.books import Books
from ledgerloom.plans.context import typed
from ledgerloom.plans.lineage import parts


def count_of(reason: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(reason).alias("reason"), "failures")


def repeats(reason: str, rows: DataFrame, *key: str) -> DataFrame:
    """Rows beyond the first of each key: counts are combined before the shuffle."""
    extra = rows.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("n"))
    return extra.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failures")).select(F.lit(reason).alias("reason"), "failures")


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def accounting_errors(b: Books) -> DataFrame:
    late = F.col("last_service") > F.col("ts").cast("date")
    broken = (
        (F.col("period_end") <= F.col("period_start")) | (F.col("net_cents") < 0) | (F.col("fee_cents") < 0) | (F.col("fee_cents") > F.col("net_cents"))
        | (F.col("gross_cents") - F.col("discount_cents") != F.col("net_cents")) | (F.col("contract_id").isNotNull() & F.col("contract_activity").isNull())
        | (F.col("period_start") < F.col("contract_start")) | (F.col("period_end") > F.col("contract_end")) | ((F.col("draw_cents") > 0) & (F.col("fee_cents") != 0))
    )
    return together(
        repeats("duplicate_invoice", b.invoices, "_source", "invoice_id"), repeats("duplicate_contract", b.contracts, "_source", "contract_id"),
        repeats("duplicate_credit", b.credits, "_source", "credit_id"), repeats("duplicate_expiry", b.expiries, "_source", "contract_id"),
        count_of("invalid_invoice", b.funding.filter(broken)), count_of("orphan_credit", b.credit_amounts.filter("invoice_activity IS NULL")),
        count_of("invalid_expiry", b.expiry_amounts.filter(F.col("contract_activity").isNull() | late)),
        count_of("nonmonthly_subscription", b.subscription_events.filter("coalesce(billing_period, 'monthly') <> 'monthly'")),
    )


def core_errors(b: Books) -> DataFrame:
    created = b.snap.filter("activity = 'customer_created'")
    edges = parent_edges(b.snap)
    financial = b.snap.filter(F.col("activity").isin("usage_invoiced", "tokens_processed", "contract_signed", "contract_renewed", "subscription_started")).select("customer")
    batches = b.invoices.groupBy("_source", "usage_batch_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    order = Window.partitionBy("_source", "customer", "subscription_id").orderBy("ts", "priority", "activity_id")
    first = b.subscription_events.withColumn("k", F.row_number().over(order)).filter("k = 1 AND activity <> 'subscription_started'")
    # Overlapping paid subscriptions of one customer by a sweep: a later start before the latest end so far.
    paid = b.subscription_states.filter("paid_seats > 0 AND start_day < stop_day").groupBy("_source", "customer", "subscription_id").agg(F.min("start_day").alias("lo"), F.max("stop_day").alias("hi"))
    before = Window.partitionBy("_source", "customer").orderBy("lo", "subscription_id").rowsBetween(Window.unboundedPreceding, -1)
    return together(
        repeats("unique_customer_creation", created, "customer"), count_of("parent_graph_resolves", created.select("customer").distinct().join(b.identity, "customer", "left_anti")),
        count_of("parents_exist", edges.filter("parent IS NOT NULL").select(F.col("parent").alias("customer")).join(created, "customer", "left_anti")),
        count_of("financial_customer_exists", financial.filter("customer IS NOT NULL").join(created, "customer", "left_anti")), count_of("one_invoice_per_batch", batches),
        count_of("paid_state_has_start", first), count_of("overlapping_subscriptions", paid.withColumn("seen", F.max("hi").over(before)).filter("lo < seen")),
    )


def compute_errors(b: Books) -> DataFrame:
    meters = b.snap.filter("activity = 'capacity_consumed'")
    matched = b.compute.filter("row_kind = 'consumption'")
    return together(count_of("meters_match_contracts", meters.join(matched, "activity_id", "left_anti")), repeats("unique_capacity_documents", typed(b.snap, ["capacity_contracted"], {"capacity_id": "string"}), "_source", "capacity_id"))


def token_population(used: DataFrame, allocated: DataFrame) -> DataFrame:
    """Token events that were allocated never or more than once: the identifiers of both sides meet once, without their rows."""
    side = lambda df, u, t: df.select("activity_id", F.lit(u).alias("u"), F.lit(t).alias("t"))
    ids = side(used, 1, 0).unionByName(side(allocated, 0, 1)).repartition(parts(used), "activity_id").groupBy("activity_id").agg(F.sum("u").alias("u"), F.sum("t").alias("t"))
    lost = F.when((F.col("t") == 0) | F.col("activity_id").isNull(), F.col("u"))
    sums = ids.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(name) for name, x in (("token_population_complete", lost), ("token_population_unique", F.when(F.col("t") > 1, F.col("t") - 1)))])
    return sums.unpivot([], ["token_population_complete", "token_population_unique"], "reason", "failures")


def token_errors(b: Books) -> DataFrame:
    batch = ["_source", "usage_batch_id", "month"]
    shared = b.allocated.groupBy(*batch).agg(F.sum("net_revenue_cents").alias("got"), F.sum("channel_fee_cents").alias("got_fee"))
    bills = b.invoices.select("_source", "usage_batch_id", "activity_id").join(b.invoice_amounts.select("activity_id", "month", (F.col("net") - F.col("fee")).alias("want"), F.col("fee").alias("want_fee")), "activity_id")
    off = bills.join(shared, batch, "full").filter("coalesce(want, 0) <> coalesce(got, 0) OR coalesce(want_fee, 0) <> coalesce(got_fee, 0)")
    cost = b.compute.filter("row_kind = 'consumption' AND purpose = 'inference'").groupBy("month", "model").agg(F.sum("cost_cents").alias("want"))
    spent = b.allocated.groupBy("month", "model").agg(F.sum("allocated_cost_cents").alias("got"))
    owners = b.usage.groupBy("_source", "usage_batch_id").agg(F.count_distinct("customer").alias("n")).filter("n > 1")
    return together(
        token_population(b.usage, b.allocated), count_of("token_revenue_reconciles", off),
        count_of("token_cost_reconciles", cost.join(spent, ["month", "model"], "full").filter("coalesce(want, 0) <> coalesce(got, 0)")), count_of("batch_has_one_customer", owners), repeats("unique_model", b.models, "model"),
    )


def seat_errors(b: Books) -> DataFrame:
    key = ["_source", "customer", "subscription_id", "month"]
    earned = b.revenue.filter("family = 'subscription'").groupBy("_source", "customer", F.col("source_document").alias("subscription_id"), "month").agg(F.sum("revenue_cents").alias("want"))
    shared = b.seats.groupBy(*key).agg(F.sum("revenue_cents").alias("got"), F.sum("seat_days").alias("seat_days"))
    both = earned.join(shared, key, "full")
    rolled = "ending_seats <> beginning_seats + gross_adds - cancelled_seats - seat_removals + transfer_in - transfer_out"
    return together(
        count_of("subscription_reconciles", both.filter("coalesce(want, 0) <> coalesce(got, 0)")), count_of("seat_rollforward", b.seats.filter(rolled)),
        count_of("revenue_has_exposure", both.filter("coalesce(want, 0) <> 0 AND coalesce(seat_days, 0) = 0")), repeats("unique_trials", typed(b.snap, ["trial_started"], {"trial_id": "string"}), "_source", "trial_id"),
    )


def journal_errors(b: Books) -> DataFrame:
    lines = b.journals.filter(F.col("month") < F.lit(b.ctx.period_end))
    open_months = b.journals.groupBy("month").agg(F.sum("amount_cents").alias("n")).filter("n <> 0")
    booked = lines.filter("account LIKE '4%'").groupBy("month").agg((-F.sum("amount_cents")).alias("booked"))
    earned = b.recognized.groupBy("month").agg(F.sum("revenue_cents").alias("earned"))
    return together(count_of("journals_balance", open_months), count_of("recognized_equals_revenue_accounts", earned.join(booked, "month", "full").filter("coalesce(earned, 0) <> coalesce(booked, 0)")))


def nrr_identity(nrr: DataFrame) -> DataFrame:
    return count_of("nrr_identity", nrr.filter("current_revenue_cents <> base_revenue_cents + expansion_cents - contraction_cents - churn_cents"))


def cohort_monotone(cohorts: DataFrame) -> DataFrame:
    order = Window.partitionBy("month").orderBy("threshold_cents")
    return count_of("cohort_monotone", cohorts.withColumn("before", F.lag("customers").over(order)).filter("customers > before"))


def all_errors(b: Books) -> DataFrame:
    return together(accounting_errors(b), core_errors(b), compute_errors(b), token_errors(b), seat_errors(b), journal_errors(b))


def require_clean(errors: DataFrame) -> None:
    """Raise, before anything is published, if a check failed."""
    failed = errors.filter("failures <> 0").collect()  # one row per named check at most
    if failed:
        raise ValueError("reporting evidence failed: " + ", ".join(f"{r.reason}={r.failures}" for r in failed))


def late_arrivals(act: DataFrame, start: Column, end: Column, known_at: Column) -> DataFrame:
    """Activities of a period that were recorded after its end, and whether the knowledge cutoff sees them."""
    rows = act.filter((F.col("ts") >= start) & (F.col("ts") < end) & (F.col("_recorded_at") >= end))
    return rows.select("activity_id", "activity", "ts", "_recorded_at", (F.col("_recorded_at") < known_at).alias("visible"))
