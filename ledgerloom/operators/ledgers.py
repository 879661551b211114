"""Revenue, compute, token and seat ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import apportion, apportion_small
from ledgerloom.plans.context import Context, months_between, typed
from ledgerloom.plans.lineage import cut

POWER = "decimal(38,9)"


def usage(snap: DataFrame) -> DataFrame:
    fields = {"usage_batch_id": "string", "model": "string", "token_type": "string", "channel": "string", "workload": "string", "tokens": "long", "effective_price_per_mtok": "double"}
    found = typed(snap, ["tokens_processed"], fields)
    rated = F.greatest(F.lit(0), F.round(F.col("tokens").cast("double") * F.col("effective_price_per_mtok") / 10000).cast("long"))
    return found.withColumns({"month": F.trunc(F.col("ts").cast("date"), "month"), "rated_cents": rated})


def revenue_ledger(recognized: DataFrame, policy: DataFrame, identity: DataFrame, invoiced: DataFrame, credited: DataFrame, used: DataFrame) -> DataFrame:
    """Recognised lines with family, segment, parent and the model and workload of the usage behind them.

    The invoice a line belongs to is worked out first, as a key column, so every join is an equality join.
    """
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise("unallocated").alias(c)
    batches = used.groupBy("_source", "usage_batch_id").agg(one("model"), one("workload"))
    bills = invoiced.select("_source", "invoice_id", "usage_batch_id").join(batches, ["_source", "usage_batch_id"], "left")
    origin = credited.select("_source", F.col("credit_id").alias("source_document"), F.lit("credit").alias("recognition_kind"), F.col("invoice_id").alias("credited_invoice"))
    rows = recognized.join(F.broadcast(policy), ["source", "recognition_kind"]).join(identity.select("customer", "segment", "ultimate_parent"), "customer")
    rows = rows.join(origin, ["_source", "source_document", "recognition_kind"], "left")
    invoice = F.when(F.col("recognition_kind") == "credit", F.col("credited_invoice")).when(F.col("recognition_kind") == "usage", F.col("source_document"))
    rows = rows.withColumn("invoice_id", invoice).join(bills, ["_source", "invoice_id"], "left")
    return rows.select(
        "activity_id", "_source", "customer", "month", "source", "recognition_kind", "source_document", "channel", "revenue_cents", "family", "segment", "ultimate_parent", "usage_batch_id",
        F.coalesce("model", F.lit("unallocated")).alias("model"), F.coalesce("workload", F.lit("unallocated")).alias("workload"),
    )


def compute_ledger(snap: DataFrame, ctx: Context) -> DataFrame:
    """Contracted and energised capacity by contract and month, and metered consumption with its cost."""
    site = {"capacity_id": "string", "provider": "string", "region": "string"}
    deals = typed(snap, ["capacity_contracted"], site | {"purpose": "string", "mw": "decimal(24,9)", "usd_per_mwh": "decimal(18,2)", "start": "date", "end": "date"})
    steps = typed(snap, ["capacity_energized"], {"capacity_id": "string", "mw": "decimal(24,9)"})
    stop = F.lit(ctx.period_end).cast("timestamp")
    following = F.lead("ts").over(Window.partitionBy("_source", "capacity_id").orderBy("ts", "activity_id"))
    steps = steps.withColumn("next_ts", F.coalesce(following, stop))
    months = deals.withColumn("month", F.explode(months_between(F.col("start"), F.col("end"), ctx))).withColumn("month_end", F.add_months("month", 1))
    terms = months.select("_source", "capacity_id", "month", "month_end", F.col("start").alias("first"), F.col("end").alias("stop"))
    # Each step is spread over the months it touches itself, so a step meets a contract's month only if both touch it.
    touched = months_between(F.col("ts").cast("date"), F.date_add(F.col("next_ts").cast("date"), 1), ctx)
    pieces = steps.select("_source", "capacity_id", "ts", "next_ts", F.col("mw").alias("step_mw"), F.explode(touched).alias("month")).join(terms, ["_source", "capacity_id", "month"])
    seconds = F.greatest(
        F.lit(0), F.unix_timestamp(F.least("next_ts", F.col("month_end").cast("timestamp"), F.col("stop").cast("timestamp"))) - F.unix_timestamp(F.greatest("ts", F.col("month").cast("timestamp"), F.col("first").cast("timestamp")))
    )
    on = pieces.groupBy("_source", "capacity_id", "month").agg((F.sum(F.col("step_mw").cast("decimal(24,9)") * seconds.cast("decimal(12,0)")).cast(POWER) / 3600).cast(POWER).alias("energized_mwh_capacity"))
    hours = (F.greatest(F.lit(0), F.datediff(F.least("end", "month_end"), F.greatest("start", "month"))) * 24).cast("decimal(10,0)")
    capacity = months.join(on, ["_source", "capacity_id", "month"], "left").select(
        F.lit("capacity").alias("row_kind"), "activity_id", "_source", "capacity_id", "month", "provider", "region", "purpose", F.lit(None).cast("string").alias("model"),
        (F.col("mw") * hours).cast(POWER).alias("contracted_mwh_capacity"), F.coalesce("energized_mwh_capacity", F.lit(0)).cast(POWER).alias("energized_mwh_capacity"),
        F.lit(0).cast(POWER).alias("consumed_mwh"), F.lit(0).cast("long").alias("cost_cents"),
    )
    meters = typed(snap, ["capacity_consumed"], site | {"purpose": "string", "model": "string", "mwh": "decimal(28,9)", "period_start": "date"})
    rates = deals.select("_source", *site, "purpose", "usd_per_mwh", "start", "end", F.col("ts").alias("signed_at"))
    day = F.col("ts").cast("date")
    consumed = meters.join(rates, ["_source", *site, "purpose"]).filter((F.col("signed_at") <= F.col("ts")) & (F.col("start") <= day) & (F.col("end") > day))
    cost = F.round(F.col("mwh").cast("decimal(24,9)") * F.col("usd_per_mwh").cast("decimal(12,2)") * 100).cast("long")
    return capacity.unionByName(consumed.select(
        F.lit("consumption").alias("row_kind"), "activity_id", "_source", "capacity_id", F.trunc("period_start", "month").alias("month"), "provider", "region", "purpose", "model",
        F.lit(0).cast(POWER).alias("contracted_mwh_capacity"), F.lit(0).cast(POWER).alias("energized_mwh_capacity"), F.col("mwh").cast(POWER).alias("consumed_mwh"), cost.alias("cost_cents"),
    ))


#: Rows of one usage batch that a task may order; larger batches take the way for groups of any size.
BATCH_ROWS = 200_000
TOKEN_COLUMNS = [
    "activity_id", "_source", "customer", "ts", "month", "model", "generation", "release_date", "token_type", "channel",
    "workload", "segment", "ultimate_parent", "usage_batch_id", "tokens", "effective_price_per_mtok",
]


def token_revenue(used: DataFrame, models: DataFrame, identity: DataFrame, invoiced: DataFrame, recognized: DataFrame, amounts: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """One row per token event with its share of the invoice's revenue and fee of the month, by rated cents (by tokens if all are zero)."""
    batch = ["usage_batch_id", "_source", "month"]  # the most telling first: sorts compare their first column's first bytes
    bills = invoiced.select("_source", "usage_batch_id", "invoice_id", F.col("activity_id").alias("invoice_activity"))
    earned = recognized.filter("recognition_kind = 'usage'").select(
        "_source", F.col("source_document").alias("invoice_id"), "month", F.col("revenue_cents").alias("revenue"), F.lit(0).cast("long").alias("fee")
    )
    fees = amounts.select("_source", "invoice_id", "month", F.lit(0).cast("long").alias("revenue"), F.col("fee"))
    money = earned.unionByName(fees).groupBy("_source", "invoice_id", "month").agg(F.sum("revenue").alias("invoice_revenue_cents"), F.sum("fee").alias("invoice_fee_cents"))
    money = money.join(bills, ["_source", "invoice_id"]).select(*batch, "invoice_revenue_cents", "invoice_fee_cents")
    rated = used.groupBy(*batch).agg((F.sum("rated_cents") > 0).alias("any_rated"), F.count(F.lit(1)).alias("batch_rows"))
    # Customers meet their identity as pairs with a batch, so the wide rows of usage move once, by batch, for joins and shares.
    people = used.select(*batch, "customer").distinct().join(identity.select("customer", "segment", "ultimate_parent"), "customer")
    rows = used.join(F.broadcast(models), "model").filter("ts >= released_at").repartition(*batch).join(people.repartition(*batch), [*batch, "customer"])
    rows = rows.join(money, batch, "left")
    zeros = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("invoice_revenue_cents", "invoice_fee_cents")}
    rows = rows.join(rated, batch).withColumns(zeros | {"revenue_weight": F.when(F.col("any_rated"), F.col("rated_cents")).otherwise(F.col("tokens"))})
    shares = {"invoice_revenue_cents": "net_revenue_cents", "invoice_fee_cents": "channel_fee_cents"}
    columns = [*TOKEN_COLUMNS, *shares.values()]
    if rated.filter(F.col("batch_rows") > batch_rows).isEmpty():
        return apportion_small(rows, batch, shares, "revenue_weight", "activity_id").select(*columns)
    small = apportion_small(rows.filter(F.col("batch_rows") <= batch_rows), batch, shares, "revenue_weight", "activity_id")
    large = cut(rows.filter(F.col("batch_rows") > batch_rows), "large-batches")
    for amount, out in shares.items():
        large = apportion(large, batch, amount, "revenue_weight", "activity_id", out)
    return small.select(*columns).unionByName(large.select(*columns))


def token_ledger(priced: DataFrame, weights: DataFrame, compute: DataFrame) -> DataFrame:
    """Token events with revenue and fee, and their share of the model's inference cost of the month, by energy."""
    pool = ["month", "model"]
    cost = compute.filter("row_kind = 'consumption' AND purpose = 'inference'").groupBy(*pool).agg(F.sum("cost_cents").alias("model_cost_cents"))
    rows = priced.join(F.broadcast(weights), ["model", "token_type"]).join(F.broadcast(cost), pool, "left")
    rows = rows.withColumns({
        "model_cost_cents": F.coalesce("model_cost_cents", F.lit(0)).cast("long"),
        "energy_weight": F.col("tokens").cast("decimal(19,0)") * F.col("coefficient_nano").cast("decimal(19,0)"),
    })
    rows = apportion(rows, pool, "model_cost_cents", "energy_weight", "activity_id", "allocated_cost_cents")
    return rows.select(*TOKEN_COLUMNS, "energy_weight", "net_revenue_cents", "channel_fee_cents", "allocated_cost_cents")


def seat_ledger(events: DataFrame, ctx: Context, revenue: DataFrame) -> DataFrame:
    """Seats of each subscription, plan and month: balances, exposure, movements and its share of subscription revenue."""
    order = Window.partitionBy("_source", "customer", "subscription_id").orderBy("ts", "priority", "activity_id")
    end, day = F.lit(ctx.period_end), F.col("ts").cast("date")
    states = events.withColumns({
        "seats": F.col("paid_seats"), "effective_day": day,
        "next_day": F.least(F.coalesce(F.lead(day).over(order), end), F.last("period_end", ignorenulls=True).over(order)),
        "previous_seats": F.coalesce(F.lag("paid_seats").over(order), F.lit(0)), "previous_plan": F.coalesce(F.lag("plan").over(order), F.col("plan")),
        "price": F.last("price_cents", ignorenulls=True).over(order),
    })
    key = ["_source", "customer", "subscription_id", "plan", "month"]
    # A state is looked at in each month it touches, its last day's month included: balances there are zero but exist.
    touched = states.withColumn("month", F.explode(months_between(F.col("effective_day"), F.date_add("next_day", 1), ctx))).withColumn("month_end", F.add_months("month", 1))
    inside = (F.col("effective_day") < F.col("month_end")) & (F.col("next_day") > F.col("month"))
    days = F.when(inside, F.datediff(F.least("next_day", "month_end"), F.greatest("effective_day", "month"))).otherwise(0)
    held = touched.filter(F.col("next_day") >= F.col("month")).groupBy(*key).agg(
        F.sum(F.when((F.col("effective_day") < F.col("month")) & (F.col("next_day") >= F.col("month")), F.col("seats")).otherwise(0)).alias("beginning_seats"),
        F.sum(F.when(F.col("next_day") >= F.col("month_end"), F.col("seats")).otherwise(0)).alias("ending_seats"),
        F.sum(F.col("seats") * days).alias("seat_days"), F.sum(F.when(F.col("seats") > 0, days).otherwise(0)).alias("account_days"),
        F.sum((F.col("seats") * F.coalesce("price", F.lit(0)) * days).cast("decimal(19,0)")).alias("exposure"),
    )
    cancelled, changed = F.col("activity") == "subscription_cancelled", F.col("plan") != F.col("previous_plan")
    zero = F.lit(0).cast("long")
    measures = ["gross_adds", "seat_removals", "cancelled_seats", "transfer_in", "transfer_out", "upgraded_account", "downgraded_account"]
    month = F.trunc(day, "month").alias("month")
    arrivals = states.select("_source", "customer", "subscription_id", "plan", month, *[x.cast("long").alias(m) for m, x in zip(measures, [
        F.greatest(F.col("seats") - F.col("previous_seats"), zero), F.when(cancelled, 0).otherwise(F.greatest(F.col("previous_seats") - F.col("seats"), zero)),
        F.when(cancelled, F.col("previous_seats")).otherwise(0), F.when(changed, F.col("previous_seats")).otherwise(0), zero, zero, zero], strict=True)])
    up, down = F.col("activity") == "subscription_upgraded", F.col("activity") == "subscription_downgraded"
    leaving = states.filter(changed | up | down).select("_source", "customer", "subscription_id", F.col("previous_plan").alias("plan"), month, *[x.cast("long").alias(m) for m, x in zip(measures, [
        zero, zero, zero, zero, F.when(changed, F.col("previous_seats")).otherwise(0), F.when(up, 1).otherwise(0), F.when(down, 1).otherwise(0)], strict=True)])
    how = {m: F.max if m.endswith("account") else F.sum for m in measures}
    flows = arrivals.unionByName(leaving).groupBy(*key).agg(*[how[m](m).alias(m) for m in measures])
    earned = revenue.filter("family = 'subscription'").groupBy("_source", "customer", F.col("source_document").alias("subscription_id"), "month").agg(F.sum("revenue_cents").alias("subscription_revenue_cents"))
    rows = held.join(flows, key, "full").join(earned, ["_source", "customer", "subscription_id", "month"], "left")
    rows = rows.filter((F.col("month") >= F.lit(ctx.first_month)) & (F.col("month") < end))
    counted = ["beginning_seats", "ending_seats", "seat_days", "account_days", *measures, "subscription_revenue_cents", "exposure"]
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in counted} | {"days": F.datediff(F.add_months("month", 1), "month").cast("long")})
    rows = apportion_small(rows, ["_source", "customer", "subscription_id", "month"], {"subscription_revenue_cents": "revenue_cents"}, "exposure", "plan")
    return rows.select(*key, "days", *counted[:4], *measures, "revenue_cents")


def trial_cohorts(snap: DataFrame) -> DataFrame:
    """Trials by start month and plan, with how many converted and how many are resolved."""
    ends = typed(snap, ["trial_converted", "trial_expired"], {"trial_id": "string"}).groupBy("_source", "trial_id").agg(F.max(F.when(F.col("activity") == "trial_converted", 1).otherwise(0)).alias("converted"))
    starts = typed(snap, ["trial_started"], {"trial_id": "string", "plan": "string"}).join(ends, ["_source", "trial_id"], "left")
    return starts.groupBy(F.trunc(F.col("ts").cast("date"), "month").alias("month"), "plan").agg(
        F.count(F.lit(1)).alias("trials_started"), F.coalesce(F.sum("converted"), F.lit(0)).cast("long").alias("trial_cohort_converted"), F.count("converted").alias("trial_cohort_resolved")
    )
