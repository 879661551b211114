"""Metric families. Money in cents as long, ratios as double; a ratio without a base is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.context import Context


def over(top: Column, base: Column) -> Column:
    """A ratio in double precision, null where the base is zero."""
    return top.cast("double") / F.nullif(base.cast("double"), F.lit(0.0))


def net_rev_per_mtok(tokens: DataFrame, cuts: list[str] | None = None) -> DataFrame:
    """Revenue per million tokens, net of discounts and with or without channel fees."""
    net, fee, n = F.sum("net_revenue_cents"), F.sum("channel_fee_cents"), F.sum("tokens")
    return tokens.groupBy("month", *(cuts or [])).agg(
        n.alias("tokens"), net.alias("net_revenue_cents"), fee.alias("channel_fee_cents"), (net + fee).alias("revenue_before_channel_fees_cents"),
        over(net * F.lit(10000.0), n).alias("net_of_discounts_and_fees_per_mtok"), over((net + fee) * F.lit(10000.0), n).alias("net_of_discounts_per_mtok"),
    )


def cost_per_mtok(tokens: DataFrame, cuts: list[str] | None = None) -> DataFrame:
    """Allocated inference cost per million tokens and the gross margin on it."""
    net, cost, n = F.sum("net_revenue_cents"), F.sum("allocated_cost_cents"), F.sum("tokens")
    return tokens.groupBy("month", *(cuts or [])).agg(
        n.alias("tokens"), cost.alias("allocated_inference_cost_cents"), net.alias("net_revenue_cents"),
        over(cost * F.lit(10000.0), n).alias("cost_per_mtok"), (1 - over(cost, net)).alias("inference_gross_margin"),
    )


def rev_per_mw(revenue: DataFrame, compute: DataFrame, ctx: Context) -> DataFrame:
    """Revenue of the last twelve months per contracted and per used megawatt, by purpose."""
    start = F.add_months(F.lit(ctx.period_end), -12)
    money = revenue.filter(F.col("month") >= start).agg(F.coalesce(F.sum("revenue_cents"), F.lit(0)).alias("revenue_cents"))
    power = compute.filter(F.col("month") >= start).groupBy("purpose").agg(*[F.sum(c).alias(c) for c in ("contracted_mwh_capacity", "energized_mwh_capacity", "consumed_mwh", "cost_cents")])
    hours = F.datediff(F.lit(ctx.period_end), start) * 24
    complete = F.lit(ctx.first_month) <= start
    shown = (F.col("purpose") == "inference") & complete
    c, d = F.col, lambda n: F.col(n).cast("double")
    return power.crossJoin(F.broadcast(money)).select(
        F.lit(ctx.asof).alias("month"), "purpose", F.when(complete, "defined").otherwise("insufficient_history").alias("status"),
        F.when(shown, c("revenue_cents")).alias("t12m_net_revenue_cents"), "cost_cents",
        (d("contracted_mwh_capacity") / hours).alias("average_contracted_mw"), (d("energized_mwh_capacity") / hours).alias("average_energized_mw"), (d("consumed_mwh") / hours).alias("utilized_mw"),
        over(c("consumed_mwh"), c("energized_mwh_capacity")).alias("energized_utilization"),
        F.when(shown, over(c("revenue_cents") * hours / F.lit(100.0), c("contracted_mwh_capacity"))).alias("revenue_per_contracted_mw"),
        F.when(shown, over(c("revenue_cents") * hours / F.lit(100.0), c("consumed_mwh"))).alias("revenue_per_utilized_mw"),
    )


def nrr_members(parents: DataFrame, identity: DataFrame, lenses: DataFrame, ctx: Context) -> DataFrame:
    """Every parent under every lens: revenue of the base and current windows and whether it counts.

    Parents without revenue are rows of no month, so one sum by parent and lens gives all of them and nothing is joined.
    """
    base_end = F.add_months(F.lit(ctx.period_end), -12)
    month, n = F.col("month"), F.col("months")
    money = F.col("consumption_cents") + F.when(F.col("include_subscription"), F.col("subscription_cents")).otherwise(0)
    in_base = (month >= F.add_months(base_end, -n)) & (month < base_end)
    in_now = month >= F.add_months(F.lit(ctx.period_end), -n)
    known = parents.filter(month >= F.add_months(F.lit(ctx.period_end), -24)).select("ultimate_parent", "month", "consumption_cents", "subscription_cents")
    rows = known.unionByName(identity.select("ultimate_parent"), allowMissingColumns=True).crossJoin(F.broadcast(lenses))
    sums = rows.groupBy("lens", "ultimate_parent").agg(
        F.sum(F.when(in_base, money).otherwise(0)).cast("long").alias("base_cents"), F.sum(F.when(in_now, money).otherwise(0)).cast("long").alias("current_cents"),
        F.max("annualization").alias("annualization"), F.max("floor_cents").alias("floor_cents"),
    )
    return sums.select("lens", "ultimate_parent", "base_cents", "current_cents", (F.col("base_cents") * F.col("annualization") >= F.col("floor_cents")).alias("in_cohort"))


def consumption_nrr(members: DataFrame, lenses: DataFrame, ctx: Context) -> DataFrame:
    """Net revenue retention of each lens; without history or base all ratios are null."""
    base, now, inside = F.col("base_cents"), F.col("current_cents"), F.col("in_cohort")
    total = lambda x: F.coalesce(F.sum(F.when(inside, x)), F.lit(0)).cast("long")
    sums = members.groupBy("lens").agg(
        F.count(F.when(inside, 1)).alias("cohort_customers"), F.sum(base).alias("all_base_cents"), total(base).alias("base_revenue_cents"), total(now).alias("current_revenue_cents"),
        total(F.greatest(now - base, F.lit(0))).alias("expansion_cents"), total(F.when(now != 0, F.greatest(base - now, F.lit(0))).otherwise(0)).alias("contraction_cents"),
        total(F.when(now == 0, base).otherwise(0)).alias("churn_cents"),
    )
    counts = ["cohort_customers", "all_base_cents", "base_revenue_cents", "current_revenue_cents", "expansion_cents", "contraction_cents", "churn_cents"]
    rows = lenses.join(sums, "lens", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in counts})
    early = F.lit(ctx.first_month) > F.add_months(F.add_months(F.lit(ctx.period_end), -12), -F.col("months"))
    rows = rows.withColumn("status", F.when(early, "insufficient_history").when(F.col("base_revenue_cents") == 0, "undefined_zero_base").otherwise("defined"))
    ratio = lambda top, bottom: F.when(F.col("status") == "defined", over(F.col(top), F.col(bottom)))
    parts = {"nrr": "current_revenue_cents", "expansion_share": "expansion_cents", "contraction_share": "contraction_cents", "churn_share": "churn_cents"}
    return rows.select(F.lit(ctx.asof).alias("month"), "lens", "status", *counts, *[ratio(t, "base_revenue_cents").alias(n) for n, t in parts.items()], ratio("base_revenue_cents", "all_base_cents").alias("cohort_revenue_coverage"))


def consumption_nrr_v1(members: DataFrame, lenses: DataFrame, ctx: Context) -> DataFrame:
    """The first version: a ratio is null where its own base is zero, and retention also where the window has no history."""
    rows, known = consumption_nrr(members, lenses, ctx), F.col("status") != "insufficient_history"
    share = lambda top, bottom="base_revenue_cents": over(F.col(top), F.col(bottom))
    return rows.withColumns({
        "nrr": F.when(known, share("current_revenue_cents")), "expansion_share": share("expansion_cents"), "contraction_share": share("contraction_cents"),
        "churn_share": share("churn_cents"), "cohort_revenue_coverage": share("base_revenue_cents", "all_base_cents"),
    })


def model_vintage(tokens: DataFrame, revenue: DataFrame, models: DataFrame, cuts: list[str] | None = None) -> DataFrame:
    """Revenue by model and months since its release, and the share of models released in the last twelve months."""
    cuts = cuts or []
    columns = ["month", "model", "generation", "release_date", "channel", "workload"]
    used = tokens.select(*columns, F.col("net_revenue_cents").alias("revenue_cents"))
    other = revenue.filter("family <> 'consumption'").join(F.broadcast(models.select("model", "generation", "release_date")), "model", "left").select(*columns, "revenue_cents")
    rows = used.unionByName(other).groupBy("month", "model", "generation", "release_date", *cuts).agg(F.sum("revenue_cents").alias("revenue_cents"))
    every = Window.partitionBy("month", *cuts)
    fresh = F.col("release_date") >= F.add_months("month", -11)
    since = (F.year("month") - F.year("release_date")) * 12 + F.month("month") - F.month("release_date")
    total = F.sum("revenue_cents").over(every)
    return rows.select(
        "month", "model", "generation", since.cast("long").alias("months_since_release"), *cuts, "revenue_cents", over(F.col("revenue_cents"), total).alias("revenue_share"),
        over(F.sum(F.when(fresh, F.col("revenue_cents")).otherwise(0)).over(every), total).alias("released_last_12_months_share"),
    )


def subscriptions(seats: DataFrame, trials: DataFrame) -> DataFrame:
    """Seats, churn, revenue per seat and account, and trial conversion by month and plan."""
    c = F.col
    some = lambda cond: F.count_distinct(F.when(cond, c("customer")))
    per_day = lambda m: F.sum(m).cast("double") / F.max("days")
    held = seats.groupBy("month", "plan").agg(
        F.sum("beginning_seats").alias("beginning_seats"), F.sum("ending_seats").alias("paid_seats"), F.sum("gross_adds").alias("gross_adds"), F.sum("cancelled_seats").alias("cancelled_seats"),
        F.sum("seat_removals").alias("seat_removals"), F.sum(c("transfer_in") - c("transfer_out")).alias("plan_transfers_net"), F.sum(c("ending_seats") - c("beginning_seats")).alias("net_adds"),
        per_day("seat_days").alias("daily_weighted_paid_seats"), per_day("account_days").alias("daily_weighted_paid_accounts"),
        some(c("beginning_seats") > 0).alias("beginning_paid_accounts"), some(c("ending_seats") > 0).alias("paid_accounts"), some(c("upgraded_account") > 0).alias("upgraded_accounts"),
        some(c("downgraded_account") > 0).alias("downgraded_accounts"), some((c("ending_seats") > c("beginning_seats")) & (c("beginning_seats") > 0)).alias("expanded_accounts"), F.sum("revenue_cents").alias("revenue_cents"),
    )
    rows = held.join(trials, ["month", "plan"], "full")
    rows = rows.select("month", "plan", *[F.coalesce(c(x), F.lit(0)).cast(rows.schema[x].dataType).alias(x) for x in rows.columns if x not in ("month", "plan")])
    lost = c("cancelled_seats") + c("seat_removals")
    churn = over(lost, c("beginning_seats"))
    rows = rows.withColumn("gross_churn_monthly", churn)
    return rows.withColumns({
        "gross_churn_annualized": F.when(c("gross_churn_monthly").between(0, 1), 1 - F.pow(1 - c("gross_churn_monthly"), F.lit(12))),
        "gross_churn_daily_exposure_lens": over(lost, c("daily_weighted_paid_seats")), "arpu": over(c("revenue_cents") / F.lit(100.0), c("daily_weighted_paid_seats")),
        "arpa": over(c("revenue_cents") / F.lit(100.0), c("daily_weighted_paid_accounts")), "upgrade_rate": over(c("upgraded_accounts"), c("beginning_paid_accounts")),
        "downgrade_rate": over(c("downgraded_accounts"), c("beginning_paid_accounts")), "seat_expansion_account_rate": over(c("expanded_accounts"), c("beginning_paid_accounts")),
        "trial_conversion_resolved_cohort_rate": over(c("trial_cohort_converted"), c("trial_cohort_resolved")), "trial_cohort_pending": c("trials_started") - c("trial_cohort_resolved"),
    })


def cohort_revenue(parents: DataFrame, months: DataFrame, ctx: Context) -> DataFrame:
    """Revenue of each parent in the twelve months up to each quarter's end.

    Each month's revenue is sent to the four quarter ends whose window holds it, so nothing is compared across.
    """
    quarters = months.filter(F.month("month").isin(3, 6, 9, 12) & (F.add_months("month_end", -12) >= F.lit(ctx.first_month))).select(F.col("month").alias("quarter"), F.date_sub("month_end", 1).alias("quarter_end"))
    to_quarter = F.add_months("month", F.pmod(-F.month("month"), F.lit(3)))
    held = parents.withColumn("quarter", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.add_months(to_quarter, k * 3))))
    return held.join(F.broadcast(quarters), "quarter").filter(F.col("month") > F.add_months("quarter", -12)).groupBy("quarter_end", "ultimate_parent").agg(F.sum("net_revenue_cents").alias("revenue_cents"))


def customer_cohorts(revenue: DataFrame, months: DataFrame, thresholds: DataFrame, ctx: Context) -> DataFrame:
    """Customers and revenue above each threshold at each quarter's end."""
    quarters = months.filter(F.month("month").isin(3, 6, 9, 12) & (F.add_months("month_end", -12) >= F.lit(ctx.first_month))).select(F.date_sub("month_end", 1).alias("quarter_end"))
    money, above = F.col("revenue_cents"), F.col("revenue_cents") > F.col("threshold_cents")
    sums = revenue.crossJoin(F.broadcast(thresholds)).groupBy("quarter_end", "threshold_cents").agg(
        F.count(F.when(above, 1)).alias("customers"), F.coalesce(F.sum(F.when(above, money)), F.lit(0)).alias("cohort_revenue_cents"), F.coalesce(F.sum(money), F.lit(0)).alias("total_revenue_cents")
    )
    grid = quarters.crossJoin(thresholds).join(sums, ["quarter_end", "threshold_cents"], "left")
    counts = ["customers", "cohort_revenue_cents", "total_revenue_cents"]
    grid = grid.select(F.col("quarter_end").alias("month"), "threshold_cents", *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in counts])
    return grid.withColumn("net_revenue_share", over(F.col("cohort_revenue_cents"), F.col("total_revenue_cents")))


def cohort_members(revenue: DataFrame, thresholds: DataFrame) -> DataFrame:
    rows = revenue.crossJoin(F.broadcast(thresholds)).filter("revenue_cents > threshold_cents")
    return rows.select(F.col("quarter_end").alias("month"), "ultimate_parent", "revenue_cents", "threshold_cents")


def yield_summary(metric: DataFrame, month: Column) -> DataFrame:
    """Revenue per million tokens of one month from its parts: weighted by tokens, never averaged; twelve decimals, half up."""
    rows = metric.filter(F.col("month") == month)
    per = lambda top: F.round(F.sum(top).cast("decimal(30,12)") * 10000 / F.nullif(F.sum("tokens"), F.lit(0)).cast("decimal(20,0)"), 12)
    return rows.agg(F.sum("tokens").alias("tokens"), F.sum("net_revenue_cents").alias("net_revenue_cents"), F.sum("channel_fee_cents").alias("channel_fee_cents"), per("net_revenue_cents").cast("double").alias("after_fees_per_mtok"), per("revenue_before_channel_fees_cents").cast("double").alias("before_fees_per_mtok"))


def nrr_sensitivity(nrr: DataFrame, headline: str = "base_t12m") -> DataFrame:
    """Each lens against the headline lens in percentage points; null if either is undefined."""
    top = nrr.filter(F.col("lens") == headline).select(F.col("nrr").alias("headline_nrr"))
    return nrr.crossJoin(F.broadcast(top)).select("month", "lens", "nrr", "headline_nrr", ((F.col("nrr") - F.col("headline_nrr")) * 100).alias("difference_pp"))
