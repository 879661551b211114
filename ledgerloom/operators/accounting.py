"""Commit funding, straight-line recognition, subscriptions and double entry, in integer cents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import SAFE, WIDE, cents, month_share
from ledgerloom.plans.context import Context, months_between, typed
from ledgerloom.plans.lineage import parts

SUBSCRIPTION_EVENTS = ["subscription_started", "subscription_renewed", "subscription_upgraded", "subscription_downgraded", "subscription_cancelled", "seat_added", "seat_removed"]


def contracts(snap: DataFrame) -> DataFrame:
    found = typed(snap, ["contract_signed", "contract_renewed"], {"contract_id": "string", "commit_usd": "decimal(18,2)", "channel": "string", "start": "date", "end": "date", "term_months": "int"})
    return found.withColumn("commit_cents", cents("commit_usd")).drop("commit_usd")


def invoices(snap: DataFrame) -> DataFrame:
    money = ["gross", "discount", "net", "channel_fee"]
    found = typed(snap, ["usage_invoiced"], {"invoice_id": "string", "usage_batch_id": "string", "contract_id": "string", "period_start": "date", "period_end": "date", "channel": "string"} | {f"{m}_usd": "decimal(18,2)" for m in money})
    named = found.withColumns({f"{m.removeprefix('channel_')}_cents": cents(f"{m}_usd") for m in money})
    return named.drop(*[f"{m}_usd" for m in money])


def credits(snap: DataFrame) -> DataFrame:
    found = typed(snap, ["credit_issued"], {"credit_id": "string", "invoice_id": "string", "period": "date", "amount_usd": "decimal(18,2)"})
    return found.withColumn("amount", cents("amount_usd")).drop("amount_usd")


def expiries(snap: DataFrame) -> DataFrame:
    return typed(snap, ["contract_expired"], {"contract_id": "string"})


def subscription_events(snap: DataFrame) -> DataFrame:
    """Events with seats after each and the order of events of one moment: start 0, plan 10, seats 20, cancel 30."""
    found = typed(snap, SUBSCRIPTION_EVENTS, {"subscription_id": "string", "plan": "string", "seats": "long", "seats_after": "long", "price_per_seat": "decimal(18,2)", "period_end": "date", "billing_period": "string"})
    kind = F.col("activity")
    order = F.when(kind.isin("seat_added", "seat_removed"), 20).when(kind.isin("subscription_upgraded", "subscription_downgraded"), 10).when(kind == "subscription_cancelled", 30).otherwise(0)
    paid = F.when(kind == "subscription_cancelled", 0).otherwise(F.coalesce("seats_after", "seats"))
    return found.withColumns({"priority": order, "paid_seats": paid.cast("long"), "price_cents": cents("price_per_seat")})


def funding(invoiced: DataFrame, signed: DataFrame) -> DataFrame:
    """How much of each invoice the contract's commitment pays: what earlier invoices of the contract have left of it.

    Invoices without a contract draw nothing and are kept out of the window, where they would form one huge group.
    """
    before = Window.partitionBy("_source", "contract_id").orderBy("period_end", "activity_id").rowsBetween(Window.unboundedPreceding, -1)
    under = invoiced.filter("contract_id IS NOT NULL").repartition(parts(invoiced), "_source", "contract_id").withColumn("prior", F.coalesce(F.sum("net_cents").over(before), F.lit(0)))
    terms = signed.select("_source", "contract_id", F.col("activity_id").alias("contract_activity"), "commit_cents", F.col("start").alias("contract_start"), F.col("end").alias("contract_end"))
    under = under.join(terms, ["_source", "contract_id"], "left")
    free = invoiced.filter("contract_id IS NULL")
    drawn = F.least("net_cents", F.greatest(F.coalesce("commit_cents", F.lit(0)) - F.coalesce("prior", F.lit(0)), F.lit(0)))
    both = under.unionByName(free, allowMissingColumns=True)
    lineage = F.array_sort(F.array_compact(F.array("activity_id", "contract_activity")))
    return both.withColumns({"draw_cents": drawn.cast("long"), "upstream_ids": lineage}).drop("prior")


def invoice_months(funded: DataFrame, ctx: Context) -> DataFrame:
    """Each invoice's service months with the days from the period's start to the month's start and end."""
    rows = funded.withColumn("month", F.explode(months_between(F.col("period_start"), F.col("period_end"), ctx)))
    return rows.withColumns({
        "days": F.datediff("period_end", "period_start").cast("long"),
        "lo": F.datediff(F.greatest("period_start", "month"), "period_start").cast("long"),
        "hi": F.datediff(F.least("period_end", F.add_months("month", 1)), "period_start").cast("long"),
    })


def invoice_amounts(months: DataFrame) -> DataFrame:
    return months.withColumns({"net": month_share("net_cents"), "fee": month_share("fee_cents"), "draw": month_share("draw_cents")})


def expiry_amounts(expired: DataFrame, signed: DataFrame, funded: DataFrame, clamp: bool = False) -> DataFrame:
    """What is left of a commitment when its contract expires; ``clamp`` keeps it from going below zero."""
    spent = funded.filter("contract_id IS NOT NULL").groupBy("_source", "contract_id").agg(F.sum("draw_cents").alias("spent"), F.max("period_end").alias("last_service"))
    terms = signed.select("_source", "contract_id", "channel", F.col("activity_id").alias("contract_activity"), "commit_cents")
    left, n, key = F.col("commit_cents") - F.coalesce("spent", F.lit(0)), parts(funded), ["_source", "contract_id"]
    rows = expired.repartition(n, *key).join(terms.repartition(n, *key), key, "left").join(spent.repartition(n, *key), key, "left")
    return rows.withColumns({
        "month": F.trunc(F.col("ts").cast("date"), "month"), "amount": (F.greatest(left, F.lit(0)) if clamp else left).cast("long"),
        "upstream_ids": F.array_sort(F.array_compact(F.array("activity_id", "contract_activity"))),
    })


def credit_amounts(issued: DataFrame, invoiced: DataFrame) -> DataFrame:
    n, key = parts(invoiced), ["_source", "invoice_id"]
    bills = invoiced.select(*key, F.col("activity_id").alias("invoice_activity"), "channel").repartition(n, *key)
    rows = issued.repartition(n, *key).join(bills, key, "left")
    return rows.withColumn("upstream_ids", F.array_sort(F.array_compact(F.array("activity_id", "invoice_activity"))))


def subscription_states(events: DataFrame, ctx: Context) -> DataFrame:
    """Intervals of constant seats and price, up to the next event, the end of service or the reported period."""
    key = ["_source", "customer", "subscription_id"]
    order = Window.partitionBy(*key).orderBy("ts", "priority", "activity_id")
    end = F.lit(ctx.period_end)
    day = F.col("ts").cast("date")
    return events.repartition(parts(events), *key).withColumns({
        "start_day": day,
        "stop_day": F.least(F.coalesce(F.lead(day).over(order), end), F.coalesce(F.last("period_end", ignorenulls=True).over(order), end), end),
        "price_cents": F.coalesce(F.last("price_cents", ignorenulls=True).over(order), F.lit(0)).cast("long"),
    })


def subscription_months(states: DataFrame, ctx: Context, n: int | None = None) -> DataFrame:
    """Price times seats times days of each subscription and month.

    States are grouped by years, a row for each subscription and year, and only then spread over the year's months, so no
    aggregation holds a row for each month. They are dealt anew by years, into ``n``
    partitions for each year of the calendar if given: neither a small partition of states nor many rows are a large task.
    """
    key, january = ["_source", "customer", "subscription_id"], lambda year: F.make_date(year, F.lit(1), F.lit(1))
    start, stop = F.col("start_day"), F.col("stop_day")
    low, high = F.year(F.greatest(start, F.lit(ctx.first_month))), F.year(F.date_sub(F.least(stop, F.lit(ctx.period_end)), 1))
    state = F.struct("activity_id", "start_day", "stop_day", "price_cents", "paid_seats")
    years = states.withColumn("year", F.explode(F.when((start < stop) & (low <= high), F.sequence(low, high))))
    years = years.repartition(*([] if n is None else [n * (ctx.period_end.year - ctx.first_month.year + 1)]), *key, "year")
    years = years.groupBy(*key, "year").agg(F.collect_list(state).alias("held"), F.min("start_day").alias("first"), F.max("stop_day").alias("last"))
    touched = months_between(F.greatest("first", january(F.col("year"))), F.least("last", january(F.col("year") + 1)), ctx)
    rows = years.withColumn("month", F.explode(touched)).withColumn("month_end", F.add_months("month", 1))
    rows = rows.withColumn("held", F.filter("held", lambda s: (s["start_day"] < F.col("month_end")) & (s["stop_day"] > F.col("month")))).filter(F.size("held") > 0)

    def product(s: Column) -> Column:
        days = F.datediff(F.least(s["stop_day"], F.col("month_end")), F.greatest(s["start_day"], F.col("month")))
        small = s["price_cents"].between(0, SAFE) & s["paid_seats"].between(0, 10_000)
        wide = s["price_cents"].cast("decimal(20,0)") * s["paid_seats"].cast("decimal(12,0)") * days
        return F.when(small, (s["price_cents"] * s["paid_seats"] * days).cast(WIDE)).otherwise(wide.cast(WIDE))

    known = F.filter(F.transform("held", product), lambda x: x.isNotNull())
    total = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast(WIDE), lambda a, x: (a + x).cast(WIDE)))
    ids = F.array_sort(F.array_distinct(F.transform("held", lambda s: s["activity_id"])))
    return rows.select(*key, "month", total.alias("numerator"), F.datediff("month_end", "month").cast("long").alias("days"), ids.alias("upstream_ids"))


def subscription_amounts(months: DataFrame) -> DataFrame:
    """Amounts rounded half up: in longs where twice the numerator surely fits, else in 128 bits."""
    narrow = "(2L * abs(cast(numerator as bigint)) + days) div (2L * days) * cast(sign(numerator) as bigint)"
    wide = "cast(((2 * abs(numerator) + days) div (2 * days)) * sign(numerator) as bigint)"
    amount = F.expr(f"CASE WHEN numerator BETWEEN -{10**17} AND {10**17} THEN {narrow} ELSE {wide} END")
    return months.withColumns({"amount": amount, "activity_id": F.concat(F.lit("subscription:"), "subscription_id", F.lit(":"), F.col("month").cast("string"))})


def recognized(amounts: DataFrame, expired: DataFrame, credited: DataFrame, subscribed: DataFrame, ctx: Context) -> DataFrame:
    """Revenue lines of all kinds: not zero, and of months before the end of the reported period."""

    def lines(df: DataFrame, month: str, source: str, kind: str, document: str, channel, amount) -> DataFrame:
        return df.select(
            F.concat_ws(":", "activity_id", F.lit(source), F.lit(kind), F.col(month).cast("string")).alias("activity_id"), "_source", "customer", F.col(month).alias("month"),
            F.lit(source).alias("source"), F.lit(kind).alias("recognition_kind"), F.col(document).alias("source_document"), channel.alias("channel"), amount.cast("long").alias("revenue_cents"), "upstream_ids",
        )

    channel = F.col("channel")
    rows = lines(amounts, "month", "commit_drawdown", "usage", "invoice_id", channel, F.col("draw"))
    rows = rows.unionByName(lines(amounts, "month", "usage", "usage", "invoice_id", channel, F.col("net") - F.col("fee") - F.col("draw")))
    rows = rows.unionByName(lines(expired, "month", "commit_drawdown", "commit_expiry", "contract_id", channel, F.col("amount")))
    rows = rows.unionByName(lines(credited, "period", "usage", "credit", "credit_id", channel, -F.col("amount")))
    rows = rows.unionByName(lines(subscribed, "month", "subscription", "subscription", "subscription_id", F.lit("direct"), F.col("amount")))
    return rows.filter((F.col("revenue_cents") != 0) & (F.col("month") < F.lit(ctx.period_end)))


def recognized_from_stream(snap: DataFrame) -> DataFrame:
    """Revenue as asserted by recognition events themselves."""
    found = typed(snap, ["revenue_recognized"], {"period": "date", "net_usd": "decimal(18,2)", "source": "string", "recognition_kind": "string", "source_document": "string", "channel": "string"})
    return found.select("activity_id", "_source", "customer", F.trunc("period", "month").alias("month"), "source", "recognition_kind", "source_document", "channel", cents("net_usd").alias("revenue_cents"))


#: Ledger accounts.
RECEIVABLE, DEFERRED, USAGE, SUBSCRIPTION, EXPIRY, CREDITS, FEES = "1100", "2100", "4000", "4010", "4020", "4090", "4095"


def journals(signed: DataFrame, amounts: DataFrame, expired: DataFrame, credited: DataFrame, subscribed: DataFrame) -> DataFrame:
    """Double-entry lines of each document and month; lines of zero are dropped."""

    def post(df: DataFrame, month, lines: list) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(a).alias("account"), x.cast("long").alias("amount_cents")) for a, x in lines])
        ids = F.col("upstream_ids") if "upstream_ids" in df.columns else F.array("activity_id")
        return df.select("activity_id", "_source", "customer", month.alias("month"), ids.alias("upstream_ids"), F.inline(pairs))

    c = F.col
    rows = post(signed, F.trunc(c("ts").cast("date"), "month"), [(RECEIVABLE, c("commit_cents")), (DEFERRED, -c("commit_cents"))])
    rows = rows.unionByName(post(amounts, c("month"), [(DEFERRED, c("draw")), (RECEIVABLE, c("net") - c("draw") - c("fee")), (USAGE, -c("net")), (FEES, c("fee"))]))
    rows = rows.unionByName(post(expired, c("month"), [(DEFERRED, c("amount")), (EXPIRY, -c("amount"))]))
    rows = rows.unionByName(post(credited, c("period"), [(CREDITS, c("amount")), (RECEIVABLE, -c("amount"))]))
    rows = rows.unionByName(post(subscribed, c("month"), [(RECEIVABLE, c("amount")), (SUBSCRIPTION, -c("amount"))]))
    return rows.filter("amount_cents <> 0").select("activity_id", "_source", "customer", "month", "account", "amount_cents", "upstream_ids")


def close_accounts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("month", "account").agg(F.sum("amount_cents").alias("amount_cents"))


def close_rollforward(lines: DataFrame, months: DataFrame) -> DataFrame:
    """Movement, beginning and ending balance of every account in every month."""
    moved = close_accounts(lines)
    grid = moved.select("account").distinct().crossJoin(F.broadcast(months.select("month"))).join(moved, ["month", "account"], "left")
    grid = grid.select("month", "account", F.coalesce("amount_cents", F.lit(0)).cast("long").alias("movement_cents"))
    so_far = Window.partitionBy("account").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    ending = F.sum("movement_cents").over(so_far)
    return grid.select("month", "account", "movement_cents", (ending - F.col("movement_cents")).alias("beginning_cents"), ending.alias("ending_cents"))
