"""Customers, contracts and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.context import typed
from ledgerloom.plans.lineage import cut, parts

LATEST = ["ts", "activity_id"]


def parent_edges(snap: DataFrame) -> DataFrame:
    """customer, ts, activity_id, parent: every statement about a parent, from creation and merger."""
    created = typed(snap, ["customer_created"], {"parent_customer": "string"}).select("customer", "ts", "activity_id", F.col("parent_customer").alias("parent"))
    merged = typed(snap, ["customer_merged"], {"ultimate_parent": "string"}).select("customer", "ts", "activity_id", F.col("ultimate_parent").alias("parent"))
    return created.unionByName(merged)


def roots(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(customer, ultimate_parent) by pointer jumping: chains of any length shrink by half in each round.

    ``edges`` holds one (customer, parent) row per customer. A customer on or above a cycle has no root and gives no
    row; a parent without a row of its own is a root. Only customers that are parents jump, the others look at theirs once.
    Of those with a root that still wait, the nearest to it get there in the next round, so a round in which nobody does
    leaves cycles only.
    """
    ends = edges.select("customer", F.coalesce("parent", "customer").alias("node"), F.col("parent").isNull().alias("done"))
    asked = ends.filter(~F.col("done")).select(F.col("node").alias("customer")).distinct()
    # A parent that was never created is a root by itself.
    state = asked.join(ends, "customer", "left").select("customer", F.coalesce("node", "customer").alias("node"), F.coalesce("done", F.lit(True)).alias("done"))
    state = cut(state, "roots")
    waiting, before = state.filter(~F.col("done")).count(), None
    for _ in range(max_rounds):
        if not waiting or waiting == before:
            break
        hop = state.select(F.col("customer").alias("node"), F.col("node").alias("next"), F.col("done").alias("next_done"))
        moved = state.join(hop, "node").select("customer", F.col("next").alias("node"), (F.col("done") | F.col("next_done")).alias("done"))
        state, before = cut(moved, "roots"), waiting
        waiting = state.filter(~F.col("done")).count()
    found = state.filter("done").select(F.col("customer").alias("node"), F.col("node").alias("ultimate_parent"))
    below = ends.filter(~F.col("done")).join(found, "node").select("customer", "ultimate_parent")
    return ends.filter("done").select("customer", F.col("node").alias("ultimate_parent")).unionByName(below)


def customer_identity(snap: DataFrame) -> DataFrame:
    """customer, segment, channel, country and the ultimate parent by each customer's latest statement."""
    edges = parent_edges(snap).groupBy("customer").agg(F.max_by("parent", F.struct(*LATEST)).alias("parent"))
    created = typed(snap, ["customer_created"], {"segment": "string", "channel": "string", "country": "string"})
    return created.select("customer", "segment", "channel", "country").join(roots(edges), "customer")


def customer_history(snap: DataFrame) -> DataFrame:
    """Parents over time: valid from one statement to the next."""
    order = Window.partitionBy("customer").orderBy(*LATEST)
    return parent_edges(snap).select("customer", "parent", F.col("ts").alias("valid_from"), F.lead("ts").over(order).alias("valid_to"))


def customer_timeline(snap: DataFrame, identity: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Identity with first and last activity, last churn, and the latest contract and subscription state.

    ``used`` are the snapshot's token events where they are stored: then they aren't read from the snapshot again.
    """
    latest = F.struct(*LATEST)
    moments = snap.select("customer", "ts", "activity")
    if used is not None:
        moments = moments.filter("activity <> 'tokens_processed'").unionByName(used.select("customer", "ts", "activity"))
    times = moments.filter("customer IS NOT NULL").groupBy("customer").agg(
        F.min("ts").alias("first_activity"), F.max("ts").alias("last_activity"), F.max(F.when(F.col("activity") == "customer_churned", F.col("ts"))).alias("last_churn")
    )
    contracts = typed(snap, ["contract_signed", "contract_renewed", "contract_expired"], {"contract_id": "string"})
    contracts = contracts.groupBy("customer").agg(F.max_by(F.struct("contract_id", "activity", "ts"), latest).alias("k")).select("customer", "k.contract_id", F.col("k.activity").alias("contract_state"), F.col("k.ts").alias("contract_state_at"))
    subs = snap.filter(F.col("activity").isin("subscription_started", "subscription_renewed", "subscription_cancelled"))
    subs = subs.groupBy("customer").agg(F.max_by(F.struct("activity", "ts"), latest).alias("s")).select("customer", F.col("s.activity").alias("subscription_state"), F.col("s.ts").alias("subscription_state_at"))
    return identity.join(times, "customer").join(contracts, "customer", "left").join(subs, "customer", "left")


def dim_model(snap: DataFrame) -> DataFrame:
    return typed(snap, ["model_released"], {"model": "string", "generation": "int", "release_date": "date"}).select("model", "generation", "release_date", F.col("ts").alias("released_at"))


def dim_contract(snap: DataFrame) -> DataFrame:
    """Contracts with their validity and when the customer's next one starts."""
    found = typed(snap, ["contract_signed", "contract_renewed"], {"contract_id": "string", "channel": "string", "start": "date", "end": "date"})
    order = Window.partitionBy("_source", "customer").orderBy("start", "activity_id")
    return found.select("activity_id", "_source", "customer", "contract_id", "channel", F.col("start").alias("valid_from"), F.col("end").alias("valid_to"), F.lead("start").over(order).alias("next_start"))


def customer_month(timeline: DataFrame, calendar: DataFrame, revenue: DataFrame, tokens: DataFrame, seats: DataFrame) -> DataFrame:
    """Each customer's months from the first activity on, with revenue by family, tokens and seats; absent measures are zero."""
    families = {"consumption": "consumption_cents", "subscription": "subscription_cents", "credit": "credit_cents", "commit_expiry": "commit_expiry_cents"}
    of = [F.sum(F.when(F.col("family") == f, F.col("revenue_cents")).otherwise(0)).alias(c) for f, c in families.items()]
    money = revenue.groupBy("customer", "month").agg(F.sum("revenue_cents").alias("net_revenue_cents"), *of)
    used = tokens.groupBy("customer", "month").agg(F.sum("tokens").alias("tokens"))
    measures = ["beginning_seats", "ending_seats", "seat_days", "account_days"]
    held = seats.groupBy("customer", "month").agg(*[F.sum(m).alias(m) for m in measures])
    base = timeline.crossJoin(F.broadcast(calendar)).filter(F.col("month_end") > F.col("first_activity").cast("date"))
    full = base.join(money, ["customer", "month"], "left").join(used, ["customer", "month"], "left").join(held, ["customer", "month"], "left")
    zeros = ["net_revenue_cents", *families.values(), "tokens", *measures]
    return full.select("customer", "ultimate_parent", "segment", "channel", "month", "days", *[F.coalesce(F.col(m), F.lit(0)).cast("long").alias(m) for m in zeros])


def parent_month(recognized: DataFrame, policy: DataFrame, identity: DataFrame) -> DataFrame:
    """Revenue by ultimate parent and month, only where there is some."""
    of = lambda f: F.sum(F.when(F.col("family") == f, F.col("revenue_cents")).otherwise(0))
    sums = {"consumption_cents": of("consumption"), "subscription_cents": of("subscription"), "net_revenue_cents": F.sum("revenue_cents")}
    # By customer once, for the sums and for the join with parents; then by parent once, for all sums that follow.
    n = parts(recognized)
    lines = recognized.join(F.broadcast(policy), ["source", "recognition_kind"]).select("customer", "month", "family", "revenue_cents").repartition(n, "customer")
    lines = lines.groupBy("customer", "month").agg(*[x.alias(c) for c, x in sums.items()])
    lines = lines.join(identity.select("customer", "ultimate_parent").repartition(n, "customer"), "customer")
    return lines.repartition(n, "ultimate_parent").groupBy("ultimate_parent", "month").agg(*[F.sum(c).alias(c) for c in sums])
