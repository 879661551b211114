"""Integrity of a stream with asserted recognition, and data tests over the ledger's nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.checks import count_of, together
from ledgerloom.plans.books import Books
from ledgerloom.plans.context import typed

MONEY = "decimal(18,2)"


def stream_checks(act: DataFrame, policy: DataFrame) -> DataFrame:
    """(reason, failures) of nine checks on the stream itself."""
    plus = act.withColumn("_source", F.struct("_source", "revenue_impact"))

    def rows(kinds: list[str], fields: dict[str, str]) -> DataFrame:
        found = typed(plus, kinds, fields)
        return found.withColumns({"revenue": F.col("_source.revenue_impact"), "origin": F.col("_source._source")}).drop("_source")

    asserted = rows(["revenue_recognized"], {"source": "string", "recognition_kind": "string", "source_document": "string", "period": "date"})
    earned = asserted.groupBy("origin", "recognition_kind", F.col("source_document").alias("document")).agg(F.sum("revenue").alias("earned"))
    of = lambda kind: earned.filter(F.col("recognition_kind") == kind).select("origin", "document", "earned")
    billed = rows(["usage_invoiced"], {"invoice_id": "string", "net_usd": MONEY, "channel_fee_usd": MONEY, "period_start": "date", "period_end": "date"})
    bills = billed.select("origin", F.col("invoice_id").alias("document"), (F.col("net_usd") - F.col("channel_fee_usd")).alias("net"))
    issued = rows(["credit_issued"], {"credit_id": "string", "amount_usd": MONEY, "period": "date"})
    ended = rows(["contract_expired"], {"contract_id": "string", "unconsumed_commit_usd": MONEY})
    created = act.filter("activity = 'customer_created'").groupBy("customer").agg(F.min("ts").alias("since"))
    events = act.filter("customer IS NOT NULL").join(created, "customer", "left").filter("since IS NULL OR since > ts")
    periods = typed(act.withColumn("activity", F.lit("any")), ["any"], {"period_start": "date", "period_end": "date"})
    merged = typed(act, ["customer_merged"], {"ultimate_parent": "string"})
    month = F.trunc(F.col("ts").cast("date"), "month")
    documents = [
        billed.select("origin", "customer", "ts", F.lit("usage").alias("kind"), F.col("invoice_id").alias("document"), F.col("period_start").alias("first"), F.col("period_end").alias("stop")),
        rows(["subscription_started", "subscription_renewed", "subscription_upgraded", "subscription_downgraded"], {"subscription_id": "string", "period_start": "date", "period_end": "date"})
        .select("origin", "customer", "ts", F.lit("subscription").alias("kind"), F.col("subscription_id").alias("document"), F.col("period_start").alias("first"), F.col("period_end").alias("stop")),
        issued.select("origin", "customer", "ts", F.lit("credit").alias("kind"), F.col("credit_id").alias("document"), F.col("period").alias("first"), F.add_months("period", 1).alias("stop")),
        ended.select("origin", "customer", "ts", F.lit("commit_expiry").alias("kind"), F.col("contract_id").alias("document"), month.alias("first"), F.add_months(month, 1).alias("stop")),
    ]
    known = documents[0]
    for more in documents[1:]:
        known = known.unionByName(more)
    r, d = asserted.alias("r"), known.alias("d")
    day = F.col("r.ts").cast("date")
    proof = (
        (F.col("r.origin") == F.col("d.origin")) & (F.col("r.customer") == F.col("d.customer")) & (F.col("r.recognition_kind") == F.col("d.kind")) & (F.col("r.source_document") == F.col("d.document"))
        & (F.col("d.ts") <= F.col("r.ts")) & (day >= F.col("d.first")) & (day < F.col("d.stop"))
    )
    due = ended.groupBy("origin", "customer", month.alias("month"), F.col("contract_id").alias("document")).agg(F.sum("unconsumed_commit_usd").alias("due"))
    paid = asserted.filter("recognition_kind = 'commit_expiry'").groupBy("origin", "customer", month.alias("month"), F.col("source_document").alias("document")).agg(F.sum("revenue").alias("paid"))
    key, left, right = ["origin", "document"], F.lit(True).alias("l"), F.lit(True).alias("r")
    return together(
        count_of("customer_exists", events),
        count_of("usage_revenue_ties_to_invoice", bills.select("*", left).join(of("usage"), key, "full").filter("l IS NULL OR net <> coalesce(earned, 0)")),
        count_of("credits_have_exact_negative_recognition", issued.select("origin", F.col("credit_id").alias("document"), "amount_usd", left).join(of("credit").select("*", right), key, "full").filter("l IS NULL OR r IS NULL OR amount_usd <> -earned")),
        count_of("no_self_mergers", merged.filter("customer = ultimate_parent")),
        count_of("service_periods_are_nonempty", periods.filter("period_start >= period_end")),
        count_of("recognition_period_matches_event_month", asserted.filter(F.col("period") != month)),
        count_of("recognition_source_documents_exist", r.join(d, proof, "left_anti")),
        count_of("commit_expiry_ties_to_unconsumed_balance", due.select("*", left).join(paid, ["origin", "customer", "month", "document"], "full").filter("l IS NULL OR due <> coalesce(paid, 0)")),
        count_of("recognition_pairs_are_versioned", asserted.join(F.broadcast(policy), ["source", "recognition_kind"], "left_anti")),
    )


def data_tests(b: Books) -> DataFrame:
    """(reason, failures) of the eleven data tests over the ledger's nodes."""
    from ledgerloom.operators import metrics

    lost = b.credits.join(b.credit_amounts.filter("invoice_activity IS NOT NULL"), "activity_id", "left_anti")
    alone = b.expiries.join(b.contracts.select("_source", "contract_id"), ["_source", "contract_id"], "left_anti").select("activity_id")
    late = b.expiries.join(b.invoices.select("_source", "contract_id", "period_end"), ["_source", "contract_id"]).filter(F.col("period_end") > F.col("ts").cast("date")).select("activity_id")
    size = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    created = b.snap.filter("activity = 'customer_created'")
    people = size(created, "n").crossJoin(size(b.identity, "m")).filter("n <> m").select("n")
    priced = size(b.usage, "n").crossJoin(size(b.tokens, "m")).filter("n <> m").select("n")
    bad_bill = (
        "gross_cents - discount_cents <> net_cents OR fee_cents < 0 OR fee_cents > net_cents OR period_end <= period_start OR (contract_id IS NOT NULL AND contract_activity IS NULL)"
        " OR (draw_cents > 0 AND fee_cents > 0) OR (contract_id IS NOT NULL AND (period_start < contract_start OR period_end > contract_end))"
    )
    open_lines = b.journals.groupBy("_source", "activity_id", "month").agg(F.sum("amount_cents").alias("n")).filter("n <> 0")
    booked = b.journals.filter(F.col("account").startswith("4")).groupBy("month").agg((-F.sum("amount_cents")).alias("booked"))
    earned = b.recognized.groupBy("month").agg(F.sum("revenue_cents").alias("earned"))
    within = F.col("month") < F.lit(b.ctx.period_end)
    seats = metrics.subscriptions(b.seats, b.trials).filter("paid_seats <> beginning_seats + gross_adds - cancelled_seats - seat_removals + plan_transfers_net")
    kinds = ["subscription_started", "subscription_renewed", "subscription_upgraded", "subscription_downgraded"]
    scope = b.subscription_events.filter(F.col("activity").isin(kinds) & ((F.col("billing_period") != "monthly") | (F.col("period_end") <= F.col("ts").cast("date"))))
    papers = [df.select("_source", F.lit(kind).alias("kind"), F.col(c).alias("document")) for kind, df, c in (("i", b.invoices, "invoice_id"), ("c", b.contracts, "contract_id"), ("r", b.credits, "credit_id"), ("e", b.expiries, "contract_id"))]
    twice = together(*papers).groupBy("_source", "kind", "document").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shares = b.tokens.groupBy("_source", "usage_batch_id", "month").agg(F.sum("net_revenue_cents").alias("money"), F.sum("channel_fee_cents").alias("fees"))
    off = b.invoice_amounts.select("_source", "usage_batch_id", "month", "net", "fee").join(shares, ["_source", "usage_batch_id", "month"], "left")
    return together(
        count_of("credit_completeness", lost), count_of("dimension_completeness", people.union(priced)), count_of("expiry_completeness", alone.union(late)),
        count_of("invoice_integrity", b.funding.filter(bad_bill)), count_of("journal_balance", open_lines),
        count_of("nrr_identity", b.nrr().filter("current_revenue_cents <> base_revenue_cents + expansion_cents - contraction_cents - churn_cents")),
        count_of("recognition_bridge", booked.filter(within).join(earned, "month", "full").filter("coalesce(booked, 0) <> coalesce(earned, 0)")),
        count_of("seat_rollforward", seats), count_of("subscription_scope", scope), count_of("unique_business_documents", twice),
        count_of("usage_allocation", off.filter("coalesce(money, 0) <> net - fee OR coalesce(fees, 0) <> fee")),
    )


def nrr_date_diagnostic(requests: DataFrame, rows: DataFrame, lenses: list[str]) -> DataFrame:
    """For each requested date of a case's report rows: selected, or why not, and the date to ask for instead."""
    r = rows.select(F.col("case_id").alias("row_case"), F.col("month").alias("row_month"), "lens", F.col("status").alias("row_status"), "nrr")
    seen = requests.join(r, requests["case_id"] == r["row_case"], "left").groupBy("case_id", "population", "requested_date").agg(
        F.count("row_case").alias("population_rows"), F.count_distinct("row_month").alias("dates"), F.min("row_month").alias("reporting_date"),
        F.count_distinct(F.when(F.col("lens").isin(lenses), F.col("lens"))).alias("registered"),
        F.count(F.when(F.col("row_month") == F.col("requested_date"), 1)).alias("selected_rows"),
        F.count(F.when(F.col("row_case").isNotNull() & ((F.col("row_status") != "defined") | F.col("nrr").isNull()), 1)).alias("unavailable_rows"),
    )
    chosen = F.col("selected_rows") > 0
    status = (
        F.when(F.col("population") != "nrr", "unsupported_population").when(F.col("population_rows") == 0, "no_population").when(F.col("dates") != 1, "ambiguous_population")
        .when((F.col("population_rows") != len(lenses)) | (F.col("registered") != len(lenses)), "incomplete_population").when(chosen & (F.col("unavailable_rows") > 0), "selected_unavailable")
        .when(chosen, "selected").when(F.col("requested_date") == F.trunc("reporting_date", "month"), "date_grain_mismatch").otherwise("no_matching_date")
    )
    seen = seen.withColumn("status", status)
    hint = F.when(F.col("status") == "date_grain_mismatch", F.col("reporting_date").cast("string")).alias("suggested_date")
    return seen.select("case_id", "status", hint, "population_rows", "selected_rows", "unavailable_rows")
