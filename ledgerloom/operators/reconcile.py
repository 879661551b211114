"""Reconciliation with evidence from outside: source captures and the general ledger of another system."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def erp_bridge(revenue: DataFrame, amounts: DataFrame, erp: DataFrame) -> DataFrame:
    """Revenue before channel fees by period, account and source against another system's figures, without tolerance.

    ``erp`` has period, account, source and amount_usd as text. The fee of an invoice and month is added back once, on
    its cash line, whatever number of lines the invoice has.
    """
    account = (
        F.when(F.col("recognition_kind") == "usage", "4000").when(F.col("recognition_kind") == "subscription", "4010").when(F.col("recognition_kind") == "commit_expiry", "4020").when(F.col("recognition_kind") == "credit", "4090")
    )
    net = revenue.select("month", account.alias("account"), "source", F.col("revenue_cents").alias("cents"))
    fees = amounts.filter("fee <> 0").select("month", F.lit("4000").alias("account"), F.lit("usage").alias("source"), F.col("fee").alias("cents"))
    ours = net.unionByName(fees).groupBy("month", "account", "source").agg(F.sum("cents").alias("ledger_cents"))
    theirs = erp.select(F.to_date(F.concat("period", F.lit("-01"))).alias("month"), "account", "source", (F.col("amount_usd").cast("decimal(20,2)") * 100).cast("long").alias("cents"))
    theirs = theirs.groupBy("month", "account", "source").agg(F.sum("cents").alias("erp_cents"))
    both = ours.join(theirs, ["month", "account", "source"], "full")
    rows = both.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("ledger_cents", "erp_cents")})
    return rows.withColumn("difference_cents", F.col("ledger_cents") - F.col("erp_cents"))


def reconcile_sources(act: DataFrame, captures: DataFrame) -> DataFrame:
    """Activities by source month, kind and status, with their count and both sides' cents.

    A row is matched, missing here, unexpected here, altered, or of altered arrival: the same content recorded at another
    time. ``captures`` has activity_id, ts, activity, content, and, if known, _recorded_at and cents; ``act`` the same after
    admission. Where the arrival or the amount of a side isn't known, it isn't compared or counted.
    """

    def side(df: DataFrame, tag: str) -> DataFrame:
        known = lambda c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
        return df.select(
            "activity_id", F.lit(True).alias(f"{tag}_has"), F.col("ts").alias(f"{tag}_ts"), F.col("activity").alias(f"{tag}_kind"), F.sha2("content", 256).alias(f"{tag}_hash"),
            known("_recorded_at", "timestamp").alias(f"{tag}_at"), known("cents", "long").alias(f"{tag}_cents"),
        )

    both = side(act, "our").join(side(captures, "their"), "activity_id", "full")
    same = F.col("our_hash").eqNullSafe(F.col("their_hash")) & F.col("our_kind").eqNullSafe(F.col("their_kind"))
    status = (
        F.when(F.col("our_has").isNull(), "missing").when(F.col("their_has").isNull(), "unexpected").when(~same, "altered")
        .when(F.col("our_at") != F.col("their_at"), "altered_arrival").otherwise("matched")
    )
    month = F.trunc(F.coalesce("their_ts", "our_ts").cast("date"), "month")
    sums = [F.sum(c).alias(c) for c in ("our_cents", "their_cents")]
    return both.groupBy(month.alias("month"), F.coalesce("their_kind", "our_kind").alias("activity"), status.alias("status")).agg(F.count(F.lit(1)).alias("n"), *sums)
