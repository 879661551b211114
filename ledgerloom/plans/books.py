"""The named nodes of the accounting graph over one snapshot.

Nodes are built when first asked for. Those with several consumers are written once to the shared folder, so no plan
holds a ledger more than once and a lost executor costs a file read.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import accounting, entities, ledgers, metrics
from ledgerloom.plans import context
from ledgerloom.plans.lineage import cut, discard, parts


class Books:
    """Nodes are properties; each output is one plan over the nodes written so far, with columns pruned at their scans."""

    def __init__(self, act: DataFrame, asof: dt.date, known_at: dt.datetime | None = None, watermark: int | None = None) -> None:
        self.spark = act.sparkSession
        self.snap = context.snapshot(act, asof, known_at, watermark)
        self.times = context.snapshot(context.times_of(act), asof, known_at) if watermark is None else self.snap
        self.asof = asof

    @cached_property
    def ctx(self) -> context.Context:
        return context.context(self.times, self.asof)

    @cached_property
    def calendar(self) -> DataFrame:
        return context.calendar(self.spark, self.ctx)

    @cached_property
    def policy(self) -> DataFrame:
        return context.recognition_policy(self.spark)

    @cached_property
    def thresholds(self) -> DataFrame:
        return context.cohort_thresholds(self.spark)

    @cached_property
    def contracts(self) -> DataFrame:
        return accounting.contracts(self.snap)

    @cached_property
    def invoices(self) -> DataFrame:
        return cut(accounting.invoices(self.snap), "invoices")

    @cached_property
    def credits(self) -> DataFrame:
        return accounting.credits(self.snap)

    @cached_property
    def expiries(self) -> DataFrame:
        return accounting.expiries(self.snap)

    @cached_property
    def subscription_events(self) -> DataFrame:
        return accounting.subscription_events(self.snap)

    @cached_property
    def funding(self) -> DataFrame:
        return cut(accounting.funding(self.invoices, self.contracts), "funding")

    @cached_property
    def invoice_months(self) -> DataFrame:
        return accounting.invoice_months(self.funding, self.ctx)

    @cached_property
    def invoice_amounts(self) -> DataFrame:
        return cut(accounting.invoice_amounts(self.invoice_months), "invoice-amounts")

    @cached_property
    def expiry_amounts(self) -> DataFrame:
        return accounting.expiry_amounts(self.expiries, self.contracts, self.funding)

    @cached_property
    def credit_amounts(self) -> DataFrame:
        return accounting.credit_amounts(self.credits, self.invoices)

    @cached_property
    def subscription_states(self) -> DataFrame:
        return accounting.subscription_states(self.subscription_events, self.ctx)

    @cached_property
    def subscription_months(self) -> DataFrame:
        return accounting.subscription_months(self.subscription_states, self.ctx, parts(self.subscription_events))

    @cached_property
    def subscription_amounts(self) -> DataFrame:
        return accounting.subscription_amounts(self.subscription_months)

    @cached_property
    def recognized(self) -> DataFrame:
        lines = accounting.recognized(self.invoice_amounts, self.expiry_amounts, self.credit_amounts, self.subscription_amounts, self.ctx)
        return cut(lines, "recognized")

    @cached_property
    def journals(self) -> DataFrame:
        return accounting.journals(self.contracts, self.invoice_amounts, self.expiry_amounts, self.credit_amounts, self.subscription_amounts)

    @cached_property
    def identity(self) -> DataFrame:
        return cut(entities.customer_identity(self.snap), "identity")

    @cached_property
    def timeline(self) -> DataFrame:
        return entities.customer_timeline(self.snap, self.identity)

    @cached_property
    def models(self) -> DataFrame:
        return entities.dim_model(self.snap)

    @cached_property
    def usage(self) -> DataFrame:
        return cut(ledgers.usage(self.snap), "usage")

    @cached_property
    def revenue(self) -> DataFrame:
        return cut(ledgers.revenue_ledger(self.recognized, self.policy, self.identity, self.invoices, self.credits, self.usage), "revenue")

    @cached_property
    def compute(self) -> DataFrame:
        return cut(ledgers.compute_ledger(self.snap, self.ctx), "compute")

    @cached_property
    def priced(self) -> DataFrame:
        """Token events with revenue and fee, without the cost share that only some outputs need."""
        return cut(ledgers.token_revenue(self.usage, self.models, self.identity, self.invoices, self.recognized, self.invoice_amounts), "priced")

    def priced_in(self, month: dt.date, used: DataFrame) -> DataFrame:
        """Priced token events of one month, from the snapshot's token events of that month.

        A batch's shares of a month depend on its events and amounts of that month only.
        """
        here = lambda df: df.filter(F.col("month") == F.lit(month))
        return cut(ledgers.token_revenue(here(used), self.models, self.identity, self.invoices, here(self.recognized), here(self.invoice_amounts)), "priced-month")

    def discard(self) -> None:
        """Delete the nodes written so far; outputs that still read them are lost."""
        discard(*[node for node in vars(self).values() if isinstance(node, DataFrame)])

    @cached_property
    def tokens(self) -> DataFrame:
        """Read from the priced events by each plan, with the columns it needs: only totals and bins are written."""
        return ledgers.token_ledger(self.priced, context.allocation(self.spark), self.compute)

    @cached_property
    def allocated(self) -> DataFrame:
        """Shares of each token event without its attributes, written for outputs that look at them several times."""
        return cut(self.tokens.select("activity_id", "_source", "usage_batch_id", "month", "model", "net_revenue_cents", "channel_fee_cents", "allocated_cost_cents"), "allocated")

    @cached_property
    def subscription_revenue(self) -> DataFrame:
        """Recognised lines of the subscription family, without the usage attributes they don't have."""
        return self.recognized.join(F.broadcast(self.policy.filter("family = 'subscription'")), ["source", "recognition_kind"])

    @cached_property
    def seats(self) -> DataFrame:
        return cut(ledgers.seat_ledger(self.subscription_events, self.ctx, self.subscription_revenue), "seats")

    @cached_property
    def trials(self) -> DataFrame:
        return ledgers.trial_cohorts(self.snap)

    @cached_property
    def parent_month(self) -> DataFrame:
        return entities.parent_month(self.recognized, self.policy, self.identity)

    @cached_property
    def customer_month(self) -> DataFrame:
        # Token events are stored for their revenue anyway.
        timeline = entities.customer_timeline(self.snap, self.identity, self.usage)
        return entities.customer_month(timeline, self.calendar, self.revenue, self.priced, self.seats)

    @cached_property
    def cohort_revenue(self) -> DataFrame:
        return metrics.cohort_revenue(self.parent_month, self.calendar, self.ctx)

    def nrr_members(self, version: str = "v3") -> DataFrame:
        return metrics.nrr_members(self.parent_month, self.identity, context.nrr_lenses(self.spark, version), self.ctx)

    def nrr(self, version: str = "v3") -> DataFrame:
        retention = metrics.consumption_nrr_v1 if version == "v1" else metrics.consumption_nrr
        return retention(self.nrr_members(version), context.nrr_lenses(self.spark, version), self.ctx)
