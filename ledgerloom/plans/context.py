"""The bitemporal snapshot, the reporting context and the small parameter relations."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from decimal import Decimal
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UTC = dt.timezone.utc

#: Megawatt hours per million tokens of the first model generation, by token kind.
ENERGY = {"input": Decimal("0.02"), "output": Decimal("0.08"), "cache_read": Decimal("0.003"), "cache_write": Decimal("0.025")}
#: Recognition pairs and the revenue family they belong to.
POLICY = [
    ("usage", "usage", "consumption"),
    ("commit_drawdown", "usage", "consumption"),
    ("subscription", "subscription", "subscription"),
    ("usage", "credit", "credit"),
    ("commit_drawdown", "commit_expiry", "commit_expiry"),
]
#: Retention lenses as (lens, months, annualisation, with subscriptions, floor in cents), by definition version.
LENSES = {
    "v1": [("base_t12m", 12, 1, False, 1_000_000), ("floor_100k", 12, 1, False, 10_000_000), ("t3m_annualized", 3, 4, False, 1_000_000), ("subscription_inclusive", 12, 1, True, 1_000_000)],
    "v2": [("base_t12m", 12, 1, False, 1_000_000), ("floor_100k", 12, 1, False, 10_000_000), ("t3m_annualized", 3, 4, False, 1_000_000), ("subscription_inclusive", 12, 1, True, 1_000_000)],
    "v3": [("base_t12m", 12, 1, False, 10_000_000), ("floor_100k", 12, 1, False, 10_000_000), ("t3m_annualized", 3, 4, False, 1_000_000), ("subscription_inclusive", 12, 1, True, 1_000_000)],
}
#: Cohort thresholds in cents.
THRESHOLDS = [10_000_000, 100_000_000, 1_000_000_000]


@dataclass(frozen=True)
class Context:
    """An economic date that ends a month, the day after it, and the first month with activity."""

    asof: dt.date
    period_end: dt.date
    first_month: dt.date


def snapshot(act: DataFrame, asof: dt.date, known_at: dt.datetime | None = None, watermark: int | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Rows of economic time up to ``asof``, recorded before ``known_at``, committed up to ``watermark``; all three are scan filters."""
    day_after = dt.datetime.combine(asof + dt.timedelta(days=1), dt.time(), UTC)
    seen = act.filter((F.col("_recorded_at") < F.lit(known_at or day_after)) & (F.col("ts") < F.lit(day_after)))
    if watermark is not None:
        seen = seen.filter(F.col("_stream_position") <= watermark)
    return seen if exclude is None else seen.join(exclude.select("activity_id"), "activity_id", "left_anti")


#: Times of streams, where they can be had at less cost than from the rows themselves: ts and _recorded_at, repeats allowed.
_times: WeakKeyDictionary[DataFrame, DataFrame] = WeakKeyDictionary()


def keep_times(act: DataFrame, times: DataFrame) -> DataFrame:
    """The stream, after noting a table with the times of all its rows and no others."""
    _times[act] = times
    return act


def times_of(act: DataFrame) -> DataFrame:
    return _times.get(act, act)


def context(snap: DataFrame, asof: dt.date) -> Context:
    day_after = asof + dt.timedelta(days=1)
    if day_after.day != 1:
        raise ValueError("the economic date must end a month")
    first = snap.agg(F.min("ts").cast("date")).first()[0] or asof
    return Context(asof, day_after, first.replace(day=1))


def calendar(spark: SparkSession, ctx: Context) -> DataFrame:
    """One row per month from the first visible to the reported one: month, month_end, days."""
    months = spark.range(1).select(F.explode(F.sequence(F.lit(ctx.first_month), F.add_months(F.lit(ctx.period_end), -1), F.expr("interval 1 month"))).alias("month"))
    return months.select("month", F.add_months("month", 1).alias("month_end"), F.datediff(F.add_months("month", 1), "month").cast("long").alias("days"))


def months_between(first: Column, stop: Column, ctx: Context) -> Column:
    """Months that overlap the half-open interval [first, stop), inside the calendar, as an array.

    Exploding it gives each interval its own months, so no interval is ever compared with a month it doesn't touch.
    """
    low = F.greatest(F.trunc(first, "month"), F.lit(ctx.first_month))
    high = F.least(F.trunc(F.date_sub(stop, 1), "month"), F.add_months(F.lit(ctx.period_end), -1))
    return F.when((first < stop) & (low <= high), F.sequence(low, high, F.expr("interval 1 month")))


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Whether two half-open intervals share a point."""
    return (start < high) & (end > low)


def allocation(spark: SparkSession, generations: int = 5) -> DataFrame:
    """Energy weights in whole nano-megawatt-hours: each generation needs four fifths of the one before."""
    rows = [(f"g{g + 1}", kind, int(base * 10**9 * 4**g / 5**g)) for g in range(generations) for kind, base in ENERGY.items()]
    return spark.createDataFrame(rows, "model string, token_type string, coefficient_nano long")


def recognition_policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICY, "source string, recognition_kind string, family string")


def nrr_lenses(spark: SparkSession, version: str = "v3") -> DataFrame:
    return spark.createDataFrame(LENSES[version], "lens string, months int, annualization long, include_subscription boolean, floor_cents long")


def cohort_thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in THRESHOLDS], "threshold_cents long")


def with_occurrence(snap: DataFrame) -> DataFrame:
    """Number of each activity of an identity and the time of the next one, after the snapshot's filters."""
    who = F.when(F.col("customer").isNotNull(), F.concat(F.lit("c:"), "customer")).when(F.col("anonymous_customer_id").isNotNull(), F.concat(F.lit("a:"), "anonymous_customer_id")).otherwise(F.concat(F.lit("e:"), "activity_id"))
    order = Window.partitionBy(who, "activity").orderBy("ts", "activity_id")
    return snap.withColumns({"activity_occurrence": F.row_number().over(order).cast("long"), "activity_repeated_at": F.lead("ts").over(order)})


def typed(snap: DataFrame, activities: list[str], fields: dict[str, str]) -> DataFrame:
    """Rows of some activities with their features as typed columns, by one pass over each JSON text.

    Fields are read as text and cast, so quoted and bare values both convert.
    """
    kept = ["activity_id", "_source", "customer", "ts", "activity"]
    features = F.from_json("feature_json", ", ".join(f"`{name}` string" for name in fields)).alias("_f")
    rows = snap.filter(F.col("activity").isin(activities)).select(*kept, features)
    return rows.select(*kept, *[F.col(f"_f.`{name}`").cast(kind).alias(name) for name, kind in fields.items()])


def usage_window(first: dt.date, last: dt.date, zone: str) -> tuple[Column, Column]:
    """UTC bounds of the local days from ``first`` to ``last``, the end excluded."""
    utc = lambda day: F.to_utc_timestamp(F.lit(day.isoformat()).cast("timestamp"), zone)
    return utc(first), utc(last + dt.timedelta(days=1))
