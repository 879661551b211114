"""Exact money arithmetic on integer cents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.lineage import cut

WIDE = "decimal(38,0)"
BINS = 1024
#: Amounts up to this, times twice a million days, fit in a long.
SAFE = 1_000_000_000_000
#: Numbers up to this have products that fit in a long.
NARROW = 3_000_000_000


def cents(usd: Column | str) -> Column:
    """A decimal amount of two places as whole cents."""
    value = F.col(usd) if isinstance(usd, str) else usd
    return (value.cast("decimal(20,2)") * 100).cast("long")


def half_up(amount: str, elapsed: str, days: str) -> Column:
    """amount * elapsed / days rounded half up, for non-negative amounts: in longs where the product surely fits, else in 128 bits."""
    fits = f"{amount} BETWEEN -{SAFE} AND {SAFE} AND {elapsed} BETWEEN 0 AND 1000000 AND {days} BETWEEN 1 AND 1000000"
    wide = f"cast((2 * cast({amount} as {WIDE}) * {elapsed} + {days}) div (2 * {days}) as bigint)"
    return F.expr(f"CASE WHEN {fits} THEN (2L * {amount} * {elapsed} + {days}) div (2L * {days}) ELSE {wide} END")


def month_share(amount: str) -> Column:
    """The part of an amount between ``lo`` and ``hi`` of ``days``: a difference of cumulative roundings, so parts add up."""
    return half_up(amount, "hi", "days") - half_up(amount, "lo", "days")


def apportion_small(df: DataFrame, group: list[str], shares: dict[str, str], weight: str, tie: str) -> DataFrame:
    """Largest-remainder allocation of several amounts (column and name of its share) over the same weights, in one shuffle.

    For groups that a task can order, such as the lines of one invoice; see ``apportion`` for groups of any size. Signs,
    ties and groups without weight are treated alike in both.
    """
    every = Window.partitionBy(*group)
    if dict(df.dtypes)[weight] == "bigint":
        # Totals as two sums of longs, of the upper and the lower 32 bits: no row is added up in 128 bits.
        sums = {"_upper": F.sum(F.shiftright(weight, 32)).over(every), "_lower": F.sum(F.col(weight).bitwiseAND(F.lit(0xFFFFFFFF))).over(every)}
        total, wide_total = "CASE WHEN _upper = 0 THEN _lower END", f"cast(cast(_upper as {WIDE}) * 4294967296 + _lower as {WIDE})"
    else:
        sums = {"_sum": F.sum(F.col(weight).cast(WIDE)).over(every)}
        total, wide_total = f"CASE WHEN _sum <= {NARROW} THEN cast(_sum as bigint) END", "_sum"
    df = df.withColumns(sums | {"_lowest": F.min(weight).over(every)}).withColumn("_total", F.expr(total))
    made: list[str] = [*sums, "_lowest", "_total"]
    for k, amount in enumerate(shares):
        # Whole parts and remainders in longs where no product of the group can leave them, else in 128 bits; a group has one kind.
        fits = f"(_total BETWEEN 1 AND {NARROW} AND abs({amount}) <= {NARROW} AND _lowest >= 0)"
        narrow, wide = f"abs({amount}) * cast({weight} as bigint)", f"cast(cast(abs({amount}) as decimal(19,0)) * cast({weight} as decimal(19,0)) as {WIDE})"
        df = df.withColumn(f"_fits{k}", F.expr(f"coalesce({fits}, false)"))
        df = df.withColumns({
            f"_whole{k}": F.expr(f"CASE WHEN _fits{k} THEN {narrow} div _total ELSE cast({wide} div nullif({wide_total}, 0) as bigint) END"),
            f"_rest{k}": F.expr(f"CASE WHEN _fits{k} THEN {narrow} % _total END"),
            f"_wide_rest{k}": F.expr(f"CASE WHEN NOT _fits{k} THEN {wide} % nullif({wide_total}, 0) END"),
        })
    # Sums of all amounts in one pass over the groups; then a group is ordered once for each amount.
    df = df.withColumns({f"_wholes{k}": F.sum(f"_whole{k}").over(every) for k in range(len(shares))})
    for k, (amount, out) in enumerate(shares.items()):
        left = F.abs(F.col(amount)) - F.col(f"_wholes{k}")
        order = Window.partitionBy(*group).orderBy(F.desc(f"_rest{k}"), F.desc(f"_wide_rest{k}"), tie)
        extra = F.when(F.row_number().over(order) <= left, 1).otherwise(0)
        df = df.withColumn(out, F.coalesce(F.signum(F.col(amount)).cast("long") * (F.col(f"_whole{k}") + extra), F.lit(0).cast("long")))
        made += [f"{name}{k}" for name in ("_fits", "_whole", "_rest", "_wide_rest", "_wholes")]
        df = df.drop(*made[-4:])
    return df.drop(*made)


def apportion(df: DataFrame, group: list[str], amount: str, weight: str, tie: str, out: str, empty: int | None = 0) -> DataFrame:
    """Largest-remainder allocation of ``amount``, the same on all rows of a group, over the rows' weights.

    Each row gets the whole part of its share; the cents left over go to the largest remainders, ties by ``tie``. A group
    without weight gets ``empty``. Groups may hold very many rows: totals are combined before the shuffle, remainders are
    counted in bins, and only the rows of the one bin of a group in which the cents run out are ordered together. Totals and
    bins are written, so where groups are few the joins with them move no row; the input itself is read three times and
    should be a stored table or near to one.
    """
    total = cut(df.groupBy(*group).agg(F.sum(F.col(weight).cast(WIDE)).alias("_total")), "apportion-totals")
    parts = (
        df.join(total, group)
        .withColumn("_product", (F.abs(F.col(amount)).cast("decimal(19,0)") * F.col(weight).cast("decimal(19,0)")).cast(WIDE))
        .withColumn("_whole", F.expr("cast(_product div nullif(_total, 0) as bigint)"))
        .withColumn("_rest", F.expr("_product % nullif(_total, 0)"))
        .withColumn("_bin", F.expr(f"coalesce(cast(cast(_rest as double) / cast(_total as double) * {BINS} as int), 0)"))
    )
    bins = parts.groupBy(*group, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.sum("_whole").alias("_wholes"), F.max(F.abs(F.col(amount))).alias("_amount"))
    every = Window.partitionBy(*group)
    above = Window.partitionBy(*group).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    quota = bins.select(
        *group,
        "_bin",
        "_n",
        (F.col("_amount") - F.sum("_wholes").over(every) - F.coalesce(F.sum("_n").over(above), F.lit(0))).alias("_quota"),
    )
    quota = cut(quota, "apportion-bins")
    order = Window.partitionBy(*group, "_bin").orderBy(F.desc("_rest"), tie)
    rows = parts.join(quota, [*group, "_bin"])
    split = F.coalesce((F.col("_quota") > 0) & (F.col("_quota") < F.col("_n")), F.lit(False))
    alike = rows.filter(~split).withColumn("_extra", F.when(F.col("_quota") > 0, 1).otherwise(0))
    ordered = rows.filter(split).withColumn("_extra", F.when(F.row_number().over(order) <= F.col("_quota"), 1).otherwise(0))
    share = F.coalesce(F.signum(F.col(amount)).cast("long") * (F.col("_whole") + F.col("_extra")), F.lit(empty).cast("long"))
    made = alike.unionByName(ordered).withColumn(out, share)
    return made.drop("_total", "_product", "_whole", "_rest", "_bin", "_n", "_quota", "_extra")
