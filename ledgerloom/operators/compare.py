"""Comparing populations: tolerant row comparison, fingerprints, restatement and bridges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.plans.lineage import cut

EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

#: Measures are compared as decimals: money exactly, ratios at twelve places.
TWELVE_PLACES = "decimal(38,12)"


def paired(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """One row per key of either side: the keys, n_l and n_r (rows of each side), and ``reasons``, the columns that differ.

    Whole numbers must be equal, other numbers within the tolerance; null equals only null, and a number that is not
    finite equals nothing. Null keys are equal.
    """
    values = [c for c in left.columns if c not in keys]

    def side(df: DataFrame, tag: str) -> DataFrame:
        packed = F.struct(*[F.col(f"`{c}`") for c in values]) if values else F.struct(F.lit(1).alias("one"))
        return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias(f"n_{tag}"), F.first(packed).alias(tag))

    l, r = side(left, "l").alias("l"), side(right, "r").alias("r")
    both = l.join(r, [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys], "full")
    named = [F.when(F.col("n_l").isNotNull(), F.col(f"l.`{k}`")).otherwise(F.col(f"r.`{k}`")).alias(k) for k in keys]
    flat = both.select(*named, "n_l", "n_r", F.col("l.l").alias("lv"), F.col("r.r").alias("rv"))
    reasons = []
    for c in values:
        a, b = F.col(f"lv.`{c}`"), F.col(f"rv.`{c}`")
        kind = left.schema[c].dataType
        if isinstance(kind, T.NumericType) and not isinstance(kind, EXACT):
            x, y = a.cast("double"), b.cast("double")
            finite = ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) != float("inf")) & (F.abs(y) != float("inf"))
            same = F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(finite & (F.abs(x - y) <= tolerance))
        else:
            same = a.eqNullSafe(b)
        reasons.append(F.when(~same, F.lit(c)))
    there = F.col("n_l").isNotNull() & F.col("n_r").isNotNull()
    none = F.array().cast("array<string>")
    return flat.select(*keys, "n_l", "n_r", F.when(there, F.array_compact(F.array(*reasons)) if reasons else none).otherwise(none).alias("reasons"))


def compare_tables(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """One row: keys only on either side, repeated keys of either side, and keys whose rows differ."""
    n = lambda cond: F.count(F.when(cond, 1))
    return paired(left, right, keys, tolerance).agg(
        n(F.col("n_r").isNull()).alias("only_left"), n(F.col("n_l").isNull()).alias("only_right"), n(F.col("n_l") > 1).alias("repeated_left"), n(F.col("n_r") > 1).alias("repeated_right"), n(F.size("reasons") > 0).alias("different")
    )


def differences(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Keys with what is wrong with them: missing on a side, repeated, or the columns that differ. Take a few by ``limit``."""
    rows = paired(left, right, keys, tolerance)
    found = F.array_compact(F.array(
        F.when(F.col("n_r").isNull(), "missing right"), F.when(F.col("n_l").isNull(), "missing left"), F.when(F.col("n_l") > 1, "repeated left"), F.when(F.col("n_r") > 1, "repeated right"),
        F.when(F.size("reasons") > 0, F.array_join("reasons", " ")),
    ))
    return rows.select(*keys, F.array_join(found, ", ").alias("reason")).filter("reason <> ''")


def encoded(df: DataFrame) -> Column:
    """A row as text by a rule that any engine can follow, so that equal populations have equal digests everywhere.

    Columns go by name; a value is its text with the length before it, null a dash. Whole numbers, money and dates are written
    as they are, ratios as decimals of twelve places (not finite ones by name), times as microseconds since 1970 in UTC.
    """
    parts = []
    for c in sorted(df.columns):
        kind, col = df.schema[c].dataType, F.col(f"`{c}`")
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            col = F.coalesce(col.try_cast("decimal(38,12)").cast("string"), col.cast("string"))
        elif isinstance(kind, T.TimestampType):
            col = F.unix_micros(col).cast("string")
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            col = F.to_json(col, {"ignoreNullFields": "false"})
        else:
            col = col.cast("string")
        parts.append(F.coalesce(F.concat(F.char_length(col).cast("string"), F.lit(":"), col), F.lit("-")))
    return F.concat_ws(",", *parts) if parts else F.lit("")


def fingerprint(df: DataFrame) -> DataFrame:
    """Count and order-independent digest of a population: lane sums of row digests, combined where the rows are."""
    digest = F.sha2(encoded(df), 256)
    lanes = [F.sum(F.conv(F.substring(digest, 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    sums = df.agg(F.count(F.lit(1)).alias("n"), *lanes)
    return sums.select(F.col("n").alias("row_count"), F.sha2(F.concat_ws(":", "n", *[F.coalesce(F.col(f"s{k}"), F.lit(0)).cast("string") for k in range(4)]), 256).alias("fingerprint"))


def restate(old: DataFrame, new: DataFrame, keys: list[str], measures: list[str], units: dict[str, str] | None = None) -> DataFrame:
    """Row bridge between two runs: one row per key and measure with both values, the exact difference and what happened.

    With ``units`` (of each measure) rows also have ``unit`` and ``delta_status``: differences of ratios are in percentage
    points, and where an end is missing there is no difference.
    """
    tall = lambda df: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast(TWELVE_PLACES).alias("value")) for m in measures])).alias("m")).select(*keys, "m.*")
    a, b = tall(old).withColumn("in_old", F.lit(True)).alias("a"), tall(new).withColumn("in_new", F.lit(True)).alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "measure"]], "full")
    what = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("a.value").eqNullSafe(F.col("b.value")), "unchanged").otherwise("changed")
    named = [F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in [*keys, "measure"]]
    delta = F.col("b.value") - F.col("a.value")
    rows = both.select(*named, F.col("a.value").alias("old_value"), F.col("b.value").alias("new_value"), delta.alias("delta"), what.alias("change"))
    if units is None:
        return rows
    unit = F.create_map(*[F.lit(x) for pair in units.items() for x in pair])[F.col("measure")]
    ratio = unit == "ratio"
    return rows.withColumns({
        "delta": F.when(ratio, (F.col("delta").cast("decimal(24,12)") * 100).cast(TWELVE_PLACES)).otherwise(F.col("delta")), "unit": F.when(ratio, "percentage points").otherwise(unit),
        "delta_status": F.when(F.col("delta").isNull(), "unavailable_endpoint").otherwise("defined"),
    })


def newly_visible(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows the new snapshot adds; it fails unless every row of the old one is there unchanged."""
    content = F.sha2(F.to_json(F.struct(*sorted(set(old.columns) & set(new.columns))), {"ignoreNullFields": "false"}), 256)
    was, now = old.select("activity_id", content.alias("was")), new.select(F.col("activity_id").alias("id"), content.alias("now"))
    lost = was.join(now, F.col("activity_id") == F.col("id"), "left").filter("now IS NULL OR was <> now").agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if lost:
        raise ValueError(f"{lost} rows of the earlier snapshot changed or are gone")
    return new.join(old.select("activity_id"), "activity_id", "left_anti")


def account_bridge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Months and accounts whose balance moved between two closes; the movements add up to zero."""
    rows = old.select("month", "account", F.col("amount_cents").alias("was")).join(new.select("month", "account", F.col("amount_cents").alias("now")), ["month", "account"], "full")
    return rows.select("month", "account", (F.coalesce("now", F.lit(0)) - F.coalesce("was", F.lit(0))).alias("delta_cents")).filter("delta_cents <> 0")


def input_manifest(snap: DataFrame) -> DataFrame:
    """One row: fingerprint, count, and the first and last position and identifier of what a run reads."""
    ends = snap.agg(*[f(c).alias(n) for c, a in (("_stream_position", "position"), ("activity_id", "id")) for f, n in ((F.min, f"first_{a}"), (F.max, f"last_{a}"))])
    return fingerprint(snap).crossJoin(ends)


def yield_bridge(old: DataFrame, new: DataFrame, moved: DataFrame) -> DataFrame:
    """One row: a month's yield before, after and the difference, from two summaries and the account bridge of that month.

    Tokens must be there and unchanged, and the change of revenue must be what accounts 4000 and 4095 moved by; anything
    else is an error, since part of the change would have no posting behind it.
    """
    amounts = ["tokens", "net_revenue_cents", "channel_fee_cents", "before_fees_cents"]
    parts = lambda df, tag: df.withColumn("before_fees_cents", F.col("net_revenue_cents") + F.col("channel_fee_cents")).select(*[F.col(c).alias(f"{tag}_{c}") for c in amounts])
    credit = lambda *codes: F.coalesce(-F.sum(F.when(F.col("account").isin(*codes), F.col("delta_cents"))), F.lit(0))
    ties = moved.agg(credit("4000", "4095").alias("net_postings"), credit("4000").alias("gross_postings"))
    row = parts(old, "old").crossJoin(parts(new, "new")).crossJoin(ties)
    row = row.withColumns({f"delta_{c}": F.col(f"new_{c}") - F.col(f"old_{c}") for c in amounts})
    even = (F.col("old_tokens") > 0) & (F.col("delta_tokens") == 0)
    tied = (F.col("delta_net_revenue_cents") == F.col("net_postings")) & (F.col("delta_before_fees_cents") == F.col("gross_postings"))
    per = lambda c: F.round(F.col(c).cast("decimal(30,12)") * 10000 / F.nullif(F.col("old_tokens"), F.lit(0)).cast("decimal(20,0)"), 12).cast("double")
    row = row.withColumns({"delta_after_fees_per_mtok": per("delta_net_revenue_cents"), "delta_before_fees_per_mtok": per("delta_before_fees_cents")})
    row = cut(row.withColumn("sound", F.coalesce(even & tied, F.lit(False))), "yield-bridge")
    if not row.first()["sound"]:
        raise ValueError("the change of yield does not tie to the accounts, or its tokens changed")
    return row.drop("net_postings", "gross_postings", "sound")


#: So many documents of one group are tried in every combination; more leave the group's changes unresolved.
MOST_DOCUMENTS = 4


def attribute_changes(
    old: DataFrame, new: DataFrame, document: Column, evaluate: Callable[[DataFrame, list[str]], DataFrame], keys: list[str], within: list[str] | None = None, most: int = MOST_DOCUMENTS
) -> DataFrame:
    """For each result row that differs between two snapshots, the fewest added documents that explain it.

    ``document`` names the document of an activity; null makes the activity a document of its own. ``within`` names columns
    that activities and results share and that no result crosses, a customer for instance: only documents of a row's own group
    can explain it, so groups are settled side by side. A group's documents are bits of a mask, and its activities are taken
    once for each mask that holds their document, those of the old snapshot for every mask; ``evaluate(rows, by)`` then
    evaluates all subsets of all groups in one plan, as results by its keys and the columns ``by``. A row is explained by the
    smallest subset that gives its new state (none, if it is gone), of equal sizes the first in order of documents.

    Returns keys, status and documents: proven_minimum_group_set, definition_change where the group has no added document,
    or unresolved_candidates where it has more than ``most`` or no subset gives the row.
    """
    groups = F.to_json(F.struct(*within), {"ignoreNullFields": "false"}) if within else F.lit("")
    added = newly_visible(old, new).withColumns({"_document": F.coalesce(document, F.concat(F.lit("activity:"), "activity_id")), "_group": groups})
    documents = cut(added.groupBy("_group", "_document").agg(F.count(F.lit(1)).alias("rows")), "added-documents").drop("rows")
    sizes = documents.groupBy("_group").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    place = F.row_number().over(Window.partitionBy("_group").orderBy("_document"))
    few = sizes.filter(F.col("_n") <= most)
    # The first document has the highest bit, so of masks with equally many bits the larger comes first in order of documents.
    bits = documents.join(few, "_group").withColumn("_bit", F.call_function("shiftleft", F.lit(1), F.col("_n") - place))
    every = F.explode(F.expr("sequence(0, shiftleft(1, _n) - 1)"))

    def state(rows: DataFrame, by: list[str]) -> DataFrame:
        found = evaluate(rows, by)
        content = F.to_json(F.struct(*sorted(c for c in found.columns if c not in [*keys, *by])), {"ignoreNullFields": "false"})
        return found.select(*keys, *by, F.sha2(content, 256).alias("digest"))

    def beside(left: DataFrame, right: DataFrame, how: str, by: list[str]) -> DataFrame:
        """Both sides' digests by key; null keys are equal."""
        all_keys = [*keys, *by]
        r = right.select(*[F.col(k).alias(f"_{k}_") for k in all_keys], F.col("digest").alias("other"))
        both = left.join(r, [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in all_keys], how)
        there = F.col("digest").isNotNull() | F.lit(how == "left")
        rest = [c for c in left.columns if c not in [*all_keys, "digest"]]
        return both.select(*[F.when(there, F.col(k)).otherwise(F.col(f"_{k}_")).alias(k) for k in all_keys], *rest, "digest", "other")

    changed = beside(state(new, []), state(old, []), "full", []).filter("NOT digest <=> other").drop("other")
    changed = cut(changed.withColumn("_group", groups).join(sizes, "_group", "left"), "changed")
    chosen = [*old.columns, "_mask"]
    rows = old.withColumn("_group", groups).join(few, "_group").withColumn("_mask", every).select(*chosen)
    more = added.join(bits, ["_group", "_document"]).withColumn("_mask", every).filter(F.col("_mask").bitwiseAND(F.col("_bit")) != 0).select(*chosen)
    tried = changed.filter(F.col("_n") <= most).withColumn("_mask", every)
    hits = beside(tried, state(rows.unionByName(more), ["_mask"]), "left", ["_mask"]).filter("digest <=> other")
    best = hits.groupBy(*keys, "_group").agg(F.min(F.struct(F.bit_count("_mask").alias("size"), (-F.col("_mask")).alias("order"))).alias("_best"))
    named = bits.groupBy("_group").agg(F.array_sort(F.collect_list(F.struct("_document", F.col("_bit").alias("bit")))).alias("_named"))
    best = best.join(named, "_group", "left").select(*[F.col(k).alias(f"_{k}_") for k in keys], "_best", "_named")
    found = changed.join(best, [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys], "left")
    used = F.filter(F.coalesce("_named", F.array().cast("array<struct<_document:string,bit:int>>")), lambda d: d["bit"].bitwiseAND(-F.col("_best.order")) != 0)
    status = F.when(F.col("_n").isNull(), "definition_change").when(F.col("_best").isNull(), "unresolved_candidates").otherwise("proven_minimum_group_set")
    documents_of = F.when(F.col("_best").isNull(), F.array().cast("array<string>")).otherwise(F.transform(used, lambda d: d["_document"]))
    return found.select(*keys, status.alias("status"), documents_of.alias("documents"))
