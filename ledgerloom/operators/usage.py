"""Usage counters: typed readings, growth between them, and what is missing."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.context import typed
from ledgerloom.plans.lineage import cut, discard

KEY = ["account", "source", "scope_id", "token_kind"]
#: Fixed value: an inventory's readings count as stale after so many days without an import.
STALE_DAYS = 7


def usage_observations(snap: DataFrame, source: str) -> DataFrame:
    """Readings of one counter source as typed rows; the line number is the third part of the observation's name."""
    fields = {name: "string" for name in ("source", "scope_id", "token_kind", "temporality", "observation_id", "model")} | {"quantity": "long", "revision": "int"}
    rows = typed(snap.withColumn("_source", F.col("_recorded_at")), ["usage_observed"], fields).withColumnsRenamed({"customer": "account", "_source": "_recorded_at"})
    line = F.split_part("observation_id", F.lit(":"), F.lit(3)).try_cast("long").alias("source_line")
    return rows.filter(F.col("source") == source).select("activity_id", "account", "ts", "_recorded_at", *KEY[1:], "temporality", "quantity", "model", "revision", line)


def usage_intervals(observations: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Consecutive cumulative readings of each session's counters with status and growth.

    A first reading inside the window is an opening balance, a step over the window's start is set apart, a missing
    reading on either side leaves the step unknown, and a smaller reading is a reset. Steps up to the window's end count.
    """
    order = Window.partitionBy(*KEY).orderBy("ts", "source_line")
    rows = observations.filter((F.col("temporality") == "cumulative") & (F.col("ts") < F.lit(end)))
    rows = rows.withColumns({"previous": F.lag("quantity").over(order), "previous_ts": F.lag("ts").over(order)}).filter(F.col("ts") >= F.lit(start))
    status = (
        F.when(F.col("previous_ts").isNull(), "opening_balance").when(F.col("previous_ts") < F.lit(start), "crosses_window_boundary")
        .when(F.col("quantity").isNull() | F.col("previous").isNull(), "missing_counter").when(F.col("quantity") < F.col("previous"), "counter_reset").otherwise("observed")
    )
    return rows.withColumn("status", status).withColumn("growth", F.when(F.col("status") == "observed", F.col("quantity") - F.col("previous")))


def usage_tokens(intervals: DataFrame) -> DataFrame:
    """Growth of each session's counters over the window; unknown if any step was reset or missing."""
    count = lambda *kinds: F.count(F.when(F.col("status").isin(*kinds), 1))
    status = (
        F.when(count("counter_reset") > 0, "counter_reset_unknown").when(count("missing_counter") > 0, "missing_counter_unknown")
        .when(F.count("growth") == 0, "insufficient_observations").otherwise("partial_observed")
    )
    return intervals.groupBy(*KEY).agg(
        F.min("ts").alias("first_observed_at"), F.max("ts").alias("last_observed_at"),
        F.when(count("counter_reset", "missing_counter") == 0, F.sum("growth")).alias("observed_tokens"), F.count(F.lit(1)).alias("observations"),
        count("observed").alias("measured_intervals"), (F.count(F.lit(1)) - count("observed")).alias("excluded_intervals"), status.alias("status"),
    )


#: What a gap asks for.
OBSERVE = "Observe remaining sessions; retain unknown opening, boundary and tail intervals"
COLLECT = "Collect a permitted usage source for this confirmed surface"
TOTALS = "Account-wide coverage and cross-session lineage are unresolved; do not sum session counters"
CHARGES = "Import an actual charge source; subscription fees and costs are not inferred from tokens"
INSPECT = "Last-counter diagnostics do not reconcile and are excluded from usage totals; inspect the retained source"
GAP = ["account", "provider", "surface", "scope", "gap", "verified_at", "latest_observed_at", "next_action", "status"]


def usage_gaps(
    snap: DataFrame, observations: DataFrame, start: dt.datetime, end: dt.datetime, known_at: dt.datetime, source: str, local: tuple[str, str] = ("vendor", "cli"), version: int = 2
) -> DataFrame:
    """What usage is not covered, one row a gap, with what to do about it.

    Every surface of an account's latest inventory is partial, stale or unavailable; totals and charges of an account are
    always open; imports of ``source`` in quarantine are listed; version 2 adds sessions whose last interval readings don't
    add up. ``local`` names the provider and surface that ``source`` covers.
    """
    inside = (F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end))
    at = lambda value, name: (F.lit(value) if isinstance(value, str) else value).alias(name)
    never = F.lit(None).cast("timestamp")
    provider, surface = local

    def gap(rows: DataFrame, *values: Column | str) -> DataFrame:
        return rows.select(*[at(value, name) for value, name in zip(values, GAP, strict=True)])

    listed = typed(snap, ["application_inventory"], {"provider": "string", "surface": "string", "scope": "string"})
    last = F.max_by(F.struct("provider", "scope", "ts"), F.struct("ts", "activity_id")).alias("last")
    latest = listed.groupBy(F.col("customer").alias("account"), "surface").agg(last).select("account", "surface", "last.*")
    seen = observations.filter(inside).groupBy("account").agg(F.max("ts").alias("seen_at"), F.max("_recorded_at").alias("imported_at"))
    covered = (F.col("surface") == surface) & F.col("imported_at").isNotNull()
    old = F.col("imported_at") < F.lit(known_at - dt.timedelta(days=STALE_DAYS))
    status = F.when(~covered, "unavailable").when(old, "stale").otherwise("partial")
    todo = F.when(covered, OBSERVE).otherwise(COLLECT)
    surfaces = gap(latest.join(seen, "account", "left"), *(F.col(c) for c in ("account", "provider", "surface", "scope")), "surface_coverage", F.col("ts"), F.col("seen_at"), todo, status)
    accounts, who = latest.select("account", "provider").distinct(), (F.col("account"), F.col("provider"))
    open_ones = [
        gap(accounts, *who, "all", scope, name, never, never, action, "unavailable")
        for scope, name, action in (("account", "account_total", TOTALS), ("billing", "billed_charges", CHARGES))
    ]
    fields = dict.fromkeys(("source", "scope_id", "reason", "next_action"), "string") | {"interval_start": "timestamp", "interval_end": "timestamp"}
    held = typed(snap.filter(F.col("link").startswith("evidence:failures/")).withColumn("_source", F.col("_recorded_at")), ["usage_coverage"], fields)
    held = held.filter((F.col("source") == source) & (F.col("interval_start") < F.lit(end)) & (F.col("interval_end") > F.lit(start)))
    why = F.concat("reason", F.lit(". "), "next_action")
    parts = [surfaces, *open_ones, gap(held, F.col("customer"), provider, surface, F.col("scope_id"), "quarantined_source", F.col("_source"), never, why, "quarantined")]
    if version >= 2:
        off = counter_residuals(observations.filter(inside)).groupBy("account", "scope_id").agg(F.max("_recorded_at").alias("imported_at"), F.max("ts").alias("seen_at"))
        parts.append(gap(off, F.col("account"), provider, surface, F.col("scope_id"), "last_counter_reconciliation", F.col("imported_at"), F.col("seen_at"), INSPECT, "diagnostic_mismatch"))
    return reduce(DataFrame.unionByName, parts)


def counter_residuals(observations: DataFrame) -> DataFrame:
    """Interval readings whose total isn't input plus output, one row per session, time and line."""
    of = lambda kind: F.max(F.when(F.col("token_kind") == kind, F.col("quantity"))).alias(kind)
    rows = observations.filter("temporality = 'interval_total'").groupBy("account", "scope_id", "ts", "source_line").agg(of("total"), of("input"), of("output"), F.max("_recorded_at").alias("_recorded_at"))
    return rows.filter("total <> input + output").withColumn("residual", F.expr("total - input - output"))


def locator_scores(packets: DataFrame, found: DataFrame, truth: DataFrame) -> DataFrame:
    """How well ``found`` locates the findings of ``truth``: counts for the development and the held-out part.

    All three have scope_id and source_line; found and truth also a residual. A packet is held out if the SHA-256 of
    "scope_id:source_line", read as a number, divides by three; since 16 leaves 1 when divided by 3, that is the sum of
    its hexadecimal digits, taken fifteen at a time.
    """
    key = ["scope_id", "source_line"]
    digest = F.sha2(F.concat_ws(":", *key), 256)
    digits = reduce(lambda x, y: x + y, [F.conv(F.substring(digest, k, 15), 16, 10).cast("long") % 3 for k in range(1, 65, 15)])
    rows = packets.select(*key).distinct().withColumn("part", F.when(digits % 3 == 0, "held_out").otherwise("development"))
    rows = rows.join(truth.select(*key, F.lit(True).alias("wanted"), F.col("residual").alias("right")), key, "left")
    rows = rows.join(found.select(*key, F.lit(True).alias("located"), F.col("residual").alias("given")), key, "left")
    count = lambda condition: F.count(F.when(condition, 1))
    wanted, located = F.col("wanted").isNotNull(), F.col("located").isNotNull()
    return rows.groupBy("part").agg(
        F.count(F.lit(1)).alias("observations"), count(wanted).alias("expected_findings"), count(located).alias("located_findings"), count(located & ~wanted).alias("false_positives"),
        count(wanted & ~located).alias("missed_findings"), count(wanted & located & ~F.col("right").eqNullSafe(F.col("given"))).alias("incorrect_values"),
    )


def usage_readiness(activities: DataFrame) -> DataFrame:
    """How many activities of each kind a report can draw on."""
    return activities.groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


#: The counters of a packet and what they are called once admitted, and the parts of a counter.
COUNTERS = {"cumulative": "cumulative", "last": "interval_total"}
PARTS = ["input", "cache_read", "output", "reasoning_output", "total"]
SESSION = r"^[A-Za-z0-9._-]{1,128}$"
OBSERVED = ["account", "session", "line"]


def read_packets(packets: DataFrame) -> DataFrame:
    """The rows of packets with ``readings``, an entry for each part of each counter given, and ``reasons`` of their own.

    Rows are (packet, account, collected_at, session, line, observed_at, counters): counters is JSON with one or both of two
    counters, each with some of five parts, null or a whole number.
    """
    rows = packets.withColumn("c", F.from_json("counters", "map<string,map<string,string>>"))
    value = lambda kind, part: F.try_element_at(F.try_element_at("c", F.lit(kind)), F.lit(part))
    number = lambda kind, part: value(kind, part).try_cast("decimal(38,0)")
    names = lambda values: F.array(*[F.lit(v) for v in values])
    given = [F.when(F.map_contains_key("c", kind), F.array(*[F.struct(F.lit(mode).alias("temporality"), F.lit(part).alias("token_kind"), value(kind, part).try_cast("long").alias("quantity")) for part in PARTS])) for kind, mode in COUNTERS.items()]
    texts = F.flatten(F.transform(F.map_values("c"), F.map_values))
    bad_number = F.exists(texts, lambda v: v.isNotNull() & (~v.rlike("^[0-9]{1,19}$") | v.try_cast("long").isNull()))
    undeclared = (F.size(F.array_except(F.map_keys("c"), names(COUNTERS))) > 0) | F.exists(F.map_values("c"), lambda m: m.isNull() | (F.size(F.array_except(F.map_keys(m), names(PARTS))) > 0))
    above = [number(kind, part) > number(kind, whole) for kind in COUNTERS for part, whole in (("cache_read", "input"), ("reasoning_output", "output"))]
    rules = {
        "identity": F.col("account").isNull() | ~F.coalesce(F.col("session").rlike(SESSION), F.lit(False)) | ~F.coalesce(F.col("line").between(1, 10**12 - 1), F.lit(False)),
        "observed after collection": F.coalesce(F.col("observed_at") > F.col("collected_at"), F.lit(True)),
        "no counter": F.col("c").isNull() | (F.size("c") == 0), "undeclared field": undeclared, "quantity": bad_number,
        "total": number("cumulative", "total") != number("cumulative", "input") + number("cumulative", "output"), "part above whole": reduce(lambda x, y: F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False)), above),
    }
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))
    rows = rows.withColumns({"readings": F.flatten(F.array_compact(F.array(*given))), "reasons": reasons}).drop("c", "counters")
    return rows.withColumn("content", F.sha2(F.to_json(F.struct("observed_at", "readings"), {"ignoreNullFields": "false"}), 256))


def admit_usage(packets: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counter packets as (admitted observations, quarantined packets with their reasons); a packet is admitted whole or not at all.

    Beside the rules of ``read_packets``, a packet is quarantined if it says different things about one line, if a line was
    observed before the latest of the lines before it in its session, if it names a session of another account, or if it
    contradicts a stored observation. Of packets that contradict each other the first by time of collection is admitted. A
    quarantined packet contradicts nobody: packets are settled in rounds, each of which admits those that no earlier one that
    is still in contradicts and refuses those that an admitted one does, so a chain of contradictions takes rounds, not pairs. An exact retry adds nothing, and the first
    packet keeps the provenance of an observation. ``stored`` has the columns of admitted observations.
    """
    rows = read_packets(packets)
    line = Window.partitionBy("packet", *OBSERVED)
    earlier = Window.partitionBy("packet", "account", "session").orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"variants": F.size(F.collect_set("content").over(line)), "before": F.max("observed_at").over(earlier)})
    known = stored.groupBy(*OBSERVED).agg(F.first("content").alias("known"), F.min("account").alias("_"))
    owner = stored.groupBy("session").agg(F.min("account").alias("owner"))
    rows = rows.join(known.drop("_"), OBSERVED, "left").join(owner, "session", "left")
    more = {
        "conflicting lines": F.col("variants") > 1, "session order": F.col("observed_at") < F.col("before"), "session of another account": F.col("owner") != F.col("account"),
        "contradicts a stored observation": F.col("known") != F.col("content"),
    }
    reasons = F.concat("reasons", F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in more.items()])))
    rows = cut(rows.withColumn("reasons", reasons).drop("variants", "before", "owner"), "packets")
    refused = rows.filter(F.size("reasons") > 0).select("packet", F.explode("reasons").alias("reason"))
    state = rows.groupBy("packet").agg(F.max(F.size("reasons")).alias("n"), F.max("collected_at").alias("collected"))
    state = cut(state.select("packet", "collected", F.when(F.col("n") > 0, "refused").otherwise("open").alias("state")), "packet-states")
    contents = cut(rows.filter(F.size("reasons") == 0).select("packet", *OBSERVED, "content").distinct(), "packet-lines")
    earlier = Window.partitionBy(*OBSERVED).orderBy("collected", "packet").rowsBetween(Window.unboundedPreceding, -1)
    while not state.filter("state = 'open'").isEmpty():
        held = F.max(F.when(F.col("state") == "admitted", F.col("content"))).over(Window.partitionBy(*OBSERVED))
        live = contents.join(state.filter("state <> 'refused'"), "packet").withColumns({"least": F.min("content").over(earlier), "most": F.max("content").over(earlier), "held": held})
        differs = F.coalesce((F.col("least") != F.col("content")) | (F.col("most") != F.col("content")), F.lit(False))
        refuted = F.coalesce(F.col("held") != F.col("content"), F.lit(False))
        verdict = live.groupBy("packet").agg(F.max(differs).alias("off"), F.max(refuted).alias("lost"))
        settled = F.when((F.col("state") == "open") & F.col("lost"), "refused").when((F.col("state") == "open") & ~F.col("off"), "admitted").otherwise(F.col("state"))
        newer = cut(state.join(verdict, "packet", "left").select("packet", "collected", settled.alias("state")), "packet-states")
        discard(state)
        state = newer
    lost = state.filter("state = 'refused'").join(refused.select("packet").distinct(), "packet", "left_anti").select("packet", F.lit("contradicts an earlier packet").alias("reason"))
    quarantined = refused.unionByName(lost).groupBy("packet").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    fresh = rows.filter("known IS NULL").join(state.filter("state = 'admitted'"), "packet")
    packet = F.min_by(F.struct("packet", "collected_at", "observed_at", "readings", "content"), F.struct("collected", "packet")).alias("p")
    admitted = fresh.groupBy(*OBSERVED).agg(packet).select(*OBSERVED, "p.packet", "p.collected_at", "p.observed_at", "p.content", F.inline("p.readings"))
    return admitted, quarantined


def usage_activities(admitted: DataFrame, source: str) -> DataFrame:
    """Admitted observations as activities of the usage stream."""
    observation = F.concat_ws(":", "session", F.lpad(F.col("line").cast("string"), 12, "0"), "temporality", "token_kind")
    name = F.concat_ws(":", F.lit("o"), "session", F.col("line").cast("string"), "temporality", "token_kind")
    features = F.struct(F.lit(None).cast("string").alias("model"), name.alias("observation_id"), "quantity", F.lit(0).alias("revision"), F.col("session").alias("scope_id"), F.lit(source).alias("source"), "temporality", "token_kind")
    return admitted.select(
        F.concat(F.lit("usage:"), F.sha2(F.concat_ws("|", "account", observation), 256)).alias("activity_id"), F.col("observed_at").alias("ts"), F.col("account").alias("customer"),
        F.lit("usage_observed").alias("activity"), F.to_json(features, {"ignoreNullFields": "false"}).alias("feature_json"), F.concat(F.lit("evidence:imports/"), "packet").alias("link"),
        F.col("collected_at").alias("_recorded_at"), F.lit("dev").alias("_lane"), F.lit("counters").alias("_source"),
    )
