"""Captured source files: numbered lines with what became of them, and the account of a ledger against its captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.plans.lineage import cut, parts
from ledgerloom.sources.admission import inventory, validate_activity

EVENT = "struct<activity_id:string,ts:timestamp,customer:string,anonymous_customer_id:string,activity:string,feature_json:map<string,string>,revenue_impact:string,link:string>"
CORE = ["ts", "customer", "anonymous_customer_id", "activity", "feature_json", "revenue_impact", "link"]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, observation (the line's number in its file, from 1) and value.

    A file may be read in several splits, each of them by one task in order. Lines are written with their split and their
    order in the task; a line's number is its place among the split's lines and the lines of the splits before.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    raw = cut(raw, "lines")
    splits = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    splits = splits.withColumn("skipped", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = raw.join(F.broadcast(splits), ["file", "block"])  # by key, all lines of a split would meet in one task
    return numbered.select("file", (F.col("at") - F.col("first") + F.col("skipped") + 1).alias("observation"), "value")


def event_digest(rows: DataFrame) -> Column:
    """The digest of an activity's content: payloads by their sorted fields, money with two decimals, times in microseconds."""
    given = F.from_json("feature_json", "map<string,string>")
    features = F.to_json(F.array_sort(F.map_entries(given)), {"ignoreNullFields": "false"})
    parts = {"ts": F.unix_micros("ts"), "feature_json": features, "revenue_impact": F.col("revenue_impact").cast("decimal(18,2)")}
    texts = [parts.get(c, F.col(c)).cast("string") for c in CORE]
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def read_capture(spark: SparkSession, path: str, source: str, checked: bool = True) -> DataFrame:
    """A capture's observations with status accepted, duplicate, conflict or rejected, and why a line was rejected.

    A line is JSON with an event and the time of its arrival. Lines that don't parse, events that arrive before they happen,
    and, if ``checked``, payloads that break the catalogue are rejected and keep their text and their number.
    """
    lines = numbered_lines(spark, path)
    parsed = F.from_json("value", f"struct<event:{EVENT},recorded_at:timestamp>")
    rows = lines.withColumn("p", parsed).select("file", "observation", "value", "p.event.*", F.col("p.recorded_at").alias("_recorded_at"))
    payload = F.get_json_object("value", "$.event.feature_json")
    rows = rows.withColumns({"feature_json": payload, "revenue_impact": F.col("revenue_impact").try_cast("decimal(18,2)")})
    unread = F.col("activity_id").isNull() | F.col("ts").isNull() | F.col("activity").isNull() | F.col("_recorded_at").isNull() | payload.isNull()
    rows = validate_activity(rows) if checked else rows.withColumn("errors", F.array().cast("array<string>"))
    error = F.when(unread, "unreadable").when(F.col("_recorded_at") < F.col("ts"), "arrival precedes economic time").when(F.size("errors") > 0, F.array_join("errors", "; "))
    rows = cut(rows.withColumns({"error": error, "event_sha256": event_digest(rows), "_source": F.lit(source)}).drop("errors"), "capture")
    # Observations of several files of one source are one sequence, file by file.
    n = parts(rows)
    seen = rows.select(F.struct("file", "observation").alias("observation"), "activity_id", F.struct("event_sha256", "_recorded_at").alias("content"), F.col("error").isNull().alias("sound"))
    status = inventory(seen.repartition(n, "activity_id")).select("observation.file", "observation.observation", "status")
    return rows.repartition(n, "file", "observation").join(status.repartition(n, "file", "observation"), ["file", "observation"])


def reconcile_captures(act: DataFrame, observations: DataFrame, coverage: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """(exceptions, totals) of a ledger's activities of [start, end) against the captures of their sources.

    ``coverage`` has a row for each capture: source, coverage_start, coverage_end and the position that the ledger had before
    anything of it was ingested. Exceptions are (kind, source, activity_id, observation): a missing population, partial
    coverage, rejected and conflicting observations, missing, unexpected and altered activities, altered arrivals, and
    activities that were in the ledger before their capture. Totals are counts and recognised cents of both sides by source,
    month and activity. All comparisons of rows are one full join.
    """
    inside = lambda c: (F.col(c) >= F.lit(start).cast("timestamp")) & (F.col(c) < F.lit(end).cast("timestamp"))
    none = F.lit(None)
    exception = lambda rows, kind, source, activity_id, number: rows.select(
        F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), source.alias("source"), activity_id.alias("activity_id"), number.cast("long").alias("observation")
    )
    populations = coverage.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    partial = coverage.filter((F.col("coverage_start") > F.lit(start)) | (F.col("coverage_end") < F.lit(end)))
    faulty = observations.filter("status IN ('rejected', 'conflict')")
    ours = act.filter(inside("ts")).select(
        "activity_id", F.col("_source").alias("our_source"), event_digest(act).alias("our_digest"), F.col("_recorded_at").alias("our_arrival"), "_stream_position",
        F.date_format("ts", "yyyy-MM").alias("our_month"), F.col("activity").alias("our_kind"), (F.coalesce("revenue_impact", F.lit(0)) * 100).cast("long").alias("our_cents"),
    )
    theirs = observations.filter("status = 'accepted'").filter(inside("ts")).select(
        "activity_id", F.col("_source").alias("source"), "event_sha256", F.col("_recorded_at").alias("arrival"), F.date_format("ts", "yyyy-MM").alias("month"), F.col("activity").alias("kind"),
        (F.coalesce("revenue_impact", F.lit(0)) * 100).cast("long").alias("cents"), F.lit(True).alias("expected"),
    ).join(F.broadcast(coverage.select("source", F.col("pre_ingestion_watermark").alias("mark"))), "source", "left")
    both = cut(ours.withColumn("actual", F.lit(True)).join(theirs, "activity_id", "full"), "captured")
    pair = F.col("actual").isNotNull() & F.col("expected").isNotNull()
    kinds = F.array_compact(F.array(
        F.when(F.col("actual").isNull(), "missing_activity"), F.when(F.col("expected").isNull(), "unexpected_activity"),
        F.when(pair & ((F.col("our_source") != F.col("source")) | (F.col("our_digest") != F.col("event_sha256"))), "altered_activity"),
        F.when(pair & (F.col("our_arrival") != F.col("arrival")), "altered_arrival"), F.when(pair & (F.col("_stream_position") <= F.col("mark")), "not_pre_ingestion_evidence"),
    ))
    source = F.coalesce("source", "our_source")
    exceptions = both.select(F.explode(kinds).alias("kind"), source.alias("source"), "activity_id", none.cast("long").alias("observation"))
    exceptions = exceptions.unionByName(exception(faulty, F.col("status"), F.col("_source"), F.col("activity_id"), F.col("observation")))
    exceptions = exceptions.unionByName(exception(partial, "partial_source_coverage", F.col("source"), none.cast("string"), none)).unionByName(exception(populations, "missing_source_population", none.cast("string"), none.cast("string"), none))
    sides = both.select(F.inline(F.array_compact(F.array(
        F.when(F.col("expected"), F.struct(F.col("source"), F.col("month"), F.col("kind").alias("activity"), F.lit(1).alias("e"), F.col("cents").alias("ec"), F.lit(0).alias("a"), F.lit(0).cast("long").alias("ac"))),
        F.when(F.col("actual"), F.struct(F.col("our_source").alias("source"), F.col("our_month").alias("month"), F.col("our_kind").alias("activity"), F.lit(0).alias("e"), F.lit(0).cast("long").alias("ec"), F.lit(1).alias("a"), F.col("our_cents").alias("ac"))),
    ))))
    totals = sides.groupBy("source", "month", "activity").agg(F.sum("e").alias("expected_count"), F.sum("a").alias("actual_count"), F.sum("ec").alias("expected_cents"), F.sum("ac").alias("actual_cents"))
    return exceptions, totals
