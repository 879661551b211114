"""The ledger's jobs on Structured Streaming."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ledgerloom.operators.compare import restate
from ledgerloom.operators.usage import KEY
from ledgerloom.plans.lineage import cut, discard
from ledgerloom.sources.activity import content_digest, with_positions


#: State on disk with a log of changes, so that a commit writes what changed and not the whole state.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: Every so many micro-batches the totals of all keys are written together.
COMPACT = 10
#: Groups of identifiers that share one entry of state; fixed, because the state of a stream outlives its micro-batches.
BUCKETS = 65_536


def start_with_state(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query with its state in RocksDB; the session's settings are put back."""
    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        return start()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def graded(stream: DataFrame) -> DataFrame:
    """(activity_id, grade, row) of what arrives: new or conflict, each content once; exact retries give nothing.

    State is the digest of an id's admitted content, for good: no history is read. Ids share their state by ``BUCKETS``
    buckets of their hash, because Python is called, and state is read and written, once for each bucket and not for each id.
    An id that first arrives with several contents in one micro-batch is a conflict and stays open; of rows of one id in a
    micro-batch a task holds distinct contents only. The row travels as JSON, so that no value passes through a float.
    """
    columns = stream.columns

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known: dict[str, str] = dict(zip(*state.get, strict=True)) if state.exists else {}
        arrived: dict[str, dict[str, str]] = {}
        for frame in batches:
            for name, content, row in zip(frame["activity_id"], frame["content"], frame["row"], strict=True):
                arrived.setdefault(name, {}).setdefault(content, row)
        out, before = [], len(known)
        for name, rows in arrived.items():
            stored = known.get(name)
            if stored is None and len(rows) == 1:
                known[name], row = next(iter(rows.items()))
                out.append((name, "new", row))
            else:
                out += [(name, "conflict", row) for content, row in rows.items() if content != stored]
        if len(known) > before:
            state.update((list(known), list(known.values())))
        if out:
            yield pd.DataFrame(out, columns=["activity_id", "grade", "row"])

    narrow = stream.select("activity_id", content_digest(stream).alias("content"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), JSON).alias("row"))
    dealt = narrow.withColumn("bucket", F.pmod(F.xxhash64("activity_id"), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").applyInPandasWithState(admit, "activity_id string, grade string, row string", "ids array<string>, contents array<string>", "append", GroupStateTimeout.NoTimeout)


def _publish(batch: DataFrame, number: int, schema: StructType, path: str, conflicts: str) -> DataFrame:
    """Write a micro-batch's new rows with positions after those of earlier batches, and its conflicts; the new rows as written.

    How far positions went is kept in one small row for each batch, beside the rows.
    """
    spark = batch.sparkSession
    batch = cut(batch, "graded")
    rows = lambda grade: batch.filter(F.col("grade") == grade).select(F.from_json("row", schema, JSON).alias("r")).select("r.*")
    marks = f"{path.rstrip('/')}-positions"
    after = 0
    if number:
        after = spark.read.schema("last long, batch int").parquet(marks).filter(F.col("batch") < number).agg(F.max("last")).first()[0] or 0
    fresh = with_positions(rows("new"), after)
    fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")
    written = spark.read.schema(fresh.schema).parquet(f"{path}/batch={number}")
    last = written.agg(F.coalesce(F.max("_stream_position"), F.lit(after)).alias("last"))
    last.write.mode("overwrite").parquet(f"{marks}/batch={number}")
    rows("conflict").write.mode("overwrite").parquet(f"{conflicts}/batch={number}")
    discard(batch)
    return written


def stream_append(stream: DataFrame, path: str, conflicts: str, checkpoint: str) -> StreamingQuery:
    """Append arriving activities once each; conflicting ones go to a folder of their own.

    Each micro-batch writes to a folder of its own number, so one that runs again overwrites what it wrote.
    """
    schema = stream.schema

    def append(batch: DataFrame, number: int) -> None:
        _publish(batch, number, schema, path, conflicts)

    writer = graded(stream).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return start_with_state(stream.sparkSession, writer.start)


def merged_totals(spark: SparkSession, path: str, number: int, delta: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Add a micro-batch's sums to the totals so far and write them as the run of its number: keys, old_ and new_ of each sum.

    A run holds the totals of the keys that its batch touched; every ``COMPACT`` batches one holds all keys, so what is read
    is the last such run and the ones after it. The answer has touched keys only.
    """
    base = (number - 1) // COMPACT * COMPACT
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in delta.schema if f.name in keys], *[f"`{s}` decimal(38,6)" for s in sums], "run int"])
    if number:
        runs = spark.read.schema(schema).parquet(path).filter((F.col("run") >= base) & (F.col("run") < number))
    else:
        runs = spark.createDataFrame([], schema)
    latest = runs.groupBy(*keys).agg(F.max_by(F.struct(*sums), "run").alias("t")).select(*keys, *[F.col(f"t.{s}").alias(f"old_{s}") for s in sums], F.lit(True).alias("known"))
    touched = delta.groupBy(*keys).agg(*[F.sum(s).cast("decimal(38,6)").alias(s) for s in sums])
    right = latest.select(*[F.col(k).alias(f"_{k}_") for k in keys], *[f"old_{s}" for s in sums], "known")
    whole = number % COMPACT == 0
    both = touched.withColumn("touched", F.lit(True)).join(right, [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys], "full" if whole else "left")
    there = F.col("touched").isNotNull()
    named = [F.when(there, F.col(k)).otherwise(F.col(f"_{k}_")).alias(k) for k in keys]
    new = [(F.coalesce(F.col(s), F.lit(0)) + F.coalesce(f"old_{s}", F.lit(0))).cast("decimal(38,6)").alias(f"new_{s}") for s in sums]
    both = cut(both.select(*named, *[f"old_{s}" for s in sums], *new, "known", "touched"), "totals")
    both.select(*keys, *[F.col(f"new_{s}").alias(s) for s in sums]).write.mode("overwrite").parquet(f"{path}/run={number}")
    return both.filter("touched").drop("touched")


def stream_restate(
    stream: DataFrame, path: str, conflicts: str, out: str, checkpoint: str, contributions: Callable[[DataFrame], DataFrame], keys: list[str], sums: list[str], measures: dict[str, str]
) -> StreamingQuery:
    """Append like ``stream_append``, and write how each micro-batch moves a result, from its own rows and kept totals.

    ``contributions`` turns activities into rows of the keys and of ``sums``, which are added up; ``measures`` are SQL
    expressions over the sums, ratios included. Sums are combined before they meet the totals, so a key with many rows is
    no single task. Only keys that the micro-batch touches are evaluated, and no activity of an earlier batch is read. Written
    are key, measure, old and new value, the difference and whether the row was added, changed or left as it was.
    """
    schema = stream.schema

    def move(batch: DataFrame, number: int) -> None:
        fresh = _publish(batch, number, schema, path, conflicts)
        totals = merged_totals(batch.sparkSession, f"{out}-totals", number, contributions(fresh), keys, sums)
        of = lambda side: totals.select(*keys, "known", *[F.col(f"{side}_{s}").alias(s) for s in sums]).select(
            *keys, "known", *[F.expr(text).cast("decimal(38,12)").alias(name) for name, text in measures.items()]
        )
        old = of("old").filter("known").drop("known")
        moved = restate(old, of("new").drop("known"), keys, list(measures))
        moved.filter("change <> 'unchanged'").write.mode("overwrite").parquet(f"{out}/batch={number}")
        discard(totals)

    writer = graded(stream).writeStream.foreachBatch(move).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return start_with_state(stream.sparkSession, writer.start)


def stream_counter_growth(readings: DataFrame, start: dt.datetime, late: str = "1 day") -> DataFrame:
    """Growth of cumulative counters while their readings arrive, as ``usage_intervals`` finds it over stored ones.

    Readings wait in the state of their session's counter until the watermark, ``late`` behind the newest reading, has passed
    them; a timer then hands them on in order of time and line, so one that arrives late but in time is counted where it
    belongs. State is the last reading handed on, and those that wait. Readings behind the watermark are dropped by Spark.
    """
    shape = "account string, source string, scope_id string, token_kind string, ts timestamp, source_line long, quantity long, previous long, status string, growth long"
    held = "seen boolean, last_ts long, last_quantity string, ts array<long>, line array<string>, quantity array<string>"
    floor = int(start.timestamp() * 1_000_000)

    def grow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last_ts, last_quantity, *waiting = state.get if state.exists else (False, 0, None, [], [], [])
        rows = [(int(t), None if x is None else int(x), None if q is None else int(q)) for t, x, q in zip(*waiting, strict=True)]
        last = None if last_quantity is None else int(last_quantity)
        for frame in batches:
            whole = lambda v: None if v is None else int(v)
            rows += [(int(t), whole(x), whole(q)) for t, x, q in zip(frame["micros"], frame["source_line"], frame["quantity"], strict=True)]
        edge = state.getCurrentWatermarkMs() * 1000
        rows.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        done = [r for r in rows if r[0] < edge]
        rows = rows[len(done) :]
        out = []
        for ts, line, quantity in done:
            status = (
                "opening_balance" if not seen else "crosses_window_boundary" if last_ts < floor
                else "missing_counter" if quantity is None or last is None else "counter_reset" if quantity < last else "observed"
            )
            if ts >= floor:
                out.append((*key, pd.Timestamp(ts, unit="us"), line, quantity, last if seen else None, status, quantity - last if status == "observed" else None))
            seen, last_ts, last = True, ts, quantity
        text = lambda v: None if v is None else str(v)
        state.update((seen, last_ts, text(last), [r[0] for r in rows], [text(r[1]) for r in rows], [text(r[2]) for r in rows]))
        if rows:
            state.setTimeoutTimestamp(max(rows[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(out, columns=[*KEY, "ts", "source_line", "quantity", "previous", "status", "growth"], dtype=object)
        yield frame.astype(dict.fromkeys(("source_line", "quantity", "previous", "growth"), "Int64") | {"ts": "datetime64[ns]"})

    # Numbers travel as text: pandas would turn a column with nulls into floats, which don't hold every long.
    rows = readings.filter("temporality = 'cumulative'").withWatermark("ts", late)
    rows = rows.select(*KEY, "ts", F.unix_micros("ts").alias("micros"), F.col("source_line").cast("string").alias("source_line"), F.col("quantity").cast("string").alias("quantity"))
    return rows.groupBy(*KEY).applyInPandasWithState(grow, shape, held, "append", GroupStateTimeout.EventTimeTimeout)


def month_usage(stream: DataFrame, late: str = "40 days", width: str = "30 days") -> DataFrame:
    """Tokens by model and tumbling window, final once the watermark has passed the window."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "model").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "model", "tokens", "n")


def split_late(stream: DataFrame, close: dt.datetime, on_time: Callable[[DataFrame], None], late: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Hand rows of the closed period that were recorded after the close to ``late``, the others to ``on_time``."""

    def split(batch: DataFrame, number: int) -> None:
        is_late = (F.col("ts") < F.lit(close)) & (F.col("_recorded_at") >= F.lit(close))
        late(batch.filter(is_late))
        on_time(batch.filter(~is_late))

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
