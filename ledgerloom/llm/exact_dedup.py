"""Exact deduplication as a stateful stream.

Every document arrives once as a narrow row (identifier, digest, length and content locator). A Structured Streaming
aggregation keyed by digest keeps, in RocksDB and without expiry, the smallest identifier, the number of rows and the
locator (file and row) of the row that stays. A digest that was seen before is a hit, and hits are confirmed on the
full bytes: for each digest the smallest and the largest normalised text must be the same text. A bitmap of the hits'
digests, of a fixed size, keeps the texts of all others out of that comparison. Texts that share a digest but differ are
grouped again by the text itself.

With a ``state`` folder the keyed state outlives the call: a later call's documents are found to be copies of earlier
ones by the digest kept there, and the locator fetches the earlier text, so their full bytes are compared too. Documents
that are no table of files are written to the state's folder first, so that every locator leads somewhere. Of
texts of one call that share a digest the state keeps one, so a later copy of another of them is not recognised.

Only built-in expressions run on the executors. Both aggregations combine on the map side first, and the join with their
results can be split where one digest has very many rows.

Defined results: null text counts as empty; rows whose identifier is null stay only if no row with the same text has
one; of rows with the same identifier and the same text one stays; an empty table gives an empty result; further
columns, whatever their names, are carried by ``drop_copies`` and ignored by ``find_copies``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACE_CLASS, materialise, scratch_path

#: State on disk; many small stores, so none reserves space ahead and each commit writes only what changed.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(column: str = "text") -> Column:
    """The text with each run of ASCII white space replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), SPACE_CLASS, " ")


def sha256_bytes(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


LOCATOR = "concat_ws('#', _metadata.file_path, cast(_metadata.row_index as string))"

#: Bits of the map of hits: 8 MB at most, whatever the number of documents.
HIT_BITS = 1 << 26


def _located(docs: DataFrame) -> DataFrame:
    """doc_id, text and the locator (file and row), null where the documents are no table of files."""
    try:
        return docs.select("doc_id", "text", F.expr(LOCATOR).alias("locator"))
    except AnalysisException:
        return docs.select("doc_id", "text", F.lit(None).cast("string").alias("locator"))


def _of_files(docs: DataFrame) -> bool:
    try:
        return bool(docs.select(F.expr(LOCATOR)).columns)
    except AnalysisException:
        return False


def _narrow(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    text = normalised()
    rows = _located(docs)
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        digest(text).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        "locator",
        *([] if digest is sha256_bytes else [sha256_bytes(text).alias("sha")]),
    )


def digest_registry(arrivals: DataFrame, state_path: str | None = None, bytes_per_trigger: int = 1 << 30) -> tuple[DataFrame, DataFrame]:
    """Stream the arrivals through keyed state: (one row per digest with keep_id, group_size and locator, the arrivals as written).

    Each call adds its arrivals to a folder of the state; the stream's checkpoint knows which it has seen. Each
    micro-batch writes the digests it changed to a folder of its own number, so a batch that runs again after a failure
    overwrites what it wrote.
    """
    spark = arrivals.sparkSession
    root = state_path or scratch_path(spark, "exact-state")
    source, out = f"{root}/arrivals", f"{root}/registry"
    own = f"{source}/call={uuid.uuid4().hex}"
    arrivals.write.option("compression", "zstd").parquet(own)

    def publish(batch: DataFrame, number: int) -> None:
        batch.withColumn("epoch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/epoch_dir={number}")

    before = {key: spark.conf.get(key, None) for key in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        state = (
            spark.readStream.schema(arrivals.schema)
            .option("maxBytesPerTrigger", str(bytes_per_trigger))
            .parquet(source)
            .groupBy("digest")
            .agg(
                F.min("doc_id").alias("keep_id"),
                F.count(F.lit(1)).alias("group_size"),
                F.min_by("locator", "doc_id").alias("locator"),
            )
        )
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{root}/checkpoint")
            .foreachBatch(publish)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    schema = "digest binary, keep_id long, group_size long, locator string, epoch long"
    empty = spark.createDataFrame([], schema)
    mine = spark.read.schema(arrivals.schema).parquet(own)
    if state_path is None and not any(p["numInputRows"] for p in query.recentProgress):
        return empty, mine
    if mine.isEmpty():
        return empty, mine
    written = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
    latest = F.max_by(F.struct("keep_id", "group_size", "locator"), "epoch").alias("latest")
    registry = written.groupBy("digest").agg(latest).select("digest", "latest.*")
    return registry, mine


def _earlier(arrivals: DataFrame, registry: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, digest and text of the documents of earlier calls that the registry keeps for digests of this one, read by their locators."""
    spark = arrivals.sparkSession
    hits = registry.filter("group_size > 1 AND locator IS NOT NULL").join(arrivals.select("digest").distinct(), "digest", "left_semi")
    hits = hits.join(arrivals.select("locator"), "locator", "left_anti").select("locator", F.col("keep_id").alias("doc_id"))
    hits = materialise(hits, "exact-earlier")
    files = [r.file for r in hits.select(F.substring_index("locator", "#", 1).alias("file")).distinct().collect()]  # file names, no documents
    if not files:
        return spark.createDataFrame([], "doc_id long, digest binary, norm string")
    text = normalised()
    stored = _located(spark.read.parquet(*files)).join(hits.withColumnRenamed("doc_id", "keep_id"), "locator")
    return stored.select(F.col("keep_id").alias("doc_id"), digest(text).alias("digest"), text.alias("norm"))


def _confirmed(docs: DataFrame, registry: DataFrame, digest: Callable[[Column], Column], earlier: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Full-byte check of the hits: (digests whose texts differ, docs that may be hits with digest, text and whether of this call)."""
    text = normalised()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(text).alias("digest"), text.alias("norm"))
    bit = F.pmod(F.xxhash64("digest"), F.lit(HIT_BITS))
    hits = registry.filter("group_size > 1").select(bit.alias("bit"))
    bitmap = hits.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    place = F.bitmap_bit_position(bit).cast("int")
    byte = F.conv(F.hex(F.expr("substring(map, cast(__place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    keyed = keyed.withColumns({"part": F.bitmap_bucket_number(bit), "__place": place}).join(F.broadcast(bitmap), "part")
    keyed = keyed.filter(byte.bitwiseAND(F.expr("shiftleft(1, __place % 8)")) != 0).select("doc_id", "digest", "norm", F.lit(True).alias("own"))
    if earlier is not None:
        keyed = keyed.unionByName(earlier.withColumn("own", F.lit(False)))
    differing = (
        keyed.groupBy("digest")
        .agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
        .filter(F.col("low") != F.col("high"))
        .select("digest")
    )
    return differing, keyed


def find_copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256_bytes, state: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_bytes, locator of the row that stays."""
    spark = docs.sparkSession
    if state and docs.isEmpty():
        docs, state = docs.limit(0), None
    if state and not _of_files(docs):
        folder = f"{state}/texts/call={uuid.uuid4().hex}"
        docs.select("doc_id", "text").write.option("compression", "zstd").parquet(folder)
        docs = spark.read.schema(docs.select("doc_id", "text").schema).parquet(folder)
    registry, arrivals = digest_registry(_narrow(docs, digest), state)
    registry = materialise(registry, "exact-registry")
    differing, keyed = _confirmed(docs, registry, digest, _earlier(arrivals, registry, digest) if state else None)
    differing = materialise(differing, "exact-differing")
    # Rows of digests with one text: the state's answer holds.
    same = arrivals.join(differing, "digest", "left_anti").join(registry.withColumnRenamed("locator", "keep_locator"), "digest")
    keeper = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    columns = ["doc_id", "keep_id", "group_size", "kept", "digest", "n_bytes", "keep_locator", F.col("digest" if digest is sha256_bytes else "sha").alias("sha")]
    # Only rows with the identifier that stays are ordered, where it is repeated; all others of a group are not gathered.
    copy = Window.partitionBy("digest", "doc_id").orderBy("locator")
    stay = same.filter(keeper).withColumn("kept", F.row_number().over(copy) == 1).select(*columns)
    same = stay.unionByName(same.filter(~keeper).withColumn("kept", F.lit(False)).select(*columns))
    # Rows of digests that different texts share: grouped by the text.
    odd = keyed.join(differing, "digest", "left_semi")
    groups = odd.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    odd_copy = Window.partitionBy("digest", "norm", "doc_id").orderBy("doc_id")
    odd = odd.filter("own").join(groups, ["digest", "norm"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(odd_copy) == 1)).alias("kept"),
        "digest",
        F.octet_length("norm").cast("long").alias("n_bytes"),
        F.lit(None).cast("string").alias("keep_locator"),
        sha256_bytes(F.col("norm")).alias("sha"),
    )
    rows = same.unionByName(odd)
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), "n_bytes", "keep_locator")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    columns = docs.columns
    keepers = find_copies(docs).filter("kept").select(F.col("keep_id").alias("__keep_id"), F.unhex("text_sha256").alias("__keep_digest"))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
        F.col("doc_id").cast("long").alias("__id"),
        sha256_bytes(normalised()).alias("__digest"),
    )
    kept = keyed.join(keepers, F.col("__id").eqNullSafe(F.col("__keep_id")) & (F.col("__digest") == F.col("__keep_digest")))
    one = Window.partitionBy("__digest", "__id").orderBy(F.to_json("row"))
    return kept.withColumn("__n", F.row_number().over(one)).filter("__n = 1").select("row.*")
