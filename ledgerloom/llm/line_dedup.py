"""Removal of lines that many documents share, with levelled sorted runs of line hashes.

The key of a line is the line without white space at both ends and in lower case (A-Z). Keys of at least ``min_chars``
code points that stand in at least ``min_docs`` documents are repeated: the document with the largest identifier keeps
its lines of that key, all others lose them.

``LineRuns`` holds what is known of keys: runs, each sorted by hash and dealt to the same buckets, with the number of
documents and the largest identifier. A batch of documents comes in as (identifier, hash). Its keys are combined, keys
that a run already knows to be repeated, by a document no smaller, are taken off by a merge anti-join with that run, and
the rest becomes a run of the lowest level. ``fanout`` runs of one level are compacted into one of the next, so there are
logarithmically many. Documents are dealt to ``batches`` batches by falling identifier, so a passage of a third of all
documents is written by few batches and taken off in all others.

Verdicts return to the documents by hash, in a sort-merge join that Spark splits where one hash has very many lines; a
document's places to drop are gathered for each row of the table, and are bounded by that row's own lines.

Only built-in expressions run on the executors. Equality of keys rests on 128 bits of their SHA-256.

Defined results: null or empty text is one empty line; rows of one identifier count as documents of their own, and all of
those with the largest identifier keep the line; null is the smallest identifier; a line repeated within a document
counts once and is dropped or kept everywhere in it; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, scratch_path
from ledgerloom.plans.lineage import delete_path

MIN_CHARS, MIN_DOCS = 40, 5
BATCHES, FANOUT = 6, 3
HASHES_PER_BUCKET = 2_000_000
#: Fixed value: the white space that is stripped from both ends of a line.
STRIPPED = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "hash binary, docs long, last long"


def line_hash(line: Column, min_chars: int) -> Column:
    """The first 128 bits of the SHA-256 of a line's key; null for keys that are too short."""
    key = F.btrim(line, F.lit(STRIPPED))
    return F.when(F.char_length(key) >= min_chars, F.unhex(F.substring(F.sha2(key, 256), 1, 32)))


class LineRuns:
    """Levelled sorted runs of line hashes, as bucketed tables in the shared folder.

    ``buckets`` is fixed when the runs are made. ``drop`` deletes the tables.
    """

    def __init__(self, spark: SparkSession, buckets: int, min_docs: int = MIN_DOCS, fanout: int = FANOUT) -> None:
        self.spark, self.buckets, self.min_docs, self.fanout = spark, buckets, min_docs, fanout
        self.name, self.made = f"line_runs_{uuid.uuid4().hex}", 0
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        """A run: one sorted file for each bucket."""
        table, self.made = f"{self.name}_{self.made}", self.made + 1
        writer = rows.repartition(self.buckets, "hash").sortWithinPartitions("hash").write.format("parquet")
        self.paths[table] = scratch_path(self.spark, table)
        writer.option("compression", "zstd").option("path", self.paths[table]).bucketBy(self.buckets, "hash").sortBy("hash").saveAsTable(table)
        return table

    def _forget(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE {table}")
        delete_path(self.spark, self.paths.pop(table))

    def tables(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def add(self, batch: DataFrame) -> None:
        """Take a batch (doc_id, hash), each hash once a document."""
        own = batch.groupBy("hash").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))
        for table in self.tables():
            known = self.spark.table(table).filter(F.col("docs") >= self.min_docs).select("hash", F.col("last").alias("known_last"))
            own = own.join(known.hint("merge"), (own["hash"] == known["hash"]) & (own["last"] <= known["known_last"]), "left_anti")
        self._place(self._write(own), 0)

    def _place(self, table: str, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        runs = self.levels[level]
        runs.append(table)
        if len(runs) == self.fanout:
            merged = self._write(self._merged(runs))
            for old in runs:
                self._forget(old)
            self.levels[level] = []
            self._place(merged, level + 1)

    def _merged(self, tables: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame([], RUN)
        for table in tables:
            rows = rows.union(self.spark.table(table).select("hash", "docs", "last"))
        return rows.groupBy("hash").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def repeated(self) -> DataFrame:
        """hash, docs (a lower bound once it reaches ``min_docs``) and last of the keys in at least ``min_docs`` documents."""
        return self._merged(self.tables()).filter(F.col("docs") >= self.min_docs)

    def drop(self) -> None:
        for table in self.tables():
            self._forget(table)
        self.levels = []


def clean_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """One row per row of the documents: doc_id, n_lines, n_dropped, kept (the lines left, joined by line ends)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    hashes = F.transform(F.split(F.translate(text, UPPER, LOWER), "\n"), lambda line: line_hash(line, min_chars))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = chosen.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.split(text, "\n").alias("lines"), hashes.alias("hashes"))
    rows = materialise(rows, "line-rows")
    there = F.filter("hashes", lambda h: h.isNotNull())
    shares = F.array(*[F.lit(k / batches) for k in range(1, batches + 1)])
    seen = rows.agg(F.sum(F.size(there)).alias("n"), F.percentile_approx("doc_id", shares, 1000).alias("ids")).first()
    # Batches by falling identifier; the last takes what is left, null too.
    runs = LineRuns(spark, max(8, -(-(seen["n"] or 0) // HASHES_PER_BUCKET)), min_docs, fanout)
    keys = rows.select("doc_id", F.explode(F.array_distinct(there)).alias("hash"))
    edges = sorted(set((seen["ids"] or [])[:-1]), reverse=True)
    for k in range(len(edges) + 1):
        part = keys if k == len(edges) else keys.filter(F.col("doc_id") > edges[k])
        if k:
            below = F.col("doc_id") <= edges[k - 1]
            part = part.filter(below if k < len(edges) else below | F.col("doc_id").isNull())
        runs.add(part)
    repeated = materialise(runs.repeated().select("hash", "last"), "line-repeated")
    runs.drop()
    places = rows.select("row", "doc_id", F.posexplode("hashes").alias("place", "hash")).filter("hash IS NOT NULL")
    lost = places.join(repeated.hint("merge"), "hash").filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    gone = lost.groupBy("row").agg(F.collect_list("place").alias("gone"))
    whole = rows.select("row", "doc_id", "lines").join(gone, "row", "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(left, lambda k: F.get(F.col("lines"), k)))
    return whole.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept"),
    )
