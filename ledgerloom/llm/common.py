"""Helpers shared by the training-data operators."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.lineage import cut as materialise
from ledgerloom.plans.lineage import discard, scratch_path, scratch_root

__all__ = ["SPACE_CLASS", "block_count", "discard", "materialise", "read_table", "scratch_path", "scratch_root", "ship_package", "text_of", "training_hash", "whole_groups"]

#: Fixed value: the ASCII white space that separates words in every contract of this subpackage.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path that only Spark needs to be able to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text with null counted as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def training_hash(doc_id: Column) -> Column:
    """crc32 of the decimal text of an id, as the fold rules use it."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def ship_package(spark: SparkSession) -> None:
    """Send this package's Python files to the executors, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_ledgerloom_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    folder = tempfile.mkdtemp(prefix="ledgerloom-")
    path = os.path.join(folder, "ledgerloom.zip")
    Path(path).write_bytes(buffer.getvalue())
    context.addPyFile(path)
    context._ledgerloom_shipped = True


def block_count(docs: DataFrame, bytes_per_block: int) -> int:
    """Number of blocks that keeps the text of one block near the given size; grows with the data."""
    total = docs.agg(F.sum(F.octet_length(text_of())).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // bytes_per_block))


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames that hold whole groups, from batches sorted by the key of the group."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        if not len(batch):
            continue
        held = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        done = held[key].ne(held[key].iloc[-1]).to_numpy()
        rest = held[~done].reset_index(drop=True)
        if done.any():
            yield held[done].reset_index(drop=True)
    if rest is not None:
        yield rest
