"""Blocks of whole documents, and compact sorted key lists that travel between blocks and buckets.

Operators that look things up for nearly every position of every text do so by block: a block of some megabytes of text
sends each distinct key once, sorted and packed, to the bucket that owns the key, and gets its answers back in the same
order. So a key that stands in a third of all documents costs one entry from each block. Blocks are written once to the
shared folder; tasks hold one block, or what one bucket receives, at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, ship_package

#: Order of a null identifier: after all others, so its row never takes anything from another row.
NULL_ID = np.iinfo(np.int64).max
MAX_DOCUMENTS = 1 << 17
BLOCK_SCHEMA = "block long, ids binary, sizes binary, data binary, extra binary"


_press, _press_text, _open = zstandard.ZstdCompressor(level=1), zstandard.ZstdCompressor(level=6), zstandard.ZstdDecompressor()


def pack(data: bytes) -> bytes:
    return _press.compress(data)


def pack_text(data: bytes) -> bytes:
    return _press_text.compress(data)


def unpack(data: bytes) -> bytes:
    return _open.decompress(data)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as differences, one compressed plane for each byte."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return pack(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unpack(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_planes(values: np.ndarray) -> bytes:
    """Any fixed-width array by byte planes."""
    width = values.dtype.itemsize
    return pack(np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T).tobytes())


def unpack_planes(data: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(unpack(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


class Block:
    """The documents of one block: ids, and the bytes of all texts one after another."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes) -> None:
        self.ids = np.frombuffer(ids, np.int64)
        self.sizes = np.frombuffer(sizes, np.int64)
        self.data = unpack(data)
        self.start = np.concatenate([[0], np.cumsum(self.sizes)])

    def text(self, k: int) -> bytes:
        return self.data[self.start[k] : self.start[k + 1]]


def write_blocks(docs: DataFrame, name: str, block_bytes: int, carried: str | None = None) -> DataFrame:
    """Documents (doc_id, text) in blocks of about so many bytes, in the shared folder; ``carried`` names a string column that goes along."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, serial = TaskContext.get().partitionId(), 0  # type: ignore[union-attr]
        ids: list[int] = []
        texts: list[bytes] = []
        extra: list[bytes] = []
        held = 0

        def closed() -> pd.DataFrame:
            row = ((task << 32) + serial, np.array(ids, np.int64).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), pack_text(b"".join(texts)), pack(b"\0".join(extra)))
            return pd.DataFrame([row], columns=["block", "ids", "sizes", "data", "extra"])

        for batch in batches:
            rest = batch[carried] if carried else [None] * len(batch)
            for doc, text, more in zip(batch["doc_id"].tolist(), batch["text"].tolist(), rest, strict=True):
                coded = b"" if text is None else text.encode("utf-8", "surrogatepass")
                ids.append(NULL_ID if doc is None or doc != doc else int(doc))
                texts.append(coded)
                extra.append(b"" if more is None else more.encode())
                held += len(coded) + 16
                if held >= block_bytes or len(ids) == MAX_DOCUMENTS:
                    yield closed()
                    ids, texts, extra, held, serial = [], [], [], 0, serial + 1
        if ids:
            yield closed()

    # Identifiers travel as text: a null among them would otherwise turn them all into floating-point numbers.
    chosen = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text", *([F.col(f"`{carried}`")] if carried else []))
    return materialise(chosen.mapInPandas(run, BLOCK_SCHEMA), name)


def bucket_count(blocks: DataFrame, entries_per_bucket: int, bytes_per_entry: int) -> int:
    """A power of two that keeps what one bucket receives near the given number of entries; grows with the text."""
    total = blocks.agg(F.sum(F.length("data"))).first()[0] or 0
    wanted = max(1, int(total) * 2 // bytes_per_entry // entries_per_bucket)
    return 1 << (wanted - 1).bit_length()


KEY_BITS = 46


def key_lists(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct short keys of a block, sorted, and in how many of its documents each stands."""
    lead = np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])]) if len(key) else np.empty(0, bool)
    pair = np.unique((key[lead] >> np.uint64(64 - KEY_BITS)) * np.uint64(MAX_DOCUMENTS) + row[lead].astype(np.uint64))
    short = pair // np.uint64(MAX_DOCUMENTS)
    first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]])) if len(short) else np.empty(0, np.int64)
    return short[first], np.diff(np.append(first, len(short))).astype(np.uint32)


def range_edges(values: np.ndarray, buckets: int, bits: int = KEY_BITS) -> np.ndarray:
    """Where the sorted values of each bucket begin: buckets, a power of two, are ranges of the value."""
    low = np.array([k * ((1 << bits) // buckets) for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(values, low), [len(values)]])


def part_bytes(bucket: int, data: bytes) -> bytes:
    return int(bucket).to_bytes(8, "little") + data


def put_together(packed: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in packed)


def pieces_of(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def send_key_lists(block: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pd.DataFrame:
    """A block's keys and counts, one row per bucket that owns some of them."""
    edge = range_edges(keys, buckets)
    rows = [(int(b), block, pack_sorted(keys[edge[b] : edge[b + 1]]), pack_planes(counts[edge[b] : edge[b + 1]])) for b in np.flatnonzero(edge[1:] > edge[:-1])]
    return pd.DataFrame(rows, columns=["bucket", "block", "keys", "counts"])


def answer_keys(part: pd.DataFrame, hot: int) -> pd.DataFrame:
    """For each block, one byte per key: 0 in one document only, 1 in several, 2 in more than ``hot``."""
    lists = [unpack_sorted(k) for k in part["keys"]]
    keys = np.concatenate(lists)
    counts = np.concatenate([unpack_planes(c, np.uint32) for c in part["counts"]]).astype(np.int64)
    distinct, where = np.unique(keys, return_inverse=True)
    total = np.bincount(where, counts, len(distinct))[where]
    grade = ((total > 1).astype(np.uint8) + (total > hot)).astype(np.uint8)
    cut = np.cumsum([len(x) for x in lists])[:-1]
    return pd.DataFrame({"block": part["block"].to_numpy(), "part": [part_bytes(b, pack(g.tobytes())) for b, g in zip(part["bucket"], np.split(grade, cut), strict=True)]})


def grades_of(key: np.ndarray, row: np.ndarray, parts: list[bytes] | None, buckets: int = 0) -> np.ndarray:
    """The answered grade of each key of a block, in the order of the keys given; with ``buckets`` some may not have answered: 0."""
    ordered = sorted((int.from_bytes(p[:8], "little"), p[8:]) for p in (parts if parts is not None else ()))
    if not len(key) or not ordered:
        return np.zeros(len(key), np.uint8)
    keys, _ = key_lists(key, row)
    if buckets:
        edge, grade = range_edges(keys, buckets), np.zeros(len(keys), np.uint8)
        for b, p in ordered:
            grade[edge[b] : edge[b + 1]] = np.frombuffer(unpack(p), np.uint8)
    else:
        grade = np.concatenate([np.frombuffer(unpack(p), np.uint8) for _, p in ordered])
    return grade[np.searchsorted(keys, key >> np.uint64(64 - KEY_BITS))]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def spans_for(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """Blocks with all their packed answers in an array ``parts``."""
    gathered = spans.groupBy("block").agg(F.collect_list("part").alias("parts"))
    return blocks.join(gathered, "block", "left")
