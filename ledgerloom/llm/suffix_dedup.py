"""Removal of repeated substrings with a logarithmic family of suffix arrays.

Every 50-byte window of a text belongs to its minimiser: the 20-byte piece in it with the smallest hash, the leftmost of
equals. Windows that follow each other and have the same minimiser form a run. Equal windows have equal minimisers, so

1. blocks send their distinct minimisers to buckets, which answer which of them stand in more than one document;
2. the runs of those, and no others, go with their bytes to the shard that owns the minimiser, where equal windows meet;
3. a shard takes its runs in batches by rising document. Equal runs are settled as a whole. The windows of the others are
   suffixes of the shard's text: each batch gets a suffix array of them, in the order of their bytes, and a merge scan
   walks it along each existing level and takes the common prefix with the neighbours; a prefix of 50 bytes is a match.
   Then the batch becomes a level, and levels of equal size merge, so a shard keeps logarithmically many;
4. matched windows return to their block as spans.

Within a block, equal runs are sent once. Minimisers that stand in very many documents are not kept in one shard: their
windows are sent one by one to the shard that owns the window.

``SuffixIndex`` keeps blocks, minimisers and the levels of all shards as tables in a folder, so that a later call adds a
batch: its runs meet the stored levels, and of the stored blocks only runs of newly shared minimisers are sent.

Defined results: null or short text loses nothing; the row with the smallest identifier keeps a repeated string, rows of
the same identifier do not take from each other, and a null identifier counts as larger than all others; strings are
judged on the input; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.blocks import (
    BLOCK_SCHEMA,
    NULL_ID,
    Block,
    answer_keys,
    bucket_count,
    grades_of,
    key_lists,
    pack,
    pack_planes,
    pieces_of,
    put_together,
    runs,
    send_key_lists,
    spans_for,
    unpack,
    unpack_planes,
    write_blocks,
)
from ledgerloom.llm.common import discard
from ledgerloom.llm.words import hash_pieces, mix

WINDOW, PIECE = 50, 20
REACH = WINDOW - PIECE + 1
BLOCK_BYTES = 4 << 20
HOT_DOCUMENTS = 20_000
BATCH_WINDOWS = 1 << 16
STRETCH = 1 << 15
_BASE = 0x9E3779B1
_ODD = np.random.default_rng(50).integers(1, 2**63, 8, np.uint64) | np.uint64(1)
KEYED = "bucket long, block long, keys binary, counts binary"


def slide(values: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each ``size`` neighbours."""
    out, width = values, 1
    while width * 2 <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = size - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def piece_order(data: np.ndarray) -> np.ndarray:
    """A 16-bit hash of each 20-byte piece above its place, so the smallest of a window is the leftmost of the smallest hash."""
    h, width = data.astype(np.uint32) + np.uint32(1), 1
    four = None
    while width < 16:
        n = len(h) - width
        h = h[:n] * np.uint32(pow(_BASE, width, 1 << 32)) + h[width : width + n]
        width *= 2
        if width == 4:
            four = h
    n = len(h) - 4
    h = h[:n] * np.uint32(pow(_BASE, 4, 1 << 32)) + four[16 : 16 + n]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return (h & np.uint32(0xFFFF0000)) | np.arange(n, dtype=np.uint32)


class Windows:
    """The runs of windows of a block's texts: key, document position in the block, first window start, number of windows."""

    def __init__(self, block: Block) -> None:
        self.data = data = np.frombuffer(block.data, np.uint8)
        n = len(data) - WINDOW + 1
        self.key = np.empty(0, np.uint64)
        self.row = self.first = self.count = np.empty(0, np.int64)
        if n <= 0:
            return
        place = np.empty(n, np.int64)
        for lo in range(0, n, STRETCH):
            hi = min(n, lo + STRETCH)
            place[lo:hi] = (slide(piece_order(data[lo : hi + WINDOW - 1]), REACH) & np.uint32(0xFFFF)).astype(np.int64) + lo
        inside = np.zeros(n + 1, np.int8)
        long = block.sizes >= WINDOW
        np.add.at(inside, block.start[:-1][long], 1)
        np.add.at(inside, block.start[1:][long] - WINDOW + 1, -1)
        starts = np.flatnonzero(np.cumsum(inside[:n], dtype=np.int8) > 0)
        if not len(starts):
            return
        place = place[starts]
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
        at = np.flatnonzero(fresh)
        self.first = starts[at]
        self.count = np.diff(np.append(at, len(starts)))
        # Empty texts share a start with the next one; the last of equal starts owns the bytes.
        self.row = np.searchsorted(block.start, self.first, "right") - 1
        self.key = piece_keys(data, place[at])


def piece_keys(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 20-byte piece at each place."""
    view = np.lib.stride_tricks.sliding_window_view(data, PIECE)
    key = np.empty(len(place), np.uint64)
    for lo in range(0, len(place), 1 << 16):
        rows = np.ascontiguousarray(view[place[lo : lo + (1 << 16)]])
        a, b, c = rows[:, :8].copy().view(np.uint64).ravel(), rows[:, 8:16].copy().view(np.uint64).ravel(), rows[:, 16:].copy().view(np.uint32).ravel()
        key[lo : lo + (1 << 16)] = mix(mix(a * _ODD[0] + c) + b * _ODD[1])
    return key


def suffixes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The suffixes at some places as far as they are compared, the 50 bytes of a window."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at]).view(f"S{WINDOW}").ravel()


def equal_pieces(data: np.ndarray, a: np.ndarray, b: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whether runs of so many windows at a and b are the same bytes: their first and last windows cover them."""
    out = np.ones(len(a), bool)
    if not len(a):
        return out
    view = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
    for lo in range(0, len(a), 1 << 16):
        x, y, c = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)], count[lo : lo + (1 << 16)] - 1
        out[lo : lo + (1 << 16)] = (view[x] == view[y]).all(1) & (view[x + c] == view[y + c]).all(1)
    return out


def equal_runs(data: np.ndarray, first: np.ndarray, count: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, head position in that order, equal to the head) of runs by rising start, grouped by bytes, the smallest document first."""
    name = mix(hash_pieces(data, first, first + count + WINDOW - 1) + count.astype(np.uint64) * _ODD[2])
    order = np.lexsort((first, doc, name))
    name, f, c = name[order], first[order], count[order]
    lead = np.concatenate([[True], (name[1:] != name[:-1]) | (c[1:] != c[:-1])]) if len(name) else np.empty(0, bool)
    head = np.flatnonzero(lead)[np.cumsum(lead) - 1] if len(name) else np.empty(0, np.int64)
    return order, head, equal_pieces(data, f, f[head], c)


def send_keys(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples():
            w = Windows(Block(r.ids, r.sizes, r.data))
            yield send_key_lists(r.block, *key_lists(w.key, w.row), buckets)


def span_part(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> bytes:
    return put_together([pack_planes(x.astype(np.int64)) for x in (row, start, stop)])


def pick_runs(w: Windows, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, count, row, key) of the runs of shared minimisers by rising start; those of very frequent ones window by window."""
    pick, hot = np.flatnonzero(grade == 1), np.flatnonzero(grade == 2)
    first, count, row, key = w.first[pick], w.count[pick], w.row[pick], w.key[pick]
    if not len(hot):
        return first, count, row, key
    n = w.count[hot]
    each = np.repeat(w.first[hot], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    first, count = np.concatenate([first, each]), np.concatenate([count, np.ones(len(each), np.int64)])
    row, key = np.concatenate([row, np.repeat(w.row[hot], n)]), np.concatenate([key, hash_pieces(w.data, each, each + WINDOW)])
    order = np.argsort(first)
    return first[order], count[order], row[order], key[order]


def send_runs(batches: Iterator[pd.DataFrame], shards: int, buckets: int) -> Iterator[pd.DataFrame]:
    """Runs of repeated minimisers to their shards, and what the block settles by itself."""
    for batch in batches:
        for r in batch.itertuples():
            block = Block(r.ids, r.sizes, r.data)
            w = Windows(block)
            first, count, row, key = pick_runs(w, grades_of(w.key, w.row, r.parts, buckets))
            doc = block.ids[row]
            order, head, equal = equal_runs(w.data, first, count, doc)
            first, count, row, key, doc = (x[order] for x in (first, count, row, key, doc))
            lead = head == np.arange(len(head))
            settled = equal & (doc > doc[head])
            twin = equal & ~lead & (doc == doc[head])  # the same run again in the same document: judged with the first
            own = span_part(row[settled], first[settled] - block.start[row[settled]], first[settled] + count[settled] + WINDOW - 1 - block.start[row[settled]])
            yield pd.DataFrame([(-1, r.block, own)], columns=["shard", "block", "part"])
            # Twins go along with their head's number, so the shard's answer covers them.
            go = ~settled & ~twin
            number = np.cumsum(go) - 1
            where = (key[go] % np.uint64(shards)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            edge = np.searchsorted(where[order], np.arange(shards + 1))
            f, c, d, n = first[go][order], count[go][order], doc[go][order], np.arange(int(go.sum()))[order]
            rw = row[go][order]
            twins_of = number[head[twin]]
            t_first, t_row = first[twin], row[twin]
            t_order = np.argsort(twins_of, kind="stable")
            twins_of, t_first, t_row = twins_of[t_order], t_first[t_order], t_row[t_order]
            rows = []
            for s in np.flatnonzero(edge[1:] > edge[:-1]):
                cut = slice(edge[s], edge[s + 1])
                text = b"".join([block.data[x : x + y + WINDOW - 1] for x, y in zip(f[cut].tolist(), c[cut].tolist(), strict=True)])
                lo, hi = np.searchsorted(twins_of, n[cut]), np.searchsorted(twins_of, n[cut], "right")
                again = np.repeat(np.arange(len(lo)), hi - lo)
                which = np.repeat(lo, hi - lo) + np.arange(len(again)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
                packed = [pack_planes(d[cut]), pack(c[cut].astype(np.uint8).tobytes()), pack(text), pack_planes(rw[cut]), pack_planes(f[cut] - block.start[rw[cut]]), pack_planes(again), pack_planes(t_row[which]), pack_planes(t_first[which] - block.start[t_row[which]])]
                rows.append((int(s), r.block, put_together(packed)))
            yield pd.DataFrame(rows, columns=["shard", "block", "part"])


class Family:
    """A logarithmic family of suffix arrays over one text: levels of (suffixes in order, smallest document)."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []

    def add(self, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Take a batch of suffixes by rising document; which of them a smaller document also has."""
        suffix = suffixes(self.data, place)
        order = np.argsort(suffix, kind="stable")  # the batch's suffix array; equal suffixes by rising document
        suffix, d = suffix[order], doc[order]
        lead = np.concatenate([[True], suffix[1:] != suffix[:-1]])
        head = np.flatnonzero(lead)[np.cumsum(lead) - 1]
        found = d > d[head]
        s, low = suffix[lead], d[lead]
        older = np.zeros(len(s), bool)
        for _, level, level_doc in self.levels:
            older |= self.scan(level, level_doc, s, low)
        found |= older[np.cumsum(lead) - 1]
        self.merge(s, low)
        hit = np.empty(len(place), bool)
        hit[order] = found
        return hit

    @staticmethod
    def scan(level: np.ndarray, level_doc: np.ndarray, suffix: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Merge scan of two suffix arrays: which suffixes have a common prefix of a whole window with the level's next one."""
        k = np.searchsorted(level, suffix)
        there = k < len(level)
        k = np.minimum(k, len(level) - 1)
        return there & (level[k] == suffix) & (level_doc[k] < doc)

    def merge(self, suffix: np.ndarray, doc: np.ndarray) -> None:
        """The batch becomes a level; levels of equal size merge, and of equal suffixes the smallest document stays."""
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, s, d = self.levels.pop()
            suffix, doc = np.concatenate([s, suffix]), np.concatenate([d, doc])
            order = np.argsort(suffix, kind="stable")  # two ordered stretches: one merge
            suffix, doc = suffix[order], doc[order]
            lead = np.flatnonzero(np.concatenate([[True], suffix[1:] != suffix[:-1]]))
            suffix, doc = suffix[lead], np.minimum.reduceat(doc, lead)
            size *= 2
        self.levels.append((size, suffix, doc))

    def stored(self) -> bytes:
        """All levels, each as its size, the suffixes in order, documents."""
        return put_together([put_together([size.to_bytes(8, "little"), pack(s.tobytes()), pack_planes(d)]) for size, s, d in self.levels])

    @classmethod
    def restored(cls, data: np.ndarray, stored: bytes) -> Family:
        family = cls(data)
        for level in pieces_of(stored):
            size, s, d = pieces_of(level)
            family.levels.append((int.from_bytes(size, "little"), np.frombuffer(unpack(s), f"S{WINDOW}"), unpack_planes(d, np.int64)))
        return family


def judge(data: np.ndarray, begin: np.ndarray, count: np.ndarray, doc: np.ndarray, batch: int, family: Family) -> np.ndarray:
    """For every window of the runs, one run after another: whether a smaller document has the window."""
    order, head, equal = equal_runs(data, begin, count, doc)
    whole = equal & (doc[order] > doc[order][head])
    twin = equal & ~whole & (head != np.arange(len(head)))
    edge = np.concatenate([[0], np.cumsum(count)])
    hit = np.zeros(int(edge[-1]), bool)
    left = order[~whole & ~twin]
    left = left[np.argsort(doc[left], kind="stable")]
    c = count[left]
    offset = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
    place, owner, where = np.repeat(begin[left], c) + offset, np.repeat(doc[left], c), np.repeat(edge[left], c) + offset
    for lo in range(0, len(place), batch):
        cut = slice(lo, lo + batch)
        hit[where[cut]] = family.add(place[cut], owner[cut])
    for k, h in zip(order[twin].tolist(), order[head[twin]].tolist(), strict=True):
        hit[edge[k] : edge[k + 1]] = hit[edge[h] : edge[h + 1]]
    settled = np.zeros(len(count), bool)
    settled[order[whole]] = True
    return hit | np.repeat(settled, count)


def judge_shard(part: pd.DataFrame, batch: int, stored: bytes = b"", keep: bool = False) -> tuple[pd.DataFrame, bytes]:
    """All runs of one shard: spans of matched windows, by block; and the family as bytes if it is to be kept."""
    lists = [pieces_of(p) for p in part["part"]]
    docs = [unpack_planes(x[0], np.int64) for x in lists]
    counts = [np.frombuffer(unpack(x[1]), np.uint8).astype(np.int64) for x in lists]
    data = np.frombuffer(b"".join(unpack(x[2]) for x in lists), np.uint8)
    doc, count = np.concatenate(docs), np.concatenate(counts)
    begin = np.concatenate([[0], np.cumsum(count + WINDOW - 1)])[:-1]
    family = Family.restored(data, stored)
    hit = judge(data, begin, count, doc, batch, family)
    # Matched stretches of windows inside each run.
    run = np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    before = np.concatenate([[False], hit[:-1] & (run[1:] == run[:-1])]) if len(hit) else hit
    after = np.concatenate([hit[1:] & (run[1:] == run[:-1]), [False]]) if len(hit) else hit
    begins, ends = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)
    owner, lo, hi = run[begins], offset[begins], offset[ends] + WINDOW
    out = []
    base_run = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    for k, x in enumerate(lists):
        mine = slice(*np.searchsorted(owner, [base_run[k], base_run[k + 1]]))
        own, a, b = owner[mine] - base_run[k], lo[mine], hi[mine]
        if not len(own):
            continue
        row, start = unpack_planes(x[3], np.int64), unpack_planes(x[4], np.int64)
        again, t_row, t_start = (unpack_planes(x[i], np.int64) for i in (5, 6, 7))
        # Twins take the spans of their head.
        left, right = np.searchsorted(own, again), np.searchsorted(own, again, "right")
        n = right - left
        which = np.repeat(left, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        rows = np.concatenate([row[own], np.repeat(t_row, n)])
        starts = np.concatenate([start[own] + a, np.repeat(t_start, n) + a[which]])
        stops = np.concatenate([start[own] + b, np.repeat(t_start, n) + b[which]])
        out.append((part["block"].iloc[k], span_part(rows, starts, stops)))
    return pd.DataFrame(out, columns=["block", "part"]), family.stored() if keep else b""


def cut_blocks(batches: Iterator[pd.DataFrame], whole_characters: bool) -> Iterator[pd.DataFrame]:
    """One row per document: what is left of it and the maximal spans removed."""
    for batch in batches:
        for r in batch.itertuples():
            block = Block(r.ids, r.sizes, r.data)
            depth = np.zeros(len(block.data) + 1, np.int32)
            for p in r.parts if r.parts is not None else ():
                row, start, stop = (unpack_planes(x, np.int64) for x in pieces_of(p))
                np.add.at(depth, block.start[row] + start, 1)
                np.add.at(depth, block.start[row] + stop, -1)
            gone = np.cumsum(depth[:-1]) > 0
            data = np.frombuffer(block.data, np.uint8)
            extra = unpack(r.extra).split(b"\0")
            rows: list[tuple] = []
            for k, doc in enumerate(block.ids.tolist()):
                cut = slice(block.start[k], block.start[k + 1])
                g = gone[cut]
                a, b = runs(g) if g.any() else ((), ())
                kept = data[cut][~g].tobytes() if len(a) else block.data[cut]
                if whole_characters and len(a):
                    kept = kept.decode("utf-8", "ignore").encode()
                rows.append((None if doc == NULL_ID else doc, int(block.sizes[k]), kept, [{"start": int(x), "stop": int(y)} for x, y in zip(a, b, strict=True)], extra[k].decode()))
                if len(rows) == 2000:
                    yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "kept", "spans", "extra"]).astype({"doc_id": "Int64"})
                    rows = []
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "kept", "spans", "extra"]).astype({"doc_id": "Int64"})


def judged(moved: DataFrame, shards: int, batch: int) -> DataFrame:
    """Answers of all shards; what blocks settled themselves passes through."""
    route = F.when(F.col("shard") < 0, -1 - F.pmod(F.xxhash64("block"), F.lit(shards))).otherwise(F.col("shard"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return part[["block", "part"]] if int(part["shard"].iloc[0]) < 0 else judge_shard(part, batch)[0]

    return moved.withColumn("shard", route).groupBy("shard").applyInPandas(run, "block long, part binary")


CUT = "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,stop:long>>, extra string"
MOVED = "shard long, block long, part binary"
VERSION = "version int, buckets int, shards int, hot long"


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hot: int = HOT_DOCUMENTS, batch: int = BATCH_WINDOWS, whole_characters: bool = False, carried: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, kept (the bytes left), spans (start and stop of each removed run), extra.

    With ``whole_characters`` the bytes that a cut leaves of a character go too, so that ``kept`` is text. ``carried`` names
    a string column that comes back as ``extra``.
    """
    blocks = write_blocks(docs, "suffix-blocks", block_bytes, carried)
    buckets, shards = bucket_count(blocks, 1 << 20, 16), bucket_count(blocks, 1 << 16, 60)
    sent = blocks.mapInPandas(lambda it: send_keys(it, buckets), KEYED)
    grades = sent.groupBy("bucket").applyInPandas(lambda p: answer_keys(p, hot), "block long, part binary")
    moved = spans_for(blocks, grades).mapInPandas(lambda it: send_runs(it, shards, buckets), MOVED)
    return spans_for(blocks, judged(moved, shards, batch)).mapInPandas(lambda it: cut_blocks(it, whole_characters), CUT)


class SuffixIndex:
    """A family of suffix arrays in a folder, for batches that come one after another; what was judged is not judged again.

    The number of buckets and shards is fixed when the index is made, for the size it is to grow to. Tables of a batch are
    written to folders of its own number, and last a row of ``versions``, which holds the batch's number and the index's
    settings. Opening the folder again reads it: complete batches count, and what an interrupted batch left is written anew.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, shards: int = 64, block_bytes: int = BLOCK_BYTES, hot: int = HOT_DOCUMENTS) -> None:
        self.spark, self.path, self.block_bytes = spark, path.rstrip("/"), block_bytes
        try:
            done = spark.read.schema(VERSION).option("recursiveFileLookup", "true").parquet(f"{self.path}/versions")
        except AnalysisException:  # a new folder
            done = spark.createDataFrame([], VERSION)
        last = done.orderBy(F.col("version").desc()).first()
        self.version = last.version + 1 if last else 0
        self.buckets, self.shards, self.hot = (last.buckets, last.shards, last.hot) if last else (buckets, shards, hot)

    def _read(self, name: str, schema: str) -> DataFrame:
        folders = [f"{self.path}/{name}/{v}" for v in range(self.version)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _put(self, df: DataFrame, name: str, version: int) -> DataFrame:
        path = f"{self.path}/{name}/{version}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def add(self, docs: DataFrame, batch: int = BATCH_WINDOWS) -> DataFrame:
        """What is left of each document of the batch, as ``remove_repeats`` returns it, judged against all batches so far."""
        v, buckets, shards, hot = self.version, self.buckets, self.shards, self.hot
        old = self._read("blocks", BLOCK_SCHEMA)
        made = write_blocks(docs, "suffix-batch", self.block_bytes)
        blocks = self._put(made.withColumn("block", F.col("block") + F.lit(v << 48)), "blocks", v)
        discard(made)
        keys = self._put(blocks.mapInPandas(lambda it: send_keys(it, buckets), KEYED), "keys", v)
        before, low = self._read("keys", KEYED), v << 48

        def grade(part: pd.DataFrame) -> pd.DataFrame:
            """The grades of keys; for older blocks only those that this batch changed, so their runs are sent once (and once more when hot)."""
            answers = answer_keys(part, hot)
            older = part["block"].to_numpy() < low
            if older.any() and not older.all():
                known = answer_keys(part[older], hot)
                parts = answers["part"].tolist()
                for at, was in zip(np.flatnonzero(older), known["part"], strict=True):
                    now, then = (np.frombuffer(unpack(p[8:]), np.uint8) for p in (parts[at], was))
                    parts[at] = parts[at][:8] + pack(np.where(now != then, now, 0).astype(np.uint8).tobytes())
                answers["part"] = parts
            return answers if not older.all() else answers.iloc[:0]

        grades = keys.unionByName(before).groupBy("bucket").applyInPandas(grade, "block long, part binary")
        both = blocks.unionByName(old)
        moved = spans_for(both, grades).filter("parts IS NOT NULL OR block >= " + str(low)).mapInPandas(lambda it: send_runs(it, shards, buckets), MOVED)
        levels = self._read("levels", "shard long, version int, levels binary").groupBy("shard").agg(F.max_by("levels", "version").alias("levels"))
        route = F.when(F.col("shard") < 0, -1 - F.pmod(F.xxhash64("block"), F.lit(shards))).otherwise(F.col("shard"))
        moved = moved.withColumn("shard", route)

        def meet(part: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            columns = ["block", "part", "shard", "levels"]
            if not len(part):
                return pd.DataFrame([], columns=columns)
            shard = int(part["shard"].iloc[0])
            if shard < 0:
                return part[["block", "part"]].assign(shard=shard, levels=None)
            part = part.sort_values("block", kind="stable").reset_index(drop=True)
            spans, stored = judge_shard(part, batch, held["levels"].iloc[0] if len(held) else b"", keep=True)
            return pd.concat([spans.assign(shard=shard, levels=None), pd.DataFrame([(-1, None, shard, stored)], columns=columns)], ignore_index=True)

        answers = moved.groupBy("shard").cogroup(levels.groupBy("shard")).applyInPandas(meet, "block long, part binary, shard long, levels binary")
        answers = self._put(answers, "answers", v)
        self._put(answers.filter("levels IS NOT NULL").select("shard", F.lit(v).alias("version"), "levels"), "levels", v)
        self._put(self.spark.createDataFrame([(v, buckets, shards, hot)], VERSION), "versions", v)
        self.version = v + 1
        spans = answers.filter(f"block >= {low}").select("block", "part")
        return spans_for(blocks, spans).mapInPandas(lambda it: cut_blocks(it, False), CUT)


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents with repeated substrings cut from the text; other columns as they were, n_chars as the new length."""
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select("doc_id", "text", F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest]), {"ignoreNullFields": "false"}).alias("__rest"))
    row = F.from_json("extra", docs.select(*[F.col(f"`{c}`") for c in rest]).schema)
    made = remove_repeats(packed, whole_characters=True, carried="__rest").select(row.alias("row"), F.col("kept").cast("string").alias("text"))
    out = {c: F.col(f"row.`{c}`") for c in rest} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return made.select(*[out[c].alias(c) for c in docs.columns])
