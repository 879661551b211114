"""Removal of repeated word windows by recompression.

A text is a sequence of word symbols. Rounds rewrite it: the run round turns a run of one word into one symbol; a pair
round joins neighbours (x, y) wherever a coin, thrown by the symbol's name and so the same everywhere, puts x on the left
side and y on the right; runs stay alone. A symbol's name is a fingerprint of its production, so all tasks name equal
productions equally.

Seen from a window of 13 words, a symbol is certain if it doesn't depend on what stands outside. Each round the uncertain
symbols at the window's two ends are popped: the first and the last run, then a first symbol of the right side and a last
one of the left side. What is left goes into the next round. The popped symbols and the core that remains after two pair
rounds stand for the window: equal windows have equal sequences, and different windows different ones, wherever they are.

1. First Spark round: blocks send their distinct level-1 names to the buckets that own them and learn which are shared by
   several documents. A window with an unshared symbol inside its ends is no repeat.
2. Second round, over the windows that are left: the same for neighbouring level-2 symbols of their cores.
3. Windows whose high-level symbols are all shared get the name of their popped sequence. A bucket finds the smallest
   document of each name; a match also has to agree on xxh3 of the window's own bytes, the 13 words.
4. Matched windows return to their block, which cuts the words they cover.

Every block sends a name once, however many of its documents share it, so a passage in a third of all documents costs
one entry from each block.

Defined results: null text has no word; texts below 13 words lose nothing; the row with the smallest identifier keeps a
repeated window, rows of the same identifier do not take from each other, a null identifier counts as larger than all
others; windows are judged on the input; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.blocks import (
    NULL_ID,
    Block,
    answer_keys,
    bucket_count,
    grades_of,
    key_lists,
    pack_planes,
    pack_sorted,
    part_bytes,
    pieces_of,
    put_together,
    range_edges,
    runs,
    send_key_lists,
    unpack_planes,
    unpack_sorted,
    write_blocks,
)
from ledgerloom.llm.words import find_words, hash_windows, hash_words, joined, mix, powers, single_spaced

WINDOW = 13
BLOCK_BYTES = 4 << 20
_rng = np.random.default_rng(1303)
_ODD = _rng.integers(1, 2**63, 16, np.uint64) | np.uint64(1)
SALTS = (0x51ED2701, 0x2545F491)


class Level:
    """The symbols of one round: names, whether each may be joined, where each begins among the symbols below."""

    def __init__(self, name: np.ndarray, joinable: np.ndarray, fresh: np.ndarray, salt: int) -> None:
        self.name, self.joinable, self.fresh, self.salt = name, joinable, fresh, salt
        coin = (mix(name ^ np.uint64(salt)) & np.uint64(1)).astype(bool)
        self.right, self.left = coin & joinable, ~coin & joinable

    def joined(self, salt: int) -> tuple[Level, np.ndarray]:
        """The next level by a pair round, and for each symbol the one of the next level that holds it."""
        second = np.zeros(len(self.name), bool)
        second[1:] = self.left[:-1] & self.right[1:] & ~self.fresh[1:]
        start = np.flatnonzero(~second)
        pair = np.append(second[1:], False)[start] if len(start) else np.zeros(0, bool)
        name = self.name[start]
        name[pair] = mix(name[pair] * _ODD[0] + self.name[start[pair] + 1] * _ODD[1] + np.uint64(self.salt))
        return Level(name, self.joinable[start], self.fresh[start], salt), np.cumsum(~second) - 1


class Parse:
    """A block's texts as words, runs, level-1 and level-2 symbols, with the bounds of every window among them."""

    def __init__(self, block: Block) -> None:
        data, edge = joined([block.text(k) for k in range(len(block.ids))])
        start, stop = find_words(data)
        self.word = w = hash_words(data, start, stop)
        self.bytes = data, start, stop
        self.edge = np.searchsorted(start, edge)
        n = len(w)
        owner = np.repeat(np.arange(len(block.ids)), np.diff(self.edge))
        fresh = np.ones(n, bool)
        fresh[1:] = owner[1:] != owner[:-1]
        lead = fresh.copy()
        lead[1:] |= w[1:] != w[:-1]
        self.run_start = np.flatnonzero(lead)
        self.run_stop = np.append(self.run_start[1:], n)
        self.run_of = np.cumsum(lead) - 1
        length = self.run_stop - self.run_start
        name = w[self.run_start]
        name = np.where(length > 1, mix(name + length.astype(np.uint64) * _ODD[2]), name)
        self.runs = Level(name, length == 1, fresh[self.run_start], SALTS[0])
        self.one, self.one_of = self.runs.joined(SALTS[1])
        self.two, self.two_of = self.one.joined(0)
        self.first = np.flatnonzero(owner[: max(0, n - WINDOW + 1)] == owner[WINDOW - 1 :]) if n >= WINDOW else np.empty(0, np.int64)
        self.row = owner[self.first]
        self.one_row, self.two_row = owner[self.run_start][self._starts(self.one_of)], owner[self.run_start][self._starts(self.one_of)][self._starts(self.two_of)]
        self._bound()

    @staticmethod
    def _starts(of: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.diff(of, prepend=-1))

    def _bound(self) -> None:
        """Pop the uncertain symbols of each round from both ends of every window."""
        i = self.first
        self.k0, self.kl = self.run_of[i], self.run_of[i + WINDOW - 1]
        p, q = self.k0 + 1, self.kl
        inside = p < q
        at = np.minimum(p, len(self.runs.name) - 1)
        self.pop_l1 = inside & self.runs.right[at]
        self.p0, p = at, p + self.pop_l1
        self.q0 = np.maximum(q - 1, 0)
        self.pop_r1 = inside & (q - 1 >= p) & self.runs.left[self.q0]
        q = q - self.pop_r1
        inside = inside & (p < q)
        a, b = np.where(inside, self.one_of[np.minimum(p, len(self.one_of) - 1)], 0), np.where(inside, self.one_of[np.maximum(q - 1, 0)] + 1, 0)
        self.a, self.b = a, b  # level-1 symbols that are certain
        self.pop_l2 = inside & self.one.right[a]
        self.pop_r2 = inside & (b - 1 >= a + self.pop_l2) & self.one.left[np.maximum(b - 1, 0)]
        a, b = a + self.pop_l2, b - self.pop_r2
        inside = inside & (a < b)
        self.core_a = np.where(inside, self.two_of[np.minimum(a, len(self.two_of) - 1)], 0)
        self.core_b = np.where(inside, self.two_of[np.maximum(b - 1, 0)] + 1, 0)

    def twos(self) -> np.ndarray:
        """Names of neighbouring level-2 symbols (the last has no neighbour and is never asked for)."""
        name = self.two.name
        return mix(name * _ODD[3] + np.append(name[1:], name[-1:]) * _ODD[4])

    def names(self, pick: np.ndarray) -> np.ndarray:
        """Names of the popped sequences of some windows."""
        i, last = self.first[pick], self.first[pick] + WINDOW - 1
        k0, kl = self.k0[pick], self.kl[pick]
        count_l = np.minimum(self.run_stop[k0], last + 1) - i
        count_r = last + 1 - np.maximum(self.run_start[kl], i)
        h = mix(self.word[i] * _ODD[5] + count_l.astype(np.uint64)) + mix(self.word[last] * _ODD[6] + count_r.astype(np.uint64))
        a, b = self.a[pick], self.b[pick]
        for flag, name, odd in (
            (self.pop_l1[pick], self.runs.name[self.p0[pick]], _ODD[7]),
            (self.pop_r1[pick], self.runs.name[self.q0[pick]], _ODD[8]),
            (self.pop_l2[pick], self.one.name[a] if len(self.one.name) else a.astype(np.uint64), _ODD[9]),
            (self.pop_r2[pick], self.one.name[np.maximum(b - 1, 0)] if len(self.one.name) else b.astype(np.uint64), _ODD[10]),
        ):
            h += np.where(flag, mix(name * odd + np.uint64(1)), np.uint64(0))
        power, inverse = powers(len(self.two.name) + 1)
        total = np.zeros(len(self.two.name) + 1, np.uint64)
        np.cumsum(self.two.name * power[: len(self.two.name)], out=total[1:])
        low, high = self.core_a[pick], self.core_b[pick]
        core = (total[high] - total[low]) * inverse[low]
        return mix(h + mix(core * _ODD[11] + (high - low).astype(np.uint64)))

    def alive(self, ones: list[bytes] | None, twos: list[bytes] | None) -> np.ndarray:
        """Windows all of whose certain symbols are shared, by the answers of the first and, if there is one, the second round."""
        if not len(self.first):
            return np.empty(0, bool)
        dead = np.concatenate([[0], np.cumsum(grades_of(self.one.name, self.one_row, ones) == 0)])
        live = dead[self.b] == dead[self.a]
        if twos is not None:
            key = self.second_keys(live)
            mine = np.zeros(len(self.two.name), bool)
            mine[key] = grades_of(self.twos()[key], self.two_row[key], twos) == 0
            dead = np.concatenate([[0], np.cumsum(mine)])
            live &= dead[np.maximum(self.core_b - 1, self.core_a)] == dead[self.core_a]
        return live

    def second_keys(self, live: np.ndarray) -> np.ndarray:
        """Positions of the level-2 neighbours in the cores of live windows."""
        wanted = live & (self.core_b - self.core_a >= 2)
        depth = np.bincount(self.core_a[wanted], minlength=len(self.two.name) + 1) - np.bincount(self.core_b[wanted] - 1, minlength=len(self.two.name) + 1)
        return np.flatnonzero(np.cumsum(depth)[: len(self.two.name)] > 0)


def send_ones(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples():
            parse = Parse(Block(r.ids, r.sizes, r.data))
            yield send_key_lists(r.block, *key_lists(parse.one.name, parse.one_row), buckets)


def send_twos(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples():
            parse = Parse(Block(r.ids, r.sizes, r.data))
            key = parse.second_keys(parse.alive(list(r.ones), None)) if r.ones is not None else np.empty(0, np.int64)
            yield send_key_lists(r.block, *key_lists(parse.twos()[key], parse.two_row[key]), buckets)


def repeated_windows(parse: Parse, ids: np.ndarray, ones: list[bytes] | None, twos: list[bytes] | None) -> tuple[np.ndarray, ...]:
    """Windows whose symbols are shared, sorted by name: (name, fingerprint of the words' bytes, document, position among the windows)."""
    pick = np.flatnonzero(parse.alive(ones, twos if twos is not None else []))
    name = parse.names(pick)
    flat, start, stop = single_spaced(*parse.bytes)
    check = hash_windows(flat, start[parse.first[pick]], stop[parse.first[pick] + WINDOW - 1])
    doc = ids[parse.row[pick]]
    order = np.lexsort((doc, check, name))
    return name[order], check[order], doc[order], pick[order]


def leaders(name: np.ndarray, check: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], (name[1:] != name[:-1]) | (check[1:] != check[:-1])]) if len(name) else np.empty(0, bool)


def send_windows(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """A block's distinct repeated windows, each with the smallest document of the block that has it."""
    for batch in batches:
        for r in batch.itertuples():
            block = Block(r.ids, r.sizes, r.data)
            name, check, doc, _ = repeated_windows(Parse(block), block.ids, r.ones, r.twos)
            lead = leaders(name, check)
            name, check, doc = name[lead], check[lead], doc[lead]
            edge = range_edges(name, buckets, 64)
            rows = []
            for b in np.flatnonzero(edge[1:] > edge[:-1]):
                cut = slice(edge[b], edge[b + 1])
                rows.append((int(b), r.block, put_together([pack_sorted(name[cut]), pack_planes(check[cut]), pack_planes(doc[cut])])))
            yield pd.DataFrame(rows, columns=["bucket", "block", "part"])


def answer_windows(part: pd.DataFrame) -> pd.DataFrame:
    """For each block the smallest document of all that has each of its windows."""
    lists = [pieces_of(p) for p in part["part"]]
    names = [unpack_sorted(x[0]) for x in lists]
    name = np.concatenate(names)
    check = np.concatenate([unpack_planes(x[1], np.uint64) for x in lists])
    doc = np.concatenate([unpack_planes(x[2], np.int64) for x in lists])
    order = np.lexsort((doc, check, name))
    lead = leaders(name[order], check[order])
    lowest = np.empty(len(doc), np.int64)
    lowest[order] = doc[order][np.flatnonzero(lead)[np.cumsum(lead) - 1]]
    cut = np.cumsum([len(x) for x in names])[:-1]
    return pd.DataFrame({"block": part["block"].to_numpy(), "part": [part_bytes(b, pack_planes(d)) for b, d in zip(part["bucket"], np.split(lowest, cut), strict=True)]})


def cut_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per document: the words left and the maximal spans of words removed."""
    columns = ["doc_id", "n_words", "n_kept", "kept", "spans"]
    for batch in batches:
        for r in batch.itertuples():
            block = Block(r.ids, r.sizes, r.data)
            parse = Parse(block)
            name, check, doc, pick = repeated_windows(parse, block.ids, r.ones, r.twos)
            lead = leaders(name, check)
            ordered = sorted((int.from_bytes(p[:8], "little"), p[8:]) for p in (r.lows if r.lows is not None else ()))
            lowest = np.concatenate([unpack_planes(p, np.int64) for _, p in ordered]) if ordered else np.empty(0, np.int64)
            gone = np.zeros(len(parse.word) + 1, np.int32)
            if len(name):
                hit = parse.first[pick[lowest[np.cumsum(lead) - 1] < doc]]
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + WINDOW, -1)
            cover = np.cumsum(gone[:-1]) > 0
            rows = []
            for k, doc_id in enumerate(block.ids.tolist()):
                words = block.text(k).split()
                g = cover[parse.edge[k] : parse.edge[k + 1]]
                a, b = runs(g) if g.any() else ((), ())
                kept = [words[i] for i in np.flatnonzero(~g).tolist()] if len(a) else words
                rows.append((None if doc_id == NULL_ID else doc_id, len(words), len(kept), b" ".join(kept), [{"start": int(x), "stop": int(y)} for x, y in zip(a, b, strict=True)]))
                if len(rows) == 2000:
                    yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})
                    rows = []
            yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})


def gathered(parts: DataFrame, name: str) -> DataFrame:
    """All packed answers of a block in one array."""
    return parts.groupBy("block").agg(F.collect_list("part").alias(name))


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_kept, kept (UTF-8 of the words left), spans (first and last + 1 word of each removed run)."""
    blocks = write_blocks(docs, "recompression-blocks", block_bytes)
    buckets = bucket_count(blocks, 1 << 20, 16)
    keyed = "bucket long, block long, keys binary, counts binary"
    judge = lambda p: answer_keys(p, 1 << 62)
    ones = blocks.mapInPandas(lambda it: send_ones(it, buckets), keyed).groupBy("bucket").applyInPandas(judge, "block long, part binary")
    named = blocks.join(gathered(ones, "ones"), "block", "left")
    twos = named.mapInPandas(lambda it: send_twos(it, buckets), keyed).groupBy("bucket").applyInPandas(judge, "block long, part binary")
    named = named.join(gathered(twos, "twos"), "block", "left")
    moved = named.mapInPandas(lambda it: send_windows(it, buckets), "bucket long, block long, part binary")
    lows = gathered(moved.groupBy("bucket").applyInPandas(answer_windows, "block long, part binary"), "lows")
    return named.join(lows, "block", "left").mapInPandas(cut_words, "doc_id long, n_words long, n_kept long, kept binary, spans array<struct<start:long,stop:long>>")
