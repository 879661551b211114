"""Packing token pieces into sequences by multiway differencing.

A document's ids are cut into whole windows, which are sequences of their own, and a rest of pieces of at most
``piece_tokens``. Pieces gather in groups worth about ``group_windows`` windows. In a group, the Karmarkar-Karp method
keeps partial partitions of k windows: the two with the largest imbalance are merged again and again, the fullest window
of one onto the emptiest of the other, until one partition is left. If a window then exceeds the capacity, k rises by
one and the group is partitioned anew.

A group belongs to one task, which holds one group and one Arrow batch: no shuffle, and no row waits for another task.
A task that runs again makes the same pieces.

Defined results: null text counts as empty (its only id is the end id); rows may repeat, and each is packed; null ids
are kept; an empty table gives no piece; further columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import re
from array import array
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.llm.bpe import byte_letters
from ledgerloom.llm.common import ship_package

CAPACITY = 4096
PIECE_TOKENS = 1024
GROUP_WINDOWS = 128
CACHE_WORDS = 300_000
BEYOND_LATIN = "\u0250"
CONTROL = re.compile("[\x00-\x1f\x7f-\xa0]")
#: Characters of the texts that are split into words together; one longer text goes alone.
CHARS_AT_ONCE = 1 << 21
#: Fixed value: how the word vocabulary splits lower-case text before merging.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def plain_parts(below: str) -> re.Pattern[str]:
    """``PARTS`` for texts that have no sign from ``below`` on: its classes written out, alternatives that can't begin alike in any order."""
    signs = "".join(map(chr, range(ord(below))))
    letters, digits = (re.escape("".join(regex.findall(kind, signs))) for kind in (r"\p{L}", r"\p{N}"))
    return re.compile(f"[{letters}]+|[{digits}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{letters}{digits}]+")


ASCII_PARTS, LATIN_PARTS = plain_parts("\x80"), plain_parts(BEYOND_LATIN)
#: Signs of texts that go word by word: control signs but for white space, and those that aren't Latin or not in lower case.
ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0" + "".join(c for c in map(chr, range(0xA1, ord(BEYOND_LATIN))) if max(c.lower()) >= BEYOND_LATIN) + BEYOND_LATIN + "-\U0010ffff]")


def merge_partitions(a: list, b: list, k: int) -> list:
    """Two partial partitions into k windows, each a list of (sum, items) by falling sum, joined with opposing imbalances."""
    over = len(a) + len(b) - k
    if over <= 0:
        joined = a + b
    else:
        low_a, low_b = a[len(a) - over :], b[len(b) - over :]
        met = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(low_a, reversed(low_b), strict=True)]
        joined = a[: len(a) - over] + b[: len(b) - over] + met
    joined.sort(key=lambda w: -w[0])
    return joined


def partition(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of the items in each of k near-equal windows."""
    heap: list[tuple[int, int, list]] = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = merge_partitions(a, b, k)
        spread = joined[0][0] - (joined[-1][0] if len(joined) == k else 0)
        heapq.heappush(heap, (-spread, serial, joined))
        serial += 1
    windows = []
    for _, tree in heap[0][2] if heap else []:
        items, stack = [], [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += node
            else:
                items.append(node)
        windows.append(sorted(items))
    return windows


def pack_sizes(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of item indices, none above the capacity; the window count rises until that holds."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = partition(sizes, k)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return windows
        k += 1


class Parts(dict[str, bytes]):
    """Ids of parts of words, in lower case and without odd signs; one that isn't known yet is encoded when it is asked for."""

    def __init__(self, tokenizer: Any) -> None:
        super().__init__()
        self.merge = tokenizer.model.tokenize  # what is left of encoding a part: it is split and in lower case already
        self.letters = {b: letter for letter, b in byte_letters().items()}

    def __missing__(self, part: str) -> bytes:
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        ids = self[part] = array("I", [t.id for t in self.merge(letters)]).tobytes()
        return ids


class Tokens:
    """Ids of a text by the tokenizers library; it is split as the vocabulary splits it, and parts are encoded once and kept.

    Texts with odd signs, or what may be a special token, go word by word: white space separates words, which are kept too.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache: dict[bytes, bytes] = {}
        self.parts = Parts(self.tokenizer)
        # A text holds an added token only where the first two signs of one stand, in either case.
        self.begins = sorted({t.content[:2].lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.special = re.compile("|".join(map(re.escape, self.begins)) or r"(?!)", re.IGNORECASE)

    def whole(self, text: str) -> bool:
        """Whether only the library itself may encode a word or part: beyond Latin letters, with control signs or perhaps a special token."""
        return bool(self.special.search(text) or CONTROL.search(text) or (not text.isascii() and max(text) >= BEYOND_LATIN))

    def learn(self, words: list[bytes]) -> None:
        """Encode words through their parts: letters, single digits and other signs are encoded apart by this vocabulary."""
        library = lambda text: array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        for word in words:
            plain = word.decode("utf-8", "replace")
            parts = [plain] if self.whole(plain) else PARTS.findall(plain.lower())
            self.cache[word] = b"".join([library(part) if self.whole(part) else self.parts[part] for part in parts])

    def encode_words(self, texts: list[str]) -> list[bytes]:
        rows = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        self.learn(list(set().union(*rows).difference(self.cache)))
        look = self.cache.__getitem__
        return [b"".join(map(look, row)) for row in rows]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.parts) > CACHE_WORDS:
            self.parts.clear()
        look, found, odd = self.parts.__getitem__, [], []
        for i, text in enumerate(texts):
            plain = text.lower()
            if ODD.search(text) or any(begin in plain for begin in self.begins):
                odd.append(i)
                found.append(b"")
            else:
                found.append(b"".join(map(look, (ASCII_PARTS if plain.isascii() else LATIN_PARTS).findall(plain))))
        for i, ids in zip(odd, self.encode_words([texts[i] for i in odd]), strict=True):
            found[i] = ids
        return found


def handfuls(texts: list[str]) -> Iterator[slice]:
    """Places of consecutive texts of some ``CHARS_AT_ONCE`` characters."""
    low, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHARS_AT_ONCE:
            yield slice(low, i)
            low, size = i, 0
        size += len(text) + 1
    if low < len(texts):
        yield slice(low, len(texts))


_loaded: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


def pack_documents(
    docs: DataFrame,
    path: str,
    end_id: int = 2,
    capacity: int = CAPACITY,
    piece_tokens: int = PIECE_TOKENS,
    group_windows: int = GROUP_WINDOWS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    ship_package(docs.sparkSession)
    piece_tokens = min(piece_tokens, capacity)
    full_enough = int((group_windows - 0.5) * capacity)
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pa.default_memory_pool().release_unused()  # a worker may still hold what an earlier job's batches needed
        tokens = tokens_of(path)
        serial = TaskContext.get().partitionId() << 32  # type: ignore[union-attr]
        group: list[tuple] = []
        held = 0

        def closed() -> Iterator[list]:
            nonlocal serial, group, held
            for window in pack_sizes([g[2] for g in group], capacity):
                at = 0
                for i in window:
                    doc, start, length, ids, total = group[i]
                    yield [doc, start, length, ids, total, serial, at]
                    at += length
                serial += 1
            group, held = [], 0

        for batch in batches:
            texts, docs_in = ["" if t is None else t for t in batch["text"].tolist()], batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None).tolist()
            del batch
            for some in handfuls(texts):
                out: list[list] = []
                for doc, ids in zip(docs_in[some], tokens.encode(texts[some]), strict=True):
                    ids += end
                    total = len(ids) // 4
                    whole = total // capacity * capacity
                    for start in range(0, whole, capacity):
                        out.append([doc, start, capacity, ids[4 * start : 4 * (start + capacity)], total, serial, 0])
                        serial += 1
                    for start in range(whole, total, piece_tokens):
                        length = min(piece_tokens, total - start)
                        group.append((doc, start, length, ids[4 * start : 4 * (start + length)], total))
                        held += length
                        if held >= full_enough:
                            out += closed()
                yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(list(closed()), columns=names)

    id_type = docs.schema["doc_id"].dataType
    long = lambda n: T.StructField(n, T.LongType())
    schema = T.StructType([T.StructField("doc_id", id_type), long("start"), long("length"), T.StructField("ids", T.BinaryType()), long("doc_tokens"), long("sequence_id"), long("offset")])
    return docs.select("doc_id", "text").mapInPandas(run, schema)
