"""Byte-pair encoding by speculation and verification, and decoding.

Each distinct word of a batch is first tokenised by greedy longest match, which is only a guess. A sequence of
canonical tokens is the byte-pair encoding of its text exactly if every adjacent pair of it is, so the guess is checked
pair by pair: ``pairs_hold`` undoes merges on both sides of all distinct pairs at once with numpy and looks for a merge
across the seam that would have come earlier. Words with a failing pair, and only those, are merged exactly.

Documents stream through ``mapInPandas``: no shuffle, and a task holds one Arrow batch and a bounded cache of words.

Defined results: null text counts as empty and encodes to no token; special tokens written in a text are recognised as
the tokenizers library does; rows may repeat; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.llm.common import ship_package

#: Fixed value: how byte-level vocabularies split text into words before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 300_000
NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Bpe:
    """A byte-level BPE vocabulary with its merge order."""

    def __init__(self, path: str) -> None:
        spec = json.loads(open(path, encoding="utf-8").read())
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocabulary = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.id_of = vocabulary
        self.size = max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for word, i in vocabulary.items():
            self.bytes_of[i] = word
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for word, i in self.special.items():
            self.bytes_of[i] = word.encode()
        # Each merged token keeps the two parts and the rank of the first merge that makes it.
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        left, right, born = (np.full(self.size, -1, np.int64) for _ in range(3))
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y = raw(a), raw(b)
            i, j, m = vocabulary[x], vocabulary[y], vocabulary[x + y]
            self.rank.setdefault((i, j), k)
            self.made[(i, j)] = m
            if born[m] < 0:
                left[m], right[m], born[m] = i, j, k
        self.left, self.right, self.born = left, right, born
        keys = np.array([i * self.size + j for i, j in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(self.rank.values()), np.int64)[order]
        # A token is canonical if exact merging of its own bytes gives it back; only those may be guessed.
        self.guess = {w: i for w, i in vocabulary.items() if len(w) == 1 or born[i] >= 0}
        self.reach: dict[bytes, int] = {}  # longest token by its first two bytes
        for w in self.guess:
            self.reach[w[:2]] = max(self.reach.get(w[:2], 1), len(w))
        self.pattern = regex.compile(SPLIT)
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cache: dict[str, bytes] = {}

    def exact(self, word: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left.

        Parts form a linked list and open pairs wait in a heap, so a word of n bytes takes n log n steps.
        """
        parts = [self.id_of[word[k : k + 1]] for k in range(len(word))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        rank, end = self.rank.get, len(parts)
        waiting = [(r, k, a, b) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank((a, b))) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, k, a, b = heapq.heappop(waiting)
            j = after[k]
            if parts[k] != a or j >= end or parts[j] != b:
                continue  # one of the two was merged meanwhile
            parts[k], parts[j] = self.made[a, b], -1
            after[k] = after[j]
            if after[k] < end:
                before[after[k]] = k
            for left in (before[k], k):
                right = after[left] if left >= 0 else end
                if right < end and (r := rank((parts[left], parts[right]))) is not None:
                    heapq.heappush(waiting, (r, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def greedy(self, word: bytes) -> list[int]:
        out, k, guess, reach, size = [], 0, self.guess, self.reach, len(word)
        while k < size:
            stop = k + reach.get(word[k : k + 2], 1)
            for n in range(stop if stop < size else size, k, -1):
                token = guess.get(word[k:n])
                if token is not None:
                    out.append(token)
                    k = n
                    break
        return out

    def pairs_hold(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether byte-pair merging of two tokens' joined bytes leaves exactly these two tokens.

        Time runs backwards: of the two pieces that touch the seam, the one that was merged last is taken apart. A
        merge across the seam spoils the pair if it could have happened while both pieces stood there, before either
        was absorbed by its own parent.
        """
        a, b = first.astype(np.int64).copy(), second.astype(np.int64).copy()
        gone_a = np.full(len(a), NEVER)  # rank at which the piece left of the seam was absorbed
        gone_b = np.full(len(a), NEVER)
        holds = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            keys = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)
            # Equal ranks: the leftmost match goes first, so a seam merge loses to the left parent and beats the right.
            spoiled = (rank < gone_a[live]) & (rank <= gone_b[live]) & (rank < NEVER)
            holds[live[spoiled]] = False
            born_x, born_y = self.born[x], self.born[y]
            open_left = born_x >= born_y
            done = spoiled | ((born_x < 0) & (born_y < 0))
            go_left, go_right = ~done & open_left, ~done & ~open_left
            left, right = live[go_left], live[go_right]
            gone_a[left] = born_x[go_left]
            a[left] = self.right[x[go_left]]
            gone_b[right] = born_y[go_right]
            b[right] = self.left[y[go_right]]
            live = live[~done]
        return holds

    def learn(self, words: list[str]) -> None:
        """Put the encodings of words into the cache, as little-endian unsigned 32-bit ids."""
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        guesses = [self.greedy(w) for w in coded]
        lengths = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(lengths.sum()))
        word_of = np.repeat(np.arange(len(guesses)), lengths)
        failed = np.zeros(len(guesses), bool)
        if len(flat) > 1:
            inner = word_of[1:] == word_of[:-1]
            keys = (flat[:-1] * self.size + flat[1:])[inner]
            distinct, where = np.unique(keys, return_inverse=True)
            verdict = self.pairs_hold(distinct // self.size, distinct % self.size)
            np.logical_or.at(failed, word_of[1:][inner], ~verdict[where])
        for k in np.flatnonzero(failed):
            guesses[k] = self.exact(coded[k])
        cache = self.cache
        for word, ids in zip(words, guesses, strict=True):
            cache[word] = np.array(ids, "<u4").tobytes()

    def words(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        pieces: list[list[str | int]] = []
        unknown: set[str] = set()
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        for text in texts:
            row: list[str | int] = []
            at = 0
            for hit in self.special_pattern.finditer(text) if self.special_pattern and any(s in text for s in self.special) else ():
                row += self.words(text[at : hit.start()])
                row.append(self.special[hit[0]])
                at = hit.end()
            row += self.words(text[at:] if at else text)
            pieces.append(row)
            unknown.update(w for w in row if w not in cache)
        self.learn([w for w in unknown if isinstance(w, str)])
        for i in self.special.values():
            cache[i] = np.array([i], "<u4").tobytes()  # type: ignore[index]
        return [b"".join(map(cache.__getitem__, row)) for row in pieces]  # type: ignore[arg-type]

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def vocabulary(path: str) -> Bpe:
    """The vocabulary, read once by each Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit), one row per document; also the ids decoded again if asked for."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = vocabulary(path)
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"].tolist()]
            for lo in range(0, len(texts), 512):
                ids = bpe.encode_batch(texts[lo : lo + 512])
                again = {"decoded": [bpe.decode(x) for x in ids]} if decoded else {}
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[lo : lo + 512], "ids": ids, **again})

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.BinaryType())])
    if decoded:
        schema.add("decoded", T.StringType())
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the decoded text."""
    ship_package(encoded.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = vocabulary(path)
        for batch in batches:
            yield batch.assign(decoded=[bpe.decode(ids) for ids in batch["ids"]])[["doc_id", "ids", "decoded"]]

    schema = T.StructType([encoded.schema["doc_id"], encoded.schema["ids"], T.StructField("decoded", T.StringType())])
    return encoded.select("doc_id", "ids").mapInPandas(run, schema)


