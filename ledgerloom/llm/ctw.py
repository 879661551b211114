"""Language-model scores by context-tree weighting over bytes.

A text is coded byte by byte, most significant bit first, and ends with byte 0xFF, which UTF-8 never uses; five more of
them stand before it. For every depth d up to five and every context of d bytes there are 255 binary nodes, one for each
prefix of the next byte. A node has the counts of its two bits in the training texts, a Krichevsky-Trofimov estimate,
and a weight: the weighted probability of its training bits is half the estimate's plus half the product over the nodes
one byte deeper. Scoring walks from the deepest node that was trained up to the root and mixes the estimates by those
weights; the length of a text in bytes of code follows from the sum of the logarithms.

All counts come from all training texts. Every block sends its distinct six-byte strings and its distinct words with
their training counts; buckets add them up; subtrees below two context bytes are weighed in one task each, and the two
top levels, at most 65,536 nodes at any size of corpus, on the driver. The strings' code lengths then go back to the
blocks that asked. Nothing that grows with the corpus is broadcast or collected.

Words are told apart by 64-bit fingerprints. Defined results: null text counts as empty, so it is its end alone; a null
identifier is not in the held-out fold; without training texts every bit costs one bit and the base score is 0; rows may
repeat; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.blocks import NULL_ID, Block, bucket_count, pack_planes, pack_sorted, part_bytes, spans_for, unpack_planes, unpack_sorted, write_blocks
from ledgerloom.llm.common import materialise
from ledgerloom.llm.words import mix as spread

DEPTH, END = 5, 0xFF
BLOCK_BYTES = 4 << 20
DENSE = 1 << 27
FOLDS, HELD_OUT = 7, 2


def in_held_out(ids: np.ndarray) -> np.ndarray:
    return np.array([i != NULL_ID and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids.tolist()], bool)


def ranked(code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of each code among the distinct ones, the distinct ones in order)."""
    if size > DENSE:
        distinct, number = np.unique(code, return_inverse=True)
        return number.astype(np.int32), distinct
    seen = np.zeros(size, bool)
    seen[code] = True
    distinct = np.flatnonzero(seen)
    table = np.empty(size, np.int32)
    table[distinct] = np.arange(len(distinct), dtype=np.int32)
    return table[code], distinct


def joined(high: np.ndarray, low: np.ndarray, size: int, base: int) -> np.ndarray:
    """high * base + low, in 32 bits if that holds ``size`` codes."""
    kind = np.int32 if size <= np.iinfo(np.int32).max else np.int64
    return high.astype(kind, copy=False) * kind(base) + low


class Strings:
    """A block's strings of DEPTH context bytes, latest first, and the byte that follows."""

    def __init__(self, block: Block) -> None:
        gap = bytes([END]) * DEPTH
        data = np.frombuffer(gap + (bytes([END]) + gap).join([block.text(k) for k in range(len(block.ids))]) + bytes([END]), np.uint8)
        coded = np.ones(len(data), bool)
        begin = block.start[:-1] + (DEPTH + 1) * np.arange(len(block.ids))
        for k in range(DEPTH):
            coded[begin + k] = False
        self.row_of = np.repeat(np.arange(len(block.ids), dtype=np.int32), block.sizes + 1)
        # Pairs, then pairs of pairs, then byte by byte, each numbered densely: linear in the text. Strings that reach
        # over a text's start are numbered too but never counted or asked for.
        letter, letters = ranked(data, 256)
        n = len(letters)
        number, found = ranked(joined(letter[1:], letter[:-1], n * n, n), n * n)
        value, count = letters[found // n] << 8 | letters[found % n], len(found)
        number, found = ranked(joined(number[2:], number[:-2], count * count, count), count * count)
        value, count = value[found // count] << 16 | value[found % count], len(found)
        for k in range(4, DEPTH):
            number, found = ranked(joined(number[1:], letter[: len(number) - 1], count * n, n), count * n)
            value, count = value[found // n] << 8 | letters[found % n], len(found)
        number, found = ranked(joined(number[:-1], letter[DEPTH:], count * n, n), count * n)
        gram = (value[found // n] << 8 | letters[found % n]).astype(np.uint64)
        order = np.argsort(gram)
        self.gram = gram[order]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.number = place[number[coded[DEPTH:]]]


def word_table(block: Block) -> tuple[list[list[bytes]], dict[bytes, int], np.ndarray]:
    """(words of each text, number of each distinct word by rising fingerprint, the fingerprints)."""
    words = [block.text(k).lower().split() for k in range(len(block.ids))]
    distinct = list(set().union(*words)) if words else []
    name = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64)
    order = np.argsort(name, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return words, dict(zip(distinct, number.tolist(), strict=True)), name[order]


def gram_bucket(gram: np.ndarray, buckets: int) -> np.ndarray:
    return (spread(gram) % np.uint64(buckets)).astype(np.int64)


def by_bucket(gram: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by bucket, then string; edges of the buckets)."""
    b = gram_bucket(gram, buckets)
    order = np.argsort(b, kind="stable")
    return order, np.searchsorted(b[order], np.arange(buckets + 1))


def name_edges(name: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(name >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64) * np.uint64((1 << 32) // buckets))


def send_counts(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples():
            block = Block(r.ids, r.sizes, r.data)
            train = ~in_held_out(block.ids)
            s = Strings(block)
            counts = np.bincount(s.number[train[s.row_of]], minlength=len(s.gram))
            order, edge = by_bucket(s.gram, buckets)
            gram, counts = s.gram[order], counts[order]
            rows = [(0, b, r.block, pack_sorted(gram[edge[b] : edge[b + 1]]), pack_planes(counts[edge[b] : edge[b + 1]])) for b in range(buckets) if edge[b] < edge[b + 1]]
            del s
            words, number, name = word_table(block)
            seen: Counter[bytes] = Counter()
            for k in np.flatnonzero(train).tolist():
                seen.update(words[k])
            counts = np.zeros(len(name), np.int64)
            counts[np.fromiter(map(number.__getitem__, seen), np.int64, len(seen))] = np.fromiter(seen.values(), np.int64, len(seen))
            edge = name_edges(name, buckets)
            rows += [(1, b, r.block, pack_sorted(name[edge[b] : edge[b + 1]]), pack_planes(counts[edge[b] : edge[b + 1]])) for b in range(buckets) if edge[b] < edge[b + 1]]
            yield pd.DataFrame(rows, columns=["kind", "bucket", "block", "keys", "counts"])


def added_up(part: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    lists = [unpack_sorted(k) for k in part["keys"]]
    distinct, where = np.unique(np.concatenate(lists), return_inverse=True)
    counts = np.concatenate([unpack_planes(c, np.int64) for c in part["counts"]])
    return lists, distinct, where, np.bincount(where, counts, len(distinct)).astype(np.int64)


def answer_words(part: pd.DataFrame) -> pd.DataFrame:
    """For each block the training counts of its words; the first row also tells how many tokens and distinct words there are."""
    lists, _, where, total = added_up(part)
    cut = np.cumsum([len(x) for x in lists])[:-1]
    parts = [part_bytes(b, pack_planes(t)) for b, t in zip(part["bucket"], np.split(total[where], cut), strict=True)]
    first = np.arange(len(part)) == 0
    return pd.DataFrame({"block": part["block"].to_numpy(), "part": parts, "tokens": np.where(first, total.sum(), 0), "distinct": np.where(first, (total > 0).sum(), 0)})


def add_grams(part: pd.DataFrame, groups: int) -> pd.DataFrame:
    """Distinct strings with their counts, to the task that weighs their subtree."""
    _, gram, _, total = added_up(part)
    group = (spread(gram >> np.uint64(8 * (DEPTH - 1))) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    edge = np.searchsorted(group[order], np.arange(groups + 1))
    gram, total = gram[order], total[order]
    rows = [(g, pack_sorted(gram[edge[g] : edge[g + 1]]), pack_planes(total[edge[g] : edge[g + 1]])) for g in range(groups) if edge[g] < edge[g + 1]]
    return pd.DataFrame(rows, columns=["subtree", "keys", "counts"])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 8, carried back."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - sum(np.log(x + k) for k in range(8))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class Level:
    """The binary nodes of all contexts of one depth, for one bit position: key is context, then the bits so far."""

    def __init__(self, key: np.ndarray, bit: np.ndarray, count: np.ndarray) -> None:
        self.key, where = np.unique(key, return_inverse=True)
        self.ones = np.bincount(where, count * bit, len(self.key))
        self.zeros = np.bincount(where, count, len(self.key)) - self.ones
        self.log_weighted = self.log_kt = log_kt(self.zeros, self.ones)
        self.odds = np.full(len(self.key), np.inf)  # logarithm of the odds of stopping here

    def over(self, deeper: Level) -> None:
        """Weigh against the nodes one byte deeper, whose key has one more context byte before the bits."""
        parent = (deeper.key >> np.uint64(16) << np.uint64(8)) | (deeper.key & np.uint64(255))
        product = np.bincount(np.searchsorted(self.key, parent), deeper.log_weighted, len(self.key))
        self.weigh(product)

    def weigh(self, product: np.ndarray) -> None:
        self.odds = self.log_kt - product
        self.log_weighted = np.logaddexp(self.log_kt, product) - np.log(2)


def nodes(gram: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits of the last byte before bit k, led by a one; bit k)."""
    symbol = gram & np.uint64(255)
    return (np.uint64(1) << np.uint64(k)) | (symbol >> np.uint64(8 - k)), (symbol >> np.uint64(7 - k)) & np.uint64(1)


def subtree_levels(gram: np.ndarray, count: np.ndarray, k: int) -> list[Level]:
    """Levels of the greatest depth down to 2 at bit k."""
    prefix, bit = nodes(gram, k)
    out = []
    for depth in range(DEPTH, 1, -1):
        context = gram >> np.uint64(8 * (DEPTH - depth + 1))
        out.append(Level((context << np.uint64(8)) | prefix, bit, count))
        if len(out) > 1:
            out[-1].over(out[-2])
    return out


def read_subtree(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    gram = np.concatenate([unpack_sorted(k) for k in part["keys"]])
    count = np.concatenate([unpack_planes(c, np.int64) for c in part["counts"]])
    order = np.argsort(gram)
    return gram[order], count[order]


def summarise(part: pd.DataFrame) -> pd.DataFrame:
    """Counts and weighted probabilities of the nodes of depth 2, added up by their latest context byte."""
    gram, count = read_subtree(part)
    out = []
    for k in range(8):
        two = subtree_levels(gram, count, k)[-1]
        out.append(pd.DataFrame({"latest": (two.key >> np.uint64(16)).astype(np.int64), "node": (two.key & np.uint64(255)).astype(np.int64), "zeros": two.zeros, "ones": two.ones, "product": two.log_weighted}))
    return pd.concat(out, ignore_index=True).groupby(["latest", "node"], as_index=False).sum()


class Top:
    """Depths 1 and 0: dense tables over 256 context bytes and 256 nodes."""

    def __init__(self, rows: list) -> None:
        shape = (256, 256)
        zeros, ones, product = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        for r in rows:
            zeros[r.latest, r.node], ones[r.latest, r.node], product[r.latest, r.node] = r.zeros, r.ones, r.product
        kt = log_kt(zeros, ones)
        self.zeros, self.ones, self.odds = zeros, ones, kt - product
        weighted = np.logaddexp(kt, product) - np.log(2)
        self.zeros0, self.ones0 = zeros.sum(0), ones.sum(0)
        self.odds0 = log_kt(self.zeros0, self.ones0) - np.where(zeros + ones > 0, weighted, 0).sum(0)


def mixed(p: np.ndarray, known: np.ndarray, zeros: np.ndarray, ones: np.ndarray, odds: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mix what deeper nodes say with the estimate of a node, if it was trained."""
    trained = zeros + ones > 0
    estimate = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0)
    stop = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
    both = np.where(known, stop * estimate + (1 - stop) * p, estimate)
    return np.where(trained, both, p), known | trained


def code_lengths(part: pd.DataFrame, top: Top, buckets: int) -> pd.DataFrame:
    """log10 of each string's last byte given its context, to the bucket that answers the blocks."""
    gram, count = read_subtree(part)
    total = np.zeros(len(gram))
    latest = (gram >> np.uint64(8 * DEPTH)).astype(np.int64)
    for k in range(8):
        prefix, bit = nodes(gram, k)
        p, known = np.full(len(gram), 0.5), np.zeros(len(gram), bool)
        for depth, level in zip(range(DEPTH, 1, -1), subtree_levels(gram, count, k), strict=True):
            at = np.searchsorted(level.key, (gram >> np.uint64(8 * (DEPTH - depth + 1)) << np.uint64(8)) | prefix)
            p, known = mixed(p, known, level.zeros[at], level.ones[at], level.odds[at], bit)
        node = prefix.astype(np.int64)
        p, known = mixed(p, known, top.zeros[latest, node], top.ones[latest, node], top.odds[latest, node], bit)
        p, known = mixed(p, known, top.zeros0[node], top.ones0[node], top.odds0[node], bit)
        total += np.log10(p)
    order, edge = by_bucket(gram, buckets)
    gram, total = gram[order], total[order]
    rows = [(b, pack_sorted(gram[edge[b] : edge[b + 1]]), pack_planes(total[edge[b] : edge[b + 1]].astype(np.float32))) for b in range(buckets) if edge[b] < edge[b + 1]]
    return pd.DataFrame(rows, columns=["bucket", "keys", "lengths"])


def answer_grams(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    gram = np.concatenate([unpack_sorted(k) for k in known["keys"]])
    length = np.concatenate([unpack_planes(v, np.float32) for v in known["lengths"]])
    order = np.argsort(gram)
    gram, length = gram[order], length[order]
    parts = [part_bytes(r.bucket, pack_planes(length[np.searchsorted(gram, unpack_sorted(r.keys))])) for r in asked.itertuples()]
    return pd.DataFrame({"block": asked["block"].to_numpy(), "part": parts})


def in_order(parts: list[bytes] | None, dtype: type) -> np.ndarray:
    ordered = sorted((int.from_bytes(p[:8], "little"), p[8:]) for p in (parts if parts is not None else ()))
    return np.concatenate([unpack_planes(p, dtype) for _, p in ordered]) if ordered else np.empty(0, dtype)


def score_blocks(batches: Iterator[pd.DataFrame], buckets: int, tokens: int, distinct: int, ends: int) -> Iterator[pd.DataFrame]:
    base = np.log10(tokens + distinct + 1.0)
    for batch in batches:
        for r in batch.itertuples():
            block = Block(r.ids, r.sizes, r.data)
            s = Strings(block)
            order, _ = by_bucket(s.gram, buckets)
            length = np.empty(len(s.gram))
            length[order] = in_order(r.lengths, np.float32)
            score = np.bincount(s.row_of, length[s.number], len(block.ids))
            words, number, _ = word_table(block)
            count = in_order(r.parts, np.int64)
            value, known = np.log10(count + 1.0) - base, count > 0
            sizes = np.array([len(own) for own in words], np.int64)
            at = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
            row = np.repeat(np.arange(len(sizes)), sizes)
            out = pd.DataFrame({
                "n_tokens": sizes + 1, "n_known": np.bincount(row, known[at], len(sizes)).astype(np.int64) + (ends > 0),
                "base_score": np.bincount(row, value[at], len(sizes)) + np.log10(ends + 1.0) - base,
            })
            out["doc_id"] = pd.array([None if i == NULL_ID else i for i in block.ids.tolist()], "Int64")
            out["held_out"], out["train_tokens"], out["score"] = in_held_out(block.ids), tokens, score
            out["bits_per_byte"] = -score * np.log2(10) / (block.sizes + 1)
            yield out[["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]]


def score_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and bits_per_byte."""
    spark = docs.sparkSession
    blocks = write_blocks(docs, "ctw-blocks", block_bytes)
    buckets = bucket_count(blocks, 1 << 20, 32)
    groups = min(buckets, 1 << 16)
    sent = materialise(blocks.mapInPandas(lambda it: send_counts(it, buckets), "kind int, bucket long, block long, keys binary, counts binary"), "ctw-counts")
    grams, words = sent.filter("kind = 0").drop("kind"), sent.filter("kind = 1").drop("kind")

    word_answers = words.groupBy("bucket").applyInPandas(answer_words, "block long, part binary, tokens long, distinct long")
    word_answers = materialise(word_answers, "ctw-words")
    sums = word_answers.agg(F.sum("tokens"), F.sum("distinct")).first()
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    ends = docs.select("doc_id").filter(~fold).count()
    tokens, distinct = int(sums[0] or 0) + ends, int(sums[1] or 0) + (ends > 0)

    subtrees = materialise(grams.groupBy("bucket").applyInPandas(lambda p: add_grams(p, groups), "subtree long, keys binary, counts binary"), "ctw-strings")
    summary = subtrees.groupBy("subtree").applyInPandas(summarise, "latest long, node long, zeros double, ones double, product double")
    top = spark.sparkContext.broadcast(Top(summary.groupBy("latest", "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("product").alias("product")).collect()))
    lengths = subtrees.groupBy("subtree").applyInPandas(lambda p: code_lengths(p, top.value, buckets), "bucket long, keys binary, lengths binary")
    answers = grams.groupBy("bucket").cogroup(lengths.groupBy("bucket")).applyInPandas(answer_grams, "block long, part binary")

    ready = spans_for(spans_for(blocks, answers).withColumnRenamed("parts", "lengths"), word_answers)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return ready.mapInPandas(lambda it: score_blocks(it, buckets, tokens, distinct, ends), schema)
