"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a document with features x is the logistic of ``w0 + <w, x> + 1/2 * sum_f ((V x)_f^2 - (V^2 x^2)_f)``: the
sum-of-squares identity gives all pairwise interactions in time linear in the number of features. Labels, language,
source and identifier are no features; the only metadata used is the stated number of characters.

Fitting takes at most ``max_rows`` labelled documents (a documented bound), those with the smallest hash of their id, so
the same rows whatever the partitioning. Their sparse features, and nothing else, come to the driver. Scoring streams
documents through a pandas UDF with the weights (a fixed size) broadcast; there is no shuffle.

Defined results: null or empty text has only structure features and gets a score like any other; null n_chars counts as
the text's length; labels other than 0 and 1 are ignored, and of conflicting labels of one id the smaller holds; without
labels of both classes every score is the share of label 1, or 0.5 without any; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import ship_package, training_hash
from ledgerloom.llm.words import LOWER, find_words, hash_pieces, joined

WORD_BUCKETS = 1 << 14
STRUCTURE = 14
FACTORS = 8
MAX_ROWS = 4000
THRESHOLD = 0.3
TEXTS_AT_ONCE = 256

_CLASS = np.full(256, 5, np.uint8)
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c in " \t\n\v\f\r" else 4
_ODD_END = np.array([b < 128 and not 97 <= (b | 32 if 65 <= b <= 90 else b) <= 122 for b in range(256)])


def features(texts: list[str | None], n_chars: list[float | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word buckets, word values, structure statistics) of each whole text."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data, edge = joined(raws)
    start, stop = find_words(data)
    hashes, first = hash_pieces(LOWER[data], start, stop), np.searchsorted(start, edge)
    kind = _CLASS[data]
    odd_end = _ODD_END[data[stop - 1]] if len(stop) else np.empty(0, bool)
    found = []
    for k, raw in enumerate(raws):
        mine = slice(first[k], first[k + 1])
        words = hashes[mine]
        distinct, counts = np.unique(words, return_counts=True)
        value = np.log1p(counts)
        value = value / np.sqrt((value * value).sum()) if len(value) else value
        n, m = max(1, len(raw)), max(1, len(words))
        kinds = np.bincount(kind[edge[k] : edge[k + 1] - 1], minlength=6) / n
        letters = max(1e-9, kinds[0] + kinds[1])
        chars = n_chars[k]
        chars = len(texts[k] or "") if chars is None or chars != chars else chars
        stats = np.array(
            [
                np.log1p(len(raw)), np.log1p(len(words)), n / m, kinds[1] / letters, kinds[2], kinds[4], kinds[5], kinds[3],
                len(counts) / m, (counts.max() if len(counts) else 0) / m, (words[1:] == words[:-1]).sum() / m, raw.count(b"\n") / m,
                odd_end[mine].sum() / m, np.log1p(max(0.0, float(chars))),
            ]
        )
        found.append(((distinct % np.uint64(WORD_BUCKETS)).astype(np.int64), value, stats))
    return found


def all_features(texts: list[str | None], n_chars: list[float | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features of many texts, some at a time, so that memory stays near the size of the texts."""
    for lo in range(0, len(texts), TEXTS_AT_ONCE):
        yield from features(texts[lo : lo + TEXTS_AT_ONCE], n_chars[lo : lo + TEXTS_AT_ONCE])


@dataclass
class Machine:
    """Fitted weights; buckets of words come first, then structure statistics."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def row(self, index: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shaped = np.clip((stats - self.centre) / self.scale, -4, 4) / np.sqrt(STRUCTURE)
        return np.concatenate([index, WORD_BUCKETS + np.arange(STRUCTURE)]), np.concatenate([value, shaped])

    def logit(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.factor[index] * value[:, None]
        total = v.sum(0)
        return float(self.bias + self.weight[index] @ value + 0.5 * (total @ total - (v * v).sum()))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], epochs: int = 12, rate: float = 0.1, seed: int = 7) -> Machine:
    """Logistic loss by AdaGrad over mini-batches, in an order fixed by the seed."""
    rng = np.random.default_rng(seed)
    size = WORD_BUCKETS + STRUCTURE
    machine = Machine(0.0, np.zeros(size), rng.normal(0, 0.01, (size, FACTORS)), np.zeros(STRUCTURE), np.ones(STRUCTURE))
    y = np.array([r[3] for r in rows], float)
    if not len(y):
        machine.factor[:] = 0
        return machine
    share = float(y.mean())
    if share in (0.0, 1.0):
        share = min(max(share, 1e-3), 1 - 1e-3)
        machine.bias = float(np.log(share / (1 - share)))
        machine.factor[:] = 0
        return machine
    stats = np.array([r[2] for r in rows])
    machine.centre, machine.scale = stats.mean(0), np.maximum(stats.std(0), 1e-6)
    machine.bias = float(np.log(share / (1 - share)))
    made = [machine.row(*r[:3]) for r in rows]
    sum_w, sum_v, sum_b = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 32):
            batch = [made[i] for i in order[lo : lo + 32]]
            ends = np.cumsum([0, *(len(b[0]) for b in batch)])
            index, value = np.concatenate([b[0] for b in batch]), np.concatenate([b[1] for b in batch])
            owner = np.repeat(np.arange(len(batch)), np.diff(ends))
            v = machine.factor[index] * value[:, None]
            total = np.add.reduceat(v, ends[:-1])
            linear = np.add.reduceat(machine.weight[index] * value, ends[:-1])
            squares = np.add.reduceat((v * v).sum(1), ends[:-1])
            logit = machine.bias + linear + 0.5 * ((total * total).sum(1) - squares)
            slip = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[order[lo : lo + 32]]) / len(batch)
            used, where = np.unique(index, return_inverse=True)
            grad_w = np.bincount(where, slip[owner] * value, len(used)) + 1e-6 * machine.weight[used]
            each = (slip[owner] * value)[:, None] * (total[owner] - v)
            grad_v = np.stack([np.bincount(where, each[:, f], len(used)) for f in range(FACTORS)], 1) + 1e-5 * machine.factor[used]
            sum_w[used] += grad_w**2
            sum_v[used] += grad_v**2
            sum_b += float(slip.sum()) ** 2
            machine.weight[used] -= rate * grad_w / np.sqrt(sum_w[used])
            machine.factor[used] -= 0.5 * rate * grad_v / np.sqrt(sum_v[used])
            machine.bias -= rate * float(slip.sum()) / np.sqrt(sum_b)
    return machine


def held_out(doc_id: Column) -> Column:
    return F.coalesce(training_hash(doc_id) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Machine:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold."""
    ship_package(docs.sparkSession)
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(all_features(batch["text"].tolist(), batch["n_chars"].tolist()))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "label": batch["label"],
                "buckets": [f[0].astype("<u2").tobytes() for f in found],
                "values": [f[1].astype("<f4").tobytes() for f in found],
                "stats": [f[2].tobytes() for f in found],
            })

    rows = docs.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars")).join(F.broadcast(chosen), "doc_id")
    # An id may stand in very many rows: the bound holds for rows too, and the order makes the choice the same each time.
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "n_chars").limit(max_rows)
    found = rows.mapInPandas(run, "doc_id long, label int, buckets binary, values binary, stats binary").toPandas()
    found = found.sort_values(["doc_id", "buckets"], kind="stable")
    rows = [
        (np.frombuffer(r.buckets, "<u2").astype(np.int64), np.frombuffer(r.values, "<f4").astype(float), np.frombuffer(r.stats, float), int(r.label))
        for r in found.itertuples()
    ]
    return fit(rows)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """The documents with their columns in a struct ``row``, and ``score``."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(machine)

    def run(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        fitted = shared.value
        for texts, chars in series:
            logits = [fitted.logit(*fitted.row(*f)) for f in all_features(texts.tolist(), chars.tolist())]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(logits, float), -500, 500))))

    scored = F.pandas_udf(run, T.DoubleType())
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), scored(F.col("text"), F.col("n_chars").cast("double")).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents the classifier accepts, with all their columns."""
    return score(docs, train(docs, labels)).filter(F.col("score") >= threshold).select("row.*")
