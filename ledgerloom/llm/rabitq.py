"""Near-duplicate vectors by randomised-rotation binary codes.

Each vector is normalised and turned by fixed random rotations. The signs are its code, stored once as packed bits with
two correction factors: the inner products of the vector with its code under the even and under the odd rotations. The
even code of one vector and the odd code of another, each divided by its factor, give an unbiased estimate of their
inner product, because the two sets of rotations are independent, and a confidence bound. Only codes and factors meet in
the first pass, which marks the vectors with a pair whose estimate plus bound reaches the threshold; full vectors are
fetched for those alone, and their pairs are recomputed exactly, in double precision, and linked if the exact cosine
reaches the threshold.

Candidates share one of ``bands`` groups of signs. The group width follows the logarithm of the number of vectors and
the number of bands follows from the width, so that a pair at the threshold is missed with a probability of at most
``MISS`` at any size. A pair that shares several bands counts in the first only. Equal vectors form a class that is
compared once. Buckets above ``BLOCK`` members are dealt into blocks, and pairs of blocks go to different tasks, which
return counts and a spanning set of links, never all pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and vectors of different
lengths, are linked with nothing; rows of equal identifiers are rows like others and keep the smallest component; a null
identifier is given, linked with nothing; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, ship_package, whole_groups
from ledgerloom.llm.graph import connected_components

THRESHOLD, MISS, SURE, BLOCK, PER_BUCKET = 0.95, 1e-4, 4.0, 4096, 8
PAIRS_AT_ONCE = 200_000


def plan_bands(count: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(signs in a band, bands) for so many vectors."""
    width = max(4, min(48, round(math.log2(max(1, count / PER_BUCKET)))))
    agree = (1 - math.acos(threshold) / math.pi) ** width
    return width, math.ceil(math.log(miss) / math.log(1 - agree))


def turn_count(size: int, width: int, bands: int) -> int:
    """Rotations of vectors of this length: their signs cover all bands, and there is an even and an odd one."""
    return max(2, -(-width * bands // size))


def rotations(size: int, count: int) -> np.ndarray:
    """Random orthogonal matrices, the same in every task."""
    rng = np.random.default_rng(1000 + size)
    return np.stack([np.linalg.qr(rng.normal(size=(size, size)))[0] for _ in range(count)])


def encode(unit: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed signs under all rotations, correction factors of the even and the odd code) of unit vectors of one length."""
    rotated = np.concatenate([unit @ t for t in turns], 1)
    bits = np.packbits(rotated > 0, axis=1)
    factors = np.stack([np.einsum("ij,ij->i", unit, half) for half in halves(bits, turns)], 1)
    return bits, factors


def signs(bits: np.ndarray, count: int) -> np.ndarray:
    return np.unpackbits(bits, axis=1, count=count).astype(bool)


def halves(bits: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes turned back: the sums of the signed rows of the even rotations, and of the odd ones."""
    count, size, _ = turns.shape
    code = np.where(signs(bits, count * size), 1.0, -1.0).reshape(len(bits), count, size)
    return tuple(np.einsum("nkc,krc->nr", code[:, k::2], turns[k::2], optimize=True) for k in (0, 1))


def band_keys(bits: np.ndarray, width: int, bands: int) -> np.ndarray:
    """One 64-bit key per band from the packed signs."""
    return signs(bits, width * bands).reshape(len(bits), bands, width) @ (np.int64(1) << np.arange(width, dtype=np.int64))


class Estimator:
    """Estimated inner products of vectors of one length, from packed codes and stored factors alone."""

    def __init__(self, bits: np.ndarray, factors: np.ndarray, turns: np.ndarray, threshold: float) -> None:
        even, odd = halves(bits, turns)
        self.even, self.odd = even / factors[:, :1], odd / factors[:, 1:]
        # What lies across the vector: lengths of the parts of the scaled codes that are no part of the vector itself.
        self.across_even = np.sqrt(np.maximum(np.einsum("ij,ij->i", self.even, self.even) - 1, 0))
        self.across_odd = np.sqrt(np.maximum(np.einsum("ij,ij->i", self.odd, self.odd) - 1, 0))
        self.apart, self.sigmas = math.sqrt(max(0.0, 1 - threshold * threshold)), SURE / math.sqrt(max(1, turns.shape[1] - 1))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates for the pairs (i, j), and bounds of the error for pairs at or above the threshold."""
        u, v = self.across_even[i], self.across_odd[j]
        return np.einsum("ij,ij->i", self.even[i], self.odd[j]), self.sigmas * (self.apart * (u + v) + u * v)


def exact_cosine(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j])


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it is linked to through pairs (i, j)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, class_id, n_links, component_id, kept."""
    ship_package(vectors.sparkSession)
    value = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    sound = (
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(value, lambda x: x != 0)
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, F.col("embedding").cast("array<double>")).alias("x"))
    classes = rows.filter("x IS NOT NULL").groupBy("x").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes, "vector-classes")
    width, bands = plan_bands(classes.count(), threshold)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby(batch["x"].map(len)):
                x = np.array(part["x"].tolist(), float)
                # Scaled by the largest component first, so that no square overflows or vanishes.
                x /= np.abs(x).max(1, keepdims=True)
                bits, factors = encode(x / np.sqrt((x * x).sum(1, keepdims=True)), rotations(size, turn_count(size, width, bands)))
                yield part.assign(size=np.int32(size), code=[b.tobytes() for b in bits], even=factors[:, 0], odd=factors[:, 1])

    def band(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby("size"):
                keys = band_keys(code_bits(part), width, bands)
                spread = part.loc[part.index.repeat(bands)]
                yield spread.assign(band=np.tile(np.arange(bands, dtype=np.int32), len(part)), key=keys.ravel())

    coded = materialise(classes.mapInPandas(code, "x array<double>, rep long, copies long, size int, code binary, even double, odd double"), "vector-codes")
    narrow = coded.select("rep", "size", "code", "even", "odd")
    placed = narrow.mapInPandas(band, "rep long, size int, code binary, even double, odd double, band int, key long")
    placed = placed.withColumn("bucket", F.xxhash64("size", "band", "key")).drop("key")
    # Only buckets that need several blocks are looked up, at most one in BLOCK of the rows.
    split = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    # Written, so that Spark knows its size before the join: small, it is broadcast and the codes aren't shuffled for it.
    split = materialise(split.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "vector-splits")
    dealt = placed.join(split, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("crossed", F.col("own") != F.col("other")).withColumn("cell", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cells in whole_groups(batches, "cell"):
            yield mark_cells(cells, width, bands, threshold)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cells in whole_groups(batches, "cell"):
            yield compare_cells(cells, width, bands, threshold)

    met = dealt.select("cell", "rep", "size", "code", "even", "odd", "band", "own", "crossed").repartition("cell").sortWithinPartitions("cell", "rep")
    marked = met.mapInPandas(mark, "cell long, rep long, band int, own int, crossed boolean")
    fetched = marked.join(coded, "rep").repartition("cell").sortWithinPartitions("cell", "rep")
    found = materialise(fetched.mapInPandas(compare, "rep long, links long, low long"), "vector-links")
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("low <> rep").select(F.col("rep").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "rep")
    settled = classes.join(totals, "rep", "left").join(parts, "rep", "left")
    out = rows.join(settled, "x", "left")
    linked = F.col("rep").isNotNull()
    component = F.when(linked, F.coalesce("component", "rep")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id",
        F.coalesce("rep", "vec_id").alias("class_id"),
        F.when(linked, F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )


def code_bits(part: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1)


def candidates(part: pd.DataFrame, width: int, bands: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs within cells, all of one length and sorted by cell and id, that the estimate can't rule out.

    A pair that shares several bands is given in the first of them only.
    """
    size, bits = int(part["size"].iloc[0]), code_bits(part)
    estimate = Estimator(bits, part[["even", "odd"]].to_numpy(), rotations(size, turn_count(size, width, bands)), threshold)
    keys = band_keys(bits, width, bands)
    cell, own, band, crossed = (part[c].to_numpy() for c in ("cell", "own", "band", "crossed"))
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    end = np.repeat(np.r_[start[1:], len(cell)], np.diff(np.r_[start, len(cell)]))
    step, live = 1, np.arange(len(cell))
    while len(live := live[live + step < end[live]]):
        for lo in range(0, len(live), PAIRS_AT_ONCE):
            i = live[lo : lo + PAIRS_AT_ONCE]
            j = i + step
            right = ~crossed[i] | (own[i] != own[j])
            i, j = i[right], j[right]
            guess, bound = estimate(i, j)
            near = guess + bound >= threshold
            i, j = i[near], j[near]
            first = np.argmax(keys[i] == keys[j], 1) == band[i]
            yield i[first], j[first]
        step += 1


def mark_cells(cells: pd.DataFrame, width: int, bands: int, threshold: float) -> pd.DataFrame:
    """Whole cells, sorted by cell and id: the members with a pair to recompute."""
    out = []
    for _, part in cells.groupby("size"):
        hit = np.zeros(len(part), bool)
        for i, j in candidates(part, width, bands, threshold):
            hit[i] = hit[j] = True
        out.append(part.loc[hit, ["cell", "rep", "band", "own", "crossed"]])
    return pd.concat(out, ignore_index=True)


def compare_cells(cells: pd.DataFrame, width: int, bands: int, threshold: float) -> pd.DataFrame:
    """Marked members of whole cells with their vectors: for each its exact links, weighted by copies, and a spanning link."""
    out = []
    for _, part in cells.groupby("size"):
        x, copies, rep = np.array(part["x"].tolist(), float), part["copies"].to_numpy(), part["rep"].to_numpy()
        links, firsts, seconds = np.zeros(len(part), np.int64), [], []
        for i, j in candidates(part, width, bands, threshold):
            near = exact_cosine(x, i, j) >= threshold
            i, j = i[near], j[near]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            firsts.append(i)
            seconds.append(j)
        label = spanning(len(part), np.concatenate(firsts), np.concatenate(seconds)) if firsts else np.arange(len(part))
        hit = links > 0
        # The label is a position; positions within a cell have no order by id, and any spanning link will do.
        out.append(pd.DataFrame({"rep": rep[hit], "links": links[hit], "low": rep[label[hit]]}))
    return pd.concat(out, ignore_index=True)
