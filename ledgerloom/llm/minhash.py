"""MinHash near-duplicates with sequential Bayesian verification.

1. Every document becomes its set of five-word shingles (xxh3 of a shingle's bytes), a digest of the set and a signature of 128
   minima. Documents with equal sets form a class, told apart by the digest; its smallest identifier speaks for it.
2. Signatures are cut into 32 bands. In each bucket that classes share, every class is paired with the smallest one and
   with the most central one, so a bucket of g classes gives less than 2 * g pairs and not g * g / 2.
3. A pair's signatures are compared in batches of 16. After each batch the posterior of the similarity under a uniform
   prior is looked up, and the pair is dropped when the probability of reaching the threshold is below ``MISS``.
4. Survivors are verified exactly on their full sets, and links form components.
5. Classes that share a bucket but ended in different components meet in cells, one bucket or two blocks of a large one.
   A first pass compares signatures inside the cells and only marks the classes that have a surviving partner; a second
   brings the sets of the marked ones, verifies each surviving pair where it stands, in the first band it shares, and
   gives back a spanning set of links. So every candidate pair is decided, and no pair is ever a row.

Defined results: null or empty text has no shingle and is linked with nothing; a text of one to four words has its whole
sequence as its only shingle; rows with equal sets are linked; rows of one identifier are one node, with the links of all
their texts; a null identifier is never the smallest and is linked with nothing; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import discard, materialise, ship_package, whole_groups
from ledgerloom.llm.graph import connected_components
from ledgerloom.llm.words import LOWER, find_words, hash_windows, joined, single_spaced

WIDTH, HASHES, ROWS, BATCH, MISS = 5, 128, 4, 16, 1e-6
PER_CENT = 75
BLOCK, PAIRS_AT_ONCE, TEXTS_AT_ONCE = 512, 100_000, 256
_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1, 2**32, HASHES, np.uint32) | np.uint32(1)
_FLIP = _rng.integers(0, 2**32, HASHES, np.uint32)


def shingles(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The shingle set of each whole text, sorted distinct xxh3 hashes of the shingles' bytes, some texts at a time."""
    for lo in range(0, len(texts), TEXTS_AT_ONCE):
        data, edge = joined([(t or "").encode("utf-8", "surrogatepass") for t in texts[lo : lo + TEXTS_AT_ONCE]])
        data = LOWER[data]
        begin, end = find_words(data)
        first = np.searchsorted(begin, edge)
        flat, start, stop = single_spaced(data, begin, end)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            width = min(WIDTH, b - a)
            yield np.unique(hash_windows(flat, start[a : b - width + 1], stop[a + width - 1 : b])) if width else np.empty(0, np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    """The 128 minima over a set, 1024 shingles at a time."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, len(short), 1024):
        block = (short[lo : lo + 1024, None] ^ _FLIP) * _MULTIPLY
        np.minimum(low, block.min(0), out=low)
    return low


def fewest_matches(threshold: float = PER_CENT / 100, miss: float = MISS) -> list[int]:
    """For each number of batches seen, the smallest number of equal minima that keeps a pair alive.

    With m of n minima equal and a uniform prior the similarity follows Beta(m + 1, n - m + 1), and the chance of a
    similarity of at least t is the binomial sum over i <= m of C(n + 1, i) t^i (1 - t)^(n + 1 - i).
    """
    found = []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found.append(m)
    return found


def digest_of(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest and sig of every row; both null without shingles."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(len(s), digest_of(s), signature(s).tobytes() if len(s) else None) for s in shingles(batch["text"].tolist())]
            sizes, digests, sigs = zip(*rows, strict=True) if rows else ((), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": sizes, "digest": digests, "sig": sigs})

    # Identifiers travel as text: a null among them would otherwise turn them all into floating-point numbers.
    chosen = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
    found = chosen.mapInPandas(run, "doc_id string, n_shingles long, digest binary, sig binary")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def surviving(left: np.ndarray, right: np.ndarray, needed: list[int]) -> np.ndarray:
    """Positions of the pairs of signatures that stay alive through all batches."""
    live, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for k, least in enumerate(needed):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        matches += (left[live, cut] == right[live, cut]).sum(1)
        alive = matches >= least
        live, matches = live[alive], matches[alive]
    return live


def bayes_filter(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes (a, b) that survive the sequential comparison of their signatures."""
    needed = fewest_matches()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                left, right = (np.frombuffer(b"".join(batch[c]), np.uint32).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
                yield batch.iloc[surviving(left, right, needed)][["a", "b"]]

    a, b = (classes.select(F.col("class").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}")) for x in "ab")
    sized = pairs.join(a, "a").join(b, "b").filter(f"100 * least(n_a, n_b) >= {PER_CENT} * greatest(n_a, n_b)")
    return sized.select("a", "b", "sig_a", "sig_b").mapInPandas(run, "a long, b long")


def similar(u: np.ndarray, v: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold, exactly."""
    both = np.concatenate([u, v])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= PER_CENT * (len(u) + len(v) - shared)


def set_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class and its full set, as sorted little-endian 64-bit hashes, for the given classes (class, rep, digest)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = list(shingles(batch["text"].tolist()))
            yield pd.DataFrame({"digest": [digest_of(s) for s in sets], "set": [s.tobytes() for s in sets]})

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted.select("rep"), "rep", "left_semi")
    found = texts.select("text").mapInPandas(run, "digest binary, set binary").groupBy("digest").agg(F.first("set").alias("set"))
    return found.join(wanted, "digest").select("class", "set")


def exact_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets have at least the threshold similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch["set_a"], batch["set_b"], strict=True)]
            yield batch[np.array(keep, bool)][["a", "b"]]

    a, b = (sets.select(F.col("class").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b").mapInPandas(run, "a long, b long")


def deal_cells(placed: DataFrame, block: int) -> DataFrame:
    """Members of buckets (bucket, band, class, component) dealt into cells.

    A bucket above ``block`` members is cut into blocks, and each pair of its blocks is a cell of its own, so a task
    holds two blocks at most.
    """
    sizes = placed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = placed.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("cell")
    return dealt.select("class", "component", "band", "own", (F.col("own") == F.col("other")).alias("alone"), cell)


class Cells:
    """Whole cells, sorted by cell, with signatures: walks over their undecided pairs."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.sig = np.frombuffer(b"".join(rows["sig"]), np.uint32).reshape(-1, HASHES)
        self.cell, self.component, self.size, self.band, self.own, self.alone = (rows[c].to_numpy() for c in ("cell", "component", "n_shingles", "band", "own", "alone"))
        self.bands = self.sig.reshape(len(self.sig), HASHES // ROWS, ROWS)
        self.needed = fewest_matches()

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different components that survive their signatures, each in the first band it shares."""
        start = np.flatnonzero(np.concatenate([[True], self.cell[1:] != self.cell[:-1]]))
        end = np.repeat(np.append(start[1:], len(self.cell)), np.diff(np.append(start, len(self.cell))))
        step, live = 1, np.arange(len(self.cell))
        while len(live := live[live + step < end[live]]):
            for lo in range(0, len(live), PAIRS_AT_ONCE):
                i = live[lo : lo + PAIRS_AT_ONCE]
                j = i + step
                small, large = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
                open_pair = (self.component[i] != self.component[j]) & (self.alone[i] | (self.own[i] != self.own[j])) & (100 * small >= PER_CENT * large)
                i, j = i[open_pair], j[open_pair]
                alive = surviving(self.sig[i], self.sig[j], self.needed)
                i, j = i[alive], j[alive]
                first = (self.bands[i] == self.bands[j]).all(2).argmax(1) == self.band[i]
                if first.any():
                    yield i[first], j[first]
            step += 1


def mark_cells(rows: pd.DataFrame) -> np.ndarray:
    """Which members have a surviving partner."""
    marked = np.zeros(len(rows), bool)
    for i, j in Cells(rows).pairs():
        marked[i] = marked[j] = True
    return marked


def link_cells(rows: pd.DataFrame) -> pd.DataFrame:
    """A spanning set of the verified links between components, as pairs (a, b) of components."""
    number, label = np.unique(rows["component"].to_numpy(), return_inverse=True)
    parent = list(range(len(number)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sets, found = [np.frombuffer(s, np.uint64) for s in rows["set"]], []
    for left, right in Cells(rows).pairs():
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            a, b = find(int(label[i])), find(int(label[j]))
            if a != b and similar(sets[i], sets[j]):
                parent[max(a, b)] = min(a, b)
                found.append((number[max(a, b)], number[min(a, b)]))
    return pd.DataFrame(found, columns=["a", "b"])


def cell_links(placed: DataFrame, classes: DataFrame, docs: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Links between components, verified in the cells where their members meet."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cells in whole_groups(batches, "cell"):
            yield cells[mark_cells(cells)][["class", "component", "band", "own", "alone", "cell"]]

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cells in whole_groups(batches, "cell"):
            yield link_cells(cells)

    rows = deal_cells(placed, block).join(classes.select("class", "n_shingles", "sig"), "class")
    marked = rows.repartition("cell").sortWithinPartitions("cell").mapInPandas(mark, "class long, component long, band int, own int, alone boolean, cell long")
    marked = materialise(marked, "minhash-marked")
    more = marked.select("class").distinct().join(sets.select("class"), "class", "left_anti")
    more = materialise(set_table(docs, classes.select("class", "rep", "digest").join(more, "class", "left_semi")), "minhash-sets")
    rows = marked.join(classes.select("class", "n_shingles", "sig"), "class").join(sets.union(more), "class")
    links = materialise(rows.repartition("cell").sortWithinPartitions("cell").mapInPandas(link, "a long, b long"), "minhash-links")
    discard(marked, more)
    return links


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (documents with the same set), component_id, kept."""
    sketched = materialise(sketch(docs), "minhash-sketch")
    known = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = materialise(classes.withColumn("class", F.monotonically_increasing_id()), "minhash-classes")
    members = sketched.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    members = materialise(members.join(classes.select("digest", "rep"), "digest", "left").drop("digest"), "minhash-members")
    discard(sketched)

    bytes_in_band = 4 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", k * bytes_in_band + 1, bytes_in_band)) for k in range(HASHES // ROWS)])
    bands = classes.select("class", F.posexplode(keys).alias("band", "bucket"))
    crowded = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowd = materialise(bands.join(crowded, "bucket"), "minhash-crowd")
    # The original of many copies agrees with them in most bands: it is the member with the most company.
    company = crowd.groupBy("class").agg(F.sum("n").alias("company"))
    central = F.max_by("class", F.struct("company", "class")).alias("central")
    heads = crowd.join(company, "class").groupBy("bucket").agg(F.min("class").alias("head"), central)
    shared = materialise(crowd.drop("n").join(heads, "bucket"), "minhash-shared")
    discard(crowd)

    pairs = [shared.filter(F.col(h) != F.col("class")).select(F.least(h, "class").alias("a"), F.greatest(h, "class").alias("b")) for h in ("head", "central")]
    alive = materialise(bayes_filter(pairs[0].union(pairs[1]).distinct(), classes), "minhash-alive")
    touched = alive.select(F.col("a").alias("class")).union(alive.select(F.col("b").alias("class"))).distinct()
    sets = materialise(set_table(docs, classes.select("class", "rep", "digest").join(touched, "class", "left_semi")), "minhash-sets")
    links = materialise(exact_links(alive, sets), "minhash-links")
    discard(alive)
    rep_of = classes.select("class", "rep")
    links = links.join(rep_of.select(F.col("class").alias("a"), F.col("rep").alias("x")), "a").join(rep_of.select(F.col("class").alias("b"), F.col("rep").alias("y")), "b")
    # Rows of one identifier are one node: its texts' classes belong together.
    twins = members.filter("rep IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high")).filter("n > 1 AND low < high")
    twins = members.join(twins.select("doc_id", "low"), "doc_id").filter("rep > low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    first = connected_components(links.select(F.col("x").alias("a"), F.col("y").alias("b")).union(twins))

    # What shares a bucket across components: everything else is settled.
    placed = shared.select("bucket", "band", "class").join(rep_of, "class").join(first, F.col("rep") == F.col("node"), "left")
    placed = placed.select("bucket", "band", "class", F.coalesce("component", "rep").alias("component"))
    open_buckets = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
    placed = materialise(placed.join(open_buckets, "bucket", "left_semi"), "minhash-open")
    discard(shared)
    late = cell_links(placed, classes, docs, sets, block)
    discard(placed, sets)
    second = connected_components(late)
    # A node of the second graph is a component of the first, or a document that had no link in the first.
    final = first.select(F.col("node").alias("rep"), F.col("component").alias("low")).join(second, F.col("low") == F.col("node"), "full")
    final = final.select(F.coalesce("rep", "node").alias("rep"), F.coalesce("component", "low").alias("component"))
    found = members.join(final, "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return found.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("class_id"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group of near-duplicates, with all their columns.

    Of rows that share the identifier that stays, all are kept.
    """
    gone = near_duplicates(docs).filter("NOT kept").select("doc_id").distinct().alias("gone")
    return docs.alias("docs").join(gone, F.col("docs.doc_id").cast("long") == F.col("gone.doc_id"), "left_anti")
