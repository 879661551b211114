"""Importance resampling towards a target distribution, with segment deduplication.

Features are runs of one to three words, counted in hashed buckets over all documents and over all target texts. The
logarithm of the two smoothed shares is a bucket's gain, and a document's weight is the sum of the gains of its features;
Gumbel noise from a hash of the identifier turns the highest scores into a draw without replacement.

Line ends separate words, so a text is cut into lines. In a stretch of texts each distinct line is looked at once: its
words, the buckets of the runs inside it. Counts are multiplied by the line's occurrences, weights are added up by
occurrence. Runs across line ends are made from the two last words of a line and the first ones of the lines that
follow, each distinct one once, and added separately.

Nothing but a count for each bucket leaves a task in the first pass, and the gains, of that fixed size, are broadcast for
the second. The order over all documents is a range-partitioned sort of narrow rows; ranks are the rows before a partition
and the place inside it.

Defined results: null or empty text has no feature and weight 0; without target texts, or without documents, all counts
are 0 on that side; rows of one identifier have the same noise, and are ordered by their counts where scores tie; a null
identifier hashes as the empty string and is the largest; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, ship_package

BUCKETS, LONGEST = 10_000, 3
SEED, MIN_WORDS, PER_CENT = 42, 20, 5
STEP_BYTES = 8 << 20
#: Fixed value: a word is a run of digits, lower-case letters and all that isn't ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = bytes(range(65, 91))
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


BLANK = zlib.crc32(b" ")
#: Lengths in bytes for which a CRC is moved by tables; longer words are moved one by one.
TABLED = 64


def _advanced(crc: np.ndarray) -> np.ndarray:
    """The raw remainders after one more byte of zero."""
    return (crc >> np.uint32(8)) ^ _BYTE[crc & np.uint32(255)]


def _tables() -> np.ndarray:
    """For each length up to ``TABLED`` and each of a remainder's four bytes, what that many bytes of zero turn it into."""
    out = np.empty((TABLED + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for n in range(TABLED):
        out[n + 1] = _advanced(out[n])
    return out


#: The raw remainder of each byte: the difference to the byte of zero takes the CRC's fixed part away.
_BYTE = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
_TABLES = _tables().ravel()


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What CRCs become when texts of the given lengths follow, whose own CRCs are still to be added (by exclusive or)."""
    at = np.minimum(lengths, TABLED) * 1024
    out = np.zeros(len(crc), np.uint32)
    for k in range(4):
        out ^= _TABLES[at + (k * 256 + ((crc >> np.uint32(8 * k)) & np.uint32(255)).astype(np.int64))]
    rest = lengths - TABLED
    for i in np.flatnonzero(rest > 0).tolist():
        zeros = bytes(int(rest[i]))
        out[i] = zlib.crc32(zeros, int(out[i])) ^ zlib.crc32(zeros)
    return out


def bucket_of(feature: bytes) -> int:
    return zlib.crc32(feature) % BUCKETS


class Segments:
    """The distinct lines of a stretch of texts and their features; texts as sequences of those lines."""

    def __init__(self, texts: list[bytes]) -> None:
        number: dict[bytes, int] = {}
        sequence: list[int] = []
        sizes: list[int] = []
        for text in texts:
            lines = text.translate(LOWERED).split(b"\n")
            sizes.append(len(lines))
            sequence += [number.setdefault(line, len(number)) for line in lines]
        self.words = [WORD.findall(line) for line in number]
        self.count = np.array([len(w) for w in self.words], np.int64)
        # Texts as lines with words only: a line without one separates nothing.
        seq, owner = np.array(sequence, np.int64), np.repeat(np.arange(len(texts)), sizes)
        full = self.count[seq] > 0 if len(seq) else np.empty(0, bool)
        self.line, self.owner, self.texts = seq[full], owner[full], len(texts)
        self._inside()
        self._across()

    def _inside(self) -> None:
        """Buckets of the runs inside each distinct line, all lines one after another."""
        known: dict[bytes, int] = {}
        which = np.array([known.setdefault(w, len(known)) for words in self.words for w in words], np.int64)
        line = np.repeat(np.arange(len(self.count)), self.count)
        # A run's CRC follows from its words': each word is read once as it is and once after a blank.
        alone = np.fromiter(map(zlib.crc32, known), np.uint32, len(known))
        after = np.fromiter((zlib.crc32(w, BLANK) for w in known), np.uint32, len(known))
        shift = np.fromiter((len(w) + 1 for w in known), np.int64, len(known))
        made, found, owners = alone[which], [], []
        for width in range(1, LONGEST + 1):
            n = max(0, len(line) - width + 1)
            if width > 1:
                last = which[width - 1 :]
                made = shifted(made[:n], shift[last]) ^ after[last]
            first = np.flatnonzero(line[:n] == line[width - 1 :])
            found.append(made[first].astype(np.int64))
            owners.append(line[first])
        self.inside, self.inside_line = np.concatenate(found) % BUCKETS, np.concatenate(owners)

    def _across(self) -> None:
        """Buckets of the runs across line ends, each with its text; equal runs are hashed once."""
        line, owner, n = self.line, self.owner, len(self.line)
        one = np.flatnonzero(owner[:-1] == owner[1:])  # a line that another one follows
        after = line[np.minimum(one + 1, max(0, n - 1))]
        third = one[(np.minimum(one + 2, n - 1) == one + 2) & (owner[np.minimum(one + 2, n - 1)] == owner[one])] if n else one
        single = self.count[line[np.minimum(third + 1, n - 1)]] == 1 if len(third) else np.empty(0, bool)
        third = third[single]
        found: list[np.ndarray] = []
        texts: list[np.ndarray] = []
        # Which lines make up the run, and how many words of the first and of the second.
        shapes = [
            (one, line[one], after, None, 1, 1),
            *[(x, line[x], line[x + 1], None, a, b) for a, b in ((2, 1), (1, 2)) for x in [one[(self.count[line[one]] >= a) & (self.count[after] >= b)]]],
            (third, line[third], line[third + 1] if len(third) else third, line[third + 2] if len(third) else third, 1, 1),
        ]
        for place, left, right, last, a, b in shapes:
            if not len(place):
                continue
            lines = np.stack([left, right] if last is None else [left, right, last], 1)
            distinct, where = np.unique(lines, axis=0, return_inverse=True)
            made = [
                bucket_of(b" ".join([*self.words[r[0]][-a:], *self.words[r[1]][:b], *(self.words[r[2]][:1] if len(r) == 3 else ())]))
                for r in distinct.tolist()
            ]
            found.append(np.array(made, np.int64)[where.ravel()])
            texts.append(owner[place])
        self.across = np.concatenate(found) if found else np.empty(0, np.int64)
        self.across_text = np.concatenate(texts) if texts else np.empty(0, np.int64)

    def totals(self) -> np.ndarray:
        """How often each bucket occurs in all texts."""
        times = np.bincount(self.line, minlength=len(self.count))
        inside = np.bincount(self.inside, times[self.inside_line], BUCKETS).astype(np.int64)
        return inside + np.bincount(self.across, minlength=BUCKETS)

    def words_of_texts(self) -> np.ndarray:
        return np.bincount(self.owner, self.count[self.line], self.texts).astype(np.int64)

    def weights(self, gain: np.ndarray) -> np.ndarray:
        """The sum of the gains of each text's features."""
        of_line = np.zeros(len(self.count), np.int64)
        np.add.at(of_line, self.inside_line, gain[self.inside])
        out = np.zeros(self.texts, np.int64)
        np.add.at(out, self.owner, of_line[self.line])
        np.add.at(out, self.across_text, gain[self.across])
        return out


def stretches(texts: pd.Series) -> Iterator[list[bytes]]:
    """The texts in bytes, some megabytes at a time."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        coded = b"" if text is None else text.encode("utf-8", "surrogatepass")
        held.append(coded)
        size += len(coded) + 64
        if size >= STEP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts of the table; only these counts come to the driver."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for texts in stretches(batch["text"]):
                total += Segments(texts).totals()
        there = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": there.astype(np.int32), "n": total[there]})

    counts = docs.select("text").mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[counts["bucket"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket: the smoothed share in the target against that in the source, in thousandths of a natural logarithm."""
    s_all, t_all = float(source.sum()), float(target.sum())
    found = [math.floor(1000 * math.log((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array(found, np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, weights = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for texts in stretches(batch["text"]):
                segments = Segments(texts)
                words.append(segments.words_of_texts())
                weights.append(segments.weights(shared.value))
            n = np.concatenate(words)
            features = sum(np.maximum(n - k, 0) for k in range(LONGEST))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": n, "n_features": features, "weight": np.concatenate(weights)})

    # Identifiers travel as text: a null among them would otherwise turn them all into floating-point numbers.
    chosen = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
    made = chosen.mapInPandas(run, "doc_id string, n_words long, n_features long, weight long")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the identifier."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The rows with their rank in the given order, null beyond the limit: a range-partitioned sort, and the rows before each partition."""
    place = F.monotonically_increasing_id()
    placed = rows.orderBy(*order).withColumns({"__part": F.shiftright(place, 33), "__at": place.bitwiseAND(F.lit((1 << 33) - 1))})
    placed = materialise(placed, "resampling-order")
    before, offsets = 0, []
    for part, n in sorted(tuple(r) for r in placed.groupBy("__part").count().collect()):  # one number for each partition
        offsets.append((part, before))
        before += n
    offset = F.broadcast(rows.sparkSession.createDataFrame(offsets, "__part long, __before long"))
    rank = F.col("__before") + F.col("__at") + 1
    return placed.join(offset, "__part", "left").select(*rows.columns, F.when(rank <= limit, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, min_words: int = MIN_WORDS, per_cent: int = PER_CENT, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (1, 2, ... of the drawn ones, else null)."""
    weighed = weigh(docs, gains(bucket_counts(docs), bucket_counts(target)))
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    # Equal rows may be ordered anyhow; a number that spreads them keeps a hot identifier from one partition.
    scored = materialise(scored.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "resampling-scores")
    fit = scored.filter(F.col("n_words") >= min_words)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("salt")]
    drawn = ranked(fit, order, per_cent * fit.count() // 100)
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
