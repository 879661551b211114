"""The quality classifier reckoned again from texts to scores: word counts in dictionaries, all pairs of features written out."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np

BUCKETS, STATS, FACTORS = 1 << 14, 14, 8
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALL = (1 << 64) - 1


def bucket_of(word: bytes) -> int:
    h = sum((c + 1) * pow(0xB5297A4D3F84D5B5, i, 1 << 64) for i, c in enumerate(word)) & ALL
    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & ALL
    h = ((h ^ h >> 27) * 0x94D049BB133111EB) & ALL
    return (h ^ h >> 31) % BUCKETS


def lower(text: bytes) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in text)


def measured(text: str | None, n_chars: int | None) -> tuple[list[tuple[int, float]], list[float]]:
    """(bucket, value) of each distinct word, and the statistics of the text."""
    raw = (text or "").encode()
    said = WORD.findall(raw)
    words = [lower(w) for w in said]
    counts = Counter(words)
    norm = math.sqrt(sum(math.log1p(n) ** 2 for n in counts.values()))
    features = [(bucket_of(w), math.log1p(n) / norm) for w, n in counts.items()]
    n, m = max(1, len(raw)), max(1, len(words))
    upper, small = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw)
    digits, white, high = sum(48 <= c <= 57 for c in raw), sum(c in b" \t\n\v\f\r" for c in raw), sum(c >= 128 for c in raw)
    signs = len(raw) - upper - small - digits - white - high
    stats = [
        math.log1p(len(raw)), math.log1p(len(words)), n / m, upper / n / max(1e-9, (upper + small) / n), digits / n, signs / n, high / n, white / n,
        len(counts) / m, max(counts.values(), default=0) / m, sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, raw.count(b"\n") / m,
        sum(w[-1] < 128 and not chr(w[-1]).isalpha() for w in said) / m, math.log1p(len(text or "") if n_chars is None else max(0, n_chars)),
    ]
    return features, stats


class ByHand:
    """Logistic loss and AdaGrad, an example at a time, with the sum over pairs as a sum over pairs."""

    def __init__(self, rows, epochs=12, rate=0.1, seed=7):
        rng = np.random.default_rng(seed)
        size = BUCKETS + STATS
        self.w, self.v = np.zeros(size), rng.normal(0, 0.01, (size, FACTORS))
        stats, y = np.array([s for _, s, _ in rows]), [label for _, _, label in rows]
        self.centre, self.scale = stats.mean(0), np.maximum(stats.std(0), 1e-6)
        share = sum(y) / len(y)
        self.b = math.log(share / (1 - share))
        gw, gv, gb = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(rows)).tolist()
            for batch in (order[k : k + 32] for k in range(0, len(order), 32)):
                dw, dv, db = {}, {}, 0.0
                for i in batch:
                    index, x = self.row(*rows[i][:2])
                    slip = (1 / (1 + math.exp(-self.logit(index, x))) - y[i]) / len(batch)
                    db += slip
                    others = (1 - np.eye(len(x))) @ (self.v[index] * x[:, None])
                    for j, xj, rest in zip(index, x, others, strict=True):
                        dw[j] = dw.get(j, 0.0) + slip * xj
                        dv[j] = dv.get(j, 0.0) + slip * xj * rest
                for j in dw:
                    g, f = dw[j] + 1e-6 * self.w[j], dv[j] + 1e-5 * self.v[j]
                    gw[j] += g * g
                    gv[j] += f * f
                    self.w[j] -= rate * g / math.sqrt(gw[j])
                    self.v[j] -= 0.5 * rate * f / np.sqrt(gv[j])
                gb += db * db
                self.b -= rate * db / math.sqrt(gb)

    def row(self, features, stats):
        shaped = np.clip((np.array(stats) - self.centre) / self.scale, -4, 4) / math.sqrt(STATS)
        return [j for j, _ in features] + [BUCKETS + k for k in range(STATS)], np.array([x for _, x in features] + shaped.tolist())

    def logit(self, index, x):
        meet = (self.v[index] @ self.v[index].T) * np.outer(x, x)
        return float(self.b + self.w[index] @ x + np.triu(meet, 1).sum())

    def score(self, features, stats):
        return 1 / (1 + math.exp(-self.logit(*self.row(features, stats))))


def scores(docs: dict[int, tuple[str | None, int | None]], labels: dict[int, int]) -> dict[int, float]:
    """Scores of documents (text, n_chars), learnt from the labelled ones outside the held-out fold."""
    learnt = [k for k in sorted(docs) if k in labels and zlib.crc32(str(k).encode()) % 5]
    machine = ByHand([(*measured(*docs[k]), labels[k]) for k in learnt])
    return {k: machine.score(*measured(*d)) for k, d in docs.items()}
