"""Words of many texts at once: places and 64-bit hashes, by numpy.

A word is a maximal piece without ASCII white space. ``hash_words`` takes eight bytes a step and mixes all bits between
two steps, so words that differ collide by chance only; words above 256 bytes are hashed by xxh3. ``hash_windows`` hashes
the bytes of runs of words, whose order and bounds count, and is what decisions rest on. ``hash_pieces`` is a polynomial
modulo 2^64 for overlapping pieces; structured pieces can collide, so its users compare bytes or need no more than
buckets.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Fixed value: the white space of every contract of this subpackage.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SPACE = np.zeros(256, bool)
SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK = 1 << 18
_BASE = 0xB5297A4D3F84D5B5
_powers = np.ones((2, 1), np.uint64)


def _power_table(size: int) -> np.ndarray:
    """Powers of the base and of its inverse modulo 2^64, as many as the longest chunk so far needed."""
    global _powers
    if _powers.shape[1] < size:
        table = np.empty((2, size), np.uint64)
        table[:, 0] = 1
        table[0, 1:], table[1, 1:] = _BASE, pow(_BASE, -1, 1 << 64)
        _powers = np.cumprod(table, axis=1, dtype=np.uint64)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def find_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    edge = np.diff(SPACE[data].astype(np.int8), prepend=np.int8(1), append=np.int8(1))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


LONG = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hash_words(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """One hash per word, eight bytes a step."""
    size = (stop - start).astype(np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = mix(size.astype(np.uint64) * _STEP)
    live, at = np.flatnonzero(size <= LONG), 0
    while len(live):
        left = size[live] - at
        chunk = eight[start[live] + at] & _MASK[np.minimum(left, 8)]
        h[live] = mix((h[live] ^ chunk) + _STEP)
        live, at = live[left > 8], at + 8
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[start[k] : stop[k]])
    return h


def single_spaced(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space after each, and where each word starts and stops there."""
    size = stop - start
    where = np.concatenate([[0], np.cumsum(size + 1)])
    keep = ~SPACE[data]
    if len(data):
        keep[stop[stop < len(data)]] = True
    out = data[keep]
    out = np.where(SPACE[out], np.uint8(0x20), out)
    return out.tobytes(), where[:-1], where[:-1] + size


def hash_windows(flat: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """xxh3 of the bytes of each window of single-spaced words."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(flat[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)), np.uint64, len(start))


def hash_pieces(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A polynomial of each piece, some hundred kilobytes of text at a time; pieces may overlap."""
    out = np.empty(len(start), np.uint64)
    k = 0
    while k < len(start):
        low = start[k]
        end = max(k + 1, int(np.searchsorted(stop, low + CHUNK, "right")))
        piece = data[low : stop[end - 1]]
        power = _power_table(max(CHUNK, len(piece)) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * power[0, : len(piece)], out=total[1:])
        a, b = start[k:end] - low, stop[k:end] - low
        out[k:end] = (total[b] - total[a]) * power[1][a]
        k = end
    return mix(out)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, each followed by a line end, and where each begins (one more entry for the end)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """So many powers of the base and of its inverse."""
    table = _power_table(size)
    return table[0], table[1]
