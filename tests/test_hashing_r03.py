"""Bucket hashes from hashes of words."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

resampling = pytest.importorskip("ledgerloom.llm.resampling")


def test_hashes_of_runs_follow_from_their_words():
    pick = random.Random(7)
    words = [bytes(pick.choices(b"abc\xc3\xa4019", k=pick.choice([1, 2, 5, 63, 64, 65, 400]))) for _ in range(300)]
    crc, length = np.array([zlib.crc32(w) for w in words], np.uint32), np.array([len(w) for w in words])
    added = np.array([zlib.crc32(w) for w in words[::-1]], np.uint32)
    found = resampling.shifted(crc, length[::-1]) ^ added
    assert found.tolist() == [zlib.crc32(a + b) for a, b in zip(words, words[::-1], strict=True)]
    runs = [words[i : i + k] for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    wanted = np.bincount([resampling.bucket_of(b" ".join(r)) for r in runs], minlength=resampling.BUCKETS)
    assert resampling.Segments([b" ".join(words)]).totals().tolist() == wanted.tolist()
