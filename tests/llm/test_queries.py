"""The query functions on a small table against brute force: derived columns, digests, null and very long texts."""

from __future__ import annotations

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import quality_by_hand
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import queries

DATA = Path("/root/testdata")


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(12)
    folder = f"file://{tmp_path_factory.mktemp('query')}"
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(90)]
    shared = " ".join(rng.choices(words, k=30))
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 80))) + (f" {shared} " if k % 4 == 0 else "") for k in range(40)]
    texts += [None, "", " \n", "A B", texts[0], " ".join(rng.choices(words, k=20_000))]
    rows = [(k, t, "en", "s", None if t is None else len(t), "x", "y") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block string, kept string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, texts


def rows_of(query, spark, folder):
    return {r.doc_id: r for r in query(spark, folder).collect()}


def test_op1_columns(spark, table):
    folder, texts = table
    data, first = [(t or "").encode() for t in texts], {}
    for k, x in enumerate(data):
        for i in range(len(x) - 49):
            first.setdefault(x[i : i + 50], k)
    found = rows_of(queries.op1_suffix_dedup, spark, folder)
    for k, x in enumerate(data):
        gone = bytearray(len(x))
        for i in range(len(x) - 49):
            if first[x[i : i + 50]] < k:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        assert (found[k].n_bytes, found[k].n_removed, found[k].n_spans, found[k].kept_sha256) == (len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_op9_columns(spark, table):
    folder, texts = table
    words, first = [(t or "").encode().split() for t in texts], {}
    for k, w in enumerate(words):
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), k)
    found = rows_of(queries.op9_recompression, spark, folder)
    for k, w in enumerate(words):
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < k:
                gone[i : i + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (found[k].n_words, found[k].n_removed, found[k].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())


def test_op5_and_op7_columns(spark, table):
    folder, texts = table
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for k, t in enumerate(texts)}
    pieces = sorted(queries.op5_packing(spark, folder).collect(), key=lambda r: (r.doc_id, r.start))
    at = dict.fromkeys(ids, 0)
    for r in pieces:
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert at == {k: len(x) for k, x in ids.items()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, r in rows_of(queries.op7_bpe, spark, folder).items():
        coded = library.encode(texts[k] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(coded), hashlib.sha256(np.array(coded, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(coded, skip_special_tokens=False).encode()).hexdigest()


def test_op10_columns(spark, table, tmp_path):
    folder, texts = table
    spark.read.parquet(f"{folder}/documents.parquet").write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = {k: int(k % 3 > 0) for k in range(len(texts))}
    spark.createDataFrame([(k, y, 0) for k, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    wanted = quality_by_hand.scores({k: (t, None if t is None else len(t)) for k, t in enumerate(texts)}, labels)
    found = rows_of(queries.op10_quality, spark, f"file://{tmp_path}")
    assert len(found) == len(texts)
    for k, r in found.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
        assert r.score == pytest.approx(wanted[k], abs=1e-4)


@pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")
@pytest.mark.parametrize(("scale", "lowest"), [("sf0.01", 0.95), ("sf0.1", 0.99)])
def test_op10_held_out_accuracy(spark, scale, lowest):
    """Accuracy grows with the labelled rows: a tenth of the table lets more junk pass."""
    folder = DATA / scale
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").filter("quality IN (0, 1)").collect()}
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in queries.op10_quality(spark, str(folder)).filter("held_out").collect() if r.doc_id in labels]
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) >= 0.99
    right = sum(p * y for _, p, y in held)
    assert 2 * right / (sum(p for _, p, _ in held) + len(good)) >= lowest


def test_op2_columns(spark, table):
    folder, texts = table
    found = queries.op2_ctw(spark, folder)
    learnt = [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 7 != 2]
    lower = [[w for w in "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()] + [None] for t in texts]
    n = sum(len(lower[k]) for k in learnt)
    known = {w for k in learnt for w in lower[k]}
    for r in found.filter(F.col("doc_id") < 44).collect():
        w = lower[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id not in learnt, len(w), sum(x in known for x in w), n)
