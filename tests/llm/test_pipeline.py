"""The corpus pipeline, stage by stage, against brute force on its own input."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import quality_by_hand
from tokenizers import Tokenizer

from ledgerloom.llm.common import materialise

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SPACE = re.compile(r"[ \t-\r]+")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    folder = str(tmp_path_factory.mktemp("tables"))
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(60, 120))) for _ in range(80)]
    texts += [texts[0], texts[1].replace(" ", "  "), texts[2] + " changed", texts[3][:300] + " " + " ".join(rng.choices(vocabulary, k=80))]
    texts += [texts[5][:200] + texts[4], texts[4] + " one more", "é" * 30 + texts[6][50:130], "", " \n", None, None]
    junk = [" ".join(w.upper() + rng.choice(["!!", "%%%"]) for w in rng.choices(vocabulary, k=80)) for _ in range(40)]
    rows = [(k, t, "en", "s", None if t is None else len(t), "x", "y") for k, t in enumerate([*texts, *junk])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string, kept string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k < len(texts)), 0) for k in range(len(rows))], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {r[0]: r[1] for r in rows}, {r[0]: int(r[0] < len(texts)) for r in rows}


def exact_by_hand(docs):
    first = {}
    for k in sorted(docs):
        first.setdefault(SPACE.sub(" ", docs[k] or ""), k)
    return {k: docs[k] for k in first.values()}


def near_by_hand(docs):
    def shingles(text):
        words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, head = {k: shingles(t) for k, t in docs.items()}, {k: k for k in docs}
    linked = [(a, b) for a in docs for b in docs if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while any(head[a] != head[b] for a, b in linked):
        for a, b in linked:
            head[a] = head[b] = min(head[a], head[b])
    return {k: t for k, t in docs.items() if head[k] == k}


def substrings_by_hand(docs):
    data, first, out = {k: (t or "").encode() for k, t in docs.items()}, {}, {}
    for k in sorted(data):
        for i in range(len(data[k]) - 49):
            first.setdefault(data[k][i : i + 50], k)
    for k, x in data.items():
        gone = [False] * len(x)
        for i in range(len(x) - 49):
            if first[x[i : i + 50]] < k:
                gone[i : i + 50] = [True] * 50
        at, kept = 0, ""
        for c in docs[k] or "":  # a character goes when all of its bytes do
            size = len(c.encode())
            kept += "" if all(gone[at : at + size]) else c
            at += size
        out[k] = kept
    return out


def test_stages(spark, tables):
    folder, texts, labels = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, own = docs.columns, texts
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "quality classifier":
            scores = quality_by_hand.scores({k: (t, None if t is None else len(t)) for k, t in own.items()}, labels)
            assert all(abs(s - 0.3) > 1e-3 for s in scores.values())
            wanted = {k: t for k, t in own.items() if scores[k] >= 0.3}
            assert 0 < len(wanted) < len(own)
        else:
            wanted = {"exact dedup": exact_by_hand, "MinHash near-dedup": near_by_hand, "suffix-array dedup": substrings_by_hand}[name](own)
            assert wanted != own
        docs = materialise(stage(spark, docs, folder), "stage")
        assert docs.columns == columns
        rows = docs.collect()
        assert len(rows) == len(wanted) and {r.doc_id: r.text for r in rows} == wanted, name
        assert {(r.lang, r.source, r.extra, r.kept) for r in rows} == {("en", "s", "x", "y")}
        own = wanted
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 2] for k, t in own.items()}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    whole = corpus_pipeline.run(spark, folder).collect()
    for pieces in (last, whole):
        got, filled = defaultdict(list), defaultdict(int)
        for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
            assert r.start == len(got[r.doc_id])
            got[r.doc_id] += np.frombuffer(bytes(r.ids), "<u4").tolist()
            filled[r.sequence_id] += r.length
        assert got == ids and max(filled.values()) <= 4096


def test_run_on_an_empty_table(spark, tables, tmp_path):
    folder = tables[0]
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
