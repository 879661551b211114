"""Deduplication operators against brute force on small fixtures, with hard cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, minhash, rabitq, recompression, suffix_dedup
from ledgerloom.llm.graph import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None, extra=""):
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("kept", F.lit("clash")).withColumn("block", F.lit(1)) if extra else df


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgé日", k=rng.randint(1, 6))) for _ in range(80)]
    shared = " ".join(rng.choices(vocabulary, k=40))
    texts = []
    for k in range(n):
        words = rng.choices(vocabulary, k=rng.randint(0, 120))
        if k % 3 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = shared.split(" ")
        texts.append(" ".join(words))
    texts += [None, "", " ", "x", texts[0], texts[0], texts[3] + " tail", "ab " * 400, "ab " * 300, "q" * 500, "q" * 200]
    return texts


def removed_bytes(texts):
    first = {}
    data = [(t or "").encode() for t in texts]
    for k, x in enumerate(data):
        for i in range(len(x) - 49):
            first.setdefault(x[i : i + 50], k)
    out = []
    for k, x in enumerate(data):
        gone = bytearray(len(x))
        for i in range(len(x) - 49):
            if first[x[i : i + 50]] < k:
                gone[i : i + 50] = b"\1" * 50
        out.append((bytes(c for c, g in zip(x, gone, strict=True) if not g), gone))
    return out


@pytest.mark.parametrize("options", [{}, {"block_bytes": 3000, "hot": 2, "batch": 64}])
def test_suffix_dedup_matches_brute_force(spark, options):
    texts = corpus()
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, texts), **options).collect()}
    for k, (kept, gone) in enumerate(removed_bytes(texts)):
        spans = [m.span() for m in re.finditer(rb"\x01+", bytes(gone))]
        assert bytes(found[k].kept) == kept
        assert [(s.start, s.stop) for s in found[k].spans] == spans


def test_suffix_index_takes_a_second_batch(spark, tmp_path):
    texts = corpus(6)
    brute, index, at = removed_bytes(texts), suffix_dedup.SuffixIndex(spark, f"file://{tmp_path}/index", 4, 8, 2000), 0
    for size in (20, 25, len(texts) - 45):
        ids = list(range(at, at + size))
        found = {r.doc_id: bytes(r.kept) for r in index.add(frame(spark, texts[at : at + size], ids), batch=64).collect()}
        assert found == {k: brute[k][0] for k in ids}
        at += size
    again = {r.doc_id: bytes(r.kept) for r in index.add(frame(spark, texts[:20], range(100, 120))).collect()}
    assert all(again[100 + k] == (b"" if len((t or "").encode()) >= 50 else (t or "").encode()) for k, t in enumerate(texts[:20]))


def test_family_of_suffix_arrays_is_logarithmic_and_ordered():
    rng = np.random.default_rng(7)
    data = np.frombuffer(bytes(rng.integers(97, 100, 4000).astype(np.uint8)) + b"abc" * 400, np.uint8)
    place, family, hits, first = np.arange(5000), suffix_dedup.Family(data), [], {}
    for lo in range(0, 5000, 100):
        hits += family.add(place[lo : lo + 100], place[lo : lo + 100] // 7).tolist()
        assert len(family.levels) == bin(lo // 100 + 1).count("1")
    for p in place.tolist():
        first.setdefault(bytes(data[p : p + 50]), p // 7)
    assert hits == [first[bytes(data[p : p + 50])] < p // 7 for p in place.tolist()] and any(hits)
    for _, suffix, _ in family.levels:
        rows = suffix.view(np.uint8).reshape(-1, 50).tolist()
        assert rows == sorted(rows)
    assert suffix_dedup.Family.restored(data, family.stored()).add(place[:50], np.full(50, 10**6)).all()


def test_suffix_dedup_same_id_null_id_and_empty(spark):
    text = "the same sentence that is longer than fifty bytes, surely it is"
    found = suffix_dedup.remove_repeats(frame(spark, [text, text, text], [5, 5, None])).collect()
    assert sorted((r.doc_id is None, len(r.kept) == len(text)) for r in found) == [(False, True), (False, True), (True, False)]
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_suffix_stage_keeps_columns(spark):
    docs = frame(spark, ["é" * 60, "x" + "é" * 60], extra="clash")
    out = suffix_dedup.clean_documents(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].text == "é" * 60 and rows[1].text == "x" and rows[1].n_chars == 1 and rows[1].kept == "clash"


@pytest.mark.parametrize("options", [{}, {"block_bytes": 2000}])
def test_recompression_matches_brute_force(spark, options):
    texts = corpus(2) + ["a " * 40, "b " + "a " * 12 + "c", "a " * 13]
    words = [(t or "").encode().split() for t in texts]
    first = {}
    for k, w in enumerate(words):
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), k)
    found = {r.doc_id: r for r in recompression.remove_repeats(frame(spark, texts), **options).collect()}
    for k, w in enumerate(words):
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < k:
                gone[i : i + 13] = [True] * 13
        assert bytes(found[k].kept) == b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (found[k].n_words, found[k].n_kept) == (len(w), len(w) - sum(gone))


def test_recompression_of_periodic_and_random_words(spark):
    """Two-letter texts have repeats at every scale, and runs at every window's edge."""
    rng = random.Random(11)
    texts = [" ".join(rng.choices("ab", k=rng.randint(10, 200))) for _ in range(40)] + ["a a b b " * 20, "a a b b " * 7, "x " * 20_000 + "end"]
    words = [t.split() for t in texts]
    first = {}
    for k, w in enumerate(words):
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), k)
    found = {r.doc_id: r for r in recompression.remove_repeats(frame(spark, texts), block_bytes=1500).collect()}
    for k, w in enumerate(words):
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < k:
                gone[i : i + 13] = [True] * 13
        assert bytes(found[k].kept).decode() == " ".join(x for x, g in zip(w, gone, strict=True) if not g)


def test_recompression_empty(spark):
    assert recompression.remove_repeats(frame(spark, [])).count() == 0


def test_exact_dedup(spark):
    texts = ["a  b", "a b", None, "", "c", "a\tb", "c", "d"]
    found = {r.doc_id: r for r in exact_dedup.find_copies(frame(spark, texts, extra="clash")).collect()}
    assert [found[k].keep_id for k in range(8)] == [0, 0, 2, 2, 4, 0, 4, 7]
    assert [found[k].group_size for k in range(8)] == [3, 3, 2, 2, 2, 3, 2, 1]
    assert [found[k].kept for k in range(8)] == [True, False, True, False, True, False, False, True]
    assert found[0].text_sha256 == hashlib.sha256(b"a b").hexdigest()


def test_exact_dedup_with_colliding_digests(spark):
    short = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 1))
    texts = [f"text {k % 23}" for k in range(60)]
    found = {r.doc_id: r for r in exact_dedup.find_copies(frame(spark, texts), digest=short).collect()}
    assert all(found[k].keep_id == k % 23 and found[k].kept == (k < 23) for k in range(60))
    assert all(found[k].text_sha256 == hashlib.sha256(texts[k].encode()).hexdigest() for k in range(60))


def test_exact_dedup_against_an_earlier_call(spark, tmp_path):
    state = f"file://{tmp_path}/state"
    first = {r.doc_id: r.kept for r in exact_dedup.find_copies(frame(spark, ["a", "b", "a"]), state=state).collect()}
    second = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.find_copies(frame(spark, ["a", "c", "c"], [10, 11, 12]), state=state).collect()}
    assert first == {0: True, 1: True, 2: False}
    assert second == {10: (0, 3, False), 11: (11, 2, True), 12: (11, 2, False)}


def test_exact_dedup_of_a_hot_group_and_long_texts(spark, tmp_path):
    texts = ["hot"] * 300 + ["x" * 1_000_000, "x" * 1_000_000 + " ", "x" * 1_000_001, *(f"own {k}" for k in range(50))]
    frame(spark, texts).write.parquet(f"file://{tmp_path}/docs")
    found = {r.doc_id: r for r in exact_dedup.find_copies(spark.read.parquet(f"file://{tmp_path}/docs")).collect()}
    assert sum(r.kept for r in found.values()) == 54 and found[299].keep_id == 0 and found[299].group_size == 300
    assert found[301].kept and found[7].keep_locator.split("#")[1].isdigit()


def test_exact_stage_repeated_rows_and_empty(spark):
    docs = frame(spark, ["a", "a", "b", "b", None], [3, 3, 1, None, None], extra="clash")
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == [("1", "b"), ("3", "a"), ("None", None)]
    assert exact_dedup.find_copies(frame(spark, [])).count() == 0


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(k) for k in range(n)]


def test_minhash_matches_brute_force(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") + str(rng.randint(0, 50)) for _ in range(120)] for _ in range(12)]
    texts = []
    for words in base:
        texts.append(" ".join(words))
        for edits in (1, 2, 4, 8):
            w = list(words)
            for _ in range(edits):
                w[rng.randrange(len(w))] = "edited" + str(rng.randint(0, 9))
            texts.append(" ".join(w))
    texts += [None, "", "one two", "ONE two", "one two three four five", texts[0].upper(), texts[1]]
    sets = [shingle_set(t) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    found = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, texts, extra="clash")).collect()}
    assert [found[k].component_id for k in range(len(texts))] == components(len(texts), pairs)
    assert [found[k].n_shingles for k in range(len(texts))] == [len(s) for s in sets]
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    kept = minhash.keep_one(frame(spark, texts, extra="clash"))
    assert kept.count() == sum(c == k for k, c in enumerate(components(len(texts), pairs)))


def test_minhash_repeated_and_null_ids(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = frame(spark, [a, b, a + " more", b + " more", a, "alone", None], [1, 1, 2, 3, None, 4, 5])
    found = sorted(((r.doc_id, r.component_id) for r in minhash.near_duplicates(rows).collect()), key=str)
    assert found == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (None, None), (4, 4), (5, 5)], key=str)


@pytest.mark.parametrize("block", [4, 512])
def test_minhash_group_just_around_the_threshold(spark, block):
    """Copies with two changed stretches each: pairs lie on both sides of the threshold, and no star settles them."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.choice([3, 4, 5])):
            at = rng.randrange(195)
            w[at : at + 2] = [f"x{k}.{rng.random()}", f"y{k}"]
        texts.append(" ".join(w))
    texts += ["long " * 30_000, "long " * 30_001]
    sets = [shingle_set(t) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, texts), block=block).collect()}
    assert [found[k] for k in range(len(texts))] == components(len(texts), pairs)


def test_minhash_links_of_cells():
    """What the second pass does, on one cell: every pair decided, a spanning set given back."""
    import pandas as pd

    rng = np.random.default_rng(3)
    core = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([core[: 400 - 3 * k], rng.integers(0, 1 << 63, 5 * k).astype(np.uint64)])) for k in range(30)]
    near = [(a, b) for a in range(30) for b in range(a + 1, 30) if minhash.similar(sets[a], sets[b])]
    rows = pd.DataFrame({"cell": 1, "component": range(30), "n_shingles": [len(s) for s in sets], "own": 0, "alone": True, "sig": [minhash.signature(s).tobytes() for s in sets], "set": [s.tobytes() for s in sets]})
    linked, marked = [], np.zeros(30, bool)
    for band in range(minhash.HASHES // minhash.ROWS):
        rows["band"] = band
        linked += minhash.link_cells(rows).to_numpy().tolist()
        marked |= minhash.mark_cells(rows)
    assert components(30, linked) == components(30, near) and 0 < len(near) < 435
    assert marked[list({x for p in near for x in p})].all()


def test_minhash_posterior_bound():
    need = minhash.fewest_matches()
    assert len(need) == minhash.HASHES // minhash.BATCH and need == sorted(need) and need[-1] < 0.75 * minhash.HASHES


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r.component for r in connected_components(links).collect()} == {0}


def test_rabitq_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rabitq, "BLOCK", 16)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 32))
    x = np.concatenate([c + rng.normal(scale=0.12, size=(40, 32)) for c in centre] + [rng.normal(size=(60, 32))]).astype(np.float32)
    x = np.concatenate([x, x[:5], 2 * x[5:8]])
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 32), (n + 2, [float("nan")] * 32), (n + 3, [1.0, 2.0]), (n + 4, [None] * 32), (n + 5, [])]
    found = {r.vec_id: r for r in rabitq.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit(1))).collect()}
    y = x.astype(float)
    unit = y / np.linalg.norm(y, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    a, b = np.nonzero(np.triu(near))
    assert near.sum() > 1000
    assert [found[k].n_links for k in range(n)] == near.sum(1).tolist()
    assert [found[k].component_id for k in range(n)] == components(n, zip(a.tolist(), b.tolist(), strict=True))
    assert all(found[k].n_links == 0 and found[k].component_id == k and found[k].kept for k in range(n, n + 6))
    assert rabitq.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_rabitq_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turns = rabitq.rotations(64, 4)
    bits, factors = rabitq.encode(x, turns)
    i, j = np.arange(0, 2000, 2), np.arange(1, 2000, 2)
    estimate = rabitq.Estimator(bits, factors, turns, threshold=0.0)
    guess, bound = estimate(i, j)
    true = np.einsum("ij,ij->i", x[i], x[j])
    assert abs((guess - true).mean()) < 0.01 and (np.abs(guess - true) <= bound).mean() > 0.999


def test_rabitq_estimate_near_the_threshold():
    rng = np.random.default_rng(2)
    for size in (2, 3, 16, 64):
        x = rng.normal(size=(4000, size))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        side = rng.normal(size=x.shape)
        side -= np.einsum("ij,ij->i", side, x)[:, None] * x
        y = 0.95 * x + np.sqrt(1 - 0.95**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
        turns = rabitq.rotations(size, rabitq.turn_count(size, 13, 33))
        estimate = rabitq.Estimator(*rabitq.encode(np.concatenate([x, y]), turns), turns, threshold=0.95)
        guess, bound = estimate(np.arange(4000), np.arange(4000, 8000))
        assert (guess + bound >= 0.95).all() and bound.max() < 0.95


def thue_morse(size):
    x = "a"
    while len(x) < size:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [64, 128, 1024, 4096])
def test_words_that_collide_in_polynomials(spark, size):
    """Thue-Morse words and their complements agree in every polynomial modulo 2^64."""
    x, y = thue_morse(size)
    words = [f"w{k}" for k in range(12)]
    texts = [" ".join([*words[:6], x, *words[6:]]), " ".join([*words[:6], y, *words[6:]]), " ".join([*words[:6], x, *words[6:]])]
    docs = frame(spark, texts)
    removed = {r.doc_id: r.n_words - r.n_kept for r in recompression.remove_repeats(docs).collect()}
    assert removed == {0: 0, 1: 0, 2: 13}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {0: 0, 1: 1, 2: 0}


def clashing(spark, texts):
    names = "extra block ids sizes data parts key keys counts bucket shard part row gone norm digest sig n bit place own file lines line rank weight score bin locator".split()
    names += [f"__{c}" for c in "locator rest gone id digest keep_id place n row".split()]
    docs = frame(spark, texts)
    return docs.select(docs["*"], *[F.lit(k).alias(c) for k, c in enumerate(names)])


@pytest.mark.parametrize("texts", [["short"], [None], [""], ["short", None, "", "short"]])
def test_small_tables_with_clashing_columns(spark, texts):
    docs = clashing(spark, texts).repartition(2)
    whole = [len(t or "") for t in texts]
    assert sorted(len(r.kept) for r in suffix_dedup.remove_repeats(docs).collect()) == sorted(whole)
    assert sorted(r.n_words for r in recompression.remove_repeats(docs).collect()) == sorted(len((t or "").split()) for t in texts)
    assert exact_dedup.find_copies(docs).count() == minhash.near_duplicates(docs).count() == len(texts)
    for stage in (suffix_dedup.clean_documents, exact_dedup.drop_copies, minhash.keep_one):
        assert stage(docs).columns == docs.columns and stage(docs).count() >= 1


def test_exact_dedup_checks_bytes_of_earlier_calls(spark, tmp_path):
    state = f"file://{tmp_path}/state"
    short = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 1))
    byte = lambda k: hashlib.sha256(f"text {k}".encode()).digest()[0] >> 4
    early = [k for k in range(20) if byte(k) not in {byte(j) for j in range(k)}]  # the state keeps one text of a digest
    exact_dedup.find_copies(frame(spark, [f"text {k}" for k in early], early), digest=short, state=state).count()
    ids = list(range(500))
    assert {byte(k) for k in early} & {byte(k) for k in ids if k not in early}
    later = frame(spark, [f"text {k}" for k in ids], [1000 + k for k in ids])
    found = {r.doc_id: r.keep_id for r in exact_dedup.find_copies(later, digest=short, state=state).collect()}
    assert found == {1000 + k: k if k in early else 1000 + k for k in ids}


def test_suffix_index_opened_again_and_interrupted(spark, tmp_path):
    text = " ".join(f"word{k}" for k in range(20))
    folder = f"file://{tmp_path}/index"
    add = lambda ids, **kw: {r.doc_id: len(r.kept) for r in suffix_dedup.SuffixIndex(spark, folder, buckets=2, shards=4, **kw).add(frame(spark, [text] * len(ids), ids)).collect()}
    assert add([1], hot=1) == {1: len(text)}
    assert add([2]) == {2: 0}
    index = suffix_dedup.SuffixIndex(spark, folder)
    assert (index.version, index.buckets, index.shards, index.hot) == (2, 2, 4, 1)
    put, index._put = index._put, lambda df, name, v: (_ for _ in ()).throw(RuntimeError) if name == "levels" else put(df, name, v)
    with pytest.raises(RuntimeError):
        index.add(frame(spark, ["other text " * 10], [3]))
    assert add([4]) == {4: 0}
    assert suffix_dedup.SuffixIndex(spark, folder).version == 3
