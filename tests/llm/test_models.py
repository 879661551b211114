"""Scoring, tokenising, packing and formatting operators: brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, chat, ctw, packing, quality_fm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


def odd_texts(seed=3, n=120):
    rng = random.Random(seed)
    parts = ["a", "e", "t", "th", "ing", " ", "  ", "\n", "<|endoftext|>", "12", "é", "日本", "😀", "'s", "!!", "\t", "\x00", "‍", "the ", "tion"]
    return ["", None, "<|endoftext|>", *("".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(n))]


def test_bpe_equals_the_library_and_round_trips(spark):
    texts = odd_texts()
    library = Tokenizer.from_file(BYTE)
    for r in bpe.encode_documents(frame(spark, texts), BYTE, decoded=True).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False) == (texts[r.doc_id] or "")
    again = bpe.decode_documents(bpe.encode_documents(frame(spark, texts), BYTE), BYTE)
    assert {r.doc_id: r.decoded for r in again.collect()} == {k: t or "" for k, t in enumerate(texts)}
    assert bpe.encode_documents(frame(spark, []), BYTE).count() == 0


def test_bpe_pair_check_equals_exact_merging():
    vocabulary = bpe.vocabulary(BYTE)
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 50_000, 3000), rng.integers(0, 50_000, 3000)
    holds = vocabulary.pairs_hold(a, b)
    for x, y, h in zip(a.tolist(), b.tolist(), holds.tolist(), strict=True):
        assert h == (vocabulary.exact(vocabulary.bytes_of[x] + vocabulary.bytes_of[y]) == [x, y])


def test_bpe_of_very_long_words():
    vocabulary, library = bpe.vocabulary(BYTE), Tokenizer.from_file(BYTE)
    rng = random.Random(6)
    for text in ("".join(rng.choices("theinganors", k=3000)), "日本語" * 700, "a" * 2001, "aab" * 500):
        assert np.frombuffer(vocabulary.encode_batch([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    begun = time.process_time()
    long = "".join(rng.choices("theinganors", k=1_000_000))
    assert vocabulary.decode(np.array(vocabulary.exact(long.encode()), "<u4").tobytes()) == long
    assert time.process_time() - begun < 60


def test_word_tokens_equal_the_library():
    tokens, library = packing.Tokens(WORD), Tokenizer.from_file(WORD)
    rng = random.Random(4)
    signs = ["a", "B", "é", "É", "ß", "İ", "ſ", "Σ", "ς", "Ω", "日", "e\u0301", "\u0301", "'s", "'", "’", "1", "²", "½", "٣", "!", "$", "_", "-", "<|", "|>", "<|endoftext|>", "\x00", "\x1f", "\x7f", "\u00a0", "\u2003", "\u200d", "😀", " ", "\n", "ª", "ǅ", "ŉ"]
    texts = ["", *("".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(1500))]
    for text, ids in zip(texts, tokens.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_packing(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["alpha", "beta", "Gamma", "x1y", "<|endoftext|>"], k=rng.choice([0, 3, 50, 900, 6000]))) for _ in range(60)] + [None, ""]
    library = Tokenizer.from_file(WORD)
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 2] for k, t in enumerate(texts)}
    got = packing.pack_documents(frame(spark, texts), WORD).collect()
    seen, filled = defaultdict(list), defaultdict(list)
    for r in got:
        part = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert part == ids[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id].append((r.start, r.length))
        filled[r.sequence_id].append((r.offset, r.length))
    for k, own in ids.items():
        at = 0
        for start, length in sorted(seen[k]):
            assert start == at
            at += length
        assert at == len(own)
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(frame(spark, []), WORD).count() == 0


def test_differencing_is_near_equal_and_grows_windows():
    rng = random.Random(2)
    sizes = [rng.randint(1, 1024) for _ in range(800)]
    windows = packing.pack_sizes(sizes)
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(800)) and max(sums) <= 4096 and max(sums) - min(sums) < 60
    assert len(packing.pack_sizes([3000, 3000, 3000])) == 3
    assert packing.pack_sizes([]) == []


def test_quality_held_out_and_hard_rows(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choices(["the", "cat", "sat", "on", "mats", "with", "birds."], k=60)) for _ in range(150)]
    junk = [" ".join(w.upper() + rng.choice(["!!", "%%%"]) for w in rng.choices(["the", "cat", "sat", "on"], k=60)) for _ in range(60)]
    docs = frame(spark, [*good, *junk, None, ""]).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(k, int(k < 150), 0) for k in range(210)] + [(None, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    machine = quality_fm.train(docs, labels)
    rows = {r.row.doc_id: r.score for r in quality_fm.score(docs, machine).collect()}
    held = [k for k in range(210) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(rows[k] >= 0.5) == (k < 150) for k in held]) > 0.95
    assert 0 <= rows[210] <= 1 and rows[210] == pytest.approx(rows[211])
    kept = quality_fm.keep_good(docs, labels)
    assert kept.columns == docs.columns and 140 <= kept.count() < 200
    blank = quality_fm.train(docs, labels.limit(0))
    assert {r.score for r in quality_fm.score(docs.limit(2), blank).collect()} == {0.5}
    assert quality_fm.score(docs.limit(0), machine).count() == 0


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    m = quality_fm.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 8)), np.zeros(14), np.ones(14))
    index, value = np.array([1, 5, 9, 30]), rng.normal(size=4)
    pairs = sum(m.factor[index[i]] @ m.factor[index[j]] * value[i] * value[j] for i in range(4) for j in range(i + 1, 4))
    assert m.logit(index, value) == pytest.approx(0.3 + m.weight[index] @ value + pairs)


def test_ctw_matches_a_direct_tree(spark):
    rng = random.Random(6)
    texts = [None, "", "é", *(" ".join(rng.choices(["the", "cat", "Sat", "on", "mats"], k=rng.randint(1, 25))) for _ in range(25))]
    depth = ctw.DEPTH
    data = [(t or "").encode() for t in texts]
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))]
    count, below = defaultdict(lambda: [0, 0]), defaultdict(set)

    def steps(x):
        s = b"\xff" * depth + x + b"\xff"
        for i in range(depth, len(s)):
            for q in range(8):
                yield s, i, (1 << q) | (s[i] >> (8 - q)), (s[i] >> (7 - q)) & 1

    for x, h in zip(data, held, strict=True):
        for s, i, node, bit in steps(x) if not h else ():
            for d in range(depth + 1):
                count[s[i - d : i], node][bit] += 1
                if d:
                    below[s[i - d + 1 : i], node].add((s[i - d : i], node))
    kt = {n: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for n, (a, b) in count.items()}
    weighted, product = {}, {}
    for n in sorted(count, key=lambda n: -len(n[0])):
        if len(n[0]) == depth:
            weighted[n] = kt[n]
        else:
            product[n] = sum(weighted[m] for m in below[n])
            weighted[n] = np.logaddexp(kt[n], product[n]) - math.log(2)
    found = {r.doc_id: r for r in ctw.score_documents(frame(spark, texts), block_bytes=400).collect()}
    words = Counter(w for x, h in zip(data, held, strict=True) if not h for w in x.lower().split())
    ends = held.count(False)
    n, v = sum(words.values()) + ends, len(words) + 1
    for k, x in enumerate(data):
        total = 0.0
        for s, i, node, bit in steps(x):
            p = None
            for d in range(depth, -1, -1):
                key = (s[i - d : i], node)
                if key in count:
                    e = (count[key][bit] + 0.5) / (sum(count[key]) + 1)
                    stop = 1.0 if p is None else 1 / (1 + math.exp(-max(-700, min(700, kt[key] - product[key]))))
                    p = e if p is None else stop * e + (1 - stop) * p
            total += math.log10(0.5 if p is None else p)
        r, own = found[k], x.lower().split()
        assert r.score == pytest.approx(total, rel=1e-6) and r.held_out == held[k] and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own) + math.log10((ends + 1) / (n + v + 1)))
        assert (r.n_tokens, r.n_known) == (len(own) + 1, sum(words[w] > 0 for w in own) + 1)
    assert ctw.score_documents(frame(spark, [])).count() == 0


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "", None, "\\l <s>\\\\", "a [/INST] b", "<s>", "</", "plain", "line\nline", "[INST]! x [/INST]"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate((r, t) for r in ("user", "assistant", "sys]\n[/INST]", None) for t in hard)]
    rows += [(2, 0, "assistant", "é"), (2, 0, "assistant", "b"), (None, None, "user", "null ids")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    found = {r.conv_id: r for r in chat.read_back(chat.render(turns)).collect()}
    first = [(r or "", t or "") for c, _, r, t in rows if c == 1]
    assert found[1].n_turns == len(first)
    assert found[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in first).encode()).hexdigest()
    assert found[1].loss_sha256 == hashlib.sha256("".join(t for r, t in first if r == "assistant").encode()).hexdigest()
    assert found[2].loss_sha256 == hashlib.sha256("bé".encode()).hexdigest() and found[2].loss_chars == 2
    assert found[None].n_turns == 1 and len(found) == 3
    assert chat.render(turns.limit(0)).count() == 0
