"""Fill-in-middle, importance resampling and line removal against brute force, with hard rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import fim, line_dedup, queries, resampling

NAMES = "row lines hashes place hash gone last docs kept output form restored n n_words weight score salt rank __part __at __before bucket part".split()


def frame(spark, texts, ids=None):
    """A table with columns of names that the operators use inside, as numbers."""
    rows = list(zip(ids or range(len(texts)), texts, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(NAMES)])


def texts_of(seed, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcXYZé日12-_,.", k=rng.randint(1, 6))) for _ in range(60)]
    shared = [" ".join(rng.choices(words, k=14)) for _ in range(8)]
    out = []
    for _ in range(n):
        lines = [rng.choice(shared) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(rng.randint(0, 7))]
        out.append("\n".join(lines) + ("\n" if rng.random() < 0.3 else ""))
    out += [None, "", "\n", "\n\n", "one line", "no end\nhere", "has <P> mark\nand <M>", "<\nS>\n<S\n>", "\x0b" + shared[0].upper() + " \t", out[0], out[0], "z\r\n" * 3]
    return out + ["\n".join(rng.choices(shared, k=4000))]


def form_of(doc_id, text, rate=100, spm=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize(("rule", "step"), [(fim.Rule(), fim.STEP_BYTES), (fim.Rule(rate=60, spm=20), 700)])
def test_fill_in_middle_matches_brute_force(spark, monkeypatch, rule, step):
    monkeypatch.setattr(fim, "STEP_BYTES", step)
    texts = texts_of(4)
    for lo in range(0, len(texts), 40):  # in this process, so that the step size holds
        part = [(t or "").encode() for t in texts[lo : lo + 40]]
        for cut in fim._steps([len(p) for p in part]):
            ids = [str(lo + k) for k in range(len(part))][cut]
            lines, form, pre, mid, out = fim.transform_texts(part[cut], np.array([rule.draws(i) for i in ids]), rule)
            for k, i in enumerate(ids):
                want = form_of(i, part[cut][k].decode(), rule.rate, rule.spm)
                assert (lines[k], fim.FORMS[form[k]], out[k].decode()) == (want[0], want[1], want[4])
                assert want[1] == "plain" or (pre[k], mid[k]) == want[2:4]
            assert fim.restore_texts(out, form) == part[cut]


def test_fill_in_middle_table(spark):
    texts = texts_of(5)
    ids = [None, 0, *range(len(texts) - 3), 0]
    found = fim.restore(fim.transform(frame(spark, texts, ids))).collect()
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in found)
    assert got == Counter((i, *form_of(i, t or ""), t or "") for i, t in zip(ids, texts, strict=True))
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fim.restore(fim.transform(frame(spark, []))).count() == 0


def resampled(texts, ids, target, min_words=20, per_cent=5):
    def features(text):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]

    docs = [features(t) for t in texts]
    s, t = Counter(b for _, f in docs for b in f), Counter(b for x in target for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    rows = []
    for i, (n, f) in zip(ids, docs, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(fit[: per_cent * len(fit) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize("case", ["plain", "ids"])
def test_resampling_matches_brute_force(spark, case):
    texts = texts_of(6) + ["a\nb\nc\nd", "a b\n\nc\n \nd e f\ng", "é\n日 x\n-\ny"]
    ids = list(range(len(texts)))
    if case == "ids":
        ids = [None, *([7] * 40), *ids[: len(texts) - 41]]
    target = texts_of(7, 20) + [None, ""]
    options = {"min_words": 5, "per_cent": 30}
    found = resampling.resample(frame(spark, texts, ids).repartition(5), frame(spark, target), **options)
    assert Counter(tuple(r) for r in found.collect()) == resampled(texts, ids, target, **options)


def test_resampling_query_and_empty_tables(spark, tmp_path):
    texts, target = texts_of(8, 400), texts_of(9, 10)
    frame(spark, texts).write.parquet(f"file://{tmp_path}/documents.parquet")
    frame(spark, target).select(F.col("doc_id").alias("item_id"), "text").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    found = queries.op12_resampling(spark, f"file://{tmp_path}").collect()
    assert Counter(tuple(r) for r in found) == resampled(texts, list(range(len(texts))), target)
    none = frame(spark, [])
    assert resampling.resample(none, frame(spark, target)).count() == 0
    assert Counter(tuple(r) for r in resampling.resample(frame(spark, [None, "a"]), none).collect()) == resampled([None, "a"], [0, 1], [])


def lines_left(texts, ids, min_chars=40, min_docs=5):
    fold = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))
    holders = defaultdict(list)
    rows = [(t or "").split("\n") for t in texts]
    for k, lines in enumerate(rows):
        for key in {fold(x) for x in lines}:
            holders[key].append(ids[k])
    top = lambda key: max((i for i in holders[key] if i is not None), default=None)
    out = Counter()
    for k, lines in enumerate(rows):
        stay = [x for x in lines if not (len(fold(x)) >= min_chars and len(holders[fold(x)]) >= min_docs and ids[k] != top(fold(x)))]
        out[(ids[k], len(lines), len(lines) - len(stay), "\n".join(stay))] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"batches": 9, "fanout": 2}, {"batches": 1}])
def test_line_removal_matches_brute_force(spark, options):
    texts = texts_of(10)
    ids = [(37 * k) % len(texts) for k in range(len(texts))]
    found = line_dedup.clean_lines(frame(spark, texts, ids).repartition(3), **options)
    assert Counter(tuple(r) for r in found.collect()) == lines_left(texts, ids)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs_")]


def test_line_removal_of_repeated_null_ids_and_empty(spark):
    texts = texts_of(11, 60)
    ids = [None, None, *([5] * 30), *range(len(texts) - 32)]
    found = Counter(tuple(r) for r in line_dedup.clean_lines(frame(spark, texts, ids), batches=4).collect())
    assert found == lines_left(texts, ids)
    nulls = ["x" * 50] * 6
    assert Counter(tuple(r) for r in line_dedup.clean_lines(frame(spark, nulls, [None] * 6)).collect()) == lines_left(nulls, [None] * 6)
    assert line_dedup.clean_lines(frame(spark, [])).count() == 0


def test_line_runs_are_levelled_and_take_known_keys_off(spark):
    runs = line_dedup.LineRuns(spark, 4, min_docs=2, fanout=2)
    batch = lambda lo: spark.createDataFrame([(lo + k, bytes([h])) for k in range(3) for h in range(5)], "doc_id long, hash binary")
    runs.add(batch(300))
    assert [len(level) for level in runs.levels] == [1]
    runs.add(batch(200))
    assert [len(level) for level in runs.levels] == [0, 1]
    assert {r.docs for r in spark.table(runs.tables()[0]).collect()} == {3}  # the second batch added nothing
    runs.add(batch(400))
    assert {(r.docs, r["last"]) for r in runs.repeated().collect()} == {(6, 402)}
    runs.drop()
