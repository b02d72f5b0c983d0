"""Operators 11, 12 and 13 against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from vigilake.llm import queries, repeats, runs, search


def brute_search(docs, items, k):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda x: rx.findall((x or "").translate(lower))
    rows = [(i, collections.Counter(cut(t))) for i, t in docs]
    rows = [(i, c, c.total()) for i, c in rows if c]
    n_docs, n_terms = len(rows), sum(n for *_, n in rows)
    df = collections.Counter(t for _, c, _ in rows for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    asked = collections.defaultdict(collections.Counter)
    for item, text in items:
        asked[item].update(cut(text))
    out = set()
    for item, terms in asked.items():
        scored = [(sum(x * weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // n_terms))) for t, x in terms.items() if t in c), i) for i, c, n in rows]
        best = sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out |= {(item, r + 1, i, s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize(("shipped", "segment", "block", "cells", "k"), [(1000, 4096, 1 << 22, 1 << 21, 10), (150, 7, 900, 40, 3)])
def test_search(spark, monkeypatch, shipped, segment, block, cells, k):
    """In one pass, and in small blocks, segments and passes."""
    for name, value in zip(("SHIPPED", "SEGMENT", "BLOCK", "CELLS"), (shipped, segment, block, cells), strict=True):
        monkeypatch.setattr(search, name, value)
    r = random.Random(5)
    words = ["the"] * 30 + ["of"] * 12 + ["Größe", "größe", "ÉTÉ", "x1", "a_b", "don't", "日本"] + [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(r.choices(words, k=r.choice([0, 3, 20, 200])))) for i in range(150)]
    docs += [(200 + i, docs[7][1]) for i in range(30)] + [(300, None), (301, ""), (302, "?! ..."), (7, docs[9][1]), (None, docs[9][1]), (303, "w1 " * 3000)]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 25)))) for i in range(25)] + [(50, None), (51, ""), (52, "absent"), (53, "the THE The"), (3, "w1 w2"), (None, "of w3"), (54, docs[7][1])]
    frames = spark.createDataFrame([(*x, 1, "y") for x in docs], "doc_id long, text string, score int, term string"), spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, rank int")
    got = [tuple(x) for x in search.top_documents(*frames, k).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_search(docs, items, k)
    assert search.top_documents(frames[0].limit(0), frames[1], k).count() == 0 == search.top_documents(frames[0], frames[1].limit(0), k).count()


def brute_runs(w, min_words, min_periods):
    out = []
    for q in range(1, len(w) // min_periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(min_words, min_periods * q) and all(any(w[t] != w[t + x] for t in range(i, i + n - x)) for x in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_of_random_words():
    r = random.Random(2)
    for _ in range(400):
        texts = []
        for _ in range(r.randint(1, 5)):
            n, kinds = r.choice([0, 1, 7, 40, 90]), r.choice([1, 2, 3, 9])
            t = [r.randrange(kinds) for _ in range(n)]
            if n and r.random() < 0.6:
                a, p = r.randrange(n), r.randint(1, n // 5 + 1)
                t = [t[i] if i < a else t[a + (i - a) % p] for i in range(n)]
            texts.append([b"%d" % x for x in t])
        periods = r.choice([2, 3, 4])
        found = collections.defaultdict(list)
        for a, *x in zip(*(c.tolist() for c in runs.find_runs(*runs.numbered(texts), 6, periods)), strict=True):
            found[a].append(tuple(x))
        assert [found[i] for i in range(len(texts))] == [brute_runs(t, 6, periods) for t in texts]


def test_runs_of_fibonacci_words_and_a_very_long_text():
    a, b = [b"x"], [b"y"]
    for _ in range(12):
        a, b = a + b, a
    got = list(zip(*(c.tolist() for c in runs.find_runs(*runs.numbered([a]), 4, 2)[1:]), strict=True))
    assert got == brute_runs(a, 4, 2)
    long = [b"w%d" % (i % 500) for i in range(60_000)] + [b"z"] * 5000
    assert [x.tolist() for x in runs.find_runs(*runs.numbered([long]))] == [[0, 0], [0, 60_000], [60_000, 5000], [500, 1]]


def brute_op12(i, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    found = brute_runs(words, 6, 4)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    span = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(found), *span, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_op12_on_the_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    short = {i for i, t in rows if len(t) < 20_000}
    got = {tuple(r) for r in queries.op12_runs(spark, sf).collect() if r["doc_id"] in short}
    assert got == {brute_op12(i, t) for i, t in rows if i in short}
    assert sum(x[1] > 0 for x in got) > 5


def test_op12_edges(spark, tmp_path):
    texts = [None, "", " \t\n", "a a a a a", "a a a a a a", "x y x y x y x y b", "\x0bé é\x0cé é\ré é", "b " * 40 + "c d " * 20 + "b c"]
    rows = [(i * 7 + k, t, "r", 1) for i, t in enumerate(texts * 6) for k in (0, 1)] + [(None, texts[4], "r", 1), (3, texts[4], "r", 1), (3, texts[4], "r", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, words int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op12_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((brute_op12(*r[:2]) for r in rows), key=str)
    assert queries.with_planted_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0 == runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count()


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    n = collections.Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((len(t), spans, bytes(c for c, x in zip(t, gone, strict=True) if not x)))
    return out


def odd_texts(r):
    some = lambda n, kinds: "".join(r.choices("abcdefghijklmnopqrstuvwxyzäß日"[:kinds], k=n))
    passages = [some(r.randint(100, 900), r.choice([2, 29])) for _ in range(3)] + ["a" * 700, "ab" * 300, some(60, 26) * 10]
    texts = []
    for _ in range(r.randint(1, 12)):
        parts = []
        for _ in range(r.randint(0, 5)):
            p = r.choice(passages)
            parts.append(some(r.randint(0, 400), r.choice([1, 2, 29])) if r.random() < 0.5 else p[r.choice([0, r.randint(0, 50)]) : r.randint(1, len(p))])
        texts.append("".join(parts))
    return texts + r.choices(texts, k=r.choice([0, 0, 1]))


def test_repeats_without_spark(monkeypatch):
    """The two sorts over one range, with small pieces."""
    monkeypatch.setattr(repeats, "CHUNK", 1500)
    r, length = random.Random(8), 260
    for _ in range(60):
        texts = odd_texts(r)
        raw = [t.encode() for t in texts]
        keys = repeats.cut_keys(raw, length)
        state = repeats.states_of(keys, *[np.zeros(len(keys), bool)] * 2)
        strings = repeats.string_keys(raw, state, length)
        found = repeats.covered(raw, state, repeats.states_of(strings, *[np.zeros(len(strings), bool)] * 2), length)
        assert [[tuple(x) for x in f.tolist()] for f in found] == [x[1] for x in brute_repeats(texts, length)]


def test_ranges_keep_order_and_equal_keys_together():
    r = np.random.default_rng(1)
    for _ in range(200):
        keys = r.integers(0, 6, (60, 2)).astype(np.uint64)
        order = repeats.multikey_order(keys)
        assert keys[order].tolist() == sorted(keys.tolist())
        splitters = keys[order][:: r.integers(1, 20)]
        got = repeats.ranges(keys, splitters)
        assert got.tolist() == [sum(s <= k for s in splitters.tolist()) for k in keys.tolist()]


@pytest.mark.parametrize("block", [repeats.BLOCK, 3000])
def test_repeats(spark, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "CHUNK", 2000)
    r = random.Random(4)
    common = "".join(r.choices("abcdefgh ", k=450))
    texts = [t for _ in range(6) for t in odd_texts(r)] + [f"{i} {common} {i * 7919} " + "".join(r.choices("xyz", k=300)) for i in range(40)] + [None, "", "short", "b" * 400, "c" * 401]
    rows = [(i if i % 9 else None, t, b"k", 3) for i, t in enumerate(texts)]
    got = repeats.repeated_strings(spark.createDataFrame(rows, "doc_id long, text string, kept binary, n_bytes int").repartition(5), 400).collect()
    mine = sorted((r["doc_id"], r["n_bytes"], [tuple(x) for x in r["spans"]], bytes(r["kept"])) for r in got if r["doc_id"] is not None)
    expected = [(i, *x) for (i, *_), x in zip(rows, brute_repeats(texts, 400), strict=True)]
    assert mine == sorted(x for x in expected if x[0] is not None)
    assert sorted((r["n_bytes"], bytes(r["kept"])) for r in got if r["doc_id"] is None) == sorted((x[1], x[3]) for x in expected if x[0] is None)
    assert repeats.repeated_strings(spark.createDataFrame([], "doc_id string, text string")).count() == 0
