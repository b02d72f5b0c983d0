"""Operators 1, 3 and 7 against the tokenizer libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as PT
import pytest
import tiktoken
from tokenizers import Tokenizer

from vigilake.llm import bpe, packing, pieces, token_counts
from vigilake.session import ship

ALPHABET = "ab'sStdmrevl  \n\t 1２²é一 \x1c\x85!?ΣßİA̰🎉"
BYTE, WORD, RANKS = PT.path("byte_bpe_50k.json"), PT.path("word_bpe_49k.json"), PT.path("byte_bpe_50k.tiktoken")
EDGE = [(-1, None), (-2, ""), (-3, "a<|endoftext|>b  <|startoftext|> ÅÉ ΣΑΣ it's 12²"), (-4, "x " * 20000), (None, "no id"), (-5, "<|endoftext|>"), (-6, "twice"), (-6, "twice"), (-7, "z" * 5000)]


def texts(n=3000):
    r = random.Random(5)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(n)] + [" 's it's 'll'll '", "'", ""]


@pytest.fixture(scope="module")
def docs(spark, sf):
    ship(spark)
    own = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(EDGE, "doc_id long, text string"))
    return own.selectExpr("doc_id", "text", "'other' as n_tokens", "1 as start")  # clashing names


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_encode_like_the_library_and_back():
    own = bpe.coder(RANKS)
    library = tiktoken.Encoding("x", pat_str=PT.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    many = texts()
    for text, ids in zip(many, own.encode_batch(many), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), text
        assert own.decode(ids) == text.encode()


def test_perfect_hash():
    keys = [str(i).encode() for i in range(5000)]
    h = bpe.PerfectHash(keys, range(5000))
    assert sorted(h.slots) == list(range(5000))
    assert all(h.get(k) == i for i, k in enumerate(keys)) and h.get(b"x") == -1
    assert bpe.PerfectHash([], []).get(b"x") == -1 and bpe.PerfectHash([b"a"], [7]).get(b"a") == 7


def test_cache_may_start_anew():
    calls = []
    cache = pieces.PieceCache(lambda x: calls.append(len(x)) or [[len(w)] for w in x], most=8)
    for text in ("a bb ccc", "a x", "dddd eeeee", "a bb", "f gg hhh a", "a " + " ".join("y" * i for i in range(1, 30)), "a bb"):
        cp, off = pieces.codepoints([text])
        starts, ends = pieces.blank_words(cp, off)
        assert cache.ids(*cache.look_up(cp, starts, ends)).tolist() == [len(w) for w in text.split()]


def test_op1(docs):
    own = bpe.coder(RANKS)
    library = tiktoken.Encoding("x", pat_str=PT.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    got = sorted(map(tuple, bpe.digest_documents(docs, RANKS).collect()), key=str)
    expected = []
    for i, text in rows_of(docs):
        ids = library.encode_ordinary(text)
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(expected, key=str)
    some = bpe.encode_documents(docs.where("doc_id = -6"), RANKS).collect()
    assert [r["ids"] for r in some] == [library.encode_ordinary("twice")] * 2


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return [word, word.translate(str.maketrans("ab", "ba"))]


def test_colliding_pieces(spark):
    """Pieces whose polynomial fingerprints modulo 2**64 are equal keep ids, bytes and counts of their own."""
    many = [x for n in (1024, 2048, 4096) for x in thue_morse(n)]
    cp, off = pieces.codepoints(many[:2])
    assert len(set(pieces.fingerprints(cp, off[:-1], off[1:]).tolist())) == 1
    many += [" ".join(many), " ".join(reversed(many))]
    own = bpe.ByteBPE(RANKS)
    library = tiktoken.Encoding("x", pat_str=PT.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for _ in range(2):  # also from the cache
        assert [x.tolist() for x in own.encode_batch(many)] == [library.encode_ordinary(x) for x in many]
    words = Tokenizer.from_file(WORD)
    assert [x.tolist() for x in packing.WordCoder(WORD).encode_batch(many)] == [words.encode(x, add_special_tokens=False).ids for x in many]
    got = token_counts.token_counts(spark.createDataFrame(list(enumerate(many)), "doc_id long, text string").repartition(3), BYTE, buckets=2).collect()
    library = Tokenizer.from_file(BYTE)
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(library.encode(x, add_special_tokens=False).ids) for i, x in enumerate(many)}


def test_op7(docs):
    library = Tokenizer.from_file(BYTE)
    got = sorted(map(tuple, token_counts.token_counts(docs, BYTE, 512).collect()), key=str)
    rows = rows_of(docs)
    sizes = [len(x.ids) for x in library.encode_batch([t for _, t in rows], add_special_tokens=False)]
    assert got == sorted([(i, len(t.encode()), n, n > 512) for (i, t), n in zip(rows, sizes, strict=True)], key=str)


def test_op7_small_blocks(docs, monkeypatch):
    """Many blocks and pre-tokens that count as common give the same."""
    library = Tokenizer.from_file(BYTE)
    monkeypatch.setattr(token_counts, "BLOCK", 2000)
    out = token_counts.token_counts(docs.where("doc_id >= 0"), BYTE, 512, buckets=3)
    rows = rows_of(docs.where("doc_id >= 0"))
    assert {r["doc_id"]: r["n_tokens"] for r in out.collect()} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_empty_table(spark, docs):
    none = docs.limit(0)
    assert bpe.digest_documents(none, RANKS).count() == token_counts.token_counts(none, BYTE).count() == packing.pack(none, WORD).count() == 0


@pytest.mark.parametrize("capacity", [4096, 64])
def test_op3(docs, capacity):
    library = Tokenizer.from_file(WORD)
    got = packing.pack(docs, WORD, capacity=capacity).collect()
    by, sequences = {}, {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["length"] == len(r["ids"]) > 0 and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    for i, text in rows_of(docs):
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        parts = sorted(by[i], key=lambda r: r["start"])
        if i == -6:
            assert [p["ids"] for p in parts] == [ids, ids]
            continue
        assert [x for p in parts for x in p["ids"]] == ids and all(p["doc_tokens"] == len(ids) for p in parts)
        assert [p["start"] for p in parts] == np.cumsum([0, *(p["length"] for p in parts)])[:-1].tolist()
    padding = total = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
        total += at
        padding += capacity - at if at & (at - 1) else 0
    assert padding <= (0.02 if capacity == 4096 else 0.1) * total


def test_plan_is_optimal():
    """The monotone queue finds what trying every cut finds."""
    r, short = random.Random(3), {k: v * 16 / packing.SCALE for k, v in packing.SHORT.items()}
    for _ in range(60):
        cuts = [0]
        while cuts[-1] < 60:
            cuts.append(cuts[-1] + r.randint(1, 5))
        penalty = [0.0] + [float(r.choice([0, 3, 9])) for _ in cuts[1:]]
        best = [0.0] + [1e9] * (len(cuts) - 1)
        for j in range(1, len(cuts)):
            for i in range(j):
                size = cuts[j] - cuts[i]
                if size <= 16:
                    cost = short[size] if size < 16 and size & (size - 1) == 0 else 16 - size
                    best[j] = min(best[j], best[i] + min(cost, 16 - size) + penalty[j])
        chosen = packing.plan(cuts, penalty, 16, True)
        place = {c: k for k, c in enumerate(cuts)}
        cost = 0.0
        for a, b in zip(chosen, chosen[1:], strict=False):
            size = b - a
            cost += min(16 - size, short[size] if size < 16 and size & (size - 1) == 0 else 99) + penalty[place[b]]
        assert cost == best[-1]
