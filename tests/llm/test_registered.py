"""The registered queries without SQL, over the whole given table, against the libraries and brute force."""

import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers as PT
import pytest
import tiktoken
from test_duplicates import brute_classes
from test_quality_language import brute, brute_kept
from tokenizers import Tokenizer

from vigilake.llm import bpe, quality, queries


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_op1(spark, sf, texts):
    path = PT.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("x", pat_str=PT.PATTERN, mergeable_ranks=bpe.coder(path).ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    ids = {i: library.encode_ordinary(t or "") for i, t in texts.items()}
    got = {tuple(r)[:4] for r in queries.op1_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert got == {(i, len(x), sha(" ".join(map(str, x)).encode()), sha((texts[i] or "").encode())) for i, x in ids.items()}


def test_op2(spark, sf, texts):
    rules = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = queries.op2_quality(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        found = brute(text)
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == found
        assert r["base_failed"] == (found[0] < 10 or 100 * found[4] > 20 * found[0]) and r["kept"] == brute_kept(rules, text)


def test_op3(spark, sf, texts):
    library, parts, sequences = Tokenizer.from_file(PT.path("word_bpe_49k.json")), collections.defaultdict(list), collections.defaultdict(list)
    for r in queries.op3_packing(spark, sf).collect():
        parts[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert parts.keys() == texts.keys()
    for i, own in parts.items():
        ids = np.array([*library.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    used = padding = 0
    for spans in sequences.values():
        size = 0
        for offset, length in sorted(spans):
            assert offset == size
            size += length
        assert size <= 4096
        used, padding = used + size, padding + (4096 - size if size & (size - 1) else 0)
    assert padding <= 0.02 * used


def test_op7(spark, sf, texts):
    library = Tokenizer.from_file(PT.path("byte_bpe_50k.json"))
    n = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}
    got = {tuple(r)[:4] for r in queries.op7_token_counts(spark, sf).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()}
    assert got == {(i, len((texts[i] or "").encode()), n[i], n[i] > 512) for i in texts}


def test_op9(spark, sf):
    real = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op9_language(spark, sf).collect()
    held = [r for r in got if r["held_out"] and real[r["doc_id"]]]
    assert {r["doc_id"] for r in got} == real.keys() and len(held) > 40
    assert sum(r["lang_pred"] == real[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_op10(spark, sf, texts):
    """Recall is 1.0 here: the classes are those of all pairs."""
    expected = brute_classes(list(texts.items()))
    got = {r["doc_id"]: r["class_id"] for r in queries.op10_minhash(spark, sf).collect()}
    assert {i: got[i] for i in expected} == expected and got.keys() == texts.keys()
    assert len(set(expected.values())) < len(expected)


def test_texts_longer_than_a_chunk(spark):
    """A text of more characters than a chunk of any operator, and a near copy of it."""
    from vigilake.llm import near_dups, repeats, runs, token_counts

    words = [f"w{(i * 7919) % 100_003}" for i in range(220_000)]
    long, near = " ".join(words), " ".join([*words[:1000], "changed", *words[1000:]])
    assert len(long) > 1 << 20
    docs = spark.createDataFrame([(1, long), (2, near), (3, "short text")], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    library = Tokenizer.from_file(PT.path("byte_bpe_50k.json"))
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, PT.path("byte_bpe_50k.json")).collect()}
    assert counts == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in ((1, long), (2, near), (3, "short text"))}
    kept = {r["doc_id"]: bytes(r["kept"]) for r in repeats.repeated_strings(docs, 400).collect()}
    assert kept == {1: b"", 2: b"changed", 3: b"short text"}
    assert {r["doc_id"]: (len(r["runs"]), r["collapsed"] == t) for r, t in zip(sorted(runs.periodic_runs(docs).collect(), key=lambda r: r["doc_id"]), (long, near, "short text"), strict=True)} == {1: (0, True), 2: (0, True), 3: (0, True)}
