"""Operators 2 and 9: statistics against brute force, held-out accuracy."""

import collections
import math
import re
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from vigilake.llm import language, quality

WORD = re.compile("[^\x20\x09-\x0d]+")
EDGE = [(-1, None), (-2, ""), (-3, " a b c d e a b c d e "), (-4, "x " * 3000), (None, "\n \n a\r\nb\xa0c\n a\r\n\U0001f600 $"), (-5, "a b c d e"), (-6, "12 !!"), (-6, "12 !!")]


def brute(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def docs(spark, sf):
    own = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    return own.union(spark.createDataFrame([(*x, None) for x in EDGE], "doc_id long, text string, lang string"))


def test_statistics(docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in quality.statistics(docs.selectExpr("doc_id", "text", "7 as word_count")).collect():
        assert tuple(r[n] for n in names) == brute(r["text"] or ""), r["text"]
    with pytest.raises(ValueError):
        quality.statistics(docs.selectExpr("text", "7 as n_words"))


def brute_features(text):
    n, chars, symbols, dup, repeat = brute(text)
    lines, upper, marks = sum(bool(WORD.search(x)) for x in text.split("\n")), sum(unicodedata.category(c) == "Lu" for c in text), len(re.findall("[!?]", text))
    share = lambda a, b: a / b if b else 0.0
    return {"words": float(n), "word_length": share(chars, n), "symbols_a_word": share(symbols, n), "marks_a_word": share(marks, n), "upper_share": share(upper, chars), "words_a_line": share(n, lines), "repeat_share": share(repeat, n), "dup_line_share": share(dup, lines)}


def brute_kept(rules, text):
    """Base rules, then the list, on plain counts."""
    f, (n, _, _, _, repeat) = brute_features(text), brute(text)
    fits = lambda c: (f[c.feature] > c.threshold) == c.above
    return not (n < 10 or 100 * repeat > 20 * n) and not any(all(map(fits, rule)) for rule in rules.rules)


CLASHES = ["7 as n_words", "'x' as kept", "array(1) as _words", "2 as _lines", "3 as _q_words", "4.5 as score", "'zz' as lang_pred", "true as rejected", "map('a', 1) as more"]


def test_verdicts(docs, spark, sf):
    """kept against brute force, with columns of the very names that the operator uses, and repeated labelled ids."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality.fit(docs, labels)
    assert rules.rules and str(quality.fit(docs.union(docs).repartition(7), labels)) == str(rules)
    out = quality.judge(docs.selectExpr("doc_id", "text", *CLASHES), None, rules).collect()
    assert len(out) == docs.count()
    for r in out:
        assert r["verdict"]["kept"] == brute_kept(rules, r["text"] or ""), r["text"]
        assert (r["n_words"], r["kept"], r["_words"], r["_lines"]) == (7, "x", [1], 2)
    with pytest.raises(ValueError):
        quality.judge(docs.selectExpr("text", "1 as verdict"), None, rules)


@pytest.mark.parametrize("n", [1999, 2000, 2001])
def test_thresholds_lie_midway_at_any_number_of_values(n):
    learned = quality.learn([{"x": float(i)} for i in range(n)], [i > n // 2 for i in range(n)])
    assert learned.rules and all(c.threshold % 1 == 0.5 for rule in learned.rules for c in rule)


def test_learned_list(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.judge(docs, labels).select("doc_id", "text", "verdict.*").collect()
    label = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good = [r for r in out if label.get(r["doc_id"]) == 1 and not r["base_failed"]]
    poor = [r for r in out if label.get(r["doc_id"]) == 0]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good)
    assert sum(not r["kept"] for r in poor) >= 0.8 * len(poor)
    assert all(r["base_failed"] and not r["kept"] for r in out if r["text"] is None)


def test_sequential_covering():
    rows = [{"x": float(i % 50), "y": float(i % 7)} for i in range(1000)]
    poor = [r["x"] > 40 and r["y"] > 3 for r in rows]
    learned = quality.learn(rows, poor)
    fits = lambda c, r: (r[c.feature] > c.threshold) == c.above
    rejected = [any(all(fits(c, r) for c in rule) for rule in learned.rules) for r in rows]
    assert sum(a == b for a, b in zip(poor, rejected, strict=True)) >= 990
    assert not quality.learn([], []).rules and not quality.learn(rows, [False] * 1000).rules


def test_no_labels(docs, spark):
    out = quality.judge(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert out.where("verdict.kept = verdict.base_failed").count() == 0 and quality.judge(docs.limit(0), None, quality.DecisionList()).count() == 0


def test_language(docs):
    model = language.fit(docs.where(~language.held_out()))
    out = language.predict(docs.withColumn("h", language.held_out()), model).select("doc_id", "lang", "h", "language.*").collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r["h"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert all(r["lang_pred"] == "und" and r["rejected"] for r in out if r["doc_id"] in (-1, -2, -6))


def brute_language(model, text):
    """Plain loops: n-grams by dictionary, a dense vector, the cosine with every centroid."""
    out, word = [" "], True
    for c in text.lower():
        letter = unicodedata.category(c)[0] == "L"
        if letter or word:
            out.append(c if letter else " ")
        word = letter
    if text and not unicodedata.category(text.lower()[0])[0] == "L":
        out = out[1:]
    signs = "".join(out[1:] if out[0] == " " and len(out) > 1 and unicodedata.category(text.lower()[0])[0] == "L" else out)
    grams, mask = collections.Counter(), (1 << 64) - 1
    for n in (1, 2, 3):
        for i in range(len(signs) - n + 1):
            state = 0
            for c in signs[i : i + n]:
                state = (state * 0x1F3D5B79 + ord(c) + 1) & mask
            grams[(((state + n) * 0x9E3779B97F4A7C15 & mask) >> 40) % language.SIZE] += 1
    vector = [0.0] * language.SIZE
    for k, n in grams.items():
        vector[k] = (1 + math.log(n)) * float(model.idf[k])
    size = math.sqrt(sum(x * x for x in vector))
    near = [sum(vector[k] * float(c[k]) for k in grams) / size for c in model.centroids]
    best = max(range(len(near)), key=lambda i: near[i])
    return model.languages[model.owner[best]], near[best], near[best] < model.limit[model.owner[best]]


def test_language_against_brute_force(docs):
    model = language.fit(docs.where(~language.held_out()))
    rows = docs.where("text is not null and length(text) < 4000").selectExpr("doc_id", "text", *CLASHES)
    checked = 0
    for r in language.predict(rows, model).collect():
        if any(unicodedata.category(c)[0] == "L" for c in r["text"]):
            lang, score, rejected = brute_language(model, r["text"])
            assert (r["language"]["lang_pred"], r["language"]["rejected"]) == (lang, rejected) and abs(r["language"]["score"] - score) < 1e-3, r["text"]
            checked += 1
        assert (r["score"], r["lang_pred"], r["rejected"]) == (4.5, "zz", True)
    assert checked > 100
    with pytest.raises(ValueError):
        language.predict(docs.selectExpr("text", "1 as language"), model)


def test_training_takes_whole_texts_and_equal_rows_once(spark):
    long = ("palabra " * 9000).strip()
    rows = [(1, long, "es"), (2, "the word and the other", "en")]
    one, many = (language.fit(spark.createDataFrame(x, "doc_id long, text string, lang string")) for x in (rows, rows * 5))
    assert one.languages == many.languages == ["en", "es"] and (one.centroids == many.centroids).all()
    assert [r["language"]["lang_pred"] for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), one).orderBy("doc_id").collect()] == ["es", "en"]


def test_language_without_training(docs):
    out = language.predict(docs.select("doc_id", "text"), language.train([], [])).select("language.*").collect()
    assert {r["lang_pred"] for r in out} == {"und"} and language.predict(docs.limit(0), language.train([], [])).count() == 0


def test_a_row_repeated_often_is_one_row_of_the_sample(spark):
    """A row with the least hash, repeated as often as the sample is large, leaves room for the others."""
    rows = [(i, f"the cat and the dog number {i} went home", "en") if i % 2 else (i, f"el perro y el gato {i} en la casa", "es") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    least = tuple(frame.orderBy(F.xxhash64("doc_id", "text")).first())
    assert language.fit(frame.union(spark.createDataFrame([least] * 50, frame.schema)), sample=50).languages == ["en", "es"]


def test_prediction_keeps_columns_of_any_name(spark):
    frame = spark.createDataFrame([("x", "the cat", 1, {"a": 1})], "`meta.src` string, text string, `language` int, `a``b` map<string,int>")
    out = language.predict(frame, language.train(["the cat", "el gato"], ["en", "es"]), result="found")
    assert out.columns == ["meta.src", "text", "language", "a`b", "found"] and out.first()["found"]["lang_pred"] == "en"
