"""Searches for tables of queries, names and cases, against brute force."""

import collections
import math
import random
import re
import unicodedata

import pytest

from vigilake.operators import article_search, literature, name_search, terminology


def fold(x):
    return "".join(c for c in unicodedata.normalize("NFD", x.lower()) if unicodedata.category(c) != "Mn")


def cut(x):
    return re.findall(r"\w+", fold(x or ""))


def brute_search(articles, queries, most):
    texts = {(i, t): cut(t) for i, t in articles if i is not None}
    counted = [(i, cut(t)) for i, t in articles if i is not None and cut(t)]
    mean = sum(len(w) for _, w in counted) / max(1, len(counted))

    def tf(words, phrase):
        return sum(words[k : k + len(phrase)] == phrase for k in range(len(words) - len(phrase) + 1))

    hits, totals = set(), {}
    for q, groups in queries:
        phrases = [{" ".join(cut(p)) for p in g if cut(p)} for g in groups]
        every = set().union(*phrases) if phrases else set()
        df = {p: sum(tf(w, p.split()) > 0 for w in texts.values()) for p in every}
        best = {}
        for (i, _), w in texts.items():
            n = {p: tf(w, p.split()) for p in every}
            if groups and all(any(n[p] for p in g) for g in phrases):
                score = sum(round(1000 * math.log(1 + (len(counted) - df[p] + 0.5) / (df[p] + 0.5)) * n[p] * 2.2 / (n[p] + 1.2 * (0.25 + 0.75 * len(w) / mean))) for p in every if n[p])
                best[i] = max(best.get(i, -1), score)
        totals[q] = len(best)
        hits |= {(q, k + 1, i, s) for k, (s, i) in enumerate(sorted(((s, i) for i, s in best.items()), key=lambda x: (-x[0], x[1]))[:most])}
    return hits, totals


def articles_and_queries():
    r = random.Random(6)
    vocabulary = ["case", "case report", "Ibuprofén", "ibuprofen", "fever", "high fever", "risk", "the", "a", "skin rash", "rash"]
    articles = [(f"p{i}", " ".join(r.choices(vocabulary, k=r.choice([0, 2, 9, 60])))) for i in range(80)]
    articles += [("p3", "case ibuprofen fever"), ("p5", articles[5][1]), (None, "case ibuprofen fever"), ("p90", None), ("p91", "Case—REPORT, ibuprofén; high\nfever!")]
    queries = [(i, [r.choices(vocabulary, k=r.randint(1, 3)) for _ in range(r.randint(1, 4))]) for i in range(30)]
    return articles, [*queries, (100, []), (101, [["case"], []]), (102, [["case"], [" ", "?"]]), (103, [["absent"], ["case"]]), (104, [["fever high fever"], ["ibuprofen"]])]


def test_article_search(spark, tmp_path):
    articles, queries = articles_and_queries()
    frame, asked = spark.createDataFrame(articles, "pmid string, text string"), spark.createDataFrame(queries, "query_id int, groups array<array<string>>")
    expected = brute_search(articles, queries, 3)
    hits, totals = article_search.search(frame, asked, 3)
    assert {tuple(x) for x in hits.collect()} == expected[0] and {x["query_id"]: x["total"] for x in totals.collect()} == expected[1]
    assert sum(expected[1].values()) > 100
    article_search.write_positions(article_search.word_positions(frame), str(tmp_path / "words"), 8)
    words = article_search.phrases_of(asked).selectExpr("explode(split(phrase, ' ')) as word")
    kept = article_search.read_positions(spark, str(tmp_path / "words"), words, 8)
    assert {tuple(x) for x in article_search.search(frame, asked, 3, positions=kept)[0].collect()} == expected[0]
    none, zero = article_search.search(frame.limit(0), asked, 3)
    assert none.count() == 0 and {x["total"] for x in zero.collect()} == {0}


def test_article_search_where_texts_are_read(spark, monkeypatch):
    """Queries that fit in the tasks need no table of positions, and find what joins of positions find."""
    articles, queries = articles_and_queries()
    frame, asked = spark.createDataFrame(articles, "pmid string, text string"), spark.createDataFrame(queries, "query_id int, groups array<array<string>>")
    joined = article_search.search(frame, asked, 3, shipped=0)
    assert {tuple(x) for x in joined[0].collect()} == brute_search(articles, queries, 3)[0]
    monkeypatch.setattr(article_search, "word_positions", None)
    hits, totals = article_search.search(frame, asked, 3)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, joined[0].collect()))
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, joined[1].collect()))


def test_sections_of_cases(spark):
    articles = [("1", "Case report of fever", "ibuprofen in a child"), ("2", "A case", "ibuprofen, high fever"), ("3", None, "Risk factor: ibuprofen and fever and a case series"), ("4", "ibuprofen rash", ""), ("5", "Naproxen", "and rash")]
    cases = [("a", "ibuprofen", ["fever", "high fever"]), ("b", "naproxen", ["rash"]), ("c", "aspirin", ["rash"]), ("d", "x", [])]
    sections, shown = literature.sections_of_cases(spark.createDataFrame(cases, "case_id string, inn string, terms array<string>"), spark.createDataFrame(articles, "pmid string, title string, abstract string"))
    got = {(r["case_id"], r["section"]): r for r in sections.collect()}
    assert {k: (r["n_found"], r["n_shown"]) for k, r in got.items() if k[0] == "a"} == {("a", "casos_reportados"): (4, 2), ("a", "factores_riesgo"): (1, 1), ("a", "recomendaciones"): (0, 0)}
    assert got["a", "casos_reportados"]["details"] == "fever: 3; high fever: 1" and got["a", "recomendaciones"]["text"] == literature.NO_RESULT
    assert got["a", "factores_riesgo"]["text"] == "PMID: 3\nTitle: \nAbstract: Risk factor: ibuprofen and fever and a case series\nOrigen: fever"
    assert got["a", "casos_reportados"]["query"] == 'ibuprofen AND ("fever" OR "high fever") AND (case OR "case report" OR "case series")'
    assert {(k, r["n_found"], r["n_shown"]) for k, r in got.items() if k[0] in "bc" and k[1] == "asociacion_general"} == {(("b", "asociacion_general"), 1, 1), (("c", "asociacion_general"), 0, 0)}
    assert got["b", "asociacion_general"]["text"] == "PMID: 5\nTitle: Naproxen\nAbstract: and rash" and got["c", "asociacion_general"]["text"] == literature.NOTHING_GENERAL
    assert not any(k[0] == "d" for k in got)
    assert {(r["case_id"], r["pmid"]) for r in literature.distinct_ids(shown).collect()} >= {("a", "3"), ("b", "5")}
    assert literature.serialise(sections).where("case_id = 'b'").first()["text"].count("───") == 8


@pytest.mark.parametrize("shipped", [10_000, 0])
def test_names_in_texts(spark, shipped):
    r = random.Random(1)
    texts = [("".join(r.choices("abAB É1", k=r.choice([0, 1, 2, 5, 40]))),) for _ in range(200)] + [(None,), ("İstanbul aB",), ("x" * 5000 + "ab",)]
    names = ["a", "AB", "aba", "b1a", " ", "", None, "é", "abab", "zz", "Ab", "ab a"]
    got = name_search.names_in_texts(spark.createDataFrame([(i, t, 1) for i, (t,) in enumerate(texts)], "id int, text string, `a.b` int"), spark.createDataFrame([(x,) for x in names], "name string"), shipped=shipped)
    assert got.columns == ["id", "text", "a.b", "names"]
    real = {x.lower() for x in names if x and x.strip()}
    expected = {i: sorted(x for x in real if x in t.lower()) for i, (t,) in enumerate(texts) if t is not None}
    found = {x["id"]: x["names"] for x in got.collect()}
    assert found == {i: x for i, x in expected.items() if x} and len(found) > 100


def test_search_for_a_table_of_queries(spark):
    r = random.Random(3)
    some = lambda: "".join(r.choices("abcé ", k=r.randint(1, 9)))
    pt = [(str(i), some(), r.choice([some(), None]), i) for i in range(100, 160)] + [("100", "abc again", "x", 900)]
    llt = [(str(i), some(), some(), str(r.randint(95, 165)), i) for i in range(150, 230)]
    pt, llt = spark.createDataFrame(pt, "code string, name_en string, name_es string, ord long"), spark.createDataFrame(llt, "code string, name_en string, name_es string, pt_code string, ord long")
    queries = ["ab", "ABC", "é a", "a", "", None, "10", "1", "155", "999", "ßø", "bca", "abca", "cab ", "abcab", "c cc", "zzzz", "  b "]
    got = collections.defaultdict(list)
    for x in name_search.search_terms(spark.createDataFrame([(q,) for q in [*queries, "ab"]], "query string"), pt, llt, 7).orderBy("place").collect():
        got[x["query"]].append((x["code"], x["name_en"], x["name_es"], x["type"], x["pt_code"], x["tier"], x["ord"], x["pt_name_en"]))
    for q in queries:
        one = [(x["code"], x["name_en"], x["name_es"], x["type"], x["pt_code"], x["tier"], x["ord"], x["pt_name_en"]) for x in terminology.search(q, pt, llt, 7).collect()] if q else []
        assert got.get((q or "").strip(), []) == one, q
    assert len(got) > 8


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_similar_names(spark, distance):
    r = random.Random(distance)
    names = ["".join(r.choices("abcd", k=r.randint(1, 9))) for _ in range(150)] + ["A", "", " ", None, "ibuprofen", "Ibuprofen ", "naproxen"]
    queries = ["".join(r.choices("abcd", k=r.randint(1, 9))) for _ in range(60)] + ["IBUPROFFEN", "ibprofn", " ", None, "x", "napro", "naproxen"]
    got = name_search.similar_names(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame([(n, k) for k, n in enumerate(names)], "name string, nth int"), distance, 1000, rank="nth")
    found = collections.defaultdict(set)
    for x in got.collect():
        found[x["query"]].add((x["place"], x["name"], x["distance"]))
    first = {}
    for k, n in enumerate(names):
        if n and n.strip():
            first.setdefault(n.strip().lower(), (k, n))
    for q in {x for x in queries if x and x.strip()}:
        near = sorted((d, k, key) for key, (k, n) in first.items() if (d := edits(q.strip().lower(), key)) <= distance)
        assert found[q] == {(p + 1, first[key][1], d) for p, (d, _, key) in enumerate(near)}, q


def test_only_the_first_names_of_a_text_are_ranked(spark, monkeypatch):
    """Names with one folded text, however many, are cut to a query's bound before they are taken apart; hits stay those of single searches."""
    pt = spark.range(3000).selectExpr("cast(id as string) as code", "element_at(array('green Apple', 'GREEN pear', 'réd apple'), 1 + cast(id % 3 as int)) as name_en", "'x' as name_es", "id as ord")
    llt = spark.createDataFrame([], "code string, name_en string, name_es string, pt_code string, ord long")
    kept = []
    monkeypatch.setattr(name_search, "settled", lambda rows: kept.append(rows.cache()) or kept[-1])
    queries = ["apple", "een", "re", "red apple", "12", "299"]
    got = collections.defaultdict(list)
    for x in name_search.search_terms(spark.createDataFrame([(q,) for q in queries], "query string"), pt, llt, 5).orderBy("place").collect():
        got[x["query"]].append((x["code"], x["name_en"], x["tier"]))
    assert [x.count() for x in kept] == [4 * 2 * 5]
    for q in queries:
        assert got[q] == [(x["code"], x["name_en"], x["tier"]) for x in terminology.search(q, pt, llt, 5).collect()] and len(got[q]) == 5, q


def test_sub_sections_are_dealt_to_all_tasks_once(spark, monkeypatch):
    """A sub-section with several names of cases is kept once, in several files, and whole texts not at all."""
    from vigilake.operators import signals

    docs = spark.range(200).coalesce(1).selectExpr("concat('f', id) as filename", "'d' as date", "'minutes' as source", "'4.1. ibuprofen and naproxen with High  rash\n4.2 end' as section4")
    cases = spark.createDataFrame([("1", "ibuprofen", ["high rash"]), ("2", "naproxen", ["fever"])], "case_id string, inn string, terms array<string>")
    kept, settled = [], signals.settled
    monkeypatch.setattr(signals, "settled", lambda rows: kept.append(settled(rows)) or kept[-1])
    got = signals.evidence_of_cases(docs, cases, judged=False)
    assert {(r["case_id"], r["with_reaction"], r["terms"]) for r in got.collect()} == {("1", True, "high rash"), ("2", False, "")} and got.count() == 400
    assert kept[0].where("part is not null").count() == 200 and len(kept[0].inputFiles()) >= 4
