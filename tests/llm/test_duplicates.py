"""Operators 4 and 10 and the components below them, against brute force."""

import collections
import random

import duckdb
import numpy as np
import pytest

from vigilake.llm import components, near_dups, oracle, vectors
from vigilake.llm.components import connected_components


def union_find(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize(("native", "task"), [(True, 0), (False, 1 << 20), (False, 60)])
def test_components(spark, monkeypatch, native, task):
    monkeypatch.setattr(components, "TASK", task)
    r = random.Random(1)
    links = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7), (None, 3)]
    own = connected_components(spark.createDataFrame(links, "a long, b long"), native=native)
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert {x["node"]: x["component"] for x in own.collect()} == union_find({x for p in real for x in p}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long"), native=native).count() == 0


def test_similarity_is_the_definition():
    r = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 12, 8)).astype(np.uint64) for _ in range(2))
        wa, wb = r.integers(1, 4, len(a)), r.integers(1, 4, len(b))
        x, y = dict(zip(a.tolist(), wa.tolist(), strict=True)), dict(zip(b.tolist(), wb.tolist(), strict=True))
        expected = sum(1 / sum(max(x.get(k, 0) / x[c], y.get(k, 0) / y[c]) for k in x.keys() | y.keys()) for c in x.keys() & y.keys())
        assert near_dups.similarity(a, wa, b, wb) == pytest.approx(expected)


def test_sketch_estimates_the_similarity():
    r = random.Random(4)
    base = [f"w{r.randint(0, 500)}" for _ in range(400)]
    other = base[:]
    for i in r.sample(range(400), 12):
        other[i] = "new"
    texts = [" ".join(base), " ".join(other)]
    doc, prints, weight = near_dups.shingles(texts)
    sketch = near_dups.sketches(doc, prints, weight, 2, 2048)
    real = near_dups.similarity(prints[doc == 0], weight[doc == 0], prints[doc == 1], weight[doc == 1])
    assert abs((sketch[0] == sketch[1]).mean() - real) < 0.05


def brute_classes(rows):
    counts = {}
    for i, text in rows:
        words = (text or "").split()
        if words and i is not None:
            counts[i] = collections.Counter([tuple(words[k : k + 5]) for k in range(len(words) - 4)] or [tuple(words)])
    links = []
    for a in counts:
        for b in counts:
            if a < b and (common := counts[a].keys() & counts[b].keys()):
                x, y = counts[a], counts[b]
                if max(x.values()) == max(y.values()) == 1:  # the plain Jaccard index
                    links += [(a, b)] if len(common) >= 0.8 * len(x.keys() | y.keys()) else []
                elif len(common) / min(len(x), len(y)) > 0.3 and sum(1 / sum(max(x[k] / x[c], y[k] / y[c]) for k in x.keys() | y.keys()) for c in common) >= 0.8:
                    links.append((a, b))
    return union_find(counts, links)


def family(r, first, n, words, edits):
    base = [f"x{r.randint(0, 9999)}" for _ in range(words)]
    out = []
    for k in range(n):
        own = base[:]
        for i in r.sample(range(words), edits):
            own[i] = f"y{r.randint(0, 9999)}"
        out.append((first + k, " ".join(own)))
    return out


def test_op10(spark):
    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"z{r.randint(0, 99999)}" for _ in range(60))) for i in range(40)]
    rows += family(r, 100, 60, 150, 2) + family(r, 200, 4, 60, 0) + [(300 + i, f"short {i % 2}") for i in range(6)]
    rows += [(400, None), (401, ""), (402, " "), (None, "no id here"), (403, "again and again " * 30), (404, "again and again " * 31)]
    got = near_dups.near_duplicates(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, class_id int")).collect()
    assert len(got) == len(rows)
    mine = {x["doc_id"]: x["class_id"] for x in got}
    for i, c in brute_classes(rows).items():
        assert mine[i] == c, i
    assert [mine[i] for i in (400, 401, 402)] == [400, 401, 402] and mine[None] is None
    assert all(x["kept"] == (x["doc_id"] == x["class_id"]) for x in got if x["doc_id"] is not None)


def test_op10_loose_group(spark, monkeypatch):
    """A group whose members are only partly similar goes through the further rounds and gets the same classes."""
    monkeypatch.setattr(near_dups, "BLOCK", 32)
    r = random.Random(11)
    rows = family(r, 0, 120, 160, 3)
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["class_id"] for x in got} == brute_classes(rows)


def test_op10_graded_group(spark, monkeypatch):
    """Members at all distances from one text, in a group far beyond a block, with equal rows and long texts."""
    monkeypatch.setattr(near_dups, "BLOCK", 100)
    r = random.Random(12)
    base = [f"x{r.randint(0, 9999)}" for _ in range(120)]
    rows = []
    for k in range(2000):
        own = base[:]
        for i in r.sample(range(120), k % 12):
            own[i] = f"y{r.randint(0, 99999)}"
        rows.append((k, " ".join(own)))
    rows += rows[:5] + [(5000 + k, " ".join(f"z{i % 9000}" for i in range(20000)) + f" end{k}") for k in range(3)]
    got = {x["doc_id"]: x["class_id"] for x in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # brute force with sets: no shingle repeats in these texts but in the long ones, which are near one another only
    sets = {i: {hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)} for i, text in rows[:2000] for w in [text.split()]}
    names = sorted(set().union(*sets.values()))
    where = {x: k for k, x in enumerate(names)}
    m = np.zeros((2000, len(names)), np.float32)
    for i, own in sets.items():
        m[i, [where[x] for x in own]] = 1
    common, size = m @ m.T, m.sum(axis=1)
    links = np.argwhere(np.triu(common / (size[:, None] + size - common) >= 0.8, 1)).tolist()
    expected = union_find(range(2000), links)
    assert {i: got[i] for i in range(2000)} == expected
    assert 1 < len(set(expected.values())) < 2000 and [got[5000 + k] for k in range(3)] == [5000] * 3


def test_op10_texts_of_one_id(spark):
    """Rows of one id are one document; its texts' groups are one."""
    r = random.Random(13)
    a, b, c = (" ".join(f"{n}{r.randint(0, 9999)}" for _ in range(40)) for n in "abc")
    rows = [(5, a), (5, b), (3, b), (9, a), (5, a), (7, c), (8, c + " more"), (8, b), (11, "alone here"), (None, a)]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {x["doc_id"]: x["class_id"] for x in got} == {5: 3, 3: 3, 9: 3, 7: 3, 8: 3, 11: 11, None: None}
    many = [(1, f"text of its own number {k}") for k in range(300)] + [(2, "text of its own number 7"), (4, "something else altogether now")]
    got = near_dups.near_duplicates(spark.createDataFrame(many, "doc_id long, text string")).collect()
    assert len(got) == 302 and {x["doc_id"]: x["class_id"] for x in got} == {1: 1, 2: 1, 4: 4}


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_op10_colliding_words(spark):
    """Words whose polynomial fingerprints modulo 2**64 are equal are different words."""
    a, b = thue_morse(2048)
    rows = [(1, f"{a} one two three four five six seven"), (2, f"{b} one two three four five six seven"), (3, a), (4, b), (5, f"{a} one two three four five six seven eight nine ten eleven twelve")]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["class_id"] for x in got} == {k: k for k in range(1, 6)}


def test_op10_empty(spark):
    assert near_dups.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op4(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    r = np.random.default_rng(3)
    base = r.standard_normal((20, 32))
    m = np.concatenate([base[i] + 0.05 * r.standard_normal((8, 32)) for i in range(20)] + [np.tile(base[0] + 0.2, (40, 1)), r.standard_normal((100, 32))])
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(m)]
    odd = [(-1, None), (-2, []), (-3, [0.0] * 32), (-4, [None] + [1.0] * 31), (-5, [float("nan")] + [1.0] * 31), (-6, [float("inf")] + [1.0] * 31), (None, rows[0][1])]
    got = {x["vec_id"]: x for x in vectors.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()}
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T) >= 0.9
    np.fill_diagonal(link, False)
    expected = union_find(range(len(rows)), list(zip(*map(np.ndarray.tolist, np.nonzero(link)), strict=True)))
    right = sum(got[i]["n_links"] == link[i].sum() and got[i]["component_id"] == expected[i] for i in range(len(rows)))
    assert right >= 0.98 * len(rows) and sum(got[i]["n_links"] for i in range(len(rows))) <= link.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(-6, 0))


def test_op4_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_op4_lengths(spark):
    """Vectors are linked within each length, as OP4 does."""
    r = np.random.default_rng(5)
    rows = []
    for dims in (32, 8, 16, 1):
        base = r.standard_normal((6, dims))
        rows += [[float(np.float32(x)) for x in v] for v in np.concatenate([base, base, base + 0.005 * r.standard_normal(base.shape)])]
    rows = [(i, v) for i, v in enumerate([*rows, [3.0, 4.0], [3.0, 4.0], [1.0, 2.0, 3.0]])] + [(-1, [0.0] * 8), (-2, None), (-3, [None] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.register("embeddings", frame.toArrow())
    got = vectors.near_duplicates(frame).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(tuple(x) for x in got) == sorted(con.execute(oracle.OP4).fetchall())


def test_op4_magnitudes_and_repeated_ids(spark):
    """Great and small components are compared as others are; different vectors of one id are vectors of their own."""
    rows = [(1, [1e200, 2e200]), (2, [1e200, 2.0001e200]), (3, [1e-200, 2e-200]), (4, [-1e308, 5e-324]), (5, [5e-324, 0.0]), (6, [1e308, 0.0])]
    rows += [(50, [1.0, -2.0]), (50, [-1.0, -2.0]), (51, [-1.0, -2.00001]), (51, [-1.0, -2.00001]), (52, [1.0, -2.00001]), (53, None), (50, None), (50, [1.0, -2.0])]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] < 50} == {(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (5, 1, 5), (6, 1, 5)}
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] >= 50) == [(50, 0, 50), (50, 1, 50), (50, 1, 50), (50, 1, 50), (51, 1, 50), (51, 1, 50), (52, 1, 50), (53, 0, 53)]


def test_op4_recall_beside_the_given_table(spark, sf):
    """Links of the given vectors with copies of them at cosines about the limit, held against brute force in double precision."""
    frame = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r["vec_id"], np.array(r["embedding"], np.float64)) for r in frame.collect() if r["embedding"] is not None]
    r = np.random.default_rng(4)
    for i, v in list(rows):
        noise = r.standard_normal(len(v))
        rows.append((100_000 + i, v / np.linalg.norm(v) + noise / np.linalg.norm(noise) * r.uniform(0.3, 0.55)))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T) >= 0.9
    np.fill_diagonal(link, False)
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(spark.createDataFrame(rows, frame.schema)).collect()}
    assert sum(got.values()) >= 0.99 * link.sum() > 200 and all(got[i] <= n for (i, _), n in zip(rows, link.sum(axis=1), strict=True))
