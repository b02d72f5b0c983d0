"""The pipeline against a brute-force version of it, and the registered queries."""

import collections
import random

import duckdb
import public_tokenizers as PT
import pytest
from pyspark.sql import functions as F
from test_duplicates import brute_classes, family
from test_quality_language import brute_kept, brute_language
from tokenizers import Tokenizer

import corpus_pipeline
from vigilake.llm import language, quality, queries


def test_against_brute_force(spark, sf):
    """Every stage in plain Python on a small table, with clashing columns, null and empty texts, repeated ids and copies."""
    own = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").where("length(text) < 3000").orderBy("doc_id").limit(140).collect()]
    r = random.Random(3)
    texts = [t for _, t, _ in own if len(t.split()) > 60][:6]
    near = [(10_000 + 10 * k + i, " ".join(w if j != at else "changed" for j, w in enumerate(t.split())), None) for k, t in enumerate(texts) for i, at in enumerate(r.sample(range(40), 2))]
    odd = [(20_000, None, None), (20_001, "", "en"), (20_002, "12 34 " * 20, None), (20_003, texts[0], None), (own[0][0], texts[1], None), (20_004, texts[2], "en"), (20_004, texts[2], "en"), (None, texts[3], None)]
    rows = [(*x, k % 3, "x", 1.5) for k, x in enumerate(own + near + odd)]
    docs = now = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, kept string, score double").checkpoint()
    sizes, out = [len(rows)], None
    for name, stage in corpus_pipeline.STAGES:
        left = [tuple(x) for x in now.collect()]
        out = stage(spark, now, sf)
        if name == "packing":
            break
        assert out.columns == docs.columns, name
        got = sorted(map(tuple, out.collect()), key=str)
        if name == "quality":
            rules = quality.fit(now, spark.read.parquet(f"{sf}/labels.parquet"))
            expected = [x for x in left if brute_kept(rules, x[1] or "")]
        elif name == "language":
            model = language.fit(now.where(~language.held_out()))
            expected = [x for x in left if any(c.isalpha() for c in x[1]) and not brute_language(model, x[1])[2]]
        else:
            classes = brute_ids(left)
            assert sorted((x[0] for x in got), key=str) == sorted([*(i for i, c in classes.items() if i == c), *(None for x in left if x[0] is None)], key=str)
            expected = [x for x in got if x in left]
        assert got == sorted(expected, key=str), name
        sizes.append(len(got))
        now = spark.createDataFrame(out.collect(), docs.schema).checkpoint()
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] > 50
    library = Tokenizer.from_file(PT.path("word_bpe_49k.json"))
    tokens = collections.Counter()
    for x in out.collect():
        tokens[x["doc_id"]] += x["length"]
    assert tokens == {x[0]: len(library.encode(x[1], add_special_tokens=False).ids) + 1 for x in left}


def brute_ids(rows):
    """Classes of ids: texts by brute_classes, with all texts of one id in one class."""
    numbered = list(enumerate(rows))
    group = brute_classes([(k, x[1]) for k, x in numbered])
    by_id, changed = {x[0]: x[0] for _, x in numbered if x[0] is not None}, True
    while changed:
        changed, least = False, {}
        for k, x in numbered:
            if x[0] is not None:
                least[group[k]] = min(least.get(group[k], x[0]), by_id[x[0]])
        for k, x in numbered:
            if x[0] is not None and least[group[k]] < by_id[x[0]]:
                by_id[x[0]], changed = least[group[k]], True
    return by_id


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).where("`sum(length)` != `max(doc_tokens)`").count() == 0


def test_empty(spark, sf):
    now = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        assert now.count() == 0


def test_columns_of_any_type_and_name(spark, sf):
    """Every stage but the last keeps columns that cannot be hashed or whose names hold dots; of rows that differ in a map only one stays."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) between 500 and 3000").limit(60)
    more = docs.union(docs.limit(3)).select("*", F.array(F.create_map(F.lit("k"), F.monotonically_increasing_id())).alias("maps"), F.struct(F.create_map(F.lit(1), "lang").alias("m")).alias("s"), F.parse_json(F.lit('{"a": [1, null]}')).alias("v"), F.lit("x").alias("meta.src"), F.lit(2).alias("b`c")).checkpoint()
    now = more
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf).checkpoint()
        assert now.schema.simpleString() == more.schema.simpleString(), name
    ids = [r["doc_id"] for r in now.collect()]
    assert len(ids) == len(set(ids)) > 20 and {str(r) for r in now.collect()} <= {str(r) for r in more.collect()}
    assert sorted(ids) == sorted(r["doc_id"] for r in corpus_pipeline.near_dup_stage(spark, now, sf).collect())


def test_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf, name):
    """Each registered query runs over its whole table, and gives what its SQL gives where it has one."""
    got = queries.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) >= {"op4_vectors": spark.read.parquet(f"{sf}/embeddings.parquet").count()}.get(name, 20)
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for table in ("documents", "embeddings", "pages", "benchmark", "conversations"):
            con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
        found = con.execute(queries.ORACLE_SQL[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == sorted(got.columns)
        order = [got.columns.index(x) for x in names]
        assert sorted((tuple(r[i] for i in order) for r in rows), key=str) == sorted(found.fetchall(), key=str)
