"""

A query is a list of groups of which all must be found; a group is a list of phrases of which any must be. ``literature``
writes such groups beside the query's text, so nothing is parsed. A phrase is one or more words that follow each other
in the folded text.

Plan: queries whose phrases together are short (``SHIPPED``) go to the tasks, and each text is looked at once, where it is read: its phrases
are found and its queries decided there, so that only the articles of a query, and for each task how many texts have each phrase, are
written. Otherwise, and for kept positions, the words of texts with their positions are a table (``word_positions``, which can be
written once by ``write_positions``). Only words of asked phrases are read. A phrase is found where its words are at successive
positions, an aggregate by article, phrase and start, so common words spread over articles. A query starts from
the articles of the group with the fewest, and its other phrases are looked up by article and phrase; so a common group costs a
lookup for each article left and not its whole list for each query. Scores are BM25 shares of the query's phrases in
thousandths (each rounded, so sums do not depend on their order); the best are kept by a limit in each task before the shuffle.

Defined results: null and empty texts have no words and are not counted; null ids are left out; texts of one id are versions of
one article, which counts once with its best version; blank phrases are never found; a query with a group without phrases that
are found, or without groups, finds nothing; equal scores go by ascending id.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from vigilake.functions.text import match_fold
from vigilake.session import broadcast_if_small, settled, ship

#: BM25's saturation and length weight.
K1, B = 1.2, 0.75
#: Characters of all asked phrases together that are shipped to the tasks; longer tables of queries are joined with positions.
SHIPPED = 2_000_000
#: Texts of an Arrow batch that are taken as Python strings at once.
AT_ONCE = 64
_WORD = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """The folded words of a text, in order."""
    return F.regexp_extract_all(match_fold(text), F.lit(_WORD), F.lit(0))


def word_positions(articles: DataFrame, id_col: str = "pmid", text_col: str = "text") -> DataFrame:
    """word, id, version (of the text), n (words of the text), pos; a plan without a shuffle."""
    cut = articles.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), words(F.col(text_col)).alias("words"))
    # outer: otherwise the words are made once more for a filter on their number
    rows = cut.select("id", "version", F.size("words").cast("long").alias("n"), F.posexplode_outer("words").alias("pos", "word"))
    return rows.where("word is not null").select("word", "id", "version", "n", "pos")


def write_positions(positions: DataFrame, path: str, buckets: int = 256) -> None:
    """Keep the table in folders of words by hash, each sorted by word, so that a search reads the folders and pages of its words."""
    bucket = F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int")
    # a common word's rows are spread over tasks; they meet again in its folder
    spread = positions.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(16)))
    spread.sortWithinPartitions("bucket", "word").write.partitionBy("bucket").mode("overwrite").parquet(path)


def read_positions(spark, path: str, asked: DataFrame, buckets: int = 256) -> DataFrame:
    """The rows of the folders that the asked words are in (joined by folder, so that others are not read)."""
    folders = asked.select(F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int").alias("bucket")).distinct()
    return spark.read.parquet(path).join(F.broadcast(folders), "bucket", "left_semi").drop("bucket")


def phrases_of(queries: DataFrame, query: str = "query_id", groups: str = "groups") -> DataFrame:
    """query, part (number of the group), phrase (its folded words joined by a blank); each once."""
    parts = queries.select(F.struct(F.col(query).alias("id")).alias("query"), F.posexplode(groups).alias("part", "phrases"))
    return parts.select("query", "part", F.explode("phrases").alias("x")).select("query", "part", F.array_join(words(F.col("x")), " ").alias("phrase")).where("phrase != ''").distinct()


def repeated_rows(articles: DataFrame, id_col: str = "pmid", text_col: str = "text") -> DataFrame:
    """id, version, copies: rows that stand in the table several times."""
    own = articles.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"))
    return own.groupBy("id", "version").agg(F.count("*").alias("copies")).where("copies > 1")


def find_phrases(positions: DataFrame, phrases: DataFrame, repeated: DataFrame) -> DataFrame:
    """phrase, id, version, n, tf: how often each of the distinct phrases is in each text. repeated: of ``repeated_rows``, whose positions come as often."""
    slots = phrases.select("phrase").distinct().select("phrase", F.size(F.split("phrase", " ")).alias("size"), F.posexplode(F.split("phrase", " ")).alias("nth", "word"))
    # one word needs no start; words of a text are in one task, so the first aggregate is all but done before its shuffle
    start = F.when(F.col("size") > 1, F.col("pos") - F.col("nth"))
    met = positions.join(broadcast_if_small(slots), "word").groupBy("phrase", "size", "id", "version", "n", start.alias("start")).agg(F.count("*").alias("seen"))
    times = F.expr("case when size = 1 then seen div coalesce(copies, 1) when seen = size * coalesce(copies, 1) then 1 else 0 end")
    found = met.join(broadcast_if_small(repeated), ["id", "version"], "left").groupBy("phrase", "id", "version", "n").agg(F.sum(times).alias("tf"))
    return found.where("tf > 0")


class Finder:
    """Phrases of a text and the queries that it answers; a task has one."""

    def __init__(self, queries: list[tuple[int, int, list[tuple[int, str]]]]):
        """queries: number, parts, (part, phrase) of each."""
        self.phrases = list(dict.fromkeys(x for _, _, own in queries for _, x in own))
        number = {x: i for i, x in enumerate(self.phrases)}
        self.single = {x: i for x, i in number.items() if " " not in x}
        self.several: dict[str, list[tuple[int, str, list[str]]]] = {}
        for x, i in number.items():
            if " " in x:
                first, *more = x.split(" ")
                self.several.setdefault(first, []).append((i, f" {x} ", more))
        self.words = self.single.keys() | self.several.keys()
        self.parts = {}
        # a query is looked at in texts with a phrase of one of its groups: of long phrases, if it has such a group, and few
        self.led: dict[int, list[int]] = {}
        for q, parts, own in queries:
            groups: dict[int, list[int]] = {}
            for part, x in own:
                groups.setdefault(part, []).append(number[x])
            if len(groups) == parts:
                self.parts[q] = list(groups.values())
                for i in min(self.parts[q], key=lambda g: (any(" " not in self.phrases[i] for i in g), len(g))):
                    self.led.setdefault(i, []).append(q)

    def find(self, text: str) -> tuple[int, dict[int, int]]:
        """Words of a text of words joined by blanks, and how often it has each phrase that it has."""
        seen = Counter(text.split(" ")) if text else Counter()
        out, padded = {}, f" {text} "
        for word in seen.keys() & self.words:
            if word in self.single:
                out[self.single[word]] = seen[word]
            for i, phrase, more in self.several.get(word, ()):
                if all(x in seen for x in more):
                    at, times = padded.find(phrase), 0
                    while at >= 0:
                        at, times = padded.find(phrase, at + 1), times + 1
                    if times:
                        out[i] = times
        return seen.total(), out

    def answers(self, found: dict[int, int]) -> list[int]:
        """The queries of which every group has a phrase among those found."""
        asked = {q for i in found.keys() & self.led.keys() for q in self.led[i]}
        return [q for q in asked if all(any(i in found for i in group) for group in self.parts[q])]


def _in_texts(articles: DataFrame, asked: DataFrame, size: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """query, parts, id, version, n, phrase, tf, df of the articles that queries find; texts with words; words of all."""
    lists = asked.groupBy("query").agg(F.collect_list(F.struct("part", "phrase")).alias("own")).join(size, "query")
    numbered = settled(lists.withColumn("q", F.monotonically_increasing_id()))
    queries = [(r["q"], r["parts"], [(x["part"], x["phrase"]) for x in r["own"]]) for r in numbered.collect()]
    phrases = Finder(queries).phrases
    texts = articles.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    texts = texts.join(broadcast_if_small(repeated_rows(articles, id_col, text_col)), ["id", "version"], "left")
    rows = texts.select("id", "version", F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), F.array_join(words(F.col("text")), " ").alias("words"))
    ship(articles.sparkSession)

    def run(batches):
        finder, total, n_words, having = Finder(queries), 0, 0, Counter()
        names = ["q", "id", "version", "n", "phrase", "tf", "copies"]
        kinds = [pa.int64(), None, pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

        def batch_of(ids, columns):
            kept = [ids if kind is None else pa.array(columns[name], kind) for name, kind in zip(names, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(kept, names)

        id_kind = None
        for whole in batches:
            id_kind = whole.schema.field(0).type
            for begin in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(begin, AT_ONCE)
                hits, at = [], []
                for k, (version, copies, text) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)):
                    n, found = finder.find(text)
                    total, n_words = total + (n > 0), n_words + n
                    having.update((i, copies) for i in found)
                    for q in finder.answers(found):
                        own = {i for group in finder.parts[q] for i in group if i in found}
                        hits += [(q, version, n, i, found[i], copies) for i in own]
                        at += [k] * len(own)
                if hits:
                    columns = dict(zip(("q", "version", "n", "phrase", "tf", "copies"), zip(*hits, strict=True), strict=True))
                    yield batch_of(batch.column(0).take(pa.array(at)), columns)
        if id_kind is not None:
            # rows without a query: texts with each phrase, then (without a phrase) all texts and words
            counts = [(None, None, None, i, n, copies) for (i, copies), n in having.items()] + [(None, None, n_words, None, total, None)]
            columns = dict(zip(("q", "version", "n", "phrase", "tf", "copies"), zip(*counts, strict=True), strict=True))
            yield batch_of(pa.nulls(len(counts), id_kind), columns)

    long = lambda name: StructField(name, LongType())
    schema = StructType([long("q"), StructField("id", rows.schema["id"].dataType), long("version"), long("n"), StructField("phrase", IntegerType()), long("tf"), long("copies")])
    out = settled(rows.mapInArrow(run, schema))
    corpus = out.where("q is null and phrase is null").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    # rows that stand in the table several times count once
    df = out.where("q is null and phrase is not null").groupBy("phrase", "copies").agg(F.sum("tf").alias("rows")).groupBy("phrase").agg(F.sum(F.expr("rows div copies")).alias("df"))
    hits = out.where("q is not null").select("q", "id", "version", "n", "phrase", "tf").distinct()
    return hits.join(df, "phrase").join(numbered.select("q", "query", "parts"), "q").drop("q"), corpus["texts"], corpus["words"]


def _share(n_articles: int, n_words: int | None) -> Column:
    """BM25's share of a phrase (df, tf) in a text of n words, in thousandths."""
    mean = (n_words or 0) / max(1, n_articles)
    idf = F.log(F.lit(1.0) + (F.lit(float(n_articles)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return F.round(F.lit(1000.0) * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.lit(max(mean, 1e-9))))).cast("long")


def _by_positions(articles: DataFrame, asked: DataFrame, size: DataFrame, id_col: str, text_col: str, positions: DataFrame | None) -> DataFrame:
    """query, id, version, score by joins of positions."""
    # as many words as the folded text has, without folding it
    n_words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[\p{L}\p{N}_][\p{L}\p{N}_\p{Mn}]*")), F.lit(0))
    corpus = articles.where(F.col(id_col).isNotNull()).agg(F.count_if(n_words > 0).alias("n"), F.sum(F.when(n_words > 0, n_words)).alias("words")).first()
    found = settled(find_phrases(word_positions(articles, id_col, text_col) if positions is None else positions, asked, repeated_rows(articles, id_col, text_col)))
    df = found.groupBy("phrase").agg(F.count("*").alias("df"))
    weighed = asked.join(df, "phrase")
    rarest = weighed.groupBy("query", "part").agg(F.sum("df").alias("list")).groupBy("query").agg(F.min(F.struct("list", "part")).alias("x"), F.count("*").alias("alive")).join(size, "query").where("alive = parts").select("query", "parts", F.col("x.part").alias("part"))
    starts = weighed.join(rarest, ["query", "part"]).select("query", "parts", "phrase")
    left = starts.join(found.select("phrase", "id", "version"), "phrase").select("query", "parts", "id", "version").distinct()
    pieces = left.join(weighed.select("query", "part", "phrase", "df"), "query").join(found, ["phrase", "id", "version"])
    # a phrase of several groups counts once in the score
    whole = pieces.groupBy("query", "parts", "id", "version", "phrase", "df", "tf", "n").agg(F.collect_set("part").alias("in_parts"))
    versions = whole.groupBy("query", "parts", "id", "version").agg(F.sum(_share(corpus["n"], corpus["words"])).alias("score"), F.size(F.array_distinct(F.flatten(F.collect_list("in_parts")))).alias("held")).where("held = parts")
    return versions


def search(articles: DataFrame, queries: DataFrame, most: int = 2, id_col: str = "pmid", text_col: str = "text", query: str = "query_id", groups: str = "groups", positions: DataFrame | None = None, shipped: int = SHIPPED) -> tuple[DataFrame, DataFrame]:
    """Hits (query, place, id_col, score: the ``most`` best of each query) and totals (query, total: all that it finds, 0 included).

    queries: query, groups (array of arrays of phrases). positions: of ``read_positions``, else made from articles.
    """
    asked = settled(phrases_of(queries, query, groups))
    size = queries.select(F.struct(F.col(query).alias("id")).alias("query"), F.size(groups).alias("parts")).groupBy("query").agg(F.max("parts").alias("parts"))
    if positions is None and asked.agg(F.coalesce(F.sum(F.length("phrase")), F.lit(0))).first()[0] <= shipped:
        pieces, n_articles, n_words = _in_texts(articles, asked, size, id_col, text_col)
        versions = pieces.groupBy("query", "id", "version").agg(F.sum(_share(n_articles, n_words)).alias("score"))
    else:
        versions = _by_positions(articles, asked, size, id_col, text_col, positions)
    hits = settled(versions.groupBy("query", "id").agg(F.max("score").alias("score")))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    best = hits.withColumn("place", place).where(F.col("place") <= most)
    totals = size.select("query").join(hits.groupBy("query").agg(F.count("*").alias("total")), "query", "left").na.fill(0, ["total"])
    return best.select(F.col("query.id").alias(query), "place", F.col("id").alias(id_col), "score"), totals.select(F.col("query.id").alias(query), "total")
