"""

All three are joins on pieces of names: substrings of fixed length (grams) for containment, and unedited segments for
approximate names. A hot piece is a key of a join that adaptive execution splits; ranked results are kept by limits in
each task before they are shuffled.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions.text import ascii_fold, bound, strip
from vigilake.session import broadcast_if_small, settled, ship, spread

#: Characters of all names together that are shipped to the tasks as one automaton; longer lists are joined by grams.
SHIPPED = 4_000_000
GRAM = 3


def grams(text: Column, size: int = GRAM) -> Column:
    """The distinct substrings of a length."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def _gram_of(name: Column) -> Column:
    """A gram that stands for a name: its first characters, as many as GRAM or the name has."""
    return F.substring(name, 1, GRAM)


def names_in_texts(texts: DataFrame, names: DataFrame, text_col: str = "text", name_col: str = "name", shipped: int = SHIPPED) -> DataFrame:
    """FLT-03/JOIN-11 for a table of names: texts with one more column ``names``, the distinct lower-cased names that occur as substrings, sorted.

    Case is ignored as by lower(); there are no word boundaries. Texts without any name go. Blank and null names are in no text. The names
    go to the tasks as one automaton if all their characters are at most ``shipped``; otherwise grams of each text find
    candidates by a join, and the texts take part by a hash of theirs and are compared with their candidates.
    """
    known = names.select(F.lower(name_col).alias("name")).where(F.coalesce(strip(F.col("name")), F.lit("")) != "").distinct()
    size = known.agg(F.coalesce(F.sum(F.length("name")), F.lit(0))).first()[0]
    if size <= shipped:
        ship(texts.sparkSession)
        return _by_automaton(texts, [r["name"] for r in known.collect()], text_col)
    return _by_grams(texts, known, text_col)


def _by_automaton(texts: DataFrame, names: list[str], text_col: str) -> DataFrame:
    columns = [F.col(f"`{c}`") for c in texts.columns]
    rows = texts.select(F.struct(*columns).alias("row"), F.lower(text_col).alias("low")).where("low is not null")

    def run(batches):
        import ahocorasick

        found = ahocorasick.Automaton()
        for x in names:
            found.add_word(x, x)
        if names:
            found.make_automaton()
        for batch in batches:
            hits = [sorted({x for _, x in found.iter(t)}) if names else [] for t in batch.column(1).to_pylist()]
            some = pa.array([bool(x) for x in hits])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(pa.string()))], ["row", "names"]).filter(some)

    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("names", ArrayType(StringType()))])).select("row.*", "names")


def _by_grams(texts: DataFrame, known: DataFrame, text_col: str) -> DataFrame:
    kinds = [r[0] for r in known.select(F.least(F.length("name"), F.lit(GRAM)).alias("k")).distinct().collect()]
    low = texts.select(F.lower(text_col).alias("low")).where("low is not null")
    keyed = low.select(F.md5("low").alias("text_key"), F.explode(F.array_distinct(F.concat(*(grams(F.col("low"), k) for k in kinds)))).alias("gram")).distinct()
    candidates = keyed.join(broadcast_if_small(known.select("name", _gram_of(F.col("name")).alias("gram"))), "gram").select("text_key", "name")
    compared = low.select(F.md5("low").alias("text_key"), "low").distinct().join(candidates, "text_key").where(F.col("low").contains(F.col("name")))
    found = compared.groupBy("text_key").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return texts.withColumn("_text_key", F.md5(F.lower(text_col))).join(found.withColumnRenamed("text_key", "_text_key"), "_text_key").drop("_text_key")


def _tiers(pt: DataFrame, llt: DataFrame) -> DataFrame:
    """Names in tiers: preferred and lower terms, each English then Spanish; of rows with one code and tier the first."""
    rows = pt.select("code", "name_en", "name_es", F.lit("PT").alias("type"), F.lit(None).cast("string").alias("pt_code"), "ord", F.lit(0).alias("first_tier"))
    lower = llt.join(pt.select("code"), "code", "left_anti").select("code", "name_en", "name_es", F.lit("LLT").alias("type"), "pt_code", "ord", F.lit(2).alias("first_tier"))
    each = F.array(*(F.struct((F.col("first_tier") + i).alias("tier"), F.col(f"name_{lang}").alias("name")) for i, lang in enumerate(("en", "es"))))
    return spread(rows.unionByName(lower), "code").select("code", F.coalesce("name_en", F.lit("")).alias("name_en"), F.coalesce("name_es", F.lit("")).alias("name_es"), "type", "pt_code", "ord", F.explode(each).alias("x")).select("*", "x.tier", ascii_fold(F.col("x.name")).alias("folded")).drop("x")


def search_terms(queries: DataFrame, pt: DataFrame, llt: DataFrame, limit: int = 15, query: str = "query") -> DataFrame:
    """TOP-01 for a table of queries: the first ``limit`` (at most 30) hits of each distinct query, as ``terminology.search`` gives them.

    Columns: query, place (from 1), code, name_en, name_es, type, pt_code, tier, ord, pt_name_en. Names and queries are folded once, and
    only the first names of each folded text and the asked prefixes of codes are ranked.
    Queries of up to GRAM folded characters take the heads of their gram's list; longer ones start from the list of the rarest of
    their grams. Digits are a prefix of a code. A query that folds to nothing is in all names. Queries under two characters or null
    find nothing.
    """
    limit = max(0, min(limit, 30))
    asked = queries.select(strip(F.col(query)).alias("query")).where(F.length("query") >= 2).distinct().withColumn("folded", ascii_fold(F.col("query")))
    digits = F.col("query").rlike(r"\A\p{Nd}+\z")
    names = _tiers(pt, llt)
    order = [F.col("tier"), F.col("ord"), F.col("code")]
    # a code stands in two tiers at most, once for each of its rows
    most = 2 * limit
    width = names.groupBy("code").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    most = max(most, int(width) * limit)
    hit = ["code", "name_en", "name_es", "type", "pt_code", "ord", "tier"]

    def heads(rows: DataFrame, *by: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")

    # of names with one folded text, which the same queries find, only the first can be among a query's hits
    in_names = settled(heads(names.where("folded is not null"), "folded"))
    postings = in_names.withColumn("gram", F.explode(F.concat(*(grams(F.col("folded"), k) for k in range(1, GRAM + 1)))))
    text = asked.where(~digits)
    short = text.where(F.length("folded").between(1, GRAM)).join(heads(postings, "gram").select("gram", *hit), F.col("folded") == F.col("gram")).select("query", *hit)
    # the rarest gram of a longer query
    pieces = text.where(F.length("folded") > GRAM).select("query", F.col("folded").alias("asked"), F.explode(grams(F.col("folded"))).alias("gram"))
    counts = postings.where(F.length("gram") == GRAM).groupBy("gram").agg(F.count("*").alias("n"))
    rarest = pieces.join(counts, "gram", "left").groupBy("query", "asked").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    long = rarest.join(postings.select("gram", "folded", *hit), "gram").where(F.col("folded").contains(F.col("asked"))).select("query", *hit)
    every = text.where("folded = ''").withColumn("all", F.lit(1)).join(heads(in_names.withColumn("all", F.lit(1)), "all").select("all", *hit), "all").select("query", *hit)
    # codes by their prefixes
    prefixes = asked.where(digits).select(F.col("query").alias("prefix")).distinct()
    coded = names.where(F.col("tier") % 2 == 0).select(*hit, F.explode(bound(F.col("code"), lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substr(c, F.lit(1), i)))).alias("prefix"))
    numbers = heads(coded.join(broadcast_if_small(prefixes), "prefix"), "prefix").select(F.col("prefix").alias("query"), *hit)
    hits = heads(short.union(long).union(every).union(numbers), "query")
    first = hits.groupBy("query", "code").agg(F.min_by(F.struct(*hit[1:]), F.struct("tier", "ord")).alias("x")).select("query", "code", "x.*")
    found = first.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("place") <= limit)
    parents = pt.groupBy(F.col("code").alias("pt_code")).agg(F.min_by(F.coalesce("name_en", F.lit("")), "ord").alias("parent"))
    return found.join(parents, "pt_code", "left").select("query", "place", "code", "name_en", "name_es", "type", "pt_code", "tier", "ord", F.when(F.col("type") == "LLT", F.coalesce("parent", F.lit(""))).alias("pt_name_en"))


def _segments(n: Column, parts: int) -> Column:
    """Starts (from 1) and sizes of the segments of a name of n characters; the last ones are the longer ones."""
    base, more = F.floor(n / parts).cast("int"), (n % parts).cast("int")
    size = lambda i: base + F.when(i >= parts - more, 1).otherwise(0)
    start = lambda i: i * base + F.greatest(i - (parts - more), F.lit(0)) + 1
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(i.alias("nth"), start(i).cast("int").alias("start"), size(i).cast("int").alias("size")))


def similar_names(queries: DataFrame, names: DataFrame, distance: int = 2, most: int = 1, query: str = "query", name: str = "name", rank: str | None = None) -> DataFrame:
    """SRC-16 with spelling: query, place, name, distance: the ``most`` nearest names at an edit distance of at most ``distance``.

    Case and outer blanks are ignored. Nearer names go first, then those of lesser ``rank`` (a column of names), then by text. Every
    name within the distance is found: of distance + 1 segments of a name one is in the query unedited, at most
    distance places from where it was; such segments of the names are joined with the query's pieces, and pairs are compared
    once each by banded edit distance. Blank queries and names find nothing.
    """
    parts = distance + 1
    low = lambda c: F.lower(strip(F.col(c)))
    asked = queries.select(F.col(query).alias("query"), low(query).alias("q")).where("q != ''").distinct()
    place = F.col(rank) if rank else F.lit(0)
    known = names.select(low(name).alias("key"), F.col(name).alias("name"), place.alias("rank")).where("key != ''").groupBy("key").agg(F.min(F.struct("rank", "name")).alias("x")).select("key", "x.*")
    cut = known.select("key", F.length("key").alias("n"), F.explode(_segments(F.length("key"), parts)).alias("s")).select("key", "n", "s.nth", F.expr("substring(key, s.start, s.size)").alias("piece"))
    sizes = F.sequence(F.greatest(F.length("q") - distance, F.lit(1)), F.length("q") + distance)
    each = asked.select("q").distinct().select("q", F.explode(sizes).alias("n")).select("q", "n", F.explode(_segments(F.col("n"), parts)).alias("s"))
    shifts = each.select("q", "n", "s.nth", "s.size", F.explode(F.sequence(F.col("s.start") - distance, F.col("s.start") + distance)).alias("start")).where("start >= 1 and start + size - 1 <= length(q)")
    pieces = shifts.select("q", "n", "nth", F.expr("substring(q, start, size)").alias("piece")).distinct()
    pairs = pieces.join(cut, ["n", "nth", "piece"]).select("q", "key").distinct().withColumn("distance", F.levenshtein("q", "key", distance)).where("distance >= 0")
    order = Window.partitionBy("q").orderBy("distance", "rank", "key")
    best = pairs.join(known, "key").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return asked.join(best, "q").select("query", "place", "name", "distance")
