"""

A short list of terms is compiled into expressions, so matching is a map without a shuffle. A long or growing list is a
table: texts are cut into folded words, a term's first word finds candidates by a hash join, and the exact
predicate decides. Both give the same rows, repeated and null ids included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.text import S, W, _real, has_marks, match_fold, matching_terms, strip
from vigilake.session import broadcast_if_small

#: Up to so many terms are compiled; each is looked for in each text, which is slower than candidates from there on.
COMPILED = 24


def match_terms(docs: DataFrame, terms: Sequence[str] | DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, term for each distinct pair of a document and a term that it mentions (FLT-02)."""
    if not isinstance(terms, DataFrame):
        terms = list(dict.fromkeys(_real(terms)))
        if len(terms) <= COMPILED:
            return docs.select(id_col, F.explode(matching_terms(F.col(text_col), terms)).alias("term"))
        terms = docs.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    return _joined(docs, terms, id_col, text_col)


def _quoted(term: Column) -> Column:
    return F.regexp_replace(strip(term), r"([^\p{L}\p{N}_\s])", r"\\$1")


def _patterns(term: Column, folded: Column) -> tuple[Column, Column]:
    """Regular expressions of a term for the text as it is, blanks flexible, and for the folded text, blanks as they are."""
    whole = lambda x, flags: F.concat(F.lit(f"{flags}(?<!{W})"), x, F.lit(f"(?!{W})"))
    flexible = F.regexp_replace(_quoted(term), rf"{S}+", S.replace("\\", "\\\\") + "+")
    return whole(flexible, "(?iu)"), whole(_quoted(folded), "")


def reaction_hit(text: Column, term: Column) -> Column:
    """FLT-02 for a term of each row; null where one of both is null."""
    exact, loose = _patterns(term, match_fold(strip(term)))
    return F.call_function("rlike", text, exact) | F.call_function("rlike", match_fold(text), loose)


def patterns_of(term: Column) -> Column:
    """What ``pattern_hit`` needs of a term: its two regular expressions, made once for the term, and what a text must have before they are tried."""
    key = match_fold(strip(term))
    exact, loose = _patterns(term, key)
    words = F.regexp_extract_all(key, F.lit(rf"{W}+"), F.lit(0))
    plain = (F.size(words) > 0) & ~key.rlike(r"[^\x00-\x7F]")
    return F.struct(term.alias("term"), exact.alias("exact"), loose.alias("loose"), key.alias("key"), F.when(plain, words).alias("words"), (F.size(F.split(strip(term), rf"{S}+")) == 1).alias("one"))


def pattern_hit(text: Column, folded: Column, pattern: Column, marked: Column | None = None) -> Column:
    """FLT-02 for a row's text, its match_fold() and a row of patterns_of; marked: whether the text has marks of its own (``has_marks``).

    Substring tests go before the regular expressions, as in ``text.term_hit``.
    """
    loose = folded.contains(pattern["key"]) & F.call_function("rlike", folded, pattern["loose"])
    may = F.forall(pattern["words"], lambda x: folded.contains(x)) & (~pattern["one"] | (has_marks(text) if marked is None else marked))
    return loose | (F.coalesce(may, F.lit(True)) & F.call_function("rlike", text, pattern["exact"]))


def _joined(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    folded = match_fold(strip(F.col("term")))
    # marks end a word in the text as it is, but not without them: both first words lead to candidates
    first = F.explode(F.array_distinct(F.array(*(F.regexp_extract(x, rf"({W}+)", 1) for x in (folded, match_fold(F.col("term"), marks=True))))))
    exact, loose = _patterns(F.col("term"), folded)
    keyed = terms.where(F.col("term").isNotNull() & ~F.col("term").rlike(rf"\A{S}*\z")).select("term", first.alias("word"), exact.alias("exact"), loose.alias("loose")).distinct()
    # rows are known by id and text, so that null and repeated ids give what they give without a join
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.md5(F.col(text_col)).alias("md5")).where("text is not null")
    cut = lambda x: F.split(x, r"[^\p{L}\p{N}_]+")
    marked = F.when(F.col("text").rlike(r"[^\x00-\x7F]") & F.col("text").rlike(r"\p{Mn}"), cut(match_fold(F.col("text"), marks=True))).otherwise(F.array().cast("array<string>"))
    words = own.select("id", "md5", F.explode(F.array_union(cut(match_fold(F.col("text"))), marked)).alias("word"))
    candidates = words.join(broadcast_if_small(keyed.where("word != ''")), "word").select("id", "md5", "term", "exact", "loose")
    # a term without a word character has no first word; texts that have any of them as it is written lead to it
    signs = keyed.where("word = ''").select("term", "exact", "loose").distinct()
    if signs.limit(1).count():
        bare = F.regexp_replace("text", rf"[\p{{L}}\p{{N}}_]+|{S}+", " ")
        runs = own.select("id", "md5", F.explode(F.array_distinct(F.split(F.trim(bare), " +"))).alias("run")).where("run != ''")
        start = signs.withColumn("sign", F.substring(strip(F.col("term")), 1, 1))
        found = runs.select("id", "md5", F.explode(F.array_distinct(F.split("run", ""))).alias("sign")).distinct().join(broadcast_if_small(start), "sign").select("id", "md5", "term", "exact", "loose")
        candidates = candidates.unionByName(found)
    candidates = candidates.distinct().withColumnsRenamed({"id": "cid", "md5": "cmd5"})
    known = own.withColumn("folded", match_fold(F.col("text")))
    hit = F.expr("text rlike exact") | F.expr("folded rlike loose")
    return candidates.join(known, F.col("cid").eqNullSafe(F.col("id")) & (F.col("cmd5") == F.col("md5"))).where(hit).select(F.col("id").alias(id_col), "term")


def term_counts(pairs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """term, n_docs."""
    return pairs.groupBy("term").agg(F.countDistinct(id_col).alias("n_docs"))
