
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.functions.text import clean, contains_any, find_date, has_marks, last_section, match_fold, matching_terms, mentions, strip, subsections
from vigilake.operators import name_search
from vigilake.operators.judge import Judge, gated, never
from vigilake.operators.name_search import SHIPPED
from vigilake.operators.terms import pattern_hit, patterns_of
from vigilake.session import settled, spread


def extract(texts: DataFrame) -> DataFrame:
    """Rows as of SRC-07 from filename, source, text (null: it could not be read)."""
    section = last_section(F.coalesce("text", F.lit("")))
    out = texts.withColumn("found", section)
    status = F.when(F.col("text").isNull(), "read_error").when(F.col("found").isNotNull(), "ok").otherwise("not_found")
    body = F.when(F.col("found").isNotNull(), clean(F.col("found"))).otherwise("")
    date = F.when(F.col("text").isNull(), "Error").otherwise(find_date(F.col("text"), F.col("filename")))
    return out.select("filename", "source", date.alias("date"), body.alias("section4"), status.alias("status")).withColumn("chars", F.length("section4"))


def evidence(docs: DataFrame, drug: str, terms: Sequence[str], judge: Judge = never, judged: bool = True) -> DataFrame:
    """One row for each document that mentions the drug: filename, date, source, with_reaction, n_fragments, fragments, terms.

    A sub-section that mentions the drug shows the reaction if one of the terms occurs, or else if the judge
    says so; a document with any such sub-section shows only those; the others show their drug-only ones, or
    none. docs: filename, date, source, section4. An undated document has one date, "sin fecha".
    """
    named = docs.where(mentions(F.col("section4"), drug)).withColumn("date", F.coalesce(F.nullif("date", F.lit("")), F.lit("sin fecha")))
    parts = named.select("filename", "date", "source", F.posexplode(subsections(F.col("section4"))).alias("pos", "part")).where(mentions(F.col("part"), drug))
    direct = parts.withColumn("direct", contains_any(F.col("part"), terms)).withColumn("prompt", F.concat(F.lit(f"{drug}\n" + "\n".join(terms) + "\n"), F.col("part")))
    seen = gated(direct, "direct", "prompt", judge, judged).drop("prompt", "direct")
    seen = seen.withColumn("terms", F.when(F.col("present"), matching_terms(F.col("part"), terms)).otherwise(F.array().cast("array<string>")))
    keys = ["filename", "date", "source"]
    with_parts = seen.groupBy(*keys).agg(F.bool_or("present").alias("with_reaction"), F.sort_array(F.collect_list(F.struct("pos", "part", "terms", "present"))).alias("all"))
    fragments = F.transform(F.filter("all", lambda x: x["present"] == F.col("with_reaction")), lambda x: F.struct(x["part"].alias("texto"), x["terms"].alias("terminos_match")))
    own = with_parts.select(*keys, "with_reaction", fragments.alias("fragments"))
    out = named.select(*keys).distinct().join(own, keys, "left")
    empty = F.expr("cast(array() as array<struct<texto:string,terminos_match:array<string>>>)")
    out = out.select(*keys, F.coalesce("with_reaction", F.lit(False)).alias("with_reaction"), F.coalesce("fragments", empty).alias("fragments"))
    return out.withColumn("n_fragments", F.size("fragments")).withColumn("terms", F.array_join(F.array_distinct(F.flatten(F.transform("fragments", lambda x: x["terminos_match"]))), ", "))


def evidence_of_cases(docs: DataFrame, cases: DataFrame, judge: Judge = never, judged: bool = True, shipped: int = SHIPPED) -> DataFrame:
    """``evidence`` for a table of cases with one scan of docs: case_id and the columns of ``evidence``, for each case and document that mentions its drug.

    cases: case_id, inn, terms. The drugs of all cases are looked for at once (``name_search``), in whole texts and in their sub-sections; only
    sub-sections that mention a drug meet the cases of that drug, and only those without a direct match are judged. Cases with a
    null or blank drug have no evidence; cases that share a case_id are one case with the terms of all of them in no fixed order.
    Documents are told apart by filename, date and source.
    """
    keys = ["filename", "date", "source"]
    dated = docs.where("section4 is not null").select("filename", F.coalesce(F.nullif("date", F.lit("")), F.lit("sin fecha")).alias("date"), "source", "section4")
    # the whole text is part -1; it may have a mention that no sub-section has
    parts = F.concat(F.array("section4"), subsections(F.col("section4")))
    rows = dated.select(*keys, F.posexplode(parts).alias("pos", "part"))
    asked = cases.where(F.coalesce(strip(F.col("inn")), F.lit("")) != "").select("case_id", F.col("inn").alias("drug"), F.lower("inn").alias("name"), F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    named = name_search.names_in_texts(rows, asked, "part", "name", shipped).withColumn("pos", F.col("pos") - 1)
    # of whole texts only the names are needed; the sub-sections, each once with its names, are dealt to all tasks
    found = settled(spread(named.select(*keys, "pos", F.when(F.col("pos") >= 0, F.col("part")).alias("part"), "names"), *keys, "pos"))
    real = F.filter("terms", lambda t: F.coalesce(strip(t), F.lit("")) != "")
    known = settled(asked.withColumn("patterns", F.transform(real, patterns_of)))
    # each sub-section is folded once, whatever cases it meets
    folded = found.where("pos >= 0").select(*keys, "pos", "part", "names", match_fold(F.col("part")).alias("folded"), has_marks(F.col("part")).alias("marked"))
    folded = folded.select(*keys, "pos", "part", "folded", "marked", F.explode("names").alias("name"))
    met = folded.join(known, "name")
    hits = F.transform(F.filter("patterns", lambda p: F.coalesce(pattern_hit(F.col("part"), F.col("folded"), p, F.col("marked")), F.lit(False))), lambda p: p["term"])
    prompt = F.concat("drug", F.lit("\n"), F.array_join("terms", "\n"), F.lit("\n"), "part")
    direct = met.withColumn("matched", hits).withColumn("direct", F.size("matched") > 0).withColumn("prompt", prompt)
    seen = gated(direct, "direct", "prompt", judge, judged)
    shown = F.when(F.col("present"), F.col("matched")).otherwise(F.array().cast("array<string>"))
    grouped = seen.groupBy("case_id", *keys).agg(F.bool_or("present").alias("with_reaction"), F.sort_array(F.collect_set(F.struct("pos", "part", shown.alias("terms"), "present"))).alias("all"))
    fragments = F.transform(F.filter("all", lambda x: x["present"] == F.col("with_reaction")), lambda x: F.struct(x["part"].alias("texto"), x["terms"].alias("terminos_match")))
    own = grouped.select("case_id", *keys, "with_reaction", fragments.alias("fragments"))
    every = found.where("pos = -1").select(*keys, F.explode("names").alias("name")).join(asked.select("case_id", "name"), "name").select("case_id", *keys).distinct()
    same = [every[c].eqNullSafe(own[c]) for c in ("case_id", *keys)]
    empty = F.expr("cast(array() as array<struct<texto:string,terminos_match:array<string>>>)")
    out = every.join(own, same, "left").select(*(every[c] for c in ("case_id", *keys)), F.coalesce("with_reaction", F.lit(False)).alias("with_reaction"), F.coalesce("fragments", empty).alias("fragments"))
    return out.withColumn("n_fragments", F.size("fragments")).withColumn("terms", F.array_join(F.array_distinct(F.flatten(F.transform("fragments", lambda x: x["terminos_match"]))), ", "))


def counts(found: DataFrame) -> DataFrame:
    """AGG-09: documents with the reaction and with the drug only."""
    return found.agg(F.count_if("with_reaction").alias("n_with"), F.count_if(~F.col("with_reaction")).alias("n_without"))


def block_text(found: DataFrame) -> DataFrame:
    """RND-06: a document's text block; joined by SEPARATOR, documents with the reaction first."""
    body = F.array_join(F.transform("fragments", lambda x: x["texto"]), "\n\n")
    head = F.concat(F.lit("── "), F.upper("source"), F.lit(" | "), F.col("date"), F.lit(" | "), F.col("filename"), F.lit("\n\n"))
    return found.withColumn("block", F.concat(head, body))


SEPARATOR = "\n\n" + "─" * 60 + "\n\n"
