
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.operators import article_search
from vigilake.session import settled

#: Sections, the phrases that their filters look for, and their titles, in order of declaration.
FILTERS = (
    ("casos_reportados", ("case", "case report", "case series"), "CASOS REPORTADOS"),
    ("factores_riesgo", ("risk", "susceptibility", "predisposing", "risk factor"), "FACTORES DE RIESGO"),
    ("recomendaciones", ("management", "prevention", "monitoring", "guideline"), "RECOMENDACIONES Y MANEJO"),
)
#: Sections with their filters as written in a query: phrases of several words in quotes.
SECTIONS = tuple((k, "(" + " OR ".join(f'"{x}"' if " " in x else x for x in some) + ")", title) for k, some, title in FILTERS)
GENERAL = ("asociacion_general", "", "ASOCIACIÓN GENERAL")
#: Articles that a term's search in a section gives, and that the general search gives.
FOUND, FOUND_GENERAL = 2, 3
NO_RESULT, NOTHING, NOTHING_GENERAL = "Sin resultados para esta búsqueda.", "Sin resultados en PubMed.", "Sin resultados."


def quoted(terms: Column) -> Column:
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def term_query(drug: Column, term: Column, section_filter: Column) -> Column:
    """STR-11: drug AND "term" AND filter."""
    return F.concat(drug, F.lit(' AND "'), term, F.lit('" AND '), section_filter)


def combination_query(drugs: Column, terms: Column) -> Column:
    """STR-11/12: all drugs of a combination with any of the terms."""
    names = F.array_join(F.transform(drugs, lambda d: F.concat(F.lit('"'), d, F.lit('"'))), " AND ")
    return F.when(F.size(terms) > 0, F.concat(F.lit("("), names, F.lit(") AND ("), quoted(terms), F.lit(")"))).otherwise(names)


def section_totals(hits: DataFrame) -> DataFrame:
    """AGG-02: n_found, the sum over terms (an article that two terms find counts twice). hits: case_id, section, term_ord, total."""
    return hits.groupBy("case_id", "section").agg(F.sum("total").alias("n_found"))


def first_seen(hits: DataFrame) -> DataFrame:
    """AGG-03: each article once with its first place and the terms that found it, in term order.

    hits: case_id, section, term_ord, term, id_ord, pmid.
    """
    grouped = hits.groupBy("case_id", "section", "pmid").agg(F.min(F.struct("term_ord", "id_ord")).alias("place"), F.sort_array(F.collect_set(F.struct("term_ord", "term"))).alias("origins"))
    order = Window.partitionBy("case_id", "section").orderBy("place")
    return grouped.select("case_id", "section", "pmid", F.row_number().over(order).alias("place"), F.array_distinct(F.transform("origins", lambda x: x["term"])).alias("origins"))


def slots(sections: DataFrame, by: str = "case_id") -> DataFrame:
    """TOP-02: slots, 1 for a section with ids; each empty section gives one to the richest sections with two or more.

    sections: by, section, ord (declaration), n_ids, n_found.
    """
    whole = Window.partitionBy(by)
    rich = Window.partitionBy(by).orderBy((F.col("n_ids") >= 2).desc(), F.col("n_found").desc(), "ord")
    free = F.sum((F.col("n_ids") == 0).cast("int")).over(whole)
    extra = (F.col("n_ids") >= 2) & (F.row_number().over(rich) <= free)
    return sections.withColumn("slots", F.when(F.col("n_ids") == 0, 0).when(extra, 2).otherwise(1))


def chosen(articles: DataFrame, allocation: DataFrame) -> DataFrame:
    """TOP-03: the first articles of each section, as many as it has slots."""
    return articles.join(allocation.select("case_id", "section", "slots"), ["case_id", "section"]).where("place <= slots")


def enrich(requested: DataFrame, fetched: DataFrame) -> DataFrame:
    """JOIN-13: requested ids with title and abstract, blank where nothing came."""
    out = requested.join(fetched.dropDuplicates(["pmid"]), "pmid", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "abstract")})


def distinct_ids(articles: DataFrame) -> DataFrame:
    """AGG-11."""
    return articles.select("case_id", "pmid").distinct()


def section_text(articles: DataFrame) -> DataFrame:
    """RND-03: the articles of each section as one text. articles: case_id, section, place, pmid, title, abstract, origins."""
    origin = F.when(F.size("origins") > 0, F.concat(F.lit("\nOrigen: "), F.array_join("origins", ", "))).otherwise("")
    one = F.struct("place", F.concat(F.lit("PMID: "), F.col("pmid"), F.lit("\nTitle: "), F.col("title"), F.lit("\nAbstract: "), F.col("abstract"), origin).alias("t"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("pmid"), F.lit("/")).alias("url"))
    rows = articles.groupBy("case_id", "section").agg(F.sort_array(F.collect_list(one)).alias("x"))
    return rows.select("case_id", "section", F.array_join(F.transform("x", lambda a: a["t"]), "\n\n").alias("text"), F.array_join(F.transform("x", lambda a: a["url"]), " | ").alias("urls"))


def serialise(sections: DataFrame) -> DataFrame:
    """RND-03: case_id, text, search_details: all sections of a case in fixed order as one text.

    sections: case_id, section, n_found, query, text, urls, details (null or blank where there is none). A case whose sections are
    all unknown has a fixed sentence.
    """
    names = sections.sparkSession.createDataFrame([(k, label, i) for i, (k, _, label) in enumerate((*SECTIONS, GENERAL))], "section string, title string, nth int")
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    head = F.concat(F.lit("─── "), F.col("title"), F.lit(" ("), F.coalesce("n_found", F.lit(0)).cast("string"), F.lit(" artículos encontrados) ───"))
    part = F.concat_ws("\n\n", head, F.concat(F.lit("Query: "), some("query")), F.coalesce("text", F.lit(NO_RESULT)), F.concat(F.lit("URLs: "), some("urls")))
    rows = sections.join(F.broadcast(names), "section", "left").groupBy("case_id").agg(F.sort_array(F.collect_list(F.when(F.col("nth").isNotNull(), F.struct("nth", part.alias("part"), some("details").alias("details"))))).alias("x"))
    first = F.get(F.filter("x", lambda x: x["details"].isNotNull()), F.lit(0))["details"]
    return rows.select("case_id", F.when(F.size("x") > 0, F.array_join(F.transform("x", lambda x: x["part"]), "\n\n")).otherwise(NOTHING).alias("text"), first.alias("search_details"))


def section_queries(cases: DataFrame) -> DataFrame:
    """STR-11: one row for each case, section and term: case_id, section, term_ord, term, query, groups (the query as ``article_search`` takes it).

    cases: case_id, inn, terms.
    """
    every = F.array(*(F.struct(F.lit(k).alias("section"), F.lit(f).alias("filter"), F.array(*map(F.lit, some)).alias("phrases")) for (k, f, _), (_, some, _) in zip(SECTIONS, FILTERS, strict=True)))
    rows = cases.select("case_id", "inn", F.explode(every).alias("s"), "terms").select("case_id", "inn", "s.*", F.posexplode("terms").alias("term_ord", "term"))
    groups = F.array(F.array("inn"), F.array("term"), F.col("phrases"))
    return rows.select("case_id", "section", "term_ord", "term", term_query(F.col("inn"), F.col("term"), F.col("filter")).alias("query"), groups.alias("groups"))


def section_query(drug: Column, terms: Column, section_filter: Column) -> Column:
    """STR-11: the query that a section shows: the drug, any of the terms, and the filter."""
    return F.concat(drug, F.lit(" AND ("), quoted(terms), F.lit(") AND "), section_filter)


def sections_of_cases(cases: DataFrame, articles: DataFrame, positions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC-09 to RND-03 for a table of cases: sections (case_id, section, n_found, n_shown, query, text, urls, details) and the articles shown.

    cases: case_id, inn, terms (the preferred one first). articles: pmid, title, abstract. Each term is searched in each section; a
    case for which no section shows an article has one general section in addition, searched for the drug and its first term.
    """
    known = articles.where("pmid is not null").select(F.col("pmid").cast("string").alias("pmid"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "abstract")))
    texts = known.select("pmid", F.concat_ws("\n", "title", "abstract").alias("text"))
    asked = settled(section_queries(cases).select("*", F.struct("case_id", "section", "term_ord").alias("query_id")))
    found, totals = article_search.search(texts, asked, FOUND, positions=positions)
    each = totals.select("query_id.*", "total").join(asked.select("case_id", "section", "term_ord", "term"), ["case_id", "section", "term_ord"])
    hits = found.select("query_id.*", F.col("place").alias("id_ord"), "pmid").join(asked.select("case_id", "section", "term_ord", "term"), ["case_id", "section", "term_ord"])
    seen = first_seen(hits)
    order = F.create_map(*(F.lit(x) for i, (k, *_) in enumerate(SECTIONS) for x in (k, i)))
    n_ids = seen.groupBy("case_id", "section").agg(F.count("*").alias("n_ids"))
    detail = F.concat("term", F.lit(": "), F.col("total").cast("string"))
    details = each.groupBy("case_id", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("term_ord", detail.alias("d")))), lambda x: x["d"]), "; ").alias("details"))
    known_sections = section_totals(each).join(n_ids, ["case_id", "section"], "left").na.fill(0, ["n_ids"]).join(details, ["case_id", "section"]).withColumn("ord", F.try_element_at(order, F.col("section")))
    allocation = slots(known_sections)
    shown = enrich(chosen(seen, allocation), known)
    # the general search of cases that show nothing
    bare = cases.join(shown.select("case_id").distinct(), "case_id", "left_anti").where(F.size("terms") > 0).select("case_id", "inn", F.get("terms", F.lit(0)).alias("term"))
    general = bare.select(F.col("case_id").alias("query_id"), F.array(F.array("inn"), F.array("term")).alias("groups"))
    some, all_of = article_search.search(texts, general, FOUND_GENERAL, positions=positions)
    more = enrich(some.select(F.col("query_id").alias("case_id"), F.lit(GENERAL[0]).alias("section"), "place", "pmid").withColumn("origins", F.array().cast("array<string>")), known)
    every = settled(shown.select("case_id", "section", "place", "pmid", "title", "abstract", "origins").unionByName(more.select("case_id", "section", "place", "pmid", "title", "abstract", "origins")))
    filters = F.create_map(*(F.lit(x) for k, f, _ in SECTIONS for x in (k, f)))
    heads = allocation.join(cases.select("case_id", "inn", "terms"), "case_id").select("case_id", "section", "n_found", section_query(F.col("inn"), F.col("terms"), F.try_element_at(filters, F.col("section"))).alias("query"), "details")
    heads = heads.unionByName(bare.join(all_of.select(F.col("query_id").alias("case_id"), F.col("total").alias("n_found")), "case_id").select("case_id", F.lit(GENERAL[0]).alias("section"), "n_found", F.concat("inn", F.lit(' AND "'), "term", F.lit('"')).alias("query"), F.lit(None).cast("string").alias("details")))
    out = heads.join(section_text(every), ["case_id", "section"], "left").join(every.groupBy("case_id", "section").agg(F.count("*").alias("n_shown")), ["case_id", "section"], "left").na.fill(0, ["n_shown"])
    return out.select("case_id", "section", "n_found", "n_shown", "query", F.coalesce("text", F.when(F.col("section") == GENERAL[0], NOTHING_GENERAL).otherwise(NO_RESULT)).alias("text"), "urls", "details"), every
