"""

Entry points take a table of cases, never one case: each source gives rows of one schema (EVIDENCE), the rows are
united, and cards and prompts are made from the union. A source is a function from cases to such rows; one that
fails gives error rows and doesn't touch the others.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.functions.arrays import cleaned, combinations, term_list
from vigilake.functions.text import interaction_section, is_no_info, strip
from vigilake.operators import drugs, literature, reports
from vigilake.sources.readers import form_list

EVIDENCE = "case_id string, source string, status string, text string"
Source = Callable[[DataFrame], DataFrame]


def cases_of(forms: DataFrame) -> DataFrame:
    """FLT-13/SRC-20/ARR-05/ARR-06: requests as cases; an invalid one has an error and the others go on.

    forms: case_id, drug, drug_inn, reaction_en, reaction_es, llts_json, age, sex.
    """
    need = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) != ""
    error = F.when(~need("drug"), "no drug").when(~need("reaction_en"), "no reaction")
    others = cleaned(form_list(F.col("llts_json")))
    return forms.withColumns({"error": error, "inn": F.coalesce(F.nullif(strip(F.col("drug_inn")), F.lit("")), strip(F.col("drug"))), "terms": term_list(strip(F.col("reaction_en")), others)})


def collect_evidence(cases: DataFrame, sources: Mapping[str, Source]) -> DataFrame:
    """STM-01/STM-02: the rows of all sources for the valid cases; a source without a row for a case has nothing to say."""
    valid = cases.where("error is null")
    out = None
    for name, source in sources.items():
        try:
            rows = source(valid).select(F.col("case_id").cast("string").alias("case_id"), F.lit(name).alias("source"), "status", "text")
        except Exception as e:  # its plan can't be made: an error card for each case
            rows = valid.select(F.col("case_id").cast("string").alias("case_id"), F.lit(name).alias("source"), F.lit("error").alias("status"), F.lit(f"{type(e).__name__}: {e}"[:500]).alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else cases.sparkSession.createDataFrame([], EVIDENCE)


def case_cards(cases: DataFrame, sources: Mapping[str, Source]) -> DataFrame:
    """Entry A, steps 4 to 6."""
    return reports.cards(collect_evidence(cases, sources))


def case_events(cases: DataFrame, sources: Mapping[str, Source]) -> DataFrame:
    """SNK-03: case_id, seq, tipo, payload: the header, a card for each source, the end."""
    shown = case_cards(cases, sources)
    ids = cases.where("error is null").select(F.col("case_id").cast("string").alias("case_id"), "drug", "reaction_en")
    head = ids.select("case_id", F.lit(0).alias("seq"), F.lit("cabecera").alias("tipo"), F.to_json(F.struct("drug", "reaction_en")).alias("payload"))
    body = shown.select("case_id", (F.col("ord") + 1).alias("seq"), F.lit("seccion").alias("tipo"), F.to_json(F.struct("card_id", "title", "state", "content")).alias("payload"))
    end = ids.select("case_id", F.lit(99).alias("seq"), F.lit("fin").alias("tipo"), F.lit("{}").alias("payload"))
    return head.unionByName(body).unionByName(end)


def case_prompts(cases: DataFrame, sources: Mapping[str, Source], header: str) -> DataFrame:
    """RND-07: one prompt for each case, each source with information once."""
    found = collect_evidence(cases, sources).where((F.col("status") == "ok") & ~is_no_info(F.col("text")))
    info = cases.select(F.col("case_id").cast("string").alias("case_id"), F.concat_ws("\n", F.concat(F.lit("Fármaco: "), "drug"), F.concat(F.lit("RAM sospechada: "), "reaction_en"), F.concat(F.lit("Edad: "), "age"), F.concat(F.lit("Sexo: "), "sex")).alias("info"))
    return reports.prompt(found.join(info, "case_id"), F.col("info"), header)


def combination_cases(forms: DataFrame) -> DataFrame:
    """Entry B: forms with drugs_json (inn, name_es) as cases of at least two drugs: case_id, i, inn, name, n, error."""
    parsed = forms.withColumn("drugs", form_list(F.col("drugs_json"), "struct<inn:string,name_es:string>"))
    error = F.when(F.size("drugs") < 2, "needs two drugs")
    rows = parsed.select("case_id", error.alias("error"), F.size("drugs").alias("n"), F.posexplode_outer("drugs").alias("i", "d"))
    return rows.select("case_id", "i", F.col("d.inn").alias("inn"), F.coalesce(F.nullif(F.col("d.name_es"), F.lit("")), "d.inn").alias("name"), "n", "error")


def interaction_evidence(cases: DataFrame, sheets: DataFrame, interactions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entry B without language models: 4.5 sections with cross mentions, direct interactions, combination queries.

    cases: of combination_cases. sheets: inn, text. interactions: inn, int_pos, name, description.
    """
    valid = cases.where("error is null")
    texts = valid.join(sheets.select("inn", interaction_section(F.col("text")).alias("text")), "inn").select("case_id", "i", "inn", "name", "text")
    pairs = drugs.direct_interactions(valid.select("case_id", F.col("i").alias("pos"), "inn"), interactions)
    lists = valid.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "inn"))), lambda x: x["inn"]).alias("names"))
    queries = lists.select("case_id", F.posexplode(combinations(F.col("names"))).alias("nth", "drugs"))
    queries = queries.withColumn("label", F.array_join("drugs", " AND ")).withColumn("query", literature.combination_query(F.col("drugs"), F.array().cast("array<string>")))
    return drugs.cross_mentions(texts), pairs, queries


def interaction_events(cases: DataFrame, cards: DataFrame, sheets: DataFrame, mentions: DataFrame, known: DataFrame, literature: DataFrame, report: DataFrame) -> DataFrame:
    """SNK-04: case_id, seq, tipo, payload of a combination: header, each drug's cards, the three interaction sections, report, end.

    cases: case_id, reaction, drugs (array of inn, name). cards: as of reports.cards with drug_index, inn. sheets: case_id, i, inn, name,
    text. mentions: as of drugs.cross_mentions. known: case_id, drug1, drug2, description. literature: case_id, text. report: case_id,
    report (JSON text). Cases without rows of a section have it empty.
    """
    whole = lambda *c: reports.compact(F.struct(*c))
    event = lambda rows, seq, kind, payload: rows.select("case_id", F.lit(seq).cast("long").alias("seq") if isinstance(seq, int) else seq.cast("long").alias("seq"), F.lit(kind).alias("tipo"), payload.alias("payload"))
    listed = lambda rows, name, order, *c: cases.select("case_id").join(rows.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*c).alias("v")))), lambda x: x["v"]).alias(name)), "case_id", "left")
    section = lambda kind, title, source, content: whole(F.lit(kind).alias("id"), F.lit(title).alias("titulo"), F.lit("ok").alias("estado"), content.alias("contenido"), F.array(F.lit(source)).alias("fuentes"), F.lit(kind).alias("subtipo"))
    tagged = reports.tag_drug(cards)
    own = listed(sheets, "farmacos", ["i"], "inn", F.col("name").alias("name_es"), F.col("text").alias("texto"))
    own = own.join(listed(mentions, "menciones_cruzadas", ["i", "j"], F.col("source").alias("farmaco_origen"), F.col("mentioned").alias("farmaco_mencionado"), F.col("snippet").alias("fragmento")), "case_id")
    pairs = listed(known, "interacciones", ["drug1", "drug2"], "drug1", "drug2", "description")
    found = cases.select("case_id").join(literature.select("case_id", "text"), "case_id", "left")
    out = event(cases, 0, "cabecera_int", whole(F.col("drugs").alias("farmacos"), F.col("reaction").alias("ram")))
    out = out.unionByName(event(tagged, 1 + 100 * F.col("farmaco_idx") + F.col("ord"), "seccion_farmaco", whole(F.col("card_id").alias("id"), F.col("title").alias("titulo"), F.col("state").alias("estado"), F.col("content").alias("contenido"), "farmaco_idx", F.col("inn").alias("farmaco_inn"))))
    out = out.unionByName(event(own, 1_000_001, "seccion_interaccion", section("cima_int", "CIMA 4.5 — Interacciones", "CIMA", F.struct("farmacos", "menciones_cruzadas"))))
    out = out.unionByName(event(pairs, 1_000_002, "seccion_interaccion", section("drugbank_int", "DrugBank — Interacciones", "DrugBank", F.struct("interacciones"))))
    out = out.unionByName(event(found, 1_000_003, "seccion_interaccion", section("pubmed_int", "PubMed — Combinaciones de Fármacos", "PubMed", F.struct(F.col("text").alias("texto")))))
    out = out.unionByName(event(report, 1_000_004, "informe_int", whole(F.col("report").alias("contenido"))))
    return out.unionByName(event(cases, 1_000_005, "fin_int", whole(F.lit("Análisis de interacciones completado").alias("mensaje"))))
