
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.json import compact, or_unavailable, parse_cascade
from vigilake.functions.text import NO_DATASHEET, NO_MINUTES, bound, or_canned, strip
from vigilake.session import broadcast_if_small


def report_counts(reports: DataFrame, terms: DataFrame) -> DataFrame:
    """AGG-01/FLT-09/FLT-10: for each drug and question, the preferred term's cases, those of other terms and both sums.

    reports: case_id, drug, term. terms: question, pt, term (term = pt for the preferred one).
    total_combined counts a case once for each term, as the source does; n_cases counts it once.
    """
    asked = terms.select("question", F.lower("term").alias("key"), (F.lower("term") == F.lower("pt")).alias("is_pt")).distinct()
    hits = reports.withColumn("key", F.lower("term")).drop("term").join(broadcast_if_small(asked), "key")
    # distinct rows first, then the terms of each case: both counts come from one row a case
    cases = hits.groupBy("drug", "question", "case_id").agg(F.collect_set(F.struct("is_pt", "key")).alias("terms"))
    each = cases.select("drug", "question", "case_id", F.posexplode("terms").alias("nth", "x")).groupBy("drug", "question", "x").agg(F.count("case_id").alias("n"), F.count_if(F.col("nth") == 0).alias("once"))
    line = F.struct(F.col("x.key").alias("key"), "n")
    out = each.groupBy("drug", "question").agg(F.coalesce(F.sum(F.when(F.col("x.is_pt"), F.col("n"))), F.lit(0)).alias("total_pt"), F.sum("n").alias("total_combined"), F.sort_array(F.collect_list(F.when(~F.col("x.is_pt"), line))).alias("lines"), F.sum("once").alias("n_cases"))
    written = F.transform("lines", lambda x: F.concat(F.lit("  '"), x["key"], F.lit("': "), x["n"].cast("string"), F.lit(" casos")))
    return out.withColumn("lines", F.array_join(written, "\n"))


def report_text(pt: Column, total_pt: Column, lines: Column, total: Column) -> Column:
    """RND-02."""
    head = F.concat(F.lit("PT '"), pt, F.lit("': "), total_pt.cast("string"), F.lit(" casos"))
    more = F.when(F.coalesce(lines, F.lit("")) != "", F.concat(F.lit("LLTs (sinónimos MedDRA):\n"), lines))
    return F.concat_ws("\n", head, more, F.concat(F.lit("Total combinado (PT + LLTs): "), total.cast("string"), F.lit(" casos")))


#: Sources with their cards and titles (RND-05), in the order of prompts (RND-07).
SOURCES = (
    ("CIMA", "cima_raw", "CIMA - Base de Datos AEMPS", "CIMA — Ficha Técnica AEMPS"),
    ("FDA FAERS", "fda_raw", "FDA FAERS - Notificaciones", "FDA FAERS — Notificaciones espontáneas"),
    ("PubMed", "pubmed_raw", "PubMed - Literatura Cientifica", "PubMed — Literatura científica"),
    ("PathwayCommons", "pathway_commons_raw", "Pathway Commons - Interacciones gen-fármaco", "Pathway Commons — Interacciones gen-fármaco"),
    ("PharmGKB", "pharmgkb_raw", "PharmGKB+CPIC - Farmacogenetica", "PharmGKB+CPIC — Farmacogenética"),
    ("DrugBank", "drugbank_raw", "DrugBank - Perfiles Farmacologicos", "DrugBank — Perfil farmacológico"),
    ("PRAC/EMA", "prac_raw", "PRAC/EMA - Actas de Señales", "PRAC/EMA — Actas de señales"),
)


def source_table(spark) -> DataFrame:
    """source, card_id, title, label, ord."""
    return spark.createDataFrame([(*x, i) for i, x in enumerate(SOURCES)], "source string, card_id string, title string, label string, ord int")


def card_fields(**columns: Column) -> Column:
    """FLT-18: more fields of a card's content, by the names that the reader of the card knows (ft_url, fda_refs, prac_docs ...)."""
    return compact(F.struct(*(c.alias(k) for k, c in columns.items())))


def minutes_docs(refs: Column) -> Column:
    """FLT-18: references to minutes (source, date, filename, fragments, found) as a card's prac_docs."""
    blank = lambda x: F.coalesce(x, F.lit(""))
    return F.transform(refs, lambda r: F.struct(blank(r["source"]).alias("source"), blank(r["date"]).alias("date"), blank(r["filename"]).alias("filename"), r["fragments"].alias("fragmentos"), F.coalesce(r["found"], F.lit(False)).alias("ram_encontrada")))


def cards(evidence: DataFrame) -> DataFrame:
    """RND-05/STM-01/STM-02/JOIN-16: one card for each case and known source; failed sources are error cards.

    evidence: case_id, source, status (ok, error, timeout), text, and perhaps fields: a JSON object of card_fields, which a
    sound card's content has besides its text.
    """
    own = evidence.join(F.broadcast(source_table(evidence.sparkSession)), "source")
    message = F.when(F.col("status") == "timeout", F.lit("Sin respuesta (timeout)")).when(F.col("status") == "error", F.concat(F.lit("Error: "), F.coalesce("text", F.lit("")))).otherwise(or_unavailable(F.col("text")))
    state = F.when(F.col("status") == "ok", "ok").otherwise("error")
    content = compact(F.struct(message.alias("texto"), F.lit(None).cast("string").alias("contradiccion")))
    if "fields" in evidence.columns:
        more = (F.col("status") == "ok") & F.col("fields").isNotNull() & (F.col("fields") != "{}")
        content = F.when(more, F.concat(F.rtrim(content, F.lit("}")), F.lit(","), F.substr("fields", F.lit(2)))).otherwise(content)
    return own.select("case_id", "card_id", "title", state.alias("state"), content.alias("content"), "source", "ord")


def tag_drug(events: DataFrame, index: str = "drug_index") -> DataFrame:
    """STM-10: card events of a combination with the drug's number."""
    return events.withColumn("tipo", F.lit("seccion_farmaco")).withColumn("farmaco_idx", F.col(index))


def found_state(text: Column) -> Column:
    """FLT-16: whether the datasheet names the reaction. Texts never begin with the first sentence, so "si" isn't reached in practice."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.startswith("sí aparece"), "si").when(low.contains("no aparece"), "no").otherwise("desconocido")


def prompt(evidence: DataFrame, case_lines: Column, header: str) -> DataFrame:
    """RND-07: one text for each case: header, case, then each source with evidence once, in fixed order.

    evidence: case_id, source, text and the columns of case_lines.
    """
    own = evidence.where(F.coalesce(F.trim("text"), F.lit("")) != "").join(F.broadcast(source_table(evidence.sparkSession)), "source")
    block = F.struct("ord", F.concat(F.lit("--- "), F.col("label"), F.lit(" ---\n"), F.col("text")).alias("b"))
    return own.groupBy("case_id").agg(F.concat_ws("\n\n", F.lit(header), F.min(case_lines), F.array_join(F.transform(F.sort_array(F.collect_list(block)), lambda x: x["b"]), "\n\n")).alias("prompt"))


#: Sources in the order of report prompts, with their labels (RND-08).
REPORT_SOURCES = (
    ("DrugBank", "DrugBank (mecanismo, dianas, CYP, toxicidad)"),
    ("PharmGKB", "PharmGKB + CPIC (farmacogenetica)"),
    ("PathwayCommons", "Pathway Commons (interacciones gen-farmaco, pathways moleculares)"),
    ("PubMed", "PubMed (literatura: casos, factores riesgo, recomendaciones)"),
    ("FDA FAERS", "FDA FAERS / openFDA (notificaciones espontaneas)"),
    ("CIMA", "CIMA / AEMPS (ficha tecnica espanola)"),
    ("PRAC/EMA", "PRAC / EMA (actas de senales regulatorias)"),
)


#: Labels of a report prompt's head, each before a column of the case, with what stands for a missing one.
REPORT_HEAD = (
    ("Farmaco: ", "drug", ""),
    ("\nRAM evaluada: ", "reaction", ""),
    ("\nSexo: ", "sex", ""),
    (" | Edad: ", "age", ""),
    (" | Etnia: ", "ethnicity", ""),
    ("\nRAM en ficha tecnica (validacion previa): ", "found", "desconocido"),
    ("\nURL Ficha Tecnica: ", "ft_url", ""),
)


def report_prompt(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """RND-08/FLT-15: case_id, prompt: the case, then every source once in fixed order, those without information by fixed sentences.

    cases: case_id, drug, reaction, sex, age, ethnicity, found, ft_url. evidence: case_id, source, text (one row for each source).
    """
    texts = evidence.groupBy("case_id").agg(*(F.max(F.when(F.col("source") == k, F.col("text"))).alias(f"t{i}") for i, (k, _) in enumerate(REPORT_SOURCES)))
    own = cases.join(texts, "case_id", "left")
    head = F.concat(*(x for label, c, missing in REPORT_HEAD for x in (F.lit(label), F.coalesce(F.col(c), F.lit(missing)))))
    canned = {"CIMA": NO_DATASHEET, "PRAC/EMA": NO_MINUTES}
    blocks = []
    for i, (source, label) in enumerate(REPORT_SOURCES):
        text = or_unavailable(F.col(f"t{i}"))
        text = or_canned(text, canned[source], F.col("drug"), F.col("reaction")) if source in canned else text
        blocks.append(F.concat(F.lit(f"--- {label} ---\n"), text))
    return own.select("case_id", F.concat_ws("\n\n", head, *blocks).alias("prompt"))


#: Wording of the prompt for a combination (RND-10).
ALERT = ("ALERTA: ", " menciona a ", ' en sección 4.5: "', '"\n')
SHEET = ("\n[", " — sección 4.5]:\n", "\n")
NO_SHEET, NO_SHEETS = "Sin datos", "Sin datos disponibles"
COMBINATION = (
    "Fármacos en combinación: ",
    "\nRAM evaluada: ",
    "\n\n--- CIMA sección 4.5 (interacciones en ficha técnica) ---\n",
    "\n\n--- DrugBank (interacciones entre fármacos) ---\n",
    "\n\n--- PubMed (literatura sobre esta combinación + RAM) ---\n",
)


def interaction_prompt(cases: DataFrame, sheets: DataFrame, mentions: DataFrame, known: DataFrame, literature: DataFrame) -> DataFrame:
    """RND-10: case_id, prompt of a combination: alerts of cross mentions, each drug's section 4.5, interactions, literature.

    cases: case_id, reaction, names (array). sheets: case_id, i, name, text (null: none). mentions: case_id, i, j, source, mentioned,
    snippet. known, literature: case_id, text.
    """
    alert = F.concat(F.lit(ALERT[0]), "source", F.lit(ALERT[1]), "mentioned", F.lit(ALERT[2]), "snippet", F.lit(ALERT[3]))
    joined = lambda rows, order, line, name: rows.groupBy("case_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), "").alias(name))
    block = F.concat(F.lit(SHEET[0]), "name", F.lit(SHEET[1]), F.coalesce("text", F.lit(NO_SHEET)), F.lit(SHEET[2]))
    own = cases.join(joined(mentions, ["i", "j"], alert, "alerts"), "case_id", "left").join(joined(sheets, ["i"], block, "blocks"), "case_id", "left")
    own = own.join(known.select("case_id", F.col("text").alias("known")), "case_id", "left").join(literature.select("case_id", F.col("text").alias("literature")), "case_id", "left")
    blank = F.lit("")
    said = strip(F.concat(F.coalesce("alerts", blank), F.coalesce("blocks", blank)))
    parts = F.array_join("names", " + "), F.coalesce("reaction", blank), F.when(said == "", NO_SHEETS).otherwise(said), or_unavailable(F.col("known")), or_unavailable(F.col("literature"))
    return own.select("case_id", F.concat(*(x for label, part in zip(COMBINATION, parts, strict=True) for x in (F.lit(label), part))).alias("prompt"))


#: Dimensions of a report with titles and sources (RND-09).
DIMENSIONS = {
    "mecanistica": ("1. Dimension Mecanistica", ("DrugBank", "PharmGKB", "CPIC", "PathwayCommons", "PubMed")),
    "clinica": ("2. Dimension Clinica", ("PubMed", "FDA FAERS", "CIMA", "PharmGKB")),
    "regulatoria": ("3. Dimension Regulatoria", ("PRAC/EMA", "FDA FAERS", "CIMA")),
}
#: Whose references each dimension shows, in order; of minutes only those with the reaction.
REFERRED = {"mecanistica": ("PubMed", "DrugBank", "PharmGKB"), "clinica": ("PubMed",), "regulatoria": ("PRAC/EMA",)}


def report_sections(raw: DataFrame, dimensions: tuple[str, ...] = tuple(DIMENSIONS), refs: DataFrame | None = None) -> DataFrame:
    """RND-09: one row for each case and dimension of a report text; a missing one is an error. raw: case_id, report.

    refs: case_id, source, ord, ref (url or file name), found; each dimension then has its references in order.
    """
    titles, sources = ({k: DIMENSIONS.get(k, (k, ()))[i] for k in dimensions} for i in (0, 1))
    item = lambda value, d: F.struct(F.lit(d).alias("dimension"), F.lit(titles[d]).alias("title"), F.lit(", ".join(sources[d])).alias("sources"), F.try_variant_get(value, f"$.{d}", "string").alias("content"))
    rows = raw.select("case_id", F.explode(bound(parse_cascade(F.col("report")), lambda value: F.array(*(item(value, d) for d in dimensions)))).alias("x")).select("case_id", "x.*")
    rows = rows.withColumn("state", F.when(F.col("content").isNotNull(), "ok").otherwise("error"))
    if refs is None:
        return rows
    places = [(d, s, n) for d in dimensions for n, s in enumerate(REFERRED.get(d, ()))]
    shown = refs.where((F.col("source") != "PRAC/EMA") | F.col("found")).join(F.broadcast(refs.sparkSession.createDataFrame(places, "dimension string, source string, place int")), "source")
    listed = shown.groupBy("case_id", "dimension").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "ord", "ref"))), lambda x: x["ref"]).alias("refs"))
    return rows.join(listed, ["case_id", "dimension"], "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))


def report_map(sections: DataFrame) -> DataFrame:
    """RND-11: content by dimension."""
    return sections.groupBy("case_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dimension", F.coalesce("content", F.lit("")))))).alias("report"))


def chat_message(message: Column, contexts: Column) -> Column:
    """RND-12: texts of attached files before the message."""
    return F.concat_ws("\n\n", F.array_join(F.filter(contexts, lambda x: F.trim(x) != ""), "\n\n"), message)


def chat_history(turns: DataFrame) -> DataFrame:
    """RND-12: a conversation's turns in order as one text. turns: conv_id, turn, role, text."""
    line = F.struct("turn", "role", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("history"), F.count("*").alias("n_turns"))
