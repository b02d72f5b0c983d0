"""

The SQL writes out what the rules give, with fixed values of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions import text as T
from vigilake.functions.arrays import sorted_distinct
from vigilake.functions.json import token_usage
from vigilake.operators import drugs, judge, literature, pgx, reports, signals, terminology
from vigilake.plans import cases
from vigilake.plans.registry import query
from vigilake.plans.relational_queries import _QUESTION_VALUES, _QUESTIONS
from vigilake.session import shared_dir, table
from vigilake.sources import readers, sinks
from vigilake.streaming.ingest import first_empty


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _text(c: str):
    return F.col(c).cast("string")


@query("""select 'R' || r_regionkey as code, 'PT' as type, r_name as name_en, 'es:' || lower(r_name) as name_es, 'H-' || r_name as top, (select string_agg(n_name, '|' order by n_nationkey) from nation where n_regionkey = r_regionkey) as llts, (select string_agg('N' || n_nationkey, '|' order by n_nationkey) from nation where n_regionkey = r_regionkey) as codes from region
 union all select 'N' || n_nationkey, 'LLT', r_name, 'es:' || lower(r_name), 'H-' || r_name, '', null from nation join region on n_regionkey = r_regionkey union all select 'X', null, null, null, null, '', null""")
def terminology_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01..05, JOIN-02, JOIN-05..07: regions and nations written as terminology files, read and resolved."""
    folder, region, nation = _folder(spark, "terms"), table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    key, parent = F.concat(F.lit("R"), _text("r_regionkey")), F.concat(F.lit("R"), _text("n_regionkey"))
    files = {
        "pt": region.select(F.concat_ws("$", key, "r_name", F.lit(""))),
        "pt_es": region.select(F.concat_ws("$", key, F.concat(F.lit("es:"), F.lower("r_name")))),
        "llt": nation.select(F.concat_ws("$", F.concat(F.lit("N"), _text("n_nationkey")), "n_name", parent, F.lit(""))),
        "mdhier": region.select(F.concat_ws("$", key, F.lit("a"), F.lit("b"), F.lit("c"), F.concat(F.lit("H-"), "r_name"))),
    }
    for name, lines in files.items():
        lines.write.text(f"{folder}/{name}")
    read = lambda n: readers.terminology(spark, f"{folder}/{n}")
    es = readers.preferred_names(read("pt_es")).select("code", F.col("name").alias("name_es"))
    pt = readers.preferred_names(read("pt")).withColumnRenamed("name", "name_en").join(es, "code", "left")
    llt = readers.lower_terms(read("llt")).select("code", F.col("name").alias("name_en"), F.lit(None).cast("string").alias("name_es"), "pt_code", "ord")
    codes = pt.select("code").union(llt.select("code")).union(spark.range(1).select(F.lit("X")))
    top = terminology.hierarchy(codes, llt, readers.hierarchy(read("mdhier"))).select("code", F.col("pt_name").alias("top"))
    own = readers.terms_of_preferred(llt).select(F.col("pt_code").alias("code"), F.array_join("codes", "|").alias("codes"))
    out = terminology.resolve(codes, pt, llt).join(top, "code").join(own, "code", "left")
    return out.select("code", "type", "name_en", "name_es", "top", F.array_join("llts_en", "|").alias("llts"), "codes")


@query("""select p_partkey::varchar as code, p_name as name_en from part where starts_with(p_partkey::varchar, '12') order by p_partkey limit 15""")
def code_prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-13, FLT-12, TOP-01: digits are a code prefix; all parts as preferred terms."""
    pt = table(spark, sf_dir, "part").select(_text("p_partkey").alias("code"), F.col("p_name").alias("name_en"), F.col("p_name").alias("name_es"), F.col("p_partkey").alias("ord"))
    none = pt.limit(0).select("*", F.lit("").alias("pt_code"))
    return terminology.search(" 12 ", pt, none, 15).select("code", "name_en")


@query("""with n as (select *, 'D' || n_nationkey as id from nation), k as (select a.n_nationkey as key, count(*) as n, min(b.n_name) as first from n a join n b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey where a.n_regionkey % 2 = 0 group by 1)
 select p_partkey, n.id as drugbank_id, n.n_name as inn, coalesce(k.n, 0)::int as n_interactions, k.first from part left join n on p_partkey % 30 = n_nationkey left join k on p_partkey % 30 = k.key""")
def drug_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-06, JOIN-08, JOIN-09, MAP-01: dictionaries of nations as JSON objects, one of them turned into a table, and parts' payloads."""
    folder, nation = _folder(spark, "drugs"), table(spark, sf_dir, "nation")
    ident = lambda c: F.concat(F.lit("D"), _text(c))
    whole = lambda rows, k, v: rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(k, v)))))
    whole(nation, F.lower("n_name"), F.struct(ident("n_nationkey").alias("drugbank_id"), F.col("n_name").alias("inn"))).write.text(f"{folder}/lookup")
    other = nation.select(F.col("n_nationkey").alias("o"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("r"))
    pairs = nation.where("n_regionkey % 2 = 0").join(other, (F.col("n_regionkey") == F.col("r")) & (F.col("n_nationkey") != F.col("o")))
    lists = pairs.groupBy("n_nationkey").agg(F.sort_array(F.collect_list(F.struct("name", ident("o").alias("drugbank_id"), F.lit("x").alias("description")))).alias("v"))
    whole(lists, ident("n_nationkey"), F.col("v")).write.text(f"{folder}/interactions")
    lookup = readers.drug_file(spark, f"{folder}/lookup", "lookup").select("key", "value.*")
    known = readers.drug_table(spark, f"{folder}/interactions", "interactions", f"{folder}/interactions.parquet")
    asked = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 30).alias("n")).join(nation.select(F.col("n_nationkey").alias("n"), F.concat(F.lit(" "), F.upper("n_name"), F.lit("\t")).alias("name")), "n", "left")
    out = drugs.with_payload(drugs.resolve(asked, lookup), known, "interactions")
    return out.select("p_partkey", "drugbank_id", "inn", F.size("interactions").alias("n_interactions"), F.get("interactions", F.lit(0))["name"].alias("first"))


@query("""select p_partkey, case when p_partkey % 5 <> 0 then p_size end::bigint as total, (p_partkey + 1)::varchar as second_id, p_size::bigint as id_total, p_name as translation, p_name as medicine, 'u' || p_partkey as document, 'PA' || p_partkey as drug_id, case when p_partkey % 2 = 1 then p_brand end as suggestion,
 coalesce(case when p_partkey % 2 = 1 then p_size end, p_partkey)::bigint as tokens, case when p_partkey % 3 = 0 then 'PA' || p_partkey else 'B' || p_partkey end as first_known from part""")
def rest_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-08, SRC-09, SRC-11, SRC-13, SRC-16, JOIN-14, AGG-12, TOP-07: answers of services made from parts."""
    odd = F.col("p_partkey") % 2 == 1
    js = lambda **c: F.to_json(F.struct(*(v.alias(k) for k, v in c.items())))
    one = lambda name, v: F.struct(v.alias(name))
    rows = table(spark, sf_dir, "part").withColumns({
        "b1": F.when(F.col("p_partkey") % 5 == 0, F.lit('{"error":{}}')).otherwise(js(meta=one("results", one("total", F.col("p_size"))))),
        "b2": js(esearchresult=F.struct(F.array(_text("p_partkey"), (F.col("p_partkey") + 1).cast("string")).alias("idlist"), _text("p_size").alias("count"), F.col("p_name").alias("querytranslation"))),
        "b3": js(resultados=F.array(F.struct(F.col("p_name").alias("nombre"), F.array(one("url", F.concat(F.lit("u"), _text("p_partkey")))).alias("docs")), F.struct(F.lit("other").alias("nombre"), F.array(one("url", F.lit("no"))).alias("docs")))),
        "b4": js(data=F.array(one("id", F.concat(F.lit("PA"), _text("p_partkey"))), one("id", F.lit("x")))),
        "b5": F.when(odd, js(suggestionGroup=one("suggestionList", one("suggestion", F.array("p_brand"))))).otherwise(F.lit("{}")),
    })
    got = readers.suggestion(readers.report_counts_of(rows, "b1"), "b5").withColumn("asked", F.col("total"))
    got = readers.literature_ids(got, "b2").withColumnRenamed("total", "id_total")
    got = readers.drug_id(readers.first_medicine(got, "b3"), "b4")
    ids = got.where("p_partkey % 3 = 0").select(F.concat(F.lit("a"), _text("p_partkey")).alias("name"), F.col("drug_id").alias("id")).union(got.select(F.concat(F.lit("b"), _text("p_partkey")), F.concat(F.lit("B"), _text("p_partkey"))))
    got = drugs.first_known(got.withColumns({"n1": F.concat(F.lit(" a"), _text("p_partkey")), "n2": F.concat(F.lit("b"), _text("p_partkey"))}), ids, "n1", "n2")
    tokens = token_usage(F.when(odd, F.col("p_size")), _text("p_partkey"))
    return got.select("p_partkey", F.col("asked").alias("total"), F.get("ids", F.lit(1)).alias("second_id"), "id_total", "translation", "medicine", "document", "drug_id", "suggestion", tokens.alias("tokens"), F.col("id").alias("first_known"))


@query("""select p_partkey as drug, 'control' as kind, i - 1 as ord, 'c' || i as name from part, range(1, 13) t(i) where i % 2 = 1 union all select p_partkey, 'pathway', i, 'p' || i from part, range(0, 8) t(i)""")
def pathway_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-15, FLT-08, TOP-06: two searches for each part; every other hit of the first is a control, of which ten would be shown."""
    hit = lambda name, i, kind: F.struct(F.concat(F.lit(name), i.cast("string")).alias("name"), F.lit("u").alias("uri"), kind.alias("biopaxClass"))
    body = lambda hits: F.to_json(F.struct(hits.alias("searchHit")))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drug"))
    first = part.select("drug", body(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: hit("c", i, F.when(i % 2 == 1, "Control").otherwise("Protein")))).alias("body"))
    second = part.select("drug", body(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: hit("p", i, F.lit("Pathway")))).alias("body"))
    out = readers.pathway_hits(first, second)
    return out.select("drug", "kind", F.when(F.col("kind") == "control", 2 * F.col("ord")).otherwise(F.col("ord")).cast("long").alias("ord"), "name")


@query("""select p_partkey, p_name || ' <b>' as title, p_brand || ' ' || p_type as abstract from part where p_partkey % 3 <> 0""")
def article_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10: parts as articles of XML files; those without title and abstract are dropped."""
    empty = F.col("p_partkey") % 3 == 0
    xml = F.concat(F.lit("<PubmedArticle v='1'><M><PMID>"), _text("p_partkey"), F.lit("</PMID><ArticleTitle>"), F.when(empty, "").otherwise(F.concat("p_name", F.lit(" &lt;b&gt;"))), F.lit("</ArticleTitle>"), F.when(empty, "").otherwise(F.concat(F.lit("<AbstractText>\n "), "p_brand", F.lit("</AbstractText><AbstractText> "), "p_type", F.lit("</AbstractText>"))), F.lit("</M></PubmedArticle>"))
    folder = _folder(spark, "articles")
    table(spark, sf_dir, "part").select(xml).write.text(folder)
    return readers.articles(spark, folder).select(F.col("pmid").cast("long").alias("p_partkey"), "title", "abstract")


_SECTION_OF = {"en": "casos_reportados", "fr": "factores_riesgo", "de": "recomendaciones", "es": "asociacion_general"}


@query("""with v(lang, section, ord, label) as (values ('en', 'casos_reportados', 0, 'CASOS REPORTADOS'), ('fr', 'factores_riesgo', 1, 'FACTORES DE RIESGO'), ('de', 'recomendaciones', 2, 'RECOMENDACIONES Y MANEJO'), ('es', 'asociacion_general', 3, 'ASOCIACIÓN GENERAL')),
 d as (select source as case_id, section, doc_id, doc_id % 3 as t from documents join v using (lang)), n as (select case_id, section, count(*) as n from d group by all),
 grid as (select c.case_id, v.section, v.ord, v.label, coalesce(n.n, 0) as n from (select distinct case_id from d) c cross join v left join n on n.case_id = c.case_id and n.section = v.section),
 sl as (select *, case when n = 0 then 0 when n >= 2 and row_number() over (partition by case_id order by (n >= 2) desc, n desc, ord) <= sum((n = 0)::int) over (partition by case_id) then 2 else 1 end as slots from grid),
 a as (select d.*, row_number() over (partition by case_id, section order by t, doc_id) as place from d),
 x as (select a.case_id, a.section, string_agg('PMID: ' || doc_id || chr(10) || 'Title: ' || case when doc_id % 2 = 0 then 'T' || doc_id else '' end || chr(10) || 'Abstract: ' || chr(10) || 'Origen: t' || t, chr(10) || chr(10) order by place) as text, string_agg('https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/', ' | ' order by place) as urls from a join sl on a.case_id = sl.case_id and a.section = sl.section where place <= slots group by all)
 select sl.case_id, string_agg('─── ' || label || ' (' || n || ' artículos encontrados) ───' || chr(10) || chr(10) || 'Query: q AND "' || label || '"' || chr(10) || chr(10) || coalesce(x.text, 'Sin resultados para esta búsqueda.') || coalesce(chr(10) || chr(10) || 'URLs: ' || urls, ''), chr(10) || chr(10) order by ord) as text from sl left join x on x.case_id = sl.case_id and x.section = sl.section group by 1""")
def literature_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RND-03, TOP-02, TOP-03, JOIN-13, AGG-02, AGG-03, STR-11, STR-12: sources as cases, languages as sections, documents as articles."""
    docs = table(spark, sf_dir, "documents").where(F.col("lang").isin(*_SECTION_OF))
    section = F.create_map(*(F.lit(x) for pair in _SECTION_OF.items() for x in pair))[F.col("lang")]
    hits = docs.select(F.col("source").alias("case_id"), section.alias("section"), (F.col("doc_id") % 3).cast("int").alias("term_ord"), F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string")).alias("term"), F.col("doc_id").alias("id_ord"), _text("doc_id").alias("pmid"))
    found = literature.section_totals(hits.groupBy("case_id", "section", "term_ord").agg(F.count("*").alias("total")))
    every = F.array(*(F.struct(F.lit(k).alias("section"), F.lit(label).alias("label"), F.lit(i).alias("ord")) for i, (k, _, label) in enumerate((*literature.SECTIONS, literature.GENERAL))))
    seen = literature.first_seen(hits)
    counted = seen.groupBy("case_id", "section").agg(F.count("*").alias("n_ids"))
    grid = hits.select("case_id").distinct().select("case_id", F.explode(every).alias("s")).select("case_id", "s.*").join(found, ["case_id", "section"], "left").join(counted, ["case_id", "section"], "left").fillna(0, ["n_ids", "n_found"])
    fetched = docs.where("doc_id % 2 = 0").select(_text("doc_id").alias("pmid"), F.concat(F.lit("T"), _text("doc_id")).alias("title"), F.lit("").alias("abstract"))
    texts = literature.section_text(literature.enrich(literature.chosen(seen, literature.slots(grid)), fetched))
    asked = literature.term_query(F.lit("q"), F.col("label"), F.lit(""))
    sections = grid.withColumn("query", F.regexp_replace(asked, " AND $", "")).join(texts, ["case_id", "section"], "left").withColumn("details", F.lit(None).cast("string"))
    return literature.serialise(sections).select("case_id", "text")


@query("""select o_orderkey as case_id, 'Farmaco: ' || o_orderpriority || chr(10) || 'RAM evaluada: fiebre' || chr(10) || 'Sexo: F | Edad: ' || (o_orderkey % 90) || ' | Etnia: ' || chr(10) || 'RAM en ficha tecnica (validacion previa): ' || case when o_orderkey % 2 = 0 then 'no' else 'desconocido' end || chr(10) || 'URL Ficha Tecnica: u' || chr(10) || chr(10)
 || '--- DrugBank (mecanismo, dianas, CYP, toxicidad) ---' || chr(10) || o_orderstatus || chr(10) || chr(10) || '--- PharmGKB + CPIC (farmacogenetica) ---' || chr(10) || 'No disponible' || chr(10) || chr(10) || '--- Pathway Commons (interacciones gen-farmaco, pathways moleculares) ---' || chr(10) || 'No disponible' || chr(10) || chr(10)
 || '--- PubMed (literatura: casos, factores riesgo, recomendaciones) ---' || chr(10) || 'No disponible' || chr(10) || chr(10) || '--- FDA FAERS / openFDA (notificaciones espontaneas) ---' || chr(10) || 'No disponible' || chr(10) || chr(10) || '--- CIMA / AEMPS (ficha tecnica espanola) ---' || chr(10)
 || case when o_orderkey % 2 = 0 then 'hoja: no aparece ' || o_orderkey else 'En la ficha técnica de CIMA/AEMPS no se ha encontrado información relacionada con la RAM ''fiebre'' para el fármaco ''' || o_orderpriority || '''.' end || chr(10) || chr(10)
 || '--- PRAC / EMA (actas de senales regulatorias) ---' || chr(10) || 'No se ha identificado evaluación regulatoria formal de la RAM ''fiebre'' para el fármaco ''' || o_orderpriority || ''' en las actas PRAC/EMA disponibles.' as prompt from orders""")
def report_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RND-08, FLT-15, FLT-16, JSN-04: orders as cases with two answers each."""
    orders = table(spark, sf_dir, "orders")
    even = F.col("o_orderkey") % 2 == 0
    sheet = F.when(even, F.concat(F.lit("hoja: no aparece "), _text("o_orderkey"))).otherwise("Sin resultados en CIMA para este medicamento.")
    own = orders.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("drug"), F.lit("fiebre").alias("reaction"), F.lit("F").alias("sex"), (F.col("o_orderkey") % 90).cast("string").alias("age"), F.lit(None).cast("string").alias("ethnicity"), reports.found_state(sheet).alias("found"), F.lit("u").alias("ft_url"))
    found = orders.select(F.col("o_orderkey").alias("case_id"), F.lit("DrugBank").alias("source"), F.col("o_orderstatus").alias("text")).union(orders.select("o_orderkey", F.lit("CIMA"), sheet))
    return reports.report_prompt(own, found)


@query("""with n as (select n_regionkey as case_id, n_nationkey as i, lower(n_name) as inn, n_name as name from nation), t as (select *, case when i % 3 > 0 then 'Evitar con ' || min(inn) over (partition by case_id) || '.' end as text from n),
 m as (select a.case_id, a.i, b.i as j, a.name as source, b.name as mentioned, a.text as snippet from t a join t b on a.case_id = b.case_id and a.i <> b.i where length(b.inn) >= 4 and contains(lower(a.text), b.inn)),
 al as (select case_id, string_agg('ALERTA: ' || source || ' menciona a ' || mentioned || ' en sección 4.5: "' || snippet || '"' || chr(10), '' order by i, j) as x from m group by 1),
 bl as (select case_id, string_agg(chr(10) || '[' || name || ' — sección 4.5]:' || chr(10) || coalesce(text, 'Sin datos') || chr(10), '' order by i) as x, string_agg(name, ' + ' order by i) as names from t group by 1)
 select bl.case_id, 'Fármacos en combinación: ' || names || chr(10) || 'RAM evaluada: fiebre' || chr(10) || chr(10) || '--- CIMA sección 4.5 (interacciones en ficha técnica) ---' || chr(10) || trim(coalesce(al.x, '') || bl.x, chr(10)) || chr(10) || chr(10) || '--- DrugBank (interacciones entre fármacos) ---' || chr(10) || 'k' || bl.case_id || chr(10) || chr(10) || '--- PubMed (literatura sobre esta combinación + RAM) ---' || chr(10) || 'No disponible' as prompt from bl left join al using (case_id)""")
def interaction_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RND-10, JOIN-12: nations of a region as drugs that their sheets name."""
    own, sheets = _combination(spark, sf_dir)
    known = own.select("case_id", F.concat(F.lit("k"), _text("case_id")).alias("text"))
    return reports.interaction_prompt(own, sheets, drugs.cross_mentions(sheets), known, known.limit(0))


def _combination(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("case_id"), F.col("n_nationkey").alias("i"), F.lower("n_name").alias("inn"), F.col("n_name").alias("name"))
    least = nation.groupBy("case_id").agg(F.min("inn").alias("least"))
    sheets = nation.join(least, "case_id").select("case_id", "i", "inn", "name", F.when(F.col("i") % 3 > 0, F.concat(F.lit("Evitar con "), "least", F.lit("."))).alias("text"))
    listed = F.sort_array(F.collect_list(F.struct("i", "inn", "name")))
    own = nation.groupBy("case_id").agg(listed.alias("d")).select("case_id", F.lit("fiebre").alias("reaction"), F.transform("d", lambda x: x["name"]).alias("names"), F.transform("d", lambda x: F.struct(x["inn"].alias("inn"), x["name"].alias("name_es"))).alias("drugs"))
    return own, sheets


@query("""with n as (select n_regionkey as r, n_nationkey as i, lower(n_name) as inn from nation), m as (select a.r, count(*) as n from n a join n b on a.r = b.r and a.i <> b.i where a.i % 3 > 0 and length(b.inn) >= 4 and contains('evitar con ' || (select min(inn) from n c where c.r = a.r) || '.', b.inn) group by 1)
 select r as case_id, 0::bigint as seq, 'cabecera_int' as tipo, count(*)::int as items from n group by 1 union all select r, 1 + 100 * i + 0, 'seccion_farmaco', 1 from n union all select r, 1000001, 'seccion_interaccion', coalesce(m.n, 0)::int from (select distinct r from n) left join m using (r)
 union all select r, 1000002, 'seccion_interaccion', 0 from (select distinct r from n) union all select r, 1000003, 'seccion_interaccion', 0 from (select distinct r from n) union all select r, 1000004, 'informe_int', 0 from (select distinct r from n) union all select r, 1000005, 'fin_int', 0 from (select distinct r from n)""")
def interaction_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-04, STM-10, RND-05, UDF-02: the events of regions as combinations; items: drugs, cross mentions or one."""
    own, sheets = _combination(spark, sf_dir)
    # a card for each drug of a case: made by drug, then given to its case
    each = reports.cards(sheets.select(F.col("i").alias("case_id"), F.lit("CIMA").alias("source"), F.lit("ok").alias("status"), "text"))
    cards = each.withColumnRenamed("case_id", "drug_index").join(sheets.select(F.col("i").alias("drug_index"), "case_id", "inn"), "drug_index")
    known = sheets.select("case_id", F.col("inn").alias("drug1"), F.col("inn").alias("drug2"), F.col("text").alias("description")).limit(0)
    texts = own.select("case_id", F.lit("x").alias("text")).limit(0)
    report = judge.reports_of(own.select("case_id", F.lit("p").alias("prompt")))
    found = cases.interaction_events(own, cards, sheets, drugs.cross_mentions(sheets), known, texts, report)
    value = F.parse_json("payload")
    items = F.coalesce(F.when(F.col("tipo") == "cabecera_int", F.size(F.try_variant_get(value, "$.farmacos", "array<variant>"))).when(F.col("tipo") == "seccion_farmaco", 1), F.size(F.try_variant_get(value, "$.contenido.menciones_cruzadas", "array<variant>")), F.lit(0))
    return found.select("case_id", "seq", "tipo", F.greatest(items, F.lit(0)).alias("items"))


@query("""with x as (select doc_id, '4.3 Contraindicaciones ' || coalesce(lang, '') as a, '4.4 Advertencias y precauciones especiales de empleo ' || source as b, '4.5 Interacción con otros medicamentos y otras formas de interacción ' || coalesce(text, '') as c from documents), y as (select doc_id, trim(a) as a, trim(b) as b, regexp_replace(c, '\\s+$', '') as c from x)
 select doc_id, md5(a || sep || b || sep || c || sep || '4.8 Reacciones adversas z') as sections_md5, md5(c) as interactions_md5 from y, (select chr(10) || chr(10) || '---' || chr(10) || chr(10) as sep)""".replace("\\\\", "\\"))
def datasheet_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-06, STR-07: documents inside the headings of a datasheet."""
    sheet = F.concat(F.lit("4.3 Contraindicaciones "), F.coalesce("lang", F.lit("")), F.lit(" 4.4 Advertencias y precauciones especiales de empleo "), "source", F.lit(" 4.5 Interacción con otros medicamentos y otras formas de interacción "), F.coalesce("text", F.lit("")), F.lit(" 4.6 Fertilidad, embarazo y lactancia y 4.8 Reacciones adversas z 4.9 Sobredosis fin"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.datasheet_sections(sheet)).alias("sections_md5"), F.md5(T.interaction_section(sheet)).alias("interactions_md5"))


@query("""with a as (select p_size as drug, p_partkey as k, case p_type when 'ECONOMY' then '1A' when 'SMALL' then '1B' when 'MEDIUM' then '2A' when 'LARGE' then '2B' when 'STANDARD' then '3' when 'PROMO' then '4' end as level, p_retailprice > 950 as guide from part),
 b as (select *, case when level in ('1A', '1B') then 0 when level in ('2A', '2B') then 1 else 2 end as block, case level when '1A' then 0 when '1B' then 1 when '2A' then 2 when '2B' then 3 else 99 end as rk from a),
 c as (select *, row_number() over (partition by drug, block order by rk, k) as pos from b),
 l as (select drug, block, string_agg('  · G' || k || ' [evidencia: ' || coalesce(nullif(level, ''), 'desconocido') || ']' || case when guide then ' ✓ GUÍA CPIC/DPWG' else '' end || ' (1 alelo-fenotipo; 1 contextos)', chr(10) order by pos) as x from c where block < 2 or pos <= 3 group by all)
 select drug, 'PharmGKB + CPIC — ' || drug || chr(10) || string_agg(chr(10) || case block when 0 then 'Genes evidencia fuerte (1A/1B):' when 1 then 'Genes evidencia secundaria (2A/2B):' else 'Genes evidencia baja (referencia):' end || chr(10) || x, chr(10) order by block) as text from l group by drug
 union all select -1, 'Sin datos farmacogenéticos relevantes.'""")
def gene_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RND-04, AGG-10, SRC-14, FLT-07, FLT-17: each part as an answer with one annotation; drug -1 has none."""
    level = F.lit(None).cast("string")
    for k, v in {"ECONOMY": "1A", "SMALL": "1B", "MEDIUM": "2A", "LARGE": "2B", "STANDARD": "3", "PROMO": "4"}.items():
        level = F.when(F.col("p_type") == k, v).otherwise(level)
    pair = lambda n, weak: F.struct(F.lit(n).alias("allele"), F.lit("p").alias("phenotype"), F.lit(weak).alias("limitedEvidence"))
    one = F.struct(
        F.struct(level.alias("term")).alias("levelOfEvidence"), F.struct(F.array(F.struct(F.concat(F.lit("G"), _text("p_partkey")).alias("symbol")), F.struct(F.lit("second").alias("symbol"))).alias("genes")).alias("location"),
        F.array(pair("a", False), pair("b", True)).alias("allelePhenotypes"), F.when(F.col("p_retailprice") > 950, F.array(F.lit("g"))).otherwise(F.array().cast("array<string>")).alias("relatedGuidelines"), F.array(F.lit("efficacy"), F.lit("")).alias("types"),
    )
    part = table(spark, sf_dir, "part")
    answers = part.select(F.col("p_size").alias("drug"), F.col("p_partkey").alias("k"), F.to_json(F.struct(F.array(one).alias("data"))).alias("body"))
    rows = readers.annotations(answers).select("drug", F.col("k").alias("ord"), *(c.alias(k) for k, c in pgx.extract(F.col("annotation")).items()))
    everyone = part.select(F.col("p_size").alias("drug")).union(spark.range(1).select(F.lit(-1)))
    return pgx.text(pgx.consolidate(rows), "drug", everyone).select(F.col("drug").cast("int").alias("drug"), "text")


@query(f"""with q(question, pt, term) as (values {_QUESTION_VALUES}), h as (select p_brand as drug, question, pt, lower(term) as term, lower(term) = lower(pt) as is_pt, count(distinct l_orderkey) as n from lineitem join part on l_partkey = p_partkey join q on lower(p_name) = lower(term) group by all),
 s as (select drug, question, pt, coalesce(sum(n) filter (where is_pt), 0) as total_pt, sum(n) as total, string_agg('  ''' || term || ''': ' || n || ' casos', chr(10) order by term) filter (where not is_pt) as lines from h group by all)
 select drug, question, 'PT ''' || pt || ''': ' || total_pt || ' casos' || chr(10) || coalesce('LLTs (sinónimos MedDRA):' || chr(10) || lines || chr(10), '') || 'Total combinado (PT + LLTs): ' || total || ' casos' as text from s""")
def report_count_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RND-02, FLT-09, FLT-10."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_name"), "l_partkey")
    asked = spark.createDataFrame(_QUESTIONS, "question string, pt string, term string")
    counts = reports.report_counts(rows.select(F.col("l_orderkey").alias("case_id"), F.col("p_brand").alias("drug"), F.col("p_name").alias("term")), asked)
    return counts.join(F.broadcast(asked.select("question", "pt").distinct()), "question").select("drug", "question", reports.report_text(F.col("pt"), F.col("total_pt"), F.col("lines"), F.col("total_combined")).alias("text"))


@query("""select 'f' || doc_id as filename, source, make_date(2000 + (doc_id % 25)::int, 3, 1) as month, md5('── ' || upper(source) || ' | ' || (10 + doc_id % 9) || ' March ' || (2000 + doc_id % 25) || ' | f' || doc_id || chr(10) || chr(10) || 'a' || chr(10) || chr(10) || coalesce(lang, '')) as block_md5 from documents""")
def minutes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01, DAT-02, RND-06: documents as minutes, half of them there before; each file once."""
    n = F.col("doc_id")
    date = F.concat((10 + n % 9).cast("string"), F.lit(" March "), (2000 + n % 25).cast("string"))
    fragments = F.array(F.struct(F.lit("a").alias("texto")), F.struct(F.coalesce("lang", F.lit("")).alias("texto")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), _text("doc_id")).alias("filename"), "source", date.alias("date"), fragments.alias("fragments"))
    merged = sinks.merge_signals(rows.where("doc_id % 2 = 0"), rows)
    return signals.block_text(merged).select("filename", "source", T.month_of(F.col("date")).alias("month"), F.md5("block").alias("block_md5"))


@query("""with r as (select source, count(*) filter (where contains(lower(text), 'thing')) as n_with, count(*) filter (where not contains(lower(text), 'thing')) as n_without from documents where text is not null group by all) select sum(n_with)::bigint as n_with, sum(n_without)::bigint as n_without from r""")
def signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-09, FLT-03."""
    return signals.counts(table(spark, sf_dir, "documents").where("text is not null").select(T.mentions(F.col("text"), "thing").alias("with_reaction")))


@query("""select o_orderkey as case_id, case when o_orderkey % 4 = 0 then 'no drug' when o_orderkey % 4 = 1 then 'no reaction' end as error, o_orderstatus as inn, case when o_orderkey % 4 = 1 then '' else 'Fever' end || case when o_orderkey % 3 = 0 then '|Hot' else '' end as terms, case when o_orderkey % 4 < 2 then 0 else 2 + (o_orderkey % 4 = 2)::int end::bigint as n_events from orders""")
def case_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03, SRC-20, FLT-13, ARR-05, ARR-06, STM-01: orders as requests; a source answers some of them, and their events are counted."""
    n = F.col("o_orderkey")
    forms = table(spark, sf_dir, "orders").select(n.alias("case_id"), F.when(n % 4 == 0, " ").otherwise("drug").alias("drug"), F.col("o_orderstatus").alias("drug_inn"), F.when(n % 4 == 1, " ").otherwise(" Fever ").alias("reaction_en"), F.lit(None).cast("string").alias("reaction_es"), F.when(n % 3 == 0, '["Hot", " fever ", ""]').otherwise("bad").alias("llts_json"), F.lit("1").alias("age"), F.lit("F").alias("sex"))
    own = cases.cases_of(forms)
    answers = lambda c: c.where("case_id % 4 = 2").select("case_id", F.lit("ok").alias("status"), F.lit("x").alias("text"))
    events = cases.case_events(own, {"CIMA": answers}).groupBy(F.col("case_id").cast("long").alias("case_id")).agg(F.count("*").alias("n_events"))
    shown = F.filter("terms", lambda t: ~((t == "fever") & (F.lower(F.trim("reaction_en")) == "")))
    return own.join(events, "case_id", "left").select("case_id", "error", "inn", F.array_join(shown, "|").alias("terms"), F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"))


def dimension_writer(prompts: list[str]) -> list[str]:
    return [f'Here: {{"mecanistica": "m{p}", "regulatoria": {{"a": 1}}}}' if int(p) % 3 else "{}" for p in prompts]


@query("""select c_custkey as case_id, d as dimension, case when c_custkey % 3 = 0 or d = 'clinica' then 'error' else 'ok' end as state, case when c_custkey % 3 = 0 then null when d = 'mecanistica' then 'm' || c_custkey when d = 'regulatoria' then '{"a":1}' end as content, case d when 'mecanistica' then 'p1,d1' when 'clinica' then 'p1' else 'f1' end as refs from customer, (values ('mecanistica'), ('clinica'), ('regulatoria')) v(d)""")
def report_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-02, RND-09, JSN-01: a generator's reports of customers by dimension, with references."""
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), _text("c_custkey").alias("prompt"))
    written = judge.reports_of(asked, dimension_writer)
    refs = (("PubMed", 0, "p1", None), ("DrugBank", 0, "d1", None), ("PRAC/EMA", 0, "f1", True), ("PRAC/EMA", 1, "f2", False))
    one = lambda s, n, r, f: F.struct(F.lit(s).alias("source"), F.lit(n).alias("ord"), F.lit(r).alias("ref"), F.lit(f).cast("boolean").alias("found"))
    # of the cases and not of their reports, which would be written a second time
    named = asked.select("case_id", F.explode(F.array(*(one(*x) for x in refs))).alias("r")).select("case_id", "r.*")
    return reports.report_sections(written, refs=named).select("case_id", "dimension", "state", "content", F.array_join("refs", ",").alias("refs"))


@query("""select c_custkey as case_id, map_entries is not null as known, case when c_custkey % 3 = 0 then '' else 'm' || c_custkey end as mecanistica, '' as clinica from (select c_custkey, 1 as map_entries from customer)""")
def report_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RND-11: reports as one map each."""
    written = judge.reports_of(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), _text("c_custkey").alias("prompt")), dimension_writer)
    return reports.report_map(reports.report_sections(written)).select("case_id", F.col("report").isNotNull().alias("known"), F.col("report")["mecanistica"].alias("mecanistica"), F.col("report")["clinica"].alias("clinica"))


_EDGE = r"[^\p{L}\p{N}_]"


@query(rf"""select doc_id, coalesce(regexp_matches(text, '(?i)(^|{_EDGE})of\s+the($|{_EDGE})') or regexp_matches(strip_accents(lower(text)), '(^|{_EDGE})of the($|{_EDGE})') or contains(substr(text, 1, 8000), 'Os los'), false) as ram_encontrada from documents""")
def datasheet_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-05, TOP-06: documents as datasheets; the judge looks for a phrase in what it is shown."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("of the").alias("reaction"))
    return judge.datasheet_found(rows, phrase_judge, keep=["doc_id"]).select("doc_id", "ram_encontrada")


def phrase_judge(prompts: list[str]) -> list[str]:
    return [f'{{"ram_presente": {str("Os los" in p).lower()}}}' for p in prompts]


@query("""select conv_id, turn, role, case when role = 'user' then 'last: ' || regexp_extract(coalesce(text, ''), '([^' || chr(10) || ']*)$', 1) else '❌ Error al contactar con el modelo: no turn of a user' end as response from conversations""")
def chat_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-03, RND-12, STM-03: each turn as a message; the partner refuses those that aren't a user's."""
    turns = table(spark, sf_dir, "conversations")
    users, others = (turns.where(F.col("role") == "user"), turns.where(F.col("role") != "user"))
    sent = lambda rows: rows.select("conv_id", "turn", "role", F.lit("s").alias("system"), F.lit(None).cast("string").alias("history"), reports.chat_message(F.coalesce("text", F.lit("")), F.array(F.lit(" "))).alias("message"))
    return judge.chat(sent(users), last_line).union(judge.chat(sent(others), refuse)).select("conv_id", "turn", "role", "response")


def last_line(prompts: list[str]) -> list[str]:
    return [f"last: {p.rsplit(chr(10), 1)[-1]}" for p in prompts]


def refuse(prompts: list[str]) -> list[str]:
    raise ValueError("no turn of a user")


@query("""select page_id, 'https://example.org/docs/agenda-' || page_id || '.pdf' as url from pages union all select page_id, 'https://h/minutes-' || page_id || '.pdf' from pages union all select page_id, 'https://example.org/a/minutes-' || page_id || '.pdf' from pages""")
def minutes_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-17, STR-14: links to minutes and agendas among those of the pages, as absolute urls."""
    page = _text("page_id")
    html = F.concat(F.coalesce("html", F.lit("")), F.lit('<a href="../docs/./agenda-'), page, F.lit('.pdf">a</a><A class=x HREF=\'https://h/minutes-'), page, F.lit('.pdf\'>b</A><a href="/x/other.pdf">c</a><a href="/a/b/../minutes-'), page, F.lit('.pdf">d</a><a href="agenda-1.html">e</a>'))
    links = readers.pdf_links(table(spark, sf_dir, "pages").select("page_id", html.alias("html")))
    return links.select("page_id", readers.absolute("https://example.org/list/page?p=0#top", F.col("href")).alias("url"))


@query("""select o_custkey as k, string_agg(distinct nullif(o_orderpriority, ''), '|' order by nullif(o_orderpriority, '')) as priorities from orders group by 1""")
def sorted_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-02."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("p")).select("k", F.array_join(sorted_distinct(F.col("p")), "|").alias("priorities"))


@query("""select o_orderkey as page, (o_orderkey % 1000) as n_links from orders where o_orderkey > 0 and o_orderkey < (select min(o_orderkey) from orders where o_orderkey % 1000 = 0 and o_orderkey > 0)""")
def pages_until_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-05: orders as pages of a listing."""
    return first_empty(table(spark, sf_dir, "orders").where("o_orderkey > 0").select(F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 1000).alias("n_links")))


@query("""select p_partkey, '=== DrugBank: ' || p_name || ' (D' || p_partkey || ') ===' || chr(10) || chr(10) || 'mechanism:' || chr(10) || p_type || chr(10) || chr(10) || 'targets:' || chr(10) || '  - ' || p_brand || ' [G' || p_size || ']: x, y' || case when p_partkey % 2 = 0 then chr(10) || chr(10) || 'snp_effects:' || chr(10) || '  - gene=? rs_id=r description=' else '' end || chr(10) || chr(10) || 'toxicity:' || chr(10) || 'low' as text from part""")
def profile_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RND-01: parts as profiles."""
    kind, effects = readers.DRUG_FILES["profiles"], readers.DRUG_FILES["pgx"]
    target = F.array(F.struct(F.col("p_brand").alias("name"), F.concat(F.lit("G"), _text("p_size")).alias("gene_symbol"), F.array(F.lit("x"), F.lit("y")).alias("actions")))
    profile = F.from_json(F.to_json(F.struct(F.col("p_name").alias("inn"), F.concat(F.lit("D"), _text("p_partkey")).alias("drugbank_id"), F.col("p_type").alias("mechanism"), target.alias("targets"), F.lit("low").alias("toxicity"))), kind)
    found = F.from_json(F.when(F.col("p_partkey") % 2 == 0, F.lit('{"snp_effects":[{"rs_id":"r"}]}')).otherwise(F.lit("{}")), effects)
    return table(spark, sf_dir, "part").select("p_partkey", profile.alias("p"), found.alias("g")).select("p_partkey", drugs.summary(F.col("p"), F.col("g")).alias("text"))
