
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions.arrays import combinations
from vigilake.operators import drugs, literature, pgx, reports, terminology
from vigilake.plans.registry import query
from vigilake.session import shared_dir, table


def _terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions as preferred terms, nations as lower terms."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    pt = region.select(F.col("r_regionkey").cast("string").alias("code"), F.col("r_name").alias("name_en"), F.initcap("r_name").alias("name_es"), F.col("r_regionkey").cast("long").alias("ord"))
    llt = nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("name_en"), F.initcap("n_name").alias("name_es"), F.col("n_regionkey").cast("string").alias("pt_code"), F.col("n_nationkey").cast("long").alias("ord"))
    return pt, llt


@query("""select code, name from (select r_regionkey::varchar as code, r_name as name from region
 union all select 'N' || n_nationkey, r_name from nation left join region on n_regionkey = r_regionkey union all select 'X', null)""")
def code_to_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-01, JOIN-03; X is unknown."""
    pt, llt = _terms(spark, sf_dir)
    codes = pt.select("code").union(llt.select("code")).union(spark.range(1).select(F.lit("X")))
    return terminology.code_to_name(codes, pt, llt).select("code", "name")


@query("select r_regionkey::varchar as code, coalesce(string_agg(n_name, '|' order by n_nationkey), '') as names from region left join nation on n_regionkey = r_regionkey group by all")
def children_of_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-04, SRC-05."""
    pt, llt = _terms(spark, sf_dir)
    return terminology.pt_to_llts(pt.select("code"), llt).select("code", F.array_join("names", "|").alias("names"))


@query("""select code, name_en, type, coalesce(pt_code, '') as pt_code, coalesce((select r_name from region where r_regionkey::varchar = pt_code), '') as pt_name_en from (
 select r_regionkey::varchar as code, r_name as name_en, 'PT' as type, null as pt_code, 0 as tier, r_regionkey as ord from region where contains(lower(r_name), 'ca')
 union all select 'N' || n_nationkey, n_name, 'LLT', n_regionkey::varchar, 2, n_nationkey from nation where contains(lower(n_name), 'ca')) order by tier, ord limit 15""")
def tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-01."""
    pt, llt = _terms(spark, sf_dir)
    return terminology.search("ca", pt, llt, 15).select("code", "name_en", "type", F.coalesce("pt_code", F.lit("")).alias("pt_code"), F.coalesce("pt_name_en", F.lit("")).alias("pt_name_en"))


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def code_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-11 as a semi join."""
    known = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code"))
    return terminology.is_pt(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code")), known).select(F.col("code").alias("c_custkey"))


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F' and o_orderpriority like '1%')")
def code_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-11: in one list and not in the other."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"))
    known = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_orderpriority like '1%'").select(F.col("o_custkey").alias("code"))
    return terminology.is_llt(customers, known, customers).select(F.col("code").alias("c_custkey"))


@query("""with l as (select lower(trim(p_name)) as key, 'DB' || min(p_partkey) as drugbank_id, min(p_name) as inn from part group by 1)
 select p_partkey, l.drugbank_id, l.inn from part left join l on lower(trim('  ' || upper(p_name) || ' ')) = l.key""")
def drug_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-08."""
    part = table(spark, sf_dir, "part")
    lookup = part.groupBy(drugs.normal(F.col("p_name")).alias("key")).agg(F.concat(F.lit("DB"), F.min("p_partkey").cast("string")).alias("drugbank_id"), F.min("p_name").alias("inn"))
    asked = part.select("p_partkey", F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")).alias("name"))
    return drugs.resolve(asked, lookup).select("p_partkey", "drugbank_id", "inn")


_QUESTIONS = [("rings", "blue ring", "blue ring"), ("rings", "blue ring", "cold ring"), ("rings", "blue ring", "HOT RING"), ("gears", "hot gear", "hot gear"), ("gears", "hot gear", "red gear")]
_QUESTION_VALUES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _QUESTIONS)


@query(f"""with q(question, pt, term) as (values {_QUESTION_VALUES}), h as (select p_brand as drug, question, lower(term) as term, lower(term) = lower(pt) as is_pt, l_orderkey from lineitem join part on l_partkey = p_partkey join q on lower(p_name) = lower(term)),
 e as (select drug, question, term, is_pt, count(distinct l_orderkey) as n from h group by all)
 select e.drug, e.question, coalesce(sum(n) filter (where is_pt), 0)::bigint as total_pt, sum(n)::bigint as total_combined, any_value(o.n_cases) as n_cases
 from e join (select drug, question, count(distinct l_orderkey) as n_cases from h group by all) o using (drug, question) group by e.drug, e.question""")
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01: orders as cases, brands as drugs, part names as reactions."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_name"), "l_partkey")
    cases = rows.select(F.col("l_orderkey").alias("case_id"), F.col("p_brand").alias("drug"), F.col("p_name").alias("term"))
    asked = spark.createDataFrame(_QUESTIONS, "question string, pt string, term string")
    return reports.report_counts(cases, asked).select("drug", "question", "total_pt", "total_combined", "n_cases")


_TERM_ORDER = ["ring", "gear", "blue", "hot"]
_TERM_VALUES = ", ".join(f"({i}, '{t}')" for i, t in enumerate(_TERM_ORDER))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as articles that terms find, brands as sections."""
    part = table(spark, sf_dir, "part").select(F.lit(1).alias("case_id"), F.col("p_brand").alias("section"), F.col("p_partkey").cast("string").alias("pmid"), F.col("p_partkey").alias("id_ord"), "p_name")
    asked = spark.createDataFrame(list(enumerate(_TERM_ORDER)), "term_ord int, term string")
    return part.join(F.broadcast(asked), F.col("p_name").contains(F.col("term")))


@query(f"with t(term_ord, term) as (values {_TERM_VALUES}) select p_brand as section, count(*)::bigint as n_found from part join t on contains(p_name, term) group by 1")
def term_source_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-02: totals by term, summed over terms."""
    each = _hits(spark, sf_dir).groupBy("case_id", "section", "term_ord").agg(F.count("*").alias("total"))
    return literature.section_totals(each).select("section", "n_found")


@query(f"""with t(term_ord, term) as (values {_TERM_VALUES}), h as (select p_brand as section, p_partkey as pmid, term_ord, term from part join t on contains(p_name, term)),
 g as (select section, pmid, min(term_ord) as first_ord, string_agg(term, ',' order by term_ord) as origins from h group by all)
 select section, pmid::varchar as pmid, row_number() over (partition by section order by first_ord, pmid)::int as place, origins from g""")
def first_seen_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03, ARR-01."""
    return literature.first_seen(_hits(spark, sf_dir)).select("section", "pmid", "place", F.array_join("origins", ",").alias("origins"))


@query("""with s as (select source, lang as section, case lang when 'de' then 0 when 'en' then 1 when 'es' then 2 else 3 end as ord, count(*) filter (where n_chars > 6000) as n_ids, sum(n_chars)::bigint as n_found from documents group by all),
 r as (select *, sum((n_ids = 0)::int) over (partition by source) as free, row_number() over (partition by source order by (n_ids >= 2) desc, n_found desc, ord) as rk from s)
 select source, section, case when n_ids = 0 then 0 when n_ids >= 2 and rk <= free then 2 else 1 end::int as slots from r""")
def slot_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-02: sources as questions, languages as sections, long documents as articles."""
    order = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).when(F.col("lang") == "es", 2).otherwise(3)
    rows = table(spark, sf_dir, "documents").select("source", F.col("lang").alias("section"), order.alias("ord"), "n_chars")
    sections = rows.groupBy("source", "section", "ord").agg(F.count_if(F.col("n_chars") > 6000).alias("n_ids"), F.sum("n_chars").alias("n_found"))
    return literature.slots(sections, by="source").select("source", "section", "slots")


_LEVELS = {"ECONOMY": "1A", "SMALL": "1B", "MEDIUM": "2A", "LARGE": "2B", "STANDARD": "3", "PROMO": "4"}
_LEVEL_CASE = "case p_type " + " ".join(f"when '{k}' then '{v}'" for k, v in _LEVELS.items()) + " end"
_RANK = "case level when '1A' then 0 when '1B' then 1 when '2A' then 2 when '2B' then 3 end"


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as annotations: sizes as drugs, brands as genes, types as levels."""
    level = F.lit(None).cast("string")
    for k, v in _LEVELS.items():
        level = F.when(F.col("p_type") == k, v).otherwise(level)
    name = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(
        F.col("p_size").alias("drug"), F.col("p_partkey").alias("ord"), level.alias("level"), F.when(F.col("p_brand") == "Brand#1", "").otherwise(F.col("p_brand")).alias("gene"),
        F.array(F.struct(name[0].alias("allele"), name[1].alias("phenotype"))).alias("pairs"), F.array(name[0]).alias("diseases"), F.array(name[1], F.lit("")).alias("contexts"),
        (F.col("p_retailprice") > 950).alias("has_guideline"), F.lit(False).alias("has_label"),
    )


@query(f"""with a as (select p_partkey as ord, {_LEVEL_CASE} as level, case when p_brand = 'Brand#1' then '?' else p_brand end as gene, p_retailprice > 950 as g from part)
 select gene, coalesce(arg_min(level, {_RANK}) filter (where ({_RANK}) is not null), arg_min(level, ord) filter (where level <> ''), 'desconocido') as level, bool_or(g) as has_guideline from a group by gene""")
def group_best_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05."""
    rows = _annotations(spark, sf_dir).withColumn("gene", F.when(F.col("gene") == "", "?").otherwise(F.col("gene")))
    return rows.groupBy("gene").agg(pgx.best_level().alias("level"), F.bool_or("has_guideline").alias("has_guideline"))


@query(f"""with a as (select p_size as drug, p_partkey as ord, {_LEVEL_CASE} as level, case when p_brand = 'Brand#1' then '?' else p_brand end as gene, p_name, p_retailprice > 950 as g from part),
 b as (select *, case when level in ('1A', '1B') then 'strong' when level in ('2A', '2B') then 'secondary' else 'low' end as strength from a),
 p as (select drug, strength, gene, p_name, min(ord) as o from b group by all), c as (select drug, strength, gene, string_agg(p_name, ',' order by o) as pairs from (select *, row_number() over (partition by drug, strength, gene order by o) as n from p) where n <= 8 group by all),
 k as (select drug, strength, gene, string_agg(distinct split_part(p_name, ' ', 2), ',' order by split_part(p_name, ' ', 2)) as contexts, coalesce(arg_min(level, {_RANK}) filter (where ({_RANK}) is not null), arg_min(level, ord) filter (where level <> ''), 'desconocido') as level, bool_or(g) as has_guideline, min(ord) as first_ord from b group by all)
 select drug, strength, gene, level, pairs, contexts, has_guideline, row_number() over (partition by drug, strength order by coalesce({_RANK}, 99), first_ord)::int as position from k join c using (drug, strength, gene)""")
def gene_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04, TOP-05."""
    pairs = F.array_join(F.transform("pairs", lambda x: F.concat(x["allele"], F.lit(" "), x["phenotype"])), ",")
    return pgx.consolidate(_annotations(spark, sf_dir)).select("drug", "strength", "gene", "level", pairs.alias("pairs"), F.array_join("contexts", ",").alias("contexts"), "has_guideline", "position")


@query(f"""with a as (select p_size as drug, p_partkey as ord, case when p_size % 2 = 0 then '3' else case {_LEVEL_CASE} when '1A' then '3' when '1B' then '3a' when '4' then '1A' else {_LEVEL_CASE} end end as level, case when p_brand = 'Brand#1' then '?' else p_brand end as gene from part),
 m as (select *, bool_or(level in ('1A', '1B', '2A', '2B')) over (partition by drug) as high from a)
 select drug, ord from m where level in ('1A', '1B', '2A', '2B') union all
 select drug, ord from (select * from m where not high and starts_with(level, '3') qualify row_number() over (partition by drug, gene order by ord) = 1) qualify row_number() over (partition by drug order by ord) <= 2""")
def first_per_group_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-04: even sizes have level-3 annotations only."""
    rows = _annotations(spark, sf_dir)
    level = F.when(F.col("drug") % 2 == 0, "3").when(F.col("level") == "1A", "3").when(F.col("level") == "1B", "3a").when(F.col("level") == "4", "1A").otherwise(F.col("level"))
    return pgx.fallback(rows.withColumn("level", level)).select("drug", "ord")


@query("""with c as (select distinct l_orderkey as case_id, p_brand as inn, min(l_linenumber) over (partition by l_orderkey, p_brand) as pos from lineitem join part on l_partkey = p_partkey),
 i as (select p_brand as inn, 'BRAND#' || (p_size % 25) as name, min(p_partkey) as int_pos, min(p_name) as description from part group by 1, 2),
 h as (select a.case_id, a.inn as drug1, b.inn as drug2, i.description, a.pos, i.int_pos from c a join i using (inn) join c b on a.case_id = b.case_id and lower(i.name) = lower(b.inn) where a.inn <> b.inn)
 select case_id, drug1, drug2, description from h qualify row_number() over (partition by case_id, least(drug1, drug2), greatest(drug1, drug2) order by pos, int_pos) = 1""")
def pair_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-10: orders as cases of several brands."""
    part = table(spark, sf_dir, "part")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    cases = lines.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy(F.col("l_orderkey").alias("case_id"), F.col("p_brand").alias("inn")).agg(F.min("l_linenumber").alias("pos"))
    known = part.groupBy(F.col("p_brand").alias("inn"), F.concat(F.lit("BRAND#"), (F.col("p_size") % 25).cast("string")).alias("name")).agg(F.min("p_partkey").alias("int_pos"), F.min("p_name").alias("description"))
    return drugs.direct_interactions(cases, known)


@query("""with v as (select n_regionkey as r, list(n_name order by n_nationkey)[1:(n_regionkey % 4) + 1] as a from nation group by 1),
 f as (select r, a, unnest(range(1, len(a) + 1)) as i from v),
 x as (select r, a as c, 0 as o from v union all select r, list_filter(a, lambda n: n <> a[i]), i from f where len(a) > 2
 union all select f.r, [f.a[f.i], f.a[g.i]], 1000 * f.i + g.i from f join f g on f.r = g.r and f.i < g.i where len(f.a) > 2)
 select r, array_to_string(c, ' AND ') as label, len(c)::int as n from x qualify row_number() over (partition by r, array_to_string(list_sort(c), '|') order by o) = 1""")
def drug_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-04: nations of a region as a list of drugs."""
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("a"))
    rows = rows.select("r", F.slice("a", 1, F.col("r") % 4 + 1).alias("a"))
    return rows.select("r", F.explode(combinations(F.col("a"))).alias("c")).select("r", F.array_join("c", " AND ").alias("label"), F.size("c").alias("n"))


@query("""with t as (select doc_id // 10 as case_id, doc_id % 10 as i, case doc_id % 3 when 0 then 'thing' when 1 then 'étion' else 'ción' end as inn, 'n' || (doc_id % 10) as name, text from documents where text is not null)
 select a.case_id, a.name as source, b.name as mentioned, strpos(lower(a.text), b.inn) as at, (case when strpos(lower(a.text), b.inn) > 81 then '…' else '' end) || regexp_replace(substr(a.text, greatest(strpos(lower(a.text), b.inn) - 80, 1), least(strpos(lower(a.text), b.inn) + length(b.inn) + 119, length(a.text)) - greatest(strpos(lower(a.text), b.inn) - 80, 1) + 1), '^\\s+|\\s+$', '', 'g') || (case when strpos(lower(a.text), b.inn) + length(b.inn) + 119 < length(a.text) then '…' else '' end) as snippet from t a join t b on a.case_id = b.case_id and a.i <> b.i where contains(lower(a.text), b.inn)""")
def cross_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-12: ten documents as the texts of a case's drugs."""
    n = F.col("doc_id") % 3
    inn = F.when(n == 0, "thing").when(n == 1, "étion").otherwise("ción")
    name = F.concat(F.lit("n"), (F.col("doc_id") % 10).cast("string"))
    texts = table(spark, sf_dir, "documents").where("text is not null").select(F.floor(F.col("doc_id") / 10).alias("case_id"), (F.col("doc_id") % 10).alias("i"), inn.alias("inn"), name.alias("name"), "text")
    return drugs.cross_mentions(texts).select("case_id", "source", "mentioned", F.col("at").cast("long").alias("at"), "snippet")


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def anti_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-17, JOIN-18: what isn't there yet."""
    from vigilake.sources.sinks import not_yet_there

    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("filename"))
    return not_yet_there(links, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("filename"))).select(F.col("filename").alias("o_orderkey"))


@query("select event_type as outcome, count(*) as n from events group by 1")
def outcome_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-08."""
    from vigilake.sources.sinks import download_counters

    return download_counters(table(spark, sf_dir, "events").select(F.col("event_type").alias("outcome")))


@query("select k, 'both' as kind from (select p_partkey as k from part intersect select s_suppkey from supplier) union all select k, 'part only' from (select p_partkey as k from part except select s_suppkey from supplier)")
def union_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    both = part.join(supplier, "k", "left_semi").distinct().withColumn("kind", F.lit("both"))
    return both.unionByName(part.join(supplier, "k", "left_anti").distinct().withColumn("kind", F.lit("part only")))


#: Written out here, so that the SQL doesn't take them from what it checks.
_TITLES = {k: (c, None) for k, c in (("CIMA", "cima_raw"), ("FDA FAERS", "fda_raw"), ("PubMed", "pubmed_raw"), ("PathwayCommons", "pathway_commons_raw"), ("PharmGKB", "pharmgkb_raw"), ("DrugBank", "drugbank_raw"), ("PRAC/EMA", "prac_raw"))}
_CARD_CASE = " ".join(f"when {i} then '{k}'" for i, k in enumerate(_TITLES))
_ID_CASE = " ".join(f"when {i} then '{c}'" for i, (c, _) in enumerate(_TITLES.values()))


@query(f"""select o_orderkey as case_id, case o_orderkey % 7 {_CARD_CASE} end as source, case o_orderkey % 7 {_ID_CASE} end as card_id, case when o_orderstatus = 'F' then 'error' else 'ok' end as state,
 case when o_orderstatus = 'F' and o_orderkey % 2 = 0 then 'Sin respuesta (timeout)' when o_orderstatus = 'F' then 'Error: ' || o_orderpriority else o_orderpriority end as text from orders""")
def source_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RND-05, STM-02: orders as answers of sources, some failed."""
    which = F.lit(None).cast("string")
    for i, k in enumerate(_TITLES):
        which = F.when(F.col("o_orderkey") % 7 == i, k).otherwise(which)
    status = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 2 == 0), "timeout").when(F.col("o_orderstatus") == "F", "error").otherwise("ok")
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), which.alias("source"), status.alias("status"), F.col("o_orderpriority").alias("text"))
    return reports.cards(found).select("case_id", "source", "card_id", "state", F.get_json_object("content", "$.texto").alias("text"))


@query("select event_type, count(*) as n, round(sum(value), 2) as value from events group by 1")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-04: the events file through an incremental stream, then counted."""
    from vigilake.streaming.ingest import new_files

    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for _ in range(2):  # the second run finds nothing new
        new_files(spark, sf_dir, f"{base}/out", f"{base}/checkpoint", lambda s: s.select("event_id", "event_type", "value"), schema, "events.parquet", "parquet")
    return spark.read.schema("event_id long, event_type string, value double").parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
