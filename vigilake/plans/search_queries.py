
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions.json import report_object
from vigilake.operators import article_search, drugs, literature, name_search, signals
from vigilake.plans.registry import query
from vigilake.session import table

_EDGE = r"[^\p{L}\p{N}_]"
_CUT = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]+')"


@query(rf"""with d as (select doc_id, {_CUT} as w from documents where text is not null), b as (select item_id, {_CUT} as w from benchmark),
 t as (select doc_id, len(w) as n, unnest(w) as word, generate_subscripts(w, 1) as pos from d),
 g as (select distinct * from (select item_id, 0 as part, w[1] || ' ' || w[2] as phrase from b union all select item_id, 1, w[3] from b union all select item_id, 1, w[4] from b union all select item_id, 2, w[5] from b union all select item_id, 2, w[6] || ' ' || w[7] from b)),
 s as (select phrase, len(ws) as size, unnest(ws) as word, generate_subscripts(ws, 1) as nth from (select distinct phrase, string_split(phrase, ' ') as ws from g)),
 o as (select phrase, doc_id, n, pos - nth as start from t join s using (word) group by phrase, size, doc_id, n, pos - nth having count(distinct nth) = size),
 f as (select phrase, doc_id, n, count(*) as tf from o group by all), x as (select phrase, count(*) as df from f group by all),
 c as (select count(*)::double as n_docs, sum(len(w)) / count(*) as mean from d where len(w) > 0),
 m as (select item_id, doc_id from g join f using (phrase) group by all having count(distinct part) = 3),
 r as (select m.item_id, m.doc_id, sum(round(1000 * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))))::bigint as score
 from m join (select distinct item_id, phrase from g) q on q.item_id = m.item_id join f on f.phrase = q.phrase and f.doc_id = m.doc_id join x on x.phrase = q.phrase, c group by all)
 select b.item_id, p.place, p.doc_id, p.score, coalesce(y.total, 0) as total from b left join (select item_id, count(*) as total from r group by 1) y using (item_id)
 left join (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as place from r qualify place <= 2) p using (item_id)""")
def literature_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-09: documents as articles; each benchmark item asks for its first two words as a phrase and for one of each of two groups of its next ones."""
    items = table(spark, sf_dir, "benchmark").select("item_id", article_search.words(F.col("text")).alias("w"))
    word = lambda i: F.get("w", F.lit(i))
    groups = F.array(F.array(F.concat_ws(" ", word(0), word(1))), F.array(word(2), word(3)), F.array(word(4), F.concat_ws(" ", word(5), word(6))))
    asked = items.select("item_id", groups.alias("groups"))
    docs = table(spark, sf_dir, "documents")
    hits, totals = article_search.search(docs, asked, literature.FOUND, "doc_id", "text", "item_id")
    return totals.join(hits, "item_id", "left").select("item_id", "place", "doc_id", "score", "total")


_PARTS = r"list_filter(list_transform(string_split(regexp_replace(s4, '(^|\n)(4\.\d+(\.\d+)*\.?\s)', chr(1) || '\1\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@query(rf"""with b as (select item_id, {_CUT} as w from benchmark), c as (select item_id as case_id, w[5] || ' ' || w[6] as drug, w[7] as t1, w[8] || ' ' || w[9] as t2 from b where len(w) >= 9),
 d as (select doc_id, '4.1. ' || substr(text, 1, length(text) // 2) || chr(10) || '4.1.2 ' || substr(text, length(text) // 2 + 1) || chr(10) || '4.2 end' as s4 from documents where text is not null),
 m as (select case_id, t1, t2, drug, doc_id, s4 from c join d on contains(lower(s4), drug)),
 p as (select case_id, doc_id, t1, t2, drug, unnest(ps) as part, generate_subscripts(ps, 1) as pos from (select *, {_PARTS} as ps from m)),
 h as (select *, {' , '.join(rf"regexp_matches(strip_accents(lower(part)), '(^|{_EDGE})' || {t} || '($|{_EDGE})') or regexp_matches(part, '(?i)(^|{_EDGE})' || replace({t}, ' ', '\s+') || '($|{_EDGE})') as h{i}" for i, t in enumerate(("t1", "t2"), 1))} from p where contains(lower(part), drug)),
 a as (select case_id, doc_id, bool_or(h1 or h2) as with_reaction, count(*) filter (where h1 or h2) as n_hit, count(*) as n_all, bool_or(h1) as any1, bool_or(h2) as any2, string_agg(case when h1 and (t1 <> t2) or h1 then '1' else '' end || case when h2 then '2' else '' end, '' order by pos) as seen, any_value(t1) as u1, any_value(t2) as u2 from h group by all)
 select m.case_id, 'f' || m.doc_id as filename, coalesce(with_reaction, false) as with_reaction, coalesce(case when with_reaction then n_hit else n_all end, 0)::int as n_fragments,
 case when not coalesce(with_reaction, false) then '' when any1 and any2 then case when seen like '2%' then u2 || ', ' || u1 else u1 || ', ' || u2 end when any1 then u1 else u2 end as terms from m left join a using (case_id, doc_id)""")
def minutes_of_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-03, JOIN-11, AGG-06 for a table of cases: documents with headings as minutes; two words of a benchmark item are its drug, the next its terms."""
    items = table(spark, sf_dir, "benchmark").select("item_id", article_search.words(F.col("text")).alias("w")).where(F.size("w") >= 9)
    word = lambda i: F.get("w", F.lit(i))
    cases = items.select(F.col("item_id").alias("case_id"), F.concat_ws(" ", word(4), word(5)).alias("inn"), F.array(word(6), F.concat_ws(" ", word(7), word(8))).alias("terms"))
    half = F.floor(F.length("text") / 2).cast("int")
    section = F.concat(F.lit("4.1. "), F.substr("text", F.lit(1), half), F.lit("\n4.1.2 "), F.substr("text", half + 1), F.lit("\n4.2 end"))
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename"), F.lit("d").alias("date"), F.lit("minutes").alias("source"), section.alias("section4"))
    return signals.evidence_of_cases(docs, cases, judged=False).select("case_id", "filename", "with_reaction", "n_fragments", "terms")


_ASKED = "select distinct q from (select substr(p_name, 1 + p_partkey % 4, 2 + p_partkey % 6) as q from part union all select (p_partkey % 100)::varchar from part)"


@query(f"""with a as (select distinct trim(q) as q from ({_ASKED}) where length(trim(q)) >= 2),
 n as (select p_partkey::varchar as code, p_name as name_en, p_type as name_es, 'PT' as type, p_partkey as ord, 0 as t, '' as pt_name_en from part
 union all select 'S' || s_suppkey, s_name, 'prov. ' || s_nationkey, 'LLT', s_suppkey, 2, coalesce((select p_name from part where p_partkey = s_suppkey), '') from supplier),
 h as (select q, code, type, ord, t, pt_name_en from a join n on regexp_matches(q, '^[0-9]+$') and starts_with(code, q)
 union all select q, code, type, ord, t, pt_name_en from a join n on not regexp_matches(q, '^[0-9]+$') and contains(lower(name_en), lower(q))
 union all select q, code, type, ord, t + 1, pt_name_en from a join n on not regexp_matches(q, '^[0-9]+$') and contains(lower(name_es), lower(q))),
 f as (select q, code, type, min(t) as tier, ord, pt_name_en from h group by all)
 select q as query, code, type, tier, case when type = 'LLT' then pt_name_en end as pt_name_en, row_number() over (partition by q order by tier, ord, code)::int as place from f qualify place <= 15""")
def term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-01 for a table of queries: pieces of part names and numbers, searched in parts (preferred) and suppliers (lower terms)."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    pieces = F.substr("p_name", (F.col("p_partkey") % 4 + 1).cast("int"), (F.col("p_partkey") % 6 + 2).cast("int"))
    asked = part.select(pieces.alias("query")).union(part.select((F.col("p_partkey") % 100).cast("string")))
    pt = part.select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name_en"), F.col("p_type").alias("name_es"), F.col("p_partkey").alias("ord"))
    llt = supplier.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("code"), F.col("s_name").alias("name_en"), F.concat(F.lit("prov. "), F.col("s_nationkey").cast("string")).alias("name_es"), F.col("s_suppkey").cast("string").alias("pt_code"), F.col("s_suppkey").alias("ord"))
    return name_search.search_terms(asked, pt, llt, 15).select("query", "code", "type", "tier", "pt_name_en", "place")


@query("""with n as (select lower(trim(p_name || ' ' || p_type || ' ' || p_brand)) as key, min(p_partkey) as rank from part group by 1),
 a as (select distinct substr(k, 1, c - 1) || substr(k, c + 1) || case when p_partkey % 3 = 0 then 'x' when p_partkey % 3 = 1 then '' else 'yz' end as q from (select p_partkey, p_name || ' ' || p_type || ' ' || p_brand as k, 1 + p_partkey % 11 as c from part)),
 f as (select q, key, rank, levenshtein(lower(trim(q)), key) as distance from a join n on abs(length(trim(q)) - length(key)) <= 2 where levenshtein(lower(trim(q)), key) <= 2)
 select q as query, key as name, distance::int as distance, row_number() over (partition by q order by distance, rank, key)::int as place from f qualify place <= 3""")
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-16 with spelling: part names with a letter left out and others added, against all part names."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name"))
    at = (F.col("p_partkey") % 11 + 1).cast("int")
    end = F.when(F.col("p_partkey") % 3 == 0, "x").when(F.col("p_partkey") % 3 == 1, "").otherwise("yz")
    asked = part.select(F.concat(F.substr("name", F.lit(1), at - 1), F.substr("name", at + 1), end).alias("query"))
    return name_search.similar_names(asked, part, 2, 3, rank="p_partkey").select("query", F.lower("name").alias("name"), "distance", "place")


@query("""with s as (select distinct p_name as query, first_value(p_type) over (partition by p_name order by p_partkey) as hint from part where p_brand < 'Brand#2'),
 q as (select distinct p_name as query from part), r as (select p_type as name, lower(p_type) as inn, min(p_partkey)::varchar as rxcui from part where p_type <> 'PROMO' group by 1, 2 union all select p_name, upper(p_name), min(p_partkey)::varchar from part where p_size < 20 group by 1, 2),
 n as (select q.query, coalesce(s.hint, q.query) as name_en from q left join s using (query))
 select n.query, n.name_en, coalesce(a.inn, b.inn) as inn, coalesce(a.rxcui, b.rxcui) as rxcui from n left join r a on a.name = n.name_en left join r b on b.name = n.query where coalesce(a.inn, b.inn) is not null""")
def suggested_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-15: part names as queries, their types as suggestions; some have none, and some suggestions aren't known."""
    part = table(spark, sf_dir, "part")
    hints = part.where("p_brand < 'Brand#2'").groupBy(F.col("p_name").alias("query")).agg(F.min_by("p_type", "p_partkey").alias("suggestion"))
    known = part.where("p_type <> 'PROMO'").groupBy(F.col("p_type").alias("name"), F.lower("p_type").alias("inn")).agg(F.min("p_partkey").cast("string").alias("rxcui"))
    known = known.union(part.where("p_size < 20").groupBy("p_name", F.upper("p_name")).agg(F.min("p_partkey").cast("string")))
    return drugs.suggested(part.select(F.col("p_name").alias("query")), hints, known).select("query", "name_en", "inn", "rxcui")


@query("select distinct l_orderkey as case_id, l_partkey::varchar as pmid from lineitem")
def distinct_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11: parts as articles that orders show."""
    return literature.distinct_ids(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").cast("string").alias("pmid")))


@query("""select doc_id, case when doc_id % 3 = 0 then lang when doc_id % 3 = 1 then null else null end as lang,
 case when doc_id % 3 = 0 then null else case when doc_id % 3 = 1 then 'no object: ' || source else '{broken ' || source || '}' end end as resumen from documents""")
def report_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-03: answers with an object inside talk, without one, and with a broken one."""
    n = F.col("doc_id") % 3
    raw = F.when(n == 0, F.concat(F.lit('Here: {"lang": "'), "lang", F.lit('"} thanks'))).when(n == 1, F.concat(F.lit("no object: "), "source")).otherwise(F.concat(F.lit("{broken "), "source", F.lit("}")))
    value = report_object(raw)
    return table(spark, sf_dir, "documents").select("doc_id", *(F.try_variant_get(value, f"$.{k}", "string").alias(k) for k in ("lang", "resumen")))
