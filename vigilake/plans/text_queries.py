
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions import text as T
from vigilake.functions.arrays import pacing
from vigilake.functions.json import parse_cascade
from vigilake.operators import judge, reports, signals, terms
from vigilake.plans.registry import query
from vigilake.session import ship, table
from vigilake.sources.readers import pdf_links

TERMS = ["thing", "of the", "étion", "für", "ción", "ereau", "zu der", "the and"]
_VALUES = ", ".join(f"('{t}')" for t in TERMS)
_EDGE = r"[^\p{L}\p{N}_]"
_HIT = rf"""(regexp_matches(d.text, '(?i)(^|{_EDGE})' || replace(t.term, ' ', '\s+') || '($|{_EDGE})')
 or regexp_matches(strip_accents(lower(d.text)), '(^|{_EDGE})' || strip_accents(lower(t.term)) || '($|{_EDGE})'))"""


@query(f"select distinct d.doc_id from documents d, (values {_VALUES}) t(term) where {_HIT}")
def term_contains_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01, FLT-02."""
    return table(spark, sf_dir, "documents").where(T.contains_any(F.col("text"), TERMS)).select("doc_id")


@query(f"select d.doc_id, t.term from documents d, (values {_VALUES}) t(term) where {_HIT}")
def term_matching_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03 as rows."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.matching_terms(F.col("text"), TERMS)).alias("term"))


@query(f"select t.term, count(distinct d.doc_id) as n_docs from documents d, (values {_VALUES}) t(term) where {_HIT} group by t.term")
def term_doc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-11: the flagship query."""
    return terms.term_counts(terms.match_terms(table(spark, sf_dir, "documents"), TERMS))


@query(f"select d.doc_id, t.term from documents d, (values {_VALUES}) t(term) where {_HIT}")
def term_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-11 for a table of terms: candidates by first word, then the exact predicate."""
    return terms.match_terms(table(spark, sf_dir, "documents"), spark.createDataFrame([(t,) for t in TERMS], "term string"))


@query("select doc_id, length(strip_accents(lower(text))) as n_folded from documents where contains(strip_accents(lower(text)), 'etion')")
def accent_fold_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01."""
    folded = T.unaccent(F.lower("text"))
    return table(spark, sf_dir, "documents").where(folded.contains("etion")).select("doc_id", F.length(folded).cast("long").alias("n_folded"))


@query(r"""select doc_id, length(regexp_replace(strip_accents(lower(text)), '[^\x00-\x7F]', '', 'g')) as n_ascii from documents
 where contains(regexp_replace(strip_accents(lower(text)), '[^\x00-\x7F]', '', 'g'), 'fur ')""")
def ascii_fold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-02, STR-13."""
    folded = T.ascii_fold(F.col("text"))
    return table(spark, sf_dir, "documents").where(folded.contains(T.ascii_fold(F.lit("FÜR ")))).select("doc_id", F.length(folded).cast("long").alias("n_ascii"))


FRAGMENT_TERMS = ["thing", "étion", "ción"]
_FRAGMENT_HIT = " or ".join(rf"regexp_matches(x, '(?i)(^|{_EDGE}){t}($|{_EDGE})') or regexp_matches(strip_accents(lower(x)), '(^|{_EDGE}){plain}($|{_EDGE})')" for t, plain in (("thing", "thing"), ("étion", "etion"), ("ción", "cion")))


@query(rf"""select doc_id, regexp_replace(coalesce(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_FRAGMENT_HIT})[1], ''), '^\s+|\s+$', '', 'g') as fragment from documents""")
def first_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-04."""
    return table(spark, sf_dir, "documents").select("doc_id", T.first_fragment(F.col("text"), FRAGMENT_TERMS).alias("fragment"))


@query(r"""with s as (select doc_id, string_split(regexp_replace(coalesce(text, '') || chr(10) || '4.1. ' || lang || chr(10) || '4.1.2 ' || source || chr(10) || '4.2 end', '(^|\n)(4\.\d+(\.\d+)*\.?\s)', chr(1) || '\1\2', 'g'), chr(1)) as p from documents),
 u as (select doc_id, regexp_replace(unnest(p), '^\s+|\s+$', '', 'g') as part from s)
 select doc_id, md5(part) as part_md5, length(part) as n_chars from u where part <> ''""")
def subsection_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-05 on texts with headings appended."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n4.1. "), F.col("lang"), F.lit("\n4.1.2 "), F.col("source"), F.lit("\n4.2 end"))
    parts = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.subsections(text)).alias("part"))
    return parts.select("doc_id", F.md5("part").alias("part_md5"), F.length("part").cast("long").alias("n_chars"))


@query(r"""select doc_id, regexp_replace(regexp_extract_all(regexp_replace('Contents 4. Signals assessment and prioritisation 3' || chr(10) || '5. Risk Management 9' || chr(10) || text || chr(10) || chr(10) || chr(10) || chr(10) || '4. Signal assessment and prioritization' || chr(10) || lang || ' ' || source || chr(10) || ' 5. Pharmacovigilance inspections', '\n{3,}', chr(10) || chr(10), 'g'),
 '(?im)4[\.\s]+Signals?\s+assessment\s+and\s+prioriti[sz]ation\w*([\s\S]*?)(^\s*5[\.\s]+Risk\s+Management|^\s*5[\.\s]+Pharmacovigilance|^\s*6[\.\s]|\z)', 1)[-1], '^\s+|\s+$', '', 'g') as section from documents where text is not null""")
def last_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-08, TOP-09: the section itself, not its line in the contents."""
    text = F.concat(F.lit("Contents 4. Signals assessment and prioritisation 3\n5. Risk Management 9\n"), F.col("text"), F.lit("\n\n\n\n4. Signal assessment and prioritization\n"), F.col("lang"), F.lit(" "), F.col("source"), F.lit("\n 5. Pharmacovigilance inspections"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.strip(T.last_section(text)).alias("section"))


@query(r"""with a as (select doc_id, regexp_replace(regexp_replace(regexp_replace('  a —– b' || chr(13) || chr(10) || text || '  ' || chr(10) || chr(10) || chr(10) || chr(10) || 'z' || chr(7) || ' ', '\r\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g') as t from documents where text is not null),
 b as (select doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '\s+$', '')), chr(10)) as t from a)
 select doc_id, md5(c) as clean_md5, length(c) as n_chars from (select doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[-–—]+', '-', 'g'), '[\x00-\x08\x0b-\x1f]', '', 'g'), '^\s+|\s+$', '', 'g') as c from b)""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-09."""
    text = T.clean(F.concat(F.lit("  a —– b\r\n"), F.col("text"), F.lit("  \n\n\n\nz\x07 ")))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(text).alias("clean_md5"), F.length(text).cast("long").alias("n_chars"))


@query("""with s as (select doc_id, text, strpos(lower(text), 'thing') as p from documents where contains(lower(text), 'thing'))
 select doc_id, (case when p - 80 > 1 then '…' else '' end) || regexp_replace(substr(text, greatest(p - 80, 1), least(p + 4 + 120, length(text)) - greatest(p - 80, 1) + 1), '^\\s+|\\s+$', '', 'g')
 || (case when p + 4 + 120 < length(text) then '…' else '' end) as snippet from s""")
def context_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-10."""
    return table(spark, sf_dir, "documents").where(T.mentions(F.col("text"), "thing")).select("doc_id", T.snippet(F.col("text"), "thing").alias("snippet"))


@query("""with x as (select doc_id, lower(regexp_replace(case doc_id % 4 when 0 then '  ' when 1 then ' No Disponible: ' || text when 2 then 'ERROR al consultar ' || source else text end, '^\\s+|\\s+$', '', 'g')) as t from documents)
 select doc_id, (t = '' or starts_with(t, 'no disponible') or starts_with(t, 'error al consultar')) as no_info from x""".replace("\\\\", "\\"))
def no_info_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-14 on texts made to have none, blank, and real information."""
    n = F.col("doc_id") % 4
    text = F.when(n == 0, "  ").when(n == 1, F.concat(F.lit(" No Disponible: "), F.col("text"))).when(n == 2, F.concat(F.lit("ERROR al consultar "), F.col("source"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.is_no_info(text).alias("no_info"))


_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_NAME = "'minutes-prac-meeting-' || (1 + doc_id % 9) || '-' || (10 + doc_id % 9) || '-march-' || (2000 + doc_id % 25) || '_en.pdf'"


@query(rf"""with h as (select doc_id, substr(case doc_id % 3 when 0 then 'Meeting of ' || (1 + doc_id % 9) || '-' || (10 + doc_id % 9) || ' February 2025. ' when 1 then 'As of March 2024, ' else '' end || coalesce(text, ''), 1, 500) as t, {_NAME} as name from documents)
 select doc_id, coalesce(nullif(regexp_extract(t, '(?i)\b(\d{{1,2}}(\s*[-–to]+\s*\d{{1,2}})?\s+({_MONTHS})\s+\d{{4}})\b', 1), ''), nullif(regexp_extract(t, '(?i)\b(({_MONTHS})\s+\d{{4}})\b', 1), ''),
 (1 + doc_id % 9) || ' ' || (10 + doc_id % 9) || ' March ' || (2000 + doc_id % 25)) as date from h""")
def date_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-01 on texts with a dated head, a month, or only a dated file name."""
    a, b, y = ((F.lit(o) + F.col("doc_id") % m).cast("string") for o, m in ((1, 9), (10, 9), (2000, 25)))
    n = F.col("doc_id") % 3
    head = F.when(n == 0, F.concat(F.lit("Meeting of "), a, F.lit("-"), b, F.lit(" February 2025. "))).when(n == 1, "As of March 2024, ").otherwise("")
    name = F.concat(F.lit("minutes-prac-meeting-"), a, F.lit("-"), b, F.lit("-march-"), y, F.lit("_en.pdf"))
    return table(spark, sf_dir, "documents").select("doc_id", T.find_date(F.concat(head, F.coalesce("text", F.lit(""))), name).alias("date"))


@query(r"""select page_id, href, regexp_replace(href, '^.*/', '') as name from (select page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref\s*=\s*["'']([^"'']+)["'']', 1)) as href from pages)""")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-17, SNK-07 (all links; the corpus has no minutes)."""
    links = pdf_links(table(spark, sf_dir, "pages").select("page_id", "html"), suffix="", prefixes=())
    return links.select("page_id", "href", T.file_name(F.col("href")).alias("name"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-01, JSN-02: answers with fences and talk around their JSON."""
    n = F.col("event_id") % 3
    raw = F.when(n == 0, F.col("props")).when(n == 1, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" done.")))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(parse_cascade(raw), "$.k", "bigint").alias("k"))


@query("""with recursive o as (select user_id, event_type = 'error' as hit, row_number() over (partition by user_id order by ts, event_id) as n from events),
 f as (select user_id, n, case when hit then least(1.0::double * 2, 8) else greatest(1.0::double * 0.85, 1) end as w from o where n = 1
 union all select o.user_id, o.n, case when o.hit then least(f.w * 2, 8) else greatest(f.w * 0.85, 1) end from f join o on o.user_id = f.user_id and o.n = f.n + 1)
 select user_id, round(arg_max(w, n), 6) as wait from f group by user_id""")
def pacing_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-06: the wait of each user after their events, errors as refusals."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", (F.col("event_type") == "error").alias("hit")))).alias("x"))
    return rows.select("user_id", F.round(pacing(F.transform("x", lambda e: e["hit"])), 6).alias("wait"))


@query("select conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) order by turn, role) as history, count(*) as n_turns from conversations group by conv_id")
def chat_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RND-12."""
    return reports.chat_history(table(spark, sf_dir, "conversations")).select("conv_id", "history", "n_turns")


@query(rf"""select d.doc_id, coalesce(regexp_matches(d.text, '(?i)(^|{_EDGE})thing($|{_EDGE})') or regexp_matches(strip_accents(lower(d.text)), '(^|{_EDGE})thing($|{_EDGE})'), false) or coalesce(l.toxic = 1, false) as present
 from documents d left join labels l using (doc_id)""")
def judge_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-04: a judge (here: reading the label in its prompt) sees only what the direct match does not settle."""
    ship(spark)
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    rows = docs.select("doc_id", F.coalesce(T.contains_any(F.col("text"), ["thing"]), F.lit(False)).alias("direct"), F.coalesce(F.col("toxic").cast("string"), F.lit("")).alias("prompt"))
    return judge.gated(rows, "direct", judge=label_judge).select("doc_id", "present")


def label_judge(prompts: list[str]) -> list[str]:
    return [f'Answer: {{"ram_presente": {str(p == "1").lower()}, "fragmento": ""}}' for p in prompts]


@query(rf"""with d as (select doc_id, source, lang, text from documents where contains(lower(text), 'thing'))
 select 'f' || doc_id as filename, coalesce(nullif(lang, ''), 'sin fecha') as date, source, regexp_matches(text, '(?i)(^|{_EDGE})of\s+the($|{_EDGE})') as with_reaction, 1 as n_fragments from d""")
def signal_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename"), F.col("lang").alias("date"), "source", F.col("text").alias("section4"))
    return signals.evidence(docs, "thing", ["of the"], judged=False).select("filename", "date", "source", "with_reaction", "n_fragments")


@query("select count(*) filter (where text is not null and length(text) >= 200) as n_ok, count(*) filter (where length(text) < 200) as n_not_found, count(*) filter (where text is null) as n_read_error, coalesce(sum(n_chars), 0)::bigint as chars from documents")
def status_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07."""
    from vigilake.sources.sinks import run_statistics

    status = F.when(F.col("text").isNull(), "read_error").when(F.length("text") < 200, "not_found").otherwise("ok")
    return run_statistics(table(spark, sf_dir, "documents").select(status.alias("status"), F.col("n_chars").alias("chars")))
