
from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions.text import S, strip
from vigilake.session import ship

TERMS = "code string, name string, parent string, c3 string, parent_name string"

NAMED = "array<struct<name:string,gene_symbol:string,actions:array<string>>>"
#: Value schemas of the drug dictionaries, which are objects keyed by name or id (SRC-06).
DRUG_FILES = {
    "lookup": "struct<drugbank_id:string,inn:string>",
    "profiles": f"struct<inn:string,drugbank_id:string,mechanism:string,pharmacodynamics:string,targets:{NAMED},enzymes:{NAMED},transporters:{NAMED},pathways:array<struct<name:string,smpdb_id:string>>,toxicity:string>",
    "interactions": "array<struct<drugbank_id:string,name:string,description:string>>",
    "targets": "array<struct<name:string,organism:string,actions:array<string>,gene_symbol:string,uniprot_id:string>>",
    "pgx": "struct<snp_effects:array<struct<gene:string,rs_id:string,description:string>>,snp_adrs:array<struct<gene:string,rs_id:string,adverse_reaction:string>>>",
}
SIGNALS = "filename string, source string, date string, section4 string, status string, chars int"
ARTICLE = "pmid string, title string, abstract string"
ANNOTATION = "struct<levelOfEvidence:struct<term:string>,location:struct<genes:array<struct<symbol:string>>>,allelePhenotypes:array<struct<allele:string,phenotype:string,limitedEvidence:boolean>>,relatedDiseases:array<struct<name:string>>,relatedGuidelines:array<string>,relatedLabels:array<string>,types:array<string>>"
CONTROL = "struct<searchHit:array<struct<name:string,uri:string,biopaxClass:string,dataSource:array<string>>>>"


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, asked of the file system that Spark itself would use."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def terminology(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: $-divided Latin-1 lines without quoting; blank lines are skipped; ord is the line's order."""
    raw = spark.read.schema(TERMS).option("sep", "$").option("encoding", "ISO-8859-1").option("quote", "").option("mode", "PERMISSIVE").csv(path)
    return raw.where(F.col("code").isNotNull()).withColumn("ord", F.monotonically_increasing_id())


def preferred_names(rows: DataFrame) -> DataFrame:
    """SRC-02: code, name; of repeated codes the last line wins."""
    return rows.where(F.col("name").isNotNull()).groupBy("code").agg(F.max_by("name", "ord").alias("name"), F.min("ord").alias("ord"))


def lower_terms(rows: DataFrame) -> DataFrame:
    """SRC-03: code, name, pt_code; of repeated codes the last line wins."""
    last = F.max_by(F.struct("name", "parent"), "ord")
    return rows.where(F.col("parent").isNotNull()).groupBy("code").agg(last.alias("x"), F.min("ord").alias("ord")).select("code", F.col("x.name").alias("name"), F.col("x.parent").alias("pt_code"), "ord")


def hierarchy(rows: DataFrame) -> DataFrame:
    """SRC-04: pt_code, pt_name; of repeated codes the first line wins."""
    return rows.where(F.col("parent_name").isNotNull()).groupBy(F.col("code").alias("pt_code")).agg(F.min_by("parent_name", "ord").alias("pt_name"))


def terms_of_preferred(llt: DataFrame) -> DataFrame:
    """SRC-05: pt_code, codes: the lower terms' codes in file order."""
    return llt.groupBy("pt_code").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "code"))), lambda x: x["code"]).alias("codes"))


def drug_file(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """SRC-06: key, value of one of DRUG_FILES; a table of drug_table(), or the source's one JSON object (a single task reads it)."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"key string, value {DRUG_FILES[kind]}")
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(f"key string, value {DRUG_FILES[kind]}").parquet(path)
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{DRUG_FILES[kind]}>")))


def drug_table(spark: SparkSession, path: str, kind: str, target: str) -> DataFrame:
    """SRC-06: the dictionary written once as Parquet (target ends in .parquet), which all tasks can read in parts."""
    drug_file(spark, path, kind).repartition("key").write.mode("overwrite").parquet(target)
    return drug_file(spark, target, kind)


#: Fixed value: what a card says if no minutes were extracted yet.
NO_SIGNALS = "Datos PRAC/EMA no disponibles."


def signals(spark: SparkSession, path: str) -> DataFrame:
    """SRC-07: minutes that were extracted before; one row with status not_available if there are none yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([(None, None, None, NO_SIGNALS, "not_available", 0)], SIGNALS)
    return spark.read.schema(SIGNALS).json(path, multiLine=True)


_kept: OrderedDict[tuple[str, str], DataFrame] = OrderedDict()
#: Fixed value: lookup tables that are kept (STM-09).
KEPT = 256


def kept(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """STM-09: a lookup table that is made and cached once for an application and used again by later calls; the one not used for longest goes when there are more than KEPT."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _kept:
        _kept[key] = make().persist()
    _kept.move_to_end(key)
    while len(_kept) > KEPT:
        (application, _), old = _kept.popitem(last=False)
        if application == key[0]:
            old.unpersist()
    return _kept[key]


def report_counts_of(answers: DataFrame, body: str = "body") -> DataFrame:
    """SRC-08: total of a count answer (null for an answer without one, such as 404)."""
    return answers.withColumn("total", F.from_json(F.col(body), "meta struct<results:struct<total:bigint>>")["meta"]["results"]["total"])


def literature_ids(answers: DataFrame, body: str = "body") -> DataFrame:
    """SRC-09: ids, total (the source gives it as text), translation; nothing for a bad answer."""
    got = F.from_json(F.col(body), "esearchresult struct<idlist:array<string>,count:string,querytranslation:string>")["esearchresult"]
    return answers.withColumns({"ids": F.coalesce(got["idlist"], F.array().cast("array<string>")), "total": F.coalesce(got["count"].try_cast("long"), F.lit(0).cast("long")), "translation": F.coalesce(got["querytranslation"], F.lit(""))})


def articles(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10 from files: one row for each article, parts of the abstract joined by a blank; empty ones are dropped.

    Files are cut at the articles' end tags, so that a large one is read by many tasks.
    """
    end = "</PubmedArticle>"
    raw = spark.read.option("lineSep", end).text(path).select(F.regexp_extract("value", r"(?s)<PubmedArticle\b.*", 0).alias("xml")).where("xml != ''")
    return parse_articles(raw.select(F.concat("xml", F.lit(end)).alias("xml")))


def parse_articles(raw: DataFrame, xml: str = "xml") -> DataFrame:
    parts = F.transform(F.xpath(F.col(xml), F.lit("//AbstractText/text()")), strip)
    title = F.coalesce(strip(F.get(F.xpath(F.col(xml), F.lit("//ArticleTitle/text()")), F.lit(0))), F.lit(""))
    out = raw.select(F.get(F.xpath(F.col(xml), F.lit("//PMID/text()")), F.lit(0)).alias("pmid"), title.alias("title"), F.array_join(F.filter(parts, lambda x: x != ""), " ").alias("abstract"))
    return out.where((F.col("title") != "") | (F.col("abstract") != ""))


def first_medicine(answers: DataFrame, body: str = "body") -> DataFrame:
    """SRC-11/TOP-07: name and document url of the first medicine of an answer."""
    got = F.get(F.from_json(F.col(body), "totalFilas int, resultados array<struct<nombre:string,docs:array<struct<url:string>>>>")["resultados"], F.lit(0))
    return answers.withColumns({"medicine": got["nombre"], "document": F.get(got["docs"], F.lit(0))["url"]})


def page_text(text: Column) -> Column:
    """SRC-12: the text of a PDF's joined pages with blanks normalised."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"\n+", " "), rf"{S}{{2,}}", " "))


Extractor = Callable[[bytes], list[str]]


def pdf_pages(data: bytes) -> list[str]:
    """The default extractor, if a PDF library is installed."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("no PDF library is installed; give an extractor") from e
    with fitz.open(stream=data, filetype="pdf") as doc:
        return [page.get_text() for page in doc]


def documents_of(spark: SparkSession, path: str, extract: Extractor = pdf_pages, glob: str = "*.pdf", joint: str = "\n") -> DataFrame:
    """SRC-18/UDF-06: filename, text of a folder of files; a file that can't be read has a null text and an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return extract_files(files, extract, joint)


def extract_files(files: DataFrame, extract: Extractor, joint: str = "\n") -> DataFrame:
    ship(files.sparkSession)

    def run(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append((path.rsplit("/", 1)[-1], joint.join(extract(bytes(content))), None))
                except Exception as e:  # one bad file is a row, not a failed job
                    rows.append((path.rsplit("/", 1)[-1], None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["filename", "text", "error"])

    return files.mapInPandas(run, "filename string, text string, error string")


def drug_id(answers: DataFrame, body: str = "body") -> DataFrame:
    """SRC-13: the first id of a name lookup; look each name up once (dropDuplicates before the connector)."""
    return answers.withColumn("drug_id", F.get(F.from_json(F.col(body), "data array<struct<id:string>>")["data"], F.lit(0))["id"])


def annotations(answers: DataFrame, body: str = "body") -> DataFrame:
    """SRC-14: one row for each annotation, with its order."""
    return answers.select("*", F.posexplode(F.from_json(F.col(body), f"data array<{ANNOTATION}>")["data"]).alias("ord", "annotation")).drop(body)


def pathway_hits(everything: DataFrame, pathways: DataFrame, body: str = "body") -> DataFrame:
    """SRC-15/FLT-08/TOP-06: the first 10 controls of one search and the first 8 pathways of the other, for each drug."""

    def hits(answers: DataFrame, kind: str, most: int, only: str | None) -> DataFrame:
        found = F.coalesce(F.from_json(F.col(body), CONTROL)["searchHit"], F.expr("cast(array() as array<struct<name:string,uri:string,biopaxClass:string,dataSource:array<string>>>)"))
        found = F.filter(found, lambda x: x["biopaxClass"] == only) if only else found
        return answers.select("drug", F.lit(kind).alias("kind"), F.posexplode(F.slice(found, 1, most)).alias("ord", "hit"))

    return hits(everything, "control", 10, "Control").unionByName(hits(pathways, "pathway", 8, None)).select("drug", "kind", "ord", "hit.*")


def suggestion(answers: DataFrame, body: str = "body") -> DataFrame:
    """SRC-16: the first spelling suggestion, null without one."""
    got = F.from_json(F.col(body), "suggestionGroup struct<suggestionList:struct<suggestion:array<string>>>")
    return answers.withColumn("suggestion", F.get(got["suggestionGroup"]["suggestionList"]["suggestion"], F.lit(0)))


def concept_names(ids: DataFrame, properties: DataFrame) -> DataFrame:
    """SRC-16: name, rxcui, inn: the first concept id of a name's answer, then the name in that id's properties.

    ids: name, body. properties: rxcui, body. Ids and names are null where an answer has none.
    """
    first = F.get(F.from_json("body", "idGroup struct<rxnormId:array<string>>")["idGroup"]["rxnormId"], F.lit(0))
    named = properties.select("rxcui", F.from_json("body", "properties struct<name:string>")["properties"]["name"].alias("inn")).dropDuplicates(["rxcui"])
    return ids.select("name", first.alias("rxcui")).join(named, "rxcui", "left").select("name", "rxcui", "inn")


def pdf_links(pages: DataFrame, html: str = "html", suffix: str = ".pdf", prefixes: tuple[str, ...] = ("agenda-", "minutes-")) -> DataFrame:
    """SRC-17: link targets that end in suffix and whose file name has one of the prefixes."""
    links = pages.select("*", F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?i)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))).alias("href")).drop(html)
    name = F.element_at(F.split("href", "/"), -1)
    wanted = F.lit(not prefixes)
    for p in prefixes:
        wanted = wanted | name.startswith(p)
    return links.where(F.col("href").endswith(suffix) & wanted)


def absolute(base: str, href: Column) -> Column:
    """STR-14: a link as an absolute url, . and .. resolved."""
    at = urlsplit(base)
    root, folder = f"{at.scheme}://{at.netloc}", at.path.rpartition("/")[0] + "/"
    page, query = root + at.path, f"?{at.query}" if at.query else ""
    own, tail = (F.regexp_extract(href, r"(?s)\A([^?#]*)(.*)\z", i) for i in (1, 2))
    whole = F.concat(F.when(own.startswith("/"), "").otherwise(folder), own)
    steps = F.split(F.regexp_replace(whole, r"(/\.\.?)\z", "$1/"), "/")
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
    walked = F.aggregate(F.slice(steps, 2, F.size(steps)), F.array(F.lit("")), lambda done, x: F.when(x == ".", done).when(x == "..", up(done)).otherwise(F.concat(done, F.array(x))))
    return (
        F.when(href.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(F.lit(f"{at.scheme}:"), href))
        .when(href == "", F.lit(page + query))
        .when(href.startswith("#"), F.concat(F.lit(page + query), href))
        .when(href.startswith("?"), F.concat(F.lit(page), href))
        .otherwise(F.concat(F.lit(root), F.array_join(walked, "/"), tail))
    )


def form_list(raw: Column, item: str = "string") -> Column:
    """SRC-20: a JSON list of a form field; a bad or missing one is empty."""
    return F.coalesce(F.from_json(raw, f"array<{item}>"), F.expr(f"cast(array() as array<{item}>)"))
