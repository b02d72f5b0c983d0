"""

pt: code, name_en, name_es, ord. llt: code, name_en, name_es, pt_code, ord. hier: pt_code, pt_name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.functions.text import ascii_fold, strip


def code_to_name(codes: DataFrame, pt: DataFrame, llt: DataFrame, lang: str = "en") -> DataFrame:
    """JOIN-01: a preferred term's name, else the name of a lower term's parent."""
    name = f"name_{lang}"
    own = pt.select("code", F.col(name).alias("own"))
    parent = llt.select("code", "pt_code").join(pt.select(F.col("code").alias("pt_code"), F.col(name).alias("of_parent")), "pt_code", "left").select("code", "of_parent")
    return codes.join(own, "code", "left").join(parent, "code", "left").withColumn("name", F.coalesce("own", "of_parent")).drop("own", "of_parent")


def code_to_names(codes: DataFrame, pt: DataFrame, llt: DataFrame) -> DataFrame:
    """JOIN-02: names in both languages."""
    en = code_to_name(codes, pt, llt, "en").withColumnRenamed("name", "name_en")
    return code_to_name(en, pt, llt, "es").withColumnRenamed("name", "name_es")


def llt_to_pt(codes: DataFrame, pt: DataFrame, llt: DataFrame) -> DataFrame:
    """JOIN-03: a lower term's preferred code and name."""
    return codes.join(llt.select("code", "pt_code"), "code", "left").join(pt.select(F.col("code").alias("pt_code"), F.col("name_en").alias("pt_name")), "pt_code", "left")


def pt_to_llts(codes: DataFrame, llt: DataFrame, lang: str = "en") -> DataFrame:
    """JOIN-04: code, names of its lower terms in file order; those without a name in the language are left out."""
    name = F.col(f"name_{lang}")
    groups = llt.where(name.isNotNull()).groupBy(F.col("pt_code").alias("code")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", name.alias("name")))), lambda x: x["name"]).alias("names"))
    return codes.join(groups, "code", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def pt_to_llt_codes(codes: DataFrame, llt: DataFrame) -> DataFrame:
    """JOIN-05."""
    return codes.join(llt.select(F.col("pt_code").alias("code"), F.col("code").alias("llt_code"), "ord"), "code")


def hierarchy(codes: DataFrame, llt: DataFrame, hier: DataFrame) -> DataFrame:
    """JOIN-06: the hierarchy's name of a code, lower terms by their parent."""
    return codes.join(llt.select("code", "pt_code"), "code", "left").withColumn("pt_code", F.coalesce("pt_code", "code")).join(hier, "pt_code", "left")


def is_pt(codes: DataFrame, pt: DataFrame) -> DataFrame:
    """FLT-11: codes of preferred terms."""
    return codes.join(pt.select("code"), "code", "left_semi")


def is_llt(codes: DataFrame, pt: DataFrame, llt: DataFrame) -> DataFrame:
    """FLT-11: codes of lower terms that aren't preferred terms too."""
    return codes.join(llt.select("code"), "code", "left_semi").join(pt.select("code"), "code", "left_anti")


def resolve(codes: DataFrame, pt: DataFrame, llt: DataFrame, most: int = 25) -> DataFrame:
    """JOIN-07: type, names, parent and the first lower terms of each code; type null for an unknown one."""
    kinds = codes.join(pt.select("code", F.lit(True).alias("as_pt")), "code", "left").join(llt.select("code", F.lit(True).alias("as_llt")), "code", "left")
    kinds = kinds.withColumn("type", F.when(F.col("as_pt"), "PT").when(F.col("as_llt"), "LLT")).drop("as_pt", "as_llt")
    out = llt_to_pt(code_to_names(kinds, pt, llt), pt, llt)
    for lang in ("en", "es"):
        out = pt_to_llts(out, llt, lang).withColumn(f"llts_{lang}", F.slice("names", 1, most)).drop("names")
    return out


def search(query: str, pt: DataFrame, llt: DataFrame, limit: int = 15) -> DataFrame:
    """TOP-01: hits in four tiers (preferred and lower terms, each English then Spanish), file order inside a tier.

    Digits are a code prefix, anything else a folded substring of a name. FLT-12: queries under two characters
    find nothing. Columns: code, name_en, name_es, type, pt_code, tier, ord, pt_name_en (the preferred term's name of a lower one).
    """
    q = query.strip()
    folded = ascii_fold(strip(F.lit(q)))
    tiers = []
    for kind, rows in (("PT", pt.withColumn("pt_code", F.lit(None).cast("string"))), ("LLT", llt.join(pt.select("code"), "code", "left_anti"))):
        for lang in ("en", "es"):
            if q.isdigit():
                found = rows.where(F.col("code").startswith(q)) if lang == "en" else rows.limit(0)
            else:
                found = rows.where(ascii_fold(F.col(f"name_{lang}")).contains(folded))
            tiers.append(found.select("code", F.coalesce("name_en", F.lit("")).alias("name_en"), F.coalesce("name_es", F.lit("")).alias("name_es"), F.lit(kind).alias("type"), "pt_code", F.lit(len(tiers)).alias("tier"), "ord"))
    hits = tiers[0]
    for t in tiers[1:]:
        hits = hits.unionByName(t)
    first = hits.groupBy("code").agg(F.min_by(F.struct("name_en", "name_es", "type", "pt_code", "tier", "ord"), F.struct("tier", "ord")).alias("x")).select("code", "x.*")
    found = first.where(F.lit(len(q) >= 2)).orderBy("tier", "ord", "code").limit(max(0, min(limit, 30)))
    # at most 30 rows: they go to the names
    named = pt.select(F.col("code").alias("pt_code"), F.coalesce("name_en", F.lit("")).alias("pt_name_en")).join(F.broadcast(found.select("pt_code").distinct()), "pt_code", "left_semi")
    return found.join(named, "pt_code", "left").select(*found.columns, F.when(F.col("type") == "LLT", F.coalesce("pt_name_en", F.lit(""))).alias("pt_name_en")).orderBy("tier", "ord", "code")
