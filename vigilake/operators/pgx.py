
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels in order of strength.
LEVELS = ("1A", "1B", "2A", "2B")
UNKNOWN = "desconocido"


def level_rank(level: Column) -> Column:
    """0 for the strongest level; null for one without a rank."""
    return F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), F.coalesce(level, F.lit(""))), F.lit(0).cast("long")) - 1


def is_high(level: Column) -> Column:
    """FLT-04."""
    return F.coalesce(level.isin(*LEVELS), F.lit(False))


def is_level_3(level: Column) -> Column:
    """FLT-05."""
    return F.coalesce(F.trim(level).startswith("3"), F.lit(False))


def strength(level: Column) -> Column:
    """FLT-06: strong, secondary or low."""
    return F.when(level.isin("1A", "1B"), "strong").when(level.isin("2A", "2B"), "secondary").otherwise("low")


def extract(annotation: Column) -> dict[str, Column]:
    """FLT-07/FLT-17: columns of one annotation: first gene only, allele phenotypes without limited evidence, flags."""
    pairs = F.filter(F.coalesce(annotation["allelePhenotypes"], F.expr("cast(array() as array<struct<allele:string,phenotype:string,limitedEvidence:boolean>>)")), lambda x: ~F.coalesce(x["limitedEvidence"], F.lit(False)))
    some = lambda k: F.coalesce(F.size(annotation[k]) > 0, F.lit(False))
    return {
        "level": F.coalesce(annotation["levelOfEvidence"]["term"], F.lit("")),
        "gene": F.coalesce(F.get(annotation["location"]["genes"], F.lit(0))["symbol"], F.lit("")),
        "pairs": F.transform(pairs, lambda x: F.struct(x["allele"].alias("allele"), x["phenotype"].alias("phenotype"))),
        "diseases": F.coalesce(F.transform(annotation["relatedDiseases"], lambda d: d["name"]), F.array().cast("array<string>")),
        "has_guideline": some("relatedGuidelines"),
        "has_label": some("relatedLabels"),
        "contexts": F.coalesce(annotation["types"], F.array().cast("array<string>")),
    }


def best_level(level: str = "level", order: str = "ord") -> Column:
    """AGG-05: the least ranked level; else the first that isn't blank; else a fixed word."""
    rank = level_rank(F.col(level))
    first = F.min_by(F.when(F.coalesce(F.col(level), F.lit("")) != "", F.col(level)), F.when(F.coalesce(F.col(level), F.lit("")) != "", F.col(order)))
    return F.coalesce(F.min_by(F.when(rank.isNotNull(), F.col(level)), rank), first, F.lit(UNKNOWN))


def fallback(annotations: DataFrame, by: str = "drug", most: int = 2) -> DataFrame:
    """TOP-04: high annotations; for a drug without any, the first level-3 one of each gene, two at most."""
    high = F.max(is_high(F.col("level"))).over(Window.partitionBy(by))
    gene = F.when(F.coalesce("gene", F.lit("")) == "", "?").otherwise(F.col("gene"))
    marked = annotations.withColumn("any_high", high)
    third = marked.where(~F.col("any_high") & is_level_3(F.col("level"))).withColumn("nth", F.row_number().over(Window.partitionBy(by, gene).orderBy("ord"))).where("nth = 1")
    third = third.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy("ord"))).where(F.col("nth") <= most)
    return marked.where(is_high(F.col("level"))).drop("any_high").unionByName(third.drop("any_high", "nth"))


def consolidate(annotations: DataFrame, by: str = "drug") -> DataFrame:
    """AGG-04/TOP-05: one row for each drug, strength and gene, in order of best level (position)."""
    gene = F.when(F.coalesce("gene", F.lit("")) == "", "?").otherwise(F.col("gene")).alias("gene")
    listed = lambda c: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", c))), lambda x: x[c]))
    rows = annotations.groupBy(by, strength(F.col("level")).alias("strength"), gene).agg(
        best_level().alias("level"),
        F.slice(F.array_distinct(listed("pairs")), 1, 8).alias("pairs"),
        F.sort_array(F.array_distinct(F.filter(F.flatten(F.collect_list("contexts")), lambda x: x != ""))).alias("contexts"),
        F.array_distinct(listed("diseases")).alias("diseases"),
        F.bool_or("has_guideline").alias("has_guideline"),
        F.bool_or("has_label").alias("has_label"),
        F.min("ord").alias("first_ord"),
    )
    order = Window.partitionBy(by, "strength").orderBy(F.coalesce(level_rank(F.col("level")), F.lit(99)), "first_ord")
    return rows.withColumn("position", F.row_number().over(order))


def gene_line() -> Column:
    """RND-04/AGG-10: one line for a consolidated gene."""
    count = lambda c, word: F.when(F.size(c) > 0, F.concat(F.size(c).cast("string"), F.lit(f" {word}")))
    extra = F.concat_ws("; ", count("pairs", "alelo-fenotipo"), count("contexts", "contextos"), count("diseases", "enfermedades"))
    flag = lambda c, t: F.when(F.col(c), F.lit(t)).otherwise("")
    return F.concat(F.lit("  · "), F.col("gene"), F.lit(" [evidencia: "), F.col("level"), F.lit("]"), flag("has_guideline", " ✓ GUÍA CPIC/DPWG"), flag("has_label", " ✓ ETIQUETA FDA/EMA"), F.when(extra != "", F.concat(F.lit(" ("), extra, F.lit(")"))).otherwise(""))


#: Titles of the strengths; of low evidence three genes are shown.
TITLES = (("strong", "Genes evidencia fuerte (1A/1B)", 10**6), ("secondary", "Genes evidencia secundaria (2A/2B)", 10**6), ("low", "Genes evidencia baja (referencia)", 3))


#: Fixed value: the text of a drug without genes.
NO_GENES = "Sin datos farmacogenéticos relevantes."


def text(genes: DataFrame, by: str = "drug", drugs: DataFrame | None = None) -> DataFrame:
    """RND-04: all genes of a drug as one text. drugs: all drugs; those without genes then have a fixed sentence."""
    if drugs is not None:
        return drugs.select(by).distinct().join(text(genes, by), by, "left").withColumn("text", F.coalesce("text", F.lit(NO_GENES)))
    titles = genes.sparkSession.createDataFrame([(a, b, n, i) for i, (a, b, n) in enumerate(TITLES)], "strength string, title string, most int, block int")
    shown = genes.join(F.broadcast(titles), "strength").where("position <= most").withColumn("line", gene_line())
    blocks = shown.groupBy(by, "block", "title").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("block", F.concat(F.lit("\n"), F.col("title"), F.lit(":\n"), F.col("lines")).alias("t")))), lambda x: x["t"])
    return blocks.groupBy(by).agg(F.concat_ws("\n", F.concat(F.lit("PharmGKB + CPIC — "), F.col(by).cast("string")), F.array_join(whole, "\n")).alias("text"))
