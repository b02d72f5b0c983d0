
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.text import bound, snippet, strip
from vigilake.session import broadcast_if_small, spread


def normal(name: Column) -> Column:
    return F.lower(strip(name))


def resolve(drugs: DataFrame, lookup: DataFrame, name: str = "name") -> DataFrame:
    """JOIN-08: drugbank_id and inn by trimmed lower-case name; null for an unknown one. lookup: key, drugbank_id, inn."""
    return drugs.withColumn("key", normal(F.col(name))).join(lookup.select("key", "drugbank_id", "inn"), "key", "left").drop("key")


def with_payload(drugs: DataFrame, payload: DataFrame, column: str) -> DataFrame:
    """JOIN-09: a dictionary's value by drugbank_id (MAP-01: an empty list where it has none)."""
    kind = payload.schema["value"].dataType
    out = drugs.join(payload.select(F.col("key").alias("drugbank_id"), F.col("value").alias(column)), "drugbank_id", "left")
    return out.withColumn(column, F.coalesce(column, F.array().cast(kind))) if kind.typeName() == "array" else out


def first_known(drugs: DataFrame, ids: DataFrame, first: str, second: str) -> DataFrame:
    """JOIN-13..15: the id of one name, else of the other. ids: name, id."""
    a, b = (ids.select(F.col("name").alias(k), F.col("id").alias(f"id_{k}")) for k in ("a", "b"))
    out = drugs.withColumns({"a": strip(F.col(first)), "b": strip(F.col(second))}).join(a, "a", "left").join(b, "b", "left")
    return out.withColumn("id", F.coalesce("id_a", "id_b")).drop("a", "b", "id_a", "id_b")


def suggested(queries: DataFrame, suggestions: DataFrame, resolved: DataFrame) -> DataFrame:
    """JOIN-15: query, name_en (the first suggestion, else the query), inn, rxcui: of that name, else of the query itself.

    queries: query. suggestions: query, suggestion. resolved: name, inn, rxcui. Queries under two characters or without a name go.
    """
    asked = queries.select(strip(F.col("query")).alias("query")).where(F.length("query") >= 2).distinct()
    hints = suggestions.select(strip(F.col("query")).alias("query"), F.nullif(strip(F.col("suggestion")), F.lit("")).alias("hint")).dropDuplicates(["query"])
    named = asked.join(hints, "query", "left").withColumn("name_en", F.coalesce("hint", "query"))
    sound = resolved.where(F.coalesce(strip(F.col("inn")), F.lit("")) != "")
    a, b = (sound.select(F.col("name").alias(k), strip(F.col("inn")).alias(f"inn_{k}"), F.col("rxcui").alias(f"rxcui_{k}")).dropDuplicates([k]) for k in ("name_en", "query"))
    out = named.join(a, "name_en", "left").join(b, "query", "left")
    first = F.col("inn_name_en").isNotNull()
    pick = lambda k: F.when(first, F.col(f"{k}_name_en")).otherwise(F.col(f"{k}_query"))
    return out.select("query", "name_en", pick("inn").alias("inn"), pick("rxcui").alias("rxcui")).where("inn is not null")


def direct_interactions(cases: DataFrame, interactions: DataFrame) -> DataFrame:
    """JOIN-10: interactions between two drugs of a case, each unordered pair once, the first in list order.

    cases: case_id, pos, inn. interactions: inn, int_pos, name, description. The drugs of a case (few) are paired first, so that
    only pairs that some case has meet the known interactions.
    """
    drug = F.struct("pos", F.col("inn").alias("inn"))
    pairs = spread(cases, "case_id").groupBy("case_id").agg(F.collect_list(drug).alias("a")).select("case_id", F.col("a").alias("b"), F.explode("a").alias("x"))
    pairs = pairs.select("case_id", "x", F.explode(F.filter("b", lambda y: y["inn"] != F.col("x.inn"))).alias("y")).select("case_id", F.col("x.pos").alias("pos"), F.col("x.inn").alias("drug1"), F.col("y.inn").alias("drug2"))
    known = interactions.groupBy(F.col("inn").alias("drug1"), F.lower("name").alias("other")).agg(F.min(F.struct("int_pos", "description")).alias("first"))
    # few known interactions go to the pairs: as keys of a shuffle a few common drugs would be a few large tasks
    found = pairs.withColumn("other", F.lower("drug2")).join(broadcast_if_small(known), ["drug1", "other"])
    best = F.min(F.struct("pos", F.col("first.int_pos").alias("int_pos"), "drug1", "drug2", F.col("first.description").alias("description"))).alias("x")
    return found.groupBy("case_id", F.least("drug1", "drug2").alias("lo"), F.greatest("drug1", "drug2").alias("hi")).agg(best).select("case_id", "x.drug1", "x.drug2", "x.description")


def cross_mentions(texts: DataFrame, least: int = 4) -> DataFrame:
    """JOIN-12/STR-10: drugs of a case named in another drug's text, the international name before the other one.

    texts: case_id, i, inn, name, text. One row for each ordered pair (i, j), with the place (at) and a snippet. The names of a case (few) go to each of
    its texts, which is read once.
    """
    names = texts.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("i", "inn", "name"))).alias("others"))
    own = texts.select("case_id", "i", F.col("name").alias("source"), "text").join(names, "case_id")

    def in_low(low):
        hit = lambda n: F.when((F.length(n) >= least) & low.contains(F.lower(n)), n)
        return F.filter(F.transform("others", lambda o: F.struct(o["i"].alias("j"), o["name"].alias("mentioned"), F.coalesce(hit(o["inn"]), hit(o["name"])).alias("as"))), lambda o: (o["j"] != F.col("i")) & o["as"].isNotNull())

    found = own.select("case_id", "i", "source", "text", F.explode(bound(F.lower("text"), in_low)).alias("x"))
    return found.select("case_id", "i", "x.j", "source", "x.mentioned", F.position(F.lower("x.as"), F.lower("text")).alias("at"), snippet(F.col("text"), F.col("x.as"), 80, 120).alias("snippet"))


def _list(title: str, items: Column, line) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"\n{title}:\n"), F.array_join(F.transform(items, line), "\n")))


def _named(x: Column) -> Column:
    gene = F.when(F.coalesce(x["gene_symbol"], F.lit("")) != "", F.concat(F.lit(" ["), x["gene_symbol"], F.lit("]"))).otherwise("")
    return F.concat(F.lit("  - "), F.coalesce(x["name"], F.lit("")), gene, F.lit(": "), F.array_join(F.coalesce(x["actions"], F.array().cast("array<string>")), ", "))


def _fields(**names: str):
    def line(x: Column) -> Column:
        return F.concat(F.lit("  - "), F.concat_ws(" ", *(F.concat(F.lit(f"{k}="), F.coalesce(x[k], F.lit(d))) for k, d in names.items())))

    return line


def summary(profile: Column, pgx: Column) -> Column:
    """RND-01: the profile as text in nine ordered parts, empty ones left out; null without a profile."""
    text = lambda k: F.when(F.coalesce(profile[k], F.lit("")) != "", F.concat(F.lit(f"\n{k}:\n"), profile[k]))
    head = F.concat(F.lit("=== DrugBank: "), F.coalesce(profile["inn"], F.lit("")), F.lit(" ("), F.coalesce(profile["drugbank_id"], F.lit("")), F.lit(") ==="))
    pathway = lambda x: F.concat(F.lit("  - "), F.coalesce(x["name"], F.lit("")), F.lit(" ["), F.coalesce(x["smpdb_id"], F.lit("")), F.lit("]"))
    parts = [head, text("mechanism"), text("pharmacodynamics")]
    parts += [_list(k, profile[k], _named) for k in ("targets", "enzymes", "transporters")]
    parts += [_list("snp_effects", pgx["snp_effects"], _fields(gene="?", rs_id="", description="")), _list("snp_adrs", pgx["snp_adrs"], _fields(gene="?", rs_id="", adverse_reaction=""))]
    parts += [_list("pathways", profile["pathways"], pathway), text("toxicity")]
    return F.when(profile.isNotNull(), F.concat_ws("\n", *parts))
