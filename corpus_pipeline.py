"""The corpus pipeline: quality rules, language ID, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of documents as they came,
whatever further ones there are and whatever their names.

Defined results: null, empty and blank texts go in the quality stage; texts without a letter go in the language stage; of
rows with one doc_id the near-duplicate stage keeps one, that of the least digest of all its columns as JSON, and rows without
doc_id all stay; an empty table goes through as an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm import language, near_dups, packing, quality
from vigilake.llm.queries import vocabulary
from vigilake.session import shared_dir, ship, table


def named(docs: DataFrame) -> list[Column]:
    """The columns of docs, whatever their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what neither the base rules nor the learned list rejects."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    verdict = quality.free_name(docs.columns, "verdict")
    return quality.judge(docs, None, rules, verdict=verdict).where(F.col(verdict)["kept"]).select(*named(docs))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts whose nearest language is near enough; training as in op9_language, from the stage's own input."""
    model = language.fit(docs.where(~language.held_out()))
    found = quality.free_name(docs.columns, "language")
    return language.predict(docs, model, result=found).where(~F.col(found)["rejected"]).select(*named(docs))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least doc_id of each near-duplicate group, and one row of it; without doc_id, all rows."""
    kept = near_dups.near_duplicates(docs.select("doc_id", "text")).where("kept").select("doc_id").distinct()
    found = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").select(*named(docs))
    # ids that repeat are found by the ids alone; all other rows stay where they are
    several = docs.select("doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    row = F.struct(*named(docs))
    order = F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)
    first = found.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), row.alias("row"), order.alias("order")).groupBy("id").agg(F.min_by("row", "order").alias("row"))
    return found.join(several, "doc_id", "left_anti").select(*named(docs)).union(first.select("row.*")).union(docs.where(F.col("doc_id").isNull()))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences, as op3_packing gives them."""
    ship(spark)
    return packing.pack_digests(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_dup_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the learned stages nor the packing; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
