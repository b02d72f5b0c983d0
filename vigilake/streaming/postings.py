"""

Each batch of new minutes writes its word positions, sorted by word, and the names of its files under its own batch number, in place of
what an earlier attempt at that batch has left; so a batch that is run again changes nothing. A file that comes again in a later
batch has its words from there: of each name the last batch counts.

Defined results: minutes without a section have no words but are known; null names are left out; a folder without batches has no postings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators.article_search import find_phrases, repeated_rows, word_positions, words
from vigilake.sources.readers import SIGNALS

WORDS, FILES = "word string, id string, version long, n long, pos int, batch long", "id string, version long, batch long"


def write_batch(minutes: DataFrame, batch: int, target: str) -> None:
    """The postings of one batch (filename, section4), in place of earlier attempts at it."""
    one = minutes.where("filename is not null").dropDuplicates(["filename", "section4"]).persist()
    spread = word_positions(one, "filename", "section4").repartition("word", F.pmod(F.xxhash64("id"), F.lit(16)))
    spread.sortWithinPartitions("word").write.mode("overwrite").parquet(f"{target}/words/batch={batch}")
    one.select(F.col("filename").alias("id"), F.xxhash64("section4").alias("version")).write.mode("overwrite").parquet(f"{target}/files/batch={batch}")
    one.unpersist()


def maintain(spark: SparkSession, minutes: str, target: str, checkpoint: str) -> None:
    """Add the postings of minutes (parquet rows of SIGNALS) not seen before, then stop."""
    stream = spark.readStream.schema(SIGNALS).parquet(minutes)
    query = stream.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def current(spark: SparkSession, target: str) -> DataFrame:
    """word, id, version, n, pos of each file's last batch."""
    last = _table(spark, f"{target}/files", FILES).groupBy("id").agg(F.max("batch").alias("batch"))
    return _table(spark, f"{target}/words", WORDS).join(last, ["id", "batch"], "left_semi").drop("batch")


def phrase_counts(spark: SparkSession, target: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """JOIN-11 from postings: term, n_docs: in how many files the folded words of each term follow one another; 0 included."""
    asked = terms.select(F.col(term).alias("term"), F.array_join(words(F.col(term)), " ").alias("phrase")).where("term is not null").distinct()
    none = repeated_rows(spark.createDataFrame([], "pmid string, text string"))  # batches hold a text once
    found = find_phrases(current(spark, target), asked.where("phrase != ''"), none).groupBy("phrase").agg(F.count_distinct("id").alias("n_docs"))
    return asked.join(found, "phrase", "left").select("term", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
