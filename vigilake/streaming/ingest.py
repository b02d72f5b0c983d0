
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators.signals import extract
from vigilake.sources.readers import Extractor, extract_files, pdf_pages


def new_files(spark: SparkSession, source: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], schema: str = "path string, modificationTime timestamp, length long, content binary", glob: str = "*", file_format: str = "binaryFile") -> None:
    """Append transform(new files) to target; what the checkpoint knows is skipped, also after a restart."""
    stream = spark.readStream.format(file_format).schema(schema).option("pathGlobFilter", glob).load(source)
    query = transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()


def ingest_minutes(spark: SparkSession, folder: str, target: str, checkpoint: str, source_name: str, extractor: Extractor = pdf_pages, glob: str = "*.pdf") -> None:
    """Minutes of a folder as rows of signals (SRC-18, STR-08)."""

    def rows(files: DataFrame) -> DataFrame:
        return extract(extract_files(files.select("path", "content"), extractor).withColumn("source", F.lit(source_name)))

    new_files(spark, folder, target, checkpoint, rows, glob=glob)


def first_empty(pages: DataFrame) -> DataFrame:
    """STM-05: the pages of a listing before the first one without links. pages: page, n_links."""
    stop = pages.where("n_links = 0").agg(F.min("page").alias("stop"))
    return pages.join(F.broadcast(stop), F.col("stop").isNull() | (F.col("page") < F.col("stop"))).drop("stop")
