"""

Distinct requests without a kept answer are dealt to tasks by host and lane; a lane sends one request after another with a pause
between them, so a host gets at most ``rate`` requests a second however many tasks there are, and one with many requests is not one
task's. Answers are appended to the table of answers, which is the cache of all later runs; errors and refusals are kept as rows
too, but asked again the next time.

Defined results: null requests have no answer; repeated ones are sent once; of several kept rows of a request a final answer
goes before an error, then the last one goes.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.session import settled, ship
from vigilake.sources.rest import WAITS

ANSWERS = "request string, status int, body string, error string, asked_at timestamp"
#: Statuses that are answers and are not asked for again: found, and known not to be there.
FINAL = (200, 404)
#: A fetcher gives status and body of a request, or raises.
Fetcher = Callable[[str, float], tuple[int, str | None]]


def over_http(url: str, timeout: float) -> tuple[int, str | None]:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, None


def kept_answers(spark: SparkSession, path: str) -> DataFrame:
    """The best row of each request in the table of answers; an empty table if there is none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    rows = spark.read.schema(ANSWERS).parquet(path) if there else spark.createDataFrame([], ANSWERS)
    best = F.max_by(F.struct("status", "body", "error"), F.struct(F.coalesce(F.col("status").isin(*FINAL), F.lit(False)).alias("final"), "asked_at"))
    return rows.groupBy("request").agg(best.alias("x")).select("request", "x.*")


def send(requests: DataFrame, fetch: Fetcher, rate: float, lanes: int, timeout: float, waits: tuple[float, ...]) -> DataFrame:
    """ANSWERS of distinct requests (request), sent by host and lane."""
    ship(requests.sparkSession)
    pause = lanes / rate
    host = F.coalesce(F.parse_url("request", F.lit("HOST")), F.lit(""))
    dealt = requests.select("request", host.alias("host"), F.pmod(F.xxhash64("request"), F.lit(lanes)).cast("int").alias("lane"))

    def one(url: str) -> tuple[int | None, str | None, str | None]:
        for wait in (*waits, None):
            try:
                status, body = fetch(url, timeout)
            except Exception as e:  # one failing request leaves the others
                return None, None, "timeout" if isinstance(e, TimeoutError) else f"{type(e).__name__}: {e}"
            if status != 429 or wait is None:
                return status, body, None if status in FINAL else f"status {status}"
            time.sleep(wait)
        raise AssertionError

    def run(batches: Iterator):
        free: dict[tuple[str, int], float] = {}
        for pdf in batches:
            out = []
            for key in zip(pdf["host"], pdf["lane"], strict=True):
                time.sleep(max(0.0, free.get(key, 0.0) - time.monotonic()))
                out.append(one(pdf["request"].iloc[len(out)]))
                # from the end of an answer, so that requests never reach the host closer together, however long they are on their way
                free[key] = time.monotonic() + pause
            for i, name in enumerate(("status", "body", "error")):
                pdf[name] = [x[i] for x in out]
            pdf["status"] = pdf["status"].astype("Int32")
            yield pdf[["request", "status", "body", "error"]]

    # a lane of a host is in one task, so its pauses hold
    sent = dealt.repartition("host", "lane").sortWithinPartitions("host", "lane", "request").mapInPandas(run, "request string, status int, body string, error string")
    return sent.withColumn("asked_at", F.current_timestamp())


def answered(requests: DataFrame, path: str, fetch: Fetcher = over_http, rate: float = 3.0, lanes: int = 1, timeout: float = 45, waits: tuple[float, ...] = WAITS, column: str = "request") -> DataFrame:
    """requests with status, body and error of their answers; those without a final one in the table at path are sent first.

    rate: requests a second for a host, by ``lanes`` tasks. The table at path is in a folder that all machines share.
    """
    spark = requests.sparkSession
    asked = requests.select(F.col(column).alias("request")).where("request is not null").distinct()
    final = kept_answers(spark, path).where(F.col("status").isin(*FINAL)).select("request")
    missing = settled(asked.join(final, "request", "left_anti"))
    if missing.limit(1).count():
        send(missing, fetch, rate, lanes, timeout, waits).write.mode("append").parquet(path)
    return requests.join(kept_answers(spark, path).withColumnRenamed("request", column), column, "left")
