"""Session helpers: default configuration, code shipping, shared folders."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only used where the session does not set its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("vigilake")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.config("spark.sql.shuffle.partitions", partitions).config("spark.driver.memory", memory).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once for each application (Python workers import it by name)."""
    context = spark.sparkContext
    if getattr(context, "_vigilake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="vigilake-")  # read by the driver's file server only
    target = os.path.join(folder, "vigilake_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(target)
    context._vigilake_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, from spark.checkpoint.dir; where that is unset, a local session gets one of its own."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    found = context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir is unset; on a cluster it must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="vigilake-checkpoint-")
    context.setCheckpointDir(found)
    return found


def settled(rows: DataFrame) -> DataFrame:
    """rows, written as a table in the shared folder and read again: lineage is cut and lost executors cost no recomputation."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def broadcast_if_small(rows: DataFrame, most: int = 20_000) -> DataFrame:
    """rows with a broadcast hint if they are few (counted up to the bound); otherwise the join is left to the optimizer."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt by hash to as many tasks as the session has for a shuffle, at least one for each core: a small file isn't one task's work."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
