
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_signals(existing: DataFrame, new: DataFrame) -> DataFrame:
    """SNK-01: existing rows and new ones of other files; sorted on reading (TOP-08), never rewritten as one file."""
    return existing.unionByName(new.join(existing.select("filename").distinct(), "filename", "left_anti"))


def by_source_and_date(rows: DataFrame) -> DataFrame:
    """TOP-08: the date is text, so this order isn't chronological; see functions.text.month_of for one that is."""
    return rows.orderBy("source", "date")


def not_yet_there(links: DataFrame, files: DataFrame) -> DataFrame:
    """SNK-02/JOIN-18: links whose file isn't there yet."""
    return links.join(files, "filename", "left_anti")


def event_stream(events: DataFrame, payload: list[str]) -> DataFrame:
    """SNK-03/04/JSN-05: server-sent event lines with compact JSON."""
    data = F.to_json(F.struct("tipo", *payload), {"ignoreNullFields": "false"})
    return events.withColumn("line", F.concat(F.lit("data: "), data, F.lit("\n\n")))


def save_sessions(cases: DataFrame, path: str) -> None:
    """SNK-05: evidence by session id (session_id and further columns), appended with the time; a session that is saved again has a new version."""
    cases.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(path)


def latest_sessions(sessions: DataFrame) -> DataFrame:
    """SNK-05: the latest version of each session, of equal times the one of the greatest digest; rows without an id go."""
    named = [F.col(f"`{c}`") for c in sessions.columns]
    order = F.struct("saved_at", F.sha2(F.to_json(F.struct(*named)), 256))
    return sessions.where("session_id is not null").groupBy("session_id").agg(F.max_by(F.struct(*named), order).alias("x")).select("x.*")


def load_session(sessions: DataFrame, session_id: str) -> DataFrame:
    """SNK-05: the latest version of one session."""
    return latest_sessions(sessions.where(F.col("session_id") == session_id))


def run_statistics(rows: DataFrame) -> DataFrame:
    """SNK-06/AGG-07: rows by status and characters in all."""
    return rows.agg(F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "not_found").alias("n_not_found"), F.count_if(F.col("status") == "read_error").alias("n_read_error"), F.coalesce(F.sum("chars"), F.lit(0)).cast("long").alias("chars"))


def download_counters(rows: DataFrame) -> DataFrame:
    """AGG-08: rows by outcome."""
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))
