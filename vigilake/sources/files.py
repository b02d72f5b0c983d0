"""

A data source writer: tasks fetch the documents of their rows and write them under names of their own beside the target;
commit gives each its final name, unless a file of that name is there. So a name has one whole file or none, under task retries,
speculation and runs that are repeated: attempts that are not committed leave nothing in the folder, and abort removes what they
wrote. Names come from the urls and the folder must be one that all machines share.
"""

from __future__ import annotations

import os
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from vigilake.functions.text import file_name
from vigilake.session import ship

#: A fetcher gives the bytes of a url or raises.
Fetcher = Callable[[str, float], bytes]


def over_http(url: str, timeout: float) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return answer.read()


@dataclass
class Written(WriterCommitMessage):
    """(name, temporary file) of what a task fetched, and (name, error) of what it could not."""

    files: list[tuple[str, str]] = field(default_factory=list)
    errors: list[tuple[str, str]] = field(default_factory=list)


class DocumentFiles(DataSource):
    """Options: folder, timeout. Rows: filename, link."""

    fetcher: Fetcher = staticmethod(over_http)

    @classmethod
    def name(cls) -> str:
        return "vigilake_documents"

    def writer(self, schema, overwrite):
        return DocumentWriter(self.options, type(self).fetcher)


class DocumentWriter(DataSourceWriter):
    def __init__(self, options, fetcher: Fetcher):
        self.folder, self.timeout, self.fetcher = options["folder"].removeprefix("file://"), float(options.get("timeout", "60")), fetcher
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        """Fetch and write under temporary names; a document that fails is an error of its own."""
        aside, out = os.path.join(self.folder, f"_temporary-{self.run}"), Written()
        os.makedirs(aside, exist_ok=True)
        for filename, link in iterator:
            if os.path.exists(os.path.join(self.folder, filename)):
                continue
            path = os.path.join(aside, uuid.uuid4().hex)
            try:
                data = self.fetcher(link, self.timeout)
                with open(path, "wb") as f:
                    f.write(data)
                out.files.append((filename, path))
            except Exception as e:  # the other documents go on
                out.errors.append((filename, f"{type(e).__name__}: {e}"))
        return out

    def commit(self, messages: list[Written | None]) -> None:
        """A name goes to the first of its files; a link fails where the name is taken, so no file is written over."""
        os.makedirs(self.folder, exist_ok=True)
        errors = []
        for message in messages:
            for filename, path in message.files if message else ():
                try:
                    os.link(path, os.path.join(self.folder, filename))
                except FileExistsError:
                    pass
            errors += message.errors if message else ()
        if errors:
            with open(os.path.join(self.folder, f"_errors-{self.run}.tsv"), "w", encoding="utf-8") as f:
                f.writelines(f"{name}\t{error!r}\n" for name, error in errors)
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        aside = os.path.join(self.folder, f"_temporary-{self.run}")
        if os.path.isdir(aside):
            for name in os.listdir(aside):
                os.unlink(os.path.join(aside, name))
            os.rmdir(aside)


def wanted(links: DataFrame, link: str = "link") -> DataFrame:
    """filename, link: one link for each file name (SNK-07), the least by text; links without a name go."""
    named = links.select(file_name(F.col(link)).alias("filename"), F.col(link).alias("link")).where("filename != ''")
    return named.groupBy("filename").agg(F.min("link").alias("link"))


def download(links: DataFrame, folder: str, source: type[DocumentFiles] = DocumentFiles, timeout: float = 60, tasks: int = 4) -> DataFrame:
    """Fetch what is not in the folder yet, by ``tasks`` tasks at once; the outcome of every name: filename, outcome (there, downloaded, error).

    There is one row for each distinct file name. Names that were in the folder before are not fetched.
    """
    spark = links.sparkSession
    ship(spark)
    place = folder.removeprefix("file://")
    os.makedirs(place, exist_ok=True)
    before = spark.createDataFrame([(x,) for x in os.listdir(place) if not x.startswith("_")], "filename string").checkpoint()
    every = wanted(links).checkpoint()
    missing = every.join(before, "filename", "left_anti")
    spark.dataSource.register(source)
    missing.repartition(tasks, "filename").select("filename", "link").write.format(source.name()).mode("append").options(folder=folder, timeout=str(timeout)).save()
    after = spark.createDataFrame([(x, True) for x in os.listdir(place) if not x.startswith("_")], "filename string, found boolean")
    known = before.select("filename", F.lit(True).alias("old"))
    outcome = F.when(F.col("old"), "there").when(F.col("found"), "downloaded").otherwise("error")
    return every.join(known, "filename", "left").join(after, "filename", "left").select("filename", outcome.alias("outcome"))
