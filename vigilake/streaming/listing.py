"""

The offset of the stream is the number of the next page, so a query that is started again goes on where its checkpoint stands
and asks for no page twice. A listing of one host is asked for page by page (that is what pacing means), so a batch's pages, few by
its bound, are read by the stream's reader; the documents that they name are fetched by tasks. Waits between requests grow
after a refusal (429) and shrink after an answer, and are part of the offset. The end is found by the reader itself: at a page that
has no link of the kind wanted, or that fails for good, the offset stays, and a later run asks for it again.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, InputPartition, SimpleDataSourceStreamReader

from vigilake.session import ship
from vigilake.sources.readers import absolute, pdf_links

SCHEMA = "page long, url string, status int, body string, error string"
#: The wait between pages in seconds, at first and at least, at most, and what it is multiplied by after a refusal and after an answer.
FIRST, MOST, SLOWER, FASTER = 1.0, 8.0, 2.0, 0.85
#: Waits after refusals of one page, seconds.
WAITS = (30.0, 60.0, 120.0)


def next_wait(wait: float, refused: bool) -> float:
    """STM-06, as ``functions.arrays.pacing`` folds it."""
    return min(wait * SLOWER, MOST) if refused else max(wait * FASTER, FIRST)


def fetch(url: str, timeout: float) -> tuple[int | None, str | None, str | None]:
    """status, body, error of one request."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            return answer.status, answer.read().decode("utf-8", "replace"), None
    except urllib.error.HTTPError as e:
        return e.code, None, str(e)
    except OSError as e:
        return None, None, "timeout" if isinstance(e, TimeoutError) else str(e)


class Pages(DataSource):
    """Options: url (with {page}), first (0), pages (of a batch at most, 50), link (a regular expression: a page with a match isn't the end), timeout, pace (of waits, 1), waits (a JSON list, of refusals)."""

    @classmethod
    def name(cls) -> str:
        return "vigilake_pages"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema):
        return PageReader(self.options)


class PageReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.url, self.at = options["url"], int(options.get("first", "0"))
        self.most, self.link = int(options.get("pages", "50")), re.compile(options.get("link", r"(?i)href\s*=\s*[\"'][^\"']+\.pdf[\"']"))
        self.timeout, self.pace = float(options.get("timeout", "60")), float(options.get("pace", "1"))
        self.waits = [float(x) for x in json.loads(options["waits"])] if "waits" in options else WAITS
        self.wait = FIRST

    def initialOffset(self) -> dict:
        return {"page": self.at, "wait_ms": int(1000 * FIRST)}

    def _page(self, page: int) -> tuple:
        """One page, asked again after refusals; a page that fails for good is a row with an error."""
        url = self.url.format(page=page)
        for again in (*self.waits, None):
            status, body, error = fetch(url, self.timeout)
            self.wait = next_wait(self.wait, status == 429)
            if status != 429 or again is None:
                break
            time.sleep(again * self.pace)
        return page, url, status, body, error

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """Pages from start on up to the first without a link or with an error, which is not passed."""
        rows, page, self.wait = [], start["page"], start["wait_ms"] / 1000
        while len(rows) < self.most:
            row = self._page(page)
            if row[3] is None or not self.link.search(row[3]):
                break
            rows.append(row)
            page += 1
            time.sleep(self.wait * self.pace)
        # an offset that only differs in its wait would be a batch without pages
        return iter(rows), {"page": page, "wait_ms": round(1000 * self.wait)} if rows else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The pages of a batch that is run again after a failure."""
        return iter([self._page(page) for page in range(start["page"], end["page"])])

    def commit(self, end: dict) -> None:
        pass


def listing(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """The stream of pages. url: with {page} where the number goes."""
    ship(spark)
    spark.dataSource.register(Pages)
    return spark.readStream.format("vigilake_pages").options(url=url, **options).load()


def links_of(pages: DataFrame, base: str) -> DataFrame:
    """SRC-17: page, filename, link of the documents that pages name."""
    found = pdf_links(pages.select("page", "body"), "body")
    return found.select("page", F.element_at(F.split("href", "/"), -1).alias("filename"), absolute(base, F.col("href")).alias("link"))


def collect_links(spark: SparkSession, url: str, target: str, checkpoint: str, **options: str) -> int:
    """Append the links of pages not read before to target, batch by batch until the listing's end; the number of pages read."""
    total = 0
    while True:
        stream = links_of(listing(spark, url, **options), url.format(page=0))
        query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
        query.awaitTermination()
        pages = sum(p["numInputRows"] for p in query.recentProgress)
        total += pages
        if not pages:
            return total
