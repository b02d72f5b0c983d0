
from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "request string, status int, body string, error string"
#: Waits after the refusals 429, seconds.
WAITS = (30, 60, 120)


class RestSource(DataSource):
    """Options: urls (a JSON list); recorded (a JSON object url -> body) for offline use; timeout in seconds."""

    @classmethod
    def name(cls) -> str:
        return "vigilake_rest"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return RestReader(self.options)


class RestReader(DataSourceReader):
    def __init__(self, options):
        self.urls = json.loads(options.get("urls", "[]"))
        self.recorded = json.loads(options["recorded"]) if "recorded" in options else None
        self.timeout = float(options.get("timeout", "45"))

    def partitions(self):
        return [InputPartition(i) for i in range(len(self.urls))]

    def read(self, partition) -> Iterator[tuple]:
        """One answer; a failure or timeout is a row with an error, so that other sources go on."""
        url = self.urls[partition.value]
        if self.recorded is not None:
            body = self.recorded.get(url)
            yield (url, 200 if body is not None else 404, body, None)
            return
        for wait in (*WAITS, None):
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as answer:
                    yield (url, answer.status, answer.read().decode("utf-8", "replace"), None)
                    return
            except urllib.error.HTTPError as e:
                if e.code == 429 and wait is not None:
                    time.sleep(wait)
                    continue
                yield (url, e.code, None, str(e))
                return
            except OSError as e:
                yield (url, None, None, "timeout" if isinstance(e, TimeoutError) else str(e))
                return


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RestSource)


def request(url: str, **params: str) -> str:
    return f"{url}?{urllib.parse.urlencode(params)}"
