"""Pages over HTTP as a data source: spark.read.format("polite_pages").option("urls", json).load().

Requests go out one at a time and no faster than the delay (one partition: politeness is the portal's, not the cluster's),
are tried again as `fetch` says, and end as rows in any case: a failure is a row with `failed`, so a run goes on.

Options: urls (a JSON array), delay_ms (1200), retries (3), expect (a part of the content type), most_bytes, timeout (seconds).
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tarnfold.shipping import ship
from tarnfold.sources.fetch import Gate, polite

SCHEMA = "url string, status int, content_type string, bytes long, failed string, body binary"


def request(url: str, timeout: float, most_bytes: int | None = None) -> tuple[int, dict[str, str], bytes]:
    """(status, headers, body), whatever the status; of a body over most_bytes only so much is read as shows that."""
    try:
        answer = urllib.request.urlopen(url, timeout=timeout)
    except urllib.error.HTTPError as e:
        answer = e
    with answer:
        return answer.status, dict(answer.headers), answer.read() if most_bytes is None else answer.read(most_bytes + 1)


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = json.loads(options.get("urls", "[]"))
        self.delay, self.retries = float(options.get("delay_ms", 1200)) / 1000, int(options.get("retries", 3))
        self.expect, self.timeout = options.get("expect"), float(options.get("timeout", 60))
        self.most_bytes = int(options["most_bytes"]) if "most_bytes" in options else None

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.urls)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        gate = Gate(self.delay)
        for url in partition.value:
            got = polite(lambda url=url: request(url, self.timeout, self.most_bytes), gate, self.retries, self.expect, self.most_bytes)
            yield url, got["status"], got["content_type"], got["bytes"], got["failed"], got["body"]


class PolitePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "polite_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(PolitePages)
