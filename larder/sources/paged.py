"""Documents of a paged REST source, newest first, as a table and as a stream: a page is a partition.

`spark.dataSource.register(PagedDocuments)`, then `spark.read.format("paged_documents").option("url", ...).option("tag", ...).load()`. The driver asks for the tag's number and the count alone; executors fetch pages and ask again where a request fails. A document that is modified while pages are read can move to a page already read, so `documents` asks for nothing newer than the moment the read was planned, and keeps one row an id.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from larder.streaming.changes import newest

# fixed values: the source's page size and most documents a load, its paths and parameters
PAGE, MOST = 100, 500
TAGS, DOCUMENTS = "/api/tags/", "/api/documents/"
SCHEMA = "id long, title string, modified string, content string"
TRIES = 4


def fetch(url: str, path: str, params: dict, token: str = "", tries: int = TRIES) -> dict:
    """The JSON that a request answers; a server's fault or a lost connection is tried again, a refusal is not."""
    request = urllib.request.Request(f"{url.rstrip('/')}{path}?{urllib.parse.urlencode(params)}", headers={"Authorization": f"Token {token}"} if token else {})
    for n in range(tries):
        try:
            with urllib.request.urlopen(request, timeout=60) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code < 500 or n == tries - 1:
                raise
        except (urllib.error.URLError, TimeoutError):
            if n == tries - 1:
                raise
        time.sleep(0.2 * 2**n)
    raise AssertionError("no try")


class Page(InputPartition):
    def __init__(self, number: int, keep: int, after: str, until: str) -> None:
        self.number, self.keep, self.after, self.until = number, keep, after, until


class _Source:
    def __init__(self, options: dict) -> None:
        self.url, self.token = options["url"], options.get("token", "")
        self.size, self.most = int(options.get("page_size", PAGE)), int(options.get("most", MOST))
        tag = options["tag"]
        found = fetch(self.url, TAGS, {"name__iexact": tag, "page_size": 5}, self.token).get("results", [])
        if not found:
            raise ValueError(f"tag not found, or not visible: {tag}")
        self.tag = int(found[0]["id"])

    def _params(self, after: str, until: str, size: int) -> dict:
        between = {k: v for k, v in (("modified__gt", after), ("modified__lte", until)) if v}
        return {"tags__id__all": self.tag, "page_size": size, "ordering": "-modified", **between}

    def newest(self) -> str:
        rows = fetch(self.url, DOCUMENTS, self._params("", "", 1) | {"page": 1}, self.token).get("results", [])
        return rows[0]["modified"] if rows else ""

    def pages(self, after: str, until: str, most: int | None) -> list[Page]:
        n = int(fetch(self.url, DOCUMENTS, self._params(after, until, 1) | {"page": 1}, self.token).get("count", 0))
        n = n if most is None else min(n, most)
        return [Page(i // self.size + 1, min(self.size, n - i), after, until) for i in range(0, n, self.size)]

    def read(self, page: Page | None) -> Iterator[tuple]:
        if page is None:  # Spark asks for one partition where there is none
            return
        rows = fetch(self.url, DOCUMENTS, self._params(page.after, page.until, self.size) | {"page": page.number}, self.token).get("results", [])
        for r in rows[: page.keep]:
            yield int(r["id"]), r.get("title"), r.get("modified"), r.get("content")


class PagedReader(_Source, DataSourceReader):
    def partitions(self) -> list[Page]:
        until = self.newest()
        return self.pages("", until, self.most) if until else []


class PagedStream(_Source, DataSourceStreamReader):
    """The offset is the newest time of modification that was read; a batch is all that was modified since, without a limit, as what a limit leaves out would never come."""

    def initialOffset(self) -> dict:
        return {"modified": ""}

    def latestOffset(self) -> dict:
        return {"modified": self.newest()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return self.pages(start["modified"], end["modified"], None) if end["modified"] > start["modified"] else []


class PagedDocuments(DataSource):
    """Options: url, tag; token, page_size (100), most (500, of a table)."""

    @classmethod
    def name(cls) -> str:
        return "paged_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options)

    def streamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(self.options)


def documents(spark: SparkSession, url: str, tag: str, **options: str) -> DataFrame:
    """id, title, modified, content of the newest documents that bear the tag; a tag that isn't there raises."""
    spark.dataSource.register(PagedDocuments)
    return newest(spark.read.format(PagedDocuments.name()).options(url=url, tag=tag, **options).load(), "id", "modified")


def to_import(documents: DataFrame, done: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """What a load takes of documents (id, modified, ...): those not in `done` (id, modified) or modified since; those with an id in `skip` (read already, or a recipe's) never. A null id goes."""
    last = done.groupBy(F.col("id").alias("_id")).agg(F.max("modified").alias("_modified"))
    out = documents.where("id IS NOT NULL").join(last, F.col("id") == F.col("_id"), "left").where("_id IS NULL OR modified > _modified").drop("_id", "_modified")
    return out if skip is None else out.join(skip.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti")
