"""Searches of paged services as streams: a stopped search goes on where it was.

An offset is the number of pages that are done, or the cursor of the next one; Spark keeps it in the query's checkpoint, with
the batch that was under way. So a page that is in the sink is not asked for again, and one of a batch that was cut off is.

page_stream(): pages that are known by number; a batch's pages are requests of its tasks. The number of pages is asked for anew for each
batch, so a search that grows goes on. cursor_stream(): each answer names the next page, so they come one after the other.
Both: page, payload. Errors of a service are tried again as in services.with_retries(), and then stop the query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

from litmill.sources.services import PAUSE, Client, with_retries

SCHEMA = "page int, payload string"


class _Page(InputPartition):
    def __init__(self, page: int):
        self.page = page


class _Numbered(DataSourceStreamReader):
    def __init__(self, client: Client, pages: Callable[[], int], fixed: dict, a_batch: int | None, pause: float):
        self.client, self.pages, self.fixed, self.a_batch, self.pause = client, pages, fixed, a_batch, pause
        self.done: int | None = None  # pages of the batches so far, if this run knows

    def initialOffset(self) -> dict:
        self.done = 0
        return {"done": 0}

    def latestOffset(self) -> dict:
        total = self.pages()
        if self.a_batch is not None and self.done is not None:
            total = min(total, self.done + self.a_batch)
        return {"done": max(total, self.done or 0)}

    def partitions(self, start: dict, end: dict) -> list[_Page]:
        self.done = end["done"]
        return [_Page(n) for n in range(start["done"], end["done"])]

    def read(self, partition: _Page) -> Iterator[tuple]:
        yield partition.page + 1, with_retries(self.client, {**self.fixed, "page": partition.page + 1}, pause=self.pause)

    def commit(self, end: dict) -> None:
        self.done = end["done"]


class _Following(SimpleDataSourceStreamReader):
    def __init__(self, client: Client, following: Callable[[str], str | None], fixed: dict, first: str, pause: float):
        self.client, self.following, self.fixed, self.first, self.pause = client, following, fixed, first, pause

    def initialOffset(self) -> dict:
        return {"done": 0, "cursor": self.first}

    def _answer(self, at: dict) -> tuple[str, dict]:
        payload = with_retries(self.client, {**self.fixed, "cursor": at["cursor"]}, pause=self.pause)
        return payload, {"done": at["done"] + 1, "cursor": self.following(payload)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["cursor"] is None:
            return iter(()), start
        payload, end = self._answer(start)
        return iter([(end["done"], payload)]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        while start["done"] < end["done"]:
            payload, start = self._answer(start)
            yield start["done"], payload

    def commit(self, end: dict) -> None:
        pass


def _stream(spark: SparkSession, name: str, reader: Callable) -> DataFrame:
    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

    setattr(Pages, reader.__name__, lambda self, schema: reader())
    spark.dataSource.register(Pages)
    return spark.readStream.format(name).load()


def page_stream(spark: SparkSession, client: Client, pages: Callable[[], int], *, a_batch: int | None = None, name: str = "numbered_pages", pause: float = PAUSE, **fixed) -> DataFrame:
    """pages: asks how many pages the search has by now. a_batch: pages of a batch at most; a run that goes on takes all that are left in its first one."""

    def streamReader():
        return _Numbered(client, pages, fixed, a_batch, pause)

    return _stream(spark, name, streamReader)


def cursor_stream(spark: SparkSession, client: Client, following: Callable[[str], str | None], *, first: str = "*", name: str = "following_pages", pause: float = PAUSE, **fixed) -> DataFrame:
    """following: of a payload the cursor of the next page, or None behind the last."""

    def simpleStreamReader():
        return _Following(client, following, fixed, first, pause)

    return _stream(spark, name, simpleStreamReader)
