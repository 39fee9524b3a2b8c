"""Readers of landed files, and a data source that fetches where a network is there."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from factloom import schemas
from factloom.functions import text
from factloom.sources import feeds


def read_geoint(spark: SparkSession, path: str) -> DataFrame:
    """Detections from JSON; fields that don't fit are null, lines that are no object are left out."""
    rows = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(schemas.GEOINT + ", _bad string").json(path)
    return rows.where("_bad is null").drop("_bad")


def read_campaigns(spark: SparkSession, path: str) -> DataFrame:
    """Campaigns from JSON, as plain rows or as lists under `campaigns`."""
    fields = f"array<struct<{schemas.CAMPAIGN.replace(' string', ':string').replace(' array', ':array')}>>"
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"campaigns {fields}")["campaigns"]
    bare = F.from_json("value", fields)
    return raw.select(F.posexplode(F.coalesce(listed, bare)).alias("pos", "c")).where("c is not null").select("pos", "c.*")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of landed pages."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def article_list_url(base: str, query: str, most: int = 75, span: str = "3d", language: str | None = None) -> str:
    """Address of an article-list search: newest first, so many records, so far back, of one source language if given."""
    words = f"{query.strip()} sourcelang:{language}" if language else query.strip()
    return base + "?" + urllib.parse.urlencode({"query": words, "mode": "ArtList", "format": "json", "maxrecords": most, "timespan": span, "sort": "DateDesc"})


def _get(url: str) -> str:
    if not url.startswith(("http://", "https://")):
        raise ValueError("only http and https")
    with urllib.request.urlopen(url, timeout=20) as answer:  # noqa: S310
        return answer.read().decode("utf-8", "replace")


def fetch_articles(spark: SparkSession, question: str, base: str, get: Callable[[str], str] = _get, tries: int = 3, wait: Callable[[float], None] = time.sleep, pause: float = 5.0, **search) -> DataFrame:
    """Documents of an article-list search for a question: by its keywords, and where nothing comes back once more, after a
    pause, by its proper nouns alone. A request is tried again with growing waits; one that keeps failing, or answers with
    no JSON, gives no documents."""
    row = spark.createDataFrame([(question,)], "q string").select(text.keyword_query(F.col("q")).alias("words"), text.proper_noun_query(F.col("q")).alias("nouns")).first()

    def ask(query: str) -> str:
        for n in range(tries):
            try:
                body = get(article_list_url(base, query, **search))
                json.loads(body)
                return body
            except ValueError:
                return "{}"
            except OSError:
                if n + 1 < tries:
                    wait(min(10.0, 2.0**n))
        return "{}"

    body = ask(row.words)
    if not json.loads(body).get("articles") and row.nouns:
        wait(pause)
        body = ask(row.nouns)
    return feeds.parse_gdelt(spark.createDataFrame([(body,)], "payload string"))


class FetchSource(DataSource):
    """`spark.read.format("factloom_fetch").option("urls", "[…]")`: (url, status, body) of addresses, one partition each.

    Only http and https; an address that fails gives a row without body. Off unless it is registered."""

    @classmethod
    def name(cls) -> str:
        return "factloom_fetch"

    def schema(self) -> str:
        return "url string, status int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _FetchReader(self.options)


class _Url(InputPartition):
    pass


class _FetchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options.get("urls", "[]"))
        self.timeout = float(options.get("timeout", "6"))
        self.tries = int(options.get("tries", "3"))

    def partitions(self) -> list[InputPartition]:
        return [_Url(u) for u in self.urls] or [_Url(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        url = partition.value
        if url is None:
            return
        if not url.startswith(("http://", "https://")):
            yield url, None, None
            return
        status, body = None, None
        for _ in range(self.tries):
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as r:
                    status, body = r.status, r.read().decode("utf-8", "replace")
                    break
            except OSError:
                continue
        yield url, status, body
