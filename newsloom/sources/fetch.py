"""Documents fetched by URL under a time and a size limit, as a data source and as a step on a frame of URLs.

A document's size is asked for before it is read (a file's status, a response's length), and no more
than the limit is read of one that does not tell. What goes wrong is in the row: the host and its
status, or that the document is too large. Sizes are bytes.

``spark.read.format("bounded_fetch")`` takes ``urls`` (a JSON array) or ``list`` (a text file of one URL a
line, which its readers read for themselves), ``cap``, ``timeout``, ``accept`` and ``group``, the URLs of one partition.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FEED_CAP, PAGE_CAP, TIMEOUT, GROUP = 2_000_000, 2_500_000, 15.0, 64
SCHEMA = "url string, bytes long, body string, error string"


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def fetch(url: str | None, cap: int, timeout: float = TIMEOUT, accept: str = "*/*") -> tuple[int | None, str | None, str | None]:
    """(bytes, text, error) of one document; the size is known of a refused one where its host tells it."""
    try:
        parts = urlsplit(url or "")
        host = parts.hostname or parts.scheme or "no host"
        if parts.scheme in ("http", "https"):
            request = urllib.request.Request(url, headers={"Accept": accept})
            with urllib.request.urlopen(request, timeout=timeout) as response:
                told = response.headers.get("content-length")
                if told and told.isdigit() and int(told) > cap:
                    return int(told), None, f"{host} response is too large"
                raw = response.read(cap + 1)
            return (len(raw), _text(raw), None) if len(raw) <= cap else (None, None, f"{host} response is too large")
        if parts.scheme == "file":
            path = unquote(parts.path)
            size = os.stat(path).st_size
            if size > cap:
                return size, None, "file response is too large"
            with open(path, "rb") as held:
                return size, _text(held.read()), None
        store, path = fs.FileSystem.from_uri(url)
        info = store.get_file_info(path)
        if info.type != fs.FileType.File:
            return None, None, f"{host} returned 404"
        if info.size > cap:
            return info.size, None, f"{host} response is too large"
        with store.open_input_stream(path) as held:
            return info.size, _text(held.read()), None
    except urllib.error.HTTPError as error:
        return None, None, f"{urlsplit(url).hostname} returned {error.code}"
    except Exception as error:  # noqa: BLE001  a document that can't be had is a row, not the end of all others
        return None, None, str(error) or type(error).__name__


@dataclass
class Group(InputPartition):
    urls: list[str]


class FetchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.cap, self.timeout = int(self.options.get("cap", PAGE_CAP)), float(self.options.get("timeout", TIMEOUT))
        self.group, self.accept = int(self.options.get("group", GROUP)), self.options.get("accept", "*/*")

    def partitions(self) -> list[Group]:
        if "urls" in self.options:
            urls = json.loads(self.options["urls"])
        else:
            store, path = fs.FileSystem.from_uri(self.options["list"]) if "://" in self.options["list"] else (fs.LocalFileSystem(), self.options["list"])
            with store.open_input_stream(path) as held:
                urls = [line for line in _text(held.read()).splitlines() if line.strip()]
        return [Group(urls[i : i + self.group]) for i in range(0, len(urls), self.group)] or [Group([])]

    def read(self, partition: Group):
        for url in partition.urls:  # one document at a time in memory
            size, body, error = fetch(url, self.cap, self.timeout, self.accept)
            yield pa.RecordBatch.from_pydict({"url": pa.array([url]), "bytes": pa.array([size], pa.int64()), "body": pa.array([body], pa.string()), "error": pa.array([error], pa.string())})


class BoundedFetch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bounded_fetch"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FetchReader:
        return FetchReader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(BoundedFetch)
    return spark


def fetched(urls: DataFrame, cap: int, timeout: float = TIMEOUT, accept: str = "*/*") -> DataFrame:
    """(url, bytes, body, error) of each distinct URL of a frame that has ``url``: the step of a flow whose URLs come from data."""

    def run(batches):
        for batch in batches:
            for url in batch.column(0).to_pylist():
                size, body, error = fetch(url, cap, timeout, accept)
                yield pa.RecordBatch.from_pydict({"url": pa.array([url], pa.string()), "bytes": pa.array([size], pa.int64()), "body": pa.array([body], pa.string()), "error": pa.array([error], pa.string())})

    return urls.select("url").where("url IS NOT NULL").distinct().mapInArrow(run, SCHEMA)


def archived(urls: DataFrame, pages: DataFrame, cap: int = PAGE_CAP) -> DataFrame:
    """The same from a table of pages (url, body) in place of the network; a URL without page is not found."""
    size = F.octet_length("body")
    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("no host"))
    held = pages.groupBy("url").agg(F.min("body").alias("body"))
    rows = urls.select("url").where("url IS NOT NULL").distinct().join(held, "url", "left")
    error = F.when(F.col("body").isNull(), F.concat(host, F.lit(" returned 404"))).when(size > cap, F.concat(host, F.lit(" response is too large")))
    return rows.select("url", size.cast("long").alias("bytes"), F.when(size <= cap, F.col("body")).alias("body"), error.alias("error"))
