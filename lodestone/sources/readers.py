"""Sources: code corpora, finance samples with a fallback, bars, vendor payloads over a pluggable fetcher."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.mixing import interleave

#: The fields of a code sample; a file may lack any of them.
CODE = "content string, lang string, size long, ext string, max_stars_repo_name string"
#: The alternative shapes of a finance sample.
FINANCE = "instruction string, output string, question string, answer string, text string"
BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def _first_that_opens(attempts: list[Callable[[], DataFrame]]) -> DataFrame:
    last: Exception | None = None
    for attempt in attempts:
        try:
            return attempt()
        except AnalysisException as e:  # the path is missing or holds nothing
            last = e
    raise FileNotFoundError("no source could be opened") from last


def code_corpus(spark: SparkSession, root: str, languages: list[str], order: str | None = None) -> DataFrame:
    """Parquet folders ``root/data/<language>``; a language that cannot be opened is skipped, none at all is an error.

    The schema is given, so no file is opened for it; ``language`` comes from the folder and prunes the scan. With ``order``
    (a number column) several languages take turns, until the smallest is exhausted: ``turn`` and ``place`` as in ``interleave``.
    """
    found = []
    for name in languages:
        try:
            found.append(spark.read.schema(CODE).option("ignoreMissingFiles", True).parquet(f"{root}/data/{name}").withColumn("language", F.lit(name)))
        except AnalysisException:
            continue
    if not found:
        raise FileNotFoundError(f"none of {languages} could be opened under {root}")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out if order is None else interleave(out, "language", order)


def finance_samples(spark: SparkSession, primary: str, fallback: str) -> DataFrame:
    """Parquet at ``primary``, else JSON lines at ``fallback``, else an error; all shapes' columns are there."""
    return _first_that_opens([lambda: spark.read.schema(FINANCE).parquet(primary), lambda: spark.read.schema(FINANCE).json(fallback)])


def instructions(spark: SparkSession, path: str) -> DataFrame:
    return _first_that_opens([lambda: spark.read.schema(FINANCE).parquet(path), lambda: spark.read.schema(FINANCE).json(path)])


def bars(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Bars from Parquet or from CSV with a header; times are read in the session's zone."""
    reader = spark.read.schema(BARS)
    return reader.option("header", True).csv(path) if kind == "csv" else reader.parquet(path)


def knowledge(spark: SparkSession, path: str) -> DataFrame:
    """Knowledge rows from JSON lines; an unreadable or missing file gives an empty table."""
    schema = "category string, key string, value string, metadata string, created_at timestamp, updated_at timestamp"
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


class _Request(InputPartition):
    def __init__(self, url: str):
        self.url = url


class PayloadReader(DataSourceReader):
    """One request a partition; a failed one gives the payload of an error without data."""

    def __init__(self, urls: list[str], timeout: float, fetch: Callable[[str, float], str] | None):
        self.urls, self.timeout, self.fetch = urls, timeout, fetch

    def partitions(self) -> list[InputPartition]:
        return [_Request(u) for u in self.urls]

    def read(self, partition: _Request | None) -> Iterator[tuple[str, str]]:
        if partition is None:  # there are no requests
            return
        try:
            if self.fetch:
                body = self.fetch(partition.url, self.timeout)
            else:
                from urllib.request import urlopen

                with urlopen(partition.url, timeout=self.timeout) as answer:  # noqa: S310  the caller names the address
                    body = answer.read().decode("utf-8", "replace")
        except OSError as e:
            body = json.dumps({"code": "-1", "msg": str(e), "data": []})
        yield partition.url, body


def payload_source(fetch: Callable[[str, float], str] | None = None) -> type[DataSource]:
    """A data source ``payloads`` (options ``urls``, by line, and ``timeout``) with columns url and body; ``fetch`` replaces the network."""

    class Payloads(DataSource):
        @classmethod
        def name(cls) -> str:
            return "payloads"

        def schema(self) -> str:
            return "url string, body string"

        def reader(self, schema) -> DataSourceReader:
            urls = [u for u in self.options.get("urls", "").split("\n") if u]
            return PayloadReader(urls, float(self.options.get("timeout", "10")), fetch)

    return Payloads
