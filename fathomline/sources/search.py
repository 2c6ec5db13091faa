"""A search service as a data source: spark.read.format("search_service").options(...).load()."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Asked(InputPartition):
    def __init__(self, query_id: str, query: str) -> None:
        self.query_id, self.query = query_id, query


class SearchService(DataSource):
    """query_id, body: the answer of the service at `url` to each query. Options: queries (a JSON list of [query_id, query]); search, top_k; http_method
    (POST with a JSON body, or GET); query_field, method_field, top_k_field; headers (a JSON object); timeout (seconds). Each query is a
    partition of its own, so that a lost executor costs its requests only."""

    @classmethod
    def name(cls) -> str:
        return "search_service"

    def schema(self) -> str:
        return "query_id string, body string"

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(self.options)


class SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)
        if "url" not in self.options or "queries" not in self.options:
            raise ValueError("the options url and queries are needed")

    def partitions(self) -> list[Asked]:
        return [Asked(str(i), q) for i, q in json.loads(self.options["queries"])]

    def read(self, partition: Asked) -> Iterator[tuple[str, str]]:
        get = self.options.get
        payload = {get("query_field", "query"): partition.query, get("method_field", "method"): get("search", "hits"), get("top_k_field", "top_k"): int(get("top_k", "10"))}
        headers = {"Content-Type": "application/json", **json.loads(get("headers", "{}"))}
        if get("http_method", "POST").upper() == "GET":
            request = urllib.request.Request(f"{get('url')}?{urllib.parse.urlencode(payload)}", headers=headers)
        else:
            request = urllib.request.Request(get("url"), data=json.dumps(payload).encode(), headers=headers, method="POST")
        with urllib.request.urlopen(request, timeout=float(get("timeout", "30"))) as answer:
            yield partition.query_id, answer.read().decode("utf-8")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SearchService)
