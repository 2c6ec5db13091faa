"""Page and edge files, statistics, benchmarks, judgments, external results."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGES = "url string, title string, text string, content_type string, crawled_at string, status int, depth int"
EDGES = "src_url string, dst_url string"
BENCHMARK = "query_id string, query_text string, topic string, judged_subset boolean, demo_candidate boolean"


def read_pages(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Pages with status 200 of a file of JSON lines. A malformed line fails, or (not strict) gives a row that has only _corrupt."""
    schema = PAGES if strict else PAGES + ", _corrupt string"
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    pages = reader.json(path)
    return pages.where("status = 200") if strict else pages


def read_pages_tolerant(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All pages that can be read, with status as a number (0 if it is none), and a row with lines_read and json_errors."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    fields = "url string, title string, text string, content_type string, crawled_at string, status string, depth string"
    parsed = lines.select("value", F.from_json("value", fields + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("p"))
    good = parsed.where("p._corrupt is null").select("p.url", "p.title", "p.text", "p.content_type", "p.crawled_at", *(F.expr(f"coalesce(try_cast(p.{c} as int), 0)").alias(c) for c in ("status", "depth")))
    counts = parsed.agg(F.count(F.lit(1)).alias("lines_read"), F.count_if(F.col("p._corrupt").isNotNull()).alias("json_errors"))
    return good, counts


def number_pages(pages: DataFrame, order: str = "url") -> DataFrame:
    """doc_id from 1 on, in the order of a column. For whole corpora give ids where they are made: one window numbers all rows."""
    return pages.withColumn("doc_id", F.row_number().over(Window.orderBy(order)).cast("long"))


def last_doc_of_url(pages: DataFrame) -> DataFrame:
    """url, doc_id: of equal URLs the row that comes last."""
    return pages.groupBy("url").agg(F.max("doc_id").alias("doc_id"))


def read_edges(spark: SparkSession, path: str, drop_empty: bool = False) -> DataFrame:
    """src_url and dst_url of a CSV file with a header, trimmed; more fields than two are ignored."""
    rows = spark.read.schema(EDGES).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True).csv(path)
    rows = rows.select(F.trim("src_url").alias("src_url"), F.trim("dst_url").alias("dst_url"))
    return rows.where("coalesce(src_url, '') <> '' and coalesce(dst_url, '') <> ''") if drop_empty else rows


def append_pages(pages: DataFrame, path: str) -> None:
    pages.write.mode("append").json(path)


def append_edges(edges: DataFrame, path: str) -> None:
    """Files with a header each; none if there is nothing to write."""
    if not edges.isEmpty():
        edges.select("src_url", "dst_url").write.mode("append").option("header", True).csv(path)


def crawl_stats(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """total_pages, total_edges, timestamp."""
    n = pages.agg(F.count(F.lit(1)).alias("total_pages"))
    return n.crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("total_edges")))).withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))


def read_benchmark(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """Queries of a JSON list; another number of them than `rows` fails when they are read."""
    queries = spark.read.schema(BENCHMARK).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if rows is not None and (n := queries.count()) != rows:
        raise ValueError(f"{path} has {n} queries instead of {rows}")
    return queries


def demo_queries(queries: DataFrame) -> DataFrame:
    return queries.where("demo_candidate")


def judged_queries(queries: DataFrame) -> DataFrame:
    return queries.where("judged_subset").select("query_id").distinct()


def write_judgments(rows: DataFrame, path: str) -> None:
    """One CSV file: a template for people to fill in."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def normalise_external(rows: DataFrame, most: int = 10) -> DataFrame:
    """Of rows(engine, position, title, link, displayed_link, snippet, source): those with a title and a link, numbered anew, `most` for each engine."""
    order = Window.partitionBy("engine").orderBy("position", "link")
    good = rows.where("coalesce(title, '') <> '' and coalesce(link, '') <> ''").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return good.select("engine", "rank", "title", F.col("link").alias("url"), F.coalesce("displayed_link", "source", F.lit("")).alias("display_url"), F.coalesce("snippet", F.lit("")).alias("snippet"))


def external_params(query: str, engine: str, key: str, most: int = 10) -> dict[str, str]:
    return {"engine": engine, "q": query, "num": str(most), "api_key": key}


def read_env(path: str | Path) -> dict[str, str]:
    """Names and values of a file of NAME=value lines; blank lines and comments are passed over, quotes around a value dropped. No file, no
    names. For settings that a session doesn't give: shared.setting comes first."""
    path, out = Path(path), {}
    for line in path.read_text(encoding="utf-8").splitlines() if path.exists() else ():
        name, equals, value = line.partition("=")
        if equals and name.strip() and not name.lstrip().startswith("#"):
            out.setdefault(name.strip(), value.strip().strip("\"'"))
    return out


def read_json(path: str | Path) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_json(path: str | Path, payload: Any) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload, indent=2, ensure_ascii=False), encoding="utf-8")


def write_reports(folder: str | Path, sections: Iterable[tuple[str, str]]) -> Path:
    """A text file for each (name, text), and one that holds them all."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    merged = []
    for name, text in sections:
        (folder / f"{name}.txt").write_text(text, encoding="utf-8")
        merged.append(f"== {name} ==\n{text}")
    whole = folder / "report.txt"
    whole.write_text("\n\n".join(merged), encoding="utf-8")
    return whole
