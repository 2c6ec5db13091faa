"""Tables of an index, a graph, ranks and a cluster build, written once and read by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save(tables: dict[str, DataFrame], path: str, clustered: dict[str, str] | None = None) -> None:
    """A Parquet table for each name. `clustered` names the column that a table's rows are dealt out and sorted by, so that a scan for a few
    of its values reads few row groups."""
    for name, df in tables.items():
        by = (clustered or {}).get(name)
        out = df.repartitionByRange(by).sortWithinPartitions(by) if by else df
        out.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def save_index(index, path: str) -> None:
    save({"postings": index.postings, "terms": index.terms, "docs": index.docs, "stats": index.stats}, path, {"postings": "term", "terms": "term"})


def load_index(spark: SparkSession, path: str):
    from ..operators.index import Index

    return Index(**load(spark, path, "postings", "terms", "docs", "stats"))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    save({"nodes": nodes, "edges": edges}, path, {"edges": "src"})


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    found = load(spark, path, "nodes", "edges")
    return found["nodes"], found["edges"]
