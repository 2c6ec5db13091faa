"""Tables behind expansion reports, for all queries at once, and their text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import expand
from ..shared import materialise
from .engine import SearchEngine

METHODS = ("association", "scalar", "metric")
#: What an evaluation compares.
EVALUATED = ("rocchio", "association", "scalar", "metric")
#: Neighbours of a query term that a report shows.
SHOWN = 12


def correlations(engine: SearchEngine, terms: DataFrame, local: DataFrame, method: str, most: int = SHOWN) -> DataFrame:
    """query_id, u, rank, v, raw, strength: the closest terms of each query term in the local documents."""
    if method == "metric":
        raw = expand.metric(engine.index.docs, local, terms, engine.stemmer)
    else:
        tf = materialise(expand.local_tf(engine.index, local), "report-tf")
        raw = expand.association(tf, terms) if method == "association" else expand.scalar(tf, terms)
    return closest(raw, most)


def closest(raw: DataFrame, most: int = SHOWN) -> DataFrame:
    order = Window.partitionBy("query_id", "u").orderBy(F.round("raw", 9).desc(), "v")
    shown = raw.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return shown.select("query_id", "u", "rank", "v", F.round("raw", 6).alias("raw"), expand.metric_strength(F.round("raw", 6)).alias("strength"))


def local_vocabulary(engine: SearchEngine, local: DataFrame) -> DataFrame:
    """query_id, n_docs, n_terms, n_shared (terms of two local documents or more), n_tokens."""
    own = engine.index.postings.join(local, "doc_id")
    per_term = own.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tf"))
    docs = local.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_docs"))
    sums = per_term.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"), F.count_if(F.col("n") > 1).alias("n_shared"), F.sum("tf").alias("n_tokens"))
    return docs.join(sums, "query_id")


def before_and_after(engine: SearchEngine, queries: DataFrame, methods=EVALUATED, search: str = "hits", k: int = 10) -> DataFrame:
    """method, query_id, kept, new: of each query's first k results, those that expansion leaves and those that it brings."""
    plain = materialise(engine.rank(engine.terms(queries), search, k).select("query_id", "doc_id"), "report-before")
    out = None
    for m in methods:
        wider = materialise(engine.expanded(queries, m), "report-expanded")
        after = engine.rank(engine.terms(wider), search, k).select("query_id", "doc_id").join(plain.withColumn("was", F.lit(True)), ["query_id", "doc_id"], "left")
        one = after.groupBy("query_id").agg(F.count_if(F.col("was").isNotNull()).alias("kept"), F.count_if(F.col("was").isNull()).alias("new")).select(F.lit(m).alias("method"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def report_sections(engine: SearchEngine, queries: DataFrame, method: str) -> Iterator[tuple[str, str]]:
    """(name, text) of each query's report. For the few queries of a report: their rows come to the driver."""
    terms = materialise(engine.terms(queries), "report-terms")
    local = engine.local_docs(terms)
    rows: dict = {}
    for r in correlations(engine, terms, local, method).orderBy("query_id", "u", "rank").collect():
        rows.setdefault(r["query_id"], []).append(f"{r['u']:<16} {r['rank']:>2}  {r['v']:<20} {r['raw']:>12.6f}  {r['strength']}")
    counts = {r["query_id"]: r for r in local_vocabulary(engine, local).collect()}
    added = {r["query_id"]: r["query"] for r in engine.expanded(queries, method).collect()}
    for q in queries.orderBy("query_id").collect():
        c = counts.get(q["query_id"])
        head = f"Query: {q['query']}\nExpanded: {added.get(q['query_id'], q['query'])}\n"
        stats = f"Local documents: {c['n_docs']}, terms: {c['n_terms']}, in two or more: {c['n_shared']}\n" if c else "No local documents\n"
        yield f"{method}_{q['query_id']}", head + stats + "\n".join(rows.get(q["query_id"], []))
