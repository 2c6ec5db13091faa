"""Experiments: a baseline ranking against its reranking by each clustering, over all benchmark queries at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate
from ..shared import materialise
from .clusters import CLUSTERINGS, Build


@dataclass
class Experiment:
    """results(system, query_id, rank, doc_id, score, cluster_id, cluster_affinity, rank_delta), metrics, summary and deltas(query_id, topic, system, delta)."""

    results: DataFrame
    metrics: DataFrame
    summary: DataFrame
    deltas: DataFrame

    def judge(self, qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
        per_query = evaluate.judged_metrics(self.results.select("system", "query_id", "rank", "doc_id"), qrels)
        return per_query, evaluate.mean_by_system(per_query)

    def template(self, judged: DataFrame | None = None) -> DataFrame:
        runs = self.results if judged is None else self.results.join(judged, "query_id", "left_semi")
        return evaluate.judgment_pool(runs)

    def examples(self, demo: DataFrame | None = None) -> DataFrame:
        rows = self.deltas if demo is None else self.deltas.join(demo, "query_id", "left_semi")
        return evaluate.pick_examples(rows)


def run_experiment(queries: DataFrame, hits: DataFrame, query_vectors: DataFrame, build: Build, methods=CLUSTERINGS) -> Experiment:
    """queries(query_id, topic), hits(query_id, rank, doc_id, score): the baseline's."""
    columns = ["system", "query_id", "rank", "doc_id", "score", "cluster_id", "cluster_affinity", "rank_delta"]
    results = hits.select(F.lit("baseline").alias("system"), "query_id", "rank", "doc_id", "score", F.lit(None).cast("int").alias("cluster_id"), F.lit(0.0).alias("cluster_affinity"), F.lit(0).alias("rank_delta"))
    for m in methods:
        results = results.unionByName(build.rerank(hits, query_vectors, m)[0].withColumn("system", F.lit(m)).select(*columns))
    results = materialise(results, "experiment-results")
    metrics = materialise(evaluate.automatic_metrics(results), "experiment-metrics")
    affinity = "average_query_cluster_affinity_at_10"
    base = metrics.where("system = 'baseline'").select("query_id", F.col(affinity).alias("was"))
    deltas = metrics.where("system <> 'baseline'").join(base, "query_id").join(queries.select("query_id", "topic"), "query_id").select("query_id", "topic", "system", F.round(F.col(affinity) - F.col("was"), 4).alias("delta"))
    return Experiment(results, metrics, evaluate.mean_by_system(metrics), deltas)
