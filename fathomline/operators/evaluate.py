"""Measures of result lists, pools for judging, and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POOL = 10


def _gain(rel: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1.0)


def last_judgments(judged: DataFrame, order: str) -> DataFrame:
    """Of repeated judgments of a query and document the last."""
    return judged.groupBy("query_id", "doc_id").agg(F.max_by("rel", order).alias("rel"))


def judged_metrics(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """For runs(system, query_id, rank, doc_id) and qrels(query_id, doc_id, rel): precision and success at 5 and 10, reciprocal rank and nDCG at 5 and
    10, of each system and query that has judgments. Precision divides by k, however many results there are."""
    known = qrels.select("query_id").distinct()
    rows = runs.join(known, "query_id", "left_semi").join(qrels, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")
    ideal = qrels.withColumn("place", F.row_number().over(order)).where("place <= 10")
    at = lambda k, value: F.sum(F.when(F.col("rank") <= k, value).otherwise(0.0))
    ideal = ideal.groupBy("query_id").agg(*(F.sum(F.when(F.col("place") <= k, _gain(F.col("rel"), F.col("place"))).otherwise(0.0)).alias(f"ideal{k}") for k in (5, 10)))
    hit = F.when(F.col("rel") > 0, 1.0).otherwise(0.0)
    sums = rows.groupBy("system", "query_id").agg(
        *((at(k, hit) / k).alias(f"precision_at_{k}") for k in (5, 10)), *(F.max(F.when(F.col("rank") <= k, hit).otherwise(0.0)).alias(f"success_at_{k}") for k in (5, 10)),
        F.coalesce(F.max(F.when(F.col("rel") > 0, 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr"), *(at(k, _gain(F.col("rel"), F.col("rank"))).alias(f"dcg{k}") for k in (5, 10)),
    )
    done = sums.join(ideal, "query_id", "left")
    ndcg = [F.when(F.coalesce(F.col(f"ideal{k}"), F.lit(0.0)) > 0, F.col(f"dcg{k}") / F.col(f"ideal{k}")).otherwise(0.0).alias(f"ndcg_at_{k}") for k in (5, 10)]
    columns = ["precision_at_5", "precision_at_10", "success_at_5", "success_at_10", "mrr"]
    wide = done.select("system", "query_id", *columns, *ndcg)
    return wide.select("system", "query_id", *(F.round(c, 4).alias(c) for c in [*columns, "ndcg_at_5", "ndcg_at_10"]))


def mean_by_system(metrics: DataFrame) -> DataFrame:
    names = [c for c in metrics.columns if c not in ("system", "query_id")]
    return metrics.groupBy("system").agg(*(F.round(F.avg(c), 4).alias(c) for c in names))


def automatic_metrics(results: DataFrame, k: int = 10) -> DataFrame:
    """For results(system, query_id, rank, cluster_id, cluster_affinity, rank_delta): share of the first k in the first one's cluster, share of the
    largest cluster, mean affinity, and mean move of all results."""
    top = results.where(F.col("rank") <= k)
    first = F.first_value("cluster_id").over(Window.partitionBy("system", "query_id").orderBy("rank"))
    sizes = top.where("cluster_id is not null").groupBy("system", "query_id", "cluster_id").agg(F.count(F.lit(1)).alias("n")).groupBy("system", "query_id").agg(F.max("n").alias("largest"))
    sums = top.withColumn("first", first).groupBy("system", "query_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("cluster_id") == F.col("first"), 1).otherwise(0)).alias("same"), F.avg(F.coalesce("cluster_affinity", F.lit(0.0))).alias("affinity"),
    )
    moves = results.groupBy("system", "query_id").agg(F.avg(F.abs("rank_delta")).alias("move"))
    done = sums.join(sizes, ["system", "query_id"], "left").join(moves, ["system", "query_id"])
    return done.select(
        "system", "query_id", F.round(F.col("same") / F.col("n"), 4).alias("cluster_coherence_at_10"), F.round(F.coalesce("largest", F.lit(0)) / F.col("n"), 4).alias("dominant_cluster_share_at_10"),
        F.round("affinity", 4).alias("average_query_cluster_affinity_at_10"), F.round("move", 4).alias("average_absolute_rank_shift"),
    )


def judgment_pool(runs: DataFrame, k: int = POOL) -> DataFrame:
    """query_id, doc_id, systems (in order, joined by ;): what to judge."""
    top = runs.where(F.col("rank") <= k)
    return top.groupBy("query_id", "doc_id").agg(F.array_join(F.array_sort(F.collect_set("system")), ";").alias("systems"))


def pick_examples(deltas: DataFrame, most: int = 3) -> DataFrame:
    """place, query_id, topic, system, delta: of deltas(query_id, topic, system, delta) the largest, each of another topic."""
    order = Window.partitionBy("topic").orderBy(F.desc("delta"), "query_id", "system")
    best = deltas.withColumn("n", F.row_number().over(order)).where("n = 1").orderBy(F.desc("delta"), "query_id").limit(most)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("delta"), "query_id"))).select("place", "query_id", "topic", "system", "delta")
