"""Clusters: k-means, agglomeration, scores, names, representatives, and what they do to a ranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..shared import materialise

CANDIDATES, MINI_CLUSTERS, SEED, ROUNDS = (8, 12, 16, 20, 24), 512, 42, 200
TOP_TERMS, REPRESENTATIVES = 6, 3
#: Weights of the text score, the query's closeness to the cluster, and the cluster's support.
WEIGHTS = (0.70, 0.20, 0.10)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(scale > 0, dot(a, b) / scale).otherwise(0.0)


# -- fitting


def fit_kmeans(vectors: DataFrame, k: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of vectors(doc_id, vec)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    return np.array(KMeans(k=k, seed=seed, maxIter=rounds).fit(data).clusterCenters())


def centers_frame(spark, centers: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "cluster_id int, center array<double>")


def assign(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """vectors(doc_id, vec, ...) with cluster_id: the nearest center, the smallest id of equals (to 12 digits); null without a vector. Centers, a few
    hundred at most, go to every task, which takes a batch of vectors times all of them in one product."""
    rows = centers.select("cluster_id", "center").orderBy("cluster_id").collect()
    ids, matrix = pa.array([r["cluster_id"] for r in rows], pa.int32()), np.array([r["center"] for r in rows], np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            column = batch.column("vec")
            there = np.nonzero(column.is_valid().to_numpy(zero_copy_only=False))[0]
            nearest = np.full(batch.num_rows, -1)
            for at in range(0, len(there), 4096):
                part = there[at : at + 4096]
                x = column.take(pa.array(part)).flatten().to_numpy().astype(np.float64).reshape(len(part), -1)
                nearest[part] = np.round((x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)[None], 12).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, ids.take(pa.array(nearest, mask=nearest < 0))], names=[*batch.schema.names, "cluster_id"])

    return vectors.mapInArrow(run, StructType([*vectors.schema.fields, StructField("cluster_id", IntegerType())]))


def label_centroids(labelled: DataFrame) -> DataFrame:
    """cluster_id, center: means of labelled(cluster_id, vec), to unit length."""
    means = labelled.select("cluster_id", F.posexplode("vec")).groupBy("cluster_id", "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    rows = means.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("c"))
    norm = F.sqrt(dot(F.col("c"), F.col("c")))
    return rows.withColumn("norm", norm).select("cluster_id", F.transform("c", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(x)).alias("center"))


def agglomerate(points: np.ndarray, linkage: str) -> list[tuple[int, int]]:
    """Merges of a few hundred points, in order, by Ward's or complete linkage (of cosine distance); each names two members of the groups."""
    n = len(points)
    if linkage == "ward":
        d = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    else:
        unit = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
        d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    size, alive, merges = np.ones(n), np.ones(n, bool), []
    for _ in range(n - 1):
        i, j = sorted(divmod(int(d.argmin()), n))
        merges.append((i, j))
        if linkage == "ward":
            new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / (size[i] + size[j] + size)
        else:
            new = np.maximum(d[i], d[j])
        alive[j] = False
        new[~alive] = np.inf
        new[i] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
    return merges


def cut(merges: list[tuple[int, int]], n: int, k: int) -> np.ndarray:
    """Labels 0 to k - 1 of n points after n - k merges, in the order of their first points."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in merges[: n - k]:
        root[find(j)] = find(i)
    names: dict[int, int] = {}
    return np.array([names.setdefault(find(x), len(names)) for x in range(n)])


# -- scores


def silhouette(x: np.ndarray, labels: np.ndarray, metric: str = "euclidean", block: int = 1024) -> float:
    """Mean silhouette of a bounded sample, in blocks of rows."""
    groups = np.unique(labels)
    if len(groups) < 2:
        return -1.0
    member = (labels[:, None] == groups[None]).astype(float)
    count = member.sum(axis=0)
    own = np.searchsorted(groups, labels)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if metric == "cosine" else x
    out = np.zeros(len(x))
    for at in range(0, len(x), block):
        part = unit[at : at + block]
        d = 1 - part @ unit.T if metric == "cosine" else np.sqrt(np.maximum((part**2).sum(1)[:, None] + (unit**2).sum(1)[None] - 2 * part @ unit.T, 0))
        d[np.arange(len(part)), at + np.arange(len(part))] = 0
        sums = d @ member
        o = own[at : at + block]
        rows = np.arange(len(part))
        a = sums[rows, o] / np.maximum(count[o] - 1, 1)
        other = sums / count
        other[rows, o] = np.inf
        b = other.min(axis=1)
        out[at : at + block] = np.where(count[o] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0)
    return float(out.mean())


def davies_bouldin(x: np.ndarray, labels: np.ndarray) -> float:
    groups = np.unique(labels)
    if len(groups) < 2:
        return math.inf
    centers = np.stack([x[labels == g].mean(axis=0) for g in groups])
    spread = np.array([np.linalg.norm(x[labels == g] - c, axis=1).mean() for g, c in zip(groups, centers, strict=True)])
    gap = np.linalg.norm(centers[:, None] - centers[None], axis=2)
    ratio = np.divide(spread[:, None] + spread[None], gap, out=np.zeros_like(gap), where=gap > 0)
    return float(ratio.max(axis=1).mean())


def pick_best(scores: DataFrame) -> DataFrame:
    """Of scores(method, k, silhouette, davies_bouldin) the best row of each method."""
    order = Window.partitionBy("method").orderBy(F.desc("silhouette"), "davies_bouldin", "k")
    return scores.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


# -- names and representatives


def name_clusters(counts: DataFrame, most: int = TOP_TERMS) -> DataFrame:
    """cluster_id, name: of counts(cluster_id, term, n) the terms that stand out by class-based TF-IDF."""
    total = counts.groupBy("cluster_id").agg(F.sum("n").alias("total"))
    per_term = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    classes = F.broadcast(counts.agg(F.countDistinct("cluster_id").alias("classes")))
    weighed = counts.join(per_term, "term").join(total, "cluster_id").crossJoin(classes)
    w = (F.col("n") / F.col("total")) * (F.log((1.0 + F.col("classes")) / (1.0 + F.col("df"))) + 1)
    order = Window.partitionBy("cluster_id").orderBy(F.round("w", 12).desc(), "term")
    best = weighed.withColumn("w", w).where("w > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    names = best.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda e: e["term"]), ", ").alias("name"))
    every = total.select("cluster_id")
    return every.join(names, "cluster_id", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("cluster "), F.col("cluster_id").cast("string"))))


def representatives(labelled: DataFrame, centers: DataFrame, most: int = REPRESENTATIVES) -> DataFrame:
    """cluster_id, rank, doc_id, similarity: the members closest to each center by cosine."""
    near = labelled.join(F.broadcast(centers), "cluster_id").withColumn("similarity", F.round(cosine(F.col("vec"), F.col("center")), 4))  # a row a cluster
    order = Window.partitionBy("cluster_id").orderBy(F.desc("similarity"), "doc_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("cluster_id", "rank", "doc_id", "similarity")


def catalog(labelled: DataFrame, centers: DataFrame, names: DataFrame) -> DataFrame:
    """cluster_id, name, size, representatives; clusters without members have size 0."""
    sizes = labelled.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    reps = representatives(labelled, centers).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "similarity"))).alias("representatives"))
    rows = centers.select("cluster_id").join(names, "cluster_id", "left").join(sizes, "cluster_id", "left").join(reps, "cluster_id", "left")
    fallback = F.concat(F.lit("cluster "), F.col("cluster_id").cast("string"))
    return rows.select("cluster_id", F.coalesce("name", fallback).alias("name"), F.coalesce("size", F.lit(0)).alias("size"), "representatives")


# -- ranking by clusters


def normalise_scores(hits: DataFrame) -> DataFrame:
    """hits(query_id, ..., score) with `normalized`: share of the query's best score."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("normalized", F.col("score") / F.when(best != 0, best).otherwise(1.0))


def rerank(hits: DataFrame, assigned: DataFrame, centers: DataFrame, query_vectors: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """hits(query_id, rank, doc_id, score) in a new order: text score, closeness of query_vectors(query_id, vec) to a hit's cluster in assigned(doc_id,
    cluster_id), and the cluster's support among the hits. Unassigned hits have neither. Ordered by the rounded score, then by rank."""
    marked = normalise_scores(hits).join(assigned.select("doc_id", "cluster_id"), "doc_id", "left")
    by_query = Window.partitionBy("query_id")
    support = F.when(F.col("cluster_id").isNotNull(), F.sum("normalized").over(Window.partitionBy("query_id", "cluster_id")))
    marked = marked.withColumn("support", support)
    most = F.max("support").over(by_query)
    share = F.coalesce(F.col("support") / F.when(most != 0, most).otherwise(1.0), F.lit(0.0))
    closeness = F.coalesce(F.when(F.col("cluster_id").isNotNull(), cosine(F.col("vec"), F.col("center"))), F.lit(0.0))
    near = marked.withColumn("share", share).join(F.broadcast(centers), "cluster_id", "left").join(query_vectors.select("query_id", "vec"), "query_id", "left")  # centers: a row a cluster
    a, b, c = WEIGHTS
    scored = near.withColumn("affinity", closeness).withColumn("new", F.round(a * F.col("normalized") + b * F.col("affinity") + c * F.col("share"), 6))
    order = by_query.orderBy(F.desc("new"), "rank")
    out = scored.withColumn("new_rank", F.row_number().over(order))
    name = F.lit("unassigned")
    if names is not None:
        out = out.join(F.broadcast(names), "cluster_id", "left")  # a row a cluster
        name = F.when(F.col("cluster_id").isNull(), "unassigned").otherwise(F.col("name"))
    return out.select(
        "query_id", F.col("new_rank").alias("rank"), "doc_id", F.col("new").alias("score"), F.round("score", 6).alias("baseline_score"), F.round("normalized", 6).alias("baseline_score_normalized"),
        F.round("affinity", 6).alias("cluster_affinity"), F.round("share", 6).alias("cluster_support"), "cluster_id", name.alias("cluster_name"), F.col("rank").alias("baseline_rank"),
        (F.col("rank") - F.col("new_rank")).alias("rank_delta"),
    )


def facets(hits: DataFrame, assigned: DataFrame, clusters: DataFrame) -> DataFrame:
    """query_id, place, cluster_id, name, size, result_count: every cluster of the catalog for every query, those with most hits first."""
    counts = hits.join(assigned.select("doc_id", "cluster_id"), "doc_id").groupBy("query_id", "cluster_id").agg(F.count(F.lit(1)).alias("result_count"))
    grid = hits.select("query_id").distinct().crossJoin(F.broadcast(clusters.select("cluster_id", "name", "size")))  # a row a cluster
    rows = grid.join(counts, ["query_id", "cluster_id"], "left").withColumn("result_count", F.coalesce("result_count", F.lit(0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("result_count"), F.desc("size"), "name")
    return rows.withColumn("place", F.row_number().over(order))


def drill_down(reranked: DataFrame, cluster_id: int) -> DataFrame:
    return reranked.where(F.col("cluster_id") == cluster_id)


def fit_flat(sample: DataFrame, vectors: DataFrame, candidates=CANDIDATES, seed: int = SEED, fitted_on: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[dict]]:
    """Assignments, unit centers and the scores of each k. The sample is bounded by its caps and scored on the driver; centers are
    fitted on fitted_on, or else on the sample."""
    x = _collect(sample)
    scores, fitted = [], {}
    for k in candidates:
        if k >= len(x):
            continue
        centers = fit_kmeans(sample if fitted_on is None else fitted_on, k, seed)
        labels = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1) if len(x) * k < 2_000_000 else np.concatenate([((p[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1) for p in np.array_split(x, 64)])
        inertia = float(((x - centers[labels]) ** 2).sum())
        scores.append({"method": "flat", "k": k, "silhouette": round(silhouette(x, labels), 4), "davies_bouldin": round(davies_bouldin(x, labels), 4), "inertia": round(inertia, 4)})
        fitted[k] = centers
    best = min(scores, key=lambda s: (-s["silhouette"], s["davies_bouldin"], s["k"]))
    centers = fitted[best["k"]]
    spark = vectors.sparkSession
    labelled = materialise(assign(vectors, centers_frame(spark, centers)), "flat-labels")
    unit = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    return labelled, centers_frame(spark, unit), scores


def fit_agglomerative(vectors: DataFrame, mini: DataFrame, mini_centers: np.ndarray, linkage: str, candidates=CANDIDATES) -> tuple[DataFrame, DataFrame, list[dict]]:
    """The same by merging mini-clusters; a document has the label of its mini-cluster in mini(doc_id, vec, cluster_id)."""
    points = mini_centers if linkage == "ward" else mini_centers / np.maximum(np.linalg.norm(mini_centers, axis=1, keepdims=True), 1e-12)
    metric = "euclidean" if linkage == "ward" else "cosine"
    merges = agglomerate(points, linkage)
    scores, found = [], {}
    for k in candidates:
        if k >= len(points):
            continue
        found[k] = cut(merges, len(points), k)
        scores.append({"method": linkage, "k": k, "silhouette": round(silhouette(points, found[k], metric), 4), "davies_bouldin": round(davies_bouldin(points, found[k]), 4)})
    best = min(scores, key=lambda s: (-s["silhouette"], s["davies_bouldin"], s["k"]))
    spark = vectors.sparkSession
    names = spark.createDataFrame([(i, int(c)) for i, c in enumerate(found[best["k"]])], "mini int, label int")
    labelled = mini.withColumnRenamed("cluster_id", "mini").join(F.broadcast(names), "mini").select("doc_id", "vec", F.col("label").alias("cluster_id"))  # MINI_CLUSTERS rows at most
    labelled = materialise(labelled, f"{linkage}-labels")
    return labelled, materialise(label_centroids(labelled), f"{linkage}-centers"), scores


def _collect(sample: DataFrame) -> np.ndarray:
    """Vectors of a bounded sample, in the order of ids."""
    rows = sample.select("doc_id", "vec").orderBy("doc_id").toPandas()
    return np.stack(rows["vec"].to_list()).astype(np.float64) if len(rows) else np.zeros((0, 0))
