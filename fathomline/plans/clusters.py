"""A cluster build: corpus, sample, projection, three clusterings, names, catalogs, and its tables."""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, cluster, vectors
from ..shared import materialise
from ..sources import files, store

LEAST_RECORDS = 10
CLUSTERINGS = ("flat", "ward", "complete")


@dataclass(frozen=True)
class Config:
    min_df: int = vectors.MIN_DF
    max_df: float = vectors.MAX_DF
    max_features: int = vectors.MAX_FEATURES
    components: int = vectors.COMPONENTS
    sample_cap: int = clean.SAMPLE_CAP
    domain_cap: int = clean.DOMAIN_CAP
    flat_k: tuple[int, ...] = cluster.CANDIDATES
    merged_k: tuple[int, ...] = cluster.CANDIDATES
    mini_clusters: int = cluster.MINI_CLUSTERS
    terms: int = cluster.TOP_TERMS
    seed: int = 42


@dataclass
class Build:
    """assignments(method, doc_id, cluster_id), catalogs(method, cluster_id, name, size, representatives), centers(method, cluster_id, center),
    scores(method, k, silhouette, davies_bouldin) and the projection."""

    build_id: str
    assignments: DataFrame
    catalogs: DataFrame
    centers: DataFrame
    scores: DataFrame
    projection: vectors.Projection | None
    manifest: dict

    def of(self, method: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        if method not in CLUSTERINGS:
            raise ValueError(f"unknown clustering {method!r}")
        return tuple(df.where(F.col("method") == method).drop("method") for df in (self.assignments, self.centers, self.catalogs))

    def catalog(self, method: str | None = None) -> DataFrame:
        return self.catalogs if method is None else self.of(method)[2]

    def rerank(self, hits: DataFrame, query_vectors: DataFrame, method: str) -> tuple[DataFrame, DataFrame]:
        """Reranked hits, and the facets of each query."""
        assigned, centers, catalog = self.of(method)
        return cluster.rerank(hits, assigned, centers, query_vectors, catalog.select("cluster_id", "name")), cluster.facets(hits, assigned, catalog)

    def save(self, path: str) -> None:
        store.save({"assignments": self.assignments, "catalogs": self.catalogs, "centers": self.centers, "scores": self.scores, "vocabulary": self.projection.vocabulary}, path)
        Path(path, "basis.pkl").write_bytes(pickle.dumps(self.projection.basis))
        files.write_json(Path(path, "manifest.json"), self.manifest)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Build:
        t = store.load(spark, path, "assignments", "catalogs", "centers", "scores", "vocabulary")
        manifest = files.read_json(Path(path, "manifest.json"))
        basis = pickle.loads(Path(path, "basis.pkl").read_bytes())  # the program's own file
        return cls(manifest["build_id"], t["assignments"], t["catalogs"], t["centers"], t["scores"], vectors.Projection(t["vocabulary"], basis), manifest)


def cluster_vectors(spark: SparkSession, sample: DataFrame, full: DataFrame, config: Config) -> dict[str, tuple[DataFrame, DataFrame, list[dict]]]:
    """Labelled vectors, centers and scores of each clustering, for vectors(doc_id, vec)."""
    found = {"flat": cluster.fit_flat(sample, full, config.flat_k, config.seed)}
    n = min(config.mini_clusters, full.count())
    mini_centers = cluster.fit_kmeans(full, n, config.seed)
    mini = materialise(cluster.assign(full, cluster.centers_frame(spark, mini_centers)), "mini-labels")
    for linkage in ("ward", "complete"):
        found[linkage] = cluster.fit_agglomerative(full, mini, mini_centers, linkage, config.merged_k)
    return found


def build(pages: DataFrame, build_id: str, config: Config = Config(), order: str = "doc_id") -> Build:
    """A build over the pages that load_corpus keeps."""
    spark = pages.sparkSession
    records, reasons = clean.load_corpus(pages, order)
    records = materialise(records, "build-records")
    n = records.count()
    if n < LEAST_RECORDS:
        raise ValueError(f"{n} records are too few to cluster")
    sample = materialise(clean.balanced_sample(records, "domain", "normalized_url", config.domain_cap, config.sample_cap, config.seed), "build-sample")
    as_text = lambda df: df.select(F.col(order).alias("doc_id"), F.col("clustering_text").alias("text"))
    projection = vectors.fit_projection(as_text(sample), config.max_features, config.min_df, config.max_df, config.components, config.seed)
    full = materialise(projection.transform(as_text(records)), "build-vectors")
    some = materialise(full.join(sample.select(F.col(order).alias("doc_id")), "doc_id", "left_semi"), "build-sample-vectors")
    found = cluster_vectors(spark, some, full, config)
    grams = materialise(projection.term_counts(as_text(records)), "build-grams")
    terms = F.broadcast(projection.vocabulary.select("term_id", "term"))  # max_features rows at most
    parts: dict[str, list[DataFrame]] = {"assignments": [], "catalogs": [], "centers": []}
    scores: list[dict] = []
    for method, (labelled, centers, own) in found.items():
        each = grams.join(labelled.select("doc_id", "cluster_id"), "doc_id").select("cluster_id", F.explode(F.arrays_zip("ids", "tfs")).alias("g"))
        counts = each.groupBy("cluster_id", F.col("g.ids").alias("term_id")).agg(F.sum("g.tfs").alias("n")).join(terms, "term_id").select("cluster_id", "term", "n")
        names = materialise(cluster.name_clusters(counts, config.terms), "build-names")
        tag = F.lit(method).alias("method")
        parts["assignments"].append(labelled.select(tag, "doc_id", "cluster_id"))
        parts["catalogs"].append(cluster.catalog(labelled, centers, names).select(tag, "*"))
        parts["centers"].append(centers.select(tag, "cluster_id", "center"))
        scores += [{k: s[k] for k in ("method", "k", "silhouette", "davies_bouldin")} for s in own]
    tables = {}
    for name, dfs in parts.items():
        whole = dfs[0]
        for more in dfs[1:]:
            whole = whole.unionByName(more)
        tables[name] = materialise(whole, f"build-{name}")
    score_rows = spark.createDataFrame([tuple(s.values()) for s in scores], "method string, k int, silhouette double, davies_bouldin double")
    chosen = {r["method"]: r["k"] for r in cluster.pick_best(score_rows).collect()}
    manifest = {
        "build_id": build_id, "created_at": datetime.now(timezone.utc).isoformat(), "status": "completed", "selected_k": chosen, "training_sample_size": sample.count(),
        "corpus": {"records_kept": n, "filters": {r["reason"]: r["n"] for r in reasons.where("reason <> 'kept'").collect()}},
    }
    return Build(build_id, tables["assignments"], tables["catalogs"], tables["centers"], score_rows, projection, manifest)
