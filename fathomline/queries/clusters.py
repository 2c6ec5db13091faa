"""Clusters, reranking and evaluation. Embeddings stand for text vectors, and their labels for clusters; documents share their ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster, evaluate, rank, vectors
from ..plans import clusters as plan
from ..plans import experiment
from ..shared import materialise
from . import base as b


def _vectors(spark, sf):
    return b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), F.col("label").alias("cluster_id"))


def _centers(spark, sf):
    return materialise(cluster.label_centroids(_vectors(spark, sf)), "centers")


def cluster_centroids(spark, sf):
    return _centers(spark, sf).select("cluster_id", F.posexplode("center").alias("dim", "x")).withColumn("x", F.round("x", 8))


def nearest_centroid(spark, sf):
    return cluster.assign(_vectors(spark, sf).drop("cluster_id"), _centers(spark, sf)).select("doc_id", "cluster_id")


def _grams(spark, sf):
    docs = b.table(spark, sf, "documents").select("doc_id", "text").join(_vectors(spark, sf).select("doc_id", "cluster_id"), "doc_id")
    return docs, vectors.gram_counts(docs.select("doc_id", "text"))


def ctfidf_names(spark, sf):
    docs, counts = _grams(spark, sf)
    per = counts.join(docs.select("doc_id", "cluster_id"), "doc_id").groupBy("cluster_id", "term").agg(F.sum("tf").alias("n"))
    return cluster.name_clusters(materialise(per, "grams"))


def gram_vocabulary(spark, sf):
    counts = vectors.gram_counts(b.table(spark, sf, "documents").select("doc_id", "text"))
    n = b.table(spark, sf, "documents").count()
    return vectors.fit_vocabulary(counts, n).select("term_id", "term", "df", F.round("idf", 9).alias("idf"))


def cluster_reps(spark, sf):
    return cluster.representatives(_vectors(spark, sf), _centers(spark, sf))


def cluster_catalog(spark, sf):
    v, names = _vectors(spark, sf), ctfidf_names(spark, sf)
    return cluster.catalog(v, _centers(spark, sf), names).select("cluster_id", "name", "size", F.size("representatives").alias("n_reps"))


def _hits(spark, sf):
    return materialise(rank.rank_bm25(b.index_of(spark, sf), b.terms_of(spark, sf), b.K), "hits")


def _query_vectors(spark, sf):
    return _vectors(spark, sf).select(F.col("doc_id").alias("query_id"), "vec")


def score_normalization(spark, sf):
    return cluster.normalise_scores(_hits(spark, sf)).select("query_id", "doc_id", F.round("normalized", 6).alias("normalized"))


def cluster_rerank(spark, sf):
    out = cluster.rerank(_hits(spark, sf), _vectors(spark, sf), _centers(spark, sf), _query_vectors(spark, sf))
    return out.drop("cluster_name")


def cluster_facets(spark, sf):
    v = _vectors(spark, sf)
    catalog = v.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).withColumn("name", F.concat(F.lit("cluster "), F.col("cluster_id").cast("string")))
    return cluster.facets(_hits(spark, sf), v, catalog)


def _runs(spark, sf):
    hits = _hits(spark, sf)
    new = cluster.rerank(hits, _vectors(spark, sf), _centers(spark, sf), _query_vectors(spark, sf))
    base = hits.select(F.lit("baseline").alias("system"), "query_id", "rank", "doc_id", F.lit(None).cast("int").alias("cluster_id"), F.lit(0.0).alias("cluster_affinity"), F.lit(0).alias("rank_delta"))
    flat = new.select(F.lit("flat").alias("system"), "query_id", "rank", "doc_id", "cluster_id", "cluster_affinity", "rank_delta")
    return materialise(base.unionByName(flat), "runs")


def _qrels(spark, sf):
    labels = b.table(spark, sf, "labels").select("doc_id", (F.col("quality") + (F.col("toxic") == 0).cast("int")).alias("rel"))
    queries = b.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    return labels.join(queries, (F.col("doc_id") % 5) == (F.col("query_id") % 5)).select("query_id", "doc_id", "rel")


def judged_metrics(spark, sf):
    return evaluate.judged_metrics(_runs(spark, sf), _qrels(spark, sf))


def system_means(spark, sf):
    return evaluate.mean_by_system(evaluate.judged_metrics(_runs(spark, sf), _qrels(spark, sf)))


def auto_metrics(spark, sf):
    return evaluate.automatic_metrics(_runs(spark, sf))


def judgment_pool(spark, sf):
    return evaluate.judgment_pool(_runs(spark, sf))


def last_judgments(spark, sf):
    """Documents of equal text judged again and again."""
    rows = b.table(spark, sf, "labels").select((F.col("doc_id") % 10).alias("query_id"), (F.col("doc_id") % 70).alias("doc_id"), F.col("doc_id").alias("at"), F.col("quality").alias("rel"))
    return evaluate.last_judgments(rows, "at")


def example_pick(spark, sf):
    m = evaluate.automatic_metrics(_runs(spark, sf)).where("system = 'flat'")
    deltas = m.select("query_id", (F.col("query_id") % 7).cast("string").alias("topic"), "system", F.col("average_query_cluster_affinity_at_10").alias("delta"))
    return evaluate.pick_examples(deltas)


def drill_down(spark, sf):
    return cluster.drill_down(_runs(spark, sf), 3).select("system", "query_id", "rank", "doc_id")


def best_k(spark, sf):
    """Scores made of the supplier table: the best row of each method."""
    s = b.table(spark, sf, "supplier").select(F.element_at(F.array(*map(F.lit, plan.CLUSTERINGS)), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("method"), F.col("s_suppkey").cast("int").alias("k"), F.round(F.col("s_nationkey") / 25, 4).alias("silhouette"), F.round(F.abs("s_acctbal") / 1000, 4).alias("davies_bouldin"))
    return cluster.pick_best(s)


def kmeans_flat(spark, sf):
    """k-means over all embeddings: k of the best silhouette, and each vector's cluster. Only the silhouette is of a sample, the 2,000
    vectors with the smallest hash of their id. Vectors are dealt by id, so that the layout of files doesn't matter."""
    v = materialise(_vectors(spark, sf).drop("cluster_id"), "kmeans-vectors")
    dealt = v.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "vec")
    sample = materialise(v.orderBy(F.xxhash64("doc_id"), "doc_id", "vec").limit(2000), "kmeans-sample")
    labelled, _, _ = cluster.fit_flat(sample, v, fitted_on=dealt)
    return labelled.select("doc_id", "cluster_id")


def agglomerative_labels(spark, sf):
    """Labels of all embeddings by both linkages of mini-clusters."""
    v = materialise(_vectors(spark, sf).drop("cluster_id"), "merge-vectors")
    centers = cluster.fit_kmeans(v, min(cluster.MINI_CLUSTERS, v.count()))
    mini = materialise(cluster.assign(v, cluster.centers_frame(spark, centers)), "merge-mini")
    parts = [cluster.fit_agglomerative(v, mini, centers, linkage)[0].select(F.lit(linkage).alias("method"), "doc_id", "cluster_id") for linkage in ("ward", "complete")]
    return parts[0].unionByName(parts[1])


def text_projection(spark, sf):
    """Documents projected to the directions of their TF-IDF vectors."""
    texts = b.table(spark, sf, "documents").select("doc_id", "text")
    return vectors.fit_projection(texts).transform(texts)


def query_projection(spark, sf):
    """Queries in the space of the documents."""
    texts = b.table(spark, sf, "documents").select("doc_id", "text")
    queries = b.queries_of(spark, sf).select(F.col("query_id").alias("doc_id"), F.col("query").alias("text"))
    return vectors.fit_projection(texts).transform(queries).withColumnRenamed("doc_id", "query_id")


def cluster_build(spark, sf):
    """A whole build over the documents that the corpus filters keep."""
    return plan.build(b.corpus(spark, sf), "build").catalogs.select("method", "cluster_id", "name", "size")


def cluster_experiment(spark, sf):
    """Baseline and reranked results of all queries, with their means."""
    v = _vectors(spark, sf)
    tag = F.lit("flat").alias("method")
    catalog = v.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).select(tag, "cluster_id", F.lit("c").alias("name"), "size", F.lit(None).alias("representatives"))
    built = plan.Build("x", v.select(tag, "doc_id", "cluster_id"), catalog, _centers(spark, sf).select(tag, "cluster_id", "center"), catalog, None, {})
    queries = b.queries_of(spark, sf).withColumn("topic", (F.col("query_id") % 7).cast("string"))
    return experiment.run_experiment(queries, _hits(spark, sf), _query_vectors(spark, sf), built, ("flat",)).summary


QUERIES = {f.__name__: f for f in (
    cluster_centroids, nearest_centroid, ctfidf_names, gram_vocabulary, cluster_reps, cluster_catalog, score_normalization, cluster_rerank, cluster_facets, judged_metrics, system_means, auto_metrics,
    judgment_pool, last_judgments, example_pick, drill_down, best_k, kmeans_flat, agglomerative_labels, text_projection, query_projection, cluster_build, cluster_experiment,
)}

_V = "v AS (SELECT vec_id AS doc_id, embedding AS vec, label AS cluster_id FROM embeddings)"
_CENTERS = f"""{_V},
cm AS (SELECT cluster_id, dim, avg(x::DOUBLE) AS x FROM (SELECT cluster_id, unnest(vec) AS x, unnest(generate_series(0, len(vec) - 1)) AS dim FROM v) GROUP BY ALL),
cn AS (SELECT cluster_id, sqrt(sum(x * x)) AS norm FROM cm GROUP BY ALL),
cx AS (SELECT cluster_id, dim, x / norm AS x FROM cm JOIN cn USING (cluster_id)),
ctr AS (SELECT cluster_id, list(x ORDER BY dim) AS center FROM cx GROUP BY ALL)"""
_DOT = "list_inner_product({0}::DOUBLE[], {1}::DOUBLE[])"
_COS = f"({_DOT.format('{0}', '{1}')} / (sqrt({_DOT.format('{0}', '{0}')}) * sqrt({_DOT.format('{1}', '{1}')})))"
_GRAMS = f"""gw AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[0-9A-Za-z_][0-9A-Za-z_]+'), lambda x: x NOT IN ({b.STOP})) AS ws FROM documents),
gr AS (SELECT doc_id, unnest(list_concat(ws, list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM gw),
gc AS (SELECT doc_id, term, count(*) AS tf FROM gr GROUP BY ALL)"""
_NAMES = f"""{_V}, {_GRAMS},
cc AS (SELECT cluster_id, term, sum(tf) AS n FROM gc JOIN v USING (doc_id) GROUP BY ALL),
ct AS (SELECT cluster_id, sum(n) AS total FROM cc GROUP BY ALL), cd AS (SELECT term, count(*) AS df FROM cc GROUP BY ALL),
cw AS (SELECT cluster_id, term, (n / total) * (ln((1.0 + (SELECT count(*) FROM ct)) / (1.0 + df)) + 1) AS w FROM cc JOIN ct USING (cluster_id) JOIN cd USING (term)),
cr AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(w, 12) DESC, term) AS rank FROM cw WHERE w > 0 QUALIFY rank <= 6),
nm AS (SELECT cluster_id, string_agg(term, ', ' ORDER BY rank) AS name FROM cr GROUP BY ALL)"""
_REPS = f"SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY s DESC, doc_id) AS rank, doc_id, s AS similarity FROM (SELECT v.cluster_id, doc_id, round({_COS.format('vec', 'center')}, 4) AS s FROM v JOIN ctr USING (cluster_id)) QUALIFY rank <= 3"
_HITS = f"{b.CTE}, {b.BM25}, hits AS ({b.top('bm25')}), nh AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS normalized FROM hits)"
_RERANK = f"""{_HITS}, {_CENTERS},
mk AS (SELECT nh.*, cluster_id, CASE WHEN cluster_id IS NOT NULL THEN sum(normalized) OVER (PARTITION BY query_id, cluster_id) END AS support FROM nh LEFT JOIN v USING (doc_id)),
sh AS (SELECT *, coalesce(support / max(support) OVER (PARTITION BY query_id), 0.0) AS share FROM mk),
af AS (SELECT sh.*, coalesce(CASE WHEN sh.cluster_id IS NOT NULL THEN {_COS.format('q.vec', 'center')} END, 0.0) AS affinity FROM sh LEFT JOIN ctr ON ctr.cluster_id = sh.cluster_id LEFT JOIN v q ON q.doc_id = sh.query_id),
sc AS (SELECT *, round(0.70 * normalized + 0.20 * affinity + 0.10 * share, 6) AS new FROM af),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY new DESC, rank) AS new_rank FROM sc),
runs AS (SELECT 'baseline' AS system, query_id, rank, doc_id, NULL::INT AS cluster_id, 0.0::DOUBLE AS cluster_affinity, 0 AS rank_delta FROM hits UNION ALL SELECT 'flat', query_id, new_rank, doc_id, cluster_id, round(affinity, 6), rank - new_rank FROM rr)"""
_QRELS = "qr AS (SELECT item_id AS query_id, doc_id, quality + (toxic = 0)::INT AS rel FROM labels JOIN benchmark ON doc_id % 5 = item_id % 5)"
_GAIN = "(pow(2.0, {0}) - 1) / log2({1} + 1.0)"
_JUDGED = f"""{_RERANK}, {_QRELS},
jr AS (SELECT system, r.query_id, rank, coalesce(rel, 0) AS rel FROM runs r LEFT JOIN qr USING (query_id, doc_id) WHERE r.query_id IN (SELECT query_id FROM qr)),
il AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS place FROM qr),
ii AS (SELECT query_id, sum(CASE WHEN place <= 5 THEN {_GAIN.format('rel', 'place')} ELSE 0 END) AS i5, sum(CASE WHEN place <= 10 THEN {_GAIN.format('rel', 'place')} ELSE 0 END) AS i10 FROM il GROUP BY ALL),
js AS (SELECT system, query_id, sum((rank <= 5 AND rel > 0)::INT) / 5 AS p5, sum((rank <= 10 AND rel > 0)::INT) / 10 AS p10, max((rank <= 5 AND rel > 0)::INT)::DOUBLE AS s5, max((rank <= 10 AND rel > 0)::INT)::DOUBLE AS s10,
  coalesce(max(CASE WHEN rel > 0 THEN 1.0::DOUBLE / rank END), 0.0) AS mrr, sum(CASE WHEN rank <= 5 THEN {_GAIN.format('rel', 'rank')} ELSE 0 END) AS d5, sum(CASE WHEN rank <= 10 THEN {_GAIN.format('rel', 'rank')} ELSE 0 END) AS d10 FROM jr GROUP BY ALL),
jm AS (SELECT system, query_id, round(p5, 4) AS precision_at_5, round(p10, 4) AS precision_at_10, round(s5, 4) AS success_at_5, round(s10, 4) AS success_at_10, round(mrr, 4) AS mrr,
  round(CASE WHEN i5 > 0 THEN d5 / i5 ELSE 0 END, 4) AS ndcg_at_5, round(CASE WHEN i10 > 0 THEN d10 / i10 ELSE 0 END, 4) AS ndcg_at_10 FROM js LEFT JOIN ii USING (query_id))"""
_AUTO = f"""{_RERANK},
tp AS (SELECT *, first_value(cluster_id) OVER (PARTITION BY system, query_id ORDER BY rank) AS f FROM runs WHERE rank <= 10),
lg AS (SELECT system, query_id, max(n) AS largest FROM (SELECT system, query_id, cluster_id, count(*) AS n FROM tp WHERE cluster_id IS NOT NULL GROUP BY ALL) GROUP BY ALL),
mv AS (SELECT system, query_id, avg(abs(rank_delta)) AS move FROM runs GROUP BY ALL),
am AS (SELECT system, query_id, round(sum(CASE WHEN cluster_id = f THEN 1 ELSE 0 END) / count(*), 4) AS cluster_coherence_at_10, round(coalesce(any_value(largest), 0) / count(*), 4) AS dominant_cluster_share_at_10,
  round(avg(coalesce(cluster_affinity, 0)), 4) AS average_query_cluster_affinity_at_10, round(any_value(move), 4) AS average_absolute_rank_shift FROM tp LEFT JOIN lg USING (system, query_id) JOIN mv USING (system, query_id) GROUP BY system, query_id)"""
_MEANS = ["precision_at_5", "precision_at_10", "success_at_5", "success_at_10", "mrr", "ndcg_at_5", "ndcg_at_10"]
_AUTO_NAMES = ["cluster_coherence_at_10", "dominant_cluster_share_at_10", "average_query_cluster_affinity_at_10", "average_absolute_rank_shift"]

ORACLE_SQL = {
    "cluster_centroids": f"WITH {_CENTERS} SELECT cluster_id, dim, round(x, 8) AS x FROM cx",
    "nearest_centroid": f"WITH {_CENTERS} SELECT doc_id, cluster_id FROM (SELECT doc_id, c.cluster_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(list_distance(vec::DOUBLE[], center) ** 2, 12), c.cluster_id) AS n FROM v, ctr c) WHERE n = 1",
    "ctfidf_names": f"WITH {_NAMES} SELECT cluster_id, coalesce(name, 'cluster ' || cluster_id) AS name FROM ct LEFT JOIN nm USING (cluster_id)",
    "gram_vocabulary": f"WITH {_GRAMS}, p AS (SELECT term, count(*) AS df, sum(tf) AS total FROM gc GROUP BY ALL HAVING df >= 5 AND df <= 0.4 * (SELECT count(*) FROM documents)), t AS (SELECT * FROM p ORDER BY total DESC, term LIMIT {vectors.MAX_FEATURES}) SELECT (row_number() OVER (ORDER BY term) - 1)::INT AS term_id, term, df, round(ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1, 9) AS idf FROM t",
    "cluster_reps": f"WITH {_CENTERS} {_REPS}",
    "cluster_catalog": f"WITH {_NAMES} SELECT cluster_id, coalesce(name, 'cluster ' || cluster_id) AS name, count(*) AS size, least(3, count(*))::INT AS n_reps FROM v LEFT JOIN nm USING (cluster_id) GROUP BY cluster_id, name",
    "score_normalization": f"WITH {_HITS} SELECT query_id, doc_id, round(normalized, 6) AS normalized FROM nh",
    "cluster_rerank": f"WITH {_RERANK} SELECT query_id, new_rank AS rank, doc_id, new AS score, round(score, 6) AS baseline_score, round(normalized, 6) AS baseline_score_normalized, round(affinity, 6) AS cluster_affinity, round(share, 6) AS cluster_support, cluster_id, rank AS baseline_rank, rank - new_rank AS rank_delta FROM rr",
    "cluster_facets": f"WITH {_HITS}, {_V}, k AS (SELECT cluster_id, 'cluster ' || cluster_id AS name, count(*) AS size FROM v GROUP BY ALL), c AS (SELECT query_id, cluster_id, count(*) AS n FROM hits JOIN v USING (doc_id) GROUP BY ALL) SELECT q.query_id, row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(n, 0) DESC, size DESC, name) AS place, k.cluster_id, name, size, coalesce(n, 0) AS result_count FROM (SELECT DISTINCT query_id FROM hits) q CROSS JOIN k LEFT JOIN c ON c.query_id = q.query_id AND c.cluster_id = k.cluster_id",
    "judged_metrics": f"WITH {_JUDGED} SELECT * FROM jm",
    "system_means": f"WITH {_JUDGED} SELECT system, {', '.join(f'round(avg({m}), 4) AS {m}' for m in _MEANS)} FROM jm GROUP BY system",
    "auto_metrics": f"WITH {_AUTO} SELECT * FROM am",
    "judgment_pool": f"WITH {_RERANK} SELECT query_id, doc_id, string_agg(DISTINCT system, ';' ORDER BY system) AS systems FROM runs WHERE rank <= 10 GROUP BY ALL",
    "last_judgments": "SELECT doc_id % 10 AS query_id, doc_id % 70 AS doc_id, arg_max(quality, doc_id) AS rel FROM labels l GROUP BY l.doc_id % 10, l.doc_id % 70",
    "example_pick": f"WITH {_AUTO}, d AS (SELECT query_id, (query_id % 7)::VARCHAR AS topic, system, average_query_cluster_affinity_at_10 AS delta FROM am WHERE system = 'flat'), t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY topic ORDER BY delta DESC, query_id) = 1) SELECT row_number() OVER (ORDER BY delta DESC, query_id) AS place, query_id, topic, system, delta FROM t QUALIFY place <= 3",
    "drill_down": f"WITH {_RERANK} SELECT system, query_id, rank, doc_id FROM runs WHERE cluster_id = 3",
    "best_k": "WITH s AS (SELECT ['flat', 'ward', 'complete'][s_suppkey % 3 + 1] AS method, s_suppkey::INT AS k, round(s_nationkey / 25, 4) AS silhouette, round(abs(s_acctbal) / 1000, 4) AS davies_bouldin FROM supplier) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY method ORDER BY silhouette DESC, davies_bouldin, k) = 1",
    "cluster_experiment": f"WITH {_AUTO} SELECT system, {', '.join(f'round(avg({m}), 4) AS {m}' for m in _AUTO_NAMES)} FROM am GROUP BY system",
}
