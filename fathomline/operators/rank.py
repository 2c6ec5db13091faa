"""Ranking for batches of queries, and how results are shown. Every ranking has a total order: score, then doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .index import Index

K1, B = 1.2, 0.75
#: Digits that scores are compared by, so that the order of a sum decides no rank.
DIGITS = 9
#: A blend reads this many times its k of the text ranking.
WIDER = 5
#: Weights of text and links in blends; PageRank is scaled up by the last.
TEXT_WEIGHT, LINK_WEIGHT, RANK_SCALE = 0.7, 0.3, 1000


def query_terms(queries: DataFrame, stemmer: str = "none") -> DataFrame:
    """query_id, term, qtf of queries(query_id, query)."""
    rows = queries.select("query_id", F.explode(tx.terms_of(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    if stemmer == "none":
        return rows
    stems = tx.stem_vocabulary(rows.select("term").distinct(), stemmer)
    return rows.join(stems, "term").groupBy("query_id", F.col("stem").alias("term")).agg(F.sum("qtf").alias("qtf"))


def top_k(scored: DataFrame, k: int, score: str = "score", within: str = "query_id", last: str = "doc_id") -> DataFrame:
    """The k best rows of each query, with their rank. Spark cuts each partition to k rows before it shuffles them."""
    order = Window.partitionBy(within).orderBy(F.round(score, DIGITS).desc(), last)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def score_tfidf(index: Index, terms: DataFrame) -> DataFrame:
    """query_id, doc_id, score: cosine of the set of query terms, weighed by idf, and documents."""
    n = F.broadcast(index.stats.select("n_docs"))
    weighed = terms.select("query_id", "term").join(index.terms, "term").crossJoin(n).withColumn("idf", F.log10(F.col("n_docs") / F.col("df")))
    norms = weighed.groupBy("query_id").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("query_norm"))
    hits = index.postings.join(weighed.select("query_id", "term", "idf"), "term")
    sums = hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * (1 + F.log10("tf")) * F.col("idf")).alias("dot"))
    scale = F.when((F.col("query_norm") > 0) & (F.coalesce("tfidf_norm", F.lit(1.0)) > 0), F.col("query_norm") * F.coalesce("tfidf_norm", F.lit(1.0))).otherwise(1.0)
    return sums.join(norms, "query_id").join(index.docs.select("doc_id", "tfidf_norm"), "doc_id", "left").select("query_id", "doc_id", (F.col("dot") / scale).alias("score"))


def score_bm25(index: Index, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, score by Okapi BM25 over the set of query terms."""
    stats = F.broadcast(index.stats)
    weighed = terms.select("query_id", "term").join(index.terms, "term").crossJoin(stats)
    weighed = weighed.withColumn("idf", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0))
    hits = index.postings.join(weighed.select("query_id", "term", "idf", "avg_dl"), "term").join(index.docs.select("doc_id", "doc_len"), "doc_id", "left")
    length = F.coalesce(F.col("doc_len").cast("double"), F.col("avg_dl"))
    part = F.col("idf") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * (length / F.col("avg_dl"))))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def rank_tfidf(index: Index, terms: DataFrame, k: int = 10) -> DataFrame:
    return top_k(score_tfidf(index, terms), k)


def rank_bm25(index: Index, terms: DataFrame, k: int = 10) -> DataFrame:
    return top_k(score_bm25(index, terms), k)


def rank_pagerank(index: Index, terms: DataFrame, ranks: DataFrame, k: int = 10) -> DataFrame:
    """The text ranking's best 5 k, by PageRank of ranks(id, score); equals stay in the order of the text ranking."""
    wide = rank_tfidf(index, terms, WIDER * k).select("query_id", "doc_id", F.col("rank").alias("text_rank"))
    scored = wide.join(ranks.select(F.col("id").alias("doc_id"), "score"), "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return top_k(scored, k, last="text_rank").drop("text_rank")


def _blend(index: Index, terms: DataFrame, links: DataFrame, k: int, scale: float) -> DataFrame:
    """links: query_id (or none), doc_id, link_score."""
    wide = rank_tfidf(index, terms, WIDER * k).drop("rank")
    best = F.max("score").over(Window.partitionBy("query_id"))
    on = [c for c in ("query_id", "doc_id") if c in links.columns]
    joined = wide.withColumn("best", F.when(best != 0, best).otherwise(1.0)).join(links, on, "left")
    score = TEXT_WEIGHT * (F.col("score") / F.col("best")) + LINK_WEIGHT * (F.coalesce("link_score", F.lit(0.0)) * scale)
    return top_k(joined.select("query_id", "doc_id", score.alias("score")), k)


def rank_tfidf_pagerank(index: Index, terms: DataFrame, ranks: DataFrame, k: int = 10) -> DataFrame:
    return _blend(index, terms, ranks.select(F.col("id").alias("doc_id"), F.col("score").alias("link_score")), k, RANK_SCALE)


def rank_tfidf_hits(index: Index, terms: DataFrame, authorities: DataFrame, k: int = 10) -> DataFrame:
    """authorities(query_id, doc_id, score): the best 5 k of HITS."""
    return _blend(index, terms, authorities.select("query_id", "doc_id", F.col("score").alias("link_score")), k, 1.0)


def format_hits(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, rank, doc_id, score (6 digits), url, title, snippet."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    shown = ranked.join(docs.select("doc_id", "url", "title", tx.snippet(F.col("text_preview")).alias("snippet")), "doc_id", "left")
    return shown.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"), empty("url"), empty("title"), empty("snippet"))


def match_strength(score: Column) -> Column:
    return F.when(score >= 0.7, "Strong").when(score >= 0.3, "Moderate").otherwise("Weak")


def score_width(score: Column, best: Column) -> Column:
    """Per cent of a bar, from 6 to 100."""
    return F.greatest(F.lit(6.0), F.least(F.lit(100.0), 100.0 * score / F.greatest(best, F.lit(1.0))))


def domain_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """left(query_id, domain, ...) with `shared`: whether right has its domain for the query."""
    there = right.select("query_id", "domain").distinct().withColumn("shared", F.lit(True))
    return left.join(there, ["query_id", "domain"], "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
