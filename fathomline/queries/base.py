"""How the driver's tables become pages, queries, judgments and a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import words
from ..operators.index import Index, build_index, index_terms
from ..operators.rank import query_terms
from ..plans.engine import SearchEngine
from ..shared import file_stamp, shared_path
from ..sources import store

K = 10
#: PageRank and HITS rounds where a query and its SQL take a fixed number.
ROUNDS = 5


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages: no title, and a URL that holds the source and id."""
    url = F.concat(F.lit("https://www."), "source", F.lit(".example.org/doc/"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", url.alias("url"), F.lit("").alias("title"), "text", F.lit("text/html").alias("content_type"), F.lit(200).alias("status"), F.lit(1).alias("depth"))


_stored: dict[tuple, str] = {}


def _stored_once(spark: SparkSession, sf: str, what: str, build: Callable[[str], None], *tables: str) -> str:
    """Where the tables that `build` writes are kept: they are written once for a session and a state of the files that they are made of."""
    stamps = (file_stamp(spark, f"{sf}/{t}.parquet") for t in tables)
    key = (spark.sparkContext.applicationId, sf, what, *stamps)
    if key not in _stored:
        path = shared_path(spark, what)
        build(path)
        _stored[key] = path
    return _stored[key]


def index_of(spark: SparkSession, sf: str, stemmer: str = "none") -> Index:
    """The stored index of the corpus: queries read it, the first of a session builds it."""
    path = _stored_once(spark, sf, f"index-{stemmer}", lambda p: store.save_index(build_index(corpus(spark, sf), stemmer), p), "documents")
    return store.load_index(spark, path)


def index_terms_of(spark: SparkSession, sf: str, stemmer: str = "none") -> DataFrame:
    """The terms of that index, for queries that need nothing else of it."""
    path = _stored_once(spark, sf, f"index-terms-{stemmer}", lambda p: store.save({"terms": index_terms(corpus(spark, sf), stemmer)}, p), "documents")
    return store.load(spark, path, "terms")["terms"]


def engine_of(spark: SparkSession, sf: str, stemmer: str = "none") -> SearchEngine:
    """The stored search engine over the corpus and the graph of its documents."""
    build = lambda p: SearchEngine.build(corpus(spark, sf), *doc_graph(spark, sf), stemmer=stemmer).save(p)
    path = _stored_once(spark, sf, f"engine-{stemmer}", build, "documents", "lineitem", "part")
    return SearchEngine.load(spark, path, stemmer)


def mixed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus as a crawl may find it: some pages with another status or type, without a URL, or with that of the page before."""
    every = lambda n: F.col("doc_id") % n == 0
    pages = corpus(spark, sf).withColumn("url", F.when(every(23), "").otherwise(F.col("url")))
    kind = F.when(every(13), "application/pdf").otherwise(F.lit(" Text/HTML ; charset=utf-8"))
    return pages.withColumn("status", F.when(every(11), 404).otherwise(200)).withColumn("content_type", kind)


def queries_of(spark: SparkSession, sf: str) -> DataFrame:
    """The first four words of each benchmark text."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("query"))


def terms_of(spark: SparkSession, sf: str) -> DataFrame:
    return query_terms(queries_of(spark, sf))


def part_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Parts, linked to the next part of an order; every tenth part has no edges out."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    steps = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    edges = steps.where("dst is not null and src <> dst and src % 10 <> 0").distinct()
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id")), edges


def doc_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The same edges between documents: parts are folded onto them."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    _, edges = part_graph(spark, sf)
    folded = edges.crossJoin(F.broadcast(n)).select(F.expr("pmod(src, n)").alias("src"), F.expr("pmod(dst, n)").alias("dst"))
    return docs, folded.where("src <> dst").distinct()


# -- SQL of the same

STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in words.STOP_WORDS)
TOKENS = "SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents"
CTE = f"""
q0 AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:4], ' ') AS query FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM q0) WHERE term NOT IN ({STOP}) GROUP BY ALL),
postings AS (SELECT term, doc_id, count(*) AS tf FROM ({TOKENS}) WHERE term NOT IN ({STOP}) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
st AS (SELECT (SELECT count(*) FROM documents) AS n_docs, coalesce((SELECT sum(tf) FROM postings), 0) / (SELECT count(*) FROM documents) AS avg_dl),
norms AS (SELECT doc_id, sum(tf) AS doc_len, sqrt(sum(((1 + log10(tf)) * log10(n_docs / df)) ** 2)) AS tfidf_norm FROM postings JOIN terms USING (term), st GROUP BY doc_id),
docs AS (SELECT doc_id, coalesce(doc_len, 0) AS doc_len, coalesce(tfidf_norm, 0.0) AS tfidf_norm, text FROM documents LEFT JOIN norms USING (doc_id))"""
TFIDF = """
wt AS (SELECT query_id, term, log10(n_docs / df) AS idf FROM qt JOIN terms USING (term), st),
wn AS (SELECT query_id, sqrt(sum(idf * idf)) AS query_norm FROM wt GROUP BY query_id),
dots AS (SELECT query_id, doc_id, sum(idf * (1 + log10(tf)) * idf) AS dot FROM postings JOIN wt USING (term) GROUP BY ALL),
tfidf AS (SELECT query_id, doc_id, dot / CASE WHEN query_norm > 0 AND tfidf_norm > 0 THEN query_norm * tfidf_norm ELSE 1 END AS score FROM dots JOIN wn USING (query_id) JOIN docs USING (doc_id))"""
BM25 = """
bm25 AS (SELECT query_id, doc_id, sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * (doc_len / avg_dl)))) AS score
         FROM qt JOIN terms USING (term) JOIN postings USING (term) JOIN docs USING (doc_id), st GROUP BY ALL)"""


def top(name: str, k: int = K, last: str = "doc_id") -> str:
    """SQL of the k best rows of a query."""
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {last}) AS rank FROM {name} QUALIFY rank <= {k}"


EDGES = """
pe AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst AND src % 10 <> 0),
pn AS (SELECT p_partkey AS id FROM part),
de AS (SELECT DISTINCT src % n AS src, dst % n AS dst FROM pe, (SELECT count(*) AS n FROM documents) WHERE src % n <> dst % n)"""


def pagerank_sql(nodes: str, edges: str, rounds: int = ROUNDS) -> str:
    """CTEs pr0 to pr<rounds>(id, score)."""
    out = [f"deg AS MATERIALIZED (SELECT src, count(*) AS degree FROM {edges} GROUP BY src), nn AS (SELECT count(*) AS n FROM {nodes}), pr0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS score FROM {nodes}, nn)"]
    for k in range(1, rounds + 1):
        out.append(
            f"pr{k} AS MATERIALIZED (SELECT x.id, 0.85 * (coalesce(got, 0) + lost / n) + (1 - 0.85) / n AS score FROM {nodes} x LEFT JOIN (SELECT dst AS id, sum(score / degree) AS got FROM {edges} JOIN deg USING (src) JOIN pr{k - 1} p ON p.id = src GROUP BY dst) g ON g.id = x.id, "
            f"(SELECT coalesce(sum(score), 0) AS lost FROM pr{k - 1} WHERE id NOT IN (SELECT src FROM deg)) l, nn)"
        )
    return ", ".join(out)


BASE_SET = """
roots AS MATERIALIZED (SELECT query_id, doc_id FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY sum(tf * qtf) DESC, doc_id) AS n FROM postings JOIN qt USING (term) GROUP BY query_id, doc_id) WHERE n <= 200),
near AS MATERIALIZED (SELECT node, other FROM (SELECT dst AS node, src AS other, row_number() OVER (PARTITION BY dst ORDER BY src) AS n FROM de) WHERE n <= 50 UNION ALL SELECT node, other FROM (SELECT src AS node, dst AS other, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM de) WHERE n <= 50),
bs AS MATERIALIZED (SELECT query_id, doc_id FROM roots UNION SELECT query_id, other FROM roots JOIN near ON node = doc_id)"""


def hits_sql(rounds: int = ROUNDS) -> str:
    """CTEs ie and h0 to h<rounds>(query_id, doc_id, auth, hub)."""
    out = ["ie AS MATERIALIZED (SELECT a.query_id, src, dst FROM de JOIN bs a ON a.doc_id = src JOIN bs b ON b.doc_id = dst AND b.query_id = a.query_id), h0 AS (SELECT query_id, doc_id, 1.0::DOUBLE AS auth, 1.0::DOUBLE AS hub FROM bs)"]
    for k in range(1, rounds + 1):
        out.append(
            f"n{k} AS (SELECT b.query_id, b.doc_id, coalesce(a.s, 0) AS auth, coalesce(h.s, 0) AS hub FROM bs b LEFT JOIN (SELECT i.query_id, dst AS doc_id, sum(hub) AS s FROM ie i JOIN h{k - 1} p ON p.query_id = i.query_id AND p.doc_id = src GROUP BY ALL) a USING (query_id, doc_id) "
            f"LEFT JOIN (SELECT i.query_id, src AS doc_id, sum(auth) AS s FROM ie i JOIN h{k - 1} p ON p.query_id = i.query_id AND p.doc_id = dst GROUP BY ALL) h USING (query_id, doc_id)), "
            f"h{k} AS MATERIALIZED (SELECT query_id, doc_id, auth / CASE WHEN na > 0 THEN na ELSE 1 END AS auth, hub / CASE WHEN nh > 0 THEN nh ELSE 1 END AS hub FROM n{k} JOIN (SELECT query_id, sqrt(sum(auth * auth)) AS na, sqrt(sum(hub * hub)) AS nh FROM n{k} GROUP BY query_id) USING (query_id))"
        )
    return ", ".join(out)
