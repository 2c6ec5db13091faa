"""Index, ranking and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph, index, rank
from ..plans import engine
from ..shared import materialise, shared_path
from ..sources import store
from . import base as b


def tokenize_terms(spark, sf):
    tokens = b.table(spark, sf, "documents").select(F.explode(tx.tokenize(F.col("text"))).alias("term"))
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def stopword_filter(spark, sf):
    return b.corpus(spark, sf).select("doc_id", F.size(tx.tokenize(F.col("text"))).cast("long").alias("n_tokens"), F.size(tx.terms_of(F.col("text"))).cast("long").alias("n_terms"))


def postings(spark, sf):
    return index.term_counts(b.corpus(spark, sf))


def term_df(spark, sf):
    return index.document_frequency(index.term_counts(b.corpus(spark, sf)))


def corpus_stats(spark, sf):
    pages = b.corpus(spark, sf)
    return index.corpus_stats(pages, index.term_counts(pages)).withColumn("avg_dl", F.round("avg_dl", 6))


def doc_norms(spark, sf):
    return b.index_of(spark, sf).docs.select("doc_id", "doc_len", F.round("tfidf_norm", 6).alias("tfidf_norm"))


def doc_store(spark, sf):
    return index.page_meta(b.corpus(spark, sf))


def doc_vectors(spark, sf):
    i = b.index_of(spark, sf)
    return index.document_vector(i, i.docs).withColumn("weight", F.round("weight", 6))


def index_sample(spark, sf):
    return index.inspect(b.index_of(spark, sf))


def stem_terms(spark, sf):
    terms = b.index_of(spark, sf).terms
    return tx.stem_vocabulary(terms, "english").join(tx.stem_vocabulary(terms, "porter").withColumnRenamed("stem", "porter_stem"), "term")


def stemmed_postings(spark, sf):
    return index.term_counts(b.corpus(spark, sf), "english")


def bm25_topk(spark, sf):
    return rank.rank_bm25(b.index_of(spark, sf), b.terms_of(spark, sf), b.K).withColumn("score", F.round("score", 6))


def tfidf_topk(spark, sf):
    return rank.rank_tfidf(b.index_of(spark, sf), b.terms_of(spark, sf), b.K).withColumn("score", F.round("score", 6))


def format_hits(spark, sf):
    i = b.index_of(spark, sf)
    return rank.format_hits(rank.rank_bm25(i, b.terms_of(spark, sf), b.K), i.docs)


def bm25_stemmed(spark, sf):
    return rank.rank_bm25(b.index_of(spark, sf, "english"), rank.query_terms(b.queries_of(spark, sf), "english"), b.K)


def graph_edges(spark, sf):
    return b.part_graph(spark, sf)[1]


def page_graph(spark, sf):
    """Pages whose URL another page has after /en/ and the like: links of the same host."""
    pages = b.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    links = pages.select(F.col("url").alias("src_url"), F.regexp_replace("url", "[#?].*$", "").alias("dst_url"))
    nodes, edges = graph.build_graph(pages, links)
    return graph.degrees(nodes, edges)


def graph_stats(spark, sf):
    return graph.graph_stats(*b.part_graph(spark, sf))


def graph_hubs_authorities(spark, sf):
    return graph.hubs_and_authorities(*b.part_graph(spark, sf))


def dead_ends(spark, sf):
    return graph.dead_ends(*b.part_graph(spark, sf))


def degree_subgraph(spark, sf):
    return graph.degree_subgraph(*b.part_graph(spark, sf))


def pagerank_fixed(spark, sf):
    nodes, edges = b.part_graph(spark, sf)
    return graph.pagerank(nodes, edges, rounds=b.ROUNDS, tolerance=None).withColumn("score", F.round("score", 9))


def pagerank_converged(spark, sf):
    nodes, edges = b.doc_graph(spark, sf)
    return graph.pagerank(nodes, edges).withColumn("score", F.round("score", 8))


def _base(spark, sf):
    nodes, edges = b.doc_graph(spark, sf)
    edges = materialise(edges, "doc-edges")
    roots = graph.root_set(b.index_of(spark, sf).postings, b.terms_of(spark, sf))
    return materialise(graph.base_set(roots, nodes, edges), "base-set"), edges


def hits_base_set(spark, sf):
    return _base(spark, sf)[0]


def hits_induced(spark, sf):
    return graph.induced_edges(*_base(spark, sf)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_edges"))


def hits_fixed(spark, sf):
    scores = graph.hits(*_base(spark, sf), rounds=b.ROUNDS, tolerance=None)
    return scores.select("query_id", "doc_id", F.round("authority", 6).alias("authority"), F.round("hub", 6).alias("hub"))


def hits_topk(spark, sf):
    return graph.rank_hits(graph.hits(*_base(spark, sf)), b.K)


def _ranks(spark, sf):
    nodes, edges = b.doc_graph(spark, sf)
    return graph.pagerank(nodes, edges, rounds=b.ROUNDS, tolerance=None)


def pagerank_rerank(spark, sf):
    return rank.rank_pagerank(b.index_of(spark, sf), b.terms_of(spark, sf), _ranks(spark, sf), b.K).withColumn("score", F.round("score", 9))


def tfidf_pagerank(spark, sf):
    return rank.rank_tfidf_pagerank(b.index_of(spark, sf), b.terms_of(spark, sf), _ranks(spark, sf), b.K).withColumn("score", F.round("score", 6))


def tfidf_hits(spark, sf):
    best = graph.rank_hits(graph.hits(*_base(spark, sf), rounds=b.ROUNDS, tolerance=None), rank.WIDER * b.K)
    return rank.rank_tfidf_hits(b.index_of(spark, sf), b.terms_of(spark, sf), best, b.K).withColumn("score", F.round("score", 6))


def match_strength(spark, sf):
    best = rank.rank_tfidf(b.index_of(spark, sf), b.terms_of(spark, sf), b.K)
    from pyspark.sql import Window

    top = F.max("score").over(Window.partitionBy("query_id"))
    return best.select("query_id", "doc_id", rank.match_strength(F.round("score", 6)).alias("strength"), F.round(rank.score_width(F.col("score"), top), 6).alias("width"))


def domain_overlap(spark, sf):
    i, terms = b.index_of(spark, sf), b.terms_of(spark, sf)
    sources = b.table(spark, sf, "documents").select("doc_id", F.col("source").alias("domain"))
    left, right = (r.join(sources, "doc_id").select("query_id", "doc_id", "domain") for r in (rank.rank_bm25(i, terms, b.K), rank.rank_tfidf(i, terms, b.K)))
    return rank.domain_overlap(left, right).select("query_id", "doc_id", "domain", "shared")


def compare_models(spark, sf):
    """One table of what each model returns: the batch form of asking all of them at once. Links take a fixed number of rounds."""
    i, terms, ranks = b.index_of(spark, sf), materialise(b.terms_of(spark, sf), "compare-terms"), materialise(_ranks(spark, sf), "compare-ranks")
    scores = materialise(graph.hits(*_base(spark, sf), rounds=b.ROUNDS, tolerance=None), "compare-hits")
    wide = graph.rank_hits(scores, rank.WIDER * b.K)
    found = {
        "bm25": rank.rank_bm25(i, terms, b.K), "tfidf": rank.rank_tfidf(i, terms, b.K), "pagerank": rank.rank_pagerank(i, terms, ranks, b.K), "hits": graph.rank_hits(scores, b.K),
        "tfidf_pagerank": rank.rank_tfidf_pagerank(i, terms, ranks, b.K), "tfidf_hits": rank.rank_tfidf_hits(i, terms, wide, b.K),
    }
    parts = [df.select(F.lit(m).alias("method"), "query_id", "rank", "doc_id", F.round("score", 6).alias("score")) for m, df in found.items()]
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole


def served_search(spark, sf):
    """All queries through the stored engine with stems, by each served method, as results are shown."""
    return b.engine_of(spark, sf, "english").compare(b.queries_of(spark, sf), engine.SERVED, b.K)


def stored_index(spark, sf):
    """An index that is written and read again: its terms."""
    path = shared_path(spark, "stored-index")
    store.save_index(b.index_of(spark, sf), path)
    found = store.load_index(spark, path)
    return index.document_frequency(found.postings)


def stored_graph(spark, sf):
    """A graph with its ranks, written and read again: edges with the rank of their source."""
    path, (nodes, edges) = shared_path(spark, "stored-graph"), b.part_graph(spark, sf)
    store.save_graph(nodes, edges, path)
    store.save({"ranks": graph.pagerank(nodes, edges, rounds=b.ROUNDS, tolerance=None)}, path)
    (_, edges), ranks = store.load_graph(spark, path), store.load(spark, path, "ranks")["ranks"]
    return edges.join(ranks.withColumnRenamed("id", "src"), "src").select("src", "dst", F.round("score", 9).alias("score"))


def added_edges(spark, sf):
    """The part graph and its edges turned round, each edge once and none from a node to itself."""
    _, edges = b.part_graph(spark, sf)
    return graph.add_edges(edges, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).unionByName(edges.select("src", F.col("src").alias("dst"))))


QUERIES = {f.__name__: f for f in (
    tokenize_terms, stopword_filter, postings, term_df, corpus_stats, doc_norms, doc_store, doc_vectors, index_sample, stem_terms, stemmed_postings, bm25_topk, tfidf_topk, format_hits, bm25_stemmed,
    graph_edges, page_graph, graph_stats, graph_hubs_authorities, dead_ends, degree_subgraph, pagerank_fixed, pagerank_converged, hits_base_set, hits_induced, hits_fixed, hits_topk, pagerank_rerank,
    tfidf_pagerank, tfidf_hits, match_strength, domain_overlap, compare_models, served_search, stored_index, stored_graph, added_edges,
)}

_SOURCE = "'https://www.' || source || '.example.org/doc/' || doc_id"
_DEGREES = "deg2 AS MATERIALIZED (SELECT id, coalesce(o, 0) AS o, coalesce(i, 0) AS i FROM pn LEFT JOIN (SELECT src AS id, count(*) AS o FROM pe GROUP BY src) USING (id) LEFT JOIN (SELECT dst AS id, count(*) AS i FROM pe GROUP BY dst) USING (id))"
_DOCN = "dn AS (SELECT doc_id AS id FROM documents)"
_PR = f"{_DOCN}, {b.pagerank_sql('dn', 'de')}"
_WIDE = b.top("tfidf", 50)
#: Rounds within which PageRank settles on these graphs.
CONVERGED = 40
_MOVES = "mv AS (" + " UNION ALL ".join(f"SELECT {k} AS k, sum(abs(a.score - b.score)) AS moved FROM pr{k} a JOIN pr{k - 1} b USING (id)" for k in range(1, CONVERGED + 1)) + ")"

ORACLE_SQL = {
    "tokenize_terms": f"SELECT term, count(*) AS n FROM ({b.TOKENS}) GROUP BY term",
    "stopword_filter": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_filter(t, lambda x: x NOT IN ({b.STOP})))::BIGINT AS n_terms FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents)",
    "postings": f"WITH {b.CTE} SELECT * FROM postings",
    "term_df": f"WITH {b.CTE} SELECT * FROM terms",
    "corpus_stats": f"WITH {b.CTE} SELECT n_docs, round(avg_dl, 6) AS avg_dl FROM st",
    "doc_norms": f"WITH {b.CTE} SELECT doc_id, doc_len::BIGINT AS doc_len, round(tfidf_norm, 6) AS tfidf_norm FROM docs",
    "doc_store": f"SELECT doc_id, {_SOURCE} AS url, '' AS title, left(text, 500) AS text_preview, 'text/html' AS content_type, 1 AS depth FROM documents",
    "doc_vectors": f"WITH {b.CTE} SELECT doc_id, term, round((1 + log10(tf)) * log10(n_docs / df), 6) AS weight FROM postings JOIN terms USING (term), st",
    "index_sample": f"WITH {b.CTE} SELECT term, df, (SELECT count(*) FROM postings) AS n_postings, (SELECT count(DISTINCT term) FROM postings) AS n_terms FROM terms ORDER BY df DESC, term LIMIT 10",
    "bm25_topk": f"WITH {b.CTE}, {b.BM25} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ({b.top('bm25')})",
    "tfidf_topk": f"WITH {b.CTE}, {b.TFIDF} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ({b.top('tfidf')})",
    "format_hits": f"WITH {b.CTE}, {b.BM25} SELECT query_id, rank, doc_id, round(score, 6) AS score, {_SOURCE} AS url, '' AS title, left(text, 300) AS snippet FROM ({b.top('bm25')}) JOIN documents USING (doc_id)",
    "graph_edges": f"WITH {b.EDGES} SELECT src, dst FROM pe",
    "page_graph": """
WITH e AS (SELECT DISTINCT s.page_id AS src, d.page_id AS dst FROM pages s JOIN pages d ON d.url = regexp_replace(s.url, '[#?].*$', '') WHERE s.page_id <> d.page_id)
SELECT page_id AS id, (SELECT count(*) FROM e WHERE src = page_id) AS out_degree, (SELECT count(*) FROM e WHERE dst = page_id) AS in_degree FROM pages""",
    "graph_stats": f"WITH {b.EDGES}, {_DEGREES} SELECT count(*) AS n_nodes, sum(o)::BIGINT AS n_edges, max(i) AS max_in_degree, (SELECT id FROM deg2 ORDER BY i DESC, id LIMIT 1) AS max_in_node, max(o) AS max_out_degree, (SELECT id FROM deg2 ORDER BY o DESC, id LIMIT 1) AS max_out_node, round(sum(o) / count(*), 2) AS avg_out_degree FROM deg2",
    "graph_hubs_authorities": f"WITH {b.EDGES}, {_DEGREES} SELECT 'hub' AS kind, row_number() OVER (ORDER BY o DESC, id) AS place, id, o AS degree FROM deg2 QUALIFY place <= 10 UNION ALL SELECT 'authority', row_number() OVER (ORDER BY i DESC, id) AS place, id, i FROM deg2 QUALIFY place <= 10",
    "dead_ends": f"WITH {b.EDGES}, {_DEGREES} SELECT count(*) FILTER (o = 0) AS dead_ends, count(*) FILTER (o = 0 AND i = 0) AS isolates FROM deg2",
    "degree_subgraph": f"WITH {b.EDGES}, {_DEGREES}, k AS (SELECT id FROM deg2 WHERE o + i >= 5 ORDER BY o + i DESC, id LIMIT 800) SELECT src, dst FROM pe WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)",
    "pagerank_fixed": f"WITH {b.EDGES}, {b.pagerank_sql('pn', 'pe')} SELECT id, round(score, 9) AS score FROM pr{b.ROUNDS}",
    "hits_base_set": f"WITH {b.CTE}, {b.EDGES}, {b.BASE_SET} SELECT query_id, doc_id FROM bs",
    "hits_induced": f"WITH {b.CTE}, {b.EDGES}, {b.BASE_SET} SELECT a.query_id, count(*) AS n_edges FROM de JOIN bs a ON a.doc_id = src JOIN bs b ON b.doc_id = dst AND a.query_id = b.query_id GROUP BY a.query_id",
    "hits_fixed": f"WITH {b.CTE}, {b.EDGES}, {b.BASE_SET}, {b.hits_sql()} SELECT query_id, doc_id, round(auth, 6) AS authority, round(hub, 6) AS hub FROM h{b.ROUNDS}",
    "pagerank_rerank": f"WITH {b.CTE}, {b.TFIDF}, {b.EDGES}, {_PR}, w AS (SELECT query_id, doc_id, rank AS text_rank FROM ({_WIDE})), s AS (SELECT query_id, doc_id, text_rank, coalesce(score, 0) AS score FROM w LEFT JOIN pr{b.ROUNDS} ON id = doc_id) SELECT query_id, doc_id, rank, round(score, 9) AS score FROM ({b.top('s', last='text_rank')})",
    "tfidf_pagerank": f"WITH {b.CTE}, {b.TFIDF}, {b.EDGES}, {_PR}, w AS ({_WIDE}), s AS (SELECT query_id, doc_id, 0.7 * (w.score / CASE WHEN best <> 0 THEN best ELSE 1 END) + 0.3 * (coalesce(p.score, 0) * 1000) AS score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM w) w LEFT JOIN pr{b.ROUNDS} p ON id = doc_id) SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ({b.top('s')})",
    "tfidf_hits": f"WITH {b.CTE}, {b.TFIDF}, {b.EDGES}, {b.BASE_SET}, {b.hits_sql()}, w AS ({_WIDE}), a0 AS (SELECT query_id, doc_id, auth AS score FROM h{b.ROUNDS}), a AS ({b.top('a0', 50)}), s AS (SELECT query_id, doc_id, 0.7 * (w.score / CASE WHEN best <> 0 THEN best ELSE 1 END) + 0.3 * coalesce(a.score, 0) AS score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM w) w LEFT JOIN a USING (query_id, doc_id)) SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ({b.top('s')})",
    "match_strength": f"WITH {b.CTE}, {b.TFIDF} SELECT query_id, doc_id, CASE WHEN round(score, 6) >= 0.7 THEN 'Strong' WHEN round(score, 6) >= 0.3 THEN 'Moderate' ELSE 'Weak' END AS strength, round(greatest(6.0, least(100.0, 100.0 * score / greatest(max(score) OVER (PARTITION BY query_id), 1.0))), 6) AS width FROM ({b.top('tfidf')})",
    "domain_overlap": f"WITH {b.CTE}, {b.BM25}, {b.TFIDF}, l AS (SELECT query_id, doc_id, source AS domain FROM ({b.top('bm25')}) JOIN documents USING (doc_id)), r AS (SELECT DISTINCT query_id, source AS domain FROM ({b.top('tfidf')}) JOIN documents USING (doc_id)) SELECT l.query_id, doc_id, l.domain, r.domain IS NOT NULL AS shared FROM l LEFT JOIN r ON l.query_id = r.query_id AND l.domain = r.domain",
    "stored_index": f"WITH {b.CTE} SELECT * FROM terms",
    "stored_graph": f"WITH {b.EDGES}, {b.pagerank_sql('pn', 'pe')} SELECT src, dst, round(score, 9) AS score FROM pe JOIN pr{b.ROUNDS} ON id = src",
    "added_edges": f"WITH {b.EDGES} SELECT src, dst FROM pe UNION SELECT dst, src FROM pe",
    "pagerank_converged": f"WITH {b.EDGES}, {_DOCN}, {b.pagerank_sql('dn', 'de', CONVERGED)}, {_MOVES}, stop AS (SELECT min(k) AS k FROM mv WHERE moved < 1e-6) " + " UNION ALL ".join(f"SELECT id, round(score, 8) AS score FROM pr{k}, stop WHERE k = {k}" for k in range(1, CONVERGED + 1)),
}
_MODELS = {"bm25": "bm25_topk", "tfidf": "tfidf_topk", "pagerank": "pagerank_rerank", "tfidf_pagerank": "tfidf_pagerank", "tfidf_hits": "tfidf_hits"}
ORACLE_SQL["compare_models"] = " UNION ALL ".join(
    [f"SELECT '{m}' AS method, query_id, rank, doc_id, round(score, 6) AS score FROM ({ORACLE_SQL[q]})" for m, q in _MODELS.items()]
    + [f"SELECT 'hits', query_id, rank, doc_id, round(score, 6) FROM (WITH {b.CTE}, {b.EDGES}, {b.BASE_SET}, {b.hits_sql()}, a0 AS (SELECT query_id, doc_id, auth AS score FROM h{b.ROUNDS}) {b.top('a0')})"]
)
