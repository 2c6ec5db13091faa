"""The search engine: one index and one graph behind every ranking, for batches of queries."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import expand, graph, index, rank
from ..shared import materialise
from ..sources import store

METHODS = ("tfidf", "bm25", "pagerank", "hits", "tfidf_pagerank", "tfidf_hits")
#: What the service answers, and what a request may call it.
SERVED = ("hits", "tfidf", "pagerank", "tfidf_pagerank", "tfidf_hits")
ALIASES = {"combined": "pagerank"}
#: Terms that an expansion adds at most.
MOST_NEW = 5
EXPANSIONS = ("rocchio", "association", "scalar", "metric")


#: The most results that a request may ask for.
BOUNDS = {"search": 100, "clustered": 50, "external": 20}


def bounded(kind: str, top_k: int) -> int:
    if not 1 <= top_k <= BOUNDS[kind]:
        raise ValueError(f"top_k is from 1 to {BOUNDS[kind]}")
    return top_k


def method_named(name: str, served: bool = True) -> str:
    """The method that a request means; an unknown one is an error."""
    found = ALIASES.get(name.strip().lower(), name.strip().lower())
    if found not in (SERVED if served else METHODS):
        raise ValueError(f"unknown method {name!r}; known are {', '.join(SERVED if served else METHODS)}")
    return found


@dataclass
class SearchEngine:
    index: index.Index
    nodes: DataFrame
    edges: DataFrame
    ranks: DataFrame
    surfaces: DataFrame
    stemmer: str = "english"
    lemmas: DataFrame | None = None

    @classmethod
    def build(cls, pages: DataFrame, nodes: DataFrame, edges: DataFrame, stemmer: str = "english", rounds: int = graph.ROUNDS, lemmas: DataFrame | None = None) -> SearchEngine:
        """Index, ranks and the form that each stem is shown in, all written once to the shared folder. lemmas(surface, lemma) is optional."""
        edges = materialise(edges, "engine-edges")
        surfaces = materialise(expand.stem_surfaces(pages, stemmer), "engine-surfaces")
        return cls(index.build_index(pages, stemmer), nodes, edges, graph.pagerank(nodes, edges, rounds=rounds), surfaces, stemmer, lemmas)

    def save(self, path: str) -> None:
        store.save_index(self.index, f"{path}/index")
        store.save_graph(self.nodes, self.edges, f"{path}/graph")
        store.save({"ranks": self.ranks, "surfaces": self.surfaces}, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, stemmer: str = "english", lemmas: DataFrame | None = None) -> SearchEngine:
        nodes, edges = store.load_graph(spark, f"{path}/graph")
        own = store.load(spark, path, "ranks", "surfaces")
        return cls(store.load_index(spark, f"{path}/index"), nodes, edges, own["ranks"], own["surfaces"], stemmer, lemmas)

    # -- ranking

    def terms(self, queries: DataFrame) -> DataFrame:
        return rank.query_terms(queries, self.stemmer)

    def authorities(self, terms: DataFrame, k: int) -> DataFrame:
        base = materialise(graph.base_set(graph.root_set(self.index.postings, terms), self.nodes, self.edges), "engine-base")
        return graph.rank_hits(graph.hits(base, self.edges), k)

    def rank(self, terms: DataFrame, method: str = "bm25", k: int = 10) -> DataFrame:
        """query_id, doc_id, score, rank."""
        if method == "bm25":
            return rank.rank_bm25(self.index, terms, k)
        if method == "tfidf":
            return rank.rank_tfidf(self.index, terms, k)
        if method == "pagerank":
            return rank.rank_pagerank(self.index, terms, self.ranks, k)
        if method == "hits":
            return self.authorities(terms, k)
        if method == "tfidf_pagerank":
            return rank.rank_tfidf_pagerank(self.index, terms, self.ranks, k)
        if method == "tfidf_hits":
            return rank.rank_tfidf_hits(self.index, terms, self.authorities(terms, rank.WIDER * k), k)
        raise ValueError(f"unknown method {method!r}")

    def search(self, queries: DataFrame, method: str = "bm25", k: int = 10) -> DataFrame:
        """Results of queries(query_id, query), as they are shown."""
        return rank.format_hits(self.rank(self.terms(queries), method, k), self.index.docs)

    def compare(self, queries: DataFrame, methods=METHODS, k: int = 10) -> DataFrame:
        """What every method finds, in one table."""
        out = None
        for m in methods:
            one = self.search(queries, m, k).withColumn("method", F.lit(m))
            out = one if out is None else out.unionByName(one)
        return out

    # -- expansion

    def local_docs(self, terms: DataFrame, k: int = expand.LOCAL_DOCS) -> DataFrame:
        return materialise(self.authorities(terms, k).select("query_id", "doc_id"), "engine-local")

    def corrected(self, queries: DataFrame) -> DataFrame:
        """query_id, place, term: a query's words as stems, misspelt ones corrected to the index's."""
        tokens = queries.select("query_id", F.posexplode(tx.tokenize(F.col("query"))).alias("place", "token"))
        return expand.correct_terms(tokens, self.index.terms, self.stemmer).select("query_id", "place", "term")

    def expand(self, queries: DataFrame, method: str = "association", m: int | None = None, most: int = MOST_NEW, feedback: DataFrame | None = None) -> DataFrame:
        """query_id, rank, term, score: terms that the method adds. m: neighbours of each query term (none: 2 for short queries, else 6)."""
        wanted = queries.select("query_id", F.lit(m).cast("int").alias("m") if m is not None else expand.neighbours_wanted(F.col("query")).alias("m"))
        return self._added(materialise(self.terms(queries), "engine-terms-of"), wanted, method, most, feedback)

    def _added(self, terms: DataFrame, wanted: DataFrame, method: str, most: int, feedback: DataFrame | None) -> DataFrame:
        if method not in EXPANSIONS:
            raise ValueError(f"unknown expansion {method!r}")
        if method == "rocchio":
            return expand.rocchio(self.index, terms, feedback if feedback is not None else expand.pseudo_feedback(self.rank(terms, "tfidf", 3)), most=most, stemmer=self.stemmer)
        local = self.local_docs(terms)
        if method == "metric":
            raw = expand.metric(self.index.docs, local, terms, self.stemmer)
        else:
            tf = materialise(expand.local_tf(self.index, local), "engine-local-tf")
            raw = expand.association(tf, terms, normalized=True) if method == "association" else expand.scalar(tf, terms)
        admitted = expand.admit(raw, self.index, terms, "v", self.stemmer).join(wanted, "query_id")
        return expand.expansion(expand.neighbours(admitted, F.col("m")), most)

    def expanded(self, queries: DataFrame, method: str = "association", most: int = MOST_NEW, feedback: DataFrame | None = None) -> DataFrame:
        """query_id, query: what is searched for instead. Words are corrected, the corrected query is expanded, and both are shown in natural
        forms. A query without local documents stays as corrected stems, one without words as it is."""
        base = materialise(self.corrected(queries), "engine-corrected")
        normal = base.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), " ").alias("normal"))
        normal = materialise(queries.join(normal, "query_id", "left").select("query_id", F.col("query").alias("asked"), F.coalesce("normal", "query").alias("query")), "engine-normal")
        wanted = normal.select("query_id", expand.neighbours_wanted(F.col("asked")).alias("m"))
        terms = materialise(self.terms(normal), "engine-terms-of")
        added = materialise(self._added(terms, wanted, method, most, feedback), "engine-added")
        known = terms if method == "rocchio" else terms.join(self.index.terms, "term", "left_semi")  # else there is no local document
        if method == "rocchio":
            wanted = wanted.withColumn("m", F.lit(None).cast("int"))
        shown = expand.shown_queries(base, added, expand.natural_words(self.surfaces, self.lemmas), expand.safe_stems(self.index.terms, self.stemmer), wanted, self.stemmer)
        shown = shown.join(known.select("query_id").distinct(), "query_id", "left_semi").withColumnRenamed("query", "shown")
        return normal.join(shown, "query_id", "left").select("query_id", F.coalesce("shown", "query").alias("query"))

    def expand_and_search(self, queries: DataFrame, method: str = "association", search: str = "hits", k: int = 10, **more) -> DataFrame:
        return self.search(materialise(self.expanded(queries, method, **more), "engine-expanded"), search, k)

    # -- single requests

    def _asked(self, query: str) -> DataFrame:
        if not query.strip():
            raise ValueError("the query is empty")
        return self.index.docs.sparkSession.range(1).select(F.lit("q").alias("query_id"), F.lit(query).alias("query"))

    def _envelope(self, began: float, found: DataFrame, **more) -> dict:
        rows = found.orderBy("rank").collect()  # top_k rows at most
        results = [{c: r[c] for c in ("rank", "doc_id", "score", "url", "title", "snippet")} for r in rows]
        return {"status": "success", **more, "metadata": {"total_results": len(results), "execution_time_ms": round(1000 * (time.perf_counter() - began), 2)}, "results": results}

    def answer(self, query: str, method: str = "hits", top_k: int = 10) -> dict:
        """The service's envelope for one query."""
        began, top_k = time.perf_counter(), bounded("search", top_k)
        return self._envelope(began, self.search(self._asked(query), method_named(method), top_k))

    def answer_expanded(self, query: str, method: str = "association", search: str = "hits", top_k: int = 10, relevant: Sequence[int] = (), irrelevant: Sequence[int] = ()) -> dict:
        """The envelope of a query that is expanded first. Rocchio moves towards the relevant documents, if any are given."""
        began, top_k = time.perf_counter(), bounded("search", top_k)
        asked = self._asked(query)
        judged = [("q", int(d), good) for ids, good in ((relevant, True), (irrelevant, False)) for d in ids]
        feedback = asked.sparkSession.createDataFrame(judged, "query_id string, doc_id long, relevant boolean") if method == "rocchio" else None
        wider = materialise(self.expanded(asked, method, feedback=feedback), "engine-expanded")
        return self._envelope(began, self.search(wider, method_named(search), top_k), original_query=query, expanded_query=wider.first()["query"])
