"""The inverted index as tables: postings, terms, documents, statistics."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import words
from ..shared import materialise


@dataclass
class Index:
    """postings(term, doc_id, tf); terms(term, df); docs(doc_id, ..., doc_len, tfidf_norm); stats(n_docs, avg_dl), one row."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    stats: DataFrame


def term_counts(pages: DataFrame, stemmer: str = "none") -> DataFrame:
    """term, doc_id, tf over title and text of pages(doc_id, title, text). Stemming takes a pass over distinct terms only."""
    terms = tx.terms_of(F.concat_ws(" ", "title", "text"))
    counts = pages.select("doc_id", F.explode(terms).alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    if stemmer == "none":
        return counts
    stems = tx.stem_vocabulary(counts.select("term").distinct(), stemmer)
    return counts.join(stems, "term").groupBy(F.col("stem").alias("term"), "doc_id").agg(F.sum("tf").alias("tf"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


#: Terms that a task counts before it gives their counts away.
COUNTED = 200_000


def index_terms(pages: DataFrame, stemmer: str = "none") -> DataFrame:
    """The terms(term, df) of build_index, without its postings: each task counts the documents of its terms, so that a row for each task and
    term is dealt out and none for each document and term. Rows of one doc_id are one document, and come to one task if there are any."""
    lower = F.lower(F.concat_ws(" ", "title", "text"))
    repeated = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    texts = pages.select(lower.alias("text")) if repeated.isEmpty() else pages.groupBy("doc_id").agg(F.concat_ws(" ", F.collect_list(lower)).alias("text")).select("text")
    of, stop = tx.STEMMERS[stemmer], frozenset(words.STOP_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems: dict[str, str] = {}
        seen: Counter[str] = Counter()

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"term": pa.array(seen.keys(), pa.string()), "df": pa.array(seen.values(), pa.int64())})

        for batch in batches:
            for text in batch.column("text").to_pylist():
                own = set(re.findall("[a-z0-9]+", text)) - stop
                for term in own:
                    if term not in stems:
                        stems[term] = of(term)
                seen.update({stems[term] for term in own})
                if len(stems) > COUNTED:
                    yield given()
                    seen.clear()
                    stems.clear()
        yield given()

    return texts.mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def idf(df: Column, n_docs: Column) -> Column:
    """log10(N / df); 0 where either is 0."""
    return F.when((df > 0) & (n_docs > 0), F.log10(n_docs / df)).otherwise(0.0)


def tfidf_weight(tf: Column, df: Column, n_docs: Column) -> Column:
    return F.when((tf > 0) & (df > 0), (1 + F.log10(tf)) * F.log10(n_docs / df)).otherwise(0.0)


def corpus_stats(pages: DataFrame, postings: DataFrame) -> DataFrame:
    """n_docs (documents without terms count) and avg_dl."""
    tokens = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_tokens"))
    n = pages.agg(F.count(F.lit(1)).alias("n_docs"))
    average = F.when(F.col("n_docs") > 0, F.col("n_tokens") / F.col("n_docs")).otherwise(0.0)
    return n.crossJoin(F.broadcast(tokens)).select("n_docs", average.alias("avg_dl"))


def document_norms(postings: DataFrame, terms: DataFrame, stats: DataFrame) -> DataFrame:
    """doc_id, doc_len, tfidf_norm."""
    weighed = postings.join(terms, "term").crossJoin(F.broadcast(stats.select("n_docs")))
    w = tfidf_weight(F.col("tf"), F.col("df"), F.col("n_docs"))
    return weighed.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"), F.sqrt(F.sum(w * w)).alias("tfidf_norm"))


def page_meta(pages: DataFrame) -> DataFrame:
    """What is shown of a page: doc_id, url, title, text_preview, content_type, depth; what is missing is empty."""
    have = set(pages.columns)
    column = lambda c, kind, none: (F.coalesce(F.col(c), F.lit(none)) if c in have else F.lit(none)).cast(kind).alias(c)
    return pages.select("doc_id", column("url", "string", ""), column("title", "string", ""), tx.preview(F.col("text")).alias("text_preview"), column("content_type", "string", ""), column("depth", "int", 0))


def build_index(pages: DataFrame, stemmer: str = "none") -> Index:
    """The tables of an index, each written once to the shared folder: texts are cut into terms once, whatever is asked of the index."""
    postings = materialise(term_counts(pages, stemmer), "postings")
    terms = materialise(document_frequency(postings), "terms")
    stats = materialise(corpus_stats(pages, postings), "stats")
    norms = document_norms(postings, terms, stats)
    docs = page_meta(pages).join(norms, "doc_id", "left").withColumn("doc_len", F.coalesce("doc_len", F.lit(0))).withColumn("tfidf_norm", F.coalesce("tfidf_norm", F.lit(0.0)))
    return Index(postings, terms, materialise(docs, "docs"), stats)


def document_vector(index: Index, doc_ids: DataFrame) -> DataFrame:
    """doc_id, term, weight of the given documents."""
    own = index.postings.join(doc_ids.select("doc_id").distinct(), "doc_id").join(index.terms, "term").crossJoin(F.broadcast(index.stats.select("n_docs")))
    return own.select("doc_id", "term", tfidf_weight(F.col("tf"), F.col("df"), F.col("n_docs")).alias("weight"))


def inspect(index: Index, most: int = 10) -> DataFrame:
    """The terms of most documents, with the size of the index on each row."""
    size = index.postings.agg(F.count(F.lit(1)).alias("n_postings"), F.countDistinct("term").alias("n_terms"))
    return index.terms.orderBy(F.desc("df"), "term").limit(most).crossJoin(F.broadcast(size))
