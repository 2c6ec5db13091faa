"""Text vectors: TF-IDF over words and word pairs, projected to a few dimensions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import words
from ..shared import discard, materialise

MAX_FEATURES, MIN_DF, MAX_DF, COMPONENTS, SEED = 25_000, 5, 0.40, 200, 42
#: Extra directions and rounds of the randomised decomposition.
EXTRA, POWER = 10, 2
#: Rows of a result that tasks add up together.
ROWS = 500
#: Blocks of such rows that the driver reads at once.
FETCHED = 15


def gram_words(text: Column) -> Column:
    """Words of two or more letters or digits, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\w\w+)"), F.lit(1)), lambda w: ~w.isin(*words.STOP_WORDS))


def gram_counts(texts: DataFrame) -> DataFrame:
    """doc_id, term, tf of texts(doc_id, text): words, and pairs of neighbours among them.

    Each word comes with the next one from two arrays side by side; a lambda over places would cut the text anew for each."""
    ws = texts.select("doc_id", gram_words(F.col("text")).alias("w"))
    zipped = ws.select("doc_id", F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, 1 << 30).alias("b"))).alias("g"))
    pairs = F.when(F.col("g.b").isNotNull(), F.array(F.col("g.a"), F.concat_ws(" ", "g.a", "g.b"))).otherwise(F.array(F.col("g.a")))
    return zipped.select("doc_id", F.explode(pairs).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def smooth_idf(df: Column, n: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def fit_vocabulary(counts: DataFrame, n_docs: int, max_features: int = MAX_FEATURES, min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """term_id, term, idf: terms of enough and not too many documents; of these the max_features most frequent."""
    per = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    return _numbered(per, n_docs, max_features)


def _numbered(per: DataFrame, n_docs: int, max_features: int) -> DataFrame:
    best = per.orderBy(F.desc("total"), "term").limit(max_features).collect()  # max_features rows at most
    terms = sorted(best, key=lambda r: r["term"])
    frame = pd.DataFrame({"term_id": range(len(terms)), "term": [r["term"] for r in terms], "df": [int(r["df"]) for r in terms]})
    return per.sparkSession.createDataFrame(frame, "term_id int, term string, df long").withColumn("idf", smooth_idf(F.col("df"), F.lit(float(n_docs))))


# -- the same counts by numbers of words, for whole corpora: no row is made for each document and term

#: Words that a task counts before it gives their counts away, and pairs of words.
COUNTED, PAIRED = 200_000, 4_000_000
#: Sums that bound how often a pair stands, over all pairs that share one; a power of 2.
SUMS = 1 << 22


def _texts(texts: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, parts: the lower-cased texts of each doc_id, and whether an id has several; only then rows are dealt out."""
    rows = texts.select("doc_id", F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    if texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return rows.select("doc_id", F.array("text").alias("parts")), False
    return rows.groupBy("doc_id").agg(F.collect_list("text").alias("parts")), True


def _words(text: str) -> list[str]:
    """gram_words with the stop words still there, of a lower-cased text."""
    return re.findall(r"\w\w+", text, re.ASCII)


def word_counts(parts: DataFrame) -> DataFrame:
    """term, df, total of single words of what _texts gives."""
    stop = frozenset(words.STOP_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        df: Counter[str] = Counter()

        def given() -> pa.RecordBatch:
            names = [w for w in total if w not in stop]
            return pa.RecordBatch.from_pydict({"term": pa.array(names, pa.string()), "df": pa.array([df[w] for w in names], pa.int64()), "total": pa.array([total[w] for w in names], pa.int64())})

        for batch in batches:
            for texts in batch.column("parts").to_pylist():
                found = [w for t in texts for w in _words(t)]
                total.update(found)
                df.update(set(found))
                if len(total) > COUNTED:
                    yield given()
                    total.clear()
                    df.clear()
        yield given()

    return parts.select("parts").mapInArrow(run, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


class _Numbers(dict):
    """Numbers of words: -1 for others, -2 for stop words, which pairs pass over."""

    def __init__(self, names: list[str]):
        super().__init__({w: -2 for w in words.STOP_WORDS} | {w: i for i, w in enumerate(names)})

    def __missing__(self, word: str) -> int:
        return -1


def _coded(column: list[list[str]], numbers: _Numbers) -> list[np.ndarray]:
    """Each document's words as numbers, without stop words, -1 after each text."""
    out = []
    for texts in column:
        codes = np.array([n for t in texts for n in (*map(numbers.__getitem__, _words(t)), -1)], np.int32)
        out.append(codes[codes != -2])
    return out


def coded_texts(parts: DataFrame, names: list[str]) -> DataFrame:
    """doc_id, codes: places in names of the words of what _texts gives."""
    shared = parts.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers(shared.value)
        for batch in batches:
            codes = _coded(batch.column("parts").to_pylist(), numbers)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes, pa.list_(pa.int32()))], names=["doc_id", "codes"])

    return parts.mapInArrow(run, f"doc_id {dict(parts.dtypes)['doc_id']}, codes array<int>")


def _flat(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All codes of a column of lists one after another, and the row of each."""
    lengths = codes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)


def _pairs(flat: np.ndarray, rows: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of neighbours as one number, and their rows."""
    there = (flat[:-1] >= 0) & (flat[1:] >= 0) & (rows[:-1] == rows[1:])
    return flat[:-1][there] * n_words + flat[1:][there], rows[1:][there]


def _sum_of(pairs: np.ndarray, n: int) -> np.ndarray:
    """Which of n sums, a power of 2, a pair adds to."""
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64)


def pair_counts(coded: DataFrame, names: list[str], least: int) -> DataFrame:
    """term, df, total of pairs of neighbours that stand `least` times or more. Pairs whose sum stays below can't, and aren't counted one by one."""
    n_words, context = len(names), coded.sparkSession.sparkContext

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SUMS)
        for batch in batches:
            np.add.at(total, _sum_of(_pairs(*_flat(batch.column("codes")), n_words)[0], len(total)), 1.0)
        yield from _sums(total[:, None])

    few = coded.select("codes").coalesce(_tasks(coded))
    often = context.broadcast(np.packbits(_added(few.mapInArrow(bound, SUM_ROWS), SUMS, 1)[:, 0] >= least))
    shared = context.broadcast(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = np.unpackbits(often.value).astype(bool)
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def given() -> pa.RecordBatch:
            pairs, place = np.unique(np.concatenate([np.zeros(0, np.int64), *(w[0] for w in waiting)]), return_inverse=True)
            df, total = (np.bincount(place, np.concatenate([np.zeros(0), *(w[i] for w in waiting)]), len(pairs)).astype(np.int64) for i in (1, 2))
            return pa.RecordBatch.from_pydict({"pair": pa.array(pairs, pa.int64()), "df": pa.array(df, pa.int64()), "total": pa.array(total, pa.int64())})

        for batch in batches:
            pairs, rows = _pairs(*_flat(batch.column("codes")), n_words)
            kept = may[_sum_of(pairs, len(may))]
            found, place = np.unique(pairs[kept], return_inverse=True)
            own = np.unique(rows[kept] * max(1, len(found)) + place)  # a document's distinct pairs
            waiting.append((found, np.bincount(own % max(1, len(found)), minlength=len(found)), np.bincount(place, minlength=len(found))))
            if sum(len(w[0]) for w in waiting) > PAIRED:
                yield given()
                waiting.clear()
        yield given()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [f"{shared.value[p // n_words]} {shared.value[p % n_words]}" for p in batch.column("pair").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), batch.column("df"), batch.column("total")], names=["term", "df", "total"])

    per = few.mapInArrow(count, "pair long, df long, total long").groupBy("pair").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    return per.where(F.col("total") >= least).mapInArrow(named, "term string, df long, total long")


class _Terms:
    """Finds a vocabulary's terms among numbered words."""

    def __init__(self, names: list[str], terms: list[str], idf: np.ndarray):
        number = {w: i for i, w in enumerate(names)}
        self.n_words, self.idf = len(names), idf
        self.single = np.full(len(names) + 1, -1, np.int64)  # the last for words without a number
        pairs = []
        for i, term in enumerate(terms):
            a, _, b = term.partition(" ")
            if b:
                pairs.append((number[a] * self.n_words + number[b], i))
            else:
                self.single[number[a]] = i
        self.pairs, self.pair_ids = np.array(sorted(pairs), np.int64).reshape(-1, 2).T

    def counts(self, codes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term id and count of all terms in a column of lists of numbers, in the order of rows and ids."""
        flat, rows = _flat(codes)
        pairs, pair_rows = _pairs(flat, rows, self.n_words)
        ids, where = self.single[flat], rows
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
            ids, where = np.concatenate([ids, np.where(self.pairs[at] == pairs, self.pair_ids[at], -1)]), np.concatenate([where, pair_rows])
        there, width = ids >= 0, max(1, len(self.idf))
        key, tf = np.unique(where[there] * width + ids[there], return_counts=True)
        return key // width, key % width, tf

    def vectors(self, codes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets of the rows, ids and weights: (1 + ln tf) idf, to unit length."""
        rows, ids, tf = self.counts(codes)
        w = (1 + np.log(tf)) * self.idf[ids]
        norm = np.sqrt(np.bincount(rows, w * w, len(codes)))
        return np.searchsorted(rows, np.arange(len(codes) + 1)).astype(np.int32), ids.astype(np.int32), w / norm[rows]


def corpus_vocabulary(parts: DataFrame, n_docs: int, max_features: int, min_df: int, max_df: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """What fit_vocabulary gives for the texts of _texts; and the texts as numbers of words, with these words.

    If max_features words fit, no pair that stands less often than the last of them is among the best, and no word that stands less often is in
    such a pair; so only pairs of the other words are counted."""
    single = materialise(word_counts(parts), "projection-words")
    fits = (F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs)
    last = single.where(fits).orderBy(F.desc("total")).limit(max_features).agg(F.min("total").alias("least"), F.count(F.lit(1)).alias("n")).first()
    least = max(min_df, last["least"] if last["n"] >= max_features else 1)
    names = sorted(r["term"] for r in single.where((F.col("df") >= min_df) & (F.col("total") >= least)).select("term").collect())
    coded = materialise(coded_texts(parts, names), "projection-codes")
    per = single.unionByName(pair_counts(coded, names, least)).where(fits)
    return materialise(_numbered(per, n_docs, max_features), "projection-terms"), coded, names


def coded_vectors(coded: DataFrame, names: list[str], vocabulary: DataFrame) -> DataFrame:
    """What tfidf_vectors gives, of coded texts."""
    kept = vocabulary.select("term", "idf").orderBy("term_id").toPandas()  # max_features rows at most
    shared = coded.sparkSession.sparkContext.broadcast((names, kept["term"].to_list(), kept["idf"].to_numpy(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Terms(*shared.value)
        for batch in batches:
            offsets, ids, weights = known.vectors(batch.column("codes"))
            rows = pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(offsets, ids), _lists(offsets, weights)], names=["doc_id", "ids", "weights"])
            yield rows.filter(pa.array(np.diff(offsets) > 0))

    return coded.mapInArrow(run, f"doc_id {dict(coded.dtypes)['doc_id']}, ids array<int>, weights array<double>")


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def tfidf_vectors(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc_id, ids, weights: (1 + ln tf) idf over the vocabulary, to unit length. Documents without terms of it are missing."""
    w = counts.join(F.broadcast(vocabulary.select("term", "term_id", "idf")), "term").select("doc_id", "term_id", ((1 + F.log("tf")) * F.col("idf")).alias("w"))  # max_features rows at most
    rows = w.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term_id", "w"))).alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, e: a + e["w"] * e["w"]))
    return rows.withColumn("norm", norm).select("doc_id", F.transform("x", lambda e: e["term_id"]).alias("ids"), F.transform("x", lambda e: e["w"] / F.col("norm")).alias("weights"))


#: Rows of sparse vectors that are made dense at once, over the terms that they have.
BLOCK = 64


def _blocks(pdf: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For blocks of rows of sparse vectors: which rows, the terms that they have, and their weights as a dense matrix over these."""
    for at in range(0, len(pdf), BLOCK):
        part = pdf.iloc[at : at + BLOCK]
        lengths = [len(x) for x in part["ids"]]
        terms, place = np.unique(np.concatenate([np.zeros(0, np.int64), *part["ids"]]).astype(np.int64), return_inverse=True)
        dense = np.zeros((len(part), len(terms)))
        dense[np.repeat(np.arange(len(part)), lengths), place] = np.concatenate([np.zeros(0), *part["weights"]])
        yield slice(at, at + len(part)), terms, dense


def _times(pdf: pd.DataFrame, m: np.ndarray) -> np.ndarray:
    """Rows of sparse vectors times a dense matrix."""
    out = np.zeros((len(pdf), m.shape[1]))
    for rows, terms, dense in _blocks(pdf):
        out[rows] = dense @ m[terms]
    return out


@dataclass
class Projection:
    """A vocabulary and a basis (terms x dimensions); its size is bounded by max_features and components."""

    vocabulary: DataFrame
    basis: np.ndarray

    def term_counts(self, texts: DataFrame) -> DataFrame:
        """doc_id, ids, tfs: the vocabulary's terms in texts(doc_id, text) and their counts, a row for each doc_id."""
        parts, _ = _texts(texts)
        kept = self.vocabulary.select("term", "idf").orderBy("term_id").toPandas()  # max_features rows at most
        shared = texts.sparkSession.sparkContext.broadcast((kept["term"].to_list(), kept["idf"].to_numpy(np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, idf = shared.value
            names = sorted({w for t in terms for w in t.split(" ")})
            numbers, known = _Numbers(names), _Terms(names, terms, idf)
            for batch in batches:
                rows, ids, tf = known.counts(pa.array(_coded(batch.column("parts").to_pylist(), numbers), pa.list_(pa.int32())))
                offsets = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(offsets, ids.astype(np.int32)), _lists(offsets, tf.astype(np.int64))], names=["doc_id", "ids", "tfs"])

        return parts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, ids array<int>, tfs array<bigint>")

    def transform(self, texts: DataFrame) -> DataFrame:
        """doc_id, vec (unit length; zeros where no term is known) of texts(doc_id, text)."""
        parts, repeated = _texts(texts)
        kept = self.vocabulary.select("term", "idf").orderBy("term_id").toPandas()  # max_features rows at most
        shared = texts.sparkSession.sparkContext.broadcast((kept["term"].to_list(), kept["idf"].to_numpy(np.float64), self.basis))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, idf, basis = shared.value
            names = sorted({w for t in terms for w in t.split(" ")})
            numbers, known = _Numbers(names), _Terms(names, terms, idf)
            for batch in batches:
                offsets, ids, weights = known.vectors(pa.array(_coded(batch.column("parts").to_pylist(), numbers), pa.list_(pa.int32())))
                dense = _times(pd.DataFrame({"ids": np.split(ids, offsets[1:-1]), "weights": np.split(weights, offsets[1:-1])}) if batch.num_rows else pd.DataFrame({"ids": [], "weights": []}), basis)
                norm = np.linalg.norm(dense, axis=1, keepdims=True)
                dense = np.divide(dense, norm, out=np.zeros_like(dense), where=norm > 0).astype(np.float32)
                at = np.arange(batch.num_rows + 1, dtype=np.int32) * dense.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(at, dense.ravel())], names=["doc_id", "vec"])

        found = parts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, vec array<float>")
        return found if not repeated else texts.select(F.col("doc_id").alias("own")).join(found, F.col("own").eqNullSafe(F.col("doc_id"))).select("doc_id", "vec")


def _tasks(rows: DataFrame) -> int:
    """How many tasks add up sums of their own: each gives as many as the result has."""
    return max(1, rows.sparkSession.sparkContext.defaultParallelism)


#: Spark's setting by which a query's shuffle files go when it ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SUM_ROWS = "block int, part int, sums binary"


def _per_block(width: int) -> int:
    return max(ROWS, 100_000 // width)


def _sums(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's sums as rows SUM_ROWS, block of rows by block of rows."""
    group, rows = TaskContext.get().partitionId(), _per_block(total.shape[1])
    for at in range(0, len(total), rows):
        part = total[at : at + rows]
        if part.any():
            yield pa.RecordBatch.from_pydict({"block": pa.array([at // rows], pa.int32()), "part": pa.array([group], pa.int32()), "sums": pa.array([part.astype("<f8").tobytes()], pa.binary())})


def _added(sums: DataFrame, n: int, width: int) -> np.ndarray:
    """The sums of all tasks, n rows of a width: added up within groups of tasks, then over these."""
    spark, rows = sums.sparkSession, _per_block(width)
    groups = max(1, int(_tasks(sums) ** 0.5))

    def add(key: tuple, pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum(np.frombuffer(x, "<f8") for pdf in pdfs for x in pdf["sums"])
        yield pd.DataFrame({"block": [key[0]], "part": [0], "sums": [total.tobytes()]})

    if groups > 4:  # few tasks' sums are added up at once
        sums = sums.withColumn("part", F.col("part") % groups).groupBy("block", "part").applyInPandas(add, SUM_ROWS)
    out = np.zeros((n, width))
    before = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")  # sums don't wait on disk until the driver collects its garbage
    try:
        found = materialise(sums.groupBy("block").applyInPandas(add, SUM_ROWS), "sums")
    finally:
        spark.conf.set(CLEANED, before)
    for at in range(0, -(-n // rows), FETCHED):  # some blocks at a time, so that the driver holds the result once
        for r in found.where((F.col("block") >= at) & (F.col("block") < at + FETCHED)).collect():
            part = np.frombuffer(r["sums"], "<f8").reshape(-1, width)
            out[r["block"] * rows : r["block"] * rows + len(part)] = part
    discard(found)
    return out


def _gather(vectors: DataFrame, left: np.ndarray | None, right: np.ndarray, n: int) -> np.ndarray:
    """Sum over rows x of vectors of (x left)' (x right), or of x' (x right). Each task adds up its rows."""
    shared = vectors.sparkSession.sparkContext.broadcast((left, right))
    width = right.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shared.value
        total = np.zeros((n, width))
        for batch in batches:
            pdf = batch.to_pandas()
            if a is not None:
                ours = _times(pdf, b)
                total += (ours if a is b else _times(pdf, a)).T @ ours
                continue
            for _, terms, dense in _blocks(pdf):
                total[terms] += dense.T @ (dense @ b[terms])
        yield from _sums(total)

    out = _added(vectors.select("ids", "weights").coalesce(_tasks(vectors)).mapInArrow(run, SUM_ROWS), n, width)
    shared.destroy()
    return out


def fit_projection(texts: DataFrame, max_features: int = MAX_FEATURES, min_df: int = MIN_DF, max_df: float = MAX_DF, components: int = COMPONENTS, seed: int = SEED) -> Projection:
    """The directions of most weight of the texts' TF-IDF vectors, by a randomised decomposition with power rounds."""
    parts, _ = _texts(texts)
    vocabulary, coded, names = corpus_vocabulary(parts, texts.count(), max_features, min_df, max_df)
    n = vocabulary.count()
    vectors = materialise(coded_vectors(coded, names, vocabulary), "projection-vectors")
    wide = min(components, max(2, n - 1))
    q = np.random.default_rng(seed).standard_normal((n, min(n, wide + EXTRA)))
    for _ in range(POWER + 1):
        q = _gather(vectors, None, q, n)  # the driver holds no more than one of them, and what qr needs
        q = np.linalg.qr(q)[0]
    gram = _gather(vectors, q, q, q.shape[1])
    values, turn = np.linalg.eigh((gram + gram.T) / 2)
    best = np.argsort(values)[::-1][:wide]
    return Projection(vocabulary, q @ turn[:, best])
