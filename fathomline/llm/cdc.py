"""Substring de-duplication by content-defined chunking.

A gear hash of the last 32 bytes rolls over the UTF-8 bytes of each text, and a chunk ends where its top bits are zero: where
chunks begin and end depends on their content alone, so an insertion moves only the chunks around it. Of chunks with equal
digests the first, in the order of (doc_id, place), stays, and the others are removed. A phrase that many texts share is
no copied passage: chunks count as shared only in runs of neighbours that all stand elsewhere too and have LEAST_RUN bytes together.

Defined results: null text counts as empty and has no chunks; texts are taken whole, of any length; null ids come last;
rows that repeat doc_id and text are one document given twice and get equal results; an empty table gives an empty result;
other columns are never looked at. A text shorter than the least chunk is one chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A chunk's least and greatest bytes, and how many top bits of the hash are zero where one ends.
LEAST, MOST, ZERO_BITS = 24, 160, 4
#: Bytes of a run of shared chunks at least.
LEAST_RUN = 112
DIGEST_BYTES = 16


def gear_table(seed: int = 1) -> np.ndarray:
    """A random 32-bit number for each byte, made from seed."""
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


GEAR = gear_table()


def rolling(buf: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 bytes up to each place: the sum of their numbers, each shifted by its distance."""
    h = GEAR[buf]
    n = 1
    while n < 32:
        more = h.copy()
        more[n:] += h[:-n] << np.uint32(n)
        h, n = more, 2 * n
    return h


def cut_points(text: bytes) -> list[int]:
    """Ends of the chunks of a text; the last is its length."""
    size = len(text)
    if size <= LEAST:
        return [size] if size else []
    ends = (np.nonzero(rolling(np.frombuffer(text, np.uint8)) >> np.uint32(32 - ZERO_BITS) == 0)[0] + 1).tolist()
    cuts, start = [], 0
    for end in [*ends, size]:
        while end - start > MOST:
            start += MOST
            cuts.append(start)
        if end - start >= LEAST:
            cuts.append(end)
            start = end
    if start < size:
        cuts.append(size)
    return cuts


def chunks(docs: DataFrame) -> DataFrame:
    """For docs(doc_id, text): a row for each chunk, doc_id, key (of the text), lo, hi, digest; and one for each text, with lo null,
    its bytes as hi and no digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, 1_000_000):
                row, lo, hi, digests = [], [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    cuts = cut_points(text)
                    begins = [0, *cuts[:-1]] if cuts else []
                    row += [i] * (len(cuts) + 1)
                    lo += [None, *begins]
                    hi += [len(text), *cuts]
                    digests.append(None)
                    digests += [hashlib.blake2b(text[a:b], digest_size=DIGEST_BYTES).digest() for a, b in zip(begins, cuts, strict=True)]
                rows = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("key").take(rows), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "key", "lo", "hi", "digest"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("key"), text.cast("binary").alias("text"))
    return common.map_arrow(rows, run, f"{common.numbered_types(docs, 'doc_id')}, key bigint, lo int, hi int, digest binary")


def passages(lo: np.ndarray, hi: np.ndarray, least: int = LEAST_RUN) -> np.ndarray:
    """Of shared chunks in order: which stand in a run of neighbours of `least` bytes or more."""
    run = np.concatenate(([0], (lo[1:] != hi[:-1]).cumsum())) if len(lo) else np.zeros(0, np.int64)
    return np.bincount(run, hi - lo)[run] >= least if len(lo) else np.zeros(0, bool)


def _sum_up(hits: DataFrame) -> DataFrame:
    """For hits(doc_id, key, own: distinct (lo, hi, gone) of a text's shared chunks): what of them stands in long runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("lo", pa.int32()), ("hi", pa.int32())])
        for batch in batches:
            rows = []
            for own in batch.column("own"):
                lo, hi, gone = (own.values.field(k).to_numpy(zero_copy_only=False) for k in ("lo", "hi", "gone"))
                order = np.argsort(lo)
                lo, hi, gone = lo[order], hi[order], gone[order]
                held = passages(lo, hi)
                gone = gone & held
                size = hi - lo
                rows.append((int(held.sum()), int(size[held].sum()), [{"lo": a, "hi": b} for a, b in zip(lo[gone].tolist(), hi[gone].tolist(), strict=True)], int(size[gone].sum())))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.list_(span), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    names = ["doc_id", "key", "shared_n", "shared_size", "removed", "removed_size"]
    return common.map_arrow(hits, run, f"{common.numbered_types(hits, 'doc_id')}, key bigint, shared_n bigint, shared_size bigint, removed array<struct<lo: int, hi: int>>, removed_size bigint")


def dedup_chunks(docs: DataFrame) -> DataFrame:
    """For each of docs(doc_id, text): doc_id, n_bytes, n_chunks, n_shared (chunks in runs that stand elsewhere too, the first copy
    included), shared_bytes, n_removed_chunks, n_removed (bytes of shared chunks that aren't the first), and spans: the
    removed chunks, as (lo, hi), in order."""
    cut = common.materialise(chunks(docs), "cdc-chunks")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "lo")
    real = cut.where(F.col("digest").isNotNull())
    # A document given twice has each chunk once.
    shared = real.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last or (first is null) <> (last is null)")
    shared = common.materialise(shared.select(F.col("digest").alias("_digest"), "first"), "cdc-shared")
    hits = real.join(shared, F.col("digest") == F.col("_digest"))
    gone = ~place.eqNullSafe(F.col("first"))
    per_doc = hits.groupBy("doc_id", "key").agg(
        F.collect_set(F.struct("lo", "hi", gone.alias("gone"))).alias("own"),  # no more than the chunks of one text
    )
    per_doc = _sum_up(per_doc).withColumnsRenamed({"doc_id": "_doc", "key": "_key"})
    per_doc = common.materialise(per_doc, "cdc-documents")
    counts = real.groupBy("doc_id", "key").agg(F.countDistinct("lo").alias("chunk_n")).select(F.col("doc_id").alias("_doc2"), F.col("key").alias("_key2"), "chunk_n")
    texts = cut.where(F.col("digest").isNull()).select("doc_id", "key", F.col("hi").cast("long").alias("n_bytes"))
    joined = texts.join(counts, F.col("doc_id").eqNullSafe(F.col("_doc2")) & (F.col("key") == F.col("_key2")), "left").join(per_doc, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    spans = F.coalesce("removed", F.array().cast("array<struct<lo:int,hi:int>>"))
    return joined.select(
        "doc_id", "n_bytes", zero("chunk_n").alias("n_chunks"), zero("shared_n").alias("n_shared"), zero("shared_size").alias("shared_bytes"),
        F.size(spans).cast("long").alias("n_removed_chunks"), zero("removed_size").alias("n_removed"), spans.alias("spans"),
    )
