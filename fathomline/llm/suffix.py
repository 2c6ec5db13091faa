"""Removal of repeated substrings by blockwise suffix sorting with a difference cover.

Every string of `length` bytes holds one minimiser: its GRAM-gram with the smallest hash, the leftmost of equals. Equal
strings hold equal minimisers at equal places, so that the suffixes of the corpus fall into buckets, one for each minimiser,
and a bucket can be sorted without the others. A run of neighbouring string starts with the same minimiser is one row, with
a digest of its bytes:

1. runs are counted by minimiser and digest; a run that stands twice is repeated as a whole, wherever it stands;
2. of minimisers with several different runs, one copy of each run is cut out of its text, and the buckets are sorted, one
   block of buckets at a time, in numpy: ranks of the suffixes in a difference cover modulo PERIOD are computed first, by
   doubling, and a suffix is then placed by the few bytes before its next cover suffix, that suffix's rank, and the bytes
   beyond the rank's depth. Ties of any length below `length` thus take a few comparisons, and memory is bounded by the block;
3. a bucket of more than Limits.crowd different runs is split first, so that no task holds it: its strings are dealt by their
   distance from the minimiser, a range of distances a piece, and by the bytes that all strings of the range hold, which equal
   strings share. A split bucket goes through steps 1 and 2 like any other, and is split by narrower ranges if it is still too large.

Runs of one bucket are laid out around their minimiser, so that the places of equal strings agree modulo PERIOD and the
cover's shift for a pair depends on the place alone.

Passages that are shorter than `length` stay, but documents that share them are told: n_shared_grams counts, of the
PASSAGE_GRAM-grams that are minimisers of a text's strings of PASSAGE bytes, those that stand in another document too. Documents
that share a string of PASSAGE bytes share such a gram, so that 0 says that no other document holds one of this text's.

Defined results: null text counts as empty; texts shorter than `length` lose nothing; matches never cross documents; rows
that repeat doc_id and text are two documents with equal texts; a text that stands twice loses all of its bytes in both places,
if it has `length` or more; texts are taken whole, of any length; an empty table gives an empty result; other columns are
never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GRAM = 32
#: Bits of a place within a stretch.
PLACE_BITS = 24


@dataclass(frozen=True)
class Limits:
    """Bounds on memory, none of which changes a result. stretch: bytes whose minimisers are found at once, below 2 ** PLACE_BITS.
    block: bytes that are sorted at once, unless one bucket has more. crowd: different runs of a bucket that are sorted at once
    at most; a larger bucket is split."""

    stretch: int = 2_000_000
    block: int = 1_000_000
    crowd: int = 2048


LIMITS = Limits()
PERIOD = 64
#: Bytes of a passage, and of the grams that stand for it. 51 words are mostly 270 bytes or more.
PASSAGE, PASSAGE_GRAM = 256, 96
#: Share of the repeated runs' rows from which a run is joined by broadcast.
HOT_SHARE = 1 / 1024


def difference_cover(period: int) -> list[int]:
    """Residues of which some two differ by any given residue: 0 to r - 1 and the multiples of r."""
    r = int(period**0.5)
    return sorted({*range(r), *range(0, period, r)})


COVER = np.array(difference_cover(PERIOD))
#: For each residue, the distance to the next place of the cover.
SHIFT = np.array([min((c - i) % PERIOD for c in COVER.tolist()) for i in range(PERIOD)])
#: Depth of the cover's ranks, and the shortest string that one rank, a word before it and words after it make up.
DEPTH = 6 * PERIOD
SHORTEST = DEPTH + 8


def _grams(buf: np.ndarray, width: int = GRAM) -> np.ndarray:
    """A hash of the `width` bytes from each place on (of fewer, at the end)."""
    base = 0x9E3779B97F4A7C15
    x, n = buf.astype(np.uint64) + np.uint64(1), 1  # of n bytes: the sum of each, times base to the power of what follows
    out, size = None, 0
    while n <= width:
        if width & n:
            if out is None:
                out, size = x.copy(), n
            else:
                longer = x * np.uint64(pow(base, size, 1 << 64))
                longer[:-n] += out[n:]
                out, size = longer, size + n
        if 2 * n <= width:
            y = x * np.uint64(pow(base, n, 1 << 64))
            y[:-n] += x[n:]
            x = y
        n *= 2
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of the `width` entries from each place on."""
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def _minimisers(raw: bytes, sizes: list[int], length: int, width: int) -> tuple[np.ndarray, ...]:
    """Of the strings of `length` bytes in the texts that raw holds one after the other: their starts, the place of the `width`
    bytes with the smallest hash in each, and the hashes by place."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none.astype(np.uint64)
    buf = np.frombuffer(raw, np.uint8)
    hashes = _grams(buf, width)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = _least((hashes[: len(buf) - width + 1] & ~low) | np.arange(len(buf) - width + 1, dtype=np.uint64), length - width + 1)
    ends = np.repeat(np.cumsum(sizes), sizes)
    starts = np.nonzero(np.arange(len(least)) + length <= ends[: len(least)])[0]
    return starts, (least[starts] & low).astype(np.int64), hashes


def runs_of(raw: bytes, sizes: list[int], length: int) -> tuple[np.ndarray, ...]:
    """Runs of string starts in the texts that raw holds one after the other: first start, last start, place and hash of the
    minimiser."""
    starts, at, hashes = _minimisers(raw, sizes, length, GRAM)
    if not len(starts):
        return starts, starts, at, hashes[:0]
    cuts = np.nonzero((at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))[0] + 1
    first, last = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(starts)])) - 1
    return starts[first], starts[last], at[first], hashes[at[first]]


def _digest(b: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b)


def _stretches(batch: pa.RecordBatch, length: int, stretch: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Rows of texts that are handled together: (row, offset, bytes). A long text comes in parts that hold all of its strings."""
    held, size = [], 0
    for i, text in enumerate(batch.column("text").to_pylist()):
        text = text or b""
        for o in range(0, max(len(text) - length + 1, 0), stretch):
            part = text[o : o + stretch + length - 1]
            if held and size + len(part) > stretch:
                yield held
                held, size = [], 0
            held.append((i, o, part))
            size += len(part)
    if held:
        yield held


def _find_runs(docs: DataFrame, length: int, stretch: int) -> DataFrame:
    """doc_id, key, gram, digest, lo, at, hi: the runs of each text; bytes lo to hi hold them, the minimiser is at `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, 1_000_000):
                for held in _stretches(batch, length, stretch):
                    raw = b"".join(p for _, _, p in held)
                    sizes = [len(p) for _, _, p in held]
                    lo, last, at, gram = runs_of(raw, sizes, length)
                    hi = last + length
                    begin = np.cumsum([0, *sizes[:-1]])
                    which = np.searchsorted(begin, lo, side="right") - 1
                    digests = [_digest(raw[a:b] + (m - a).to_bytes(4, "little")) for a, b, m in zip(lo.tolist(), hi.tolist(), at.tolist(), strict=True)]
                    move = np.array([o for _, o, _ in held])[which] - begin[which]
                    rows = pa.array(np.array([i for i, _, _ in held])[which])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(rows), batch.column("key").take(rows), pa.array(gram.view(np.int64)), pa.array(digests, pa.binary()), *(pa.array((x + move).astype(np.int32)) for x in (lo, at, hi))],
                        names=["doc_id", "key", "gram", "digest", "lo", "at", "hi"],
                    )

    return common.map_arrow(docs, run, f"{common.numbered_types(docs, 'doc_id')}, key bigint, gram bigint, digest binary, lo int, at int, hi int")


def _refine(rank: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Ranks by (rank, more); both below 2 ** 32."""
    key = (rank.astype(np.uint64) << np.uint64(32)) | more.astype(np.uint64)
    order = np.argsort(key)
    ordered = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.concatenate(([0], (ordered[1:] != ordered[:-1]).cumsum()))
    return out


def repeated_starts(runs: list[tuple[bytes, int]], length: int) -> list[np.ndarray]:
    """For runs (bytes, place of the minimiser in them): of which starts the string of `length` bytes stands in two of the
    runs. A start is taken to be comparable with those at its distance from the minimiser."""
    parts, base, at = [], [], 0
    for body, place in runs:
        pad = -(at + place) % PERIOD  # puts the minimiser at a multiple of PERIOD
        parts += [b"\0" * pad, body]
        base.append(at + pad)
        at += pad + len(body)
    buf = np.frombuffer(b"".join(parts) + b"\0" * (DEPTH + 2 * PERIOD), np.uint8)
    word = buf.astype(np.uint64)
    for n in (1, 2, 4):  # the 8 bytes from each place on
        word = (word[:-n] << np.uint64(8 * n)) | word[n:]
    order = np.argsort(word)
    ids = np.empty(len(word), np.int64)
    ids[order] = np.concatenate(([0], (word[order][1:] != word[order][:-1]).cumsum()))

    base_ = np.array(base)
    counts = np.array([len(b) - length + 1 for b, _ in runs])
    starts = np.repeat(base_ - np.concatenate(([0], counts.cumsum()[:-1])), counts) + np.arange(counts.sum())

    # Ranks of the cover's suffixes to DEPTH. They are needed at most PERIOD beyond the last start.
    inside = np.zeros(len(word), bool)
    reach = np.zeros(len(word) + 1, np.int64)
    np.add.at(reach, base_, 1)
    np.add.at(reach, np.minimum(base_ + counts + SHORTEST, len(word)), -1)
    inside[:] = reach[:-1].cumsum() > 0
    cover = np.zeros(PERIOD, bool)
    cover[COVER] = True
    places = np.nonzero(inside & cover[np.arange(len(word)) % PERIOD])[0]
    places = places[places + PERIOD <= len(word)]
    index = np.full(len(word) + DEPTH, len(places), np.int64)
    index[places] = np.arange(len(places))
    rank = ids[places]
    for k in range(1, PERIOD // 8):
        rank = _refine(rank, ids[places + 8 * k])
    then = lambda r, n: np.append(r, r.max(initial=0) + 1)[index[places + n]]  # noqa: E731  rank of what begins n later
    two = _refine(rank, then(rank, PERIOD))
    four = _refine(two, then(two, 2 * PERIOD))
    six = _refine(four, then(two, 4 * PERIOD))

    # Suffixes: residue and rank first, then the word before and the words after; those alone in their class drop out.
    residue = starts % PERIOD
    shift = SHIFT[residue]
    rank = _refine(six[index[starts + shift]], residue)
    left = np.arange(len(starts))
    tail = [*range(DEPTH, length - 8, 8), length - 8]
    for k in [0, *tail]:
        if not len(left):
            break
        rank = _refine(rank, ids[starts[left] + k])
        many = np.bincount(rank)[rank] > 1
        left, rank = left[many], rank[many]
    found = np.zeros(len(starts), bool)
    found[left] = True
    return np.split(found, counts.cumsum()[:-1])


def _sort_buckets(bodies: DataFrame, length: int, most: int) -> DataFrame:
    """For bodies(gram, digest, doc_id, key, lo, at, body, open): spans (doc_id, key, lo, hi) of repeated strings in runs that are open."""
    kind = common.numbered_types(bodies, "doc_id")
    id_type = None

    def spans(block: list[tuple]) -> pa.RecordBatch | None:
        # Rows that repeat a document bring a run twice.
        block = list({(r[0], r[1]): r for r in block}.values())
        marks = repeated_starts([(r[6], r[5] - r[4]) for r in block], length)
        out = []
        for r, mark in zip(block, marks, strict=True):
            if not r[7] or not mark.any():
                continue
            edge = np.diff(np.concatenate(([0], mark.view(np.int8), [0])))
            for a, b in zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True):
                out.append((r[2], r[3], r[4] + a, r[4] + b - 1 + length))
        if not out:
            return None
        ids, keys, lo, hi = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(keys, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["doc_id", "key", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal id_type
        block: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for row in zip(*(batch.column(k).to_pylist() for k in ("gram", "digest", "doc_id", "key", "lo", "at", "body", "open")), strict=True):
                if row[0] != last and size >= most:
                    if (out := spans(block)) is not None:
                        yield out
                    block, size = [], 0
                last = row[0]
                block.append(row)
                size += len(row[6])
        if block and (out := spans(block)) is not None:
            yield out

    dealt = bodies.repartition(common.shuffle_partitions(bodies.sparkSession), "gram").sortWithinPartitions("gram", "digest")
    return common.map_arrow(dealt.select("gram", "digest", "doc_id", "key", "lo", "at", "body", "open"), run, f"{kind}, key bigint, lo int, hi int")


def _split(bodies: DataFrame, length: int, width: int) -> DataFrame:
    """Pieces of the bodies, as gram, digest, doc_id, key, lo, at, hi, open, body: the strings of a piece hold the minimiser at
    distances of one range of width + 1, and gram is a hash of the range and of the length - width bytes that they all hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("gram", "lo", "at", "body")), strict=True)
            which, grams, digests, lows, highs, cut = [], [], [], [], [], []
            for i, (gram, lo, at, body) in enumerate(rows):
                n, place = len(body) - length + 1, at - lo
                for part in range((place - n + 1) // (width + 1), place // (width + 1) + 1):
                    near = part * (width + 1)  # distances from near to near + width
                    first, last = max(place - near - width, 0), min(place - near, n - 1)
                    common_bytes = body[place - near : place - near - width + length]
                    piece = body[first : last + length]
                    grams.append(xxhash.xxh3_64_intdigest(common_bytes + part.to_bytes(4, "little"), gram & (2**64 - 1)))
                    digests.append(_digest(piece + (place - first).to_bytes(4, "little")))
                    which.append(i)
                    lows.append(lo + first)
                    highs.append(lo + last + length)
                    cut.append(piece)
            one = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(grams, np.uint64).view(np.int64)), pa.array(digests, pa.binary()), *(batch.column(c).take(one) for c in ("doc_id", "key")), pa.array(lows, pa.int32()), batch.column("at").take(one), pa.array(highs, pa.int32()), batch.column("open").take(one), pa.array(cut, pa.binary())],
                names=["gram", "digest", "doc_id", "key", "lo", "at", "hi", "open", "body"],
            )

    schema = f"gram bigint, digest binary, {common.numbered_types(bodies, 'doc_id')}, key bigint, lo int, at int, hi int, open boolean, body binary"
    return common.map_arrow(bodies.select("gram", "doc_id", "key", "lo", "at", "open", "body"), run, schema)


def _sort_crowded(crowd: DataFrame, length: int, limits: Limits) -> list[DataFrame]:
    """Spans as those of _sort_buckets, for the bodies of buckets that are too large for it."""
    found, width = [], length - GRAM
    while not crowd.isEmpty():
        width //= 4  # at 0 all pieces of a bucket are equal, and none is left
        pieces = common.materialise(_split(crowd, length, width), "suffix-pieces")
        one = F.min(F.struct("key", "doc_id", "lo", "at", "body")).alias("one")
        # A piece that is not open is of a run that stands twice.
        kinds = pieces.groupBy("gram", "digest").agg(F.count(F.lit(1)).alias("n"), F.bool_and("open").alias("open"), one)
        kinds = common.materialise(kinds.select("gram", "digest", "n", (F.col("open") & (F.col("n") == 1)).alias("open"), "one.*"), "suffix-kinds")
        again = kinds.where("not open").select(F.col("gram").alias("_gram"), F.col("digest").alias("_digest"), "n")
        found += _whole_runs(pieces.where("open"), common.materialise(again, "suffix-again"))
        contested = _contested(kinds, limits.crowd)
        bodies = common.materialise(kinds.join(contested, F.col("gram") == F.col("_gram")).drop("_gram", "n"), "suffix-bodies")
        found.append(_sort_buckets(bodies.where("not crowded"), length, limits.block))
        common.discard(kinds, contested)
        crowd = bodies.where("crowded")
    return found


def _contested(kinds: DataFrame, crowd: int) -> DataFrame:
    """_gram and crowded of the buckets of several kinds(gram), written."""
    found = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return common.materialise(found.select(F.col("gram").alias("_gram"), (F.col("m") > crowd).alias("crowded")), "suffix-contested")


def _whole_runs(runs: DataFrame, again: DataFrame) -> list[DataFrame]:
    """doc_id, key, lo, hi of the runs whose (gram, digest) the written table again(_gram, _digest, n) holds."""
    pair = (F.col("gram") == F.col("_gram")) & (F.col("digest") == F.col("_digest"))
    hot, few = _by_heat(again)
    return [runs.join(hot, pair, "left_semi").select("doc_id", "key", "lo", "hi"), runs.join(hot, pair, "left_anti").join(few, pair).select("doc_id", "key", "lo", "hi")]


def _cut_bodies(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """wanted(doc_id, key, runs) joined with texts(doc_id, key, text): one row a run, with its bytes."""
    by_doc = wanted.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "runs")
    joined = texts.join(by_doc.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")))
    cut = joined.select("doc_id", "key", "text", F.explode("runs").alias("r"))
    return cut.select("r.gram", "r.digest", "doc_id", "key", "r.lo", "r.at", F.expr("substring(text, r.lo + 1, r.hi - r.lo)").alias("body"), "r.open", "r.crowded")


def shared_grams(docs: DataFrame, passage: int = PASSAGE, width: int = PASSAGE_GRAM, limits: Limits = LIMITS) -> DataFrame:
    """doc_id, key and n_shared_grams of the documents that share a minimiser of their passages with another row, for docs(doc_id,
    key, text as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, 1_000_000):
                found: dict[int, list[np.ndarray]] = {}
                for held in _stretches(batch, passage, limits.stretch):
                    starts, at, hashes = _minimisers(b"".join(p for _, _, p in held), [len(p) for _, _, p in held], passage, width)
                    if not len(starts):
                        continue
                    begin = np.cumsum([0, *(len(p) for _, _, p in held[:-1])])
                    at = np.unique(at)
                    which = np.searchsorted(begin, at, side="right") - 1
                    for k in np.unique(which).tolist():
                        found.setdefault(held[k][0], []).append(hashes[at[which == k]])
                own = {i: np.unique(np.concatenate(x)) for i, x in found.items()}  # once a row
                rows = pa.array(np.repeat(list(own), [len(x) for x in own.values()]).astype(np.int64))
                grams = np.concatenate([np.zeros(0, np.uint64), *own.values()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("key").take(rows), pa.array(grams.view(np.int64))], names=["doc_id", "key", "gram"])

    grams = common.materialise(common.map_arrow(docs, run, f"{common.numbered_types(docs, 'doc_id')}, key bigint, gram bigint"), "suffix-grams")
    again = common.materialise(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("gram").alias("_gram"), "n"), "suffix-shared")
    hot, few = _by_heat(again)
    same = F.col("gram") == F.col("_gram")
    found = grams.join(hot, same).select("doc_id", "key", "gram").unionByName(grams.join(few, same).select("doc_id", "key", "gram"))
    out = common.materialise(found.groupBy("doc_id", "key").agg(F.count_distinct("gram").alias("n_shared_grams")), "suffix-passages")
    common.discard(grams, again)
    return out


def _by_heat(again: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a written table of repeated keys with the number n of their rows: those that hold HOT_SHARE of the rows, to be broadcast,
    no more than 1 / HOT_SHARE of them; and the others, which meet their rows in a sort-merge join."""
    total = again.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(again.where(F.col("n") > total * HOT_SHARE).drop("n")), again.where(F.col("n") <= total * HOT_SHARE).drop("n").hint("merge")


def repeated_spans(docs: DataFrame, length: int = 400, limits: Limits = LIMITS) -> DataFrame:
    """doc_id, key and spans (arrays of lo, hi, in no order), written, of bytes under strings that stand elsewhere too, for docs(doc_id, key,
    text as binary). One row for each document that has such."""
    if length < SHORTEST + 8:
        raise ValueError(f"length must be {SHORTEST + 8} or more")
    runs = common.materialise(_find_runs(docs, length, limits.stretch), "suffix-runs")
    one = F.min(F.struct("key", "doc_id", "lo", "at", "hi")).alias("one")
    kinds = common.materialise(runs.groupBy("gram", "digest").agg(F.count(F.lit(1)).alias("n"), one), "suffix-kinds")
    contested = _contested(kinds, limits.crowd)
    wanted = kinds.join(contested, F.col("gram") == F.col("_gram")).select("gram", "digest", (F.col("n") == 1).alias("open"), "crowded", "one.*")
    wanted = wanted.groupBy("doc_id", "key").agg(F.collect_list(F.struct("gram", "digest", "lo", "at", "hi", "open", "crowded")).alias("runs"))
    bodies = common.materialise(_cut_bodies(wanted, docs), "suffix-bodies")
    found = [_sort_buckets(bodies.where("not crowded"), length, limits.block), *_sort_crowded(bodies.where("crowded"), length, limits)]
    again = kinds.where("n > 1").select(F.col("gram").alias("_gram"), F.col("digest").alias("_digest"), "n")
    again = common.materialise(again, "suffix-again")
    found += _whole_runs(runs, again)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    spans = common.materialise(every.groupBy("doc_id", "key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "suffix-spans")
    common.discard(runs, kinds, contested, bodies, again)
    return spans


def remove_repeats(docs: DataFrame, length: int = 400, with_text: bool = False, limits: Limits = LIMITS) -> DataFrame:
    """For each of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the bytes that are
    left, n_shared_grams, and the bytes that are left as `kept_text` (binary) if with_text."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    texts = docs.select("doc_id", text.alias("text")).withColumn("key", F.xxhash64("text"))
    marks = shared_grams(texts, limits=limits).select("doc_id", "key", F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("spans"), "n_shared_grams")
    spans = repeated_spans(texts, length, limits).select("doc_id", "key", "spans", F.lit(None).cast("long").alias("n_shared_grams"))
    by_doc = marks.unionByName(spans).groupBy("doc_id", "key").agg(F.first("spans", ignorenulls=True).alias("spans"), F.max("n_shared_grams").alias("n_shared_grams"))
    by_doc = by_doc.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "spans", "n_shared_grams")
    joined = texts.join(by_doc.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")
    joined = joined.select("doc_id", "text", "spans", F.coalesce("n_shared_grams", F.lit(0)).cast("long").alias("n_shared_grams"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_grams", *["kept_text"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole):
                rows = []
                for body, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                    left, at, gone, runs = [], 0, 0, 0
                    for lo, hi in sorted((s["lo"], s["hi"]) for s in own or ()):
                        if lo > at or not runs:
                            runs += 1
                            left.append(body[at:lo])
                        gone += max(0, hi - max(lo, at))
                        at = max(at, hi)
                    left.append(body[at:])
                    kept = b"".join(left)
                    rows.append((len(body), gone, runs, hashlib.sha256(kept).hexdigest(), kept))
                columns = list(zip(*rows, strict=True))
                counts = [pa.array(c, t) for c, t in zip(columns[:4], (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, batch.column("n_shared_grams"), *[pa.array(columns[4], pa.binary())] * with_text], names=names)

    schema = f"{common.numbered_types(docs, 'doc_id')}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_shared_grams bigint"
    return common.map_arrow(joined, run, schema + ", kept_text binary" * with_text)
