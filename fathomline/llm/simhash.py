"""Near-duplicates by SimHash: tiled exact comparison of fingerprints.

Equal fingerprints are one node. Fingerprints within the radius agree in at least `blocks - radius` of `blocks` equal
parts of their bits, so each fingerprint is dealt to one bucket for every choice of so many parts; which division is used
depends on the number of fingerprints alone, and any of them finds every link. Within a bucket fingerprints stand in order
of their population count and are compared tile by tile with exclusive-or and bit counts; tile pairs whose population
counts differ by more than the radius are skipped. A bucket beyond CROWD fingerprints is cut into parts, and every pair of
its parts becomes a bucket. A bucket returns a spanning forest of its links, so that rows stay in proportion to
fingerprints, and components are found from these.

Defined results: null and empty texts, and texts without words, have fingerprint zero, which links like any other; fewer
words than a shingle has are one shingle; texts are taken whole, of any length; repeated rows share a fingerprint; a
component's id is its smallest doc_id, null only if all its ids are; an empty table gives an empty result; other columns are
never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SEED, BITS = 42, 64
TILE, CROWD = 512, 16_384
#: Fingerprints of a bucket that are aimed at, if bits were even.
BUCKET = 1024
#: Shingles that are counted at once.
STRIDE = 1 << 16


def shingles(text: bytes, words: int) -> np.ndarray:
    """Hashes of the shingles of a text in UTF-8, in order, repeats included."""
    parts = text.lower().split()  # of bytes: lower-cases A-Z and splits at the six ASCII spaces only
    if not parts:
        return np.zeros(0, "<u8")
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    of = xxhash.xxh64_intdigest
    return np.array([of(line[a:b], SEED) for a, b in spans], dtype="<u8")


def fingerprint(text: bytes, words: int) -> int:
    """SimHash of a text in UTF-8: a bit is set if it is in more than half of the shingles' hashes."""
    hashes = shingles(text, words)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), STRIDE):
        counts += np.unpackbits(hashes[at : at + STRIDE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("key"), text.cast("binary").alias("text"))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, key (of the text) and fp of each of docs(doc_id, text): a long that holds the unsigned bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                fps = np.array([fingerprint(t or b"", words) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(fps.view(np.int64))], names=["doc_id", "key", "fp"])

    return common.map_arrow(_texts(docs), run, f"{common.numbered_types(docs, 'doc_id')}, key bigint, fp bigint")


def _division(n: int, radius: int) -> tuple[int, int]:
    """Blocks of bits, and how many of them have to agree, so that even bits would leave BUCKET of n in a bucket."""
    for agree in range(1, BITS):
        blocks = radius + agree
        if n / 2.0 ** (BITS * agree // blocks) <= BUCKET:
            return blocks, agree
    return BITS, BITS - radius


def _masks(blocks: int, agree: int) -> list[int]:
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    own = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(own, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the fingerprints (n x lanes, unsigned, distinct) within radius of each other, as index pairs."""
    pop = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
    order = np.argsort(pop, kind="stable")
    x, pop = np.ascontiguousarray(fps[order].T), pop[order]
    n = len(pop)
    label = np.arange(n)
    for a in range(0, n, TILE):
        top = pop[min(a + TILE, n) - 1]
        for b in range(a, n, TILE):
            if pop[b] - top > radius:  # and so for all tiles after it
                break
            apart = np.bitwise_count(x[0, a : a + TILE, None] ^ x[0, None, b : b + TILE])
            if len(x) > 1:
                apart = apart.astype(np.uint16)
                for lane in x[1:]:
                    apart += np.bitwise_count(lane[a : a + TILE, None] ^ lane[None, b : b + TILE])
            i, j = np.nonzero(apart <= radius)
            i, j = i + a, j + b
            new = label[i] != label[j]
            if new.any():
                label = _merged(label, i[new], j[new])
    away = np.nonzero(label != np.arange(n))[0]
    return order[away], order[label[away]]


def _merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label (each entry the smallest place of its component) after linking the places i and j."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _links(keyed: DataFrame, radius: int) -> DataFrame:
    """u, v: fingerprints of keyed(table, key, fp) that are linked within a bucket; as many rows as bucket entries at most."""
    kind = dict(keyed.dtypes)["fp"]
    crowds = keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD)
    crowds = common.materialise(crowds.select(F.col("table").alias("_table"), F.col("key").alias("_key"), F.ceil(F.col("n") / CROWD).cast("int").alias("parts")), "simhash-crowds")
    if crowds.isEmpty():
        units = keyed.select("table", "key", F.lit(0).alias("a"), F.lit(0).alias("b"), "fp")
    else:
        own = F.pmod(F.xxhash64("fp"), F.coalesce(F.col("parts"), F.lit(1))).cast("int")
        dealt = keyed.join(crowds, (F.col("table") == F.col("_table")) & (F.col("key") == F.col("_key")), "left").withColumn("own", own)
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
        units = dealt.select("table", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    keys = ["table", "key", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []

        def close() -> pa.RecordBatch | None:
            x = np.concatenate(held) if held else np.zeros((0, 1), np.uint64)
            if len(x) < 2:
                return None
            pairs = forest(x, radius)
            if kind == "bigint":
                ends = [pa.array(x[k, 0].view(np.int64)) for k in pairs]
            else:
                ends = [pa.array([r.tobytes() for r in x[k]], pa.binary()) for k in pairs]
            return pa.RecordBatch.from_arrays(ends, names=["u", "v"]) if len(pairs[0]) else None

        def unsigned(column: pa.Array) -> np.ndarray:
            if kind == "bigint":
                return column.to_numpy().view(np.uint64).reshape(-1, 1)
            return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in keys]
            fps = unsigned(batch.column("fp"))
            starts = np.nonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0))[0] + 1
            for s, e in zip([0, *starts.tolist()], [*starts.tolist(), len(fps)], strict=True):
                key = tuple(c[s] for c in columns)
                if key != held_key:
                    if (out := close()) is not None:
                        yield out
                    held_key, held = key, []
                held.append(fps[s:e])
        if (out := close()) is not None:
            yield out

    spread = units.repartition(common.shuffle_partitions(keyed.sparkSession), *keys).sortWithinPartitions(*keys)
    return common.map_arrow(spread, run, f"u {kind}, v {kind}")


def _grouped(prints: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """prints with root, the smallest fp that links(u, v) reach, and component_id, the smallest doc_id."""
    roots = components(links)
    rooted = common.materialise(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = common.materialise(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-least").withColumnRenamed("root", "_root")
    named = common.materialise(rooted.join(least, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "root", "component_id"), "simhash-named")
    return prints.join(named, F.col("fp") == F.col("_fp")).drop("_fp")


def group_near(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, key, fp, root and component_id of each of docs(doc_id, text): all links of 64-bit fingerprints within radius."""
    prints = common.materialise(fingerprints(docs, words), "simhash-prints")
    nodes = common.materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    masks = _masks(*_division(nodes.count(), radius))
    keyed = nodes.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("table", "key"))
    return _grouped(prints, nodes, _links(keyed, radius))


#: Min-hashes of a set, and how many of them one band takes.
HASHES, ROWS = 256, 4
#: Share of pairs at the similarity itself that meet in no band; standard deviations that the radius lies above their mean distance.
BAND_LOSS, SLACK = 5e-6, 5
#: Sets and shingles of a group that are compared in one task; larger groups are cut into parts of so many.
PART_SETS, PART_SHINGLES = 4096, 1 << 21
_XOR, _TIMES = (np.random.default_rng(SEED).integers(0, 1 << 32, (2, HASHES, 1), dtype=np.uint32) | np.array([0, 1], np.uint32).reshape(2, 1, 1))
_MIX = np.random.default_rng(SEED + 1).integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _bands(similarity: float) -> tuple[int, int]:
    """Bands and min-hashes in each, so that all but BAND_LOSS of pairs agree in a whole band, whatever the number of texts."""
    for rows in range(ROWS, 1, -1):
        bands = int(np.ceil(np.log(BAND_LOSS) / np.log1p(-(similarity**rows)))) if similarity < 1 else 1
        if bands * rows <= HASHES:
            return bands, rows
    return HASHES, 1


def _radius(similarity: float) -> int:
    """Bits in which sets of this similarity differ at most, next to always: each differs with a chance of (1 - similarity) / 2."""
    p = (1 - similarity) / 2
    return int(np.ceil(HASHES * p + SLACK * (HASHES * p * (1 - p)) ** 0.5))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least of a set's hashes under each of HASHES orders; two sets have the same one with the chance of their similarity."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(low, ((x[None, at : at + 512] ^ _XOR) * _TIMES).min(axis=1), out=low)
    return low


def _set_id(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key (of the text), node (digest of the set of shingles), n (shingles of the set), fp (a bit of each min-hash) and keys (of
    the bands) of each of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                sets = [np.unique(shingles(t, words)) for t in part.column("text").to_pylist()]
                low = np.array([min_hashes(x) for x in sets], np.uint32)
                on = np.packbits((low * np.uint32(0x9E3779B1)) >> np.uint32(31), axis=1)
                keys = (low[:, : bands * rows].reshape(-1, bands, rows) * _MIX[:rows]).sum(axis=2, dtype=np.uint64).view(np.int64)
                held = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
                columns = [pa.array([_set_id(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in on], pa.binary()), held]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), *columns], names=["doc_id", "key", "node", "n", "fp", "keys"])

    return common.map_arrow(_texts(docs), run, f"{common.numbered_types(docs, 'doc_id')}, key bigint, node binary, n bigint, fp binary, keys array<bigint>")


def similar_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets (sorted hashes) whose Jaccard similarity, counted out, is no less, as index pairs."""
    size = np.array([len(x) for x in sets], np.int64)
    ids = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)[1].astype(np.int32)
    own = np.split(ids, np.cumsum(size)[:-1])
    on = np.zeros(len(ids), bool)
    found = []
    rest = np.nonzero(size)[0]
    flat, wide = np.concatenate([ids[:0], *(own[i] for i in rest)]), rest  # what is compared: the sets of rest, and some that have gone
    stack: list[int] = []
    while len(rest):
        if not stack:
            stack.append(int(rest[0]))
            rest = rest[1:]
        at = stack.pop()
        if len(rest) < 0.7 * len(wide):
            flat, wide = np.concatenate([ids[:0], *(own[i] for i in rest)]), rest
        if not len(rest):
            break
        on[own[at]] = True
        both = np.add.reduceat(on[flat], np.cumsum(size[wide]) - size[wide], dtype=np.int64)
        on[own[at]] = False
        near = wide[both / (size[at] + size[wide] - both) >= similarity]
        near = near[np.isin(near, rest, assume_unique=True)]
        if len(near):
            found += [(at, int(i)) for i in near]
            stack += near.tolist()
            rest = rest[~np.isin(rest, near, assume_unique=True)]
    return found


def _confirmed(docs: DataFrame, wanted: DataFrame, words: int, similarity: float) -> DataFrame:
    """u, v: links by exact similarity between sets of one group, for wanted(doc_id, key, group, parts), a document of each set. Every
    pair of sets of a group is in one task at least; a task gives a spanning forest."""
    spark = docs.sparkSession
    asked = wanted.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "group", "parts")
    texts = _texts(docs).join(asked, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key"))).select("group", "parts", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                sets = [np.unique(shingles(t, words)) for t in part.column("text").to_pylist()]
                columns = [pa.array([_set_id(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("group"), part.column("parts"), *columns], names=["group", "parts", "node", "grams"])

    held = common.map_arrow(texts, read, "group binary, parts int, node binary, grams binary")
    dealt = held.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["group", "a", "b"]
    units = dealt.select("group", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "grams")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, sets = None, {}

        def close() -> pa.RecordBatch:
            nodes = list(sets)
            pairs = similar_forest([np.frombuffer(x, "<u8") for x in sets.values()], similarity) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[p[k]] for p in pairs], pa.binary()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            for group, a, b, node, grams in zip(*(batch.column(c).to_pylist() for c in [*keys, "node", "grams"]), strict=True):
                if (key := (group, a, b)) != held_key:
                    yield close()
                    held_key, sets = key, {}
                sets[node] = grams
        yield close()

    spread = units.repartition(common.shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    return common.map_arrow(spread, compare, "u binary, v binary")


def group_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, key, fp (digest of the set of shingles), root and component_id of each of docs(doc_id, text): links are pairs whose sets of
    shingles have this Jaccard similarity or more.

    Min-hashes only find candidates: a pair meets if it agrees in one of several bands, and is a candidate if no more than a radius
    of the bits of whole sketches differ. Of a group that candidates connect, all pairs are then compared by their shingles."""
    prints = common.materialise(sketches(docs, words, *_bands(similarity)), "similar-prints")
    none = F.col("doc_id").isNull().alias("none")
    sets = prints.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min(F.struct(none, "doc_id", "key")).alias("first"), *(F.first(c).alias(c) for c in ("n", "fp", "keys")))
    sets = common.materialise(sets, "similar-sets")
    near = components(_links(sets.select("fp", F.posexplode("keys").alias("table", "key")), _radius(similarity)))
    near = near.select(F.col("node").alias("_fp"), "root")
    grouped = sets.select("node", "n", "fp", "first").join(near, F.col("fp") == F.col("_fp"), "left").select("n", "first", F.coalesce("root", "fp").alias("group"))
    grouped = common.materialise(grouped, "similar-groups")
    many = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).where("m > 1")
    parts = F.greatest(F.ceil(F.col("m") / PART_SETS), F.ceil(F.col("total") / PART_SHINGLES)).cast("int")
    many = common.materialise(many.select(F.col("group").alias("_group"), parts.alias("parts")), "similar-many")
    wanted = grouped.join(many, F.col("group") == F.col("_group")).select("first.doc_id", "first.key", "group", "parts")
    links = _confirmed(docs, common.materialise(wanted, "similar-wanted"), words, similarity)
    return _grouped(prints.select("doc_id", "key", F.col("node").alias("fp")), sets.select(F.col("node").alias("fp"), "least_id"), links)


def drop_near(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each group of similar texts, with all its columns: that with the smallest doc_id and key (null last)."""
    groups = common.materialise(group_similar(docs, words, similarity), "simhash-groups")
    pairs = common.materialise(groups.groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("repeats")), "simhash-pairs")
    first = pairs.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    first = common.materialise(first.select("root", "first.doc_id", "first.key"), "simhash-first")
    first = first.select(F.col("root").alias("_root"), F.col("doc_id").alias("_doc"), F.col("key").alias("_key"))
    stays = pairs.join(first, F.col("root") == F.col("_root"))
    kept = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key"))
    verdicts = common.materialise(stays.select("doc_id", "key", kept.alias("kept"), "repeats"), "simhash-verdicts")
    return common.keep_one(docs, verdicts, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
