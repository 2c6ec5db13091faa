"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A document's expected copies are its source's target over its source's size. Documents of a source stand in the order of
(size, doc_id, text digest); the running sum of expected copies, shifted by one offset for the source, crosses an integer as often as
the document is emitted. Between two crossings sizes only grow, so the words taken from a source differ from its target by less
than the size of its largest document.

The running sum needs no task that holds a source: rows are range-partitioned, and a source's rows before a partition
are counted in a table of at most partitions + sources rows. Targets need an order of all sources: they are numbered and filled
up in two passes over ranges of sources, with a row for each range on the driver.

Defined results: null or empty text has size 0; a null source is a source of its own and comes last; a source without
words has target 0 and is taken 0 times; ties in size go by doc_id (null first), rows that repeat are rows like any other;
an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The weights that sources take in turn, and how often the mix may use a source at most.
WEIGHTS = (1, 2, 3)
CAP = 3


def _running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], tag: str) -> DataFrame:
    """df with the running sum up to and with each row, in a total order, of every column in sums. Rows are dealt by
    ranges of the order; what comes before a range is the sum of the ranges before it, of which the driver holds a row each."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(common.shuffle_partitions(spark), *order).withColumn("_range", F.spark_partition_id())
    ranged = common.materialise(ranged, tag)
    blocks = ranged.groupBy("_range").agg(*(F.sum(c).alias(n) for n, c in sums.items())).orderBy("_range").collect()
    before, rows = dict.fromkeys(sums, 0.0), []
    for block in blocks:
        rows.append((block["_range"], *before.values()))
        before = {n: before[n] + float(block[n]) for n in sums}
    # Literals: a row for each range, no more than there are shuffle partitions.
    starts = F.create_map(*(x for r in rows for x in (F.lit(r[0]), F.array(*(F.lit(v) for v in r[1:]))))) if rows else None
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged
    for k, (name, column) in enumerate(sums.items()):
        start = F.get(F.element_at(starts, F.col("_range")), F.lit(k)) if rows else F.lit(0.0)
        out = out.withColumn(name, F.sum(column.cast("double")).over(own) + start)
    return out.drop("_range")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """For sizes(source, source_size): target words of each source, by weight, none above cap times its size.

    The level at which sources fill up is found in one pass: in the order of cap / weight, a source is capped if the level
    of those not yet capped lies above its own. Sums are of whole numbers below 2 ** 53, so any order of adding gives the same."""
    by_name = _running(sizes, [F.col("source").asc_nulls_last()], {"nth": F.lit(1)}, "mix-sources")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("nth").cast("long") - 1) % len(weights) + 1).cast("int"))
    weighed = by_name.withColumn("weight", weight).drop("nth").withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = [F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()]
    filled = _running(weighed, order, {"most_upto": F.col("most"), "weight_upto": F.col("weight")}, "mix-levels")
    whole = filled.agg(F.sum("source_size").cast("double").alias("words"), F.sum("weight").alias("weight")).first()
    level = (F.lit(whole["words"]) - (F.col("most_upto") - F.col("most"))) / (F.lit(whole["weight"]) - (F.col("weight_upto") - F.col("weight")))
    levels = filled.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("most"))
    final = levels.agg(F.max(F.when(~F.col("full"), F.col("level"))).alias("level")).first()["level"]
    return levels.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * F.lit(final).cast("double"))).select("source", "source_size", "target")


def offset_of(source: Column, seed: int) -> Column:
    """The one random offset of a source: a multiple of 2 ** -20 in [0, 1), fixed by seed and name."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.md5(name), 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))


def _mixed(docs: DataFrame, mark: Column, weights: Sequence[int], cap: int, seed: int) -> DataFrame:
    """mix(), with a mark that tells apart rows of equal doc_id, source and text."""
    spark = docs.sparkSession
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_first(), F.col("text_key"), F.col("mark")]
    sized = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), mark.alias("mark"), common.word_count(F.col("text")).alias("size"), "source")
    ranged = sized.repartitionByRange(common.shuffle_partitions(spark), *order)
    ranged = common.materialise(ranged.withColumn("part", F.spark_partition_id()), "mix-ranged")
    blocks = ranged.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    blocks = common.materialise(blocks, "mix-blocks")
    goals = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select(F.col("source").alias("_source"), F.col("part").alias("_part"), "start")
    goals = goals.withColumnRenamed("source", "_source")
    starts = starts.join(goals.withColumnRenamed("_source", "_goal"), F.col("_source").eqNullSafe(F.col("_goal")))
    place = Window.partitionBy("source", "part").orderBy("size", F.col("doc_id").asc_nulls_first(), "text_key", "mark")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    upto = F.col("start") + F.col("nth")
    crossed = F.floor(F.col("rate") * upto + F.col("offset")) - F.floor(F.col("rate") * (upto - 1) + F.col("offset"))
    return (
        ranged.withColumn("nth", F.row_number().over(place))
        .join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
        .withColumn("rate", rate)
        .withColumn("offset", offset_of(F.col("source"), seed))
        .withColumn("copies", crossed.cast("int"))
        .select("doc_id", "text_key", "mark", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = 7) -> DataFrame:
    """For each of docs(doc_id, text, source): doc_id, text_key, size, source, source_size, target, copies, taken."""
    return _mixed(docs, F.lit(0), weights, cap, seed).drop("mark")


def emit_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = 7) -> DataFrame:
    """The rows of the mix: each of docs as often as mix() takes it, with all its columns.

    Rows that repeat doc_id, source and text stand in the order of a hash of all their columns, and each is taken on its own;
    the copies of rows that agree in every column are added up."""
    keys = ["doc_id", "source", "text_key", "mark"]
    copies = _mixed(docs, common.row_hash(docs), weights, cap, seed)
    copies = copies.groupBy(*keys).agg(F.sum("copies").cast("int").alias("_times"), F.count(F.lit(1)).alias("_rows"))
    copies = copies.select(*(F.col(k).alias(f"_{k}") for k in keys), "_times", "_rows")
    text_key = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_own_key")
    marked = docs.select(common.whole_row(docs).alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_from"), text_key, common.row_hash(docs).alias("_own_mark"))
    same = F.col("_id").eqNullSafe(F.col("_doc_id")) & F.col("_from").eqNullSafe(F.col("_source")) & (F.col("_own_key") == F.col("_text_key")) & (F.col("_own_mark") == F.col("_mark"))
    joined = marked.join(copies.where("_times > 0"), same)
    single = joined.where("_rows = 1").select("_row", "_times")
    # These agree in every column, so any of them stands for all.
    several = joined.where("_rows > 1").groupBy("_doc_id", "_source", "_text_key", "_mark").agg(F.first("_row").alias("_row"), F.first("_times").alias("_times")).select("_row", "_times")
    return single.unionByName(several).withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
