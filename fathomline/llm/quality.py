"""Quality rules: measures of a document's words and lines, and lines that too many documents of a host share.

In DataFrame operations only. One pass over the texts measures each document and hashes its normalised lines; the number
of distinct documents for each host and line is a partial aggregate; lines above the limit are joined back and a document
that loses too many of its words with them is rejected (judge_quality); strip_lines removes the lines themselves. The column
`source` names the host.

Defined results: null text counts as empty; a document without words has measures 0 and fails the base rules; texts are
taken whole, of any length; a null source is a host of its own; rows that agree in doc_id, source and text get equal
verdicts, and each counts as a document where lines are counted; an empty table gives an empty result; other columns are
never looked at. 5-word windows are compared by a 64-bit hash within their document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A document fails the base rules with fewer words, or if a larger share of them stands in repeated windows.
LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
#: A line is boilerplate if more documents of its host have it than this number and this share of the host's documents.
LINE_DOCS, LINE_SHARE = 20, 0.01
#: A document is rejected if less than this share of its words is left.
LEAST_LEFT = 0.5
#: The characters that the contract counts as symbols.
SYMBOLS = "#*$%&|<>"


def _windows(words: Column) -> Column:
    """Hash of the words i to i + 4 for each i."""
    at = lambda i, k: F.get(words, i + k)
    return F.when(F.size(words) < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW))))
    )


def _covered(ordered: Column) -> Column:
    """From (hash, place) in order: words under the places whose hash has a neighbour that is equal."""
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    found = F.filter(
        F.transform(ordered, lambda x, j: F.struct(x["i"].alias("i"), (same(x, F.get(F.col("_ordered"), j - 1)) | same(x, F.get(F.col("_ordered"), j + 1))).alias("twice"))),
        lambda x: x["twice"],
    )
    places = F.array_sort(F.transform(found, lambda x: x["i"]))
    sums = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("long").alias("n"), i.alias("last")),
    )
    return sums["n"]


def measure(docs: DataFrame) -> DataFrame:
    """One row for each of docs(doc_id, text, source): its key, the base measures, hashes and word counts of its lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "source", text.alias("_text"))
    words = F.filter(F.split("_text", common.SPACES + "+"), lambda w: w != "")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(common.NOT_SPACES))
    base = base.select("*", F.xxhash64("_text").alias("text_key"), words.alias("_words"), lines.alias("_lines"))
    base = base.select("*", _windows(F.col("_words")).alias("_windows"))
    base = base.withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    base = base.withColumn("_ordered", F.when(F.col("_repeats"), F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    bare = common.without(F.col("_text"), " \t\n\x0b\x0c\r")
    normal = F.transform("_lines", lambda x: F.struct(F.xxhash64(normal_line(x)).alias("hash"), F.regexp_count(x, F.lit(common.NOT_SPACES + "+")).alias("words")))
    return base.select(
        "doc_id",
        "source",
        "text_key",
        F.size("_words").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(bare) - F.length(common.without(bare, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_repeats"), _covered(F.col("_ordered"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        normal.alias("lines"),
    )


def normal_line(line: Column) -> Column:
    """A-Z lower-cased, outer space dropped, inner space as one blank."""
    return F.trim(F.regexp_replace(common.ascii_lower(line), common.SPACES + "+", " "))


def common_lines(measured: DataFrame, line_docs: int, line_share: float) -> DataFrame:
    """_source, _hash: the lines of measured(source, lines) that more documents of their host have than the limits allow."""
    # Once a document and line, whatever the order of its lines: array_distinct works within the row.
    seen = measured.select("source", F.explode(F.array_distinct(F.transform("lines", lambda x: x["hash"]))).alias("hash")).groupBy("source", "hash").agg(F.count(F.lit(1)).alias("n_docs"))
    hosts = measured.groupBy("source").agg(F.count(F.lit(1)).alias("host_docs")).withColumnRenamed("source", "_host")
    over = seen.where(F.col("n_docs") > line_docs).join(hosts, F.col("source").eqNullSafe(F.col("_host"))).where(F.col("n_docs") > F.col("host_docs") * line_share)
    return common.materialise(over.select(F.col("source").alias("_source"), F.col("hash").alias("_hash")), "quality-lines")


def strip_lines(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """doc_id, source and kept_text, the text without its lines above the limit (null counts as empty), for each of docs(doc_id,
    text, source). Lines that stay keep their order and their line ends."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "source", text.alias("_text"), F.xxhash64(text).alias("text_key"))
    hashed = lambda x: F.when(x.rlike(common.NOT_SPACES), F.xxhash64(normal_line(x)))
    lines = F.transform(F.filter(F.split("_text", "\n"), lambda x: x.rlike(common.NOT_SPACES)), lambda x: F.struct(hashed(x).alias("hash")))
    measured = common.materialise(base.select("doc_id", "source", "text_key", lines.alias("lines")), "quality-hashes")
    over = common_lines(measured, line_docs, line_share)
    own = measured.select("doc_id", "source", "text_key", F.explode(F.array_distinct("lines")).alias("line")).select("doc_id", "source", "text_key", "line.hash")
    hits = own.join(over, (F.col("hash") == F.col("_hash")) & F.col("source").eqNullSafe(F.col("_source")))
    # A text's own lines; rows that repeat a document have the same ones.
    gone = hits.groupBy("doc_id", "source", "text_key").agg(F.collect_set("hash").alias("_gone")).select(F.col("doc_id").alias("_doc"), F.col("source").alias("_from"), F.col("text_key").alias("_key"), "_gone")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("source").eqNullSafe(F.col("_from")) & (F.col("text_key") == F.col("_key"))
    left = F.filter(F.split("_text", "\n"), lambda x: ~F.coalesce(F.array_contains(F.col("_gone"), hashed(x)), F.lit(False)))
    kept = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(left, "\n"))
    return base.join(common.materialise(gone, "quality-gone"), same, "left").select("doc_id", "source", kept.alias("kept_text"))


def judge_quality(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """The measures of each of docs, base_failed, n_removed_words (in lines above the limit) and kept."""
    measured = common.materialise(measure(docs), "quality-measures")
    per_doc = measured.select("doc_id", "source", "text_key", F.explode("lines").alias("line")).select("doc_id", "source", "text_key", "line.hash", "line.words")
    over = common_lines(measured, line_docs, line_share)
    lost = (
        per_doc.join(over, (F.col("hash") == F.col("_hash")) & F.col("source").eqNullSafe(F.col("_source")))
        .groupBy("doc_id", "source", "text_key")
        .agg(F.sum("words").alias("_lost"), F.count(F.lit(1)).alias("_n"))
        .select(F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("text_key").alias("_key"), "_lost")
    )
    # Equal rows add up in `lost`; each of them lost its share.
    copies = measured.groupBy("doc_id", "source", "text_key").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select(F.col("doc_id").alias("_doc2"), F.col("source").alias("_source2"), F.col("text_key").alias("_key2"), "_rows")
    lost = lost.join(copies, F.col("_doc").eqNullSafe(F.col("_doc2")) & F.col("_source").eqNullSafe(F.col("_source2")) & (F.col("_key") == F.col("_key2")), "left")
    lost = lost.select("_doc", "_source", "_key", (F.col("_lost") / F.coalesce("_rows", F.lit(1))).cast("long").alias("_lost"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("text_key") == F.col("_key"))
    removed = F.coalesce("_lost", F.lit(0)).cast("long")
    failed = (F.col("n_words") < LEAST_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED) * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_removed_words") < F.col("n_words") * least_left
    return (
        measured.drop("lines")
        .join(lost, same, "left")
        .withColumn("n_removed_words", removed)
        .withColumn("base_failed", failed)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"))
    )
