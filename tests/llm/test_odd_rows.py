"""Every operator gives a row for each odd row, and nothing for an empty table."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fathomline.llm import cdc, common, exact, mixing, piece, quality, queries, simhash, suffix, tokencount, toxicity, urlfilter

#: Names that operators use within.
CLASHING = ("key", "fp", "digest", "size", "lo", "hi", "n", "kept", "copies", "target", "part", "root", "half", "toxic", "host", "path", "rule", "_doc", "_key", "_row", "_own_key", "_id", "_times", "_text", "_words", "_nth", "held_out", "spans", "component_id", "source_size")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with names that operators use within."""
    long_word, line = "x" * 70_000, "one line that stands here again and again\n"
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "short", "b"), (5, "short", "b"), (5, "short", "b"), (None, "short", "b"), (None, None, None), (6, long_word, "c"),
        (7, line * 300, "c"), (8, line * 300, "c"), (9, "SHORT", "b"), (10, "é ß 漢字 \x00 ▁ 😀 " * 40, "c"), (11, "word " * 5000, None), (12, "\n\n\n", "a"), (-5, "a b c d e f g h i j k", "a"),
    ]
    more = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["z"] * len(CLASHING)) for r in rows], f"doc_id long, text string, source string, {more}")


@pytest.fixture(scope="module")
def nested(spark):
    """Repeated rows whose other columns differ, and are of types that have no order."""
    rows = [(i % 5, ["some text", "Some text", None, "x y z"][i % 4], "s", {"k": i % 7}, {"m": {"a": i}, "v": [i]}, [{"b": i % 3}]) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>, s struct<m:map<string,int>,v:array<int>>, a array<map<string,int>>")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def _labels(docs):
    return docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))


OPERATORS = {
    "mix": mixing.mix,
    "urls": lambda d: urlfilter.judge_urls(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), "*"), urlfilter.rules_frame(d.sparkSession, queries.URL_RULES)),
    "tokens": lambda d: tokencount.count_tokens(queries.standard_edits(d), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    "chunks": cdc.dedup_chunks,
    "quality": quality.judge_quality,
    "lines": quality.strip_lines,
    "suffixes": suffix.remove_repeats,
    "simhash": simhash.group_near,
    "similar": simhash.group_similar,
    "exact": exact.dedup_exact,
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, _labels(d))),
    "pieces": lambda d: piece.digest_pieces(d, queries.piece_model()),
}
FILTERS = {
    "exact": exact.drop_exact,
    "near": simhash.drop_near,
    "toxic": lambda d: toxicity.drop_toxic(d, toxicity.fit(d, _labels(d))),
    "mix": mixing.emit_mix,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_each(odd, none, name):
    out = OPERATORS[name](odd)
    assert out.count() == odd.count()
    empty = OPERATORS[name](none)
    assert empty.count() == 0 and empty.columns == out.columns


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(odd, none, name):
    out = FILTERS[name](odd)
    assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
    assert out.count() <= 3 * odd.count()
    assert FILTERS[name](none).count() == 0


@pytest.mark.parametrize("name", FILTERS)
def test_filters_take_columns_without_order(nested, name):
    out, again = FILTERS[name](nested).collect(), FILTERS[name](nested.repartition(3)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert {str(r) for r in out} <= {str(r) for r in nested.collect()}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_pass_over_columns_without_order(nested, name):
    assert OPERATORS[name](nested).count() == nested.count()


def test_of_repeated_rows_one_stays(odd):
    kept = exact.drop_exact(odd)
    texts = [(r["text"] or "").lower() for r in kept.collect()]
    assert len(texts) == len(set(texts))
    assert kept.where("lower(text) = 'short'").first()["doc_id"] == 9
    near = simhash.drop_near(odd.where("lower(text) = 'short'")).collect()
    assert len(near) == 1 and near[0]["doc_id"] == 4


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        named = None

        def get(self, name, default=None):
            return self.named or default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "yarn"})()

    with pytest.raises(ValueError):
        common.shared_dir(Session())
    Conf.named = "hdfs://a/shared/"
    assert common.shared_dir(Session()) == "hdfs://a/shared/fathomline"


def test_discarded_tables_are_gone(spark):
    kept, gone = (common.materialise(spark.range(3), "discard") for _ in range(2))
    path = common._path_of[gone]
    common.discard(gone)
    files, there = common.hadoop_path(spark.sparkContext, path)
    assert not files.exists(there) and path not in common._written and kept.count() == 3
