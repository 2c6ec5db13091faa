"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import pytest
from conftest import SMALL, rows_of

from fathomline import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SMALL).toPandas()
    theirs = duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


@pytest.mark.parametrize("name", ["stem_terms", "bm25_stemmed", "pagerank_converged", "hits_topk", "html_text", "url_normalize", "reject_reasons", "greedy_dedup", "politeness", "spell_correct", "crawl_rounds", "agglomerative_labels"])
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]
