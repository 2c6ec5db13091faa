from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fathomline.sources import files


def test_pages(spark, tmp_path):
    path = tmp_path / "pages.jsonl"
    good = {"url": "http://a/1", "title": "t", "text": "x", "status": 200, "depth": 1}
    path.write_text("\n".join([json.dumps(good), "", json.dumps(good | {"status": 404}), json.dumps(good | {"url": "http://a/2"})]))
    pages = files.read_pages(spark, str(path))
    assert [r["doc_id"] for r in files.number_pages(pages).orderBy("url").collect()] == [1, 2]
    path.write_text(path.read_text() + "\n{broken")
    with pytest.raises(Exception):
        files.read_pages(spark, str(path)).collect()
    rows, counts = files.read_pages_tolerant(spark, str(path))
    assert rows.count() == 3 and counts.first().asDict() == {"lines_read": 4, "json_errors": 1}


def test_edges_with_commas(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text("src_url,dst_url\n http://a/1 ,http://b\nhttp://a/x,y,http://b\n,http://c\n")
    rows = {tuple(r) for r in files.read_edges(spark, str(path)).collect()}
    assert ("http://a/1", "http://b") in rows and ("http://a/x", "y") in rows
    assert files.read_edges(spark, str(path), drop_empty=True).count() == 2


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("u", "t")], "url string, title string")
    edges = spark.createDataFrame([("a", "b")], files.EDGES)
    for _ in range(2):
        files.append_pages(pages, f"{tmp_path}/p")
        files.append_edges(edges, f"{tmp_path}/e")
        files.append_edges(edges.limit(0), f"{tmp_path}/e")
    assert files.read_edges(spark, f"{tmp_path}/e").count() == 2 and spark.read.json(f"{tmp_path}/p").count() == 2
    stats = files.crawl_stats(pages, edges).first()
    assert (stats["total_pages"], stats["total_edges"]) == (1, 1)


def test_benchmark(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps([{"query_id": f"Q{i}", "query_text": "t", "topic": "x", "judged_subset": i < 2, "demo_candidate": i < 3} for i in range(4)], indent=1))
    q = files.read_benchmark(spark, str(path), 4)
    assert files.judged_queries(q).count() == 2 and files.demo_queries(q).count() == 3
    with pytest.raises(ValueError):
        files.read_benchmark(spark, str(path), 50)


def test_external_results_skip_rows_without_title_or_link(spark):
    rows = spark.createDataFrame([("g", 1, "a", "http://a", None, None, "s"), ("g", 2, "", "http://b", None, None, None), ("g", 3, "c", None, None, None, None), ("g", 4, "d", "http://d", "d.com", "x", None)], "engine string, position long, title string, link string, displayed_link string, snippet string, source string")
    got = [tuple(r) for r in files.normalise_external(rows).orderBy("rank").collect()]
    assert got == [("g", 1, "a", "http://a", "s", ""), ("g", 2, "d", "http://d", "d.com", "x")]


def test_last_url_wins(spark):
    df = spark.createDataFrame([("u", 1), ("u", 3), ("v", 2)], "url string, doc_id long")
    assert {tuple(r) for r in files.last_doc_of_url(df).collect()} == {("u", 3), ("v", 2)}


def test_reports(tmp_path):
    whole = files.write_reports(tmp_path / "r", [("one", "1"), ("two", "2")])
    assert "== two ==" in whole.read_text() and (tmp_path / "r" / "one.txt").read_text() == "1"
