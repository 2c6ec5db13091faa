from __future__ import annotations

import http.server
import json
import threading
import time
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline import catalog, shared
from fathomline.operators import rank
from fathomline.plans import clusters, engine, experiment, reports, service
from fathomline.sources import files, search
from fathomline.streaming import crawl

TOPICS = {"volcano": "lava magma eruption crater volcano ash cone the and earth", "quake": "fault seismic wave earthquake rupture plate the and earth", "fossil": "bone shell fossil dinosaur layer amber the and earth"}


@pytest.fixture(scope="module")
def topics(spark):
    """18 pages on three topics, each linked to the next."""
    rows = []
    for t, (topic, words) in enumerate(TOPICS.items()):
        for i in range(6):
            rows.append((t * 6 + i + 1, f"https://{topic}.example.org/p{i}", f"{topic} {i}", f"{words} number{i} {topic}s with this from that {words.split()[i]} " * 4, "text/html; charset=utf-8", 200, 1))
    pages = spark.createDataFrame(rows, "doc_id long, url string, title string, text string, content_type string, status int, depth int")
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 18)], "src long, dst long")
    return pages, pages.select(F.col("doc_id").alias("id")), edges


def queries(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, query string")


def test_engine(spark, topics, tmp_path):
    e = engine.SearchEngine.build(*topics, rounds=5)
    e.save(f"{tmp_path}/e")
    e = engine.SearchEngine.load(spark, f"{tmp_path}/e")
    asked = queries(spark, "volcano lava", "seismic faults")
    for method in engine.METHODS:
        found = e.search(asked, method, 3).collect()
        assert {r["query_id"] for r in found} == {0, 1}, method
    first = e.search(asked, "bm25", 1).where("query_id = 1").first()
    assert first["url"].startswith("https://quake")
    for method in engine.EXPANSIONS:
        e.expand(asked, method).collect()
    assert e.compare(asked, ("bm25", "tfidf"), 2).groupBy("method").count().count() == 2
    answer = e.answer("volcano lava", "combined", 2)
    assert answer["metadata"]["total_results"] == 2 and answer["results"][0]["rank"] == 1
    for bad in (("", "hits", 5), ("x", "bm25", 5), ("x", "hits", 0), ("x", "hits", 101)):
        with pytest.raises(ValueError):
            e.answer(*bad)


def test_served_expansion(spark, topics):
    """Words are corrected, expanded and shown in natural forms; what finds nothing stays as corrected stems."""
    extra = spark.createDataFrame([(100 + i, f"https://x.example.org/{i}", "", f"filler{chr(97 + i % 26)} words", "", 200, 1) for i in range(130)], topics[0].schema)
    pages = topics[0].unionByName(extra)
    e = engine.SearchEngine.build(pages, pages.select(F.col("doc_id").alias("id")), topics[2], rounds=5)
    asked = queries(spark, "volcanno lavva", "qqqq zzzzz", "", "the eruptions")
    for method in engine.EXPANSIONS:
        got = {r["query_id"]: r["query"] for r in e.expanded(asked, method).collect()}
        shown = got[0].split()
        assert shown[:2] == ["volcano", "lava"] and len(shown) <= 7 and len(set(shown)) == len(shown), method
        assert got[2] == "" and (got[1] == "qqqq zzzzz" or method == "rocchio")
    assert {"magma", "crater", "ash", "cone", "eruption"} & set(e.expanded(asked, "association").where("query_id = 0").first()["query"].split())
    answer = e.answer_expanded("volcanno", "association", "tfidf", 3)
    assert answer["original_query"] == "volcanno" and answer["expanded_query"].startswith("volcano") and answer["metadata"]["total_results"] == 3
    moved = e.answer_expanded("lava", "rocchio", "tfidf", 3, relevant=[1, 2], irrelevant=[13])
    assert moved["expanded_query"].split()[0] == "lava" and len(moved["expanded_query"].split()) > 1


def test_panels(spark, topics):
    e = engine.SearchEngine.build(*topics, rounds=5)
    external = spark.createDataFrame([("google", 0, 1, "t", "u")], "engine string, query_id int, rank int, title string, url string")
    panels = service.fan_out(e, queries(spark, "volcano lava", "fossil"), k=3, external=external)
    assert {r["panel"] for r in panels.select("panel").distinct().collect()} == {*engine.SERVED, "expanded", "google"}
    assert panels.where("rank > 3").isEmpty()


def test_reports(spark, topics, tmp_path):
    e = engine.SearchEngine.build(*topics, rounds=5)
    asked = queries(spark, "volcano lava", "nothing known")
    for method in reports.METHODS:
        whole = files.write_reports(tmp_path / method, reports.report_sections(e, asked, method))
        assert "Query: volcano lava" in whole.read_text() and "No local documents" in whole.read_text()
    rows = reports.before_and_after(e, asked, ("association",), "bm25", 5).collect()
    assert rows and all(r["kept"] + r["new"] <= 5 for r in rows)


def test_command_line(spark, topics, tmp_path, capsys):
    from fathomline.__main__ import main

    topics[0].drop("doc_id").withColumn("crawled_at", F.lit("x")).coalesce(1).write.json(f"{tmp_path}/pages")
    urls = topics[0].select("doc_id", "url")
    links = topics[2].join(urls.withColumnRenamed("doc_id", "src").withColumnRenamed("url", "src_url"), "src").join(urls.withColumnRenamed("doc_id", "dst").withColumnRenamed("url", "dst_url"), "dst")
    links.select("src_url", "dst_url").write.option("header", True).csv(f"{tmp_path}/edges")
    main(["build", "--pages", f"{tmp_path}/pages", "--edges", f"{tmp_path}/edges", "--out", f"{tmp_path}/out"])
    main(["search", "--index", f"{tmp_path}/out", "--method", "tfidf_pagerank", "-k", "2", "volcano", "lava"])
    main(["search", "--index", f"{tmp_path}/out", "--expand", "association", "--method", "bm25", "fossil"])
    printed = capsys.readouterr().out
    assert "https://volcano" in printed and "https://fossil" in printed


def test_build_and_experiment(spark, topics, tmp_path):
    config = clusters.Config(min_df=1, max_df=0.95, max_features=256, components=8, sample_cap=18, domain_cap=6, flat_k=(3, 4, 5), merged_k=(3, 4), mini_clusters=6)
    built = clusters.build(topics[0], "b1", config)
    built.save(f"{tmp_path}/b1")
    built = clusters.Build.load(spark, f"{tmp_path}/b1")
    assert built.manifest["corpus"]["records_kept"] == 18
    for method in clusters.CLUSTERINGS:
        assigned, centers, catalog = built.of(method)
        k = built.manifest["selected_k"][method]
        assert assigned.count() == 18 and centers.count() == k and k in (3, 4, 5)
        assert sum(r["size"] for r in catalog.collect()) == 18
    with pytest.raises(ValueError):
        built.of("none")
    e = engine.SearchEngine.build(*topics, rounds=5)
    asked = queries(spark, "volcano lava geology", "fossil bone")
    hits = e.rank(e.terms(asked), "bm25", 6)
    vectors = built.projection.transform(asked.select(F.col("query_id").alias("doc_id"), F.col("query").alias("text"))).withColumnRenamed("doc_id", "query_id")
    reranked, facets = built.rerank(hits, vectors, "flat")
    assert reranked.where("query_id = 0").count() == 6 and reranked.where("cluster_name is null").count() == 0
    assert facets.where("query_id = 0").agg(F.sum("result_count")).first()[0] == 6
    run = experiment.run_experiment(asked.withColumn("topic", F.col("query")), hits, vectors, built)
    assert {r["system"] for r in run.summary.collect()} == {"baseline", *clusters.CLUSTERINGS}
    qrels = spark.createDataFrame([(0, 1, 2), (1, 13, 1)], "query_id int, doc_id long, rel int")
    per_query, means = run.judge(qrels)
    assert per_query.count() == 8 and means.count() == 4
    assert run.template().count() > 0 and run.examples().count() == 2


def test_too_few_records(spark, topics):
    with pytest.raises(ValueError):
        clusters.build(topics[0].where("doc_id < 4"), "b2")


def test_answers_of_services(spark):
    fields = service.answer_fields({"results_path": "data.items", "title": None, "unknown": 1}, url="link")
    assert fields == service.FIELDS | {"results_path": "data.items", "url": "link"}
    body = json.dumps({"data": {"items": [{"link": "HTTP://A.org/x/", "title": "t", "score": "1.5"}, "no", {"rank": 9}]}})
    rows = service.normalise_answers(spark.createDataFrame([(1, body)], "query_id int, body string"), fields).collect()
    assert [r.asDict() for r in rows] == [
        {"query_id": 1, "rank": 1, "title": "t", "url": "HTTP://A.org/x/", "normalized_url": "http://a.org/x", "snippet": "", "score": 1.5},
        {"query_id": 1, "rank": 9, "title": "", "url": "", "normalized_url": "", "snippet": "", "score": 0.0},
    ]
    for bad in ("{}", '{"data": {"items": {}}}', "no json"):
        with pytest.raises(Exception, match="no list at data.items"):
            service.normalise_answers(spark.createDataFrame([(1, bad)], "query_id int, body string"), fields).collect()


def test_a_search_service_is_a_source(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def _answer(self, asked: dict) -> None:
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"results": [{"title": f"{asked['q']} {self.headers['X-Key']}", "url": "http://a/"}] * int(asked["top_k"])}).encode())

        def do_POST(self) -> None:
            self._answer(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))

        def do_GET(self) -> None:
            self._answer(dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query)))

        def log_message(self, *args) -> None:
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    search.register(spark)
    for method in ("POST", "GET"):
        reader = spark.read.format("search_service").option("url", f"http://127.0.0.1:{server.server_port}/").option("queries", json.dumps([[1, "lava"], [2, "ash flow"]]))
        answers = reader.option("query_field", "q").option("top_k", "2").option("http_method", method).option("headers", '{"X-Key": "k"}').load()
        rows = service.normalise_answers(answers).orderBy("query_id", "rank").collect()
        assert [(r["query_id"], r["rank"], r["title"]) for r in rows] == [("1", 1, "lava k"), ("1", 2, "lava k"), ("2", 1, "ash flow k"), ("2", 2, "ash flow k")]
    server.shutdown()
    with pytest.raises(Exception, match="url and queries"):
        spark.read.format("search_service").load().collect()


def test_requests(spark, tmp_path):
    assert service.upstream_error(422, '{"detail": "bad"}') == (422, "bad") and service.upstream_error(500, "<html>") == (502, "<html>")
    assert [q["query_id"] for q in service.demo_list(spark, str(tmp_path / "none.json"))] == ["Q001", "Q009", "Q017", "Q024", "Q033"]
    (tmp_path / "some.json").write_text(json.dumps([{"query_id": "Q2", "query_text": "x", "topic": "t", "judged_subset": True, "demo_candidate": True}, {"query_id": "Q1", "query_text": "y", "topic": "t", "judged_subset": True, "demo_candidate": False}]))
    assert service.demo_list(spark, str(tmp_path / "some.json")) == [{"query_id": "Q2", "query_text": "x", "topic": "t"}]
    latest = service.Latest()
    old, new = latest.ask(), latest.ask()
    assert latest.is_current(new) and not latest.is_current(old)
    assert [service.relevance(r) for r in (0, 1, 2)] == [0, 1, 2] and engine.bounded("external", 20) == 20
    for bad in (lambda: service.relevance(3), lambda: engine.bounded("external", 21), lambda: engine.bounded("clustered", 51)):
        with pytest.raises(ValueError):
            bad()
    (tmp_path / ".env").write_text("# note\nA=1\n B = 'two' \nA=3\nnothing\n")
    assert files.read_env(tmp_path / ".env") == {"A": "1", "B": "two"} and files.read_env(tmp_path / "none") == {}
    assert shared.setting(spark, "port", "8000") == "8000"
    spark.conf.set("spark.fathomline.port", "9")
    assert shared.setting(spark, "port", "8000") == "9"


def test_jobs(tmp_path):
    jobs = service.Jobs(str(tmp_path))
    good, bad = jobs.start(lambda folder: 1)["id"], jobs.start(lambda folder: 1 / 0)["id"]
    assert jobs.futures[good].result() == 1 and jobs.futures[bad].exception() is not None
    assert (jobs.status(good)["status"], jobs.status(bad)["status"], jobs.newest(), jobs.status("none")) == ("completed", "failed", good, None)


def test_politeness(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate((0.0, 0.4, 1.2))], "host long, event_id long, t double").withColumn("ts", F.timestamp_seconds("t"))
    assert {r["event_id"]: r["accepted"] for r in crawl.polite(df.select("host", "event_id", "ts"), 1.0).collect()} == {0: True, 1: False, 2: True}


def test_arrivals_are_indexed_once(spark, tmp_path):
    folder, out = tmp_path / "in", f"{tmp_path}/out"
    folder.mkdir()
    page = {"title": "", "text": "lava rock lava", "status": 200}
    (folder / "1.json").write_text(json.dumps(page | {"url": "http://a/1"}))
    crawl.index_arrivals(crawl.arriving_pages(spark, str(folder)), out, f"{tmp_path}/check").awaitTermination()
    (folder / "2.json").write_text(json.dumps(page | {"url": "http://a/2"}) + "\n" + json.dumps(page | {"url": "http://a/3", "status": 500}))
    crawl.index_arrivals(crawl.arriving_pages(spark, str(folder)), out, f"{tmp_path}/check").awaitTermination()
    assert {(r["term"], r["tf"]) for r in spark.read.parquet(out).collect()} == {("lava", 2), ("rock", 1)} and spark.read.parquet(out).count() == 4


def test_new_urls(spark):
    links = spark.createDataFrame([("http://A/x/",), ("http://a/x",), ("http://a/y",), ("http://a/y#f",)], "url string")
    seen = spark.createDataFrame([("http://a/x",)], "url string")
    assert crawl.new_urls(links, seen).count() == 1


def test_first_visits(spark):
    pages = spark.createDataFrame([(3, "http://a/x"), (1, "http://A/x/"), (2, "http://a/y#f"), (4, "http://a/y")], "id long, url string")
    assert {r["id"]: r["fresh"] for r in crawl.first_visits(pages, "id").collect()} == {1: True, 2: True, 3: False, 4: False}


def test_progress_of_a_crawl(spark, tmp_path):
    said = []
    listener = crawl.Progress(target=10, every=1, say=said.append)
    spark.streams.addListener(listener)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"url": f"http://a/{i}", "title": "", "text": "lava", "status": 200}) for i in range(7)))
    crawl.index_arrivals(crawl.arriving_pages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    for _ in range(100):
        if len(said) >= 2:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert said[0].startswith("7 pages") and said[0].endswith("left of 10")


def test_robots(spark):
    pages = spark.createDataFrame([(1, "http://a/x"), (2, "http://a/no/x"), (3, "http://b/no")], "page_id long, url string")
    rules = spark.createDataFrame([("a", "User-agent: *\nDisallow: /no/")], "host string, robots string")
    assert {r["page_id"]: r["allowed"] for r in crawl.robots_filter(pages, rules, "x").collect()} == {1: True, 2: False, 3: True}


def test_sessions(spark):
    df = spark.createDataFrame([(1, 0), (1, 600), (1, 9000)], "user_id long, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted(r["n"] for r in crawl.sessions(df.select("user_id", "ts")).collect()) == [1, 2]


def test_ranked_rows_have_a_total_order(spark, topics):
    e = engine.SearchEngine.build(*topics, rounds=5)
    rows = rank.rank_bm25(e.index, e.terms(queries(spark, "earth")), 18).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_flat_clusters_are_of_all_vectors(spark, tmp_path):
    """Twenty clusters, stored one after the other: the first rows show only some, and in the reverse order others."""
    rng = np.random.default_rng(3)
    rows = [(150 * c + i, [float(x) for x in np.eye(20)[c] + rng.normal(0, 0.02, 20)], c) for c in range(20) for i in range(150)]
    got = []
    for name, part in (("up", rows), ("down", rows[::-1])):
        spark.createDataFrame(part, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        got.append({r["doc_id"]: r["cluster_id"] for r in catalog.QUERIES["kmeans_flat"](spark, f"{tmp_path}/{name}").collect()})
    assert got[0] == got[1] and len(got[0]) == 3000 and len(set(got[0].values())) >= 16


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        named = None

        def get(self, name, default=None):
            return self.named or default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://a:7077"})()

    with pytest.raises(ValueError):
        shared.shared_dir(Session())
    Conf.named = "hdfs://a/shared/"
    assert shared.shared_dir(Session()) == "hdfs://a/shared/fathomline"
