from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import clean, cluster, evaluate, expand, graph, index, rank, vectors


def pages(spark, texts, **more):
    rows = [(i + 1, f"http://h{i % 3}.org/{i}", "", t, "text/html", 200, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, url string, title string, text string, content_type string, status int, depth int")


def asked(spark, *queries):
    return rank.query_terms(spark.createDataFrame(list(enumerate(queries)), "query_id int, query string"))


def test_zero_idf_still_hits(spark):
    i = index.build_index(pages(spark, ["rock", "rock"]))
    got = rank.rank_tfidf(i, asked(spark, "rock")).collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [(1, 0.0), (2, 0.0)]


def test_empty_documents_count(spark):
    i = index.build_index(pages(spark, ["rock lava", "", None]))
    assert i.stats.first().asDict() == {"n_docs": 3, "avg_dl": 2 / 3}
    assert {r["doc_id"]: r["doc_len"] for r in i.docs.collect()} == {1: 2, 2: 0, 3: 0}
    assert rank.rank_bm25(i, asked(spark, "unknown words", "")).count() == 0


def test_bm25_by_hand(spark):
    i = index.build_index(pages(spark, ["lava lava rock", "rock", "ash"]))
    idf, avg = math.log((3 - 1 + 0.5) / 1.5 + 1), 5 / 3
    want = idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg))
    assert rank.rank_bm25(i, asked(spark, "lava lava")).first()["score"] == pytest.approx(want)


def test_bm25_grows_with_frequency(spark):
    i = index.build_index(pages(spark, ["lava ash ash ash", "lava lava ash ash", "lava lava lava ash", "dust dust dust dust"]))
    assert [r["doc_id"] for r in rank.rank_bm25(i, asked(spark, "lava")).orderBy("rank").collect()] == [3, 2, 1]


def test_pagerank_keeps_mass(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = {r["id"]: r["score"] for r in graph.pagerank(nodes, spark.createDataFrame([(1, 2)], "src long, dst long")).collect()}
    assert sum(got.values()) == pytest.approx(1) and set(got) == {1, 2, 3} and got[2] > got[1] == pytest.approx(got[3])
    assert graph.pagerank(nodes.limit(0), spark.createDataFrame([], "src long, dst long")).count() == 0


def test_hits_takes_the_round_before(spark):
    edges = [(1, 3), (2, 3), (2, 4)]
    ids = np.array([1, 2, 3, 4])
    auth, hub = graph.hits_scores(ids, np.array([1, 2, 2]), np.array([3, 3, 4]), 3, None)
    a, h = np.ones(4), np.ones(4)
    for _ in range(3):
        na, nh = np.zeros(4), np.zeros(4)
        for s, d in edges:
            na[d - 1] += h[s - 1]
            nh[s - 1] += a[d - 1]
        a, h = na / np.linalg.norm(na), nh / np.linalg.norm(nh)
    assert np.allclose(auth, a) and np.allclose(hub, h)
    base = spark.createDataFrame([(7, i) for i in (1, 2, 3, 4)], "query_id long, doc_id long")
    got = {r["doc_id"]: r["authority"] for r in graph.hits(base, spark.createDataFrame(edges, "src long, dst long"), 3, None).collect()}
    assert np.allclose([got[i] for i in (1, 2, 3, 4)], a)


def test_repeated_query_terms_count_in_roots(spark):
    postings = spark.createDataFrame([("a", 1, 2), ("b", 2, 3)], "term string, doc_id long, tf long")
    terms = spark.createDataFrame([(0, "a", 2), (0, "b", 1)], "query_id int, term string, qtf long")
    assert graph.root_set(postings, terms, 1).first()["doc_id"] == 1


def test_graph(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, url string")
    links = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a"), ("a", "zzz"), ("b", "c")], "src_url string, dst_url string")
    nodes, edges = graph.build_graph(docs, links)
    assert {tuple(r) for r in edges.collect()} == {(1, 2), (2, 3)}
    assert graph.graph_stats(nodes, edges).first().asDict() == {"n_nodes": 3, "n_edges": 2, "max_in_degree": 1, "max_in_node": 2, "max_out_degree": 1, "max_out_node": 1, "avg_out_degree": 0.67}
    assert {tuple(r) for r in graph.crawl_levels(edges, nodes.where("id = 1"), 1).collect()} == {(1, 0), (2, 1)}


@pytest.mark.parametrize(("rows", "kept"), [([("u1", "t1"), ("u2", "t1"), ("u2", "t2")], [1, 3]), ([("u1", "t1"), ("u1", "t2"), ("u2", "t2")], [1, 3])])
def test_greedy_dedup(spark, rows, kept):
    df = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "id long, normalized_url string, text_hash string")
    assert sorted(r["id"] for r in clean.keep_first(df, "id").where("kept").collect()) == kept


def test_greedy_dedup_is_the_fold(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"u{rng.integers(40)}", f"t{rng.integers(40)}") for i in range(120)]
    urls, texts, want = set(), set(), []
    for i, u, t in rows:
        if u not in urls and t not in texts:
            urls.add(u)
            texts.add(t)
            want.append(i)
    got = clean.keep_first(spark.createDataFrame(rows, "id long, normalized_url string, text_hash string"), "id")
    assert sorted(r["id"] for r in got.where("kept").collect()) == want


def test_null_keys_repeat_nothing(spark):
    rows = [(1, "u", None), (2, "v", None), (3, None, "t"), (4, None, "t"), (5, "u", "s"), (6, None, None), (7, "v", "r")]
    got = clean.keep_first(spark.createDataFrame(rows, "id long, normalized_url string, text_hash string"), "id")
    assert sorted((r["id"], r["duplicate"]) for r in got.collect()) == [(1, None), (2, None), (3, None), (4, "text"), (5, "url"), (6, None), (7, "url")]


def test_reasons(spark):
    good = "the rock and the volcano for this earth " * 5
    rows = [
        (1, "http://a/1", "t", good, "text/html; x", 200, 1), (2, "http://a/2", "t", good, "text/html", 404, 1), (3, "http://a/3", "t", good, "image/png", 200, 1), (4, "", "t", good, "", 200, 1),
        (5, "http://a/5", "t", "short", "", 200, 1), (6, "http://a/6", "App Store x", good, "", 200, 1), (7, "http://a/7", "t", "zz qq " * 60, "", 200, 1), (8, "http://a/1/", "t", good + "x", "", 200, 1), (9, "http://a/9", "t", good, "", 200, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, url string, title string, text string, content_type string, status int, depth int")
    records, counts = clean.load_corpus(df, "doc_id")
    assert [r["doc_id"] for r in records.collect()] == [1]
    assert {r["reason"]: r["n"] for r in counts.collect()} == {"kept": 1, "non_200": 1, "non_html": 1, "missing_url": 1, "short_text": 1, "low_value": 1, "non_english": 1, "duplicate_url": 1, "duplicate_text": 1}


def local(spark, rows):
    return spark.createDataFrame([(0, t, d, f) for t, d, f in rows], "query_id int, term string, doc_id long, tf long")


def test_association_and_cosine(spark):
    terms = spark.createDataFrame([(0, "u", 1)], "query_id int, term string, qtf long")
    tf = local(spark, [("u", 1, 1), ("u", 2, 1), ("v", 1, 2), ("v", 2, 2), ("w", 3, 1), ("w", 4, 5)])
    scores = {r["v"]: r["raw"] for r in expand.scalar(tf, terms).collect()}
    assert scores["v"] == pytest.approx(1, abs=1e-9) and "w" not in scores
    raw = {r["v"]: r["raw"] for r in expand.association(tf, terms).collect()}
    assert raw["v"] == 4
    share = {r["v"]: r["raw"] for r in expand.association(tf, terms, normalized=True).collect()}
    assert share["v"] == pytest.approx(4 / (2 * 4))


def test_known_correlations(spark):
    # Sum of frequencies 9 and 3 with a product sum of 8 give 0.296296; norms of 17 and 5 with 8 give 0.867722.
    terms = spark.createDataFrame([(0, "flow", 1)], "query_id int, term string, qtf long")
    tf = local(spark, [("flow", 1, 2), ("flow", 2, 4), ("flow", 3, 3), ("v", 1, 2), ("v", 2, 1)])
    assert {r["v"]: round(r["raw"], 6) for r in expand.association(tf, terms, True).collect()}["v"] == 0.296296
    tf = local(spark, [("flow", 1, 4), ("flow", 2, 1), ("v", 1, 2), ("v", 2, 1), ("v", 3, 0)])
    assert 9 / (17**0.5 * 5**0.5) == pytest.approx({r["v"]: r["raw"] for r in expand.scalar(tf, terms).collect()}["v"])


def test_metric(spark):
    docs = spark.createDataFrame([(1, "aa bb aa cc")], "doc_id long, text_preview string")
    got = expand.metric(docs, spark.createDataFrame([(0, 1)], "query_id int, doc_id long"), spark.createDataFrame([(0, "aa", 1)], "query_id int, term string, qtf long"))
    assert {r["v"]: r["raw"] for r in got.collect()}["cc"] == pytest.approx(1 / 3 + 1)


@pytest.mark.parametrize(("df", "n", "length", "ok"), [(3, 100, 1, False), (4, 100, 1, True), (3, 100, 2, True), (10, 100, 1, True), (11, 100, 1, False), (5, 100, 3, True), (6, 100, 3, False), (7, 5000, 2, False), (8, 5000, 2, True), (7, 5000, 3, True)])
def test_candidates(spark, df, n, length, ok):
    terms = spark.createDataFrame([("lava", df), ("page", df), ("l4va", df), ("la", df)], "term string, df long")
    got = [r["term"] for r in terms.where(expand.candidate_terms(terms, F.lit(n), F.lit(length))).collect()]
    assert got == (["lava"] if ok else [])


def test_rocchio_moves_towards_relevant(spark):
    texts = ["lava flow basalt basalt", "lava basalt", "lava cake sugar", "cake sugar", "basalt column", "sugar cane"] + [f"other{chr(97 + i)}" for i in range(60)]
    i = index.build_index(pages(spark, texts))
    feedback = spark.createDataFrame([(0, 1, True), (0, 2, True), (0, 3, False)], "query_id int, doc_id long, relevant boolean")
    assert [r["term"] for r in expand.rocchio(i, asked(spark, "lava flow"), feedback).orderBy("rank").collect()] == ["basalt"]


def test_spelling(spark):
    terms = spark.createDataFrame([("volcano", 9), ("volcanic", 9), ("rock", 9), ("fossil", 2)], "term string, df long")
    words = spark.createDataFrame([(0, 0, "volcnos"), (0, 1, "rocks"), (0, 2, "fosil"), (0, 3, "zzzz")], "query_id int, place int, token string")
    got = {r["token"]: r["term"] for r in expand.correct_terms(words, terms).collect()}
    assert got == {"volcnos": "volcano", "rocks": "rock", "fosil": "fosil", "zzzz": "zzzz"}
    assert expand.close_match("volcno", ["volcano", "rock"]) == "volcano" and expand.close_match("x", ["rock"]) is None


def test_spelling_of_many_words(spark):
    """Blocks of words give what close_match finds for one word at a time, and compare few of all pairs."""
    import random
    import time

    some = random.Random(7)
    vocabulary = sorted({"".join(some.choice("abcdeilnorst") for _ in range(some.randint(4, 12))) for _ in range(20_000)} | {"cababa"})
    broken = sorted({v[:i] + v[i] + v[i:] for v in some.sample(vocabulary, 400) for i in [some.randrange(len(v))]} | {"b", "q9q9q9", "cabbabca"})
    terms = spark.createDataFrame([(v, 9) for v in vocabulary], "term string, df long")
    words = spark.createDataFrame([(0, i, w) for i, w in enumerate(broken)], "query_id int, place int, token string")
    began = time.perf_counter()
    got = {r["token"]: r["term"] for r in expand.correct_terms(words, terms, "none").collect()}
    assert time.perf_counter() - began < 30
    known = set(vocabulary)
    assert set(got) == set(broken)
    for w in [x for x in broken if x not in known][::8] + ["b", "q9q9q9"]:
        assert got[w] == (expand.close_match(w, vocabulary) or w)
    assert got["cabbabca"] == "cababa"  # the other way round, the two share shorter blocks


def test_terms_without_postings(spark, monkeypatch):
    rows = [(1, "", "Rocks rock the lava"), (1, "", "lava ash"), (2, "Rocking", None), (None, None, "ash 7"), (3, "", "")]
    texts = spark.createDataFrame(rows, "doc_id long, title string, text string")
    monkeypatch.setattr(index, "COUNTED", 2)
    for frame in (texts, texts.dropDuplicates(["doc_id"]), texts.where("doc_id > 9")):
        for stemmer in ("none", "english"):
            whole = index.document_frequency(index.term_counts(frame, stemmer))
            assert sorted(index.index_terms(frame, stemmer).collect()) == sorted(whole.collect())


def test_natural_words(spark):
    surfaces = spark.createDataFrame([("volcano", "volcanoes"), ("rock", "Rocks "), ("b2", "b2b"), ("ash", "ash"), ("x", "xy")], "stem string, surface string")
    lemmas = spark.createDataFrame([("volcanoes", "volcano"), ("rocks", "stone"), ("b2b", "b2"), ("ash", "as")], "surface string, lemma string")
    named = lambda df: {r["stem"]: r["natural"] for r in df.collect()}
    assert named(expand.natural_words(surfaces)) == {"volcano": "volcanoes", "rock": "rocks", "ash": "ash"}
    assert named(expand.natural_words(surfaces, lemmas)) == {"volcano": "volcanoes", "rock": "stone", "ash": "ash"}
    assert [r["term"] for r in expand.safe_stems(spark.createDataFrame([("lava", 4), ("ash", 3), ("page", 9), ("l4", 9)], "term string, df long")).collect()] == ["lava"]


def test_admitted_rows_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    i = index.build_index(pages(spark, [" ".join(rng.choice(["lava", "rock", "ash", "page", "a1", "fault", "cone", "dike", *(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(150))], 6)) for _ in range(200)]))
    terms = spark.createDataFrame([(0, "lava", 1), (1, "lava", 1), (1, "rock", 1), (2, "ash", 2), (2, "w", 1)], "query_id int, term string, qtf long")
    rows = i.terms.crossJoin(terms.select("query_id").distinct()).select("query_id", "term")
    got = expand.admit(rows, i, terms)
    n, df = 200, {r["term"]: r["df"] for r in i.terms.collect()}
    want = set()
    for q, length, own in ((0, 1, {"lava"}), (1, 2, {"lava", "rock"}), (2, 3, {"ash", "w"})):
        for t, d in df.items():
            if t.isalpha() and 3 <= len(t) <= 24 and t not in expand.stop_terms() and t not in own and d >= (4 if length <= 1 else 3) and d / n <= (0.1 if length <= 1 else 0.05):
                want.add((q, t))
    assert {(r["query_id"], r["term"]) for r in got.collect()} == want and want
    totals = {r["query_id"]: r["n"] for r in expand.candidate_totals(i, terms).collect()}
    assert totals == {q: sum(x == q for x, _ in want) for q in {x for x, _ in want}}


def test_display_query():
    natural = {"volcano": "volcanoes", "lava": "lava", "erupt": "eruption"}
    assert expand.display_query(["volcano"], ["lava", "eruptionvolcano", "volcano", "basalt"], natural, {"basalt"}) == "volcanoes lava basalt"
    assert expand.display_query(["volcano"], ["basalt"], natural, {"basalt"}, m=6) == "volcanoes"
    assert expand.display_query(["zz"], [], {}, set()) == "zz"


def test_precision_divides_by_k(spark):
    runs = spark.createDataFrame([("s", 0, i + 1, d) for i, d in enumerate((1, 2, 3))], "system string, query_id int, rank int, doc_id long")
    qrels = spark.createDataFrame([(0, 1, 2), (0, 9, 1)], "query_id int, doc_id long, rel int")
    m = evaluate.judged_metrics(runs, qrels).first()
    ideal = 3 / 1 + 1 / math.log2(3)
    assert (m["precision_at_5"], m["success_at_5"], m["mrr"], m["ndcg_at_5"]) == (0.2, 1.0, 1.0, round(3 / ideal, 4))
    none = evaluate.judged_metrics(runs, spark.createDataFrame([(0, 1, 0)], "query_id int, doc_id long, rel int")).first()
    assert none["ndcg_at_10"] == none["mrr"] == 0


def test_rerank_of_unassigned(spark):
    hits = spark.createDataFrame([(0, 1, 10, 2.0), (0, 2, 11, 1.0)], "query_id int, rank int, doc_id long, score double")
    assigned = spark.createDataFrame([(11, 0)], "doc_id long, cluster_id int")
    centers = spark.createDataFrame([(0, [1.0, 0.0])], "cluster_id int, center array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, vec array<double>")
    rows = {r["doc_id"]: r for r in cluster.rerank(hits, assigned, centers, q, spark.createDataFrame([(0, "n")], "cluster_id int, name string")).collect()}
    assert (rows[10]["cluster_name"], rows[10]["cluster_affinity"], rows[10]["cluster_support"], rows[10]["score"]) == ("unassigned", 0.0, 0.0, 0.7)
    assert (rows[11]["cluster_name"], rows[11]["score"], rows[11]["rank"], rows[11]["rank_delta"]) == ("n", 0.65, 2, 0)


def test_vectors_go_to_the_nearest_center(spark):
    rng = np.random.default_rng(6)
    x, c = rng.normal(size=(300, 8)).astype(np.float32), rng.normal(size=(7, 8))
    c[5] = c[2]  # of equals the first
    df = spark.createDataFrame([(i, [float(v) for v in r], {"k": i}) for i, r in enumerate(x)] + [(900, None, None)], "doc_id long, vec array<float>, more map<string,int>").repartition(3)
    got = {r["doc_id"]: (r["cluster_id"], r["more"]) for r in cluster.assign(df, cluster.centers_frame(spark, c)).collect()}
    assert got == {i: (int(((r - c) ** 2).sum(axis=1).argmin()), {"k": i}) for i, r in enumerate(x.astype(np.float64))} | {900: (None, None)}


def test_sparse_products(spark):
    rng = np.random.default_rng(7)
    x = (rng.random((700, 1200)) < 0.02) * rng.random((700, 1200))
    rows = [(i, np.nonzero(r)[0].tolist(), r[np.nonzero(r)[0]].tolist()) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, weights array<double>").repartition(5)
    a, b = rng.normal(size=(1200, 4)), rng.normal(size=(1200, 6))
    assert np.allclose(vectors._gather(df, None, b, 1200), x.T @ (x @ b))
    assert np.allclose(vectors._gather(df, a, b, 4), (x @ a).T @ (x @ b))


def test_long_chains_of_duplicates(spark):
    rows = [(i, f"u{(i + 1) // 2}", f"t{i // 2}") for i in range(400)]
    seen_u, seen_t, want = set(), set(), []
    for i, u, t in rows:
        if u not in seen_u and t not in seen_t:
            want.append(i)
            seen_u.add(u)
            seen_t.add(t)
    got = clean.keep_first(spark.createDataFrame(rows, "id long, normalized_url string, text_hash string"), "id")
    assert sorted(r["id"] for r in got.where("kept").collect()) == want


def test_a_drawing_of_a_graph(spark, tmp_path):
    graph.graph_page(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"), str(tmp_path / "g.html"), "<x>")
    page = (tmp_path / "g.html").read_text()
    assert page.count("<line") == 2 and page.count("<circle") == 3 and "&lt;x&gt;" in page


def test_agglomeration():
    x = np.array([[0, 1], [0.1, 1], [5, 0], [5.2, 0.1], [9, 9]], float)
    for linkage in ("ward", "complete"):
        labels = cluster.cut(cluster.agglomerate(x, linkage), len(x), 3)
        assert len(set(labels)) == 3 and labels[0] == labels[1] and labels[2] == labels[3]


def test_scores():
    x = np.array([[0.0], [0.1], [5.0], [5.1]])
    labels = np.array([0, 0, 1, 1])
    a, b = 0.1, np.array([5.05, 4.95, 4.95, 5.05])
    assert cluster.silhouette(x, labels, block=3) == pytest.approx(((b - a) / b).mean())
    assert cluster.davies_bouldin(x, labels) == pytest.approx(0.1 / 5)
    assert cluster.silhouette(x, np.zeros(4)) == -1 and cluster.davies_bouldin(x, np.zeros(4)) == math.inf


@pytest.mark.parametrize("most, min_df", [(25, 3), (10_000, 1)])
def test_vocabulary_without_rows_for_pairs(spark, monkeypatch, most, min_df):
    """Counts by numbers of words give the vocabulary and vectors of the plain counts: null and empty texts, ids that repeat, small tables."""
    for name, small in (("COUNTED", 5), ("PAIRED", 5), ("SUMS", 16)):
        monkeypatch.setattr(vectors, name, small)
    some = np.random.default_rng(3)
    rows = [(int(i % 70), " ".join(f"w{int(x)}" for x in some.zipf(1.5, 30) % 60) + " the Lava_x and Caf\u00e9 rock's 7 77") for i in range(80)] + [(200, None), (None, "w1 w2 the w3"), (201, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for texts in (frame, frame.dropDuplicates(["doc_id"])):
        counts, n = vectors.gram_counts(texts), texts.count()
        plain = vectors.fit_vocabulary(counts, n, most, min_df)
        parts, repeated = vectors._texts(texts)
        vocabulary, coded, names = vectors.corpus_vocabulary(parts, n, most, min_df, vectors.MAX_DF)
        assert repeated == (texts is frame)
        assert sorted(vocabulary.collect()) == sorted(plain.collect())
        key = lambda r: (r["doc_id"] is None, r["doc_id"])
        want, got = (sorted(f.collect(), key=key) for f in (vectors.tfidf_vectors(counts, plain), vectors.coded_vectors(coded, names, vocabulary)))
        assert [(r["doc_id"], r["ids"]) for r in got] == [(r["doc_id"], r["ids"]) for r in want]
        assert all(np.allclose(g["weights"], w["weights"]) for g, w in zip(got, want, strict=True))
        projection = vectors.fit_projection(texts, most, min_df, components=4)
        basis, seen = projection.basis, {r["doc_id"]: (r["ids"], r["weights"]) for r in want}
        found = projection.term_counts(texts).select("doc_id", F.explode(F.arrays_zip("ids", "tfs")).alias("g")).select("doc_id", F.col("g.ids").alias("term_id"), F.col("g.tfs").alias("tf"))
        assert sorted(map(str, found.collect())) == sorted(map(str, counts.join(vocabulary, "term").select("doc_id", "term_id", "tf").collect()))
        out = projection.transform(texts).collect()
        assert len(out) == n
        for r in out:
            ids, weights = seen.get(r["doc_id"], ([], []))
            x = np.array(weights) @ basis[list(ids)] if len(ids) else np.zeros(basis.shape[1])
            assert np.allclose(r["vec"], x / max(np.linalg.norm(x), 1e-300), atol=1e-5)
