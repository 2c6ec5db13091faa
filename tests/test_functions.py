from __future__ import annotations

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomline.functions import html, urls, words
from fathomline.functions import text as tx
from fathomline.functions.stem import english, porter


@pytest.mark.parametrize(
    ("word", "stem"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"),
        ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"),
        ("digitizer", "digit"), ("operator", "oper"), ("feudalism", "feudal"), ("decisiveness", "decis"), ("hopefulness", "hope"), ("formality", "formal"), ("sensitivity", "sensit"), ("triplicate", "triplic"),
        ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("allowance", "allow"), ("airliner", "airlin"), ("adjustable", "adjust"), ("replacement", "replac"), ("adoption", "adopt"),
        ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("controller", "control"), ("geology", "geolog"), ("volcanoes", "volcano"), ("yearly", "yearli"), ("conus", "conu"), ("dying", "die"), ("is", "is"),
    ],
)
def test_porter(word, stem):
    assert porter(word) == stem


@pytest.mark.parametrize(
    ("word", "stem"),
    [
        ("consignment", "consign"), ("consisted", "consist"), ("consistency", "consist"), ("consolation", "consol"), ("consolatory", "consolatori"), ("conspicuous", "conspicu"), ("conspiracy", "conspiraci"), ("knackeries", "knackeri"),
        ("knaves", "knave"), ("knavish", "knavish"), ("kneaded", "knead"), ("knightly", "knight"), ("knots", "knot"), ("generate", "generat"), ("generously", "generous"), ("communism", "communism"), ("skies", "sky"), ("news", "news"),
        ("happy", "happi"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("this", "this"), ("gaps", "gap"), ("kiwis", "kiwi"), ("agreed", "agre"), ("hopping", "hop"), ("hoping", "hope"), ("luxuriated", "luxuri"), ("fluently", "fluentli"),
        ("sayings", "say"), ("yearly", "year"), ("by", "by"), ("geology", "geolog"), ("geological", "geolog"), ("volcanoes", "volcano"), ("proceed", "proceed"), ("relational", "relat"), ("conditional", "condit"), ("bed", "bed"), ("shed", "shed"),
        ("formative", "format"), ("adoption", "adopt"), ("controller", "control"), ("hopefulness", "hope"), ("electricity", "electr"), ("early", "earli"), ("earthquakes", "earthquak"), ("magmatic", "magmat"), ("sedimentary", "sedimentari"),
    ],
)
def test_english(word, stem):
    assert english(word) == stem


def test_stop_words_are_frozen():
    assert len(words.STOP_WORDS) == len(set(words.STOP_WORDS)) == 179


def test_url_forms_differ():
    odd = "HTTP://A.com:80//x/../y/?b=2&a=1#f"
    assert urls.crawl_url(odd) == "http://a.com/y?a=1&b=2"
    assert urls.visited_url(odd) == "http://a.com:80//x/../y?a=1&b=2"
    assert urls.page_url(odd) == "http://a.com:80//x/../y?b=2&a=1"
    tracked = "https://a.com/?utm_source=z&B=1"
    assert urls.crawl_url(tracked) == "https://a.com/?B=1&utm_source=z"
    assert urls.page_url(tracked) == "https://a.com?B=1"
    assert urls.page_url("a.com/x/") == "https:///a.com/x" or urls.page_url("a.com/x/").startswith("https:")
    assert urls.crawl_url("a.com/x/") == urls.crawl_url("") == urls.page_url("") == urls.page_url(None) == urls.crawl_url("ftp://a/") == urls.crawl_url("http://a:bad/") == ""


@settings(max_examples=80, deadline=None)
@given(st.from_regex(r"https?://[a-z]{1,6}(\.[a-z]{2,3})?(:[0-9]{2,4})?(/[a-z.]{0,4}){0,4}(\?[a-z]=[a-z0-9]{0,3}(&[a-z]=[0-9])?)?(#[a-z])?", fullmatch=True))
def test_normalisers_are_idempotent(url):
    for of in (urls.crawl_url, urls.visited_url, urls.page_url):
        assert of(of(url)) == of(url)


def test_links_allowed(spark):
    rows = [("https://a.com/geology/x", True), ("https://a.com/x", False), ("https://a.com/geology.pdf", False), ("https://a.com/geology?ref=1", False), ("ftp://a.com/geology", False), ("https://A.com/GEOLOGY", True), (None, False)]
    df = spark.createDataFrame(rows, "url string, want boolean").select(urls.is_link_allowed(F.col("url")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())


def test_tail_goes_with_its_element():
    assert html.parse_page("<p>a<script>x</script>b</p><p>c</p>")[1] == "ac"
    assert html.parse_page('<div class="x sidebar">s</div>t<p>u</p>')[1] == "u"
    title, text, links = html.parse_page("<title> T </title><nav><a href='/n'>n</a></nav><a href='b'>l</a>")
    assert (title, links) == ("T", ["/n", "b"])
    assert "l" in text and "n" not in text
    assert html.parse_page(None) == ("", "", []) and html.parse_page("<p><b>open")[1] == "open"


def test_page_links(spark):
    page = '<a href="/geology/a">1</a><a href="/geology/a#x">2</a><a href="/other">3</a><a href="http://[bad">4</a>' + "".join(f'<a href="/geology/{i}">{i}</a>' for i in range(100))
    parsed = html.parse_pages(spark.createDataFrame([(1, "http://h.org/", page)], "page_id long, url string, html string"))
    links = html.page_links(parsed).orderBy("place").collect()
    assert len(links) == html.MOST_LINKS and links[0]["link"] == "http://h.org/geology/a" and links[1]["link"] == "http://h.org/geology/0"


def test_text_functions(spark):
    df = spark.createDataFrame([(" a \n b  c ", "T"), (None, None), ("", " ")], "text string, title string")
    got = df.select(tx.clean(F.col("text"), 3).alias("c"), tx.terms_of(F.col("text")).alias("t"), tx.content_type(F.lit("Text/HTML; x")).alias("k"), tx.clustering_text(F.col("title"), F.lit("x")).alias("x")).collect()
    assert [r["c"] for r in got] == ["a b"[:3], "", ""] and got[0]["t"] == ["b", "c"] and got[0]["k"] == "text/html"
    assert [r["x"] for r in got] == ["T T T x", "x", "x"]


def test_analyze_is_the_same_on_driver_and_executors(spark):
    text = "Volcanoes and the Rocks of sedimentary formations"
    terms = spark.createDataFrame([(text,)], "t string").select(F.explode(tx.terms_of(F.col("t"))).alias("term"))
    stems = {r["term"]: r["stem"] for r in tx.stem_vocabulary(terms).collect()}
    assert tx.analyze(text) == [stems[t] for t in ("volcanoes", "rocks", "sedimentary", "formations")]


def test_pages_of_unclosed_tags_take_linear_time():
    text = "<div>a" * 30_000 + "</p>" * 30_000 + "<b>x</b>"
    began = time.perf_counter()
    assert html.parse_page(text)[1].endswith("ax") and time.perf_counter() - began < 5
