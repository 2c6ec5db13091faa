"""Pages from HTML: title, links, text without boilerplate. The standard library's parser, in pandas batches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import urls

# Elements and class names that go, with the text that follows their end tag.
DROPPED = frozenset("script style noscript header footer nav aside form iframe".split())
DROPPED_CLASSES = frozenset(("sidebar", "menu", "advertisement"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# A page's text has one of these.
CONTENT = (
    "geology", "geological", "geologic", "mineral", "rock", "sediment", "fossil", "earthquake", "seismic", "volcano", "volcanic", "tectonic", "stratigraphy", "lithology", "igneous",
    "metamorphic", "sedimentary", "geophysics", "geochemistry", "paleontology", "earth science", "earth sciences", "fault", "magma", "lava", "bedrock", "groundwater",
)
MOST_TEXT, MOST_LINKS = 50_000, 80


class _Page(HTMLParser):
    """Collects text outside dropped elements. What follows a dropped element up to the next tag is its tail, and goes with it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.count: Counter[str] = Counter()  # open elements of each name, so that no tag looks through all of them
        self.dropping = 0  # open elements that are dropped
        self.parts: list[str] = []
        self.links: list[str] = []
        self.title: str | None = None
        self.tail = False

    def handle_starttag(self, tag, attrs) -> None:
        self.tail = False
        found = dict(attrs)
        if tag == "a" and found.get("href") is not None:
            self.links.append(found["href"])
        gone = tag in DROPPED or bool(DROPPED_CLASSES & set((found.get("class") or "").split()))
        if tag in VOID:
            self.tail = gone
        else:
            self.open.append((tag, gone))
            self.count[tag] += 1
            self.dropping += gone

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag) -> None:
        if self.count[tag]:
            while True:
                t, gone = self.open.pop()
                self.count[t] -= 1
                self.dropping -= gone
                if t == tag:
                    self.tail = gone
                    return

    def handle_data(self, data) -> None:
        if self.title is None and self.open and self.open[-1][0] == "title":
            self.title = data.strip()
        if not self.tail and not self.dropping:
            self.parts.append(data)


def parse_page(html: str | None) -> tuple[str, str, list[str]]:
    """Title, text and links as they stand."""
    page = _Page()
    try:
        page.feed(html or "")
        page.close()
    except (AssertionError, ValueError):  # what could be read of a broken page counts
        pass
    text = re.sub(r"\s+", " ", "".join(page.parts)).strip()
    return page.title or "", text[:MOST_TEXT], page.links


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, title, text and links (absolute and normalised, in the order of the page) of pages(page_id, url, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [parse_page(h) for h in pdf["html"]]
            links = []
            for base, (_, _, hrefs) in zip(pdf["url"], got, strict=True):
                own = []
                for h in hrefs:
                    try:
                        own.append(urls.crawl_url(urljoin(base or "", h)))
                    except ValueError:
                        continue
                links.append([u for u in own if u])
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "title": [g[0] for g in got], "text": [g[1] for g in got], "links": links})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, title string, text string, links array<string>")


def has_content(text):
    """Some word of CONTENT in the lower-cased text."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(CONTENT))


def page_links(parsed: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """page_id, place (from 1) and link: of each page the first `most` different links that a crawl follows."""
    allowed = F.filter(F.array_distinct("links"), urls.is_link_allowed)
    return parsed.select("page_id", F.posexplode(F.slice(allowed, 1, most)).alias("place", "link")).select("page_id", (F.col("place") + 1).alias("place"), "link")


def title_of(html):
    """The first title, by pattern alone."""
    return F.trim(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))
