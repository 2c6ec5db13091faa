"""Crawling as batches and streams: levels, politeness, fetch rules, robots, incremental arrival."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ..functions import text as tx
from ..functions import urls
from ..operators.graph import crawl_levels
from ..sources.files import PAGES

DELAY, MOST_DEPTH, TARGET_PAGES, MOST_MB, RETRIES, BACKOFF = 1.0, 10, 100_000, 3.0, 2, 1.2
# What a crawl reads.
TYPES = ("text/html", "application/xhtml+xml")


def crawl_plan(edges: DataFrame, seeds: DataFrame, most_depth: int = MOST_DEPTH, pages: int = TARGET_PAGES) -> DataFrame:
    """id, depth, place: pages in the order of a breadth-first crawl that stops at its target; the cap is the target."""
    levels = crawl_levels(edges, seeds, most_depth).orderBy("depth", "id").limit(pages)
    return levels.withColumn("place", F.row_number().over(Window.orderBy("depth", "id")))


def polite(requests: DataFrame, delay: float = DELAY) -> DataFrame:
    """requests(host, event_id, ts) with `accepted`: at least `delay` seconds after the host's last accepted one; others are deferred.

    Each acceptance depends on the one before it, so that a host's requests go by in order, in one task; it holds a batch of them at a time."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, last = object(), None
        for pdf in batches:
            out = []
            for h, t in zip(pdf["host"], pdf["ts"], strict=True):
                if h != host:
                    host, last = h, None
                ok = last is None or (t - last).total_seconds() >= delay
                last = t if ok else last
                out.append(ok)
            yield pdf[["host", "event_id"]].assign(accepted=out)

    ordered = requests.select("host", "event_id", "ts").repartition("host").sortWithinPartitions("host", "ts", "event_id")
    return ordered.mapInPandas(fold, f"host {dict(requests.dtypes)['host']}, event_id long, accepted boolean")


class Frontier(StatefulProcessor):
    """The same for a stream: a host's state is the time of its last accepted request; deferred requests wait in a list until a timer."""

    def __init__(self, delay: float) -> None:
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at double")
        self.waiting = handle.getListState("waiting", "event_id long")

    def _emit(self, key, ids) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"host": [key[0]] * len(ids), "event_id": ids, "accepted": [True] * len(ids)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for pdf in rows:
            for event, t in pdf.sort_values(["ts", "event_id"])[["event_id", "ts"]].itertuples(index=False):
                at = t.timestamp()
                if not self.last.exists() or at - self.last.get()[0] >= self.delay:
                    self.last.update((at,))
                    out.append(int(event))
                else:
                    self.waiting.appendValue((int(event),))
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.delay * 1000))
        yield from self._emit(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ids = [w[0] for w in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.clear()
        if ids[1:]:
            self.waiting.put([(i,) for i in ids[1:]])
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.delay * 1000))
        yield from self._emit(key, ids[:1])

    def close(self) -> None:
        pass


def polite_stream(requests: DataFrame, delay: float = DELAY) -> DataFrame:
    """host, event_id, accepted: requests when their host may be asked. Needs a state store that holds lists (RocksDB)."""
    return requests.groupBy("host").transformWithStateInPandas(Frontier(delay), "host string, event_id long, accepted boolean", "append", "processingTime")


def fetch_rules(fetched: DataFrame, most_mb: float = MOST_MB) -> DataFrame:
    """page_id, content_type (as compared) and `accepted`: a page to read, of bearable size."""
    kind = tx.content_type(F.col("content_type"))
    return fetched.select("page_id", kind.alias("content_type"), ((F.col("status") == 200) & kind.isin(*TYPES) & (F.col("size_bytes") <= most_mb * 1_000_000)).alias("accepted"))


def retry_delays(retries: int = RETRIES, backoff: float = BACKOFF) -> list[float]:
    return [backoff * (n + 1) for n in range(retries)]


def robots_filter(pages: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """pages(page_id, url) with `allowed` by the robots.txt of rules(host, robots); a host without rules allows all."""

    def judge(url: pd.Series, robots: pd.Series) -> pd.Series:
        parsed: dict = {}

        def allowed(u: str, text: str | None) -> bool:
            if text is None:
                return True
            if text not in parsed:
                parsed[text] = RobotFileParser()
                parsed[text].parse(text.splitlines())
            return parsed[text].can_fetch(agent, u)

        return pd.Series([allowed(u, t) for u, t in zip(url, robots, strict=True)])

    joined = pages.withColumn("host", urls.netloc(F.col("url"))).join(rules, "host", "left")
    return joined.select(*pages.columns, F.pandas_udf(judge, "boolean")("url", "robots").alias("allowed"))


def new_urls(links: DataFrame, visited: DataFrame) -> DataFrame:
    """url of links that isn't visited yet, once each: the exact form of a visited filter."""
    seen = visited.select(urls.visited_url_of(F.col("url")).alias("key")).distinct()
    return links.withColumn("key", urls.visited_url_of(F.col("url"))).join(seen, "key", "left_anti").dropDuplicates(["key"]).select("url")


def first_visits(pages: DataFrame, order: str) -> DataFrame:
    """pages with `fresh`: whether no page before it, in the given order, has its URL. The whole history in one pass, as a visited set sees it."""
    key = urls.visited_url_of(F.col("url"))
    first = pages.select(key.alias("_key"), order).groupBy("_key").agg(F.min(order).alias("_first"))
    return pages.withColumn("_key", key).join(first, "_key").withColumn("fresh", F.col(order) == F.col("_first")).drop("_key", "_first")


class Progress(StreamingQueryListener):
    """Pages so far, pages a second and seconds left of a crawl that arrives as a stream; `say` is told every `every` pages, and at the end."""

    def __init__(self, target: int = TARGET_PAGES, every: int = 500, say: Callable[[str], None] = print) -> None:
        self.target, self.every, self.say = target, every, say
        self.began, self.pages, self.told = time.monotonic(), 0, 0

    def line(self) -> str:
        rate = self.pages / max(time.monotonic() - self.began, 1e-9)
        left = max(self.target - self.pages, 0) / rate if rate else float("inf")
        return f"{self.pages} pages, {rate:.1f} a second, {left:.0f} s left of {self.target}"

    def onQueryStarted(self, event) -> None:
        self.began = time.monotonic()

    def onQueryProgress(self, event) -> None:
        self.pages += event.progress.numInputRows
        if self.pages - self.told >= self.every:
            self.told = self.pages
            self.say(self.line())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.say(self.line())


def counted(pages: DataFrame, name: str = "crawl") -> tuple[DataFrame, Observation]:
    """The same pages, and what is counted of them on their way: pages, accepted (status 200), last depth."""
    seen = Observation(name)
    return pages.observe(seen, F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status") == 200).alias("accepted"), F.max("depth").alias("depth")), seen


def arriving_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the page files that come into a folder."""
    return spark.readStream.schema(PAGES).json(folder).where("status = 200")


def index_arrivals(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the postings of arriving pages(doc_id or url, title, text) to path, once each: a batch that is tried again replaces its own files."""
    from ..operators.index import term_counts

    def write(batch: DataFrame, batch_id: int) -> None:
        own = batch.dropDuplicates(["url"]).withColumn("doc_id", F.xxhash64("url"))
        term_counts(own).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Beyond what is asked of a crawl: sessions of events(user_id, ts) with a watermark."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), "n")
