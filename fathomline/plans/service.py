"""Requests and jobs in one process: answers of search services, what a search shows, build and experiment jobs, health."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..shared import materialise
from ..sources import files
from .clusters import CLUSTERINGS, Build
from .engine import SERVED, SearchEngine

# Queries that are shown where there is no benchmark file.
DEMO = (
    ("Q001", "volcanic eruption hawaii", "volcanology"), ("Q009", "earthquake fault lines california", "seismology"), ("Q017", "quartz crystal formation", "mineralogy"),
    ("Q024", "aquifer contamination sources", "hydrogeology"), ("Q033", "metamorphic rock foliation", "petrology"),
)
#: Where a search service's answer has its results, and what it calls their fields.
FIELDS = {"results_path": "results", "title": "title", "url": "url", "snippet": "snippet", "score": "score"}


def answer_fields(asked: dict | None = None, **defaults: str) -> dict[str, str]:
    """FIELDS, changed by a service's defaults and then by what a request names; other names, and nulls, change nothing."""
    layers = (FIELDS, defaults, asked or {})
    return {k: next(v for layer in reversed(layers) if (v := layer.get(k)) is not None) for k in FIELDS}


def normalise_answers(answers: DataFrame, fields: dict[str, str] = FIELDS) -> DataFrame:
    """query_id, rank, title, url, normalized_url, snippet, score of the results in answers(query_id, body), JSON texts. Results that are no
    objects are passed over; one without a rank has that of its place. An answer without a list where results should be fails."""
    path = fields["results_path"]
    raw = F.get_json_object("body", f"$.{path}")
    items = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>"))
    items = F.coalesce(items, F.raise_error(F.lit(f"an answer has no list at {path}")).cast("array<string>"))
    rows = answers.select("query_id", F.posexplode(items).alias("place", "item")).where(F.ltrim("item").startswith("{"))
    got = rows.withColumn("item", F.from_json("item", "map<string,string>"))
    text = lambda name: F.coalesce(F.element_at("item", F.lit(fields[name])), F.lit(""))
    rank = F.coalesce(F.expr("nullif(try_cast(element_at(item, 'rank') as int), 0)"), F.col("place") + 1)
    score = F.coalesce(text("score").try_cast("double"), F.lit(0.0))
    return got.select("query_id", rank.alias("rank"), text("title").alias("title"), text("url").alias("url"), urls.page_url_of(text("url")).alias("normalized_url"), text("snippet").alias("snippet"), score.alias("score"))


def relevance(value: int) -> int:
    if value not in (0, 1, 2):
        raise ValueError("relevance is 0, 1 or 2")
    return value


def upstream_error(status: int, body: str) -> tuple[int, str]:
    """The status and message that a failed request upstream is passed on with: errors of the request as they are, others as 502."""
    try:
        detail = json.loads(body).get("detail", body)
    except (ValueError, AttributeError):
        detail = body
    return (status if 400 <= status < 500 else 502), str(detail or "the service upstream failed")[:500]


def demo_list(spark: SparkSession, path: str) -> list[dict]:
    """The demo queries of a benchmark file, or the fixed ones if there is no such file."""
    columns = ("query_id", "query_text", "topic")
    if not Path(path).exists():
        return [dict(zip(columns, q, strict=True)) for q in DEMO]
    return [r.asDict() for r in files.demo_queries(files.read_benchmark(spark, path)).select(*columns).orderBy("query_id").collect()]


def fan_out(engine: SearchEngine, queries: DataFrame, expansion: str = "association", k: int = 10, build: Build | None = None, external: DataFrame | None = None) -> DataFrame:
    """panel, query_id, rank, title, url, score: what one search shows side by side, as one table: each served method, the expanded query's
    results, those that a cluster build's three clusterings put in order, and normalised results of external engines(engine, query_id, ...)."""
    columns = ["panel", "query_id", "rank", "title", "url", "score"]
    found = engine.compare(queries, SERVED, k).withColumnRenamed("method", "panel").select(*columns)
    found = found.unionByName(engine.expand_and_search(queries, expansion, "hits", k).withColumn("panel", F.lit("expanded")).select(*columns))
    if build is not None:
        hits = materialise(engine.rank(engine.terms(queries), "hits", k), "fan-hits")
        vectors = build.projection.transform(queries.select(F.col("query_id").alias("doc_id"), F.col("query").alias("text"))).withColumnRenamed("doc_id", "query_id")
        for method in CLUSTERINGS:
            again = build.rerank(hits, vectors, method)[0].join(engine.index.docs.select("doc_id", "title", "url"), "doc_id")
            found = found.unionByName(again.withColumn("panel", F.lit(f"clustered_{method}")).select(*columns))
    if external is not None:
        found = found.unionByName(external.select(F.col("engine").alias("panel"), "query_id", "rank", "title", "url", F.lit(None).cast("double").alias("score")))
    return found


class Latest:
    """Tells the answer to the newest request from those to older ones."""

    def __init__(self) -> None:
        self._next, self._lock = 0, threading.Lock()

    def ask(self) -> int:
        with self._lock:
            self._next += 1
            return self._next

    def is_current(self, request: int) -> bool:
        return request == self._next


class Jobs:
    """Jobs in the background, each with a state file; states go from queued over running to completed or failed."""

    def __init__(self, folder: str, workers: int = 1) -> None:
        self.folder, self.pool, self.lock = Path(folder), ThreadPoolExecutor(workers), threading.Lock()
        self.futures: dict[str, Future] = {}

    def _state(self, job: str, **more) -> dict:
        path = self.folder / job / "state.json"
        with self.lock:
            state = {**(files.read_json(path) if path.exists() else {"id": job}), **more, "updated_at": datetime.now(timezone.utc).isoformat()}
            files.write_json(path, state)
        return state

    def start(self, work: Callable[[str], Any], job: str | None = None) -> dict:
        job = job or uuid.uuid4().hex[:12]
        state = self._state(job, status="queued")

        def run() -> Any:
            self._state(job, status="running")
            try:
                out = work(str(self.folder / job))
            except Exception as e:
                self._state(job, status="failed", error=f"{type(e).__name__}: {e}")
                raise
            self._state(job, status="completed")
            return out

        self.futures[job] = self.pool.submit(run)
        return state

    def status(self, job: str) -> dict | None:
        path = self.folder / job / "state.json"
        return files.read_json(path) if path.exists() else None

    def newest(self) -> str | None:
        """The completed job that was last updated."""
        done = [s for p in self.folder.glob("*/state.json") if (s := files.read_json(p)).get("status") == "completed"]
        return max(done, key=lambda s: s["updated_at"])["id"] if done else None

    def health(self) -> dict:
        return {"status": "ok", "running": sum(not f.done() for f in self.futures.values()), "current": self.newest()}
