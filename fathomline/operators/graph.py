"""The page graph: construction, statistics, PageRank, HITS, crawl levels."""

from __future__ import annotations

import html
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import discard, materialise

DAMPING, ROUNDS, TOLERANCE = 0.85, 100, 1e-6
HITS_ROUNDS, ROOT_SIZE, NEIGHBOURS = 50, 200, 50


def distinct_edges(edges: DataFrame) -> DataFrame:
    """src, dst once each, without loops."""
    return edges.where("src <> dst").select("src", "dst").distinct()


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    return distinct_edges(edges.select("src", "dst").unionByName(more.select("src", "dst")))


def build_graph(docs: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(id) and edges(src, dst): docs(doc_id, url), links(src_url, dst_url) between known pages."""
    src = docs.select(F.col("url").alias("src_url"), F.col("doc_id").alias("src"))
    dst = docs.select(F.col("url").alias("dst_url"), F.col("doc_id").alias("dst"))
    return docs.select(F.col("doc_id").alias("id")), distinct_edges(links.join(src, "src_url").join(dst, "dst_url"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree of all nodes."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    sums = ends.groupBy("e.id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))
    return nodes.join(sums, "id", "left").select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, the largest degrees with their nodes (the smallest id of equals), mean out-degree."""
    first = lambda c: F.max_by("id", F.struct(F.col(c), -F.col("id")))
    return degrees(nodes, edges).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum("out_degree").alias("n_edges"), F.max("in_degree").alias("max_in_degree"), first("in_degree").alias("max_in_node"),
        F.max("out_degree").alias("max_out_degree"), first("out_degree").alias("max_out_node"), F.round(F.sum("out_degree") / F.count(F.lit(1)), 2).alias("avg_out_degree"),
    )


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float | None = TOLERANCE) -> DataFrame:
    """id, score: uniform start and teleport, dangling mass spread over all nodes; ends after `rounds`, or once scores move by less than the
    tolerance in all (None: never before).

    A round sends shares along edges that are kept with their source's degree, so it costs a join and an aggregate, written to the shared
    folder; the dangling mass and the change are sums over what was written, and go to the driver as two numbers."""
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    sink = nodes.select("id").distinct().join(degree.select(F.col("src").alias("id"), F.lit(False).alias("sink")), "id", "left").select("id", F.coalesce("sink", F.lit(True)).alias("sink"))
    nodes = materialise(sink, "pr-nodes")
    n, sinks = nodes.agg(F.count(F.lit(1)), F.count_if("sink")).first()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("score"))
    shares = materialise(edges.join(degree, "src").select("src", "dst", "degree"), "pr-shares")
    scores, lost, both = nodes.withColumn("score", F.lit(1.0 / n)), sinks / n, None
    for _ in range(rounds):
        sent = shares.join(scores, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("score") / F.col("degree")).alias("got"))
        new = damping * (F.coalesce("got", F.lit(0.0)) + lost / n) + (1 - damping) / n
        last, both = both, materialise(scores.join(sent, F.col("id") == F.col("to"), "left").select("id", "sink", F.col("score").alias("was"), new.alias("score")), "pr-scores")
        if last is not None:
            discard(last)
        scores = both.select("id", "sink", "score")
        moved, lost = both.agg(F.sum(F.abs(F.col("score") - F.col("was"))), F.coalesce(F.sum(F.when(F.col("sink"), F.col("score"))), F.lit(0.0))).first()
        if tolerance is not None and moved < tolerance:
            break
    return scores.select("id", "score")


def root_set(postings: DataFrame, terms: DataFrame, most: int = ROOT_SIZE) -> DataFrame:
    """query_id, doc_id: the documents with the largest sum of term frequencies; a repeated query term counts as often as it stands."""
    sums = postings.join(terms, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("tf") * F.col("qtf")).alias("tf_sum"))
    order = Window.partitionBy("query_id").orderBy(F.desc("tf_sum"), "doc_id")
    return sums.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("query_id", "doc_id")


def base_set(roots: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = NEIGHBOURS) -> DataFrame:
    """query_id, doc_id: the roots and up to `most` neighbours of each in either direction (those with the smallest ids), as far as they are nodes."""
    own = Window.partitionBy("node").orderBy("other")
    sides = [edges.select(F.col(a).alias("node"), F.col(b).alias("other")) for a, b in (("dst", "src"), ("src", "dst"))]
    root_nodes = roots.select(F.col("doc_id").alias("node")).distinct()
    near = [s.join(root_nodes, "node", "left_semi").withColumn("n", F.row_number().over(own)).where(F.col("n") <= most).drop("n") for s in sides]
    added = roots.join(near[0].unionByName(near[1]), F.col("doc_id") == F.col("node")).select("query_id", F.col("other").alias("doc_id"))
    return roots.unionByName(added).distinct().join(nodes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("query_id", "doc_id")


def induced_edges(base: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, src, dst: edges between nodes of a query's base set."""
    a = base.select("query_id", F.col("doc_id").alias("src"))
    b = base.select("query_id", F.col("doc_id").alias("dst"))
    return edges.join(a, "src").join(b, ["query_id", "dst"]).select("query_id", "src", "dst")


def hits_scores(ids: np.ndarray, src: np.ndarray, dst: np.ndarray, rounds: int = HITS_ROUNDS, tolerance: float | None = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Authority and hub of each id (sorted). Both are updated from the round before."""
    n = len(ids)
    s, d = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    auth, hub = np.ones(n), np.ones(n)
    for _ in range(rounds):
        new_auth, new_hub = np.bincount(d, hub[s], n), np.bincount(s, auth[d], n)
        new_auth, new_hub = (x / norm if (norm := np.linalg.norm(x)) > 0 else x for x in (new_auth, new_hub))
        still = tolerance is not None and np.abs(new_auth - auth).sum() < tolerance and np.abs(new_hub - hub).sum() < tolerance
        auth, hub = new_auth, new_hub
        if still:
            break
    return auth, hub


def hits(base: DataFrame, edges: DataFrame, rounds: int = HITS_ROUNDS, tolerance: float | None = TOLERANCE) -> DataFrame:
    """query_id, doc_id, authority, hub. A query's base set has at most 200 * 101 nodes, so that one task holds it.

    Only edges between nodes of some base set count. Each node takes its targets among these along as one array, no longer than the
    base sets together, and the task drops those outside its own set: queries that share pages make no row for each query and edge."""
    some = base.select("doc_id").distinct()
    inner = edges.join(some.withColumnRenamed("doc_id", "src"), "src", "left_semi").join(some.withColumnRenamed("doc_id", "dst"), "dst", "left_semi")
    lists = inner.groupBy("src").agg(F.collect_list("dst").alias("out"))
    rows = base.select("query_id", "doc_id").join(lists, F.col("doc_id") == F.col("src"), "left").select("query_id", "doc_id", "out")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        ids = pdf["doc_id"].to_numpy(np.int64)
        lists = [np.asarray(x, np.int64) if x is not None else np.zeros(0, np.int64) for x in pdf["out"]]
        src, dst = np.repeat(ids, [len(x) for x in lists]), np.concatenate(lists)
        inside = ids[np.minimum(np.searchsorted(ids, dst), len(ids) - 1)] == dst
        auth, hub = hits_scores(ids, src[inside], dst[inside], rounds, tolerance)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "doc_id": ids, "authority": auth, "hub": hub})

    return rows.groupBy("query_id").applyInPandas(run, f"query_id {dict(base.dtypes)['query_id']}, doc_id long, authority double, hub double")


def rank_hits(scores: DataFrame, k: int, by: str = "authority") -> DataFrame:
    from .rank import top_k

    return top_k(scores.select("query_id", "doc_id", F.col(by).alias("score")), k)


def degree_subgraph(nodes: DataFrame, edges: DataFrame, least: int = 5, most: int = 800) -> DataFrame:
    """Edges between the `most` nodes with the largest degree, of those with `least` or more; the cap keeps a drawing readable."""
    total = F.col("in_degree") + F.col("out_degree")
    kept = degrees(nodes, edges).where(total >= least).orderBy(total.desc(), "id").limit(most)
    kept = materialise(kept.select("id"), "subgraph-nodes")
    return edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def hubs_and_authorities(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """kind (hub, authority), place, id, degree: the nodes with the most edges out and in."""
    d = materialise(degrees(nodes, edges), "degrees")
    out = []
    for kind, column in (("hub", "out_degree"), ("authority", "in_degree")):
        best = d.select("id", F.col(column).alias("degree")).orderBy(F.desc("degree"), "id").limit(most)
        out.append(best.select(F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy(F.desc("degree"), "id")).alias("place"), "id", "degree"))
    return out[0].unionByName(out[1])


def graph_page(edges: DataFrame, path: str, title: str = "Graph") -> None:
    """A page with a drawing of edges(src, dst), nodes on a circle in the order of their ids, that shows a node's links on pointing at it. For
    a subgraph that is small enough to look at, such as degree_subgraph's, whose rows come to the driver."""
    pairs = sorted({(r["src"], r["dst"]) for r in edges.select("src", "dst").collect()})
    ids = sorted({x for p in pairs for x in p})
    at = {x: (500 + 470 * np.cos(2 * np.pi * k / len(ids)), 500 + 470 * np.sin(2 * np.pi * k / len(ids))) for k, x in enumerate(ids)}
    lines = "".join(f'<line class="n{a} n{b}" x1="{at[a][0]:.1f}" y1="{at[a][1]:.1f}" x2="{at[b][0]:.1f}" y2="{at[b][1]:.1f}"/>' for a, b in pairs)
    dots = "".join(f'<circle data-id="{x}" cx="{at[x][0]:.1f}" cy="{at[x][1]:.1f}" r="4"><title>{x}</title></circle>' for x in ids)
    script = "document.querySelectorAll('circle').forEach(c=>{const ls=document.querySelectorAll('.n'+c.dataset.id);c.onmouseenter=()=>ls.forEach(l=>l.classList.add('on'));c.onmouseleave=()=>ls.forEach(l=>l.classList.remove('on'))})"
    style = "line{stroke:#999;stroke-opacity:.25}line.on{stroke:#c30;stroke-opacity:1}circle{fill:#246}"
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<!doctype html><title>{html.escape(title)}</title><style>{style}</style><svg viewBox="0 0 1000 1000">{lines}{dots}</svg><script>{script}</script>')


def dead_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without edges out, and those without any."""
    d = degrees(nodes, edges)
    return d.agg(F.count_if(F.expr("out_degree = 0")).alias("dead_ends"), F.count_if(F.expr("out_degree = 0 and in_degree = 0")).alias("isolates"))


def crawl_levels(edges: DataFrame, seeds: DataFrame, most_depth: int, allowed: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """id, depth: breadth-first from seeds(id), a level at a time, each node at its least depth. Edges of the last level aren't followed."""
    frontier = materialise(allowed(seeds.select("id").distinct()), "crawl-level")
    visited = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, most_depth + 1):
        found = edges.join(frontier.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = materialise(allowed(found.join(visited, "id", "left_anti")), "crawl-level")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.withColumn("depth", F.lit(depth)))
    return visited
