"""The registered queries and their SQL."""

from __future__ import annotations

from .queries import clusters, expansion, pages, search

_MODULES = (search, pages, expansion, clusters)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}

#: Numbers of rows in an order are integers here and bigints in DuckDB: columns of the SQL that are cast, by query.
_PLACES = {
    **dict.fromkeys(("bm25_topk", "tfidf_topk", "format_hits", "pagerank_rerank", "tfidf_pagerank", "tfidf_hits", "compare_models", "external_results", "assoc_terms", "assoc_normalized", "scalar_terms"), ("rank",)),
    **dict.fromkeys(("metric_terms", "rocchio_terms", "association_table", "scalar_table", "metric_table", "cluster_reps", "drill_down"), ("rank",)),
    **dict.fromkeys(("graph_hubs_authorities", "cluster_facets", "example_pick"), ("place",)),
    "balanced_sample": ("turn",),
    "cluster_centroids": ("dim",),
    "cluster_rerank": ("rank", "baseline_rank", "rank_delta"),
}


def _typed(name: str, sql: str) -> str:
    if name not in _PLACES:
        return sql
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in _PLACES[name])}) FROM ({sql}) AS rows_of_query"


ORACLE_SQL: dict[str, str] = {k: _typed(k, s) for m in _MODULES for k, s in m.ORACLE_SQL.items()}
