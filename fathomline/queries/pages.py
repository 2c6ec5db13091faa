"""Queries over pages: HTML, URLs, cleaning, corpora, samples, crawls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, urls
from ..functions import text as tx
from ..operators import clean, graph
from ..shared import shared_path
from ..sources import files
from ..streaming import crawl
from . import base as b


def html_title_regex(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", html.title_of(F.col("html")).alias("title"))


def html_text(spark, sf):
    parsed = html.parse_pages(b.table(spark, sf, "pages"))
    return parsed.select("page_id", "title", "text", html.has_content(F.col("text")).alias("has_content"))


def html_links(spark, sf):
    """Links of the pages and of some more that a crawl follows or doesn't: nested pages, the same page under another name, a file, a login."""
    more = ['<a href="/geology/', "?b=2&amp;a=1#top\">1</a><a href='rocks/../volcano//x'>2</a><a href=\"/geology/", '?a=1&amp;b=2">3</a><a href="fault.pdf">4</a><a href="/login/fault">5</a>']
    i = F.col("page_id").cast("string")
    pages = b.table(spark, sf, "pages").withColumn("html", F.concat(F.lit(more[0]), i, F.lit(more[1]), i, F.lit(more[2]), F.coalesce("html", F.lit(""))))
    return html.page_links(html.parse_pages(pages))


def url_normalize(spark, sf):
    url = F.col("url")
    return b.table(spark, sf, "pages").select("page_id", urls.crawl_url_of(url).alias("crawl_url"), urls.visited_url_of(url).alias("visited_url"), urls.page_url_of(url).alias("page_url"))


def url_domain_hist(spark, sf):
    return b.table(spark, sf, "pages").groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("n_urls")).orderBy(F.desc("n"), "domain").limit(20)


def link_allowed(spark, sf):
    """Every other URL is about the crawl's subject, every fifth is a file, every seventh a login."""
    i = F.col("page_id")
    url = F.concat("url", F.when(i % 5 == 0, "/map.PDF").otherwise(""), F.when(i % 7 == 0, "/login").otherwise(""), F.when(i % 2 == 0, "&topic=Geology").otherwise(""))
    return b.table(spark, sf, "pages").select("page_id", urls.is_link_allowed(url).alias("allowed"))


def clean_text(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", F.md5(tx.clean(F.col("text"), clean.MOST_CHARS)).alias("clean_md5"), F.length(tx.clean(F.col("text"), clean.MOST_CHARS)).cast("long").alias("n"))


def clustering_text(spark, sf):
    title = F.element_at(F.split("text", "\n"), 1)
    return b.table(spark, sf, "documents").select("doc_id", F.md5(tx.clustering_text(title, F.col("text"))).alias("text_md5"))


def language_gate(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", tx.is_english(F.col("text")).alias("english"))


def content_gate(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", html.has_content(F.col("text")).alias("has_content"))


def text_hashes(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", tx.text_hash(F.col("text")).alias("text_sha1"))


def previews(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", tx.preview(F.col("text")).alias("preview"), tx.snippet(F.col("text")).alias("snippet"))


def json_paths(spark, sf):
    return b.table(spark, sf, "events").select("event_id", tx.nested_get(F.col("props"), "k").alias("k"), tx.nested_get(F.col("props"), "none.such").alias("missing"))


def low_value_filter(spark, sf):
    d = b.corpus(spark, sf)
    return d.select("doc_id", clean.is_low_value(F.col("url"), F.col("title"), F.col("text")).alias("low_value"))


def _records(spark, sf):
    return clean.with_reasons(b.mixed_pages(spark, sf))


def reject_reasons(spark, sf):
    return _records(spark, sf).groupBy(F.coalesce("reason", F.lit("passed")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def corpus_counts(spark, sf):
    return clean.load_corpus(b.corpus(spark, sf), "doc_id")[1]


def corpus_report(spark, sf):
    records, _ = clean.load_corpus(b.corpus(spark, sf), "doc_id")
    return clean.corpus_report(records)


def text_hash_dedup(spark, sf):
    return clean.keep_first_text(b.table(spark, sf, "documents"), "doc_id", F.md5("text"))


def greedy_dedup(spark, sf):
    """URL and text keys both repeat: sources stand in for URLs of near texts."""
    d = b.table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), F.left("text", F.lit(12))).alias("normalized_url"), F.md5("text").alias("text_hash"))
    return clean.keep_first(d, "doc_id").select("doc_id", "kept", "duplicate")


def visited_filter(spark, sf):
    """Whether each page's URL is new to a crawl that takes pages in order of their ids."""
    return crawl.first_visits(b.table(spark, sf, "pages").select("page_id", "url"), "page_id").select("page_id", "fresh")


def unvisited_links(spark, sf):
    """Of all pages' URLs in upper case and with a fragment, and a new one beside each: those that no page has."""
    pages = b.table(spark, sf, "pages")
    links = pages.select(F.explode(F.array(F.concat("url", F.lit("#x")), F.concat(F.regexp_replace("url", "[#?].*$", ""), F.lit("/new/")))).alias("url"))
    return crawl.new_urls(links, pages).select(urls.visited_url_of(F.col("url")).alias("url"))


def balanced_sample(spark, sf):
    return clean.balanced_sample(b.table(spark, sf, "documents"), "source", "doc_id").select("doc_id", "source", "turn")


def raw_graph_stats(spark, sf):
    pages = b.table(spark, sf, "pages")
    return clean.raw_graph_stats(pages.select(F.col("url").alias("src_url"), F.regexp_replace("url", "[#?].*$", "").alias("dst_url")))


def last_doc_of_url(spark, sf):
    pages = b.table(spark, sf, "pages").select(F.regexp_replace("url", "[#?].*$", "").alias("url"), F.col("page_id").alias("doc_id"))
    return files.last_doc_of_url(pages)


def external_results(spark, sf):
    rows = b.table(spark, sf, "pages").select(
        F.when(F.col("page_id") % 2 == 0, "a").otherwise("b").alias("engine"), F.col("page_id").alias("position"), F.when(F.col("page_id") % 5 > 0, html.title_of(F.col("html"))).alias("title"),
        F.when(F.col("page_id") % 7 > 0, F.col("url")).alias("link"), F.lit(None).cast("string").alias("displayed_link"), F.lit(None).cast("string").alias("snippet"), urls.domain(F.col("url")).alias("source"),
    )
    return files.normalise_external(rows)


def crawl_stats(spark, sf):
    pages = b.table(spark, sf, "pages")
    return files.crawl_stats(pages, b.part_graph(spark, sf)[1]).drop("timestamp")


def bfs_levels(spark, sf):
    nodes, edges = b.part_graph(spark, sf)
    return graph.crawl_levels(edges, nodes.where("id in (1, 2)"), 3)


def crawl_rounds(spark, sf):
    """A crawl of the part graph to the usual depth and number of pages."""
    nodes, edges = b.part_graph(spark, sf)
    return crawl.crawl_plan(edges, nodes.where("id in (1, 2)"))


def politeness(spark, sf):
    return crawl.polite(b.table(spark, sf, "events").select(F.col("user_id").alias("host"), "event_id", "ts"), 3600.0)


def fetch_rules(spark, sf):
    fetched = b.table(spark, sf, "pages").select("page_id", F.lit("Text/HTML; charset=utf-8").alias("content_type"), F.octet_length("html").alias("size_bytes"), F.lit(200).alias("status"))
    return crawl.fetch_rules(fetched, 0.02)


def robots_rules(spark, sf):
    rules = b.table(spark, sf, "pages").select(urls.netloc(F.col("url")).alias("host")).distinct().select("host", F.lit("User-agent: *\nDisallow: /en/\n").alias("robots"))
    return crawl.robots_filter(b.table(spark, sf, "pages").select("page_id", "url"), rules, "fathom").select("page_id", "allowed")


def page_files(spark, sf):
    """Pages appended to files of JSON lines, in two parts, and read again: those with status 200."""
    path, pages = shared_path(spark, "page-files"), b.mixed_pages(spark, sf)
    for part in (0, 1):
        files.append_pages(pages.where(F.col("doc_id") % 2 == part).select("url", "title", "text", "content_type", F.lit("x").alias("crawled_at"), "status", "depth"), path)
    return files.read_pages(spark, path).select("url", tx.text_hash(F.col("text")).alias("text_sha1"), "status", "depth")


def tolerant_files(spark, sf):
    """Lines of which every fifth is broken and every seventh blank: how many were read, and how many of them weren't JSON."""
    path, i = shared_path(spark, "broken-files"), F.col("doc_id")
    line = F.to_json(F.struct("url", "text", F.lit("200").alias("status")))
    b.corpus(spark, sf).select(F.when(i % 7 == 0, " ").when(i % 5 == 0, F.concat(F.lit('{"url": '), line)).otherwise(line)).write.text(path)
    return files.read_pages_tolerant(spark, path)[1]


def edge_files(spark, sf):
    """Edges written as CSV with blanks around names, and read again without those that have an empty end."""
    path, (_, edges) = shared_path(spark, "edge-files"), b.part_graph(spark, sf)
    name = lambda c: F.concat(F.lit("  http://a/"), F.col(c).cast("string"), F.lit(" "))
    files.append_edges(edges.select(name("src").alias("src_url"), F.when(F.col("dst") % 10 > 0, name("dst")).otherwise(" ").alias("dst_url")), path)
    files.append_edges(edges.limit(0).select(F.lit("").alias("src_url"), F.lit("").alias("dst_url")), path)
    return files.read_edges(spark, path, drop_empty=True)


def benchmark_file(spark, sf):
    """Queries written as one JSON list and read again: those to show, and whether they are judged."""
    path, i = shared_path(spark, "benchmark-file"), F.col("item_id")
    rows = b.table(spark, sf, "benchmark").select(F.format_string("Q%03d", i).alias("query_id"), F.col("text").alias("query_text"), F.concat(F.lit("t"), (i % 7).cast("string")).alias("topic"), (i % 2 == 0).alias("judged_subset"), (i % 3 > 0).alias("demo_candidate"))
    rows.agg(F.to_json(F.collect_list(F.struct("*")))).coalesce(1).write.text(path)  # a benchmark is a list of some tens of queries
    queries = files.read_benchmark(spark, path, rows.count())
    judged = files.judged_queries(queries).withColumn("judged", F.lit(True))
    return files.demo_queries(queries).join(judged, "query_id", "left").select("query_id", F.md5("query_text").alias("text_md5"), "topic", F.coalesce("judged", F.lit(False)).alias("judged"))


def observed_crawl(spark, sf):
    """What is counted of pages on their way to a file."""
    pages, seen = crawl.counted(b.mixed_pages(spark, sf).withColumn("depth", (F.col("doc_id") % 9).cast("int")))
    pages.select("url").write.text(shared_path(spark, "observed"))
    got = seen.get
    return spark.range(1).select(*(F.lit(got[k]).cast("long").alias(k) for k in ("pages", "accepted", "depth")))


def arrivals(spark, sf):
    """Pages that arrive as files in two batches of a stream, indexed as they come: the documents of each term."""
    folder, out, seen = (shared_path(spark, f"arrivals-{x}") for x in ("in", "out", "check"))
    pages = b.corpus(spark, sf).select("url", "title", "text", "content_type", F.lit("x").alias("crawled_at"), "status", "depth")
    for part in (0, 1):
        files.append_pages(pages.where(F.crc32(F.col("url").cast("binary")) % 2 == part), folder)
        crawl.index_arrivals(crawl.arriving_pages(spark, folder), out, seen).awaitTermination()
    return spark.read.parquet(out).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def stem_surface(spark, sf):
    """The most frequent token of each stem, in previews."""
    from ..operators import expand

    return expand.stem_surfaces(b.corpus(spark, sf), "english")


QUERIES = {f.__name__: f for f in (
    html_title_regex, html_text, html_links, url_normalize, url_domain_hist, link_allowed, clean_text, clustering_text, language_gate, content_gate, text_hashes, previews, json_paths, low_value_filter,
    reject_reasons, corpus_counts, corpus_report, text_hash_dedup, greedy_dedup, visited_filter, balanced_sample, raw_graph_stats, last_doc_of_url, external_results, crawl_stats, bfs_levels, crawl_rounds,
    politeness, fetch_rules, robots_rules, stem_surface, unvisited_links, page_files, tolerant_files, edge_files, benchmark_file, observed_crawl, arrivals,
)}


def _has(column: str, parts) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(column, p.replace("'", "''")) for p in parts) + ")"


_TITLE = r"trim(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1), ' ')"
_CLEAN = r"trim(left(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' '), 8000), ' ')"
_DOMAIN = r"regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '')"
_ENGLISH = "length(s) > 0 AND length(regexp_replace(s, '[^A-Za-z]', '', 'g')) >= greatest(20, length(s) // 10) AND " + " + ".join(f"contains(lower(s), '{w}')::INT" for w in tx.words.ENGLISH_MARKS) + " >= 2"
_LINK = "lower(url || CASE WHEN page_id % 5 = 0 THEN '/map.PDF' ELSE '' END || CASE WHEN page_id % 7 = 0 THEN '/login' ELSE '' END || CASE WHEN page_id % 2 = 0 THEN '&topic=Geology' ELSE '' END)"
_RX = lambda parts: "|".join(p.replace(".", r"\.").replace("/", "/") for p in parts)
_LEVEL = "SELECT DISTINCT dst AS id FROM pe WHERE src IN (SELECT id FROM l{0}) AND dst NOT IN ({1})"

_VISITED = r"regexp_replace(regexp_replace(lower(url), '#.*$', ''), '/+(\?|$)', '\1')"
_PLAIN = "SELECT doc_id, 'https://www.' || source || '.example.org/doc/' || doc_id AS url, 200 AS status, 1 AS depth, 'text/html' AS kind, text FROM documents"
_MIXED = "SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN '' ELSE 'https://www.' || source || '.example.org/doc/' || doc_id END AS url, CASE WHEN doc_id % 11 = 0 THEN 404 ELSE 200 END AS status, 1 AS depth, CASE WHEN doc_id % 13 = 0 THEN 'application/pdf' ELSE 'text/html' END AS kind, text FROM documents"
_REASONS = f"""
rc AS (SELECT *, {_CLEAN} AS t FROM ({{pages}})),
re AS (SELECT *, trim(left(' ' || t, 1000), ' ') AS s FROM rc),
rf AS (SELECT doc_id, url, status, kind, t, ({_ENGLISH}) AS english FROM re),
rs AS (SELECT doc_id, sha1(t) AS s, CASE WHEN status <> 200 THEN 'non_200' WHEN kind <> 'text/html' THEN 'non_html' WHEN url = '' THEN 'missing_url' WHEN length(t) < {clean.LEAST_CHARS} THEN 'short_text'
  WHEN {_has('lower(t)', clean.LOW_TEXTS)} THEN 'low_value' WHEN NOT english THEN 'non_english' END AS reason FROM rf)"""

ORACLE_SQL = {
    "html_title_regex": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "url_domain_hist": f"SELECT {_DOMAIN} AS domain, count(*) AS n, count(DISTINCT url) AS n_urls FROM pages GROUP BY 1 ORDER BY n DESC, domain LIMIT 20",
    "link_allowed": rf"SELECT page_id, regexp_matches({_LINK}, '^https?:') AND NOT regexp_matches(regexp_extract({_LINK}, '^https?://[^/?#]*([^?#]*)', 1), '({_RX(urls.BINARY)})$') AND NOT {_has(_LINK, urls.JUNK)} AND {_has(_LINK, urls.FOCUS)} AS allowed FROM pages",
    "clean_text": f"SELECT doc_id, md5({_CLEAN}) AS clean_md5, length({_CLEAN})::BIGINT AS n FROM documents",
    "clustering_text": r"SELECT doc_id, md5(CASE WHEN t <> '' THEN t || ' ' || t || ' ' || t || ' ' || text ELSE text END) AS text_md5 FROM (SELECT *, trim(split_part(text, chr(10), 1), ' ') AS t FROM documents)",
    "language_gate": f"SELECT doc_id, {_ENGLISH} AS english FROM (SELECT doc_id, trim(left(text, 1000), ' ') AS s FROM documents)",
    "content_gate": f"SELECT doc_id, {_has('lower(text)', html.CONTENT)} AS has_content FROM documents",
    "text_hashes": "SELECT doc_id, sha1(text) AS text_sha1 FROM documents",
    "previews": "SELECT doc_id, left(text, 500) AS preview, left(text, 300) AS snippet FROM documents",
    "json_paths": "SELECT event_id, props ->> '$.k' AS k, props ->> '$.none.such' AS missing FROM events",
    "low_value_filter": f"SELECT doc_id, {_has('lower(text)', clean.LOW_TEXTS)} AS low_value FROM documents",
    "greedy_dedup": """
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, source || '/' || left(text, 12) AS u, md5(text) AS t FROM documents),
g(n, doc_id, duplicate, urls, texts) AS (
    SELECT 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, []::VARCHAR[], []::VARCHAR[]
    UNION ALL
    SELECT x.n, x.doc_id, x.why, CASE WHEN why IS NULL THEN list_append(urls, u) ELSE urls END, CASE WHEN why IS NULL THEN list_append(texts, t) ELSE texts END
    FROM (SELECT d.*, urls, texts, CASE WHEN list_contains(urls, u) THEN 'url' WHEN list_contains(texts, t) THEN 'text' END AS why FROM g JOIN d ON d.n = g.n + 1) x)
SELECT doc_id, duplicate IS NULL AS kept, duplicate FROM g WHERE n > 0""",
    "text_hash_dedup": "SELECT md5(text) AS text_hash, min(doc_id) AS doc_id, count(*) AS n_rows FROM documents GROUP BY 1",
    "url_normalize": rf"SELECT page_id, {_VISITED} AS crawl_url, {_VISITED} AS visited_url, regexp_replace({_VISITED}, '\?utm_[a-z]+=[a-z]*$', '') AS page_url FROM pages",
    "visited_filter": f"SELECT page_id, page_id = min(page_id) OVER (PARTITION BY {_VISITED}) AS fresh FROM pages",
    "unvisited_links": f"SELECT DISTINCT url FROM (SELECT regexp_replace(url, '[#?].*$', '') || '/new' AS url FROM pages) WHERE url NOT IN (SELECT {_VISITED} FROM pages)",
    "balanced_sample": f"WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS turn FROM documents) SELECT doc_id, source, turn FROM d WHERE turn <= {clean.DOMAIN_CAP} ORDER BY turn, md5('42:' || source), source LIMIT {clean.SAMPLE_CAP}",
    "reject_reasons": f"WITH {_REASONS.format(pages=_MIXED)} SELECT coalesce(reason, 'passed') AS reason, count(*) AS n FROM rs GROUP BY 1",
    "corpus_counts": f"WITH {_REASONS.format(pages=_PLAIN)} SELECT coalesce(reason, CASE WHEN doc_id = first THEN 'kept' ELSE 'duplicate_text' END) AS reason, count(*) AS n FROM rs LEFT JOIN (SELECT s, min(doc_id) AS first FROM rs WHERE reason IS NULL GROUP BY s) USING (s) GROUP BY 1",
    "corpus_report": f"WITH {_REASONS.format(pages=_PLAIN)}, k AS (SELECT min(doc_id) AS doc_id FROM rs WHERE reason IS NULL GROUP BY s), p AS (SELECT 'www.' || source || '.example.org' AS domain, count(*) AS n_records FROM k JOIN documents USING (doc_id) GROUP BY 1) SELECT domain, n_records, (SELECT sum(n_records)::BIGINT FROM p) AS records_kept, (SELECT count(*) FROM p) AS unique_domains FROM p ORDER BY n_records DESC, domain LIMIT 15",
    "raw_graph_stats": rf"SELECT count(*) AS edges, (SELECT count(DISTINCT regexp_replace(regexp_replace(lower(u), '(\?utm_[a-z]+=[a-z]*)$', ''), '/+(\?|$)', '\1')) FROM (SELECT regexp_replace(url, '#.*$', '') AS u FROM pages UNION ALL SELECT regexp_replace(url, '[#?].*$', '') FROM pages)) AS graph_nodes FROM pages",
    "politeness": """
WITH RECURSIVE ok AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
  UNION ALL SELECT e.user_id, min(e.ts) FROM ok JOIN events e ON e.user_id = ok.user_id AND epoch_us(e.ts) - epoch_us(ok.ts) >= 3600000000 GROUP BY e.user_id, ok.ts),
f AS (SELECT e.user_id, min(event_id) AS event_id FROM ok JOIN events e ON e.user_id = ok.user_id AND e.ts = ok.ts GROUP BY e.user_id, e.ts)
SELECT user_id AS host, event_id, event_id IN (SELECT event_id FROM f) AS accepted FROM events""",
    "crawl_rounds": f"WITH {b.EDGES}, l0 AS MATERIALIZED (SELECT id FROM pn WHERE id IN (1, 2)), " + ", ".join(f"l{k} AS MATERIALIZED ({_LEVEL.format(k - 1, ' UNION ALL '.join(f'SELECT id FROM l{j}' for j in range(k)))})" for k in range(1, crawl.MOST_DEPTH + 1))
    + ", every AS (" + " UNION ALL ".join(f"SELECT id, {k} AS depth FROM l{k}" for k in range(crawl.MOST_DEPTH + 1)) + f") SELECT id, depth, (row_number() OVER (ORDER BY depth, id))::INT AS place FROM every QUALIFY place <= {crawl.TARGET_PAGES}",
    "html_links": r"SELECT page_id, unnest([1, 2])::INT AS place, unnest([root || '/geology/' || page_id || '?a=1&b=2', CASE WHEN dir = '/' THEN root || '/volcano/x' ELSE root || dir || 'volcano/x' END]) AS link FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://[^/?#]+')) AS root, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '^.*/') AS dir FROM pages)",
    "page_files": f"SELECT url, sha1(text) AS text_sha1, status, depth FROM ({_MIXED}) WHERE status = 200",
    "tolerant_files": "SELECT count(*) AS lines_read, count(*) FILTER (doc_id % 5 = 0) AS json_errors FROM documents WHERE doc_id % 7 <> 0",
    "edge_files": f"WITH {b.EDGES} SELECT 'http://a/' || src AS src_url, 'http://a/' || dst AS dst_url FROM pe WHERE dst % 10 > 0",
    "benchmark_file": "SELECT printf('Q%03d', item_id) AS query_id, md5(text) AS text_md5, 't' || item_id % 7 AS topic, item_id % 2 = 0 AS judged FROM benchmark WHERE item_id % 3 > 0",
    "observed_crawl": f"SELECT count(*) AS pages, count(*) FILTER (status = 200) AS accepted, max(doc_id % 9)::BIGINT AS depth FROM ({_MIXED})",
    "arrivals": f"WITH {b.CTE} SELECT * FROM terms",
    "last_doc_of_url": "SELECT regexp_replace(url, '[#?].*$', '') AS url, max(page_id) AS doc_id FROM pages GROUP BY 1",
    "external_results": f"""
WITH r AS (SELECT CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'b' END AS engine, page_id, {_TITLE} AS title, url, {_DOMAIN} AS display_url FROM pages WHERE page_id % 5 > 0 AND page_id % 7 > 0)
SELECT engine, row_number() OVER (PARTITION BY engine ORDER BY page_id) AS rank, title, url, display_url, '' AS snippet FROM r WHERE title <> '' QUALIFY rank <= 10""",
    "crawl_stats": f"WITH {b.EDGES} SELECT (SELECT count(*) FROM pages) AS total_pages, (SELECT count(*) FROM pe) AS total_edges",
    "bfs_levels": f"WITH {b.EDGES}, l0 AS (SELECT id FROM pn WHERE id IN (1, 2)), l1 AS ({_LEVEL.format(0, 'SELECT id FROM l0')}), l2 AS ({_LEVEL.format(1, 'SELECT id FROM l0 UNION SELECT id FROM l1')}), l3 AS ({_LEVEL.format(2, 'SELECT id FROM l0 UNION SELECT id FROM l1 UNION SELECT id FROM l2')}) "
    + " UNION ALL ".join(f"SELECT id, {k} AS depth FROM l{k}" for k in range(4)),
    "fetch_rules": "SELECT page_id, 'text/html' AS content_type, strlen(html) <= 0.02 * 1000000 AS accepted FROM pages",
    "robots_rules": "SELECT page_id, NOT regexp_matches(url, '^[a-z]+://[^/]+/en/') AS allowed FROM pages",
}
