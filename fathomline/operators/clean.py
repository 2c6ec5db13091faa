"""Which pages a corpus takes: filters with reasons, greedy de-duplication, balanced samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..shared import discard, materialise

# What marks a page of low value. URLs are lower-cased before they are compared, so that "return_to=%2F" never fits.
LOW_URLS = ("telegram.me/share", "pinterest.com", "apps.apple.com", "itunes.apple.com", "wordpress.com/abuse", "localization?currency=", "return_to=%2F", "replytocom=", "/share?", "facebook.com/share")
LOW_TITLES = ("Attention Required! | Cloudflare", "App Store", "Enable cookies", "Blocked", "Just a moment")
LOW_TEXTS = ("cloudflare ray id", "please enable cookies", "performance & security by cloudflare", "share with others", "click to reveal")
LEAST_CHARS, MOST_CHARS, MOST_TITLE = 150, 8000, 512
DOMAIN_CAP, SAMPLE_CAP, SEED = 1000, 30_000, 42


def _any(column: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(column, F.lit(p))
    return out


def is_low_value(url: Column, title: Column, text: Column) -> Column:
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return _any(low(url), LOW_URLS) | _any(low(title), [t.lower() for t in LOW_TITLES]) | _any(low(text), LOW_TEXTS)


def with_reasons(pages: DataFrame) -> DataFrame:
    """pages(url, title, text, content_type, status, depth) with cleaned columns and `reason`: the first filter that a page fails, null
    if none. Duplicates aren't looked for yet."""
    kind = tx.content_type(F.col("content_type"))
    base = pages.withColumn("content_type", kind).withColumn("normalized_url", urls.page_url_of(F.col("url")))
    base = base.withColumn("title", tx.clean(F.col("title"), MOST_TITLE)).withColumn("text", tx.clean(F.col("text"), MOST_CHARS))
    reason = (
        F.when(F.coalesce("status", F.lit(0)) != 200, "non_200")
        .when((F.col("content_type") != "") & (F.col("content_type") != "text/html"), "non_html")
        .when(F.col("normalized_url") == "", "missing_url")
        .when(F.length("text") < LEAST_CHARS, "short_text")
        .when(is_low_value(F.col("normalized_url"), F.col("title"), F.col("text")), "low_value")
        .when(~tx.is_english(F.concat_ws(" ", "title", "text")), "non_english")
    )
    return base.withColumn("reason", reason)


def keep_first(rows: DataFrame, order: str, url: str = "normalized_url", text_hash: str = "text_hash") -> DataFrame:
    """rows with `kept` and `duplicate` (url, text or null): in the given order a row is kept unless an earlier kept row has its URL or its
    text hash. A null key repeats no other.

    Rows that share no key with another are kept at once; the others are folded in order, one connected group of keys at a time."""
    keys = rows.select(F.col(order).alias("row"), F.explode(F.array(F.concat(F.lit("u"), F.col(url)), F.concat(F.lit("t"), F.col(text_hash)))).alias("key"))
    low = materialise(keys.groupBy("key").agg(F.min("row").alias("low"), F.count(F.lit(1)).alias("n")), "first-keys")
    keys = materialise(keys.join(low.where("n > 1").select("key"), "key"), "first-shared")
    # Smallest row that shared keys reach. A round takes a label over from the neighbours, and then the label's own label, so that
    # rounds grow with the logarithm of a group's diameter.
    labels = materialise(keys.select("row", F.col("row").alias("label")).distinct(), "first-labels")
    while True:
        of_key = keys.join(labels, "row").groupBy("key").agg(F.min("label").alias("label"))
        new = keys.join(of_key, "key").groupBy("row").agg(F.min("label").alias("label"))
        near = materialise(new, "first-near")
        further = near.select(F.col("row").alias("label"), F.col("label").alias("new"))
        both = materialise(near.join(further, "label").select("row", F.col("new").alias("label")), "first-labels")
        moved = not both.join(labels.withColumnRenamed("label", "was"), "row").where("label <> was").isEmpty()
        discard(near, labels)
        labels = both
        if not moved:
            break
    grouped = rows.select(F.col(order).alias("row"), F.col(url).alias("u"), F.col(text_hash).alias("t")).join(labels, "row")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, seen_urls, seen_texts = object(), set(), set()
        for pdf in batches:
            out = []
            for label, row, u, t in pdf[["label", "row", "u", "t"]].itertuples(index=False):
                if label != group:
                    group, seen_urls, seen_texts = label, set(), set()
                why = "url" if u in seen_urls else "text" if t in seen_texts else None
                if why is None:
                    seen_urls.update(k for k in (u,) if k is not None)
                    seen_texts.update(k for k in (t,) if k is not None)
                out.append((row, why))
            yield pd.DataFrame(out, columns=["row", "duplicate"])

    # A group goes by in order, a batch at a time; its task holds the keys that were kept.
    folded = grouped.repartition("label").sortWithinPartitions("label", "row").mapInPandas(fold, f"row {dict(rows.dtypes)[order]}, duplicate string")
    return rows.join(folded.withColumnRenamed("row", order), order, "left").withColumn("kept", F.col("duplicate").isNull())


def keep_first_text(rows: DataFrame, order: str, text_hash: Column) -> DataFrame:
    """The fast path where URLs differ anyway: of equal texts the first row stays."""
    return rows.groupBy(text_hash.alias("text_hash")).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("n_rows"))


def load_corpus(pages: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """The records of a corpus, and the number of pages for each reason (kept among them)."""
    marked = materialise(with_reasons(pages).withColumn("text_hash", tx.text_hash(F.col("text"))), "corpus-marked")
    judged = materialise(keep_first(marked.where("reason is null"), order), "corpus-judged")
    records = judged.where("kept").withColumn("domain", urls.netloc(F.col("normalized_url"))).withColumn("content_type", F.when(F.col("content_type") == "", "text/html").otherwise(F.col("content_type")))
    reasons = marked.where("reason is not null").select("reason").unionByName(judged.select(F.coalesce(F.concat(F.lit("duplicate_"), "duplicate"), F.lit("kept")).alias("reason")))
    columns = ["normalized_url", "url", "title", "text", "domain", "content_type", "depth", "status"]
    return records.select(order, *columns, tx.clustering_text(F.col("title"), F.col("text")).alias("clustering_text")), reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def balanced_sample(records: DataFrame, domain: str, key: str, domain_cap: int = DOMAIN_CAP, cap: int = SAMPLE_CAP, seed: int = SEED) -> DataFrame:
    """Up to domain_cap records of each domain and cap in all, dealt out in rounds over the domains; chance is a hash of the seed. The cap is
    what a sample is for."""
    chance = lambda c: F.md5(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string")))
    turn = F.row_number().over(Window.partitionBy(domain).orderBy(chance(key), key))
    dealt = records.withColumn("turn", turn).where(F.col("turn") <= domain_cap)
    return dealt.orderBy("turn", chance(domain), domain).limit(cap)


def corpus_report(records: DataFrame, domain: str = "domain", most: int = 15) -> DataFrame:
    """The largest domains, each with the number of all records and domains."""
    per = records.groupBy(domain).agg(F.count(F.lit(1)).alias("n_records"))
    totals = per.agg(F.coalesce(F.sum("n_records"), F.lit(0)).alias("records_kept"), F.count(F.lit(1)).alias("unique_domains"))
    return per.orderBy(F.desc("n_records"), domain).limit(most).crossJoin(F.broadcast(totals))


def raw_graph_stats(edges: DataFrame) -> DataFrame:
    """Rows of edges(src_url, dst_url), and different URLs among their normalised ends."""
    ends = edges.select(F.explode(F.array("src_url", "dst_url")).alias("url")).distinct().select(urls.page_url_of(F.col("url")).alias("url")).where("url <> ''")
    return edges.agg(F.count(F.lit(1)).alias("edges")).crossJoin(F.broadcast(ends.agg(F.countDistinct("url").alias("graph_nodes"))))
