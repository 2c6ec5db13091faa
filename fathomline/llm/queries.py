"""The queries of this subpackage, and their SQL where SQL can express them. Merged by the entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cdc, common, exact, mixing, piece, quality, simhash, suffix, tokencount, toxicity, urlfilter
from .hash_sql import mod, number, xxh64

#: (action, host, path)
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("allow", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"), urlfilter.rules_frame(spark, URL_RULES))


def standard_edits(docs: DataFrame) -> DataFrame:
    """docs with the edits that the count query applies: the first line's end is marked, 40 characters go at a third of the text, a
    sentence comes in at its middle, and a word at its end."""
    n = F.length(F.coalesce("text", F.lit("")))
    line = F.instr(F.coalesce("text", F.lit("")), "\n") - 1
    first = F.when(line > 0, line).otherwise(0)
    one = lambda start, stop, text: F.struct(F.expr("int(null)").alias("start") if start is None else start.cast("int").alias("start"), F.expr("int(null)").alias("stop") if stop is None else stop.cast("int").alias("stop"), F.lit(text).alias("text"))
    edits = F.array(one(first, first, " (1)"), one(F.floor(n / 3), F.floor(n / 3) + 40, ""), one(F.floor(n / 2), F.floor(n / 2), " This part was revised."), one(None, None, " end"))
    return docs.select("doc_id", "text", edits.alias("edits"))


def op3_token_counts(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return tokencount.count_tokens(standard_edits(_table(spark, sf_dir, "documents")), path, public_tokenizers.PATTERN)


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans as text, lo-hi in order with blanks between."""
    span = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["lo"], x["hi"])), " ")
    return cdc.dedup_chunks(_table(spark, sf_dir, "documents")).withColumn("spans", span)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.group_near(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = exact.dedup_exact(_table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    return piece.digest_pieces(_table(spark, sf_dir, "documents"), model_path or piece_model())


def piece_model() -> str:
    """Path of the vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


QUERIES = {f.__name__: f for f in (op1_mixing, op2_url_filter, op3_token_counts, op4_chunk_dedup, op5_quality_rules, op6_suffix_dedup, op7_simhash_near_dedup, op8_exact_dedup, op9_toxicity, op10_sentencepiece)}

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
_AZ = f"translate({{0}}, '{common.UPPER}', '{common.LOWER}')"

def _suffix_sql(length: int = 400) -> str:
    """Repeats by a digest of each string of `length` bytes; passages by the least hash of a gram in each of their strings. Hashes of grams
    are made by doubling: h2n(i) = h1..n(i) * base ** n + hn(i + n)."""
    base, passage, gram = 0x9E3779B97F4A7C15, suffix.PASSAGE, suffix.PASSAGE_GRAM
    power = lambda n: number(pow(base, n, 1 << 64))
    doubled = ", ".join(f"h{2 * n} AS MATERIALIZED (SELECT r, i, {mod(f'h * {power(n)} + coalesce(lead(h, {n}) OVER (PARTITION BY r ORDER BY i), 0)')} AS h FROM h{n})" for n in (1, 2, 4, 8, 16, 32))
    if gram != 96:
        raise ValueError("the SQL adds the hashes of 64 and 32 bytes")
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
p AS MATERIALIZED (SELECT r, unnest(range(n_bytes)) AS i, b FROM d),
h1 AS MATERIALIZED (SELECT r, i, (('0x' || hex(b[i + 1:i + 1]))::INT + 1)::UHUGEINT AS h FROM p), {doubled},
g AS (SELECT r, i, {mod(f"h64.h * {power(32)} + h32.h")}::UBIGINT AS h FROM h64 JOIN (SELECT r, i - 64 AS i, h FROM h32) h32 USING (r, i) JOIN d USING (r) WHERE i + {gram} <= n_bytes),
x AS (SELECT r, i, {mod(f"xor(h, h >> 29)::UHUGEINT * {number(0xBF58476D1CE4E5B9)}")}::UBIGINT AS h FROM g),
y AS MATERIALIZED (SELECT r, i, xor(h, h >> 32) AS h FROM x),
m AS (SELECT r, i, min(h // {1 << suffix.PLACE_BITS} * {1 << suffix.PLACE_BITS} + i) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {passage - gram} FOLLOWING) % {1 << suffix.PLACE_BITS} AS place FROM y),
n AS (SELECT DISTINCT r, y.h FROM m JOIN d USING (r) JOIN (SELECT r, i AS place, h FROM y) y USING (r, place) WHERE i + {passage} <= n_bytes),
s AS (SELECT r, count(*) AS n_shared_grams FROM (SELECT r FROM n QUALIFY count(*) OVER (PARTITION BY h) > 1) GROUP BY r),
q AS MATERIALIZED (SELECT r, i, md5(b[i + 1:i + {length}]) AS digest FROM p WHERE i + {length} <= octet_length(b)),
z AS MATERIALIZED (SELECT digest FROM q GROUP BY digest HAVING count(*) > 1),
f AS (SELECT r, i, i AS start FROM q SEMI JOIN z USING (digest)),
c AS (SELECT r, i, hex(b[i + 1:i + 1]) AS byte, coalesce(max(start) OVER (PARTITION BY r ORDER BY i) > i - {length}, false) AS gone FROM p LEFT JOIN f USING (r, i)),
e AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS was FROM c),
o AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT was) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY r)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256,
        coalesce(n_shared_grams, 0)::BIGINT AS n_shared_grams FROM d LEFT JOIN o USING (r) LEFT JOIN s USING (r)"""


def _chunk_sql() -> str:
    """Gear hashes by doubling; from each place the cut that follows a chunk's begin there; the cuts of a text step by step."""
    gear = f"[{', '.join(map(str, cdc.GEAR.tolist()))}]"
    doubled = ", ".join(f"h{2 * n} AS MATERIALIZED (SELECT r, i, (h + coalesce(lag(h, {n}) OVER (PARTITION BY r ORDER BY i), 0) * {1 << n}) % {1 << 32} AS h FROM h{n})" for n in (1, 2, 4, 8, 16))
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
h1 AS MATERIALIZED (SELECT r, i, ({gear}::BIGINT[])[('0x' || hex(b[i:i]))::INT + 1] AS h FROM (SELECT r, b, unnest(generate_series(1, n_bytes)) AS i FROM d)), {doubled},
e AS (SELECT r, i, n_bytes, CASE WHEN h < {1 << (32 - cdc.ZERO_BITS)} THEN i END AS cut FROM h32 JOIN d USING (r)),
t AS MATERIALIZED (SELECT r, i - 1 AS lo, least(n_bytes, i - 1 + {cdc.MOST}, coalesce(min(cut) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {cdc.LEAST - 1} FOLLOWING AND {cdc.MOST - 1} FOLLOWING), n_bytes)) AS hi FROM e),
c(r, lo, hi) AS (SELECT r, lo, hi FROM t WHERE lo = 0 UNION ALL SELECT t.r, t.lo, t.hi FROM c JOIN t ON t.r = c.r AND t.lo = c.hi),
k AS (SELECT r, doc_id, lo, hi, b[lo + 1:hi] AS chunk FROM c JOIN d USING (r)),
m AS MATERIALIZED (SELECT r, lo, hi, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, r, lo) > 1 AS gone, count(*) OVER (PARTITION BY chunk) > 1 AS shared FROM k),
n AS (SELECT *, lo IS DISTINCT FROM lag(hi) OVER (PARTITION BY r ORDER BY lo) AS begins FROM m WHERE shared),
o AS (SELECT *, sum(begins::INT) OVER (PARTITION BY r ORDER BY lo) AS run FROM n),
p AS (SELECT *, sum(hi - lo) OVER (PARTITION BY r, run) >= {cdc.LEAST_RUN} AS held FROM o),
s AS (SELECT r, count(*) AS n_shared, sum(hi - lo) AS shared_bytes, count(*) FILTER (gone) AS n_removed_chunks, sum(hi - lo) FILTER (gone) AS n_removed,
        string_agg(lo || '-' || hi, ' ' ORDER BY lo) FILTER (gone) AS spans FROM p WHERE held GROUP BY r),
q AS (SELECT r, count(*) AS n_chunks FROM m GROUP BY r)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, coalesce(n_chunks, 0)::BIGINT AS n_chunks, coalesce(n_shared, 0)::BIGINT AS n_shared, coalesce(shared_bytes, 0)::BIGINT AS shared_bytes,
        coalesce(n_removed_chunks, 0)::BIGINT AS n_removed_chunks, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(spans, '') AS spans FROM d LEFT JOIN q USING (r) LEFT JOIN s USING (r)"""


def _simhash_sql(words: int = 4, radius: int = 4) -> str:
    """Fingerprints by sums over each bit, links by comparing all, components by what is reached."""
    bits = " + ".join(f"CASE WHEN 2 * sum((h >> {k}) & 1) > count(*) THEN {number(1 << k)} ELSE {number(0)} END" for k in range(simhash.BITS))
    return f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '{WORD}') AS words FROM documents),
s AS MATERIALIZED (SELECT r, array_to_string(words[i:i + {words - 1}], ' ') AS shingle FROM (SELECT r, words, unnest(generate_series(1, greatest(len(words) - {words - 1}, least(len(words), 1)))) AS i FROM t)),
{", ".join(xxh64("s", "shingle", simhash.SEED))},
f AS (SELECT r, {bits} AS fp FROM s JOIN hashed USING (shingle) GROUP BY r),
d AS MATERIALIZED (SELECT doc_id, coalesce(fp, {number(0)})::HUGEINT AS fp FROM t LEFT JOIN f USING (r)),
k AS MATERIALIZED (SELECT fp, min(doc_id) AS least FROM d GROUP BY fp),
l AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM k a JOIN k b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= {radius}),
reach(fp, other) AS (SELECT fp, fp FROM k UNION SELECT reach.fp, l.b FROM reach JOIN l ON l.a = reach.other),
c AS (SELECT reach.fp, min(least) AS component_id FROM reach JOIN k ON k.fp = other GROUP BY reach.fp)
SELECT doc_id, lpad(lower(hex(fp::UBIGINT)), 16, '0') AS fingerprint, component_id FROM d JOIN c USING (fp)"""


ORACLE_SQL = {
    "op1_mixing": rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
m AS (SELECT *, source_size * 3.0::DOUBLE AS most FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM m),
f AS (SELECT *, level * weight >= most AS is_full FROM l),
g AS (SELECT source, source_size, CASE WHEN is_full THEN most ELSE weight * max(CASE WHEN NOT is_full THEN level END) OVER () END AS target,
        ('0x' || substr(md5('7:' || coalesce('s' || source, 'n')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS shift FROM f),
r AS (SELECT d.doc_id, d.size, g.*, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS n FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate * n + shift) - floor(rate * (n - 1) + shift)))::BIGINT AS taken FROM r""",
    "op2_url_filter": f"""
WITH rules(action, rule_host, rule_path) AS (VALUES {", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)}),
r AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
u AS (SELECT row_number() OVER () AS n, page_id, {_AZ.format("coalesce(split_part(rest, '/', 1), '')")} AS host, coalesce(substr(rest, length(split_part(rest, '/', 1)) + 1), '') AS path FROM r),
b AS (SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS verdict
      FROM u JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN b USING (n)""",
    "op4_chunk_dedup": _chunk_sql(),
    "op5_quality_rules": rf"""
WITH t AS (SELECT row_number() OVER () AS n, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM t),
p AS (SELECT n, i, array_to_string(words[i:i + 4], ' ') AS shingle FROM (SELECT n, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w)),
q AS (SELECT n, i FROM p QUALIFY count(*) OVER (PARTITION BY n, shingle) > 1),
rep AS (SELECT n, count(DISTINCT i + k) AS n_repeat_words FROM q, (SELECT unnest(generate_series(0, 4)) AS k) GROUP BY n),
l AS (SELECT n, source, trim(regexp_replace({_AZ.format("line")}, '{SPACE}', ' ', 'g'), ' ') AS line, len(regexp_extract_all(line, '{WORD}')) AS k FROM (SELECT n, source, unnest(lines) AS line FROM w)),
c AS (SELECT source, line, count(DISTINCT n) AS docs FROM l GROUP BY ALL),
h AS (SELECT source, count(*) AS docs FROM t GROUP BY source),
o AS (SELECT c.source, c.line FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE c.docs > {quality.LINE_DOCS} AND c.docs > h.docs * {quality.LINE_SHARE}),
x AS (SELECT n, sum(k) AS lost FROM l JOIN o ON l.source IS NOT DISTINCT FROM o.source AND l.line = o.line GROUP BY n),
a AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_removed_words FROM w LEFT JOIN rep USING (n) LEFT JOIN x USING (n)),
e AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND NOT n_words - n_removed_words < n_words * {quality.LEAST_LEFT} AS kept FROM e""",
    "op6_suffix_dedup": _suffix_sql(),
    "op7_simhash_near_dedup": _simhash_sql(),
    "op8_exact_dedup": f"""
WITH t AS (SELECT doc_id, sha256({_AZ.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM t WINDOW same AS (PARTITION BY text_sha256)""",
}
