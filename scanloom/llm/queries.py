"""The operators over the driver's tables, and what SQL says of the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import decontaminate, exact_dedup, html_text, mixing, quality, simhash, substring_dedup, toxicity, url_filter, warc
from scanloom.llm.common import LOWER, UPPER

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(_table(spark, sf_dir, "pages"), min_bytes=0)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0).drop("copies")


def op4_toxicity_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")), threshold=0.5)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), digest=True)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), RULES)


def op7_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")), threshold=0.3)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"), t=4)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_benchmark_decontamination, op2_warc_salvage, op3_source_mixing, op4_toxicity_compression, op5_suffix_dedup,
        op6_url_filter, op7_quality_nbsvm, op8_html_extraction, op9_simhash_anchors, op10_exact_dedup,
    )
    return {f.__name__: f for f in named}


def _lower(c: str) -> str:
    return f"translate({c}, '{UPPER}', '{LOWER}')"


_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_lower("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(_lower("coalesce(text, '')"))} AS w FROM benchmark),
bi AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM bi),
ns AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM di),
m AS (SELECT doc_id, item, i, bw.n AS n FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN hits USING (doc_id)
"""

_B32 = " || ".join(f"array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT) >> s) & 31 AS INTEGER) + 1, 1)), '')" for k in range(8))

_OP2 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_B32} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN f USING (h)
"""

_OP3 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS words FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight FROM s),
c AS (SELECT *, words * 2.0 AS ceiling, row_number() OVER (ORDER BY words * 2.0 / weight, source NULLS LAST) AS k FROM w),
l AS (SELECT *, coalesce(sum(ceiling) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS full_,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS open_, sum(words) OVER () * 1.5 AS all_ FROM c),
v AS (SELECT *, (all_ - full_) / open_ AS level FROM l),
x AS (SELECT arg_min(level, k) AS level FROM v WHERE level <= ceiling / weight),
t AS (SELECT v.source, words, least(ceiling, coalesce((SELECT level FROM x) * weight, ceiling)) AS target FROM v),
n AS (SELECT source, size, CAST(floor(sqrt(CAST(size AS DOUBLE)) * 16.0) AS BIGINT) AS wt, count(*) AS n FROM d GROUP BY source, size),
h AS (SELECT n.*, target, CAST(coalesce(sum(size * n) OVER (PARTITION BY n.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) * 2.0 AS taken_,
    CAST(sum(size * n * wt) OVER (PARTITION BY n.source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS left_ FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source),
lv AS (SELECT source, arg_max(lev, size) AS lev FROM (SELECT *, (target - taken_) / left_ AS lev FROM h WHERE left_ > 0) WHERE lev * wt <= 2.0 GROUP BY source),
r AS (SELECT d.*, words, target, CASE WHEN size > 0 THEN least(2.0, coalesce(lev * CAST(floor(sqrt(CAST(size AS DOUBLE)) * 16.0) AS BIGINT), 2.0)) ELSE 0.0 END AS times
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN lv ON d.source IS NOT DISTINCT FROM lv.source),
q AS (SELECT *, CASE WHEN times - floor(times) > 0 THEN (u / (1.0 - u)) / ((times - floor(times)) / (1.0 - (times - floor(times)))) END AS q,
    target - sum(floor(times) * size) OVER (PARTITION BY source) AS rest FROM r),
o AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS upto FROM q WHERE q IS NOT NULL),
e AS (SELECT doc_id, 1 AS extra FROM o WHERE upto <= rest OR (upto - size < rest AND upto - rest < rest - (upto - size)))
SELECT q.doc_id, size, CAST(words AS BIGINT) AS source_size, target, CAST((floor(times) + coalesce(extra, 0)) * size AS BIGINT) AS taken
FROM q LEFT JOIN e USING (doc_id)
"""

_OP6 = f"""
WITH p AS (SELECT page_id, {_lower("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(verdict, host, path) AS (VALUES {", ".join(str(r) for r in RULES)}),
m AS (SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(verdict, length(r.host || r.path)) AS verdict
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""

_OP10 = f"""
WITH d AS (SELECT doc_id, sha256({_lower("coalesce(text, '')")}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL has no such hash, compressor, model, parser or byte strings, the tests hold the query against brute force."""
    return {"op1_benchmark_decontamination": _OP1, "op2_warc_salvage": _OP2, "op3_source_mixing": _OP3, "op6_url_filter": _OP6, "op10_exact_dedup": _OP10}
