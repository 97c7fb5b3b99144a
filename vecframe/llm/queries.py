"""The opN_<name> queries and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe
from .common import stage, stage_path, table
from .exact_dedup import exact_dedup
from .lm_scoring import lm_scoring
from .ngram_join import ngram_join
from .packing import packing
from .quality import quality
from .quality_rules import quality_rules
from .toxicity import toxicity
from .url_filter import url_filter, url_parts
from .warc import read_warc, write_warc


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).marks.drop("locator")


OP1_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("evidence")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), n=3, per_cent=90)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring(table(spark, sf_dir, "documents"))


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stage_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), out)
    return read_warc(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda j:
 substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (j // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (j % 4)))::BIGINT & 31), 1)), '') AS payload_digest FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id < last THEN last END AS refers_to FROM m
"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def url_list(pages: DataFrame) -> DataFrame:
    """The dated list of op10, made from the pages by rule, as pages has none.

    Keys are each host, its parent domain of three labels, and each host with its first directory.  Four digits of a key's
    MD5 decide (v): blocked on a day of 2024 if v is divisible by 3, allowed if by 5, removed if by 7.
    """
    host, path = url_parts(F.col("url"))
    h = pages.select(host.alias("host"), F.regexp_extract(path, "^/+([^/]+)/", 1).alias("dir")).where("host is not null").distinct()
    keys = h.select(F.explode(F.array(F.col("host"), F.array_join(F.slice(F.split("host", r"\."), -3, 3), "."), F.when(F.col("dir") != "", F.concat("host", F.lit("/"), "dir", F.lit("/"))))).alias("key"))
    keys = keys.where("key <> ''").distinct().withColumn("v", F.conv(F.substring(F.md5("key"), 1, 4), 16, 10).cast("int"))
    day = lambda k: F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("v") * k, F.lit(366))).cast("timestamp_ntz")
    each = F.array(*[F.when(F.col("v") % m == 0, F.struct(day(k).alias("since"), F.lit(action).alias("action"))) for m, k, action in URL_RULES])
    return keys.select("key", F.explode(F.filter(each, lambda e: e.isNotNull())).alias("e")).select("key", "e.since", "e.action")


#: Divisor, days for each unit of v (modulo 366), action.
URL_RULES = [(3, 1, "block"), (5, 17, "allow"), (7, 29, "remove")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page n is fetched n times 3,607 s, modulo 366 days, into 2024, as pages has no times either."""
    pages = table(spark, sf_dir, "pages")
    fetched = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, pmod(page_id * 3607, 31622400))")
    entries = stage(url_list(pages), "url-list")
    return url_filter(pages.withColumn("fetched", fetched), entries)


OP10_SQL = (
    r"""WITH r AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_seconds((page_id * 3607) % 31622400) AS fetched, regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://([^?#]*)', 1) AS rest FROM pages),
a AS (SELECT *, split_part(rest, '/', 1) AS authority FROM r),
c AS (SELECT *, substr(rest, length(authority) + 1) AS path,
 nullif(regexp_replace(regexp_replace(lower(split_part(authority, '@', -1)), ':\d*$', ''), '\.+$', ''), '') AS host FROM a),
w AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(regexp_replace(path, '^/|[^/]*$', '', 'g'), '/'), lambda d: d <> '') AS dirs FROM c),
n AS (SELECT DISTINCT unnest([host, array_to_string(labels[-3:], '.'), CASE WHEN len(dirs) > 0 THEN host || '/' || dirs[1] || '/' END]) AS key FROM w WHERE host IS NOT NULL),
v AS (SELECT key, ('0x' || substr(md5(key), 1, 4))::INTEGER AS v FROM n WHERE key <> ''),
e AS ("""
    + " UNION ALL ".join(f"SELECT key, TIMESTAMP '2024-01-01' + to_days((v * {k}) % 366) AS since, '{action}' AS action, {rank} AS rank FROM v WHERE v % {m} = 0" for (m, k, action), rank in zip(URL_RULES, (2, 1, 3), strict=True))
    + r"""),
o AS (SELECT key, since, arg_max(action, rank) AS action FROM e GROUP BY key, since),
i AS (SELECT key, since, action, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM o),
k AS (
 SELECT page_id, fetched, 1000 - n AS weight, array_to_string(labels[n:], '.') AS key FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS n FROM w WHERE host IS NOT NULL)
 UNION ALL
 SELECT page_id, fetched, 1000 + n, host || '/' || array_to_string(dirs[:n], '/') || '/' FROM (SELECT *, unnest(range(1, len(dirs) + 1)) AS n FROM w WHERE host IS NOT NULL)),
m AS (SELECT page_id, k.key, i.since, i.action, row_number() OVER (PARTITION BY page_id ORDER BY weight DESC) AS nth
 FROM k JOIN i ON k.key = i.key AND k.fetched >= i.since AND (i.until IS NULL OR k.fetched < i.until) WHERE i.action <> 'remove')
SELECT c.page_id, c.url, c.host, c.fetched, m.action, m.key AS matched_key, m.since AS active_since, coalesce(m.action = 'block', false) AS blocked
FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.nth = 1
"""
)


QUERIES = {q.__name__: q for q in (op1_exact_dedup, op2_toxicity, op3_byte_bpe, op4_ngram_join, op5_quality, op6_lm_scoring, op7_harmonic_packing, op8_warc, op9_quality_rules, op10_url_filter)}
SQL = {"op1_exact_dedup": OP1_SQL, "op8_warc": OP8_SQL, "op10_url_filter": OP10_SQL}
