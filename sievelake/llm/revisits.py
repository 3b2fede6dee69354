"""Not-modified revisits of web captures: an as-of join to the latest earlier full response.

Records are captures (url, time, status, validators, headers). A revisit (status 304) refers to the latest
full response (status 200) of the same canonical URL strictly before it; of full responses at one time the
largest record id counts. Then validators are checked: entity tags compare weakly where both have one,
else last-modified dates where both have one. A match merges the headers: the revisit's replace the stored
ones except those that describe the body or the connection.

The join is two windows: within (URL, time chunk), and over a URL's chunks (``CHUNKS`` at most), each of
which hands on its last full response. Chunks divide the span of all but the outermost records evenly, so
a URL with a third of all records is dealt out by time, and no group is larger than a chunk of one URL.
Only keys, validators and headers move, never bodies.

Defined results: a null URL or time, or a URL that is not http(s), is ``invalid``; no earlier response is
``orphan``; unequal validators are ``mismatch``; none in common is ``unverified``; repeated records each
get a row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

CHUNKS = 1024
# Query parameters that only track, and headers that a not-modified response may not replace.
TRACKING = ("utm_[a-z]+", "ref", "fbclid", "gclid")
KEEP_STORED = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "etag",
    "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Host in lower case without www., port 80/443 or user; path without a trailing slash; query sorted
    and without tracking parameters; no scheme and no fragment. Null if it is not http(s)."""
    url = F.regexp_replace(F.trim(url), "#.*$", "")
    shape = r"^(?i:https?)://(?:[^/?@]*@)?([^/?:]+)(?::(\d+))?(/[^?]*)?(?:\?(.*))?$"
    part = lambda k: F.regexp_extract(url, shape, k)
    host = F.regexp_replace(F.lower(part(1)), r"^www\.", "")
    port = F.when(part(2).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(2)))
    path = F.regexp_replace(part(3), "/+$", "")
    wanted = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~p.rlike(f"^(?i:{'|'.join(TRACKING)})(=|$)"))
    query = F.array_join(F.array_sort(wanted), "&")
    whole = F.concat(host, port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(part(1) != "", whole)


def header_map(headers: Column) -> Column:
    """Names in lower case; of names that then clash, the last one's value. Null: none."""
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(F.trim(e.key)).alias("k"), e.value.alias("v")))
    pairs = F.coalesce(pairs, F.expr("cast(array() AS array<struct<k: string, v: string>>)"))
    names = F.array_distinct(F.transform(pairs, lambda p: p.k))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p.k == n), -1).v))


def merged_headers(stored: Column, new: Column) -> Column:
    allowed = F.map_filter(new, lambda k, _: ~k.isin(*KEEP_STORED))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(allowed, k)), allowed)


def _tag(etag: Column) -> Column:
    return F.nullif(F.regexp_replace(F.trim(etag), "^W/", ""), F.lit(""))


def resolve_revisits(records: DataFrame, chunks: int = CHUNKS) -> DataFrame:
    """One row per revisit of ``records`` (record_id long, url, ts long, status int, etag, last_modified,
    headers map, payload_digest): record_id, canonical, ts, refers_to, refers_ts, outcome, payload_digest
    and headers (merged where resolved, else the revisit's own)."""
    # A few odd times must not widen the chunks: the outer ones take what lies beyond nearly all records.
    low, high = records.agg(F.percentile_approx(F.col("ts").cast("long"), [0.001, 0.999], 10_000)).first()[0] or (0, 0)
    width = max(1, (high - low) // chunks + 1)
    chunk = F.greatest(F.lit(0), F.least(F.lit(chunks - 1), F.floor((F.col("ts").cast("double") - F.lit(float(low))) / F.lit(float(width)))))
    rows = records.where(F.col("status").isin(200, 304)).select(
        F.col("record_id").cast("long").alias("record_id"),
        canonical_url(F.col("url")).alias("canonical"),
        F.col("ts").cast("long").alias("ts"),
        (F.col("status") == 200).alias("full"),
        _tag(F.col("etag")).alias("etag"),
        F.nullif(F.trim("last_modified"), F.lit("")).alias("modified"),
        header_map(F.col("headers")).alias("headers"),
        "payload_digest",
    )
    valid = F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    usable = rows.where(valid).withColumn("chunk", chunk.cast("int"))
    response = F.when(F.col("full"), F.struct("ts", "record_id", "etag", "modified", "headers", "payload_digest"))
    within = W.partitionBy("canonical", "chunk").orderBy("ts", "full", "record_id").rowsBetween(W.unboundedPreceding, 0)
    near = usable.withColumn("near", F.last(response, ignorenulls=True).over(within)).where(~F.col("full"))

    key = F.struct("ts", F.coalesce("record_id", F.lit(-(1 << 63))))
    handed = usable.where("full").groupBy("canonical", "chunk").agg(F.max_by(response, key).alias("last"))
    asked = near.where(F.col("near").isNull()).select("canonical", "chunk").distinct().withColumn("last", F.lit(None).cast(handed.schema["last"].dataType))
    over = W.partitionBy("canonical").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = handed.unionByName(asked).groupBy("canonical", "chunk").agg(F.first("last", ignorenulls=True).alias("last"))
    carried = carried.select("canonical", "chunk", F.last("last", ignorenulls=True).over(over).alias("far"))
    found = near.join(carried, ["canonical", "chunk"], "left").withColumn("to", F.coalesce("near", "far")).drop("near", "far", "chunk")
    odd = rows.where(~valid & ~F.col("full")).withColumn("to", F.lit(None).cast(found.schema["to"].dataType))

    both_tags = F.col("etag").isNotNull() & F.col("to.etag").isNotNull()
    both_dates = F.col("modified").isNotNull() & F.col("to.modified").isNotNull()
    outcome = (
        F.when(~valid, "invalid")
        .when(F.col("to").isNull(), "orphan")
        .when(both_tags, F.when(F.col("etag") == F.col("to.etag"), "resolved").otherwise("mismatch"))
        .when(both_dates, F.when(F.col("modified") == F.col("to.modified"), "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    judged = found.unionByName(odd).withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    return judged.select(
        "record_id",
        "canonical",
        "ts",
        F.col("to.record_id").alias("refers_to"),
        F.col("to.ts").alias("refers_ts"),
        "outcome",
        F.when(resolved, F.col("to.payload_digest")).alias("payload_digest"),
        F.when(resolved, merged_headers(F.col("to.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )


def attach_payload(resolved: DataFrame, captures: DataFrame, id_col: str = "record_id") -> DataFrame:
    """Resolved revisits with the other columns of the capture that they refer to."""
    body = captures.withColumnsRenamed({c: f"payload_{c}" for c in captures.columns if c in resolved.columns and c != id_col})
    body = body.withColumnRenamed(id_col, "refers_to")
    return resolved.where("outcome = 'resolved'").join(body, "refers_to")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Captures made of a table of pages, whose order is taken as time.

    Every page is a full response at 10 * page_id. Page p also gives a revisit of its URL at 10 * p + 5,
    under the scheme and host form of another crawl: with the page's tag (p % 4 = 0), a weak tag (1), only a
    date (2), or a changed tag (3); and pages with p % 10 = 0 one just before it, when it may not be known.
    """
    p, url = F.col("page_id"), F.col("url")
    tag, date = F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.concat(F.lit("d"), F.floor(p / 7).cast("string"))
    base = pages.select("page_id", "url", tag.alias("tag"), date.alias("date"))
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    full = base.select(
        (F.col("page_id") * 3).alias("record_id"), "url", (F.col("page_id") * 10).alias("ts"), F.lit(200).alias("status"),
        F.col("tag").alias("etag"), F.col("date").alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), F.col("tag"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Age"), text("page_id")).alias("headers"),
        F.concat(F.lit("md5:"), "tag").alias("payload_digest"),
    )
    kind = F.col("page_id") % 4
    again = base.select(
        (F.col("page_id") * 3 + 1).alias("record_id"), F.regexp_replace("url", "^https?://", "HTTP://WWW.").alias("url"),
        (F.col("page_id") * 10 + 5).alias("ts"), F.lit(304).alias("status"),
        F.when(kind == 0, F.col("tag")).when(kind == 1, F.concat(F.lit("W/"), "tag")).when(kind == 3, F.concat("tag", F.lit("x"))).alias("etag"),
        F.when(kind == 2, F.col("date")).alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/plain"), F.lit("cache-control"), F.lit("max-age=90")).alias("headers"),
        none.alias("payload_digest"),
    )
    before = base.where("page_id % 10 = 0").select(
        (F.col("page_id") * 3 + 2).alias("record_id"), "url", (F.col("page_id") * 10 - 1).alias("ts"), F.lit(304).alias("status"),
        F.col("tag").alias("etag"), none.alias("last_modified"),
        F.create_map(F.lit("date"), text("page_id")).alias("headers"), none.alias("payload_digest"),
    )
    return full.unionByName(again).unionByName(before)


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(records_of_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e.key, F.lit(": "), e.value))
    return found.withColumn("headers", F.array_join(lines, "\n"))


_CANON = r"""
CASE WHEN regexp_matches(u0, '^(?i:https?)://([^/?@]*@)?[^/?:]+(:\d+)?(/[^?]*)?(\?.*)?$') THEN
  regexp_replace(lower(regexp_extract(u0, '^(?i:https?)://(?:[^/?@]*@)?([^/?:]+)', 1)), '^www\.', '')
  || CASE WHEN regexp_extract(u0, '^(?i:https?)://(?:[^/?@]*@)?[^/?:]+(?::(\d+))?', 1) IN ('', '80', '443') THEN ''
     ELSE ':' || regexp_extract(u0, '^(?i:https?)://(?:[^/?@]*@)?[^/?:]+(?::(\d+))?', 1) END
  || regexp_replace(regexp_extract(u0, '^(?i:https?)://[^/?]+(/[^?]*)?', 1), '/+$', '')
  || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END END
"""
OP9_SQL = rf"""
WITH base AS (SELECT page_id, url, md5(coalesce(html, '')) AS tag, 'd' || floor(page_id / 7)::BIGINT AS day FROM pages),
records AS (
  SELECT page_id * 3 AS record_id, url, page_id * 10 AS ts, 200 AS status, tag AS etag, day AS modified,
         map {{'age': page_id::VARCHAR, 'cache-control': 'max-age=60', 'content-type': 'text/html', 'etag': tag}} AS h, 'md5:' || tag AS digest FROM base
  UNION ALL
  SELECT page_id * 3 + 1, regexp_replace(url, '^https?://', 'HTTP://WWW.'), page_id * 10 + 5, 304,
         CASE page_id % 4 WHEN 0 THEN tag WHEN 1 THEN tag WHEN 3 THEN tag || 'x' END, CASE WHEN page_id % 4 = 2 THEN day END,
         map {{'cache-control': 'max-age=90', 'content-type': 'text/plain'}}, NULL FROM base
  UNION ALL
  SELECT page_id * 3 + 2, url, page_id * 10 - 1, 304, tag, NULL, map {{'date': page_id::VARCHAR}}, NULL FROM base WHERE page_id % 10 = 0),
cut AS (
  SELECT *, regexp_replace(trim(url), '#.*$', '') AS u0,
         list_filter(string_split(regexp_extract(regexp_replace(trim(url), '#.*$', ''), '\?(.*)$', 1), '&'),
                     lambda p: p <> '' AND NOT regexp_matches(p, '^(?i:utm_[a-z]+|ref|fbclid|gclid)(=|$)')) AS q
  FROM records),
canon AS (SELECT *, {_CANON} AS canonical FROM cut),
pairs AS (
  SELECT r.record_id, r.canonical, r.ts, r.etag, r.modified, r.h, f.record_id AS refers_to, f.ts AS refers_ts, f.etag AS fe, f.modified AS fm, f.h AS fh, f.digest
  FROM (SELECT * FROM canon WHERE status = 304) r
  LEFT JOIN (SELECT * FROM canon WHERE status = 200) f ON r.canonical = f.canonical AND f.ts < r.ts
  QUALIFY row_number() OVER (PARTITION BY r.record_id ORDER BY f.ts DESC NULLS LAST, f.record_id DESC NULLS LAST) = 1),
judged AS (
  SELECT *, CASE WHEN canonical IS NULL OR ts IS NULL THEN 'invalid' WHEN refers_to IS NULL THEN 'orphan'
    WHEN etag IS NOT NULL AND fe IS NOT NULL THEN CASE WHEN etag = fe THEN 'resolved' ELSE 'mismatch' END
    WHEN modified IS NOT NULL AND fm IS NOT NULL THEN CASE WHEN modified = fm THEN 'resolved' ELSE 'mismatch' END
    ELSE 'unverified' END AS outcome FROM pairs),
names AS (
  SELECT record_id, k, CASE WHEN outcome = 'resolved' THEN
      CASE WHEN list_contains(map_keys(h), k) AND k NOT IN ('content-type', 'etag') THEN h[k] ELSE fh[k] END ELSE h[k] END AS v
  FROM judged, unnest(CASE WHEN outcome = 'resolved' THEN list_distinct(list_concat(map_keys(fh), list_filter(map_keys(h), lambda x: x NOT IN ('content-type', 'etag')))) ELSE map_keys(h) END) u(k))
SELECT record_id, canonical, ts, refers_to, refers_ts, outcome, CASE WHEN outcome = 'resolved' THEN digest END AS payload_digest,
       (SELECT string_agg(k || ': ' || v, chr(10) ORDER BY k) FROM names n WHERE n.record_id = j.record_id) AS headers
FROM judged j
"""
