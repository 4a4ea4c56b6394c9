"""WARC: resolution of not-modified revisits.

A revisit record has headers and no payload. It is resolved by an as-of join on the
canonical URL: the latest full response (status 200) that is earlier than the revisit.
The revisit's validators must agree with that response: its entity tag if it has one
(weak comparison), else its Last-Modified, else its payload digest; without any it stays
unchecked. The headers of a resolved record are the response's, updated by those of the
revisit that may change without a new payload.

Scale: payloads take no part, only their digests. A URL's records aren't put in order in
one task: they are dealt by URL and span of time, each part hands on its last response
only, and the parts' carries are ordered by URL.

Defined cases: a null URL has no partner ("no url"). A revisit without an earlier full
response is an "orphan", one whose validators disagree a "mismatch"; both keep their own
headers and get no payload. Equal times are not earlier; of responses at one time that of
the greatest id counts. Records repeated as a whole are resolved alike. A null time comes
before all others, negative ones too. Header names are compared and returned in lower case;
of names that differ in case alone the least value counts. A query parameter that only tracks
(utm_, ref, fbclid, gclid, sessionid) is no part of a URL, nor is its scheme; percent signs and dot
segments are taken as written. Columns beside those named are not read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import checkpoint, read

SPAN = 100_000
#: Query parameters that don't change a page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"
#: Headers of the stored payload or of one connection, which a revisit can't change.
FIXED_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "trailer", "transfer-encoding", "upgrade")

_PARTNER = "struct<ts:bigint,record_id:bigint,headers:map<string,string>,digest:string>"


def canonical(url: Column) -> Column:
    """Host in lower case without www and default port, path without a final slash, ordered query without tracking."""
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www[0-9]*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    kept = F.filter(F.split(F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def lower_names(headers: Column) -> Column:
    """The map with its names in lower case; of names that differ in case alone the least value stays."""
    names = F.array_distinct(F.transform(F.map_keys(headers), F.lower))
    of = lambda n: F.array_min(F.transform(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == n), lambda e: e["value"]))
    return F.map_from_arrays(names, F.transform(names, of))


#: The span of records without a time, before all others.
NO_TIME = -(1 << 62)


def _agrees(own: Column, theirs: Column, digest: Column, their_digest: Column) -> Column:
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    return (
        F.when(own["etag"].isNotNull(), F.coalesce(tag(own) == tag(theirs), F.lit(False)))
        .when(own["last-modified"].isNotNull(), F.coalesce(own["last-modified"] == theirs["last-modified"], F.lit(False)))
        .when(digest.isNotNull(), F.coalesce(digest == their_digest, F.lit(False)))
    )


def merged(response: Column, revisit: Column) -> Column:
    """The response's headers, updated by those that a revisit may change."""
    fresh = F.map_filter(revisit, lambda k, v: ~k.isin(*FIXED_HEADERS))
    return F.map_concat(F.map_filter(response, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)


def resolve(records: DataFrame, span: int = SPAN) -> DataFrame:
    """``records`` (record_id, url, ts, kind "response" or "revisit", status, headers, digest) with canonical_url, partner_id, outcome and the resolved headers and digest."""
    r = records.select("record_id", "url", "ts", "kind", "status", lower_names(F.col("headers")).alias("headers"), "digest").withColumn("canonical_url", canonical(F.col("url")))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    partner = F.when(full, F.struct("ts", "record_id", "headers", "digest")).cast(_PARTNER)
    known = r.where("canonical_url is not null").withColumn("part", F.coalesce(F.floor(F.col("ts") / span), F.lit(NO_TIME))).withColumn("own", partner)

    # At one time revisits come first, so that they see no response of that time.
    here = W.partitionBy("canonical_url", "part").orderBy(F.col("ts").asc_nulls_first(), full.cast("int"), "record_id").rowsBetween(W.unboundedPreceding, -1)
    carries = known.where("own is not null").groupBy("canonical_url", "part").agg(F.max_by("own", F.struct("ts", "record_id")).alias("carry"))
    parts = known.select("canonical_url", "part").distinct().join(carries, ["canonical_url", "part"], "left")
    earlier = W.partitionBy("canonical_url").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("canonical_url", "part", F.last("carry", ignorenulls=True).over(earlier).alias("carried"))
    known = known.withColumn("found", F.last("own", ignorenulls=True).over(here)).join(parts, ["canonical_url", "part"])
    known = known.withColumn("partner", F.coalesce("found", "carried")).drop("found", "carried", "part", "own")

    every = known.unionByName(r.where("canonical_url is null").withColumn("partner", F.lit(None).cast(_PARTNER)))
    agrees = _agrees(F.col("headers"), F.col("partner.headers"), F.col("digest"), F.col("partner.digest"))
    outcome = (
        F.when(F.col("kind") == "response", "response")
        .when(F.col("canonical_url").isNull(), "no url")
        .when(F.col("partner").isNull(), "orphan")
        .when(agrees, "resolved")
        .when(agrees.isNull(), "unchecked")
        .otherwise("mismatch")
    )
    every = every.withColumn("outcome", outcome)
    used = F.col("outcome").isin("resolved", "unchecked")
    return every.select(
        "record_id", "canonical_url", "ts", "kind", "outcome",
        F.when(used, F.col("partner.record_id")).alias("partner_id"),
        F.when(used, merged(F.col("partner.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(used, F.col("partner.digest")).when(F.col("kind") == "response", F.col("digest")).alias("digest"),
    )


def records(pages: DataFrame) -> DataFrame:
    """Four records a page: a response, and revisits soon after it, long after it, and just before or behind it.

    The page's id gives the time. The late revisit has in turn an entity tag, a Last-Modified,
    a tag that agrees with nothing, and a digest alone; the last one has no validator and, of
    each third page, comes before the response. Each seventh response is not a full one.
    """
    p = checkpoint(pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("size")))
    at, day = F.col("page_id") * 10, F.concat(F.lit("day "), F.col("page_id").cast("string"))
    tag = F.concat(F.lit('"'), F.col("digest"), F.lit('"'))
    head = lambda *pairs: F.create_map(*[x if isinstance(x, Column) else F.lit(x) for pair in pairs for x in pair])
    response = head(("content-type", "text/html"), ("content-length", F.col("size")), ("etag", tag), ("last-modified", day), ("cache-control", "max-age=60"))
    soon = head(("etag", F.concat(F.lit("W/"), tag)), ("content-length", "0"), ("cache-control", "max-age=120"))
    turn = F.col("page_id") % 4
    late = F.when(turn == 0, head(("ETag", tag), ("Date", "late"))).when(turn == 1, head(("Last-Modified", day), ("Date", "late"))).when(turn == 2, head(("etag", '"stale"'), ("date", "late"))).otherwise(head(("date", "late")))
    early = head(("date", "early"), ("connection", "close"))
    none = F.lit(None).cast("string")
    row = lambda n, ts, kind, status, headers, digest: F.struct((F.col("page_id") * 4 + n).alias("record_id"), ts.cast("long").alias("ts"), F.lit(kind).alias("kind"), status.cast("int").alias("status"), headers.alias("headers"), digest.alias("digest"))
    made = F.array(
        row(0, at, "response", F.when(F.col("page_id") % 7 == 6, 503).otherwise(200), response, F.col("digest")),
        row(1, at + 5, "revisit", F.lit(304), soon, none),
        row(2, at + 300_000, "revisit", F.lit(304), late, F.when(turn == 3, F.col("digest"))),
        row(3, at + F.when(F.col("page_id") % 3 == 0, -1).otherwise(7), "revisit", F.lit(304), early, none),
    )
    return p.select("url", F.explode(made).alias("r")).select("url", "r.*")


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return resolve(records(read(spark, sf_dir, "pages"))).select("record_id", "canonical_url", "ts", "kind", "outcome", F.coalesce("partner_id", F.lit(-1).cast("long")).alias("partner_id"), shown.alias("headers"), "digest")


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest, CAST(length(coalesce(html, '')) AS VARCHAR) AS size,
         regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
c AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)'))), '&') AS query FROM p),
u AS (SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical_url FROM c),
r AS (
  SELECT page_id * 4 AS record_id, canonical_url, page_id * 10 AS ts, 'response' AS kind, page_id % 7 <> 6 AS is_full, '"' || digest || '"' AS tag, 'day ' || page_id AS modified,
         'max-age=60' AS cache, NULL AS date, size, digest, CAST(NULL AS VARCHAR) AS connection FROM u
  UNION ALL SELECT page_id * 4 + 1, canonical_url, page_id * 10 + 5, 'revisit', false, 'W/"' || digest || '"', NULL, 'max-age=120', NULL, '0', NULL, NULL FROM u
  UNION ALL SELECT page_id * 4 + 2, canonical_url, page_id * 10 + 300000, 'revisit', false, CASE page_id % 4 WHEN 0 THEN '"' || digest || '"' WHEN 2 THEN '"stale"' END, CASE WHEN page_id % 4 = 1 THEN 'day ' || page_id END, NULL, 'late', NULL, CASE WHEN page_id % 4 = 3 THEN digest END, NULL FROM u
  UNION ALL SELECT page_id * 4 + 3, canonical_url, page_id * 10 + CASE WHEN page_id % 3 = 0 THEN -1 ELSE 7 END, 'revisit', false, NULL, NULL, NULL, 'early', NULL, NULL, 'close' FROM u),
j AS (
  SELECT r.*, f.record_id AS f_id, f.tag AS f_tag, f.modified AS f_modified, f.cache AS f_cache, f.size AS f_size, f.digest AS f_digest,
         row_number() OVER (PARTITION BY r.record_id ORDER BY f.ts DESC NULLS LAST, f.record_id DESC) AS n
  FROM r LEFT JOIN r f ON f.is_full AND f.canonical_url = r.canonical_url AND f.ts < r.ts),
o AS (
  SELECT *, CASE WHEN kind = 'response' THEN 'response' WHEN canonical_url IS NULL THEN 'no url' WHEN f_id IS NULL THEN 'orphan'
    WHEN tag IS NOT NULL THEN CASE WHEN replace(tag, 'W/', '') = f_tag THEN 'resolved' ELSE 'mismatch' END
    WHEN modified IS NOT NULL THEN CASE WHEN modified = f_modified THEN 'resolved' ELSE 'mismatch' END
    WHEN digest IS NOT NULL THEN CASE WHEN digest = f_digest THEN 'resolved' ELSE 'mismatch' END ELSE 'unchecked' END AS outcome FROM j WHERE n = 1),
h AS (SELECT *, outcome IN ('resolved', 'unchecked') AS used FROM o)
SELECT record_id, canonical_url, ts, kind, outcome, CASE WHEN used THEN f_id ELSE -1 END AS partner_id,
  array_to_string(list_sort(list_filter([
    'cache-control: ' || CASE WHEN used THEN coalesce(cache, f_cache) ELSE cache END,
    'connection: ' || CASE WHEN NOT used THEN connection END,
    'content-length: ' || CASE WHEN used THEN f_size ELSE size END,
    'content-type: ' || CASE WHEN used OR kind = 'response' THEN 'text/html' END,
    'date: ' || date,
    'etag: ' || CASE WHEN used THEN coalesce(tag, f_tag) ELSE tag END,
    'last-modified: ' || CASE WHEN used THEN coalesce(modified, f_modified) ELSE modified END], lambda x: x IS NOT NULL)), chr(10)) AS headers,
  CASE WHEN used THEN f_digest WHEN kind = 'response' THEN digest END AS digest
FROM h
"""

QUERIES = {"op9_revisits": op9_revisits}
ORACLES = {"op9_revisits": ORACLE}
