"""Not-modified revisits of web captures, resolved by an as-of join.

A revisit (status 304, no payload) stands for the latest earlier full response of its canonical URL, if its validators agree:
the entity tag where both have one (compared weakly), else the modification date. Of the revisit's headers only those that a
304 may carry replace the stored ones.

The as-of join runs in two steps, so that no URL's history has to lie in one task: inside slices of about equal numbers of captures,
cut from the order of URL, time and id wherever a burst needs it, and over one summary row per slice. Defined results: revisits of null
URLs, and revisits without an earlier response, are `orphan`; revisits whose validators differ, or without a common one, are `mismatch`;
equal times go by capture id, equal ids by a hash of what the captures say; null times come first; header names are compared without case, and of a revisit's names that
differ in case only the last in order counts; empty tables give empty results; repeated
capture ids are captures of their own; other columns pass through, but for those that the result defines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import cut, private

#: Headers that a not-modified answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that only track.
TRACKING = "utm_[a-z]+|gclid|fbclid|ref"


def canonical_url(url: Column) -> Column:
    """Lower-case host without www. or m., no scheme, default port, fragment, tracking parameters or slash at the end."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^(?:[A-Za-z]+://)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^(www|m)[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^(?:[A-Za-z]+://)?[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(bare, r"[?](.*)$", 1), f"(^|&)({TRACKING})=[^&]*", "")
    query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    return F.when(url.isNotNull(), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def resolve_revisits(captures: DataFrame, per_slice: int = 50_000) -> DataFrame:
    """captures (capture_id, url, ts, status, etag, last_modified, headers MAP<STRING,STRING>, payload_digest) -> with
    canonical, source_id (the response a revisit stands for), outcome (`response`, `resolved`, `mismatch`, `orphan`),
    headers merged and payload_digest filled for resolved revisits."""
    names = [c for c in captures.columns if c not in ("canonical", "source_id", "outcome")]
    captures = captures.select(*[F.col(f"`{c}`") for c in names])
    rows = private(captures, canonical=canonical_url(F.col("url")), ts=F.col("ts"), capture=F.col("capture_id"))
    # captures of one time and id go by what they say
    says = F.struct("own.status", "own.etag", "own.last_modified", "own.payload_digest", F.array_sort(F.map_entries("own.headers")).alias("headers"))
    rows = rows.withColumn("told", F.xxhash64(F.to_json(says)))
    order = [F.col("ts").asc_nulls_first(), F.col("capture"), F.col("told")]
    slices = max(1, math.ceil(captures.count() / per_slice))
    placed = rows.filter("canonical IS NOT NULL").repartitionByRange(slices, "canonical", *order)
    placed = cut(placed.withColumn("slice", F.spark_partition_id()))  # what lies in a slice must not change later
    parts = ("capture_id", "etag", "last_modified", "headers", "payload_digest")
    placed = placed.withColumn("full", F.when(F.col("own.status") == 200, F.struct(*(F.col(f"own.{c}") for c in parts))))
    inside = Window.partitionBy("canonical", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("near", F.last("full", ignorenulls=True).over(inside))
    time = F.struct(F.col("ts").isNotNull().alias("known"), "ts", "capture", "told")
    ends = placed.groupBy("canonical", "slice").agg(F.max_by(F.col("full"), F.when(F.col("full").isNotNull(), time)).alias("end"))
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("canonical", "slice", F.last("end", ignorenulls=True).over(before).alias("far"))
    found = near.join(carried, ["canonical", "slice"]).select("own", "canonical", F.coalesce("near", "far").alias("base"))
    nothing = rows.filter("canonical IS NULL").select("own", "canonical", F.lit(None).cast(found.schema["base"].dataType).alias("base"))
    every = found.unionByName(nothing)

    own = lambda c: F.col(f"own.{c}")
    plain = lambda tag: F.regexp_replace(tag, "^W/", "")
    etags = own("etag").isNotNull() & F.col("base.etag").isNotNull()
    agree = F.when(etags, plain(own("etag")) == plain(F.col("base.etag"))).otherwise(F.coalesce(own("last_modified") == F.col("base.last_modified"), F.lit(False)))
    outcome = F.when(~own("status").eqNullSafe(304), "response").when(F.col("base").isNull(), "orphan").when(agree, "resolved").otherwise("mismatch")
    none = F.create_map().cast("map<string,string>")
    updates = F.map_filter(F.coalesce(own("headers"), none), lambda k, v: F.lower(k).isin(*PERMITTED))
    # of names that differ in case only the last in order counts
    names_ = F.map_keys(updates)
    updates = F.map_filter(updates, lambda k, v: ~F.exists(names_, lambda other: (F.lower(other) == F.lower(k)) & (other > k)))
    updated = F.transform(F.map_keys(updates), F.lower)
    kept = F.map_filter(F.coalesce("base.headers", none), lambda k, v: ~F.array_contains(updated, F.lower(k)))
    ok = F.col("outcome") == "resolved"
    merged = {
        "payload_digest": F.when(ok, F.col("base.payload_digest")).otherwise(own("payload_digest")),
        "headers": F.when(ok, F.map_concat(kept, updates)).otherwise(own("headers")),
    }
    judged = every.withColumn("outcome", outcome)
    return judged.select(*[merged[c].alias(c) if c in merged else F.col(f"own.`{c}`") for c in names], "canonical", F.when(ok, F.col("base.capture_id")).alias("source_id"), "outcome")


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Captures derived from the pages table: each page is a full response at time 10 * page_id, and is asked for again at a
    later time through a differing form of its URL. Of these revisits some carry an outdated entity tag, some only the
    modification date, some nothing, and some come before any response."""
    page, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    tag = F.md5(html.cast("binary"))
    response = pages.select(
        (page * 2).alias("capture_id"),
        "url",
        (page * 10).alias("ts"),
        F.lit(200).alias("status"),
        tag.alias("etag"),
        (page % 97).cast("string").alias("last_modified"),
        F.create_map(
            F.lit("content-length"), F.octet_length(html).cast("string"), F.lit("date"), (page * 10).cast("string"), F.lit("etag"), tag
        ).alias("headers"),
        tag.alias("payload_digest"),
    )
    later = page * 10 + 5 + (page % 7) * 1000 - F.when(page % 13 == 0, 10_000_000).otherwise(0)
    sent = F.when(page % 5 == 0, F.lit("outdated")).when(page % 5 == 1, F.lit(None)).otherwise(F.concat(F.lit("W/"), tag))
    revisit = pages.select(
        (page * 2 + 1).alias("capture_id"),
        F.concat(F.regexp_replace("url", "^https?://", "HTTP://www."), F.lit("#again")).alias("url"),
        later.alias("ts"),
        F.lit(304).alias("status"),
        sent.alias("etag"),
        F.when(page % 3 != 0, (page % 97).cast("string")).alias("last_modified"),
        F.create_map(F.lit("date"), later.cast("string"), F.lit("content-length"), F.lit("0"), F.lit("set-cookie"), F.lit("x")).alias("headers"),
        F.lit(None).cast("string").alias("payload_digest"),
    )
    return response.unionByName(revisit)


def revisit_digest(pages: DataFrame) -> DataFrame:
    """One row per capture; merged headers as sorted text."""
    out = resolve_revisits(captures_of_pages(pages.select("page_id", "url", "html")))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "; ")
    return out.select("capture_id", "canonical", "ts", "status", "outcome", "source_id", "payload_digest", text.alias("merged_headers"))


ORACLE = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
c AS (
  SELECT page_id * 2 AS capture_id, url, page_id * 10 AS ts, 200 AS status, md5(html) AS etag, CAST(page_id % 97 AS VARCHAR) AS lm,
    CAST(strlen(html) AS VARCHAR) AS len, CAST(page_id * 10 AS VARCHAR) AS dt, md5(html) AS digest FROM p
  UNION ALL
  SELECT page_id * 2 + 1, regexp_replace(url, '^https?://', 'HTTP://www.') || '#again',
    page_id * 10 + 5 + (page_id % 7) * 1000 - CASE WHEN page_id % 13 = 0 THEN 10000000 ELSE 0 END, 304,
    CASE page_id % 5 WHEN 0 THEN 'outdated' WHEN 1 THEN NULL ELSE 'W/' || md5(html) END,
    CASE WHEN page_id % 3 <> 0 THEN CAST(page_id % 97 AS VARCHAR) END, '0',
    CAST(page_id * 10 + 5 + (page_id % 7) * 1000 - CASE WHEN page_id % 13 = 0 THEN 10000000 ELSE 0 END AS VARCHAR), NULL FROM p),
b AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS bare FROM c),
u AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^(?:[A-Za-z]+://)?([^/?]*)', 1)), '^(www|m)[.]', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(bare, '^(?:[A-Za-z]+://)?[^/?]*([^?]*)', 1), '/+$', '') AS path,
    regexp_replace(regexp_extract(bare, '[?](.*)$', 1), '(^|&)(utm_[a-z]+|gclid|fbclid|ref)=[^&]*', '', 'g') AS q0 FROM b),
k AS (SELECT *, array_to_string(list_sort(list_filter(string_split(q0, '&'), lambda x: x <> '')), '&') AS q FROM u),
n AS (SELECT *, CASE WHEN url IS NOT NULL THEN host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical FROM k),
r AS (SELECT canonical, ts, capture_id, etag, lm, len, digest FROM n WHERE status = 200 AND canonical IS NOT NULL),
s AS (SELECT n.*, r.capture_id AS rid, r.etag AS retag, r.lm AS rlm, r.len AS rlen, r.digest AS rdigest,
    row_number() OVER (PARTITION BY n.capture_id ORDER BY r.ts DESC, r.capture_id DESC) AS rn
  FROM n LEFT JOIN r ON n.status = 304 AND n.canonical = r.canonical AND (r.ts < n.ts OR (r.ts = n.ts AND r.capture_id < n.capture_id))),
o AS (SELECT *, CASE WHEN status <> 304 THEN 'response' WHEN rid IS NULL THEN 'orphan'
    WHEN CASE WHEN etag IS NOT NULL AND retag IS NOT NULL THEN regexp_replace(etag, '^W/', '') = regexp_replace(retag, '^W/', '')
      ELSE coalesce(lm = rlm, false) END THEN 'resolved' ELSE 'mismatch' END AS outcome FROM s WHERE rn = 1)
SELECT capture_id, canonical, ts, status, outcome, CASE WHEN outcome = 'resolved' THEN rid END AS source_id,
  CASE WHEN outcome = 'resolved' THEN rdigest ELSE digest END AS payload_digest,
  CASE outcome WHEN 'response' THEN 'content-length: ' || len || '; date: ' || dt || '; etag: ' || etag
    WHEN 'resolved' THEN 'content-length: ' || rlen || '; date: ' || dt || '; etag: ' || retag
    ELSE 'content-length: 0; date: ' || dt || '; set-cookie: x' END AS merged_headers
FROM o
"""
