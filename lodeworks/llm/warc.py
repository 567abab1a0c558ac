"""WARC revisit records resolved by an as-of join (operator 6).

A ``revisit`` record of the profile server-not-modified stands for a body that the
server did not send again. It is resolved to the latest earlier full response of
the same canonical URL, if their validators agree; the response's headers, updated
by those that a 304 may change, then describe the body.

All captures of a URL at one time are first made one point, with the largest record
id among its full responses. The as-of join is two windows over points, neither over
all of a URL: points of a URL with more than ``SLICE_POINTS`` are cut into slices at
quantiles of their own times, so that neither a burst nor a wrong date fills a slice,
and each slice takes the last full response of the slices before it, of which a URL
has at most ``MOST_SLICES``. A URL with a third of all captures is thus cut into many
tasks.

Rules: full responses have the kind ``response`` and the status 200; earlier means
a smaller time; of two responses at one time the larger record id is the later
one. Validators: if both sides have an ETag they must match, weak marks aside;
else, if both have Last-Modified, it must be the same; else, if the revisit names
a payload digest, it must be the response's; else nothing can be checked.

Edge cases: a revisit with a null URL or time has no response; a null headers map
is an empty one; header names are compared in lower case; a response without a
record id can be referred to, by nothing; of responses with one record id, URL and
time the largest by digest, then headers, stands for all; repeated revisits are
resolved each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.common import Scratch, broadcast_if_small

#: Points of a URL up to which it is one slice, and most slices of a URL.
SLICE_POINTS, MOST_SLICES = 50_000, 4096
BROADCAST_BYTES = 8 << 20
#: Headers of a 304 response that replace those of the stored one (fixed values, from the HTTP standard).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without its last slash, query without ``utm_`` parameters; no scheme, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(F.lower(p), F.lit("utm_"))))
    return F.concat(host, path, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(""))


def lower_names(headers: Column) -> Column:
    """The map with names in lower case; of names that then clash, the last value in order of the original names."""
    entries = F.array_sort(F.map_entries(headers))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    last = F.filter(F.transform(entries, lambda e, k: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"), k.alias("k"))), lambda e: ~F.array_contains(F.slice(names, e["k"] + 2, F.size(names) + 1), e["key"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each revisit of ``records`` (record_id, url, ts, kind, status, headers, payload_digest).

    Returns (record_id, canonical_url, ts, refers_to, outcome, headers, payload_digest); the outcome is
    ``resolved``, ``no_response``, ``mismatch`` or ``no_validator``, and the last two columns and ``refers_to``
    are null but for the first.
    """
    scratch = Scratch(records.sparkSession, "warc")
    rows = records.select(
        F.col("record_id").cast("string").alias("record_id"),
        canonical_url(F.col("url")).alias("canonical_url"),
        F.col("ts").cast("long").alias("ts"),
        (F.col("kind") == "revisit").alias("revisit"),
        F.coalesce((F.col("kind") == "response") & (F.col("status") == 200) & F.col("url").isNotNull() & F.col("ts").isNotNull(), F.lit(False)).alias("full"),
        lower_names(F.coalesce("headers", F.create_map().cast("map<string,string>"))).alias("headers"),
        "payload_digest",
    ).where("revisit or full")
    points = rows.where("canonical_url is not null and ts is not null").groupBy("canonical_url", "ts")
    points = scratch.write(points.agg(F.max(F.when(F.col("full"), F.struct("ts", "record_id"))).alias("stored"), F.max("revisit").alias("asked")), "points")
    busy = points.groupBy("canonical_url").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SLICE_POINTS)
    busy = scratch.write(busy, "busy")
    cuts = points.join(broadcast_if_small(scratch, busy, "busy", BROADCAST_BYTES), "canonical_url").groupBy("canonical_url")
    cuts = cuts.agg(F.percentile_approx("ts", [k / MOST_SLICES for k in range(1, MOST_SLICES)], 4 * MOST_SLICES).alias("quantiles"), F.max("n").alias("n"))
    step = F.greatest(F.lit(1), F.floor(MOST_SLICES / F.ceil(F.col("n") / SLICE_POINTS)).cast("int"))  # as many slices as it has points for
    cuts = cuts.select("canonical_url", F.filter("quantiles", lambda x, k: (k + 1) % step == 0).alias("cuts"))
    cuts = scratch.write(cuts, "cuts")
    sliced = points.join(broadcast_if_small(scratch, cuts, "cuts", BROADCAST_BYTES), "canonical_url", "left")
    points = sliced.select("canonical_url", "ts", "stored", "asked", F.coalesce(F.size(F.filter("cuts", lambda x: x <= F.col("ts"))), F.lit(0)).alias("slice"))
    # what the slices before have: one row for each URL and slice
    before = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = points.groupBy("canonical_url", "slice").agg(F.max("stored").alias("end"))
    prior = ends.select("canonical_url", "slice", F.last("end", ignorenulls=True).over(before).alias("prior"))
    # what the slice itself has before
    inside = Window.partitionBy("canonical_url", "slice").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    own = points.withColumn("own", F.last("stored", ignorenulls=True).over(inside)).where("asked")
    asof = own.join(prior, ["canonical_url", "slice"]).select("canonical_url", "ts", F.coalesce("own", "prior").alias("last")).where("last is not null")
    asof = scratch.write(asof.select(F.col("canonical_url").alias("at_url"), F.col("ts").alias("at_ts"), F.col("last.ts").alias("last_ts"), F.col("last.record_id").alias("last_id")), "asof")
    revisits = rows.where("revisit").select("record_id", "canonical_url", "ts", "headers", "payload_digest")
    found = revisits.join(asof, (F.col("canonical_url") == F.col("at_url")) & (F.col("ts") == F.col("at_ts")), "left")
    entries = F.array_sort(F.map_entries("headers"))
    stored = rows.where("full").groupBy("canonical_url", "ts", "record_id").agg(F.max(F.struct("payload_digest", entries.alias("entries"))).alias("kept"))
    stored = stored.select(
        F.col("canonical_url").alias("stored_url"), F.col("ts").alias("stored_ts"), F.col("record_id").alias("stored_id"),
        F.map_from_entries("kept.entries").alias("stored"), F.col("kept.payload_digest").alias("stored_digest"),
    )
    stored = scratch.write(stored, "stored")  # its own exchange in the join below, so that a response with very many revisits can be split
    at = (F.col("at_url") == F.col("stored_url")) & (F.col("last_ts") == F.col("stored_ts")) & F.col("last_id").eqNullSafe(F.col("stored_id"))
    both = found.join(stored, at, "left")
    strong = lambda h: F.regexp_replace(F.element_at(h, "etag"), "^W/", "")
    agree = F.coalesce(
        strong(F.col("headers")) == strong(F.col("stored")),
        F.element_at("headers", "last-modified") == F.element_at("stored", "last-modified"),
        F.col("payload_digest") == F.col("stored_digest"),
    )
    outcome = F.when(F.col("stored_ts").isNull(), "no_response").when(agree.isNull(), "no_validator").when(agree, "resolved").otherwise("mismatch")
    news = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.map_contains_key(news, k)), news)
    only = lambda c: F.when(F.col("outcome") == "resolved", c)
    return both.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "ts", only(F.col("stored_id")).alias("refers_to"), "outcome", only(merged).alias("headers"), only(F.col("stored_digest")).alias("payload_digest")
    )


def captures(pages: DataFrame) -> DataFrame:
    """An archive of the pages table for the query: each page as a response, and a later (or earlier) revisit of each.

    Some responses are errors, some lack an ETag or all validators, some revisits have a stale ETag.
    """
    n, digest = F.col("page_id"), F.md5(F.coalesce("html", F.lit("")))
    every = lambda k: n % k == 0
    etag = F.when(~every(5), F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"')))
    modified = F.when(~every(35), (n * 10).cast("string"))
    present = lambda *pairs: F.map_filter(F.create_map(*[x for p in pairs for x in p]), lambda k, v: v.isNotNull())
    response = pages.select(
        F.concat(F.lit("r"), n).alias("record_id"),
        "url",
        (n * 10).alias("ts"),
        F.lit("response").alias("kind"),
        F.when(every(13), 404).otherwise(200).alias("status"),
        present((F.lit("ETag"), etag), (F.lit("Last-Modified"), modified), (F.lit("Content-Type"), F.lit("text/html")), (F.lit("Cache-Control"), F.lit("max-age=60")), (F.lit("Date"), (n * 10).cast("string"))).alias("headers"),
        digest.alias("payload_digest"),
    )
    ts = n * 10 + F.when(every(11), -5).otherwise(5)
    revisit = pages.select(
        F.concat(F.lit("v"), n).alias("record_id"),
        F.regexp_replace("url", "#.*$", "").alias("url"),
        ts.alias("ts"),
        F.lit("revisit").alias("kind"),
        F.lit(304).alias("status"),
        present((F.lit("etag"), F.when(every(7), F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), etag))), (F.lit("last-modified"), modified), (F.lit("cache-control"), F.lit("max-age=120")), (F.lit("date"), ts.cast("string")), (F.lit("set-cookie"), F.lit("a=b")), (F.lit("content-length"), F.lit("0"))).alias("headers"),
        F.lit(None).cast("string").alias("payload_digest"),
    )
    return response.unionByName(revisit)
