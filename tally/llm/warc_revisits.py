"""Not-modified revisit records resolved to the full response they stand for.

A revisit carries no body.  It is joined as-of, by canonical URL, to the
latest earlier full response; if the validators agree, the response's body and
headers stand, with the headers a 304 may renew taken from the revisit.

The as-of join never puts one URL's records into one task: time is cut into
``slices``, the last full response of each (URL, slice) comes from a partial
aggregate, a window over those few rows carries it into later slices, and only
the records of one URL and slice meet in a window.

Defined results: equal times go by record id, a response before a revisit of
its own id; responses equal in both go by a hash of their body and headers, and
a revisit takes headers and body of one and the same of them; a null URL or a
null time matches nothing; without a full response, or with validators that
disagree or are missing on either side, a revisit stays unresolved; repeated
records are resolved one by one, each response by its own body; no records, no
rows; extra columns pass through and those named like a result give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Headers that a not-modified response may renew (HTTP caching).
RENEWED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]

SLICES = 64


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` or ``m.``, path without trailing slash or ``.html``, tracking parameters and fragment dropped."""
    u = F.regexp_replace(url, "#.*$", "")
    u = F.regexp_replace(u, "(?i)([?&])(?:(?:utm_[a-z]+|ref)=[^&]*(?:&|$))+", "$1")
    u = F.regexp_replace(u, "[?&]+$", "")
    u = F.regexp_replace(u, "(?i)^[a-z]+://(www\\.|m\\.)?", "")
    u = F.regexp_replace(u, "(/+|\\.html?)$", "")
    return F.concat(F.lower(F.regexp_extract(u, "^[^/?]*", 0)), F.regexp_replace(u, "^[^/?]*", ""))


def _agrees(own: Column, theirs: Column) -> Column:
    strip = lambda c: F.regexp_replace(c, "^W/", "")  # noqa: E731  weak comparison
    return F.coalesce(strip(own) == strip(theirs), F.lit(False))


def validates(revisit: Column, response: Column) -> Column:
    """Entity tag first, else the modification time; a digest on both sides must agree as well."""
    tag, time = revisit["etag"], revisit["last-modified"]
    by_tag = _agrees(tag, response["etag"])
    by_time = F.coalesce(time == response["last-modified"], F.lit(False))
    digest = F.coalesce(revisit["warc-payload-digest"] == response["warc-payload-digest"], F.lit(True))
    return F.when(tag.isNotNull(), by_tag).otherwise(by_time) & digest


def merge_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, those a 304 may renew replaced where the revisit has them."""
    renewed = F.map_filter(revisit, lambda k, v: k.isin(*RENEWED) & v.isNotNull())
    kept = F.map_filter(response, lambda k, v: ~F.array_contains(F.map_keys(renewed), k))
    return F.map_concat(kept, renewed)


def resolve(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """Resolve the revisits of ``records``: record_id, url, time (long), kind (``response`` or ``revisit``), headers (lower-case map), body.

    Adds ``canonical_url``, ``refers_to`` (record_id), ``resolved``,
    ``merged_headers`` and ``resolved_body``; responses stand for themselves.
    """
    names = ("canonical_url", "refers_to", "resolved", "merged_headers", "resolved_body")
    is_full = F.coalesce(F.col("kind") == "response", F.lit(False))
    rows = records.drop(*names).withColumn("canonical_url", canonical_url(F.col("url")))
    columns = [F.col(f"`{c}`") for c in rows.columns if c != "body"]
    # Responses stand for themselves; only what the others need goes through a shuffle.
    stand = rows.where(is_full).select(*columns, F.lit(True).alias("resolved"), F.col("record_id").alias("refers_to"), F.col("headers").alias("merged_headers"), F.col("body").alias("resolved_body"))
    low, high = rows.agg(F.min("time"), F.max("time")).first()
    low, width = low or 0, ((high or 0) - (low or 0)) // slices + 1
    # Bodies stay at home: only ids and headers are carried, the body is joined at the end.
    slim = rows.select(*columns, F.xxhash64("body", F.sort_array(F.map_entries("headers"))).alias("__mark"), F.expr(f"(time - {low}L) div {width}L").alias("__slice"))
    usable = F.col("canonical_url").isNotNull() & F.col("time").isNotNull()
    full = F.struct("time", F.col("record_id").alias("id"), "headers", F.col("__mark").alias("mark"))
    last = slim.where(is_full & usable).groupBy("canonical_url", "__slice").agg(F.max_by(full, F.struct("time", "record_id", "__mark")).alias("__last"))
    some = slim.where(usable).select("canonical_url", "__slice").distinct()
    per_url = Window.partitionBy("canonical_url").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = some.join(last, ["canonical_url", "__slice"], "left").withColumn("__before", F.last("__last", ignorenulls=True).over(per_url)).drop("__last")
    # A revisit stands behind a response of its time and id.
    inside = Window.partitionBy("canonical_url", "__slice").orderBy("time", "record_id", (~is_full).cast("int"), "__mark").rowsBetween(Window.unboundedPreceding, -1)
    matched = slim.where(usable).join(carried, ["canonical_url", "__slice"]).withColumn("__full", F.coalesce(F.last(F.when(is_full, full), ignorenulls=True).over(inside), F.col("__before")))
    matched = matched.where(~is_full).drop("__before").unionByName(slim.where(~is_full & ~usable), allowMissingColumns=True)
    found, own = F.col("__full"), F.col("headers")
    ok = F.coalesce((F.col("kind") == "revisit") & found.isNotNull() & validates(own, found["headers"]), F.lit(False))
    again = matched.withColumn("resolved", ok).select(
        *columns, "resolved", F.when(F.col("resolved"), found["id"]).alias("refers_to"), F.when(F.col("resolved"), merge_headers(found["headers"], own)).alias("merged_headers"),
        F.when(F.col("resolved"), found["time"]).alias("__time"), F.when(F.col("resolved"), found["mark"]).alias("__found"))
    # Responses alike in all of these are alike in body.
    bodies = rows.where(is_full & usable).select(
        F.col("canonical_url").alias("__url"), F.col("record_id").alias("__id"), F.col("time").alias("__at"),
        F.xxhash64("body", F.sort_array(F.map_entries("headers"))).alias("__mark"), F.col("body").alias("resolved_body")).dropDuplicates(["__url", "__id", "__at", "__mark"])
    same = (again["canonical_url"] == bodies["__url"]) & again["refers_to"].eqNullSafe(bodies["__id"]) & (again["__time"] == bodies["__at"]) & (again["__found"] == bodies["__mark"])
    again = again.join(bodies, same, "left").drop("__url", "__id", "__at", "__mark", "__time", "__found")
    return stand.unionByName(again)
