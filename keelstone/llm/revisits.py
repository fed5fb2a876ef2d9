"""Resolution of not-modified revisit records to the full response they stand for.

A revisit refers to the latest full response of its canonical URL that was captured before
it. Its validators must agree with that response; then the response's payload stands, and
its headers are updated by those of the revisit that a 304 may change.

The as-of join is a union and a running last value. Records are dealt in the order of URL
and time, so one URL's history may span many tasks; only the last response of a URL in each
range is carried on to the ranges after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelstone.llm.batches import parallelism
from keelstone.session import cut_lineage

#: Header fields that describe the message body or the connection; a
#: not-modified response does not change them.
NOT_MERGED = (
    "connection",
    "content-encoding",
    "content-length",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-authenticate",
    "proxy-connection",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
)
#: Query parameters that do not name another page.
TRACKING = "^(utm_[a-z]+|fbclid|gclid)="


def canonical_url(url: Column) -> Column:
    """Host, path and query that name the page; null stays null.

    Scheme, default ports, a leading ``www.``, the fragment, closing slashes and tracking
    parameters go; the host is lower case, parameters are in order.
    """
    rest = F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, "#.*$", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www[0-9]*[.]", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    asked = F.split(F.regexp_extract(rest, "[?](.*)$", 1), "&")
    kept = F.array_sort(F.filter(asked, lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(url.isNotNull(), F.concat(host, path, query))


def _plain_tag(tag: Column) -> Column:
    """Entity tags compare weakly for a not-modified answer."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def validated(own: Column, base: Column, digest: Column, base_digest: Column) -> Column:
    """Whether a revisit's validators agree with a response.

    Entity tags decide where both have one, else modification times where both have one;
    a payload digest, where both have one, must agree as well. Nothing in common is no
    proof.
    """
    tag, base_tag = own["etag"], base["etag"]
    date, base_date = own["last-modified"], base["last-modified"]
    by_digest = digest == base_digest
    by_header = F.when(
        tag.isNotNull() & base_tag.isNotNull(), _plain_tag(tag) == _plain_tag(base_tag)
    ).when(date.isNotNull() & base_date.isNotNull(), date == base_date)
    return F.coalesce(by_header & by_digest, by_header, by_digest, F.lit(False))


def merged(base: Column, own: Column) -> Column:
    """Headers of the response, those that the revisit may change taken from it."""
    changes = F.map_filter(own, lambda k, _: ~k.isin(*NOT_MERGED))
    names = F.map_keys(changes)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(names, k)), changes)


def resolve_revisits(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """A row per revisit: what it resolves to and its full headers.

    ``records`` has ``record_id, uri, captured, kind, headers, payload_digest``: ``kind`` is
    ``response`` or ``revisit`` (others are ignored), ``headers`` a map with lower-case
    names. The result has ``record_id, url_key, status, base_record_id, payload_digest,
    headers``; status is ``resolved``, ``changed`` (the validators disagree) or ``missing``
    (no earlier response, or no URL or time). Unresolved revisits keep their own headers and
    have no base.

    Earlier means a smaller ``(captured, record_id)``. Null headers count as none; repeated
    revisits are answered each; an empty table gives no rows; extra columns are ignored.
    """
    empty = F.create_map().cast("map<string,string>")
    rows = records.select(
        F.col("record_id").alias("_id"),
        canonical_url(F.col("uri")).alias("_key"),
        F.col("captured").alias("_time"),
        F.col("kind").alias("_kind"),
        F.coalesce(F.col("headers"), empty).alias("_headers"),
        F.col("payload_digest").alias("_digest"),
    ).filter(F.col("_kind").isin("response", "revisit"))
    linked = F.col("_key").isNotNull() & F.col("_time").isNotNull()
    response = F.struct("_id", "_headers", "_digest")
    dealt = cut_lineage(
        rows.withColumn("_base", F.when((F.col("_kind") == "response") & linked, response))
        .withColumn("_spread", F.when(~linked, F.xxhash64("_id")))
        .repartitionByRange(ranges or parallelism(records.sparkSession), "_key", "_spread", "_time", "_id")
        .withColumn("_range", F.spark_partition_id())
    )
    unlinked = dealt.filter(~linked).withColumn("_found", F.lit(None).cast(dealt.schema["_base"].dataType))
    order = ["_time", "_id", F.col("_kind").desc()]
    inside = Window.partitionBy("_range", "_key").orderBy(*order)
    local = dealt.filter(linked).withColumn(
        "_found", F.last("_base", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    )
    # The last response of every URL that several ranges share, carried to the later ones.
    lasts = (
        dealt.filter(linked)
        .groupBy("_key", "_range")
        .agg(F.max_by("_base", F.when(F.col("_base").isNotNull(), F.struct("_time", "_id"))).alias("_last"))
    )
    earlier = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        lasts.withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier))
        .filter(F.col("_carried").isNotNull())
        .select("_key", "_range", "_carried")
    )
    found = (
        local.filter(F.col("_kind") == "revisit")
        .join(carried, ["_key", "_range"], "left")
        .withColumn("_found", F.coalesce("_found", "_carried"))
        .drop("_carried")
        .unionByName(unlinked.filter(F.col("_kind") == "revisit"))
    )
    base = F.col("_found")
    agrees = validated(F.col("_headers"), base["_headers"], F.col("_digest"), base["_digest"])
    status = F.when(base.isNull(), "missing").when(agrees, "resolved").otherwise("changed")
    resolved = F.col("status") == "resolved"
    return found.withColumn("status", status).select(
        F.col("_id").alias("record_id"),
        F.col("_key").alias("url_key"),
        "status",
        F.when(resolved, base["_id"]).alias("base_record_id"),
        F.when(resolved, F.coalesce(base["_digest"], F.col("_digest"))).alias("payload_digest"),
        F.when(resolved, merged(base["_headers"], F.col("_headers"))).otherwise(F.col("_headers")).alias("headers"),
    )
