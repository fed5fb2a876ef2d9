"""Web captures derived from the given pages, and the SQL that resolves their revisits.

Every page has a full response; every fourth is captured a second time with another body.
Every page has a later not-modified revisit, under another spelling of its URL, with strong
or weak entity tags, modification times or digests, some of them stale or missing; some
revisits come before any response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Both engines run this text; header fields are columns, NULL where a record has none.
CAPTURES = """
SELECT page_id, page_id * 4 AS record_id, url AS uri, 1700000000 + page_id AS captured, 'response' AS kind,
       '"' || md5(html) || '"' AS etag, 'day 1 of ' || CAST(page_id AS STRING) AS last_modified,
       'max-age=60' AS cache_control, 'text/html' AS content_type, CAST(length(html) AS STRING) AS content_length,
       'archive' AS server, 'md5:' || md5(html) AS payload_digest
FROM pages
UNION ALL
SELECT page_id, page_id * 4 + 1, url, 1700000500 + page_id, 'response',
       '"' || md5(html || '2') || '"', 'day 2 of ' || CAST(page_id AS STRING),
       'no-cache', 'text/html', CAST(length(html) + 1 AS STRING), 'archive', 'md5:' || md5(html || '2')
FROM pages WHERE page_id % 4 = 0
UNION ALL
SELECT page_id, page_id * 4 + 2,
       CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN replace(url, 'https://', 'HTTP://www.')
            ELSE url || CASE WHEN url LIKE '%#%' THEN 'x' WHEN url LIKE '%?%' THEN '&utm_medium=r' ELSE '/?utm_source=r#t' END END,
       CASE WHEN page_id % 13 = 0 THEN 1699999999 + page_id ELSE 1700000001 + page_id + page_id % 7 * 200 END, 'revisit',
       CASE WHEN page_id % 11 = 0 THEN '"stale"' WHEN page_id % 5 = 0 THEN NULL
            WHEN page_id % 2 = 0 THEN 'W/"' || md5(html) || '"' ELSE '"' || md5(html) || '"' END,
       CASE WHEN page_id % 3 = 0 THEN 'day 1 of ' || CAST(page_id AS STRING) END,
       'max-age=' || CAST(page_id % 100 AS STRING), 'text/plain', '0', NULL,
       CASE WHEN page_id % 6 = 0 THEN NULL ELSE 'md5:' || md5(html) END
FROM pages
"""

#: Header field -> column of ``CAPTURES``.
FIELDS = {
    "cache-control": "cache_control",
    "content-length": "content_length",
    "content-type": "content_type",
    "etag": "etag",
    "last-modified": "last_modified",
    "server": "server",
}


def captures(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The records, with their header fields as a map."""
    rows = spark.sql(CAPTURES.replace("FROM pages", "FROM {pages}"), pages=pages)
    pairs = [x for name, column in FIELDS.items() for x in (F.lit(name), F.col(column))]
    return rows.withColumn("headers", F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()))


def header_text(headers: Column) -> Column:
    """``name: value`` lines in order."""
    lines = F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(F.array_sort(lines), "\n")


def _lines(values: dict[str, str]) -> str:
    parts = ", ".join(f"'{name}: ' || {value}" for name, value in values.items())
    return f"array_to_string(list_sort(list_filter([{parts}], lambda x: x IS NOT NULL)), chr(10))"


_OWN = {name: f"r.{column}" for name, column in FIELDS.items()}
_MERGED = {
    name: f"b.{column}" if name.startswith("content-") else f"coalesce(r.{column}, b.{column})"
    for name, column in FIELDS.items()
}

ORACLE = f"""
WITH captures AS ({CAPTURES}),
parts AS (
  SELECT *, captured * 1000000000 + record_id AS place,
         regexp_replace(regexp_replace(trim(uri), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest
  FROM captures),
keyed AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www[0-9]*[.]', '')
            || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
            || CASE WHEN len(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'),
                             lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|fbclid|gclid)='))) > 0
                    THEN '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'),
                             lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|fbclid|gclid)='))), '&')
                    ELSE '' END AS url_key
  FROM parts),
found AS (
  SELECT r.record_id, r.url_key, b.record_id AS base_id,
         CASE WHEN r.etag IS NOT NULL AND b.etag IS NOT NULL
              THEN regexp_replace(r.etag, '^W/', '') = regexp_replace(b.etag, '^W/', '')
              WHEN r.last_modified IS NOT NULL AND b.last_modified IS NOT NULL
              THEN r.last_modified = b.last_modified END AS by_header,
         r.payload_digest = b.payload_digest AS by_digest,
         coalesce(b.payload_digest, r.payload_digest) AS digest,
         {_lines(_OWN)} AS own_headers, {_lines(_MERGED)} AS merged_headers
  FROM (SELECT * FROM keyed WHERE kind = 'revisit') r
  ASOF LEFT JOIN (SELECT * FROM keyed WHERE kind = 'response') b
    ON r.url_key = b.url_key AND r.place > b.place),
judged AS (
  SELECT *, CASE WHEN base_id IS NULL THEN 'missing'
                 WHEN coalesce(by_header AND by_digest, by_header, by_digest, FALSE) THEN 'resolved'
                 ELSE 'changed' END AS status
  FROM found)
SELECT record_id, url_key, status, CASE WHEN status = 'resolved' THEN base_id END AS base_record_id,
       CASE WHEN status = 'resolved' THEN digest END AS payload_digest,
       CASE WHEN status = 'resolved' THEN merged_headers ELSE own_headers END AS headers
FROM judged
"""
