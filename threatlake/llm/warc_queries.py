"""Query of operator 8 and its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .warc import archive_folder, read_records, write_archives


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = archive_folder(spark)
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_records(index, folder, with_payload=False).drop("url")


#: base32 of the SHA-1: its 160 bits in 32 groups of five.
ORACLE = """
WITH base AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages
),
bits AS (
  SELECT *, array_to_string(list_transform(range(40), lambda i: right('0000' || bin(CAST('0x' || substr(sha, CAST(i + 1 AS BIGINT), 1) AS INTEGER)), 4)), '') AS b FROM base
),
named AS (
  SELECT page_id, payload_bytes, sha, array_to_string(list_transform(range(32), lambda g:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform(range(5), lambda k: CAST(substr(b, CAST(5 * g + k + 1 AS BIGINT), 1) AS INTEGER) * (16 >> CAST(k AS INTEGER)))) + 1 AS BIGINT), 1)), '') AS payload_digest
  FROM bits
),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first_id FROM named)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""

QUERIES = {"op8_warc": op8_warc}
ORACLES = {"op8_warc": ORACLE}
