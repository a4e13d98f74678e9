"""Query of operator 1 and its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import read_documents
from .sharding import assign_shards


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(read_documents(spark, sf_dir))


#: crc32 by table lookup over the text's bytes; the table comes from the polynomial 0xEDB88320.
ORACLE = """
WITH RECURSIVE step(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END FROM step WHERE k < 8
),
tab AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8),
base AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size FROM documents
),
crc AS (
  SELECT base.*, CAST(xor(4294967295::UBIGINT, list_reduce(
      list_transform(range(strlen(text)), lambda i: CAST(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS UBIGINT)),
      lambda a, b: xor(a >> 8, tab[CAST(xor(a & 255, b) AS BIGINT) + 1]), 4294967295::UBIGINT)) AS BIGINT) AS text_crc32
  FROM (SELECT *, hex(encode(text)) AS h FROM base) base, tab
),
pos AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total,
         row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM crc
),
cut AS (SELECT *, CAST(least(15, ((2 * before + size) * 16) // (2 * total)) AS INTEGER) AS shard FROM pos)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       CAST(idx - min(idx) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""

QUERIES = {"op1_sharding": op1_sharding}
ORACLES = {"op1_sharding": ORACLE}
