"""Query of operator 11 and its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .resampling import resample
from .shared import read_documents


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("n_words")


#: CRC by table lookup over the bytes of the distinct words; the table comes from the polynomial 0xEDB88320.
ORACLE = r"""
WITH RECURSIVE step(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END FROM step WHERE k < 8
),
tab AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8),
cut AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
),
aim AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
own AS MATERIALIZED (SELECT r, unnest(w) AS word FROM cut),
vocabulary AS MATERIALIZED (
  SELECT word, CAST(xor(4294967295::UBIGINT, list_reduce(
      list_transform(range(strlen(word)), lambda i: CAST(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS UBIGINT)),
      lambda a, b: xor(a >> 8, tab[CAST(xor(a & 255, b) AS BIGINT) + 1]), 4294967295::UBIGINT)) % 10000 AS BIGINT) AS bucket
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM (SELECT word FROM own UNION ALL SELECT word FROM aim)), tab
),
s AS (SELECT bucket, count(*) AS s FROM own JOIN vocabulary USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aim JOIN vocabulary USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM own) + 10000 AS DOUBLE)
         / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM aim) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM vocabulary) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
),
means AS (SELECT r, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM own JOIN vocabulary USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS UBIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM cut LEFT JOIN means USING (r)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, (10 * count(*) FILTER (WHERE n_features >= 20) OVER ()) // 100 AS drawn FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM placed
"""

QUERIES = {"op11_resampling": op11_resampling}
ORACLES = {"op11_resampling": ORACLE}
