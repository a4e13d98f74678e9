"""Query of operator 5 and its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .mixing import mix_sources
from .shared import read_documents


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_documents(spark, sf_dir)).drop("source")


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws(':', CAST(doc_id AS VARCHAR), '0')) AS key
  FROM documents
),
src AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source)
),
ratio AS (SELECT *, 3 * source_size AS most, CAST(3 * source_size AS DOUBLE) / w AS ratio FROM src),
lev AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER o, 0) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS DOUBLE) AS level
  FROM ratio WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
fin AS (SELECT level AS final FROM lev WHERE ratio >= level ORDER BY ratio, source LIMIT 1),
tgt AS (SELECT source, source_size, least(CAST(most AS DOUBLE), coalesce(final * w, CAST(most AS DOUBLE))) AS target FROM lev LEFT JOIN fin ON true),
pos AS (
  SELECT base.doc_id, base.size, source_size, target,
         sum(base.size) OVER (PARTITION BY base.source ORDER BY key, doc_id, base.size ROWS UNBOUNDED PRECEDING) - base.size AS before,
         coalesce(CAST(floor(target) AS BIGINT) // nullif(source_size, 0), 0) AS epochs
  FROM base JOIN tgt ON base.source IS NOT DISTINCT FROM tgt.source
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM pos
"""

QUERIES = {"op5_mixing": op5_mixing}
ORACLES = {"op5_mixing": ORACLE}
