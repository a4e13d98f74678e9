"""Query of operator 13 and its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .neighbours import nearest


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where("vec_id % 100 = 0"))


#: Sums run over the components in their order, as in the operator.
ORACLE = """
WITH fine AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), lambda a, b: a + b)) AS score
  FROM fine q JOIN fine c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

QUERIES = {"op13_neighbours": op13_neighbours}
ORACLES = {"op13_neighbours": ORACLE}
