"""Query of operator 6; held-out labels test it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .quality import score_quality
from .shared import read_documents


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op6_quality": op6_quality}
ORACLES: dict[str, str] = {}
