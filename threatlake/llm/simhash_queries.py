"""Query of operator 9; DuckDB has no such hash, so brute force tests it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import read_documents
from .simhash import fingerprint_edits


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read_documents(spark, sf_dir))


QUERIES = {"op9_simhash": op9_simhash}
ORACLES: dict[str, str] = {}
