"""Query of operator 10; banded alignment has no SQL form, so brute force tests it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminations
from .shared import read_documents


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminations(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.groupBy("doc_id", "item_id", "n_windows").agg(F.max("n_found").alias("n_found"), F.min("edits").alias("edits"))


QUERIES = {"op10_decontaminate": op10_decontaminate}
ORACLES: dict[str, str] = {}
