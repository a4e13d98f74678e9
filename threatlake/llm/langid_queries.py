"""Query of operator 4; held-out accuracy tests it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .langid import identify
from .shared import read_documents


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_documents(spark, sf_dir))


QUERIES = {"op4_langid": op4_langid}
ORACLES: dict[str, str] = {}
