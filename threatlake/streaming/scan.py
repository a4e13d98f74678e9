"""An addition: the character and pattern detectors over a stream of arriving files.

Files that arrive again within the watermark are recognised by the hash of their
contents and scanned once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import FAMILIES, ThreatEngine

ARRIVALS = "path string, content string, arrived timestamp"


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of JSON rows (path, content, arrived) written to ``folder``."""
    return spark.readStream.schema(ARRIVALS).json(folder)


def unseen(files: DataFrame, delay: str = "1 hour") -> DataFrame:
    return files.withWatermark("arrived", delay).withColumn("sha256", F.sha2("content", 256)).dropDuplicatesWithinWatermark(["path", "sha256"])


def scan_stream(files: DataFrame, output: str, checkpoint: str, engine: ThreatEngine | None = None) -> StreamingQuery:
    """Appends findings as Parquet; every micro-batch is scanned by the batch engine."""
    chosen = engine or ThreatEngine.default(("l1",))

    def batch(rows: DataFrame, number: int) -> None:
        chosen.scan(rows.select("path", "content")).withColumn("batch", F.lit(number)).write.mode("append").parquet(output)

    return unseen(files).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def severity_by_window(files: DataFrame, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """A stream of invisible characters by severity in tumbling windows of arrival."""
    found = FAMILIES["invisible"](files.withWatermark("arrived", delay).withColumn("path", F.concat_ws("\t", F.col("arrived").cast("string"), "path")))
    at = F.to_timestamp(F.split("path", "\t")[0])
    return found.groupBy(F.window(at, width).alias("window"), "severity").agg(F.count(F.lit(1)).alias("n"))
