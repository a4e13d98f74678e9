"""Operator 1, sharding: contiguous shards of near-equal byte size.

Rows are ordered by ``doc_id`` (then by a hash of the text, then by a seeded
random number, so that one id held by many rows still spreads).  Global byte
prefix sums come from per-partition totals; the total is cut at equal targets
and every row goes to the shard that holds the middle of its byte range.

Results in edge cases: a null text has no bytes (size 1, crc of no bytes: 0);
a null id sorts first; repeated rows are sharded one by one; an empty table
gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prefix_sums

SHARDS = 16


def assign_shards(docs: DataFrame, shards: int = SHARDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, *keep) per row."""
    bytes_of = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id"),
        *keep,
        (F.octet_length(bytes_of).cast("long") + 1).alias("size"),
        F.crc32(bytes_of).alias("text_crc32"),
        F.xxhash64("text").alias("_tie"),
        F.rand(17).alias("_any"),
        F.lit(1).cast("long").alias("_one"),
    )
    placed = prefix_sums(rows, [], ["doc_id", "_tie", "_any"], ["size", "_one"], "shards")
    total = placed.agg(F.sum("size").alias("_total"))
    place = F.expr(f"((2 * before_size + size) * {shards}) div (2 * _total)")
    cut = placed.crossJoin(F.broadcast(total)).withColumn("shard", F.least(F.lit(shards - 1), place).cast("int"))
    starts = cut.groupBy("shard").agg(F.min("before__one").alias("_start"))
    return cut.join(F.broadcast(starts), "shard").select(
        "doc_id",
        *keep,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before__one") - F.col("_start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
