"""Operator 5, mixing: every source's words are taken up to its target.

Sources are ranked by code point (null last) and weigh 1, 2, 3, repeating.  The
targets share all words by weight; no target passes ``cap`` times its source's
size, and what a capped source leaves is shared again by weight (water filling,
solved by prefix sums over the per-source table).  Within a source, documents
are range-sorted by a seeded hash of the id; distributed prefix sums of their
word counts tell which documents fall below the source's budget.  A budget
above the source's size first takes whole epochs.

Results in edge cases: a null text has no words and is taken 0 times; equal
hashes are ordered by id and size, and rows equal in all of these are
interchangeable; a source without words has the target 0; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import keeping_columns, prefix_sums, written

WORDS = r"[^\x20\x09-\x0D]+"
CAP = 3


def source_targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    The table has one row per source and its windows run in one task over that
    table only: it is meant for up to some millions of sources.
    """
    ranked = sizes.withColumn("w", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    ranked = ranked.withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    earlier = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(earlier), F.lit(0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(earlier), F.lit(0)))
    filled = ranked.withColumn("level", level)
    final = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "source", "level"))).over(whole)["level"]
    filled = filled.withColumn("final", final)
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("final") * F.col("w"), F.col("most").cast("double")))
    return filled.select("source", "source_size", target.alias("target"))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")


def _key(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(str(seed))).cast("binary"))


def _placed(docs: DataFrame, cap: int, seed: int) -> DataFrame:
    """Every row with its source's target, whole epochs, and the words of the last, partial epoch."""
    rows = docs.select("doc_id", "source", _size().alias("size"), _key(seed).alias("_key"))
    placed = prefix_sums(rows, ["source"], ["_key", "doc_id", "size"], ["size"], "mix")
    targets = source_targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), cap)
    targets = targets.select(F.col("source").alias("_source"), "source_size", "target")
    budget = F.floor("target")
    epochs = F.expr("coalesce(floor(target) div nullif(source_size, 0), 0)")
    joined = placed.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("epochs", epochs)
    rest = budget - F.col("epochs") * F.col("source_size")
    return joined.withColumn("last", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before_size"))))


def mix_sources(docs: DataFrame, cap: int = CAP, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) per row of ``docs``."""
    taken = (F.col("epochs") * F.col("size") + F.col("last")).cast("long")
    return _placed(docs, cap, seed).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, cap: int = CAP, seed: int = 0) -> DataFrame:
    """``docs`` with every row repeated once per epoch that takes it; rows that none takes go.

    The last epoch takes the rows up to the one at which the budget is reached,
    that one whole.  One cut key per source says so; the texts are not shuffled.
    """
    place = lambda: F.struct(_key(seed).alias("k"), F.col("doc_id").alias("d"), _size().alias("s"))
    at = F.when(F.col("last") > 0, F.struct(F.col("_key").alias("k"), F.col("doc_id").alias("d"), F.col("size").alias("s")))

    def mixed(rows: DataFrame) -> DataFrame:
        cuts = _placed(rows, cap, seed).groupBy("source").agg(F.max(at).alias("_cut"), F.max("epochs").alias("_epochs"))
        cuts = written(cuts.withColumnRenamed("source", "_source"), "cuts")
        copies = F.col("_epochs") + F.coalesce((place() <= F.col("_cut")).cast("int"), F.lit(0))
        joined = rows.join(cuts, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_copies", copies).where("_copies > 0")
        return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))

    return keeping_columns(docs, ("doc_id", "source", "text"), mixed)
