"""Helpers that the operators share: scratch tables and distributed prefix sums."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests) gets a folder of its
    own; a cluster without it is an error, because executors share no disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return f"file://{_LOCAL['dir']}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` cut from its lineage: written to the shared folder and read again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one job in the shared folder; those not ``kept`` are deleted when the job ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failed) -> None:
        for path in self.paths:
            removed(self.spark, path)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go when the query ends, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


#: Bytes of a batch that a Python worker gets at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches, which else hold 10,000 rows however long their texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def keeping_columns(docs: DataFrame, used: tuple[str, ...], step) -> DataFrame:
    """``step`` applied to ``docs`` while columns that it does not use bear other names, so that no name of theirs clashes."""
    names = {c: c if c in used else f"__own_{k}" for k, c in enumerate(docs.columns)}
    out = step(docs.toDF(*names.values()))
    return out.select(*(F.col(new).alias(old) for old, new in names.items()))


#: Rows of a few longs that may be broadcast; a larger table is joined by shuffling.
BROADCAST_ROWS = 1 << 20


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it was counted to have at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing will read again."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def crc_fold(col: str, folds: int) -> Column:
    """crc32 of the column as text, modulo ``folds``; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % folds


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(df: DataFrame, group: list[str], order: list[str], values: list[str], name: str) -> DataFrame:
    """Adds ``before_<v>``: the sum of ``v`` over the group's earlier rows.

    Rows are dealt by range of (group, order), so one large group spreads over
    many partitions.  Each task adds running sums within its partition while it
    streams the sorted rows, the result is written once, the per-partition
    totals (at most one row per partition and group) give every partition its
    offset, and a join adds the two.  Rows that tie on (group, order) are in
    arbitrary order, so ``order`` must tell apart all rows that differ.
    """
    spark = df.sparkSession
    fields = [*df.schema.fields, T.StructField("_part", T.IntegerType()), *(T.StructField(f"before_{v}", T.LongType()) for v in values)]
    schema = T.StructType(fields)
    dealt = df.repartitionByRange(shuffle_width(spark), *group, *order).sortWithinPartitions(*group, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, carry = None, [0] * len(values)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = list(zip(*(batch.column(g).to_pylist() for g in group))) if group else [()] * n
            starts = [i for i in range(n) if (i and keys[i] != keys[i - 1])]
            edges = [0, *starts, n]
            if keys[0] != last:
                carry = [0] * len(values)
            columns = []
            for k, v in enumerate(values):
                x = np.asarray(batch.column(v).to_numpy(zero_copy_only=False), dtype=np.int64)
                out = np.empty(n, dtype=np.int64)
                run_sum = carry[k]
                for a, b in zip(edges, edges[1:]):
                    if a:
                        run_sum = 0
                    c = np.cumsum(x[a:b])
                    out[a:b] = c - x[a:b] + run_sum
                    run_sum += int(c[-1])
                carry[k] = run_sum
                columns.append(pa.array(out))
            last = keys[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), *columns], names=[f.name for f in fields])

    table = written(dealt.mapInArrow(run, schema), name)
    totals = table.groupBy("_part", *group).agg(*(F.sum(v).alias(f"_sum_{v}") for v in values))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_part").alias("_p"),
        *(F.col(g).alias(f"_g_{g}") for g in group),
        *(F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_off_{v}") for v in values),
    )
    on = F.col("_part") == F.col("_p")
    for g in group:
        on &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = table.join(offsets, on)
    return joined.select(*df.columns, *((F.col(f"before_{v}") + F.col(f"_off_{v}")).alias(f"before_{v}") for v in values))
