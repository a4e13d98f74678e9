"""Detectors of others: one Python function, run by the engine or called from SQL.

A function takes a file's path and content and yields (line, column, category,
severity, description).  ``detector`` makes it a detector for ``ThreatEngine.register``;
``register_detector`` makes it a table function of the session:

    SELECT f.path, d.* FROM files f, LATERAL my_detector(f.path, f.content) d

Both give the same rows; files without any do not appear, in an outer LATERAL
join neither.  A file on which the function fails stops the query with the
file's path in the error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from .findings import finding

Found = Iterable[tuple[int, int, str, str, str]]
ROW = "line bigint, column bigint, category string, severity string, description string"


def _rows(find: Callable[[str, str], Found], path: str | None, content: str | None) -> Iterator[tuple]:
    if content is None:
        return
    try:
        for line, column, category, severity, description in find(path, content):
            yield line, column, category, severity, description
    except Exception as error:
        raise RuntimeError(f"detector failed on {path}: {error!r}") from error


def detector(name: str, find: Callable[[str, str], Found]) -> Callable[[DataFrame], DataFrame]:
    """A detector over files(path, content) that makes the function's rows findings."""

    def detect(files: DataFrame) -> DataFrame:
        def run(batches: Iterator) -> Iterator:
            import pandas as pd

            columns = ["path", *(part.split()[0] for part in ROW.split(", "))]
            for batch in batches:
                yield pd.DataFrame([(path, *row) for path, content in zip(batch["path"], batch["content"]) for row in _rows(find, path, content)], columns=columns)

        return finding(files.select("path", "content").mapInPandas(run, f"path string, {ROW}"), name, 0)

    return detect


def register_detector(spark: SparkSession, name: str, find: Callable[[str, str], Found]) -> None:
    """Registers the function as a table function ``name(path, content)`` for SQL's LATERAL joins."""

    class Detect:
        def eval(self, path: str, content: str):
            yield from _rows(find, path, content)

    spark.udtf.register(name, udtf(Detect, returnType=ROW))
