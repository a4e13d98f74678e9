"""Files as rows: folders, tables, package archives."""

from __future__ import annotations

import gzip
import io
import tarfile
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import DEFAULT_EXCLUDES, DEFAULT_EXTENSIONS


def files_from_paths(spark: SparkSession, paths: list[str], extensions: list[str] | None = None, excludes: list[str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """(path, content, sha256) of the text files below ``paths``.

    The extension glob keeps other files from being read; folders with an
    excluded name below a root are left out; bytes that are not UTF-8 are no text.
    """
    text = F.col("content").cast("string")
    rows = _read(spark, paths, extensions, excludes, max_bytes).where(F.is_valid_utf8(text))
    return rows.select("path", text.alias("content"), F.sha2("content", 256).alias("sha256"))


def unreadable_files(spark: SparkSession, paths: list[str], extensions: list[str] | None = None, excludes: list[str] | None = None) -> DataFrame:
    """(path, length, reason) of the files that ``files_from_paths`` passes over because they are no text."""
    return _read(spark, paths, extensions, excludes, None).where(~F.is_valid_utf8(F.col("content").cast("string"))).select("path", "length", F.lit("not UTF-8").alias("reason"))


def _read(spark: SparkSession, paths: list[str], extensions: list[str] | None, excludes: list[str] | None, max_bytes: int | None) -> DataFrame:
    kept = DEFAULT_EXTENSIONS if extensions is None else extensions
    barred = DEFAULT_EXCLUDES if excludes is None else excludes
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join([*kept, "_"]) + "}").load(paths)
    if max_bytes is not None:
        read = read.where(F.col("length") <= max_bytes)
    roots = "|".join("\\Q" + p.rstrip("/").split("://")[-1] + "\\E" for p in paths)
    below = F.regexp_replace("path", f"^(?:[a-z]+:)?/*?(?:{roots})", "")
    return read.where(~F.exists(F.split(below, "/"), lambda s: s.isin(barred)))


def files_from_table(table: DataFrame, path: str, content: str) -> DataFrame:
    """A table's rows as files; ``path`` and ``content`` are SQL expressions."""
    return table.select(F.expr(path).alias("path"), F.expr(content).alias("content")).where("content IS NOT NULL")


#: Bytes that all members of an archive may have unpacked.
UNPACKED_BYTES = 1 << 30
#: Bytes of members that a Python worker hands on at once.
_BATCH_BYTES = 8 << 20


def archive_members(archives: DataFrame, most_bytes: int = UNPACKED_BYTES) -> DataFrame:
    """(archive, sha256, path, content) of the text members of gzipped tar archives (path, content).

    Members that would leave the archive's folder, links and undecodable bytes
    are passed over; ``damaged_archives`` lists what could not be unpacked.
    """
    out = unpacked(archives, most_bytes)
    text = F.col("content").cast("string")
    return out.where("reason IS NULL").where(F.is_valid_utf8(text)).select("archive", "sha256", "path", text.alias("content"))


def damaged_archives(archives: DataFrame, most_bytes: int = UNPACKED_BYTES) -> DataFrame:
    """(archive, sha256, reason) of the archives that could not be read to their end."""
    return unpacked(archives, most_bytes).where("reason IS NOT NULL").select("archive", "sha256", "reason")


def unpacked(archives: DataFrame, most_bytes: int = UNPACKED_BYTES) -> DataFrame:
    """(archive, sha256, path, content, reason) of all members; an archive that could not be read to its end has one more row, with the reason.

    The members before the damage are kept.  Members are handed on as they are
    read, so a task holds one of them and one batch; an archive that unpacks to
    more than ``most_bytes`` ends there, with that as its reason.
    """

    def members(data: bytes) -> Iterator[tuple[str | None, bytes | None, str | None]]:
        left = most_bytes
        try:
            unzipped = gzip.GzipFile(fileobj=io.BytesIO(data))
            with tarfile.open(fileobj=unzipped, mode="r|") as tar:
                for member in tar:
                    left -= member.size
                    if left < 0:
                        yield None, None, f"unpacks to more than {most_bytes} bytes"
                        return
                    parts = member.name.split("/")
                    if member.isfile() and ".." not in parts and not member.name.startswith("/"):
                        content = tar.extractfile(member).read()
                        if len(content) < member.size:
                            raise EOFError("ends within a member")
                        yield "/".join(parts[1:]) or member.name, content, None
            # the checksum stands at the end
            while left > 0 and (rest := len(unzipped.read(1 << 20))):
                left -= rest
        except (tarfile.TarError, zlib.error, EOFError, OSError, ValueError, OverflowError) as damage:
            yield None, None, f"{type(damage).__name__}: {damage}"

    def unpack(batches: Iterator) -> Iterator:
        import pandas as pd

        columns = ["archive", "sha256", "path", "content", "reason"]
        for batch in batches:
            rows, size = [], 0
            for archive, sha, data in zip(batch["archive"], batch["sha256"], batch["content"]):
                for path, content, reason in members(data):
                    rows.append((archive, sha, path, content, reason))
                    size += len(content or b"")
                    if size > _BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
            yield pd.DataFrame(rows, columns=columns)

    listed = archives.where("content IS NOT NULL").select(F.col("path").alias("archive"), F.sha2("content", 256).alias("sha256"), "content")
    return listed.mapInPandas(unpack, "archive string, sha256 string, path string, content binary, reason string")
