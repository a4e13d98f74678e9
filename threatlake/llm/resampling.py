"""Operator 11, importance resampling towards a target distribution.

Features are the runs of up to ``n`` consecutive words; a feature's bucket is the
CRC of its bytes modulo ``buckets``.  The most frequent words of documents and
target form a dictionary of at most ``dictionary`` entries.  Every worker builds
an Aho-Corasick automaton of the entries between delimiters, whose payload is
the entry's CRC and length; a scan of the delimited text emits payloads, and the
payloads of adjacent words compose to the CRCs of longer runs (a linear map of
the left CRC by the right length), so that no run is ever spelled out.  Words
that the dictionary lacks get their payload from their own bytes, so the
dictionary's bound is one of speed and memory only.

One scan of documents and target counts the buckets, all of them summed per task
before the shuffle; a second one scores the documents; the best are ranked by
distributed prefix sums over the range-sorted scores.

Results in edge cases: null or empty texts have no features and weight 0; a null
id hashes as the empty text and sorts first; rows that repeat an id all count,
and rows equal in all values are interchangeable; an empty target has no counts;
an empty table gives an empty result; very long texts are scanned whole; other
columns are not read.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, prefix_sums, small_batches, written

#: Entries of the dictionary, and the bytes that an entry may have.
DICTIONARY, ENTRY_BYTES = 1 << 15, 48
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lower case for A-Z, a blank for every delimiter; bytes of longer characters belong to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_POLYNOMIAL = 0xEDB88320


def _applied(rows: list[int], value: int) -> int:
    """The linear map with these images of the 32 bits, applied to one value."""
    out = 0
    for bit, image in enumerate(rows):
        if value >> bit & 1:
            out ^= image
    return out


@functools.lru_cache(maxsize=1)
def _shifts() -> list[np.ndarray]:
    """For every power of two, four tables of 256 entries that move a CRC past so many zero bytes."""
    step = [_POLYNOMIAL if bit == 0 else 1 << (bit - 1) for bit in range(32)]
    for _ in range(3):  # one bit, two, four, eight
        step = [_applied(step, x) for x in step]
    out = []
    for _ in range(32):
        out.append(np.array([[_applied(step, byte << 8 * k) for byte in range(256)] for k in range(4)], dtype=np.uint32))
        step = [_applied(step, x) for x in step]
    return out


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each CRC moved past ``length`` zero bytes; the CRC of AB is that of A moved by B's length, xor that of B."""
    crc = crc.copy()
    for power, table in enumerate(_shifts()):
        at = np.flatnonzero(length >> power & 1)
        if len(at):
            x = crc[at]
            crc[at] = table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]
        elif not (length >> power).any():
            break
    return crc


@functools.lru_cache(maxsize=1)
def _automaton(words: tuple[bytes, ...]):
    """(automaton of the delimited words, their CRCs, their lengths)."""
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, word in enumerate(words):
        found.add_word(f" {word.decode('latin-1')} ", k)
    if words:
        found.make_automaton()
    return found, np.array([zlib.crc32(w) for w in words], dtype=np.uint32), np.array([len(w) for w in words], dtype=np.int64)


def payloads(words: tuple[bytes, ...], texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, CRC, length) of every word of the texts, in order."""
    joined = b" ".join(t or b"" for t in texts).translate(_FOLD)
    ends_of_text = np.cumsum([len(t or b"") + 1 for t in texts])
    solid = np.concatenate(([False], np.frombuffer(joined, dtype=np.uint8) != 32, [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    crc, known = np.zeros(len(starts), dtype=np.uint32), np.zeros(len(starts), dtype=bool)
    if words and len(starts):
        automaton, crcs, lengths = _automaton(words)
        hits = np.fromiter(automaton.iter(f" {joined.decode('latin-1')} "), dtype=[("end", np.int64), ("entry", np.int64)])
        at = np.searchsorted(starts, hits["end"] - lengths[hits["entry"]] - 1)
        crc[at], known[at] = crcs[hits["entry"]], True
    for k in np.flatnonzero(~known).tolist():
        crc[k] = zlib.crc32(joined[starts[k] : ends[k]])
    return np.searchsorted(ends_of_text, starts, side="right"), crc, ends - starts


def runs(text: np.ndarray, crc: np.ndarray, length: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, CRC) of all runs of 1 to ``n`` adjacent words, joined by one blank."""
    texts, crcs = [text], [crc]
    blank = zlib.crc32(b" ")
    long = crc
    for width in range(2, n + 1):
        if len(text) < width:
            break
        right = slice(width - 1, None)
        parted = shifted(long[:-1], np.ones(len(long) - 1, dtype=np.int64)) ^ np.uint32(blank)
        long = shifted(parted, length[right]) ^ crc[right]
        within = text[: len(long)] == text[right]
        texts.append(text[right][within])
        crcs.append(long[within])
    return np.concatenate(texts), np.concatenate(crcs)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORDS), F.lit(0))


def frequent_words(texts: DataFrame, entries: int) -> tuple[bytes, ...]:
    """The most frequent words that fit into an entry.

    Words are counted once and fall into classes of about equal counts; the
    highest classes that together have at most ``entries`` words are taken, so
    that no task sends more than belongs to the dictionary.
    """
    counted = texts.select(F.explode(_words(F.col("text"))).alias("word")).where(F.octet_length("word") <= ENTRY_BYTES).groupBy("word").count()
    with Scratch(texts.sparkSession) as scratch:
        rows = scratch.written(counted.select("word", F.floor(8 * F.log2("count")).cast("int").alias("class")), "words")
        taken, least = 0, None
        for row in sorted(rows.groupBy("class").count().collect(), reverse=True):
            taken += row["count"]
            if taken > entries:
                break
            least = row["class"]
        if least is None:
            return ()
        return tuple(r.word.encode() for r in sorted(rows.where(F.col("class") >= least).collect(), key=lambda r: (-r["class"], r.word)))


def bucket_counts(texts: DataFrame, words, n: int, buckets: int) -> np.ndarray:
    """Features per bucket over all ``texts``; ``words`` is the broadcast dictionary."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                _, crcs = runs(*payloads(words.value, batch.column(0).to_pylist()), n)
                total += np.bincount(crcs.astype(np.int64) % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    table = texts.select(F.col("text").cast("binary")).mapInArrow(counted, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for row in table.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed frequencies, rounded down."""
    m, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = [float(t + 1) * float(s_all + m) / (float(s + 1) * float(t_all + m)) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], dtype=np.int64)


def weighted(docs: DataFrame, words, gains, n: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) per row: the rounded-down mean gain of the row's features."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            text, crc, length = payloads(words.value, batch.column("text").to_pylist())
            text_of, crcs = runs(text, crc, length, n)
            gain = gains.value[crcs.astype(np.int64) % len(gains.value)]
            features = np.bincount(text_of, minlength=rows)
            total = np.bincount(text_of, weights=gain, minlength=rows).astype(np.int64)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.bincount(text, minlength=rows)), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(scored, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10, dictionary: int = DICTIONARY) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) per row of ``docs``; ``rank`` is null for rows that are not drawn.

    The score adds Gumbel noise from a hash of the id, so that the best scores
    are a draw without replacement in proportion to the importance weights.
    """
    spark = docs.sparkSession
    small_batches(spark)
    words = spark.sparkContext.broadcast(frequent_words(docs.select("text").unionByName(target.select("text")), dictionary))
    gains = spark.sparkContext.broadcast(bucket_gains(bucket_counts(docs, words, n, buckets), bucket_counts(target, words, n, buckets)))
    try:
        digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
        h = F.conv(digits, 16, 10).cast("double")
        noise = F.floor(F.lit(-1000) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
        scored = written(weighted(docs, words, gains, n).withColumn("score", F.col("weight") + noise), "resample")
    finally:
        words.destroy()
        gains.destroy()
    able = F.col("n_words") >= least_words
    drawn = percent * scored.where(able).count() // 100
    ordered = scored.where(able).withColumns({"_down": -F.col("score"), "_one": F.lit(1).cast("long")})
    ranked = prefix_sums(ordered, [], ["_down", "doc_id", "n_features", "weight"], ["_one"], "ranks")
    place = F.col("before__one") + 1
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    rest = scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, F.when(place <= drawn, place).alias("rank")).unionByName(rest)
