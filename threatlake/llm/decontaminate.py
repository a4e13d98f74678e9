"""Operator 10, benchmark decontamination by the q-gram lemma.

Benchmark items are cut into windows of at most WINDOW normalised bytes that
overlap by half.  A window occurs in a document if some stretch of it lies
within ``e`` edits, a tenth of the window's length.  Such an occurrence shares
at least L + 1 - q (e + 1) q-grams with the window, all within e + 1 neighbouring
diagonals; so hits are counted in overlapping bands of 2 (e + 1) diagonals, the
bands that reach the bound are kept, and a banded alignment verifies each.  An
item is found in a document if any of its windows is, and reported with the
share of its windows found.

Text is normalised to case-folded words (Unicode's full folding, composed by
NFC) of letters, digits and non-ASCII characters parted by single blanks.

The benchmark is read in blocks of at most BLOCK windows, each small enough to
broadcast, and every block is held against all documents, whole texts, in one
scan; so the benchmark may have any size.

Results in edge cases: null or empty texts match nothing, null or empty items
are found nowhere; equal items are each found; a document is named once per
item, also if its row is repeated; empty tables give an empty result; very long
texts go piece by piece with overlap; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keeping_columns, small_batches, written

WINDOW, RATE, BLOCK = 96, 10, 20_000
#: The length from which windows are cut into 8-grams; below it the lemma's bound would be empty, so shorter ones use 4-grams.
LONG = 32
PIECE, SLICE = 1 << 20, 500

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def folded(text: bytes) -> bytes:
    """Non-ASCII text in NFC and without case; bytes that are no UTF-8 stay as they are."""
    composed = unicodedata.normalize("NFC", text.decode("utf-8", "surrogateescape"))
    return unicodedata.normalize("NFC", composed.casefold()).encode("utf-8", "surrogateescape")


def normalised(text: bytes | None) -> bytes:
    text = text or b""
    return b" ".join((text if text.isascii() else folded(text)).translate(_FOLD).split())


def windows_of(item: bytes) -> list[bytes]:
    """The item's windows: of WINDOW bytes at every half window, the last one flush with the end."""
    if len(item) <= WINDOW:
        return [item] if item else []
    starts = [*range(0, len(item) - WINDOW, WINDOW // 2), len(item) - WINDOW]
    return [item[s : s + WINDOW] for s in starts]


def budget(length: int) -> int:
    """Edits that an occurrence may have."""
    return length // RATE


def grams(text: bytes, q: int) -> np.ndarray:
    """The text's q-grams (q a power of 2 up to 8) as 64-bit numbers."""
    x = np.frombuffer(text, dtype=np.uint8).astype(np.uint64)
    for width in (w for w in (1, 2, 4) if w < q):
        x = x[:-width] | (x[width:] << np.uint64(8 * width)) if len(x) > width else x[:0]
    return x


def banded_distances(patterns: list[bytes], texts: list[bytes], lows: list[int], span: int) -> np.ndarray:
    """The least edits that turn each pattern into a stretch of its text starting on a diagonal in [low, low + span).

    All patterns have one length.  The band reaches the pattern's budget beyond
    the diagonals at either side, so an alignment within the budget is found
    exactly; all pairs advance together, one pattern character at a time.
    """
    size = len(patterns[0])
    margin = budget(size)
    width = span + 2 * margin
    first = np.array(lows, dtype=np.int64) - margin
    cut = [(b"\0" * -f + t[: max(0, width + size + f)] if f < 0 else t[f : f + width + size]).ljust(width + size, b"\0")[: width + size] for t, f in zip(texts, first.tolist())]
    data = np.frombuffer(b"".join(cut), dtype=np.uint8).reshape(len(texts), width + size)
    pattern = np.frombuffer(b"".join(patterns), dtype=np.uint8).reshape(len(texts), size)
    steps = np.arange(width, dtype=np.int16)
    begins = first[:, None] + steps
    ends = np.array([len(t) for t in texts], dtype=np.int64)[:, None]
    inside = (begins >= 0) & (begins <= ends) & (steps >= margin) & (steps < margin + span)
    row = np.where(inside, 0, 20_000).astype(np.int16)
    for i in range(size):
        new = row + (data[:, i : i + width] != pattern[:, i : i + 1])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row.min(axis=1)


class Grams:
    """Q-grams of some windows of a block: sorted grams with postings, and a table that rules most grams out."""

    BITS = 20
    SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, windows: list[bytes], numbers: list[int], q: int):
        self.q = q
        listed = [(k, grams(windows[k], q)) for k in numbers]
        gram = np.concatenate([g for _, g in listed])
        order = np.argsort(gram, kind="stable")
        self.window = np.concatenate([np.full(len(g), k, dtype=np.int64) for k, g in listed])[order]
        self.offset = np.concatenate([np.arange(len(g), dtype=np.int64) for _, g in listed])[order]
        self.gram, self.start, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << self.BITS, dtype=bool)
        self.table[self._slot(self.gram)] = True
        lengths = np.array([len(w) for w in windows], dtype=np.int64)
        self.edits = lengths // RATE
        self.bound = lengths + 1 - q * (self.edits + 1)

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return ((gram * self.SPREAD) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def candidates(self, text: bytes) -> list[tuple[int, int, int]]:
        """(window, lowest, highest diagonal) of the bands that reach the lemma's bound."""
        gram = grams(text, self.q)
        at = np.flatnonzero(self.table[self._slot(gram)])
        if not len(at) or not len(self.gram):
            return []
        found = np.minimum(np.searchsorted(self.gram, gram[at]), len(self.gram) - 1)
        real = self.gram[found] == gram[at]
        at, found = at[real], found[real]
        times = self.count[found]
        total = int(times.sum())
        if not total:
            return []
        posting = np.repeat(self.start[found] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(total)
        window, offset = self.window[posting], self.offset[posting]
        diagonal = np.repeat(at, times) - offset + WINDOW
        band = diagonal // (self.edits[window] + 1)
        span = np.int64(len(text) + 2 * WINDOW + 2)
        cell = window * span + band
        # bands overlap: a band's hits are those of two neighbouring half bands
        half, hits = np.unique(cell, return_counts=True)
        beside = np.zeros_like(hits)
        beside[:-1] = np.where(half[1:] == half[:-1] + 1, hits[1:], 0)
        bound = self.bound[half // span]
        busy = hits + beside >= bound
        lone = (np.concatenate([[-1], half[:-1]]) != half - 1) & (hits >= bound) & (half % span > 0)
        wide = np.concatenate([half[busy], half[lone] - 1])
        if not len(wide):
            return []
        kept = np.zeros(len(half), dtype=bool)
        kept[np.isin(half, np.concatenate([wide, wide + 1]))] = True
        at_half = kept[np.searchsorted(half, cell)]
        cell, offset, band = cell[at_half], offset[at_half], band[at_half]
        # each of the window's grams counts once in a band, however often the text repeats it there
        key = np.unique(np.concatenate([cell, cell[band > 0] - 1]) * WINDOW + np.concatenate([offset, offset[band > 0]]))
        cell, hits = np.unique(key // WINDOW, return_counts=True)
        which, band = cell // span, cell % span
        full = hits >= self.bound[which]
        which, band = which[full], band[full]
        low = band * (self.edits[which] + 1) - WINDOW
        return list(zip(which.tolist(), low.tolist(), (low + 2 * (self.edits[which] + 1) - 1).tolist()))



class Index:
    """A block of windows, each looked up by the q-grams that its length allows; below RATE bytes no edit is allowed, so those are found as whole words."""

    def __init__(self, windows: list[bytes]):
        self.windows = windows
        self.edits = [budget(len(w)) for w in windows]
        self.words = {k: b" " + w + b" " for k, w in enumerate(windows) if not self.edits[k]}
        split = [(q, [k for k, w in enumerate(windows) if self.edits[k] and (len(w) >= LONG) == (q == 8)]) for q in (8, 4)]
        self.parts = [Grams(windows, numbers, q) for q, numbers in split if numbers]

    def search(self, texts: list[bytes]) -> list[dict[int, int]]:
        """Per normalised text {window: least edits} of the windows that occur in it."""
        found: list[dict[int, int]] = [{} for _ in texts]
        asked: dict[int, list[tuple[int, int, bytes, int]]] = {}
        for number, text in enumerate(texts):
            here = found[number]
            if self.words:
                padded = b" " + text + b" "
                here.update((k, 0) for k, w in self.words.items() if w in padded)
            at = 0
            while True:
                piece = text[at : at + PIECE]
                for k, low, high in (c for part in self.parts for c in part.candidates(piece)):
                    if here.get(k) == 0:
                        continue
                    window, edits = self.windows[k], self.edits[k]
                    begin = max(0, low - edits)
                    stretch = piece[begin : max(0, high + len(window) + edits)]
                    if window in stretch:
                        here[k] = 0
                    else:
                        asked.setdefault(len(window), []).append((number, k, stretch, low - begin))
                if at + PIECE >= len(text):
                    break
                at += PIECE - 4 * WINDOW
        for size, rows in asked.items():
            edits = budget(size)
            for at in range(0, len(rows), 4096):
                part = [r for r in rows[at : at + 4096] if found[r[0]].get(r[1]) != 0]
                if not part:
                    continue
                distances = banded_distances([self.windows[r[1]] for r in part], [r[2] for r in part], [r[3] for r in part], 2 * (edits + 1))
                for (number, k, _, _), distance in zip(part, distances.tolist()):
                    if distance <= edits:
                        found[number][k] = min(distance, found[number].get(k, distance))
        return found


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_windows, window) of all items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, len(w), x) for i, text in zip(*(c.to_pylist() for c in batch.columns)) for w in [windows_of(normalised(text))] for x in w]
            columns = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["item_id", "n_windows", "window"])

    return benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).mapInArrow(cut, "item_id long, n_windows long, window binary")


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, n_windows, n_found, edits): every item of which a window occurs in a document.

    ``text_key`` is xxhash64 of the text, ``edits`` the fewest edits of a found
    window; the caller may ask for a larger share n_found / n_windows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    table = written(benchmark_windows(benchmark), "benchmark")
    distinct = written(table.groupBy("window").agg(F.count(F.lit(1)).alias("n")), "windows")
    blocks = max(1, -(-distinct.count() // (BLOCK // 2)))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary"))
    schema = "doc_id long, text_key long, found binary, edits int"
    hits, held = None, []
    for block in range(blocks):
        part = distinct.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).select("window")
        shared = spark.sparkContext.broadcast([bytes(r[0]) for r in part.collect()])
        held.append(shared)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for batch in batches:
                out, ids, keys = [], batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for at in range(0, batch.num_rows, SLICE):
                    texts = [normalised(t.as_py()) for t in batch.column(2).slice(at, SLICE)]
                    for k, found in enumerate(index.search(texts)):
                        out += [(ids[at + k], keys[at + k], index.windows[w], n) for w, n in found.items()]
                columns = list(zip(*out)) if out else [[], [], [], []]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "text_key", "found", "edits"])

        one = rows.mapInArrow(search, schema)
        hits = one if hits is None else hits.unionByName(one)
    found = written(hits, "window-hits")
    for shared in held:
        shared.destroy()
    met = found.join(table, F.col("found") == F.col("window"))
    # an item may hold the same window twice
    own = table.groupBy("item_id").agg(F.countDistinct("window").alias("n_own")).select(F.col("item_id").alias("_item"), "n_own")
    items = met.groupBy("doc_id", "text_key", "item_id").agg(F.countDistinct("window").alias("n_found"), F.min("edits").alias("edits"))
    joined = items.join(own, F.col("item_id").eqNullSafe(F.col("_item")))
    return joined.select("doc_id", "text_key", "item_id", F.col("n_own").alias("n_windows"), "n_found", "edits")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item is found, with their columns unchanged."""

    def kept(rows: DataFrame) -> DataFrame:
        found = contaminations(rows, benchmark).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
        same = F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_key"))
        return rows.join(written(found, "contaminated"), same, "left_anti")

    return keeping_columns(docs, ("doc_id", "text"), kept)
