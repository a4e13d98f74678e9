"""Operator 6, quality: a linear-chain conditional random field over lines.

Every line has features of its bytes and words and some of its neighbours'; the
field labels each line good or bad, with weights for features and for pairs of
neighbouring labels.  Forward-backward sums give each line's marginal of good,
and a document's score is their mean weighted by line length.

A document's label does not tell which of its lines are bad.  So training first
fits a field without pairs on lines that all bear their document's label; lines
of bad documents that it finds good are then labelled so (the worst line of each
stays bad), and the field is fitted on these labels, from which pairs learn how
labels change.  It uses about ``sample`` labelled documents chosen by a hash of
the id, so the fit costs the same at every size.  Scoring reads whole texts.

Results in edge cases: a null text counts as empty, and an empty text is one
empty line; without labelled rows of both classes all weights are 0 and the
score is 0.5; repeated rows give repeated results; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_fold
from .shingles import mixed, word_hashes

SAMPLE, STEPS, RIDGE, THRESHOLD = 4000, 150, 1e-3, 0.3
#: Lines of a block; longer documents are several blocks, whose sums are joined at their borders.
BLOCK = 256


def _class(test) -> np.ndarray:
    return np.array([test(c) for c in range(256)], dtype=np.uint8)


_CLASSES = np.stack(
    [
        _class(lambda c: 65 <= c <= 90),
        _class(lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c > 127),
        _class(lambda c: chr(c) in "#$%&*@^~<>{}=\\/+_`[]"),
        _class(lambda c: c == 33),
        _class(lambda c: c == 124),
        _class(lambda c: 48 <= c <= 57),
        _class(lambda c: chr(c) in ".,;:?'\"()-"),
        _class(lambda c: c == 32 or 9 <= c <= 13),
    ]
)
_OWN = 13
FEATURES = 1 + _OWN + 2 * 6 + 2


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features per line, weight per line) of one text; lines end at U+000A."""
    data = np.frombuffer(text + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(ends)
    size = (ends - starts).astype(float)
    counts = [np.add.reduceat(table[data], starts, dtype=np.int64).astype(float) for table in _CLASSES]
    upper, letters, symbols, bangs, bars, digits, points, white = counts
    white -= 1  # the line's end
    gap = _CLASSES[7][data] == 1
    word_start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    line_of = np.searchsorted(ends, word_start)
    words = np.bincount(line_of, minlength=n).astype(float)
    hashes = word_hashes(text)
    distinct = np.zeros(n)
    again = np.zeros(n)
    if len(hashes):
        same_line = line_of[1:] == line_of[:-1]
        np.add.at(again, line_of[1:][same_line & (hashes[1:] == hashes[:-1])], 1)
        key = mixed(hashes + line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first = np.unique(key, return_index=True)
        distinct = np.bincount(line_of[first], minlength=n).astype(float)
    # the line's fingerprint, for lines that come again in the text
    mark = np.zeros(n, dtype=np.uint64)
    if len(hashes):
        np.add.at(mark, line_of, hashes)
    _, inverse, times = np.unique(mark, return_inverse=True, return_counts=True)
    repeated = (times[inverse] > 1) & (words > 0)
    last = data[np.maximum(ends - 1, 0)]
    closed = np.isin(last, (33, 46, 63)) & (size > 0)
    some = np.maximum(size, 1)
    own = np.stack(
        [
            np.log1p(size) / 5,
            upper / np.maximum(letters, 1),
            np.minimum(1, 5 * symbols / some),
            np.minimum(1, 10 * bangs / some),
            np.minimum(1, 10 * bars / some),
            digits / some,
            points / some,
            np.minimum(3, (size - white) / np.maximum(words, 1) / 10),
            1 - distinct / np.maximum(words, 1),
            again / np.maximum(words, 1),
            closed.astype(float),
            repeated.astype(float),
            (words < 4).astype(float),
        ],
        axis=1,
    )
    near = own[:, [0, 1, 2, 3, 4, 8]]
    none = np.zeros((1, near.shape[1]))
    first_line, last_line = np.zeros((n, 1)), np.zeros((n, 1))
    first_line[0], last_line[-1] = 1, 1
    before, after = np.concatenate([none, near[:-1]]), np.concatenate([near[1:], none])
    return np.concatenate([np.ones((n, 1)), own, before, after, first_line, last_line], axis=1), size + 1


def marginals(scores: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """P(good) per line by forward-backward sums; ``scores`` favour good, ``pairs[a, b]`` the label b after a (1 is good)."""
    top = pairs.max()
    p00, p01, p10, p11 = (math.exp(pairs[a, b] - top) for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)))
    clipped = np.clip(scores, -60, 60)
    good = (1 / (1 + np.exp(-clipped))).tolist()
    n = len(good)
    forward = [0.0] * n
    g = good[0]
    forward[0] = g
    for i in range(1, n):
        a1 = (g * p11 + (1 - g) * p01) * good[i]
        a0 = (g * p10 + (1 - g) * p00) * (1 - good[i])
        g = a1 / (a1 + a0)
        forward[i] = g
    out = [0.0] * n
    out[-1] = forward[-1]
    b1 = b0 = 0.5
    for i in range(n - 2, -1, -1):
        x1, x0 = good[i + 1] * b1, (1 - good[i + 1]) * b0
        b1, b0 = p11 * x1 + p10 * x0, p01 * x1 + p00 * x0
        total = b1 + b0
        b1, b0 = b1 / total, b0 / total
        f = forward[i]
        out[i] = f * b1 / (f * b1 + (1 - f) * b0)
    return np.array(out)


class Field:
    """Weights of the field: features are centred and scaled before."""

    def __init__(self, centre=None, scale=None, weights=None, pairs=None):
        self.centre = np.zeros(FEATURES) if centre is None else centre
        self.scale = np.ones(FEATURES) if scale is None else scale
        self.weights = np.zeros(FEATURES) if weights is None else weights
        self.pairs = np.zeros((2, 2)) if pairs is None else pairs

    def score(self, text: bytes | None) -> float:
        features, weight = line_features(text or b"")
        good = marginals(((features - self.centre) / self.scale) @ self.weights, self.pairs)
        return float(good @ weight / weight.sum())


def line_labels(sequences: list[np.ndarray], labels: list[int], first: Field) -> list[np.ndarray]:
    """Labels of lines: in bad documents those that ``first`` finds good are good, but for the worst of each."""
    out = []
    for lines, label in zip(sequences, labels):
        found = np.full(len(lines), label)
        if not label:
            scores = ((lines - first.centre) / first.scale) @ first.weights
            found = (scores > 0).astype(int)
            found[int(scores.argmin())] = 0
        out.append(found)
    return out


def fit(sequences: list[np.ndarray], labels: list[int], steps: int = STEPS) -> Field:
    """Weights from documents' features and labels, in two rounds."""
    if len(set(labels)) < 2:
        return Field()
    first = fit_lines(sequences, [np.full(len(s), label) for s, label in zip(sequences, labels)], steps, chained=False)
    return fit_lines(sequences, line_labels(sequences, labels, first), steps)


class Chains:
    """The lines of all documents, cut into blocks of at most ``BLOCK`` lines.

    Blocks stand by falling length, so line t of all blocks that have one is one
    array of places.  ``joints`` leads from each block to the next of its document.
    """

    def __init__(self, lengths: np.ndarray, block: int):
        self.lengths = lengths
        self.offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        parts = -(-lengths // block)
        doc = np.repeat(np.arange(len(lengths)), parts)
        index = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = self.offsets[doc] + index * block
        size = np.minimum(block, self.offsets[doc] + lengths[doc] - begin)
        order = np.argsort(-size, kind="stable")
        self.doc, self.index, self.begin, self.size = (x[order] for x in (doc, index, begin, size))
        self.last = self.begin + self.size - 1
        self.places = self._places(np.arange(len(order)))
        several = np.flatnonzero(parts[self.doc] > 1)
        self.several, self.several_places = several, self._places(several)
        self.inner = self.index > 0
        # blocks of one turn have the same place within their documents
        by_index = [several[self.index[several] == j] for j in range(int(parts.max()))] if len(several) else []
        at = np.empty(len(order), dtype=np.int64)
        at[order] = np.arange(len(order))
        self.joints = [(at[order[b] - 1], b) for b in by_index[1:]]

    def _places(self, blocks: np.ndarray) -> list[np.ndarray]:
        begin, size = self.begin[blocks], self.size[blocks]
        return [begin[: int((size > t).sum())] + t for t in range(int(size.max()))] if len(blocks) else []

    def borders(self, node: np.ndarray, pairs: np.ndarray, alpha: list[np.ndarray], beta: list[np.ndarray], add) -> None:
        """Sets the sums at the last lines of blocks of longer documents: products of the blocks' transfer matrices, from both ends."""
        if not len(self.several):
            return
        begin, inner = self.begin[self.several], self.inner[self.several]
        # sums over the labels of a block's lines by the label before the block and its last line's
        sums = [[np.where(inner, pairs[s, 0], 0.0), np.where(inner, pairs[s, 1], 0.0) + node[begin]] for s in (0, 1)]
        for here in self.several_places[1:]:
            n = len(here)
            for x in sums:
                a0, a1 = x[0][:n], x[1][:n]
                x[0][:n], x[1][:n] = add(a0 + pairs[0, 0], a1 + pairs[1, 0]), add(a0 + pairs[0, 1], a1 + pairs[1, 1]) + node[here]
        transfer = np.zeros((2, 2, len(self.begin)))
        for s in (0, 1):
            for t in (0, 1):
                transfer[s, t, self.several] = sums[s][t]
        firsts = self.several[~inner]
        for t in (0, 1):
            alpha[t][self.last[firsts]] = transfer[0, t, firsts]
        for before, here in self.joints:
            e0, e1 = alpha[0][self.last[before]], alpha[1][self.last[before]]
            for t in (0, 1):
                alpha[t][self.last[here]] = add(e0 + transfer[0, t, here], e1 + transfer[1, t, here])
        for before, here in reversed(self.joints):
            b0, b1 = beta[0][self.last[here]], beta[1][self.last[here]]
            for s in (0, 1):
                beta[s][self.last[before]] = add(transfer[s, 0, here] + b0, transfer[s, 1, here] + b1)


def fit_lines(sequences: list[np.ndarray], labels: list[np.ndarray], steps: int = STEPS, chained: bool = True) -> Field:
    """Maximum likelihood of line labels with a ridge, by Adam on all sequences at once; pairs stay 0 unless ``chained``."""
    order = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
    lengths = np.array([len(sequences[k]) for k in order])
    flat = np.concatenate([sequences[k] for k in order])
    label = np.concatenate([labels[k] for k in order])
    centre, scale = flat.mean(axis=0), flat.std(axis=0)
    centre[0], scale[0] = 0, 1
    scale[scale < 1e-6] = 1
    flat = (flat - centre) / scale
    docs, chains = len(lengths), Chains(lengths, BLOCK)
    inner = np.ones(len(flat), dtype=bool)
    inner[chains.offsets] = False
    after = np.flatnonzero(inner)
    seen = np.bincount(2 * label[after - 1] + label[after], minlength=4).astype(float)
    theta = np.zeros(flat.shape[1] + 4)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    add = np.logaddexp
    for step in range(1, steps + 1):
        w, pairs = theta[:-4], theta[-4:].reshape(2, 2)
        node = flat @ w
        if chained:
            p, expected = _expectations(node, pairs, chains, add)
        else:
            p, expected = 1 / (1 + np.exp(-np.clip(node, -60, 60))), seen
        gradient = np.concatenate([(label - p) @ flat, seen - expected]) / docs - RIDGE * theta
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        theta = theta + 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Field(centre, scale, theta[:-4], theta[-4:].reshape(2, 2))


def _expectations(node, pairs, chains: Chains, add) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line and the expected number of each pair of neighbouring labels, by forward-backward sums over all sequences."""
    alpha0, alpha1 = np.zeros(len(node)), np.zeros(len(node))
    beta0, beta1 = np.zeros(len(node)), np.zeros(len(node))
    chains.borders(node, pairs, [alpha0, alpha1], [beta0, beta1], add)
    first, places = chains.places[0], chains.places
    alpha1[first[~chains.inner]], alpha0[first[~chains.inner]] = node[first[~chains.inner]], 0
    joined = first[chains.inner]
    for here in [joined, *places[1:]]:
        a0, a1 = alpha0[here - 1], alpha1[here - 1]
        alpha0[here] = add(a0 + pairs[0, 0], a1 + pairs[1, 0])
        alpha1[here] = add(a0 + pairs[0, 1], a1 + pairs[1, 1]) + node[here]
    last = chains.offsets + chains.lengths - 1
    logz = add(alpha0[last], alpha1[last])
    of_block = logz[chains.doc]
    expected = np.zeros(4)

    def count(here: np.ndarray, z: np.ndarray) -> None:
        right = (beta0[here], beta1[here] + node[here])
        for a, left in ((0, alpha0[here - 1]), (1, alpha1[here - 1])):
            for b in (0, 1):
                expected[2 * a + b] += np.exp(left + pairs[a, b] + right[b] - z).sum()

    for here in reversed(places[1:]):
        n0, n1 = beta0[here], beta1[here] + node[here]
        beta0[here - 1] = add(pairs[0, 0] + n0, pairs[0, 1] + n1)
        beta1[here - 1] = add(pairs[1, 0] + n0, pairs[1, 1] + n1)
        count(here, of_block[: len(here)])
    count(joined, of_block[chains.inner])
    return np.exp(alpha1 + beta1 - np.repeat(logz, chains.lengths)), expected


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Fits the field on about ``sample`` of the labelled rows: labels(doc_id, quality) of docs(doc_id, text)."""
    rows = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id"), (F.col("quality") > 0).cast("int").alias("quality"))
    parts = max(1, rows.count() // sample)
    chosen = rows.where(F.pmod(F.xxhash64("_id", F.lit("train")), F.lit(parts)) == 0).dropDuplicates(["_id"])
    # about ``sample`` rows: the bound of this broadcast
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # an id that comes again in documents trains once
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([line_features(t.as_py() or b"")[0].astype(np.float32).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, batch.column(2)], names=["doc_id", "lines", "quality"])

    found = texts.select("doc_id", "text", "quality").mapInArrow(collect, "doc_id long, lines binary, quality int").collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["lines"])))
    sequences = [np.frombuffer(r["lines"], dtype=np.float32).reshape(-1, FEATURES).astype(float) for r in found]
    return fit(sequences, [r["quality"] for r in found])


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row; trained on labels outside fold 0 of 5."""
    field = docs.sparkSession.sparkContext.broadcast(train(docs, labels.where(crc_fold("doc_id", 5) != 0), sample))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([field.value.score(t.as_py()) for t in batch.column(2)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), (crc_fold("doc_id", 5) == 0).alias("held_out"), F.col("text").cast("binary"))
    scored = rows.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
