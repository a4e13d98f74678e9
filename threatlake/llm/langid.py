"""Operator 4, language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
A word's probability is the sum over all its segmentations into pieces, found
by the forward algorithm; a text's is the product over its words, and the
language with the greatest posterior is the prediction.  The score is its
posterior given EVIDENCE words of the text's mean evidence (or as many as it
has), since the product over many words would always be sure.  Words are the text's runs of letters,
lower case, each with the vocabulary's word mark before it.  Characters that no
piece holds cost the same in every language.

The piece probabilities are one step of expectation maximisation from a common
prior that falls with a piece's rank: expected piece counts of the training
texts, by forward-backward sums, added up per language.  Training reads at most
about ``sample`` labelled documents, chosen by a hash of the id, so that the fit
costs the same at every size; the prediction reads whole texts.

Results in edge cases: a null text or one without a letter is ``und`` with score
0; without labelled rows every text is ``und``; rows without a language do not
train; words of any length are scored whole; repeated rows give repeated
results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_fold, keeping_columns

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE = 20_000
#: Probability of a character that no piece holds, and the weight of the prior in piece counts.
UNKNOWN, PRIOR_WEIGHT = 1e-7, 50.0
#: Words whose mean evidence the score rests on; documents handled at once; words remembered per task.
EVIDENCE, SLICE, REMEMBERED = 4, 400, 100_000
MARK, UNDETERMINED = "▁", "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def vocabulary_pieces(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces that lower-case words can hold: letters, with or without the word mark, by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [p for p in pieces if p == p.lower() and (p == MARK or p.removeprefix(MARK).isalpha())]


def words_of(text: str | None) -> list[str]:
    """The text's words; none if it has no letter."""
    words = _LETTERS.findall((text or "").lower())
    if any(w.isalpha() for w in words) or any(c.isalpha() for w in words for c in w):
        return words
    return []


class Pieces:
    """Numbers of the vocabulary's pieces by a rolling hash of their characters; 0 is no piece."""

    STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        self.longest = max((len(p) for p in pieces), default=1)
        hashes = [0] + [self._hash(p) for p in pieces]
        self.keys = np.array(hashes, dtype=np.uint64)
        first = self._slot(self.keys, 20, 0xD6E8FEB86659FD93)
        self.first = np.zeros(1 << 20, dtype=np.int32)
        self.first[first[:0:-1]] = np.arange(len(pieces), 0, -1, dtype=np.int32)
        rest = np.flatnonzero(self.first[first] != np.arange(len(hashes)))
        rest = rest[rest > 0]
        self.factor = 0xA0761D6478BD642F
        while len(np.unique(self._slot(self.keys[rest], 18, self.factor))) < len(rest):
            self.factor = (self.factor * 6364136223846793005 + 1442695040888963407) % 2**64 | 1
        self.second = np.zeros(1 << 18, dtype=np.int32)
        self.second[self._slot(self.keys[rest], 18, self.factor)] = rest

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.STEP) + ord(c) + 1) % 2**64
        return h

    @staticmethod
    def _slot(h: np.ndarray, bits: int, factor: int) -> np.ndarray:
        return ((h * np.uint64(factor)) >> np.uint64(64 - bits)).astype(np.int64)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        one = self.first[self._slot(h, 20, 0xD6E8FEB86659FD93)]
        two = self.second[self._slot(h, 18, self.factor)]
        return np.where(self.keys[one] == h, one, np.where(self.keys[two] == h, two, 0))

    def within(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length l from 1: numbers of the pieces that start at each place of the words (one per row)."""
        found, h = [], np.zeros_like(codes)
        for length in range(1, min(self.longest, codes.shape[1]) + 1):
            h = h[:, : codes.shape[1] - length + 1] * self.STEP + codes[:, length - 1 :] + np.uint64(1)
            found.append(self.lookup(h))
        return found


def by_length(words: list[str], chunk: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, character codes) of words of one length with the mark before them, at most ``chunk`` characters at once."""
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        step = max(1, chunk // (int(size) + 1))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            codes = np.frombuffer("".join(MARK + words[i] for i in part).encode("utf-32-le"), dtype=np.uint32)
            yield part, codes.reshape(len(part), int(size) + 1).astype(np.uint64)


def marginal_logs(words: list[str], pieces: Pieces, theta: np.ndarray) -> np.ndarray:
    """Log of each word's probability, summed over its segmentations, per language.

    ``theta`` has a row per piece (row 0: none) and a column per language.
    """
    out = np.empty((len(words), theta.shape[1]))
    for part, codes in by_length(words):
        found, size = pieces.within(codes), codes.shape[1]
        alpha = [np.ones((len(part), theta.shape[1]))]
        logs = np.zeros((len(part), theta.shape[1]))
        for end in range(1, size + 1):
            ids = found[0][:, end - 1]
            total = alpha[end - 1] * np.where((ids == 0)[:, None], UNKNOWN, theta[ids])
            for length in range(2, min(len(found), end) + 1):
                ids = found[length - 1][:, end - length]
                hit = np.flatnonzero(ids)
                if len(hit):
                    total[hit] += alpha[end - length][hit] * theta[ids[hit]]
            alpha.append(total)
            if end % 16 == 0:
                logs += np.log(total)
                for k in range(max(0, end - pieces.longest), end):
                    alpha[k] = alpha[k] / total
                alpha[end] = np.ones_like(total)
            if end > pieces.longest:
                alpha[end - pieces.longest - 1] = None
        out[part] = np.log(alpha[size]) + logs
    return out


def expected_counts(words: list[str], weights: np.ndarray, pieces: Pieces, prior: np.ndarray) -> np.ndarray:
    """Expected piece counts (piece, language) of weighted words under the prior, by forward-backward sums."""
    counts = np.zeros((len(prior), weights.shape[1]))
    for part, codes in by_length(words):
        found, size = pieces.within(codes), codes.shape[1]
        value = [np.where(ids == 0, UNKNOWN, prior[ids]) if k == 0 else prior[ids] for k, ids in enumerate(found)]
        # logs of the sums, so that words of any length train
        before, after = np.zeros((size + 1, len(part))), np.zeros((size + 1, len(part)))
        for end in range(1, size + 1):
            total = sum(np.exp(before[end - k - 1] - before[end - 1]) * value[k][:, end - k - 1] for k in range(min(len(found), end)))
            before[end] = before[end - 1] + np.log(total)
        for start in range(size - 1, -1, -1):
            total = sum(np.exp(after[start + k + 1] - after[start + 1]) * value[k][:, start] for k in range(min(len(found), size - start)))
            after[start] = after[start + 1] + np.log(total)
        for k, ids in enumerate(found):
            rows, starts = np.nonzero(ids)
            share = value[k][rows, starts] * np.exp(before[starts, rows] + after[starts + k + 1, rows] - before[size, rows])
            for lang in range(weights.shape[1]):
                counts[:, lang] += np.bincount(ids[rows, starts], share * weights[part[rows], lang], len(prior))
    return counts


def rank_prior(n: int) -> np.ndarray:
    """The common prior: falls with rank; entry 0 is no piece."""
    prior = np.concatenate([[0.0], 1.0 / (np.arange(n) + 100.0)])
    return prior / prior.sum()


class Model:
    """Languages with their piece probabilities; plain arrays, made on the driver from aggregated counts."""

    def __init__(self, pieces: list[str], langs: list[str], counts: np.ndarray, documents: np.ndarray):
        prior = rank_prior(len(pieces))
        self.pieces, self.langs = pieces, langs
        smoothed = counts + PRIOR_WEIGHT * prior[:, None]
        self.theta = smoothed / smoothed.sum(axis=0, keepdims=True)
        self.share = np.log((documents + 1) / (documents + 1).sum()) if langs else np.zeros(0)


def train(labelled: DataFrame, vocabulary: str = VOCABULARY, sample: int = SAMPLE) -> Model:
    """Fits a model on about ``sample`` of the rows (doc_id, text, lang)."""
    pieces = vocabulary_pieces(vocabulary)
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text", "lang")
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(shares)
    parts = max(1, sum(shares.values()) // sample)
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(parts)) == 0).select("text", "lang")
    prior = rank_prior(len(pieces))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, number = Pieces(pieces), {lang: k for k, lang in enumerate(langs)}
        total = np.zeros((len(prior), len(langs)))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                seen = [Counter() for _ in langs]
                for text, lang in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns)):
                    seen[number[lang]].update(words_of(text))
                words = sorted({w for s in seen for w in s})
                if words:
                    weights = np.array([[s[w] for s in seen] for w in words], dtype=float)
                    total += expected_counts(words, weights, table, prior)
        piece, lang = np.nonzero(np.round(total * 1024))
        # whole numbers, so that the sum does not depend on the order of tasks
        units = np.round(total[piece, lang] * 1024).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(units)], names=["piece", "lang", "units"])

    summed = chosen.mapInArrow(count, "piece long, lang long, units long").groupBy("piece", "lang").agg(F.sum("units").alias("units")).toPandas()
    counts = np.zeros((len(prior), len(langs)))
    counts[summed["piece"].to_numpy(dtype=np.int64), summed["lang"].to_numpy(dtype=np.int64)] = summed["units"].to_numpy(dtype=float) / 1024
    return Model(pieces, langs, counts, np.array([shares[x] for x in langs], dtype=float))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and (lang_pred, score, posterior) per row of ``docs``; ``posterior`` rests on all words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [*keep, "lang_pred", "score", "posterior"]
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c].simpleString()}" for c in keep), "lang_pred string", "score double", "posterior double"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table, known, logs = Pieces(model.pieces), {}, np.zeros((0, len(model.langs)))
        for batch in batches:
            langs, scores, sure = [], [], []
            for at in range(0, batch.num_rows, SLICE):
                texts = batch.column(batch.num_columns - 1).slice(at, SLICE)
                listed = [words_of(t.as_py()) if model.langs else [] for t in texts]
                new = list({w for words in listed for w in words if w not in known})
                if len(known) + len(new) > REMEMBERED:
                    known, logs = {}, logs[:0]
                    new = list({w for words in listed for w in words})
                known.update(zip(new, range(len(known), len(known) + len(new))))
                if new:
                    logs = np.concatenate([logs, marginal_logs(new, table, model.theta)])
                for words in listed:
                    if not words:
                        langs.append(UNDETERMINED)
                        scores.append(0.0)
                        sure.append(0.0)
                        continue
                    evidence = logs[[known[w] for w in words]].sum(axis=0)
                    total = model.share + evidence
                    best = int(total.argmax())
                    langs.append(model.langs[best])
                    sure.append(float(1 / np.exp(total - total[best]).sum()))
                    tempered = model.share + evidence * min(1, EVIDENCE / len(words))
                    scores.append(float(1 / np.exp(tempered - tempered[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.float64())], names=fields)

    return docs.select(*keep, "text").mapInArrow(score, schema)


def identify(docs: DataFrame, vocabulary: str = VOCABULARY, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): trained on the documents whose id does not fall in fold 2 of 4."""
    fold = crc_fold("doc_id", 4)
    model = train(docs.where(fold != 2), vocabulary, sample)
    marked = docs.select("doc_id", (fold == 2).alias("held_out"), "text")
    return predict(marked, model, ("doc_id", "held_out")).drop("posterior")


def keep_identified(docs: DataFrame, least: float = 0.5, vocabulary: str = VOCABULARY, sample: int = SAMPLE) -> DataFrame:
    """The documents whose language has a posterior of at least ``least``, columns unchanged."""

    def kept(rows: DataFrame) -> DataFrame:
        model = train(rows.where(crc_fold("doc_id", 4) != 2), vocabulary, sample)
        others = tuple(c for c in rows.columns if c != "text")
        told = predict(rows.select(*others, F.col("text").alias("_kept_text"), "text"), model, (*others, "_kept_text"))
        told = told.where((F.col("lang_pred") != UNDETERMINED) & (F.col("posterior") >= least))
        return told.withColumnRenamed("_kept_text", "text")

    return keeping_columns(docs, ("doc_id", "text", "lang"), kept)
