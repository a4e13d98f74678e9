import itertools
import random
import time

import numpy as np
import pytest

from threatlake.llm import quality
from threatlake.llm.quality import Chains, FEATURES, _expectations, fit, fit_lines, line_features, line_labels, marginals, score_quality

from .conftest import DE, EN, text_of


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        scores, pairs = rng.normal(size=n), rng.normal(size=(2, 2))
        total, good = 0.0, np.zeros(n)
        for labels in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(s for s, y in zip(scores, labels) if y) + sum(pairs[a, b] for a, b in zip(labels, labels[1:])))
            total += p
            good += p * np.array(labels)
        assert np.allclose(marginals(scores, pairs), good / total)


def test_features_of_odd_lines():
    for text in (b"", b"\n\n", b"a", "é\n  x".encode(), b"same words here\nsame words here\n", b"x" * 100_000):
        features, weight = line_features(text)
        assert features.shape == (text.count(b"\n") + 1, FEATURES) and np.isfinite(features).all() and (weight > 0).all()
    assert line_features(b"same words here\nsame words here")[0][:, 12].tolist() == [1, 1]


def test_held_out_quality(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        text = text_of(EN if i % 2 else DE, rng.randrange(5, 80), i)
        if not good:
            text = [text.upper().replace(" ", "!! "), " | ".join(text.split()), " ".join(w + "###" for w in text.split()), "spam " * 60][i // 4 % 4]
        rows.append((i, text.replace(" w", "\nw")))
        labels.append((i, int(good), 0))
    rows += [(1000, None), (1001, ""), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = score_quality(docs, marks).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 40 and sum(r.predicted == int(r.doc_id % 4 != 0) for r in held) >= 0.95 * len(held)


def test_lines_of_bad_documents_may_be_good():
    rng = random.Random(4)
    good = lambda k: text_of(EN, 12, k).capitalize() + "."
    bad = lambda k: text_of(EN, 12, k).upper().replace(" ", "!! ")
    docs, labels = [], []
    for i in range(240):
        label = int(i % 3 != 0)
        lines = [good(rng.random()) if label or i % 2 and j % 4 else bad(rng.random()) for j in range(8)]
        docs.append("\n".join(lines).encode())
        labels.append(label)
    sequences = [line_features(d)[0] for d in docs]
    first = fit_lines(sequences, [np.full(len(s), y) for s, y in zip(sequences, labels)], chained=False)
    told = line_labels(sequences, labels, first)
    assert all(t.min() == 0 for t, y in zip(told, labels) if not y) and all(t.min() == 1 for t, y in zip(told, labels) if y)
    field = fit(sequences, labels)
    mixed = field.score("\n".join([good(k) for k in range(5)] + [bad(k) for k in range(5)]).encode())
    whole = lambda line: field.score("\n".join(line(k) for k in range(8)).encode())
    assert whole(good) > 0.9 and whole(bad) < 0.1 and 0.2 < mixed < 0.8


@pytest.mark.parametrize("block", [1, 2, 3, 4, 256])
def test_expectations_against_enumeration(block):
    rng = np.random.default_rng(3)
    lengths = np.array([9, 7, 4, 2, 1])
    offsets = np.array([0, 9, 16, 20, 22])
    node, pairs = rng.normal(size=23), rng.normal(size=(2, 2))
    p, expected = _expectations(node, pairs, Chains(lengths, block), np.logaddexp)
    good, counts = np.zeros(23), np.zeros(4)
    for a, n in zip(offsets, lengths):
        total, g, c = 0.0, np.zeros(n), np.zeros(4)
        for labels in itertools.product((0, 1), repeat=int(n)):
            x = np.exp(sum(s for s, y in zip(node[a:], labels) if y) + sum(pairs[i, j] for i, j in zip(labels, labels[1:])))
            total += x
            g += x * np.array(labels)
            for i, j in zip(labels, labels[1:]):
                c[2 * i + j] += x
        good[a : a + n], counts = g / total, counts + c / total
    assert np.allclose(p, good) and np.allclose(expected, counts)


def test_without_labels(corpus, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in score_quality(corpus, none).collect()} == {0.5}
    assert score_quality(nothing, none).count() == 0


def test_a_very_long_document_trains_in_time(monkeypatch):
    rng = np.random.default_rng(8)
    short = [rng.normal(size=(int(n), FEATURES)) for n in rng.integers(1, 30, 50)]
    labels = [np.full(len(x), k % 2) for k, x in enumerate(short)]
    long = rng.normal(size=(100_000, FEATURES))
    began = time.time()
    fit_lines([*short, long], [*labels, np.ones(len(long), dtype=int)], steps=15)
    assert time.time() - began < 20
    some = [*short, long[:2000]]
    marks = [*labels, (np.arange(2000) // 50 % 2)]
    fields = []
    for block in (1 << 30, 16):
        monkeypatch.setattr(quality, "BLOCK", block)
        fields.append(fit_lines(some, marks, 20))
    assert np.allclose(fields[0].weights, fields[1].weights, atol=1e-6) and np.allclose(fields[0].pairs, fields[1].pairs, atol=1e-6)
