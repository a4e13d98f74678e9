import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from threatlake.llm.resampling import frequent_words, payloads, resample, runs, shifted

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def features(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i : i + size]) for size in range(1, n + 1) for i in range(len(words) - size + 1)], len(words)


def brute(docs, target, n=1, buckets=10_000, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    cut = [(r[0], *features(r[1], n)) for r in docs]
    s, t = Counter(bucket(f) for _, fs, _ in cut for f in fs), Counter(bucket(f) for x in target for f in features(x, n)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for doc_id, fs, words in cut:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=str)


def test_crcs_compose():
    rng = np.random.default_rng(5)
    a, b = [rng.bytes(int(k)) for k in rng.integers(0, 40, 200)], [rng.bytes(int(k)) for k in rng.integers(0, 3000, 200)]
    left = np.array([zlib.crc32(x) for x in a], dtype=np.uint32)
    right = np.array([zlib.crc32(x) for x in b], dtype=np.uint32)
    whole = shifted(left, np.array([len(x) for x in b])) ^ right
    assert whole.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


@pytest.mark.parametrize("words", [(), (b"the",), (b"a", b"the", b"then", "für".encode(), b"he")])
def test_payloads_are_the_words(words):
    texts = ["The then, the a9 für FÜR\tHe-he", None, "", "...", "a", "the the the"]
    text, crc, length = payloads(words, [None if t is None else t.encode() for t in texts])
    want = [(k, w) for k, t in enumerate(texts) for w in features(t, 1)[0]]
    assert list(zip(text.tolist(), crc.tolist(), length.tolist())) == [(k, zlib.crc32(w.encode()), len(w.encode())) for k, w in want]
    for n in (2, 3):
        of, crcs = runs(text, crc, length, n)
        assert sorted(zip(of.tolist(), crcs.tolist())) == sorted((k, zlib.crc32(f.encode())) for k, t in enumerate(texts) for f in features(t, n)[0])


@pytest.mark.parametrize("n, dictionary", [(1, 50), (3, 50), (2, 0)])
def test_resampling_equals_brute_force(spark, corpus, n, dictionary):
    target = [r.text for r in corpus.where("doc_id BETWEEN 40 AND 50").collect()] + [None, ""]
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    rows = resample(corpus, aim, n=n, dictionary=dictionary).collect()
    assert sorted((tuple(r) for r in rows), key=str) == brute([(r.doc_id, r.text) for r in corpus.collect()], target, n)


def test_target_is_preferred_and_empty_tables(spark, corpus, nothing):
    german = corpus.where("lang = 'de'").select("text")
    rows = resample(corpus, german, percent=20).where("rank IS NOT NULL").collect()
    assert {r.rank for r in rows} == set(range(1, len(rows) + 1)) and sum(40 <= r.doc_id < 60 for r in rows) >= 18
    assert resample(nothing, german).count() == 0
    assert resample(corpus, nothing.select("text")).where("rank IS NOT NULL").count() > 0


def test_dictionary_is_bounded(spark):
    texts = spark.createDataFrame([("b a b c",), ("x" * 60 + " a",), (None,)], "text string")
    assert frequent_words(texts, 2) == (b"a", b"b") and frequent_words(texts, 9) == (b"a", b"b", b"c")
