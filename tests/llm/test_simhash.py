import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from threatlake.llm import simhash
from threatlake.llm.simhash import fingerprint_edits, fingerprints, following, near_fingerprints


def test_edits_and_likeness(corpus):
    docs = [r for r in corpus.collect()]
    rows = fingerprint_edits(corpus).collect()
    assert len(rows) == len(docs)
    texts = {}
    for r in docs:
        texts.setdefault(r.doc_id, r.text or "")
    ids = sorted((r.doc_id for r in docs), key=lambda i: -1 if i is None else i)
    prints = {}
    for r in rows:
        assert r.n_chars == len(texts[r.doc_id])
        prints.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
        k = r.n_chars // 4
        options = {hashlib.sha256((texts[r.doc_id][: r.n_chars - k] + texts[ids[(p + 1) % len(ids)]][:k]).encode()).hexdigest() for p, i in enumerate(ids) if i == r.doc_id}
        assert r.edited_sha256 in options
        same = 1 - bin(int(r.fingerprint, 16) ^ int(r.edited_fingerprint, 16)).count("1") / 64
        assert r.near_edited == same and 0 <= r.near_next <= 1
    assert all(len(p) == 1 for p in prints.values())
    plain = [r for r in rows if r.doc_id is not None and r.doc_id < 40]
    assert sum(r.near_edited for r in plain) > sum(r.near_next for r in plain)


def test_long_words_repeated_without_end(spark):
    words = ["abcdefghijkl", "longestwordofall", "eightlet"]
    texts = spark.createDataFrame([(k, " ".join([w] * 10_000)) for k, w in enumerate(words)], "k long, text string")
    found = {r.k: r.fingerprint for r in fingerprints(texts, ["k"], "text").collect()}
    hashes = spark.createDataFrame(list(enumerate(words)), "k long, w string").select("k", F.xxhash64("w").alias("h"))
    assert found == {r.k: r.h for r in hashes.collect()}


def test_plan_has_no_python(corpus):
    plan = fingerprint_edits(corpus)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def plain_fingerprint(text):
    votes, total = [0] * 64, 0
    for w in re.split(r"[ \t-\r]+", text.lower()):
        h, weight = xxhash.xxh64_intdigest(w.encode(), seed=42), min(len(w), 12)
        total += weight
        for k in range(64):
            votes[k] += weight * (h >> k & 1)
    return f"{sum(1 << k for k in range(64) if 2 * votes[k] > total):016x}"


def test_bits_and_search_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 15)))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(300)]
        for _ in range(10):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(300)] = word()
            texts.append(" ".join(w))
    texts += [texts[0], "", "Ünïcode   Wörds\tAND more", "a" * 30]
    sparse = [rng.randrange(1 << 60) // 2 * 2 for _ in texts]  # ids far apart: no two share a bucket
    ids = [i - i % 50 if k % 5 == 0 else i for k, i in enumerate(sparse)]
    rows = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    found = sorted(fingerprint_edits(rows).collect(), key=lambda r: r.doc_id)
    order = sorted(zip(ids, texts))
    prints = [plain_fingerprint(t) for _, t in order]
    assert [r.fingerprint for r in found] == prints
    differ = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    for k, r in enumerate(found):
        assert r.near_next == 1 - differ(prints[k], prints[(k + 1) % len(prints)]) / 64
        if r.doc_id % 50:
            assert r.near_fingerprints is None and r.near_documents is None and r.nearest is None
        else:
            near = [p for p in prints if p != prints[k] and differ(p, prints[k]) <= 3]
            assert (r.near_fingerprints, r.near_documents) == (len(set(near)), len(near))
            assert r.nearest == min((differ(p, prints[k]) for p in near), default=None)
    assert any(r.near_documents for r in found)


def test_following_wraps_round(spark):
    ids = sorted(random.Random(1).sample(range(10**7), 300))
    found = {r.bucket: r.next_bucket for r in following(spark.createDataFrame([(i,) for i in ids], "bucket long")).collect()}
    assert found == {a: b for a, b in zip(ids, ids[1:] + ids[:1])}


def test_block_tables_find_all(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    stored = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 7))) for b in base]
    signed = [x - (1 << 64) if x >> 63 else x for x in stored]
    queries = spark.createDataFrame(list(enumerate(signed[:60])), "query long, fingerprint long")
    found = {(r["query"], r.fingerprint, r.distance) for r in near_fingerprints(queries, spark.createDataFrame([(x,) for x in signed], "fingerprint long"), 3).collect()}
    want = {(q, s, bin(a ^ b).count("1")) for q, a in enumerate(stored[:60]) for s, b in zip(signed, stored) if bin(a ^ b).count("1") <= 3}
    assert found == want


def test_crowded_keys_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 3)
    stored = [1 << k for k in range(40)] + [0]
    one = spark.createDataFrame([(7, 0)], "query long, fingerprint long")
    found = near_fingerprints(one, spark.createDataFrame([(x,) for x in stored], "fingerprint long"), 3).collect()
    assert sorted((r.fingerprint, r.distance) for r in found) == sorted((x, bin(x).count("1")) for x in stored)


def test_empty(nothing):
    assert fingerprint_edits(nothing).count() == 0
