import zlib

from threatlake.llm.mixing import mix_sources, mixed_documents
from threatlake.llm.sharding import assign_shards


def test_shards_are_gapless_balanced_and_in_order(corpus):
    rows = assign_shards(corpus, 4).collect()
    assert len(rows) == corpus.count()
    for shard in range(4):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    sizes = [sum(r["size"] for r in rows if r.shard == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)
    texts = {r.doc_id: r.text for r in corpus.collect()}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
    placed = sorted(rows, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in placed]
    assert ids == sorted(ids)


def test_one_id_in_many_rows_spreads(spark):
    rows = spark.range(200).selectExpr("1L AS doc_id", "concat('t', id) AS text")
    found = assign_shards(rows, 8).groupBy("shard").agg({"size": "sum"}).collect()
    assert len(found) == 8 and max(r["sum(size)"] for r in found) - min(r["sum(size)"] for r in found) <= 10


def test_mix_meets_the_targets(corpus):
    rows = mix_sources(corpus).collect()
    words = {r.doc_id: len((r.text or "").split()) for r in corpus.collect()}
    total = sum(r["size"] for r in rows)
    by_source = {}
    for r in rows:
        assert r["size"] == words[r.doc_id] and 0 <= r.taken <= 3 * r["size"]
        by_source.setdefault(r.source, []).append(r)
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(by_source, key=lambda s: (s is None, s or "")))}
    sizes = {s: sum(r["size"] for r in rs) for s, rs in by_source.items()}
    targets, capped = {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        w = sum(weights[s] for s in sizes if s not in capped)
        over = {s for s in sizes if s not in capped and rest * weights[s] / w > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s, rs in by_source.items():
        want = 3 * sizes[s] if s in capped else rest * weights[s] / w
        assert abs(rs[0].target - want) < 1e-6
        assert sum(r.taken for r in rs) == int(want + 1e-9)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mix_sources(corpus).collect()), key=str)
    assert targets == {}


def test_mixed_documents_repeat_by_epoch(corpus):
    taken = {}
    for r in mix_sources(corpus).collect():
        taken.setdefault(r.doc_id, []).append((r["size"], r.taken))
    counts = {r.doc_id: r["count"] for r in mixed_documents(corpus).groupBy("doc_id").count().collect()}
    for doc_id, parts in taken.items():
        least = sum(t // s if s else 0 for s, t in parts)
        most = sum(-(-t // s) if s else 3 for s, t in parts)
        assert least <= counts.get(doc_id, 0) <= most
    assert mixed_documents(corpus).columns == corpus.columns


def test_source_without_words(spark):
    rows = [(1, "a b c", "full"), (2, "d e", "full"), (3, None, "none"), (4, "", "none"), (5, " \n\t ", "none"), (6, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in mix_sources(docs).collect()}
    assert all(found[k] == (0, 0, 0.0, 0) for k in (3, 4, 5, 6))
    assert found[1] == (3, 5, 5.0, 3) and found[2] == (2, 5, 5.0, 2)
    assert sorted(r.doc_id for r in mixed_documents(docs).collect()) == [1, 2]
    only = docs.where("doc_id > 2")
    assert all((r.target, r.taken) == (0.0, 0) for r in mix_sources(only).collect()) and mixed_documents(only).count() == 0


def test_empty_tables(nothing):
    assert assign_shards(nothing).count() == 0
    assert mix_sources(nothing).count() == 0
    assert mixed_documents(nothing).count() == 0
