import hashlib
import zlib

from threatlake.llm.manifest import manifest, proofs, verified_manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*(value(v) for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(digests, width):
    """(top, per leaf the steps (left, right) upwards)."""
    steps, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for k, place in enumerate(at):
            low = place // width * width
            steps[k].append(("".join(level[low:place]), "".join(level[place + 1 : low + width])))
            at[k] = place // width
        level = [sha(*level[i : i + width]) for i in range(0, len(level), width)]
    return level[0], steps


def brute(rows, width=16):
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        leaves = sorted(((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r) for r in by_source[s]), key=lambda x: x[:3])
        made[s] = (leaves, *tree([x[2] for x in leaves], width))
    root, above = tree([made[s][1] for s in order], width)
    out = []
    for s, top in zip(order, above):
        leaves, subroot, steps = made[s]
        for (_, _, own, r), path in zip(leaves, steps):
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
            at = leaf(r, lowered(r.text)) if tampered else own
            for a, b in path + top:
                at = sha(a, at, b)
            out.append((r.doc_id, own, subroot, root, sha(*(a + b for a, b in path + top)), at, at == root))
    return sorted(out, key=str)


def test_manifest_equals_brute_force(spark, corpus):
    rows = corpus.collect()
    mixed = [r.asDict() | {"text": (r.text or "").title() if r.text and k % 3 else r.text, "n_chars": None if k % 7 == 0 else r.n_chars} for k, r in enumerate(rows)]
    # one source with most rows, one with a single row, equal rows that fill whole runs
    more = [mixed[0] | {"doc_id": 1000 + k, "source": "big"} for k in range(290)] + [mixed[1] | {"doc_id": 7, "source": "same"}] * 40 + [mixed[2] | {"source": "lone"}]
    docs = spark.createDataFrame(mixed + more, corpus.schema)
    found = sorted(map(tuple, verified_manifest(docs).collect()), key=str)
    assert found == brute(docs.collect())
    assert any(r[-1] for r in found) and not all(r[-1] for r in found)


def test_many_sources_and_proofs_of_some(spark, corpus):
    row = corpus.where("doc_id = 5").first().asDict()
    docs = spark.createDataFrame([row | {"doc_id": k, "source": f"s{k % 23:02}"} for k in range(200)], corpus.schema)
    whole = {(r.tree, r.pos): r for r in proofs(manifest(docs)).collect()}
    assert len(whole) == 200 and len({r.root for r in whole.values()}) == 1
    asked = spark.createDataFrame([("s03", 0), ("s03", 8), ("s22", 1), ("s99", 0)], "tree string, pos long")
    some = proofs(manifest(docs), asked).collect()
    assert {(r.tree, r.pos) for r in some} == {("s03", 0), ("s03", 8), ("s22", 1)}
    assert all(r == whole[r.tree, r.pos] for r in some)
    assert sorted(map(tuple, verified_manifest(docs).collect()), key=str) == brute(docs.collect())


def test_small_tables(spark, corpus, nothing):
    assert verified_manifest(nothing).count() == 0
    one = corpus.where("doc_id = 5")
    r = verified_manifest(one).first()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha()
    assert sorted(map(tuple, verified_manifest(corpus.where("doc_id IS NULL")).collect()), key=str) == brute(corpus.where("doc_id IS NULL").collect())
