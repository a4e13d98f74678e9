import numpy as np

from threatlake.llm.langid import MARK, UNDETERMINED, UNKNOWN, Pieces, expected_counts, identify, keep_identified, marginal_logs, rank_prior, vocabulary_pieces


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba", MARK, MARK + "a", "é"]
    theta = np.random.default_rng(1).random((len(pieces) + 1, 3))
    theta[0] = 0
    index = {p: k + 1 for k, p in enumerate(pieces)}

    def total(s):
        if not s:
            return np.ones(3)
        out = np.zeros(3)
        for n in range(1, len(s) + 1):
            if s[:n] in index:
                out += theta[index[s[:n]]] * total(s[n:])
            elif n == 1:
                out += UNKNOWN * total(s[1:])
        return out

    words = ["ab", "abab", "aé", "xyz", "babababab", "a" * 15]
    got = marginal_logs(words, Pieces(pieces), theta)
    assert np.allclose(got, [np.log(total(MARK + w)) for w in words])
    long = marginal_logs(["ab" * 3000], Pieces(pieces), theta)
    assert np.isfinite(long).all()


def test_expected_counts_of_all_segmentations():
    pieces = ["a", "b", "ab", "ba", MARK, MARK + "a"]
    prior = rank_prior(len(pieces))
    index = {p: k + 1 for k, p in enumerate(pieces)}

    def splits(s):
        if not s:
            yield [], 1.0
        for n in range(1, len(s) + 1):
            if s[:n] in index:
                for rest, weight in splits(s[n:]):
                    yield [index[s[:n]], *rest], prior[index[s[:n]]] * weight

    words, weights = ["ab", "abba", "baab"], np.array([[1.0, 0], [2, 1], [0, 3]])
    want = np.zeros((len(prior), 2))
    for w, weight in zip(words, weights):
        listed = list(splits(MARK + w))
        total = sum(x for _, x in listed)
        for parts, x in listed:
            for k in parts:
                want[k] += weight * x / total
    assert np.allclose(expected_counts(words, weights, Pieces(pieces), prior), want)
    long = expected_counts(["ab" * 2000 + "é" * 500], np.ones((1, 1)), Pieces(pieces), prior)
    assert np.isfinite(long).all() and long.sum() > 1000


def test_lookup_finds_every_piece():
    pieces = vocabulary_pieces()
    table = Pieces(pieces)
    assert (table.lookup(np.array([table._hash(p) for p in pieces], dtype=np.uint64)) == np.arange(1, len(pieces) + 1)).all()


def test_held_out_languages(corpus):
    langs = {r.doc_id: (r.lang, r.text) for r in corpus.collect()}
    rows = identify(corpus).collect()
    assert len(rows) == corpus.count()
    for r in rows:
        lang, text = langs[r.doc_id]
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == (UNDETERMINED, 0.0)
        elif lang and len(text.split()) > 20:
            assert r.lang_pred == lang and r.score > 0.9
    assert identify(corpus).orderBy("doc_id", "score").collect() == identify(corpus).orderBy("doc_id", "score").collect()


def test_filter_and_empty_tables(corpus, nothing):
    kept = keep_identified(corpus)
    assert kept.columns == corpus.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {96, 97, 98, 99} and set(range(60)) <= ids
    assert identify(nothing).count() == 0 and keep_identified(nothing).count() == 0
    assert {r.lang_pred for r in identify(corpus.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {UNDETERMINED}
