import random
import unicodedata

from threatlake.llm.decontaminate import Index, budget, contaminations, decontaminated, normalised, windows_of

from .conftest import EN, text_of


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_windows_against_dynamic_programming():
    rng = random.Random(8)
    windows = [w for k in range(12) for w in windows_of(normalised(text_of(EN, 40, k).encode()))] + [b"a short one", b"thirty-six bytes of text are enough.", b"thirty bytes are a bit shorter", b"tiny one"]
    index = Index(windows)
    for _ in range(150):
        k = rng.randrange(len(windows))
        part = bytearray(windows[k])
        for _ in range(rng.randrange(13)):
            at = rng.randrange(len(part))
            [lambda: part.__setitem__(at, rng.randrange(97, 123)), lambda: part.__delitem__(at), lambda: part.insert(at, rng.randrange(97, 123))][rng.randrange(3)]()
        text = normalised(text_of(EN, 30, rng.random()).encode())
        at = rng.randrange(len(text))
        text = text[:at] + bytes(part) + text[at:]
        got = index.search([text])[0].get(k)
        if budget(len(windows[k])):
            true = edits(windows[k], text)
            assert got == (true if true <= budget(len(windows[k])) else None)
        else:
            assert (got == 0) == (b" " + windows[k] + b" " in b" " + text + b" ")


def test_documents_with_items_go(spark, corpus):
    items = [(k, text_of(EN, 45, 500 + k)) for k in range(6)] + [(7, None), (8, ""), (9, items_text := "tiny item text"), (9, items_text)]
    rng = random.Random(1)
    planted = []
    for k in range(6):
        words = items[k][1].split()
        words[3], words[30] = "changed", "other"
        half = words[:40]
        planted += [(1000 + k, text_of(EN, 50, rng.random()) + " " + items[k][1].upper().replace(" ", ",\n") + " tail"), (1100 + k, "x " + " ".join(words)), (1200 + k, " ".join(half) + " " + text_of(EN, 9, k))]
    planted += [(1300, "here is a Tiny ITEM, text inside"), (1302, "one passage only " + items[5][1][60:180]), (1301, "y " * 400_000 + items[2][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = corpus.unionByName(spark.createDataFrame(planted, "doc_id long, text string"), allowMissingColumns=True)
    found = {(r.doc_id, r.item_id) for r in contaminations(docs, benchmark).collect()}
    want = {(base + k, k) for base in (1000, 1100, 1200) for k in range(6)} | {(1300, 9), (1301, 2), (1302, 5)}
    assert found == want
    clean = decontaminated(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == corpus.count()


def test_case_and_composition_of_accented_text(spark):
    words = "überprüfung größe schöner äpfel straße élève façade garçon àéîõü żółć čeština ñandú".split()
    text = text_of(words, 30, 4)
    forms = [text, text.upper(), text.title(), unicodedata.normalize("NFD", text), unicodedata.normalize("NFD", text.upper())]
    assert len({normalised(f.encode()) for f in forms}) == 1
    assert normalised("É".encode() + b"\xff A") == "é".encode() + b"\xff a"
    docs = spark.createDataFrame([(k, f"{text_of(EN, 20, k)} {f} tail") for k, f in enumerate(forms)], "doc_id long, text string")
    for item in (text, text.upper()):
        benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
        found = contaminations(docs, benchmark).collect()
        assert sorted(r.doc_id for r in found) == list(range(5)) and all(r.n_found == r.n_windows and r.edits == 0 for r in found)
        assert decontaminated(docs, benchmark).count() == 0


def test_empty(spark, corpus, nothing):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert contaminations(corpus, empty).count() == 0
    assert decontaminated(corpus, empty).count() == corpus.count()
    assert decontaminated(nothing, spark.createDataFrame([(1, "some item text")], "item_id long, text string")).count() == 0
