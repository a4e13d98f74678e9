import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node long, `_kept` string, `_copy` long, shard string, `_key` string, score string"
EN = "the of and to in that was for with his they which from this had not but what all were when there can more if no man out other so time up go about than into could state only new some take come these know see use get like then first any work now may such give over think most even find day also after way many must look before great back through long where much should well people down own just because good each those feel seem how high too place little world very still nation hand old life tell write become here show house both between need mean call develop under last right move thing general school never same another begin while number part turn real leave might want point form off child few small since against ask late home interest large person end open public follow during present without again hold govern around possible head consider word program problem however lead system set order eye plan run keep face fact group play stand increase early course change help line".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine uhr seiner worden will zwischen immer millionen ein was sagte gibt alle seit muss wurden beim doch jetzt waren drei".split()


def text_of(words, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with copies, near copies, nulls, repeated rows, odd texts, and further columns of clashing names."""
    rows = []
    add = lambda i, t, lang="en", source="s1": rows.append((i, t, lang, source, len(t or ""), 7, 8, "k", 9, "h", "y", "z"))
    for i in range(40):
        add(i, text_of(EN, 60 + 3 * i, i), "en", f"s{i % 3}")
    for i in range(40, 60):
        add(i, text_of(DE, 80, i), "de", "s2")
    base = text_of(EN, 120, 999).split()
    for i in range(60, 90):
        w = list(base)
        w[i % len(w)] = f"edited{i}"
        add(i, " ".join(w), "en", "s0")
    for i in range(90, 96):
        add(i, text_of(EN, 60, 0), "en", None)
    add(96, None)
    add(97, "")
    add(98, " \n\t ")
    add(99, "??? 123 !!!")
    add(100, "one two three")
    add(100, "one two three")
    add(None, "null id text of some words here", None, None)
    add(101, text_of(EN, 30_000, 7), "en", "s1")
    add(102, "x" * 50_000, "en", "s1")
    add(103, "word " * 500, None, "s1")
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark, corpus):
    return spark.createDataFrame([], corpus.schema)
