"""Unit cases of the detectors: what must be found, and what must not."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threatlake.engine import FAMILIES, ThreatEngine, scan_characters, scan_text
from threatlake.functions.stego import byte_entropy, decoded_payload, encode_text, payload_class, text_entropy
from threatlake.functions.text import lines
from threatlake.operators import patterns as P
from threatlake.operators import unicode_chars as U
from threatlake.operators.findings import at_least, deduplicated, display, session_stats
from pyspark.sql import functions as F

BLOB = "Zm9vYmFyYmF6cXV4MDEyMzQ1Njc4OUFCQ0RFRkdISUpLTE1OT1BRUlNUVVZXWFlaYWJjZGVmZ2hpamtsbW5vcHFyc3R1dnd4eXo="


def files(spark, *contents):
    return spark.createDataFrame([(f"f{k}.js", c) for k, c in enumerate(contents)], "path string, content string")


def found(spark, content, *columns):
    return [tuple(r[c] for c in columns) for r in scan_text(spark, content, "f.js").orderBy("line", "column", "emit_seq").collect()]


@pytest.mark.parametrize(
    "content, want",
    [
        ("const secret︀Key = 'value';", [("invisible_character", "critical", 0xFE00, 1, 13)]),
        ("const pass​word = 'secret';", [("invisible_character", "critical", 0x200B, 1, 11)]),
        ('const file = "test‮txt";', [("invisible_character", "critical", 0x202E, 1, 19), ("bidirectional_override", "critical", 0x202E, 1, 19)]),
        ('const text = "hello‫world";', [("invisible_character", "critical", 0x202B, 1, 20), ("bidirectional_override", "high", 0x202B, 1, 20)]),
        ('const x = "test\U000e0001value";', [("invisible_character", "medium", 0xE0001, 1, 16), ("unicode_tag", "medium", 0xE0001, 1, 16)]),
        ("const pаssword = 'secret';", [("homoglyph", "critical", 0x430, 1, 8)]),
        ("const lοgin = 'user';", [("homoglyph", "critical", 0x3BF, 1, 8)]),
        ("let bιt = αb;", [("homoglyph", "medium", 0x3B9, 1, 6), ("homoglyph", "high", 0x3B1, 1, 11)]),
        ("let сообщ = 'test';", []),
        ("  // pаy\n# pаy\n<!-- pаy", []),
        ("const normal = 'hello world';", []),
        ("☀️ \U0001f600‍", []),
        ("a\r\nb⁠\r\n", [("invisible_character", "high", 0x2060, 2, 2)]),
        ("x؜﻿", [("bidirectional_override", "low", 0x61C, 1, 2)]),
        ("�", [("invisible_character", "medium", 0xFFFD, 1, 1)]),
    ],
)
def test_characters(spark, content, want):
    assert found(spark, content, "category", "severity", "code_point", "line", "column") == want


def test_lines(spark):
    rows = lines(files(spark, "a\r\nb\n\nc\r", "", "\n", "x\n")).collect()
    assert [(r.path, r.line, r.text) for r in rows] == [("f0.js", 1, "a"), ("f0.js", 2, "b"), ("f0.js", 3, ""), ("f0.js", 4, "c\r"), ("f2.js", 1, ""), ("f3.js", 1, "x")]


def test_context(spark):
    row = scan_text(spark, "0123456789012345678901234567890​0123456789012345678901234567890", "f").first()
    assert row.context == "...12345678901234567890​0123456789012345678..."
    assert scan_text(spark, "ab​", "f").first().context == "ab​"


def payload(spark, data):
    return spark.createDataFrame([(encode_text(data),)], "r string").select(decoded_payload(F.col("r")).alias("p")).first().p


def test_payloads(spark):
    p = payload(spark, b"hello")
    assert (bytes(p.bytes), p.is_valid_utf8, p.codepoint_count, p.payload_class, p.decoded_text) == (b"hello", True, 5, "too_small", "hello")
    assert payload(spark, b"abc") is None
    p = payload(spark, bytes(range(256)))
    assert len(p.bytes) == 256 and abs(p.entropy - 8) < 1e-9 and p.payload_class == "encrypted_or_compressed" and not p.is_valid_utf8
    assert payload(spark, b"hello world hello!").payload_class == "plaintext_code"


@settings(max_examples=10, deadline=None)
@given(data=st.binary(min_size=4, max_size=80))
def test_round_trip(spark, data):
    assert bytes(payload(spark, data).bytes) == data


def test_entropy(spark):
    rows = spark.createDataFrame([("41414141",), ("0001020304050607",), ("",)], "h string").select(F.round(byte_entropy(F.unhex("h")), 9)).collect()
    assert [r[0] for r in rows] == [0.0, 3.0, 0.0]
    assert spark.range(1).select(payload_class(F.lit(100), F.lit(6.5), F.lit(True))).first()[0] == "suspicious_data"
    assert abs(spark.range(1).select(text_entropy(F.lit("ab"))).first()[0] - 1) < 1e-12


def test_runs(spark):
    run = encode_text(bytes(range(16)) + b"more")
    f = files(spark, f"text\nmo{run}re", "a" + encode_text(b"hidde") + "b", "x|" + encode_text(b"hidden") + "data")
    rows = P.stego_runs(f).collect()
    assert [(r.path, r.line, r.column, r.severity, r.decoded_payload.codepoint_count) for r in rows] == [("f0.js", 2, 3, "critical", 20)]
    rows = P.pipe_stego(f).collect()
    assert [(r.path, r.line, r.column, r.decoded_payload.decoded_text) for r in rows] == [("f2.js", 1, 2, "hidden")]
    two = P.carrier_runs(files(spark, f"{run}ab{run}c{run}"), 16).orderBy("start").collect()
    assert [r.start for r in two] == [0, 22, 43]


def test_decoder_and_indicators(spark):
    f = files(spark, "é s.codePointAt(0) - 0xFE00\nplain 0xFE00", "eval(x)", "eval(atob(x))", "new Function(atob(b)); eval(1)", "x = 1")
    assert [(r.path, r.line, r.column) for r in P.decoder_functions(f).collect()] == [("f0.js", 1, 23)]
    rows = P.indicator_findings(f).orderBy("path", "column").collect()
    assert [(r.path, r.severity) for r in rows if r.path == "f2.js"] == [("f2.js", "medium")] * 2
    assert [(r.column, r.severity) for r in rows if r.path == "f3.js"] == [(1, "critical"), (5, "critical"), (14, "critical"), (24, "critical")]
    assert {r.path for r in rows} == {"f2.js", "f3.js"}


@pytest.mark.parametrize("runs", ["eval(atob(x))", "vm.runInNewContext(x)", "cp.execSync(x)", "new Function(x)"])
def test_encrypted_payloads(spark, runs):
    f = files(spark, f'a\nconst b = "{BLOB}";\n{runs}', f'const b = "{BLOB}";', runs, f"const b = '{'a' * 100}'; {runs}", f"const b = '{BLOB[:40]}'; {runs}")
    assert [(r.path, r.line, r.severity) for r in P.encrypted_payloads(f).collect()] == [("f0.js", 2, "high")]


def test_header_channels(spark):
    parts = ["https.get(u, (res) => {", 'k = res.headers["x"]', "d = createDecipheriv(a, k)", "eval(d)"]
    xor = 'fetch(u)\nr.headers.get("x")\no = h.charCodeAt(i) ^ 1\n\n\nString.fromCharCode(o)\nnew Function(o)'
    far = xor.replace("\n\n\n", "\n\n\n\n\n\n")
    f = files(spark, "\n".join(parts), *("\n".join(p for p in parts if p != drop) for drop in parts), xor, far)
    assert sorted((r.path, r.line) for r in P.header_channels(f).collect()) == [("f0.js", 2), ("f5.js", 2)]


def test_rc4(spark):
    code = "new Array(256); x ^ y; z % 256; t = s[i]; s[i] = s[j]; s[j] = t; charCodeAt(0)"
    row = spark.createDataFrame([(code,)], "c string").select(P.rc4_indicators(F.col("c")).alias("k"), P.rc4_confidence(F.lit(5)).alias("s")).first()
    assert row.k == ["INIT_256", "XOR_OP", "MOD_256", "SWAP", "CHARCODE"] and row.s == 0.85


def test_engine(spark):
    assert ThreatEngine().detector_count == 0 and ThreatEngine().scan(files(spark, "​")).count() == 0
    engine = ThreatEngine.default()
    assert engine.detector_count == len(FAMILIES) + 2 + 1
    f = files(spark, "const x​ = 1;", 'const file = "a‮b";')
    all_rows = engine.scan(f)
    assert all_rows.count() == 3
    assert deduplicated(all_rows).count() == 2 and deduplicated(all_rows, fixes=True).count() == 3
    stats = session_stats(all_rows).first()
    assert (stats.total_files, stats.total_findings, stats.critical_findings) == (2, 3, 3)
    assert at_least(scan_characters(f, ("tags",)), "low").count() == 0
    assert all_rows.where("category = 'bidirectional_override'").select(display(all_rows)).first()[0].startswith("[CRITICAL] f1.js:1:16 - U+202E (bidirectional_override)")


def test_cached_scan(spark):
    engine = ThreatEngine.default(("l1",), cache=True)
    assert engine.scan(files(spark, "a\u200b")).count() == 1 and len(engine.cached) == 1
    engine.release()
    assert not engine.cached and U.confusables_of("i") == [0x3B9]


def test_custom_detector(spark):
    engine = ThreatEngine().register("mine", lambda f: U.tag_characters(f).withColumn("detector", F.lit("mine")))
    assert engine.scan(files(spark, "a\U000e0041")).first().detector == "mine"


def test_raw_documents_are_clean(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("concat(doc_id, '.js') AS path", "text AS content")
    assert ThreatEngine.default(("l1",)).scan(docs).count() == 0


def test_plans_stay_in_the_jvm(spark):
    f = files(spark, "x")
    plan = ThreatEngine.default(("l1",)).scan(f)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_every_match_holds_the_pattern_s_literal():
    from threatlake.functions import fixed as X
    from threatlake.functions.text import anchor

    assert anchor(r"\bvm\.runIn(NewContext|ThisContext)\s*\(") == "runIn" and anchor("charCodeAt|fromCharCode") is None and anchor(r"\^") is None
    assert anchor(X.RC4_PATTERNS["INIT_256"]) is None and anchor(r"ab?c") is None
    for pattern in [*X.EXEC_PATTERNS, *X.CLIENT_PATTERNS, *X.HEADER_PATTERNS, *X.DECRYPT_PATTERNS, *X.EVAL_PATTERNS]:
        assert anchor(pattern) and anchor(pattern) in pattern


def test_long_lines_and_many_lines(spark):
    """A line of a million characters and a file of a hundred thousand lines take a time that grows with their length only."""
    line = "a" * 500_000 + "​" + "pаss" + "b" * 500_000
    rows = scan_text(spark, line, "one.js").collect()
    assert sorted((r.category, r.column) for r in rows) == [("homoglyph", 500_003), ("invisible_character", 500_001)]
    many = "eval(x)\r\n" * 100_000 + "‮"
    found = scan_text(spark, many, "many.js")
    assert found.where("category = 'glassware_pattern'").count() == 100_000 and found.where("category = 'bidirectional_override'").first().line == 100_001
