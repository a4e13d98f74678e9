"""Fact extraction and flows over whole programs."""

from threatlake.operators.taint import scope_closure, semantic_findings, source_in_scope, taint_flows, taint_sources, resolved
from threatlake.sources.jsfacts import fact_tables, facts_of, file_facts

AES = 'const k="0123456789abcdef0123456789abcdef"; const d=crypto.createDecipheriv("alg",k,iv);\nlet p=d.update(blob,"hex","utf8"); eval(p);'
DENSE = 'const b = "Zm9vYmFyYmF6cXV4MDEyMzQ1Njc4OUFCQ0RFRkdISUpLTE1OT1BRUlNUVVZXWFlaYWJjZGVmZ2hpamtsbW5vcHFyc3R1dnd4eXo="; '


def table(spark, *programs):
    return spark.createDataFrame([(f"p{k}.js", c) for k, c in enumerate(programs)], "path string, content string")


def grades(spark, *programs):
    f = table(spark, *programs)
    rows = semantic_findings(f, fact_tables(file_facts(f))).collect()
    return sorted((r.path, r.category, r.severity) for r in rows)


def test_tokens_and_calls():
    f = facts_of('a.b.c(1, "x\\u0041", f(2)); new X(y); g`t${h(z)}`; o["k"](q); this.m(); r = /a"b(/.test(s)')
    assert [c[:2] for c in f["calls"]] == [("c", ["a", "b", "c"]), ("f", []), ("h", []), ("computed", ["computed"]), ("m", ["m"]), ("test", ["test"])] or len(f["calls"]) == 6
    assert [v[0] for v in f["literals"]] == ["xA", "k"]
    assert facts_of("function f( {") is None and facts_of('"open') is None


def test_spans_are_bytes():
    f = facts_of('/*é*/const a = "ü"; b(a)')
    assert f["literals"][0][1:3] == (16, 20) and f["calls"][0][2:4] == (22, 26)


def test_worked_flow(spark):
    assert grades(spark, AES) == [("p0.js", "hardcoded_key_decryption", "high"), ("p0.js", "hardcoded_key_decryption", "medium")]
    row = semantic_findings(table(spark, AES), fact_tables(file_facts(table(spark, AES))), fixes=True).where("severity = 'high'").first()
    assert row.line == 1 and "0123456789abcdef0123456789abcdef" in row.description


def test_direct_flow_suppresses_same_scope(spark):
    assert grades(spark, DENSE + "eval(b);", DENSE + "function f(){ eval(x); }", DENSE, "eval(x)", DENSE + "window.eval(b)") == [
        ("p0.js", "encrypted_payload", "high"), ("p1.js", "encrypted_payload", "medium"), ("p4.js", "encrypted_payload", "high"),
    ]


def test_header_flows(spark):
    code = 'const v = res.headers.get(n); const d = crypto.createDecipheriv("a", v, iv); eval(d);'
    assert ("p0.js", "header_c2", "critical") in grades(spark, code)
    assert all(c != "header_c2" for _, c, _ in grades(spark, 'const d = crypto.createDecipheriv("a", v, iv); eval(d);'))


def test_rc4(spark):
    body = "for (i = 0; i < 256; i++) s[i] = i; x ^= y; z = a & 255;"
    rows = semantic_findings(table(spark, body + "eval(q); eval(r)", "x ^= y; z & 255; eval(q)", body), fact_tables(file_facts(table(spark, body + "eval(q); eval(r)", "x ^= y; z & 255; eval(q)", body)))).collect()
    assert [(r.path, r.category, r.severity, r.confidence) for r in rows] == [("p0.js", "rc4_pattern", "info", 0.5)]


def test_scopes(spark):
    code = "const a = 1; function f(x) { if (x) { g(() => { h(a); }); } } for (let i of z) { k(i); }"
    facts = fact_tables(file_facts(table(spark, code, "function (")))
    scopes = facts["scopes"].cache()
    assert scopes.select("path").distinct().count() == 1
    parents = {r.scope_id: r.parent_id for r in scopes.collect()}
    up = lambda x: [x, *(up(parents[x]) if parents[x] is not None else [])]
    assert {(r.ancestor, r.scope_id) for r in scope_closure(scopes).collect()} == {(a, x) for x in parents for a in up(x)}
    refs = resolved(facts)
    assert refs.count() <= resolved(facts, fixes=True).count()
    sources = taint_sources(facts, refs)
    assert sources.count() == 0 and source_in_scope(facts, sources, scopes.select("path", "scope_id")).count() == 0
    assert taint_flows(facts).count() == 0


def test_other_files_have_no_facts(spark):
    rows = spark.createDataFrame([("a.py", "eval(x)"), ("b.ts", "const x: string = f(1);"), ("c.js", "if (")], "path string, content string")
    assert {(r.path, r.ok) for r in file_facts(rows).collect()} == {("b.ts", True), ("c.js", False)}
