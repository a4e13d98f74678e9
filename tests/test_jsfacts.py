"""What is read from single programs: initialisers, calls and references, in all styles of writing."""

import pytest

from threatlake.sources.jsfacts import facts_of, file_facts, rejects


def told(code):
    f = facts_of(code)
    assert f is not None, code
    data = code.encode()
    inits = {name: data[a:b].decode() if a is not None else None for name, _, a, b, _, _ in f["declarations"]}
    return inits, [c[0] for c in f["calls"]], [r[0] for r in f["references"]]


INITIALISERS = [
    ("const a = f(b)\neval(c)", {"a": "f(b)"}),
    ('const k = g("x")\nconst m = 2', {"k": 'g("x")', "m": "2"}),
    ("const a = f(b);\neval(c);", {"a": "f(b)"}),
    ("let a = [1, 2]\nlet b = a[0]\nb()", {"a": "[1, 2]", "b": "a[0]"}),
    ("let a = `x${y}z`\nlet b = 1", {"a": "`x${y}z`", "b": "1"}),
    ("let a = {x: 1}\nfoo()", {"a": "{x: 1}"}),
    ("let a = b\n  + c\nd()", {"a": "b\n  + c"}),
    ("let a = b +\n  c\nd()", {"a": "b +\n  c"}),
    ("let a = f\n(b)\nc()", {"a": "f\n(b)"}),
    ("let a = b\n  .c()\n  .d()\ne()", {"a": "b\n  .c()\n  .d()"}),
    ("let a = await\n f()\ng()", {"a": "await\n f()"}),
    ("let a = i++\nb()", {"a": "i++"}),
    ("let a = i\n++b", {"a": "i"}),
    ("let a = x in\n y\nb()", {"a": "x in\n y"}),
    ("let a = function () { return 1 }\nb()", {"a": "function () { return 1 }"}),
    ("let a = () => { b() }\nc()", {"a": "() => { b() }"}),
    ("let a = x => x + 1\nc()", {"a": "x => x + 1"}),
    ("let a = 1, b = f(2), c\nd()", {"a": "1", "b": "f(2)", "c": None}),
    ("for (let i = 0, n = f(); i < n; i++) g(i)", {"i": "0", "n": "f()"}),
    ("const a: string = f(b)\nc()", {"a": "f(b)"}),
    ("const a: Map<string, number> = f(b)\nc()", {"a": "f(b)"}),
    ("const a = f<string>(b)\nc()", {"a": "f<string>(b)"}),
    ("var a = b ? c : d\ne()", {"a": "b ? c : d"}),
    ("var a = (b, c)\ne()", {"a": "(b, c)"}),
    ("var a = new B(c)\nd()", {"a": "new B(c)"}),
    ("const a = class { x = 1 }\nb()", {"a": "class { x = 1 }"}),
    ("const a = b || {}\nc()", {"a": "b || {}"}),
    ("const a = /x/g\nc()", {"a": "/x/g"}),
]


@pytest.mark.parametrize("code,want", INITIALISERS)
def test_initialisers_end_where_the_statement_does(code, want):
    assert told(code)[0] == want


REGULAR = [
    ("if (x) /a[/]b/.test(y);", ["test"]),
    ("while (i--) /re/g.exec(s);", ["exec"]),
    ("for (;;) /'/.test(s)", ["test"]),
    ("{ a() } /'/.test(s)", ["a", "test"]),
    ("function f() {} /'/.test(s)", ["test"]),
    ("a = (b) / c / d; e('/')", ["e"]),
    ("a = {b: 1} / 2; c('/')", ["c"]),
    ("a = b[0] / 2; c('/')", ["c"]),
    ("a = i++ / 2; c('/')", ["c"]),
    ("a = this / 2; c('/')", ["c"]),
    ("a = `x` / 2; c('/')", ["c"]),
    ("return /'/.test(s)", ["test"]),
    ("x.if(y) / 2; c('/')", ["if", "c"]),
    ("s.replace(/[\"'`]/g, f('a'))", ["replace", "f"]),
    ("case /a'/.test(b): c()", ["test", "c"]),
]


@pytest.mark.parametrize("code,calls", REGULAR)
def test_regular_expressions_and_divisions(code, calls):
    assert sorted(told(code)[1]) == sorted(calls)


NAMES = [
    ("#!/usr/bin/env node\nf(a)", ["f", "a"]),
    ("outer: for (const x of y) { continue outer }", ["y", "outer"]),
    ("try { f() } catch (e) { g(h) }", ["f", "g", "h"]),
    ("try { f() } catch { g() }", ["f", "g"]),
    ("class A { x = b; static y = c; m() { n() } get z() { return d } }", ["b", "c", "n", "d"]),
    ("class A { x\n y\n m(p) { p() } }", ["p"]),
    ("const o = { m() { n() }, k: v, [w]: 1 }", ["n", "v", "w"]),
    ("a ? b : c", ["a", "b", "c"]),
    ("switch (a) { case b: c(); default: d() }", ["a", "b", "c", "d"]),
    ("\\u0065val(x)", ["eval", "x"]),
    ("var \\u{61}b = c", ["c"]),
    ("f(a.b?.c, d['e'])", ["f", "a", "d"]),
    ("const g = (a, b) => a + c", ["a", "c"]),
]


@pytest.mark.parametrize("code,names", NAMES)
def test_what_counts_as_a_reference(code, names):
    assert [n for n in told(code)[2]] == names


def test_index_ends_the_chain():
    f = facts_of("a?.[0]?.d(); a.b.c(); a['x']()")
    assert [(c[0], c[1]) for c in f["calls"]] == [("d", ["d"]), ("c", ["a", "b", "c"]), ("computed", ["computed"])]


def test_files_without_facts_are_listed(spark):
    rows = spark.createDataFrame([("a.js", "f("), ("b.js", "f()"), ("c.txt", "f(")], "path string, content string")
    assert [r.path for r in rejects(file_facts(rows)).collect()] == ["a.js"]
