"""Labels of what encloses what against spans, flows over one file with very many sources and sinks, and deep programs."""

import random
import time

import pytest

from threatlake.operators import taint as T
from threatlake.sources.jsfacts import enclosing, fact_tables, facts_of, file_facts


def holds(a, b, x, y):
    return a is not None and a <= x and y <= b


def program(rng, depth=0):
    """A random program with nested calls, initialisers and functions."""
    names = ["a", "b", "c", "d"]

    def value(depth):
        kind = rng.randrange(7) if depth < 5 else rng.randrange(2)
        if kind == 0:
            return rng.choice(names)
        if kind == 1:
            return f'"{rng.choice("wxyzü")}"'
        if kind == 2:
            return f"{rng.choice(['f', 'o.p', 'eval', 'o.p(a).q'])}({', '.join(value(depth + 1) for _ in range(rng.randrange(4)))})"
        if kind == 3:
            return f"[{value(depth + 1)}, {value(depth + 1)}]"
        if kind == 4:
            return f"({rng.choice(names)} => {value(depth + 1)})"
        if kind == 5:
            return f"() => {{ {statement(depth + 1)} }}"
        return f"{value(depth + 1)} + {value(depth + 1)}"

    def statement(depth):
        if rng.random() < 0.6:
            return f"const {rng.choice(names)} = {value(depth)}, {rng.choice(names)} = {value(depth)};"
        return f"{value(depth)};" if rng.random() < 0.7 or depth > 4 else f"function g(x) {{ {statement(depth + 1)} {statement(depth + 1)} }}"

    return "\n".join(statement(depth) for _ in range(6))


@pytest.mark.parametrize("seed", range(40))
def test_labels_equal_the_spans(seed):
    text = program(random.Random(seed))
    f = facts_of(text)
    assert f is not None, text
    label = f["labels"]
    symbols = sorted(range(len(f["declarations"])), key=lambda k: f["declarations"][k][5])
    init = lambda k: f["declarations"][k][2:4]
    first = lambda x, y: next((k for k in symbols if holds(*init(k), x, y)), None)
    assert label["literal_of"] == [first(*v[1:3]) for v in f["literals"]]
    assert label["call_of"] == [first(*c[2:4]) for c in f["calls"]]
    inside = lambda a, b: next((k for k, v in enumerate(f["literals"]) if holds(a, b, *v[1:3])), None)
    assert label["init_literal"] == [inside(*init(k)) for k in range(len(symbols))]
    assert label["arg_literal"] == [[inside(a, b) for a, b in c[5]] for c in f["calls"]]
    for k, r in enumerate(f["references"]):
        assert sorted(label["in_inits"][k]) == [s for s in range(len(symbols)) if holds(*init(s), *r[1:3])]
        assert sorted(label["in_args"][k]) == [(c, j) for c, call in enumerate(f["calls"]) for j, (a, b) in enumerate(call[5]) if holds(a, b, *r[1:3])]
    data = text.encode()
    for name, begin in (("literals", 1), ("calls", 2)):
        for fact, (place, line) in zip(f[name], f["places"][name]):
            before = data[: fact[begin]].decode()
            assert (place, line) == (len(before) + 1, before.count("\n") + 1)


def test_enclosing_of_any_intervals():
    rng = random.Random(2)
    span = lambda: (lambda a: (a, a + 1 + rng.randrange(30)))(rng.randrange(60))
    intervals, spans = [span() for _ in range(80)], [span() for _ in range(200)]
    found = enclosing(intervals, spans)
    assert [sorted(x) for x in found] == [[k for k, (a, b) in enumerate(intervals) if a <= x and y <= b] for x, y in spans]


BLOB = "Zm9vYmFyYmF6cXV4MDEyMzQ1Njc4OUFCQ0RFRkdISUpLTE1OT1BRUlNUVVZXWFlaYWJjZGVmZ2hpamtsbW5vcHFyc3R1dnd4eXo="


def test_siblings_of_one_file_do_not_meet(spark):
    """20,000 sources and 20,000 sinks in sibling functions of one file: the flows are those within a function, and no join makes more rows."""
    n = 20_000
    scopes = spark.range(1, 2 * n + 1).selectExpr("'f.js' AS path", "cast(id AS int) AS scope_id", "0 AS parent_id", "array(0, cast(id AS int)) AS scope_path")
    scopes = scopes.union(spark.sql("SELECT 'f.js', 0, cast(NULL AS int), array(0)"))
    ids = spark.range(n).selectExpr("'f.js' AS path", "cast(id AS int) AS seq")
    fact = "0 AS span_start, 1 AS span_end, 1 AS place, 1 AS at_line, cast(NULL AS int) AS assigned_to"
    facts = {
        "scopes": scopes,
        "literals": ids.selectExpr("path", "seq AS lit_seq", f"'{BLOB}' AS value", "5.5D AS entropy", "seq + 1 AS scope_id", *fact.split(", ")),
        # every tenth sink stands with a source, the others in functions of their own
        "calls": ids.selectExpr("path", "seq AS call_seq", "'eval' AS callee", "cast(array() AS array<string>) AS callee_chain", f"if(seq % 10 = 0, seq + 1, {n} + seq + 1) AS scope_id", *fact.split(", ")),
        "args": spark.createDataFrame([], "path string, call_seq int, arg_idx int, first_lit int"),
        "declarations": spark.createDataFrame([], "path string, symbol_id int, name string, scope_id int, node_seq int, first_lit int"),
        "references": spark.createDataFrame([], "path string, ref_seq int, name string, scope_id int, node_seq int, in_args array<struct<call_seq: int, arg_idx: int>>, in_inits array<int>"),
    }
    flows = T.taint_flows(facts)
    began = time.time()
    assert flows.groupBy("flow").count().collect() == [("same_scope", n // 10)]
    assert time.time() - began < 30
    plan = flows._jdf.queryExecution().optimizedPlan().toString()
    assert "span_start" not in plan.split("LogicalRDD")[0] and "array_contains(scope_path" not in plan and "array_contains(up" not in plan


def test_scopes_relate_as_ancestors(spark):
    code = f'const a = "{BLOB}"; function f() {{ const b = "{BLOB}"; if (x) {{ eval(q); }} function g() {{ const c = "{BLOB}"; }} }} function h() {{ eval(r); }}'
    facts = fact_tables(file_facts(spark.createDataFrame([("p.js", code)], "path string, content string")))
    rows = T.taint_flows(facts).collect()
    ancestors = {}
    for r in T.scope_closure(facts["scopes"]).collect():
        ancestors.setdefault(r.scope_id, set()).add(r.ancestor)
    sources = {f"0:{r.lit_seq:09}": r.scope_id for r in facts["literals"].collect()}
    sinks = {r.call_seq: r.scope_id for r in facts["calls"].collect()}
    want = {(s, k) for s, a in sources.items() for k, b in sinks.items() if a in ancestors[b] or b in ancestors[a]}
    assert {(r.source_id, r.sink_seq) for r in rows} == want and len(rows) == len(want)


def test_deep_programs_take_linear_time():
    def seconds(n):
        code = "const f = " + "a => " * n + "b;"
        began = time.time()
        found = facts_of(code)
        assert len(found["scopes"]) == n + 1 and [r[0] for r in found["references"]] == ["b"]
        return time.time() - began

    seconds(500)
    assert seconds(8000) < 3


@pytest.mark.parametrize("code, want", [
    ("const g = <T,>(x: T) => x\nf()", "<T,>(x: T) => x"),
    ("const g = <T extends K<U>>(x) => h(x);", "<T extends K<U>>(x) => h(x)"),
    ("const g = a => b => c\nf()", "a => b => c"),
])
def test_generic_and_curried_initialisers(code, want):
    (_, _, a, b, _, _), *_ = facts_of(code)["declarations"]
    assert code[a:b] == want
