"""Queries of fact extraction and taint flows, with their oracles.

Flow joins run on fact tables that a projection of ``lineitem`` makes, one file
per order; the detectors run end to end on one program per document.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..operators import taint as T
from ..sources.jsfacts import fact_tables, file_facts, literal_entropy
from .planted import BLOB

# One text for Spark and DuckDB: a line item gives a scope, a declaration, a call with two arguments, two references and a literal.
_N = "CAST(l_linenumber AS INT)"
_P = "concat('o', CAST(l_orderkey AS VARCHAR(20)))"
_CALLEE = "CASE l_suppkey % 5 WHEN 0 THEN 'eval' WHEN 1 THEN 'createDecipheriv' WHEN 2 THEN 'get' WHEN 3 THEN 'exec' ELSE 'log' END"
FACTS = {
    "scopes": f"SELECT DISTINCT {_P} AS path, 0 AS scope_id, CAST(NULL AS INT) AS parent_id FROM lineitem" + "".join(f" UNION ALL SELECT DISTINCT {_P}, {n}, {n // 2} FROM lineitem" for n in range(1, 8)),
    "declarations": f"SELECT {_P} AS path, {_N} AS symbol_id, concat('v', CAST(l_partkey % 3 AS VARCHAR(9))) AS name, 'const' AS kind, 100 * {_N} AS init_start, 100 * {_N} + 60 AS init_end, CAST(l_linenumber % 3 AS INT) AS scope_id, 10 * {_N} AS node_seq FROM lineitem",
    "calls": f"SELECT {_P} AS path, {_N} AS call_seq, {_CALLEE} AS callee, CAST(l_suppkey % 5 AS INT) AS kind_no, 100 * {_N} + 2 AS span_start, 100 * {_N} + 58 AS span_end, CAST(l_linenumber % 3 AS INT) AS scope_id FROM lineitem",
    "args": f"SELECT {_P} AS path, {_N} AS call_seq, 0 AS arg_idx, 100 * {_N} + 10 AS arg_start, 100 * {_N} + 25 AS arg_end FROM lineitem UNION ALL SELECT {_P}, {_N}, 1, 100 * {_N} + 30, 100 * {_N} + 55 FROM lineitem",
    "references": f"SELECT {_P} AS path, 2 * {_N} AS ref_seq, concat('v', CAST(l_suppkey % 3 AS VARCHAR(9))) AS name, 100 * {_N} + 12 AS span_start, 100 * {_N} + 14 AS span_end, CAST(l_linenumber % 3 AS INT) AS scope_id, 10 * {_N} + 5 AS node_seq FROM lineitem "
    f"UNION ALL SELECT {_P}, 2 * {_N} + 1, concat('v', CAST(l_orderkey % 3 AS VARCHAR(9))), 100 * {_N} + 40, 100 * {_N} + 42, CAST(l_linenumber % 2 AS INT), 10 * {_N} + 6 FROM lineitem",
    "literals": f"SELECT {_P} AS path, {_N} AS lit_seq, CASE WHEN l_quantity > 25 THEN '{BLOB}' ELSE 'key' END AS value, 100 * {_N} + 31 AS span_start, 100 * {_N} + 38 AS span_end, CAST(l_linenumber % 3 AS INT) AS scope_id FROM lineitem",
}


def _planted_facts(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    packed = F.shiftleft(F.col("l_partkey").cast("long"), 28) + F.shiftleft(F.col("l_suppkey").cast("long"), 6) + F.col("l_quantity").cast("long")
    dealt = T.by_file(items.select(F.expr(_P).alias("path"), F.col("l_linenumber").cast("int"), packed.alias("l")), items.count())
    # a line number may come twice in an order: the least row stays, so that facts are unique by their key; packed into one number, it is found without a sort
    least = dealt.groupBy("path", "l_linenumber").agg(F.min("l").alias("l")).sortWithinPartitions("path", "l_linenumber").persist(StorageLevel.DISK_ONLY)
    field = lambda low, bits, name: F.shiftright("l", low).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).alias(name)
    items = least.select("path", F.substring("path", 2, 20).cast("long").alias("l_orderkey"), "l_linenumber", field(28, 35, "l_partkey"), field(6, 22, "l_suppkey"), field(0, 6, "l_quantity"))
    made = {}
    for name, sql in FACTS.items():
        items.createOrReplaceTempView("planted_lineitem")
        # the files' names are made once, before the shuffle by them
        made[name] = spark.sql(sql.replace(_P, "path").replace("FROM lineitem", "FROM planted_lineitem"))
    # each file's eight scopes from one pass over the items
    scope = lambda n: F.struct(F.lit(n).alias("scope_id"), F.lit(n // 2 if n else None).cast("int").alias("parent_id"))
    made["scopes"] = items.select("path").distinct().select("path", F.inline(F.array(*map(scope, range(8)))))
    chain = F.when(F.col("kind_no") == 1, F.array(F.lit("crypto"), F.lit("createDecipheriv"))).when(F.col("kind_no") == 2, F.array(F.lit("res"), F.lit("headers"), F.lit("get")))
    chain = chain.when(F.col("kind_no") == 3, F.array(F.lit("child_process"), F.lit("exec"))).otherwise(F.array().cast("array<string>"))
    made["calls"] = made["calls"].withColumn("callee_chain", chain)
    half = lambda c: F.floor(c / 2).cast("int")
    up = F.array(F.lit(0), half(half(F.col("scope_id"))), half(F.col("scope_id")), F.col("scope_id"))
    made["scopes"] = made["scopes"].withColumn("scope_path", F.array_distinct(up))
    # what encloses what, as an extractor labels it; the oracle compares the spans
    placed = lambda seq: {"place": F.col("span_start") + 1, "at_line": F.lit(1), "assigned_to": F.col(seq)}
    made["literals"] = made["literals"].withColumns({**placed("lit_seq"), "entropy": F.when(F.col("value") == BLOB, F.lit(literal_entropy(BLOB)))})
    made["calls"] = made["calls"].withColumns(placed("call_seq"))
    made["args"] = made["args"].withColumn("first_lit", F.when(F.col("arg_idx") == 1, F.col("call_seq")))
    made["declarations"] = made["declarations"].withColumn("first_lit", F.col("symbol_id"))
    within = F.struct(half(F.col("ref_seq")).alias("call_seq"), (F.col("ref_seq") % 2).cast("int").alias("arg_idx"))
    made["references"] = made["references"].withColumns({"in_args": F.array(within), "in_inits": F.array(half(F.col("ref_seq")))})
    return made


def _planted_flows(spark, d, facts=None):
    return T.taint_flows(facts or _planted_facts(spark, d), kept=lambda df: df.persist(StorageLevel.DISK_ONLY))


VIEWS = "WITH RECURSIVE " + ",\n".join(f"{n} AS ({q})" for n, q in {**FACTS, "refs": FACTS["references"]}.items() if n != "references") + """,
res AS (SELECT r.path, r.ref_seq, r.span_start, r.span_end, arg_min(d.symbol_id, d.node_seq) AS symbol_id FROM refs r JOIN declarations d ON r.path = d.path AND r.name = d.name AND r.scope_id = d.scope_id AND d.node_seq < r.node_seq GROUP BY ALL),
s2c AS (SELECT DISTINCT res.path, symbol_id, call_seq FROM res JOIN args a ON res.path = a.path AND a.arg_start <= res.span_start AND res.span_end <= a.arg_end),
keys AS (SELECT a.path, a.call_seq, arg_min(value, lit_seq) AS key_value FROM args a JOIN literals l ON a.path = l.path AND a.arg_start <= l.span_start AND l.span_end <= a.arg_end WHERE arg_idx = 1 GROUP BY a.path, a.call_seq),
src0 AS (
  SELECT path, concat('0:', printf('%09d', lit_seq)) AS source_id, 'high_entropy' AS kind, CAST(NULL AS VARCHAR) AS key_value, span_start, span_end, scope_id FROM literals WHERE len(value) > 64
  UNION ALL SELECT path, concat('1:', printf('%09d', call_seq)), 'http_header', NULL, span_start, span_end, scope_id FROM calls WHERE kind_no = 2
  UNION ALL SELECT calls.path, concat('2:', printf('%09d', calls.call_seq)), 'crypto', key_value, span_start, span_end, scope_id FROM calls LEFT JOIN keys USING (path, call_seq) WHERE kind_no = 1
),
holds AS (SELECT s.path, source_id, arg_min(d.symbol_id, d.node_seq) AS sym FROM src0 s JOIN declarations d ON d.path = s.path AND d.init_start <= s.span_start AND s.span_end <= d.init_end GROUP BY s.path, source_id),
src AS (SELECT src0.*, sym FROM src0 LEFT JOIN holds USING (path, source_id)),
snk AS (SELECT path, call_seq AS sink_seq, CASE kind_no WHEN 0 THEN 'eval' ELSE 'child_process_exec' END AS sink, scope_id FROM calls WHERE kind_no IN (0, 3)),
reach AS (SELECT s2c.path, symbol_id, sink_seq, sink FROM s2c JOIN snk ON s2c.path = snk.path AND call_seq = sink_seq),
direct AS (SELECT DISTINCT src.path, source_id, kind, key_value, sink, sink_seq FROM src JOIN reach ON src.path = reach.path AND sym = symbol_id),
transitive AS (
  SELECT src.path, source_id, src.kind, key_value, sink, sink_seq FROM src JOIN res ON src.path = res.path AND sym = res.symbol_id JOIN declarations d ON d.path = src.path AND d.init_start <= res.span_start AND res.span_end <= d.init_end
  JOIN reach ON reach.path = src.path AND reach.symbol_id = d.symbol_id ANTI JOIN direct x ON x.path = src.path AND x.source_id = src.source_id AND x.sink_seq = reach.sink_seq
),
anc(path, ancestor, scope_id) AS (
  SELECT path, scope_id, scope_id FROM scopes UNION ALL SELECT anc.path, s.parent_id, anc.scope_id FROM anc JOIN scopes s ON s.path = anc.path AND s.scope_id = anc.ancestor WHERE s.parent_id IS NOT NULL
),
same_scope AS (
  SELECT src.path, source_id, kind, key_value, sink, sink_seq FROM src JOIN snk ON src.path = snk.path
  WHERE (EXISTS (SELECT 1 FROM anc WHERE anc.path = src.path AND ancestor = src.scope_id AND anc.scope_id = snk.scope_id) OR EXISTS (SELECT 1 FROM anc WHERE anc.path = src.path AND ancestor = snk.scope_id AND anc.scope_id = src.scope_id))
    AND NOT EXISTS (SELECT 1 FROM direct x WHERE x.path = src.path AND x.source_id = src.source_id AND x.sink_seq = snk.sink_seq)
),
flows AS (SELECT *, 'direct' AS flow FROM direct UNION ALL SELECT *, 'transitive' FROM transitive UNION ALL SELECT *, 'same_scope' FROM same_scope)
"""

# One program per document: by the id's remainder a different flow.
PROGRAM = f"""CASE doc_id % 5
  WHEN 0 THEN 'const k = "0123456789abcdef"; const d = crypto.createDecipheriv("alg", k, iv);' || chr(10) || 'let p = d.update(blob, "hex", "utf8"); eval(p);'
  WHEN 1 THEN 'function run() {{' || chr(10) || '  const b = "{BLOB}";' || chr(10) || '  eval(b);' || chr(10) || '}}'
  WHEN 2 THEN 'const h = res.headers.get("x-key");' || chr(10) || 'const d = crypto.createDecipheriv("alg", h, iv);' || chr(10) || 'child_process.exec(d);'
  WHEN 3 THEN 'var s = []; for (i = 0; i < 256; i++) s[i] = i; t = s[i]; s[i] = s[j]; s[j] = t; x ^= s[(i + j) % 256]; y = String.fromCharCode(x);' || chr(10) || 'window.eval(y);'
  ELSE 'const a = "plain"; if (a) {{ console.log(a, {{ b: 1 }}); }}'
END"""
#: Before it stands the document's whole text in a comment, so that all spans depend on it.
COMMENT = "concat('/* ', replace(coalesce(text, ''), '*/', '* /'), ' */', chr(10))"
BASE = ["doc_id", "concat('src/', CAST(doc_id AS VARCHAR(20)), '.js') AS path"]


def _programs(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.selectExpr(*BASE, f"concat({COMMENT}, {PROGRAM}) AS content")


def semantic_detectors(spark, d):
    files = _programs(spark, d)
    found = T.semantic_findings(files, fact_tables(file_facts(files, T.VALUE_CHARS).persist(StorageLevel.DISK_ONLY)))
    return found.groupBy("path", "category", "severity").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"), F.min("line").alias("place"), F.max("description").alias("description"))


def js_facts_extract(spark, d):
    facts = file_facts(_programs(spark, d))
    sizes = [F.size(c).cast("long").alias(f"n_{c}") for c in ("scopes", "literals", "calls", "declarations")]
    return facts.select("path", "ok", *sizes)


def page_script_facts(spark, d):
    """Facts of the pages' inline scripts."""
    pages = spark.read.parquet(f"{d}/pages.parquet")
    scripts = pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".js")).alias("path"), F.explode(F.regexp_extract_all("html", F.lit("(?is)<script[^>]*>(.*?)</script>"), F.lit(1))).alias("content"))
    t = fact_tables(file_facts(scripts))
    return t["calls"].groupBy("callee").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("n_files"))


# Programs made of the documents' whole texts: all words as one member chain that is called, or all letters as one key.
def callee_chains(spark, d):
    """The chain of names of a call."""
    words = F.transform(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"), F.lit(1)), lambda w: F.concat(F.lit("_"), w, F.lit(".")))
    content = F.concat(F.lit("_."), F.array_join(words, ""), F.lit('end("'), F.coalesce("lang", F.lit("")), F.lit('");'))
    files = spark.read.parquet(f"{d}/documents.parquet").select(F.expr(BASE[1]), content.alias("content"))
    calls = fact_tables(file_facts(files))["calls"]
    return calls.select("path", "callee", F.size("callee_chain").cast("long").alias("n_names"), F.md5(F.array_join("callee_chain", ".").cast("binary")).alias("digest"), F.col("span_end").cast("long").alias("span_end"))


def key_previews(spark, d):
    """What a finding shows of a hard-coded key: the first 32 characters of one of more than 32 bytes."""
    key = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]+", "")
    content = F.concat(F.lit('const k = "'), key, F.lit('";\nconst d = crypto.createDecipheriv("alg", k, iv);\neval(d);'))
    files = spark.read.parquet(f"{d}/documents.parquet").select(F.expr(BASE[1]), content.alias("content"))
    found = T.semantic_findings(files, fact_tables(file_facts(files, T.VALUE_CHARS).persist(StorageLevel.DISK_ONLY)), fixes=True)
    return found.where("category = 'hardcoded_key_decryption'").select("path", "line", "severity", "description")


_FLOW = ["path", "source_id", "kind", "sink", "sink_seq"]


def _flows(kind):
    return lambda s, d: _planted_flows(s, d).where(F.col("flow") == kind).select(*_FLOW)


def _graded(spark, d, rows, high, weak):
    return rows.groupBy(F.when(F.col("flow") == "same_scope", weak).otherwise(high).alias("severity"), "sink").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("n_files"))


def gw008(spark, d):
    facts = _planted_facts(spark, d)
    header = facts["calls"].where(F.array_contains("callee_chain", "headers")).select("path").distinct()
    return _graded(spark, d, _planted_flows(spark, d, facts).where("kind = 'crypto'").join(header, "path", "left_semi"), "critical", "high")


def closure(spark, d):
    """How many scopes enclose each scope, itself included."""
    return T.scope_closure(_planted_facts(spark, d)["scopes"]).groupBy("path", "scope_id").agg(F.count(F.lit(1)).alias("n_ancestors"))


QUERIES = {
    "scope_closure": closure,
    "direct_flows": _flows("direct"),
    "transitive_flows": _flows("transitive"),
    "same_scope_flows": _flows("same_scope"),
    "gw005_semantic": lambda s, d: _graded(s, d, _planted_flows(s, d).where("kind = 'high_entropy'"), "high", "medium"),
    "gw006_semantic": lambda s, d: _graded(s, d, _planted_flows(s, d).where("kind = 'crypto' AND key_value IS NOT NULL"), "high", "medium"),
    "gw008_semantic": gw008,
    "semantic_detectors": semantic_detectors,
    "js_facts_extract": js_facts_extract,
    "page_script_facts": page_script_facts,
    "callee_chains": callee_chains,
    "key_previews": key_previews,
}

_ITEMS = "items AS MATERIALIZED (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1)"
_VIEWS = VIEWS.replace("FROM lineitem", "FROM items").replace("WITH RECURSIVE ", f"WITH RECURSIVE {_ITEMS},\n", 1)
#: Without what needs the scopes' ancestors.
_JOINED = _VIEWS[: _VIEWS.index("anc(path")].rstrip().rstrip(",")
_SELECT = "SELECT path, source_id, kind, sink, sink_seq FROM"
_GRADED = "SELECT CASE flow WHEN 'same_scope' THEN '{1}' ELSE '{0}' END AS severity, sink, count(*) AS n, count(DISTINCT path) AS n_files FROM flows WHERE {2} GROUP BY 1, 2"
ORACLES = {
    "scope_closure": f"{_VIEWS} SELECT path, scope_id, count(*) AS n_ancestors FROM anc GROUP BY path, scope_id",
    "direct_flows": f"{_JOINED} {_SELECT} direct",
    "transitive_flows": f"{_JOINED} {_SELECT} transitive",
    "same_scope_flows": f"{_VIEWS} {_SELECT} same_scope",
    "gw005_semantic": _VIEWS + _GRADED.format("high", "medium", "kind = 'high_entropy'"),
    "gw006_semantic": _VIEWS + _GRADED.format("high", "medium", "kind = 'crypto' AND key_value IS NOT NULL"),
    "gw008_semantic": _VIEWS + _GRADED.format("critical", "high", "kind = 'crypto' AND path IN (SELECT path FROM calls WHERE kind_no = 2)"),
    "semantic_detectors": f"""WITH programs AS (SELECT doc_id, doc_id % 5 AS k, concat('src/', doc_id, '.js') AS path, {COMMENT} AS comment, {PROGRAM} AS program FROM documents),
expected(k, category, severity, confidence, spot, description) AS (VALUES
  (0, 'hardcoded_key_decryption', 'high', NULL, 'crypto.', 'Decryption by createDecipheriv with key ''0123456789abcdef'' flows to eval'), (0, 'hardcoded_key_decryption', 'medium', NULL, 'crypto.', 'Decryption by createDecipheriv with key ''0123456789abcdef'' flows to eval'),
  (1, 'encrypted_payload', 'high', NULL, '"', 'Literal of high entropy flows to eval (flow: direct)'), (2, 'hardcoded_key_decryption', 'high', NULL, 'crypto.', 'Decryption by createDecipheriv with key ''x-key'' flows to child_process_exec'),
  (2, 'header_c2', 'critical', NULL, 'crypto.', 'Header access and createDecipheriv flow to child_process_exec'), (3, 'rc4_pattern', 'info', 0.85::DOUBLE, 'window.eval', 'Hand-made stream cipher near eval: INIT_256, XOR_OP, MOD_256, SWAP, CHARCODE'))
SELECT path, category, severity, CAST(1 AS BIGINT) AS n, confidence, CAST(len(comment) + instr(program, spot) AS BIGINT) AS place, description FROM programs JOIN expected USING (k)""",
    "js_facts_extract": """WITH expected(k, n_scopes, n_literals, n_calls, n_declarations) AS (VALUES (0, 1, 4, 3, 3), (1, 2, 1, 1, 1), (2, 1, 2, 3, 2), (3, 2, 0, 2, 1), (4, 2, 1, 1, 1))
SELECT concat('src/', doc_id, '.js') AS path, true AS ok, CAST(n_scopes AS BIGINT) AS n_scopes, CAST(n_literals AS BIGINT) AS n_literals, CAST(n_calls AS BIGINT) AS n_calls, CAST(n_declarations AS BIGINT) AS n_declarations
FROM documents JOIN expected ON doc_id % 5 = k""",
    "callee_chains": """WITH chained AS (SELECT concat('src/', doc_id, '.js') AS path, coalesce(lang, '') AS lang, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM documents),
made AS (SELECT path, lang, len(w) AS n, '_.' || coalesce(array_to_string(list_transform(w, lambda x: '_' || x || '.'), ''), '') || 'end' AS chain FROM chained)
SELECT path, 'end' AS callee, CAST(n + 2 AS BIGINT) AS n_names, md5(chain) AS digest, CAST(strlen(chain) + strlen(lang) + 4 AS BIGINT) AS span_end FROM made""",
    "key_previews": """WITH keys AS (SELECT concat('src/', doc_id, '.js') AS path, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]+', '', 'g') AS k FROM documents)
SELECT path, CAST(2 AS BIGINT) AS line, 'high' AS severity, 'Decryption by createDecipheriv with key ''' || CASE WHEN strlen(k) > 32 THEN left(k, 32) || '...' ELSE k END || ''' flows to eval' AS description FROM keys""",
    "page_script_facts": r"""WITH scripts AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1)) AS content FROM pages),
calls AS (SELECT page_id, unnest(regexp_extract_all(content, '([A-Za-z]+)\(', 1)) AS callee FROM scripts)
SELECT callee, count(*) AS n, count(DISTINCT page_id) AS n_files FROM calls GROUP BY callee""",
}
