"""Queries of the operators around the detectors: descriptions, previews, orders, shares, verdicts, exports, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..engine import FAMILIES, scan_characters
from ..functions.fixed import BIDI_NAMES, CONFUSABLES, RULE_IDS, ZERO_WIDTH_NAMES
from ..functions.stego import CLASS_DESCRIPTIONS, hex_preview, payload_class, text_entropy, text_preview
from ..operators import corpus as C
from ..operators import export as E
from ..operators import findings as N
from ..operators import patterns as P
from ..operators import review as R
from ..operators import taint as T
from ..operators import unicode_chars as U
from ..sources import packages as S
from .corpus_queries import CANDIDATES_SQL, CUTOFF, DOWNLOADS, EVERY, _candidates, _findings, _packages
from .pattern_queries import RUNS
from .planted import CHARS_SQL, LINES_SQL, PLANTED_SQL, files, planted, with_views
from .taint_queries import _VIEWS as FLOW_VIEWS
from .taint_queries import _planted_facts
from .unicode_queries import BIDI_SQL, HOMOGLYPH_SQL, INVISIBLE_SQL, TAG_SQL

_KEY = ["path", "line", "column", "code_point", "category", "severity"]


def _characters(s, d):
    return scan_characters(files(s, d), ("invisible", "homoglyph", "bidi", "tags"))


def _case(pairs: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in pairs.items()) + " END"


_NAMED = "printf('U+%04X', code_point)"
_BIDI, _ZERO = _case(BIDI_NAMES, "code_point"), _case(ZERO_WIDTH_NAMES, "code_point")
_DANGER = _case({c: f": {U.BIDI_DANGER[n]}" for c, n in BIDI_NAMES.items() if n in U.BIDI_DANGER}, "code_point")
_SCRIPT, _LETTER = _case({c: s for c, _, s, _ in CONFUSABLES}, "code_point"), _case({c: b for c, b, _, _ in CONFUSABLES}, "code_point")
#: Every character finding with its description.
DESCRIBED = f"""{with_views(PLANTED_SQL, LINES_SQL, CHARS_SQL)}, {INVISIBLE_SQL}, {HOMOGLYPH_SQL}, {BIDI_SQL}, {TAG_SQL},
described AS (
  SELECT path, line, "column", code_point, 'invisible_character' AS category, severity, context, 0 AS emit_seq, CASE WHEN {_BIDI} IS NOT NULL THEN 'Bidirectional control ' || {_BIDI} WHEN {_ZERO} IS NOT NULL THEN 'Zero-width character ' || {_ZERO}
    WHEN code_point BETWEEN 65024 AND 65039 OR code_point BETWEEN 917760 AND 917999 THEN 'Variation selector' ELSE 'Invisible character' END || ' (' || {_NAMED} || ')' AS description FROM invisible
  UNION ALL SELECT path, line, "column", code_point, 'homoglyph', severity, context, 1, 'Identifier ''' || context || ''' mixes scripts: ' || {_NAMED} || ' (' || {_SCRIPT} || ') looks like ''' || {_LETTER} || '''' FROM homoglyph
  UNION ALL SELECT path, line, "column", code_point, 'bidirectional_override', severity, context, 2, 'Bidirectional control ' || {_BIDI} || ' (' || {_NAMED} || ')' || coalesce({_DANGER}, '') FROM bidi
  UNION ALL SELECT path, line, "column", code_point, 'unicode_tag', severity, context, 4, 'Unicode tag character: ' || tag FROM tags
)"""


def payload_contexts(s, d):
    """The text around hidden payloads, which omits the payload itself."""
    return P.stego_runs(files(s, d)).select("path", "line", "column", "context")


def payload_previews(s, d):
    rows = P.content_findings(files(s, d), ("stego_runs", "pipe_stego"))
    p = F.col("decoded_payload")
    return rows.select(
        "path", "line", "column", hex_preview(p["bytes"]).alias("hex"), text_preview(p["decoded_text"], 40).alias("text"), F.size(E.payload_box(p)).cast("long").alias("box_lines"), F.get(E.payload_box(p), 0).alias("box"),
    )


def class_descriptions(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL")
    kind = payload_class(F.octet_length("text"), text_entropy(F.col("text")), F.is_valid_utf8("text"))
    return docs.select(N.lookup(CLASS_DESCRIPTIONS, kind).alias("description")).groupBy("description").agg(F.count(F.lit(1)).alias("n"))


def confusable_letters(s, d):
    """Look-alikes found, with how many other characters look like the same letter."""
    others = {b: len(U.confusables_of(b)) for _, b, _, _ in CONFUSABLES}
    rows = U.homoglyphs(files(s, d)).withColumn("base", N.lookup({c: b for c, b, _, _ in CONFUSABLES}, F.col("code_point").cast("int")))
    return rows.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.max(N.lookup(others, F.col("base"))).cast("long").alias("known"))


def single_family_scans(s, d):
    """Each family of the character scanner on its own."""
    out = None
    for name in FAMILIES:
        rows = scan_characters(files(s, d), (name,)).groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn("family", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def prompt_rules(s, d):
    """Rules as review prompts name them; other categories are UNKNOWN_<category>."""
    return _findings(s, d).groupBy(N.rule_id(F.col("category"), prompt=True).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def sensitivity_levels(s, d):
    """Priorities of orders read as sensitivity levels."""
    word = F.regexp_extract("o_orderpriority", "[A-Z]+$", 0)
    return s.read.parquet(f"{d}/orders.parquet").groupBy(N.sensitivity(word).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def cut_contents(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL")
    cut = R.cut_content(F.col("text"), 2000)
    return docs.select("doc_id", F.length(cut).cast("long").alias("n_chars"), F.md5(cut.cast("binary")).alias("digest"))


def verdict_answers(s, d):
    """Chat answers made of conversation turns, fenced in three ways, parsed to verdicts."""
    c = s.read.parquet(f"{d}/conversations.parquet").where("text IS NOT NULL")
    body = F.to_json(F.struct((F.col("turn") % 2 == 0).alias("is_malicious"), (F.col("turn") / 8).alias("confidence"), F.col("text").alias("reasoning"), F.when(F.col("turn") % 3 == 0, "low").alias("reclassified_severity")))
    fenced = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("```\n"), body, F.lit("\n```\n"))).otherwise(F.concat(F.lit("  "), body, F.lit("\n")))
    response = F.to_json(F.struct(F.array(F.struct(F.struct(fenced.alias("content")).alias("message"))).alias("choices")))
    return c.select("conv_id", "turn", R.parsed_verdict(response).alias("v")).select("conv_id", "turn", "v.is_malicious", "v.confidence", F.md5(F.col("v.reasoning").cast("binary")).alias("digest"), "v.reclassified_severity")


def _verdicts(s, d):
    """A verdict on every third planted file, and on files that were not scanned."""
    docs = s.read.parquet(f"{d}/documents.parquet").where("doc_id % 3 = 0")
    path = F.expr("CASE WHEN doc_id % 2 = 0 THEN concat('pkg/', source, '/doc', CAST(doc_id AS STRING), '.js') ELSE concat('gone/', CAST(doc_id AS STRING)) END")
    verdict = F.struct(F.lit(True).alias("is_malicious"), (F.col("doc_id") % 10 / 10).alias("confidence"), F.lit("r").alias("reasoning"), F.lit(None).cast("string").alias("reclassified_severity"))
    return docs.select(path.alias("path"), verdict.alias("verdict"))


def verdict_join(s, d):
    told = C.with_verdicts(_findings(s, d), C.verdicts_on(files(s, d), _verdicts(s, d)))
    return told.groupBy("triage_status", "llm_confidence").agg(F.count(F.lit(1)).alias("n"))


def verdicts_scanned(s, d):
    return C.verdicts_on(files(s, d), _verdicts(s, d)).select("path", "verdict.confidence")


def json_summary(s, d):
    return E.json_summary(_findings(s, d), files(s, d))


def json_round_trip(s, d):
    """Findings written as JSON lines and read back as records."""
    back = E.findings_from_json(E.json_rows(_findings(s, d)))
    return back.select("file_path", "line", "column", "category", "severity", F.get_json_object("decoded_payload", "$.byte_count").cast("long").alias("byte_count"))


def sarif_documents(s, d):
    """SARIF results, read field by field."""
    at = "$.locations[0].physicalLocation"
    field = lambda p: F.get_json_object("json", p)
    return E.sarif_results(_characters(s, d)).select(
        field(f"{at}.artifactLocation.uri").alias("uri"), field(f"{at}.region.startLine").cast("long").alias("line"), field(f"{at}.region.startColumn").cast("long").alias("column"), field("$.ruleId").alias("rule"),
        field("$.level").alias("level"), field("$.message.text").alias("message"), field(f"{at}.region.snippet.text").alias("snippet"),
    )


def review_prompts(s, d):
    """Prompts on all files with character findings: one per file, its findings as a sorted set."""
    made = R.prompts(files(s, d), _characters(s, d))
    return made.select("path", F.md5(F.col("prompt").cast("binary")).alias("digest"), F.length("prompt").cast("long").alias("n_chars"))


def report_max_severity(s, d):
    return _findings(s, d).groupBy("package", "version").agg(C.report_severity(F.col("severity")).alias("reported"), C.report_severity(F.col("severity"), True).alias("greatest"))


def severity_ratio(s, d):
    return N.severity_ratio(_findings(s, d), ("package",))


def print_sorted(s, d):
    rows = _findings(s, d)
    return N.numbered(rows, ("path",), [*E.print_order(rows), F.col("category"), F.col("code_point")]).select(*_KEY, "nth")


def severity_sorted(s, d):
    """A package's findings by severity as text, greatest first, then by place."""
    order = [N.severity_key(), *(F.col(c) for c in ("path", "line", "column", "emit_seq", "category", "code_point"))]
    return N.numbered(_findings(s, d), ("package", "version"), order).select("package", "version", *_KEY, "nth")


def category_order(s, d):
    ranked = C.category_order(_findings(s, d))
    return ranked.withColumn("nth", F.row_number().over(Window.orderBy(F.col("n").desc(), "category")))


def severity_display(s, d):
    return C.severity_display(_findings(s, d))


def _runs(s, d):
    """Users' days of events as runs, and the events as scanned packages."""
    e = s.read.parquet(f"{d}/events.parquet").withColumn("id", F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")))
    runs = e.groupBy("id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at")).withColumns({"packages_total": F.lit(0), "packages_flagged": F.lit(0)})
    return runs, e.select(F.col("id").alias("scan_run_id"), F.when(F.col("value") > 50, 1).otherwise(0).alias("finding_count"))


def run_counters(s, d):
    return C.run_counters(_runs(s, d)[1])


def finished_runs(s, d):
    runs, packages = _runs(s, d)
    rows = C.finished_runs(runs, packages)
    newest = F.row_number().over(Window.partitionBy(F.substring_index("id", "/", 1)).orderBy(F.col("started_at").desc()))
    seconds = F.expr("extract(DAY FROM duration) * 86400 + extract(HOUR FROM duration) * 3600 + extract(MINUTE FROM duration) * 60 + extract(SECOND FROM duration)").cast("double")
    return rows.select("id", "packages_total", "packages_flagged", F.round(seconds, 3).alias("seconds"), newest.alias("nth"))


def top_install_scripts(s, d):
    found = C.package_rollup(_packages(s, d), _findings(s, d)).withColumn("has_install_scripts", F.col("n_files") % 2 == 0)
    return C.top_install_scripts(found).select("package", "version", "finding_count")


def tier1_limited(s, d):
    return S.tier1(_candidates(s, d), F.lit(CUTOFF).cast("timestamp"), DOWNLOADS, most=50).select("seq", "name")


def taint_sources(s, d):
    facts = _planted_facts(s, d)
    rows = T.taint_sources(facts, T.resolved(facts))
    return rows.select("path", "source_id", "kind", "assigned_to", "span_start", "span_end", "scope_id", F.col("key_value").isNotNull().alias("has_hardcoded_key"))


def taint_sinks(s, d):
    return T.taint_sinks(_planted_facts(s, d)).select("path", "call_seq", "sink", "scope_id")


def sources_in_scope(s, d):
    """Scopes with a high-entropy literal in themselves or around them."""
    facts = _planted_facts(s, d)
    rows = T.taint_sources(facts, T.resolved(facts)).where("kind = 'high_entropy'")
    return T.source_in_scope(facts, rows, facts["scopes"].select("path", "scope_id"))


QUERIES = {
    "character_descriptions": lambda s, d: _characters(s, d).select("path", "line", "column", "category", "description"),
    "display_lines": lambda s, d: _characters(s, d).select("path", "emit_seq", N.display(_characters(s, d)).alias("text")),
    "payload_contexts": payload_contexts, "payload_previews": payload_previews, "class_descriptions": class_descriptions, "confusable_letters": confusable_letters,
    "single_family_scans": single_family_scans, "prompt_rules": prompt_rules, "sensitivity_levels": sensitivity_levels, "cut_contents": cut_contents, "verdict_answers": verdict_answers,
    "verdict_join": verdict_join, "verdicts_scanned": verdicts_scanned, "json_summary": json_summary, "json_round_trip": json_round_trip, "sarif_documents": sarif_documents, "review_prompts": review_prompts,
    "report_max_severity": report_max_severity, "severity_ratio": severity_ratio, "print_sorted": print_sorted, "severity_sorted": severity_sorted, "category_order": category_order,
    "severity_display": severity_display, "run_counters": run_counters, "finished_runs": finished_runs, "top_install_scripts": top_install_scripts, "tier1_limited": tier1_limited,
    "taint_sources": taint_sources, "taint_sinks": taint_sinks, "sources_in_scope": sources_in_scope,
}

_ORDERED = '"column", code_point, category, severity'
_RULES = " ".join(f"WHEN '{c}' THEN '{r}'" for c, r in RULE_IDS.items())
_RUN = "concat(user_id, '/', strftime(ts, '%Y-%m-%d'))"
_PATHS = "CASE WHEN doc_id % 2 = 0 THEN concat('pkg/', source, '/doc', doc_id, '.js') ELSE concat('gone/', doc_id) END"
_REPORT_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE -1 END"
_BOX = "CASE WHEN decoded_text <> '' THEN string_split(CASE WHEN strlen(decoded_text) > 512 THEN left(decoded_text, 512) ELSE decoded_text END, chr(10))[1:15] ELSE [hex] END"
_AROUND = """CASE WHEN start > 100 THEN '...' ELSE '' END || substr(content, CAST(greatest(start - 100, 0) + 1 AS BIGINT), CAST(least(start, 100) AS BIGINT)) || substr(content, CAST(start + n + 1 AS BIGINT), 100)
  || CASE WHEN start + n + 100 < len(content) THEN '...' ELSE '' END"""
ORACLES = {
    "character_descriptions": f'{DESCRIBED} SELECT path, line, "column", category, description FROM described',
    "display_lines": f"""{DESCRIBED} SELECT path, emit_seq, printf('[%s] %s:%d:%d - U+%04X (%s) - %s', upper(severity), path, line, "column", code_point, category, description) AS text FROM described""",
    "payload_contexts": f'{RUNS} SELECT path, line, "column", {_AROUND} AS context FROM placed WHERE n >= 16',
    "payload_previews": f"""{RUNS}, hexed AS (SELECT path, island, string_agg(lower(printf('%02X', CAST(b AS INTEGER))), ' ' ORDER BY pos) AS hex FROM octets o JOIN (SELECT path, island, min(pos) AS first FROM octets GROUP BY ALL) f USING (path, island) WHERE pos < first + 32 GROUP BY path, island),
shown AS (SELECT p.path, p.start, p.n_bytes, hexed.hex, p.decoded_text FROM payloads p JOIN hexed USING (path, island))
SELECT s.path, line, "column" + CASE k WHEN 'pipe' THEN -1 ELSE 0 END AS "column", hex, CASE WHEN strlen(decoded_text) > 40 THEN left(decoded_text, 40) || '... (' || strlen(decoded_text) || ' bytes total)' ELSE decoded_text END AS text,
  CAST(len({_BOX}) AS BIGINT) AS box_lines, ({_BOX})[1] AS box
FROM shown s JOIN placed ON placed.path = s.path AND placed.start = s.start, (VALUES ('run'), ('pipe')) AS kinds(k) WHERE k = 'run' AND n >= 16 OR k = 'pipe' AND n >= 4 AND substr(content, CAST(placed.start AS BIGINT), 1) = '|'""",
    "class_descriptions": f"""WITH bytes AS (SELECT doc_id, strlen(text) AS size, substr(hex(encode(text)), CAST(2 * i + 1 AS BIGINT), 2) AS b FROM (SELECT *, unnest(range(strlen(text))) AS i FROM documents WHERE text IS NOT NULL)),
scored AS (SELECT doc_id, size, entropy(b) AS e FROM bytes GROUP BY ALL UNION ALL SELECT doc_id, 0, 0 FROM documents WHERE text = ''),
every AS (SELECT CASE WHEN size < 16 THEN 'too_small' WHEN e > 7 THEN 'encrypted_or_compressed' WHEN e >= 6 THEN 'suspicious_data' ELSE 'plaintext_code' END AS c FROM scored)
SELECT {_case(CLASS_DESCRIPTIONS, "c")} AS description, count(*) AS n FROM every GROUP BY 1""",
    "confusable_letters": f"""{with_views(PLANTED_SQL, LINES_SQL, CHARS_SQL)}, {HOMOGLYPH_SQL}, dim(code_point, base) AS (VALUES {", ".join(f"({c}, '{b}')" for c, b, _, _ in CONFUSABLES)})
SELECT base, count(*) AS n, any_value(known) AS known FROM homoglyph JOIN dim USING (code_point) JOIN (SELECT base, count(*) AS known FROM dim GROUP BY base) USING (base) GROUP BY base""",
    "single_family_scans": f"""{EVERY} SELECT category, count(*) AS n, CASE category WHEN 'invisible_character' THEN 'invisible' WHEN 'homoglyph' THEN 'homoglyph' WHEN 'bidirectional_override' THEN 'bidi' WHEN 'unicode_tag' THEN 'tags' ELSE 'stego' END AS family
FROM every WHERE category NOT IN ('encrypted_payload', 'header_c2') GROUP BY category""",
    "prompt_rules": f"{EVERY} SELECT CASE category {_RULES} ELSE 'UNKNOWN_' || category END AS rule, count(*) AS n FROM every GROUP BY 1",
    "sensitivity_levels": "SELECT CASE regexp_extract(o_orderpriority, '[A-Z]+$') WHEN 'CRITICAL' THEN 'critical' WHEN 'HIGH' THEN 'high' WHEN 'MEDIUM' THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM orders GROUP BY 1",
    "cut_contents": """WITH cut AS (SELECT doc_id, CASE WHEN strlen(text) > 2000 THEN left(text, least(2000, len(text)) - 1) || chr(10) || '[truncated]' ELSE text END AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(t) AS n_chars, md5(t) AS digest FROM cut""",
    "verdict_answers": "SELECT conv_id, turn, turn % 2 = 0 AS is_malicious, turn / 8 AS confidence, md5(text) AS digest, CASE WHEN turn % 3 = 0 THEN 'low' END AS reclassified_severity FROM conversations WHERE text IS NOT NULL",
    "verdict_join": f"""{EVERY}, told AS (SELECT {_PATHS} AS path, doc_id % 10 / 10 AS confidence FROM documents WHERE doc_id % 3 = 0)
SELECT CASE WHEN confidence IS NOT NULL THEN 'llm_reviewed' ELSE triage_status END AS triage_status, confidence AS llm_confidence, count(*) AS n FROM found LEFT JOIN told USING (path) GROUP BY 1, 2""",
    "verdicts_scanned": f"SELECT {_PATHS} AS path, doc_id % 10 / 10 AS confidence FROM documents WHERE doc_id % 6 = 0",
    "json_summary": f"{EVERY} SELECT count(*) AS findings_count, (SELECT count(*) FROM documents) AS files_scanned FROM every",
    "json_round_trip": f"""{EVERY} SELECT path AS file_path, line, "column", category, severity, CASE WHEN category IN ('stegano_payload', 'pipe_delimiter_stego') THEN (SELECT max(n) FROM placed WHERE placed.path = every.path) END AS byte_count FROM every""",
    "sarif_documents": f"""{DESCRIBED} SELECT path AS uri, line, "column", CASE category {_RULES} ELSE 'GW003' END AS rule, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, description AS message, context AS snippet FROM described""",
    "review_prompts": f"""{DESCRIBED}, listed AS (SELECT path, string_agg(text, chr(10) ORDER BY text) AS listed FROM (SELECT DISTINCT path, printf('%s line %d: %s (%s)', CASE category {_RULES} ELSE 'UNKNOWN_' || category END, line, description, severity) AS text FROM described) GROUP BY path),
prompts AS (SELECT path, 'Findings:' || chr(10) || listed || chr(10) || chr(10) || 'File:' || chr(10) || CASE WHEN strlen(content) > 50000 THEN left(content, least(50000, len(content)) - 1) || chr(10) || '[truncated]' ELSE content END || chr(10) || chr(10)
  || 'Answer with JSON: {{"is_malicious", "confidence", "reasoning", "reclassified_severity"}}' AS prompt FROM listed JOIN planted USING (path))
SELECT path, md5(prompt) AS digest, len(prompt) AS n_chars FROM prompts""",
    "report_max_severity": f"{EVERY} SELECT package, version, arg_max(severity, {_REPORT_RANK}) AS reported, arg_min(severity, {_REPORT_RANK}) AS greatest FROM found GROUP BY package, version",
    "severity_ratio": f"{EVERY} SELECT package, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (WHERE severity IN ('critical', 'high')) / count(*), 1) AS ratio FROM found GROUP BY package",
    "print_sorted": f"""{EVERY} SELECT path, line, {_ORDERED}, row_number() OVER (PARTITION BY path ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, line, "column", emit_seq, category, code_point) AS nth FROM every""",
    "severity_sorted": f"""{EVERY} SELECT package, version, path, line, {_ORDERED}, row_number() OVER (PARTITION BY package, version ORDER BY severity DESC, path, line, "column", emit_seq, category, code_point) AS nth FROM found""",
    "category_order": f"{EVERY} SELECT category, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, category) AS nth FROM every GROUP BY category",
    "severity_display": f"{EVERY} SELECT severity, count(*) AS n FROM every GROUP BY severity",
    "run_counters": f"SELECT {_RUN} AS scan_run_id, count(*) AS packages_total, count(*) FILTER (WHERE value > 50) AS packages_flagged FROM events GROUP BY 1",
    "finished_runs": f"""SELECT {_RUN} AS id, count(*) AS packages_total, count(*) FILTER (WHERE value > 50) AS packages_flagged, round(epoch(max(ts)) - epoch(min(ts)), 3) AS seconds,
  row_number() OVER (PARTITION BY any_value(user_id) ORDER BY min(ts) DESC) AS nth FROM events GROUP BY 1""",
    "top_install_scripts": f"{EVERY} SELECT package, version, finding_count FROM rollup WHERE finding_count > 0 AND n_files % 2 = 0 ORDER BY finding_count DESC, package, version LIMIT 5",
    "tier1_limited": f"{CANDIDATES_SQL} SELECT seq, name FROM judged WHERE reason IS NULL ORDER BY seq LIMIT 50",
    "taint_sources": f"{FLOW_VIEWS} SELECT path, source_id, kind, sym AS assigned_to, span_start, span_end, scope_id, key_value IS NOT NULL AS has_hardcoded_key FROM src",
    "taint_sinks": f"{FLOW_VIEWS} SELECT path, sink_seq AS call_seq, sink, scope_id FROM snk",
    "sources_in_scope": f"{FLOW_VIEWS} SELECT DISTINCT anc.path, anc.scope_id FROM anc JOIN src0 ON src0.path = anc.path AND src0.scope_id = anc.ancestor WHERE kind = 'high_entropy'",
}
