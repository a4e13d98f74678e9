"""Queries of the payload and code-pattern detectors, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.stego import entropies, payload_class, text_entropy
from ..functions.text import lines
from ..operators import patterns as P
from .planted import LINES_SQL, PLANTED_SQL, files, planted, with_views

#: Islands of carriers over the whole content, by position less row number.
RUNS_SQL = """
points AS (SELECT path, content, unnest(string_split(content, '')) AS ch, generate_subscripts(string_split(content, ''), 1) - 1 AS pos FROM planted),
carriers AS (SELECT path, content, pos, unicode(ch) AS cp FROM points WHERE unicode(ch) BETWEEN 65024 AND 65039 OR unicode(ch) BETWEEN 917760 AND 917999),
islands AS (SELECT *, pos - row_number() OVER (PARTITION BY path ORDER BY pos) AS island FROM carriers),
runs AS (SELECT path, any_value(content) AS content, min(pos) AS start, count(*) AS n FROM islands GROUP BY path, island),
placed AS (SELECT *, len(left(content, start)) - len(replace(left(content, start), chr(10), '')) + 1 AS line, start - coalesce(nullif(len(left(content, start)) - instr(reverse(left(content, start)), chr(10)) + 1, len(left(content, start)) + 1), 0) + 1 AS "column" FROM runs),
octets AS (SELECT path, island, pos, CASE WHEN cp < 65536 THEN cp - 65024 ELSE cp - 917760 + 16 END AS b FROM islands),
hist AS (SELECT path, island, b, count(*) AS c, sum(count(*)) OVER (PARTITION BY path, island) AS n FROM octets GROUP BY path, island, b),
entropy AS (SELECT path, island, round(-sum(c / n * log2(c / n)), 6) + 0.0 AS entropy FROM hist GROUP BY path, island),
decoded AS (
  SELECT path, island, min(pos) AS start, count(*) AS n_bytes, max(b) < 128 AS ascii, CASE WHEN max(b) < 128 THEN string_agg(chr(CAST(b AS INTEGER)), '' ORDER BY pos) END AS decoded_text
  FROM octets GROUP BY path, island
),
payloads AS (
  SELECT decoded.*, entropy, CASE WHEN n_bytes < 16 THEN 'too_small' WHEN entropy > 7 THEN 'encrypted_or_compressed' WHEN entropy >= 6 THEN 'suspicious_data' WHEN ascii THEN 'plaintext_code' ELSE 'suspicious_data' END AS payload_class
  FROM decoded JOIN entropy USING (path, island)
)"""
RUNS = with_views(PLANTED_SQL, RUNS_SQL)
LINES = with_views(PLANTED_SQL, LINES_SQL)


def _column(pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"CASE WHEN regexp_matches(text, '{quoted}') THEN CAST(strlen(regexp_extract(text, '^((?s:.)*?)(?:{quoted})', 1)) + 1 AS BIGINT) END"


def _has(col: str, patterns) -> str:
    joined = "|".join(f"(?:{p})" for p in patterns).replace("'", "''")
    return f"regexp_matches({col}, '{joined}')"


LISTED = [(k, p) for k, ps in (("decoder_pattern", X.DECODER_PATTERNS), ("eval_pattern", X.EVAL_PATTERNS), ("encoding_pattern", X.ENCODING_PATTERNS)) for p in ps]
INDICATORS_SQL = "hits AS (" + " UNION ALL ".join(f"""SELECT path, line, text, {_column(p)} AS "column", '{k}' AS kind, {i} AS pattern_no FROM lines""" for i, (k, p) in enumerate(LISTED)) + """),
indicators AS (SELECT *, count(*) OVER (PARTITION BY path) AS n FROM hits WHERE "column" IS NOT NULL),
sure AS (SELECT *, CASE WHEN n = 2 THEN 'medium' WHEN n = 3 THEN 'high' ELSE 'critical' END AS severity FROM indicators WHERE n >= 2)"""
DECODER_SQL = f"""decoders AS (SELECT path, line, text, coalesce({", ".join(_column(p) for p in X.SELECTOR_CONSTANTS)}) AS "column" FROM lines WHERE contains(text, 'codePointAt')),
decoder_lines AS (SELECT * FROM decoders WHERE "column" IS NOT NULL)"""
ENTROPY_OF = "(SELECT entropy(substr(hex(encode(x)), CAST(2 * i + 1 AS BIGINT), 2)) FROM (SELECT unnest(range(strlen(x))) AS i))"
BLOB_SQL = f"""literals AS (
  SELECT path, line, text, {_has("text", X.EXEC_PATTERNS)} AS runs, regexp_matches(text, '{X.HEX_RUN}') AS hex_run, regexp_matches(text, '{X.BASE64_RUN}') AS base64_run,
    regexp_extract_all(text, '{X.BASE64_RUN}') AS blobs,
    coalesce(nullif(regexp_extract(text, '{X.QUOTED_LITERAL.replace("'", "''")}', 1) || regexp_extract(text, '{X.QUOTED_LITERAL.replace("'", "''")}', 2), ''), nullif(regexp_extract(text, '{X.TEMPLATE_LITERAL}', 1), '')) AS literal
  FROM lines
),
strings AS (SELECT path, line, unnest(list_append(blobs, literal)) AS x, generate_subscripts(list_append(blobs, literal), 1) = len(blobs) + 1 AS is_literal FROM literals WHERE len(blobs) > 0 OR literal IS NOT NULL),
bytes AS (SELECT path, line, x, is_literal, substr(hex(encode(x)), CAST(2 * i + 1 AS BIGINT), 2) AS b FROM (SELECT *, unnest(range(strlen(x))) AS i FROM strings WHERE x IS NOT NULL)),
scored AS (SELECT path, line, is_literal, x, entropy(b) > 4.5 AS dense FROM bytes GROUP BY path, line, is_literal, x),
blob_lines AS (SELECT path, line, bool_or(dense AND is_literal) AS dense_literal, bool_or(dense) AS dense FROM scored GROUP BY path, line),
encrypted AS (
  SELECT l.path, coalesce(min(l.line) FILTER (WHERE hex_run), min(l.line) FILTER (WHERE base64_run), min(l.line) FILTER (WHERE dense_literal), 1) AS line
  FROM literals l LEFT JOIN blob_lines b ON l.path = b.path AND l.line = b.line GROUP BY l.path HAVING coalesce(bool_or(dense), false) AND bool_or(runs)
)"""
XOR_SQL = """near AS (
  SELECT path, line, contains(text, 'charCodeAt') AND contains(text, '^') AND bool_or(contains(text, 'String.fromCharCode')) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
    OR contains(text, 'String.fromCharCode') AND contains(text, '^') AND bool_or(contains(text, 'charCodeAt')) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS x FROM lines
),
xors AS (SELECT path, bool_or(x) AS x FROM near GROUP BY path)"""
CHANNEL_SQL = f"""{XOR_SQL},
channels AS (
  SELECT path, coalesce((SELECT min(line) FROM lines WHERE lines.path = planted.path AND {_has("text", X.HEADER_PATTERNS)}), 1) AS line FROM planted JOIN xors USING (path)
  WHERE {_has("content", X.CLIENT_PATTERNS)} AND {_has("content", X.HEADER_PATTERNS)} AND {_has("content", X.C2_EXEC_PATTERNS)} AND ({_has("content", X.DECRYPT_PATTERNS)} OR x)
)"""


def document_entropy(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    found = entropies(docs, ["doc_id"], F.coalesce("text", F.lit("")).cast("binary"))
    return found.select("doc_id", (F.round("entropy", 6) + 0.0).alias("entropy"))


def byte_histogram(spark, d):
    """The corpus's byte counts: exploded per document, combined before the shuffle."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    pairs = F.regexp_extract_all(F.hex(F.col("text").cast("binary")), F.lit("(..)"), F.lit(1))
    return docs.select("lang", F.explode(pairs).alias("byte")).groupBy("lang", "byte").agg(F.count(F.lit(1)).alias("n"))


def payload_entropy_class(spark, d):
    """Every document's text as a payload: class by size, entropy and encoding."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL")
    size, entropy = F.octet_length("text"), text_entropy(F.col("text"))
    return docs.select("lang", payload_class(size, entropy, F.lit(True)).alias("payload_class"), size.alias("size")).groupBy("lang", "payload_class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("n_bytes")
    )


def _payload(rows):
    return rows.select(
        "path", "line", "column", F.col("decoded_payload.codepoint_count").alias("n"), (F.round("decoded_payload.entropy", 6) + 0.0).alias("entropy"),
        F.col("decoded_payload.is_valid_utf8").alias("is_valid_utf8"), F.col("decoded_payload.decoded_text").alias("decoded_text"), F.col("decoded_payload.payload_class").alias("payload_class"),
    )


def rc4_kinds(spark, d):
    kinds = planted(spark, d).select("path", P.rc4_indicators(F.col("content")).alias("kinds"))
    return kinds.select("path", F.size("kinds").cast("long").alias("n"), F.array_join("kinds", ", ").alias("kinds"))


def page_inline_scripts(spark, d):
    """Pages as files: lines and indicators of their inline scripts."""
    pages = spark.read.parquet(f"{d}/pages.parquet")
    scripts = pages.select(F.col("url").alias("path"), F.explode(F.regexp_extract_all("html", F.lit("(?is)<script[^>]*>(.*?)</script>"), F.lit(1))).alias("content"))
    rows = lines(scripts)
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).cast("long").alias("n_chars"))


def xor_files(spark, d):
    return planted(spark, d).select("path", F.coalesce(P.xor_proximity(F.col("content")), F.lit(False)).alias("x"))


QUERIES = {
    "vs_runs": lambda s, d: P.carrier_runs(files(s, d), 1).select("path", F.col("start").cast("long").alias("start"), "n"),
    "stego_payloads": lambda s, d: _payload(P.stego_runs(files(s, d))),
    "pipe_stego": lambda s, d: _payload(P.pipe_stego(files(s, d))),
    "payload_entropy_class": payload_entropy_class,
    "document_entropy": document_entropy,
    "byte_histogram": byte_histogram,
    "decoder_functions": lambda s, d: P.decoder_functions(files(s, d)).select("path", "line", "column", "context"),
    "indicator_cooccurrence": lambda s, d: P.indicator_findings(files(s, d)).select("path", "line", "column", "severity", "context"),
    "indicator_counts": lambda s, d: P.indicators(files(s, d)).groupBy("kind", "pattern_no").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("path").alias("n_files")),
    "encrypted_payload": lambda s, d: P.encrypted_payloads(files(s, d)).select("path", "line", "severity"),
    "header_c2": lambda s, d: P.header_channels(files(s, d)).select("path", "line", "severity"),
    "xor_proximity": xor_files,
    "rc4_indicators": rc4_kinds,
    "page_inline_scripts": page_inline_scripts,
}

_PAYLOAD = "n_bytes AS n, entropy, ascii AS is_valid_utf8, decoded_text, payload_class"
ORACLES = {
    "vs_runs": f"{RUNS} SELECT path, start, n FROM runs",
    "stego_payloads": f"""{RUNS} SELECT placed.path, line, "column", {_PAYLOAD} FROM placed JOIN payloads p ON placed.path = p.path AND placed.start = p.start WHERE n >= 16""",
    "pipe_stego": f"""{RUNS} SELECT placed.path, line, "column" - 1 AS "column", {_PAYLOAD} FROM placed JOIN payloads p ON placed.path = p.path AND placed.start = p.start
WHERE n >= 4 AND substr(content, CAST(placed.start AS BIGINT), 1) = '|'""",
    "payload_entropy_class": """WITH bytes AS (SELECT doc_id, lang, strlen(text) AS size, substr(hex(encode(text)), CAST(2 * i + 1 AS BIGINT), 2) AS b FROM (SELECT *, unnest(range(strlen(text))) AS i FROM documents WHERE text IS NOT NULL)),
scored AS (SELECT doc_id, lang, size, entropy(b) AS e FROM bytes GROUP BY ALL),
every AS (SELECT lang, size, CASE WHEN size < 16 THEN 'too_small' WHEN e > 7 THEN 'encrypted_or_compressed' WHEN e >= 6 THEN 'suspicious_data' ELSE 'plaintext_code' END AS payload_class FROM scored)
SELECT lang, payload_class, count(*) AS n, CAST(sum(size) AS BIGINT) AS n_bytes FROM every GROUP BY lang, payload_class""",
    "document_entropy": """WITH bytes AS (SELECT doc_id, substr(hex(encode(text)), CAST(2 * i + 1 AS BIGINT), 2) AS b FROM (SELECT *, unnest(range(strlen(text))) AS i FROM documents))
SELECT doc_id, round(coalesce(e, 0), 6) AS entropy FROM documents LEFT JOIN (SELECT doc_id, entropy(b) AS e FROM bytes GROUP BY doc_id) USING (doc_id)""",
    "byte_histogram": """SELECT lang, substr(hex(encode(text)), CAST(2 * i + 1 AS BIGINT), 2) AS byte, count(*) AS n FROM (SELECT *, unnest(range(strlen(text))) AS i FROM documents) GROUP BY 1, 2""",
    "decoder_functions": f"""{LINES}, {DECODER_SQL} SELECT path, line, "column", CASE WHEN strlen(text) > 200 THEN left(text, 200) || '...' ELSE text END AS context FROM decoder_lines""",
    "indicator_cooccurrence": f"""{LINES}, {INDICATORS_SQL} SELECT path, line, "column", severity, text AS context FROM sure""",
    "indicator_counts": f"{LINES}, {INDICATORS_SQL} SELECT kind, pattern_no, count(*) AS hits, count(DISTINCT path) AS n_files FROM indicators GROUP BY kind, pattern_no",
    "encrypted_payload": f"{LINES}, {BLOB_SQL} SELECT path, line, 'high' AS severity FROM encrypted",
    "header_c2": f"{LINES}, {CHANNEL_SQL} SELECT path, line, 'critical' AS severity FROM channels",
    "xor_proximity": f"{LINES}, {XOR_SQL} SELECT path, coalesce(x, false) AS x FROM planted LEFT JOIN xors USING (path)",
    "rc4_indicators": f"""{with_views(PLANTED_SQL)}, kinds AS (SELECT path, list_filter([{", ".join(f"CASE WHEN {_has('content', [p])} THEN '{k}' END" for k, p in X.RC4_PATTERNS.items())}], lambda k: k IS NOT NULL) AS kinds FROM planted)
SELECT path, CAST(len(kinds) AS BIGINT) AS n, coalesce(array_to_string(kinds, ', '), '') AS kinds FROM kinds""",
    "page_inline_scripts": r"""WITH scripts AS (SELECT url AS path, unnest(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1)) AS content FROM pages),
parts AS (SELECT path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS k, len(string_split(content, chr(10))) AS n FROM scripts)
SELECT path, count(*) AS n_lines, CAST(sum(len(text)) AS BIGINT) AS n_chars FROM parts WHERE k < n OR text <> '' GROUP BY path""",
}
