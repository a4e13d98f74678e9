"""The planted corpus: every document becomes a source file, most with something hidden.

The supplied texts hold no hidden characters and no code, so a projection adds
some, by the id's remainder; all documents are read and scanned whole.  The
projection is one SQL text that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.stego import encode_text

PLAIN = encode_text(b"console.log('a hidden payload in plain text')")
DENSE = encode_text(bytes(range(256)))
MIXED = encode_text(bytes(range(40, 140)))
BLOB = "Zm9vYmFyYmF6cXV4MDEyMzQ1Njc4OUFCQ0RFRkdISUpLTE1OT1BRUlNUVVZXWFlaYWJjZGVmZ2hpamtsbW5vcHFyc3R1dnd4eXo="

DECODER = ["const d = (s) => [...s].map(c => { const p = c.codePointAt(0); return p >= 0xFE00 ? p - 0xFE00 : p - 0xE0100; })", ".filter(c => c !== null);", "eval(String.fromCharCode(d(x)));"]
LOADER = [f'const blob = "{BLOB}";', "const f = new Function(atob(blob));", "f();"]
CHANNEL = [
    "https.get(url, (res) => {",
    '  const k = res.headers["x-key"];',
    '  const d = crypto.createDecipheriv("aes", k, iv);',
    '  eval(d.update(body, "hex", "utf8"));',
    "});",
]
XOR_CHANNEL = [
    "const r = await fetch(u);",
    'const h = r.headers.get("x-data");',
    "let o = 0;",
    "const n = h.charCodeAt(o) ^ 42;",
    "out += String.fromCharCode(n);",
    "new Function(out)();",
]


def _code(lines: list[str]) -> str:
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in ["", *lines])


#: The planted content by ``plant``, the id's remainder.
CONTENT = f"""
  CASE plant
    WHEN 0 THEN substr(text, 1, 5) || '\u200b' || substr(text, 6)
    WHEN 1 THEN text || chr(10) || 'var hidden = "' || CASE doc_id % 3 WHEN 0 THEN '{PLAIN}' WHEN 1 THEN '{DENSE}' ELSE '{MIXED}' END || '";'
    WHEN 2 THEN text || ' |' || substr('{PLAIN}', 1, CAST(4 + doc_id % 9 AS INT)) || ' end'
    WHEN 3 THEN substr(text, 1, 3) || '\u202e' || substr(text, 4) || '\u2066x\u200f'
    WHEN 4 THEN substr(text, 1, 4) || '\U000e0041' || substr(text, 5) || '\U000e0001\U000e007f'
    WHEN 5 THEN text || chr(10) || 'const p\u0430ssword = l\u03bfgin;' || chr(10) || '  // p\u0430y' || chr(10) || 'let \u0441\u043e\u043e\u0431 = \u03b1lpha + b\u03b9t;'
    WHEN 6 THEN text || chr(10) || '\u2600\ufe0f sun \U0001f600\u200d and \ufffd'
    WHEN 7 THEN text || {_code(DECODER)}
    WHEN 8 THEN text || {_code(LOADER)}
    WHEN 9 THEN text || CASE WHEN doc_id % 2 = 0 THEN {_code(CHANNEL)} ELSE {_code(XOR_CHANNEL)} END
    ELSE text
  END"""
BASE = [
    "doc_id", "coalesce(text, '') AS text", "doc_id % 11 AS plant", "concat('pkg/', source, '/doc', CAST(doc_id AS VARCHAR(20)), '.js') AS path", "source AS package", "lang AS version",
]
PLANT = f"SELECT doc_id, path, package, version, plant, {CONTENT} AS content FROM (SELECT {', '.join(BASE)} FROM documents) AS base"


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, package, version, plant, content) of every document."""
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(*BASE)
    return base.selectExpr("doc_id", "path", "package", "version", "plant", f"{CONTENT} AS content")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir).select("path", "content")


#: The oracle's views: planted files, their lines and characters.
PLANTED_SQL = f"planted AS ({PLANT})"
LINES_SQL = r"""
raw AS (SELECT path, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS line, len(string_split(content, chr(10))) AS n FROM planted),
lines AS (SELECT path, CAST(line AS BIGINT) AS line, CASE WHEN line < n AND suffix(raw, chr(13)) THEN left(raw, len(raw) - 1) ELSE raw END AS text FROM raw WHERE line < n OR raw <> '')"""
CHARS_SQL = r"""
cells AS (SELECT path, line, text, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS col FROM lines WHERE text <> ''),
chars AS (
  SELECT path, line, text, CAST(col AS BIGINT) AS "column", ch, CAST(unicode(ch) AS BIGINT) AS cp,
         unicode(CASE WHEN col > 1 THEN substr(text, col - 1, 1) END) AS before, unicode(CASE WHEN col < len(text) THEN substr(text, col + 1, 1) END) AS after
  FROM (SELECT * FROM cells WHERE regexp_matches(ch, '[^\x00-\x{24F}]'))
)"""


def with_views(*views: str) -> str:
    return "WITH " + ",".join(views)
