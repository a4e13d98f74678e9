"""Queries of the character detectors, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import BIDI_NAMES, BIDI_SEVERITY, CONFUSABLES, EMOJI_RANGES, INVISIBLE_RANGES, ZERO_WIDTH_NAMES
from ..functions.text import lines
from ..operators import unicode_chars as U
from ..operators.findings import deduplicated, severity_counts
from .planted import CHARS_SQL, LINES_SQL, PLANTED_SQL, files, with_views


def _any(cp: str, ranges) -> str:
    return "(" + " OR ".join(f"{cp} BETWEEN {a} AND {b}" for a, b in ranges) + ")"


INVISIBLE = _any("cp", [(a, b) for _, a, b, _ in INVISIBLE_RANGES])
CRITICAL = _any("cp", [(a, b) for _, a, b, c in INVISIBLE_RANGES if c])
NAMED = f"cp IN ({', '.join(map(str, [*BIDI_NAMES, *ZERO_WIDTH_NAMES]))})"
EMOJI = f"({' OR '.join(f'coalesce({_any(c, EMOJI_RANGES)}, false)' for c in ('before', 'after'))})"
INVISIBLE_SEVERITY = f"CASE WHEN {CRITICAL} THEN 'critical' WHEN {NAMED} THEN 'high' ELSE 'medium' END"
CONTEXT = """(CASE WHEN "column" - 1 > 20 THEN '...' ELSE '' END || substr(text, greatest("column" - 21, 0) + 1, least("column" + 19, len(text)) - greatest("column" - 21, 0))
  || CASE WHEN "column" + 19 < len(text) THEN '...' ELSE '' END)"""
BIDI_NAME = "CASE cp " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in BIDI_NAMES.items()) + " END"
BIDI_SQL_SEVERITY = "CASE name " + " ".join(f"WHEN '{n}' THEN '{s}'" for n, s in BIDI_SEVERITY.items()) + " ELSE 'medium' END"

VIEWS = with_views(PLANTED_SQL, LINES_SQL, CHARS_SQL)
INVISIBLE_SQL = f"""invisible AS (SELECT path, line, "column", cp AS code_point, {INVISIBLE_SEVERITY} AS severity, {CONTEXT} AS context FROM chars WHERE {INVISIBLE} AND NOT {EMOJI})"""
BIDI_SQL = f"""bidi AS (SELECT path, line, "column", cp AS code_point, {BIDI_SQL_SEVERITY} AS severity, {CONTEXT} AS context
  FROM (SELECT *, {BIDI_NAME} AS name FROM chars) WHERE name IS NOT NULL)"""
TAG_SQL = f"""tags AS (SELECT path, line, "column", cp AS code_point, 'medium' AS severity, {CONTEXT} AS context, CASE WHEN cp = 917505 THEN 'Language Tag' WHEN cp = 917631 THEN 'Cancel Tag'
  WHEN cp BETWEEN 917536 AND 917630 THEN 'Tag: ' || chr(CAST(cp - 917504 AS INTEGER)) ELSE printf('Tag (U+%04X)', cp) END AS tag FROM chars WHERE cp BETWEEN 917504 AND 917631)"""
CONFUSABLE_CODES = ", ".join(str(c) for c, *_ in CONFUSABLES)
HIGH, MEDIUM = ([str(c) for c, _, _, s in CONFUSABLES if s == x] for x in (0.95, 0.9))
HOMOGLYPH_SQL = rf"""homoglyph AS (
  SELECT path, line, "column", cp AS code_point, CASE WHEN cp IN ({", ".join(HIGH)}) THEN 'high' WHEN cp IN ({", ".join(MEDIUM)}) THEN 'medium' ELSE 'critical' END AS severity, id AS context
  FROM (SELECT *, regexp_extract(left(text, "column" - 1), '([\p{{L}}\p{{N}}_]*)$', 1) || ch || regexp_extract(substr(text, "column" + 1), '^([\p{{L}}\p{{N}}_]*)', 1) AS id FROM chars
        WHERE cp IN ({CONFUSABLE_CODES}) AND NOT regexp_matches(text, '^\s*(//|#|/\*|\*|<!--)'))
  WHERE len(id) > 1 AND regexp_matches(id, '[A-Za-z]') AND regexp_matches(id, '[^\p{{Latin}}\p{{Common}}\p{{Inherited}}]'))"""

COLUMNS = ["path", "line", "column", "code_point", "severity", "context"]
SELECT = 'SELECT path, line, "column", code_point, severity, context FROM'
IDENTIFIERS_SQL = r"""identifiers AS (SELECT path, line, unnest(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: strlen(w) > 1)) AS identifier FROM lines)"""


def _identifiers(spark, d):
    return U.identifiers(lines(files(spark, d)))


def mixed_script_identifiers(spark, d):
    words = _identifiers(spark, d).where(F.col("identifier").rlike(U.FOREIGN))
    return words.groupBy("identifier").agg(
        F.count(F.lit(1)).alias("n"), F.max(U.has_mixed_scripts(F.col("identifier"))).alias("mixed"), F.max(U.is_pure_non_latin(F.col("identifier"))).alias("pure_non_latin"),
        F.max(U.is_high_risk(F.col("identifier"))).alias("high_risk"),
    )


def script_inventory(spark, d):
    scripts = _identifiers(spark, d).select(F.array_join(U.scripts_in(F.col("identifier")), ",").alias("scripts"), U.is_pure_latin(F.col("identifier")).alias("ascii"))
    return scripts.groupBy("scripts", "ascii").agg(F.count(F.lit(1)).alias("n"))


def emoji_exempt(spark, d):
    from ..functions.text import beside_emoji, chars

    rows = chars(lines(files(spark, d)), U.INVISIBLE_CLASS).where(beside_emoji())
    return rows.select("path", "line", "column", F.col("cp").alias("code_point"), U.quick_severity(F.col("cp")).alias("severity"))


def dedup_findings(spark, d):
    """Distinct by place and code point: of a bidirectional control seen by two detectors the first stays."""
    f = files(spark, d)
    return deduplicated(U.invisible_characters(f).unionByName(U.bidi_controls(f)).unionByName(U.tag_characters(f))).select("path", "line", "column", "code_point", "category", "severity")


def dimension_join(spark, d):
    """The range lookup as a join: characters against the table of ranges, broadcast for its fixed eight rows."""
    from ..functions.text import chars

    ranges = spark.createDataFrame([(n, a, b) for n, a, b, _ in INVISIBLE_RANGES], "name string, first bigint, last bigint")
    rows = chars(lines(files(spark, d)), U.INVISIBLE_CLASS)
    joined = rows.join(F.broadcast(ranges), F.col("cp").between(F.col("first"), F.col("last")))
    return joined.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("n_files"))


def confusable_join(spark, d):
    """Look-alike characters against their table, by an equi-join with its fixed 31 rows."""
    from ..functions.text import chars

    table = spark.createDataFrame(CONFUSABLES, "code_point bigint, base string, script string, similarity double")
    rows = chars(lines(files(spark, d)), U.CONFUSABLE_CLASS).join(F.broadcast(table), F.col("cp") == F.col("code_point"))
    return rows.groupBy("base", "script", "similarity").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "invisible_findings": lambda s, d: U.invisible_characters(files(s, d)).select(*COLUMNS),
    "invisible_by_severity": lambda s, d: severity_counts(U.invisible_characters(files(s, d))),
    "emoji_context_exempt": emoji_exempt,
    "bidi_findings": lambda s, d: U.bidi_controls(files(s, d)).select(*COLUMNS),
    "tag_findings": lambda s, d: U.tag_characters(files(s, d)).select(*COLUMNS, F.expr("substring(description, 24)").alias("tag")),
    "homoglyph_findings": lambda s, d: U.homoglyphs(files(s, d)).select(*COLUMNS),
    "mixed_script_identifiers": mixed_script_identifiers,
    "script_inventory": script_inventory,
    "quick_check_flags": lambda s, d: U.quick_flags(files(s, d)),
    "dedup_findings": dedup_findings,
    "range_dimension_join": dimension_join,
    "confusable_join": confusable_join,
}

_FOREIGN = r"[^\p{Latin}\p{Common}\p{Inherited}]"
ORACLES = {
    "invisible_findings": f"{VIEWS}, {INVISIBLE_SQL} {SELECT} invisible",
    "invisible_by_severity": f"{VIEWS}, {INVISIBLE_SQL} SELECT severity, count(*) AS n FROM invisible GROUP BY severity",
    "emoji_context_exempt": f"""{VIEWS} SELECT path, line, "column", cp AS code_point, {INVISIBLE_SEVERITY} AS severity FROM chars WHERE {INVISIBLE} AND {EMOJI}""",
    "bidi_findings": f"{VIEWS}, {BIDI_SQL} {SELECT} bidi",
    "tag_findings": f"""{VIEWS}, {TAG_SQL} SELECT path, line, "column", code_point, severity, context, tag FROM tags""",
    "homoglyph_findings": f"{VIEWS}, {HOMOGLYPH_SQL} {SELECT} homoglyph",
    "mixed_script_identifiers": rf"""{with_views(PLANTED_SQL, LINES_SQL)}, {IDENTIFIERS_SQL}
SELECT identifier, count(*) AS n, regexp_matches(identifier, '[A-Za-z]') AS mixed, NOT regexp_matches(identifier, '[A-Za-z]') AS pure_non_latin, regexp_matches(identifier, '[\p{{Cyrillic}}\p{{Greek}}]') AS high_risk
FROM identifiers WHERE regexp_matches(identifier, '{_FOREIGN}') GROUP BY identifier""",
    "script_inventory": rf"""{with_views(PLANTED_SQL, LINES_SQL)}, {IDENTIFIERS_SQL}
SELECT array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(identifier, ''), lambda c: CASE WHEN regexp_matches(c, '\p{{Latin}}') THEN 'Latin'
  WHEN regexp_matches(c, '\p{{Cyrillic}}') THEN 'Cyrillic' WHEN regexp_matches(c, '\p{{Greek}}') THEN 'Greek' WHEN regexp_matches(c, '[\p{{Common}}\p{{Inherited}}]') THEN 'Common' ELSE 'Other' END), lambda s: s <> 'Common'))), ',') AS scripts,
  regexp_full_match(identifier, '[A-Za-z0-9_]*') AS "ascii", count(*) AS n
FROM identifiers GROUP BY 1, 2""",
    "quick_check_flags": rf"""{with_views(PLANTED_SQL)} SELECT path, regexp_matches(content, '[\x{{FE00}}-\x{{FE0F}}\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{E0000}}-\x{{E007F}}]') AS has_invisible,
  regexp_matches(content, '[{"".join(chr(c) for c, *_ in CONFUSABLES)}]') AS has_confusables FROM planted""",
    "dedup_findings": f"""{VIEWS}, {INVISIBLE_SQL}, {BIDI_SQL}, {TAG_SQL},
every AS (SELECT path, line, "column", code_point, 'invisible_character' AS category, severity, 0 AS o FROM invisible UNION ALL SELECT path, line, "column", code_point, 'bidirectional_override', severity, 2 FROM bidi
  UNION ALL SELECT path, line, "column", code_point, 'unicode_tag', severity, 4 FROM tags)
SELECT path, line, "column", code_point, category, severity FROM every QUALIFY row_number() OVER (PARTITION BY path, line, "column", code_point ORDER BY o) = 1""",
    "range_dimension_join": f"""{VIEWS}, ranges(name, a, b) AS (VALUES {", ".join(f"('{n}', {a}, {b})" for n, a, b, _ in INVISIBLE_RANGES)})
SELECT name, count(*) AS n, count(DISTINCT path) AS n_files FROM chars JOIN ranges ON cp BETWEEN a AND b GROUP BY name""",
    "confusable_join": f"""{VIEWS}, confusables(code_point, base, script, similarity) AS (VALUES {", ".join(f"({c}, '{b}', '{s}', {x}::DOUBLE)" for c, b, s, x in CONFUSABLES)})
SELECT base, script, similarity, count(*) AS n FROM chars JOIN confusables ON cp = code_point GROUP BY ALL""",
}
