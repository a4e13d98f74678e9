"""The finding table: how detectors make rows, and what is done with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import DECLARED_RANK, RULE_IDS, SEVERITY_RANK
from ..schemas import FINDING_COLUMNS, PAYLOAD


def literal_map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(literal_map(pairs), key)


def finding_columns(name: str, order: int, /, **fields) -> list[Column]:
    """The columns of a finding: ``fields`` are columns or constants, the rest is null or of that name."""
    defaults = {
        "code_point": F.lit(0).cast("bigint"), "character": F.lit(""), "remediation": F.lit(None).cast("string"), "cwe_id": F.lit(None).cast("string"),
        "references": F.array().cast("array<string>"), "context": F.lit(None).cast("string"), "decoded_payload": F.lit(None).cast(PAYLOAD), "confidence": F.lit(None).cast("double"),
        "detector": F.lit(name), "emit_seq": F.lit(order).cast("bigint"),
    }
    given = {k: v if isinstance(v, Column) else F.lit(v) for k, v in fields.items()}
    columns = {**{c: F.col(c) for c in FINDING_COLUMNS if c not in defaults}, **defaults, **given}
    return [columns[c].alias(c) for c in FINDING_COLUMNS]


def finding(rows: DataFrame, name: str, order: int, /, **fields) -> DataFrame:
    """``rows`` as findings."""
    return rows.select(*finding_columns(name, order, **fields))


def exploded(rows: DataFrame, made: list[tuple[Column, list[Column]]]) -> DataFrame:
    """The findings that ``rows`` make: each of ``made`` (condition, columns) makes one where its condition holds."""
    found = F.array_compact(F.array(*(F.when(condition, F.struct(*columns)) for condition, columns in made)))
    return rows.select(F.explode(found).alias("_f")).select("_f.*")


def severity_rank(severity: Column, fixes: bool = False) -> Column:
    """The declared order, in which info is above critical; with ``fixes`` info is lowest."""
    return F.coalesce(lookup(SEVERITY_RANK if fixes else DECLARED_RANK, severity), F.lit(0))


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """The command line's filter: info counts as low."""
    return findings.where(F.coalesce(lookup(SEVERITY_RANK, F.col("severity")), F.lit(0)) >= SEVERITY_RANK.get(severity, 0))


PLACE = ("line", "column", "emit_seq", "description")


def scanner_key(fixes: bool = False) -> list[Column]:
    """The scanner's order within a file: most severe first, then by place."""
    return [severity_rank(F.col("severity"), fixes).desc(), *(F.col(c) for c in PLACE)]


def engine_key() -> list[Column]:
    """The engine's order within a file: by place, detectors in their order."""
    return [F.col(c) for c in PLACE]


def scanner_order(findings: DataFrame, fixes: bool = False) -> DataFrame:
    """Most severe first, then by place."""
    return findings.orderBy(severity_rank(F.col("severity"), fixes).desc(), "path", *PLACE)


def engine_order(findings: DataFrame) -> DataFrame:
    """By file and place; detectors in their order."""
    return findings.orderBy("path", *engine_key())


def numbered(findings: DataFrame, within: tuple[str, ...], order: list[Column]) -> DataFrame:
    """``findings`` with ``nth``, their place in ``order`` within each group."""
    return findings.withColumn("nth", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))


def severity_key(lexical: bool = True) -> Column:
    """By severity, greatest first: compared as text, as the reproduced queries do, or by rank."""
    return (F.col("severity") if lexical else severity_rank(F.col("severity"), True)).desc()


def sensitivity(text: Column) -> Column:
    """The sensitivity level that a text names; unknown ones are low."""
    return F.when(F.lower(text).isin("critical", "high", "medium"), F.lower(text)).otherwise("low")


def deduplicated(findings: DataFrame, fixes: bool = False) -> DataFrame:
    """The first finding of each (path, line, column, code_point); ``fixes`` adds the category to the key."""
    key = ["path", "line", "column", "code_point", *(["category"] if fixes else [])]
    first = Window.partitionBy(*key).orderBy("emit_seq", "description")
    return findings.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def session_stats(findings: DataFrame) -> DataFrame:
    """One row: files, findings and findings per severity (info counts as low)."""
    count = lambda *s: F.count_if(F.col("severity").isin(*s))
    return findings.agg(
        F.countDistinct("path").alias("total_files"), F.count(F.lit(1)).alias("total_findings"), count("critical").alias("critical_findings"), count("high").alias("high_findings"),
        count("medium").alias("medium_findings"), count("low", "info").alias("low_findings"),
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def rule_id(category: Column, prompt: bool = False) -> Column:
    """The category's rule; others are GW003, or in a review prompt UNKNOWN_<category>."""
    other = F.concat(F.lit("UNKNOWN_"), category) if prompt else F.lit("GW003")
    return F.coalesce(lookup(RULE_IDS, category), other)


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def display(findings: DataFrame) -> Column:
    """One line of text per finding."""
    return F.format_string("[%s] %s:%d:%d - U+%04X (%s) - %s", F.upper("severity"), F.col("path"), F.col("line"), F.col("column"), F.col("code_point"), F.col("category"), F.col("description"))


def severity_ratio(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """How many findings there are, and the share of critical and high ones in per cent to one place."""
    total, hit = F.count(F.lit(1)), F.count_if(F.col("severity").isin("critical", "high"))
    return findings.groupBy(*by).agg(total.alias("n"), F.round(100 * hit / F.nullif(total, F.lit(0)), 1).alias("ratio"))
