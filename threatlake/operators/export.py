"""Findings as JSON, SARIF and console text."""

from __future__ import annotations

import json
import re
import textwrap
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions.fixed import RULE_IDS
from ..functions.stego import hex_preview, text_preview
from .findings import lookup, rule_id, sarif_level


def json_rows(findings: DataFrame) -> DataFrame:
    """(path, json): one JSON object per finding; null parts are left out."""
    p = F.col("decoded_payload")
    decoded = F.when(p.isNotNull(), F.struct(
        F.octet_length(p["bytes"]).alias("byte_count"), p["entropy"].alias("entropy"), p["payload_class"].alias("payload_class"), hex_preview(p["bytes"]).alias("preview_hex"), text_preview(p["decoded_text"]).alias("preview_text"),
    ))
    return findings.select("path", F.to_json(F.struct(F.col("path").alias("file"), "line", "column", "severity", "category", F.col("description").alias("message"), decoded.alias("decoded"))).alias("json"))


def json_lines(findings: DataFrame, files_scanned: int, duration_ms: int) -> Iterator[str]:
    """The lines of one JSON document: a head, a line per finding, the summary; findings pass through one partition at a time."""
    yield _json_head()
    n = 0
    for row in json_rows(findings).toLocalIterator():
        yield ("," if n else "") + row["json"]
        n += 1
    yield _json_tail(files_scanned, n, duration_ms)


def _json_head() -> str:
    return f'{{"version":"{__version__}","findings":['


def _json_tail(files_scanned: int, n: int, duration_ms: int) -> str:
    return f'],"summary":{{"files_scanned":{files_scanned},"findings_count":{n},"duration_ms":{duration_ms}}}}}'


def json_summary(findings: DataFrame, files: DataFrame) -> DataFrame:
    """One row: the summary's counts."""
    return findings.agg(F.count(F.lit(1)).alias("findings_count")).crossJoin(F.broadcast(files.agg(F.count(F.lit(1)).alias("files_scanned"))))


REPORTED = "file string, line bigint, column bigint, severity string, category string, message string, decoded struct<byte_count: bigint, entropy: double, payload_class: string, preview_hex: string, preview_text: string>"


def findings_from_json(lines: DataFrame, column: str = "json") -> DataFrame:
    """Finding records from lines that each hold one finding, or a whole document with ``findings``; rule and confidence are not in them."""
    one, many = F.from_json(column, REPORTED), F.from_json(F.get_json_object(column, "$.findings"), f"array<struct<{re.sub(r'(^|, )(\w+) ', r'\1\2: ', REPORTED)}>>")
    rows = lines.select(F.explode(F.coalesce(many, F.array(one))).alias("f"))
    return rows.select(
        F.coalesce("f.file", F.lit("")).alias("file_path"), "f.line", "f.column", F.lit(None).cast("string").alias("rule_id"), F.coalesce("f.category", F.lit("")).alias("category"),
        F.coalesce("f.severity", F.lit("low")).alias("severity"), F.coalesce("f.message", F.lit("")).alias("message"), F.lit(None).cast("double").alias("confidence"), F.to_json("f.decoded").alias("decoded_payload"),
    )


def sarif_rows(findings: DataFrame) -> DataFrame:
    """(path, rule_id, level, line, column, message, snippet) per finding."""
    return findings.select("path", rule_id(F.col("category")).alias("rule_id"), sarif_level(F.col("severity")).alias("level"), "line", "column", F.col("description").alias("message"), F.col("context").alias("snippet"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(path, json): one SARIF result per finding."""
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"), F.when(F.col("snippet").isNotNull(), F.struct(F.col("snippet").alias("text"))).alias("snippet"))
    place = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    result = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"))
    return sarif_rows(findings).select("path", F.to_json(result).alias("json"))


def sarif_lines(findings: DataFrame, fixes: bool = False) -> Iterator[str]:
    """The lines of a SARIF 2.1.0 log; rules GW001 to GW004 are defined, with ``fixes`` all."""
    yield _sarif_head(fixes)
    first = True
    for row in sarif_results(findings).toLocalIterator():
        yield ("" if first else ",") + row["json"]
        first = False
    yield _SARIF_TAIL


_SARIF_TAIL = "]}]}"


def _sarif_head(fixes: bool) -> str:
    known = sorted((rule, category) for category, rule in RULE_IDS.items() if fixes or rule <= "GW004")
    driver = {"name": "threatlake", "version": __version__, "rules": [{"id": rule, "name": category} for rule, category in known]}
    return f'{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{json.dumps({"driver": driver})},"results":['


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file in any store that Spark writes to."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


#: Names that stand before and after those of Spark's part files.
HEAD, TAIL = "a-head.json", "z-tail.json"


def write_report(findings: DataFrame, folder: str, kind: str = "json", files_scanned: int = 0, duration_ms: int = 0, fixes: bool = False) -> int:
    """Writes a JSON document or SARIF log as a new folder whose files, in the order of their names, are the document; returns how many findings it has.

    Executors write the findings, sorted by range, with a comma before each but
    the first of all; no finding passes through the driver.  The head is written
    next and the tail last: a folder without its tail is not complete.
    """
    order = [c for c in ("path", "line", "column", "emit_seq", "code_point") if c in findings.columns]
    made = (sarif_results if kind == "sarif" else json_rows)(findings.orderBy(*order))
    # the smallest key is in the first partition, so the first row there is the first of all
    comma = F.when(F.monotonically_increasing_id() == 0, "").otherwise(",")
    seen = Observation()
    rows = made.select(F.concat(comma, F.col("json")).alias("value")).observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(~F.startswith("value", F.lit(","))).alias("firsts"))
    rows.write.text(folder)
    n, firsts = (int(seen.get.get(k) or 0) for k in ("n", "firsts"))
    if firsts != min(n, 1):
        raise RuntimeError(f"{firsts} of {n} findings are the first one; the report in {folder} is not complete")
    spark = findings.sparkSession
    write_text(spark, f"{folder}/{HEAD}", (_sarif_head(fixes) if kind == "sarif" else _json_head()) + "\n")
    write_text(spark, f"{folder}/{TAIL}", _SARIF_TAIL if kind == "sarif" else _json_tail(files_scanned, n, duration_ms))
    return n


#: The order of the console: info prints as low.
PRINT_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 3}


def print_order(findings: DataFrame) -> list[Column]:
    """The columns that order findings as they are printed."""
    return [F.coalesce(lookup(PRINT_RANK, F.col("severity")), F.lit(3)), *(F.col(c) for c in ("path", "line", "column", "emit_seq"))]


def payload_box(payload: Column) -> Column:
    """What is shown of a payload: at most 15 lines of 512 bytes of text, or 32 bytes in hex; null without one."""
    text, data = payload["decoded_text"], payload["bytes"]
    shown = F.when(F.octet_length(text) > 0, F.when(F.octet_length(text) > 512, F.left(text, F.lit(512))).otherwise(text)).otherwise(hex_preview(data))
    return F.when(payload.isNotNull(), F.slice(F.split(shown, "\n", -1), 1, 15))


def pretty(findings: DataFrame, verdicts: DataFrame | None = None, color: bool = False) -> Iterator[str]:
    """Console lines, most severe first, then the counts and the verdicts; the findings are read once, a partition at a time."""
    tint = {"critical": 31, "high": 33, "medium": 36, "low": 2}
    paint = lambda text, severity: f"\x1b[{tint[severity]}m{text}\x1b[0m" if color else text
    rule, last, counts = "=" * 60, None, Counter()
    ordered = findings.orderBy(*print_order(findings)).select("severity", "path", "line", "column", "category", "description", payload_box(F.col("decoded_payload")).alias("box"))
    for r in ordered.toLocalIterator():
        severity = "low" if r["severity"] not in ("critical", "high", "medium") else r["severity"]
        if severity != last:
            yield from (rule, paint(severity.upper(), severity), rule)
            last = severity
        counts[severity] += 1
        yield f"{r['path']}:{r['line']}:{r['column']} [{r['category']}] {r['description']}"
        for line in r["box"] or ():
            yield from (f"    | {x}" for x in textwrap.wrap(line, 72) or [""])
    yield from (rule, ", ".join(f"{s}: {counts[s]}" for s in ("critical", "high", "medium", "low")))
    if verdicts is not None:
        yield from verdict_lines(verdicts)


def verdict_lines(verdicts: DataFrame) -> Iterator[str]:
    """The block of verdicts on files."""
    rule, first = "=" * 60, True
    for r in verdicts.orderBy("path").select("path", "verdict.*").toLocalIterator():
        if first:
            yield from (rule, "Review", rule)
            first = False
        yield f"File: {r['path']}"
        yield f"  Verdict: {'MALICIOUS' if r['is_malicious'] else 'BENIGN'} (confidence: {r['confidence'] or 0:.2f})"
        if r["reclassified_severity"]:
            yield f"  Severity: {r['reclassified_severity']} (reclassified)"
        yield "  Reasoning: " + "\n    ".join(textwrap.wrap(r["reasoning"] or "", 72))


def exit_code(findings: DataFrame, files: DataFrame) -> int:
    """0 without findings, 1 with some, 2 if there was nothing to scan."""
    return 2 if files.isEmpty() else 0 if findings.isEmpty() else 1
