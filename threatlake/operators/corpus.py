"""The corpus: packages, findings and runs; rollups, queues, statistics, reports.

Tables are append-only; an update is a newer row, and ``latest`` shows the
newest row of each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import SEVERITY_RANK
from .findings import lookup

RANK = {**SEVERITY_RANK, "low": 1, "medium": 2, "high": 3, "critical": 4}


def latest(table: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The newest row of each key: what updates in place would have left."""
    newest = table.groupBy(*keys).agg(F.max_by(F.struct(*table.columns), by).alias("_row"))
    return newest.select("_row.*")


def package_rollup(packages: DataFrame, findings: DataFrame, key: tuple[str, ...] = ("package", "version"), lexical: bool = False) -> DataFrame:
    """Every package with its number of findings and its greatest severity.

    ``lexical`` compares severities as text, as the reproduced query does; else
    low < medium < high < critical, others below.
    """
    greatest = F.max("severity") if lexical else F.max_by("severity", F.coalesce(lookup(RANK, F.col("severity")), F.lit(0)))
    counted = findings.groupBy(*key).agg(F.count(F.lit(1)).alias("finding_count"), greatest.alias("max_severity"))
    return packages.join(counted, list(key), "left").withColumn("finding_count", F.coalesce("finding_count", F.lit(0)))


def flagged(rollup: DataFrame) -> DataFrame:
    return rollup.where("finding_count > 0")


def untriaged(findings: DataFrame, packages: DataFrame, key: tuple[str, ...] = ("package", "version")) -> DataFrame:
    return findings.where("triage_status = 'untriaged'").join(packages, list(key))


def critical_findings(findings: DataFrame, packages: DataFrame, key: tuple[str, ...] = ("package", "version")) -> DataFrame:
    return findings.where("severity = 'critical'").join(packages, list(key))


def statistics(packages: DataFrame, findings: DataFrame) -> DataFrame:
    """(metric, key, n): packages, flagged packages, findings, and findings by severity and by category."""
    one = lambda df, metric: df.select(F.lit(metric).alias("metric"), F.lit("").alias("key"), "n")
    rows = one(packages.agg(F.count(F.lit(1)).alias("n")), "total_packages")
    rows = rows.unionByName(one(packages.agg(F.count_if(F.col("finding_count") > 0).alias("n")), "flagged_packages"))
    both = findings.groupBy("severity", "category").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.unionByName(one(both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "total_findings"))
    for column in ("severity", "category"):
        rows = rows.unionByName(both.groupBy(F.col(column).alias("key")).agg(F.sum("n").alias("n")).select(F.lit(f"by_{column}").alias("metric"), "key", "n"))
    return rows


def detection_rate(rollup: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Packages, flagged ones and their share in per cent to one place; null without packages."""
    total, hit = F.count(F.lit(1)), F.count_if(F.col("finding_count") > 0)
    return rollup.groupBy(*by).agg(total.alias("total"), hit.alias("flagged"), F.round(100 * hit / F.nullif(total, F.lit(0)), 1).alias("rate"))


def top_flagged(rollup: DataFrame, n: int = 10) -> DataFrame:
    return flagged(rollup).orderBy(F.col("finding_count").desc(), "package", "version").limit(n)


def top_install_scripts(rollup: DataFrame, n: int = 5) -> DataFrame:
    """Flagged packages that run scripts when they are installed, most findings first."""
    return flagged(rollup).where("has_install_scripts").orderBy(F.col("finding_count").desc(), "package", "version").limit(n)


#: The report's list of severities.
REPORT_ORDER = ["critical", "high", "medium", "low", "info"]


def report_severity(severity: Column, fixes: bool = False) -> Column:
    """The severity that a report names for a package, an aggregate.

    The reproduced report takes the greatest place in its list, which begins with
    critical, and so the least severe; ``fixes`` takes the most severe.
    """
    place = F.coalesce(lookup({s: k for k, s in enumerate(REPORT_ORDER)}, severity), F.lit(-1))
    return F.min_by(severity, place) if fixes else F.max_by(severity, place)


def category_order(findings: DataFrame) -> DataFrame:
    """(category, n), most first."""
    return findings.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "category")


def severity_display(findings: DataFrame) -> DataFrame:
    """(severity, n) in the report's order; severities without findings are left out."""
    counted = findings.where(F.col("severity").isin(REPORT_ORDER)).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(lookup({s: k for k, s in enumerate(REPORT_ORDER)}, F.col("severity")))


def first_findings(findings: DataFrame, n: int = 10, key: tuple[str, ...] = ("package", "version"), order: tuple[str, ...] = ("path", "line", "column", "emit_seq", "code_point")) -> DataFrame:
    """The first ``n`` findings of each package, with how many it has in all."""
    within = Window.partitionBy(*key)
    ranked = findings.withColumn("nth", F.row_number().over(within.orderBy(*order))).withColumn("of", F.count(F.lit(1)).over(within))
    return ranked.where(F.col("nth") <= n)


def run_counters(packages: DataFrame, run: str = "scan_run_id") -> DataFrame:
    return packages.groupBy(run).agg(F.count(F.lit(1)).alias("packages_total"), F.count_if(F.col("finding_count") > 0).alias("packages_flagged"))


def finished_runs(runs: DataFrame, packages: DataFrame) -> DataFrame:
    """Runs with their counters and duration, newest first."""
    counted = run_counters(packages).withColumnRenamed("scan_run_id", "id")
    return runs.drop("packages_total", "packages_flagged").join(counted, "id", "left").withColumn("duration", F.col("finished_at") - F.col("started_at")).orderBy(F.col("started_at").desc())


def rescan_files(files: DataFrame, rollup: DataFrame, key: tuple[str, ...] = ("package", "version")) -> DataFrame:
    """The files of the packages that a run flagged."""
    return files.join(flagged(rollup).select(*key), list(key), "left_semi")


def verdicts_on(files: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The verdicts on files that were scanned."""
    return verdicts.join(files.select("path"), "path", "left_semi")


def with_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings with the verdict on their file; reviewed ones leave the untriaged queue."""
    joined = findings.join(verdicts.select("path", F.to_json("verdict").alias("llm_verdict"), F.col("verdict.confidence").alias("llm_confidence")), "path", "left")
    return joined.withColumn("triage_status", F.when(F.col("llm_verdict").isNotNull(), "llm_reviewed").otherwise(F.col("triage_status")))


def vault(files: DataFrame, rollup: DataFrame, path: str, key: tuple[str, ...] = ("package", "version")) -> None:
    """Keeps the files of flagged packages, one folder per package."""
    rescan_files(files, rollup, key).write.mode("overwrite").partitionBy(key[0]).parquet(path)


def report(packages: DataFrame, findings: DataFrame, title: str = "Scan report") -> str:
    """A Markdown report; all figures are aggregates, the driver only lays out a bounded number of rows."""
    stats = {(r["metric"], r["key"]): r["n"] for r in statistics(packages, findings).collect()}
    total, hit = stats[("total_packages", "")], stats[("flagged_packages", "")]
    rate = f"{100 * hit / total:.1f}%" if total else "N/A"
    out = [f"# {title}", "", f"- Packages: {total}", f"- Flagged: {hit} ({rate})", f"- Findings: {stats[('total_findings', '')]}", "", "## By severity", ""]
    out += [f"- {s}: {stats[('by_severity', s)]}" for s in ("critical", "high", "medium", "low", "info") if stats.get(("by_severity", s))]
    out += ["", "## By category", ""]
    out += [f"- {k}: {n}" for (m, k), n in sorted(stats.items(), key=lambda x: (-x[1], x[0][1])) if m == "by_category"]
    top = top_flagged(packages).collect()
    shown = first_findings(findings.join(F.broadcast(packages.sparkSession.createDataFrame([(r["package"], r["version"]) for r in top], "package string, version string")), ["package", "version"])) if top else findings.limit(0)
    lines = {}
    for r in shown.orderBy("package", "version", "nth").collect() if top else []:
        lines.setdefault((r["package"], r["version"]), []).append(r)
    out += ["", "## Flagged packages", ""]
    for r in top:
        out.append(f"### {r['package']} {r['version']}: {r['finding_count']} findings, at most {r['max_severity']}")
        rows = lines.get((r["package"], r["version"]), [])
        out += [f"- [{x['severity']}] {x['path']}:{x['line']}:{x['column']} {x['category']}" for x in rows]
        if rows and rows[0]["of"] > len(rows):
            out.append(f"- and {rows[0]['of'] - len(rows)} more")
        out.append("")
    return "\n".join(out)
