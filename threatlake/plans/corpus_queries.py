"""Queries of the finding table, the corpus and the selection, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..engine import ThreatEngine
from ..functions.fixed import CATEGORIES, RULE_IDS
from ..operators import corpus as C
from ..operators import export as E
from ..operators import findings as N
from ..operators import review as R
from ..sources import packages as S
from .pattern_queries import BLOB_SQL, CHANNEL_SQL, DECODER_SQL, INDICATORS_SQL, RUNS_SQL
from .planted import CHARS_SQL, LINES_SQL, PLANTED_SQL, planted, with_views
from .unicode_queries import BIDI_SQL, HOMOGLYPH_SQL, INVISIBLE_SQL, TAG_SQL


def _findings(spark, d):
    """All first-layer findings of the planted corpus, with package and version."""
    files = planted(spark, d)
    found = ThreatEngine.default(("l1",)).scan(files.select("path", "content"))
    return found.join(files.select("path", "package", "version"), "path").withColumn("triage_status", F.when(F.col("line") % 3 == 0, "reviewed").otherwise("untriaged"))


def _packages(spark, d):
    return planted(spark, d).groupBy("package", "version").agg(F.count(F.lit(1)).alias("n_files"))


_PART = """SELECT path, line, "column", {cp} AS code_point, '{category}' AS category, {severity} AS severity, {seq} AS emit_seq FROM {table}"""
EVERY = ", ".join([with_views(PLANTED_SQL, LINES_SQL, CHARS_SQL), INVISIBLE_SQL, HOMOGLYPH_SQL, BIDI_SQL, TAG_SQL, RUNS_SQL, DECODER_SQL, INDICATORS_SQL, BLOB_SQL, CHANNEL_SQL]) + ", every AS (" + " UNION ALL ".join([
    _PART.format(cp="code_point", category="invisible_character", severity="severity", seq=0, table="invisible"),
    _PART.format(cp="code_point", category="homoglyph", severity="severity", seq=1, table="homoglyph"),
    _PART.format(cp="code_point", category="bidirectional_override", severity="severity", seq=2, table="bidi"),
    _PART.format(cp="0", category="stegano_payload", severity="'critical'", seq=3, table="placed WHERE n >= 16"),
    """SELECT path, line, "column" - 1, 0, 'pipe_delimiter_stego', 'critical', 3 FROM placed WHERE n >= 4 AND substr(content, CAST(start AS BIGINT), 1) = '|'""",
    _PART.format(cp="0", category="decoder_function", severity="'high'", seq=3, table="decoder_lines"),
    _PART.format(cp="0", category="glassware_pattern", severity="severity", seq=3, table="sure"),
    _PART.format(cp="code_point", category="unicode_tag", severity="severity", seq=4, table="tags"),
    "SELECT path, line, 1, 0, 'encrypted_payload', 'high', 5 FROM encrypted",
    "SELECT path, line, 1, 0, 'header_c2', 'critical', 6 FROM channels",
]) + """),
found AS (SELECT every.*, package, version, CASE WHEN line % 3 = 0 THEN 'reviewed' ELSE 'untriaged' END AS triage_status FROM every JOIN planted USING (path)),
packages AS (SELECT package, version, count(*) AS n_files FROM planted GROUP BY package, version),
counted AS (SELECT package, version, count(*) AS c, max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS r, max(severity) AS lexical FROM found GROUP BY package, version),
rollup AS (SELECT p.*, coalesce(c, 0) AS finding_count, CASE r WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' END AS max_severity, lexical FROM packages p LEFT JOIN counted USING (package, version))
"""
DECLARED = "CASE severity WHEN 'info' THEN 4 WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
_KEY = ["path", "line", "column", "code_point", "category", "severity"]
_SELECT = 'path, line, "column", code_point, category, severity'


def _rollup(s, d):
    return C.package_rollup(_packages(s, d), _findings(s, d))


def _nth(order):
    def query(s, d):
        rows = _findings(s, d).withColumn("rank", N.severity_rank(F.col("severity")))
        return rows.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy(*(F.col(o[1:]).desc() if o[0] == "-" else F.col(o) for o in order), "emit_seq", "category", "code_point"))).select(*_KEY, "nth")

    return query


def _candidates(s, d):
    """A package per order; names come again, some are scoped."""
    o = s.read.parquet(f"{d}/orders.parquet")
    name = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("@scope/p"), F.col("o_orderkey"))).otherwise(F.concat(F.lit("p"), F.col("o_custkey") * 3 + F.col("o_orderkey") % 3))
    scripts = F.when(F.col("o_orderpriority").startswith("1"), F.array(F.lit("preinstall"))).when(F.col("o_orderpriority").startswith("2"), F.array(F.lit("test"), F.lit("postinstall"))).otherwise(F.array(F.lit("build")))
    rows = o.select(F.col("o_orderkey").alias("seq"), name.alias("name"), scripts.alias("scripts"), F.col("o_orderdate").alias("published_at"), F.floor("o_totalprice").cast("bigint").alias("downloads_weekly"))
    return rows.withColumn("has_install_scripts", F.arrays_overlap("scripts", F.array(*map(F.lit, S.INSTALL_SCRIPTS))))


CUTOFF, DOWNLOADS = "1995-01-01 00:00:00", 200_000
CANDIDATES_SQL = f"""WITH rows AS (
  SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 7 = 0 THEN concat('@scope/p', o_orderkey) ELSE concat('p', o_custkey * 3 + o_orderkey % 3) END AS name, left(o_orderpriority, 1) IN ('1', '2') AS scripted, o_orderdate, CAST(floor(o_totalprice) AS BIGINT) AS downloads FROM orders
),
firsts AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq) = 1),
judged AS (SELECT *, CASE WHEN name LIKE '@%' THEN 'scoped' WHEN NOT scripted THEN 'no_scripts' WHEN o_orderdate < TIMESTAMP '{CUTOFF}' THEN 'too_old' WHEN downloads >= {DOWNLOADS} THEN 'too_popular' END AS reason FROM firsts)"""


def metadata_candidates(s, d):
    """Registry metadata as JSON text, one document per order, read back by the selector."""
    o = s.read.parquet(f"{d}/orders.parquet")
    version = F.concat(F.lit("1."), F.col("o_orderkey") % 10, F.lit(".0"))
    package = F.struct(
        F.concat(F.lit("p"), F.col("o_orderkey")).alias("name"), F.create_map(F.lit("latest"), version).alias("dist-tags"), F.create_map(version, F.unix_timestamp("o_orderdate").cast("string")).alias("time"),
        F.create_map(version, F.struct(F.create_map(F.when(F.col("o_custkey") % 2 == 0, "postinstall").otherwise("test"), F.lit("node x.js")).alias("scripts"), F.struct(F.concat(F.lit("https://example.com/"), F.col("o_orderkey"), F.lit(".tgz")).alias("tarball")).alias("dist"))).alias("versions"),
        F.array(F.struct(F.concat(F.lit("m"), F.col("o_custkey")).alias("name"))).alias("maintainers"),
    )
    rows = S.candidates(o.select(F.to_json(package).alias("json"), F.col("o_custkey").alias("downloads_weekly")))
    return rows.select("name", "version", "tarball_url", F.unix_timestamp("published_at").alias("published"), "author", "has_install_scripts", "downloads_weekly")


def scan_runs(s, d):
    """Event rows as scan records: counters per run, a run being a user's day."""
    e = s.read.parquet(f"{d}/events.parquet")
    rows = e.select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("scan_run_id"), F.when(F.col("value") > 50, 1).otherwise(0).alias("finding_count"), "ts")
    return rows.groupBy("scan_run_id").agg(F.count(F.lit(1)).alias("packages_total"), F.count_if(F.col("finding_count") > 0).alias("packages_flagged"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"))


def latest_packages(s, d):
    """Updates as newer rows: the last event of each user."""
    e = s.read.parquet(f"{d}/events.parquet")
    return C.latest(e.select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


def llm_prompt_rows(s, d):
    files = planted(s, d)
    prompts = R.prompts(files.select("path", "content"), _findings(s, d))
    return prompts.select("path", F.sha2("prompt", 256).alias("digest"), F.length("prompt").cast("long").alias("n_chars"))


def labelled_rate(s, d):
    """Flagged files against the documents' labels."""
    files, found = planted(s, d), _findings(s, d).select("path").distinct()
    labels = s.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    flagged = files.select("doc_id", "path", "plant").join(found.withColumn("hit", F.lit(1)), "path", "left").join(labels, "doc_id")
    hits, total = F.sum(F.coalesce("hit", F.lit(0))), F.count(F.lit(1))
    return flagged.groupBy("quality", (F.col("plant") != 10).alias("planted")).agg(total.alias("total"), hits.alias("flagged"), F.round(100 * hits / total, 1).alias("rate"))


def rule_table(s, d):
    """Category, rule and level of every finding, counted."""
    return E.sarif_rows(_findings(s, d)).groupBy("rule_id", "level").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("n_files"))


def _rules(kind):
    return "CASE category " + " ".join(f"WHEN '{c}' THEN '{RULE_IDS.get(c, 'GW003')}'" for c in CATEGORIES) + " END" if kind == "rule" else ""


QUERIES = {
    "engine_findings": lambda s, d: _findings(s, d).select(*_KEY),
    "severity_filter": lambda s, d: N.severity_counts(N.at_least(_findings(s, d), "high")),
    "engine_sorted": _nth(["line", "column"]),
    "scanner_sorted": _nth(["-rank", "line", "column"]),
    "session_stats": lambda s, d: N.session_stats(_findings(s, d)),
    "sarif_rows": rule_table,
    "json_export": lambda s, d: E.json_rows(_findings(s, d)).select("path", F.get_json_object("json", "$.line").cast("long").alias("line"), F.get_json_object("json", "$.category").alias("category"), F.get_json_object("json", "$.decoded.byte_count").cast("long").alias("byte_count")),
    "package_rollup": lambda s, d: _rollup(s, d).select("package", "version", "n_files", "finding_count", "max_severity"),
    "package_rollup_lexical": lambda s, d: C.package_rollup(_packages(s, d), _findings(s, d), lexical=True).select("package", "version", "max_severity"),
    "untriaged_queue": lambda s, d: C.untriaged(_findings(s, d), _packages(s, d)).groupBy("package", "version", "category").agg(F.count(F.lit(1)).alias("n"), F.max("n_files").alias("n_files")),
    "critical_with_package": lambda s, d: C.critical_findings(_findings(s, d), _packages(s, d)).select("package", "version", "n_files", "path", "line", "column", "category"),
    "corpus_statistics": lambda s, d: C.statistics(_rollup(s, d), _findings(s, d)),
    "detection_rate": lambda s, d: C.detection_rate(_rollup(s, d), ("version",)),
    "labelled_rate": labelled_rate,
    "top_flagged": lambda s, d: C.top_flagged(_rollup(s, d)).select("package", "version", "finding_count"),
    "findings_top10_per_package": lambda s, d: C.first_findings(_findings(s, d), order=("path", "line", "column", "emit_seq", "category", "code_point")).select("package", "version", "path", "line", "column", "category", "nth", "of"),
    "tier1_candidates": lambda s, d: S.tier1(_candidates(s, d), F.lit(CUTOFF).cast("timestamp"), DOWNLOADS).select("seq", "name", "downloads_weekly"),
    "tier1_rejections": lambda s, d: S.rejections(_candidates(s, d), F.lit(CUTOFF).cast("timestamp"), DOWNLOADS),
    "metadata_candidates": metadata_candidates,
    "rescan_semi": lambda s, d: C.rescan_files(planted(s, d), _rollup(s, d)).select("path", "package", "version"),
    "events_scan_runs": scan_runs,
    "latest_packages": latest_packages,
    "llm_prompt_rows": llm_prompt_rows,
}

ORACLES = {
    "engine_findings": f"{EVERY} SELECT {_SELECT} FROM every",
    "severity_filter": f"{EVERY} SELECT severity, count(*) AS n FROM every WHERE severity IN ('high', 'critical') GROUP BY severity",
    "engine_sorted": f"""{EVERY} SELECT {_SELECT}, row_number() OVER (PARTITION BY path ORDER BY line, "column", emit_seq, category, code_point) AS nth FROM every""",
    "scanner_sorted": f"""{EVERY} SELECT {_SELECT}, row_number() OVER (PARTITION BY path ORDER BY {DECLARED} DESC, line, "column", emit_seq, category, code_point) AS nth FROM every""",
    "session_stats": f"""{EVERY} SELECT count(DISTINCT path) AS total_files, count(*) AS total_findings, count(*) FILTER (WHERE severity = 'critical') AS critical_findings, count(*) FILTER (WHERE severity = 'high') AS high_findings,
  count(*) FILTER (WHERE severity = 'medium') AS medium_findings, count(*) FILTER (WHERE severity IN ('low', 'info')) AS low_findings FROM every""",
    "sarif_rows": f"""{EVERY} SELECT {_rules("rule")} AS rule_id, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, count(*) AS n, count(DISTINCT path) AS n_files FROM every GROUP BY 1, 2""",
    "json_export": f"""{EVERY} SELECT path, line, category, CASE WHEN category IN ('stegano_payload', 'pipe_delimiter_stego') THEN (SELECT max(n) FROM placed WHERE placed.path = every.path) END AS byte_count FROM every""",
    "package_rollup": f"{EVERY} SELECT package, version, n_files, finding_count, max_severity FROM rollup",
    "package_rollup_lexical": f"{EVERY} SELECT package, version, lexical AS max_severity FROM rollup",
    "untriaged_queue": f"{EVERY} SELECT package, version, category, count(*) AS n, max(n_files) AS n_files FROM found JOIN packages USING (package, version) WHERE triage_status = 'untriaged' GROUP BY ALL",
    "critical_with_package": f"""{EVERY} SELECT package, version, n_files, path, line, "column", category FROM found JOIN packages USING (package, version) WHERE severity = 'critical'""",
    "corpus_statistics": f"""{EVERY} SELECT 'total_packages' AS metric, '' AS key, count(*) AS n FROM rollup UNION ALL SELECT 'flagged_packages', '', count(*) FROM rollup WHERE finding_count > 0 UNION ALL SELECT 'total_findings', '', count(*) FROM every
UNION ALL SELECT 'by_severity', severity, count(*) FROM every GROUP BY severity UNION ALL SELECT 'by_category', category, count(*) FROM every GROUP BY category""",
    "detection_rate": f"{EVERY} SELECT version, count(*) AS total, count(*) FILTER (WHERE finding_count > 0) AS flagged, round(100.0::DOUBLE * count(*) FILTER (WHERE finding_count > 0) / count(*), 1) AS rate FROM rollup GROUP BY version",
    "labelled_rate": f"""{EVERY} SELECT quality, plant <> 10 AS planted, count(*) AS total, count(f.path) AS flagged, round(100.0::DOUBLE * count(f.path) / count(*), 1) AS rate
FROM planted JOIN labels USING (doc_id) LEFT JOIN (SELECT DISTINCT path FROM every) f USING (path) GROUP BY 1, 2""",
    "top_flagged": f"{EVERY} SELECT package, version, finding_count FROM rollup WHERE finding_count > 0 ORDER BY finding_count DESC, package, version LIMIT 10",
    "findings_top10_per_package": f"""{EVERY} SELECT * FROM (SELECT package, version, path, line, "column", category, row_number() OVER (PARTITION BY package, version ORDER BY path, line, "column", emit_seq, category, code_point) AS nth,
  count(*) OVER (PARTITION BY package, version) AS of FROM found) WHERE nth <= 10""",
    "tier1_candidates": f"{CANDIDATES_SQL} SELECT seq, name, downloads AS downloads_weekly FROM judged WHERE reason IS NULL",
    "tier1_rejections": f"{CANDIDATES_SQL} SELECT coalesce(reason, 'selected') AS reason, count(*) AS n FROM judged GROUP BY 1",
    "metadata_candidates": """SELECT concat('p', o_orderkey) AS name, concat('1.', o_orderkey % 10, '.0') AS version, concat('https://example.com/', o_orderkey, '.tgz') AS tarball_url, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS published,
  concat('m', o_custkey) AS author, o_custkey % 2 = 0 AS has_install_scripts, o_custkey AS downloads_weekly FROM orders""",
    "rescan_semi": f"{EVERY} SELECT path, package, version FROM planted JOIN rollup USING (package, version) WHERE finding_count > 0",
    "events_scan_runs": """SELECT concat(user_id, '/', strftime(ts, '%Y-%m-%d')) AS scan_run_id, count(*) AS packages_total, count(*) FILTER (WHERE value > 50) AS packages_flagged,
  CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds FROM events GROUP BY 1""",
    "latest_packages": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
}
