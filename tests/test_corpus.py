"""Corpus tables, exports, sources, review, streaming."""

import io
import json
import tarfile
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from threatlake import cli
from threatlake.engine import ThreatEngine
from threatlake.operators import corpus as C
from threatlake.operators import export as E
from threatlake.operators import review as R
from threatlake.runs import Corpus
from threatlake.sources import packages as S
from threatlake.sources.files import archive_members, damaged_archives, files_from_paths, files_from_table, unreadable_files
from threatlake.streaming.scan import arriving_files, scan_stream, severity_by_window, unseen


@pytest.fixture()
def scanned(spark):
    files = spark.createDataFrame([("a.js", "x​ eval(atob(y))", "p", "1"), ("b.js", "fine", "q", "1"), ("c.js", "‮", "p", "1")], "path string, content string, package string, version string")
    found = ThreatEngine.default().scan(files.select("path", "content")).join(files.select("path", "package", "version"), "path").withColumn("triage_status", F.lit("untriaged"))
    return files, found, C.package_rollup(files.select("package", "version").distinct(), found)


def test_rollup_and_report(scanned):
    files, found, rollup = scanned
    assert {(r.package, r.finding_count, r.max_severity) for r in rollup.collect()} == {("p", 5, "critical"), ("q", 0, None)}
    assert C.package_rollup(files.select("package", "version").distinct(), found, lexical=True).where("package = 'p'").first().max_severity == "medium"
    assert C.detection_rate(rollup).first().rate == 50.0
    assert {r.path for r in C.rescan_files(files, rollup).collect()} == {"a.js", "c.js"}
    text = C.report(rollup, found)
    assert "- Flagged: 1 (50.0%)" in text and "### p 1: 5 findings, at most critical" in text
    assert C.first_findings(found, 2).count() == 2
    assert "N/A" in C.report(rollup.limit(0), found.limit(0))


def test_exports(scanned):
    files, found, _ = scanned
    log = json.loads("".join(E.sarif_lines(found)))
    assert log["version"] == "2.1.0" and len(log["runs"][0]["results"]) == 5 and len(log["runs"][0]["tool"]["driver"]["rules"]) == 4
    doc = json.loads("".join(E.json_lines(found, 3, 5)))
    assert doc["summary"] == {"files_scanned": 3, "findings_count": 5, "duration_ms": 5} and "decoded" not in doc["findings"][0]
    assert "CRITICAL" in "\n".join(E.pretty(found))
    assert (E.exit_code(found, files), E.exit_code(found.limit(0), files), E.exit_code(found.limit(0), files.limit(0))) == (1, 0, 2)


def test_review(scanned):
    files, found, _ = scanned
    answer = json.dumps({"choices": [{"message": {"content": '```json\n{"is_malicious": true, "confidence": 0.9, "reasoning": "r"}\n```'}}]})
    verdicts = R.verdicts(files.select("path", "content"), found, lambda prompt: answer)
    assert {r.path for r in verdicts.collect()} == {"a.js", "c.js"}
    joined = C.with_verdicts(found, verdicts)
    assert {(r.triage_status, r.llm_confidence) for r in joined.collect()} == {("llm_reviewed", 0.9)}

    def broken(prompt):
        raise OSError

    assert R.verdicts(files.select("path", "content"), found, broken).count() == 0
    assert R.config_from_env({}) is None


@pytest.mark.parametrize("text, want", [("```json\n{1}\n```", "{1}"), ("{1}", "{1}"), ("```\n{1}\n```", "{1}")])
def test_fences(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(R.unfenced(F.col("t"))).first()[0] == want


def test_files_and_cli(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.js").write_text("x​")
    (tmp_path / "src/b.bin").write_text("x​")
    (tmp_path / "src/c.js").write_bytes(b"\xff\xfe")
    (tmp_path / "node_modules/d.js").write_text("x​")
    assert [r.path.split("/")[-1] for r in files_from_paths(spark, [str(tmp_path)]).collect()] == ["a.js"]
    assert cli.main([str(tmp_path), "-f", "json", "-s", "high"]) == 1
    shown = capsys.readouterr().out
    assert json.loads(shown[shown.index('{"version"') :])["summary"]["findings_count"] == 1
    assert [(r.path.split("/")[-1], r.reason) for r in unreadable_files(spark, [str(tmp_path)]).collect()] == [("c.js", "not UTF-8")]
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as tar:
        for name, body in (("package/i.js", b"hi"), ("../evil.js", b"no"), ("package/x.bin", b"\xff")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    archives = spark.createDataFrame([("p.tgz", data.getvalue()), ("bad.tgz", b"junk")], "path string, content binary")
    assert [(r.archive, r.path, r.content) for r in archive_members(archives).collect()] == [("p.tgz", "i.js", "hi")]
    assert [r.archive for r in damaged_archives(archives).collect()] == ["bad.tgz"]
    assert files_from_table(spark.range(2), "concat('f', id)", "if(id = 0, 'x', null)").count() == 1


def test_selection(spark):
    rows = spark.createDataFrame(
        [(1, "a", ["postinstall"], datetime(2024, 1, 2), 5), (2, "a", ["postinstall"], datetime(2024, 1, 3), 5), (3, "@s/b", ["install"], datetime(2024, 1, 2), 5), (4, "c", ["test"], datetime(2024, 1, 2), 5),
         (5, "d", ["install"], datetime(2020, 1, 1), 5), (6, "e", ["install"], datetime(2024, 1, 2), 5000), (7, "f", ["preinstall"], datetime(2024, 5, 1), 1)],
        "seq long, name string, scripts array<string>, published_at timestamp, downloads_weekly long",
    ).withColumn("has_install_scripts", F.arrays_overlap("scripts", F.array(*map(F.lit, S.INSTALL_SCRIPTS))))
    cutoff = F.lit("2024-01-01").cast("timestamp")
    assert [r.seq for r in S.tier1(rows, cutoff).orderBy("seq").collect()] == [1, 7]
    assert [r.seq for r in S.tier1(rows, cutoff, most=1).collect()] == [1]
    assert {r.reason: r.n for r in S.rejections(rows, cutoff).collect()} == {"selected": 2, "scoped": 1, "no_scripts": 1, "too_old": 1, "too_popular": 1}


def test_runs(spark):
    runs = spark.createDataFrame([("r1", datetime(2024, 1, 1), datetime(2024, 1, 1, 1)), ("r2", datetime(2024, 1, 2), None)], "id string, started_at timestamp, finished_at timestamp")
    runs = runs.withColumn("packages_total", F.lit(0)).withColumn("packages_flagged", F.lit(0))
    packages = spark.createDataFrame([("r1", 0), ("r1", 3)], "scan_run_id string, finding_count long")
    rows = C.finished_runs(runs, packages).collect()
    assert [(r.id, r.packages_total, r.packages_flagged) for r in rows] == [("r2", None, None), ("r1", 2, 1)] and rows[1].duration.total_seconds() == 3600


def test_batch_run_rescan_and_report(spark, tmp_path):
    files = spark.createDataFrame(
        [("p", "1", "a.js", "x\u200b eval(atob(y))"), ("p", "1", "b.js", "fine"), ("q", "2", "a.js", "fine"), ("r", "1", "c.js", "\u202e")], "package string, version string, path string, content string"
    )
    corpus = Corpus(spark, f"file://{tmp_path}/corpus")
    assert corpus.runs().count() == 0 and corpus.unscanned(files).count() == 4
    metadata = spark.createDataFrame([("p", "1", True, "ann")], "package string, version string, has_install_scripts boolean, author string")
    first = corpus.run(files, metadata)
    assert corpus.unscanned(files).count() == 0
    run = corpus.run_of(first).first()
    assert (run.packages_total, run.packages_flagged) == (3, 2) and run.finished_at >= run.started_at
    assert {(r.package, r.finding_count, r.has_install_scripts, r.author) for r in corpus.packages(first).collect()} == {("p", 3, True, "ann"), ("q", 0, None, None), ("r", 2, None, None)}
    assert {r.file_path for r in corpus.findings(first).collect()} == {"a.js", "c.js"} and corpus.untriaged().count() == 5
    answer = json.dumps({"choices": [{"message": {"content": '{"is_malicious": true, "confidence": 0.9, "reasoning": "r"}'}}]})
    second = corpus.rescan(first, files, model=lambda prompt: answer)
    assert [r.id for r in corpus.runs().collect()] == [second, first]
    assert (corpus.run_of(second).first().packages_total, corpus.packages().count()) == (2, 3)
    assert {r.triage_status for r in corpus.findings(second).collect()} == {"llm_reviewed"} and corpus.untriaged().count() == 0
    assert {(r.metric, r.n) for r in corpus.statistics().where("key = ''").collect()} == {("total_packages", 3), ("flagged_packages", 2), ("total_findings", 5)}
    text = corpus.report(first, save=True)
    assert "- Flagged: 2 (66.7%)" in text and (tmp_path / f"corpus/reports/run-{first[:8]}.md").read_text() == text
    assert corpus.summary(first)[1:3] == ["Packages scanned: 3", "Packages flagged: 2"] and corpus.summary("none") == ["No run none"]
    corpus.vault(first, files)
    assert spark.read.parquet(f"{tmp_path}/corpus/vault/{first[:8]}").count() == 3


def test_batch_command(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    with tarfile.open(tmp_path / "in/left-pad-1.0.tgz", mode="w:gz") as tar:
        info = tarfile.TarInfo("package/i.js")
        info.size = len(body := "x\u200b".encode())
        tar.addfile(info, io.BytesIO(body))
    root = f"file://{tmp_path}/corpus"
    assert cli.main(["corpus", "run", root, "--archives", str(tmp_path / "in")]) == 0
    assert "left-pad@1.0 (1 findings, critical)" in capsys.readouterr().out
    assert cli.main(["corpus", "run", root, "--archives", str(tmp_path / "in"), "--resume"]) == 0
    assert "Packages scanned: 0" in capsys.readouterr().out
    assert cli.main(["corpus", "stats", root]) == 0 and "total_packages" in capsys.readouterr().out


def test_public_names():
    import threatlake

    assert all(getattr(threatlake, name) for name in threatlake.__all__)


def test_engine_families(spark):
    files = spark.createDataFrame([("a.js", "x\u200b \u202e p\u0430ss")], "path string, content string")
    only = ThreatEngine.with_config({"invisible": False, "tags": False})
    assert only.detector_count == 3 and {r.category for r in only.scan(files).collect()} == {"bidirectional_override", "homoglyph"}
    assert ThreatEngine.with_config(dict.fromkeys(("invisible", "homoglyph", "bidi", "stego", "tags"), False)).scan(files).count() == 0


def test_verdict_block(spark):
    rows = spark.createDataFrame([("a.js", (True, 0.5, "word " * 40, "high"))], "path string, verdict struct<is_malicious: boolean, confidence: double, reasoning: string, reclassified_severity: string>")
    lines = list(E.verdict_lines(rows))
    assert lines[3:6] == ["File: a.js", "  Verdict: MALICIOUS (confidence: 0.50)", "  Severity: high (reclassified)"] and all(len(x) < 90 for line in lines for x in line.split("\n"))


def test_streaming(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    row = json.dumps({"path": "a.js", "content": "x​", "arrived": "2024-01-01T00:00:00"})
    (src / "1.json").write_text(row + "\n" + row + "\n")
    query = scan_stream(arriving_files(spark, str(src)), str(out), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(out)).count() == 1
    assert unseen(arriving_files(spark, str(src))).isStreaming and severity_by_window(arriving_files(spark, str(src))).isStreaming


def test_every_core_query_has_rows_and_most_an_oracle():
    from threatlake import plans

    names, oracles = set(plans.queries()), set(plans.oracle_sql())
    assert oracles <= names and names - oracles <= {"llm_prompt_rows"}
    assert set(plans.queries()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["invisible_findings", "homoglyph_findings", "stego_payloads", "encrypted_payload", "header_c2", "direct_flows", "package_rollup", "tier1_candidates"])
def test_queries_against_duckdb(spark, name):
    from threatlake import plans

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "orders", "lineitem", "events", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = plans.queries()[name](spark, sf)
    want = con.execute(plans.oracle_sql()[name]).fetch_df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, got.select(*columns).toPandas().astype(object).where(lambda x: x.notna(), None).values.tolist())) == sorted(map(str, want[columns].astype(object).where(want[columns].notna(), None).values.tolist()))
