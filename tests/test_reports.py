"""Reports that executors write: valid documents, whole, in order, and none without its tail."""

import json
from pathlib import Path

import pytest

from threatlake import cli
from threatlake.engine import ThreatEngine
from threatlake.operators import export as E


def document(folder):
    """The folder's files in the order of their names."""
    names = sorted(p for p in Path(folder).iterdir() if not p.name.startswith((".", "_")))
    return json.loads("".join(p.read_text() for p in names))


@pytest.fixture(scope="module")
def found(spark):
    files = spark.range(300).selectExpr("concat('f', lpad(id, 3, '0'), '.js') AS path", "concat('x​ \\n', repeat('‮', cast(id % 3 AS int)), '\"q\" eval(atob(y))') AS content").repartition(5)
    rows = ThreatEngine.default(("l1",)).scan(files).persist()
    yield rows
    rows.unpersist()


def test_json_report(spark, found, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one part
    try:
        n = E.write_report(found, f"{tmp_path}/json", files_scanned=300, duration_ms=7)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    made = document(f"{tmp_path}/json")
    assert n == found.count() == len(made["findings"]) and made["summary"] == {"files_scanned": 300, "findings_count": n, "duration_ms": 7}
    streamed = json.loads("".join(E.json_lines(found.orderBy("path", "line", "column", "emit_seq", "code_point"), 300, 7)))
    assert made == streamed
    assert len([p for p in (tmp_path / "json").iterdir() if p.name.startswith("part-")]) > 1


def test_sarif_report(found, tmp_path):
    n = E.write_report(found, f"{tmp_path}/sarif", "sarif")
    made = document(f"{tmp_path}/sarif")
    assert len(made["runs"][0]["results"]) == n and made == json.loads("".join(E.sarif_lines(found.orderBy("path", "line", "column", "emit_seq", "code_point"))))


def test_empty_reports_and_existing_folders(found, tmp_path):
    assert E.write_report(found.limit(0), f"{tmp_path}/none") == 0
    assert document(f"{tmp_path}/none")["findings"] == []
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        E.write_report(found, f"{tmp_path}/none")


def test_a_report_that_fails_has_no_tail(spark, tmp_path, monkeypatch):
    written = E.write_text

    def broken(session, path, text):
        if path.endswith(E.TAIL):
            raise OSError("lost")
        written(session, path, text)

    monkeypatch.setattr(E, "write_text", broken)
    files = spark.createDataFrame([("a.js", "x​")], "path string, content string")
    with pytest.raises(OSError):
        E.write_report(ThreatEngine.default(("l1",)).scan(files), f"{tmp_path}/cut")
    assert not (tmp_path / "cut" / E.TAIL).exists()


def test_command_writes_a_folder(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.js").write_text("x​")
    assert cli.main([str(tmp_path / "src"), "-f", "sarif", "-o", str(tmp_path / "report")]) == 1
    assert len(document(tmp_path / "report")["runs"][0]["results"]) == 1
