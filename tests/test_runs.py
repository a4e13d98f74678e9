"""Batch runs that are killed, cancelled or broken off, what readers see meanwhile, and what they read."""

import io
import json
import subprocess
import sys
import tarfile
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from threatlake import cli
from threatlake.engine import ThreatEngine
from threatlake.runs import Corpus, OpenRun

FILES = [("p", "1", "a.js", "x​ eval(atob(y))"), ("p", "1", "b.js", "fine"), ("q", "2", "a.js", "fine"), ("r", "1", "c.js", "‮")]
SCHEMA = "package string, version string, path string, content string"

KILLED = """
import os, sys
from pyspark.sql import SparkSession
from threatlake.runs import Corpus
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
files = spark.createDataFrame({files!r}, {schema!r})
corpus = Corpus(spark, {root!r})
Corpus._commit = lambda *more: os._exit(9)
corpus.run(files)
"""


@pytest.fixture()
def files(spark):
    return spark.createDataFrame(FILES, SCHEMA)


@pytest.fixture()
def corpus(spark, tmp_path):
    return Corpus(spark, f"file://{tmp_path}/corpus")


def test_a_killed_run_leaves_nothing_to_see(files, corpus):
    code = KILLED.format(files=FILES, schema=SCHEMA, root=corpus.root)
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, timeout=300)
    assert done.returncode == 9, done.stderr[-2000:]
    run = corpus.runs().first()
    assert run.status == "running" and run.finished_at is None
    folder = Path(corpus.root.removeprefix("file://"))
    assert list((folder / "findings").rglob("*.parquet")) and list((folder / "packages").rglob("*.parquet"))
    assert corpus.findings().count() == corpus.findings(run.id).count() == corpus.packages().count() == 0
    assert corpus.unscanned(files).count() == 4
    assert corpus.vacuum() == []  # the run may still go on
    corpus.close(run.id)
    ended = corpus.run_of(run.id).first()
    assert (ended.status, ended.packages_total, ended.packages_flagged) == ("interrupted", 0, 0) and ended.finished_at is not None
    assert len(corpus.vacuum()) == 2 and not list((folder / "findings").rglob("*.parquet"))
    again = corpus.run(files)
    assert corpus.packages(again).count() == 3 and corpus.run_of(again).first().status == "finished"


def test_readers_see_all_of_a_batch_or_nothing(files, corpus, monkeypatch):
    seen = []
    commit = Corpus._commit

    def watched(self, run_id, batch):
        seen.append((self.findings().count(), self.packages().count(), self.findings(run_id).count()))
        commit(self, run_id, batch)
        seen.append((self.findings().count(), self.packages().count(), self.findings(run_id).count()))

    monkeypatch.setattr(Corpus, "_commit", watched)
    corpus.run(files)
    assert seen == [(0, 0, 0), (5, 3, 5)]


def test_a_broken_run_keeps_its_committed_batches(files, corpus, monkeypatch):
    packages = OpenRun._packages

    def broken(self, rows, metadata, found):
        if rows.where("package = 'r'").count():
            raise KeyboardInterrupt
        return packages(self, rows, metadata, found)

    monkeypatch.setattr(OpenRun, "_packages", broken)
    with pytest.raises(KeyboardInterrupt):
        with corpus.open_run() as run:
            run.add(files.where("package = 'p'"))
            run.add(files.where("package <> 'p'"))
    ended = corpus.run_of(run.id).first()
    assert (ended.status, ended.packages_total, ended.packages_flagged) == ("interrupted", 1, 1)
    assert {r.package for r in corpus.packages().collect()} == {"p"} and {r.package for r in corpus.findings().collect()} == {"p"}
    monkeypatch.undo()
    with corpus.open_run(run_id=run.id) as more:
        more.add(corpus.unscanned(files))
    ended = corpus.run_of(run.id).first()
    assert (ended.status, ended.packages_total, ended.packages_flagged) == ("finished", 3, 2) and corpus.findings(run.id).count() == 5


def test_batches_give_what_one_gives(files, corpus):
    one, more = corpus.run(files), corpus.run(files, batches=3)
    rows = lambda r: sorted(map(str, corpus.findings(r).drop("scan_run_id").collect()))
    assert rows(one) == rows(more) and corpus.commits().where(F.col("scan_run_id") == more).count() == 3


def test_cancelled_runs_end_as_interrupted(spark, files, tmp_path):
    def slow(rows):
        def wait(batches):
            for batch in batches:
                time.sleep(60)
                yield batch.iloc[:0]

        from threatlake.schemas import FINDINGS

        return rows.limit(0).mapInPandas(lambda b: b, "path string, content string").select("path").join(rows.mapInPandas(wait, "path string, content string"), "path").selectExpr(
            *(f"cast(null AS {t}) AS {c}" for c, t in ((f.name, f.dataType.simpleString()) for f in spark.createDataFrame([], FINDINGS).schema))
        )

    corpus = Corpus(spark, f"file://{tmp_path}/slow", ThreatEngine().register("slow", slow))
    run = corpus.open_run()
    failed = []

    def work():
        try:
            with run:
                run.add(files)
        except Exception as error:
            failed.append(error)

    thread = threading.Thread(target=work)
    thread.start()
    for _ in range(300):
        time.sleep(0.2)
        if spark.sparkContext.statusTracker().getJobIdsForGroup(run.id):
            break
    corpus.cancel(run.id)
    thread.join(60)
    assert not thread.is_alive() and failed
    ended = corpus.run_of(run.id).first()
    assert (ended.status, ended.packages_total) == ("interrupted", 0) and corpus.findings().count() == 0


def test_one_run_reads_its_partitions_only(files, corpus):
    first, second = corpus.run(files), corpus.run(files.where("package = 'r'"))
    for rows in (corpus.findings(first), corpus.packages(first)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        scan = next(line for line in plan.split("\n") if "FileScan" in line and ("severity" in line or "finding_count" in line))
        assert f"scan_run_id#" in scan and f"= {first}" in scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert corpus.findings(second).count() == 2 and corpus.findings().count() == 5


def test_vault_verdicts_and_updates(spark, files, corpus):
    first = corpus.run(files)
    corpus.vault(first, files.where("package = 'p'"))
    assert {(r.package, r.path) for r in corpus.vaulted(first).collect()} == {("p", "a.js"), ("p", "b.js")}
    assert {(r.package, r.path) for r in corpus.flagged_files(first, files).collect()} == {("p", "a.js"), ("p", "b.js"), ("r", "c.js")}
    again = corpus.rescan(first)
    assert {(r.package, r.finding_count) for r in corpus.packages(again).collect()} == {("p", 3)}
    verdict = spark.createDataFrame([("p@1/a.js", (True, 0.75, "why", None))], "path string, verdict struct<is_malicious: boolean, confidence: double, reasoning: string, reclassified_severity: string>")
    corpus.add_verdicts(first, verdict)
    corpus.add_verdicts(first, verdict.withColumn("verdict", F.col("verdict").withField("confidence", F.lit(0.5))))
    assert {(r.file, r.triage_status, r.llm_confidence) for r in corpus.findings(first).collect()} == {("p@1/a.js", "llm_reviewed", 0.5), ("r@1/c.js", "untriaged", None)}
    assert {r.triage_status for r in corpus.findings(again).collect()} == {"untriaged"}
    corpus.update_packages(first, spark.createDataFrame([("q", "2", 77)], "package string, version string, scan_duration_ms long"))
    assert {(r.package, r.scan_duration_ms, r.finding_count) for r in corpus.packages(first).collect()} == {("p", None, 3), ("q", 77, 0), ("r", None, 2)}
    assert corpus._committed_counts(first) == (3, 2)


def archive(path, body):
    with tarfile.open(path, mode="w:gz") as tar:
        info = tarfile.TarInfo("package/i.js")
        info.size = len(body := body.encode())
        tar.addfile(info, io.BytesIO(body))


def test_command_selects_the_first_tier(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    lines = []
    now = time.strftime("%Y-%m-%dT%H:%M:%SZ")
    for name, when, downloads, scripts in (("good", now, 5, {"postinstall": "x"}), ("old", "2001-01-01T00:00:00Z", 5, {"install": "x"}), ("known", now, 5000, {"install": "x"}), ("plain", now, 5, {}), ("other", now, 7, {"preinstall": "x"})):
        archive(tmp_path / f"in/{name}-1.0.tgz", "x​")
        packed = {"name": name, "dist-tags": {"latest": "1.0"}, "time": {"1.0": when}, "versions": {"1.0": {"scripts": scripts, "dist": {"tarball": f"http://r/{name}.tgz"}}}}
        lines.append(json.dumps({"metadata": packed, "downloads_weekly": downloads}))
    (tmp_path / "meta.jsonl").write_text("\n".join(lines))
    root = f"file://{tmp_path}/corpus"
    command = ["corpus", "run", root, "--archives", str(tmp_path / "in"), "--metadata", str(tmp_path / "meta.jsonl")]
    assert cli.main([*command, "--batches", "2", "--vault"]) == 0
    corpus = Corpus(spark, root)
    rows = {r.package: r for r in corpus.packages().collect()}
    assert set(rows) == {"good", "other"} and rows["good"].tarball_url == "http://r/good.tgz" and rows["other"].downloads_weekly == 7
    import hashlib

    assert rows["good"].tarball_sha256 == hashlib.sha256((tmp_path / "in/good-1.0.tgz").read_bytes()).hexdigest()
    run = corpus.runs().first()
    assert (run.packages_total, run.packages_flagged, run.status) == (2, 2, "finished") and json.loads(run.filter_params) == {"days_back": 30, "download_threshold": 1000, "tier": 1}
    assert cli.main([*command, "--download-threshold", "10000", "--resume", "--max-packages", "9"]) == 0
    assert {r.package for r in corpus.packages().collect()} == {"good", "other", "known"}
    capsys.readouterr()
    assert cli.main(["corpus", "rescan", root, "--run", run.id]) == 0
    assert "Packages scanned: 2" in capsys.readouterr().out
    assert cli.main(["corpus", "vacuum", root]) == 0 and cli.main(["corpus", "close", root, "--run", run.id]) == 0
