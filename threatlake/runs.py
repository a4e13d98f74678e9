"""Batch runs over package files: scan, keep the tables, scan again, report.

Below one root stand the tables packages, findings and verdicts, each a Parquet
folder partitioned by run and batch, and two small logs, scan_runs and commits.
A batch writes its rows into partitions of its own and is then committed by one
row in ``commits``; readers only follow committed batches, so that nobody ever
sees half a batch, and a run that is broken off keeps the batches before.  The
run's last row is written however the run ends, with the counts of what was
committed.  Rows are never changed: an update is a newer batch, and readers take
the newest.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .engine import ThreatEngine
from .operators import corpus as C
from .operators.export import write_text
from .operators.findings import rule_id
from .schemas import COMMITS, CORPUS_FINDINGS, CORPUS_VERDICTS, PACKAGES, SCAN_RUNS

KEY = ["package", "version"]
BATCH = ["scan_run_id", "batch"]
VAULT = "package string, version string, path string, content string"


class OpenRun:
    """One run while it goes on: ``add`` scans files as a batch of their own and commits it.

    A context manager: leaving it writes the run's last row, also when an error
    or an interrupt ends it; its status is then ``interrupted``.
    """

    def __init__(self, corpus: "Corpus", params: str, notes: str | None, run_id: str | None = None):
        self.corpus, self.params, self.notes = corpus, params, notes
        self.id, self.started = run_id or uuid.uuid4().hex, dt.datetime.now()

    def __enter__(self) -> "OpenRun":
        self.corpus._log_run(self, None, "running", (0, 0))
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.corpus.engine.release()
        self.corpus._log_run(self, dt.datetime.now(), "interrupted" if kind else "finished", self.corpus._committed_counts(self.id))

    def add(self, files: DataFrame, metadata: DataFrame | None = None, model=None) -> None:
        """Scans ``files(package, version, path, content)`` and commits their findings and packages together.

        ``files`` may have the column sha256, the hash of the package's archive;
        ``metadata`` has further columns of the packages table by (package, version).
        """
        corpus, batch = self.corpus, uuid.uuid4().hex
        context = corpus.spark.sparkContext
        context.setJobGroup(self.id, f"run {self.id}", interruptOnCancel=True)
        try:
            corpus._write("findings", self.id, batch, self._findings(files, model))
            found = corpus._batch("findings", CORPUS_FINDINGS, self.id, batch)
            corpus._write("packages", self.id, batch, self._packages(files, metadata, found))
            corpus._commit(self.id, batch)
        finally:
            corpus.engine.release()
            context.setLocalProperty("spark.jobGroup.id", None)

    def _findings(self, files: DataFrame, model) -> DataFrame:
        told = files.withColumn("file", F.concat_ws("/", F.concat_ws("@", "package", "version"), "path"))
        scanned = told.select(F.col("file").alias("path"), "content")
        found = self.corpus.engine.scan(scanned)
        placed = found.join(told.select(F.col("file").alias("_f"), *KEY, F.col("path").alias("file_path")), F.col("path") == F.col("_f")).drop("_f")
        rows = placed.select(
            *KEY, "file_path", "line", "column", rule_id(F.col("category")).alias("rule_id"), "category", "severity", F.col("description").alias("message"), "confidence",
            F.when(F.col("decoded_payload").isNotNull(), F.to_json(F.struct(F.octet_length("decoded_payload.bytes").alias("byte_count"), "decoded_payload.entropy", "decoded_payload.payload_class"))).alias("decoded_payload"),
            F.lit("untriaged").alias("triage_status"), F.lit(None).cast("string").alias("llm_verdict"), F.lit(None).cast("double").alias("llm_confidence"), F.lit(self.id).alias("scan_run_id"),
            F.col("emit_seq"), F.col("path").alias("file"),
        )
        if model is not None:
            from .operators.review import verdicts

            rows = C.with_verdicts(rows.drop("llm_verdict", "llm_confidence").withColumnRenamed("file", "path"), C.verdicts_on(scanned, verdicts(scanned, found, model))).withColumnRenamed("path", "file")
        return rows.select(*_names(CORPUS_FINDINGS))

    def _packages(self, files: DataFrame, metadata: DataFrame | None, found: DataFrame) -> DataFrame:
        archive = F.max("sha256") if "sha256" in files.columns else F.lit(None).cast("string")
        listed = files.groupBy(*KEY).agg(archive.alias("tarball_sha256"))
        if metadata is not None:
            listed = listed.join(metadata, KEY, "left")
        counted = C.package_rollup(listed, found).drop("max_severity").withColumns({"scan_run_id": F.lit(self.id), "scanned_at": F.lit(dt.datetime.now()).cast("timestamp")})
        typed = [(part.split()[0], part.split()[1]) for part in PACKAGES.split(", ")]
        counted = counted.withColumnRenamed("package", "name")
        return counted.select(*((F.col(c) if c in counted.columns else F.lit(None)).cast(t).alias(c) for c, t in typed))


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


class Corpus:
    """The tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str, engine: ThreatEngine | None = None):
        self.spark, self.root, self.engine = spark, root.rstrip("/"), engine or ThreatEngine.default()

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema)

    def _log(self, name: str, schema: str, row: tuple) -> None:
        """Adds one row to a log, as one file."""
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def _log_run(self, run: OpenRun, finished: dt.datetime | None, status: str, counts: tuple[int, int]) -> None:
        self._log("scan_runs", SCAN_RUNS, (run.id, run.started, finished, run.params, *counts, __version__, run.notes, status))

    def _partitioned(self, name: str, schema: str) -> DataFrame:
        """All rows of a table, those of uncommitted batches too, with their batch."""
        others = ", ".join(part for part in schema.split(", ") if part.split()[0] != "scan_run_id")
        return self._read(name, f"{others}, scan_run_id string, batch string")

    def _table(self, name: str, schema: str, run_id: str | None = None) -> DataFrame:
        """The committed rows, or those of one run, whose partitions alone are read."""
        commits, rows = self.commits(), self._partitioned(name, schema)
        if run_id is not None:
            commits, rows = commits.where(F.col("scan_run_id") == run_id), rows.where(F.col("scan_run_id") == run_id)
        return rows.join(commits.select(*BATCH), BATCH, "left_semi").select(*_names(schema))

    def _batch(self, name: str, schema: str, run_id: str, batch: str) -> DataFrame:
        rows = self._partitioned(name, schema)
        return rows.where((F.col("scan_run_id") == run_id) & (F.col("batch") == batch)).select(*_names(schema))

    def _write(self, name: str, run_id: str, batch: str, rows: DataFrame) -> None:
        rows.drop("scan_run_id").write.parquet(f"{self.root}/{name}/scan_run_id={run_id}/batch={batch}")

    def _commit(self, run_id: str, batch: str) -> None:
        """From here on readers see the batch: one row, written as one file that appears at once."""
        counts = self._batch("packages", PACKAGES, run_id, batch).agg(F.count(F.lit(1)), F.count_if(F.col("finding_count") > 0)).first()
        self._log("commits", COMMITS, (run_id, batch, dt.datetime.now(), *counts))

    def commits(self) -> DataFrame:
        """(scan_run_id, batch, committed_at, packages_total, packages_flagged)."""
        return self._read("commits", COMMITS)

    def _committed_counts(self, run_id: str) -> tuple[int, int]:
        sums = self.commits().where(F.col("scan_run_id") == run_id).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("packages_total", "packages_flagged"))).first()
        return sums[0], sums[1]

    def runs(self) -> DataFrame:
        """Runs, newest first; of a run's rows the one that ends it counts."""
        newest = C.latest(self._read("scan_runs", SCAN_RUNS).withColumn("_at", F.coalesce("finished_at", "started_at")), ["id"], "_at")
        return newest.drop("_at").orderBy(F.col("started_at").desc())

    def run_of(self, run_id: str) -> DataFrame:
        return self.runs().where(F.col("id") == run_id)

    def packages(self, run_id: str | None = None) -> DataFrame:
        """The newest row of every package and version, of all runs or of one."""
        rows = self._table("packages", PACKAGES, run_id).withColumnRenamed("name", "package")
        return C.latest(rows, KEY, "scanned_at")

    def findings(self, run_id: str | None = None) -> DataFrame:
        """The findings of every package's newest run, or of one run, with the newest verdict on their file."""
        rows = self._table("findings", CORPUS_FINDINGS, run_id)
        if run_id is None:
            rows = rows.join(self.packages().select(*KEY, "scan_run_id"), [*KEY, "scan_run_id"], "left_semi")
        newer = C.latest(self._table("verdicts", CORPUS_VERDICTS, run_id), ["scan_run_id", "file"], "given_at")
        newer = newer.select("scan_run_id", "file", F.col("llm_verdict").alias("_verdict"), F.col("llm_confidence").alias("_sure"))
        joined = rows.join(newer, ["scan_run_id", "file"], "left")
        given = F.col("_verdict").isNotNull()
        changed = {"triage_status": F.when(given, "llm_reviewed").otherwise(F.col("triage_status")), "llm_verdict": F.coalesce("_verdict", "llm_verdict"), "llm_confidence": F.when(given, F.col("_sure")).otherwise(F.col("llm_confidence"))}
        return joined.withColumns(changed).select(*_names(CORPUS_FINDINGS))

    def unscanned(self, files: DataFrame) -> DataFrame:
        """The files of packages that no run has scanned; a run that was broken off goes on with them."""
        return files.join(self.packages().select(*KEY), KEY, "left_anti")

    def open_run(self, params: str = "{}", notes: str | None = None, run_id: str | None = None) -> OpenRun:
        """A run for batches that the caller makes; ``run_id`` goes on with an interrupted one."""
        return OpenRun(self, params, notes, run_id)

    def run(self, files: DataFrame, metadata: DataFrame | None = None, params: str = "{}", notes: str | None = None, model=None, batches: int = 1) -> str:
        """Scans ``files`` as one run and returns its id; with more ``batches`` each part of the packages is committed once it is done."""
        with self.open_run(params, notes) as run:
            part = F.pmod(F.xxhash64(*KEY), F.lit(batches))
            for k in range(batches):
                run.add(files.where(part == k) if batches > 1 else files, metadata, model)
        return run.id

    def cancel(self, run_id: str) -> None:
        """Stops the jobs of a run that another thread of this process runs; the run ends as interrupted."""
        self.spark.sparkContext.cancelJobGroup(run_id)

    def close(self, run_id: str) -> None:
        """Ends a run whose process has died, with the counts of its committed batches."""
        last = self.run_of(run_id).first()
        if last is not None and last["finished_at"] is None:
            counts = self._committed_counts(run_id)
            self._log("scan_runs", SCAN_RUNS, (run_id, last["started_at"], dt.datetime.now(), last["filter_params"], *counts, last["engine_version"], last["notes"], "interrupted"))

    def vacuum(self) -> list[str]:
        """Deletes what ended runs wrote and did not commit, and names the folders."""
        ended = self.runs().where("finished_at IS NOT NULL").select(F.col("id").alias("scan_run_id"))
        jvm, gone = self.spark.sparkContext._jvm, []
        for name, schema in (("findings", CORPUS_FINDINGS), ("packages", PACKAGES), ("verdicts", CORPUS_VERDICTS)):
            stray = self._partitioned(name, schema).select(*BATCH).distinct().join(self.commits(), BATCH, "left_anti").join(ended, "scan_run_id", "left_semi")
            for r in stray.collect():
                path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/scan_run_id={r['scan_run_id']}/batch={r['batch']}")
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
                gone.append(str(path))
        return gone

    def vaulted(self, run_id: str) -> DataFrame:
        """(package, version, path, content) that the vault keeps of a run."""
        return self._read(f"vault/{run_id[:8]}", VAULT)

    def flagged_files(self, run_id: str, files: DataFrame | None = None) -> DataFrame:
        """The files of the packages that a run flagged: from the vault, and from ``files`` for packages that it lacks."""
        kept = self.vaulted(run_id)
        if files is None:
            return kept
        others = C.rescan_files(files, self.packages(run_id))
        missing = others.join(kept.select(*KEY).distinct(), KEY, "left_anti")
        return kept.unionByName(missing, allowMissingColumns=True)

    def rescan(self, run_id: str, files: DataFrame | None = None, **more) -> str:
        """Scans again the packages that a run flagged; without ``files``, what the vault keeps of them."""
        return self.run(self.flagged_files(run_id, files), notes=f"rescan of {run_id}", **more)

    def add_verdicts(self, run_id: str, verdicts: DataFrame) -> None:
        """Keeps verdicts (path, verdict) on a run's files; newer ones replace older ones of the same file."""
        rows = verdicts.select(F.col("path").alias("file"), F.to_json("verdict").alias("llm_verdict"), F.col("verdict.confidence").alias("llm_confidence"), F.lit(dt.datetime.now()).cast("timestamp").alias("given_at"), F.lit(run_id).alias("scan_run_id"))
        batch = uuid.uuid4().hex
        self._write("verdicts", run_id, batch, rows.select(*_names(CORPUS_VERDICTS)))
        self._log("commits", COMMITS, (run_id, batch, dt.datetime.now(), 0, 0))

    def update_packages(self, run_id: str, changes: DataFrame) -> None:
        """Newer rows for packages of a run: the columns of ``changes`` (package, version, …) replace theirs."""
        rows = self.packages(run_id).withColumn("scanned_at", F.lit(dt.datetime.now()).cast("timestamp"))
        named = changes.select(*KEY, *(F.col(c).alias(f"_new_{c}") for c in changes.columns if c not in KEY))
        new = {c: F.col(f"_new_{c}") for c in changes.columns if c not in KEY}
        typed = {part.split()[0]: part.split()[1] for part in PACKAGES.split(", ")}
        joined = rows.join(named, KEY).withColumns(new).withColumnRenamed("package", "name")
        batch = uuid.uuid4().hex
        self._write("packages", run_id, batch, joined.select(*(F.col(c).cast(t).alias(c) for c, t in typed.items())))
        self._log("commits", COMMITS, (run_id, batch, dt.datetime.now(), 0, 0))

    def untriaged(self) -> DataFrame:
        """Findings nobody has looked at, by severity as text, greatest first."""
        return C.untriaged(self.findings(), self.packages().select(*KEY, "finding_count")).orderBy(F.col("severity").desc())

    def statistics(self) -> DataFrame:
        return C.statistics(self.packages(), self.findings())

    def summary(self, run_id: str, n: int = 10) -> list[str]:
        """The console's lines on a run: counts, duration and the packages with most findings."""
        r = C.finished_runs(self.run_of(run_id), self.packages(run_id)).first()
        if r is None:
            return [f"No run {run_id}"]
        out = [f"Run {run_id[:8]}", f"Packages scanned: {r['packages_total'] or 0}", f"Packages flagged: {r['packages_flagged'] or 0}", f"Duration: {r['duration']}"]
        rollup = C.package_rollup(self.packages(run_id).drop("finding_count"), self.findings(run_id))
        return out + [f"  {x['package']}@{x['version']} ({x['finding_count']} findings, {x['max_severity']})" for x in C.top_flagged(rollup, n).collect()]

    def report(self, run_id: str, save: bool = False) -> str:
        """A run's Markdown report; saved below the root as run-<first 8 digits>.md."""
        rollup = C.package_rollup(self.packages(run_id).drop("finding_count"), self.findings(run_id))
        found = self.findings(run_id).withColumnsRenamed({"file_path": "path"}).withColumn("code_point", F.lit(0))
        text = C.report(rollup, found, f"Scan report {run_id[:8]}")
        if save:
            write_text(self.spark, f"{self.root}/reports/run-{run_id[:8]}.md", text)
        return text

    def vault(self, run_id: str, files: DataFrame) -> None:
        """Keeps the files of the packages that a run flagged."""
        C.vault(files, self.packages(run_id), f"{self.root}/vault/{run_id[:8]}")
