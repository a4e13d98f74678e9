"""Command lines: python -m threatlake.cli PATH..., and python -m threatlake.cli corpus run|rescan|report|stats|close|vacuum."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import ThreatEngine
from .operators.review import chat_client, config_from_env


def _model(wanted: bool):
    """The review client that the environment configures; None, with a warning, if it does not."""
    found = config_from_env() if wanted else None
    if wanted and not found:
        print("review is not configured, going on without", file=sys.stderr)
    return chat_client(**found) if found else None


def corpus_main(argv: list[str]) -> int:
    """Batch runs over package archives: run, rescan, report, stats; close ends a dead run, vacuum deletes what was not committed."""
    from .runs import Corpus
    from .sources.files import archive_members
    from .sources.packages import candidates, tier1

    parser = argparse.ArgumentParser(prog="threatlake corpus")
    parser.add_argument("action", choices=["run", "rescan", "report", "stats", "close", "vacuum"])
    parser.add_argument("root")
    parser.add_argument("--archives", help="folder of gzipped tar archives named package-version.tgz")
    parser.add_argument("--run", help="id of the run to scan again or to report on")
    parser.add_argument("--metadata", help="JSON lines with the registry's metadata and downloads_weekly of each package; only those of the tier are scanned")
    parser.add_argument("--tier", type=int, choices=[1], default=1)
    parser.add_argument("--days-back", type=int, default=30, help="how many days ago a package may have been published")
    parser.add_argument("--download-threshold", type=int, default=1000, help="weekly downloads from which a package is too popular")
    parser.add_argument("--max-packages", type=int)
    parser.add_argument("--batches", type=int, default=1, help="parts of the packages that are scanned and committed one after another")
    parser.add_argument("--vault", action="store_true", help="keep the files of flagged packages")
    parser.add_argument("--resume", action="store_true", help="leave out packages that were scanned before")
    parser.add_argument("--llm", action="store_true")
    parser.add_argument("--save", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("threatlake").getOrCreate()
    corpus = Corpus(spark, args.root)
    if args.action == "stats":
        for r in corpus.statistics().orderBy("metric", F.col("n").desc(), "key").collect():
            print(r["metric"], r["key"], r["n"])
        return 0
    if args.action == "report":
        print(corpus.report(args.run, args.save))
        return 0
    if args.action == "close":
        corpus.close(args.run)
        return 0
    if args.action == "vacuum":
        print("\n".join(corpus.vacuum()))
        return 0
    key, params, metadata = ["package", "version"], {}, None
    model = _model(args.llm)
    if args.action == "rescan" and not args.archives:
        run_id = corpus.rescan(args.run, model=model)
        print("\n".join(corpus.summary(run_id)))
        return 0
    archives = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tgz").load(args.archives)

    def named(rows, path):
        base = F.regexp_extract(path, r"([^/]+)\.tgz$", 1)
        return rows.withColumns({"package": F.regexp_extract(base, r"^(.*?)(?:-(\d[^/]*))?$", 1), "version": F.regexp_extract(base, r"-(\d[^/]*)$", 1)})

    archives = named(archives, "path")
    if args.metadata:
        told = spark.read.text(args.metadata).select(F.get_json_object("value", "$.metadata").alias("json"), F.get_json_object("value", "$.downloads_weekly").cast("long").alias("downloads_weekly"))
        chosen = tier1(candidates(told), F.current_timestamp() - F.make_interval(days=F.lit(args.days_back)), args.download_threshold, order="name", most=args.max_packages)
        metadata = chosen.withColumnRenamed("name", "package").select(*key, "tarball_url", "published_at", "author", "downloads_weekly", "has_install_scripts")
        archives = archives.join(metadata.select(*key), key, "left_semi")
        params = {"days_back": args.days_back, "download_threshold": args.download_threshold, "tier": args.tier}
    if args.resume:
        archives = corpus.unscanned(archives)
    if args.max_packages and not args.metadata:
        archives = archives.join(archives.select(*key).distinct().orderBy(*key).limit(args.max_packages), key, "left_semi")
    files = lambda some: named(archive_members(some), "archive").select(*key, "path", "content", "sha256")
    if args.action == "rescan":
        run_id = corpus.rescan(args.run, files(archives), model=model)
    else:
        # a batch unpacks its own archives only
        with corpus.open_run(json.dumps(params)) as run:
            for k in range(args.batches):
                run.add(files(archives.where(F.pmod(F.xxhash64(*key), F.lit(args.batches)) == k)), metadata, model)
        run_id = run.id
        if args.vault:
            corpus.vault(run_id, files(archives).drop("sha256"))
    print("\n".join(corpus.summary(run_id)))
    return 0


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["corpus"]:
        return corpus_main(argv[1:])
    parser = argparse.ArgumentParser(prog="threatlake")
    parser.add_argument("paths", nargs="+")
    parser.add_argument("-f", "--format", choices=["pretty", "json", "sarif"], default="pretty")
    parser.add_argument("-s", "--severity", choices=["info", "low", "medium", "high", "critical"], default="low")
    parser.add_argument("-q", "--quiet", action="store_true")
    parser.add_argument("-o", "--output", help="new folder for a JSON or SARIF report that executors write as part files")
    parser.add_argument("--no-color", action="store_true")
    parser.add_argument("--extensions")
    parser.add_argument("--exclude")
    parser.add_argument("--layers", default="l1,l2")
    parser.add_argument("--llm", action="store_true", help="review files with findings by the configured chat service")
    args = parser.parse_args(argv)
    listed = lambda text: text.split(",") if text else None
    spark = SparkSession.builder.appName("threatlake").getOrCreate()
    engine = ThreatEngine.default(tuple(args.layers.split(",")))
    if model := _model(args.llm):
        engine.with_review(model)
    if args.output:
        return engine.write_report_paths(spark, args.paths, args.output, "sarif" if args.format == "sarif" else "json", args.severity, listed(args.extensions), listed(args.exclude))
    color = sys.stdout.isatty() and not args.no_color and "NO_COLOR" not in os.environ
    for line in engine.report_paths(spark, args.paths, args.format, args.severity, listed(args.extensions), listed(args.exclude), color):
        if isinstance(line, int):
            if engine.unread_count:
                print(f"{engine.unread_count} programs could not be read; flows in them are unknown", file=sys.stderr)
            return line
        if not args.quiet:
            print(line)
    return 2


if __name__ == "__main__":
    sys.exit(main())
