"""The engine: registered detectors over files, with layers, filters and sinks."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from .operators import patterns, taint, unicode_chars
from .operators.export import exit_code, json_lines, pretty, sarif_lines, write_report
from .operators.findings import at_least, engine_order
from .operators.review import verdicts
from .schemas import FILES, FINDINGS
from .sources.files import files_from_paths
from .sources.jsfacts import fact_tables, file_facts, rejects

Detector = Callable[[DataFrame], DataFrame]
SemanticDetector = Callable[[DataFrame, dict], DataFrame]


_STEGO = ("stego_runs", "pipe_stego", "decoder_functions", "indicators")


def stego_family(files: DataFrame) -> DataFrame:
    """Hidden payloads, their decoders and loader patterns."""
    return patterns.content_findings(files, _STEGO)


#: The five families of the character scanner, in order, and the two whole-file detectors.
FAMILIES: dict[str, Detector] = {
    "invisible": unicode_chars.invisible_characters, "homoglyph": unicode_chars.homoglyphs, "bidi": unicode_chars.bidi_controls, "stego": stego_family, "tags": unicode_chars.tag_characters,
}
WHOLE_FILE: dict[str, Detector] = {"encrypted_payload": patterns.encrypted_payloads, "header_c2": patterns.header_channels}
#: The parts of ``content_findings`` that these detectors are.
_PARTS = {"stego": _STEGO, "encrypted_payload": ("encrypted",), "header_c2": ("channels",)}


def fused(files: DataFrame, detectors: dict[str, Detector], fixes: bool = False) -> list[DataFrame]:
    """What the detectors find: the library's own ones in two passes over the files, each other one in a pass of its own."""
    own = {n for n, d in detectors.items() if d is {**FAMILIES, **WHOLE_FILE}.get(n)}
    families = tuple(n for n in unicode_chars.CHARACTER_CLASSES if n in own)
    parts = tuple(p for n in _PARTS if n in own for p in _PARTS[n])
    found = [unicode_chars.character_findings(files, families, fixes)] if families else []
    found += [patterns.content_findings(files, parts, fixes)] if parts else []
    return found + [d(files) for n, d in detectors.items() if n not in own]


def scan_characters(files: DataFrame, families: tuple[str, ...] = tuple(FAMILIES), fixes: bool = False) -> DataFrame:
    """Findings of the chosen families of the character scanner."""
    return functools.reduce(DataFrame.unionByName, fused(files, {f: FAMILIES[f] for f in families}, fixes))


def scan_text(spark: SparkSession, content: str, name: str) -> DataFrame:
    return scan_characters(spark.createDataFrame([(name, content)], FILES))


class ThreatEngine:
    """Starts empty; ``default`` has all detectors.  ``scan`` is lazy.

    The library's first-layer detectors read the files twice, others once each.
    With ``cache`` the files are kept on disk by the first that reads them, so
    that a slow source is read once.
    Extracted facts are always kept.  ``release`` lets go of what is kept.
    ``unread`` lists, for the last scan, the programs from which no facts could be
    read: their flows are unknown, not absent.
    """

    def __init__(self, layers: tuple[str, ...] = ("l1", "l2"), fixes: bool = False, cache: bool = False):
        self.layers, self.fixes, self.model, self.cache = layers, fixes, None, cache
        self.cached: list[DataFrame] = []
        self.unread: DataFrame | None = None
        self.unread_count = 0
        self.detectors: dict[str, Detector] = {}
        self.semantic: dict[str, SemanticDetector] = {}

    @classmethod
    def with_config(cls, families: dict[str, bool] | None = None, layers: tuple[str, ...] = ("l1", "l2"), fixes: bool = False, cache: bool = False) -> "ThreatEngine":
        """An engine with the character scanner's families that are not switched off, and nothing else."""
        engine = cls(layers, fixes, cache)
        for name in FAMILIES:
            if (families or {}).get(name, True):
                engine.register(name, FAMILIES[name])
        return engine

    @classmethod
    def default(cls, layers: tuple[str, ...] = ("l1", "l2"), fixes: bool = False, cache: bool = False) -> "ThreatEngine":
        engine = cls(layers, fixes, cache)
        for name, detector in {**FAMILIES, **WHOLE_FILE}.items():
            engine.register(name, detector)
        return engine.register_semantic("flows", functools.partial(taint.semantic_findings, fixes=fixes))

    def register(self, name: str, detector: Detector) -> "ThreatEngine":
        self.detectors[name] = detector
        return self

    def register_semantic(self, name: str, detector: SemanticDetector) -> "ThreatEngine":
        self.semantic[name] = detector
        return self

    def with_review(self, model: Callable[[str], str]) -> "ThreatEngine":
        self.model = model
        return self

    @property
    def detector_count(self) -> int:
        return len(self.detectors) + len(self.semantic)

    def scan(self, files: DataFrame) -> DataFrame:
        """Findings of all layers that are on, unsorted."""
        if self.cache:
            files = files.persist(StorageLevel.DISK_ONLY)
            self.cached.append(files)
        self.unread = None
        parts = fused(files, self.detectors, self.fixes) if "l1" in self.layers else []
        if "l2" in self.layers and self.semantic:
            extracted = file_facts(files).persist(StorageLevel.DISK_ONLY)  # many joins read the facts; they are extracted once
            self.cached.append(extracted)
            self.unread = rejects(extracted)
            facts = fact_tables(extracted)
            parts += [d(files, facts) for d in self.semantic.values()]
        if not parts:
            return files.sparkSession.createDataFrame([], FINDINGS)
        return functools.reduce(DataFrame.unionByName, parts)

    def release(self) -> None:
        while self.cached:
            self.cached.pop().unpersist()

    def scan_with_review(self, files: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        found = self.scan(files)
        return found, verdicts(files, found, self.model) if self.model else None

    def report_paths(self, spark: SparkSession, paths: list[str], output: str = "pretty", severity: str = "low", extensions: list[str] | None = None, excludes: list[str] | None = None, color: bool = False) -> Iterator[str | int]:
        """The report's lines, and last the exit code; findings are kept on disk meanwhile, so that the scan runs once."""
        files = files_from_paths(spark, paths, extensions, excludes)
        found = at_least(self.scan(files), severity).persist(StorageLevel.DISK_ONLY)
        self.cached.append(found)
        try:
            if output == "json":
                yield from json_lines(engine_order(found), files.count(), 0)
            elif output == "sarif":
                yield from sarif_lines(engine_order(found), self.fixes)
            else:
                yield from pretty(found, verdicts(files, found, self.model) if self.model else None, color)
            self.unread_count = self.unread.count() if self.unread is not None else 0
            yield exit_code(found, files)
        finally:
            self.release()

    def write_report_paths(self, spark: SparkSession, paths: list[str], folder: str, output: str = "json", severity: str = "low", extensions: list[str] | None = None, excludes: list[str] | None = None) -> int:
        """Writes the report as a folder of part files, for any number of findings; returns the exit code."""
        files = files_from_paths(spark, paths, extensions, excludes)
        found = at_least(self.scan(files), severity).persist(StorageLevel.DISK_ONLY)
        self.cached.append(found)
        try:
            write_report(found, folder, output, files.count(), 0, self.fixes)
            return exit_code(found, files)
        finally:
            self.release()

    def scan_paths(self, spark: SparkSession, paths: list[str], output: str = "pretty", severity: str = "low", extensions: list[str] | None = None, excludes: list[str] | None = None) -> tuple[str, int]:
        """(text, exit code) of a scan small enough for its report to be held."""
        *lines, code = self.report_paths(spark, paths, output, severity, extensions, excludes)
        return "\n".join(lines), code
