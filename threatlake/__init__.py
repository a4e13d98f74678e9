"""threatlake: source-code threat analytics as Spark DataFrame queries."""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

#: Public names and the modules that hold them; imported when they are first used.
_EXPORTS = {
    "ThreatEngine": "engine", "scan_characters": "engine", "scan_text": "engine", "FAMILIES": "engine", "Corpus": "runs",
    "files_from_paths": "sources.files", "files_from_table": "sources.files", "archive_members": "sources.files", "unreadable_files": "sources.files",
    "damaged_archives": "sources.files",
    "file_facts": "sources.jsfacts", "fact_tables": "sources.jsfacts", "rejects": "sources.jsfacts",
    "detector": "operators.custom", "register_detector": "operators.custom",
    "taint_flows": "operators.taint", "taint_sources": "operators.taint", "taint_sinks": "operators.taint", "semantic_findings": "operators.taint",
    "at_least": "operators.findings", "deduplicated": "operators.findings", "session_stats": "operators.findings", "severity_rank": "operators.findings", "display": "operators.findings",
    "json_rows": "operators.export", "json_lines": "operators.export", "sarif_rows": "operators.export", "sarif_lines": "operators.export", "pretty": "operators.export", "findings_from_json": "operators.export",
    "decoded_payload": "functions.stego", "encode_text": "functions.stego", "text_entropy": "functions.stego", "payload_class": "functions.stego",
}
__all__ = ["__version__", *_EXPORTS]


def __getattr__(name: str):
    if name in _EXPORTS:
        return getattr(importlib.import_module(f".{_EXPORTS[name]}", __name__), name)
    raise AttributeError(name)
