"""Explicit schemas of the library's tables."""

from __future__ import annotations

PAYLOAD = "struct<bytes: binary, entropy: double, is_valid_utf8: boolean, decoded_text: string, payload_class: string, codepoint_count: bigint>"
FILES = "path string, content string"
FINDINGS = (
    "path string, line bigint, column bigint, code_point bigint, character string, category string, severity string, description string, remediation string, "
    f"cwe_id string, references array<string>, context string, decoded_payload {PAYLOAD}, confidence double, detector string, emit_seq bigint"
)
FINDING_COLUMNS = [part.split()[0] for part in FINDINGS.replace(PAYLOAD, "payload").split(", ")]

SCOPES = "path string, scope_id int, parent_id int, scope_path array<int>"
PLACED = "span_start int, span_end int, scope_id int, place int, at_line int, assigned_to int"
STRING_LITERALS = f"path string, lit_seq int, value string, entropy double, {PLACED}"
CALL_SITES = f"path string, call_seq int, callee string, callee_chain array<string>, {PLACED}"
CALL_ARGS = "path string, call_seq int, arg_idx int, arg_start int, arg_end int, first_lit int"
DECLARATIONS = "path string, symbol_id int, name string, kind string, init_start int, init_end int, scope_id int, node_seq int, first_lit int"
REFERENCES = "path string, ref_seq int, name string, span_start int, span_end int, scope_id int, node_seq int, in_args array<struct<call_seq: int, arg_idx: int>>, in_inits array<int>"

SCAN_RUNS = "id string, started_at timestamp, finished_at timestamp, filter_params string, packages_total bigint, packages_flagged bigint, engine_version string, notes string, status string"
COMMITS = "scan_run_id string, batch string, committed_at timestamp, packages_total bigint, packages_flagged bigint"
PACKAGES = (
    "id bigint, name string, version string, published_at timestamp, author string, downloads_weekly bigint, has_install_scripts boolean, tarball_url string, "
    "tarball_sha256 string, scanned_at timestamp, scan_run_id string, finding_count bigint, scan_duration_ms bigint"
)
CORPUS_FINDINGS = (
    "package string, version string, file_path string, line bigint, column bigint, rule_id string, category string, severity string, message string, confidence double, "
    "decoded_payload string, triage_status string, llm_verdict string, llm_confidence double, scan_run_id string, emit_seq bigint, file string"
)
CORPUS_VERDICTS = "file string, llm_verdict string, llm_confidence double, given_at timestamp, scan_run_id string"
VERDICT = "is_malicious boolean, confidence double, reasoning string, reclassified_severity string"
