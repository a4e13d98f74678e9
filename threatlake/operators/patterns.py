"""Detectors of hidden payloads and of code patterns.

Each takes files(path, content) and returns findings.  Payload places count code
points; pattern columns count bytes, as the reproduced behaviour does.  What a
file holds is found within its row, by functions of arrays of runs and lines; so
no detector shuffles, and ``content_findings`` runs any of them in one pass.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.stego import CARRIER, carrier_count, decoded_payload, text_entropy
from ..functions.text import byte_column, let, line_array, matches, short_line
from .findings import finding_columns, lookup


#: Characters of context to each side of a run, and how many runs are gathered at a time.
_BESIDE, _CHUNK = 100, 64
_RUN = "struct<start: int, line: int, column: int, before: string, run: string>"


def _gathered(pieces: Column, start: Column, kind: str, step) -> Column:
    """The items of type ``kind`` that ``step(item before, piece)`` makes one after another, the first from ``start``.

    A step of ``aggregate`` copies its whole state, so no state grows with the
    pieces: a first pass keeps only the item before each chunk, a second one
    gathers the items of every chunk on its own.
    """
    several = f"array<{kind}>"
    chunks = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _CHUNK).cast("int"))
    part = lambda c: F.slice(pieces, c * _CHUNK + 1, F.lit(_CHUNK))
    past = lambda before, c: F.aggregate(part(c), before.cast(kind), lambda s, x: step(s, x).cast(kind))
    begins = F.aggregate(chunks, F.array(start).cast(several), lambda s, c: F.concat(s, F.array(past(F.element_at(s, -1), c)).cast(several)))
    grown = lambda s, x: F.concat(s, F.array(step(F.element_at(s, -1), x)).cast(several))
    items = lambda before, c: F.slice(F.aggregate(part(c), F.array(before).cast(several), grown), 2, _CHUNK)
    return let(begins, lambda b: F.flatten(F.transform(chunks, lambda c: items(F.get(b, c), c))))


def run_array(content: Column, least: int = X.RUN_LENGTH, lead: str = "") -> Column:
    """array<struct<start, line, column, before, run, after>>: runs of at least ``least`` carriers after ``lead``.

    ``start`` counts code points from 0; ``line`` and ``column`` are the run's place,
    ``before`` and ``after`` what stands beside it.  The content is cut into runs
    and the gaps between them once; one pass forward adds up places, one
    backward gathers what follows, so the time grows with the content and the
    number of runs, not with their product.
    """
    pattern = f"{lead}[{CARRIER}]{{{least},}}"
    parts = F.struct(F.regexp_extract_all(content, F.lit(f"({pattern})"), F.lit(1)).alias("runs"), F.split(content, pattern, -1).alias("gaps"))
    cut = lambda p: F.transform(p["runs"], lambda run, k: F.struct(run.alias("run"), F.get(p["gaps"], k).alias("gap"), F.get(p["gaps"], k + 1).alias("next")))
    last = lambda text: F.right(text, F.lit(_BESIDE))
    first = lambda text: F.left(text, F.lit(_BESIDE))

    def forward(r: Column, x: Column) -> Column:
        gap, n = x["gap"], F.length(x["gap"])
        column = F.when(gap.contains("\n"), F.length(F.substring_index(gap, "\n", -1)) + 1).otherwise(r["column"] + F.length(r["run"]) + n)
        breaks = n - F.length(F.replace(gap, F.lit("\n"), F.lit("")))
        before = last(F.concat(last(F.concat(r["before"], r["run"])), last(gap)))
        return F.struct((r["start"] + F.length(r["run"]) + n).alias("start"), (r["line"] + breaks).alias("line"), column.alias("column"), before.alias("before"), x["run"].alias("run"))

    def backward(s: Column, x: Column) -> Column:
        return F.struct(first(F.concat(first(x["next"]), first(F.concat(s["run"], s["after"])))).alias("after"), x["run"].alias("run"))

    begin = F.struct(F.lit(0).alias("start"), F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit("").alias("before"), F.lit("").alias("run"))
    end = F.struct(F.lit("").alias("after"), F.lit("").alias("run"))
    joined = lambda r, after: F.struct(*(r[c].alias(c) for c in ("start", "line", "column", "before", "run")), after["after"].alias("after"))
    made = let(parts, lambda p: let(cut(p), lambda pieces: F.zip_with(_gathered(pieces, begin, _RUN, forward), F.reverse(_gathered(F.reverse(pieces), end, "struct<after: string, run: string>", backward)), joined)))
    return F.when(content.rlike(pattern), made).otherwise(F.array().cast(f"array<{_RUN[:-1]}, after: string>>"))


def carrier_runs(files: DataFrame, least: int = X.RUN_LENGTH, lead: str = "") -> DataFrame:
    """(path, content, run_no, start, run, n) of every run."""
    rows = files.select("path", "content", F.posexplode(run_array(F.col("content"), least, lead)).alias("run_no", "_r"))
    return rows.select("path", "content", "run_no", F.col("_r.start").alias("start"), F.col("_r.run").alias("run"), carrier_count(F.col("_r.run")).cast("long").alias("n"))


def _payloads(content: Column, least: int, lead: str, category: str, text) -> Column:
    """Findings of the runs; ``text`` makes the description of a run's length."""
    dots = lambda when: F.when(when, "...").otherwise("")

    def one(r: Column, size: Column) -> Column:
        end = r["start"] + F.length(r["run"])
        context = F.concat(dots(r["start"] > _BESIDE), r["before"], r["after"], dots(end + _BESIDE < size))
        return F.struct(*finding_columns(
            "stego", 3, line=r["line"].cast("long"), column=r["column"].cast("long"), category=category, severity="critical", description=text(carrier_count(r["run"]).cast("string")),
            remediation="Look at the decoded payload and remove the hidden characters.", cwe_id="CWE-506", context=context, decoded_payload=decoded_payload(r["run"]),
        ))

    found = F.struct(run_array(content, least, lead).alias("runs"), F.length(content).alias("size"))
    return let(found, lambda f: F.transform(f["runs"], lambda r: one(r, f["size"])))


def _stego(content: Column) -> Column:
    return _payloads(content, X.RUN_LENGTH, "", "stegano_payload", lambda n: F.concat(F.lit("Hidden payload in a run of "), n, F.lit(" variation selectors")))


def _pipe(content: Column) -> Column:
    return _payloads(content, X.PIPE_RUN, r"\|", "pipe_delimiter_stego", lambda n: F.concat(F.lit("Hidden payload of "), n, F.lit(" variation selectors after a pipe")))


def _decoders_in(rows: Column) -> Column:
    def one(row: Column) -> Column:
        x = row["text"]
        column = F.coalesce(*(byte_column(x, p) for p in X.SELECTOR_CONSTANTS))
        made = finding_columns(
            "stego", 3, line=row["line"], column=column, category="decoder_function", severity="high", description="Decoder of variation selectors: codePointAt with their constants",
            remediation="Find the file that carries the payload this code decodes.", cwe_id="CWE-506", context=short_line(x),
        )
        return F.when(x.contains("codePointAt") & matches(x, X.SELECTOR_CONSTANTS), F.struct(*made))

    return F.array_compact(F.transform(rows, one))


def indicator_confidence(n: Column) -> Column:
    steps = [F.when((n >= low) & (n <= high if high else F.lit(True)), F.lit(sure)) for low, high, sure in X.INDICATOR_CONFIDENCE]
    return F.coalesce(*steps)


_INDICATORS = [(kind, p) for kind, patterns in (("decoder_pattern", X.DECODER_PATTERNS), ("eval_pattern", X.EVAL_PATTERNS), ("encoding_pattern", X.ENCODING_PATTERNS)) for p in patterns]


_EVERY_INDICATOR = [p for _, p in _INDICATORS]


def indicator_array(rows: Column) -> Column:
    """array<struct<line, text, kind, pattern_no, column>> of lines: the first match of every pattern per line."""

    def one(row: Column) -> Column:
        x = row["text"]
        hits = (
            F.when(x.rlike(f"(?U){p}"), F.struct(row["line"].alias("line"), x.alias("text"), F.lit(kind).alias("kind"), F.lit(k).alias("pattern_no"), byte_column(x, p).alias("column")))
            for k, (kind, p) in enumerate(_INDICATORS)
        )
        return F.when(matches(x, _EVERY_INDICATOR), F.array_compact(F.array(*hits)))

    return F.flatten(F.array_compact(F.transform(rows, one)))


def indicators(files: DataFrame) -> DataFrame:
    """(path, line, text, column, kind, pattern_no, n); ``n`` counts the indicators of the file."""
    content = F.col("content")
    rows = files.where(matches(content, _EVERY_INDICATOR)).select("path", indicator_array(line_array(content)).alias("_all")).where("size(_all) > 0")
    return rows.select("path", F.explode("_all").alias("_h"), F.size("_all").cast("long").alias("n")).select("path", "_h.*", "n")


def _indicators_in(rows: Column) -> Column:
    """One finding per indicator in files that have at least two."""

    def made(listed: Column) -> Column:
        sure = indicator_confidence(F.size(listed))
        severity = F.when(sure >= 0.8, "critical").when(sure >= 0.6, "high").otherwise("medium")
        text = lambda kind: F.format_string("Loader pattern: %s (confidence: %d%%)", kind, F.round(sure * 100).cast("int"))
        one = lambda h: F.struct(*finding_columns(
            "stego", 3, line=h["line"], column=h["column"], category="glassware_pattern", severity=severity, description=text(h["kind"]), remediation="Review what the file decodes and runs.",
            cwe_id="CWE-956", context=h["text"],
        ))
        return F.when(F.size(listed) >= 2, F.transform(listed, one))

    return let(indicator_array(rows), made)


def line_literal(text: Column) -> Column:
    """The line's first quoted literal of 64 or more characters, else its first such template; null without one."""
    quoted = F.concat(F.regexp_extract(text, X.QUOTED_LITERAL, 1), F.regexp_extract(text, X.QUOTED_LITERAL, 2))
    template = F.regexp_extract(text, X.TEMPLATE_LITERAL, 1)
    return F.when(quoted != "", quoted).when(template != "", template)


_BLOB = f"{X.BASE64_RUN}|{X.QUOTED_LITERAL}|{X.TEMPLATE_LITERAL}"


def _encrypted_in(rows: Column, fixes: bool = False) -> Column:
    """Files with a blob of high entropy and a line that runs code.

    Hex runs can never pass 4.5 bits, so they only give the place: the first line
    with a hex run, else with a base64 run, else with a literal of high entropy.
    ``fixes`` takes the first line with a blob of high entropy.
    """
    dense = lambda x: F.exists(F.regexp_extract_all(x, F.lit(f"({X.BASE64_RUN})"), F.lit(1)), lambda run: text_entropy(run) > X.ENTROPY_LIMIT)
    literal = lambda x: F.coalesce(text_entropy(line_literal(x)) > X.ENTROPY_LIMIT, F.lit(False))
    told = lambda row: F.when(row["text"].rlike(_BLOB), facts_of(row["line"], row["text"]))
    facts_of = lambda line, x: F.struct(line.alias("line"), dense(x).alias("base64"), literal(x).alias("literal"), x.rlike(X.HEX_RUN).alias("hex_run"), x.rlike(X.BASE64_RUN).alias("base64_run"))

    def made(facts: Column) -> Column:
        first = lambda test: F.array_min(F.transform(F.filter(facts, test), lambda f: f["line"]))
        full = lambda f: f["base64"] | f["literal"]
        place = first(full) if fixes else F.coalesce(first(lambda f: f["hex_run"]), first(lambda f: f["base64_run"]), first(lambda f: f["literal"]), F.lit(1).cast("long"))
        one = finding_columns(
            "encrypted_payload", 5, line=place.cast("long"), column=F.lit(1).cast("bigint"), category="encrypted_payload", severity="high", description="Blob of high entropy in a file that runs code dynamically",
            remediation="Decode the blob and review what is run.", cwe_id="CWE-506", character=F.lit(None).cast("string"),
        )
        return F.when(F.exists(facts, full), F.array(F.struct(*one)))

    runs = F.exists(rows, lambda row: matches(row["text"], X.EXEC_PATTERNS))
    return F.when(runs, let(F.array_compact(F.transform(rows, told)), made))


def xor_proximity(content: Column) -> Column:
    """charCodeAt with ^ and fromCharCode up to four lines later, or fromCharCode with ^ and charCodeAt up to five lines earlier."""

    def near(split: Column, a: str, b: str, low: int, high: int) -> Column:
        around = lambda i: F.slice(split, F.greatest(i - low + 1, F.lit(1)), F.least(i, F.lit(low)) + high + 1)
        return F.exists(F.transform(split, lambda x, i: F.when(x.contains(a) & x.contains("^"), F.exists(around(i), lambda y: y.contains(b))).otherwise(F.lit(False))), lambda z: z)

    return let(F.split(content, "\n", -1), lambda split: near(split, "charCodeAt", "String.fromCharCode", 0, 4) | near(split, "String.fromCharCode", "charCodeAt", 5, 0))


def _channels(content: Column) -> Column:
    """Files that read response headers of a client, decrypt, and run code."""
    hit = matches(content, X.CLIENT_PATTERNS) & matches(content, X.HEADER_PATTERNS) & matches(content, X.C2_EXEC_PATTERNS)
    hit &= matches(content, X.DECRYPT_PATTERNS) | F.coalesce(F.when(content.contains("charCodeAt"), xor_proximity(content)), F.lit(False))
    places = F.transform(F.split(content, "\n", -1), lambda x, i: F.when(matches(x, X.HEADER_PATTERNS), i + 1))
    one = finding_columns(
        "header_c2", 6, line=F.coalesce(F.array_min(places), F.lit(1)).cast("bigint"), column=F.lit(1).cast("bigint"), category="header_c2", severity="critical",
        description="Response headers are read, decrypted and run", remediation="Review the network calls and the decryption.", cwe_id="CWE-506", character=F.lit(None).cast("string"),
    )
    return F.when(hit, F.array(F.struct(*one)))


#: What is looked for in whole contents and in their lines, by name; each gives an array of findings, or null.
CONTENT_PARTS = {"stego_runs": _stego, "pipe_stego": _pipe, "channels": _channels}
LINE_PARTS = {"decoder_functions": _decoders_in, "indicators": _indicators_in, "encrypted": _encrypted_in}


def _worth_cutting(content: Column, part: str) -> Column:
    """Whether the content can hold what the part looks for in lines."""
    if part == "decoder_functions":
        return content.contains("codePointAt")
    return matches(content, _EVERY_INDICATOR) if part == "indicators" else matches(content, X.EXEC_PATTERNS) & content.rlike(_BLOB)


def _in_lines(content: Column, parts: list[str], fixes: bool) -> Column:
    """Findings of the parts that look at lines; a content that may hold any is cut into lines once for all of them."""
    worth = F.struct(*(_worth_cutting(content, p).alias(p) for p in parts))
    found = lambda p, rows: _encrypted_in(rows, fixes) if p == "encrypted" else LINE_PARTS[p](rows)
    every = lambda w, rows: F.flatten(F.array_compact(F.array(*(F.when(w[p], found(p, rows)) for p in parts))))
    return let(worth, lambda w: F.when(functools.reduce(Column.__or__, (w[p] for p in parts)), let(line_array(content), lambda rows: every(w, rows))))


def content_findings(files: DataFrame, parts: tuple[str, ...] = (*CONTENT_PARTS, *LINE_PARTS), fixes: bool = False) -> DataFrame:
    """Findings of the chosen parts in one pass over the files."""
    content = F.col("content")
    made = [CONTENT_PARTS[p](content) for p in parts if p in CONTENT_PARTS]
    if lined := [p for p in parts if p in LINE_PARTS]:
        made.append(_in_lines(content, lined, fixes))
    return files.select("path", "content").select(F.explode(F.flatten(F.array_compact(F.array(*made)))).alias("_f")).select("_f.*")


def stego_runs(files: DataFrame) -> DataFrame:
    """Long runs of variation selectors, decoded."""
    return content_findings(files, ("stego_runs",))


def pipe_stego(files: DataFrame) -> DataFrame:
    """Variation selectors right after a pipe, decoded; the place is the pipe's."""
    return content_findings(files, ("pipe_stego",))


def decoder_functions(files: DataFrame) -> DataFrame:
    """Lines that name a selector constant and codePointAt; the column is that of the first pattern, in order, that matches."""
    return content_findings(files, ("decoder_functions",))


def indicator_findings(files: DataFrame) -> DataFrame:
    """One finding per indicator in files that have at least two."""
    return content_findings(files, ("indicators",))


def encrypted_payloads(files: DataFrame, fixes: bool = False) -> DataFrame:
    """Files with a blob of high entropy and a line that runs code."""
    return content_findings(files, ("encrypted",), fixes)


def header_channels(files: DataFrame) -> DataFrame:
    """Files that read response headers of a client, decrypt, and run code."""
    return content_findings(files, ("channels",))


def rc4_indicators(content: Column) -> Column:
    """The kinds of stream-cipher indicators in the content, in fixed order."""
    return F.array_compact(F.array(*(F.when(matches(content, [p]), F.lit(kind)) for kind, p in X.RC4_PATTERNS.items())))


def rc4_confidence(n: Column) -> Column:
    return lookup(X.RC4_CONFIDENCE, n.cast("int"))
