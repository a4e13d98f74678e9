"""Review of flagged files by a language model: prompts, answers, verdicts.

The model is an injected callable (prompt -> answer text); only files with
findings reach it, and a failing call leaves the file without a verdict but
with the reason.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import VERDICT
from .findings import rule_id

CONTENT_LIMIT = 50_000


def config_from_env(environ=os.environ) -> dict | None:
    """base_url, api_key and model of a chat service; None if any is missing."""
    found = {k: environ.get(f"THREATLAKE_REVIEW_{k.upper()}") for k in ("base_url", "api_key", "model")}
    return found if all(found.values()) else None


def chat_client(base_url: str, api_key: str, model: str, timeout: float = 120) -> Callable[[str], str]:
    """A callable that posts a prompt to a chat service and returns the response's text; network errors are OSErrors."""

    def ask(prompt: str) -> str:
        import json
        from urllib.request import Request, urlopen

        body = {"model": model, "temperature": 0.1, "messages": [{"role": "user", "content": prompt}]}
        request = Request(f"{base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Authorization": f"Bearer {api_key}", "Content-Type": "application/json"})
        with urlopen(request, timeout=timeout) as response:
            return response.read().decode("utf-8", "replace")

    return ask


def cut_content(content: Column, limit: int = CONTENT_LIMIT) -> Column:
    """Contents of more than ``limit`` bytes lose what follows ``limit`` characters, and the last of these."""
    short = F.left(content, F.least(F.lit(limit), F.length(content)) - 1)
    return F.when(F.octet_length(content) > limit, F.concat(short, F.lit("\n[truncated]"))).otherwise(content)


def prompts(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, prompt) of the files with findings."""
    line = F.format_string("%s line %d: %s (%s)", rule_id(F.col("category"), prompt=True), F.col("line"), F.col("description"), F.col("severity"))
    listed = findings.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("listed"))
    cut = files.select("path", cut_content(F.col("content")).alias("content"))
    text = F.concat(F.lit("Findings:\n"), F.col("listed"), F.lit("\n\nFile:\n"), F.col("content"), F.lit('\n\nAnswer with JSON: {"is_malicious", "confidence", "reasoning", "reclassified_severity"}'))
    return cut.join(listed, "path").select("path", text.alias("prompt"))


def unfenced(text: Column) -> Column:
    """The text inside a Markdown code fence, if there is one."""
    body = F.regexp_extract(text, r"(?s)^\s*```(?:json)?\s*\n?(.*)```", 1)
    return F.regexp_replace(F.when(text.rlike(r"(?s)^\s*```.*```"), body).otherwise(text), r"^\s+|\s+$", "")


def parsed_verdict(response: Column) -> Column:
    """The verdict in a chat response's first message."""
    return F.from_json(unfenced(F.get_json_object(response, "$.choices[0].message.content")), VERDICT)


def reviews(files: DataFrame, findings: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """(path, verdict, reason) for the files with findings; one of the two is null: a file without verdict has the reason."""

    def ask(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for path, prompt in zip(batch["path"], batch["prompt"]):
                try:
                    rows.append((path, model(prompt), None))
                except (OSError, ValueError) as error:
                    rows.append((path, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "response", "failure"])

    asked = prompts(files, findings).mapInPandas(ask, "path string, response string, failure string")
    answer = parsed_verdict(F.col("response"))
    read = asked.select("path", F.when(answer["is_malicious"].isNotNull(), answer).alias("verdict"), "failure")
    reason = F.when(F.col("verdict").isNull(), F.coalesce("failure", F.lit("the answer holds no verdict")))
    return read.select("path", "verdict", reason.alias("reason"))


def verdicts(files: DataFrame, findings: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """(path, verdict) for the files with findings that were reviewed."""
    return reviews(files, findings, model).where("verdict IS NOT NULL").select("path", "verdict")
