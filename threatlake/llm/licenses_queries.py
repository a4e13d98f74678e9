"""Query of operator 2 and its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .licenses import BASE, TEMPLATES, markup, scan_licenses
from .shared import read_documents


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_documents(spark, sf_dir)).drop("spans")


def as_regex(parts: list) -> str:
    """A template over blank-parted words as a regular expression (the oracle's second reading of the markup)."""
    out = ""
    for part in parts:
        if isinstance(part, list):
            out += f"(?:{as_regex(part)})?"
        elif isinstance(part, tuple):
            out += f"(?:[^ ]+ ){{{part[0]},{part[1]}}}"
        else:
            out += f"{part} "
    return out


def oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    lists = []
    for phrase in BASE:
        words = phrase.split()
        test = " AND ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(words))
        lists.append(f"list_filter(range(len(w)), lambda i: {test})")
    base_labels = [f"CASE WHEN len(b{k}) > 0 THEN '{label}' END" for k, label in enumerate(BASE.values())]
    own = [f"CASE WHEN regexp_matches(s, ' {as_regex(markup(t))}') THEN '{label}' END" for label, t in TEMPLATES]
    joined = "coalesce(array_to_string(list_sort(list_distinct(list_filter([{}], lambda x: x IS NOT NULL))), ','), '')"
    return f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
),
found AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s, {", ".join(f"{x} AS b{k}" for k, x in enumerate(lists))} FROM words),
named AS (
  SELECT doc_id, len(w) AS n_words, list_concat(b0, list_concat(b1, b2)) AS b,
         {joined.format(", ".join(base_labels))} AS base_labels, {joined.format(", ".join(base_labels + own))} AS labels FROM found
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(b) AS BIGINT) AS n_base, list_min(b) AS first_word, list_max(b) AS last_word,
       base_labels, labels, CASE WHEN labels <> base_labels THEN 1.0 WHEN base_labels <> '' THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM named
"""


QUERIES = {"op2_licenses": op2_licenses}
ORACLES = {"op2_licenses": oracle()}
