"""Query of operator 12 and its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .manifest import verified_manifest
from .shared import read_documents


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_manifest(read_documents(spark, sf_dir))


def _levels(name: str, first: str, most: int) -> str:
    """Tables <name>0.. of nodes with what stands before and after them in their run; a tree with one node left has no run."""
    out = []
    for k in range(most + 1):
        below = f"{name}{k - 1}"
        nodes = first if k == 0 else (
            f"SELECT tree, pos // 16 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM {below} GROUP BY tree, pos // 16"
        )
        beside = lambda rows: f"coalesce(string_agg(digest, '') OVER (PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN {rows}), '')"
        out.append(
            f"{name}{k} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY tree) AS n, {beside('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS before, "
            f"{beside('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS after FROM ({nodes}))"
        )
    return ",\n".join(out)


def oracle(depth: int = 4, above: int = 2) -> str:
    """For sources of up to 16^depth rows and up to 16^above sources."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps, last = [], "leaves"
    for k, (name, level, pos, tree) in enumerate([*(("s", level, "pos", "l.tree") for level in range(depth)), *(("a", level, "rank", "0") for level in range(above))]):
        steps.append(
            f"f{k} AS MATERIALIZED (SELECT l.* EXCLUDE (fold, proof), CASE WHEN n = 1 THEN fold ELSE sha256(before || fold || after) END AS fold, CASE WHEN n = 1 THEN proof ELSE proof || before || after END AS proof "
            f"FROM {last} l JOIN {name}{level} x ON x.tree IS NOT DISTINCT FROM {tree} AND x.pos = l.{pos} // {16 ** level})"
        )
        last = f"f{k}"
    return f"""
WITH RECURSIVE step(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END FROM step WHERE k < 8
),
tab AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8),
hashed AS MATERIALIZED (
  SELECT source AS tree, doc_id, {leaf("text")} AS leaf, {leaf(low)} AS low, hex(encode(CAST(doc_id AS VARCHAR))) AS h FROM documents
),
crc AS (
  SELECT hashed.*, CAST(xor(4294967295::UBIGINT, list_reduce(
      list_transform(range(len(h) // 2), lambda i: CAST(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS UBIGINT)),
      lambda a, b: xor(a >> 8, tab[CAST(xor(a & 255, b) AS BIGINT) + 1]), 4294967295::UBIGINT)) AS BIGINT) AS crc FROM hashed, tab
),
ranked AS MATERIALIZED (
  SELECT tree, doc_id, leaf, CASE WHEN crc % 5 = 0 THEN low ELSE leaf END AS changed, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos FROM crc
),
{_levels("s", "SELECT tree, pos, leaf AS digest FROM ranked", depth)},
tops AS MATERIALIZED (SELECT tree AS source, digest, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS rank FROM s{depth}),
{_levels("a", "SELECT 0 AS tree, rank AS pos, digest FROM tops", above)},
leaves AS MATERIALIZED (
  SELECT ranked.tree, ranked.pos, doc_id, leaf, rank, tops.digest AS subroot, a{above}.digest AS root, changed AS fold, '' AS proof
  FROM ranked JOIN tops ON ranked.tree IS NOT DISTINCT FROM tops.source, a{above}
),
{", ".join(steps)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM {last}
"""


QUERIES = {"op12_manifest": op12_manifest}
ORACLES = {"op12_manifest": oracle()}
