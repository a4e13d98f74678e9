"""Operator 12, Merkle manifest: a content-addressed tree of digests per source, and one above the sources.

Every row is a leaf.  Leaves stand in the order of their ids within their
source; runs of ``width`` digests become the digest of the run, level by level,
until one is left, the source's root.  The sources' roots, in the order of the
sources, make the tree above them.  Levels are stored as records of a digest
with its children.

Proofs descend through these records: from the root, each level is joined with
the frontier on the digest, every wanted child goes on with the digit of its
rank, and the children beside it are added to the path; leaves that share a
run's path share its steps.  Reversed, the path folds a leaf up to the root.

A run's record holds at most ``width`` children, so no group grows; ranks are
distributed prefix sums, so a source that holds most rows spreads over all tasks.

Results in edge cases: null fields count as such in the leaf; null ids and null
sources come first; rows that share an id are ordered by their leaf, and equal
rows have one digest; a source with one row has its leaf as root; an empty table
gives an empty result; texts are hashed whole; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import prefix_sums, written

WIDTH = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    """The leaf of a row, or of the row with another text."""
    return digest(*(_field(text if name == "text" and text is not None else F.col(name)) for name in FIELDS))


def _lowered_text() -> Column:
    return F.translate("text", _UPPER, _LOWER)


def is_tampered(every: int = 5) -> Column:
    """Rows whose id's CRC is divisible by ``every``; rows without an id are left alone."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))


@dataclass
class Tree:
    """``tops`` (tree, digest, depth) and, from the lowest level up, tables (digest, children)."""

    tops: DataFrame
    records: list[DataFrame]


def build(nodes: DataFrame, name: str, width: int = WIDTH) -> Tree:
    """Trees over ``nodes`` (tree, pos, digest): a tree is done when one node is left."""
    level, records = nodes.select("tree", "pos", "digest", F.lit(0).alias("depth")), []
    while True:
        height = len(records) + 1
        run = F.expr(f"pos div {width}").alias("pos")
        runs = level.groupBy("tree", run).agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("kids"), F.max("depth").alias("depth"))
        kids = F.col("kids.digest")
        done = (F.col("pos") == 0) & (F.size(kids) == 1)
        made = runs.select(
            "tree", "pos", F.when(done, kids[0]).otherwise(digest(F.array_join(kids, ""))).alias("digest"), F.when(done, F.col("depth")).otherwise(height).alias("depth"), F.when(~done, kids).alias("children")
        )
        level = written(made, f"{name}-{height}")
        records.append(level.where("children IS NOT NULL").select("digest", "children"))
        if not level.agg(F.max("pos")).first()[0]:
            return Tree(level.select("tree", "digest", "depth"), records)


def _beside(children: Column, digit: Column) -> Column:
    """The unselected children, left and right of the selected one."""
    left, right = F.slice(children, F.lit(1), digit), F.slice(children, digit + 2, F.size(children))
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def _opened(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """The frontier with its records' children; equal digests have one record."""
    return frontier.join(records.dropDuplicates(["digest"]), "digest")


def descend(tree: Tree, tops: DataFrame, to: int, width: int = WIDTH, wanted: DataFrame | None = None) -> DataFrame:
    """(tree, pos, digest, path, …) of all nodes at level ``to`` below ``tops`` (tree, digest, depth, path, …).

    ``path`` gains one step per level, from the top down.  Only nodes above the
    leaves ``wanted`` (tree, pos) are followed, if given.  Trees of a lower
    depth join the frontier at their level.
    """
    needed = []
    for _ in range(len(tree.records) + 1) if wanted is not None else ():
        rows = needed[-1].select("tree", F.expr(f"pos div {width}").alias("pos")) if needed else wanted.select("tree", "pos")
        needed.append(rows.distinct())
    tops = tops.withColumn("pos", F.lit(0).cast("long"))
    columns = [c for c in tops.columns if c not in ("digest", "pos", "path", "depth")]
    at = lambda height: tops.where(F.col("depth") == height).select(*columns, "digest", "pos", "path")
    frontier = at(len(tree.records))
    for height in range(len(tree.records), to, -1):
        opened = _opened(frontier, tree.records[height - 1]).select("*", F.posexplode("children").alias("digit", "child"))
        step = F.array(_beside(F.col("children"), F.col("digit")))
        frontier = opened.select(*columns, F.col("child").alias("digest"), (F.col("pos") * width + F.col("digit")).alias("pos"), F.concat("path", step).alias("path"))
        if needed:
            n = needed[height - 1].select(F.col("tree").alias("_t"), F.col("pos").alias("_p"))
            frontier = frontier.join(n, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("pos") == F.col("_p")), "left_semi")
        frontier = frontier.unionByName(at(height - 1))
    return frontier


@dataclass
class Manifest:
    """``leaves`` (tree, pos, doc_id, leaf, changed), the sources' trees, the tree above them and its root."""

    leaves: DataFrame
    sources: Tree
    above: Tree
    order: DataFrame
    root: str | None


def manifest(docs: DataFrame, changed: Column | None = None, width: int = WIDTH) -> Manifest:
    """The stored manifest of ``docs``; ``changed`` is what a row's leaf would be now (its leaf, if not given)."""
    leaf = leaf_digest()
    rows = docs.select(F.col("source").alias("tree"), "doc_id", leaf.alias("leaf"), (leaf if changed is None else changed).alias("changed"), F.lit(1).cast("long").alias("_one"))
    hashed = written(rows, "leaves")
    leaves = prefix_sums(hashed, ["tree"], ["doc_id", "leaf"], ["_one"], "leaf-ranks").select("tree", F.col("before__one").alias("pos"), "doc_id", "leaf", "changed")
    sources = build(leaves.select("tree", "pos", F.col("leaf").alias("digest")), "sources", width)
    tops = sources.tops.withColumn("_one", F.lit(1).cast("long"))
    order = prefix_sums(tops, [], ["tree"], ["_one"], "source-ranks").select("tree", F.col("digest").alias("subroot"), "depth", F.col("before__one").alias("rank"))
    order = written(order, "source-order")
    above = build(order.select(F.lit(0).alias("tree"), F.col("rank").alias("pos"), F.col("subroot").alias("digest")), "above", width)
    root = above.tops.first()
    return Manifest(leaves, sources, above, order, root.digest if root else None)


def proofs(m: Manifest, requests: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """(tree, pos, doc_id, leaf, changed, subroot, root, path) per leaf, or per leaf in ``requests`` (tree, pos).

    ``path`` has the steps (left, right) from the leaf's run up to the root.
    """
    empty = F.array().cast("array<struct<left:string,right:string>>")
    top = descend(m.above, m.above.tops.withColumn("path", empty), 0, width).select(F.col("pos").alias("rank"), "path")
    # one row per source, read again at every level: written, so that no level computes it anew
    tops = written(m.order.join(top, "rank").select("tree", F.col("subroot").alias("digest"), "depth", "path", "subroot"), "source-paths")
    runs = _opened(descend(m.sources, tops, 1, width, requests), m.sources.records[0]) if m.sources.records else None
    whole = ["tree", "pos", "path", "subroot"]
    lone = tops.where("depth = 0").select("tree", F.lit(0).cast("long").alias("pos"), "path", "subroot", F.lit(None).cast("array<string>").alias("children"))
    found = runs.select(*whole, "children").unionByName(lone).select(F.col("tree").alias("_tree"), F.col("pos").alias("_run"), "path", "subroot", "children")
    leaves = m.leaves
    if requests is not None:
        asked = requests.select(F.col("tree").alias("_t"), F.col("pos").alias("_p"))
        leaves = leaves.join(asked, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("pos") == F.col("_p")), "left_semi")
    joined = leaves.join(found, F.col("tree").eqNullSafe(F.col("_tree")) & (F.expr(f"pos div {width}") == F.col("_run")))
    last = F.when(F.col("children").isNotNull(), F.array(_beside(F.col("children"), (F.col("pos") % width).cast("int")))).otherwise(empty)
    return joined.select("tree", "pos", "doc_id", "leaf", "changed", "subroot", F.lit(m.root).alias("root"), F.reverse(F.concat("path", last)).alias("path"))


def proof_digest(path: Column) -> Column:
    """One digest of all siblings, level by level."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda below, step: digest(step["left"], below, step["right"]))


def verified_manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row: what a change of the rows ``tampered`` does."""
    changed = F.when(is_tampered() if tampered is None else tampered, leaf_digest(_lowered_text())).otherwise(leaf_digest())
    found = proofs(manifest(docs, changed)).withColumn("folded_root", folded(F.col("path"), F.col("changed")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
