"""Operator 9, document fingerprints: SimHash in DataFrame functions only.

A text's words (runs of characters other than blank and U+0009-U+000D, lower
case) vote on 64 signed bits by their hash; a word's weight is its length, up
to 12, so that short function words count little.  Votes are summed in packed
longs by an aggregate over the exploded words, combined before the shuffle.  A
bit is set if more than half of the weight votes for it.

Then fingerprints are searched: the 64 bits are cut into ``radius + extra``
blocks; two fingerprints within the radius agree on at least ``extra`` blocks, so
a table per choice of ``extra`` blocks, keyed by those blocks' bits, meets every
pair.  Equal fingerprints are one entry of the tables, whatever bears them.

The next document is found in windows over buckets of 1,024 neighbouring ids;
ids must not repeat without bound, since rows of one id share a bucket.

Results in edge cases: a null text counts as empty; an empty or blank text has
the fingerprint of 16 zeros; a null doc_id sorts first; rows with equal ids are
ordered by a hash of the text; repeated rows give repeated results; the next of
a single row is itself; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_broadcast, shuffle_width, written

LONGEST, CHUNK_BITS = 12, 11
#: Ids that share a bucket when a row looks for the next one, as a power of two.
BUCKET_BITS = 10
#: Differing bits of fingerprints that are near, and stored fingerprints of a block key that go to one part.
RADIUS, CROWD = 3, 4096


def fingerprints(texts: DataFrame, keys: list[str], texts_col: str) -> DataFrame:
    """(*keys, fingerprint long) for every row of ``texts``; ``keys`` identify a row.

    The first aggregate sums chunks of 2,048 words in 16 longs of four 16-bit
    fields.  A field gets at most 2,048 * 12 = 24,576, below 2^15, so that the top
    one does not reach the sign either.  The second, over few rows, adds up the
    chunks in 64 sums.
    """
    words = texts.select(*keys, F.posexplode(F.split(F.lower(texts_col), r"[ \t-\r]+")).alias("_at", "_w"))
    votes = words.select(*keys, F.shiftright("_at", CHUNK_BITS).alias("_chunk"), F.xxhash64("_w").alias("_h"), F.least(F.length("_w"), F.lit(LONGEST)).cast("long").alias("_c"))
    field = F.lit(0x0001000100010001)
    packed = [F.sum(F.col("_c") * F.shiftrightunsigned("_h", j).bitwiseAND(field)).alias(f"_s{j}") for j in range(16)]
    chunks = votes.groupBy(*keys, "_chunk").agg(F.sum("_c").alias("_total"), *packed)
    single = [F.sum(F.shiftrightunsigned(f"_s{j % 16}", 16 * (j // 16)).bitwiseAND(F.lit(0xFFFF))).alias(f"_b{j}") for j in range(64)]
    summed = chunks.groupBy(*keys).agg(F.sum("_total").alias("_total"), *single)
    bits = F.array(*(F.when(2 * F.col(f"_b{j}") > F.col("_total"), F.lit(1 << j if j < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long") for j in range(64)))
    return summed.select(*keys, F.aggregate(bits, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y)).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """1 less the share of differing bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def following(buckets: DataFrame) -> DataFrame:
    """(bucket, next_bucket) in ascending order of the distinct ``buckets(bucket)``; the last one's next is the first.

    Buckets are dealt by ranges and look for the next one within their range;
    only the firsts of the ranges, one row for each, meet in one window.
    """
    spark = buckets.sparkSession
    dealt = written(buckets.repartitionByRange(shuffle_width(spark), "bucket").select("bucket", F.spark_partition_id().alias("range")), "ranges")
    near = dealt.withColumn("next_bucket", F.lead("bucket").over(Window.partitionBy("range").orderBy("bucket")))
    firsts = dealt.groupBy("range").agg(F.min("bucket").alias("first"))
    chain = firsts.select(F.col("range").alias("_range"), F.lead("first").over(Window.orderBy("range")).alias("_next"))
    lowest = dealt.agg(F.min("bucket").alias("_lowest"))
    joined = near.join(F.broadcast(chain), F.col("range") == F.col("_range")).crossJoin(F.broadcast(lowest))
    return joined.select("bucket", F.coalesce("next_bucket", "_next", "_lowest").alias("next_bucket"))


def with_next(rows: DataFrame, order: list[str], col: str) -> DataFrame:
    """``rows`` with ``place`` (from 1 within the bucket) and ``next_<col>`` of the row that follows in (bucket, order).

    The window runs within buckets; the last row of a bucket takes the value of
    the next bucket's first row, which a join on the bucket brings.
    """
    within = Window.partitionBy("bucket").orderBy(*order)
    placed = rows.withColumn("place", F.row_number().over(within)).withColumn("_ahead", F.lead(col).over(within)).withColumn("_more", F.lead(F.lit(True)).over(within))
    firsts = placed.where("place = 1").select(F.col("bucket").alias("_b"), F.col(col).alias("_value"))
    chain = following(rows.select("bucket").distinct())
    jump = chain.join(firsts, F.col("next_bucket") == F.col("_b")).select(F.col("bucket").alias("_from"), "_value")
    joined = placed.join(jump, F.col("bucket") == F.col("_from"))
    return joined.withColumn(f"next_{col}", F.when(F.col("_more"), F.col("_ahead")).otherwise(F.col("_value"))).drop("_ahead", "_more", "_from", "_value")


def fingerprint_edits(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per row: its fingerprint, that of its edited text, their likeness, and for query rows what is near it.

    The edited text has the last floor(n_chars / 4) characters replaced by the
    first as many of the next document's text.  Rows whose id is divisible by 50
    are searched among all rows; the columns of the search are null elsewhere.
    """
    base = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.shiftright(F.col("doc_id").cast("long"), BUCKET_BITS), F.lit(-(1 << 62))).alias("bucket"),
        F.xxhash64("text").alias("tie"),
    )
    ahead = with_next(base, ["doc_id", "tie"], "text").withColumn("n_chars", F.length("text").cast("long"))
    cut = F.expr("cast(n_chars div 4 as int)")
    edited = ahead.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 4 as int))"), F.substring("next_text", F.lit(1), cut)))
    keys = ["bucket", "place", "doc_id", "n_chars", "edited_sha256", "version"]
    versions = edited.select(
        "bucket", "place", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("version", "words_of")
    )
    made = fingerprints(versions, keys, "words_of")
    paired = made.groupBy(*keys[:-1]).agg(
        F.max(F.when(F.col("version") == 0, F.col("fingerprint"))).alias("fp"), F.max(F.when(F.col("version") == 1, F.col("fingerprint"))).alias("edited_fp")
    )
    paired = written(paired, "fingerprints")
    rows = with_next(paired.withColumnRenamed("place", "rank"), ["rank"], "fp")
    near = near_counts(paired.select("doc_id", "fp"), radius)
    rows = rows.join(bounded_broadcast(near), (F.col("fp") == F.col("_fp")) & F.expr(IS_QUERY), "left")
    as_hex = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex("fp").alias("fingerprint"),
        as_hex("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "near_fingerprints",
        "near_documents",
        "nearest",
    )


#: The rows whose fingerprints are searched among all others.
IS_QUERY = "doc_id % 50 = 0"


def near_counts(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(_fp, near_fingerprints, near_documents, nearest) for the fingerprints of the query rows among ``rows(doc_id, fp)``.

    How many other fingerprints are within the radius, how many rows bear them,
    and the distance of the nearest (null if there is none).
    """
    stored = written(rows.groupBy(F.col("fp").alias("fingerprint")).agg(F.count(F.lit(1)).alias("bearers"), F.max(F.coalesce(F.expr(IS_QUERY), F.lit(False))).alias("asked")), "stored")
    queries = stored.where("asked").select(F.col("fingerprint").alias("query"), "fingerprint")
    found = near_fingerprints(queries, stored.select("fingerprint"), radius).where("query <> fingerprint")
    counted = found.join(stored.select(F.col("fingerprint").alias("_s"), "bearers"), F.col("fingerprint") == F.col("_s"))
    counted = counted.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.sum("bearers").alias("rows"), F.min("distance").alias("nearest"))
    named = queries.select(F.col("query").alias("_fp")).join(counted, F.col("_fp") == F.col("query"), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return named.select("_fp", count("n").alias("near_fingerprints"), count("rows").alias("near_documents"), F.col("nearest").cast("int").alias("nearest"))


def near_fingerprints(queries: DataFrame, stored: DataFrame, radius: int = RADIUS, extra: int = 3) -> DataFrame:
    """(query, fingerprint, distance): every stored fingerprint within ``radius`` of a query's.

    ``queries(query, fingerprint)`` and ``stored(fingerprint)``; equal stored
    fingerprints count once.  Block tables are keyed by table number and the
    chosen blocks, so no table is searched whole; a pair is named in the first
    table in which it meets.  A key of more than CROWD stored fingerprints is
    dealt in as many parts as that takes, and its queries go to each part.
    """
    blocks = radius + extra
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), extra):
        mask = 0
        for k in chosen:
            mask |= (1 << edges[k + 1]) - (1 << edges[k])
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    keyed = lambda col: F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col(col).bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks))))
    left = queries.select("query", F.col("fingerprint").alias("q"), keyed("fingerprint").alias("at"))
    right = stored.select("fingerprint").distinct().select("fingerprint", keyed("fingerprint").alias("at2"))
    crowds = written(right.groupBy("at2").count().where(F.col("count") > CROWD), "crowds").select(F.col("at2").alias("crowd"), F.ceil(F.col("count") / CROWD).cast("int").alias("parts"))
    crowds = bounded_broadcast(crowds)
    one = F.coalesce("parts", F.lit(1))
    left = left.join(crowds, F.col("at") == F.col("crowd"), "left").select("query", "q", "at", F.explode(F.sequence(F.lit(0), one - 1)).alias("part"))
    right = right.join(crowds, F.col("at2") == F.col("crowd"), "left").select("fingerprint", "at2", F.pmod(F.xxhash64("fingerprint"), one).cast("int").alias("part2"))
    differing = F.col("q").bitwiseXOR(F.col("fingerprint"))
    first = F.array_position(F.array(*(differing.bitwiseAND(F.lit(m)) == 0 for m in masks)), F.lit(True)) - 1
    met = left.join(right, (F.col("at") == F.col("at2")) & (F.col("part") == F.col("part2")) & (F.bit_count(differing) <= radius) & (first == F.col("at.t")))
    return met.select("query", "fingerprint", F.bit_count(differing).alias("distance")).distinct()
