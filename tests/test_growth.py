"""Time that grows with the content, places of many runs, entropy, damaged archives."""

import collections
import gzip
import io
import math
import random
import tarfile
import time

import pytest
from pyspark.sql import functions as F

from threatlake.functions.stego import byte_entropy, encode_text, entropies
from threatlake.operators import patterns as P
from threatlake.sources.files import archive_members, damaged_archives, unpacked


def table(spark, *contents):
    return spark.createDataFrame([(f"p{k}.js", c) for k, c in enumerate(contents)], "path string, content string")


def seconds(df):
    df.write.format("noop").mode("overwrite").save()
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def places(content, runs):
    """(line, column, context) of each (start, end)."""
    for a, b in runs:
        before = content[:a]
        context = ("..." if a > 100 else "") + content[max(0, a - 100) : a] + content[b : b + 100] + ("..." if b + 100 < len(content) else "")
        yield before.count("\n") + 1, a - (before.rfind("\n") + 1) + 1, context


@pytest.mark.parametrize("seed", range(3))
def test_places_of_many_runs(spark, seed):
    rng = random.Random(seed)
    gaps = ["", "x", "\n", "ab\ncd", "é" * 120, "\r\n", "w" * 99 + "\n", "long " * 40, "\n\n"]
    content, runs = rng.choice(gaps), []
    for _ in range(700):
        run = encode_text(bytes(rng.randrange(256) for _ in range(rng.randrange(16, 24))))
        runs.append((len(content), len(content) + len(run)))
        content += run + "." + rng.choice(gaps)
    found = P.stego_runs(table(spark, content)).select("line", "column", "context").collect()
    assert sorted(map(tuple, found)) == sorted(places(content, runs))


def test_pipe_runs_take_time_in_proportion(spark):
    def content(n):
        return "".join(f"word{k} |{encode_text(b'abcdef')} and so on{chr(10) * (k % 7 == 0)}" for k in range(n))

    took = {n: seconds(P.pipe_stego(table(spark, content(n)))) for n in (2000, 4000, 8000)}
    assert P.pipe_stego(table(spark, content(4000))).count() == 4000
    assert took[8000] < 3 * took[4000] + 1 and took[8000] < 15, took


def test_entropy(spark):
    rng = random.Random(4)
    data = [bytes(rng.randrange(k) for _ in range(n)) for k, n in ((256, 0), (256, 1), (1, 50), (2, 999), (256, 5000), (200, 64))] + ["üñ漢\n".encode() * 30]
    table = spark.createDataFrame([(k, x) for k, x in enumerate(data)], "k int, b binary")
    rows = table.select("k", byte_entropy(F.col("b")).alias("e")).collect() + entropies(table, ["k"], F.col("b")).withColumnRenamed("entropy", "e").collect()
    assert len(rows) == 2 * len(data)
    for r in rows:
        n = len(data[r.k])
        want = -sum(c / n * math.log2(c / n) for c in collections.Counter(data[r.k]).values()) if n else 0.0
        assert abs(r.e - want) < 1e-9
    took = {}
    for distinct in (2, 256):
        big = bytes(rng.randrange(distinct) for _ in range(400_000))
        took[distinct] = seconds(spark.createDataFrame([(big,)], "b binary").select(byte_entropy(F.col("b"))))
    assert took[256] < 4 * took[2] + 1, took


def packed(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, body in members:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    return out.getvalue()


def test_damaged_archives_end_as_members_or_reasons(spark):
    rng = random.Random(11)
    bodies = [(f"package/f{k}.js", bytes(rng.choice(b"abcdefghij \n") for _ in range(400))) for k in range(5)]
    whole, rows = packed(bodies), []
    for k in range(300):
        data = bytearray(whole)
        for _ in range(3):
            data[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
        rows.append((f"a{k}.tgz", bytes(data)))
    rows += [(f"cut{k}.tgz", whole[: len(whole) * k // 20]) for k in range(1, 20)] + [("junk.tgz", b"junk"), ("empty.tgz", b""), ("null.tgz", None), ("plain.tgz", gzip.compress(b"no tar")), ("fine.tgz", whole)]
    archives = spark.createDataFrame(rows, "path string, content binary").repartition(4)
    kept = collections.defaultdict(list)
    for r in archive_members(archives).collect():
        kept[r.archive].append((f"package/{r.path}", r.content.encode()))
    reasons = {r.archive: r.reason for r in damaged_archives(archives).collect()}
    assert set(kept) | set(reasons) | {"null.tgz"} == {name for name, _ in rows}
    assert kept["fine.tgz"] == bodies and "fine.tgz" not in reasons
    for k in range(1, 19):
        assert reasons[f"cut{k}.tgz"] and kept[f"cut{k}.tgz"] == bodies[: len(kept[f"cut{k}.tgz"])]
    assert all(x in reasons for x in ("junk.tgz", "empty.tgz", "plain.tgz"))


def test_archives_are_read_in_bounded_parts(spark):
    bomb = packed([("package/a.js", b"fine"), ("package/b.js", b"\0" * 3_000_000), ("package/c.js", b"never read")])
    archives = spark.createDataFrame([("bomb.tgz", bomb)], "path string, content binary")
    rows = unpacked(archives, most_bytes=1_000_000).collect()
    assert [(r.path, r.reason) for r in rows] == [("a.js", None), (None, "unpacks to more than 1000000 bytes")]
    assert [r.path for r in archive_members(archives).collect()] == ["a.js", "b.js", "c.js"]
