import numpy as np
import pytest

from threatlake.llm.neighbours import VantageTree, nearest

SCHEMA = "vec_id long, embedding array<float>, label string, rank string, score string, key string, shard string"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, "l", "r", "s", "k", "h") for i, v in rows], schema)


def clean(rows):
    return [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]


def distance(a, b):
    total = 0.0
    for x, y in zip(a.tolist(), b.tolist()):
        total += (x - y) ** 2
    return float(np.sqrt(total))


def brute(rows, asks, k=10):
    fine, out = clean(rows), []
    for n, (q, v) in enumerate(fine):
        if asks(q):
            near = sorted((distance(v, w), i) for m, (i, w) in enumerate(fine) if m != n and len(w) == len(v))[:k]
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return sorted(out)


def corpus(seed=3):
    rng = np.random.default_rng(seed)
    f = lambda v: [float(np.float32(x)) for x in v]
    centres = rng.normal(size=(6, 8)) * 4
    rows = [(k, f(centres[k % 6] + rng.normal(size=8))) for k in range(900)]
    rows += [(2000 + k, rows[7][1]) for k in range(400)]  # a third of all rows are one vector
    rows += [(3000, None), (3100, []), (3200, [0.0] * 8), (3300, [1.0, None] * 4), (3400, [1.0, float("nan")] * 4), (3500, [float("inf")] * 8), (None, rows[1][1])]
    rows += [(4000 + k, f(rng.normal(size=3))) for k in range(5)] + [(100, rows[100][1]), (200, rows[3][1]), (5, rows[100][1])]
    return rows


@pytest.mark.parametrize("shards", [1, 7])
def test_factor_one_is_exact(spark, shards):
    rows = corpus()
    t = table(spark, rows).repartition(3)
    found = nearest(t, t.where("vec_id % 100 = 0"), shards=shards).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == brute(rows, lambda q: q % 100 == 0)


def test_greater_factors_prune_and_keep_recall():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 5
    points = centres[rng.integers(0, 40, 20_000)] + rng.normal(size=(20_000, 16))
    tree, queries = VantageTree(points, np.arange(len(points)), 11), points[::100]
    exact, cost = {}, {}
    for factor in (1.0, 2.0, 4.0):
        q, ids, _, seen = tree.search(queries, 10, np.full(len(queries), np.inf), factor)
        exact[factor], cost[factor] = set(zip(q.tolist(), ids.tolist())), seen
    d = np.linalg.norm(queries[:, None] - points[None], axis=2)
    true = {(k, int(i)) for k in range(len(queries)) for i in np.argsort(d[k], kind="stable")[:10]}
    assert exact[1.0] == true
    assert cost[4.0] < cost[2.0] < cost[1.0] < len(queries) * len(points) / 2
    assert len(exact[2.0] & true) >= 0.9 * len(true)


def test_odd_tables(spark):
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (7, [3.0, 4.0])]
    t = table(spark, rows)
    found = nearest(t, t.where("vec_id % 100 = 0")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == brute(rows, lambda q: q % 100 == 0)
    assert nearest(t.limit(0), t.limit(0)).count() == 0 and nearest(t, t.where("vec_id < 0")).count() == 0
    alone = t.where("vec_id = 0")
    assert nearest(alone, alone).count() == 0
    huge = table(spark, [(0, [1e200, 1.0]), (1, [-1e200, 1.0]), (2, [1e200, 2.0])], SCHEMA.replace("float", "double"))
    near = nearest(huge, huge.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in near] == [(2, 1.0), (1, float("inf"))]
