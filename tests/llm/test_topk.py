import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from copresence.llm import topk_search as K


def _plain(rows, k):
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(vectors):
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for m, (i, b) in enumerate(vectors) if m != n and len(a) == len(b))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def _rows(n, dims=8, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dims)]) for i in range(n)]
    same = rows[7][1]
    rows += [(n + i, same) for i in range(350)]
    rows += [(5000, None), (5001, [None] * dims), (5050, [math.nan] * dims), (5051, [math.inf] * dims), (5100, [1.0, 2.0]), (5101, [2.0, 1.0]), (None, same), (rows[3][0], rows[3][1])]
    rows += [(0, rows[1][1]), (0, rows[0][1]), (50, [rng.gauss(0, 3) for _ in range(dims)]), (100, same), (6000, []), (6001, []), (6050, [0.0])]
    rng.shuffle(rows)
    return rows


def _found(spark, rows, *more, k=5, extra=False):
    made = spark.createDataFrame([(*r, 1, 2, 3.0) for r in rows], "vec_id long, embedding array<double>, shard int, key int, v double") if extra else None
    made = made if extra else spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(tuple(r) for r in K.top_k(K.quantized(made), F.col("vec_id") % 50 == 0, k, *more).collect())


@pytest.mark.parametrize("sizes", [(16_384, 1024), (60, 3, (3, 7))])
def test_matches_brute_force(spark, sizes):
    """Repeated ids of equal and of other vectors, equal vectors of many rows, several lengths, columns with internal names."""
    rows = _rows(700)
    assert _found(spark, rows, *sizes, extra=True) == _plain(rows, 5)


def test_few_and_no_rows(spark):
    assert _found(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]
    assert _found(spark, [(0, [1.0])]) == [] and _found(spark, []) == [] and _found(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_large_components(spark):
    """Whole numbers beyond 64 bits are taken as they are; a score beyond 64 bits is an error."""
    rows = [(0, [0.0, 1 / 256]), (1, [1e17, 3 / 256]), (2, [1e300, -1.0])]
    got = _found(spark, rows)
    assert got == [(0, 1, 1, 3), (0, 2, 2, -256)] == [r for r in _plain(rows, 5)]
    v = K.quantized(spark.createDataFrame([(1, [1e17, -1e-20, -0.1, 3.999])], "vec_id long, embedding array<double>")).first().v
    assert v == [2.56e19, -1.0, -26.0, 1023.0]
    with pytest.raises(Exception, match="64 bits"):
        _found(spark, [(0, [1e17]), (1, [1e17])])


def test_exact_beyond_doubles():
    ids, v = np.arange(3), np.array([[2.0**27, 1.0], [2.0**27, 2.0], [2.0**27, -1.0]])
    key, found, score = K.Shard(ids, ids, v).search(np.array([0]), v[:1], np.array([-np.inf]), 2)
    assert found.tolist() == [1, 2] and score.tolist() == [2**54 + 2, 2**54 - 1]


def test_nodes_are_pruned():
    """A query whose kth score is shared looks at few of a shard's leaves."""
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(c, 3, (1000, 8)) for c in rng.normal(0, 200, (8, 8))]).round()
    ids = np.arange(len(v))
    shard, seen = K.Shard(ids, ids, v), []
    whole = K.Best.add
    K.Best.add = lambda self, at, scores, *more: (seen.append(scores.shape[1]), whole(self, at, scores, *more))[1]
    try:
        least = np.sort(v @ v[0])[-6:-5]
        shard.search(np.array([0]), v[:1], least, 5)
    finally:
        K.Best.add = whole
    assert sum(seen) < len(v) / 4


def test_bounds_hold():
    rng = np.random.default_rng(2)
    v, q = rng.integers(-200, 200, (500, 16)).astype(float), rng.integers(-200, 200, (20, 16)).astype(float)
    tree = K.BallTree(v, 32)
    bounds = tree.bounds(q)
    for node, (a, b) in enumerate(tree.rows):
        rows = tree.order[a:b]
        if tree.children[node] is None:
            assert (q @ v[rows].T).max(1).max() <= bounds[:, node].max() and ((q @ v[rows].T).max(1) <= bounds[:, node]).all()


def test_shards_of_a_large_pivot_have_balls_of_their_own(spark, monkeypatch):
    """Clusters that the first level leaves to two pivots are parted by the next ones: most shards are out of reach of most queries, where a
    hash leaves all of them in reach. Many copies of nearly one vector end in several shards all the same, and results are whole."""
    monkeypatch.setattr(K, "PIVOTS", 2)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (12, 8)) * 4
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.05, 8)).tolist()) for i in range(1200)]
    rows += [(2000 + i, (centres[0] + rng.normal(0, 1e-2, 8)).tolist()) for i in range(300)]
    base = K.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).select("vec_id", "v", (F.col("vec_id") % 50 == 0).alias("asks"), F.monotonically_increasing_id().alias("key"))
    base = base.checkpoint()
    placed = K._dealt(base, 120).collect()
    assert sorted(r.vec_id for r in placed) == sorted(i for i, _ in rows)
    shards = {}
    for r in placed:
        shards.setdefault(r.shard, []).append(r.v)
    assert max(map(len, shards.values())) <= 240 and len(shards) >= 13
    vectors = np.array([r.v for r in placed])

    def reached(groups):
        centre = np.array([np.mean(g, 0) for g in groups])
        radius = np.array([np.sqrt(((np.array(g) - c) ** 2).sum(1).max()) for g, c in zip(groups, centre, strict=True)])
        queries = np.array([r.v for r in placed if r.asks])
        kth = np.sort(queries @ vectors.T, 1)[:, -5]
        return (K.ball_bounds(queries, centre, radius) >= kth[:, None]).mean()

    by_hash = np.array_split(vectors[rng.permutation(len(vectors))], len(shards))
    assert reached(by_hash) > 0.9 and reached([np.array(g) for g in shards.values()]) < 0.4
    assert _found(spark, rows, 120, 7) == _plain(rows, 5)
