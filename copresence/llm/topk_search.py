"""Exact top-k inner products by ball trees, one a shard, with branch and bound.

Vectors are whole numbers. Equal vectors are thinned to the k + 1 rows that any query can have among its best. The rest are dealt to shards
by nearest pivot; what a pivot has beyond a shard is dealt again by nearest pivots of its own, level by level, so that the shards of a pivot
have balls of their own. Only vectors that LEVELS levels cannot part are dealt by a hash. In a first pass each shard's tree is searched for the shard's
own queries, which gives each query a kth score to start from. In a second one queries go to those other shards only whose root ball can
reach that score; they stream past the shard's tree in bounded blocks. Nodes are taken in the order of their inner-product upper bound
q.c + |q| r over the block, and a query enters a node only if its bound reaches the query's kth score so far.

The base is shuffled once a pass, and a tree built once a pass, however many queries there are. Queries with equal vectors that are
not among the thinned rows have equal results and are searched once.

Defined results: null vectors and vectors with null or non-finite components take no part; nor do null ids. Vectors are compared only
with vectors of their own length; an empty vector scores 0. A row is no candidate for itself only: other rows of its id, equal ones too,
are. A query with a repeated id gives the results of each of its rows. Equal scores go to the smaller id, and among rows of one id and
score it does not matter which. Fewer candidates than k give all. Scores beyond 64 bits raise an error. Extra columns of any names are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copresence.llm.common import table, written

SCALE = 256
SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 16_384, 1_024, 128
#: At most so many pivots of each length of vector, from a sample of so many times as many rows.
PIVOTS, PIVOT_SAMPLE = 128, 8
#: Levels of pivots below the first. Each has at most PIVOTS for a pivot of the level above.
LEVELS = 4
#: So many times a shard's vectors are dealt to a task of a level.
DEALT_SHARDS = 8


def quantized(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, as doubles (whole numbers of any size), without rows that take no part."""
    scaled = lambda c: c.cast("double") * F.lit(float(scale))
    whole = lambda y: F.rint(y - y % F.lit(1.0))  # noqa: E731  F.floor gives 64 bits
    floor = lambda y: whole(y) - F.when(whole(y) > y, 1.0).otherwise(0.0)
    fine = F.forall(F.col(embedding), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(scaled(c)) < float("inf")))
    kept = vectors.filter(F.col(embedding).isNotNull() & F.col(vec_id).isNotNull() & fine)
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(embedding), lambda c: floor(scaled(c)) + F.lit(0.0)).alias("v"))


class BallTree:
    """Balls in one list, children behind their parents; leaves hold rows first:last of the ordered vectors."""

    def __init__(self, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(vectors))
        self.centre, self.radius, self.children, self.rows = [], [], [], []
        self._grow(vectors, leaf_rows)
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def _grow(self, vectors, leaf_rows) -> None:
        waiting = [(0, len(vectors), None, 0)]
        while waiting:
            first, last, parent, side = waiting.pop()
            mine = vectors[self.order[first:last]]
            centre = mine.mean(0)
            with np.errstate(over="ignore"):
                away = ((mine - centre) ** 2).sum(1)
            node = len(self.centre)
            self.centre.append(centre)
            self.radius.append(float(np.sqrt(away.max(initial=0))))
            self.children.append(None)
            self.rows.append((first, last))
            if parent is not None:
                self.children[parent][side] = node
            if last - first > leaf_rows and self.radius[-1] > 0:
                one = mine[away.argmax()]
                two = mine[((mine - one) ** 2).sum(1).argmax()]
                half = (last - first) // 2
                split = np.argpartition(mine @ (two - one), half)
                self.order[first:last] = self.order[first:last][split]
                self.children[node] = [0, 0]
                waiting += [(first, first + half, node, 0), (first + half, last, node, 1)]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return ball_bounds(queries, self.centre, self.radius)


def ball_bounds(queries: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Upper bounds of inner products, queries x balls, rounded up; infinite where doubles overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((queries**2).sum(1))[:, None]
        reach = queries @ centre.T + norm * radius[None, :]
        bounds = reach + 1e-9 * (np.abs(reach) + norm * np.sqrt((centre**2).sum(1))[None, :]) + 1e-6
    return np.where(np.isnan(bounds), np.inf, bounds)


class Best:
    """The k best (score, smaller id) of each query of a block. Rows of vectors have keys of their own, and none is found by itself."""

    def __init__(self, keys: np.ndarray, k: int, least: np.ndarray):
        self.keys, self.k, self.floor, self.least = keys, k, least.astype(float), least.astype(float)
        self.score = np.full((len(keys), k), -np.inf)
        self.found = np.full((len(keys), k), np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        s = np.where(keys[None, :] == self.keys[at][:, None], -np.inf, scores)
        if s.shape[1] > self.k:  # what reaches the kth score, ties included
            edge = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
            keep = (s >= np.maximum(edge, self.least[at])[:, None]).any(0)
            s, ids = s[:, keep], ids[keep]
        s = np.concatenate([self.score[at], s], 1)
        i = np.concatenate([self.found[at], np.broadcast_to(ids, (len(at), len(ids)))], 1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[at], self.found[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        self.least[at] = np.maximum(self.least[at], self.score[at, -1])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key of the query, vec_id, score) of what can be among the k best of all shards: nothing below the score that was shared."""
        row, column = np.nonzero(np.isfinite(self.score) & (self.score >= self.floor[:, None]))
        return self.keys[row], self.found[row, column], self.score[row, column].astype(np.int64)


class Shard:
    """Ids, keys and vectors of a shard, with its ball tree."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, vectors: np.ndarray):
        self.ids, self.keys, self.vectors = ids, keys, vectors
        self.tree = BallTree(vectors)
        self.most = np.abs(vectors).max(initial=0)

    def search(self, keys: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query of a block, none below `least`. Nodes wait in the order of the best bound that a query has for them."""
        best = Best(keys, k, least)
        if self.most * np.abs(queries).max(initial=0) * max(1, queries.shape[1]) >= 2**53:
            return self._search_plainly(keys, queries, k)
        tree, bounds = self.tree, self.tree.bounds(queries)
        everyone = np.arange(len(keys))
        waiting = [(-bounds[:, 0].max(), 0, everyone)]
        while waiting:
            _, node, at = heapq.heappop(waiting)
            at = at[bounds[at, node] >= best.least[at]]
            if not len(at):
                continue
            if tree.children[node] is None:
                rows = tree.order[slice(*tree.rows[node])]
                best.add(at, queries[at] @ self.vectors[rows].T, self.ids[rows], self.keys[rows])
                continue
            for child in tree.children[node]:
                heapq.heappush(waiting, (-bounds[at, child].max(), child, at))
        return best.rows()

    def _search_plainly(self, keys, queries, k):
        """For components too large for exact products of doubles: products of whole numbers of any size."""
        whole = np.array([[int(x) for x in v] for v in self.vectors], object).reshape(self.vectors.shape)
        out = []
        for key, q in zip(keys.tolist(), queries, strict=True):
            scores = whole @ np.array([int(x) for x in q], object)
            ranked = sorted((-s, i) for s, i, other in zip(scores, self.ids.tolist(), self.keys.tolist(), strict=True) if other != key)
            for s, i in ranked[:k]:
                if not -(2**63) <= -s < 2**63:
                    raise OverflowError("a score does not fit 64 bits")
                out.append((key, i, int(-s)))
        return tuple(np.array([r[c] for r in out], np.int64) for c in range(3))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows sorted by their first column, in pieces of one value each."""
    for b in batches:
        group = b.column(0).to_numpy()
        if len(group):
            at = np.append(0, np.flatnonzero(group[1:] != group[:-1]) + 1)
            for first, last in zip(at.tolist(), [*at[1:].tolist(), len(group)], strict=True):
                yield int(group[first]), b.slice(first, last - first)


FOUND = "key long, vec_id long, score long"
TREES = "shard long, kind byte, key long, vec_id long, score long, dim int, centre array<double>, radius double"


def _trees(k: int, every: int):
    """(shard, key, vec_id, v, asks), sorted by shard -> the root ball of each shard, and what its own queries find in it."""

    def finished(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        key, ids, asks = (rows.column(c).to_numpy() for c in ("key", "vec_id", "asks"))
        vectors = _matrix(rows.column("v").combine_chunks())
        here = Shard(ids, key, vectors)
        out = [[], [], []]
        own = np.flatnonzero(asks)
        for at in range(0, len(own), every):
            some = own[at : at + every]
            for c, v in zip(out, here.search(key[some], vectors[some], np.full(len(some), -np.inf), k), strict=True):
                c.append(v)
        q, i, s = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
        n = len(q)
        none = [None] * n
        return pa.RecordBatch.from_arrays(
            [
                pa.array([shard] * (n + 1), pa.int64()), pa.array([0] + [1] * n, pa.int8()), pa.array([None, *q.tolist()], pa.int64()), pa.array([None, *i.tolist()], pa.int64()),
                pa.array([None, *s.tolist()], pa.int64()), pa.array([vectors.shape[1]] * (n + 1), pa.int32()), pa.array([here.tree.centre[0].tolist(), *none], pa.list_(pa.float64())),
                pa.array([here.tree.radius[0], *none], pa.float64()),
            ],
            ["shard", "kind", "key", "vec_id", "score", "dim", "centre", "radius"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for shard, rows in _runs(batches):
            if shard != now and parts:
                yield finished(now, parts)
                parts = []
            now = shard
            parts.append(rows)
        if parts:
            yield finished(now, parts)

    return run


def _streamed(load, answer, every: int):
    """Rows sorted by group and `asks` -> for each group, load() of the rows that do not ask, and answer() of it and the others, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, here, waiting = None, [], None, []
        whole = lambda rows: pa.Table.from_batches(rows).combine_chunks().to_batches()[0]

        def flush():
            rows = whole(waiting)
            waiting.clear()
            for at in range(0, rows.num_rows, every):
                yield answer(here, rows.slice(at, every))

        for group, rows in _runs(batches):
            if group != now:
                if waiting:
                    yield from flush()
                now, parts, here = group, [], None
            asks = rows.column(1).to_numpy(zero_copy_only=False)
            n = int(np.searchsorted(asks, True))
            if n:
                parts.append(rows.slice(0, n))
            if n < len(asks) and (parts or here is not None):
                if here is None:
                    here, parts = load(whole(parts)), []
                waiting.append(rows.slice(n))
                if sum(w.num_rows for w in waiting) >= every:
                    yield from flush()
        if waiting:
            yield from flush()

    return run


QUERIES = "asks boolean, key long, v array<double>, least double"


def _routed():
    """(slot, asks, shard, radius, key, v, least), v the centre of a shard's root ball or a query -> the queries for each shard that they may
    find something in. A query does not go to its own shard."""

    def load(rows: pa.RecordBatch):
        return rows.column("shard").to_numpy(), rows.column("radius").to_numpy(), _matrix(rows.column("v"))

    def answer(balls, rows: pa.RecordBatch) -> pa.RecordBatch:
        shard, radius, centre = balls
        home = rows.column("shard").to_numpy()
        bounds = ball_bounds(_matrix(rows.column("v")), centre, radius)
        row, to = np.nonzero((bounds >= rows.column("least").to_numpy()[:, None]) & (shard[None, :] != home[:, None]))
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([pa.array(shard[to]), *(rows.column(c).take(take) for c in ("asks", "key", "v", "least"))], ["shard", "asks", "key", "v", "least"])

    return _streamed(load, answer, 256)


def _searched(k: int, every: int):
    """(shard, asks, vec_id, key, v, least): a shard's vectors and then the queries that come to it -> what they find."""

    def load(rows: pa.RecordBatch) -> Shard:
        return Shard(rows.column("vec_id").to_numpy(), rows.column("key").to_numpy(), _matrix(rows.column("v")))

    def answer(here: Shard, rows: pa.RecordBatch) -> pa.RecordBatch:
        found = here.search(rows.column("key").to_numpy(), _matrix(rows.column("v")), rows.column("least").to_numpy(), k)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["key", "vec_id", "score"])

    return _streamed(load, answer, every)


def _dealt(base: DataFrame, shard_rows: int) -> DataFrame:
    """base with `shard`: the nearest pivot of the vector's length, of that pivot's own where it has more than shard_rows vectors, and so on.
    Pivots come from bounded samples, by a hash of the key."""
    sizes = {r.dim: r.n for r in base.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    most = PIVOTS * PIVOT_SAMPLE
    sample = base.filter(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(max(1, total // most))) == 0).select(F.size("v").alias("dim"), "v").limit(4 * most).collect()
    pivots: dict[int, np.ndarray] = {}
    for dim, n in sizes.items():
        mine = [r.v for r in sample if r.dim == dim][: max(1, min(PIVOTS, n // shard_rows))]
        pivots[dim] = np.unique(np.array(mine, float).reshape(len(mine), dim), axis=0)
    number = {dim: i << 20 for i, dim in enumerate(sorted(pivots))}
    shared = base.sparkSession.sparkContext.broadcast((pivots, number))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, number = shared.value
        for b in batches:
            column = b.column(b.schema.names.index("v"))
            dims = np.diff(column.offsets.to_numpy())
            out = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                out[at] = number.get(dim, 0)
                if dim in pivots and len(pivots[dim]) > 1:
                    p, v = pivots[dim], _matrix(column.take(pa.array(at)))
                    out[at] += ((p**2).sum(1)[None, :] - 2 * v @ p.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "pivot"])

    schema = f"{base.schema.simpleString()[7:-1]}, pivot: bigint"
    placed = written(base.mapInArrow(nearest, schema))
    done, level, columns = [], 0, placed.columns
    while True:
        counts = placed.groupBy("pivot").agg(F.count("*").alias("n"), F.min("key").alias("some_key"))
        large = counts.filter(F.col("n") > shard_rows)
        if level == LEVELS or large.isEmpty():
            break
        level += 1
        large = written(large)
        done.append(placed.join(large, "pivot", "left_anti").select(*columns))
        placed = written(_parted(placed.join(large, "pivot"), shard_rows, level).select(*columns))
    rest = placed.join(counts.select("pivot", F.ceil(F.col("n") / F.lit(shard_rows)).alias("parts")), "pivot")
    shards = rest.withColumn("shard", F.xxhash64("pivot", F.pmod(F.xxhash64("key"), F.col("parts")))).drop("pivot", "parts")
    for rows in done:
        shards = shards.unionByName(rows.withColumn("shard", F.xxhash64("pivot", F.lit(0).cast("long"))).drop("pivot"))
    return shards


def _parted(rows: DataFrame, shard_rows: int, level: int) -> DataFrame:
    """rows(vec_id, v, asks, key, pivot, n, some_key), n: the vectors of the pivot -> (vec_id, v, asks, key, pivot), with the pivot of the next level.
    The new pivots, twice as many as shards are needed, are a sample by a hash of the key, or some_key's vector where that is empty. A
    pivot of very many vectors is dealt to several tasks, each of which has all of its new pivots."""
    most = F.least(F.lit(PIVOTS), F.ceil(F.lit(2.0) * F.col("n") / F.lit(shard_rows))).cast("int")
    draw = F.xxhash64("key", F.lit(10 + level))
    drawn = rows.withColumns({"most": most, "draw": draw}).filter((F.pmod("draw", F.greatest(F.lit(1), F.floor(F.col("n") / (F.col("most") * PIVOT_SAMPLE)))) == 0) | (F.col("key") == F.col("some_key")))
    first = F.row_number().over(Window.partitionBy("pivot").orderBy("draw", "key"))
    tasks = F.ceil(F.col("n") / F.lit(DEALT_SHARDS * shard_rows))
    new = drawn.withColumn("sub", first).filter(F.col("sub") <= F.col("most")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    pivots = new.select(F.xxhash64("pivot", "part").alias("slot"), F.lit(False).alias("dealt"), none("long").alias("vec_id"), "v", none("boolean").alias("asks"), none("long").alias("key"), F.xxhash64("pivot", F.lit(level), "sub").alias("pivot"))
    slot = F.xxhash64("pivot", F.pmod(F.xxhash64("key"), tasks))
    going = rows.select(slot.alias("slot"), F.lit(True).alias("dealt"), "vec_id", "v", "asks", "key", "pivot")

    def load(here: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return here.column("pivot").to_numpy(), _matrix(here.column("v"))

    def answer(here: tuple[np.ndarray, np.ndarray] | None, some: pa.RecordBatch) -> pa.RecordBatch:
        names, p = here
        away = (p**2).sum(1)[None, :] - 2 * _matrix(some.column("v")) @ p.T
        return pa.RecordBatch.from_arrays([*(some.column(c) for c in ("vec_id", "v", "asks", "key")), pa.array(names[away.argmin(1)])], ["vec_id", "v", "asks", "key", "pivot"])

    met = pivots.unionByName(going).repartition("slot").sortWithinPartitions("slot", "dealt", F.col("pivot"))
    return met.mapInArrow(_streamed(load, answer, BLOCK_ROWS), "vec_id long, v array<double>, asks boolean, key long, pivot long")


def top_k(rows: DataFrame, asks: Column, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, slot_rows: tuple[int, int] = (4096, 8192)) -> DataFrame:
    """rows(vec_id, v), asks: which of them are queries -> (query_id, rank, vec_id, score). slot_rows: root balls and queries, about, that
    a task of the routing takes together."""
    numbered = written(rows.select("vec_id", "v", F.coalesce(asks, F.lit(False)).alias("asks")).withColumn("key", F.monotonically_increasing_id()))
    # of equal vectors a query can have the k smallest ids among its best, and one more in place of itself
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id", "key"))
    thinned = numbered.withColumn("place", place).filter(F.col("place") <= k + 1).drop("place")
    base = written(_dealt(written(thinned), shard_rows))
    trees = written(base.select("shard", "key", "vec_id", "v", "asks").repartition("shard").sortWithinPartitions("shard").mapInArrow(_trees(k, block_rows), TREES))
    own = trees.filter("kind = 1").select("key", "vec_id", "score")
    never, nowhere = F.lit(float("-inf")), F.lit(0).cast("long")
    kth = own.groupBy("key").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("least"))
    first = base.filter("asks").join(kth, "key", "left").select("key", "v", "shard", F.coalesce("least", never).alias("least"))
    # queries whose vectors were thinned out: one for each vector stands for all
    others = numbered.filter("asks").join(base.select("key"), "key", "left_anti")
    stand_in = written(others.groupBy("v").agg(F.min("key").alias("stands")))
    queries = first.unionByName(stand_in.select(F.col("stands").alias("key"), "v", nowhere.alias("shard"), never.alias("least")))
    # root balls and queries meet in slots: each query meets each block of balls once
    roots = trees.filter("kind = 0").select("shard", "dim", F.col("centre").alias("v"), "radius")
    blocks = max(1, -(-roots.count() // slot_rows[0]))
    parts = max(1, -(-numbered.filter("asks").count() // slot_rows[1]))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda n: F.pmod(F.xxhash64(*n[0]), F.lit(n[1])).cast("int")
    slot = F.xxhash64("dim", "block", "part").alias("slot")
    balls = roots.withColumn("block", of((["shard"], blocks))).withColumn("part", every(parts))
    balls = balls.select(slot, F.lit(False).alias("asks"), "shard", "radius", nowhere.alias("key"), "v", never.alias("least"))
    going = queries.withColumns({"dim": F.size("v"), "part": of((["key"], parts))}).withColumn("block", every(blocks))
    going = going.select(slot, F.lit(True).alias("asks"), "shard", F.lit(0.0).alias("radius"), "key", "v", "least")
    sent = balls.unionByName(going).repartition("slot").sortWithinPartitions("slot", "asks").mapInArrow(_routed(), f"shard long, {QUERIES}")
    there = base.select("shard", F.lit(False).alias("asks"), "vec_id", "key", "v", never.alias("least"))
    met = there.unionByName(sent.select("shard", "asks", nowhere.alias("vec_id"), "key", "v", "least")).repartition("shard").sortWithinPartitions("shard", "asks")
    found = own.unionByName(met.mapInArrow(_searched(k, block_rows), FOUND))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    named = base.filter("asks").select("key", F.col("vec_id").alias("query_id")).unionByName(
        others.join(stand_in, "v").select(F.col("stands").alias("key"), F.col("vec_id").alias("query_id"))
    )
    return best.join(named, "key").select("query_id", "rank", "vec_id", "score")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for every vector whose id is divisible by 50."""
    return top_k(quantized(table(spark, sf_dir, "embeddings", "vec_id", "embedding")), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH q AS (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
),
p AS (
  SELECT a.k, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.k <> b.k
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS r FROM p) WHERE r <= 5
"""
