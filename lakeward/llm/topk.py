"""Exact inner-product top-k by ball trees, one for each shard of the vectors.

Copies of a vector are one point with its smallest ids. Points are dealt into shards by
a tree of splits over a sample, so a shard is a region and has a ball of its
own; a region that holds too many points is divided by a hash. The ball tree of a shard
is built once and written down.

Queries go to the shards in rounds, first to the one with the largest upper bound
(product with the ball's centre plus the query's length times its radius), then to a few
more, then to all that are left. After each round a query takes its k-th score so far
to every later shard, and a shard whose bound is below it is not asked at all: only
pairs of a query and a shard that may still matter are shuffled, and no vector is. In a
shard's tree the queries of a block descend together, each into the child with the
larger bound first, and leave a subtree whose bound is below their k-th score.

Nulls and ties: a vector that is null, or holds a null or non-finite component, takes
no part; equal scores rank by smaller vec_id; a null vec_id takes no part; rows that
repeat a vec_id are candidates each, and a query once. A query has fewer rows where
there are fewer candidates. Vectors of another length than the query's count as
zero-padded. An empty table gives no rows. Only vec_id and embedding are read besides
what ``is_query`` names, so other columns may have any name.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeward.llm.shared import discard, stored

LEAF = 64
SHARD_ROWS = 8_192
#: Queries that one task takes to a shard together.
BLOCK_ROWS = 8_192
#: Shards at most, whose balls every task holds: beyond, shards grow.
MOST_SHARDS = 50_000
#: Points that the regions are split by, and the fewest of them in a region.
SAMPLE, SAMPLE_IN_REGION = 16_384, 8
#: Shards that a query has been to after each round but the last.
ROUNDS = (1, 8)
_EXACT = 2.0**53


class BallTree:
    """Points in an array, split at the median of their widest coordinate."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points, self.order = points, np.arange(len(points))
        self.nodes: list[tuple[int, int, np.ndarray, float, int, int]] = []
        if len(points):
            self._grow(0, len(points), leaf)

    def _grow(self, lo: int, hi: int, leaf: int) -> int:
        x = self.points[self.order[lo:hi]].astype(np.float64)
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
        at = len(self.nodes)
        self.nodes.append((lo, hi, centre, radius, -1, -1))
        spread = x.max(axis=0) - x.min(axis=0)
        if hi - lo > leaf and spread.max() > 0:
            mid = (hi - lo) // 2
            part = np.argpartition(x[:, int(spread.argmax())], mid)
            self.order[lo:hi] = self.order[lo:hi][part]
            self.nodes[at] = (lo, hi, centre, radius, self._grow(lo, lo + mid, leaf), self._grow(lo + mid, hi, leaf))
        return at


def upper(product: np.ndarray, length: np.ndarray, radius: np.ndarray | float) -> np.ndarray:
    """A bound of the products with all points of a ball, rounding included."""
    reach = product + length * radius
    return reach + 1e-9 * (np.abs(product) + length * radius + 1)


class Shard:
    """A shard's different points, the ids of each, and their ball tree."""

    def __init__(self, points: np.ndarray, ids: list[list[int]]) -> None:
        self.points, self.ids = points, ids
        self.tree = BallTree(points)

    def ball(self) -> tuple[np.ndarray, float]:
        _, _, centre, radius, _, _ = self.tree.nodes[0]
        return centre, radius


class Search:
    """Best k of one shard for a block of queries."""

    def __init__(self, shard: Shard, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.copies, self.k, self.own, self.tree = shard.ids, k, own, shard.tree
        size = max(shard.points.shape[1], queries.shape[1])
        points, queries = (np.pad(a, ((0, 0), (0, size - a.shape[1]))) for a in (shard.points, queries))
        self.size = size
        largest = max((float(np.abs(a).max()) for a in (points, queries) if a.size), default=0.0)
        exact = largest * largest * max(1, size) < _EXACT
        self.points, self.queries = (points.astype(np.float64), queries.astype(np.float64)) if exact else (points, queries)
        self.plain = queries.astype(np.float64)
        self.length = np.sqrt((self.plain**2).sum(axis=1))
        self.floor = floor.astype(np.float64)
        self.best: list[list[tuple[int, int]]] = [[] for _ in range(len(queries))]
        self._visit(0, np.arange(len(queries)))

    def _bound(self, node: int, which: np.ndarray) -> np.ndarray:
        _, _, centre, radius, _, _ = self.tree.nodes[node]
        return upper(self.plain[which, : len(centre)] @ centre, self.length[which], radius)

    def _visit(self, node: int, which: np.ndarray) -> None:
        which = which[self._bound(node, which) >= self.floor[which]]
        if not len(which):
            return
        lo, hi, _, _, left, right = self.tree.nodes[node]
        if left < 0:
            self._leaf(self.tree.order[lo:hi], which)
            return
        nearer = self._bound(left, which) >= self._bound(right, which)
        for child, part in ((left, which[nearer]), (right, which[nearer]), (right, which[~nearer]), (left, which[~nearer])):
            if len(part):
                self._visit(child, part)

    def _leaf(self, at: np.ndarray, which: np.ndarray) -> None:
        scores = self.queries[which] @ self.points[at].T
        for row, q in enumerate(which.tolist()):
            line, best, own = scores[row], self.best[q], int(self.own[q])
            for j in np.flatnonzero(line >= self.floor[q]).tolist():
                score, taken = int(line[j]), 0
                for vec in self.copies[at[j]]:  # by id: later copies rank behind
                    if vec != own:
                        best.append((-score, vec))
                        taken += 1
                        if taken == self.k:
                            break
            best.sort()
            del best[self.k :]
            if len(best) == self.k:
                self.floor[q] = max(self.floor[q], -best[-1][0])


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and its components as floor(scale * x); only vectors that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    return vectors.where(x.isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long"), whole.alias("v"))


def _grid(vectors: list, size: int = 0) -> np.ndarray:
    size = max([size, *map(len, vectors)])
    out = np.zeros((len(vectors), size), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Regions:
    """Splits of a sample at the coordinate of most variance: a leaf is a region."""

    def __init__(self, sample: np.ndarray, least: int) -> None:
        self.splits: list[tuple[int, float, int, int] | int] = []
        self.count = 0
        self._grow(sample, max(1, least))

    def _grow(self, x: np.ndarray, least: int) -> int:
        at = len(self.splits)
        self.splits.append(0)
        spread = x.var(axis=0) if len(x) else np.zeros(1)
        if len(x) >= 2 * least and spread.max() > 0:
            column = int(spread.argmax())
            value = x[:, column]
            cut = float(value.mean())  # tells clusters apart; a median where it cuts off few
            if not len(x) < 20 * (value < cut).sum() < 19 * len(x):
                cut = float(np.median(value))
                cut = cut if cut > value.min() else float(np.nextafter(cut, np.inf))
            low = value < cut
            self.splits[at] = (column, cut, self._grow(x[low], least), self._grow(x[~low], least))
        else:
            self.splits[at] = self.count
            self.count += 1
        return at

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            at, which = waiting.pop()
            split = self.splits[at]
            if isinstance(split, int):
                out[which] = split
                continue
            column, cut, low, high = split
            value = x[which, column] if column < x.shape[1] else np.zeros(len(which))
            waiting += [(low, which[value < cut]), (high, which[value >= cut])]
        return out


def _points(whole: DataFrame, k: int) -> DataFrame:
    """v and ids: the different vectors with their k + 1 smallest ids."""
    order = Window.partitionBy("v").orderBy("vec_id")
    least = whole.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    return least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _placed(points: DataFrame, regions: Regions, shard_rows: int) -> DataFrame:
    """``points`` with their shard: a region, or a part of one with too many points."""
    held = points.sparkSession.sparkContext.broadcast(regions)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("region", pa.array(held.value.of(_grid(batch.column("v").to_pylist()))))

    routed = stored(points.mapInArrow(route, "v array<bigint>, ids array<bigint>, region long"), "points")
    sizes = routed.groupBy(F.col("region").alias("r")).agg(F.ceil(F.count("*") / shard_rows).alias("parts"))  # a row for each region
    part = F.pmod(F.xxhash64("v"), F.col("parts"))
    return routed.join(F.broadcast(sizes), F.col("region") == F.col("r")).select("v", "ids", F.concat_ws("-", "region", part).alias("shard"))


def _built(points: DataFrame) -> DataFrame:
    """shard, centre, radius and tree: each shard with its ball tree, written down."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(_grid(list(rows.v)), [list(map(int, i)) for i in rows.ids])
        centre, radius = shard.ball()
        return pd.DataFrame({"shard": [rows.shard.iloc[0]], "centre": [centre], "radius": [radius], "tree": [pickle.dumps(shard)]})

    return stored(points.groupBy("shard").applyInPandas(build, "shard string, centre array<double>, radius double, tree binary"), "trees")


def _asked(queries: DataFrame, balls: pd.DataFrame, done: int, upto: int) -> DataFrame:
    """shard, query_id, v, floor: the pairs of a query (query_id, v, floor) and the
    shards from place ``done`` to ``upto`` in its order of bounds that may still matter."""
    centres = balls.centre.tolist()
    size = max(map(len, centres))
    table = np.array([np.pad(c, (0, size - len(c))) for c in centres])
    held = queries.sparkSession.sparkContext.broadcast((balls.shard.to_numpy(), table, balls.radius.to_numpy()))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, centres, radius = held.value
        step = max(1, 2_000_000 // len(names))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                x = _grid(batch.column("v").to_pylist(), centres.shape[1]).astype(np.float64)
                bound = upper(x[:, : centres.shape[1]] @ centres.T, np.sqrt((x**2).sum(axis=1))[:, None], radius[None, :])
                place = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
                floor = batch.column("floor").to_numpy()
                query, shard = np.nonzero((place >= done) & (place < upto) & (bound >= floor[:, None]))
                for at in range(0, len(query), 5_000):
                    part = batch.take(pa.array(query[at : at + 5_000]))
                    yield part.append_column("shard", pa.array(names[shard[at : at + 5_000]], pa.string()))

    return queries.select("query_id", "v", "floor").mapInArrow(pair, "query_id long, v array<bigint>, floor double, shard string")


def _searched(trees: DataFrame, pairs: DataFrame, k: int, block_rows: int) -> DataFrame:
    def cell(tree: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(tree) and len(block):
            own = block.query_id.to_numpy()
            found = Search(pickle.loads(tree.tree.iloc[0]), _grid(list(block.v)), own, block.floor.to_numpy(), k)
            out = [(int(q), vec, -score) for q, best in zip(own, found.best, strict=True) for score, vec in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    pairs = stored(pairs, "pairs")
    blocks = pairs.groupBy(F.col("shard").alias("s")).agg(F.ceil(F.count("*") / block_rows).alias("blocks"))  # a row for each shard
    named = pairs.join(F.broadcast(blocks), F.col("shard") == F.col("s")).withColumn("block", F.pmod(F.xxhash64("query_id", "v"), F.col("blocks")))
    held = trees.join(F.broadcast(blocks), F.col("shard") == F.col("s")).select("shard", "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    return held.groupBy("shard", "block").cogroup(named.groupBy("shard", "block")).applyInPandas(cell, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best for each row of ``is_query``."""
    spark = vectors.sparkSession
    whole = quantised(vectors)
    points = stored(_points(whole, k), "distinct")
    n = points.count()
    shard_rows = max(shard_rows, -(-n // MOST_SHARDS))
    # A sample of at most about SAMPLE points makes the regions; it decides how the work
    # is dealt, not what is found.
    share = F.pmod(F.xxhash64("v", F.lit(3)), F.lit(1 << 30)).cast("double") / float(1 << 30) < SAMPLE / max(1, n)
    sample = _grid([r["v"] for r in points.where(share).select("v").collect()]).astype(np.float64)
    least = max(SAMPLE_IN_REGION, len(sample) * shard_rows // max(1, n) // 2 + 1)
    trees = _built(_placed(points, Regions(sample, least), shard_rows))
    balls = trees.select("shard", "centre", "radius").orderBy("shard").toPandas()  # MOST_SHARDS bounds it
    asked = whole.where(is_query).select(F.col("vec_id").alias("query_id"), "v").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = None
    queries = asked.withColumn("floor", F.lit(float("-inf")))
    bounds = [b for b in rounds if b < len(balls)] + [len(balls)]
    for done, upto in zip([0, *bounds], bounds, strict=False):
        if not len(balls):
            break
        found = _searched(trees, _asked(queries, balls, done, upto), k, block_rows)
        every = found if best is None else found.unionByName(best.drop("rank"))
        before, best = best, stored(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
        if before is not None:
            discard(spark, before)
        kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("score").cast("double").alias("kth"))
        queries = asked.join(kth, F.col("query_id") == F.col("q"), "left").select("query_id", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("floor"))
    if best is None:
        return asked.select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return best.select("query_id", "rank", "vec_id", "score")
