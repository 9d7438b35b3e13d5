"""Approximate nearest neighbours by inner product with collision counting (QALSH; Huang et al., 2015).

A block's vectors are searched by ranges of length. In a range they get one more component, which makes all as long as
its longest, so that the largest inner product is the smallest distance. Every projection is one sorted array. Round a
query's own projection a window opens in each array; virtual rehashing widens all windows until the k-th exact product
so far is beyond what a vector outside can have, but for a stated chance. Vectors that collide with the query in the
threshold's number of windows are verified with their exact inner products.

A task has one block of vectors, indexes it once, and streams the queries through it; each block gives its nearest, of
which the best are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import bound_batches, staged

PROJECTIONS = 112
#: Share of the projections in which a candidate collides; ratio by which windows widen until there are k.
COLLISIONS, RATIO = 0.88, 1.2
#: Chance at most that a vector as near as the k-th is left out when the search ends; ratio of the lengths of a range.
MISSED, RANGE = 0.05, 1.1
#: Vectors of a range that are all verified instead of indexed; vectors whose neighbours give the first windows' width.
LEAST, PILOTS = 256, 64
#: Vectors of a block and bytes of its index, at most; a block isn't made smaller than SMALL for more tasks. Queries at
#: once.
BLOCK, BLOCK_BYTES, SMALL, QUERY_BLOCK = 65_536, 128 << 20, 16_384, 1_024
#: Products and lengths beyond these may have lost digits: such ranges are verified whole.
TINY, HUGE = 1e-280, 1e280


@lru_cache(maxsize=8)
def reach(missed: float = MISSED) -> float:
    """The half-width of windows, in distances, in which a vector misses too often with a chance of `missed`: a projection
    of a distance is normal with that deviation, so misses are binomial."""
    allowed = int(PROJECTIONS * (1 - COLLISIONS))
    low, high = 0.0, 10.0
    for _ in range(60):
        z = (low + high) / 2
        p = math.erfc(z / math.sqrt(2))
        kept = sum(math.comb(PROJECTIONS, i) * p**i * (1 - p) ** (PROJECTIONS - i) for i in range(allowed + 1))
        low, high = (z, high) if 1 - kept > missed else (low, z)
    return high


def lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled to length 1, and the logarithms of their lengths; nothing under- or overflows."""
    largest = np.abs(x).max(axis=1, keepdims=True)
    power = np.exp2(np.floor(np.log2(largest)))
    scaled = x / power
    size = np.linalg.norm(scaled, axis=1, keepdims=True)
    return scaled / size, (np.log(power) + np.log(size))[:, 0]


class Range:
    """Vectors (places in the block) whose lengths differ by a factor of RANGE at most, with their sorted projections."""

    def __init__(self, unit: np.ndarray, log_length: np.ndarray, places: np.ndarray, k: int, seed: int = 7) -> None:
        self.places, self.top = places, float(log_length.max())
        self.indexed = places.size > max(k, LEAST)
        if not self.indexed:
            return
        share = np.exp(log_length - self.top)  # lengths as shares of the longest
        x = unit * share[:, None]
        rest = np.sqrt(np.maximum(1.0 - share * share, 0.0))
        self.lines = np.random.default_rng(seed).standard_normal((PROJECTIONS, x.shape[1] + 1))
        found = self.lines[:, :-1] @ x.T + self.lines[:, -1:] * rest
        self.order = np.argsort(found, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(found, self.order, 1)
        # the usual distance of a k-th neighbour, from vectors dealt over the range
        pilots = unit[:: max(1, places.size // PILOTS)][:PILOTS]
        near = np.partition(pilots @ x.T, places.size - 1 - k, axis=1)[:, places.size - 1 - k]
        self.start = max(1e-6, math.sqrt(max(0.0, 2 - 2 * float(np.median(near)))))

    def projected(self, units: np.ndarray) -> np.ndarray:
        return units @ self.lines[:, :-1].T

    def colliding(self, at: np.ndarray, half: float) -> np.ndarray:
        """Which vectors collide often enough with a query's projections in windows of this half-width. Collisions are
        counted by what lies outside the windows, which is less."""
        n = self.places.size
        parts = []
        for line, row, v in zip(self.sorted, self.order, at):
            parts += [row[: line.searchsorted(v - half)], row[line.searchsorted(v + half, "right") :]]
        return np.bincount(np.concatenate(parts), minlength=n) <= int(PROJECTIONS * (1 - COLLISIONS))


def products(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as they are in double precision; what isn't a number counts as minus infinity."""
    with np.errstate(over="ignore", invalid="ignore"):
        found = (x * query).sum(axis=1)
    return np.where(np.isnan(found), -np.inf, found)


class Index:
    """A block's vectors x and their ids, by ranges of length, the longest first."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, k: int) -> None:
        self.x, self.ids, self.k = x, ids, k
        unit, log_length = lengths(x)
        step = np.floor((log_length.max() - log_length) / math.log(RANGE))
        self.ranges = [Range(unit[p], log_length[p], p, k + 1) for p in (np.flatnonzero(step == s) for s in np.unique(step))]

    def search(self, queries: np.ndarray, names: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each query the places of its k nearest, best first, their products, and how many were verified."""
        units, sizes = lengths(queries)
        at = [r.projected(units) if r.indexed else None for r in self.ranges]
        for i, (query, name) in enumerate(zip(queries, names)):
            best, score, verified = np.empty(0, np.int64), np.empty(0), 0
            for r, lines in zip(self.ranges, at):
                scale = r.top + float(sizes[i])  # the logarithm of the largest product that the range can have
                done, half = np.zeros(r.places.size, bool), None
                while True:
                    least = float(score[-1]) if score.size == self.k else -math.inf
                    known = TINY < abs(least) < HUGE and math.log(TINY) < scale < math.log(HUGE)
                    t = least * math.exp(-scale) if known else -math.inf  # the k-th product as a share of that
                    if t > 1 + 1e-9:
                        break
                    if not r.indexed or (score.size == self.k and not known):
                        new = ~done
                    else:
                        wanted = reach() * math.sqrt(max(0.0, 2 - 2 * t)) + 1e-9 if t > -1 else math.inf
                        if half is not None and half >= wanted:
                            break
                        half = reach() * r.start if half is None else half * RATIO
                        half = wanted if t > -1 else half
                        new = r.colliding(lines[i], half) & ~done
                    done |= new
                    near = r.places[new]
                    verified += near.size
                    near = np.concatenate([best, near[self.ids[near] != name]])
                    found = np.concatenate([score, products(self.x[near[best.size :]], query)])
                    order = np.lexsort((self.ids[near], -found))[: self.k]
                    best, score = near[order], found[order]
                    if done.all():
                        break
            yield best, score, verified


FOUND = "query_id long, vec_id long, score double"


def block_nearest(k: int):
    """Rows (dim, block, kind, vec_id, embedding) in this order, kind 0 being data and 1 queries."""

    def matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        values = batch.column(4).flatten().to_numpy(zero_copy_only=False)
        return batch.column(3).to_numpy(), values.astype(np.float64).reshape(batch.num_rows, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index = None, [], None
        for batch in batches:
            tags = np.stack([batch.column(i).to_numpy() for i in range(3)], 1).astype(np.int64)
            cuts = np.flatnonzero((tags[1:] != tags[:-1]).any(axis=1)) + 1
            for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(tags)].tolist()):
                if a == b:
                    continue
                if tuple(tags[a, :2]) != key:
                    key, held, index = tuple(tags[a, :2]), [], None
                ids, x = matrix(batch.slice(a, b - a))
                if tags[a, 2] == 0:
                    held.append((ids, x))
                    continue
                if not held:
                    continue
                if index is None:
                    index = Index(np.concatenate([v for _, v in held]), np.concatenate([i for i, _ in held]), k)
                for at in range(0, len(ids), QUERY_BLOCK):
                    names = ids[at : at + QUERY_BLOCK]
                    found = [(index.ids[near], score) for near, score, _ in index.search(x[at : at + QUERY_BLOCK], names)]
                    owner = np.repeat(names, [len(n) for n, _ in found])
                    yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate([n for n, _ in found])), pa.array(np.concatenate([s for _, s in found]))], ["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>): one row an id, without null, zero, empty or non-finite vectors. Rows that
    repeat an id count once, with the smallest embedding."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    v = v.where(finite & F.exists("embedding", lambda e: e != 0.0))
    return v.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """For each vec_id divisible by `every` the k nearest other vectors found: query_id, rank, vec_id, score.

    Nearness is the inner product in double precision, ties go to the smaller vec_id; all candidates come if there are
    at most k. A vector as near as a block's k-th is left out with a chance of MISSED at most, whatever the lengths and
    dimensions are; blocks and ranges of at most LEAST vectors are exact. Only vectors of the query's own dimension are
    candidates. Null, zero and non-finite vectors and rows without vec_id take no part; an empty table gives an empty
    result; other columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    good = staged(usable(vectors).withColumn("dim", F.size("embedding")), "neighbours")
    fits = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (F.col("dim") * 24 + PROJECTIONS * 12))))
    # as many blocks as memory needs, and as there are tasks, unless they get too small for that
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = good.groupBy("dim").agg(F.count("*").alias("n"))
    blocks = F.greatest(F.ceil(F.col("n") / fits), F.least(F.lit(tasks), F.ceil(F.col("n") / min(SMALL, BLOCK)))).cast("int")
    sizes = staged(sizes.select(F.col("dim").alias("d"), blocks.alias("blocks")), "neighbours-dims")
    rows = good.join(sizes, F.col("dim") == F.col("d"))
    data = rows.select("dim", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "embedding")
    queries = rows.where(F.col("vec_id") % every == 0).select("dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "vec_id", "embedding")
    dealt = data.unionByName(queries).repartition("dim", "block").sortWithinPartitions("dim", "block", "kind", "vec_id")
    found = dealt.mapInArrow(block_nearest(k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
