"""Approximate nearest neighbours by collision counting over query-centred windows.

Vectors are dealt to shards by a hash of their id. A shard keeps, for each of ``projections`` random directions, the
array of its vectors sorted by projected value. A query opens in every array a window centred at its own projected
value and widens all windows together by a constant factor (virtual rehashing), so that only the newly covered runs of
the arrays are counted; a vector that falls into the windows of at least ``threshold`` of all arrays is verified by its
true distance. For a vector at distance d, the chance to collide in one window of half width r is
P(\\|N(0, 1)\\| <= r / d), so the widening of a query ends as soon as a vector as near as its k-th best so far would have
reached the threshold but for a chance of ``miss`` (normal approximation of the binomial). If that never comes, the
last window is all of the line and every vector of the shard is verified. Nothing else bounds candidates or bins.

The vectors of a shard come first in its partition, the queries after them as a stream of Arrow batches: memory is
bounded by the rows of a shard, however many queries there are. Each shard gives its nearest per query, and a ranked
window over the few rows of a query merges the shards.

Defined results: vectors that are null, empty, all zero, or hold null or non-finite components take no part, nor do
rows without an id; rows that repeat an id count once (the smallest vector, in array order); vectors of another length
than the query's are no candidates; ties in distance go to the smaller id; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS, THRESHOLD, MISS = 64, 0.8, 0.1
ROWS_PER_SHARD = 8192
FIRST, WIDEN, ROUNDS = 0.8, 1.3, 14


def stop_ratio(projections: int, threshold: float, miss: float) -> float:
    """Half width of the windows, as a multiple of a distance, at which a vector at that distance reaches the
    threshold but for a chance of ``miss``."""
    normal = NormalDist()
    z = normal.inv_cdf(1 - miss)
    low, high = threshold, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if p - z * math.sqrt(p * (1 - p) / projections) < threshold:
            low = p
        else:
            high = p
    return normal.inv_cdf((1 + min(high, 1 - 1e-9)) / 2)


class ShardIndex:
    """Sorted projections of the vectors of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int, threshold: float, miss: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        dim = vectors.shape[1]
        self.directions = np.random.default_rng(1000 + dim).normal(size=(dim, projections))
        values = self.vectors @ self.directions
        self.order = np.ascontiguousarray(np.argsort(values, axis=0).T)
        self.values = np.ascontiguousarray(np.sort(values, axis=0).T)
        self.needed = math.ceil(threshold * projections)
        self.ratio = stop_ratio(projections, threshold, miss)
        self.squares = (self.vectors**2).sum(axis=1)
        # half width of the first windows, from the spread of the projected values
        spread = float(np.median(values.std(axis=0)))
        self.first = max(FIRST * spread, 1e-12 * max(1.0, float(np.abs(values).max())))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and distances of the k nearest found, per query, nearest first."""
        m, n = self.values.shape
        at = queries @ self.directions
        radii = [self.first * WIDEN**j for j in range(ROUNDS)]
        low = np.empty((ROUNDS, len(queries), m), np.int32)
        high = np.empty((ROUNDS, len(queries), m), np.int32)
        for i in range(m):
            for j, r in enumerate(radii):
                low[j, :, i] = np.searchsorted(self.values[i], at[:, i] - r, side="left")
                high[j, :, i] = np.searchsorted(self.values[i], at[:, i] + r, side="right")
        for row in range(len(queries)):
            query = queries[row]
            counts = np.zeros(n, np.uint8 if m < 256 else np.int32)
            open_ = np.ones(n, bool)
            open_[np.searchsorted(self.ids, query_ids[row]):np.searchsorted(self.ids, query_ids[row], side="right")] = False
            found, squared = np.zeros(0, np.int64), np.zeros(0)
            own = float(query @ query)
            before: tuple[list[int], list[int]] | None = None
            for j in range(ROUNDS + 1):
                if j < ROUNDS:
                    lo, hi = low[j, row].tolist(), high[j, row].tolist()
                    if before is None:
                        for order, a, b in zip(self.order, lo, hi, strict=True):
                            counts[order[a:b]] += 1
                    else:
                        for order, a, b, a0, b0 in zip(self.order, lo, hi, *before, strict=True):
                            if a < a0:
                                counts[order[a:a0]] += 1
                            if b0 < b:
                                counts[order[b0:b]] += 1
                    before = lo, hi
                    new = np.flatnonzero((counts >= self.needed) & open_)
                else:
                    new = np.flatnonzero(open_)
                if len(new):
                    open_[new] = False
                    found = np.concatenate([found, new])
                    squared = np.concatenate([squared, self.squares[new] - 2 * (self.vectors[new] @ query) + own])
                if len(found) >= k and j < ROUNDS:
                    if radii[j] >= self.ratio * math.sqrt(max(0.0, np.partition(squared, k - 1)[k - 1])):
                        break
                if not open_.any():
                    break
            if len(found) > k:  # squares by products may err in the last places: all that could be among the k stay
                slack = 1e-9 * (own + float(self.squares[found].max()))
                found = found[squared <= np.partition(squared, k - 1)[k - 1] + slack]
            d = np.sqrt(((self.vectors[found] - query) ** 2).sum(axis=1))
            best = np.lexsort((self.ids[found], d))[:k]
            yield self.ids[found[best]], d[best]


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part, one row per id."""
    bad = ("exists(v, x -> x is null or isnan(x) or x in (double('Infinity'), double('-Infinity')))"
           " or forall(v, x -> x = 0)")
    rows = vectors.selectExpr(f"cast({vec_id} as bigint) as vec_id", f"cast({embedding} as array<double>) as v")
    return (rows.where("vec_id is not null and v is not null and size(v) > 0").where(f"not ({bad})")
            .groupBy("vec_id").agg(F.min("v").alias("v")))


def nearest(vectors: DataFrame, queries_where: str, k: int = 10, embedding: str = "embedding", vec_id: str = "vec_id",
            projections: int = PROJECTIONS, threshold: float = THRESHOLD, miss: float = MISS,
            rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every vector that meets ``queries_where`` (a condition on
    vec_id)."""
    rows = usable(vectors, vec_id, embedding)
    n = vectors.count()
    shards = max(1, math.ceil(n / rows_per_shard))
    own = rows.selectExpr("size(v) as dim", f"cast(pmod(xxhash64(vec_id), {shards}) as int) as shard", "0 as kind",
                          "vec_id", "v")
    asked = rows.where(queries_where).selectExpr("size(v) as dim", f"explode(sequence(0, {shards - 1})) as shard",
                                                 "1 as kind", "vec_id", "v")
    dealt = (own.unionByName(asked).repartition(shards, "dim", "shard")
             .sortWithinPartitions("dim", "shard", "kind", "vec_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, parts, index = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            dim, shard = np.asarray(batch.column("dim")), np.asarray(batch.column("shard"))
            kind, who = np.asarray(batch.column("kind")), np.asarray(batch.column("vec_id"))
            cut = np.flatnonzero((np.diff(dim) != 0) | (np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(dim)], strict=True):
                if key != (dim[a], shard[a]):
                    key, ids, parts, index = (dim[a], shard[a]), [], [], None
                x = np.asarray(batch.column("v").slice(a, b - a).flatten()).reshape(b - a, int(dim[a]))
                if kind[a] == 0:
                    ids.append(who[a:b])
                    parts.append(x)
                    continue
                if not ids:
                    continue  # a shard without vectors of this length
                if index is None:
                    index = ShardIndex(np.concatenate(ids), np.concatenate(parts), projections, threshold, miss)
                for at in range(a, b, 64):
                    to = min(b, at + 64)
                    out = list(index.search(who[at:to], x[at - a:to - a], k))
                    size = [len(o[0]) for o in out]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(who[at:to], size)), pa.array(np.concatenate([o[0] for o in out])),
                         pa.array(np.concatenate([o[1] for o in out]))], ["query_id", "vec_id", "score"])

    near = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
