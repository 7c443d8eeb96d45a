"""Centroid clustering with Drake's adaptive bounds, in exact integer arithmetic.

Each vector carries its nearest centroids in order: an upper bound of the distance to
its own, a lower bound for each of the next ``b``, and one lower bound, the remainder,
for all others. When centroids move, the bounds move with them. As long as the upper
bound lies below every lower one the assignment is certified without a distance; else
the distance to the own centroid is made exact, then those of as many of the listed
ones as the bounds can't rule out, and only a vector whose remainder can't be ruled
out is compared with all centroids. ``b`` begins at a quarter of the centroids and
follows what a round needed, down to an eighth.

Bounds are floats that are widened by more than their rounding; every comparison that
they can't decide is made on integers, so ties go to the smaller number and the result
is that of comparing all distances.

A round is one pass over the table of vectors and bounds, written to the shared
folder, and one aggregate of the sums of each cluster, combined before its shuffle.
The driver holds the centroids and a row for each cluster, nothing that grows with
the vectors; centroids are all that is sent to tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import cut_at, pieces, remove

#: Components are integers floor(SCALE * x).
SCALE = 256
#: Their largest size: squared distances of 64 of them fit a long.
LARGEST = 1 << 27
#: Relative width given to a bound, far above the rounding of a few float operations.
WIDER = 1e-12
#: The remainder where no centroid is left for it; bounds have to stay finite.
FAR = 1e300
#: Vectors that are worked on at once.
ROWS = 2048

STATE = "vec_id long, vec array<int>, near array<int>, low array<double>, rest double, used int, computed long, distance long"


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row for each vector and a column for each centroid."""
    bound = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * bound * bound < 1 << 53:  # every partial sum is exact in a double
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def _listed(x: np.ndarray, centroids: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to the centroids it names."""
    return ((x[:, None, :] - centroids[numbers]) ** 2).sum(2)


def _bounds(distances: np.ndarray) -> np.ndarray:
    """Bounds of ordered squared distances: an upper one for the first, lower ones for the others."""
    out = np.sqrt(distances.astype(np.float64)) * (1 - WIDER)
    out[:, 0] = np.sqrt(distances[:, 0].astype(np.float64)) * (1 + WIDER)
    return out


class Bounds:
    """Bounds of a block of vectors: near and low (vectors, 1 + b), rest (vectors)."""

    def __init__(self, near: np.ndarray, low: np.ndarray, rest: np.ndarray):
        self.near, self.low, self.rest = near, low, rest

    @classmethod
    def scanned(cls, x: np.ndarray, centroids: np.ndarray, b: int) -> Bounds:
        """From all distances; equal ones in order of the centroids' numbers."""
        distances = squared(x, centroids)
        order = np.argsort(distances, axis=1, kind="stable")[:, : b + 2]
        held = _bounds(np.take_along_axis(distances, order, 1))
        rest = held[:, b + 1] if held.shape[1] > b + 1 else np.full(len(x), FAR)
        return cls(order[:, : b + 1].copy(), held[:, : b + 1].copy(), rest.copy())

    def moved(self, by: np.ndarray) -> None:
        """The centroids have moved by these lengths at most."""
        step = by[self.near]
        step[:, 0] *= -1
        self.low -= step
        self.low[:, 0] *= 1 + WIDER
        self.low[:, 1:] -= WIDER * (np.abs(self.low[:, 1:]) + step[:, 1:])
        self.rest -= by.max() + WIDER * (np.abs(self.rest) + by.max())

    def certify(self, x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put the nearest centroid first. Returns for each vector how many listed bounds
        that took (-1: all centroids were compared) and how many distances were computed."""
        b = self.near.shape[1] - 1
        used, computed = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
        floor = np.minimum.accumulate(np.concatenate([self.low[:, 1:], self.rest[:, None]], 1)[:, ::-1], axis=1)[:, ::-1]
        open_ = np.flatnonzero(self.low[:, 0] >= floor[:, 0])
        if not len(open_):
            return used, computed
        own = _listed(x[open_], centroids, self.near[open_, :1])[:, 0]
        self.low[open_, 0] = np.sqrt(own.astype(np.float64)) * (1 + WIDER)
        computed[open_] = 1
        need = (self.low[open_, :1] >= floor[open_]).sum(1)
        for n in range(1, b + 1):
            at = open_[need == n]
            if len(at):
                names = self.near[at, : n + 1]
                distances = _listed(x[at], centroids, names)
                order = np.lexsort((names, distances), axis=-1)
                self.near[at, : n + 1] = np.take_along_axis(names, order, 1)
                self.low[at, : n + 1] = _bounds(np.take_along_axis(distances, order, 1))
                used[at], computed[at] = n, n + 1
        at = open_[need == b + 1]
        if len(at):
            new = Bounds.scanned(x[at], centroids, b)
            self.near[at], self.low[at], self.rest[at] = new.near, new.low, new.rest
            used[at], computed[at] = -1, len(centroids) + 1
        return used, computed

    def shortened(self, b: int) -> Bounds:
        """With at most ``b`` listed bounds; the remainder takes in the others."""
        rest = np.minimum(self.rest, self.low[:, b + 1 :].min(1, initial=FAR))
        return Bounds(self.near[:, : b + 1], self.low[:, : b + 1], rest)


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    """Lists of one length as rows of an array of its own."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(dtype)


def _lists(values: np.ndarray) -> pa.Array:
    flat, width = np.ascontiguousarray(values).ravel(), values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), pa.array(flat))


def assignment(centroids: np.ndarray, moves: np.ndarray | None, b: int, last: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over (vec_id, vec), or over the state of the pass before where centroids moved since.

    ``distance`` is exact after the last pass and null before it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, ROWS):
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"), np.int64)
            if moves is None:
                held = Bounds.scanned(x, centroids, b)
                used, computed = np.zeros(len(x), np.int32), np.full(len(x), len(centroids), np.int64)
            else:
                held = Bounds(_matrix(batch.column("near"), np.int64), _matrix(batch.column("low"), np.float64), batch.column("rest").to_numpy().copy())
                held.moved(moves)
                used, computed = held.certify(x, centroids)
                computed += batch.column("computed").to_numpy()
                held = held.shortened(b)
            distance = pa.array(_listed(x, centroids, held.near[:, :1])[:, 0]) if last else pa.nulls(len(x), pa.int64())
            columns = [batch.column("vec_id"), _lists(x.astype(np.int32)), _lists(held.near.astype(np.int32)), _lists(held.low), pa.array(held.rest), pa.array(used), pa.array(computed), distance]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "vec", "near", "low", "rest", "used", "computed", "distance"])

    return run


def integer_vectors(df: DataFrame, dims: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) of the rows whose vector has ``dims`` components, none null, NaN or infinite."""
    x = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    kept = x.where((F.size("vec") == dims) & ~F.exists("vec", odd))
    too_large = F.raise_error(F.lit(f"a component is beyond {LARGEST} / {SCALE}: squared distances wouldn't fit a long")).cast("int")
    whole = lambda v: F.when(F.abs(v) * SCALE < LARGEST, F.floor(v * SCALE).cast("int")).otherwise(too_large)
    return kept.select("vec_id", F.transform("vec", whole).alias("vec"))


def states(df: DataFrame, k: int, rounds: int, dims: int = 64, seed: int = 2, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame | None, np.ndarray]:
    """The last pass' state and the final centroids; no state where no vector is kept."""
    vectors = integer_vectors(df, dims, id_col, vec_col)
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = vectors.orderBy(F.asc_nulls_last(place), "vec").limit(k).collect()
    centroids = np.array([r.vec for r in starts], np.int64).reshape(-1, dims)
    if not len(centroids):
        return None, centroids
    k = len(centroids)
    b = min(max(k // 4, 1), k - 1)
    now, moves, path = vectors, None, None
    for turn in range(rounds + 1):
        before = path
        now, path = cut_at(now.mapInArrow(assignment(centroids, moves, b, turn == rounds), STATE), "clusters")
        if before:
            remove(df.sparkSession, before)
        if turn == rounds:
            break
        sums = now.groupBy(F.col("near")[0].alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.max("used").alias("used"), *(F.sum(F.col("vec")[j].cast("long")).alias(f"s{j}") for j in range(dims))).collect()
        after = centroids.copy()
        for r in sums:
            after[r.cluster] = [r[f"s{j}"] // r.n for j in range(dims)]
        moves = np.sqrt(((after - centroids) ** 2).sum(1).astype(np.float64)) * (1 + WIDER)
        if turn:  # the first pass scans, so it says nothing of what is needed
            b = min(b, max(max(r.used for r in sums), k // 8, 1))
        centroids = after
    return now, centroids


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    A vector is kept if it has ``dims`` components, none null or non-finite; null ids
    stay null and come last in the choice of the first centroids, rows of one id in
    the order of their vectors. Repeated rows are vectors of their own. Fewer vectors
    than ``k`` give as many centroids; none give an empty result. A component of
    ``LARGEST / SCALE`` or more is an error, as its distances may not fit a long.
    Columns other than the two named are not read.
    """
    state, centroids = states(df, k, rounds, dims, seed, id_col, vec_col)
    if state is None:
        return df.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    own = state.select("vec_id", F.col("near")[0].alias("cluster"), "distance")
    parts = {r.cluster: r.total for r in own.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    each = range(len(centroids))
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.array(*(F.lit(v).cast(kind) for v in values))[F.col("cluster")]
    total: Column = F.lit(sum(parts.values())).cast("long")
    return own.select("vec_id", "cluster", "distance", of([parts.get(c, 0) for c in each], "long").alias("cluster_inertia"), total.alias("inertia"), of(names, "string").alias("centroid_sha256"))


def oracle_sql(k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2) -> str:
    """The same by comparing all distances, for DuckDB; k up to 64."""
    parts = [
        f"""kept AS (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS k, v FROM kept ORDER BY k LIMIT {k})",
    ]
    for turn in range(rounds + 1):
        parts.append(f"""a{turn} AS (
            SELECT row, vec_id, v, m % 64 AS k, m // 64 AS d FROM (
                SELECT row, any_value(vec_id) AS vec_id, any_value(x.v) AS v, min(list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) * 64 + c.k) AS m
                FROM kept x CROSS JOIN c{turn} c GROUP BY row))""")
        if turn < rounds:
            parts.append(f"""c{turn + 1} AS (
                SELECT c.k, coalesce(m.v, c.v) AS v FROM c{turn} c LEFT JOIN (
                    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM (
                        SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range({dims})) AS j FROM a{turn}) GROUP BY k, j) GROUP BY k) m ON m.k = c.k)""")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, a.k::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON c.k = a.k"""
