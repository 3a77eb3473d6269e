"""Centroid clustering of vectors by Elkan's bounds (operator 11).

Vectors become integers, floor(256 * x), and all decisions are made on exact squared distances between these. A row of the state
is a block of vectors with, for each of them, its centroid, an upper bound of its distance to that and a lower bound of its
distance to every centroid; a round maps the blocks, one by one, to new ones, and no vector is shuffled at all:

1. bounds move by how far the centroids moved;
2. a vector whose upper bound is below half the distance from its centroid to the nearest other one stays where it is;
3. for others the upper bound is made exact, and the distance to another centroid is calculated only if neither its lower
   bound nor half the distance between the two centroids is above the upper bound;
4. each block adds up its vectors by centroid, Spark adds up the blocks', and the driver gets k sums.

Bounds are doubles that are rounded away from the distance they bound, and a calculation is left out only where a bound is
strictly greater, so that equal distances are always calculated and the smaller number wins.

The state is a table in the shared folder, written in each round; the one before is emptied. The driver holds k centroids and
as many sums.

Defined results: vectors that are null, have another number of components, or one that is null or not finite, are left out;
components beyond +-LARGEST count as that, so that squared distances fit 64 bits; equal vectors are clustered each; vectors of
equal id are vectors of their own, in the order of their components where the first centroids are chosen; a null id has no hash
and comes after all others there; with fewer vectors than k each is a first centroid, and with none there are no rows; a total
that exceeds 64 bits is null; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noetica.llm.common import emptied, released, written

SCALE, LARGEST = 256, (1 << 27) - 1
#: Up to here squared distances are exact in doubles, and come from a product of matrices.
PLAIN = 1 << 21
STATE = "ids array<long>, vectors binary, near binary, upper binary, lower binary, sums array<long>, calculated long"
COLUMNS = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def kept_vectors(vectors: DataFrame, dimensions: int) -> DataFrame:
    """(vec_id, v) of usable vectors, as doubles."""
    v = F.col("embedding").cast("array<double>").alias("v")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v).where((F.size("v") == dimensions) & sound)


def whole(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values * SCALE), -LARGEST, LARGEST).astype(np.int64)


def squares(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances to one centroid."""
    gap = vectors - centroid
    return np.einsum("ij,ij->i", gap, gap)


def _all_squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) < PLAIN:
        x, c = vectors.astype(float), centroids.astype(float)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([squares(vectors, c) for c in centroids], 1)


def above(square: np.ndarray) -> np.ndarray:
    """A double not below the root."""
    return np.nextafter(np.sqrt(square.astype(float)) * (1 + 1e-15), np.inf)


def below(square: np.ndarray) -> np.ndarray:
    """A double not above the root."""
    return np.maximum(np.nextafter(np.sqrt(square.astype(float)) * (1 - 1e-15), -np.inf), 0)


class Bounds:
    """A block's centroids and bounds; `calculated` counts distances between vectors and centroids."""

    def __init__(self, n: int, k: int):
        self.near, self.upper, self.lower = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros((n, k))
        self.calculated = 0

    def moved(self, old: np.ndarray, new: np.ndarray) -> None:
        by = above(((old - new) ** 2).sum(1))
        self.upper = np.nextafter(self.upper + by[self.near], np.inf)
        self.lower = np.maximum(np.nextafter(self.lower - by, -np.inf), 0)

    def first(self, vectors: np.ndarray, centroids: np.ndarray) -> None:
        """All distances: where there are no bounds yet."""
        square = _all_squares(vectors, centroids)
        self.calculated += square.size
        self.near = square.argmin(1).astype(np.int32)  # the first of the least
        self.upper, self.lower = above(square[np.arange(len(square)), self.near]), below(square)

    def again(self, vectors: np.ndarray, centroids: np.ndarray) -> None:
        half = below(_all_squares(centroids, centroids)) / 2
        np.fill_diagonal(half, np.inf)
        at = np.flatnonzero(self.upper >= half.min(1, initial=np.inf)[self.near])  # half the distance is an exact division
        if not len(at):
            return
        own, near, lower = vectors[at], self.near[at], self.lower[at]
        best = np.empty(len(at), np.int64)
        for j in np.unique(near):
            best[near == j] = squares(own[near == j], centroids[j])
        self.calculated += len(at)
        upper = above(best)
        lower[np.arange(len(at)), near] = below(best)
        for j in range(len(centroids)):
            rows = np.flatnonzero((near != j) & (lower[:, j] <= upper) & (half[near, j] <= upper))
            if not len(rows):
                continue
            square = squares(own[rows], centroids[j])
            self.calculated += len(rows)
            lower[rows, j] = below(square)
            closer = (square < best[rows]) | ((square == best[rows]) & (j < near[rows]))
            rows, square = rows[closer], square[closer]
            near[rows], best[rows], upper[rows] = j, square, above(square)
        self.near[at], self.upper[at], self.lower[at] = near, upper, lower


def _row(ids: pa.Array, vectors: np.ndarray, bounds: Bounds, k: int) -> pa.RecordBatch:
    """A row of the state; sums has for each centroid the number of its vectors and their sum."""
    sums = np.zeros((k, 1 + vectors.shape[1]), np.int64)
    sums[:, 0] = np.bincount(bounds.near, minlength=k)
    order = np.argsort(bounds.near, kind="stable")
    some = np.flatnonzero(sums[:, 0])
    if len(some):
        sums[some, 1:] = np.add.reduceat(vectors[order], (np.cumsum(sums[:, 0]) - sums[:, 0])[some])
    small = np.int16 if np.abs(vectors).max(initial=0) < 1 << 15 else np.int32
    raw = [vectors.astype(small), bounds.near.astype(np.int16 if k < 1 << 15 else np.int32), bounds.upper, np.nextafter(bounds.lower.astype(np.float32), np.float32(-1))]
    listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    columns = [listed, *(pa.array([r.tobytes()], pa.binary()) for r in raw), pa.array([sums.ravel().tolist()], pa.list_(pa.int64())), pa.array([bounds.calculated], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in STATE.split(", ")])


def _blocks(batch: pa.RecordBatch, k: int, dimensions: int):
    """(ids, vectors, bounds) of every row of the state."""
    for i in range(batch.num_rows):
        ids = batch.column("ids")[i].values
        vectors, near, upper, lower = (batch.column(c)[i].as_buffer() for c in ("vectors", "near", "upper", "lower"))
        small = np.int16 if len(vectors) == 2 * dimensions * len(ids) else np.int32
        bounds = Bounds(0, k)
        bounds.near = np.frombuffer(near, np.int16 if k < 1 << 15 else np.int32).astype(np.int32)
        bounds.upper, bounds.lower = np.frombuffer(upper, float), np.maximum(np.frombuffer(lower, np.float32).astype(float), 0).reshape(-1, k)
        yield ids, np.frombuffer(vectors, small).astype(np.int64).reshape(-1, dimensions), bounds


def first_centroids(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors of least hash: a bounded top-k."""
    rows = kept.orderBy(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).select("v").collect()
    return whole(np.array([r.v for r in rows]))


def state_of(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Blocks of vectors, assigned for the first time: a map over the scan."""
    k, dimensions = centroids.shape

    def run(arrived):
        for batch in arrived:
            if not batch.num_rows:
                continue
            vectors = whole(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions))
            bounds = Bounds(len(vectors), k)
            bounds.first(vectors, centroids)
            yield _row(batch.column("vec_id"), vectors, bounds, k)
        released()

    return kept.mapInArrow(run, STATE)


def next_state(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    k, dimensions = new.shape

    def run(arrived):
        for batch in arrived:
            for ids, vectors, bounds in _blocks(batch, k, dimensions):
                bounds.moved(old, new)
                bounds.again(vectors, new)
                yield _row(ids, vectors, bounds, k)
        released()

    return state.mapInArrow(run, STATE)


def _sums(state: DataFrame, k: int, dimensions: int) -> np.ndarray:
    """Number and sum of each centroid's vectors, added up in Spark from the blocks' one column of sums."""
    out = np.zeros(k * (1 + dimensions), np.int64)
    for r in state.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).where("value != 0").collect():
        out[r.at] = r.value
    return out.reshape(k, 1 + dimensions)


def clustered(vectors: DataFrame, k: int, dimensions: int, rounds: int = 5, seed: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """(the state's table after the last assignment, the centroids of that)."""
    kept = kept_vectors(vectors, dimensions)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], STATE), np.zeros((0, dimensions), np.int64)
    state = written(state_of(kept, centroids), "clusters")
    for _ in range(rounds):
        sums = _sums(state, *centroids.shape)
        new = np.where(sums[:, :1] > 0, sums[:, 1:] // np.maximum(sums[:, :1], 1), centroids)
        before, state = state, written(next_state(state, centroids, new), "clusters")
        emptied(before)
        centroids = new
    return state, centroids


def assigned(vectors: DataFrame, k: int = 40, dimensions: int = 64, rounds: int = 5, seed: str = "2:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector."""
    state, centroids = clustered(vectors, k, dimensions, rounds, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], COLUMNS)
    k = len(centroids)

    def distances(arrived):
        for batch in arrived:
            for ids, own, bounds in _blocks(batch, k, dimensions):
                yield pa.RecordBatch.from_arrays([ids, pa.array(bounds.near), pa.array(squares(own, centroids[bounds.near]))], ["vec_id", "cluster", "distance"])
        released()

    rows = state.mapInArrow(distances, "vec_id long, cluster int, distance long")
    inertia = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()  # k rows
    total, fits = sum(int(r.inertia) for r in inertia), lambda n: n if n < 1 << 63 else None
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = vectors.sparkSession.createDataFrame([(r.cluster, fits(int(r.inertia)), fits(total), shas[r.cluster]) for r in inertia], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of), "cluster").select([c.split()[0] for c in COLUMNS.split(", ")])  # k rows
