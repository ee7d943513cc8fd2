"""Centroid clustering in whole numbers, pruned by Ptolemaic pivots.

Centroids of an earlier round, at first the starting ones, are the pivots, and
every vector keeps its distances to them.  For pivots a, b Ptolemy's inequality gives, for a vector x and a centroid
c, |x c| * |a b| >= | |x a| * |c b| - |x b| * |c a| |, so the kept distances
bound the distance to any later centroid from below.  A vector's exact distance
to the centroid of least bound prunes the others; what survives is calculated
exactly.  Where more than half of all distances survived a round, the centroids
have left the pivots, and the present ones become pivots, a few times at most.
Bounds are lowered by more than rounding can lift them, so no nearest centroid is
lost, ties included.

A round is one pass over the written vectors with their pivot distances.  A task
sends sums per centroid and component; the driver holds the centroids only.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.shared import saved, small_batches
from chartloom.llm.topk import valid_vector, whole_numbers

CLUSTERS, ROUNDS, SCALE, DIMENSION = 8, 10, 1024, 64
SEED_TEXT = "3:"
#: Largest component up to which all sums of squares of 64 components are exact in double precision.
EXACT = 1 << 22
#: How often pivots are chosen anew; each time the vectors are written again.
NEW_PIVOTS = 3
LARGEST = 2**63 - 1


# ---------------------------------------------------------------- distances and bounds

def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x from y (a row, or as many rows), in whole numbers of any size."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)), int(y.max(initial=0)), -int(y.min(initial=0)))
    if top <= EXACT:
        apart = x.astype(np.float64) - y
        return np.einsum("ij,ij->i", apart, apart).astype(np.int64)
    apart = x.astype(object) - y.astype(object)
    return (apart * apart).sum(1) if apart.shape[1] else np.zeros(len(apart), np.int64)


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of each row from each pivot."""
    return np.stack([np.sqrt(squared(x, p).astype(np.float64)) for p in pivots], 1) if len(pivots) else np.zeros((len(x), 0))


def lower_bounds(known: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """A lower bound of the distance of each row from each centroid; ``known`` has the rows' pivot distances."""
    bound = np.zeros((len(known), len(centroids)))
    to_pivots, between = pivot_distances(centroids, pivots), pivot_distances(pivots, pivots)
    for a in range(len(pivots)):  # each pivot with the next one
        b = (a + 1) % len(pivots)
        if between[a, b] > 0:
            one, two = known[:, a, None] * to_pivots[None, :, b], known[:, b, None] * to_pivots[None, :, a]
            # a root is off by 2e-16 of its value, a product by three times that
            np.maximum(bound, (np.abs(one - two) - 1e-12 * (one + two)) / between[a, b] * (1 - 1e-12), out=bound)
    return bound


def nearest(x: np.ndarray, known: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid of each row, squared distance, distances calculated); ties go to the smaller number."""
    bound = lower_bounds(known, centroids, pivots)
    first = bound.argmin(1) if len(x) else np.zeros(0, np.int64)
    best, cluster, done = squared(x, centroids[first]), first.copy(), len(x)
    # squares of doubles again round by less than 1e-15
    bound = bound * bound * (1 - 1e-12)
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= best.astype(np.float64)) & (first != c))
        exact = squared(x[rows], centroids[c])
        done += len(rows)
        nearer = (exact < best[rows]) | ((exact == best[rows]) & (c < cluster[rows]))
        if exact.dtype == object and best.dtype != object:
            best = best.astype(object)
        best[rows[nearer]] = exact[nearer]
        cluster[rows[nearer]] = c
    return cluster, best, done


# ---------------------------------------------------------------- rounds

def _matrix(column, width: int, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def first_centroids(points: DataFrame, clusters: int, seed_text: str) -> np.ndarray:
    """The ``clusters`` vectors whose keys have the smallest hashes, in that order."""
    name = F.sha2(F.concat(F.lit(seed_text), F.col("key").cast("string")).cast("binary"), 256)
    # at most ``clusters`` rows
    rows = points.filter("key IS NOT NULL").select(name.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], np.int64) if rows else np.zeros((0, 0), np.int64)


def with_pivots(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """key, v, known: the points with their pivot distances."""
    def work(batches):
        import pyarrow as pa

        for batch in batches:
            known = pivot_distances(_matrix(batch.column(1), pivots.shape[1]), pivots)
            edges = pa.array(np.arange(0, known.size + 1, len(pivots)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(edges, pa.array(known.reshape(-1)))], ["key", "v", "known"])

    return points.mapInArrow(work, "key bigint, v array<bigint>, known array<double>")


def moved_centroids(points: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(centroids after one round, rows, distances calculated)."""
    k, dim = centroids.shape

    def sums(batches):
        import pyarrow as pa

        total, count, done, rows = np.zeros((k, dim), object), np.zeros(k, np.int64), 0, 0
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            cluster, _, n = nearest(x, _matrix(batch.column(1), len(pivots), np.float64), centroids, pivots)
            done, rows = done + n, rows + len(x)
            small = len(x) == 0 or max(int(x.max()), -int(x.min())) < 1 << 40
            for c in range(k):
                mine = x[cluster == c]
                total[c] += mine.sum(0) if small else mine.astype(object).sum(0)
                count[c] += len(mine)
        if rows:
            # component -1 is the number of rows; cluster -1 counts the work
            cells = [(c, j, total[c, j]) for c in range(k) if count[c] for j in range(dim)] + [(c, -1, count[c]) for c in range(k)] + [(-1, 0, rows), (-1, 1, done)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in cells], pa.int32()), pa.array([x[1] for x in cells], pa.int32()),
                                              pa.array([Decimal(int(x[2])) for x in cells], pa.decimal128(38, 0))], ["c", "j", "s"])

    found = points.select("v", "known").mapInArrow(sums, "c int, j int, s decimal(38,0)").groupBy("c", "j").agg(F.sum("s").alias("s"))
    # one row per centroid and component
    cells = {(r["c"], r["j"]): int(r["s"]) for r in found.collect()}
    new = centroids.copy()
    for c in range(k):
        n = cells.get((c, -1), 0)
        if n:
            new[c] = [cells[c, j] // n for j in range(dim)]
    return new, cells.get((-1, 0), 0), cells.get((-1, 1), 0)


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE,
                    seed_text: str = SEED_TEXT, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector of ``dimension`` finite components.

    Components become floor(scale * x), cut to 64 bits; distances are squared
    and, as their sums, cut to 64 bits.  Centroids start as the vectors of the
    smallest key hashes (fewer vectors than ``clusters``: all of them) and move
    ``rounds`` times to the floor of their vectors' mean; empty ones stay.
    Vectors that are null, of another length or hold null or non-finite
    components give no row.  Rows that repeat a key are vectors of their own;
    null keys are assigned, but start no centroid.  Ties go to the smaller
    number.  Tables without such vectors, or without keys, give no rows.
    """
    small_batches(vectors.sparkSession, 4096)
    usable = valid_vector(vector) & (F.size(vector) == dimension)
    points = vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col(key).cast("bigint").alias("key"), whole_numbers(vector, scale).alias("v"))
    pivots = first_centroids(points, clusters, seed_text)
    if not len(pivots):
        points = points.limit(0)
        pivots = np.zeros((1, dimension), np.int64)
    points = saved(with_pivots(points, pivots), "cluster-points")
    centroids, changes = pivots, 0
    for left in range(rounds, 0, -1):
        new, rows, done = moved_centroids(points, centroids, pivots)
        if (new == centroids).all():  # the rounds left would change nothing
            break
        centroids = new
        if 2 * done > len(pivots) * rows and changes < NEW_PIVOTS and left > 2:
            pivots, changes = centroids, changes + 1
            points = saved(with_pivots(points.select("key", "v"), pivots), "cluster-points")

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            cluster, distance, _ = nearest(_matrix(batch.column(1), dimension), _matrix(batch.column(2), len(pivots), np.float64), centroids, pivots)
            cut = distance if distance.dtype != object else [min(d, LARGEST) for d in distance]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(cut, pa.int64())], ["key", "cluster", "distance"])

    assigned = saved(points.mapInArrow(assign, "key bigint, cluster int, distance bigint"), "cluster-assigned")
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    # one row per centroid
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(wide.alias("s")).collect()}
    of_cluster = lambda values: F.array(*[F.lit(v) for v in values])[F.col("cluster")]
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return assigned.select("key", "cluster", "distance", of_cluster([min(inertia.get(c, 0), LARGEST) for c in range(len(centroids))]).cast("bigint").alias("cluster_inertia"),
                           F.lit(min(sum(inertia.values()), LARGEST)).cast("bigint").alias("inertia"), of_cluster(names).alias("centroid_sha256"))
