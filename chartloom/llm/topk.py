"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is described by the means and deviations of its segments, on levels
from one segment for all of it to segments of a few components.  For segments
of length L with means m, n and deviations s, t the squared distance of two
vectors is at least L * ((m - n)^2 + (s - t)^2), so their inner product is at
most L * (m * n + s * t), summed over the segments.  A query first gets a
threshold from exact products of the most promising candidates; the bounds then
remove candidates level by level, and the survivors get exact products.  No
candidate is removed that could be among the k best.

Blocks of queries meet slices of candidates in a grid, so a task holds one slice
and one block whatever the tables' size; k rows per query and slice go on.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_BYTES = 32 << 20
BLOCK_BYTES = 8 << 20


def valid_vector(vector: str) -> Column:
    """Not null, and every component finite."""
    x = F.col(vector)
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def whole_numbers(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("bigint"))


def _levels(dim: int) -> list[list[tuple[int, int]]]:
    """Segments of each level, coarse to fine; lengths may differ by one."""
    out, count = [], 1
    while count <= max(1, dim // 2):
        edges = np.linspace(0, dim, count + 1).astype(int)
        out.append([(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a])
        count *= 4
    return out


def _statistics(x: np.ndarray, segments: list[tuple[int, int]]) -> np.ndarray:
    """sqrt(L) * mean and sqrt(L) * deviation of each segment: their products are the bounds' terms."""
    columns = []
    for a, b in segments:
        part = x[:, a:b]
        columns += [part.mean(1) * np.sqrt(b - a), part.std(1) * np.sqrt(b - a)]
    return np.stack(columns, 1) if columns else np.zeros((len(x), 0))


def _exact(candidates: np.ndarray, query: np.ndarray, safe: bool) -> np.ndarray:
    if safe:
        return candidates.astype(np.float64) @ query.astype(np.float64)
    if not len(candidates):
        return np.zeros(0)
    wide = candidates.astype(object) @ query.astype(object)
    return np.array([min(max(v, -(2**63)), 2**63 - 1) for v in wide], object)


def best_of_slice(query_ids, queries: np.ndarray, ids, vectors: np.ndarray, k: int) -> tuple[list, list, list]:
    """(query id, id, score) of the k best of one slice for each query of one block; ties to the smaller id."""
    out: tuple[list, list, list] = ([], [], [])
    if not len(ids) or not len(query_ids):
        return out
    dim = vectors.shape[1]
    top = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(dim, 1)
    safe = top < 2**52
    values, asked = vectors.astype(np.float64), queries.astype(np.float64)
    slack = 1e-6 + 1e-9 * np.linalg.norm(values, axis=1).max(initial=0) * np.linalg.norm(asked, axis=1)
    levels = _levels(dim)
    have, want = [_statistics(values, s) for s in levels], [_statistics(asked, s) for s in levels]
    for i, query_id in enumerate(query_ids):
        left = np.flatnonzero(ids != query_id)
        if len(left) > 4 * k and safe and dim > 1:
            bound = have[-1][left] @ want[-1][i] if len(levels) == 1 else have[1][left] @ want[1][i]
            first = left[np.argpartition(-bound, 2 * k)[:2 * k]]
            threshold = np.partition(_exact(vectors[first], queries[i], safe), len(first) - k)[len(first) - k]
            for h, w in zip(have, want, strict=True):  # coarse to fine
                left = left[h[left] @ w[i] + slack[i] >= threshold]
        scores = _exact(vectors[left], queries[i], safe)
        order = sorted(range(len(left)), key=lambda j: (-scores[j], ids[left[j]]))[:k] if not safe else np.lexsort((ids[left], -scores))[:k]
        for j in order:
            out[0].append(int(query_id))
            out[1].append(int(ids[left[j]]))
            out[2].append(int(scores[j]))
    return out


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256,
            slice_bytes: int = SLICE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k candidates of highest integer inner product for each query: query_id, rank, vec_id, score.

    A candidate with the query's own key is left out.  Vectors that are null or
    hold null or non-finite components, and null keys, take no part; queries
    meet candidates of the same length only.  Ties go to the smaller key.  A
    query key that repeats is asked once, with its greatest vector; candidates
    that repeat a key each count.  Products beyond 64 bits are cut to them.
    """
    spark = queries.sparkSession

    def prepared(df):
        rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & valid_vector("v"))
        return rows.select("id", whole_numbers("v", scale).alias("v")).withColumn("dim", F.size("v"))

    asked = prepared(queries).groupBy("id", "dim").agg(F.max("v").alias("v"))
    asked = asked.groupBy("id").agg(F.max(F.struct("dim", "v")).alias("x")).select("id", "x.dim", "x.v")
    given = prepared(candidates)
    size = given.agg(F.sum(8 * F.col("dim") + 16).alias("n")).first()["n"] or 0
    asked_size = asked.agg(F.sum(8 * F.col("dim") + 16).alias("n")).first()["n"] or 0
    slices = max(int(-(-size // slice_bytes)), 2 * spark.sparkContext.defaultParallelism)
    blocks = max(1, int(-(-asked_size // block_bytes)))
    left = (asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
            .withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))))
    right = (given.withColumn("slice", F.pmod(F.xxhash64(F.lit("slice"), "id", "v"), F.lit(slices)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))

    def search(one, other):
        import pyarrow as pa

        def matrix(table):
            n = table.num_rows
            flat = table.column("v").combine_chunks()
            values = (flat.flatten() if n else pa.array([], pa.int64())).to_numpy(zero_copy_only=False).astype(np.int64)
            return table.column("id").to_numpy(), values.reshape(n, len(values) // max(n, 1))

        (query_ids, q), (ids, x) = matrix(one), matrix(other)
        columns = best_of_slice(query_ids, q, ids, x, k)
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    keys = ["dim", "slice", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
