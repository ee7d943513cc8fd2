"""Near-duplicate vectors by Euclidean p-stable hashing.

Equal vectors of a label are one class.  A class's normalised vector gets one
key per table: a few random projections, shifted and quantised.  Classes that
share a key in a table meet, and exact cosines decide.  Unit vectors with cosine
c are sqrt(2 - 2c) apart, which gives the chance of a shared key; the number of
tables follows from the wanted recall, the number of projections from the number
of classes, so that buckets of unrelated vectors stay small at every size.

A pair that shares keys in several tables counts in the first of them only.
Pairs are not emitted: a bucket gives sums of links per class and a few edges
that connect what it linked.  Buckets of more than ``block`` classes are split
into block pairs, so a task holds two blocks at most.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.links import components
from chartloom.llm.shared import mix, saved, small_batches, sorted_groups
from chartloom.llm.topk import valid_vector

WIDTH = 1.5
RECALL = 0.9995
BLOCK = 2048
SEED = 20240611


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection agrees for points ``distance`` apart."""
    if distance <= 0:
        return 1.0
    r = width / distance
    normal = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(n: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """(projections per table, tables): unrelated vectors leave buckets of about 16."""
    far, near = collision(math.sqrt(2.0)), collision(math.sqrt(2 - 2 * cosine))
    projections = max(3, math.ceil(math.log(max(n, 2) / 16) / -math.log(far)))
    return projections, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**projections)))


def table_keys(unit: np.ndarray, projections: int, tables: int, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """One 32-bit key per vector and table."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    directions = rng.normal(size=(unit.shape[1], projections * tables))
    cells = np.floor((unit @ directions + rng.uniform(0, width, projections * tables)) / width).astype(np.int64).astype(np.uint64)
    out = np.zeros((len(unit), tables), np.uint64)
    for j in range(projections):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + cells[:, j::projections][:, :tables] + np.uint64(j + 1))
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _linked(left: np.ndarray, right: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with cosine of at least the limit, in double precision."""
    near = left @ right.T
    i, j = np.nonzero(near >= cosine - 1e-12)
    exact = np.einsum("ij,ij->i", left[i], right[j]) if len(i) < 4_000_000 else near[i, j]
    keep = exact >= cosine
    return i[keep], j[keep]


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join the trees of all pairs (a, b) in ``root``; returns the roots that moved and where each went."""
    moved, to = [], []
    while True:
        one, two = root[a], root[b]
        apart = one != two
        if not apart.any():
            break
        high, low = np.maximum(one[apart], two[apart]), np.minimum(one[apart], two[apart])
        np.minimum.at(root, high, low)
        high = np.unique(high)
        moved.append(high)
        to.append(root[high])
        while (root[root] != root).any():
            root[:] = root[root]
    if not moved:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(moved), np.concatenate(to)


def class_links(classes: DataFrame, tables: int, cosine: float, block: int = BLOCK) -> DataFrame:
    """(kind, a, b): kind 0 is b links of class a, kind 1 an edge between a and b.

    ``classes`` has cid, label, dim, n, v and keys.
    """
    spots = classes.select("cid", "label", "dim", F.posexplode("keys").alias("t", "key"))
    bucket = ["label", "dim", "t", "key"]
    sizes = spots.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / block).cast("int")
    crowded = spots.join(sizes, bucket).withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # a block meets itself and every other one once
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    crowded = crowded.withColumn("other", other).select("cid", *bucket, "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    rows = crowded.join(classes.select("cid", "n", "v", "keys"), "cid")
    group = [*bucket, "i", "j"]

    def compare(batches):
        import pyarrow as pa

        for table in sorted_groups(batches, group):
            if table.num_rows < 2:
                continue
            t, i, j = (table.column(c)[0].as_py() for c in ("t", "i", "j"))
            mine = table.column("mine").to_numpy()
            ids, weight = table.column("cid").to_numpy(), table.column("n").to_numpy()
            unit, keys = _unit(_matrix(table.column("v"))), _matrix(table.column("keys"))
            left = np.arange(len(ids)) if i == j else np.flatnonzero(mine == i)
            right = left if i == j else np.flatnonzero(mine == j)
            if not len(left) or not len(right):
                continue
            sums, edges_a, edges_b = np.zeros(len(ids), np.int64), [], []
            root = np.arange(len(ids))
            for at in range(0, len(left), 512):
                part = left[at:at + 512]
                a, b = _linked(unit[part], unit[right], cosine)
                a, b = part[a], right[b]
                keep = a < b if i == j else np.ones(len(a), bool)
                a, b = a[keep], b[keep]
                for earlier in range(t):
                    fresh = keys[a, earlier] != keys[b, earlier]
                    a, b = a[fresh], b[fresh]
                np.add.at(sums, a, weight[b])
                np.add.at(sums, b, weight[a])
                hooked, to = _unite(root, a, b)
                edges_a += ids[hooked].tolist()
                edges_b += ids[to].tolist()
            some = np.flatnonzero(sums)
            kinds = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(edges_a), np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.concatenate([ids[some], np.array(edges_a, np.int64)])),
                                              pa.array(np.concatenate([sums[some], np.array(edges_b, np.int64)]))], ["kind", "a", "b"])

    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(parts, *group).sortWithinPartitions(*group).mapInArrow(compare, "kind int, a bigint, b bigint")


def link_vectors(vectors: DataFrame, cosine: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                 recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """key, n_links, component, kept of every row.

    Rows with equal, non-null labels link where the cosine of their vectors, in
    double precision, is at least ``cosine``.  Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, nor do rows
    with a null key or label.  Rows that repeat a key are vectors of their own
    for ``n_links``.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    x = F.col("v")
    rows = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(vector).alias("v"), F.col(label).alias("label"))
    usable = valid_vector("v") & (F.size(x) > 0) & F.exists(x, lambda c: c != 0) & F.col("label").isNotNull() & F.col("key").isNotNull()
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    rows = rows.withColumn("v", F.when(F.col("ok"), F.transform(x, lambda c: c.cast("double"))))
    rows = rows.withColumn("cid", F.when(F.col("ok"), F.xxhash64("label", "v")))
    classes = saved(rows.filter("ok").groupBy("cid", "label", "v").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")), "vector-classes")
    projections, tables = parameters(classes.count(), cosine, recall)

    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = table.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = table.take(pa.array(np.flatnonzero(dims == dim)))
                keys = table_keys(_unit(_matrix(part.column("v"))), projections, tables)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.reshape(-1)))
                yield from part.append_column("keys", flat).combine_chunks().to_batches()

    kinds = classes.schema["label"].dataType.simpleString()
    small_batches(spark, 2000)
    keyed = classes.select("cid", "label", "n", F.size("v").alias("dim"), "v")
    keyed = saved(keyed.mapInArrow(hashed, f"cid bigint, label {kinds}, n bigint, dim int, v array<double>, keys array<int>"), "vector-keys")
    found = saved(class_links(keyed, tables, cosine, block), "vector-links")
    sums = found.filter("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("links"))
    groups = components(found.filter("kind = 1").select("a", "b"))
    named = saved(classes.join(sums, "cid", "left").join(groups.withColumnRenamed("id", "cid"), "cid", "left")
                  .select("cid", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                          F.coalesce("component", "cid").alias("group")), "vector-groups")
    smallest = named.groupBy("group").agg(F.min("least").alias("component"))
    named = named.join(smallest, "group").select("cid", "n_links", "component")
    out = rows.select("key", "cid").join(named, "cid", "left")
    component = F.coalesce("component", "key")
    return out.select("key", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component"),
                      F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))
