"""Ranks and top-k that do not put one key's rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.session import materialize

def position_in_group(df: DataFrame, keys: list[str], order: list[Column], bucket: Column,
                      name: str = "position") -> DataFrame:
    """1-based position of each row within ``keys`` in ``order``.

    ``bucket`` must be a non-decreasing function of ``order`` (a day of a
    timestamp, an id range).  Rows are numbered inside (keys, bucket) and
    shifted by the sizes of the earlier buckets, so a key that holds a large
    share of the rows is spread over as many tasks as it has buckets; only the
    bucket counts, not the rows, meet in one place.  Buckets of about the
    square root of the row count keep both sides small when there are no keys.
    """
    b, n, base = "__bucket", "__n", "__base"
    with_bucket = df.withColumn(b, bucket)
    counts = with_bucket.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, b, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(base))
    same = Window.partitionBy(*keys, b).orderBy(*order)
    ranked = with_bucket.withColumn(name, F.row_number().over(same))
    condition = ranked[b].eqNullSafe(offsets[b])
    for key in keys:
        condition = condition & ranked[key].eqNullSafe(offsets[key])
    columns = [ranked[c] for c in df.columns]
    return (ranked.join(offsets, condition)
            .select(*columns, (ranked[name] + offsets[base]).cast("bigint").alias(name)))


def global_position(df: DataFrame, order: list[Column], name: str = "position", parts: int | None = None) -> DataFrame:
    """1-based position of each row of a whole table in ``order``, which should end in a unique column.

    Ranges of the order, cut by Spark's sample of it, go to one partition each
    and are numbered there; a partition's first position follows from the sizes
    of those before it, one row a partition.  No window holds more than these,
    whatever the values of the order columns.  The numbered rows are checkpointed,
    as a second sample could cut the ranges elsewhere.
    """
    spark = df.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part, at = "__part", "__at"
    row = F.monotonically_increasing_id()  # the partition in the upper 31 bits, the place in it in the lower 33
    numbered = (df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*df.columns, row.alias(at))
                .withColumn(part, F.shiftright(F.col(at), 33)))
    numbered = materialize(numbered.withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1))))
    counts = numbered.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return numbered.join(bases, part).select(*df.columns, (F.col(at) + F.col("__base") + 1).cast("bigint").alias(name))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each key.

    Spark keeps only ``k`` rows per key and map task before the exchange
    (WindowGroupLimit), so the final task of a hot key sees k rows per input
    partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
