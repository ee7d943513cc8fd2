"""Query inputs that pass through a keyed store in several batches."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.session import checkpoint_dir
from chartloom.sources.keyed_store import KeyedStore


def scratch(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def halves(rows: DataFrame, by: str) -> list[DataFrame]:
    """The rows up to the mean of a column, and those after it."""
    middle = rows.agg(F.avg(by)).first()[0]
    return [rows.filter(F.col(by) <= F.lit(middle)), rows.filter(F.col(by) > F.lit(middle))]


def stored(name: str, parts: list[DataFrame], merge, keys: list[str]) -> KeyedStore:
    """A new store with the parts merged into it one after another; the last batch runs twice and counts once."""
    spark = parts[0].sparkSession
    schema = merge(None, parts[0]).schema
    store = KeyedStore.create(spark, scratch(spark, name), schema, keys, buckets=8)
    for i in [*range(len(parts)), len(parts) - 1]:
        store.apply(parts[i], merge, batch=f"part {i}")
    return store
