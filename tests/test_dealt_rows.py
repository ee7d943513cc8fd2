"""Tasks over notes hold about the same number of rows, however the file of the orders is cut."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chartloom.functions.spans import TASK_ROWS, dealt
from chartloom.plans.notes import notes


def _rows_by_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]


def test_one_row_group_in_many_splits(spark, tmp_path):
    n = 8 * TASK_ROWS
    orders = pa.table({"o_orderkey": pa.array(range(n), pa.int64()), "o_custkey": pa.array([7] * n, pa.int64()),
                       "o_orderdate": pa.array([0] * n, pa.timestamp("us")), "o_orderpriority": pa.array(["1-URGENT"] * n)})
    pq.write_table(orders, f"{tmp_path}/orders.parquet", row_group_size=n, compression="none")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = _rows_by_task(notes(spark, str(tmp_path)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(rows) == n and max(rows) < 1.1 * TASK_ROWS


@pytest.mark.parametrize("n", [0, 1, 999])
def test_dealt_rows_are_the_same_rows(spark, n):
    df = dealt(spark.range(n).withColumn("x", F.col("id") * 2), rows=10)
    assert sorted(map(tuple, df.collect())) == [(i, 2 * i) for i in range(n)]
    assert max(_rows_by_task(df), default=0) <= 30
