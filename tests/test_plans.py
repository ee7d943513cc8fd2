"""Plans read their tables as often as they should, and long texts cost linear time."""

import re
import time

import pytest
from pyspark.sql import functions as F

from chartloom.operators import spans as E
from chartloom.plans import load

QUERIES, _ = load()


def scans(plan: str, table: str) -> int:
    return len(re.findall(rf"FileScan parquet [^\n]*/{table}\.parquet", plan))


@pytest.mark.parametrize("name,table", [("t08_structured_documents", "orders"), ("g21_patient_bundle", "lineitem"), ("g21_patient_bundle", "supplier"),
                                        ("g17_cross_patient_patterns", "lineitem"), ("g17_cross_patient_patterns", "supplier")])
def test_one_scan(spark, sf, name, table):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert scans(plan, table) == 1, plan


def test_span_extraction_is_linear(spark):
    def seconds(n):
        docs = spark.createDataFrame([(1, "glucose 101 mg/dL today. " * n)], "doc_id long, text string")
        out = E.resolve(E.extract(docs, E.pattern_rules(), E.pattern_score)).select(F.size("spans").alias("n"))
        start = time.time()
        rows = out.collect()[0]["n"]
        return time.time() - start, rows

    seconds(200)
    (few, n), (many, m) = seconds(5_000), seconds(20_000)
    assert m == 4 * n > 0 and many < 8 * few + 2
