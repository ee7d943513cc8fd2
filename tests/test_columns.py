import datetime as dt

import pytest
from pyspark.sql import functions as F

from chartloom.functions import columns as U
from chartloom.functions.ranking import position_in_group, top_k


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,seconds", [("30s", 30), ("5m", 300), ("2h", 7200), ("45", 45), ("invalid", None), ("", None)])
def test_durations(spark, text, seconds):
    assert one(spark, U.parse_duration(F.lit(text))) == seconds


@pytest.mark.parametrize("seconds,shown", [(0.123, "123ms"), (5.67, "5.7 seconds"), (125.0, "2m 5s"), (7260.0, "2h 1m"), (20.25, "20.2 seconds")])
def test_seconds(spark, seconds, shown):
    assert one(spark, U.format_seconds(F.lit(seconds))) == shown


def test_names(spark):
    assert one(spark, U.sanitize_filename(F.lit("file<>:with|bad?chars*.txt"))) == "file_with_bad_chars_.txt"
    assert one(spark, U.sanitize_filename(F.lit(""))) == "unnamed_file"
    assert one(spark, U.safe_filename(F.lit(".a b"))) == "file_.a_b"
    assert one(spark, U.sanitize_patient_id(F.lit("é-1 /x_"))) == "é-1x_"
    assert one(spark, U.sanitize_patient_id(F.lit("!!"))) == "unknown_patient"
    assert one(spark, U.is_patient_id(F.lit("ab_1\n"))) is True
    assert one(spark, U.is_patient_id(F.lit("a b"))) is False


def test_truncate_and_sizes(spark):
    assert one(spark, U.truncate(F.lit("This is a very long text that goes on"), 20)) == "This is a very lo..."
    assert one(spark, U.truncate(F.lit("short"), 20)) == "short"
    assert [one(spark, U.format_bytes(F.lit(n))) for n in (0, 512, 1536, 5 * 1024 ** 2)] == ["0 B", "512.0 B", "1.5 KB", "5.0 MB"]
    assert one(spark, U.format_bytes(F.lit(1536), "")) == "1.5KB"


def test_weighted_confidence(spark):
    df = spark.createDataFrame([(0.9,), (0.05,), (0.5,)], "s double")
    assert df.agg(U.weighted_confidence(F.col("s"))).first()[0] == pytest.approx((0.729 + 0.125) / (0.81 + 0.25))
    assert df.filter("s < 0.1").agg(U.weighted_confidence(F.col("s"))).first()[0] == 0.0


@pytest.mark.parametrize("text", ["01/15/2024", "2024-01-15", "January 15, 2024", "Jan 15 2024", "1-15-24", "JANUARY 15 2024"])
def test_dates(spark, text):
    assert one(spark, U.parse_date(F.lit(text))) == dt.datetime(2024, 1, 15)


@pytest.mark.parametrize("text,year", [("1/2/69", 1969), ("1/2/68", 2068), ("bad", None), ("13/45/2020", None), ("1/2-2020", None)])
def test_date_pivot_and_failures(spark, text, year):
    got = one(spark, U.parse_date(F.lit(text)))
    assert (got.year if got else None) == year


def test_position_in_group_matches_plain_ranking_on_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i}", i * 7 % 1000, i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, at int, id int")
    got = {(r.k, r.id): r.position for r in position_in_group(df, ["k"], [F.col("at"), F.col("id")], F.floor(F.col("at") / 50)).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])), 1):
            want[(key, r[2])] = n
    assert got == want


def test_top_k_cuts_before_the_exchange(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = top_k(df, ["k"], [F.desc("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
