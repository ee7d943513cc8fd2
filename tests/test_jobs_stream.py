import datetime as dt

from pyspark.sql import functions as F

from chartloom.operators import intake as S
from chartloom.operators import jobs as J
from chartloom.sources.keyed_store import KeyedStore
from chartloom.streaming import job_stream as JS

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, job_id long, ts timestamp_ntz, event string, progress double, error string"


def log(n=300):
    kinds = ["queue", "start", "progress", "fail", "complete", "cancel"]
    return [(i, i % 7 if i % 3 else 0, T0 + dt.timedelta(seconds=(i * 37) % 3000), kinds[(i * 5) % 6], float(i % 100), f"e{i}") for i in range(n)]


def test_stream_equals_batch_with_disorder_and_repeats(spark, tmp_path):
    rows = log()
    src = str(tmp_path / "in")
    for part in (rows[100:200], rows[:100] + rows[150:160], rows[200:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    events = JS.read_events(spark, src, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    JS.fold_stream(events, str(tmp_path / "state"), str(tmp_path / "ckpt"), compact_every=2).awaitTermination()
    got = J.job_view(JS.latest_state(spark, str(tmp_path / "state")), "2024-01-02")
    want = J.job_view(J.job_state(spark.createDataFrame(rows, SCHEMA)), "2024-01-02")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert len(JS._versions(spark, str(tmp_path / "state" / "delta" / "jobs"))) >= 3 and JS._versions(spark, str(tmp_path / "state" / "full" / "jobs"))
    # a later run adds to the stored state
    spark.createDataFrame([(999, 0, T0 + dt.timedelta(days=1), "cancel", 0.0, "")], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    JS.fold_stream(events, str(tmp_path / "state"), str(tmp_path / "ckpt")).awaitTermination()
    last = {r.job_id: r.status for r in J.job_view(JS.latest_state(spark, str(tmp_path / "state")), "2024-01-02").collect()}
    assert last[0] == "cancelled"


def test_window_counts_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = log() + [(1000, 1, T0 + dt.timedelta(days=3), "queue", 0.0, "")]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(src)
    events = JS.read_events(spark, src, spark.createDataFrame([], SCHEMA).schema)
    JS.count_windows(events, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = {(r.event, r.n) for r in spark.read.parquet(str(tmp_path / "out")).groupBy("event").agg(F.sum("n").alias("n")).collect()}
    want = {(r.event, r.n) for r in spark.createDataFrame(log(), SCHEMA).groupBy("event").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_events_days_late_and_repeated_later_count_once(spark, tmp_path):
    rows = [(i, i % 3, T0 + dt.timedelta(hours=7 * ((i * 13) % 40)), ["fail", "start", "progress"][i % 3 if i % 2 else 0], 1.0, f"e{i}") for i in range(40)]
    src = str(tmp_path / "in")
    for part in (rows[30:], rows[:20], rows[25:35] + rows[20:30], rows[5:8]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    events = JS.read_events(spark, src, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    JS.fold_stream(events, str(tmp_path / "state"), str(tmp_path / "ckpt"), compact_every=3).awaitTermination()
    got = J.job_view(JS.latest_state(spark, str(tmp_path / "state")), "2024-02-02")
    want = J.job_view(J.job_state(spark.createDataFrame(rows, SCHEMA)), "2024-02-02")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_events_correct_finished_windows(spark, tmp_path):
    """Files out of time order, a restart from the checkpoint in between: the stored counts are those of all events."""
    rows = log(400)
    src, store = str(tmp_path / "in"), str(tmp_path / "store")

    def run():
        events = JS.read_events(spark, src, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
        JS.fold_windows(events, store, str(tmp_path / "ckpt")).awaitTermination()

    for parts in ((rows[300:], rows[:100]), (rows[200:300], rows[100:200])):
        for part in parts:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        run()
    got = sorted(map(tuple, KeyedStore(spark, store).read().select("window_start", "event", "n").collect()))
    assert got == sorted(map(tuple, J.window_counts(spark.createDataFrame(rows, SCHEMA)).select("window_start", "event", "n").collect()))
    assert len(KeyedStore(spark, store).versions()) == 4


def test_health_and_retry(spark):
    df = spark.createDataFrame([(11,), (6,), (5,)], "n int").select(J.queue_health(F.col("n")))
    assert [r[0] for r in df.collect()] == ["degraded", "warning", "healthy"]
    jobs = spark.createDataFrame([(1, 0, 1), (2, 3, 3)], "job_id int, retry_count int, max_retries int")
    new, refused = J.retry(jobs, "2024-01-01")
    assert [(r.original_job_id, r.retry_count) for r in new.collect()] == [(1, 1)] and [r.job_id for r in refused.collect()] == [2]


def test_intake_rules(spark):
    rows = [("a.pdf", 10, "application/pdf", "x"), ("a.PNG", 99_000_000, "image/png", "x"), ("a.exe", 1, "application/pdf", "x"),
            ("a.txt", 1, "application/pdf", "x"), ("a.pdf", 1, "application/pdf", "<ScRipt>"), ("noext", 1, "text/plain", "x")]
    df = spark.createDataFrame(rows, "filename string, size long, mime string, body string")
    got = [(r.extension, r.error, len(r.warnings)) for r in S.validate_files(df).collect()]
    assert got == [("pdf", None, 0), ("png", "size", 0), ("exe", "extension", 0), ("txt", None, 1), ("pdf", "unsafe content", 0), ("", "extension", 0)]


def test_document_types(spark):
    df = spark.createDataFrame([("Radiology",), ("radiolgy",), ("zzz",)], "k string")
    got = {r.name: (r.resolved, r.suggestions) for r in S.resolve_document_types(df, "k").collect()}
    assert got["Radiology"] == ("radiology", []) and got["radiolgy"] == (None, ["radiology"]) and got["zzz"] == (None, [])
