import datetime as dt
import random

from chartloom.streaming import job_stream as JS
from chartloom.streaming import job_timers as JT

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, job_id long, ts timestamp_ntz, event string"
LIMIT = 600


def plain(rows, until):
    """Runs without a start or an end within the limit, for which the watermark has come."""
    marks = [r for r in rows if r[3] != "progress" and r[1] is not None and r[2] is not None]
    out = []
    for event_id, job, ts, event in marks:
        end = ts + dt.timedelta(seconds=LIMIT)
        if event == "start" and end <= until and not any(r[1] == job and ts < r[2] <= end for r in marks):
            out.append((job, event_id, (ts - T0).total_seconds()))
    return sorted(out)


def test_runs_time_out_over_files_and_a_restart(spark, tmp_path):
    random.seed(2)
    kinds = ["start", "start", "complete", "fail", "cancel", "progress"]
    rows = [(i, random.randrange(12), T0 + dt.timedelta(seconds=40 * i + random.randrange(-300, 300)), random.choice(kinds)) for i in range(300)]
    rows += [(500, None, T0 + dt.timedelta(seconds=50), "start"), (501, 3, None, "start"), (502, 40, T0, "start"), (503, 40, T0, "start")]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    first, second, third = rows[:100] + rows[300:], rows[100:200], rows[200:300]

    def run():
        events = JS.read_events(spark, src, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
        JT.time_out_runs(events, out, str(tmp_path / "ckpt"), LIMIT, "1 hour").awaitTermination()

    for parts in ((first, second), (third,)):
        for part in parts:
            random.shuffle(part)
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        run()
    until = max(r[2] for r in rows if r[2] and r[3] != "progress" and r[1] is not None) - dt.timedelta(hours=1)
    got = sorted((r.job_id, r.event_id, (r.started_ms - T0.replace(tzinfo=dt.UTC).timestamp() * 1000) / 1000) for r in spark.read.parquet(out).collect())
    assert got == plain(rows, until) and len(got) > 10
    assert (40, 502, 0.0) in got and (40, 503, 0.0) in got
    assert spark.conf.get(JT._PROVIDER, None) != JT._ROCKS
