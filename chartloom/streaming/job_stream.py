"""The job log as a stream.

``fold_stream`` keeps job states as partial folds: every micro-batch is folded
on its own and written as one delta, so a batch costs what its events cost and
not what the whole state costs; now and then the deltas are merged into a full
version.  Every part of a state may be merged again and again without a change:
newest values are maxima by (time, event id), and errors are kept as rows of
(job, time, event id) and counted as distinct rows when the state is read.  So
no event is dropped for being late, and one that repeats in a later batch counts
once.  A delta is named by its batch id: a batch that runs again after a failure
rewrites its own folder and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators.jobs import job_state, window_counts
from chartloom.sources.keyed_store import KeyedStore


def read_events(spark: SparkSession, path: str, schema, pattern: str | None = None, files_per_batch: int = 100) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def merge_states(parts: DataFrame) -> DataFrame:
    """Partial states of jobs as one row per job, without the error count."""
    newest = ["status_at", "started_at", "completed_at", "progress_at", "error_at"]
    return parts.groupBy("job_id").agg(*[F.max(c).alias(c) for c in newest], F.min("created_at").alias("created_at"))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Batch ids with a finished state version below ``path``."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(root)
                  if s.getPath().getName().startswith("v=")
                  and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))


def _folders(spark: SparkSession, path: str, up_to: int | None) -> list[str]:
    """The newest full version and the deltas after it."""
    def known(kind: str) -> list[int]:
        return [v for v in _versions(spark, f"{path}/{kind}/jobs") if up_to is None or v <= up_to]

    full = known("full")[-1:]
    deltas = [v for v in known("delta") if not full or v > full[-1]]
    return [f"{path}/full/{{}}/v={v}" for v in full] + [f"{path}/delta/{{}}/v={v}" for v in deltas]


def _parts(spark: SparkSession, path: str, up_to: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(merged states, distinct errors) of all versions."""
    folders = _folders(spark, path, up_to)
    if not folders:
        return None
    jobs, errors = (spark.read.parquet(*[f.format(kind) for f in folders]) for kind in ("jobs", "errors"))
    return merge_states(jobs), errors.distinct()


def latest_state(spark: SparkSession, path: str, up_to: int | None = None) -> DataFrame | None:
    """The state of all jobs, as ``job_state`` gives it for the same events."""
    parts = _parts(spark, path, up_to)
    if parts is None:
        return None
    jobs, errors = parts
    counts = errors.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_errors"))
    return jobs.join(counts, "job_id", "left").withColumn("n_errors", F.coalesce("n_errors", F.lit(0)))


def _with_event_time(events: DataFrame) -> DataFrame:
    """Watermarks need a zoned timestamp; a zoneless one is read in the session zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def fold_stream(events: DataFrame, state_path: str, checkpoint: str, compact_every: int = 20):
    """Start the fold; returns the streaming query.

    Events may come late, out of order and repeatedly, in any split into batches.
    """
    def upsert(batch: DataFrame, batch_id: int) -> None:
        folder = f"{state_path}/delta/{{}}/v={batch_id}"
        # the errors first: a version counts once its jobs are there
        batch.filter("event = 'fail'").select("job_id", "ts", "event_id").distinct().write.mode("overwrite").parquet(folder.format("errors"))
        job_state(batch).drop("n_errors").write.mode("overwrite").parquet(folder.format("jobs"))
        if (batch_id + 1) % compact_every == 0:
            jobs, errors = _parts(batch.sparkSession, state_path, batch_id)
            errors.write.mode("overwrite").parquet(f"{state_path}/full/errors/v={batch_id}")
            jobs.write.mode("overwrite").parquet(f"{state_path}/full/jobs/v={batch_id}")

    return events.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_windows(events: DataFrame, out_path: str, checkpoint: str, width: str = "5 minutes", watermark: str = "1 hour"):
    """Finished windows appended to a table.

    A window is appended once and only after the watermark passed it, so an event
    that comes later than that is not in its count; ``fold_windows`` keeps counts
    that late events correct.
    """
    counts = window_counts(_with_event_time(events).withWatermark("ts", watermark), width)
    return (counts.writeStream.outputMode("append").format("parquet").option("path", out_path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def fold_windows(events: DataFrame, store_path: str, checkpoint: str, width: str = "5 minutes"):
    """Counts of all windows in a keyed store (window_start, event, n), right after every batch.

    A batch is counted by itself and its counts are added to those of its
    windows, whenever these began; only the buckets of its windows are written.
    A batch that runs again after a failure counts once.
    """
    spark = events.sparkSession

    def add(batch: DataFrame, batch_id: int) -> None:
        counts = window_counts(batch, width)
        store = KeyedStore(spark, store_path)
        store.apply(counts, lambda old, new: old.unionByName(new.select(*old.columns)).groupBy(*store.keys).agg(F.sum("n").alias("n")), batch=str(batch_id))

    if not KeyedStore.exists(spark, store_path):
        KeyedStore.create(spark, store_path, "window_start timestamp_ntz, event string, n bigint", ["window_start", "event"])
    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
