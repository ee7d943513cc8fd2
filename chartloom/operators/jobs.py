"""Processing jobs folded from their event log.

A job is the fold of its events: the newest value of every field.  The fold is
an aggregate, so a job with very many events is reduced before the exchange,
and it gives the same state in batch and in stream (``streaming.job_stream``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom import lexicons as L
from chartloom.functions.columns import seconds_between, string_map, strings
from chartloom.functions.ranking import position_in_group

STATE_EVENTS = {"queue": "queued", "start": "running", "complete": "completed", "fail": "failed", "cancel": "cancelled"}


def job_state(events: DataFrame) -> DataFrame:
    """Events (event_id, job_id, ts, event, progress, error) to one state row per job.

    Times of equal events go to the later event id.
    """
    state = F.element_at(string_map(STATE_EVENTS), F.col("event"))
    rows = events.withColumn("state", state)
    at = "struct(ts, event_id)"
    ended = "event IN ('complete', 'fail', 'cancel')"
    return rows.groupBy("job_id").agg(
        F.expr(f"max(struct(ts, event_id, state)) FILTER (WHERE state IS NOT NULL)").alias("status_at"),  # noqa: F541
        F.min("ts").alias("created_at"),
        F.expr("max(ts) FILTER (WHERE event = 'start')").alias("started_at"),
        F.expr(f"max(ts) FILTER (WHERE {ended})").alias("completed_at"),
        F.expr("max(struct(ts, event_id, progress)) FILTER (WHERE event = 'progress')").alias("progress_at"),
        F.expr("max(struct(ts, event_id, error)) FILTER (WHERE event = 'fail')").alias("error_at"),
        F.expr(f"count(DISTINCT {at}) FILTER (WHERE event = 'fail')").alias("n_errors"))


def job_view(states: DataFrame, as_of: str) -> DataFrame:
    """Current view with defaults and the running time in seconds."""
    end = F.coalesce("completed_at", F.lit(as_of).cast("timestamp_ntz"))
    return states.select(
        "job_id", F.coalesce("status_at.state", F.lit("queued")).alias("status"), "created_at", "started_at", "completed_at",
        F.coalesce("progress_at.progress", F.lit(0.0)).alias("progress"), F.col("error_at.error").alias("last_error"), "n_errors",
        seconds_between(F.col("started_at"), end).alias("processing_seconds"))


def with_defaults(jobs: DataFrame) -> DataFrame:
    """Unknown workflow, priority or state take their defaults."""
    low = F.lower("priority")
    return (jobs.withColumn("workflow", F.when(F.col("workflow").isin(list(L.WORKFLOWS)), F.col("workflow")).otherwise("complete_pipeline"))
            .withColumn("priority", F.when(low.isin(list(L.PRIORITIES)), low).otherwise("normal"))
            .withColumn("status", F.when(F.col("status").isin(L.JOB_STATES), F.col("status")).otherwise("queued")))


def queue_status(jobs: DataFrame) -> DataFrame:
    """Counts, mean duration of completed jobs, expected wait, active workflows, health: one row."""
    duration = F.when((F.col("status") == "completed") & F.col("started_at").isNotNull() & F.col("completed_at").isNotNull(),
                      seconds_between(F.col("started_at"), F.col("completed_at")))
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_jobs") for s in ("queued", "running", "completed", "failed")]
    row = jobs.agg(F.count(F.lit(1)).alias("total_jobs"), *counts, F.coalesce(F.avg(duration), F.lit(0.0)).alias("mean"),
                   F.array_sort(F.collect_set(F.when(F.col("status") == "running", F.col("workflow")))).alias("active_workflows"))
    wait = F.when(F.col("mean") > 0, F.col("queued_jobs") * F.col("mean")).otherwise(F.lit(0.0))
    return row.select("total_jobs", "queued_jobs", "running_jobs", "completed_jobs", "failed_jobs",
                      F.round("mean", 2).alias("average_processing_time"), F.round(wait, 2).alias("estimated_wait_time"),
                      queue_health(F.col("running_jobs")).alias("queue_health"), "active_workflows")


def queue_health(running: Column, cpu: Column | None = None, memory: Column | None = None) -> Column:
    """degraded above 10 running jobs (or 90 % load), warning above 5 (or 70 %)."""
    cpu, memory = (F.lit(0.0) if x is None else x for x in (cpu, memory))
    return (F.when((running > 10) | (cpu > 90) | (memory > 90), "degraded")
            .when((running > 5) | (cpu > 70) | (memory > 70), "warning").otherwise("healthy"))


def stages_of(workflow: Column) -> Column:
    return F.element_at(F.create_map(*[x for w, (s, _) in L.WORKFLOWS.items() for x in (F.lit(w), strings(s))]), workflow)


def job_metrics(jobs: DataFrame) -> DataFrame:
    """Queue and processing seconds, expected remaining seconds, completed stages."""
    busy, progress = F.col("processing_seconds"), F.col("progress")
    remaining = F.when((progress > 0) & (F.col("status") == "running") & (busy != 0), busy / (progress / 100) - busy)
    n = F.size(stages_of(F.col("workflow")))
    queue = seconds_between(F.col("created_at"), F.col("started_at"))

    def shown(c):
        return F.when(c != 0, F.round(c, 2))

    return jobs.select("job_id", "status", shown(queue).alias("queue_seconds"), shown(busy).alias("processing_seconds"),
                       shown(remaining).alias("remaining_seconds"), n.alias("total_stages"),
                       F.when(progress > 0, F.floor(progress / 100 * n)).otherwise(0).cast("int").alias("completed_stages"))


def validate_requests(requests: DataFrame) -> DataFrame:
    """All errors of a request (n_documents, n_paths, max_retries, timeout_seconds, workflow)."""
    errors = F.array_compact(F.array(
        F.when((F.col("n_documents") == 0) & (F.col("n_paths") == 0), L.REQUEST_ERRORS["documents"]),
        F.when(~F.col("max_retries").between(0, 10), L.REQUEST_ERRORS["retries"]),
        F.when(~F.col("timeout_seconds").between(30, 3600), L.REQUEST_ERRORS["timeout"]),
        F.when(~F.col("workflow").isin(list(L.WORKFLOWS)), F.concat(F.lit(L.REQUEST_ERRORS["workflow"]), F.col("workflow")))))
    return requests.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def retry(jobs: DataFrame, created_at: str) -> tuple[DataFrame, DataFrame]:
    """(new queued jobs, refused jobs): one more attempt while the limit allows it."""
    attempt = F.col("retry_count") + 1
    allowed = attempt <= F.col("max_retries")
    stage = F.concat(F.lit("Retry "), attempt.cast("string"), F.lit(" of "), F.col("max_retries").cast("string"),
                     F.lit(" - Job queued for processing"))
    new = jobs.filter(allowed).select(
        F.sha2(F.concat_ws("|", F.col("job_id").cast("string"), attempt.cast("string")), 256).alias("job_id"),
        F.lit("queued").alias("status"), F.col("job_id").alias("original_job_id"), attempt.alias("retry_count"), "max_retries",
        F.lit(created_at).cast("timestamp_ntz").alias("created_at"), stage.alias("current_stage"))
    return new, jobs.filter(~allowed)


def cancel(jobs: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(cancelled jobs, refused jobs): jobs in a final state stay as they are."""
    final = F.col("status").isin(L.FINAL_STATES)
    at = F.lit(as_of).cast("timestamp_ntz")
    done = jobs.filter(~final).withColumn("status", F.lit("cancelled")).withColumn("completed_at", at).withColumn(
        "processing_seconds", seconds_between(F.col("started_at"), at))
    return done, jobs.filter(final)


def workflow_stages(jobs: DataFrame) -> DataFrame:
    """One row per job and stage, in stage order, with the estimate of its workflow."""
    estimate = F.create_map(*[x for w, (_, s) in L.WORKFLOWS.items() for x in (F.lit(w), F.lit(s))])
    return jobs.select("job_id", "workflow", F.element_at(estimate, F.col("workflow")).alias("estimated_seconds"),
                       F.posexplode(stages_of(F.col("workflow"))).alias("position", "stage"))


def dispatch_order(jobs: DataFrame, bucket: Column) -> DataFrame:
    """Position of each job in the list of its priority, oldest first."""
    return position_in_group(jobs, ["priority"], [F.col("created_at"), F.col("job_id")], bucket)


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def window_counts(events: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Events per window and kind; works on a table and on a watermarked stream."""
    return events.groupBy(F.window("ts", width).alias("w"), "event").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "event", "n")
