"""Registered queries for columns, intake and jobs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from chartloom import lexicons as L
from chartloom.functions import columns as U
from chartloom.functions.ranking import global_position
from chartloom.operators import graph as G
from chartloom.operators import intake as S
from chartloom.operators import jobs as J
from chartloom.plans import sqltext as X
from chartloom.plans.registry import query, table
from chartloom.plans.stores import halves, scratch
from chartloom.session import checkpoint_dir
from chartloom.sources import files as FS
from chartloom.sources.keyed_store import DuplicateKeys, KeyedStore
from chartloom.streaming import job_stream as JS
from chartloom.streaming import job_timers as JT

NOW = "2024-02-01 00:00:00"


# --- columns -----------------------------------------------------------------

@query("u01_weighted_confidence", """
SELECT l_orderkey AS doc_id, round(coalesce(sum(s * s * s) / nullif(sum(s * s), 0), 0), 6) AS confidence
FROM (SELECT l_orderkey, CASE WHEN l_discount * 10 >= 0.1 THEN l_discount * 10 END AS s FROM lineitem) GROUP BY l_orderkey""")
def u01(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.round(U.weighted_confidence(F.col("l_discount") * 10), 6).alias("confidence"))


@query("u02_truncated", "SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE left(text, 117) || '...' END AS short FROM documents")
def u02(spark, sf):
    return table(spark, sf, "documents").select("doc_id", U.truncate(F.col("text"), 120).alias("short"))


@query("u03_batches", """
SELECT o_orderkey AS id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 50 AS batch FROM orders""")
def u03(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return global_position(rows, [F.col("id")]).select("id", F.floor((F.col("position") - 1) / 50).alias("batch"))


@query("u04_patient_ids", "SELECT c_custkey AS id, coalesce(nullif(regexp_replace(c_name || CASE WHEN c_custkey % 7 = 0 THEN ' é/1' ELSE '-x' END, '[^\\pL\\pN_-]', '', 'g'), ''), 'unknown_patient') AS clean FROM customer")
def u04(spark, sf):
    raw = F.concat("c_name", F.when(F.col("c_custkey") % 7 == 0, " é/1").otherwise("-x"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), U.sanitize_patient_id(raw).alias("clean"))


@query("u05_file_names", """
SELECT page_id, CASE WHEN starts_with(s, '.') THEN 'file_' || s ELSE s END AS safe, coalesce(nullif(trim(regexp_replace(regexp_replace(url, '[<>:"/\\\\|?*]', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'unnamed_file') AS clean
FROM (SELECT *, regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g') AS s FROM pages)""")
def u05(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.safe_filename(F.col("url")).alias("safe"),
                                            U.sanitize_filename(F.col("url")).alias("clean"))


@query("u06_id_checks", "SELECT c_custkey AS id, regexp_matches(c_name, '^[a-zA-Z0-9_-]{1,50}$') AS plain, regexp_matches(replace(c_name, '#', '_'), '^[a-zA-Z0-9_-]{1,50}$') AS marked FROM customer")
def u06(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), U.is_patient_id(F.col("c_name")).alias("plain"),
                                               U.is_patient_id(F.replace("c_name", F.lit("#"), F.lit("_"))).alias("marked"))


@query("u07_durations", """WITH t AS (SELECT event_id, event_id::VARCHAR || CASE event_type WHEN 'click' THEN 's' WHEN 'view' THEN 'm' WHEN 'error' THEN 'h' WHEN 'signup' THEN 'x' ELSE '' END AS d FROM events)
SELECT event_id, d, (try_cast(regexp_extract(d, '^([0-9]+)[smh]?$', 1) AS BIGINT) * CASE right(d, 1) WHEN 'm' THEN 60 WHEN 'h' THEN 3600 ELSE 1 END)::BIGINT AS seconds FROM t""")
def u07(spark, sf):
    unit = F.coalesce(F.element_at(U.string_map({"click": "s", "view": "m", "error": "h", "signup": "x"}), F.col("event_type")), F.lit(""))
    rows = table(spark, sf, "events").select("event_id", F.concat(F.col("event_id").cast("string"), unit).alias("d"))
    return rows.withColumn("seconds", U.parse_duration(F.col("d")))


@query("u08_times", """WITH t AS (SELECT event_id, value * value / 4 AS s FROM events)
SELECT event_id, CASE WHEN s < 1 THEN trunc(s * 1000)::BIGINT || 'ms' WHEN s < 60 THEN printf('%.1f', s) || ' seconds'
  WHEN s < 3600 THEN floor(s / 60)::BIGINT || 'm ' || (floor(s)::BIGINT % 60) || 's' ELSE floor(s / 3600)::BIGINT || 'h ' || floor((s - floor(s / 3600) * 3600) / 60)::BIGINT || 'm' END AS shown FROM t""")
def u08(spark, sf):
    s = F.col("value") * F.col("value") / 4
    return table(spark, sf, "events").select("event_id", U.format_seconds(s).alias("shown"))


@query("u09_sizes", """WITH t AS (SELECT doc_id, n_chars * (doc_id % 5) * 1500 AS n FROM documents)
SELECT doc_id, CASE WHEN n = 0 THEN '0 B' WHEN n < 1024 THEN printf('%.1f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) ELSE printf('%.1f GB', n / 1073741824.0::DOUBLE) END AS spaced FROM t""")
def u09(spark, sf):
    n = F.col("n_chars") * (F.col("doc_id") % 5) * 1500
    return table(spark, sf, "documents").select("doc_id", U.format_bytes(n).alias("spaced"))


_MIMES = ["image/png", "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/html", "audio/ogg"]


def _cycle(key, values):
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@query("u10_categories", f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'pdf' WHEN 2 THEN 'office_document' WHEN 3 THEN 'text' ELSE 'other' END AS category FROM pages""")
def u10(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.mime_category(F.expr(_cycle("page_id", _MIMES))).alias("category"))


# --- intake ------------------------------------------------------------------

_EXTS = ["pdf", "txt", "docx", "exe", "jpg", "PNG", "xlsx"]
_FILE_MIMES = ["application/pdf", "text/plain", "image/jpeg", "application/x-msdownload", "image/png"]
_FILE_COLUMNS = [f"'scan.' || doc_id || '.' || {_cycle('doc_id', _EXTS)} AS filename", "n_chars * 5000 AS size",
                 f"{_cycle('doc_id', _FILE_MIMES)} AS mime",
                 "CASE WHEN doc_id % 11 = 0 THEN '<SCRIPT>' || text ELSE text END AS body"]


def _files(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id", *_FILE_COLUMNS)


_SQL_FILES = f"files AS (SELECT doc_id, {', '.join(_FILE_COLUMNS)} FROM documents)"
_SQL_EXT = "lower(regexp_extract(filename, '\\.([^./]+)$', 1))"


@query("s01_file_validation", f"""WITH {_SQL_FILES}, f AS (SELECT *, {_SQL_EXT} AS extension FROM files),
j AS (SELECT *, CASE WHEN size > coalesce({'CASE extension ' + ' '.join(f"WHEN '{e}' THEN {n}" for e, (_, n) in L.FILE_TYPES.items()) + ' END'}, 52428800) THEN 'size'
  WHEN mime NOT IN ({', '.join(X.q(m) for m, _ in L.FILE_TYPES.values())}) THEN 'media type' WHEN extension NOT IN ({', '.join(X.q(e) for e in L.FILE_TYPES)}) THEN 'extension'
  WHEN {X.contains_any('lower(body)', L.UNSAFE_SIGNATURES)} THEN 'unsafe content' END AS error,
  {X.lookup('extension', {e: m for e, (m, _) in L.FILE_TYPES.items()})} AS expected FROM f)
SELECT doc_id, extension, sha256(body) AS sha256, error, error IS NULL AS is_valid,
  CASE WHEN error IS NULL AND expected <> mime THEN 'File extension .' || extension || ' may not match detected type ' || mime ELSE '' END AS warnings FROM j""")
def s01(spark, sf):
    return S.validate_files(_files(spark, sf)).select("doc_id", "extension", "sha256", "error", "is_valid",
                                                      F.array_join("warnings", "|").alias("warnings"))


@query("s02_unsafe_content", f"""SELECT page_id, {X.contains_any('lower(html)', L.UNSAFE_SIGNATURES)} AS unsafe,
  array_to_string(list_filter([{', '.join(X.q(s) for s in L.UNSAFE_SIGNATURES)}], lambda s: contains(lower(html), s)), '|') AS hits FROM pages""")
def s02(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.is_unsafe(F.col("html")).alias("unsafe"),
                                            F.array_join(S.unsafe_signatures(F.col("html")), "|").alias("hits"))


def _scratch(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _document_store(spark, sf):
    """The valid form of every document with its checksum, written by category and patient."""
    docs = _files(spark, sf).join(table(spark, sf, "documents").select("doc_id", F.col("source").alias("patient_id")), "doc_id")
    path = _scratch(spark, "documents")
    FS.write_documents(docs.withColumn("sha256", F.sha2("body", 256)), path)
    return path


_SQL_STORE = f"""{_SQL_FILES}, store AS (SELECT files.*, source AS patient_id, CASE WHEN starts_with(mime, 'image/') THEN 'image' ELSE 'document' END AS category
  FROM files JOIN documents USING (doc_id))"""


@query("s03_document_store", f"""WITH {_SQL_STORE} SELECT doc_id, patient_id, category, size, filename, mime, sha256(body) AS sha256,
  'category=' || category || '/patient_id=' || patient_id AS folder, true AS has_size, true AS has_time FROM store""")
def s03(spark, sf):
    """Written by category and patient; a metadata row per document, with the file that Spark finds it in."""
    rows = FS.stored_documents(spark, _document_store(spark, sf))
    return rows.select("doc_id", "patient_id", "category", "size", "filename", "mime", "sha256",
                       F.regexp_extract("stored_path", "/(category=[^/]*/patient_id=[^/]*)/[^/]*$", 1).alias("folder"),
                       (F.col("stored_size") > 0).alias("has_size"), F.col("created_at").isNotNull().alias("has_time"))


_SQL_KNOWN_MIME = X.lookup("extension", {e: m for e, (m, _) in L.FILE_TYPES.items()})


@query("s04_inventory", f"""WITH {_SQL_FILES}, f AS (SELECT doc_id, filename, size, {_SQL_EXT} AS extension FROM files),
m AS (SELECT *, coalesce({_SQL_KNOWN_MIME}, 'application/octet-stream') AS mime FROM f)
SELECT doc_id, filename, size, CASE WHEN size = 0 THEN '0B' WHEN size < 1024 THEN printf('%.1fB', size::DOUBLE) WHEN size < 1048576 THEN printf('%.1fKB', size / 1024.0::DOUBLE)
  WHEN size < 1073741824 THEN printf('%.1fMB', size / 1048576.0::DOUBLE) ELSE printf('%.1fGB', size / 1073741824.0::DOUBLE) END AS size_human, mime,
  CASE WHEN starts_with(mime, 'image/') THEN 'image' WHEN mime = 'application/pdf' THEN 'pdf' WHEN starts_with(mime, 'application/vnd.openxmlformats-officedocument') THEN 'office_document'
  WHEN starts_with(mime, 'text/') THEN 'text' ELSE 'other' END AS category, extension FROM m""")
def s04(spark, sf):
    """The stored documents as files: name, size and type of each."""
    files = _files(spark, sf).select("doc_id", F.concat(F.lit("/store/in/"), "filename").alias("path"), F.col("size").alias("length"),
                                     F.lit(None).cast("timestamp").alias("modificationTime"))
    rows = S.inventory(files)
    return rows.select("doc_id", "filename", "size", "size_human", "mime", "category", "extension")


@query("s04_stored_files", f"""WITH {_SQL_STORE} SELECT category, patient_id, count(*) AS documents, 'parquet' AS extension, true AS has_size, true AS has_time
FROM store GROUP BY category, patient_id""")
def s04_stored(spark, sf):
    """The inventory of the files that hold the stored documents, summed by folder."""
    rows = S.inventory(FS.stored_files(spark, _document_store(spark, sf), ["category", "patient_id"]))
    return rows.groupBy(F.col("folder_category").alias("category"), F.col("folder_patient_id").alias("patient_id")).agg(
        F.sum("documents").alias("documents"), F.max("extension").alias("extension"),
        F.min((F.col("size") > 0) & (F.col("size_human") != "0B")).alias("has_size"),
        F.min((F.col("created") <= F.col("modified"))).alias("has_time"))


@query("s05_expired", "SELECT event_id, user_id FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR")
def s05(spark, sf):
    return S.expired(table(spark, sf, "events"), "ts", "2024-01-20 00:00:00", 24).select("event_id", "user_id")


_TYPES = ["Lab_Report", "lab report", "RADIOLOGY", "radiolgy", "prescriptions", "clinical note", "consent", "unknown thing"]


#: Expected suggestions of the names above that are near a known type; all other names are near none.
_NEAR_TYPES = {"lab report": "lab_report", "radiolgy": "radiology", "prescriptions": "prescription", "clinical note": "clinical_notes", "consent": "consent_form"}


@query("s06_document_types", f"""WITH n AS (SELECT {_cycle('doc_id', _TYPES)} AS name FROM documents UNION SELECT p_type FROM part)
SELECT name, CASE WHEN lower(trim(name)) IN ({', '.join(X.q(t) for t in L.DOCUMENT_TYPES)}) THEN lower(trim(name)) END AS resolved,
  coalesce({X.lookup('name', _NEAR_TYPES)}, '') AS suggestions FROM n""")
def s06(spark, sf):
    """Names given to documents, resolved or with suggestions."""
    rows = table(spark, sf, "documents").select(F.expr(_cycle("doc_id", _TYPES)).alias("kind")).unionAll(
        table(spark, sf, "part").select("p_type"))
    return S.resolve_document_types(rows, "kind").withColumn("suggestions", F.array_join("suggestions", "|"))


@query("s07_uploads", f"""WITH r AS (SELECT user_id AS upload_id, count(*) AS files_count, count(*) FILTER (event_type = 'purchase') AS files_completed,
  count(*) FILTER (event_type = 'error') AS files_failed, min(ts) AS created_at FROM events GROUP BY user_id)
SELECT upload_id, files_count, files_completed, files_failed, round(files_completed / files_count::DOUBLE * 100, 6) AS progress,
  round(date_diff('microsecond', created_at, TIMESTAMP '{NOW}') / 1e6, 3) AS elapsed_seconds,
  CASE WHEN files_failed = files_count THEN 'failed' WHEN files_failed + files_completed = files_count THEN 'completed' ELSE 'processing' END AS status,
  CASE WHEN files_failed = files_count THEN '{'|'.join(L.UPLOAD_ACTIONS['failed'])}' WHEN files_failed + files_completed = files_count THEN '{'|'.join(L.UPLOAD_ACTIONS['completed'])}' ELSE '{'|'.join(L.UPLOAD_ACTIONS['other'])}' END AS actions FROM r""")
def s07(spark, sf):
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("processing")
    files = table(spark, sf, "events").select(F.col("user_id").alias("upload_id"), status.alias("state"), "ts")
    out = S.upload_rollup(files, "upload_id", "state", "ts", NOW)
    return out.select("upload_id", "files_count", "files_completed", "files_failed", F.round("progress", 6).alias("progress"),
                      F.round("elapsed_seconds", 3).alias("elapsed_seconds"), "status", F.array_join("actions", "|").alias("actions"))


@query("s08_ocr_pages", """WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, l_quantity * 2 AS conf, CASE WHEN l_returnflag = 'N' THEN ' ' ELSE l_returnflag END AS text FROM lineitem),
p AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, max(l_tax) * 12.5 AS quality FROM lineitem GROUP BY ALL),
k AS (SELECT doc_id, page, avg(conf / 100.0::DOUBLE) AS c, count(*) AS n FROM w WHERE trim(text) <> '' AND conf / 100.0::DOUBLE >= 0.6 GROUP BY ALL)
SELECT doc_id, page, round(coalesce(c, 0), 6) AS confidence, coalesce(n, 0) AS regions,
  concat_ws('|', CASE WHEN quality < 0.7 THEN 'Low image quality detected' END, CASE WHEN coalesce(c, 0) < 0.8 THEN 'Low OCR confidence' END) AS issues FROM p LEFT JOIN k USING (doc_id, page)""")
def s08(spark, sf):
    li = table(spark, sf, "lineitem")
    keys = [F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page")]
    words = li.select(*keys, (F.col("l_quantity") * 2).alias("conf"), F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_returnflag")).alias("text"))
    pages = li.groupBy(*keys).agg((F.max("l_tax") * 12.5).alias("quality"))
    out = S.ocr_pages(words, pages, ["doc_id", "page"])
    return out.select("doc_id", "page", F.round("confidence", 6).alias("confidence"), "regions", F.array_join("issues", "|").alias("issues"))


@query("s09_ocr_documents", """WITH p AS (SELECT conv_id AS doc_id, turn AS page, text, CASE role WHEN 'user' THEN 0.9 WHEN 'assistant' THEN 0.4 ELSE 0.5 END::DOUBLE AS confidence FROM conversations),
d AS (SELECT doc_id, count(*) AS total_pages, count(*) FILTER (confidence > 0.5) AS pages_successful, count(*) FILTER (confidence <= 0.5) AS pages_failed,
  round(avg(confidence), 6) AS overall_confidence, string_agg(text, chr(10) || chr(10) ORDER BY page, text) AS full_text FROM p GROUP BY doc_id)
SELECT *, len(list_filter(string_split_regex(full_text, '\\s+'), lambda w: w <> '')) AS word_count FROM d""")
def s09(spark, sf):
    conf = F.when(F.col("role") == "user", 0.9).when(F.col("role") == "assistant", 0.4).otherwise(0.5)
    pages = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text", conf.alias("confidence"))
    return S.ocr_documents(pages, "doc_id").withColumn("overall_confidence", F.round("overall_confidence", 6))


@query("s10_batch_status", """SELECT user_id AS batch_id, count(*) AS total, count(*) FILTER (event_type = 'error' AND value > 60) AS failed,
  CASE WHEN count(*) FILTER (event_type = 'error' AND value > 60) = 0 THEN 'completed' WHEN count(*) FILTER (event_type = 'error' AND value > 60) = count(*) THEN 'failed' ELSE 'partial_success' END AS status FROM events GROUP BY user_id""")
def s10(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("user_id", "batch_id")
    return S.batch_status(e, "batch_id", (F.col("event_type") == "error") & (F.col("value") > 60))


@query("s11_csv_export", "SELECT r_regionkey, n_nationkey, n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def s11(spark, sf):
    """A result written as CSV and read back."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    df = (c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
          .groupBy("r_regionkey", "n_nationkey", "n_name").agg(F.count(F.lit(1)).alias("customers")))
    path = _scratch(spark, "export")
    FS.write_csv(df, path)
    return FS.read_csv(spark, path, df.schema)


@query("s12_unique_write", "SELECT o_orderkey AS id, o_custkey AS patient_id FROM orders")
def s12_write(spark, sf):
    """Visits written in two batches; a batch that repeats stored ids is refused as a whole in between."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("patient_id"))
    first, second = halves(rows, "id")
    store = KeyedStore.create(spark, scratch(spark, "visits"), rows.schema, ["id"], buckets=8)
    store.insert(first)
    try:
        store.insert(rows)
    except DuplicateKeys:
        store.insert(second)
    return store.read()


@query("s12_duplicate_ids", """WITH n AS (SELECT 'Patient' AS label, c_custkey::VARCHAR AS id FROM customer UNION ALL SELECT 'Visit', o_orderkey::VARCHAR FROM orders
  UNION ALL SELECT 'Medication', p_name FROM part UNION ALL SELECT 'Edge', l_orderkey || '-' || l_linenumber FROM lineitem)
SELECT label, id, count(*) AS n FROM n GROUP BY ALL HAVING count(*) > 1""")
def s12(spark, sf):
    c, o, p, li = (table(spark, sf, t) for t in ("customer", "orders", "part", "lineitem"))
    nodes = (c.select(F.lit("Patient").alias("label"), F.col("c_custkey").cast("string").alias("id"))
             .unionAll(o.select(F.lit("Visit"), F.col("o_orderkey").cast("string")))
             .unionAll(p.select(F.lit("Medication"), "p_name"))
             .unionAll(li.select(F.lit("Edge"), F.concat_ws("-", "l_orderkey", "l_linenumber"))))
    return G.check_unique(nodes)


# --- jobs --------------------------------------------------------------------

_EVENTS = {"signup": "queue", "view": "start", "click": "progress", "purchase": "complete", "error": "fail"}
_JOB_EVENTS = [f"{X.lookup('event_type', _EVENTS)} AS event", "user_id AS job_id", "least(value, 100.0) AS progress", "props AS error"]


def job_events(df):
    return df.selectExpr("event_id", "ts", *_JOB_EVENTS)


_WF = f"{_cycle('job_id', [*L.WORKFLOWS, 'other'])}"


def _jobs(spark, sf):
    view = J.job_view(J.job_state(job_events(table(spark, sf, "events"))), NOW)
    return J.with_defaults(view.withColumn("workflow", F.expr(_WF)).withColumn("priority", F.expr(_cycle("job_id", ["HIGH", "low", "none", "urgent"]))))


_SQL_JOBS = f"""ev AS (SELECT event_id, ts, {', '.join(_JOB_EVENTS)} FROM events),
jobs AS (SELECT job_id, CASE arg_max(event, row(ts, event_id)) FILTER (event <> 'progress') WHEN 'queue' THEN 'queued' WHEN 'start' THEN 'running' WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' ELSE 'queued' END AS status,
  min(ts) AS created_at, max(ts) FILTER (event = 'start') AS started_at, max(ts) FILTER (event IN ('complete', 'fail')) AS completed_at,
  coalesce(arg_max(progress, row(ts, event_id)) FILTER (event = 'progress'), 0) AS progress, arg_max(error, row(ts, event_id)) FILTER (event = 'fail') AS last_error,
  count(*) FILTER (event = 'fail') AS n_errors, CASE job_id % 6 {' '.join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(L.WORKFLOWS))} ELSE 'complete_pipeline' END AS workflow,
  CASE job_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'normal' ELSE 'urgent' END AS priority FROM ev GROUP BY job_id),
jv AS (SELECT *, date_diff('microsecond', started_at, coalesce(completed_at, TIMESTAMP '{NOW}')) / 1e6 AS processing_seconds FROM jobs)"""


@query("j01_queue_status", f"""WITH {_SQL_JOBS}, m AS (SELECT avg(date_diff('microsecond', started_at, completed_at) / 1e6) FILTER (status = 'completed') AS a,
  count(*) AS total_jobs, {', '.join(f"count(*) FILTER (status = '{s}') AS {s}_jobs" for s in ('queued', 'running', 'completed', 'failed'))},
  coalesce(string_agg(DISTINCT workflow, '|' ORDER BY workflow) FILTER (status = 'running'), '') AS active_workflows FROM jv)
SELECT total_jobs, queued_jobs, running_jobs, completed_jobs, failed_jobs, round(coalesce(a, 0), 2) AS average_processing_time,
  round(CASE WHEN a > 0 THEN queued_jobs * a ELSE 0 END, 2) AS estimated_wait_time,
  CASE WHEN running_jobs > 10 THEN 'degraded' WHEN running_jobs > 5 THEN 'warning' ELSE 'healthy' END AS queue_health, active_workflows FROM m""")
def j01(spark, sf):
    return J.queue_status(_jobs(spark, sf)).withColumn("active_workflows", F.array_join("active_workflows", "|"))


@query("j02_health_by_workflow", f"""WITH {_SQL_JOBS} SELECT workflow, count(*) FILTER (status = 'running') AS running,
  CASE WHEN count(*) FILTER (status = 'running') > 10 THEN 'degraded' WHEN count(*) FILTER (status = 'running') > 5 THEN 'warning' ELSE 'healthy' END AS health FROM jv GROUP BY workflow""")
def j02(spark, sf):
    per = _jobs(spark, sf).groupBy("workflow").agg(F.count_if(F.col("status") == "running").alias("running"))
    return per.withColumn("health", J.queue_health(F.col("running")))


_SQL_VIEW = """SELECT job_id, status, created_at::VARCHAR AS created_at, started_at::VARCHAR AS started_at, completed_at::VARCHAR AS completed_at,
  round(progress, 4) AS progress, last_error, n_errors, round(processing_seconds, 3) AS processing_seconds"""


def _view(jobs):
    micro = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    shown = [F.regexp_replace(F.date_format(c, micro), r"\.?0+$", "").alias(c) for c in ("created_at", "started_at", "completed_at")]
    return jobs.select("job_id", "status", *shown, F.round("progress", 4).alias("progress"), "last_error", "n_errors",
                       F.round("processing_seconds", 3).alias("processing_seconds"))


_SQL_TIMES = ("regexp_replace(strftime({0}, '%Y-%m-%d %H:%M:%S.%f'), '\\.?0+$', '') AS {0}")
_SQL_JOB_VIEW = (f"WITH {_SQL_JOBS} SELECT job_id, status, " + ", ".join(_SQL_TIMES.format(c) for c in ("created_at", "started_at", "completed_at"))
                 + ", round(progress, 4) AS progress, last_error, n_errors, round(processing_seconds, 3) AS processing_seconds FROM jv")


@query("j03_job_view", _SQL_JOB_VIEW)
def j03(spark, sf):
    return _view(J.job_view(J.job_state(job_events(table(spark, sf, "events"))), NOW))


@query("j04_job_metrics", f"""WITH {_SQL_JOBS}, n AS (SELECT *, CASE workflow WHEN 'ocr_only' THEN 1 WHEN 'ocr_to_ner' THEN 2 WHEN 'insight_generation' THEN 1 ELSE 6 END AS k,
  date_diff('microsecond', created_at, started_at) / 1e6 AS q FROM jv)
SELECT job_id, status, CASE WHEN q <> 0 THEN round(q, 2) END AS queue_seconds, CASE WHEN processing_seconds <> 0 THEN round(processing_seconds, 2) END AS processing_seconds,
  CASE WHEN progress > 0 AND status = 'running' AND processing_seconds <> 0 THEN nullif(round(processing_seconds / (progress / 100) - processing_seconds, 2), 0) END AS remaining_seconds,
  k AS total_stages, CASE WHEN progress > 0 THEN floor(progress / 100 * k) ELSE 0 END::INT AS completed_stages FROM n""")
def j04(spark, sf):
    return J.job_metrics(_jobs(spark, sf))


@query("j05_stream_fold", _SQL_JOB_VIEW)
def j05(spark, sf):
    """The event log in several files out of time order, one file a batch; the final state equals the batch view."""
    log = table(spark, sf, "events")
    source = _scratch(spark, "job-log")
    log.repartition(5, F.xxhash64("event_id")).write.parquet(source)
    events = job_events(JS.read_events(spark, source, log.schema, files_per_batch=1))
    state = _scratch(spark, "job-state")
    JS.fold_stream(events, state, _scratch(spark, "job-fold")).awaitTermination()
    return _view(J.job_view(JS.latest_state(spark, state), NOW))


@query("j05_window_counts", f"""WITH {_SQL_JOBS} SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event, count(*) AS n FROM ev GROUP BY ALL""")
def j05_windows(spark, sf):
    out = J.window_counts(job_events(table(spark, sf, "events")))
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("j05_window_fold", f"""WITH {_SQL_JOBS} SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event, count(*) AS n FROM ev GROUP BY ALL""")
def j05_window_fold(spark, sf):
    """The same counts kept by a stream over several files that are out of time order; late rows correct finished windows."""
    log = table(spark, sf, "events")
    source, store = _scratch(spark, "window-log"), _scratch(spark, "window-store")
    log.repartition(3, F.xxhash64("event_id")).write.parquet(source)
    events = job_events(JS.read_events(spark, source, log.schema, files_per_batch=1))
    JS.fold_windows(events, store, _scratch(spark, "window-fold")).awaitTermination()
    return KeyedStore(spark, store).read().withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


_RUN_LIMIT = 1800


@query("j05_run_timeouts", f"""WITH {_SQL_JOBS}, m AS (SELECT job_id, event_id, event, epoch_us(ts) // 1000 AS ms FROM ev WHERE event IN ('start', 'complete', 'fail', 'cancel')),
n AS (SELECT *, min(ms) OVER (PARTITION BY job_id ORDER BY ms RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after_ms FROM m)
SELECT job_id, event_id, ms AS started_ms, ms + {_RUN_LIMIT * 1000} AS failed_ms FROM n
WHERE event = 'start' AND ms + {_RUN_LIMIT * 1000} <= (SELECT max(ms) - 3600000 FROM m) AND (after_ms IS NULL OR after_ms > ms + {_RUN_LIMIT * 1000})""")
def j05_run_timeouts(spark, sf):
    """Runs that neither ended nor began anew within half an hour, by timers on the stream's state."""
    events = job_events(JS.read_events(spark, sf, table(spark, sf, "events").schema, pattern="events.parquet"))
    out = _scratch(spark, "run-timeouts")
    JT.time_out_runs(events, out, _scratch(spark, "run-timers"), _RUN_LIMIT).awaitTermination()
    return spark.read.schema(JT.RESULT).parquet(out)


_REQUEST = ["o_orderkey AS id", "o_orderkey % 3 AS n_documents", "o_custkey % 2 AS n_paths", "o_custkey % 14 - 1 AS max_retries",
            "o_orderkey % 4000 AS timeout_seconds", f"{_cycle('o_custkey', [*L.WORKFLOWS, 'nightly'])} AS workflow"]


@query("j06_request_validation", f"""WITH r AS (SELECT {', '.join(_REQUEST)} FROM orders)
SELECT id, concat_ws('|', CASE WHEN n_documents = 0 AND n_paths = 0 THEN 'At least one document_id or file_path must be provided' END,
  CASE WHEN max_retries NOT BETWEEN 0 AND 10 THEN 'max_retries must be between 0 and 10' END, CASE WHEN timeout_seconds NOT BETWEEN 30 AND 3600 THEN 'timeout_seconds must be between 30 and 3600' END,
  CASE WHEN workflow = 'nightly' THEN 'Invalid workflow_type: nightly' END) AS errors FROM r""")
def j06(spark, sf):
    out = J.validate_requests(table(spark, sf, "orders").selectExpr(*_REQUEST))
    return out.select("id", F.array_join("errors", "|").alias("errors"))


@query("j07_retries", f"""WITH {_SQL_JOBS}, f AS (SELECT job_id, n_errors // 4 AS retry_count, job_id % 5 + 1 AS max_retries FROM jv WHERE status = 'failed')
SELECT sha256(job_id || '|' || (retry_count + 1)) AS job_id, job_id AS original_job_id, 'queued' AS status, retry_count + 1 AS retry_count, 'Retry ' || (retry_count + 1) || ' of ' || max_retries || ' - Job queued for processing' AS current_stage FROM f WHERE retry_count + 1 <= max_retries
UNION ALL SELECT job_id::VARCHAR, job_id, 'refused', retry_count, NULL FROM f WHERE retry_count + 1 > max_retries""")
def j07(spark, sf):
    failed = _jobs(spark, sf).filter("status = 'failed'").select(
        "job_id", F.floor(F.col("n_errors") / 4).alias("retry_count"), (F.col("job_id") % 5 + 1).alias("max_retries"))
    new, refused = J.retry(failed, NOW)
    cols = ["job_id", "original_job_id", "status", "retry_count", "current_stage"]
    return new.select(*cols).unionByName(refused.select(F.col("job_id").cast("string").alias("job_id"), F.col("job_id").alias("original_job_id"),
                                                        F.lit("refused").alias("status"), "retry_count", F.lit(None).cast("string").alias("current_stage")))


@query("j08_cancellations", f"""WITH {_SQL_JOBS} SELECT job_id, CASE WHEN status IN ('completed', 'failed') THEN 'refused' ELSE 'cancelled' END AS outcome,
  CASE WHEN status NOT IN ('completed', 'failed') THEN round(date_diff('microsecond', started_at, TIMESTAMP '{NOW}') / 1e6, 3) END AS seconds FROM jv""")
def j08(spark, sf):
    done, refused = J.cancel(_jobs(spark, sf), NOW)
    return done.select("job_id", F.lit("cancelled").alias("outcome"), F.round("processing_seconds", 3).alias("seconds")).unionByName(
        refused.select("job_id", F.lit("refused").alias("outcome"), F.lit(None).cast("double").alias("seconds")))


@query("j09_workflow_stages", f"""WITH {_SQL_JOBS}, w AS (SELECT unnest([{', '.join(X.q(w) for w in L.WORKFLOWS)}]) AS workflow, unnest([{', '.join(str(s) for _, s in L.WORKFLOWS.values())}]) AS estimated_seconds,
  unnest([{', '.join('[' + ', '.join(X.q(x) for x in s) + ']' for s, _ in L.WORKFLOWS.values())}]) AS st)
SELECT job_id, workflow, estimated_seconds, unnest(range(len(st)))::INT AS position, unnest(st) AS stage FROM jv JOIN w USING (workflow)""")
def j09(spark, sf):
    return J.workflow_stages(_jobs(spark, sf))


@query("j10_dispatch_order", """SELECT o_orderkey AS job_id, o_orderpriority AS priority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS position FROM orders""")
def j10(spark, sf):
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("priority"),
                                             F.col("o_orderdate").alias("created_at"))
    return J.dispatch_order(jobs, F.to_date("created_at")).select("job_id", "priority", "position")


@query("j11_status_counts", f"WITH {_SQL_JOBS} SELECT status, count(*) AS n FROM jv GROUP BY status")
def j11(spark, sf):
    return J.status_counts(_jobs(spark, sf))
