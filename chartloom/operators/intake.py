"""Document intake: validation, recognized pages, batches, type resolution."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom import lexicons as L
from chartloom.functions.columns import any_contains, format_bytes, mime_category, string_map, strings, word_count
from chartloom.functions.ranking import top_k


def extension(filename: Column) -> Column:
    """Lower-cased suffix without the dot; a leading dot starts a name, not a suffix."""
    return F.lower(F.regexp_extract(filename, r"[^/.][^/]*\.([^./]+)$", 1))


def unsafe_signatures(body: Column) -> Column:
    low = F.lower(body)
    return F.filter(strings(L.UNSAFE_SIGNATURES), lambda s: low.contains(s))


def is_unsafe(body: Column) -> Column:
    return any_contains(F.lower(body), L.UNSAFE_SIGNATURES)


def validate_files(files: DataFrame, scan: bool = True) -> DataFrame:
    """Adds extension, sha256, error (of the first failing rule), is_valid and warnings.

    Rules in order: size by extension, media type, extension, unsafe content.
    An extension that does not fit the media type is only a warning.
    """
    ext = extension(F.col("filename"))
    limits = F.create_map(*[x for e, (_, n) in L.FILE_TYPES.items() for x in (F.lit(e), F.lit(n))])
    limit = F.coalesce(F.element_at(limits, ext), F.lit(L.DEFAULT_SIZE_LIMIT))
    by_type: dict[str, list[str]] = {}
    for e, (mime, _) in L.FILE_TYPES.items():
        by_type.setdefault(mime, []).append(e)
    expected = F.element_at(F.create_map(*[x for m, es in by_type.items() for x in (F.lit(m), strings(es))]), F.col("mime"))
    error = (F.when(F.col("size") > limit, "size").when(~F.col("mime").isin(list(by_type)), "media type")
             .when(~ext.isin(list(L.FILE_TYPES)), "extension"))
    if scan:
        error = error.when(is_unsafe(F.col("body")), "unsafe content")
    warning = F.when(error.isNull() & ~F.array_contains(expected, ext), F.concat(
        F.lit("File extension ."), ext, F.lit(" may not match detected type "), F.col("mime")))
    return files.select(
        "*", ext.alias("extension"), F.sha2("body", 256).alias("sha256"), error.alias("error"),
        error.isNull().alias("is_valid"), F.array_compact(F.array(warning)).alias("warnings"))


def inventory(files: DataFrame) -> DataFrame:
    """File rows (path, length, modificationTime) as listed: name, size, type, times.

    ``created`` is a column ``created`` of the input where there is one, else the
    time of the last change: file stores keep no other.
    """
    name = F.element_at(F.split("path", "/"), -1)
    mime = F.coalesce(F.element_at(string_map({e: m for e, (m, _) in L.FILE_TYPES.items()}), extension(name)),
                      F.lit("application/octet-stream"))
    kept = [c for c in files.columns if c not in ("path", "length", "modificationTime", "created")]
    created = F.col("created" if "created" in files.columns else "modificationTime")
    return files.select(*kept, "path", name.alias("filename"), F.col("length").alias("size"), format_bytes(F.col("length"), "").alias("size_human"),
                        mime.alias("mime"), mime_category(mime).alias("category"), created.alias("created"), F.col("modificationTime").alias("modified"),
                        extension(name).alias("extension"))


def expired(rows: DataFrame, modified: str, as_of: str, max_age_hours: int = 24) -> DataFrame:
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL '{int(max_age_hours)}' HOUR")
    return rows.filter(F.col(modified) < cutoff)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("ratio", T.DoubleType())])))
def _closest_types(names: pd.Series) -> pd.Series:
    """Known types with a matching-block ratio of at least 0.6, best first."""
    out = []
    for name in names:
        rated = [(difflib.SequenceMatcher(None, t, name).ratio(), t) for t in L.DOCUMENT_TYPES]
        out.append([{"type": t, "ratio": r} for r, t in sorted(rated, reverse=True) if r >= 0.6][:3])
    return pd.Series(out)


def resolve_document_types(rows: DataFrame, column: str) -> DataFrame:
    """Distinct type names with the known type they equal (case folded) or up to three suggestions.

    Only distinct unmatched names reach Python.
    """
    names = rows.select(F.col(column).alias("name")).distinct().withColumn("low", F.lower(F.trim("name")))
    resolved = F.when(F.col("low").isin(L.DOCUMENT_TYPES), F.col("low"))
    close = F.transform(_closest_types("low"), lambda x: x["type"])
    known = names.withColumn("resolved", resolved)
    nothing = F.array().cast("array<string>")
    return (known.filter(F.col("resolved").isNotNull()).withColumn("suggestions", nothing)
            .unionByName(known.filter(F.col("resolved").isNull()).withColumn("suggestions", close)).drop("low"))


def upload_rollup(files: DataFrame, key: str, status: str, created: str, as_of: str) -> DataFrame:
    """Counts, progress, age and possible actions of each upload batch."""
    rows = files.groupBy(key).agg(
        F.count(F.lit(1)).alias("files_count"), F.count_if(F.col(status) == "completed").alias("files_completed"),
        F.count_if(F.col(status) == "failed").alias("files_failed"), F.min(created).alias("created_at"))
    state = (F.when(F.col("files_failed") == F.col("files_count"), "failed")
             .when(F.col("files_completed") + F.col("files_failed") == F.col("files_count"), "completed").otherwise("processing"))
    actions = F.create_map(*[x for k, v in L.UPLOAD_ACTIONS.items() for x in (F.lit(k), strings(v))])
    return (rows.withColumn("status", state)
            .withColumn("progress", F.col("files_completed") / F.col("files_count") * 100.0)
            .withColumn("elapsed_seconds", F.timestamp_diff("MICROSECOND", F.col("created_at"), F.lit(as_of).cast("timestamp_ntz")) / 1e6)
            .withColumn("actions", F.coalesce(F.element_at(actions, F.col("status")), F.element_at(actions, F.lit("other")))))


def ocr_pages(words: DataFrame, pages: DataFrame, keys: list[str], threshold: float = 0.6) -> DataFrame:
    """Recognized words to pages.

    Blank and unsure words are dropped; a page's confidence is the mean of the
    rest (0 without any).  ``pages`` has a quality; low values raise issues.
    """
    kept = words.filter((F.trim("text") != "") & (F.col("conf") / 100.0 >= threshold))
    per = kept.groupBy(*keys).agg(F.avg(F.col("conf") / 100.0).alias("confidence"), F.count(F.lit(1)).alias("regions"))
    joined = pages.join(per, keys, "left").fillna(0.0, ["confidence"]).fillna(0, ["regions"])
    return joined.withColumn("issues", F.array_compact(F.array(
        F.when(F.col("quality") < 0.7, L.OCR_ISSUES["quality"]), F.when(F.col("confidence") < 0.8, L.OCR_ISSUES["confidence"]))))


def ocr_documents(pages: DataFrame, key: str) -> DataFrame:
    """Pages (page, text, confidence) to documents; text in page order with a blank line between."""
    good = F.col("confidence") > 0.5
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n")
    return pages.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_pages"), F.count_if(good).alias("pages_successful"), F.count_if(~good).alias("pages_failed"),
        F.avg("confidence").alias("overall_confidence"), text.alias("full_text")).withColumn("word_count", word_count(F.col("full_text")))


def batch_status(documents: DataFrame, key: str, failed: Column) -> DataFrame:
    n, bad = F.count(F.lit(1)), F.count_if(failed)
    return documents.groupBy(key).agg(n.alias("total"), bad.alias("failed")).withColumn(
        "status", F.when(F.col("failed") == 0, "completed").when(F.col("failed") == F.col("total"), "failed").otherwise("partial_success"))
