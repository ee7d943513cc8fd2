"""Column helpers: ids, file names, durations, sizes, dates, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted_confidence(score: Column) -> Column:
    """Self-weighted mean of the scores of at least 0.1; 0 when there are none."""
    s = F.when(score >= 0.1, score.cast("double"))
    total = F.sum(s * s)
    return F.when(total > 0, F.sum(s * s * s) / total).otherwise(F.lit(0.0))


def truncate(text: Column, max_length: int, suffix: str = "...") -> Column:
    keep = max(max_length - len(suffix), 0)
    return F.when(F.length(text) <= max_length, text).otherwise(
        F.concat(F.substring(text, 1, keep), F.lit(suffix)))


def sanitize_patient_id(value: Column) -> Column:
    kept = F.regexp_replace(value, r"[^\p{L}\p{N}_-]", "")
    return F.when(F.length(kept) > 0, kept).otherwise(F.lit("unknown_patient"))


def safe_filename(value: Column) -> Column:
    """Every character outside ASCII letters, digits, '-', '_' and '.' becomes '_'."""
    safe = F.regexp_replace(value, r"[^A-Za-z0-9_.-]", "_")
    return F.when(safe.startswith("."), F.concat(F.lit("file_"), safe)).otherwise(safe)


def sanitize_filename(value: Column) -> Column:
    """Unsafe characters become single underscores, none at either end."""
    merged = F.regexp_replace(F.regexp_replace(value, r'[<>:"/\\|?*]', "_"), "_+", "_")
    trimmed = F.regexp_replace(merged, "^_|_$", "")
    return F.when(F.length(trimmed) > 0, trimmed).otherwise(F.lit("unnamed_file"))


def is_patient_id(value: Column) -> Column:
    return value.rlike(r"\A[a-zA-Z0-9_-]{1,50}\n?\z")


def parse_duration(value: Column) -> Column:
    """'30s', '5m', '2h' or bare seconds as a number of seconds; null if malformed."""
    unit = F.substring(value, -1, 1)
    factor = F.when(unit == "m", 60).when(unit == "h", 3600).otherwise(1)
    number = F.regexp_extract(value, r"\A\s*([+-]?[0-9]+)\s*[smh]?\z", 1)
    return F.when(F.length(number) > 0, number.try_cast("bigint") * factor)


def one_decimal(value: Column) -> Column:
    """One decimal place; exact quarters round to even, as IEEE formatting does."""
    exact = F.pmod(value * 4, F.lit(1.0)) == 0
    return F.format_string("%.1f", F.when(exact, F.bround(value, 1)).otherwise(value))


def format_seconds(seconds: Column) -> Column:
    s = seconds.cast("double")
    whole = F.floor(s)
    minutes = F.floor(s / 60)
    hours = F.floor(s / 3600)
    return (
        F.when(s < 1, F.concat((s * 1000).cast("bigint").cast("string"), F.lit("ms")))
        .when(s < 60, F.concat(one_decimal(s), F.lit(" seconds")))
        .when(s < 3600, F.concat(minutes.cast("string"), F.lit("m "),
                                 (whole - minutes * 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h "),
                            (minutes - hours * 60).cast("string"), F.lit("m"))))


SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]


def format_bytes(size: Column, gap: str = " ") -> Column:
    """Binary units with one decimal; ``gap`` separates number and unit."""
    out = F.lit(f"0{gap}B")
    for power, unit in enumerate(SIZE_UNITS):
        scaled = F.concat(one_decimal(size / float(1024 ** power)), F.lit(f"{gap}{unit}"))
        at_least = 1024 ** power
        out = F.when(size >= at_least, scaled).otherwise(out) if power else F.when(size != 0, scaled).otherwise(out)
    return out


def mime_category(mime: Column) -> Column:
    return (F.when(mime.startswith("image/"), "image")
            .when(mime == "application/pdf", "pdf")
            .when(mime.startswith("application/vnd.openxmlformats-officedocument"), "office_document")
            .when(mime.startswith("text/"), "text")
            .otherwise("other"))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def age_years(dob: Column, as_of: Column) -> Column:
    """Completed years on ``as_of``."""
    before_birthday = (F.month(as_of) * 100 + F.dayofmonth(as_of)) < (F.month(dob) * 100 + F.dayofmonth(dob))
    return F.year(as_of) - F.year(dob) - F.when(before_birthday, 1).otherwise(0)


def period_days(period: Column) -> Column:
    """'2 years', '6 months', '90 days' as days; unknown units give a year."""
    low = F.lower(period)
    count = F.regexp_extract(period, r"^\s*([0-9]+)(?:\s|$)", 1).try_cast("int")
    return (F.when(low.contains("year"), F.coalesce(count, F.lit(1)) * 365)
            .when(low.contains("month"), F.coalesce(count, F.lit(6)) * 30)
            .when(low.contains("day"), F.coalesce(count, F.lit(90)))
            .otherwise(F.lit(365)))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once per row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def parse_date(value: Column) -> Column:
    """First of the nine accepted date layouts that fits; null when none does.

    Two-digit years pivot at 1969: 69-99 are 19xx, 00-68 are 20xx.
    """
    return bound(F.regexp_replace(F.trim(value), r"\s+", " "), _parsed).cast("timestamp_ntz")


def _parsed(v: Column) -> Column:
    slash = r"^([0-9]{1,2})([/-])([0-9]{1,2})\2([0-9]{2}|[0-9]{4})$"
    year = F.regexp_extract(v, slash, 4)
    two = year.try_cast("int")
    full = F.when(F.length(year) == 2,
                  F.when(two >= 69, two + 1900).otherwise(two + 2000)).otherwise(two)
    numeric = F.concat_ws("-", full.cast("string"), F.regexp_extract(v, slash, 1), F.regexp_extract(v, slash, 3))

    def month_first(named: Column) -> Column:
        return F.coalesce(
            F.try_to_timestamp(F.when(named.rlike(r"^[A-Z][a-z]{3,} [0-9]{1,2} [0-9]{4}$"), named), F.lit("MMMM d yyyy")),
            F.try_to_timestamp(F.when(named.rlike(r"^[A-Z][a-z]{2} [0-9]{1,2} [0-9]{4}$"), named), F.lit("MMM d yyyy")))

    return F.coalesce(
        F.try_to_timestamp(F.when(v.rlike(slash), numeric), F.lit("y-M-d")),
        F.try_to_timestamp(F.when(v.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), v), F.lit("yyyy-M-d")),
        bound(F.initcap(F.regexp_replace(F.lower(v), ",", "")), month_first))


def any_contains(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def word_count(text: Column) -> Column:
    """Whitespace-separated tokens."""
    return F.when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", 0).otherwise(
        F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "))).cast("bigint")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def string_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])
