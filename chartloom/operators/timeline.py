"""Patient timelines from dated chunks.

Facts travel as rows (patient, day, kind, value); sets are de-duplicated before
they are collected.  A patient has at most one entry per day, so an assembled
timeline is bounded by calendar days.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom import lexicons as L
from chartloom.functions.columns import any_contains
from chartloom.functions.ranking import top_k
from chartloom.functions.spans import let, literal
from chartloom.operators.chunks import strip_sql, visit_date_of

FACTS = ["symptoms", "tests", "medications", "diagnoses", "procedures"]


def visit_day(visit_date: Column, text: Column, as_of: str) -> Column:
    return F.to_date(F.coalesce(visit_date, visit_date_of(text), F.lit(as_of).cast("timestamp_ntz")))


def _captured(patterns: list[str]) -> str:
    """First groups of all matches; a pattern runs only where its first words stand, or on a text that is not plain ASCII."""
    def one(p: str) -> str:
        word = re.match(r"[a-z ]+(?![?*{])", p).group().strip()
        return (f"CASE WHEN contains(__low, {literal(word)}) OR octet_length(text) <> length(text) THEN regexp_extract_all(text, {literal('(?iU)' + p)}, 1) "
                "WHEN text IS NOT NULL THEN CAST(array() AS array<string>) END")

    return "concat(" + ", ".join(map(one, patterns)) + ")"


def facts(chunks: DataFrame) -> DataFrame:
    """Adds the six fact arrays of a chunk (text, spans)."""
    words = "array(" + ", ".join(literal(w) for w in L.FACT_SYMPTOMS) + ")"
    first = strip_sql("filter(sentences, (p, i) -> contains(lows[i], w))[0]")
    symptoms = let(f"filter({words}, w -> contains(__low, w))", "found", "CASE WHEN size(found) = 0 THEN CAST(array() AS array<string>) ELSE " + let(
        "split(text, '\\\\.')", "sentences", let("transform(sentences, p -> lower(p))", "lows", f"transform(found, w -> {first})")) + " END")
    low = F.col("__low")
    tested = F.expr("transform(filter(spans, s -> s.label IN ('lab_values', 'vitals')), s -> s.text)")
    nothing = F.array().cast("array<string>")
    note = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    return (chunks.withColumn("__low", F.lower("text")).withColumn("symptoms", F.array_compact(F.expr(symptoms)))
            .withColumn("tests", F.when(any_contains(low, L.FACT_TESTS), tested).otherwise(nothing))
            .withColumn("medications", F.expr("transform(filter(spans, s -> s.label = 'medication'), s -> s.text)"))
            .withColumn("diagnoses", F.expr(_captured(L.FACT_DIAGNOSES))).withColumn("procedures", F.expr(_captured(L.FACT_PROCEDURES)))
            .withColumn("progress_notes", F.when(any_contains(low, L.FACT_NOTES), F.array(note)).otherwise(nothing)).drop("__low"))


def chunk_confidence() -> Column:
    """Mean span confidence of a chunk, 0.5 without spans."""
    return F.when(F.size("spans") > 0, F.expr("aggregate(spans, 0D, (a, s) -> a + s.confidence) / size(spans)")).otherwise(F.lit(0.5))


def fact_rows(chunks_with_facts: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys, kind, value)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("values")) for k in FACTS])
    return (chunks_with_facts.select(*keys, F.explode(pairs).alias("p"))
            .select(*keys, "p.kind", F.explode("p.values").alias("value")).distinct())


def entries(chunks: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """One entry per (keys, day) from chunks with facts, day and confidence.

    ``sums`` are summed over the chunks of an entry.  Rows without a chunk (text
    null) give an entry without chunks.

    Lists are sets in name order; notes and chunk ids keep duplicates in the
    order given.  Facts and chunks go through one aggregate: the sets are
    de-duplicated on the map side and the chunks are read once.
    """
    parts = ", ".join(f"transform({k}, v -> struct('{k}' AS kind, v AS value))" for k in FACTS)
    alone = "array(struct(CASE WHEN text IS NULL THEN 'none' ELSE 'chunk' END AS kind, CAST(NULL AS STRING) AS value))"
    items = F.expr(f"concat(CASE WHEN text IS NOT NULL THEN concat({parts}) ELSE array() END, {alone})")
    extra = [v.alias(f"__sum_{k}") for k, v in (sums or {}).items()]
    rows = chunks.select(*keys, "visit_day", "chunk_confidence", *order, "chunk_id", "progress_notes", *extra, F.explode(items).alias("i"))
    is_chunk = F.col("i.kind") == "chunk"
    per = rows.groupBy(*keys, "visit_day").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("i.kind") == k, F.col("i.value")))).alias(k) for k in FACTS],
        F.avg(F.when(is_chunk, F.col("chunk_confidence"))).alias("confidence"), F.count_if(is_chunk).alias("n_chunks"),
        *[F.sum(F.when(is_chunk, F.col(f"__sum_{k}"))).alias(k) for k in sums or {}],
        F.array_sort(F.collect_list(F.when(is_chunk, F.struct(*order, "chunk_id", "progress_notes")))).alias("__c"))
    return per.select(
        *keys, "visit_day", F.concat(F.lit("visit_"), F.col("visit_day").cast("string")).alias("visit_id"), *FACTS,
        F.flatten(F.transform("__c", lambda c: c["progress_notes"])).alias("progress_notes"),
        F.transform("__c", lambda c: c["chunk_id"]).alias("chunk_ids"), "confidence", "n_chunks", *(sums or {}))


def entry_confidences(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, visit_day, confidence) of the entries, for results that need nothing else of them: no facts travel."""
    return chunks.groupBy(*keys, "visit_day").agg(F.avg("chunk_confidence").alias("confidence"))


def threshold_report(entry_rows: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Kept and dropped entries, mean confidence of the kept ones, first and last day."""
    kept = F.col("confidence") >= threshold
    return entry_rows.groupBy(*keys).agg(
        F.count_if(kept).alias("total_visits"), F.count_if(~kept).alias("dropped"),
        F.coalesce(F.avg(F.when(kept, F.col("confidence"))), F.lit(0.0)).alias("confidence_score"),
        F.min(F.when(kept, F.col("visit_day"))).alias("first_day"), F.max(F.when(kept, F.col("visit_day"))).alias("last_day"))


def summary(headers: DataFrame, entry_rows: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Adds the summary text: span, visits, up to three diagnoses, medications and symptoms.

    Names are taken in order; only three per kind are kept before they meet
    their patient.
    """
    kinds = [("diagnoses", "Key diagnoses"), ("medications", "Medications"), ("symptoms", "Primary symptoms")]
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("values")) for k, _ in kinds])
    named = (entry_rows.filter(F.col("confidence") >= threshold).select(*keys, F.explode(pairs).alias("p"))
             .select(*keys, "p.kind", F.explode("p.values").alias("value")).distinct())
    few = top_k(named, [*keys, "kind"], [F.asc("value")], 3)
    lists = few.groupBy(*keys).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("value")))).alias(f"__{k}") for k, _ in kinds])
    parts = [F.concat(F.lit("Patient medical timeline spanning "), F.col("first_day").cast("string"), F.lit(" to "),
                      F.col("last_day").cast("string"), F.lit(" with "), F.col("total_visits").cast("string"), F.lit(" visit(s)."))]
    for k, title in kinds:
        parts.append(F.when(F.size(f"__{k}") > 0, F.concat(F.lit(f"{title}: "), F.array_join(f"__{k}", ", "), F.lit("."))))
    text = F.when(F.col("total_visits") > 0, F.concat_ws(" ", *parts)).otherwise(L.EMPTY_TIMELINE)
    return headers.join(lists, keys, "left").withColumn("summary", text).drop(*[f"__{k}" for k, _ in kinds])


def assemble(patients: DataFrame, entry_rows: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """One timeline per patient: entries by day, counts and span; empty for patients without one."""
    kept = entry_rows.filter(F.col("confidence") >= threshold)
    fields = [c for c in entry_rows.columns if c not in (key, "visit_day")]
    per = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("visit_day", *fields))).alias("entries"),
                                F.count(F.lit(1)).alias("total_visits"), F.min("visit_day").alias("first_day"),
                                F.max("visit_day").alias("last_day"))
    return patients.select(key).join(per, key, "left").withColumn("total_visits", F.coalesce("total_visits", F.lit(0)))


def entry_text(entry: Column | None = None) -> Column:
    """An entry rendered for embedding; ``entry`` is a struct, or the row itself."""
    at = (lambda k: entry[k]) if entry is not None else F.col
    titles = [("Symptoms", "symptoms"), ("Tests", "tests"), ("Medications", "medications"), ("Diagnoses", "diagnoses"),
              ("Procedures", "procedures"), ("Notes", "progress_notes")]
    return F.concat_ws(" ", F.concat(F.lit("Date: "), at("visit_day").cast("string")),
                       *[F.concat(F.lit(f"{t}: "), F.array_join(at(c), ", ")) for t, c in titles])


def structure_documents(docs: DataFrame, key: str, cfg, as_of: str, threshold: float = 0.5, native: bool = False) -> DataFrame:
    """Text to timeline and quality per document, from one extraction.

    Visit chunks with their spans go into entries by day, with the sums that the
    quality needs; entries go into the document's timeline.  Quality is the mean
    of timeline confidence, coherence and spread of spans.  A document without
    chunks has an empty timeline and zeros.
    """
    from chartloom.operators.chunks import document_chunks_with_spans
    chunks = facts(document_chunks_with_spans(docs, [key], cfg, keep_empty=True, native=native))
    dated = chunks.withColumn("visit_day", F.when(F.col("text").isNotNull(), visit_day(F.col("visit_date"), F.col("text"), as_of))).withColumn(
        "chunk_confidence", chunk_confidence())
    n = F.size("spans").cast("double")
    days = entries(dated, [key], ["start_index"], {"spans": n, "squares": n * n, "score": F.col("semantic_score")})
    kept = F.col("visit_day").isNotNull() & (F.col("confidence") >= threshold)
    dropped = F.col("visit_day").isNotNull() & ~kept
    fields = ["visit_day", *FACTS, "progress_notes", "chunk_ids", "confidence", "n_chunks"]
    per = days.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(kept, F.struct(*fields)))).alias("timeline"),
        F.coalesce(F.avg(F.when(kept, F.col("confidence"))), F.lit(0.0)).alias("timeline_confidence"),
        F.min(F.when(kept, F.col("visit_day"))).alias("first_day"), F.max(F.when(kept, F.col("visit_day"))).alias("last_day"),
        (F.count_if(dropped) > 0).alias("dropped_entries"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_chunks", "spans", "squares", "score")])
    count = F.col("n_chunks")
    mean = F.col("spans") / count
    spread = F.sqrt(F.greatest(F.col("squares") / count - mean * mean, F.lit(0.0)))
    per = per.withColumn("coherence", F.when(count > 0, F.col("score") / count).otherwise(F.lit(0.0))).withColumn(
        "entity_distribution", F.when(count > 0, 1.0 - spread / (mean + 1e-6)).otherwise(F.lit(0.0)))
    return per.select(
        key, count.alias("chunks_created"), F.size("timeline").alias("timeline_entries"), F.col("spans").cast("bigint").alias("entities_found"),
        "timeline_confidence", "coherence", "entity_distribution",
        ((F.col("timeline_confidence") + F.col("coherence") + F.col("entity_distribution")) / 3).alias("overall_quality"),
        "dropped_entries", "timeline", "first_day", "last_day")
