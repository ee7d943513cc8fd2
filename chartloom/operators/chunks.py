"""Cutting documents into chunks.

Each strategy is an array expression over one document, so chunking is a
projection; ``chunk`` explodes it to one row per chunk with the derived
columns.  Only the semantic strategy leaves the JVM: its grouping depends on
the order of the segments and runs in an Arrow-batched UDF, one document at a
time.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom import lexicons as L
from chartloom.functions import spans as S
from chartloom.functions.columns import any_contains, bound, parse_date
from chartloom.functions.scanner import scanned
from chartloom.functions.spans import fold_blocks, let, literal, running_sums
from chartloom.operators import spans as E

CHUNK_TYPE = "struct<number:int,text:string,start_index:int,end_index:int,key:string>"


@dataclass(frozen=True)
class ChunkConfig:
    strategy: str = "visit_based"
    chunk_size: int = 1000
    min_chunk_size: int = 100
    overlap: int = 200
    semantic_threshold: float = 0.7
    paragraph_mark: str = "\n\n"


#: The blanks of a regular expression with Unicode classes.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip_sql(text: str) -> str:
    """The text without blanks at its ends, which are looked at from the ends only."""
    return f"trim(BOTH '{''.join(f'\\u{ord(c):04x}' for c in BLANKS)}' FROM {text})"


def _cut(text: str, bounds: str, min_size: int, key: str = "CAST(NULL AS STRING)") -> str:
    """Stripped pieces between neighbouring bounds that are longer than ``min_size``."""
    piece = (f"CAST(struct(i + 1, {strip_sql(f'substring({text}, b[i] + 1, b[i + 1] - b[i])')}, b[i], b[i + 1], {key}) "
             f"AS {CHUNK_TYPE})")
    return let(bounds, "b", f"filter(transform(sequence(0, size(b) - 2), i -> {piece}), "
                            f"c -> length(c.text) > {min_size})")


def visit_chunks_sql(text: str, cfg: ChunkConfig) -> str:
    def found(pattern: str) -> str:
        words = S.required_words(pattern)
        test = " OR ".join(f"contains(low, {literal(w)})" for w in words or ())
        return f"CASE WHEN {test} THEN {S.match_starts(text, pattern)} ELSE CAST(array() AS array<int>) END" if words else S.match_starts(text, pattern)

    starts = let(S.folded(text), "low", "concat(" + ", ".join(map(found, L.VISIT_PHRASES)) + ")")
    return _cut(text, f"concat(array(0), array_sort({starts}), array(length({text})))", cfg.min_chunk_size)


def temporal_chunks_sql(text: str, spans: str, cfg: ChunkConfig) -> str:
    """Cut at date spans; piece i is keyed by date i, so the last has none.

    Without dates the paragraphs are taken.
    """
    dates = f"filter({spans}, s -> s.label = 'date')"
    bounds = f"concat(array(0), transform(d, s -> s.start), array(length({text})))"
    return let(dates, "d", f"CASE WHEN size(d) = 0 THEN {paragraph_chunks_sql(text, cfg)} "
                           f"ELSE {_cut(text, bounds, cfg.min_chunk_size, 'get(d, i).text')} END")


def paragraph_chunks_sql(text: str, cfg: ChunkConfig) -> str:
    """Paragraphs of at least the minimum size; offsets count stripped lengths plus two."""
    mark = literal("\\Q" + cfg.paragraph_mark + "\\E")
    chunk = f"CAST(struct(i + 1, p, sums[i], sums[i] + length(p), CAST(NULL AS STRING)) AS {CHUNK_TYPE})"
    kept = f"filter(transform(ps, (p, i) -> {chunk}), c -> length(c.text) >= {cfg.min_chunk_size})"
    return let(f"transform(split({text}, {mark}), p -> {strip_sql('p')})", "ps",
               let(running_sums("transform(ps, p -> length(p) + 2)"), "sums", kept))


def fixed_chunks_sql(text: str, cfg: ChunkConfig) -> str:
    """Windows with overlap up to the first that is too short once stripped."""
    step = cfg.chunk_size - cfg.overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than chunk_size")
    window = (f"CAST(struct(i + 1, substring({text}, at + 1, {cfg.chunk_size}), at, "
              f"least(at + {cfg.chunk_size}, length({text})), CAST(NULL AS STRING)) AS {CHUNK_TYPE})")
    windows = f"transform(sequence(0, greatest(length({text}) - 1, 0), {step}), (at, i) -> {window})"
    short = f"array_position(transform(w, c -> length({strip_sql('c.text')}) < {cfg.min_chunk_size}), true)"
    return (f"CASE WHEN length({text}) = 0 THEN CAST(array() AS array<{CHUNK_TYPE}>) ELSE "
            + let(windows, "w", f"CASE WHEN {short} > 0 THEN slice(w, 1, CAST({short} AS INT) - 1) ELSE w END") + " END")


def sentence_chunks_sql(text: str, cfg: ChunkConfig) -> str:
    """Sentences packed while their summed length fits; offsets are running sums of chunk lengths."""
    joined = "array_join(state.cur, '. ')"
    close = (f"array(CAST(struct(state.k + 1, {joined}, state.at, state.at + length({joined}), "
             f"CAST(size(state.cur) AS STRING)) AS {CHUNK_TYPE}))")
    full = f"state.n + length(x) > {cfg.chunk_size} AND size(state.cur) > 0"
    step = (f"CASE WHEN {full} THEN named_struct('state', named_struct('k', state.k + 1, 'cur', array(x), 'n', length(x), 'at', state.at + length({joined})), "
            f"'items', {close}) ELSE named_struct('state', named_struct('k', state.k, 'cur', concat(state.cur, array(x)), 'n', state.n + length(x), 'at', state.at), "
            f"'items', CAST(array() AS array<{CHUNK_TYPE}>)) END")
    sentences = f"filter(transform(split({text}, '[.!?]+'), p -> {strip_sql('p')}), p -> p <> '')"
    start = "named_struct('k', 0, 'cur', CAST(array() AS array<string>), 'n', 0, 'at', 0)"
    return fold_blocks(sentences, start, step, CHUNK_TYPE, f"CASE WHEN size(state.cur) > 0 THEN concat(items, {close}) ELSE items END")


def topic_chunks_sql(text: str, cfg: ChunkConfig) -> str:
    """Sentences grouped by their best topic, topics in order of first appearance.

    The first listed topic wins ties, so a sentence without keywords goes to it.
    """
    topics = list(L.TOPIC_WORDS)
    score = {t: " + ".join(f"CAST(contains(low, {literal(w)}) AS INT)" for w in L.TOPIC_WORDS[t]) for t in topics}
    scores = "array(" + ", ".join(score[t] for t in topics) + ")"
    names = "array(" + ", ".join(literal(t) for t in topics) + ")"
    best = let("lower(p)", "low", let(scores, "v", f"{names}[CAST(array_position(v, array_max(v)) AS INT) - 1]"))
    tagged = f"transform(split({text}, '[.!?]+'), (p, i) -> named_struct('i', i, 'p', p, 't', {best}))"
    group = let("filter(tagged, x -> x.t = topic)", "g", let(
        strip_sql("array_join(transform(g, x -> x.p), '. ')"), "body",
        f"CASE WHEN size(g) > 0 AND length(body) > {cfg.min_chunk_size} THEN named_struct('i', g[0].i, 'chunk', "
        f"CAST(struct(0, body, locate(g[0].p, {text}) - 1, locate(g[0].p, {text}) - 1 + length(body), topic) AS {CHUNK_TYPE})) END"))
    ordered = f"array_sort(array_compact(transform({names}, topic -> {group})))"
    return let(tagged, "tagged", f"transform({ordered}, (x, k) -> CAST(struct(k + 1, x.chunk.text, x.chunk.start_index, "
                                 f"x.chunk.end_index, x.chunk.key) AS {CHUNK_TYPE}))")


# --- semantic ----------------------------------------------------------------

def _hashed_terms(segments: list[str], dims: int) -> np.ndarray:
    out = np.zeros((len(segments), dims))
    for row, segment in enumerate(segments):
        for word in re.findall(r"\w+", segment.lower()):
            out[row, zlib.crc32(word.encode()) % dims] += 1.0
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1.0)


def seed_groups(vectors: np.ndarray, threshold: float) -> list[list[int]]:
    """Each segment joins the first seed it is closer to than the threshold, else becomes one.

    Only segment-to-seed products are computed, never the full matrix.
    """
    free, groups = np.ones(len(vectors), dtype=bool), []
    for i in range(len(vectors)):
        if not free[i]:
            continue
        free[i] = False
        later = np.flatnonzero(free[i + 1:]) + i + 1
        members = later[vectors[later] @ vectors[i] > threshold] if len(later) else later
        free[members] = False
        groups.append([i, *members.tolist()])
    return groups


def cohesion(vectors: np.ndarray) -> float:
    """Mean cosine over all ordered pairs, the diagonal included: |sum of unit vectors|^2 / n^2."""
    total = vectors.sum(axis=0)
    return float(total @ total) / len(vectors) ** 2


def semantic_groups(threshold: float, dims: int = 512):
    """UDF: segments of one document to array<struct<members, score>>."""

    @F.pandas_udf("array<struct<members:array<int>,score:double>>")
    def run(segments: pd.Series) -> pd.Series:
        out = []
        for texts in segments:
            texts = list(texts)
            if len(texts) < 2:
                out.append([])
                continue
            limit = max(0.3, threshold - 0.3) if len(texts) > 10 else max(0.4, threshold - 0.2)
            vectors = _hashed_terms(texts, dims)
            out.append([{"members": g, "score": cohesion(vectors[g]) if len(g) > 1 else 1.0}
                        for g in seed_groups(vectors, limit)])
        return pd.Series(out)

    return run


def semantic_chunks(docs: DataFrame, cfg: ChunkConfig, text: str = "text") -> DataFrame:
    """Adds ``chunks`` by similarity of lines (or sentences); too few segments fall back to windows."""
    lines = F.expr(f"filter(transform(split({text}, '\\n'), p -> {strip_sql('p')}), p -> p <> '')")
    sentences = F.expr(f"filter(transform(split({text}, '[.!?]+'), p -> {strip_sql('p')}), p -> length(p) > 10)")
    cut = docs.withColumn("__lines", lines).withColumn("__segments", F.when(F.size("__lines") > 1, F.col("__lines")).otherwise(sentences))
    grouped = cut.withColumn("__groups", semantic_groups(cfg.semantic_threshold)("__segments"))
    minimum = (f"CASE WHEN contains({text}, '\\n') AND size(__segments) > 5 THEN {min(cfg.min_chunk_size, 60)} "
               f"ELSE {cfg.min_chunk_size} END")
    whole = "size(__lines) > 1 AND size(m) = size(__lines)"
    body = let("transform(g.members, k -> __segments[k])", "m", let(
        strip_sql(f"CASE WHEN {whole} THEN array_join(m, '\\n') ELSE array_join(m, '. ') END"), "body", let(
            f"locate(m[0], {text}) - 1", "at",
            f"CASE WHEN length(body) >= {minimum} AND at >= 0 THEN named_struct('score', g.score, 'n', size(m), 'chunk', CAST(struct(i + 1, body, at, "
            f"greatest(at + length(body), locate(m[size(m) - 1], {text}, at + 1) - 1 + length(m[size(m) - 1])), "
            f"CAST(g.score AS STRING)) AS {CHUNK_TYPE})) END")))
    made = f"transform(array_compact(transform(__groups, (g, i) -> {body})), x -> x.chunk)"
    return grouped.withColumn("chunks", F.expr(
        f"CASE WHEN size(__segments) < 2 THEN {fixed_chunks_sql(text, cfg)} ELSE {made} END")).drop("__lines", "__segments", "__groups")


# --- dispatch and derived columns -------------------------------------------

SCORES = {"visit": 0.85, "topic": 0.8, "temporal": 0.75, "fixed": 0.6, "sentence": 0.75, "paragraph": 0.8}
STRATEGIES = {"visit_based": "visit", "topic_based": "topic", "temporal": "temporal", "semantic": "semantic",
              "fixed_size": "fixed", "sentence_boundary": "sentence", "paragraph_boundary": "paragraph"}


def resolve_strategy(strategy: str, reference_dispatch: bool = False) -> str:
    """Kind of chunk of a strategy; sentence and paragraph fall to fixed under ``reference_dispatch``."""
    kind = STRATEGIES.get(strategy, "fixed")
    return "fixed" if reference_dispatch and kind in ("sentence", "paragraph") else kind


def with_chunks(docs: DataFrame, cfg: ChunkConfig, text: str = "text", reference_dispatch: bool = False, native: bool = True) -> DataFrame:
    """Adds the array ``chunks``; the temporal strategy needs a resolved ``spans`` column.

    Without ``native`` the phrases of visits are found by the pattern scan.
    """
    kind = resolve_strategy(cfg.strategy, reference_dispatch)
    if kind == "visit" and not native:
        phrases = scanned(F.col(text), [S.Rule("visit", p) for p in L.VISIT_PHRASES])
        cuts = f"concat(array(0), array_sort(transform(__phrases, s -> s.start)), array(length({text})))"
        return docs.withColumn("__phrases", phrases).withColumn("chunks", F.expr(_cut(text, cuts, cfg.min_chunk_size))).drop("__phrases")
    if kind == "semantic":
        return semantic_chunks(docs, cfg, text)
    made = {"visit": visit_chunks_sql, "topic": topic_chunks_sql, "fixed": fixed_chunks_sql,
            "sentence": sentence_chunks_sql, "paragraph": paragraph_chunks_sql}
    if kind == "temporal":
        return docs.withColumn("chunks", F.expr(temporal_chunks_sql(text, "spans", cfg)))
    return docs.withColumn("chunks", F.expr(made[kind](text, cfg)))


def chunk(docs: DataFrame, keys: list[str], cfg: ChunkConfig, text: str = "text",
          reference_dispatch: bool = False, keep_empty: bool = False, native: bool = True) -> DataFrame:
    """One row per chunk.  With a ``spans`` column each chunk gets the spans that start in it.

    ``keep_empty`` keeps a row without chunk for a document that has none.
    """
    kind = resolve_strategy(cfg.strategy, reference_dispatch)
    has_spans = "spans" in docs.columns
    exploded = with_chunks(docs, cfg, text, reference_dispatch, native).select(
        *keys, *(["spans"] if has_spans else []), F.explode_outer("chunks").alias("c"))
    if not keep_empty:
        exploded = exploded.filter(F.col("c").isNotNull())
    body = F.col("c.text")
    visit_date = (parse_date(F.col("c.key")) if kind == "temporal" else visit_date_of(body) if kind == "visit"
                  else F.lit(None).cast("timestamp_ntz"))
    topics = F.array(F.col("c.key")) if kind == "topic" else medical_topics(body)
    score = F.col("c.key").try_cast("double") if kind == "semantic" else F.lit(SCORES.get(kind, 0.6))
    trimmed = F.expr(strip_sql("c.text"))
    rows = exploded.select(
        *keys, F.concat(F.lit(f"{kind}_chunk_"), F.concat(F.col("c.key"), F.lit("_")) if kind == "topic" else F.lit(""),
                        F.col("c.number")).alias("chunk_id"),
        (trimmed if kind == "fixed" else body).alias("text"), F.col("c.start_index").alias("start_index"),
        F.col("c.end_index").alias("end_index"), F.length(body).alias("char_count"),
        F.size(F.filter(F.split(body, r"(?U)\s+"), lambda w: w != "")).alias("word_count"),
        F.coalesce(score, F.lit(0.6)).alias("semantic_score"), F.lit(kind).alias("chunk_type"),
        visit_date.alias("visit_date"), topics.alias("medical_topics"),
        *([F.expr("filter(spans, s -> s.start >= c.start_index AND s.start < c.end_index)").alias("spans")] if has_spans else []))
    return rows


def assign_spans(chunks: DataFrame, spans: DataFrame, key: str, width: int, start: str = "start_index",
                 end: str = "end_index", at: str = "at") -> DataFrame:
    """Spans as rows joined to the chunks of the same key they start in.

    Both sides carry a band of ``width`` positions: a chunk is copied to every
    band it touches, a span has one, so a key with very many spans is spread.
    """
    first, last = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
    left = chunks.filter(F.col(end) > F.col(start)).withColumn("__band", F.explode(F.sequence(first, last)))
    right = spans.withColumn("__band", F.floor(F.col(at) / width))
    return left.join(right, [key, "__band"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__band")


def visit_date_of(text: Column) -> Column:
    """Date of the first date pattern (in order) that occurs in the text.

    On plain ASCII the patterns match the same without Unicode classes, and faster.
    """
    def first(value: Column) -> Column:
        plain = F.octet_length(value) == F.length(value)
        found = [F.when(plain, F.regexp_extract(value, "(?i)" + p, 1)).otherwise(F.regexp_extract(value, S.java_pattern(p), 1)) for p in L.VISIT_DATE_PATTERNS]
        return F.coalesce(*[bound(x, lambda v: F.when(v != "", v)) for x in found])

    return parse_date(first(text))


def medical_topics(text: Column) -> Column:
    """Specialties with a keyword in the lower-cased text; keywords keep their case."""
    def tags(low: Column) -> Column:
        return F.array_compact(F.array(*[F.when(any_contains(low, words), topic) for topic, words in L.SPECIALTY_WORDS.items()]))

    return bound(F.lower(text), tags)


# --- quality -----------------------------------------------------------------

def chunk_quality(chunks: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Coverage, coherence and spread of spans over chunks; zeros for documents without chunks.

    ``chunks`` has char_count, semantic_score, n_spans; ``documents`` has text_length.
    """
    per = chunks.groupBy(key).agg(
        F.sum("char_count").alias("covered"), F.avg("semantic_score").alias("coherence"),
        F.stddev_pop("n_spans").alias("sd"), F.avg("n_spans").alias("mean"), F.avg("char_count").alias("avg_chunk_size"),
        F.stddev_pop("char_count").alias("chunk_size_std"), F.count(F.lit(1)).alias("total_chunks"),
        F.sum("n_spans").alias("entities_found"))
    ratio = F.when(F.col("text_length") > 0, F.col("covered") / F.col("text_length")).otherwise(F.lit(0.0))
    filled = documents.join(per, key, "left")
    return filled.select(
        key, F.coalesce(ratio, F.lit(0.0)).alias("coverage"), F.coalesce("coherence", F.lit(0.0)).alias("coherence"),
        F.coalesce(1.0 - F.col("sd") / (F.col("mean") + 1e-6), F.lit(0.0)).alias("entity_distribution"),
        F.coalesce("avg_chunk_size", F.lit(0.0)).alias("avg_chunk_size"),
        F.coalesce("chunk_size_std", F.lit(0.0)).alias("chunk_size_std"),
        F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"),
        F.coalesce("entities_found", F.lit(0)).alias("entities_found"))


def document_chunks_with_spans(docs: DataFrame, keys: list[str], cfg: ChunkConfig, keep_empty: bool = False, native: bool = True) -> DataFrame:
    """Pattern spans, then chunks with their spans; the usual way into a timeline."""
    return chunk(E.extract_patterns(docs, native=native), keys, cfg, keep_empty=keep_empty, native=native)


