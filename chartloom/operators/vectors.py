"""Vector store tables and exact similarity search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.ranking import position_in_group, top_k
from chartloom.operators.vector_index import build_index, search


# --- store -------------------------------------------------------------------

def upsert(store: DataFrame, rows: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Newest version of every id; the store itself counts as older than any row."""
    both = store.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
    fields = [c for c in store.columns if c != key]
    newest = both.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct("__new", version)).alias("r"))
    return newest.select(key, *[F.col(f"r.{c}").alias(c) for c in fields])


def delete(store: DataFrame, ids: DataFrame, key: str = "patient_id") -> DataFrame:
    return store.join(ids.select(key).distinct(), key, "left_anti")


def page(store: DataFrame, order: list[str], limit: int = 10, offset: int = 0) -> DataFrame:
    return store.orderBy(*order).offset(offset).limit(limit)


def page_per_key(store: DataFrame, key: str, order: list[str], limit: int = 10, offset: int = 0) -> DataFrame:
    """The same page of every key; no more than offset + limit rows of a key leave a map task."""
    ranked = top_k(store, [key], [F.asc(c) for c in order], offset + limit)
    return ranked.filter(F.col("rank") > offset)


def timeline_documents(headers: DataFrame, entry_rows: DataFrame) -> DataFrame:
    """Timelines and their entries as store rows (id, kind, text, counts).

    Entries are numbered by day per patient through yearly buckets.
    """
    from chartloom.operators.timeline import entry_text
    top = headers.select(
        F.concat(F.lit("timeline_"), F.col("patient_id").cast("string")).alias("id"), "patient_id", F.lit("timeline").alias("kind"),
        F.col("summary").alias("document"), F.col("total_visits").cast("int").alias("n_visits"),
        *[F.lit(None).cast("int").alias(f"{k}_count") for k in ("symptoms", "tests", "medications", "diagnoses")])
    numbered = position_in_group(entry_rows, ["patient_id"], [F.col("visit_day")], F.year("visit_day"))
    entry = numbered.select(
        F.concat_ws("_", F.lit("entry"), F.col("patient_id").cast("string"), (F.col("position") - 1).cast("string")).alias("id"),
        "patient_id", F.lit("entry").alias("kind"), entry_text().alias("document"), F.lit(1).alias("n_visits"),
        *[F.size(k).alias(f"{k}_count") for k in ("symptoms", "tests", "medications", "diagnoses")])
    return top.unionByName(entry)


def chunk_documents(chunks: DataFrame) -> DataFrame:
    """Chunks as store rows with their metadata."""
    return chunks.select(
        F.concat_ws("_", F.lit("chunk"), F.col("patient_id").cast("string"), F.col("doc_id").cast("string"), "chunk_id").alias("id"),
        "patient_id", "chunk_id", "start_index", "end_index", "word_count", "char_count", "chunk_type",
        F.col("visit_date").cast("string").alias("visit_date"), F.to_json("medical_topics").alias("medical_topics"),
        F.size("spans").alias("entities_count"), F.coalesce("semantic_score", F.lit(0.0)).alias("semantic_score"),
        F.col("text").alias("document"))


# --- distances ---------------------------------------------------------------

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def nearest(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", **index_options) -> DataFrame:
    """Exact ``k`` nearest rows of ``corpus`` (id, embedding) for each query (query_id, embedding).

    The corpus is indexed in the shared folder and searched once; callers that
    search a corpus again keep the index of ``vector_index.build_index``.
    """
    found = search(build_index(corpus, metric, **index_options), queries, k)
    return found.withColumn("similarity", 1 - F.col("distance"))


def group_cohesion(rows: DataFrame, key: str, dims_column: str = "embedding") -> DataFrame:
    """Mean cosine over all ordered pairs of a group, the diagonal included.

    Equal to |sum of unit vectors|^2 / n^2, so a group is summed per dimension
    with partial aggregation and no pair is ever built.
    """
    unit = rows.withColumn("__n", norm(F.col(dims_column))).select(
        key, F.posexplode(dims_column).alias("d", "x"), "__n")
    sums = unit.groupBy(key, "d").agg(F.sum(F.col("x").cast("double") / F.col("__n")).alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.groupBy(key).agg((F.sum(F.col("s") * F.col("s")) / F.max("n") / F.max("n")).alias("cohesion"), F.max("n").alias("n"))


def centroids(rows: DataFrame, key: str) -> DataFrame:
    """Mean vector per key, summed per dimension."""
    per = rows.select(key, F.posexplode("embedding").alias("d", "x")).groupBy(key, "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return per.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda p: p["m"]).alias("embedding"))
