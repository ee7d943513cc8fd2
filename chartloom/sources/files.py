"""Reading document files and writing documents and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions.columns import mime_category


def read_files(spark: SparkSession, path: str, pattern: str | None = None, with_content: bool = True) -> DataFrame:
    """Files below ``path``: path, modificationTime, length and, if wanted, content.

    Spark's readers skip empty files, so they give no row.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    df = reader.load(path)
    return df if with_content else df.drop("content")


def write_documents(docs: DataFrame, path: str, patient: str = "patient_id", buckets: int | None = None) -> None:
    """Documents by category and patient; rows of one patient meet in few files per category.

    The rows are rebalanced by folder: large folders are split and small ones
    joined by their measured sizes, so a patient with very many documents is
    written by as many tasks as they need.  With very many patients pass
    ``buckets``: folders then hold a hash bucket of patients each.
    """
    category = F.when(mime_category(F.col("mime")) == "image", "image").otherwise("document")
    salted = docs.withColumn("category", category)
    folder = patient
    if buckets:
        folder = "patient_bucket"
        salted = salted.withColumn(folder, F.pmod(F.xxhash64(patient), F.lit(buckets)))
    (salted.hint("rebalance", "category", folder)
     .write.mode("overwrite").partitionBy("category", folder).parquet(path))


def stored_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a document store, each with the file that holds it: stored_path, stored_size, created_at.

    These come from the hidden file columns of Spark's readers, so no file is
    listed or opened a second time.  Files of a store are written once, so the
    time of the last change is that of creation.
    """
    meta = F.col("_metadata")
    return spark.read.parquet(path).select(
        "*", meta["file_path"].alias("stored_path"), meta["file_size"].alias("stored_size"), meta["file_modification_time"].alias("created_at"))


def stored_files(spark: SparkSession, path: str, folder: list[str]) -> DataFrame:
    """Files of a document store as ``inventory`` takes them, with the columns of their ``folder`` (as ``folder_...``) and the number of documents in each."""
    rows = stored_documents(spark, path)
    return (rows.groupBy(*[F.col(c).alias(f"folder_{c}") for c in folder], F.col("stored_path").alias("path"), F.col("stored_size").alias("length"), F.col("created_at").alias("modificationTime"))
            .agg(F.count(F.lit(1)).alias("documents")))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
