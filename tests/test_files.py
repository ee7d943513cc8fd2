"""Document store, its inventory, and numbering without keys."""

import glob
import os
import time

from pyspark.sql import functions as F

from chartloom.functions.ranking import global_position
from chartloom.operators.intake import inventory
from chartloom.sources import files as FS

MIMES = ["application/pdf", "image/png"]


def test_metadata_of_stored_documents(spark, tmp_path):
    start, path = time.time(), str(tmp_path / "store")
    docs = spark.createDataFrame([(i, f"p{i % 3}", MIMES[i % 2], f"text {i}") for i in range(60)], "doc_id bigint, patient_id string, mime string, body string")
    FS.write_documents(docs, path)
    rows = FS.stored_documents(spark, path).withColumn("created_at", F.unix_timestamp("created_at")).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(60))
    sizes = {os.path.relpath(p, path): os.path.getsize(p) for p in glob.glob(f"{path}/*/*/*.parquet")}
    for r in rows:
        name = r["stored_path"].split("/store/")[1]
        assert sizes[name] == r["stored_size"] and start - 2 <= r["created_at"] <= time.time() + 2
        assert name.startswith(f"category={'image' if r['doc_id'] % 2 else 'document'}/patient_id=p{r['doc_id'] % 3}/")
    listed = inventory(FS.stored_files(spark, path, ["category", "patient_id"])).collect()
    assert len(listed) == len(sizes) and sum(r["documents"] for r in listed) == 60
    assert all(r["size"] == sizes[r["path"].split("/store/")[1]] and r["created"] == r["modified"] and r["filename"].endswith(".parquet") for r in listed)


def test_inventory_of_plain_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x" * 2048)
    (tmp_path / "b.bin").write_bytes(b"1")
    (tmp_path / "empty.txt").write_bytes(b"")
    rows = {r["filename"]: r for r in inventory(FS.read_files(spark, str(tmp_path), with_content=False)).collect()}
    assert rows["a.txt"]["size_human"] == "2.0KB" and rows["a.txt"]["mime"] == "text/plain" and rows["a.txt"]["created"] == rows["a.txt"]["modified"]
    assert "empty.txt" not in rows  # Spark's readers skip empty files
    assert rows["b.bin"]["size_human"] == "1.0B" and rows["b.bin"]["mime"] == "application/octet-stream"


def test_positions_of_sparse_ids(spark):
    ids = [-(2 ** 62), -5, 0, *[i * 2 ** 40 + 7 for i in range(1, 500)], *range(1, 400)]
    rows = spark.createDataFrame([(i, i % 2) for i in ids], "id bigint, odd bigint").repartition(7)
    got = {r["id"]: r["position"] for r in global_position(rows, [F.col("id")], parts=16).collect()}
    assert got == {i: n for n, i in enumerate(sorted(ids), 1)}
    got = {r["id"]: r["position"] for r in global_position(rows, [F.col("odd").desc(), F.col("id")], parts=5).collect()}
    assert got == {i: n for n, i in enumerate(sorted(ids, key=lambda i: (-(i % 2), i)), 1)}
    assert global_position(rows.limit(0), [F.col("id")]).collect() == []
