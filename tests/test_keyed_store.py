import pytest
from pyspark.sql import functions as F

from chartloom.operators import graph as G
from chartloom.operators import vectors as V
from chartloom.sources.keyed_store import DuplicateKeys, KeyedStore


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def store(spark, tmp_path):
    return KeyedStore.create(spark, str(tmp_path / "store"), "id string, version int, body string", ["id"], buckets=8)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, version int, body string")


def test_versions_and_untouched_files(spark, store):
    assert rows_of(store.read()) == [] and store.versions() == []
    assert store.apply(frame(spark, [(f"k{i}", 1, "first") for i in range(40)]), V.upsert) == 1
    files = {r[0] for r in store.read().select(F.input_file_name()).distinct().collect()}
    assert store.apply(frame(spark, [("k3", 2, "second"), ("new", 1, "x")]), V.upsert) == 2
    after = {r[0] for r in store.read().select(F.input_file_name()).distinct().collect()}
    assert len(files - after) <= 2 and len(after & files) >= len(files) - 2
    got = {r.id: r.body for r in store.read().collect()}
    assert len(got) == 41 and got["k3"] == "second" and got["new"] == "x"
    assert {r.body for r in store.read(1).collect()} == {"first"} and store.read(1).count() == 40
    # opened again, by its path alone
    again = KeyedStore(spark, store.path)
    assert rows_of(again.read()) == rows_of(store.read()) and again.keys == ["id"]


def test_a_batch_counts_once(spark, store):
    rows = frame(spark, [("a", 1, "x")])
    assert store.apply(rows, lambda old, new: old.unionByName(new), batch="b1") == 1
    assert store.apply(rows, lambda old, new: old.unionByName(new), batch="b1") == 1
    assert store.read().count() == 1
    assert store.apply(rows.limit(0), V.upsert) == 1


def test_delete(spark, store):
    store.apply(frame(spark, [(f"k{i}", 1, "v") for i in range(20)] + [(None, 1, "null key")]), lambda old, new: new)
    store.delete(spark.createDataFrame([(f"k{i}",) for i in range(20)] + [("unknown",)], "id string"))
    assert [r.body for r in store.read().collect()] == ["null key"]
    store.apply(frame(spark, [("k1", 2, "back")]), V.upsert)
    assert store.read().count() == 2


def test_all_rows_gone(spark, store):
    store.apply(frame(spark, [("a", 1, "x")]), V.upsert)
    store.delete(spark.createDataFrame([("a",)], "id string"))
    assert rows_of(store.read()) == [] and store.read(1).count() == 1


def test_failed_write_leaves_nothing(spark, store):
    store.insert(frame(spark, [("a", 1, "x"), ("b", 1, "y")]))
    before = rows_of(store.read())
    for bad in ([("c", 1, "z"), ("c", 2, "z")], [("d", 1, "z"), ("a", 2, "again")]):
        with pytest.raises(DuplicateKeys):
            store.insert(frame(spark, bad))
        assert rows_of(store.read()) == before and store.versions() == [1]
    store.insert(frame(spark, [("c", 1, "z")]))
    assert store.read().count() == 3


def test_half_written_version_is_not_seen(spark, store):
    store.apply(frame(spark, [("a", 1, "x")]), V.upsert)
    frame(spark, [("a", 9, "lost")]).withColumn("__bucket", F.lit(1)).write.partitionBy("__bucket").parquet(f"{store.path}/data/v=2")
    assert [r.body for r in store.read().collect()] == ["x"]
    store.apply(frame(spark, [("a", 2, "y")]), V.upsert)
    assert [r.body for r in store.read().collect()] == ["y"]


def test_merge_rules_in_parts(spark, tmp_path):
    """Updates in any number of parts give what one merge over all of them gives."""
    updates = spark.createDataFrame([(i, f"id{i % 7}", f"n{i}", None if i % 5 == 0 else i / 100) for i in range(60)], "seq int, id string, name string, confidence double")
    merge = lambda old, new: G.merge_first_keep_max(old, new, ["id"], "seq", ["name"])
    whole = merge(updates.drop("seq").limit(0), updates)
    store = KeyedStore.create(spark, str(tmp_path / "nodes"), whole.schema, ["id"], buckets=4)
    for low in (0, 20, 40):
        store.apply(updates.filter((F.col("seq") >= low) & (F.col("seq") < low + 20)), merge, batch=f"from {low}")
    assert rows_of(store.read()) == rows_of(whole)
