"""The pipeline stage by stage against plain versions."""

import subprocess
import sys
from collections import Counter

import brute
import pytest

import corpus_pipeline
from chartloom.llm import mixing, quality
from chartloom.llm.shared import saved


@pytest.fixture(scope="module")
def stages(spark, small):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = saved(stage(spark, docs, small), f"test-{name}")
        out.append((name, docs, result))
        docs = result
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_and_columns(stages, spark, small):
    names = spark.read.parquet(f"{small}/documents.parquet").columns
    assert [n for n, _, _ in stages] == ["quality", "near_duplicates", "secrets", "mix", "packing"]
    assert all(out.columns == names for _, _, out in stages[:-1])


def test_quality_stage(stages, spark, small):
    _, before, after = stages[0]
    scored = quality.score_documents(before, spark.read.parquet(f"{small}/labels.parquet"))
    assert set(rows(after)) == {r["key"] for r in scored.filter("predicted = 1").collect()}


def test_near_duplicate_stage(stages):
    _, before, after = stages[1]
    groups = brute.near_duplicates([(k, r["text"]) for k, r in rows(before).items()])
    assert set(rows(after)) == {k for k, (_, c) in groups.items() if k == c}


def test_secret_stage(stages):
    _, before, after = stages[2]
    old, new = rows(before), rows(after)
    assert set(old) == set(new)
    for k, r in old.items():
        assert not brute.secret_spans(new[k]["text"])
        if not brute.secret_spans(r["text"]) and "[SECRET]" not in new[k]["text"]:
            assert new[k] == r


def test_mix_stage(stages):
    _, before, after = stages[3]
    want = {r["key"]: r["copies"] for r in mixing.mix_sources(before).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in after.collect()) == want


def test_packing_stage(stages):
    _, before, after = stages[4]
    places = Counter()
    for r in after.collect():
        places[r["sequence_id"]] += r["length"]
    assert max(places.values()) <= corpus_pipeline.SEQUENCE_TOKENS
    pieces = Counter(r["doc_id"] for r in after.filter("piece = 0").collect())
    assert pieces == Counter(r["doc_id"] for r in before.collect())


def test_run_gives_the_last_stage(stages, spark, small):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, corpus_pipeline.run(spark, small).select(*columns).collect())) == Counter(map(tuple, stages[-1][2].select(*columns).collect()))


def test_entry_works_without_these_operators():
    code = ("import sys; sys.modules['chartloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; "
            "assert len(e.queries()) > 170 and 'pipeline' not in e.queries() and not any(n.startswith('op') for n in e.oracle_sql())")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0])
