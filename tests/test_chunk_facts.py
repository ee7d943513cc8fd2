"""Facts and dates of chunks by the cheaper tests equal those of the patterns run on every text."""

import re

import pytest
from pyspark.sql import functions as F

from chartloom import lexicons as L
from chartloom.operators import chunks as C
from chartloom.operators import timeline as T
from chartloom.plans import load

QUERIES, _ = load()
TEXTS = ["Diagnosed with asthma. Diagnosis: flu, CONDITION stable. Procedure: MRI. operation x", "No complaints.", "", None, "DIAGNOſIS: flu é. ſurgery: knee",
         "Fever. Chest PAIN, no ache.  Dizzy . fever again", "Seen 1/2/2020 and 2020-03-04", "on March 3, 2020", "x12/13/20 1-2-99", "é 2020-03-04 ٣/٤/٢٠٢٠", "Sept 3 2020"]


def captured(text, patterns):
    return [m for p in patterns for m in re.findall(p, text, re.I)]


def test_facts_of_chunks(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").withColumn("spans", F.expr("CAST(array() AS array<struct<label:string,text:string>>)"))
    for r in T.facts(df).orderBy("doc_id").collect():
        if r.text is None:
            assert r.symptoms == [] and r.diagnoses is None and r.procedures is None
            continue
        assert (r.diagnoses, r.procedures) == (captured(r.text, L.FACT_DIAGNOSES), captured(r.text, L.FACT_PROCEDURES)), r.text
        assert r.symptoms == [next(p for p in r.text.split(".") if w in p.lower()).strip() for w in L.FACT_SYMPTOMS if w in r.text.lower()]
    assert "__low" not in T.facts(df).columns


def test_dates_of_chunks(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    found = {r.text: r.day for r in df.select("text", C.visit_date_of(F.col("text")).cast("date").cast("string").alias("day")).collect()}
    assert [found[t] for t in TEXTS[6:9]] == ["2020-01-02", "2020-03-03", "1999-01-02"] and found["é 2020-03-04 ٣/٤/٢٠٢٠"] is None
    assert found[None] is None and found[""] is None


@pytest.mark.parametrize("name", ["t04_entry_confidence", "t05_threshold_report", "t06_timelines"])
def test_results_without_facts_collect_none(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "diagnosed with" not in plan
