"""Texts scanned together give what each gives alone, and the queries over notes use that scan."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chartloom.functions import scanner as M
from chartloom.functions.spans import Rule
from chartloom.operators import chunks as C
from chartloom.operators import spans as E
from chartloom.plans import load

QUERIES, _ = load()
RULES = E.pattern_rules() + [Rule("x", p) for p in (r"^5", r"(?<=a)\s+mg", r"mg[^5]*5", r"\bmg\b", r"\b\w+\s*mg", r"\b\d+\s*(?:mg|g)\b", r"\b\d+[/-]\d+")]
SCANNER = M.Scanner(RULES)
PIECES = ["mg", " ", "5", "12", ".", "/", "-", "\n", "a", "A", "é", "K", "ſ", "%", "BP", "SODIUM", ", ", "\x01", "Age 7"]


@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=5))
@settings(max_examples=300, deadline=None)
def test_texts_scanned_together(texts):
    got = sorted((k, i, start, end, hit) for k, start, i, end, hit, _ in SCANNER.scan_all(texts))
    assert got == sorted((k, i, *m.span(), m.group()) for k, text in enumerate(texts) for i, r in enumerate(RULES) for m in re.finditer(r.pattern, text, re.I))


def test_resolved_in_the_scan_as_in_sql(spark):
    texts = ["Metformin 500 mg BID, Glucose 101 mg/dL 5 units", None, "", "SODIUM, SERUM 140 mEq/L chest pain 01/02/2020 " * 50, " Hospital 12 g"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    one, two = ([str(r.spans) for r in E.extract_patterns(df, native=n).orderBy("doc_id").collect()] for n in (True, False))
    assert one == two


def test_visit_chunks_both_ways_and_blanks_of_any_kind(spark):
    df = spark.createDataFrame([(1, "　 Visit on 01/02/2020 a b c  Follow-up  visit on March 3, 2020\u0085")], "doc_id int, text string")
    one, two = (C.chunk(df, ["doc_id"], C.ChunkConfig(min_chunk_size=3), native=n).collect() for n in (True, False))
    assert one == two and [r.text for r in one] == [r.text.strip() for r in one] and len(one) > 1


@pytest.mark.parametrize("name", ["c01_visit_chunks", "e09_merged_clinical_spans", "e12_unknown_labels", "e19_type_filter", "e26_document_metrics", "e32_hybrid_spans", "t02_facts", "t08_structured_documents"])
def test_notes_are_scanned_once(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "\\u0001$0" not in plan
