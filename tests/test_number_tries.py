"""A pattern is tried only at numbers that can begin a match, and counts leave the scan as counts."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chartloom.functions import scanner as M
from chartloom.functions.spans import Rule
from chartloom.operators import spans as E

PATTERNS = [r"\b\d{5}\b", r"\b\d{2,3}\b", r"\b\d{1,2}[/-]\d{1,2}\b", r"\b\d{2}x", r"\b\d+\s+(?:days?|weeks?)\s+ago\b", r"\b(\d+)\s+(days?)\b", r"\b\d+(?:\.\d+)?\s*(?:mg|g)\b",
            r"\b\d{2,}\s*", r"\b\d{1,2}\d", r"\b\w+\s+\d+(?:\.\d+)?\s*(?:mg|days?)\b", r"\b\w+\s+\d{3}\b", r"\b\d+\b\s*k", r"\b\d{1,2}(?:\s+\d)?", r"\b\d+\s+\s*g", r"\b\d+\s?g", r"\b\d+(?:\s+)?%"]
RULES = [Rule("x", p) for p in PATTERNS]
SCANNER = M.Scanner(RULES)
PIECES = ["1", "22", "333", "55555", " ", "  ", "\n", ".", "/", "-", "%", "x", "g", "mg", "day", "days", "ago", "week", "K", "K", "²", "٣", "_", "a"]


@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), max_size=4))
@settings(max_examples=800, deadline=None)
def test_the_same_matches(texts):
    got = sorted((k, i, start, end, hit) for k, start, i, end, hit, _ in SCANNER.scan_all(texts))
    assert got == sorted((k, i, *m.span(), m.group()) for k, text in enumerate(texts) for i, p in enumerate(PATTERNS) for m in re.finditer(p, text, re.I))


FREE = [Rule("x", p) for p in (r"seen\s+on", r"on", r"visit\s+(?:date|on)", r"-up\s")]
FREE_SCANNER = M.Scanner(FREE)


@given(st.lists(st.lists(st.sampled_from(["Seen", " ", "on", "VISIT", "date", "-up", "\n", "é", "ſeen", "\x02"]), max_size=10).map("".join), max_size=4))
@settings(max_examples=200, deadline=None)
def test_heads_anywhere(texts):
    assert FREE_SCANNER.only_free
    got = sorted((k, i, start, end) for k, start, i, end, _, _ in FREE_SCANNER.scan_all(texts))
    assert got == sorted((k, i, *m.span()) for k, text in enumerate(texts) for i, r in enumerate(FREE) for m in re.finditer(r.pattern, text, re.I))


def test_few_tries_fail():
    text = "Visit on 03/22/1995, BP 146/60, aspirin 350 mg, 1995-04-05, for 2 days, 12345 or 123456, 3 months" + M.MARK
    for p, most in ((r"\b\d{5}\b", 1), (r"\b(\d+)\s+(days?|weeks?)\b", 1), (r"\b\d{4}-\d{2}-\d{2}\b", 1), (r"\b\d+(?:\.\d+)?\s*(?:mg|g|ml|units?)\b", 2),
                    (r"\b\w+\s+\d+(?:\.\d+)?\s*(?:mg|ml)\b", 2)):
        assert 0 < len(M.Scanner([Rule("x", p)]).starts(text)[0]) <= most, p


def test_counts_are_those_of_the_spans(spark):
    texts = ["12 mg 12 mg metformin", None, "", "Metformin 5 mg twice daily, 5 days ago", "\x0112 mg\x01"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    rules = E.clinical_rules() + E.temporal_rules()
    rows = E.to_rows(E.extract(docs, rules, native=False), ["doc_id"]).groupBy("label", "text").agg(F.count(F.lit(1)).alias("n"))
    found = E.count_texts(docs, rules)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect())) != []
    assert E.count_texts(docs.limit(0), rules).count() == 0 and E.count_texts(docs.filter("text IS NULL"), rules).count() == 0
