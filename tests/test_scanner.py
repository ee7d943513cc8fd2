import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chartloom.functions import scanner as M
from chartloom.functions import spans as S
from chartloom.functions.spans import Rule
from chartloom.operators import spans as E
from chartloom.plans.notes import notes

TEXTS = ["Seen on 01/15/2024, BP: 120/80 mmHg. HbA1c: 7.2%. Metformin 500 mg BID, Café Hospital.", "", "é is1 ñthe the 12-3-99 January 5, 2020",
         "Hemoglobin (Hb): 13.2 g/dL, range: 12.0 - 16.0; platelets 250 range 150-400. dr. Müller Lange", "ſtroke and ıNSULIN, İnsulin 5 units",
         "amoxicillin500mg amoxicillin  \n 500 mg 20mg mg", "١٢ days ago, 3 months  ago. IV infusion infusion", "PAIN pain Pain chest\tpain"]
ALL = E.pattern_rules() + E.clinical_rules() + E.extra_rules() + E.temporal_rules() + E.lab_rules()


def plain(rules, text):
    return [(i, m.span()) for i, r in enumerate(rules) for m in re.finditer(r.pattern, text, re.I)]


def scan(scanner, text):
    return [(i, m.span()) for i, m in scanner.scan(text)]


def test_shapes():
    assert M.shape(r"\b(?:HR|Heart\s+Rate):?\s*\d") == ("head", frozenset({"hr", "heart"}))
    assert M.shape(r"visit\s+on") == ("free", frozenset({"visit"}))
    assert M.shape(r"\b\w+\s*(?:mg|units?)\b")[0] == "word" and M.shape(r"\b\d{4}\b") == ("head", frozenset({M.DIGIT}))
    assert M.shape(r"\d{4}") == M.shape(r"\b\w+\s*\d") == M.shape(r"[A-Z]\w+") == M.shape(r"x?") == ("any", frozenset())
    assert sum(M.shape(r.pattern)[0] == "any" for r in ALL) == 3


def test_scan_equals_a_search_per_pattern(spark, sf):
    scanner = M.Scanner(ALL)
    for text in TEXTS + [r.text for r in notes(spark, sf).limit(60).collect()]:
        assert scan(scanner, text) == plain(ALL, text), text


PIECES = ["mg", " ", "  ", "5", "12", "500", ".", ":", "=", "/", "-", "\n", "BP", "range", "Dr", "hb", "x", "pain", "chest", "days", "ago", "A", "_", "é", "%", "IV", "daily"]
GENERIC = [Rule("a", p) for p in (r"mg", r"\bmg", r"pain|chest", r"\b\w+mg", r"\b\w+\s+\d+", r"\b(\w+\s*[:=])", r"\b(?:(?:BP|hb)|da)\w*", r"(?:5|12)\b", r"\bx+A", r"\b[1-3]\d")]


@given(st.lists(st.sampled_from(PIECES), max_size=40))
@settings(max_examples=300, deadline=None)
def test_scan_equals_a_search_on_random_texts(pieces):
    text = "".join(pieces)
    for rules, scanner in ((ALL, _ALL), (GENERIC, _GENERIC)):
        assert scan(scanner, text) == plain(rules, text), text


_ALL, _GENERIC = M.Scanner(ALL), M.Scanner(GENERIC)


def test_both_ways_give_the_same_rows(spark, sf):
    texts = TEXTS + [None, "a\u0001b 20 mg\u0002 x"] + [r.text for r in notes(spark, sf).limit(40).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for rules, score in ((E.pattern_rules(), E.pattern_score), (E.lab_rules(), None), (E.clinical_rules(), None)):
        one, two = (sorted(map(str, E.extract(df, rules, score, 7, native=n).withColumn("spans", F.coalesce("spans", F.expr(f"CAST(array() AS {S.SPANS_TYPE})"))).collect()))
                    for n in (True, False))
        assert one == two
    assert [r.spans for r in E.extract(df, [], native=False).limit(2).collect()] == [[], []]


def test_a_lexicon_of_fifty_thousand_terms(spark):
    random.seed(5)
    words = ["".join(random.choice("bcdfghklmnprst") + random.choice("aeiou") for _ in range(4)) for _ in range(60_000)]
    terms = list(dict.fromkeys(words))[:50_000]
    texts = [" ".join(random.choice(words) for _ in range(200)) for _ in range(400)]
    known = set(terms)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    start = time.time()
    got = {r.doc_id: [(s.start, s.text) for s in r.spans] for r in M.find_terms(df, terms, "TERM").collect()}
    assert time.time() - start < 60
    for k, text in enumerate(texts):
        assert sorted(got[k]) == [(m.start(), m.group()) for m in re.finditer(r"\w+", text) if m.group() in known]
