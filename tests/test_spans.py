import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chartloom import lexicons as L
from chartloom.functions import spans as S
from chartloom.functions.spans import Rule
from chartloom.operators import spans as E
from chartloom.plans.notes import notes

MIXED = ["Seen on 01/15/2024, BP: 120/80 mmHg. HbA1c: 7.2%. Metformin 500 mg BID, Café Hospital.", "", "é is1 ñthe the 12-3-99 January 5, 2020",
         "Hemoglobin (Hb): 13.2 g/dL, range: 12.0 - 16.0; platelets 250 range 150-400. dr. Müller Lange", "a\u0001b 20 mg\u0002 x", "PAIN pain Pain"]


def python_spans(text, rules):
    clean = text.replace("\u0001", " ").replace("\u0002", " ")
    return [(m.start(), i, m.end(), r.label, m.group()) for i, r in enumerate(rules) for m in re.finditer(r.pattern, clean, re.I)]


@pytest.mark.parametrize("name", ["pattern_rules", "clinical_rules", "extra_rules", "temporal_rules", "lab_rules"])
def test_offsets_match_a_direct_search(spark, sf, name):
    rules = [Rule(r.label, r.pattern, 0.5, r.semantic_type, r.captures) for r in getattr(E, name)()]
    texts = MIXED + [r.text for r in notes(spark, sf).limit(40).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for row in E.extract(df, rules).collect():
        got = [(s.start, s.ord, s.end, s.label, s.text) for s in row.spans]
        assert got == python_spans(row.text, rules), row.text


def test_required_words_occur_in_every_match(sf):
    rules = E.pattern_rules() + E.clinical_rules() + E.extra_rules() + E.temporal_rules() + E.lab_rules()
    gated = [r for r in rules if S.required_words(r.pattern)]
    assert len(gated) > 60
    assert S.required_words(r"\b(?:HR|Heart\s+Rate):?\s*\d") == ["hr", "heart"]
    assert S.required_words(r"\b(?:lbs?|kg)\b") == ["lb", "kg"] and S.required_words(r"\b(?:a|bcd)\b") is None
    assert S.required_words(r"\b\w+\s+(?:mg)") is None and S.required_words(r"visit\s+(?:date|on)") == ["visit"]
    samples = ["three times daily", "Blood  Pressure: 120/80", "beats per minute HR 80 beats per minute", "units 5 units/L", "Dr. Smith Reg No 12",
               "ſtroke and ıNSULIN", "Type 2 Diabetes Mellitus", "two weeks, 3 weeks ago", "HDL: 40 LDL 30 mg/dL", "wbc 3 WBC: 4.5 k/uL range 4-5"]
    for r in gated:
        for text in samples:
            for m in re.finditer(r.pattern, text, re.I):
                low = m.group().lower().replace("ſ", "s").replace("ı", "i")
                assert any(w in low for w in S.required_words(r.pattern)), (r.pattern, m.group())


def first_rule(spans):
    """Compare with every kept span."""
    kept = []
    for s in sorted(spans, key=lambda s: s[0]):
        hit = next((k for k in kept if s[0] < k[2] and s[2] > k[0]), None)
        if hit is None:
            kept.append(s)
        elif s[3] > hit[3]:
            kept.remove(hit)
            kept.append(s)
    return sorted(kept)


def last_rule(spans):
    """Compare with the last kept span."""
    kept = []
    for s in sorted(spans, key=lambda s: s[0]):
        if kept and s[0] < kept[-1][2]:
            kept[-1] = s if s[3] > kept[-1][3] else kept[-1]
        else:
            kept.append(s)
    return kept


def pair_rule(spans):
    """Compare with the current span, symmetric overlap."""
    kept = []
    for s in sorted(spans, key=lambda s: s[0]):
        if kept and not (kept[-1][2] <= s[0] or s[2] <= kept[-1][0]):
            kept[-1] = s if s[3] > kept[-1][3] else kept[-1]
        else:
            kept.append(s)
    return kept


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 12), st.sampled_from([0.7, 0.8, 0.9])), max_size=25))
@settings(max_examples=200, deadline=None)
def test_three_overlap_rules_agree(raw):
    spans = [(a, i, a + n, c) for i, (a, n, c) in enumerate(raw)]
    assert first_rule(spans) == sorted(last_rule(spans)) == sorted(pair_rule(spans))


def test_resolve_equals_the_rules(spark):
    random.seed(3)
    cases = [[(random.randint(0, 60), random.randint(1, 15), random.choice([0.7, 0.8, 0.9])) for _ in range(random.randint(0, 30))] for _ in range(60)]
    cases += [[(0, 10, .8), (5, 7, .9), (11, 4, .85)], [(0, 10, .7), (12, 8, .7), (8, 6, .9)], [(0, 10, .9), (0, 10, .9)], [(0, 5, .7), (5, 4, .7)]]
    rows = [(k, [(a, i, a + n, "x", "t", c, None, None, None) for i, (a, n, c) in enumerate(case)]) for k, case in enumerate(cases)]
    df = spark.createDataFrame(rows, f"k int, spans {S.SPANS_TYPE}")
    for r in df.select("k", F.expr(S.resolve_overlaps("spans")).alias("spans")).collect():
        want = last_rule([(a, i, a + n, c) for i, (a, n, c) in enumerate(cases[r.k])])
        assert [(s.start, s.ord, s.end, s.confidence) for s in r.spans] == want


def fix_ocr(text):
    for wrong, right in L.OCR_CORRECTIONS.items():
        if text.lower() == wrong.lower():
            return right
    out = text
    if re.search(r"\d", text):
        out = re.sub(r"O(?=\d|$|\s)", "0", re.sub(r"[Il](?=\d|$|\s)", "1", out))
    if re.search(r"[a-zA-Z]{3,}", text):
        out = re.sub(r"0(?=[a-zA-Z])", "O", re.sub(r"1(?=[a-zA-Z])", "l", out))
    out = out.replace("rn", "m").replace("cl", "d")
    for pattern, put in ((r"l(\d+)", r"1\1"), (r"(\d+)O", r"\g<1>0"), (r"O(\d+)", r"0\1"), (r"(\d+)o", r"\g<1>0"), (r"o(\d+)", r"0\1")):
        out = re.sub(pattern, put, out)
    return out


def first_type(text, label):
    low = text.lower().strip()
    for kind, patterns in L.TYPE_RULES.items():
        if any(re.search(p, low) for p in patterns):
            return {"ID": "PERSON", "LAB_VALUE_2": "LAB_VALUE"}.get(kind, kind)
    if label == "MEDICATION" and not (any(re.search(p, low) for p in L.MEDICATION_EVIDENCE) or low.endswith(tuple(L.MEDICATION_SUFFIXES))):
        return "ORGANIZATION"
    if label == "CONDITION" and not any(re.search(p, low) for p in L.CONDITION_EVIDENCE):
        return "ORGANIZATION"
    return label


def is_artifact(text):
    low = text.lower().strip()
    return (low in L.GENERIC_HEADINGS + L.ADMIN_TERMS + L.OCR_ARTIFACTS or len(low) < 2
            or any(re.match(p, low) for p in L.ENTITY_ARTIFACT_PATTERNS)
            or (len(low.split()) == 1 and len(low) > 15 and not low.isalpha()))


WORDS = ["l20", "12O", "O80 mg", "12o", "Hgb", "plt", "burn 1eft", "c1inic cl", "Il 5 O", "monocytes", "HEMOGIOBIA", "rn", "0ral", "120/8O", "lO0l"]


def test_ocr_fix(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "text string").withColumn("x", F.expr(E.ocr_fix_sql("text")))
    assert {r.text: r.x for r in df.collect()} == {w: fix_ocr(w) for w in WORDS}


def test_whole_extraction_against_loops(spark, sf):
    """Every stage in plain Python over whole notes gives the same entities."""
    texts = [r.text for r in notes(spark, sf).limit(60).collect()] + ["Patient has diabetes and takes metformin 500 mg daily. CBC: Hgb 12 g/dL.", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rules = E.extra_rules() + E.clinical_rules() + E.temporal_rules() + E.lab_rules()
    pairs = {p for a, b in L.RELATED_LABEL_PAIRS for p in ((a, b), (b, a))}
    for row in E.extract_entities(df, 0.7).collect():
        found = [(a, i, b, label, text, rules[i].confidence) for a, i, b, label, text in python_spans(row.text, rules)]
        typed = [(a, i, b, first_type(fix_ocr(t), lab), fix_ocr(t), c) for a, i, b, lab, t, c in found]
        kept = last_rule([(a, i, b, c, lab, t) for a, i, b, lab, t, c in typed if not is_artifact(t)])
        want = []
        for n, (a, _, b, c, lab, t) in enumerate(kept):
            group = L.TERM_GROUP.get(lab)
            normal = L.TERMS.get(group, {}).get(t.lower().strip(), t)
            code = L.CODES.get(L.CODE_SYSTEM.get(lab), {}).get(normal.lower())
            near = [k for k, o in enumerate(kept) if k != n and abs(o[0] - a) <= 100 and (lab, o[4]) in pairs]
            want.append((a, b, lab, normal, code, near))
        assert [(e.start, e.end, e.label, e.text, e.concept_code, e.related) for e in row.entities] == want


def test_scores_context_and_filters(spark):
    df = spark.createDataFrame([("date", "2024-01-15"), ("symptoms", "chest pain"), ("patient_info", "x")], "label string, text string")
    got = {r.label: round(r.c, 6) for r in df.withColumn("c", F.expr(E.pattern_score("label", "text"))).collect()}
    assert got == {"date": 0.98, "symptoms": 0.83, "patient_info": 0.75}
    text = "x" * 40
    assert spark.createDataFrame([(text,)], "t string").select(F.expr(S.context("t", "10", "20"))).first()[0] == text
    rows = spark.createDataFrame([("A",), ("B",)], "label string")
    assert E.filter_types(rows, include=["A"], exclude=["A"]).count() == 0
    assert [r.label for r in E.filter_types(rows, exclude=["A"]).collect()] == ["B"]


def test_terms_and_codes(spark):
    df = spark.createDataFrame([("MEDICATION", "ASA"), ("PROCEDURE", "blood count"), ("CONDITION", "Hypertension")], "label string, text string")
    plain = {r.text: r.normalized_text for r in E.normalize_terms(df).collect()}
    folded = {r.text: r.normalized_text for r in E.normalize_terms(df, case_fold=True).collect()}
    assert plain["ASA"] == "ASA" and folded["ASA"] == "aspirin" and plain["blood count"] == "Complete Blood Count"
    assert {r.text: r.entity_id for r in E.link_concepts(df).collect()}["Hypertension"] == "ICD10:I10"


def test_windows(spark):
    df = spark.createDataFrame([(1, "a" * 700), (2, "b" * 512), (3, ""), (4, "c" * 513)], "id int, text string")
    got = {}
    for r in E.text_windows(df, "id").collect():
        got.setdefault(r.id, []).append((r.start, len(r.window)))
    assert sorted(got[1]) == [(0, 512), (128, 512), (256, 444)] and got[2] == [(0, 512)] and 3 not in got
    assert sorted(got[4]) == [(0, 512), (128, 385)]


def test_extraction_stays_in_one_stage_without_python(spark, sf):
    plan = E.to_rows(E.extract_patterns(notes(spark, sf)), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "hashpartitioning" not in plan
