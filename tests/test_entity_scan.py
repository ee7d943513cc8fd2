"""The extraction in the pattern scan gives what the SQL gives, and notes do not go through the SQL span by span."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chartloom import lexicons as L
from chartloom.functions import spans as S
from chartloom.operators import entity_scan as N
from chartloom.operators import spans as E
from chartloom.plans.notes import notes

RULES = tuple(E.extra_rules() + E.clinical_rules() + E.temporal_rules() + E.lab_rules())
WORDS = ["Metformin 500 mg", "HTN", "CBC", "Hgb", "PLT", "c1inic", "burn", "12O mg", "type 2 diabetes", "Dr. Smith", "Mayo Clinic", "patient id", "98.6 °f", "daily", "BID", "every 8 hours", "x-ray",
         "hemoglobin: 12.5 g/dL range 12-16", "WBC (auto): 7 k/uL, range 4 - 11", "120/80 mmHg", "chest pain", "aspirin", "MRI", "3 days ago", "\n", ".", ". ", "(", ")", "Hospital of", "Ömer Hospital", "glucose", "COPD"]
ODD = ["é hospital", "İzmir clinic", "5\xa0mg", "½ hospital", "١٢ mg", "a‍b clinic", "dr. ẞ", "7\x1cmg", "5 mg", "\x01", "Σ lab pathology"]


def both(df, **more):
    empty = F.expr(f"CAST(array() AS {S.SPANS_TYPE})")
    return ([r.entities for r in E.extract_entities(df.withColumn("m", m) if m is not None else df, model_spans=m is not None and "m" or None, **more).orderBy("doc_id").collect()] for m in (None, empty))


@pytest.mark.parametrize("more", [{}, {"case_fold": True, "threshold": 0.8}, {"with_extra": False}])
def test_scan_equals_sql(spark, sf, more):
    rng = random.Random(7)
    texts = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 30))) for _ in range(300)] + [" ".join(rng.choices(WORDS + ODD, k=12)) for _ in range(300)] + [None, "", " "]
    texts += [r.text for r in notes(spark, sf).limit(100).collect()] + [w.lower() for x in (L.TERMS.values()) for w in x] + list(L.OCR_CORRECTIONS)
    one, two = both(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2), **more)
    assert one == two and sum(map(len, one)) > 1000


def test_only_documents_with_odd_signs_go_through_the_sql():
    found = N._entities(pa.array(["Metformin 500 mg at Mayo Clinic", "seen at ½ hospital", None]), RULES, 1000, 0.7, False, 100).to_pylist()
    assert [x["found"] is None for x in found] == [True, False, True] and found[1]["entities"] == [] and found[2]["entities"] == []
    assert [e["label"] for e in found[0]["entities"]] and [s["text"] for s in found[1]["found"]]


def test_a_recurring_span_is_decided_once(monkeypatch):
    N._known.cache_clear()
    N._rules.cache_clear()
    asked = []
    real = N.SpanRules.fixed
    monkeypatch.setattr(N.SpanRules, "fixed", lambda self, text: asked.append(text) or real(self, text))
    for k in range(3):
        N._entities(pa.array([f"Takes metformin 500 mg daily. Note {k} {i}" for i in range(500)]), RULES, 1000, 0.7, False, 100)
    assert 0 < len(asked) < 10


def test_related_positions_equal_a_plain_loop():
    rng = np.random.default_rng(3)
    doc = np.sort(rng.integers(0, 40, 600))
    start = np.concatenate([np.cumsum(rng.integers(1, 60, n)) for n in np.bincount(doc, minlength=40)])
    kind = rng.integers(0, len(N.RELATED), 600)
    sizes, positions = N.related(doc, start, kind, 100)
    want = [[j - np.searchsorted(doc, d) for j in range(600) if j != i and doc[j] == d and abs(start[j] - start[i]) <= 100 and N.RELATED[kind[i], kind[j]]] for i, d in enumerate(doc)]
    assert np.split(positions, np.cumsum(sizes)[:-1])[5].tolist() == want[5] and [len(w) for w in want] == sizes.tolist() and positions.tolist() == sum(want, [])
