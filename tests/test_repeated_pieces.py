"""Texts are cut where no pattern matches across, and a piece that recurs is scanned once."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chartloom.functions import cuts as K
from chartloom.functions import scanner as M
from chartloom.functions.spans import Rule
from chartloom.operators import spans as E
from chartloom.plans.span_queries import _MIXED

PIECES = ["Patient", " ", "Dr", ".", "\n", "Mrs", "JOHN", "Reg", "No", "A12", "5 mg", "daily", "hemoglobin", "(", ")", "12", ". ", ".\n", "é", "ſ", "mg", "pain", "\x01", "CO", ", "]
LEXICONS = [(tuple(E.pattern_rules()), E.PATTERN_SCORES), (tuple(_MIXED), None), (tuple(E.extra_rules()), None),
            (tuple(Rule("x", p, 0.5) for p in (r"seen\s+on", r"\bg\.\s+\w+", r"\b\w+\b")), None)]


def plain(texts, rules, scores, resolved, clear):
    texts = [(x or "").replace("\x01", " ").replace("\x02", " ") if clear else x or "" for x in texts]
    offsets, items = M._found(texts, rules, 0, scores, resolved)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items).to_pylist()


@pytest.mark.parametrize("rules, scores", LEXICONS)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PIECES), max_size=14).map("".join)), max_size=6), st.booleans())
@settings(max_examples=250, deadline=None)
def test_pieces_give_what_whole_texts_give(rules, scores, texts, resolved):
    column = pa.array(["x", *texts], pa.string()).slice(1)
    assert M._spans(column, rules, 0, scores, resolved, True).to_pylist() == plain(texts, rules, scores, resolved, True)


@given(st.lists(st.lists(st.sampled_from(["ab", "g", "r", ".", " ", "\n", "(", ")", "7", "no", "A"]), max_size=8).map("".join), min_size=1, max_size=5),
       st.sampled_from([r"\bg\.\s*\w+", r"a(?:b\.|r)\s", r"\w+[^(]7", r"no?\.?\s*\d", r"\.\s+r", r"\(.*?\)", r"b\.(?= )", r"7\.$", r"r*", r"[^.]+"]))
@settings(max_examples=600, deadline=None)
def test_no_match_goes_across_a_cut(texts, pattern):
    cut, ends = K.pieces(pa.array(texts, pa.string()), K.table_of([pattern]))
    cut = cut.to_pylist()
    for k, text in enumerate(texts):
        parts = cut[ends[k]:ends[k + 1]]
        assert "".join(parts) == text
        at = np.cumsum([0, *map(len, parts)]).tolist()
        found = [(at[i] + m.start(), at[i] + m.end()) for i, part in enumerate(parts) for m in re.finditer(pattern, part, re.I)]
        assert found == [m.span() for m in re.finditer(pattern, text, re.I)] or not text


def test_titles_and_brackets_keep_a_text_together():
    texts = pa.array(["Seen by Dr. Smith for asthma. Severe pain. HbA1c: 5.3%.\nPlan", "Hemoglobin (low. high) 12", "end. ", ""], pa.string())
    cut, ends = K.pieces(texts, K.table_of(r.pattern for r in E.pattern_rules()))
    assert cut.to_pylist() == ["Seen by Dr. Smith for asthma.", " Severe pain.", " HbA1c: 5.3%.", "\nPlan", "Hemoglobin (low. high) 12", "end.", " "]
    assert ends.tolist() == [0, 4, 5, 7, 7]
    assert K.table_of([r"a\Z"]) is None and K.table_of([r"x?"]) is None and K.table_of([r"a(?!\s)"]) is None


def test_a_recurring_piece_is_scanned_once(monkeypatch):
    seen, scan = [], M._found
    monkeypatch.setattr(M, "_found", lambda texts, *rest: seen.extend(texts) or scan(texts, *rest))
    M._known.cache_clear()
    rules, rows = tuple(E.clinical_rules()), [f"Take aspirin daily. Back in {k % 5} days." for k in range(1000)]
    for _ in range(3):
        assert M._spans(pa.array(rows), rules, 0, None, True).to_pylist()[7] == plain(rows[7:8], rules, None, True, False)[0]
    assert len([x for x in seen if x.startswith("Take") and x.endswith(".") and "days" not in x]) == 1
    assert sum("Back" in x and "Take" not in x for x in seen) == 5


def test_known_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(M, "KNOWN_SIGNS", 100)
    known = M._Known(tuple(E.clinical_rules()), 0, None, True)
    for k in range(50):
        known.look_up([f"aspirin {k} mg daily.", f" {k} days ago"])
        assert known.signs < 150 and len(known.places) == len(known.size) == len(known.first) - 1
