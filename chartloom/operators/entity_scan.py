"""The entity extraction of ``operators.spans`` in the pattern scan.

What a span becomes (fixed, dropped, typed, normalized, linked) follows from its
label and its text, so a worker decides it once for each, and keeps the resolved
entities of the pieces of text it has seen (``functions.scanner``).  Only the
offsets and the related positions belong to a document.

The rules are those of the SQL, written for texts whose signs Java and Python
class alike.  A document with another span text has no entities here but its
spans, for the SQL.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from chartloom import lexicons as L
from chartloom.functions import scanner as M
from chartloom.functions.spans import SPANS_TYPE, Rule

ENTITY_FIELDS = ("struct<start:int,end:int,label:string,text:string,confidence:double,semantic_type:string,"
                 "value:string,reference_range:string,normalized_text:string,concept_code:string,"
                 "entity_id:string,related:array<int>>")

#: Signs that count as letters, digits, blanks and line ends alike in Java and Python, with one lower case.
_LETTERS = [c for c in map(chr, (*range(0xC0, 0x180), *range(0x386, 0x530))) if unicodedata.category(c) in ("Lu", "Ll") and len(c.lower()) == 1]
PLAIN = re.compile(r"[\t\n\x0b\x0c\x20-\x7e°±·×÷µ–—‘’“”•…≤≥" + "".join(c for c in _LETTERS if c not in "Σσς") + "]*")
#: Positions of a label in ``RELATED``; 0 is any other label.
_KINDS = {label: i for i, label in enumerate(sorted({x for pair in L.RELATED_LABEL_PAIRS for x in pair}), 1)}
RELATED = np.zeros((len(_KINDS) + 1, len(_KINDS) + 1), bool)
for _a, _b in L.RELATED_LABEL_PAIRS:
    RELATED[_KINDS[_a], _KINDS[_b]] = RELATED[_KINDS[_b], _KINDS[_a]] = True


def _any(patterns: list[str]) -> re.Pattern:
    return re.compile("|".join(f"(?:{p})" for p in patterns).replace(r"\z", r"\Z"))


class SpanRules:
    """The rules on one span, as ``ocr_fix_sql``, ``entity_artifact_sql``, ``validated_type_sql``, ``normal_form_sql`` and ``concept_code_sql`` have them."""

    def __init__(self, case_fold: bool = False):
        self.known: dict[str, str] = {}
        for wrong, right in L.OCR_CORRECTIONS.items():
            self.known.setdefault(wrong.lower(), right)
        gates = {"digit": re.compile("[0-9]"), "letters": re.compile("[a-zA-Z]{3,}"), None: re.compile("")}
        self.steps = [(gates[gate], re.compile(pattern, re.A), re.sub(r"\$(\d)", r"\\g<\1>", new)) for gate, pattern, new in L.OCR_STEPS]
        self.artifacts = frozenset(L.GENERIC_HEADINGS + L.ADMIN_TERMS + L.OCR_ARTIFACTS)
        self.artifact = _any(L.ENTITY_ARTIFACT_PATTERNS)
        result = {"ID": "PERSON", "LAB_VALUE_2": "LAB_VALUE"}
        self.types = [(_any(patterns), result.get(kind, kind)) for kind, patterns in L.TYPE_RULES.items()]
        self.evidence = {"MEDICATION": _any(L.MEDICATION_EVIDENCE + ["(?:" + "|".join(L.MEDICATION_SUFFIXES) + r")\z"]), "CONDITION": _any(L.CONDITION_EVIDENCE)}
        self.terms: dict[tuple[str, str], str] = {}
        for group, terms in L.TERMS.items():
            for term, normal in terms.items():
                self.terms.setdefault((group, term.lower() if case_fold else term), normal)
        self.entity = lru_cache(maxsize=1 << 16)(self._entity)

    def fixed(self, text: str) -> str:
        low = text.lower()
        if low in self.known:
            return self.known[low]
        out = text
        for gate, pattern, new in self.steps:
            if gate.search(text):
                out = pattern.sub(new, out)
        return out

    def is_artifact(self, low: str) -> bool:
        return (low in self.artifacts or len(low) < 2 or self.artifact.search(low) is not None
                or len(low) > 15 and not re.search(r"\s", low, re.A) and not low.isalpha())

    def type_of(self, low: str, label: str) -> str:
        for pattern, kind in self.types:
            if pattern.search(low):
                return kind
        evidence = self.evidence.get(label)
        return label if evidence is None or evidence.search(low) else "ORGANIZATION"

    def _entity(self, label: str, hit: str) -> tuple | None:
        """(label, text, code, id, kind) of a span; None of an artifact, () where the SQL has to say."""
        text = self.fixed(hit)
        if not (PLAIN.fullmatch(hit) and PLAIN.fullmatch(text)):
            return ()
        low = text.strip(" ").lower()
        if self.is_artifact(low):
            return None
        kind = self.type_of(low, label)
        normal = self.terms.get((L.TERM_GROUP.get(kind), low), text)
        system = L.CODE_SYSTEM.get(kind)
        code = L.CODES[system].get(normal.lower()) if system else None
        return kind, normal, code, None if code is None else f"{system}:{code}", _KINDS.get(kind, 0)


@lru_cache(maxsize=2)
def _rules(case_fold: bool) -> SpanRules:
    return SpanRules(case_fold)


class _KnownEntities(M._Known):
    """Entities of the different pieces of texts that were scanned so far; a piece with an odd text has one marked row."""

    def __init__(self, rules: tuple[Rule, ...], threshold: float, case_fold: bool):
        self.threshold, self.case_fold = threshold, case_fold
        super().__init__(rules, 0, None, True)

    def scan(self, texts: list[str]):
        import pyarrow as pa

        rules = self.asked[0]
        scanner, entity = M._scanner(rules), _rules(self.case_fold).entity
        rows: list[tuple] = []
        for base, group in M._groups(texts):
            found = [(x, entity(rules[x[2]].label, x[4])) for x in scanner.scan_all(group)]
            odd = {x[0] for x, e in found if e == ()}
            rows += [(base + k, 0, 0, "", "", 0.0, None, None, None, None, None, 0, True) for k in odd]
            found = [(x, e) for x, e in found if e and x[0] not in odd]
            best = M.best_spans([x for x, _ in found], [rules[x[2]].confidence for x, _ in found])
            for (k, start, i, end, _, m), (label, text, code, name, kind) in (found[at] for at in best):
                rule = rules[i]
                if rule.confidence >= self.threshold:
                    value, low, high = m.group(1, 2, 3) if rule.captures else (None, None, None)
                    rows.append((base + k, start, end, label, text, rule.confidence, rule.semantic_type, value or None,
                                 f"{low}-{high}" if low and high else None, code, name, kind, False))
        rows.sort(key=lambda x: x[:2])
        owner, *columns = zip(*rows) if rows else ((),) * 13
        types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), *[pa.string()] * 5, pa.int32(), pa.bool_()]
        names = ["start", "end", "label", "text", "confidence", "semantic_type", "value", "reference_range", "concept_code", "entity_id", "kind", "odd"]
        spans = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        return np.searchsorted(np.array(owner, np.int64), np.arange(len(texts) + 1)), spans


@lru_cache(maxsize=4)
def _known(rules: tuple[Rule, ...], threshold: float, case_fold: bool) -> _KnownEntities:
    return _KnownEntities(rules, threshold, case_fold)


def related(doc: np.ndarray, start: np.ndarray, kind: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, positions) of the lists of ``related_positions_sql``, for disjoint spans in the order of documents and starts."""
    first = np.searchsorted(doc, doc)
    near, step, pairs = np.arange(len(doc)), 0, []
    while len(near):
        step += 1
        near = near[near + step < len(doc)]
        near = near[(doc[near + step] == doc[near]) & (start[near + step] - start[near] <= distance)]
        hit = near[RELATED[kind[near], kind[near + step]]]
        pairs += [(hit, hit + step), (hit + step, hit)]
    left, right = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
    order = np.lexsort((right, left))
    return np.bincount(left, minlength=len(doc)), (right - first[right])[order]


def _entities(column, rules: tuple[Rule, ...], first_ord: int, threshold: float, case_fold: bool, distance: int):
    import pyarrow as pa

    known = _known(rules, threshold, case_fold)
    which, ends = known.pieces(column, True)
    piece, span = known.spread(which)
    before = np.concatenate([[0], np.cumsum(known.size[which])])
    owner = np.repeat(np.arange(len(column)), np.diff(ends))
    doc, shift = owner[piece], (before[:-1] - before[ends[:-1]][owner])[piece]
    flags = known.spans.field("odd").to_numpy(zero_copy_only=False)[span]
    is_odd = np.zeros(len(column), bool)
    if flags.any():
        is_odd[doc[flags]] = True
        span, doc, shift = (x[~is_odd[doc]] for x in (span, doc, shift))
    items = known.spans.take(pa.array(span, pa.int64()))
    fields = {f.name: items.field(i) for i, f in enumerate(items.type)}
    start, end = (fields[name].to_numpy() + shift for name in ("start", "end"))
    sizes, positions = related(doc, start, fields["kind"].to_numpy(), distance)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(positions, pa.int32()))
    names = [x.split(":")[0] for x in ENTITY_FIELDS[len("struct<"):-1].split(",")]
    fields |= {"start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32()), "normalized_text": fields["text"], "related": lists}
    entities = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(column) + 1)), pa.int32()),
                                        pa.StructArray.from_arrays([fields[n] for n in names], names))
    odd = np.flatnonzero(is_odd)
    raw = M._spans(column.take(pa.array(odd, pa.int64())), rules, first_ord, None, False, True)
    sizes = np.zeros(len(column), np.int64)
    sizes[odd] = np.diff(raw.offsets.to_numpy())
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    found = pa.ListArray.from_arrays(offsets, raw.values, mask=pa.array(~is_odd))
    return pa.StructArray.from_arrays([entities, found], ["entities", "found"])


def scanned_entities(text: Column, rules: list[Rule], first_ord: int, threshold: float, case_fold: bool = False, distance: int = 100) -> Column:
    """A struct of the ``entities`` of a text, or of its spans in ``found`` where the SQL has to say; a null text has no entities."""
    fixed = tuple(rules)

    @F.arrow_udf(f"struct<entities:array<{ENTITY_FIELDS}>,found:{SPANS_TYPE}>")
    def found(column):
        return _entities(column, fixed, first_ord, threshold, case_fold, distance)

    return found(text)
