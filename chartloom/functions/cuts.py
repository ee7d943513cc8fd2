"""Where a text can be cut without changing what a lexicon finds in it.

Sentences of clinical notes recur far more often than whole notes.  A text is
cut between a full stop and the blank after it, but only where no pattern can
match across that place; the pieces are then scanned once each, however often
they occur.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable
from functools import lru_cache
from re import _compiler as compiler
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa

STOP, BLANKS = ".", " \n"
#: A text with this sign is not cut: what stands in brackets may go across sentences.
GUARD = "("
_BEFORE = string.ascii_lowercase + string.digits + "%"

# A relation over the places of a window of signs: row i has a bit for each place that is
# reached from i.  Place 0 is anywhere left of the window, the last one anywhere right of it.
_Relation = list[int]


def _one(n: int) -> _Relation:
    return [1 << i for i in range(n)]


def _reached(b: _Relation, row: int) -> int:
    out = 0
    for j, to in enumerate(b):
        if row >> j & 1:
            out |= to
    return out


def _then(a: _Relation, b: _Relation) -> _Relation:
    return [_reached(b, row) for row in a]


def _either(a: _Relation, b: _Relation) -> _Relation:
    return [x | y for x, y in zip(a, b)]


def _any_times(a: _Relation) -> _Relation:
    found = _one(len(a))
    while (more := _either(found, _then(found, a))) != found:
        found = more
    return found


@lru_cache(maxsize=1 << 16)
def _same(code: int, sign: str) -> bool:
    return re.match(re.escape(chr(code)), sign, re.I) is not None


class _Crossing:
    """Whether a match of a pattern can take the last two signs of a window, in a text without the guard."""

    def __init__(self, pattern: str):
        self.parsed = parser.parse(pattern, re.I)
        self.fits: dict[tuple[str, str], bool] = {}

    def accepts(self, item, sign: str) -> bool:
        if item[0] is C.LITERAL:
            return _same(item[1], sign)
        key = repr(item), sign
        if key not in self.fits:
            one = compiler.compile(parser.SubPattern(self.parsed.state, [item]), re.I)
            self.fits[key] = one.match(sign) is not None
        return self.fits[key]

    def relation(self, items, window: str) -> _Relation:
        n = len(window) + 2
        found = _one(n)
        for item in items:
            op, arg = item
            if op is C.AT and arg in (C.AT_BOUNDARY, C.AT_NON_BOUNDARY):
                continue  # no word ends or begins at a cut
            if op is C.LITERAL and arg == ord(GUARD):
                return [0] * n
            if op in (C.LITERAL, C.NOT_LITERAL, C.IN, C.ANY):
                here = [3, *(1 << i + 2 if self.accepts(item, c) else 0 for i, c in enumerate(window)), 1 << n - 1]
            elif op is C.SUBPATTERN:
                here = self.relation(arg[3], window)
            elif op is C.BRANCH:
                here = [0] * n
                for x in arg[1]:
                    here = _either(here, self.relation(x, window))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                once = self.relation(arg[2], window)
                here = once if arg[1] == 1 else _then(once, _any_times(once))
                here = _either(here, _one(n)) if arg[0] == 0 else here
            else:  # what looks around, goes back or does not give back
                return [(1 << n) - 1] * n
            found = _then(found, here)
        return found

    def possible(self, window: str) -> bool:
        last = len(window) + 1
        return any(row >> last & 1 for row in self.relation(self.parsed, window)[:last - 1])


@lru_cache(maxsize=16)
def cut_table(patterns: tuple[str, ...]) -> np.ndarray | None:
    """For the two signs before a full stop (256 * first + second): whether a text can be cut after it; None if nowhere."""
    known = [_Crossing(p) for p in patterns]
    if any(x.parsed.getwidth()[0] == 0 for x in known):
        return None
    table = np.zeros((256, 256), bool)
    crossing = [x for x in known if any(x.possible(STOP + b) for b in BLANKS)]
    for last in _BEFORE:
        unsafe = [x for x in crossing if any(x.possible(last + STOP + b) for b in BLANKS)]
        firsts = [f for f in _BEFORE if not any(x.possible(f + last + STOP + b) for x in unsafe for b in BLANKS)] if unsafe else []
        for second in {last, last.upper()}:
            for first in [ord(c) for f in firsts for c in {f, f.upper()}] if unsafe else [slice(None)]:
                table[first, ord(second)] = True
    return table.reshape(-1) if table.any() else None


def table_of(patterns: Iterable[str]) -> np.ndarray | None:
    return cut_table(tuple(patterns))


def pieces(texts: pa.StringArray, table: np.ndarray | None) -> tuple[pa.StringArray, np.ndarray]:
    """(pieces of all texts, place of each text's first piece and the end); an empty text has none."""
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    first, last = int(offsets[0]), int(offsets[-1])
    if first == last:
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
    stop = np.zeros(0, np.int64)
    if table is not None:
        signs = np.frombuffer(data, np.uint8)[:last]
        stop = np.flatnonzero(signs[first:-1] == ord(STOP)) + first
        stop = stop[stop >= 2]
        after = signs[stop + 1]
        stop = stop[((after == ord(" ")) | (after == ord("\n"))) & table[signs[stop - 2].astype(np.int64) * 256 + signs[stop - 1]]]
        guarded = np.flatnonzero(signs[first:] == ord(GUARD)) + first
        if len(guarded):
            whole = np.zeros(len(texts) + 1, bool)
            whole[np.searchsorted(offsets, guarded, "right") - 1] = True
            stop = stop[~whole[np.searchsorted(offsets, stop, "right") - 1]]
    bounds = np.sort(np.concatenate([offsets, (stop + 1).astype(np.int32)]), kind="stable")
    bounds = bounds[np.concatenate([[True], np.diff(bounds) > 0])]
    cut = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), data)
    return cut, np.searchsorted(bounds, offsets)
