"""Many patterns over a text in one pass.

An automaton over the literal heads of all patterns runs once over a text; a
pattern is tried only where one of its heads stands.  What a text costs follows
its length and its hits, not the number of patterns, so a lexicon may have a
hundred thousand rows.  Patterns that begin with a digit are tried where a
number begins; patterns that begin with a word of any kind and go on with a
literal are tried at the word before that literal.  Only patterns of another
shape are searched for in the whole text.

The automaton is built once per Python worker and lexicon.  Texts come in Arrow
batches and are cut where no pattern can match across (``functions.cuts``); a
worker scans each piece once and keeps its spans up to a bound, so memory is
bounded by the spans of one batch and of ``KNOWN_SIGNS``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from re import _compiler as compiler
from re import _constants as C
from re import _parser as parser

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.cuts import pieces, table_of
from chartloom.functions.spans import SPANS_TYPE, Rule

DIGIT = "\0digit"  # stands for any digit among the heads of a pattern
MAX_HEADS = 4096
#: Letters whose lower case is longer or depends on what follows, or that match another letter only when case is ignored.
_SINGLE = {0x17F: "s", 0x131: "i", 0x130: "i", 0x212A: "k", 0x3A3: "\u03c3", 0x3C2: "\u03c3", 0xB5: "\u03bc"}


def fold(text: str) -> str:
    """Lower case, letter for letter: offsets stay."""
    if text.isascii():
        return text.lower()
    low = text.translate(_SINGLE).lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text.translate(_SINGLE))


def _set_heads(items) -> set[tuple[str, bool]] | None:
    """Heads of a character class: its plain characters, or any digit."""
    if items == [(C.CATEGORY, C.CATEGORY_DIGIT)]:
        return {(DIGIT, False)}
    if all(op is C.LITERAL for op, _ in items):
        return {(fold(chr(c)), True) for _, c in items}
    ranges = [a for op, a in items if op is C.RANGE]
    if len(ranges) == len(items) and all(b - a < 10 for a, b in ranges):
        return {(fold(chr(c)), True) for a, b in ranges for c in range(a, b + 1)}
    return None


def heads(items) -> set[tuple[str, bool]] | None:
    """(text, whole) in lower case: every match of the parsed items begins with one text; None if none can be named.

    ``whole`` says that the text stands for all of the items.  A head may be empty.
    """
    found: set[tuple[str, bool]] = {("", True)}
    for op, arg in items:
        if op is C.AT:
            continue
        if op is C.LITERAL:
            here = {(fold(chr(arg)), True)}
        elif op is C.IN:
            here = _set_heads(arg)
        elif op is C.SUBPATTERN:
            here = heads(arg[3])
        elif op is C.BRANCH:
            parts = [heads(x) for x in arg[1]]
            here = None if any(p is None for p in parts) else set().union(*parts)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            here = heads(arg[2])
            here = here and {(text, whole and arg[1] == 1) for text, whole in here}
        else:
            here = None
        if here is None or (DIGIT, False) in here and found != {("", True)} or len(found) * len(here) > MAX_HEADS:
            return {(text, False) for text, _ in found} if found != {("", True)} else None
        found = {(a + b, whole) for a, _ in found for b, whole in here}
        if not all(whole for _, whole in found):
            return {(text, False) for text, _ in found}
    return found


def _unwrapped(items) -> list:
    """The items with groups that enclose them all, or begin them, opened."""
    items = list(items)
    while items and items[0][0] is C.SUBPATTERN:
        items = [*items[0][1][3], *items[1:]]
    return items


def _category(item, category, unbounded: bool = True) -> bool:
    return (item[0] in (C.MAX_REPEAT, C.MIN_REPEAT) and list(item[1][2]) == [(C.IN, [(C.CATEGORY, category)])]
            and (item[1][1] == C.MAXREPEAT or not unbounded))


def shape(pattern: str) -> tuple[str, frozenset[str]]:
    """(kind, heads): where matches of a pattern can begin.

    ``head``: at one of the heads, where a word begins; ``free``: at one of the
    heads wherever it stands; ``word``: at the word before one of the heads;
    ``any``: anywhere.
    """
    items = _unwrapped(parser.parse(pattern, re.I))
    bounded = bool(items) and items[0] == (C.AT, C.AT_BOUNDARY)
    items = _unwrapped(items[1:] if bounded else items)
    first = heads(items)
    # digits are tried only where a word begins, which the boundary asks for
    usable = first is not None and all(text for text, _ in first) and (bounded or (DIGIT, False) not in first)
    if usable:
        return "head" if bounded else "free", frozenset(text for text, _ in first)
    if bounded and items and _category(items[0], C.CATEGORY_WORD) and items[0][1][0] == 1:
        blanks = len(items) > 1 and _category(items[1], C.CATEGORY_SPACE)
        least = items[1][1][0] if blanks else 0
        after = heads(_unwrapped(items[2:] if blanks else items[1:]))
        if after and all(text for text, _ in after) and ((DIGIT, False) not in after or least):
            return "word", frozenset(text for text, _ in after)
    return "any", frozenset()


def number_tail(pattern: str) -> tuple[frozenset[str], re.Pattern] | None:
    """(signs, tail) of a pattern that is plain classes and blanks up to its first number, else None.

    The part before the number holds no digits, so a match lies in one run of its
    signs and blanks that ends where a number begins, and begins with a word; the
    tail says whether the rest fits there.  A run is then tried only if it does.
    """
    parsed = parser.parse(pattern, re.I)
    items = list(parsed)
    if not items or items[0] != (C.AT, C.AT_BOUNDARY):
        return None
    signs = []
    for at, item in enumerate(items[1:], 1):
        op, arg = item
        if _category(item, C.CATEGORY_DIGIT) and arg[0] >= 1:
            if at < 3 or not _category(items[at - 1], C.CATEGORY_SPACE) or items[at - 1][1][0] < 1:
                return None
            tail = compiler.compile(parser.SubPattern(parsed.state, items[at:]), re.I)
            fits = re.compile("[" + "".join(signs) + r"\s]", re.I).match
            return frozenset(c for c in map(chr, range(0x3100)) if fits(c)), tail
        classes = list(arg[2]) if op in (C.MAX_REPEAT, C.MIN_REPEAT) else [item]
        if len(classes) != 1 or classes[0][0] is not C.IN:
            return None
        for kind, value in classes[0][1]:
            low, high = value if kind is C.RANGE else (value, value) if kind is C.LITERAL else (0, 0)
            if kind is C.RANGE and (chr(low) + chr(high)).isalpha() and high < 128:
                signs.append(f"{chr(low)}-{chr(high)}")
            elif kind is C.LITERAL and not chr(low).isdecimal():
                signs.append(re.escape(chr(low)))
            elif (kind, value) != (C.CATEGORY, C.CATEGORY_SPACE):
                return None
        if at == 1 and not (op is C.IN and all(kind is C.RANGE for kind, _ in arg)):
            return None
    return None


def _first_signs(items) -> tuple[set[str], bool] | None:
    """(signs, empty): what the parsed items can begin with, a blank for any space, and whether they can be empty; None if unknown."""
    found: set[str] = set()
    for op, arg in items:
        if op is C.AT:
            continue
        if op is C.SUBPATTERN:
            here = _first_signs(arg[3])
        elif op is C.BRANCH:
            parts = [_first_signs(x) for x in arg[1]]
            here = None if None in parts else (set().union(*(p[0] for p in parts)), any(p[1] for p in parts))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            here = _first_signs(arg[2])
            here = here and (here[0], here[1] or arg[0] == 0)
        elif op is C.LITERAL:
            here = {fold(chr(arg))}, False
        elif op is C.IN:
            here = ({" "}, False) if arg == [(C.CATEGORY, C.CATEGORY_SPACE)] else None
            if here is None and all(kind is C.LITERAL for kind, _ in arg):
                here = {fold(chr(c)) for _, c in arg}, False
        else:
            here = None
        if here is None:
            return None
        found |= here[0]
        if not here[1]:
            return found, False
    return found, True


def _after_blanks(items) -> set[str] | None:
    """Signs of which one must follow blanks that the parsed items begin with; None if unknown."""
    for at, item in enumerate(items):
        blanks = _category(item, C.CATEGORY_SPACE)
        here = _first_signs(items[at + 1:] if blanks else [item])
        if here is None or " " in here[0] or here[1] == blanks:
            return None
        if blanks:
            return here[0]
    return None


class Number:
    """What is known of the number that parsed items begin with: its digits, and the signs after it.

    A number is a run of digits that begins a word; a match takes a whole run, or
    the rest of it would have to be what follows.
    """

    def __init__(self, items):
        (least, most, _), rest = items[0][1], items[1:]
        found = _first_signs(rest)
        known = found is not None and not found[1] and not any(c.isdecimal() for c in found[0])
        self.edge = bool(rest) and rest[0] == (C.AT, C.AT_BOUNDARY)  # the run is followed by no word sign
        self.least, self.most = least, most if most != C.MAXREPEAT and (known or self.edge) else None
        self.blank = known and " " in found[0]
        self.signs = _codes(found[0] - {" "}) if known else None
        then = _after_blanks(rest) if self.blank else None
        self.then = None if then is None else _codes(then)

    def fits(self, size: np.ndarray, after: np.ndarray, signs: np.ndarray, word: np.ndarray, space: np.ndarray, solid: np.ndarray) -> np.ndarray:
        """Which numbers of ``size`` digits that end before ``after`` can begin a match; ``solid`` are the next places without blank."""
        ok = size >= self.least
        if self.most is not None:
            ok &= size <= self.most
        if self.edge:
            ok &= ~word[after]
        if self.signs is not None:
            follows = np.isin(signs[after], self.signs)
            if self.blank:
                follows |= space[after] if self.then is None else space[after] & np.isin(signs[solid], self.then)
            ok &= follows
        return ok


def _codes(signs: set[str]) -> np.ndarray:
    return np.array(sorted(map(ord, signs)), np.uint32)


def number_start(pattern: str, words: int = 0) -> Number | None:
    """The number that a pattern begins with, after ``words`` items in front of it."""
    items = _unwrapped(parser.parse(pattern, re.I))
    items = _unwrapped(_unwrapped(items[1:] if items and items[0] == (C.AT, C.AT_BOUNDARY) else items)[words:])
    return Number(items) if items and _category(items[0], C.CATEGORY_DIGIT, False) else None


def _looks_back(items) -> bool:
    """Whether parsed items ask for what stands before a match, other than a word boundary."""
    for op, arg in items:
        if op is C.AT and arg in (C.AT_BEGINNING, C.AT_BEGINNING_STRING, C.AT_BEGINNING_LINE) or op in (C.ASSERT, C.ASSERT_NOT) and arg[0] < 0:
            return True
        inner = arg[1] if op is C.BRANCH else [x for x in arg if isinstance(x, parser.SubPattern)] if isinstance(arg, tuple) else []
        if any(_looks_back(x) for x in inner):
            return True
    return False


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word signs, blanks and digits among all code points, as the patterns see them."""
    signs = [chr(c) for c in range(0x110000)]
    return (np.fromiter((c.isalnum() or c == "_" for c in signs), bool, len(signs)), np.fromiter(map(str.isspace, signs), bool, len(signs)),
            np.fromiter(map(str.isdecimal, signs), bool, len(signs)))


class _Lists:
    """Lists of rules, one per head, laid out in one array."""

    def __init__(self, lists: list[list[int]]):
        self.first = np.cumsum([0, *map(len, lists)])
        self.rules = np.array([i for x in lists for i in x], np.int64)

    def spread(self, heads_: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rule, place) for every rule of the head found at a place."""
        n = self.first[heads_ + 1] - self.first[heads_]
        at = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        return self.rules[self.first[heads_][at] + within], places[at]


class Scanner:
    """All matches of the rules in texts, rule by rule, each rule leftmost and without overlaps, case ignored."""

    def __init__(self, rules: Iterable[Rule]):
        import ahocorasick

        self.rules = list(rules)
        self._compiled: dict[int, re.Pattern] = {}
        self.anywhere: list[int] = []
        self.runs: list[tuple[int, frozenset[str], re.Pattern]] = []
        self.digits: list[tuple[int, Number | None]] = []
        self.digit_words: list[tuple[int, Number | None]] = []
        table: dict[str, dict[str, list[int]]] = {}
        for i, rule in enumerate(self.rules):
            kind, texts = shape(rule.pattern)
            run = number_tail(rule.pattern) if kind == "any" else None
            if _looks_back(parser.parse(rule.pattern, re.I)) or kind == "any" and not run:
                self.anywhere.append(i)
                continue
            if run:
                self.runs.append((i, *run))
            for text in texts:
                if text == DIGIT and kind == "head":
                    self.digits.append((i, number_start(rule.pattern)))
                elif text == DIGIT:
                    self.digit_words.append((i, number_start(rule.pattern, 2)))
                else:
                    table.setdefault(text, {"head": [], "free": [], "word": []})[kind].append(i)
        self.automaton = ahocorasick.Automaton()
        for k, text in enumerate(table):
            self.automaton.add_word(text, k)
        if table:
            self.automaton.make_automaton()
        self.has_heads = bool(table)
        self.length = np.array([len(text) for text in table], np.int64)
        self.is_word = np.array([bool(_WORD.match(text)) for text in table], bool)
        self.lists = {kind: _Lists([tried[kind] for tried in table.values()]) for kind in ("head", "free", "word")}
        #: Only heads that may stand anywhere: words, blanks and numbers need not be found.
        self.only_free = not (self.digits or self.digit_words or self.runs or len(self.lists["head"].rules) or len(self.lists["word"].rules))

    def pattern(self, i: int) -> re.Pattern:
        found = self._compiled.get(i)
        if found is None:
            found = self._compiled[i] = re.compile(self.rules[i].pattern, re.I)
        return found

    def starts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(rule, place) where rules are worth trying in a text that ends with MARK, in the order of rules, then of places."""
        low = fold(text)
        if self.only_free:
            head, at = self._hits(low)
            return self._ordered(*([x] for x in self.lists["free"].spread(head, at)), len(text))
        is_word, is_space, is_digit = _classes()
        plain = text.isascii()  # a byte a sign then
        codes = np.frombuffer(text.encode("ascii"), np.uint8) if plain else np.frombuffer(text.encode("utf-32-le"), np.uint32)
        word, space = (is_word[:128][codes], is_space[:128][codes]) if plain else (is_word[codes], is_space[codes])
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        first, solid = np.flatnonzero(begins), np.flatnonzero(~space)  # the mark at the end is solid
        rules, places = [], []

        def before(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Starts of the words that end before ``p``, blanks between left out, and where there are any."""
            at = np.searchsorted(solid, p) - 1
            q = solid[np.maximum(at, 0)]
            found = (at >= 0) & word[q]
            return first[np.searchsorted(first, q, "right") - 1] if len(first) else q, found

        if self.has_heads:
            head, at = self._hits(low)
            bounded = ~self.is_word[head] | begins[at]
            for kind, chosen in (("head", bounded), ("free", slice(None))):
                if len(self.lists[kind].rules):
                    i, p = self.lists[kind].spread(head[chosen], at[chosen])
                    rules.append(i)
                    places.append(p)
            if len(self.lists["word"].rules):
                i, p = self.lists["word"].spread(head, at)
                q, found = before(p)
                rules.append(i[found])
                places.append(q[found])
        if self.digits or self.digit_words or self.runs:
            digit = is_digit[:128][codes] if plain else is_digit[codes]
            numbers = np.flatnonzero(begins & digit)
            ends = np.flatnonzero(digit[:-1] & ~digit[1:]) + 1  # the mark at the end is no digit
            after = ends[np.searchsorted(ends, numbers, "right")]
            size, following = after - numbers, solid[np.searchsorted(solid, after)]
            signs = codes if low is text else np.frombuffer(low.encode("ascii"), np.uint8) if plain else np.frombuffer(low.encode("utf-32-le"), np.uint32)
            q, found = before(numbers) if self.digit_words else (numbers, numbers)
            for i, number in self.digits:
                p = numbers if number is None else numbers[number.fits(size, after, signs, word, space, following)]
                rules.append(np.full(len(p), i))
                places.append(p)
            for i, number in self.digit_words:
                p = q[found if number is None else found & number.fits(size, after, signs, word, space, following)]
                rules.append(np.full(len(p), i))
                places.append(p)
            blanks = numbers[(numbers > 0) & space[numbers - 1]].tolist()
            for i, signs_, tail in self.runs:
                for p in blanks:
                    if tail.match(text, p):
                        left = p  # runs of two numbers share no sign, as no sign is a digit
                        while left and text[left - 1] in signs_:
                            left -= 1
                        here = left + np.flatnonzero(begins[left:p])
                        rules.append(np.full(len(here), i))
                        places.append(here)
        return self._ordered(rules, places, len(codes))

    def _hits(self, low: str) -> tuple[np.ndarray, np.ndarray]:
        """(head, place) of the literal heads in a text in lower case."""
        if not self.has_heads:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        hits = np.fromiter(chain.from_iterable(self.automaton.iter(low)), np.int64).reshape(-1, 2)
        head = hits[:, 1]
        return head, hits[:, 0] - self.length[head] + 1

    @staticmethod
    def _ordered(rules: list[np.ndarray], places: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Different (rule, place) in the order of rules, then of places."""
        if not rules:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        tries = np.unique(np.concatenate(rules) * np.int64(size + 1) + np.concatenate(places))
        return tries // (size + 1), tries % (size + 1)

    def scan_all(self, texts: list[str]) -> list[tuple[int, int, int, int, str, re.Match]]:
        """(text, start, rule, end, hit, match) of all texts, in the order of rules.

        The texts are laid end to end; a match sees its own text's end and, before
        it, at most a mark, which is neither a word sign nor a blank.
        """
        joined = MARK.join(texts) + MARK
        bounds = np.cumsum([0, *(len(x) + 1 for x in texts)])
        rules, places = self.starts(joined)
        owner = np.searchsorted(bounds, places, "right") - 1
        out = []
        cuts = [0, *(np.flatnonzero(np.diff(rules)) + 1).tolist(), len(rules)] if len(rules) else [0]
        begin, stop = bounds[owner].tolist(), (bounds[owner + 1] - 1).tolist()
        owners, at = owner.tolist(), places.tolist()
        for first, last in zip(cuts, cuts[1:]):
            i = int(rules[first])
            match, end = self.pattern(i).match, 0
            for j in range(first, last):
                p = at[j]
                if p >= end and (m := match(joined, p, stop[j])):
                    end = m.end()
                    out.append((owners[j], p - begin[j], i, end - begin[j], joined[p:end], m))
        for i in self.anywhere:
            find = self.pattern(i).finditer
            out.extend((k, m.start(), i, m.end(), m.group(), m) for k, text in enumerate(texts) for m in find(text))
        return out

    def scan(self, text: str) -> list[tuple[int, re.Match]]:
        """(rule, match) in the order of rules, then of places."""
        return sorted(((i, m) for _, _, i, _, _, m in self.scan_all([text])), key=lambda x: x[0])


_WORD = re.compile(r"\w+")
MARK = "\x01"  # stands between texts; neither a word sign nor a blank
#: Signs of the texts that are scanned together.
SCAN_SIGNS = 1 << 20


@lru_cache(maxsize=4)
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


@dataclass(frozen=True)
class Scores:
    """Confidence by label, raised by a digit and by several words (the SQL of ``functions.spans.label_score``)."""

    base: tuple[tuple[str, float], ...]
    default: float

    def rater(self):
        base = dict(self.base)
        digit, several = re.compile("[0-9]").search, re.compile(r"\S\s+\S", re.A).search

        @lru_cache(maxsize=1 << 16)
        def rate(label: str, hit: str) -> float:
            return min(base.get(label, self.default) + (0.05 if digit(hit) else 0.0) + (0.03 if several(hit) else 0.0), 0.98)

        return rate


@lru_cache(maxsize=4)
def _rater(scores: Scores):
    return scores.rater()


def _groups(texts: list[str | None]):
    """Runs of texts that are scanned together: (place of the first, texts)."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size > SCAN_SIGNS:
            yield first, texts[first:k + 1]
            first, size = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def best_spans(spans: list[tuple], scores: list[float]) -> list[int]:
    """Positions of the best spans (text, start, ord, end, ...) that do not overlap; the rule of ``functions.spans.resolve_overlaps``."""
    kept: list[int] = []
    owner = end = -1
    for x in sorted(range(len(spans)), key=spans.__getitem__):
        k, start, _, stop = spans[x][:4]
        if k == owner and start < end:
            if scores[x] > scores[kept[-1]]:
                kept[-1], end = x, stop
        else:
            kept.append(x)
            owner, end = k, stop
    return kept


def _found(texts: list[str], rules: tuple[Rule, ...], first_ord: int, scores: Scores | None, resolved: bool):
    """(offsets, spans) of texts as Arrow structs, text by text."""
    import pyarrow as pa

    scanner = _scanner(rules)
    rate = _rater(scores) if scores else None
    labels, fixed, captures = [r.label for r in rules], [r.confidence for r in rules], any(r.captures for r in rules)
    spans, rated = [], []
    for base, group in _groups(texts):
        found = scanner.scan_all(group)
        rating = [rate(labels[x[2]], x[4]) for x in found] if rate else [fixed[x[2]] for x in found]
        order = best_spans(found, rating) if resolved else sorted(range(len(found)), key=lambda x: found[x][0])  # stable: rules, then places
        spans.extend((base + found[x][0], *found[x][1:]) if base else found[x] for x in order)
        rated.extend(rating[x] for x in order)
    owner, starts, orders, ends, hits, matches = zip(*spans) if spans else ((),) * 6
    offsets = np.searchsorted(np.array(owner, np.int64), np.arange(len(texts) + 1))
    rule = pa.array(orders, pa.int64())
    values, bounds = pa.nulls(len(spans), pa.string()), pa.nulls(len(spans), pa.string())
    if captures:
        groups = [m.group(1, 2, 3) if rules[i].captures else (None, None, None) for i, m in zip(orders, matches)]
        values = pa.array([v or None for v, _, _ in groups], pa.string())
        bounds = pa.array([f"{low}-{high}" if low and high else None for _, low, high in groups], pa.string())
    fields = {"start": pa.array(starts, pa.int32()), "ord": pa.array(first_ord + np.array(orders, np.int32), pa.int32()), "end": pa.array(ends, pa.int32()),
              "label": pa.array(labels, pa.string()).take(rule), "text": pa.array(hits, pa.string()), "confidence": pa.array(rated, pa.float64()),
              "semantic_type": pa.array([r.semantic_type for r in rules], pa.string()).take(rule), "value": values, "reference_range": bounds}
    return offsets, pa.StructArray.from_arrays(list(fields.values()), list(fields))


#: Signs of pieces whose spans a worker keeps from batch to batch; beyond them it begins anew.
KNOWN_SIGNS = 1 << 23


class _Known:
    """Spans of the different pieces of texts that were scanned so far."""

    def __init__(self, rules: tuple[Rule, ...], first_ord: int, scores: Scores | None, resolved: bool):
        self.asked = rules, first_ord, scores, resolved
        self.table = table_of(r.pattern for r in rules)
        self.forget()

    def forget(self):
        self.places: dict[str, int] = {}
        self.size, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)  # signs of a piece, its first span
        self.spans, self.signs = None, 0

    def scan(self, texts: list[str]):
        return _found(texts, *self.asked)

    def look_up(self, texts: list[str]) -> np.ndarray:
        """Places of different texts among the known pieces; new ones are scanned."""
        import pyarrow as pa

        if self.signs > KNOWN_SIGNS:
            self.forget()
        places = self.places
        fresh = [x for x in texts if x not in places]
        if fresh or self.spans is None:
            offsets, spans = self.scan(fresh)
            size = np.fromiter(map(len, fresh), np.int64, len(fresh))
            places.update(zip(fresh, range(len(places), len(places) + len(fresh))))
            self.first = np.concatenate([self.first, self.first[-1] + offsets[1:]])
            self.size, self.signs = np.concatenate([self.size, size]), self.signs + int(size.sum())
            self.spans = spans if self.spans is None else pa.concat_arrays([self.spans, spans])
        return np.fromiter(map(places.__getitem__, texts), np.int64, len(texts))

    def pieces(self, column, clear: bool) -> tuple[np.ndarray, np.ndarray]:
        """(known place of each piece of the texts, first piece of each text and the end)."""
        cut, ends = pieces(_plain(column, clear), self.table)
        coded = cut.dictionary_encode()
        return self.look_up(coded.dictionary.to_pylist())[coded.indices.to_numpy()], ends

    def spread(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, span) for every span of the pieces, in their order."""
        n = self.first[which + 1] - self.first[which]
        piece = np.repeat(np.arange(len(which)), n)
        return piece, np.arange(len(piece)) + np.repeat(self.first[which] - (np.cumsum(n) - n), n)


@lru_cache(maxsize=4)
def _known(rules: tuple[Rule, ...], first_ord: int, scores: Scores | None, resolved: bool) -> _Known:
    return _Known(rules, first_ord, scores, resolved)


def _plain(column, clear: bool):
    """The texts without nulls; ``clear`` makes blanks of the two marks (``functions.spans.clear_marks``)."""
    import pyarrow as pa

    texts = column.cast(pa.string()).fill_null("")
    data = texts.buffers()[2]
    signs = np.frombuffer(data, np.uint8) if clear and data is not None else np.empty(0, np.uint8)
    marks = (signs == 1) | (signs == 2)
    if not marks.any():
        return texts
    return pa.StringArray.from_buffers(len(texts), texts.buffers()[1], pa.py_buffer(np.where(marks, np.uint8(32), signs)), offset=texts.offset)


def _spans(column, rules: tuple[Rule, ...], first_ord: int, scores: Scores | None, resolved: bool, clear: bool = False):
    import pyarrow as pa

    known = _known(rules, first_ord, scores, resolved)
    which, ends = known.pieces(column, clear)
    piece, span = known.spread(which)
    before = np.concatenate([[0], np.cumsum(known.size[which])])
    owner = np.repeat(np.arange(len(column)), np.diff(ends))
    shift = (before[:-1] - before[ends[:-1]][owner])[piece]
    if not resolved and len(span):  # rules, then places; no span lies in two pieces
        orders = known.spans.field("ord").to_numpy()[span]
        by_rule = np.argsort(owner[piece] * np.int64(len(rules)) + (orders - first_ord), kind="stable")
        span, shift, piece = span[by_rule], shift[by_rule], piece[by_rule]
    items = known.spans.take(pa.array(span, pa.int64()))
    fields = {f.name: items.field(i) for i, f in enumerate(items.type)}
    for name in ("start", "end"):
        fields[name] = pa.array((fields[name].to_numpy() + shift).astype(np.int32), pa.int32())
    offsets = np.searchsorted(owner[piece], np.arange(len(column) + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def scanned(text: Column, rules: list[Rule], first_ord: int = 0, scores: Scores | None = None, resolved: bool = False,
            clear: bool = False) -> Column:
    """All matches of all rules as one array of spans, rule by rule; a null or empty text has none.

    ``scores`` give the confidence, default the rule's own; ``resolved`` keeps the
    best spans that do not overlap, in start order; ``clear`` reads the two marks
    as blanks.
    """
    fixed = tuple(rules)

    @F.arrow_udf(SPANS_TYPE)
    def found(column):
        return _spans(column, fixed, first_ord, scores, resolved, clear)

    return found(text)


COUNTS_TYPE = "array<struct<label:string,text:string,n:bigint>>"


def _counts(column, rules: tuple[Rule, ...], clear: bool = False):
    import pyarrow as pa

    known = _known(rules, 0, None, False)
    times = np.bincount(known.pieces(column, clear)[0], minlength=1)
    which = np.flatnonzero(times)
    piece, span = known.spread(which) if len(which) else (which, which)
    items = known.spans.take(pa.array(span, pa.int64()))
    found = pa.table({"label": items.field("label"), "text": items.field("text"), "n": pa.array(times[which][piece], pa.int64())})
    found = found.group_by(["label", "text"]).aggregate([("n", "sum")]).combine_chunks()
    fields = [found.column(k).combine_chunks().cast(t) for k, t in (("label", pa.string()), ("text", pa.string()), ("n_sum", pa.int64()))]
    offsets = np.minimum(np.arange(len(column) + 1), 1) * found.num_rows
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["label", "text", "n"]))


def counted(docs: DataFrame, rules: list[Rule], text: Column, clear: bool = False) -> DataFrame:
    """(label, text, n): how often the rules find each text under each label.

    The matches of a batch leave Python as counts, in the array of its first row,
    so what is exchanged follows the different texts and not the matches.
    """
    fixed = tuple(rules)

    @F.arrow_udf(COUNTS_TYPE)
    def found(column):
        return _counts(column, fixed, clear)

    rows = docs.select(F.explode_outer(found(text)).alias("c")).filter(F.col("c").isNotNull())
    return rows.groupBy("c.label", "c.text").agg(F.sum("c.n").alias("n"))


def find_terms(docs: DataFrame, terms: list[str], label: str, into: str = "spans", text: str = "text") -> DataFrame:
    """Adds the whole-word occurrences of a list of terms, case ignored; the list may have a hundred thousand entries."""
    rules = [Rule(label, r"\b" + re.escape(t) + r"\b" if re.match(r"\w.*\w\Z|\w\Z", t, re.S) else re.escape(t), 0.7) for t in terms]
    return docs.withColumn(into, scanned(F.col(text), rules))
