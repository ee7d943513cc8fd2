"""Spans as arrays of structs next to their text.

A document and its spans stay in one row until the result is exploded: offsets,
overlap resolution and filters are array expressions, so a document table of
any size is processed without a shuffle and the memory of one task is bounded
by one document.

The functions return Spark SQL text.  A lexicon of fifty patterns is a tree of
a few thousand expressions; parsing it once is much cheaper than building it
call by call.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

SPAN_TYPE = ("struct<start:int,ord:int,end:int,label:string,text:string,confidence:double,"
             "semantic_type:string,value:string,reference_range:string>")
SPANS_TYPE = f"array<{SPAN_TYPE}>"


@dataclass(frozen=True)
class Rule:
    """One pattern of a lexicon."""

    label: str
    pattern: str
    confidence: float | None = None
    semantic_type: str | None = None
    captures: bool = False


def literal(value: str | None) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def java_pattern(pattern: str) -> str:
    """Case-insensitive with Unicode word, digit and boundary classes."""
    return "(?iU)" + pattern


def clear_marks(text: str) -> str:
    """The two marker characters become blanks, so offsets stay the same."""
    return f"translate({text}, '\\u0001\\u0002', '  ')"


def folded(text: str) -> str:
    """Lower case for word tests; the two letters that match s and i only when case is ignored are replaced."""
    return f"translate(lower({text}), '\u017f\u0131', 'si')"


def required_words(pattern: str) -> list[str] | None:
    """Lower-case words of which every match of the pattern contains one, or None.

    Read off a leading literal or a leading group of plain alternatives; parts
    that may be absent are left out.  Testing for the words first is several
    times cheaper than running the pattern over a text it cannot match.
    """
    literal_start = re.match(r"(?:\\b)?([A-Za-z0-9-]{3,})(?=\\s|\(\?:)", pattern)
    if literal_start:
        return [literal_start.group(1).lower()]
    group = re.match(r"\\b\((?:\?:)?((?:[^()\\]|\\[sdw.])*)\)(.?)", pattern)
    if not group or group.group(2) in ("?", "*", "{"):
        return None
    words = []
    for alternative in group.group(1).split("|"):
        pieces = re.split(r"\\.[?*+]?|\[[^\]]*\][?*+]?|.[?*]", alternative)
        longest = max(pieces, key=len)
        if len(longest) < 2 or not re.fullmatch(r"[A-Za-z0-9 /%-]+", longest):
            return None
        words.append(longest.lower())
    return words


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` bound to ``name`` and evaluated once per row."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: Elements folded at a time: growing an array costs this many copies per element, whatever its length.
BLOCK = 64


def running_sums(numbers: str) -> str:
    """Sums of the numbers before each element of a non-empty integer array, in linear time.

    Blocks are summed on their own and shifted by the sums of the blocks before.
    """
    grow = "named_struct('at', acc.at + {0}, 'out', concat(acc.out, array(acc.at)))"
    zero = "named_struct('at', 0, 'out', CAST(array() AS array<int>))"
    blocks = f"transform(sequence(1, size(ns), {BLOCK}), k -> aggregate(slice(ns, k, {BLOCK}), {zero}, (acc, n) -> {grow.format('n')}))"
    bases = f"aggregate(blocks, {zero}, (acc, b) -> {grow.format('b.at')}, acc -> acc.out)"
    return let(numbers, "ns", let(blocks, "blocks", f"flatten(zip_with(blocks, {bases}, (b, base) -> transform(b.out, x -> x + base)))"))


def fold_blocks(array: str, start: str, step: str, item_type: str, finish: str) -> str:
    """A fold that emits items, in linear time.

    ``step`` is over ``state`` and ``x`` and gives ``named_struct('state', ...,
    'items', array)``; ``finish`` is over ``state`` and ``items``.  Items of one
    block grow their own small array.
    """
    inner = (f"aggregate(block, named_struct('state', acc.state, 'items', CAST(array() AS array<{item_type}>)), "
             f"(a, x) -> {let(let('a.state', 'state', step), 'r', "named_struct('state', r.state, 'items', concat(a.items, r.items))")})")
    outer = let(inner, "done", "named_struct('state', done.state, 'items', concat(acc.items, array(done.items)))")
    blocks = f"transform(sequence(1, greatest(size(xs), 1), {BLOCK}), k -> slice(xs, k, {BLOCK}))"
    fold = (f"aggregate({blocks}, named_struct('state', {start}, 'items', CAST(array() AS array<array<{item_type}>>)), "
            f"(acc, block) -> {outer}, acc -> {let('acc.state', 'state', let('flatten(acc.items)', 'items', finish))})")
    return let(array, "xs", fold)


def fold_matches(text: str, pattern: str, element: str, element_type: str) -> str:
    """Array of ``element`` for every match, in order.

    One regex pass puts a mark on both sides of every match.  Splitting on the
    opening mark leaves pieces "match, closing mark, rest"; the start of a
    match is the sum of the lengths before it, less one closing mark per
    earlier match.  ``element`` may use ``at`` (the start) and ``hit``.
    """
    pieces = f"split(regexp_replace({text}, {literal(pattern)}, '\\u0001$0\\u0002'), '\\u0001')"
    built = let("sums[i + 1] - i", "at", let("substring_index(piece, '\\u0002', 1)", "hit", element))
    found = let(running_sums("transform(pieces, p -> length(p))"), "sums", f"transform(slice(pieces, 2, size(pieces)), (piece, i) -> {built})")
    return let(pieces, "pieces", f"CASE WHEN size(pieces) = 1 THEN CAST(array() AS array<{element_type}>) ELSE {found} END")


def match_starts(text: str, pattern: str) -> str:
    return fold_matches(text, java_pattern(pattern), "at", "int")


def find_spans(text: str, rules: list[Rule], score=None, first_ord: int = 0, low: str | None = None) -> str:
    """All matches of all rules as one array of spans, rule by rule.

    ``text`` is the name of a column that went through ``clear_marks`` and
    ``low`` one that also went through ``folded``; with it a rule runs only on
    texts that contain one of its required words.  ``score(label, hit)`` gives
    the SQL of a confidence, default the rule's own.
    """
    if not rules:
        return f"CAST(array() AS {SPANS_TYPE})"
    parts = []
    for i, rule in enumerate(rules):
        pattern = java_pattern(rule.pattern)
        confidence = score(literal(rule.label), "hit") if score else repr(rule.confidence) + "D"
        value = bounds = literal(None)
        if rule.captures:
            group = [f"regexp_extract(hit, {literal(pattern)}, {g})" for g in (1, 2, 3)]
            value = f"nullif({group[0]}, '')"
            bounds = f"CASE WHEN {group[1]} <> '' AND {group[2]} <> '' THEN concat({group[1]}, '-', {group[2]}) END"
        element = (f"CAST(struct(at, {first_ord + i}, at + length(hit), {literal(rule.label)}, hit, "
                   f"{confidence}, {literal(rule.semantic_type)}, {value}, {bounds}) AS {SPAN_TYPE})")
        found = fold_matches(text, pattern, element, SPAN_TYPE)
        words = required_words(rule.pattern) if low else None
        if words:
            test = " OR ".join(f"contains({low}, {literal(w)})" for w in words)
            found = f"CASE WHEN {test} THEN {found} ELSE CAST(array() AS {SPANS_TYPE}) END"
        parts.append(found)
    return "concat(" + ", ".join(parts) + ")"


def resolve_overlaps(spans: str, element_type: str = SPAN_TYPE) -> str:
    """Best non-overlapping spans in start order.

    Spans are taken by (start, ord).  One that starts before the kept one ends
    replaces it only with a strictly higher confidence.  Kept spans never
    overlap, so looking at the last one is the same as looking at all of them.
    Elements must begin with the fields start, ord.
    """
    step = (f"CASE WHEN x.start < state.end THEN named_struct('state', CASE WHEN x.confidence > state.confidence THEN x ELSE state END, "
            f"'items', CAST(array() AS array<{element_type}>)) ELSE named_struct('state', x, 'items', array(state)) END")
    fold = fold_blocks("slice(ordered, 2, size(ordered))", "ordered[0]", step, element_type, "concat(items, array(state))")
    return let(f"array_sort({spans})", "ordered", f"CASE WHEN size(ordered) < 2 THEN ordered ELSE {fold} END")


def context(text: str, start: str, end: str, width: int = 50) -> str:
    """Up to ``width`` characters on both sides of a span, clipped to the text."""
    return (f"substring({text}, greatest({start} - {width}, 0) + 1, "
            f"least({end} + {width}, length({text})) - greatest({start} - {width}, 0))")


def label_score(label: str, hit: str, base: dict[str, float], default: float) -> str:
    """Base by label, +0.05 with a digit, +0.03 with several words, at most 0.98."""
    cases = " ".join(f"WHEN {label} = {literal(k)} THEN {v}D" for k, v in base.items())
    start = f"CASE {cases} ELSE {default}D END" if cases else f"{default}D"
    return (f"least({start} + CASE WHEN {hit} RLIKE '[0-9]' THEN 0.05D ELSE 0D END "
            f"+ CASE WHEN {hit} RLIKE '\\\\S\\\\s+\\\\S' THEN 0.03D ELSE 0D END, 0.98D)")


def spread(df, partitions: int | None = None):
    """Repartition an input with fewer partitions than cores before costly row work.

    A table of any size already has at least as many splits as cores and is
    left alone; a small file is one split and would run on one core.
    """
    wanted = partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


#: Rows of a task of ``dealt``.
TASK_ROWS = 50_000


def dealt(df, rows: int = TASK_ROWS):
    """Deal the rows of a table out evenly, at most about ``rows`` to a task, before costly row work.

    The number of splits says nothing about that: a row group is read by one task
    however many splits its bytes make, so splits can be empty while others have
    a million rows.  The rows are counted from the footers of the files, and a
    task does not grow with the table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * max(1, -(-df.count() // (cores * rows))))  # full rounds of tasks
