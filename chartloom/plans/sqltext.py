"""Check-side SQL for spans: the same lexicons, matched by the other engine."""

from __future__ import annotations

from chartloom.functions.spans import Rule


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def find(rules: list[Rule], source: str = "notes", first_ord: int = 0, key: str = "doc_id") -> str:
    """(key, ord, label, kind, conf, start, end, text) of every match of every rule."""
    parts = []
    for i, r in enumerate(rules):
        mark = f"string_split(regexp_replace(text, {q('(?i)' + r.pattern)}, chr(1) || '\\0' || chr(2), 'g'), chr(1))"
        conf = f"{r.confidence}::DOUBLE" if r.confidence is not None else "NULL::DOUBLE"
        parts.append(f"SELECT {key}, {first_ord + i} AS ord, {q(r.label)} AS label, {q(r.semantic_type or '')} AS kind, "
                     f"{conf} AS conf, unnest(p) AS piece, generate_subscripts(p, 1) AS i "
                     f"FROM (SELECT {key}, {mark} AS p FROM {source})")
    union = " UNION ALL ".join(parts)
    return (f"SELECT {key}, ord, label, kind, conf, start::INT AS start, (start + length(text))::INT AS \"end\", text FROM ("
            f"SELECT *, split_part(piece, chr(2), 1) AS text, sum(length(piece) - CASE WHEN i > 1 THEN 1 ELSE 0 END) "
            f"OVER (PARTITION BY {key}, ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start "
            f"FROM ({union})) WHERE i > 1")


def score(label: str, text: str, base: dict[str, float], default: float) -> str:
    cases = " ".join(f"WHEN {label} = {q(k)} THEN {v}::DOUBLE" for k, v in base.items())
    return (f"least(CASE {cases} ELSE {default}::DOUBLE END + CASE WHEN regexp_matches({text}, '[0-9]') THEN 0.05::DOUBLE "
            f"ELSE 0::DOUBLE END + CASE WHEN regexp_matches({text}, '\\S\\s+\\S') THEN 0.03::DOUBLE ELSE 0::DOUBLE END, 0.98::DOUBLE)")


def resolve(source: str, key: str = "doc_id", fields: str = "label := label, text := text, conf := conf") -> str:
    """Greedy overlap rule as a list fold; one row per kept span."""
    return (f"SELECT {key}, unnest(kept, recursive := true) FROM (SELECT {key}, list_reduce(list([s] ORDER BY s.start, s.ord), "
            f"lambda acc, x: CASE WHEN x[1].start < acc[-1].\"end\" THEN CASE WHEN x[1].conf > acc[-1].conf "
            f"THEN list_concat(acc[:-2], x) ELSE acc END ELSE list_concat(acc, x) END) AS kept FROM ("
            f"SELECT {key}, struct_pack(start := start, ord := ord, \"end\" := \"end\", {fields}) AS s FROM {source}) GROUP BY {key})")


def any_pattern(text: str, patterns: list[str]) -> str:
    joined = "|".join(f"(?:{p})" for p in patterns)
    return f"regexp_matches({text}, {q(joined)})"


def contains_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def lookup(key: str, table: dict[str, str], default: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {default} END"
