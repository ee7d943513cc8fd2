"""Plain versions of the operators' results, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile("[^\x20\x09-\x0D]+")
ASSIGN = re.compile("(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(text: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits(text))):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def secret_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out)


def private_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    text = text or ""
    out = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(m[0])]
    out += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def entropy_windows(text: str, window: int) -> float:
    best = 0.0
    for i in range(len(text) - window + 1):
        counts = Counter(text[i:i + window]).values()
        best = max(best, -sum(c / window * math.log2(c / window) for c in counts))
    return best


def unite(pairs, ids) -> dict:
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def repeats(docs: list[tuple[int, str | None]], window: int) -> dict[int, tuple[int, int, str]]:
    seen: Counter = Counter()
    for _, t in docs:
        w = words(t)
        seen.update(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    out = {}
    for k, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out[k] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def shingles(text: str | None) -> frozenset:
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_duplicates(docs: list[tuple[int, str | None]], percent: int = 75) -> dict[int, tuple[int, int]]:
    sets = {k: shingles(t) for k, t in docs}
    holders = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    common: Counter = Counter()
    for ks in holders.values():
        common.update((a, b) for i, a in enumerate(ks) for b in ks[i + 1:])
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    root = unite(links, sets)
    return {k: (len(sets[k]), root[k]) for k in sets}


def usable(v) -> bool:
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def vector_links(rows, cosine: float) -> dict[int, tuple[int, int]]:
    count, pairs, ids = Counter(), [], [r[0] for r in rows]
    good = [(k, np.array(v, float), label) for k, v, label in rows if label is not None and usable(v)]
    for i, (a, x, p) in enumerate(good):
        for b, y, q in good[i + 1:]:
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                count[a] += 1
                count[b] += 1
                pairs.append((a, b))
    root = unite(pairs, ids)
    return {k: (count[k], root[k]) for k in ids}


def top_k(queries, rows, k: int) -> list[tuple[int, int, int, int]]:
    ints = {i: [math.floor(256 * float(x)) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in queries:
        if q in ints:
            best = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return out
