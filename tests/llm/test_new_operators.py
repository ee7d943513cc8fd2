"""Chat formatting, source audit and centroid clusters: edge cases and plain versions; colliding words in the fingerprints."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from chartloom.llm import centroid_clusters as cc
from chartloom.llm import chat_format as cf
from chartloom.llm import near_dup, repeats, source_audit
from chartloom.llm.encoding import Encoder
from chartloom.llm.shared import byte_hashes, distinct_ranges, window_hashes

SIGNS = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "<\\/s>", "[ROLE]", "[TEXT]", "[/TEXT]", "é日本", "x", " ", "\n", "[\\\\SYS]", "s>", "/s>", "INST]", "\U0001f600"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- chats

def chats(seed, n=200):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "system", "tool", "[TEXT]</s>", None])
            rows.append((c, t, role, None if rng.random() < 0.1 else "".join(rng.choice(SIGNS) for _ in range(rng.randrange(25)))))
    rows += [(1000, t, rng.choice(["user", "assistant"]), "long " * rng.randrange(60)) for t in range(400)]
    rows += [(None, 1, "user", "a"), (None, None, "assistant", "b"), (2000, 0, "user", ""), (2001, 5, "assistant", "same"), (2001, 5, "assistant", "same")]
    rng.shuffle(rows)
    return rows


def plain_chats(rows):
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((-1 if t is None else t, r or "", x or ""))
    out = {}
    for c, own in groups.items():
        own.sort()
        loss = "".join(x for _, r, x in own if r == "assistant")
        out[c] = (len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)), len(loss), sha(loss))
    return out


@pytest.mark.parametrize("page_bytes", [cf.PAGE_BYTES, 300])
def test_chats_come_back(spark, page_bytes):
    rows = chats(page_bytes)
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string, page int")
    pages = cf.format_chats(turns, page_bytes=page_bytes)
    assert {r["key"]: tuple(r)[1:5] for r in cf.read_chats(pages).collect()} == plain_chats(rows)
    assert not cf.read_chats(cf.format_chats(turns.limit(0))).collect()


def test_pages_of_one_partition():
    """One conversation over several batches and pages; only conversations that begin and end inside are whole."""
    rows = [(1, "user", "a" * 50)] + [(2, "assistant", "b" * 50)] * 20 + [(3, "user", "c")] + [(4, "assistant", "<s>")]
    batches = [pa.RecordBatch.from_pydict({"key": [r[0] for r in part], "role": [r[1] for r in part], "text": [r[2] for r in part]})
               for part in (rows[:3], rows[3:9], rows[9:10], rows[10:])]
    pages = [r for b in cf.assemble_partition(batches, 7, 200) for r in b.to_pylist()]
    assert [p["page"] for p in pages] == list(range(7, 7 + len(pages)))
    assert {p["key"] for p in pages if p["whole"]} == {3}
    assert len([p for p in pages if p["key"] == 2]) == 2 and sum(p["n_turns"] for p in pages) == len(rows)
    assert [t for p in pages for t in cf.parse(p["formatted"])] == [r[1:] for r in rows]
    for p in pages:
        assert [p["formatted"][a:b] for a, b in zip(p["loss_start"], p["loss_end"], strict=True)] == [cf.escape(t) for r, t in cf.parse(p["formatted"]) if r == "assistant"]


def test_escapes_leave_no_control_string():
    for parts in itertools.product(SIGNS, repeat=3):
        text = "".join(parts)
        assert cf.unescape(cf.escape(text)) == text and not cf.CONTROL.search(cf.escape(text))


# ---------------------------------------------------------------- audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_audit(docs, least, ranks):
    docs = [((lang or ""), (source or ""), [t.translate({i: i + 32 for i in range(65, 91)}) for t in TERM.findall(text or "")]) for text, lang, source in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, terms in own for t in set(terms))
        kept = sorted(t for t, n in df.items() if n >= least)
        counts = {s: Counter() for s in {d[1] for d in own}}
        for _, s, terms in own:
            counts[s].update(t for t in terms if df[t] >= least)
        whole = sum(counts.values(), Counter())

        def rate(c):
            total = sum(c.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        p, q = {s: rate(c) for s, c in counts.items()}, rate(whole)
        for s in counts:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s)
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])[:ranks]
            out += [(lang, s, part, item, -v, i) for part, rows in (("pair", pairs), ("term", terms)) for i, (v, _, item) in enumerate(rows, 1)]
    return sorted(out)


def test_audit(spark):
    rng, docs = random.Random(4), []
    for i in range(400):
        text = " ".join(rng.choice(["Alpha", "beta,", "γάμμα", "it's", "x1y", "ÉTÉ", "déjà"]) + rng.choice(["", "s", "_t", "ed"]) for _ in range(rng.randrange(20)))
        docs.append((text, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, "S"])))
    docs += [("hot text again", "en", rng.choice(["s1", "s2"])) for _ in range(300)]
    docs += [(None, "en", "none"), ("", "xx", "only"), ("12 34", "yy", "a"), ("12", "yy", "b"), ("w " * 40_000, "en", "long")]
    frame = spark.createDataFrame([(i, *d, "c", 3) for i, d in enumerate(docs)], "doc_id bigint, text string, lang string, source string, term string, n bigint")
    want = plain_audit(docs, 30, 5)
    for blocks in ((256, 2048), (2, 3)):
        got = source_audit.audit_sources(frame.repartition(5), ranks=5, source_block=blocks[0], term_block=blocks[1])
        assert sorted(tuple(r) for r in got.collect()) == want
    assert not source_audit.audit_sources(frame.limit(0)).collect()


def test_copies_cost_one_row_a_task(spark):
    frame = spark.range(3000).selectExpr("'the same text' AS text", "'en' AS lang", "concat('s', id % 2) AS source").repartition(3)
    sent = source_audit.collapse_texts(frame).collect()
    assert len(sent) <= 9 and sum(r["n"] for r in sent) == 3000 and sum(r["text"] is not None for r in sent) <= 3


# ---------------------------------------------------------------- clusters

def plain_clusters(rows, k=8, rounds=10, dim=64):
    rows = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((sha(f"3:{i}"), v) for i, v in rows if i is not None)[:k]
    centroids = [v for _, v in start]
    if not centroids:
        return []
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for left in range(rounds, -1, -1):
        best = [min((apart(v, c), n) for n, c in enumerate(centroids)) for _, v in rows]
        for n in range(len(centroids) if left else 0):
            own = [v for (_, v), (_, c) in zip(rows, best, strict=True) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    cut = lambda x: min(x, 2**63 - 1)
    return sorted(((i, c, cut(d), cut(sum(min(x, 2**63 - 1) for x, y in best if y == c)), cut(sum(min(x, 2**63 - 1) for x, _ in best)), sha(",".join(map(str, centroids[c]))))
                   for (i, _), (d, c) in zip(rows, best, strict=True)), key=str)


@pytest.mark.parametrize("scale", [1.0, 1e-3, 3e5])
def test_clusters(spark, scale):
    rng = np.random.default_rng(int(scale) + 1)
    middle = rng.normal(size=(6, 64)) * scale
    rows = [(i, (middle[i % 6] + scale * 0.3 * rng.normal(size=64)).tolist()) for i in range(120)]
    rows += [(200, None), (201, [1.0] * 63), (202, [float("nan")] * 64), (203, [None] + [1.0] * 63), (204, []), (None, [0.5 * scale] * 64), (205, [0.0] * 64), (205, [0.0] * 64), (206, [float("inf")] * 64)]
    rows += [(300 + i, rows[0][1]) for i in range(40)]
    frame = spark.createDataFrame([(*r, 1, "v") for r in rows], "vec_id bigint, embedding array<double>, cluster int, v string")
    got = sorted((tuple(r) for r in cc.cluster_vectors(frame).collect()), key=str)
    assert got == plain_clusters(rows)


def test_few_or_no_vectors(spark):
    frame = spark.createDataFrame([(1, [2.0] * 64), (2, [2.0] * 64), (3, [-1.0] * 64)], "vec_id bigint, embedding array<double>")
    assert sorted(tuple(r) for r in cc.cluster_vectors(frame).collect()) == plain_clusters([tuple(r) for r in frame.collect()])
    assert not cc.cluster_vectors(frame.limit(0)).collect()
    assert not cc.cluster_vectors(frame.withColumn("vec_id", cc.F.lit(None).cast("bigint"))).collect()


def test_bounds_are_below_distances_and_prune():
    rng = np.random.default_rng(5)
    middle = rng.integers(-2000, 2000, (8, 64))
    x = np.repeat(middle, 100, 0) + rng.integers(-60, 60, (800, 64))
    pivots, centroids = x[::100].copy(), middle + rng.integers(-20, 20, (8, 64))
    known = cc.pivot_distances(x, pivots)
    exact = np.stack([np.sqrt(cc.squared(x, c)) for c in centroids], 1)
    bound = cc.lower_bounds(known, centroids, pivots)
    assert (bound <= exact).all() and bound.max() > 0
    cluster, distance, done = cc.nearest(x, known, centroids, pivots)
    assert done < 2 * len(x)  # of 8 for each
    assert (cluster == exact.argmin(1)).all() and (distance == np.array([cc.squared(x[i:i + 1], centroids[c])[0] for i, c in enumerate(cluster)])).all()


# ---------------------------------------------------------------- fingerprints

def parity_words(n):
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("length", [1024, 4096])
def test_words_of_bit_parities(spark, length):
    """Two words that every polynomial fingerprint with an odd base modulo 2**64 takes for one."""
    one, other = parity_words(length)
    raw = np.frombuffer((one + other).encode(), np.uint8)
    begin = np.array([0, length])
    assert len(set(byte_hashes(raw, begin, begin + length).tolist())) == 2 and distinct_ranges(raw, begin, begin + length)[0].tolist() in ([0, 1], [1, 0])
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = Encoder(name)
        assert encoder.ids(one + " " + other) == encoder._encode(one + " " + other)
    words = [f"w{i}" for i in range(34)]
    docs = [(1, " ".join([*words, one])), (2, " ".join([*words, other])), (3, one + " " + one), (4, other + " " + other)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {r["key"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.remove_repeats(frame).collect()} == brute.repeats(docs, 35)
    alone = spark.createDataFrame([(3, one), (4, other), (5, f"a {one} b c d"), (6, f"a {other} b c d")], "doc_id bigint, text string")
    assert all(r["kept"] for r in near_dup.link_documents(alone).collect())


def test_windows_of_any_length():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 3, 400).astype(np.uint64)
    for w in (1, 2, 3, 5, 7, 8, 35, 64):
        at = np.arange(len(values) - w + 1)
        prints = window_hashes(values, at, w).tolist()
        truth = [tuple(values[i:i + w].tolist()) for i in at]
        assert len(set(prints)) == len(set(truth)) == len(set(zip(prints, truth, strict=True)))


def test_first_halves_that_agree():
    """Fingerprints with equal first and different second halves are different."""
    prints = np.array([[5, 1], [5, 2], [5, 1], [6, 1], [5, 3], [7, 7]], np.uint64)
    assert repeats._recurring(prints).tolist() == [True, False, True, False, False, False]
    assert repeats._found(prints, np.array([[5, 3], [5, 2], [6, 2], [7, 7]], np.uint64)).tolist() == [False, True, False, False, True, True]
    assert repeats._distinct(prints).tolist() == [[5, 1], [5, 2], [5, 3], [6, 1], [7, 7]]
