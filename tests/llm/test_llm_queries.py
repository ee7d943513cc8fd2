"""The registered queries against brute force on a whole small table."""

import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest
from chartloom.llm import queries as registered
from chartloom.llm.encoding import tokenizer_path

Q = registered.QUERIES


@pytest.fixture(scope="module")
def docs(spark, small):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def vectors(spark, small):
    return [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]


def ids_of(name):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_top_k(spark, small, vectors):
    got = sorted(tuple(r) for r in Q["op1_top_k"](spark, small).collect())
    assert got == sorted(brute.top_k([v[0] for v in vectors if v[0] % 50 == 0], [v[:2] for v in vectors], 5))


def test_token_store(spark, small, docs):
    encode, start, want = ids_of(registered.WORD_TOKENIZER), 0, {}
    for k, t in docs:
        ids = [*encode(t or ""), 1]
        want[k] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in Q["op2_token_store"](spark, small).collect()} == want


def test_secrets(spark, small, docs):
    rows = {r["doc_id"]: r for r in Q["op3_secrets"](spark, small).collect()}
    assert len(rows) == len(docs)
    for k, t in docs:
        spans = brute.secret_spans(t)
        assert rows[k]["base_sha256"] == brute.sha(brute.joined(spans))
        assert [rows[k][f"n_{x}"] for x in ("assign", "access", "hex")] == [sum(s[3] == x for s in spans) for x in ("assign", "access", "hex")]
        assert {x for x in brute.joined(spans).split(",") if x} <= set(rows[k]["spans"].split(","))


def test_private_data(spark, small, docs):
    rows = {r["doc_id"]: r for r in Q["op4_private_data"](spark, small).collect()}
    assert len(rows) == len(docs)
    for k, t in docs:
        spans = brute.private_spans(t)
        assert rows[k]["base_sha256"] == brute.sha(brute.joined(spans))
        assert [rows[k][f"n_{x}"] for x in ("email", "ip", "card", "phone")] == [sum(s[3] == x for s in spans) for x in ("email", "ip", "card", "phone")]


def test_repeats(spark, small, docs):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in Q["op5_repeats"](spark, small).collect()}
    assert got == brute.repeats(docs, 35) and any(n for _, n, _ in got.values())


def test_near_duplicates(spark, small, docs):
    rows = Q["op6_near_duplicates"](spark, small).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute.near_duplicates(docs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows) and not all(r["kept"] for r in rows)


def test_packing(spark, small, docs):
    encode, places, total = ids_of(registered.BYTE_TOKENIZER), defaultdict(list), 0
    pieces = defaultdict(dict)
    for r in Q["op7_packing"](spark, small).collect():
        pieces[r["doc_id"]][r["piece"]] = (r["start"], r["length"], r["ids_crc32"])
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, t in docs:
        ids = [*encode(t or ""), 0]
        total += len(ids)
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        assert pieces[k] == {i: (a, b - a, crc(ids[a:b])) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))}
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(places) <= -(-total // 2048) + 1


def test_quality(spark, small, docs):
    rows = Q["op8_quality"](spark, small).collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in Q["op8_quality"](spark, sf).collect() if r["held_out"] and r["doc_id"] in label]
    good = [r["score"] for r in rows if label[r["doc_id"]] == 1]
    bad = [r["score"] for r in rows if label[r["doc_id"]] == 0]
    assert sum(g > b for g in good for b in bad) > 0.95 * len(good) * len(bad)
    assert sum(g >= 0.7 for g in good) > 0.97 * len(good)


def test_vector_links(spark, small, vectors):
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in Q["op9_vector_links"](spark, small).collect()}
    assert got == brute.vector_links(vectors, 0.93)


def test_mixing(spark, small, docs):
    rows = Q["op10_mixing"](spark, small).collect()
    assert {r["doc_id"]: r["size"] for r in rows} == {k: len(brute.words(t)) for k, t in docs}
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
        assert r["taken"] <= 3 * r["size"]
    assert {s: r for s, r in sizes.items()} == {source[r["doc_id"]]: r["source_size"] for r in rows}
    want = water_fill(sizes, (5, 2, 1), 3)
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in sizes)
    again = {r["doc_id"]: r["taken"] for r in Q["op10_mixing"](spark, small).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def water_fill(sizes, weights, stop):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share > stop * sizes[s]}
        for s in full:
            target[s] = float(stop * sizes[s])
            left -= target[s]
        open_ -= full
        if not full:
            target |= {s: weight[s] * share for s in open_}
            break
    return target
