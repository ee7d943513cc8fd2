"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax output.

The vectors and the output layer are learned by numpy stochastic gradient
descent from a bounded sample of labelled rows (``sample_docs``); the shares of
the labels are counted over all labelled rows and correct the sample's equal
shares.  Every document is scored from its whole text.  A score needs the
difference of the two outputs only, so scoring looks one number up per word and
n-gram: the vector's product with that difference.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from chartloom.llm.shared import byte_chunks, byte_hashes, claim_worker, free_name, join_hashes, saved, small_batches, text_bytes, whole_text, word_bounds

BUCKET_BITS = 16
ORDERS = (2, 3, 4)
DIMENSION = 12
EPOCHS = 12
RATE = 0.3
#: Labelled rows of each label that training sees; the only bound, scoring and label shares have none.
SAMPLE_DOCS = 1500
CUT = 0.7


# ---------------------------------------------------------------- features

def _gram_buckets(raw: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte; the last order-1 places are not n-grams."""
    h = raw[:len(raw) - order + 1].astype(np.uint32)
    for j in range(1, order):
        h = h * np.uint32(0x01000193) + raw[j:len(raw) - order + 1 + j]
    h ^= h >> np.uint32(15)
    h = h * np.uint32(0x9E3779B1) + np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def n_buckets(bits: int) -> int:
    return (len(ORDERS) + 2) << bits


def feature_blocks(raw: np.ndarray, starts: np.ndarray, bits: int = BUCKET_BITS):
    """(bucket ids, document of each) per feature kind: words, word pairs, n-grams of letters; each kind in its own range of buckets."""
    n = len(starts) - 1
    begin, end, first = word_bounds(raw, starts)
    prints, word_owner = byte_hashes(raw, begin, end), np.repeat(np.arange(n), np.diff(first))
    bucket = lambda h: (h >> np.uint64(64 - bits)).astype(np.int64)
    yield bucket(prints), word_owner
    inside = word_owner[1:] == word_owner[:-1]
    yield bucket(join_hashes(prints[:-1], prints[1:]))[inside] + ((len(ORDERS) + 1) << bits), word_owner[1:][inside]
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))
    for kind, order in enumerate(ORDERS, 1):
        if len(raw) < order:
            continue
        inside = owner[:len(raw) - order + 1] == owner[order - 1:]
        yield _gram_buckets(raw, order, bits)[inside] + (kind << bits), owner[:len(raw) - order + 1][inside]


def score_texts(raw: np.ndarray, starts: np.ndarray, weights: np.ndarray, bias: float, bits: int = BUCKET_BITS) -> np.ndarray:
    n = len(starts) - 1
    total, count = np.zeros(n), np.zeros(n)
    for buckets, owner in feature_blocks(raw, starts, bits):
        total += np.bincount(owner, weights[buckets], n)
        count += np.bincount(owner, minlength=n)
    logit = np.clip(total / np.maximum(count, 1) + bias, -50, 50)
    return 1 / (1 + np.exp(-logit))


# ---------------------------------------------------------------- training

def train(texts: list[bytes], labels: np.ndarray, bits: int = BUCKET_BITS, dimension: int = DIMENSION, epochs: int = EPOCHS,
          rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weight per bucket, bias) of the logit of label 1, for equal shares of the labels."""
    rng = np.random.default_rng(seed)
    docs = []
    for text in texts:
        raw = np.frombuffer(text, np.uint8)
        ids = np.concatenate([b for b, _ in feature_blocks(raw, np.array([0, len(raw)]), bits)] or [np.zeros(0, np.int64)])
        at, counts = np.unique(ids, return_counts=True)
        docs.append((at.astype(np.int32), (counts / max(counts.sum(), 1)).astype(np.float32)))
    size = n_buckets(bits)
    vectors = rng.normal(0, 0.1, (size, dimension)).astype(np.float32)
    squares = np.full(size, 1e-6, np.float32)
    output = rng.normal(0, 0.5, (dimension, 2)).astype(np.float32)
    shift = np.zeros(2, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(docs)):
            at, share = docs[i]
            if not len(at):
                continue
            mean = share @ vectors[at]
            z = mean @ output + shift
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i])] -= 1  # gradient of the softmax loss
            back = output @ p
            output -= 0.5 * step * np.outer(mean, p)
            shift -= 0.05 * step * p
            gradient = share * float(np.linalg.norm(back))
            squares[at] += gradient * gradient
            # step sizes follow each vector's own gradients, so rare n-grams learn too
            vectors[at] -= (step * share / np.sqrt(squares[at]))[:, None] * back
    difference = output[:, 1] - output[:, 0]
    return (vectors @ difference).astype(np.float32), float(shift[1] - shift[0])


def is_held_out(key: str) -> Column:
    """Rows whose crc32 of the key as text leaves 2 modulo 4; null keys are not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, float]:
    """(weights, bias) learned from the labelled rows that are not held out.

    The sample is the rows of least key hash of each label.  Rows without a key
    or label take no part; of repeated keys the highest label counts.  Without
    rows of both labels the weights are 0 and the bias gives the share of label
    1 (1.0 where nothing is labelled).
    """
    spark = docs.sparkSession
    known = (labels.select(F.col(key).cast("bigint").alias("key"), F.col(label).cast("int").alias("label")).filter("key IS NOT NULL AND label IN (0, 1)")
             .filter(~is_held_out("key")).groupBy("key").agg(F.max("label").alias("label")))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = n_buckets(BUCKET_BITS)
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1) if counts else 1 - 1e-6
    prior = math.log(share / (1 - share))
    if len(counts) < 2:
        return np.zeros(size, np.float32), prior
    parts = [known.filter(F.col("label") == v).orderBy(F.xxhash64("key"), "key").limit(sample_docs) for v in (0, 1)]
    some = saved(parts[0].unionByName(parts[1]), "quality-sample")
    small_batches(spark)
    texts = docs.select(F.col(key).cast("bigint").alias("key"), whole_text(text).alias("text"))
    # at most 2 * sample_docs rows of two numbers
    rows = texts.join(F.broadcast(some), "key").groupBy("key").agg(F.max("label").alias("label"), F.max("text").alias("text"))

    def learn(table):
        import pyarrow as pa

        claim_worker("quality")
        table = table.sort_by("key")
        weights, bias = train([t.as_py().encode() for t in table.column("text")], table.column("label").to_numpy())
        return pa.table({"weights": [weights.tobytes()], "bias": [bias]}, pa.schema([("weights", pa.binary()), ("bias", pa.float64())]))

    model = rows.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(learn, "weights binary, bias double").collect()
    if not model:
        return np.zeros(size, np.float32), prior
    return np.frombuffer(model[0]["weights"], np.float32), model[0]["bias"] + prior


def scorer(model: tuple[np.ndarray, float]):
    """Column function from text to score."""
    weights, bias = model

    @F.arrow_udf(DoubleType())
    def score(texts):
        import pyarrow as pa

        claim_worker("quality")
        raw, starts = text_bytes(texts)
        out = [score_texts(raw[starts[a]:starts[b]], starts[a:b + 1] - starts[a], weights, bias) for a, b in byte_chunks(starts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", cut: float = CUT) -> DataFrame:
    """key, held_out, score, predicted of every document.

    Null texts score as empty ones: the share of label 1.  Repeated rows and null
    keys each give their row; an empty table gives none.
    """
    score = scorer(fit(docs, labels, key, text, label))
    rows = docs.select(F.col(key).alias("key"), is_held_out(key).alias("held_out"), score(whole_text(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", cut: float = CUT) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    score = scorer(fit(docs, labels, key, text, label))
    name = free_name(docs, "__score")
    return docs.withColumn(name, score(whole_text(text))).filter(F.col(name) >= cut).drop(name)
