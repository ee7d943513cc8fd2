"""Removal of repeated word windows by recompression.

A text is a sequence of word fingerprints.  Rounds shorten it: the first names
runs of one word, each further one splits the symbols into two sides by a hash
bit and names every adjacent pair (left side, right side).  A name is the
fingerprint of what it stands for, so all tasks give equal runs and pairs equal
names without a shared dictionary.  A symbol depends on the words that decided
it; those are tracked exactly, so wherever a window of words recurs, the symbols
decided inside it recur too.

So a window can only recur if every symbol decided inside it does.  High-level
symbols, a fraction of the words, are counted first; the windows that no unique
symbol rules out send fingerprints of all their words, and equal fingerprints
(128 bits, inside a batch and between batches) are the repeats.  Windows without any symbol of their own are sent as
they are.

Texts travel in compressed batches.  A batch sends each fingerprint once,
however often it holds it, so a passage in a third of all documents costs one
entry per batch; buckets of fingerprints are sized by the number of words.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.shared import SEEDS, byte_chunks, byte_hashes, join_hashes, mix, saved, small_batches, text_bytes, whole_text, window_hashes, word_bounds

WINDOW = 35
ROUNDS = 6
BATCH_BYTES = 1 << 20
BUCKET_WORDS = 1 << 20


# ---------------------------------------------------------------- recompression of one batch

def _pair_name(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return join_hashes(left, right, SEEDS[1])


def recompress(words: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, lo, hi) of the symbols after all rounds; words lo to hi decided the symbol.

    ``first`` has the first word of each text and the end.  Reaching past a
    text's edge counts as depending on a word outside it.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    # runs of one word; each depends on the word before and the word after it
    opens = np.ones(n, bool)
    opens[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(opens)
    end = np.append(start[1:], n)
    name = np.where(end - start > 1, _pair_name(words[start], (end - start).astype(np.uint64)), words[start])
    lo, hi, owner = start - 1, end + 1, owner[start]
    for level in range(rounds):
        bit = mix(name + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) & np.uint64(1) == 0
        near = owner[1:] == owner[:-1]
        joins = np.zeros(len(name), bool)
        joins[:-1] = bit[:-1] & ~bit[1:] & near  # left side followed by right side
        after = np.zeros(len(name), bool)
        after[1:] = joins[:-1]
        alone = ~joins & ~after
        # an unpaired left symbol depends on the next one, an unpaired right symbol on the one before
        next_hi = np.append(hi[1:], 0)
        next_hi = np.where(np.append(near, False), next_hi, hi + 1)
        last_lo = np.insert(lo[:-1], 0, 0)
        last_lo = np.where(np.insert(near, 0, False), last_lo, lo - 1)
        new_hi = np.where(alone & bit, np.maximum(hi, next_hi), hi)
        new_lo = np.where(alone & ~bit, np.minimum(lo, last_lo), lo)
        at = np.flatnonzero(joins)
        new_lo[at] = np.minimum(lo[at], lo[at + 1])
        new_hi[at] = np.maximum(hi[at], hi[at + 1])
        new_name = name.copy()
        new_name[at] = _pair_name(name[at], name[at + 1])
        keep = ~after
        name, lo, hi, owner = new_name[keep], new_lo[keep], new_hi[keep], owner[keep]
    return name, lo, hi


class _Batch:
    """Words of a batch of texts: fingerprints, symbols and windows."""

    def __init__(self, raw: bytes, starts: np.ndarray, window: int):
        self.raw, self.starts, self.window = raw, starts, window
        data = np.frombuffer(raw, np.uint8)
        self.begin, self.end, self.first = word_bounds(data, starts)
        self.data = data
        self.words = byte_hashes(data, self.begin, self.end)

    def symbols(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols that some window holds with all that decided them."""
        name, lo, hi = recompress(self.words, self.first)
        fits = hi - lo <= self.window
        return name[fits], lo[fits], hi[fits]

    def places(self) -> np.ndarray:
        """Start words of all windows."""
        sizes = np.diff(self.first)
        ok = np.zeros(len(self.words) + 1, np.int64)
        long_ = sizes >= self.window
        np.add.at(ok, self.first[:-1][long_], 1)
        np.add.at(ok, self.first[1:][long_] - self.window + 1, -1)
        return np.flatnonzero(np.cumsum(ok)[:-1] > 0)

    def prints(self, at: np.ndarray) -> np.ndarray:
        """128 bits for each window: two columns, from two independent fingerprints of every word."""
        others = byte_hashes(self.data, self.begin, self.end, SEEDS[1])
        return np.stack([window_hashes(self.words, at, self.window, SEEDS[1]), window_hashes(others, at, self.window, SEEDS[0])], 1)


def _sorted_pairs(prints: np.ndarray) -> np.ndarray:
    """Order of the rows by both columns; only rows with equal first halves need the second."""
    order = np.argsort(prints[:, 0], kind="stable")
    ranked = prints[order]
    same = ranked[1:, 0] == ranked[:-1, 0]
    return np.lexsort((prints[:, 1], prints[:, 0])) if (same & (ranked[1:, 1] != ranked[:-1, 1])).any() else order


def _recurring(prints: np.ndarray) -> np.ndarray:
    """Which rows equal another one in both columns."""
    order = _sorted_pairs(prints)
    same = (prints[order][1:] == prints[order][:-1]).all(1)
    twice = np.zeros(len(prints), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def _distinct(prints: np.ndarray) -> np.ndarray:
    """The distinct rows, sorted."""
    ranked = prints[_sorted_pairs(prints)]
    new = np.ones(len(ranked), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(1)
    return ranked[new]


def _found(prints: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which rows are among the wanted ones."""
    wanted = _distinct(wanted)
    hit = _member(prints[:, 0], wanted[:, 0])
    some = np.flatnonzero(hit)
    at = np.searchsorted(wanted[:, 0], prints[some, 0])
    right = wanted[at, 1] == prints[some, 1]
    for step in range(1, len(wanted)):  # wanted rows with equal first halves stand together
        open_ = np.flatnonzero(~right & (at + step < len(wanted)))
        open_ = open_[wanted[at[open_] + step, 0] == prints[some[open_], 0]]
        if not len(open_):
            break
        right[open_] = wanted[at[open_] + step, 1] == prints[some[open_], 1]
    hit[some] = right
    return hit


def _member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def candidate_windows(batch: _Batch, repeated: np.ndarray) -> np.ndarray:
    """Start words of windows that hold no unique symbol; ``repeated`` has the names known from other batches."""
    name, lo, hi = batch.symbols()
    here, counts = np.unique(name, return_counts=True)
    unique = ~(_member(name, repeated) | _member(name, here[counts > 1]))
    out = np.zeros(len(batch.words) + 2, np.int64)
    np.add.at(out, np.maximum(hi[unique] - batch.window, 0), 1)
    np.add.at(out, np.maximum(lo[unique] + 1, 0), -1)
    at = batch.places()
    return at[np.cumsum(out)[at] == 0]


# ---------------------------------------------------------------- Spark stages

def _unpack(row: dict, window: int) -> _Batch:
    import zstandard

    return _Batch(zstandard.ZstdDecompressor().decompress(row["blob"]) if row["size"] else b"", np.frombuffer(row["starts"], np.int64), window)


def _packed(docs: DataFrame, key: str, text: str, batch_bytes: int) -> DataFrame:
    """Batches of texts: batch, n_words, size, keys, nulls, starts, blob."""
    def pack(batches):
        import pyarrow as pa
        import zstandard

        number, press = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3)
        for batch in batches:
            raw, starts = text_bytes(batch.column(1))
            keys = batch.column(0)
            nulls, ids = keys.is_null().to_numpy(zero_copy_only=False), keys.fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in byte_chunks(starts, batch_bytes):
                part, edges = raw[starts[a]:starts[b]], starts[a:b + 1] - starts[a]
                n = len(word_bounds(part, edges)[0])
                blob = press.compress(part.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in (
                    (number, pa.int64()), (n, pa.int64()), (len(part), pa.int64()), (ids[a:b].tobytes(), pa.binary()),
                    (nulls[a:b].tobytes(), pa.binary()), (edges.tobytes(), pa.binary()), (blob, pa.binary()))],
                    ["batch", "n_words", "size", "keys", "nulls", "starts", "blob"])
                number += 1

    rows = docs.select(F.col(key).cast("bigint").alias("key"), whole_text(text).alias("text"))
    return rows.mapInArrow(pack, "batch bigint, n_words bigint, size bigint, keys binary, nulls binary, starts binary, blob binary")


def _by_bucket(prints: np.ndarray, bits: int):
    """(bucket, first, last) ranges of sorted fingerprints."""
    bucket = (prints >> np.uint64(64 - bits)).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield int(bucket[a]), a, b


def _send(rows: list[tuple], names: list[str]):
    import pyarrow as pa

    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * (len(names) - 2)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)


def _repeated(table, names: list[str]):
    """Per batch, the fingerprints of a bucket that at least two batches sent; all the columns of a fingerprint count."""
    import pyarrow as pa

    batches = table.column("batch").to_pylist()
    columns = [[np.frombuffer(x, np.uint64) for x in table.column(name).to_pylist()] for name in names]
    sizes = [len(x) for x in columns[0]]
    values = np.stack([np.concatenate(x) if x else np.zeros(0, np.uint64) for x in columns], 1)
    twice = _recurring(values if len(names) > 1 else np.repeat(values, 2, 1))
    out, at = [], 0
    for batch, n in zip(batches, sizes, strict=True):
        hit = values[at:at + n][twice[at:at + n]]
        if len(hit):
            out.append((batch, hit.tobytes()))
        at += n
    return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["batch", "hits"])


def _hits(table, width: int = 1) -> np.ndarray:
    found = [np.frombuffer(x, np.uint64).reshape(-1, width) for x in table.column("hits").to_pylist()]
    return np.concatenate(found) if found else np.zeros((0, width), np.uint64)


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES,
                   bucket_words: int = BUCKET_WORDS, keep_text: bool = False) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 (and kept_text) of every document.

    A word goes if a window of ``window`` words covers it whose word sequence
    also starts anywhere else, in any document.  Windows are judged on the input.
    Null and empty texts have no words; the digest is that of the empty string.
    Rows that repeat a text are other places, so both lose their windows.  Null
    keys give rows with a null key; an empty table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    packed = saved(_packed(docs, key, text, batch_bytes), "repeats-batches")
    words = packed.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    bits = max(5, int(np.ceil(np.log2(max(1, words / bucket_words)))))
    small_batches(spark, 16)

    def name_symbols(batches):
        for table in batches:
            for row in table.to_pylist():
                names = np.unique(_unpack(row, window).symbols()[0])
                rows = [(bucket, row["batch"], names[a:b].tobytes()) for bucket, a, b in _by_bucket(names, bits)]
                if rows:
                    yield _send(rows, ["bucket", "batch", "one"])

    def send_windows(left, right):
        import pyarrow as pa

        repeated, rows = np.sort(_hits(right)[:, 0]), []
        for row in left.to_pylist():
            batch = _unpack(row, window)
            at = candidate_windows(batch, repeated)
            prints = _distinct(batch.prints(at))
            one, two = np.ascontiguousarray(prints[:, 0]), np.ascontiguousarray(prints[:, 1])
            rows += [(bucket, row["batch"], one[a:b].tobytes(), two[a:b].tobytes()) for bucket, a, b in _by_bucket(one, bits)]
        return pa.Table.from_batches([_send(rows, ["bucket", "batch", "one", "two"])])

    def finish(left, right):
        import pyarrow as pa

        repeated, out = _hits(right, 2), {"key": [], "n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
        for row in left.to_pylist():
            batch = _unpack(row, window)
            at = batch.places()
            prints = batch.prints(at)
            again = at[_recurring(prints) | _found(prints, repeated)]
            cover = np.zeros(len(batch.words) + 1, np.int64)
            np.add.at(cover, again, 1)
            np.add.at(cover, again + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            keys, nulls = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["nulls"], bool)
            for d in range(len(keys)):
                a, b = int(batch.first[d]), int(batch.first[d + 1])
                tokens = batch.raw[batch.starts[d]:batch.starts[d + 1]].split()
                removed = int(total[b] - total[a])
                if removed:
                    tokens = list(itertools.compress(tokens, (~gone[a:b]).tolist()))
                kept = b" ".join(tokens)
                for name, value in zip(out, (None if nulls[d] else int(keys[d]), b - a, removed, hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None), strict=True):
                    out[name].append(value)
        return pa.table(out, pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]))

    def symbol_repeats(table):
        return _repeated(table, ["one"])

    def window_repeats(table):
        return _repeated(table, ["one", "two"])

    by_batch = packed.groupBy("batch")
    names = packed.mapInArrow(name_symbols, "bucket int, batch bigint, one binary").groupBy("bucket").applyInArrow(symbol_repeats, "batch bigint, hits binary")
    windows = by_batch.cogroup(names.groupBy("batch")).applyInArrow(send_windows, "bucket int, batch bigint, one binary, two binary")
    repeats = windows.groupBy("bucket").applyInArrow(window_repeats, "batch bigint, hits binary")
    done = packed.groupBy("batch").cogroup(repeats.groupBy("batch")).applyInArrow(
        finish, "key bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
    return done if keep_text else done.drop("kept_text")
