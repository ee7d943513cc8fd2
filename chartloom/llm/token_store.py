"""Token ids in shards with a minimal perfect hash index.

``write_store`` encodes documents and writes shards in ascending key order;
``read_store`` reads every document back; ``fetch`` gets some by key.

A shard is one row of a Parquet table: ``part`` and ``shard`` (together in key
order), ``n_docs``, ``n_tokens``, ``first_key``, ``last_key``, ``payload`` and
``index``.  The payload holds one record per document: key (int64), flag (uint8,
1 for a null key), id count (uint32), ids (uint16 where the vocabulary has at
most 65,536 entries, else uint32), all little-endian.  The index is a minimal
perfect hash of the shard's keys: levels of bit sets in which each key alone in
its place is settled and the others go to the next level; the rank of a key's
bit is its slot, and the slot holds a 32-bit fingerprint and the byte offset of
the record.  A look-up reads a constant number of places whatever the shard's
size, and a key that is not there is refused by its fingerprint.

Memory: one shard (``shard_bytes``, one document at least) and one Arrow batch.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.llm.encoding import CHUNK_BYTES, encoder
from chartloom.llm.shared import byte_chunks, mix, small_batches, text_bytes, whole_text

STORE_SCHEMA = ("part int, shard int, n_docs bigint, n_tokens bigint, first_key bigint, last_key bigint, "
                "payload binary, index binary")
_HEAD = struct.Struct("<qBI")
_GAMMA = 2


# ---------------------------------------------------------------- minimal perfect hash

def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))
    return (mix(keys ^ seed) % np.uint64(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def build_index(keys: np.ndarray, offsets: np.ndarray) -> bytes:
    """Index of distinct int64 keys."""
    keys = keys.astype(np.int64).view(np.uint64)
    left, where, levels, order = keys, np.arange(len(keys)), [], []
    while len(left):
        size = max(64, _GAMMA * len(left))
        at = _place(left, len(levels), size)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, bool)
        bits[at[alone]] = True
        order.append(where[alone][np.argsort(at[alone])])
        levels.append(np.packbits(bits, bitorder="little").tobytes())
        left, where = left[~alone], where[~alone]
        levels[-1] = struct.pack("<I", size) + levels[-1]
    slots = np.concatenate(order) if order else np.zeros(0, np.int64)
    return (struct.pack("<II", len(keys), len(levels)) + b"".join(levels)
            + fingerprints(keys[slots]).astype("<u4").tobytes() + offsets[slots].astype("<u8").tobytes())


class Index:
    """Record offsets by key."""

    def __init__(self, raw: bytes):
        self.n, count = struct.unpack_from("<II", raw)
        at, self.levels, base = 8, [], 0
        for _ in range(count):
            (size,) = struct.unpack_from("<I", raw, at)
            n_bytes = (size + 7) // 8
            bits = np.unpackbits(np.frombuffer(raw, np.uint8, n_bytes, at + 4), bitorder="little")[:size]
            rank = base + np.cumsum(bits) - bits
            self.levels.append((size, bits.astype(bool), rank))
            base += int(bits.sum())
            at += 4 + n_bytes
        self.marks = np.frombuffer(raw, "<u4", self.n, at)
        self.offsets = np.frombuffer(raw, "<u8", self.n, at + 4 * self.n).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Byte offset of each key's record, -1 where the key is not there."""
        keys = np.asarray(keys, np.int64).view(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (size, bits, rank) in enumerate(self.levels):
            at = _place(keys[open_], level, size)
            hit = bits[at]
            slot, who = rank[at[hit]], open_[hit]
            right = self.marks[slot] == fingerprints(keys[who])
            out[who[right]] = self.offsets[slot[right]]
            open_ = open_[~hit]
        return out


# ---------------------------------------------------------------- writing

def _shard(records: list[tuple[int | None, bytes]], wide: bool, part: int, shard: int) -> dict:
    payload, keys, offsets, at, tokens = [], [], [], 0, 0
    for key, ids in records:
        n = len(ids) // 4
        body = ids if wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        if key is not None and (not keys or keys[-1] != key):  # of equal keys, the first record is indexed
            keys.append(key)
            offsets.append(at)
        payload += [_HEAD.pack(0 if key is None else key, key is None, n), body]
        at += _HEAD.size + len(body)
        tokens += n
    return {"part": part, "shard": shard, "n_docs": len(records), "n_tokens": tokens,
            "first_key": keys[0] if keys else None, "last_key": keys[-1] if keys else None, "payload": b"".join(payload),
            "index": build_index(np.array(keys, np.int64), np.array(offsets, np.int64))}


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, key: str = "doc_id",
                text: str = "text", shard_bytes: int = 4 << 20, partitions: int | None = None) -> None:
    """Encode whole texts and write the shards to ``path``.

    Null texts are empty.  Null keys come first and are read back by
    ``read_store`` only.  Equal keys are all kept, in the order of their texts;
    ``fetch`` returns the first of them.  An empty table gives an empty store.
    One range exchange of the texts; everything after it stays in its task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        code, part, shard = encoder(tokenizer), TaskContext.get().partitionId(), 0
        wide, end = code.size > 1 << 16, b"" if end_id is None else struct.pack("<I", end_id)
        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
                            ("first_key", pa.int64()), ("last_key", pa.int64()), ("payload", pa.binary()), ("index", pa.binary())])
        records: list = []
        held = 0
        for batch in batches:
            keys, (raw, starts) = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for a, b in byte_chunks(starts, CHUNK_BYTES):
                ids, edges = code.encode(raw[starts[a]:starts[b]], starts[a:b + 1] - starts[a])
                for i in range(a, b):
                    own = ids[edges[i - a]:edges[i - a + 1]].tobytes() + end
                    records.append((keys[i], own))
                    held += len(own)
                    if held >= shard_bytes * (1 if wide else 2):
                        yield pa.RecordBatch.from_pylist([_shard(records, wide, part, shard)], schema)
                        records, held, shard = [], 0, shard + 1
        if records:
            yield pa.RecordBatch.from_pylist([_shard(records, wide, part, shard)], schema)

    rows = docs.select(F.col(key).cast("bigint").alias("k"), whole_text(text).alias("t"))
    (rows.repartitionByRange(n, "k").sortWithinPartitions("k", "t").mapInArrow(pack, STORE_SCHEMA)
     .write.option("compression", "lz4_raw").parquet(path))


# ---------------------------------------------------------------- reading

def _records(payload: bytes, n_docs: int, wide: bool) -> Iterator[tuple[int, int | None, int, int]]:
    """(offset, key, first byte of the ids, id count) of each record."""
    at, step = 0, 4 if wide else 2
    for _ in range(n_docs):
        key, null, n = _HEAD.unpack_from(payload, at)
        yield at, None if null else key, at + _HEAD.size, n
        at += _HEAD.size + step * n


def _ids(payload: bytes, at: int, n: int, wide: bool) -> np.ndarray:
    return np.frombuffer(payload, "<u4" if wide else "<u2", n, at).astype("<u4")


def is_wide(tokenizer: str) -> bool:
    return encoder(tokenizer).size > 1 << 16


def read_store(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Every document of a store: key, start (ids of all documents before it), n_tokens, ids_crc32.

    Each shard's index is asked for all its keys and must lead to their records.
    """
    def unpack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        wide = is_wide(tokenizer)
        for batch in batches:
            for row in batch.to_pylist():
                out: dict[str, list] = {"part": [], "shard": [], "key": [], "start": [], "n_tokens": [], "ids_crc32": []}
                start, seen, places = 0, [], []
                for at, key, first, n in _records(row["payload"], row["n_docs"], wide):
                    if key is not None and (not seen or seen[-1] != key):
                        seen.append(key)
                        places.append(at)
                    for name, value in zip(out, (row["part"], row["shard"], key, start, n,
                                                 zlib.crc32(_ids(row["payload"], first, n, wide).tobytes())), strict=True):
                        out[name].append(value)
                    start += n
                if (Index(row["index"]).find(np.array(seen, np.int64)) != np.array(places, np.int64)).any():
                    raise ValueError(f"index of shard {row['part']}/{row['shard']} does not lead to its records")
                yield pa.RecordBatch.from_pydict(out, pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("key", pa.int64()),
                                                                 ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))

    store = spark.read.schema(STORE_SCHEMA).parquet(path)
    # A few numbers per shard: first within a part, then over the parts.
    counts = store.select("part", "shard", "n_tokens")
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (counts.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
             .join(parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "part")
             .select("part", "shard", (F.col("before") + F.col("inside")).alias("base")))
    small_batches(spark, 8)
    rows = (store.select("part", "shard", "n_docs", "payload", "index")
            .mapInArrow(unpack, "part int, shard int, key bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))
    return (rows.join(bases, ["part", "shard"])
            .select("key", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32"))


def fetch(spark: SparkSession, path: str, tokenizer: str, keys: list[int]) -> DataFrame:
    """(key, ids) of a short list of keys, by the index; keys that are not there give no row.

    The key ranges of the shards are pushed to the scan, so only shards that may
    hold a key are read.
    """
    wanted = sorted(set(keys))

    def get(batches: Iterator) -> Iterator:
        import pyarrow as pa

        wide = is_wide(tokenizer)
        for batch in batches:
            out: dict[str, list] = {"key": [], "ids": []}
            for row in batch.to_pylist():
                inside = [k for k in wanted if row["first_key"] <= k <= row["last_key"]]
                for key, at in zip(inside, Index(row["index"]).find(np.array(inside, np.int64)).tolist(), strict=True):
                    if at >= 0:
                        _, stored, first, n = next(_records(row["payload"][at:], 1, wide))
                        if stored == key:
                            out["key"].append(key)
                            out["ids"].append(_ids(row["payload"], at + first, n, wide).tolist())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    may = F.lit(False)
    for key in wanted:
        may = may | ((F.col("first_key") <= key) & (F.col("last_key") >= key))
    small_batches(spark, 8)
    rows = (spark.read.schema(STORE_SCHEMA).parquet(path).filter(may)
            .select("first_key", "last_key", "payload", "index").mapInArrow(get, "key bigint, ids array<bigint>"))
    return rows.dropDuplicates(["key"])
