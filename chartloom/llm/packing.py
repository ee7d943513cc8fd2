"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents become pieces of at most ``capacity`` tokens.  Pieces are dealt to
islands of bounded size by hash.  On an island an individual is a set of bins;
crossover puts whole well-filled bins of one parent into the other, removes the
bins that held the same pieces, and puts the displaced pieces back by best fit.
After each round the elite bins (filled to ``elite``) are final; the pieces of
all other bins migrate to new islands, so what one island could not fill is
filled with pieces of others.  The last round keeps all its bins.

An island is one group of about ``island_pieces`` rows of a few numbers; texts
and ids never leave their tasks.
"""

from __future__ import annotations

import random
import struct
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.encoding import CHUNK_BYTES, encoder
from chartloom.llm.shared import byte_chunks, saved, small_batches, text_bytes, whole_text

PIECE_SCHEMA = "key bigint, piece int, start bigint, length bigint, ids_crc32 bigint, salt bigint"


# ---------------------------------------------------------------- one island

class _Bins:
    """Bins of one individual, with a bit per remaining capacity for best fit."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.by_room, self.rooms = capacity, {}, {}, 0
        self.next = 0

    def add(self, items: list[int], room: int) -> None:
        name = self.next
        self.next += 1
        self.bins[name] = (items, room)
        self._open(name, room)

    def _open(self, name: int, room: int) -> None:
        if room:
            self.by_room.setdefault(room, []).append(name)
            self.rooms |= 1 << room

    def put(self, item: int, length: int) -> None:
        """Into the bin with the least room that holds it, or into a new one."""
        fits = self.rooms >> length
        if not fits:
            self.add([item], self.capacity - length)
            return
        room = length + (fits & -fits).bit_length() - 1
        names = self.by_room[room]
        name = names.pop()
        if not names:
            self.rooms &= ~(1 << room)
        items, _ = self.bins[name]
        items.append(item)
        self.bins[name] = (items, room - length)
        self._open(name, room - length)


def _best_fit(order: list[int], lengths: list[int], capacity: int, kept: list[tuple[list[int], int]] = ()) -> list[tuple[list[int], int]]:
    bins = _Bins(capacity)
    for items, room in kept:
        bins.add(list(items), room)
    for i in order:
        bins.put(i, lengths[i])
    return list(bins.bins.values())


def _fitness(bins: list[tuple[list[int], int]], capacity: int) -> tuple[int, float]:
    """Fewer bins, then more uneven filling."""
    return -len(bins), sum(((capacity - room) / capacity) ** 2 for _, room in bins)


def _cross(one: list, other: list, lengths: list[int], capacity: int, rng: random.Random) -> list:
    """Well-filled bins of ``other`` go into ``one`` whole; displaced pieces are best-fitted."""
    full = sorted(other, key=lambda b: b[1])
    inject = rng.sample(full[:max(1, len(full) // 2)], max(1, len(full) // 4))
    taken = {i for items, _ in inject for i in items}
    kept, displaced = [], []
    weakest = max((room for _, room in one), default=0)
    for items, room in one:
        if any(i in taken for i in items):
            displaced += [i for i in items if i not in taken]
        elif room and room >= weakest * 0.5 and rng.random() < 0.5:  # mutation: weak bins are emptied
            displaced += items
        else:
            kept.append((items, room))
    displaced.sort(key=lambda i: -lengths[i])
    return _best_fit(displaced, lengths, capacity, kept + inject)


def pack_island(lengths: list[int], capacity: int, seed: int = 0, population: int = 4, generations: int = 6) -> list[list[int]]:
    """Bins (lists of positions in ``lengths``) of one island; stops when no packing can be smaller."""
    if not lengths:
        return []
    rng = random.Random(seed)
    least = -(-sum(lengths) // capacity)
    pool = []
    for k in range(population):
        noise = 0.0 if k == 0 else 0.15
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i] * (1 + noise * rng.random()))
        bins = _best_fit(order, lengths, capacity)
        pool.append((_fitness(bins, capacity), bins))
        if len(bins) == least:
            return [items for items, _ in bins]
    for _ in range(generations):
        pool.sort(key=lambda p: p[0], reverse=True)
        for a, b in ((0, 1), (1, 0)) if population > 1 else ((0, 0),):
            child = _cross(pool[a][1], pool[b][1], lengths, capacity, rng)
            pool.append((_fitness(child, capacity), child))
        pool.sort(key=lambda p: p[0], reverse=True)
        del pool[population:]
        if len(pool[0][1]) == least:
            break
    return [items for items, _ in pool[0][1]]


# ---------------------------------------------------------------- documents to pieces

def pieces(docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents: key, piece, start, length, ids_crc32, salt.

    Ids are those of the whole text (null: empty) and the end id.  Only a document
    longer than ``capacity`` is cut: its last pieces are full and the first is
    what is left over.  A document without any id has no piece.
    """
    small_batches(docs.sparkSession)

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        code, end = encoder(tokenizer), b"" if end_id is None else struct.pack("<I", end_id)
        salt = TaskContext.get().partitionId() << 40
        schema = pa.schema([("key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("salt", pa.int64())])
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            keys, (raw, starts) = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for a, b in byte_chunks(starts, CHUNK_BYTES):
                tokens, edges = code.encode(raw[starts[a]:starts[b]], starts[a:b + 1] - starts[a])
                for i in range(a, b):
                    ids = tokens[edges[i - a]:edges[i - a + 1]].tobytes() + end
                    n, at, number = len(ids) // 4, 0, 0
                    while at < n:
                        length = (n % capacity or capacity) if at == 0 else capacity
                        for column, value in zip(out, (keys[i], number, at, length, zlib.crc32(ids[4 * at:4 * (at + length)]), salt), strict=True):
                            column.append(value)
                        at, number, salt = at + length, number + 1, salt + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    rows = docs.select(F.col(key).cast("bigint").alias("k"), whole_text(text).alias("t"))
    return rows.mapInArrow(cut, PIECE_SCHEMA)


# ---------------------------------------------------------------- islands

def _island_packer(names: list[str], capacity: int, number: int, last: bool, elite: float, population: int, generations: int):
    """The work of one island in round ``number``, for ``applyInPandas``."""
    def island(rows):
        rows = rows.sort_values(["length", "key", "piece", "salt"]).reset_index(drop=True)
        here, lengths = int(rows["island"].iloc[0]), rows["length"].tolist()
        bins = pack_island(lengths, capacity, seed=number * 1_000_003 + here, population=population, generations=generations)
        sequence, offset, final = [0] * len(lengths), [0] * len(lengths), [True] * len(lengths)
        for k, items in enumerate(bins):
            at, keep = 0, last or sum(lengths[i] for i in items) >= elite * capacity
            for i in items:
                sequence[i], offset[i], final[i] = (number << 58) + (here << 20) + k, at, keep
                at += lengths[i]
        return rows[names].assign(sequence_id=sequence, offset=offset, final=final)

    return island


def pack(table: DataFrame, capacity: int = 2048, island_pieces: int = 4096, rounds: int = 3, elite: float = 0.995,
         population: int = 4, generations: int = 6) -> DataFrame:
    """Sequence and offset of each piece of a written table of pieces: its columns, sequence_id, offset."""
    names = ["key", "piece", "start", "length", "ids_crc32", "salt"]
    done, left = [], table
    for number in range(rounds):
        islands = max(1, -(-left.count() // island_pieces))

        dealt = left.select(*names, F.pmod(F.xxhash64(F.lit(number), "salt", "key"), F.lit(islands)).alias("island"))
        packed = saved(dealt.groupBy("island").applyInPandas(
            _island_packer(names, capacity, number, number == rounds - 1, elite, population, generations), PIECE_SCHEMA + ", sequence_id bigint, offset bigint, final boolean"), "pack-round")
        done.append(packed.filter("final"))
        left = packed.filter("NOT final")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("final", "salt")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens: one row per piece.

    Columns: key, piece, start, length, ids_crc32, sequence_id, offset.  Null
    texts are empty; with an end id they are pieces of one token.  Repeated rows
    and null keys are packed like any other row.  An empty table gives no rows.
    """
    return pack(saved(pieces(docs, tokenizer, end_id, capacity, key, text), "pack-pieces"), capacity)
