"""Shared folder for intermediate tables, and text helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the operators' word rule: a word is ``[^\x20\x09-\x0D]+``.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"

#: Rows of one Arrow batch sent to Python; with long texts a batch stays within tens of MB.
BATCH_ROWS = 500

_local_folder: dict[str, str] = {}

#: Tables that a Python worker keeps between tasks, and the operator that filled them.
WORKER_TABLES: list[dict] = []
_claims: list[str] = []


def claim_worker(operator: str) -> None:
    """Called by the tasks of an operator: a worker that served another one forgets its tables."""
    if _claims != [operator]:
        for table in WORKER_TABLES:
            table.clear()
        if _claims:
            release_memory()
        _claims[:] = [operator]


def release_memory() -> None:
    """Give memory that this worker holds but does not use back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        return


def free_name(docs: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the one named in ``spark.checkpoint.dir``.  Only a local-mode session
    without that setting gets a temporary folder; elsewhere the setting is
    required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder.setdefault("path", tempfile.mkdtemp(prefix="chartloom-llm-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    It cuts the lineage and outlives lost executors.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows that one Arrow batch carries to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


# ---------------------------------------------------------------- bytes of an Arrow text column

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, start offset of each text and the end) of an Arrow string array."""
    import pyarrow as pa

    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), starts - starts[0]
    raw = np.frombuffer(data, np.uint8)[starts[0]:starts[-1]]
    return raw, starts - starts[0]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def word_bounds(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text) of all words; words never cross texts."""
    return range_bounds(raw, starts, ~_IS_SPACE)


def range_bounds(raw: np.ndarray, starts: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first range of each text) of all runs of wanted bytes; ``wanted`` has 256 flags."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    inside = wanted[raw]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edge = starts[:-1][starts[:-1] < len(raw)]
    opens[edge] = inside[edge]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = starts[1:][starts[1:] > 0] - 1
    closes[last] = inside[last]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return begin, end, np.searchsorted(begin, starts)


#: Odd starting values of the two fingerprints.
SEEDS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Places in a word that have a table of values; later ones are calculated.
_PLACES = 64
_place_values: dict[int, np.ndarray] = {}


def _values(cells: np.ndarray, seed: int) -> np.ndarray:
    return mix(cells.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def byte_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = SEEDS[0]) -> np.ndarray:
    """64-bit fingerprint of raw[begin:end] for ranges in order that do not overlap.

    Every (place in the range, byte) has a pseudo-random value of its own, and a
    range is the mixed sum of its values and its length.
    """
    if not len(begin):
        return np.zeros(0, np.uint64)
    table = _place_values.get(seed)
    if table is None:
        table = _place_values[seed] = _values(np.arange(_PLACES * 256), seed)
    length = end - begin
    after = np.cumsum(length)
    first = after - length
    narrow = np.int32 if len(raw) < 1 << 22 else np.int64  # cells fit
    at = np.arange(after[-1], dtype=narrow)
    place = at - np.repeat(first.astype(narrow), length)
    signs = raw[at + np.repeat((begin - first).astype(narrow), length)] if after[-1] != end[-1] - begin[0] else raw[begin[0]:end[-1]]
    cells = (place << 8) + signs
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        far_values = _values(cells[far], seed)
        cells[far] = 0
    values = table[cells]
    if len(far):
        values[far] = far_values
    total = np.add.reduceat(values, first) if (length > 0).all() else np.diff(np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])[np.concatenate([[0], after])])
    return mix(total + length.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def join_hashes(left: np.ndarray, right: np.ndarray, seed: int = SEEDS[0]) -> np.ndarray:
    """Fingerprint of two parts in their order; both are mixed, so it is no sum of theirs."""
    return mix(mix(left + np.uint64(seed)) + right)


def window_hashes(values: np.ndarray, at: np.ndarray, window: int, seed: int = SEEDS[0]) -> np.ndarray:
    """Fingerprint of values[i:i + window] for each i of ``at``, from fingerprints of powers of two."""
    level, size, rest, out, place = values, 1, window, None, at + window
    while rest:
        if rest & 1:
            place = place - size
            part = level[place]
            out = part if out is None else join_hashes(part, out, seed)
        rest >>= 1
        if rest:
            level = join_hashes(level[:-size], level[size:], seed) if len(level) > size else level[:0]
            size *= 2
    return mix(out + np.uint64(window)) if out is not None else np.zeros(len(at), np.uint64)


def same_bytes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, other: np.ndarray) -> bool:
    """Whether every range raw[begin:end] holds the bytes of the range that starts at ``other`` and is as long."""
    some = np.flatnonzero(begin != other)
    begin, end, other = begin[some], end[some], other[some]
    narrow = np.int32 if len(raw) < 1 << 31 else np.int64
    length = end - begin
    place = np.arange(length.sum(), dtype=narrow) + np.repeat((begin - np.cumsum(length) + length).astype(narrow), length)
    return bool((raw[place] == raw[place + np.repeat((other - begin).astype(narrow), length)]).all())


def distinct_ranges(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the kind of each range, a place of each kind); kinds are equal bytes.

    Fingerprints group the ranges, and the bytes of every range are compared
    with those of its kind.
    """
    prints = byte_hashes(raw, begin, end)
    order = np.argsort(prints)
    ranked = prints[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    kind = np.empty(len(prints), np.int64)
    kind[order] = np.cumsum(new) - 1
    where = order[new]
    model = where[kind]
    if (end[model] - begin[model] == end - begin).all() and same_bytes(raw, begin, end, begin[model]):
        return kind, where
    # two different ranges share a fingerprint: by their bytes, one by one
    known: dict[bytes, int] = {}
    kind = np.array([known.setdefault(raw[a:b].tobytes(), len(known)) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], np.int64)
    return kind, np.unique(kind, return_index=True)[1]


def byte_chunks(starts: np.ndarray, limit: int = 2 << 20) -> list[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes each; a longer text is a range of its own."""
    out, n, first = [], len(starts) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + limit, "right")) - 1)
        out.append((first, min(last, n)))
        first = out[-1][1]
    return out


def sorted_groups(batches, names: list[str]):
    """Tables of equal values of ``names`` from Arrow batches that are sorted by them.

    Memory: one batch and one group.
    """
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        changed = np.zeros(table.num_rows, bool)
        for name in names:
            values = table.column(name).to_numpy()
            changed[1:] |= values[1:] != values[:-1]
        edges = [0, *np.flatnonzero(changed).tolist()]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield table.slice(a, b - a)
        held = table.slice(edges[-1])
    if held is not None:
        yield held
