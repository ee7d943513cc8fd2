"""Chat formatting by columnar byte assembly.

A conversation becomes one string: every turn has a head, its text and a tail by
role.  Control strings inside texts and role names are escaped by a backslash
behind their first sign, one more than they have there, so each text comes back
as it was.  A task assembles many conversations at once: segment lengths give
cumulative offsets, those give scatter indices, and heads, texts, backslashes
and tails go into one preallocated buffer, which becomes the Arrow column.

Rows are dealt by ranges of (conversation, turn, role, text hash), so a
conversation of any length is spread over tasks; its string comes in pages of
whole turns.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.shared import byte_chunks, small_batches, text_bytes, whole_text

#: Head and tail by role; any other role stands between ROLE and TEXT.
TEMPLATE = {"system": ("[SYS]", "[/SYS]\n"), "user": ("[INST] ", " [/INST]\n"), "assistant": ("<s>", "</s>\n")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]\n")
LEARNED = "assistant"

_STRING = r"{}/?s>|{}/?(?:SYS|INST|ROLE|TEXT)\]"
CONTROL = re.compile("(" + _STRING.format("<", r"\[") + ")")
#: What is escaped: control strings with any number of backslashes behind the first sign.
_OPEN = re.compile(_STRING.format(r"<\\*", r"\[\\*").encode())
_ESCAPED = re.compile(_STRING.format(r"<\\+", r"\[\\+"))

#: Bytes of texts that are assembled together, and of a conversation that waits for its end before a page is written.
CHUNK_BYTES = 2 << 20
PAGE_BYTES = 32 << 20

PAGES = "key bigint, page bigint, whole boolean, n_turns bigint, formatted string, loss_start array<bigint>, loss_end array<bigint>"


def escape(text: str) -> str:
    raw = text.encode()
    return _OPEN.sub(lambda m: m[0][:1] + b"\\" + m[0][1:], raw).decode()


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text) if "\\" in text else text


# ---------------------------------------------------------------- assembly

def _escapes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places in ``raw`` before which a backslash goes; matches across two texts are none."""
    found = np.array([(m.start(), m.end()) for m in _OPEN.finditer(raw.tobytes())], np.int64).reshape(-1, 2)
    row = np.searchsorted(starts, found[:, 0], "right") - 1
    return found[found[:, 1] <= starts[row + 1], 0] + 1


def _scatter(out: np.ndarray, to: np.ndarray, palette: list[bytes], which: np.ndarray) -> None:
    """Copy palette[which[i]] to place to[i] of ``out``, for all i."""
    size = np.array([len(x) for x in palette], np.int64)
    first = np.cumsum(size) - size
    source = np.frombuffer(b"".join(palette), np.uint8)
    n = size[which]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(to, n) + step] = source[np.repeat(first[which], n) + step]


def assemble(raw: np.ndarray, starts: np.ndarray, roles: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, first byte of each turn and the end, first byte of each text, its end) of formatted turns."""
    names = sorted(set(roles))
    number = {name: i for i, name in enumerate(names)}
    kind = np.array([number[r] for r in roles], np.int64)
    pairs = [TEMPLATE.get(r) or (OTHER[0] + escape(r) + OTHER[1], OTHER[2]) for r in names]
    heads, tails = [p[0].encode() for p in pairs], [p[1].encode() for p in pairs]
    at = _escapes(raw, starts)
    added = np.searchsorted(at, starts)
    length = np.diff(starts) + np.diff(added)
    head, tail = (np.array([len(x) for x in side], np.int64)[kind] for side in (heads, tails))
    turn = np.concatenate([[0], np.cumsum(head + length + tail)])
    begin = turn[:-1] + head
    out = np.empty(turn[-1], np.uint8)
    # runs of source bytes that move by one distance: from a text's start or an escape to the next
    filled = np.flatnonzero(np.diff(starts))
    edge = np.union1d(starts[:-1][filled], at)
    row = np.searchsorted(starts, edge, "right") - 1
    shift = begin[row] - starts[row] + np.searchsorted(at, edge, "right") - added[row]
    place = np.arange(len(raw)) + np.repeat(shift, np.diff(np.append(edge, len(raw))))
    out[place] = raw
    out[place[at] - 1] = 0x5C
    _scatter(out, turn[:-1], heads, kind)
    _scatter(out, begin + length, tails, kind)
    return out, turn, begin, begin + length


def _pages(table, first_row: np.ndarray, whole: np.ndarray, numbers: np.ndarray):
    """Formatted pages of a table of turns (key, role, text); page i has the rows from first_row[i] to the next."""
    import pyarrow as pa

    raw, starts = text_bytes(table.column("text").combine_chunks())
    roles = table.column("role").to_pylist()
    out, turn, begin, end = assemble(raw, starts, roles)
    edges = np.append(first_row, len(roles))
    letters = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])  # code points before each byte
    learned = np.flatnonzero([r == LEARNED for r in roles])
    page = np.searchsorted(first_row, learned, "right") - 1
    origin = letters[turn[first_row]][page]
    spans = [pa.ListArray.from_arrays(pa.array(np.searchsorted(learned, edges), pa.int32()), pa.array(letters[x[learned]] - origin)) for x in (begin, end)]
    text = pa.StringArray.from_buffers(len(first_row), pa.py_buffer(turn[edges].astype(np.int32)), pa.py_buffer(out))
    return pa.RecordBatch.from_arrays([table.column("key").combine_chunks().take(pa.array(first_row)), pa.array(numbers), pa.array(whole), pa.array(np.diff(edges)), text, *spans],
                                      ["key", "page", "whole", "n_turns", "formatted", "loss_start", "loss_end"])


def assemble_partition(batches, number: int = 0, page_bytes: int = PAGE_BYTES):
    """Pages, numbered from ``number`` on, of a partition that is sorted by conversation and turn."""
    import pyarrow as pa

    held, known = None, False  # known: the conversation that is held began in this partition, and none of it is written

    def emit(table, firsts, whole):
        nonlocal number
        _, starts = text_bytes(table.column("text").combine_chunks())
        sizes = np.concatenate([starts[firsts], starts[-1:]])
        for a, b in byte_chunks(sizes, CHUNK_BYTES):
            last = firsts[b] if b < len(firsts) else table.num_rows
            yield _pages(table.slice(firsts[a], last - firsts[a]), firsts[a:b] - firsts[a], whole[a:b], np.arange(number, number + b - a))
            number += b - a

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        key = table.column("key")
        null, value = key.is_null().to_numpy(), key.fill_null(0).to_numpy()
        firsts = np.concatenate([[0], np.flatnonzero((null[1:] != null[:-1]) | (value[1:] != value[:-1])) + 1])
        if len(firsts) > 1:  # all but the last conversation end here
            whole = np.ones(len(firsts) - 1, bool)
            whole[0] = known
            yield from emit(table.slice(0, firsts[-1]), firsts[:-1], whole)
            known, table = True, table.slice(firsts[-1])
        held = table
        if held.column("text").nbytes > page_bytes:
            yield from emit(held, np.zeros(1, np.int64), np.zeros(1, bool))
            known, held = False, None
    if held is not None:
        yield from emit(held, np.zeros(1, np.int64), np.zeros(1, bool))


def format_chats(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 page_bytes: int = PAGE_BYTES) -> DataFrame:
    """key, page, whole, n_turns, formatted, loss_start, loss_end: conversations as strings with their loss mask.

    A conversation is one page (``whole``) or, where it is long or stands at the
    edge of a task, several; joined in the order of ``page`` they are its
    string.  The loss mask covers the assistant's texts: spans of code points
    within the page, end exclusive.

    Rows go by turn (null first), then role, then text hash.  Null texts and
    roles are empty; a role outside the template is named in its head.  Rows
    that repeat are turns of their own; rows with a null key are one
    conversation.  Other columns are left aside; an empty table gives no rows.
    """
    small_batches(turns.sparkSession)
    rows = turns.select(F.col(key).cast("bigint").alias("key"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                        whole_text(text).alias("text"))
    order = ["key", "turn", "role", "hash"]
    rows = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def work(batches):
        yield from assemble_partition(batches, TaskContext.get().partitionId() << 32, page_bytes)

    return rows.select("key", "role", "text").mapInArrow(work, PAGES)


# ---------------------------------------------------------------- reading back

def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of all turns of a formatted page."""
    parts, out, i = CONTROL.split(formatted), [], 1
    while i < len(parts):
        sign, text = parts[i], parts[i + 1]
        if sign == OTHER[0]:
            role, text, i = unescape(text), parts[i + 3], i + 6
        else:
            role = {"[SYS]": "system", "[INST]": "user", "<s>": "assistant"}[sign]
            text, i = text[1:-1] if role == "user" else text, i + 4
        out.append((role, unescape(text)))
    return out


class _Digest:
    def __init__(self):
        self.turns, self.chars, self.loss_chars, self.all, self.loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, begin: list[int], end: list[int]) -> None:
        self.chars += len(formatted)
        for role, text in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        for a, b in zip(begin, end, strict=True):
            text = unescape(formatted[a:b])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGESTS = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
_DIGEST_TYPES = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_chats(pages: DataFrame) -> DataFrame:
    """key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from formatted pages.

    Whole conversations are read where they stand; pages of the others are
    brought together and read in order, one page at a time.
    """
    def read_whole(batches):
        import pyarrow as pa

        for batch in batches:
            table = batch.to_pydict()
            found = []
            for whole, formatted, begin, end in zip(table["whole"], table["formatted"], table["loss_start"], table["loss_end"], strict=True):
                digest = _Digest()
                if whole:
                    digest.add(formatted, begin, end)
                found.append(digest.row() if whole else (None,) * 5)
            rest = [None if w else f for w, f in zip(table["whole"], table["formatted"], strict=True)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array([r[i] for r in found], kinds[i]) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rest, pa.string()), batch.column(5), batch.column(6), *columns],
                                             ["key", "page", "formatted", "loss_start", "loss_end", *_DIGESTS])

    def read_pages(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def record(key, row):
            return pa.RecordBatch.from_pydict(dict(zip(["key", *_DIGESTS], ([key], *([x] for x in row)), strict=True)), schema)

        schema = pa.schema([("key", pa.int64()), *((c, pa.string() if "sha" in c else pa.int64()) for c in _DIGESTS)])
        now, digest = None, None
        for batch in batches:
            whole = batch.column(2).is_null()
            yield batch.filter(whole).select(["key", *_DIGESTS])
            for row in batch.filter(pc.invert(whole)).to_pylist():
                if digest is not None and row["key"] != now:
                    yield record(now, digest.row())
                    digest = None
                now, digest = row["key"], digest or _Digest()
                digest.add(row["formatted"], row["loss_start"], row["loss_end"])
        if digest is not None:
            yield record(now, digest.row())

    first = pages.mapInArrow(read_whole, "key bigint, page bigint, formatted string, loss_start array<bigint>, loss_end array<bigint>, " + _DIGEST_TYPES)
    return first.repartition("key").sortWithinPartitions("key", "page").mapInArrow(read_pages, "key bigint, " + _DIGEST_TYPES)
