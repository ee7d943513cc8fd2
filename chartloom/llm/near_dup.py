"""Near-duplicate documents by SetSketch registers.

A document is its set of distinct word shingles.  Its sketch has registers that
hold the smallest of many exponentially distributed hashes on an exponential
scale: ``floor(1 - log_b(x))``, cut to a fixed range.  Sketches of unions are
registerwise maxima, and equal registers are as likely as shared shingles.

Equal sets are one node.  Bands of registers bring nodes together; a joint
likelihood over the registers estimates their similarity and drops chance
meetings; what is left forms groups.  In a band's bucket all nodes meet its
smallest and its largest node; those that neither is near enough to speak for
meet each other, in blocks.  Links are only made on full sets.  Each group has a hub, the node that shares most bands, and every node is compared
with it.  Nodes that do not link to their hub are compared with all nodes of
their group, in blocks.  Nodes that are all linked to the hub need no more
comparisons: they are in one component.

No pair of equal texts and no pair within a component is emitted; a group of any
size is split into blocks of bounded size.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from chartloom.llm.links import components
from chartloom.llm.shared import (
    SEEDS, byte_chunks, byte_hashes, claim_worker, free_name, lower_ascii, saved, small_batches, sorted_groups, text_bytes, whole_text, window_hashes, word_bounds,
)
from chartloom.llm.vector_links import _unite

SHINGLE = 5
#: 32 bands of 4 registers: documents of similarity 0.75 share none with a chance of 5 in a million.
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
BASE, RATE, LIMIT = 1.02, 20.0, 2000
#: Meetings with a lower estimate are chance; far below any link.
LEAST_ESTIMATE = 0.2
#: Below the least similarity of a link: how far an estimate may lie under the similarity (7 deviations at 0.75).
MARGIN = 0.25
BLOCK = 1024
#: Pairs added at a time when intersections are counted.
PAIRS = 1_000_000


# ---------------------------------------------------------------- shingles and sketches

def shingle_sets(raw: np.ndarray, starts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle fingerprints of all texts, first of each text and the end)."""
    raw = lower_ascii(raw)
    begin, end, first = word_bounds(raw, starts)
    words = byte_hashes(raw, begin, end)
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), count)
    at = first[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
    prints = np.empty(len(at), np.uint64)
    length = np.minimum(n, size)[owner]
    for k in range(1, size + 1):  # shorter texts are one shingle of all their words
        some = np.flatnonzero(length == k)
        if len(some):
            prints[some] = window_hashes(words, at[some], k, SEEDS[1])
    order = np.lexsort((prints, owner))
    prints, owner = prints[order], owner[order]
    new = np.ones(len(prints), bool)
    new[1:] = (prints[1:] != prints[:-1]) | (owner[1:] != owner[:-1])
    return prints[new], np.searchsorted(owner[new], np.arange(len(n) + 1))


_rng = np.random.default_rng(977)
_A, _B, _C = (_rng.integers(1, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1) for _ in range(3))


def sketch(prints: np.ndarray) -> np.ndarray:
    """Registers of a non-empty set of fingerprints."""
    low, high = prints.astype(np.uint32), (prints >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for i in range(0, len(low), 1024):
        h = low[i:i + 1024, None] * _A + high[i:i + 1024, None] * _B
        h ^= h >> np.uint32(15)
        h *= _C
        h ^= h >> np.uint32(13)
        np.minimum(least, h.min(0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, LIMIT).astype("<u2")


def merge(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(one, other)


def _likelihood(one: np.ndarray, other: np.ndarray, n_one: np.ndarray, n_other: np.ndarray):
    """(log likelihood of a similarity, largest similarity that the sizes allow) of each pair of sketches."""
    larger, smaller = (one > other).sum(1), (one < other).sum(1)
    equal = one.shape[1] - larger - smaller
    u = n_one / (n_one + n_other)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def likelihood(j):
        a, b = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return larger * np.log(a) + smaller * np.log(b) + equal * np.log(np.maximum(1 - a - b, 1e-12))

    return likelihood, np.minimum(u, v) / np.maximum(u, v)


def estimate(one: np.ndarray, other: np.ndarray, n_one: np.ndarray, n_other: np.ndarray) -> np.ndarray:
    """Most likely similarity of each pair of sketches, given the set sizes.

    Registers are larger on one side, on the other, or equal; their chances
    follow from the similarity, and the likelihood has one maximum.
    """
    likelihood, high = _likelihood(one, other, n_one, n_other)
    low = np.zeros(len(high))
    for _ in range(40):
        third = (high - low) / 3
        left, right = low + third, high - third
        up = likelihood(left) < likelihood(right)
        low, high = np.where(up, left, low), np.where(up, high, right)
    return (low + high) / 2


def reaches(one: np.ndarray, other: np.ndarray, n_one: np.ndarray, n_other: np.ndarray, least: float) -> np.ndarray:
    """Whether the estimate of each pair is ``least`` or more: the likelihood still rises there."""
    if least <= 0:
        return np.ones(len(n_one), bool)
    likelihood, high = _likelihood(one, other, n_one, n_other)
    return (high >= least) & (likelihood(np.minimum(least + 1e-4, high)) >= likelihood(np.minimum(least, high)))


def _digest(prints: np.ndarray) -> tuple[int, bytes]:
    raw = hashlib.blake2b(prints.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), raw


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, print (of the text), n (shingles), node (of the set), registers; node and registers are null for empty sets."""
    small_batches(docs.sparkSession)

    def work(batches):
        import pyarrow as pa

        claim_worker("near_dup")
        for batch in batches:
            raw, starts = text_bytes(batch.column(2))
            for a, b in byte_chunks(starts, 1 << 20):
                prints, first = shingle_sets(raw[starts[a]:starts[b]], starts[a:b + 1] - starts[a])
                nodes, registers = [], []
                for i in range(b - a):
                    own = prints[first[i]:first[i + 1]]
                    nodes.append(_digest(own)[0] if len(own) else None)
                    registers.append(sketch(own).tobytes() if len(own) else None)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:2]), pa.array(np.diff(first)), pa.array(nodes, pa.int64()),
                                                  pa.array(registers, pa.binary())], ["key", "print", "n", "node", "registers"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.xxhash64(whole_text(text)).alias("print"), whole_text(text).alias("text"))
    return rows.mapInArrow(work, "key bigint, print bigint, n bigint, node bigint, registers binary")


# ---------------------------------------------------------------- groups of nodes that may link

def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


@F.arrow_udf(DoubleType())
def _estimated(one, other, n_one, n_other):
    import pyarrow as pa

    if not len(one):
        return pa.array([], pa.float64())
    return pa.array(estimate(_registers(one), _registers(other), n_one.to_numpy().astype(float), n_other.to_numpy().astype(float)))


def unsettled(crowded: DataFrame, settled: DataFrame) -> DataFrame:
    """(h, node) of the nodes that are no centre of their bucket and that no centre settles; ``settled`` has a, b."""
    rest = crowded.filter("node <> low AND node <> high")
    for center in ("low", "high"):
        rest = rest.join(settled, (F.least("node", center) == F.col("a")) & (F.greatest("node", center) == F.col("b")), "left_anti")
    return rest.select("h", "node")


def rest_meetings(rest: DataFrame, nodes: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(a, b): enough meetings of an estimate from ``least`` on among the nodes of each bucket; all pairs of them are compared, in blocks."""
    counts = rest.groupBy("h").agg(F.count(F.lit(1)).alias("left")).filter("left > 1")
    blocks = F.ceil(F.col("left") / block).cast("int")
    rows = rest.join(counts, "h").select("h", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("mine"))
    rows = rows.join(nodes.select("node", "n", "registers"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grid = rows.select("h", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "n", "registers")
    parts = max(1, int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def work(batches):
        import pyarrow as pa

        for table in sorted_groups(batches, ["h", "i", "j"]):
            i, j, mine, ids = (table.column(c).to_numpy() for c in ("i", "j", "mine", "node"))
            n, registers = table.column("n").to_numpy().astype(float), _registers(table.column("registers"))
            left, right = np.flatnonzero(mine == i[0]), np.flatnonzero(mine == j[0])
            names, where = np.unique(ids, return_inverse=True)
            root = np.arange(len(names))
            for k, x in enumerate(left):
                to = right[k + 1:] if i[0] == j[0] else right
                to = to[root[where[to]] != root[where[x]]]  # the others are in one group already
                if not len(to):
                    continue
                to = to[reaches(registers[x][None], registers[to], np.full(len(to), n[x]), n[to], least)]
                moved, went = _unite(root, np.full(len(to), where[x]), where[to])
                if len(moved):
                    yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[went])], ["a", "b"])

    grid = grid.repartition(parts, "h", "i", "j").sortWithinPartitions("h", "i", "j")
    return grid.mapInArrow(work, "a bigint, b bigint")


def groups(nodes: DataFrame, percent: int = 75, block: int = BLOCK) -> DataFrame:
    """(node, part, hub, size) of nodes that may link with others; ``nodes`` has node, n, registers.

    A node so near to a centre of its bucket that whatever links with it must
    meet that centre too is settled; the others of the bucket meet each other.
    """
    width = 2 * ROWS
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("registers", i * width + 1, width)) for i in range(BANDS)])
    spots = nodes.select("node", F.explode(bands).alias("h"))
    crowds = spots.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("low"), F.max("node").alias("high")).filter("m > 1")
    crowded = saved(spots.join(crowds, "h"), "near-crowded")
    # a bucket's nodes meet its smallest and its largest node first
    pairs = (crowded.select("node", F.explode(F.array("low", "high")).alias("center")).filter("node <> center")
             .select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct())
    sides = [nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}")) for x in "ab"]
    met = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", _estimated("r_a", "r_b", "n_a", "n_b").alias("estimate"))
    met = saved(met.filter(F.col("estimate") >= LEAST_ESTIMATE), "near-met")
    # distances add up: what has a similarity of percent with a settled node has LEAST_ESTIMATE and the margin with its centre
    settled = met.filter(F.col("estimate") >= 1 - percent / 100 + LEAST_ESTIMATE + MARGIN)
    rest = saved(unsettled(crowded, settled), "near-rest")
    near = met.select("a", "b").unionByName(rest_meetings(rest, nodes, percent / 100 - MARGIN, block))
    members = components(near)
    popular = crowded.groupBy("node").agg(F.sum(F.col("m") - 1).alias("met"))
    members = saved(members.withColumnRenamed("id", "node").withColumnRenamed("component", "part").join(popular, "node"), "near-members")
    heads = members.groupBy("part").agg(F.max(F.struct("met", "node")).alias("best"), F.count(F.lit(1)).alias("size"))
    return saved(members.join(heads, "part").select("node", "part", F.col("best.node").alias("hub"), "size"), "near-groups")


# ---------------------------------------------------------------- links on full sets

def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left and right sets.

    Shingles that only few sets hold are added pair by pair, the others by
    products of 0/1 matrices, some columns at a time.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    row_a, row_b = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    names, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    col_a, col_b = where[:len(a)], where[len(a):]
    in_a, in_b = np.bincount(col_a, minlength=len(names)), np.bincount(col_b, minlength=len(names))
    work = in_a * in_b
    dense = work > 4096
    order = np.argsort(col_b, kind="stable")
    sorted_rows, edge = row_b[order], np.concatenate([[0], np.cumsum(in_b)])
    some = np.flatnonzero((work > 0)[col_a] & ~dense[col_a])
    grown = np.cumsum(in_b[col_a[some]])
    edges = [0, *(np.flatnonzero(np.diff(grown // PAIRS)) + 1).tolist(), len(some)]
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        part = some[i:j]
        n = in_b[col_a[part]]
        places = np.repeat(edge[col_a[part]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        np.add.at(out, (np.repeat(row_a[part], n), sorted_rows[places]), 1)
    columns = np.flatnonzero(dense)
    for i in range(0, len(columns), 2048):
        part = columns[i:i + 2048]
        place = np.full(len(names), -1)
        place[part] = np.arange(len(part))
        one, two = np.zeros((len(left), len(part)), np.float32), np.zeros((len(right), len(part)), np.float32)
        k = place[col_a] >= 0
        one[row_a[k], place[col_a[k]]] = 1
        k = place[col_b] >= 0
        two[row_b[k], place[col_b[k]]] = 1
        out += one @ two.T
    return out


def _links(common: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, percent: int) -> np.ndarray:
    both = common.astype(np.int64)
    return 100 * both >= percent * (n_left[:, None] + n_right[None, :] - both)


def full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(node, part, hub, size, shingles) of the wanted nodes; ``wanted`` has the key of a document of each."""
    small_batches(docs.sparkSession, 100)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), whole_text(text).alias("text")).join(wanted, "key")

    def work(batches):
        import pyarrow as pa

        claim_worker("near_dup")
        for batch in batches:
            raw, starts = text_bytes(batch.column(0))
            nodes = batch.column(1).to_pylist()
            prints, first = shingle_sets(raw, starts)
            own = [prints[first[i]:first[i + 1]] for i in range(len(nodes))]
            right = [i for i, x in enumerate(own) if len(x) and _digest(x)[0] == nodes[i]]  # of rows that repeat a key, the one that is meant
            part = batch.take(pa.array(right, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([own[i].tobytes() for i in right], pa.binary())], ["node", "part", "hub", "size", "shingles"])

    return rows.select("text", "node", "part", "hub", "size").mapInArrow(work, "node bigint, part bigint, hub bigint, size bigint, shingles binary")


def _arrays(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def hub_links(sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(node, part, hub, size, linked): whether each node links with the hub of its group."""
    salts = F.ceil(F.col("size") / block).cast("int")
    hubs = sets.filter("node = hub").select("part", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("turn"), "node", "hub", "size", "shingles")
    others = sets.filter("node <> hub").select("part", F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"), F.lit(1).alias("turn"), "node", "hub", "size", "shingles")
    parts = max(1, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def work(batches):
        import pyarrow as pa

        for table in sorted_groups(batches, ["part", "salt"]):
            own = _arrays(table.column("shingles"))
            n = np.array([len(x) for x in own])
            linked = [True if len(x) == 0 else bool(_links(np.array([[_member_count(x, own[0])]]), np.array([k]), n[:1], percent)[0, 0])
                      for x, k in zip(own, n, strict=True)]
            yield pa.RecordBatch.from_arrays([table.column(c).combine_chunks() for c in ("node", "part", "hub", "size")] + [pa.array(linked)],
                                             ["node", "part", "hub", "size", "linked"])

    rows = hubs.unionByName(others).repartition(parts, "part", "salt").sortWithinPartitions("part", "salt", "turn")
    return rows.mapInArrow(work, "node bigint, part bigint, hub bigint, size bigint, linked boolean")


def _member_count(small: np.ndarray, sorted_set: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(sorted_set, small), len(sorted_set) - 1)
    return int((sorted_set[at] == small).sum())


def rest_links(sets: DataFrame, hubbed: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b): enough links of the nodes that did not link with their hub, from comparisons with all nodes of their group."""
    rest = hubbed.filter("NOT linked").select("node").distinct()
    counts = hubbed.groupBy("part").agg(F.sum((~F.col("linked")).cast("bigint")).alias("left")).filter("left > 0 AND part IS NOT NULL")
    rows = sets.filter("size > 2").join(counts, "part").join(rest.withColumn("open", F.lit(True)), "node", "left")
    p_blocks, a_blocks = F.ceil(F.col("left") / block).cast("int"), F.ceil(F.col("size") / block).cast("int")
    spots = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    asked = rows.filter("open").select("part", mine(p_blocks).alias("i"), spots(a_blocks).alias("j"), F.lit(0).alias("side"), "node", "shingles")
    given = rows.select("part", spots(p_blocks).alias("i"), mine(a_blocks).alias("j"), F.lit(1).alias("side"), "node", "shingles")
    parts = max(1, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def work(batches):
        import pyarrow as pa

        for table in sorted_groups(batches, ["part", "i", "j"]):
            side, ids, own = table.column("side").to_numpy(), table.column("node").to_numpy(), _arrays(table.column("shingles"))
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            n = np.array([len(x) for x in own])
            a, b = np.nonzero(_links(_common([own[i] for i in left], [own[i] for i in right]), n[left], n[right], percent))
            names, where = np.unique(ids, return_inverse=True)
            root = np.arange(len(names))
            moved, to = _unite(root, where[left[a]], where[right[b]])
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[to])], ["a", "b"])

    grid = asked.unionByName(given).repartition(parts, "part", "i", "j").sortWithinPartitions("part", "i", "j")
    return grid.mapInArrow(work, "a bigint, b bigint")


def _linked(docs: DataFrame, percent: int, key: str, text: str, block: int = BLOCK) -> DataFrame:
    """key, print (of the text), n_shingles, component, kept of every row, as ``link_documents`` describes."""
    rows = saved(sketches(docs, key, text), "near-sketches")
    own = rows.filter("key IS NOT NULL AND node IS NOT NULL")
    nodes = saved(own.groupBy("node", "n", "registers").agg(F.min("key").alias("key")), "near-nodes")
    grouped = groups(nodes, percent, block)
    sets = saved(full_sets(docs, grouped.join(nodes.select("node", "key"), "node"), key, text), "near-sets")
    small_batches(docs.sparkSession, 200)
    hubbed = saved(hub_links(sets, percent, block), "near-hubs")
    rest = rest_links(sets, hubbed, percent, block)
    links = saved(hubbed.filter("linked AND node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).unionByName(rest), "near-links")
    members = components(links)
    named = saved(members.join(nodes.select(F.col("node").alias("id"), "key"), "id"), "near-components")
    least = named.groupBy("component").agg(F.min("key").alias("least"))
    linked = named.join(least, "component").select(F.col("id").alias("node"), "least")
    alone = nodes.select("node", F.col("key").alias("own"))
    out = rows.select("key", "print", "n", F.when(F.col("key").isNotNull(), F.col("node")).alias("node")).join(alone, "node", "left").join(linked, "node", "left")
    component = F.coalesce("least", "own", "key")
    return out.select("key", "print", F.col("n").alias("n_shingles"), component.alias("component"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def link_documents(docs: DataFrame, percent: int = 75, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """key, n_shingles, component, kept of every row.

    Words are lower-cased (A-Z) and not otherwise changed; a text of fewer words
    than a shingle is one shingle; null and empty texts have none and link with
    nothing, nor do null keys.  Documents link where 100 * intersection >=
    percent * union.  The component is the smallest key reachable; of rows that
    repeat a key, equal texts are one set and different ones are different sets.
    An empty table gives no rows.
    """
    return _linked(docs, percent, key, text, block).drop("print")


def kept_documents(docs: DataFrame, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The document of smallest key of each component, with all its columns.

    Documents without words and rows with a null key stay.  Rows that repeat a
    key (or a null key) and a text stay once; rows that repeat a key with
    different texts stay or go each by its own text.
    """
    gone_key, gone_print, hashed, place, turn = (free_name(docs, f"__{x}") for x in ("gone", "gone_print", "print", "place", "turn"))
    gone = _linked(docs, percent, key, text).filter("NOT kept").select(F.col("key").alias(gone_key), F.col("print").alias(gone_print)).distinct()
    # null keys are spread by their text; they meet no key that goes
    rows = docs.withColumn(hashed, F.xxhash64(whole_text(text))).withColumn(place, F.coalesce(F.col(key).cast("bigint"), F.col(hashed)))
    rows = rows.join(gone, (F.col(place) == F.col(gone_key)) & (F.col(hashed) == F.col(gone_print)) & F.col(key).isNotNull(), "left_anti")
    same = Window.partitionBy(place, hashed).orderBy(F.col(key))
    return rows.withColumn(turn, F.row_number().over(same)).filter(F.col(turn) == 1).drop(turn, hashed, place)
