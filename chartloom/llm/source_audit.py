"""Divergence of sources by their terms, with identical texts collapsed.

Identical texts of a language are one text with a number of copies per source:
every task sends a text once and the copies as counts, so a text in a third of
all documents costs each task one row.  A text is cut into terms once; its terms
are added to document frequencies and counts, weighted by the copies.  Terms in
enough documents are kept.

Sources are compared on the terms that occur: a term that neither source has
differs by the same amount for all such terms, so the sum over all kept terms is
that amount for each of them, corrected by cells of occurring terms.  A cell
holds a block of terms for two blocks of sources.  All arithmetic is in whole
numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm.shared import claim_worker, distinct_ranges, lower_ascii, range_bounds, saved, small_batches, text_bytes

LEAST_DOCS = 30
SCALE = 1_000_000_000
SMOOTH = 5
TERM_RANKS = 50

#: Bytes of texts that are counted together, and sums that a task holds before it sends them.
CHUNK_BYTES = 2 << 20
HELD_SUMS = 2_000_000
#: Texts that a task remembers as sent.
HELD_TEXTS = 200_000
#: Sources and terms of a cell, on average.
SOURCE_BLOCK, TERM_BLOCK = 256, 2048

_TERM_SIGN = np.zeros(256, bool)
_TERM_SIGN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


# ---------------------------------------------------------------- identical texts

def collapse_texts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, digest, source, n, text): copies by source, with the text itself once per task at least."""
    small_batches(docs.sparkSession)

    def work(batches):
        import pyarrow as pa

        sent: set = set()
        copies: dict = {}

        def rows():
            columns = list(zip(*((*k, n) for k, n in copies.items()), strict=True))
            kinds = [pa.string(), pa.binary(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.nulls(len(copies), pa.string())],
                                              ["lang", "digest", "source", "n", "text"])

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            raw, starts = text_bytes(batch.column(2))
            data, fresh = raw.tobytes(), []
            for i, (own_lang, own_source) in enumerate(zip(langs, sources, strict=True)):
                digest = hashlib.blake2b(data[starts[i]:starts[i + 1]], digest_size=16).digest()
                if (own_lang, digest) not in sent:
                    sent.add((own_lang, digest))
                    fresh.append((i, digest))
                else:
                    place = (own_lang, digest, own_source)
                    copies[place] = copies.get(place, 0) + 1
            if fresh:
                some = batch.take(pa.array([i for i, _ in fresh], pa.int64()))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([d for _, d in fresh], pa.binary()), some.column(1), pa.array([1] * len(fresh), pa.int64()), some.column(2)],
                                                 ["lang", "digest", "source", "n", "text"])
            if len(sent) + len(copies) > HELD_TEXTS:
                if copies:
                    yield rows()
                sent, copies = set(), {}
        if copies:
            yield rows()

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).alias("text"))
    sent = rows.mapInArrow(work, "lang string, digest binary, source string, n bigint, text string")
    return sent.repartition("lang", "digest").sortWithinPartitions("digest", "lang")


class _Sums:
    """Occurrences and documents by (owner, term) of one task; owners are pairs of language and source."""

    def __init__(self):
        self.owners: dict[tuple, int] = {}
        self.terms: dict[bytes, int] = {}
        self.cells, self.values, self.held = [], [], 0

    def owner(self, lang: str, source: str) -> int:
        return self.owners.setdefault((lang, source), len(self.owners))

    def add(self, owner: np.ndarray, term: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        self._merge([owner << 32 | term], [np.stack([n, docs], 1)])
        if self.held > HELD_SUMS:
            self.compact()

    def _merge(self, cells: list[np.ndarray], values: list[np.ndarray]) -> None:
        merged, where = np.unique(np.concatenate(cells), return_inverse=True)
        sums = np.zeros((len(merged), 2), np.int64)
        np.add.at(sums, where, np.concatenate(values))
        self.cells.append(merged)
        self.values.append(sums)
        self.held += len(merged)

    def compact(self) -> None:
        if len(self.cells) > 1:
            cells, values = self.cells, self.values
            self.cells, self.values, self.held = [], [], 0
            self._merge(cells, values)

    def full(self) -> bool:
        return self.held > HELD_SUMS // 2 and len(self.cells) == 1

    def rows(self):
        """lang, source, term, n, docs."""
        import pyarrow as pa

        self.compact()
        if self.cells:
            names = list(self.owners)
            langs, sources = pa.array([x[0] for x in names], pa.string()), pa.array([x[1] for x in names], pa.string())
            terms = pa.array(list(self.terms), pa.binary()).cast(pa.string())
            for at in range(0, len(self.cells[0]), 50_000):
                cells = self.cells[0][at:at + 50_000]
                owner, term = pa.array(cells >> 32), pa.array(cells & 0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([langs.take(owner), sources.take(owner), terms.take(term), *(pa.array(self.values[0][at:at + 50_000, i]) for i in (0, 1))],
                                                 ["lang", "source", "term", "n", "docs"])
        self.__init__()


def count_terms(texts: list[bytes], copies: list[tuple[str, dict[str, int]]], sums: _Sums) -> None:
    """Add the terms of distinct texts to the sums; ``copies`` has each text's language and its copies by source."""
    raw = lower_ascii(np.frombuffer(b"".join(texts), np.uint8))
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    begin, end, first = range_bounds(raw, starts, _TERM_SIGN)
    if not len(begin):
        return
    kind, where = distinct_ranges(raw, begin, end)
    data, known = raw.tobytes(), sums.terms
    number = np.array([known.setdefault(data[a:b], len(known)) for a, b in zip(begin[where].tolist(), end[where].tolist(), strict=True)], np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    pairs, times = np.unique(text * len(where) + kind, return_counts=True)
    text, term = pairs // len(where), number[pairs % len(where)]
    # the copies of a text by source, one after another
    spread = [(sums.owner(lang, s), n) for lang, own in copies for s, n in own.items()]
    owners, each = (np.array(x, np.int64) for x in zip(*spread, strict=True))
    many = np.array([len(own) for _, own in copies], np.int64)
    n = many[text]
    place = np.repeat((np.cumsum(many) - many)[text], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    sums.add(owners[place], np.repeat(term, n), each[place] * np.repeat(times, n), each[place])


def term_counts(collapsed: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n): occurrences by source of the terms in ``least_docs`` documents of their language or more.

    One exchange by (lang, term) serves both sums; a term has one row per source and task there.
    """
    def work(batches):
        claim_worker("source_audit")
        sums, texts, copies, size = _Sums(), [], [], 0
        now, text, own = None, None, {}
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            valid = batch.column(4).is_valid().to_pylist()
            for i, (lang, digest, source, n) in enumerate(zip(*columns, strict=True)):
                if (lang, digest) != now:
                    if now is not None:
                        texts.append(text)
                        copies.append((now[0], own))
                        size += len(text)
                    now, text, own = (lang, digest), None, {}
                    if size > CHUNK_BYTES:
                        count_terms(texts, copies, sums)
                        texts, copies, size = [], [], 0
                        if sums.full():
                            yield from sums.rows()
                own[source] = own.get(source, 0) + n
                if text is None and valid[i]:
                    text = batch.column(4)[i].as_py().encode()
        if now is not None:
            count_terms([*texts, text], [*copies, (now[0], own)], sums)
        yield from sums.rows()

    sent = collapsed.mapInArrow(work, "lang string, source string, term string, n bigint, docs bigint").repartition("lang", "term")
    sums = sent.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    in_lang = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return sums.withColumn("docs", in_lang).filter(F.col("docs") >= least_docs).select("lang", "source", "term", "n")


# ---------------------------------------------------------------- rates and divergences

def _rate(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)), null without kept terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    whole = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + F.lit(SMOOTH).cast("decimal(10,0)")),
                            (wide(total) + F.lit(SMOOTH).cast("decimal(10,0)") * wide(kept)))
    return F.when(kept > 0, F.lit(1) + whole)


def pair_values(rates: DataFrame, groups: DataFrame, source_block: int = SOURCE_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """(lang, source, item, value) of all pairs of different sources of a language.

    ``rates`` has lang, source, term, p of occurring terms; ``groups`` has lang,
    source, base (the rate of a term that does not occur), kept and sources (how
    many the language has).
    """
    blocks = F.ceil(F.col("sources") / source_block).cast("int")
    cells = F.greatest(F.ceil(F.col("kept") / term_block), F.lit(1)).cast("int")
    sides = groups.select("lang", "source", F.coalesce("base", F.lit(0)).alias("base"), "kept", cells.alias("cells"), blocks.alias("blocks"),
                          F.pmod(F.xxhash64("source"), blocks).cast("int").alias("mine"))
    spots = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # every source is in all cells of its language by its base, and by its terms where they belong
    empty = sides.withColumn("cell", spots("cells")).withColumn("term", F.lit(None).cast("string")).withColumn("p", F.lit(None).cast("bigint"))
    filled = rates.join(sides, ["lang", "source"]).withColumn("cell", F.pmod(F.xxhash64("term"), F.col("cells")).cast("int"))
    names = ["lang", "cell", "blocks", "mine", "source", "base", "kept", "term", "p"]
    rows = empty.select(*names).unionByName(filled.select(*names)).withColumn("other", spots("blocks"))
    grid = rows.select("lang", "cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "source", "base", "kept", "term", "p")

    def compare(table):
        import pyarrow as pa

        lang, cell, i, j, kept = (table.column(c)[0].as_py() for c in ("lang", "cell", "i", "j", "kept"))
        source = table.column("source").combine_chunks().dictionary_encode()
        term = table.column("term").combine_chunks().dictionary_encode()
        who, what = source.indices.to_numpy(), term.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        base, mine = np.zeros(len(source.dictionary), np.int64), np.zeros(len(source.dictionary), np.int64)
        base[who], mine[who] = table.column("base").to_numpy(), table.column("mine").to_numpy()
        p = np.repeat(base[:, None], len(term.dictionary), 1)
        some = what >= 0
        p[who[some], what[some]] = table.column("p").combine_chunks().filter(pa.array(some)).to_numpy()
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        rest = kept if cell == 0 else 0  # the amount of all kept terms counts once
        out = [np.abs(p[right] - p[x]).sum(1) + (rest - p.shape[1]) * np.abs(base[right] - base[x]) for x in left]
        value = np.stack(out) if out else np.zeros((0, len(right)), np.int64)
        a, b = np.nonzero(left[:, None] != right[None, :])
        value, a, b = value[a, b], left[a], right[b]
        if i != j:
            a, b, value = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([value, value])
        names = source.dictionary
        return pa.table([pa.array([lang] * len(a), pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(value)], ["lang", "source", "item", "value"])

    parts = grid.groupBy("lang", "cell", "i", "j").applyInArrow(compare, "lang string, source string, item string, value bigint")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = TERM_RANKS, lang: str = "lang", source: str = "source", text: str = "text",
                  source_block: int = SOURCE_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: how sources differ from each other and from their language.

    Part ``pair`` has every other source of the language with the sum of the
    differences of all kept terms' rates; part ``term`` the ``ranks`` terms whose
    rate is most above the language's.  A language keeps the terms in
    ``least_docs`` of its documents or more.  Terms are runs of letters (A-Z in
    lower case) and signs outside ASCII.

    Null texts, languages and sources are empty ones.  A source without terms
    has its pairs; a language of one source has none.  Repeated rows are
    documents of their own.  Ties go by the UTF-8 item.  An empty table gives no
    rows.
    """
    counts = saved(term_counts(collapse_texts(docs, lang, source, text), least_docs), "audit-counts")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = saved(docs.select(blank(lang).alias("lang"), blank(source).alias("source")).distinct().join(totals, ["lang", "source"], "left"), "audit-groups")
    langs = (known.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.sum("total").alias("lang_total"))
             .join(whole.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")), "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0))))
    total = F.coalesce("total", F.lit(0))
    groups = saved(known.join(langs, "lang").select("lang", "source", "sources", "kept", total.alias("total"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
                                                    _rate(F.lit(0), total, F.col("kept")).alias("base")), "audit-bases")
    rates = counts.join(groups, ["lang", "source"]).withColumn("p", _rate(F.col("n"), F.col("total"), F.col("kept")))
    terms = rates.join(whole, ["lang", "term"]).withColumn("q", _rate(F.col("lang_n"), F.col("lang_total"), F.col("kept"))).filter("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    pairs = ranked(pair_values(rates.select("lang", "source", "term", "p"), groups, source_block, term_block), "pair")
    best = ranked(terms.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "term")
    return pairs.unionByName(best.filter(F.col("rank") <= ranks))
