"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 64-bit hash of its key.  A source takes all its documents
``whole`` times and those below a hash threshold once more, so the thresholds
of one, two and three copies are nested.  The threshold is found without
sorting: sizes are summed by source and hash prefix, the prefix in which the
budget ends is the boundary, and only the boundary is summed again by the next
bits.  Each level keeps one row per source; no row of a document leaves its
task except into a sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions.ranking import position_in_group
from chartloom.llm.shared import WORD_PATTERN, free_name, saved, whole_text

LEVEL_BITS = 12
LEVELS = 4


def word_count(text: str = "text") -> Column:
    """Number of words of the whole text, 0 for null."""
    return F.regexp_count(whole_text(text), F.lit(WORD_PATTERN)).cast("bigint")


def _prefix(level: int, column: str = "h") -> Column:
    """The first ``level * LEVEL_BITS`` bits of the hash."""
    return F.shiftrightunsigned(F.col(column), 64 - level * LEVEL_BITS)


def targets(sources: DataFrame, weights: Sequence[float], max_repeat: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights go to the sources by code point, null last, over and over.  All
    sizes are shared by weight; a target stops at ``max_repeat`` times its
    source's size and the excess is shared again by weight.  So a target is the
    smaller of its stop and ``level * weight``, and the level is found by a few
    one-row sums; sources are never collected.
    """
    sources = sources.withColumn("_null", F.col("source").isNull())
    # code points order UTF-8 strings; prefixes are buckets of that order
    ranked = position_in_group(sources, [], [F.col("_null"), F.col("source")],
                               F.struct("_null", F.substring("source", 1, 4).alias("p")), "position")
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = saved(ranked.select("source", "source_size", (F.col("source_size") * float(max_repeat)).alias("stop"),
                                 F.element_at(table, ((F.col("position") - 1) % len(weights) + 1).cast("int")).alias("w")), "mix-sources")
    first = ranked.agg(F.sum("source_size").alias("t"), F.sum("w").alias("w")).first()
    total = float(first["t"] or 0)
    level = total / first["w"] if first["w"] else 0.0
    while total:
        below = F.col("stop") <= F.col("w") * level
        row = ranked.agg(F.sum(F.when(below, F.col("stop"))).alias("stopped"), F.sum(F.when(~below, F.col("w"))).alias("open")).first()
        if not row["open"]:
            break
        higher = (total - (row["stopped"] or 0.0)) / row["open"]
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return ranked.select("source", "source_size", F.least(F.col("stop"), F.col("w") * F.lit(level)).alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, bound): copies are ``whole``, one more where the hash prefix is below ``bound``.

    ``rows`` has source, h and size; ``goals`` is the result of ``targets``.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    state = saved(goals.withColumn("whole", whole)
                  .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
                  .withColumn("bound", F.lit(0).cast("bigint")), "mix-level")
    for level in range(1, LEVELS + 1):
        sums = rows.alias("r").join(state.select(F.col("source").alias("s"), "bound").alias("b"), F.col("r.source").eqNullSafe(F.col("b.s")))
        if level > 1:
            sums = sums.filter(_prefix(level - 1) == F.col("bound"))
        sums = sums.groupBy("r.source", _prefix(level).alias("prefix")).agg(F.sum("size").alias("n"))
        # at most 2**LEVEL_BITS sums per source
        running = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("through", F.sum("n").over(running))
        joined = state.alias("b").join(sums.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")), "left")
        over = F.col("s.through") > F.col("b.budget")
        edge = joined.groupBy("b.source", "source_size", "target", "whole", "budget", "bound").agg(
            F.min(F.when(over, F.struct("s.prefix", "s.n", (F.col("s.through") - F.col("s.n")).alias("before")))).alias("e"))
        # no boundary: the budget holds all of them, so the bound is past the last prefix
        past = F.shiftleft(F.col("bound") + 1, LEVEL_BITS)
        spent = F.col("budget") - F.coalesce(F.col("e.before"), F.lit(0))
        if level == LEVELS:  # the last boundary is taken whole where that comes nearer
            take = (F.col("e.n") <= 2 * spent).cast("bigint")
            bound = F.when(F.col("e").isNull(), past).otherwise(F.col("e.prefix") + take)
        else:
            bound = F.when(F.col("e").isNull(), past).otherwise(F.col("e.prefix"))
        state = saved(edge.select("source", "source_size", "target", "whole", F.when(F.col("e").isNull(), F.lit(0.0)).otherwise(spent).alias("budget"),
                                  bound.alias("bound")), "mix-level")
    return state.select("source", "source_size", "target", "whole", "bound")


def mix_thresholds(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: float = 3.0, key: str = "doc_id",
                   text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows: key, source, size, h; thresholds per source) of a table of documents."""
    rows = saved(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"),
                             key_hash(key).alias("h")), "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return rows, thresholds(rows, targets(sources, weights, max_repeat))


def key_hash(key: str) -> Column:
    return F.xxhash64(F.lit("mix"), F.col(key))


def copies(bounds: DataFrame) -> Column:
    extra = (_prefix(LEVELS) < bounds["bound"]).cast("bigint")
    return bounds["whole"] + extra


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: float = 3.0, key: str = "doc_id",
                text: str = "text", source: str = "source") -> DataFrame:
    """How often the mix takes each document: key, source, size, source_size, target, copies, taken.

    ``size`` is the number of words (null text: 0); ``taken`` is copies times
    size, and at most ``max_repeat`` times it.  The choice depends on the key's
    hash only, so reruns agree, and rows that repeat a key are taken alike.
    Null sources are one source, the last; null keys share one hash.  Sources
    without words get target 0 and no copies.  An empty table gives no rows.
    """
    rows, bounds = mix_thresholds(docs, weights, max_repeat, key, text, source)
    joined = rows.join(bounds, rows["source"].eqNullSafe(bounds["source"]))
    n = copies(bounds)
    return joined.select("key", rows["source"], "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: float = 3.0, key: str = "doc_id",
              text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns."""
    _, bounds = mix_thresholds(docs, weights, max_repeat, key, text, source)
    at = {c: free_name(docs, f"_mix_{c}") for c in (*bounds.columns, "h", "n", "copy")}
    bounds = bounds.select(*[F.col(c).alias(at[c]) for c in bounds.columns])
    n = F.col(at["whole"]) + (_prefix(LEVELS, at["h"]) < F.col(at["bound"])).cast("bigint")
    wanted = docs.withColumn(at["h"], key_hash(key))
    taken = (wanted.join(bounds, wanted[source].cast("string").eqNullSafe(bounds[at["source"]]))
             .withColumn(at["n"], n).filter(F.col(at["n"]) > 0))
    copied = taken.withColumn(at["copy"], F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(at["n"]))))
    return copied.drop(*at.values())
