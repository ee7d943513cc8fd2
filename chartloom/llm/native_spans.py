"""Spans of pattern matches by DataFrame functions only.

A span is a struct (start, rank, end, kind): code points, end exclusive; rank is
the place of the kind in its operator's list, so sorting spans sorts by start,
then kind.  Everything is a projection: a text and its spans stay in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matches folded at a time; positions cost about BLOCK copies a match, whatever their number.
BLOCK = 128
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def with_matches(df: DataFrame, text: str, name: str, pattern: str, may: Column | None = None) -> DataFrame:
    """Add ``name``: array of (start, end, m) of all leftmost non-overlapping matches.

    The text between the matches and the matches themselves give all offsets.
    Lengths are summed in blocks, and the blocks' sums shift the blocks, so a
    text with very many matches costs no more per match.
    """
    m, p, z, blocks, bases = (f"__{name}_{x}" for x in ("m", "p", "z", "b", "a"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    df = df.withColumn(m, found if may is None else F.when(may, found).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(p, F.when(F.size(m) > 0, F.split(text, pattern, -1)))
    # a column that is read once would be moved into the lambda that reads it and worked out per element
    df = df.withColumn(z, F.when(F.size(p) > 0, F.transform(m, lambda x, i: F.struct(F.length(F.get(F.col(p), i)).alias("gap"), F.length(x).alias("n"), x.alias("m")))))

    def fold(at):
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,m:string>>").alias("out"))
        return F.aggregate(F.slice(F.col(z), at, F.lit(BLOCK)), zero, lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["n"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["n"]).alias("end"), x["m"].alias("m")))).alias("out")))

    df = df.withColumn(blocks, F.when(F.size(z) > 0, F.transform(F.sequence(F.lit(1), F.size(z), F.lit(BLOCK)), fold)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    df = df.withColumn(bases, F.aggregate(blocks, zero, lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))))
    spans = F.flatten(F.transform(blocks, lambda b, i: F.transform(b["out"], lambda s: F.struct(
        (s["start"] + F.get(F.col(bases)["out"], i)).alias("start"), (s["end"] + F.get(F.col(bases)["out"], i)).alias("end"), s["m"].alias("m")))))
    df = df.withColumn(name, F.coalesce(spans, F.array().cast("array<struct<start:int,end:int,m:string>>")))
    return df.drop(m, p, z, blocks, bases)


def as_spans(matches: Column, kind: str | Column, rank: int | Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    rank = F.lit(rank) if isinstance(rank, int) else rank
    return F.transform(matches, lambda x: F.struct(x["start"].alias("start"), rank.alias("rank"), x["end"].alias("end"), kind.alias("kind"))).cast(SPANS)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def joined(spans: Column) -> Column:
    """kind:start:end of all spans by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, mark: str) -> Column:
    """The text with every span replaced by ``mark``; overlapping spans count as one."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    cut = F.aggregate(F.array_sort(spans), zero, lambda a, s: F.struct(
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out"),
        F.greatest(a["at"], s["end"]).alias("at")))
    whole = F.concat(cut["out"], F.substring(text, cut["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
