"""Personal data: pattern matches, and identifiers found by bootstrapped contexts.

DataFrame functions only.  Matches of the base patterns are seeds.  The words in
front of a seed are its lexical pattern.  Patterns and the identifier-like
strings behind them form a graph: a pattern is as good as the share of its
strings that are good, a string as good as the patterns it follows, and a few
rounds spread the scores.  Good patterns then find identifiers that no base
pattern knows; these bring in the other patterns they follow, and so on until no
pattern is added.

The texts are read once.  The graph has one edge per pattern and string, summed
before the exchange, and only patterns that several known identifiers follow
are in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.native_spans import SPANS, as_spans, count_of, joined, with_matches
from chartloom.llm.shared import saved, whole_text

# The base patterns.  Written possessively and with a fixed left edge, they find the same matches in linear time.
KINDS = ("email", "ip", "card", "phone")
EMAIL = "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9](?:[\\x20-]?[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
IP_PARTS = "^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"

#: Strings that may be identifiers: six signs or more with a digit or an at sign.
CANDIDATE = "(?<![^\\x20\\x09-\\x0D])[^\\x20\\x09-\\x0D0-9@]*+[0-9@][^\\x20\\x09-\\x0D]*+"
CANDIDATE_LEAST = 6
#: Signs in front of a span in which its pattern is looked for: two words at most.
CONTEXT = 80
ROUNDS = 3
LEAST_SEEDS = 5
GOOD_PATTERN = 0.8


def passes_luhn(digits: Column) -> Column:
    """Whether a string of digits has the right check digit."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    parts = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(parts, F.lit(0), lambda a, d: a + d) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _named(matches: Column, kind: str) -> Column:
    return F.transform(matches, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m"), F.lit(kind).alias("kind")))


def with_private_data(df: DataFrame, text: str, base: str) -> DataFrame:
    """Add the base spans and ``__matches``: (start, end, m, kind) of them."""
    has_digit = F.rlike(F.col(text), F.lit("[0-9]"))
    for kind, pattern, may in (("email", EMAIL, F.contains(F.col(text), F.lit("@"))), ("ip", IP, has_digit), ("card", CARD, has_digit),
                               ("phone", PHONE, F.contains(F.col(text), F.lit("+")))):
        df = with_matches(df, text, f"__{kind}", pattern, may)
    right = {
        "email": F.col("__email"),
        "ip": F.filter("__ip", lambda x: F.rlike(x["m"], F.lit(IP_PARTS))),
        "card": F.filter("__card", lambda x: F.when(F.length(_digits(x["m"])).between(14, 19), passes_luhn(_digits(x["m"]))).otherwise(F.lit(False))),
        "phone": F.filter("__phone", lambda x: F.length(_digits(x["m"])).between(10, 15)),
    }
    for kind in KINDS:
        df = df.withColumn(f"__{kind}", right[kind])
    df = df.withColumn(base, F.concat(*[as_spans(F.col(f"__{k}"), k, i) for i, k in enumerate(KINDS)]))
    df = df.withColumn("__matches", F.concat(*[_named(F.col(f"__{k}"), k) for k in KINDS]))
    return df.drop(*[f"__{k}" for k in KINDS])


def _pattern(text: Column, start: Column) -> Column:
    """The two words in front of a span, lower case, digits as 0; empty at a text's start."""
    begin = F.greatest(start - CONTEXT, F.lit(0))
    front = F.lower(F.regexp_replace(F.substring(text, begin + 1, start - begin), "[0-9]", "0"))
    return F.regexp_extract(front, "([^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]+[^\\x20\\x09-\\x0D]+)[\\x20\\x09-\\x0D\"'(<\\[]*$", 1)


def occurrences(df: DataFrame, text: str) -> DataFrame:
    """Add ``__seen``: (start, end, value, pattern, kind) of seeds and of other identifier-like strings (kind null)."""
    df = with_matches(df, text, "__candidate", CANDIDATE, F.rlike(F.col(text), F.lit("[0-9@]")))
    known = F.col("__matches")
    others = F.filter("__candidate", lambda x: (F.length(x["m"]) >= CANDIDATE_LEAST)
                      & ~F.exists(known, lambda s: (s["start"] < x["end"]) & (s["end"] > x["start"])))
    row = lambda x, kind: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lower(x["m"]).alias("value"),
                                   _pattern(F.col(text), x["start"]).alias("pattern"), kind.alias("kind"))
    seen = F.concat(F.transform(known, lambda x: row(x, x["kind"])), F.transform(others, lambda x: row(x, F.lit(None).cast("string"))))
    return df.withColumn("__seen", F.filter(seen, lambda x: x["pattern"] != "")).drop("__candidate", "__matches")


def _scores(graph: DataFrame, confidence: DataFrame) -> DataFrame:
    """(value, of, score): a string is good unless every pattern it follows is wrong about it; seeds have 1."""
    values = graph.join(confidence, ["pattern", "of"]).groupBy("value", "of").agg(
        F.max("seed").alias("seed"), (1 - F.exp(F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999)))))).alias("score"))
    return values.select("value", "of", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.col("score")).alias("score"))


def _supported(edges: DataFrame, known: DataFrame, least_seeds: int) -> DataFrame:
    """(pattern, of, seeds, good) of patterns that ``least_seeds`` different seeds or ``known`` strings (value, of, score) of a kind follow."""
    own = edges.filter("kind IS NOT NULL").select("pattern", F.col("kind").alias("of"), F.lit(1.0).alias("score"))
    found = edges.join(known, "value").filter(~F.col("kind").eqNullSafe(F.col("of"))).select("pattern", "of", "score")
    return own.unionByName(found).groupBy("pattern", "of").agg(F.count(F.lit(1)).alias("seeds"), F.sum("score").alias("good")).filter(F.col("seeds") >= least_seeds)


def good_patterns(seen: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, least: float = GOOD_PATTERN) -> DataFrame:
    """(pattern, kind, confidence) of patterns that lead to identifiers of a kind.

    ``seen`` has value, pattern, kind.  Scores are computed per kind, in
    ``rounds`` rounds.  A pattern enters with ``least_seeds`` different seeds of
    a kind, or strings that scored ``least`` before; then all are scored again
    from the shares they entered with, until no pattern is added.
    """
    edges = saved(seen.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "pii-edges")
    spark = edges.sparkSession
    added = _supported(edges, spark.createDataFrame([], "value string, of string, score double"), least_seeds)
    support = graph = None
    while True:
        size = edges.join(added.select("pattern").distinct(), "pattern").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
        added = saved(added.join(size, "pattern").select("pattern", "of", "n", (F.col("good") / F.col("n")).alias("confidence")), "pii-support")
        if support is not None and added.isEmpty():
            break
        more = edges.join(added, "pattern").select("pattern", "value", "of", "n", (F.col("kind").eqNullSafe(F.col("of"))).alias("seed"))
        support = added if support is None else saved(support.unionByName(added), "pii-support")
        graph = saved(more if graph is None else graph.unionByName(more), "pii-graph")
        confidence = support.select("pattern", "of", "confidence")
        for _ in range(rounds):
            confidence = saved(graph.join(_scores(graph, confidence), ["value", "of"]).groupBy("pattern", "of").agg((F.sum("score") / F.max("n")).alias("confidence")), "pii-confidence")
        known = saved(_scores(graph, confidence).filter(F.col("score") >= least), "pii-known")
        added = _supported(edges, known, least_seeds).join(support.select("pattern", "of"), ["pattern", "of"], "left_anti")
    return confidence.filter(F.col("confidence") >= least).select("pattern", F.col("of").alias("kind"), "confidence")


def find_private_data(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS,
                      least: float = GOOD_PATTERN) -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, n_context, base_sha256, spans of every document.

    Spans found by context have kind ``context_`` and the kind.  Null and empty
    texts have no spans; repeated rows and null keys each give their row; an
    empty table gives none.  The contexts of all documents are counted.
    """
    df = docs.select(F.col(key).cast("bigint").alias("key"), whole_text(text).alias("text"))
    df = occurrences(with_private_data(df, "text", "base"), "text")
    rows = saved(df.select("key", F.xxhash64("text").alias("print"), "base", F.col("__seen").alias("seen")), "pii-rows")
    seen = rows.select("key", "print", F.explode("seen").alias("x")).select("key", "print", "x.*")
    patterns = good_patterns(seen, rounds, least_seeds, least)
    new = (seen.filter(F.col("kind").isNull()).drop("kind").join(patterns, "pattern")
           .groupBy("key", "print", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("best"))
           .groupBy("key", "print").agg(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.concat(F.lit("context_"), "best.kind").alias("kind"))).alias("extra")))
    both = rows.alias("r").join(new.alias("n"), F.col("r.key").eqNullSafe(F.col("n.key")) & (F.col("r.print") == F.col("n.print")), "left")
    extra = F.coalesce(F.col("n.extra").cast(SPANS), F.array().cast(SPANS))
    count = [count_of(F.col("r.base"), k).alias(f"n_{k}") for k in KINDS]
    return both.select(F.col("r.key").alias("key"), *count, F.size(extra).cast("bigint").alias("n_context"),
                       F.sha2(joined(F.col("r.base")), 256).alias("base_sha256"), joined(F.concat("r.base", extra)).alias("spans"))
