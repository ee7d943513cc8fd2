"""Secret scans: pattern matches, and windows of high entropy in candidate strings.

DataFrame functions only, one projection over the texts, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.native_spans import as_spans, count_of, joined, masked, with_matches
from chartloom.llm.shared import whole_text

# The base patterns and the least length of each (of group 2 for assign).
KINDS = ("assign", "access", "hex")
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: Candidate strings of the entropy scan and its window.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Character classes, narrowest first, each with its pattern and the bits that a window of such a candidate needs.
CLASSES = (
    ("hex", "^(?:[0-9a-f]++|[0-9A-F]++)$", 2.9),
    ("lower", "^[a-z0-9]++$", 3.6),
    ("upper", "^[A-Z0-9]++$", 3.6),
    ("letters", "^[A-Za-z]++$", 3.7),
    ("alphanumeric", "^[A-Za-z0-9]++$", 3.7),
    ("base64", "", 3.7),
)
LEAST_BITS = {name: bits for name, _, bits in CLASSES}
#: A part of a compound: a word in one case or capitalised, words run together, a word with a short number, a short number with a unit, a number.
_PART = "(?:[A-Z]?[a-z]++|[A-Z]++|[a-z]*+(?:[A-Z]++[a-z]{2,}+)++[A-Z]*+|[A-Za-z]{2,16}+[0-9]{1,4}+|[0-9]{1,4}+[A-Za-z]{1,3}+|[0-9]{1,8}+)"
#: Candidates that are never secrets (possessive groups, which need no stack on long candidates): paths, names and other compounds of such parts, numbers, and identifiers with a known form.
ALLOW = (
    "^[0-9]++(?:[-/_=+][0-9]++)*+$",
    f"^[-/_=+]*+(?:{_PART}(?![A-Za-z0-9])[-/_=+]*+)*+$",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)


def highest_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of any window of a string.

    The state holds a count for each different sign of the string.  The window
    slides by one sign: the count of the sign that leaves falls by one, that of
    the sign that enters rises by one, and the sum of n * log2(n), from which
    the entropy follows, changes by these two terms only.
    """
    signs = F.split(candidate, "")
    slots = F.transform(signs, lambda x: F.array_position(F.array_distinct(signs), x).cast("int"))
    weights = F.transform(F.sequence(F.lit(0), F.lit(window)), lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0)))

    def weight(state, n):
        return F.get(state["weights"], n)

    def changed(counts, slot, by):
        return F.concat(F.slice(counts, F.lit(1), slot - 1), F.array(F.get(counts, slot - 1) + by),
                        F.slice(counts, slot + 1, F.size(counts) - slot))

    def leave(state, i):
        slot = F.get(state["slots"], F.greatest(i - window, F.lit(1)) - 1)
        n = F.get(state["counts"], slot - 1)
        return F.when(i > window, F.struct(changed(state["counts"], slot, -1).alias("counts"), (weight(state, n - 1) - weight(state, n)).alias("change"))).otherwise(
            F.struct(state["counts"].alias("counts"), F.lit(0.0).alias("change")))

    def enter(state, left, i):
        slot = F.get(state["slots"], i - 1)
        n = F.get(left["counts"], slot - 1)
        total = state["total"] + left["change"] + weight(state, n + 1) - weight(state, n)
        bits = F.when(i >= window, F.log2(F.lit(float(window))) - total / window).otherwise(F.lit(0.0))
        return F.struct(state["slots"].alias("slots"), state["weights"].alias("weights"), changed(left["counts"], slot, 1).alias("counts"),
                        total.alias("total"), F.greatest(state["best"], bits).alias("best"))

    def step(state, i):
        # a lambda over one element keeps the counts after leaving, so that they are worked out once
        return F.get(F.transform(F.array(leave(state, i)), lambda left: enter(state, left, i)), 0)

    zero = F.struct(slots.alias("slots"), weights.alias("weights"), F.array_repeat(F.lit(0), F.size(F.array_distinct(signs))).alias("counts"),
                    F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    return F.aggregate(F.sequence(F.lit(1), F.length(candidate)), zero, step, lambda s: s["best"])


def with_secrets(df: DataFrame, text: str, base: str, extra: str, window: int = WINDOW, least_bits: dict[str, float] | None = None,
                 allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Add two span columns: ``base`` by the patterns, ``extra`` by entropy (kind ``entropy``).

    A candidate is a span if no rule of ``allow`` matches it and one of its
    windows has the bits that its character class needs (``least_bits`` may
    change some of ``LEAST_BITS``).
    """
    bits = LEAST_BITS | (least_bits or {})
    for kind, pattern, may in (("assign", ASSIGN, None), ("access", ACCESS, F.contains(F.col(text), F.lit("AKIA"))), ("hex", HEX, None), ("candidate", CANDIDATE, None)):
        df = with_matches(df, text, f"__{kind}", pattern, may)
    long_ = F.filter("__assign", lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= ASSIGN_LEAST)
    access = F.filter("__access", lambda x: F.length(x["m"]) >= ACCESS_LEAST)
    df = df.withColumn(base, F.concat(as_spans(long_, "assign", 0), as_spans(access, "access", 1), as_spans(F.col("__hex"), "hex", 2)))

    def suspicious(x):
        allowed = F.lit(False)
        for rule in allow:
            allowed = allowed | F.rlike(x["m"], F.lit(rule))
        least = F.lit(bits["base64"])
        for name, pattern, _ in reversed(CLASSES[:-1]):
            least = F.when(F.rlike(x["m"], F.lit(pattern)), F.lit(bits[name])).otherwise(least)
        return F.when(allowed, F.lit(False)).otherwise(highest_entropy(x["m"], window) >= least)

    df = df.withColumn(extra, F.when(F.size("__candidate") > 0, as_spans(F.filter("__candidate", suspicious), "entropy", 3))
                       .otherwise(as_spans(F.col("__candidate"), "entropy", 3)))
    return df.drop("__assign", "__access", "__hex", "__candidate")


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, n_entropy, base_sha256, spans of every document.

    Null and empty texts have no spans (the digest is that of the empty string).
    Repeated rows and null keys each give their row; an empty table gives none.
    """
    df = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    df = with_secrets(df, "text", "base", "extra")
    count = [count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return df.select("key", *count, F.size("extra").cast("bigint").alias("n_entropy"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                     joined(F.concat("base", "extra")).alias("spans"))


def mask_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", length: str | None = "n_chars") -> DataFrame:
    """The documents with every secret replaced by ``mark``; other documents and null texts stay as they are.

    ``length``, where there is such a column, is set anew for changed texts.
    """
    # the whole row travels as one column, so no name of the input meets one of the scan
    df = with_secrets(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), whole_text(text).alias("text")), "text", "base", "extra")
    df = df.withColumn("spans", F.concat("base", "extra"))
    changed = F.size("spans") > 0
    new = F.when(changed, masked(F.col("text"), F.col("spans"), mark)).otherwise(F.col("row")[text])
    df = df.select("row", new.alias("new"), changed.alias("changed"))
    out = {c: F.col("row")[c] for c in docs.columns}
    out[text] = F.col("new")
    if length and length in docs.columns:
        out[length] = F.when(F.col("changed"), F.length("new").cast(docs.schema[length].dataType)).otherwise(out[length])
    return df.select(*[v.alias(c) for c, v in out.items()])
