"""Secret scan: base patterns, and sliding-window entropy of candidate strings, all as native expressions."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.llm.spans import let, matches

# The base patterns.  A lower bound inside a pattern gives the same spans as dropping short runs afterwards.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KEYWORD = r"(?i)passw|secret|token|api_?key"

WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Least entropy, in bits, of some window: hexadecimal digits, and the 64 characters of base 64.
HEX_BITS, BASE64_BITS = 3.2, 3.9
#: Strings that are no secrets: placeholders, runs of the alphabet or one character, UUIDs, checksums of lock files.
ALLOWED = (r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|x{6}|0123456789|abcdefgh|(.)\1{5}|^sha(1|256|384|512)-"
           r"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
KINDS = ["assign", "access", "hex", "entropy"]
SPANS = "array<struct<start:bigint,rank:int,end:bigint>>"


def best_window(value: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits per character, over the windows of an ASCII string at least as long as a window.

    Counts are kept in a string of 128 places, one per character, each holding
    the character of code 33 + count; a step changes the place of the one
    that enters and of the one that leaves.  With S the sum of c log2 c over
    the counts, the entropy is log2(window) - S / window.
    """
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])

    def count(counts, code):
        return F.ascii(F.substring(counts, code + 1, F.lit(1))) - 33

    def change(state, code, by):
        c = count(state["counts"], code)
        return F.struct(F.overlay(state["counts"], F.char(c + by + 33), code + 1).alias("counts"),
                        (state["s"] + F.get(terms, c + by) - F.get(terms, c)).alias("s"), state["best"].alias("best"))

    def slide(codes):
        def step(state, i):
            inside = let(change(state, F.get(codes, i), 1), lambda s: F.when(i >= window, let(F.get(codes, i - window), lambda old: change(s, old, -1))).otherwise(s))
            return let(inside, lambda s: F.struct(s["counts"].alias("counts"), s["s"].alias("s"),
                                                  F.when(i >= window - 1, F.greatest(s["best"], F.lit(math.log2(window)) - s["s"] / window)).otherwise(s["best"]).alias("best")))

        start = F.struct(F.lit("!" * 128).alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda s: s["best"])

    return let(F.transform(F.split(value, F.lit("")), F.ascii), slide)


def is_secret(value: Column, window: int = WINDOW) -> Column:
    """Digits and letters together, not on the allow-list, and random enough for the class of its characters."""
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(ALLOWED)
    least = F.when(value.rlike("^[0-9A-Fa-f]+$"), HEX_BITS).otherwise(BASE64_BITS)
    return F.when(mixed, best_window(value, window) >= least).otherwise(False)


def found(text: Column) -> Column:
    """All spans of a text by start, then kind: array of (start, rank of the kind, end).  Null: none."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(SPANS)

    def spans(rank, pattern, gate, keep=None, group=0):
        hits = matches(text, F.lit(pattern), group)
        hits = hits if keep is None else F.filter(hits, lambda m: keep(m["value"]))
        out = F.transform(hits, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))
        return F.when(gate, out).otherwise(none)

    return F.array_sort(F.concat(
        spans(0, ASSIGN, text.rlike(KEYWORD), lambda v: F.length(v) >= 8, 2),
        spans(1, ACCESS, text.contains("AKIA")),
        spans(2, HEX, text.rlike(HEX)),
        spans(3, CANDIDATE, text.rlike(CANDIDATE), is_secret)))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the column _secrets, the spans of `found`.

    Null and empty texts have none; the other columns, null ids and repeated
    rows pass through; an empty table stays empty.  An input column named
    _secrets is replaced.
    """
    return docs.withColumn("_secrets", found(F.col(text)))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by a mark."""
    def step(state, s):
        more = F.concat(F.substring(text, state["at"] + 1, (s["start"] - state["at"]).cast("int")), F.lit(mark))
        # A span that begins inside the last one lengthens it without a second mark.
        return F.struct(F.when(s["start"] >= state["at"], F.array_append(state["parts"], more)).otherwise(state["parts"]).alias("parts"),
                        F.greatest(state["at"], s["end"].cast("int")).alias("at"))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))
    done = F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
