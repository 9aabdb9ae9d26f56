"""Places of regex matches as native column expressions."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once, not once per element of a lambda inside."""
    return F.transform(F.array(value), body)[0]


def sums_before(numbers: Column) -> Column:
    """For each number of an array the sum of those before it, by sums of chunks: no step copies the whole array."""
    def total(a):
        return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)

    def chunked(a):
        count = F.size(a)
        chunks = F.transform(F.when(count > 0, F.sequence(F.lit(0), F.floor((count - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>")),
                             lambda c: total(F.slice(a, c * CHUNK + 1, F.lit(CHUNK))))
        return let(chunks, lambda t: F.transform(a, lambda x, i: total(F.slice(t, F.lit(1), F.floor(i / CHUNK).cast("int")))
                                                 + total(F.slice(a, (F.floor(i / CHUNK) * CHUNK + 1).cast("int"), (i % CHUNK).cast("int")))))

    return let(numbers.cast("array<bigint>"), chunked)


def matches(text: Column, pattern: Column, group: int = 0) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, value), in code points, end exclusive; value is the group's text.

    The pieces between matches and the matches come from the same search, so
    their lengths add up to the places.
    """
    def build(hits):
        pieces = F.split(text, pattern, F.lit(-1))
        gaps = F.transform(F.slice(pieces, F.lit(1), F.size(hits)), lambda p: F.length(p).cast("bigint"))
        steps = F.zip_with(gaps, hits, lambda g, h: g + F.length(h))
        values = hits if group == 0 else F.regexp_extract_all(text, pattern, F.lit(group))
        ends = let(steps, lambda s: F.zip_with(sums_before(s), s, lambda b, x: b + x))
        # An end less the match's length is its start.
        spans = F.zip_with(ends, hits, lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end")))
        return F.zip_with(spans, values, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value")))

    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda hits: F.when(F.size(hits) > 0, build(hits)).otherwise(empty))
