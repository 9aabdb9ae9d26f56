"""Chat formatting by a prefix tree: turns that conversations share at their start are emitted once."""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netspark.llm.common import stage
from netspark.llm.spans import sums_before

# The template of a turn: HEAD role SEP text TAIL.
HEAD, SEP, TAIL = "### ", ": ", "</turn>\n"
#: Characters that could begin a control string; each is written behind a backslash in roles and texts.
CONTROL = r"([\\#<:])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def gathered(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, turns (role, text) in order, and names, the chained hash of each beginning.

    A conversation is gathered in one row: it is one sequence in the end.
    """
    key = F.struct(F.coalesce(F.col("turn"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.select("conv_id", key.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    rows = rows.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    hashed = F.transform("turns", lambda t: F.sha2(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]), 256))
    rows = rows.withColumn("_hashes", hashed)
    chain = F.aggregate("_hashes", F.array().cast("array<string>"),
                        lambda done, h: F.array_append(done, F.sha2(F.concat(F.coalesce(F.get(done, F.size(done) - 1), F.lit("")), h), 256)))
    return rows.withColumn("names", chain).drop("_hashes")


def shared_start(a: Column, b: Column) -> Column:
    """Number of leading elements that two arrays have in common."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(a.isNull() | b.isNull(), 0).when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def emitted(leaves: DataFrame) -> DataFrame:
    """Leaves (names, ...) in depth-first order, with `kept`, the turns that the leaf before has already emitted, and `base`, the characters emitted before.

    In order of their chained names the leaves of a tree stand as a walk in
    depth visits them, and what a leaf shares with any earlier one it shares
    with the one just before.  The order is a range partitioning; one row per
    range carries the last leaf and the sum on.
    """
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(leaves.repartitionByRange(parts, "names").withColumn("_range", F.spark_partition_id()), "leaves")
    ranges = Window.orderBy("_range")  # one row per range
    lasts = ranged.groupBy("_range").agg(F.max("names").alias("_last")).select("_range", F.lag("_last").over(ranges).alias("_last"))
    inside = Window.partitionBy("_range").orderBy("names")
    rows = ranged.withColumn("_prev", F.lag("names").over(inside)).join(lasts, "_range")
    rows = rows.withColumn("kept", shared_start(F.coalesce("_prev", "_last"), F.col("names"))).drop("_prev", "_last")
    fresh = F.slice("parts", F.col("kept") + 1, F.greatest(F.size("parts") - F.col("kept"), F.lit(0)))
    rows = stage(rows.withColumn("fresh", fresh).withColumn("_sum", F.aggregate("fresh", F.lit(0).cast("bigint"), lambda t, p: t + F.length(p["formatted"]))), "emitted")
    totals = rows.groupBy("_range").agg(F.sum("_sum").alias("_t"))
    totals = totals.select("_range", F.coalesce(F.sum("_t").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"))
    before = F.coalesce(F.sum("_sum").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_before", before).join(totals, "_range").withColumn("base", F.col("_below") + F.col("_before")).drop("_range", "_sum", "_before", "_below")


def build(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, leaves, conversations) of turns (conv_id, turn, role, text).

    `segments`: one row per distinct beginning, depth first by `begin`: name,
    parent, root, depth, begin and finish (its place in the emitted stream, in
    characters), position (the position id of its first character: the
    characters before it in its conversations), formatted, and mask_from and
    mask_to (the loss mask inside it; equal where none).
    `leaves`: leaf (the last segment of a conversation), steps (the begin of
    each of its segments) and attends (the intervals that these make in the
    stream, neighbours joined).  A character of any segment may attend to the
    intervals of a leaf below it, as far as they stand before it.
    `conversations`: conv_id, leaf and n_turns.

    All tables grow with the turns, also where a conversation is very long.
    Null roles and texts are empty.  Turns sort by number, null first, then
    by role and text, so ties and repeated rows have a fixed order; a null
    conv_id is a conversation.  Other columns are not read.  An empty table
    gives empty tables.
    """
    convs = stage(gathered(turns.select("conv_id", "turn", "role", "text")).withColumn("leaf", F.element_at("names", -1)), "conversations")
    # Equal conversations are merged before the shuffle.
    distinct = convs.groupBy("leaf").agg(F.min("names").alias("names"), F.min("turns").alias("turns"))

    def part(t):
        head, body = F.concat(F.lit(HEAD), escaped(t["role"]), F.lit(SEP)), escaped(t["text"])
        begin = F.length(head).cast("bigint")
        return F.struct(F.concat(head, body, F.lit(TAIL)).alias("formatted"), begin.alias("mask_from"),
                        F.when(t["role"] == "assistant", begin + F.length(body)).otherwise(begin).alias("mask_to"))

    walk = stage(emitted(distinct.select("leaf", "names", F.transform("turns", part).alias("parts"))), "walk")
    lengths = F.transform("parts", lambda p: F.length(p["formatted"]).cast("bigint"))
    fresh_lengths = F.transform("fresh", lambda p: F.length(p["formatted"]).cast("bigint"))
    rows = walk.withColumn("_offsets", sums_before(fresh_lengths)).withColumn("_places", F.slice(sums_before(lengths), F.col("kept") + 1, F.greatest(F.size("fresh"), F.lit(0))))
    zipped = F.arrays_zip(F.col("fresh").alias("p"), F.col("_offsets").alias("o"), F.col("_places").alias("at"), F.slice("names", F.col("kept") + 1, F.size("fresh")).alias("name"),
                          F.when(F.col("kept") > 0, F.slice("names", F.col("kept"), F.size("fresh")))
                          .otherwise(F.concat(F.array(F.lit(None).cast("string")), F.slice("names", F.lit(1), F.size("fresh") - 1))).alias("parent"))
    rows = rows.select(F.get("names", F.lit(0)).alias("root"), "kept", "base", F.posexplode(zipped).alias("i", "z"))
    begin = F.col("base") + F.col("z.o")
    segments = rows.select("z.name", "z.parent", "root", (F.col("kept") + F.col("i")).alias("depth"), begin.alias("begin"),
                           (begin + F.length("z.p.formatted")).alias("finish"), F.col("z.at").alias("position"), "z.p.formatted", "z.p.mask_from", "z.p.mask_to")
    segments = stage(segments, "segments")
    spots = segments.select(F.col("name").alias("_name"), F.struct("depth", "begin", "finish").alias("_spot"))
    steps = walk.select("leaf", F.explode("names").alias("_name")).join(spots, "_name").groupBy("leaf").agg(F.sort_array(F.collect_list("_spot")).alias("_spots"))
    # A step that begins where the one before ends makes no new interval.
    opens = F.filter("_spots", lambda s, i: (i == 0) | (s["begin"] != F.get(F.col("_spots"), i - 1)["finish"]))
    closes = F.filter("_spots", lambda s, i: (i == F.size("_spots") - 1) | (s["finish"] != F.get(F.col("_spots"), i + 1)["begin"]))
    attends = F.zip_with(opens, closes, lambda a, b: F.struct(a["begin"].alias("begin"), b["finish"].alias("finish")))
    leaves = stage(steps.select("leaf", F.transform("_spots", lambda s: s["begin"]).alias("steps"), attends.alias("attends")), "leaves")
    return segments, leaves, convs.select("conv_id", "leaf", F.size("names").cast("bigint").alias("n_turns"))


def read_back(segments: DataFrame, leaves: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted (its text along its leaf's segments) and masked (unescaped texts under the loss mask).

    Leaves are read once however many conversations end in them; a segment
    many leaves share is joined by its place, which adaptive execution splits.
    """
    own = segments.select("begin", F.struct("begin", "formatted", "mask_from", "mask_to").alias("_part"))
    texts = leaves.select("leaf", F.explode("steps").alias("begin")).join(own, "begin").groupBy("leaf").agg(F.sort_array(F.collect_list("_part")).alias("parts"))
    masked = F.transform("parts", lambda p: F.substring(p["formatted"], (p["mask_from"] + 1).cast("int"), (p["mask_to"] - p["mask_from"]).cast("int")))
    texts = texts.select("leaf", F.array_join(F.transform("parts", lambda p: p["formatted"]), "").alias("formatted"), F.transform(masked, unescaped).alias("masked"))
    return conversations.join(texts, "leaf").select("conv_id", "n_turns", "formatted", "masked")


TURN = re.compile(r"### ((?:[^\\:#<]|\\.)*): ((?:[^\\:#<]|\\.)*)</turn>\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        turn = TURN.match(formatted, at)
        out.append(tuple(re.sub(r"\\(.)", r"\1", g, flags=re.S) for g in turn.groups()))
        at = turn.end()
    return out


TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(TURNS)
def parsed(formatted: pd.Series) -> pd.Series:
    return formatted.map(lambda s: [{"role": r, "text": t} for r, t in parse(s)])
