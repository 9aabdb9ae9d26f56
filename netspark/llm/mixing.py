"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netspark.llm.common import WORD, running_sums, stage

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
BLOCK_WORDS = 512
#: Slots of the schedule per slice when ranks are counted.
SLICE_SLOTS = 1 << 16
#: Tasks for the table of sources, one row each.
PARTS = 8
GOLDEN = 0.6180339887498949


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source of `sized` (source, size): source_size, weight, target, and low/high, its part of [0, 1).

    Sources in code-point order, null last, take the weights in turn.  The mix
    is as large as all sizes; a target stops at `most` times its source, and
    the excess goes to the others by weight.  In order of room per weight the
    sources that stop are a first part, so one ordered scan finds the level.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_sums(per, [F.col("source")], {"place": F.lit(1)}, "sources", PARTS)
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", pick).withColumn("room", F.col("source_size") * most)
    ranked = running_sums(ranked, [F.col("room") / F.col("weight"), F.col("place")],
                          {"room_before": F.col("room"), "weight_before": F.col("weight")}, "sources", PARTS)
    ranked = stage(ranked, "sources", PARTS)
    # Two single rows of totals: the sizes and weights of all, and the level of the first source that does not stop.
    all_size, all_weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(all_size) - F.col("room_before")) / (F.lit(all_weight) - F.col("weight_before"))
    leveled = ranked.withColumn("stops", level * F.col("weight") >= F.col("room"))
    final = leveled.filter("not stops").agg(F.min_by(level, F.struct(F.col("room") / F.col("weight"), "place"))).first()[0]
    out = leveled.withColumn("_level", F.lit(final).cast("double"))
    out = out.withColumn("target", F.when(F.col("stops") | F.col("_level").isNull(), F.col("room").cast("double"))
                         .otherwise(F.least(F.col("room").cast("double"), F.col("_level") * F.col("weight"))))
    out = out.withColumn("wanted", F.floor(F.col("target") + 0.5).cast("bigint")).drop("stops", "_level", "room_before", "weight_before")
    return stage(out, "targets", PARTS)


def streams(sized: DataFrame) -> DataFrame:
    """Add `begin`: words before a document in its source's shuffled stream (md5 of the id orders it).

    The order is cut into 4096 slices of the hash, so no task holds a source.
    """
    df = sized.withColumn("_h", F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")))
    df = df.withColumn("_slice", F.substring("_h", 1, 3))
    across = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = df.groupBy("source", "_slice").agg(F.sum("size").alias("_n"))
    slices = slices.select(F.col("source").alias("_src"), F.col("_slice").alias("_sl"), F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    within = Window.partitionBy("source", "_slice").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    df = df.join(slices, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_slice") == F.col("_sl")))
    return df.withColumn("begin", (F.col("_before") + F.col("_within")).cast("bigint")).drop("_h", "_slice", "_within", "_before", "_src", "_sl")


def schedule(targets: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Slots (slot, source, rank): golden-ratio points through the cumulative targets, ranked per source.

    A source has ceil(wanted / block) slots.  What the points give beyond that
    is left out; the few they do not reach follow behind the last point.
    """
    spark = targets.sparkSession
    wide = running_sums(targets.filter("wanted > 0"), [F.col("place")], {"low_words": F.col("wanted")}, "intervals", PARTS)
    wide = stage(wide.withColumn("needs", F.ceil(F.col("wanted") / block).cast("bigint")), "intervals", PARTS)
    words, count = wide.agg(F.sum("wanted"), F.count(F.lit(1))).first()
    slots, cells = -(-(words or 0) // block), 1 << max(6, (count or 1).bit_length())
    low, high = F.col("low_words") / F.lit(float(words or 1)), (F.col("low_words") + F.col("wanted")) / F.lit(float(words or 1))
    # Each source lies in the cells of [0, 1) that its part covers, so points meet sources by an equality join of any size.
    first, last = F.floor(low * cells), F.least(F.floor(high * cells), F.lit(cells - 1))
    parts = wide.select("source", "needs", low.alias("low"), high.alias("high"), F.explode(F.sequence(first, F.greatest(first, last))).alias("cell"))
    # frac(t * golden) with t in two halves, so that precision does not fall with t.
    t_high, t_low, step = F.floor(F.col("id") / (1 << 20)), F.col("id") % (1 << 20), (GOLDEN * (1 << 20)) % 1.0
    point = t_high * step % 1.0 + t_low * GOLDEN
    points = spark.range(slots).withColumn("point", point - F.floor(point)).withColumn("cell", F.floor(F.col("point") * cells))
    hits = points.join(parts, "cell").filter("point >= low and point < high").select(F.col("id").alias("slot"), "source", "needs")
    hits = hits.withColumn("_slice", F.floor(F.col("slot") / SLICE_SLOTS))
    across = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = hits.groupBy("source", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    slices = slices.select(F.col("source").alias("_src"), F.col("_slice").alias("_sl"), F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_below"))
    within = F.row_number().over(Window.partitionBy("source", "_slice").orderBy("slot")) - 1
    ranked = (hits.withColumn("_within", within).join(slices, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_slice") == F.col("_sl")))
              .withColumn("rank", (F.col("_below") + F.col("_within")).cast("bigint")).filter("rank < needs").select("slot", "source", "rank"))
    got = hits.groupBy(F.col("source").alias("_src")).agg(F.count(F.lit(1)).alias("_got"))
    short = wide.join(got, F.col("source").eqNullSafe(F.col("_src")), "left").withColumn("_got", F.coalesce("_got", F.lit(0))).filter("_got < needs")
    tail = short.select("source", F.explode(F.sequence(F.col("_got"), F.col("needs") - 1)).alias("rank"), "_got")
    return ranked.unionByName(tail.select((F.lit(slots) + F.col("rank") - F.col("_got")).cast("bigint").alias("slot"), "source", "rank"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, block: int = BLOCK_WORDS, extra: tuple = ()):
    """Mix `docs` (doc_id, text, source) to target weights.

    Returns (sized, targets, pieces).  `sized`: doc_id, source, size, begin, and the columns `extra`.
    `pieces`: slot, source, begin, epoch, start, length: in slot order, which
    words of which document (named by source and begin) the mix takes.  A
    source's stream is repeated in epochs; block r is words
    [r * block, (r + 1) * block) of it, and the last stops at the target.

    Null text or text without words: size 0, never taken.  Null source: a source
    of its own, last.  Null ids sort first in their source.  Equal rows are
    taken one behind the other.  An empty table gives empty tables.
    """
    own = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), *extra)
    sized = streams(stage(own, "sizes"))
    targets = source_targets(sized, weights, most)
    plan = schedule(targets, block)
    t = targets.select(F.col("source").alias("_src"), "source_size", "wanted")
    plan = plan.join(t, F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    plan = plan.withColumn("_a", F.col("rank") * block).withColumn("_b", F.least(F.col("_a") + block, F.col("wanted")))
    epochs = F.sequence(F.floor(F.col("_a") / F.col("source_size")), F.floor((F.col("_b") - 1) / F.col("source_size")))
    plan = plan.withColumn("epoch", F.explode(epochs))
    plan = plan.withColumn("_a", F.greatest(F.col("_a") - F.col("epoch") * F.col("source_size"), F.lit(0)))
    plan = plan.withColumn("_b", F.least(F.col("_b") - F.col("epoch") * F.col("source_size"), F.col("source_size")))

    def cells(a, b):
        return F.explode(F.sequence(F.floor(F.col(a) / block), F.floor((F.col(b) - 1) / block)))

    plan = plan.select("slot", F.col("source").alias("_src"), "epoch", "_a", "_b", cells("_a", "_b").alias("_cell"))
    own = sized.filter("size > 0").withColumn("_end", F.col("begin") + F.col("size"))
    own = own.withColumn("cell", cells("begin", "_end"))
    met = own.join(plan, F.col("source").eqNullSafe(F.col("_src")) & (F.col("cell") == F.col("_cell")))
    low = F.greatest(F.col("begin"), F.col("_a"), F.col("cell") * block)
    high = F.least(F.col("_end"), F.col("_b"), (F.col("cell") + 1) * block)
    pieces = met.withColumn("_low", low).withColumn("length", high - low).filter("length > 0")
    return sized, targets, pieces.select("slot", "source", "begin", "epoch", (F.col("_low") - F.col("begin")).alias("start"), "length")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies (epochs in which the mix takes of it)."""
    sized, targets, pieces = mix(docs, **options)
    sums = pieces.groupBy("source", "begin").agg(F.sum("length").alias("taken"), F.max("epoch").alias("last"))
    sums = sums.select(F.col("source").alias("_src"), F.col("begin").alias("_begin"), "taken", (F.col("last") + 1).alias("copies"))
    # Only documents with words have a place of their own in the stream.
    mine = F.when(F.col("size") > 0, F.col("begin"))
    out = sized.join(sums, F.col("source").eqNullSafe(F.col("_src")) & (mine == F.col("_begin")), "left").drop("_src", "_begin")
    t = targets.select(F.col("source").alias("_src"), "source_size", "target")
    out = out.join(t, F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("taken", "copies")})
