"""Embedding near-duplicates by a forest of random-projection trees with spill."""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.llm.common import components, discard, repeated_ids, stage

LEAST_COSINE = 0.98
TREES = 8
LEAF_ROWS, BLOCK_ROWS = 128, 1024
#: Half-width of the spill band, in standard deviations of the projected difference of a pair at the least cosine.
SPILL = 0.5
#: Levels beyond those that halving needs.
MORE_LEVELS = 4


def spill_width(dim: int, cosine: float = LEAST_COSINE) -> float:
    return SPILL * math.sqrt(2 * (1 - cosine) / dim)


def directions(trees: int, levels: int, dim: int) -> np.ndarray:
    """One random unit direction per tree and level; the nodes of a level differ by their thresholds."""
    rows = np.stack([np.random.default_rng([7, t, level, dim]).standard_normal(dim) for t in range(trees) for level in range(levels)])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable(value) -> np.ndarray | None:
    if value is None or None in value or not len(value):
        return None
    x = np.array(value, np.float64)
    return x if np.isfinite(x).all() and x.any() and np.isfinite(x @ x) and x @ x > 0 else None


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, vector (doubles as bytes) and digest (of label and vector); dim 0 where the row can have no links."""
    key, label = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def read(batches):
        for batch in batches:
            rows = [usable(v) if tag is not None and i is not None else None
                    for v, tag, i in zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist(), batch.column("vec_id").to_pylist())]
            data = [None if x is None else x.tobytes() for x in rows]
            names = [None if d is None else hashlib.md5(repr(tag).encode() + b":" + d).digest() for d, tag in zip(data, batch.column("label").to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("label"), pa.array([0 if x is None else len(x) for x in rows], pa.int32()),
                pa.array(names, pa.binary()), pa.array(data, pa.binary())],
                names=["vec_id", "label", "dim", "digest", "vector"])

    return vectors.select("vec_id", "embedding", "label").mapInArrow(read, f"vec_id {key}, label {label}, dim int, digest binary, vector binary")


def project(reps: DataFrame, trees: int, levels: int) -> DataFrame:
    """Rows rep, label, dim, tree, places: a vector's projections at each level of a tree."""
    label = reps.schema["label"].dataType.simpleString()

    def run(batches):
        cache = {}
        for batch in batches:
            dims = batch.column("dim").to_pylist()
            places = []
            for dim, data in zip(dims, batch.column("vector")):
                if dim not in cache:
                    cache[dim] = directions(trees, levels, dim)
                x = np.frombuffer(data.as_buffer(), np.float64)
                places.append((cache[dim] @ (x / np.linalg.norm(x))).reshape(trees, levels).astype(np.float32))
            take = pa.array(np.repeat(np.arange(len(dims)), trees))
            flat = pa.array([row for p in places for row in p], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in ("rep", "label", "dim")],
                                              pa.array(np.tile(np.arange(trees, dtype=np.int32), len(dims))), flat],
                                             names=["rep", "label", "dim", "tree", "places"])

    return reps.select("rep", "label", "dim", "vector").mapInArrow(run, f"rep binary, label {label}, dim int, tree int, places array<float>")


def forest(reps: DataFrame, trees: int = TREES, leaf: int = LEAF_ROWS, cosine: float = LEAST_COSINE) -> DataFrame:
    """Rows rep, leaf: the leaves of every tree that hold a vector, one root per label and dimension.

    A node of more than `leaf` rows splits at its median along the level's
    direction, and rows close to the threshold go to both sides.  Where the
    middle of a node is denser than the band, a dense group stands there; the
    threshold then moves to the widest gap between other quantiles, or the
    node stays whole and is compared in blocks.
    """
    largest = reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    levels = max(1, math.ceil(math.log2(max(largest, 1) / leaf)) + MORE_LEVELS)
    rows = project(reps, trees, levels).withColumn("node", F.lit(1).cast("bigint"))
    rows = stage(rows.withColumn("open", F.lit(True)), "forest")
    root = ["label", "dim", "tree", "node"]
    width = F.lit(SPILL) * F.sqrt(F.lit(2 * (1 - cosine)) / F.col("dim"))
    for level in range(levels):
        place = F.get("places", F.lit(level)).cast("double")
        parts = (rows.filter("open").groupBy(*root).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(place, [0.1, 0.3, 0.4, 0.5, 0.6, 0.7, 0.9], 1000).alias("q"))
                 .filter(F.col("n") > leaf))
        gaps = [(F.get("q", F.lit(b)) - F.get("q", F.lit(a)), (F.get("q", F.lit(a)) + F.get("q", F.lit(b))) / 2) for a, b in ((0, 1), (1, 3), (3, 5), (5, 6))]
        widest = F.greatest(*[F.struct(g.alias("gap"), m.alias("at")) for g, m in gaps])
        middle = F.get("q", F.lit(4)) - F.get("q", F.lit(2)) >= 2 * width
        parts = parts.withColumn("at", F.when(middle, F.get("q", F.lit(3))).when(widest["gap"] >= 2 * width, widest["at"])).filter(F.col("at").isNotNull()).select(*root, "at")
        parts = stage(parts, "splits", 8)
        if parts.isEmpty():
            break
        met = rows.join(parts, root, "left")
        left, right = F.when(place <= F.col("at") + width, F.col("node") * 2), F.when(place > F.col("at") - width, F.col("node") * 2 + 1)
        child = F.when(F.col("at").isNull(), F.array("node")).otherwise(F.filter(F.array(left, right), lambda c: c.isNotNull()))
        after = met.select("rep", "label", "dim", "tree", "places", F.explode(child).alias("node"), F.col("at").isNotNull().alias("open"))
        after = stage(after, "forest")
        discard(rows)
        rows = after
    return rows.select("rep", F.xxhash64(*root).alias("leaf"))


def compare_leaf(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        x = np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in table.column("vector")])
        lows = np.array(table.column("low").to_pylist(), dtype=object)
        order = np.argsort(lows, kind="stable")
        x, lows = x[order], lows[order]
        reps = table.column("rep").take(pa.array(order))
        sizes = np.array(table.column("size"), np.int64)[order]
        block = np.array(table.column("block"), np.int64)[order]
        first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
        lists = [table.column("leaves")[int(i)].as_py() for i in order]
        own = table.column("leaf")[0].as_py()
        norms = np.sqrt((x * x).sum(axis=1))
        near = np.triu((x @ x.T) / norms[:, None] / norms[None, :] >= cosine, 1)
        if first != second:
            near &= block[:, None] != block[None, :]
        a, b = np.nonzero(near)
        links, part = np.zeros(len(x), np.int64), np.arange(len(x))
        if len(a):
            wide = max(map(len, lists))
            padded = np.array([v + [None] * (wide - len(v)) for v in lists], dtype=object)
            codes = np.unique(np.concatenate([np.array(v, np.int64) for v in lists]))
            mine = np.full(padded.shape, -1, np.int64)
            for i, v in enumerate(lists):
                mine[i, :len(v)] = np.searchsorted(codes, np.array(v, np.int64))
            here = int(np.searchsorted(codes, own))
            # A pair counts in the smallest leaf that its vectors share, so each link counts once over all trees.
            for i in range(0, len(a), 65536):
                u, v = a[i: i + 65536], b[i: i + 65536]
                shared = (mine[u][:, :, None] == mine[v][:, None, :]) & (mine[u] >= 0)[:, :, None]
                least = np.where(shared.any(axis=2), mine[u], len(codes)).min(axis=1)
                counted = least == here
                np.add.at(links, u[counted], sizes[v[counted]])
                np.add.at(links, v[counted], sizes[u[counted]])
            while True:
                low = part.copy()
                np.minimum.at(low, a, part[b])
                np.minimum.at(low, b, part[a])
                low = low[low]
                if (low == part).all():
                    break
                part = low
        some = (links > 0) | (part != np.arange(len(x)))
        ids = table.schema.field("low").type
        return pa.table({"rep": reps.filter(pa.array(some)), "links": pa.array(links[some], pa.int64()),
                         "low": pa.array(list(lows[some]), ids), "part": pa.array(list(lows[part[some]]), ids)})
    return run


def near_vectors(vectors: DataFrame, cosine: float = LEAST_COSINE, trees: int = TREES) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Equal vectors of a label form a class that is compared once and counts as
    often as it has rows.  Leaves are compared whole; a leaf of more than
    BLOCK_ROWS rows is dealt into pairs of blocks, so no task holds more than
    two blocks.  Only sums and one edge per vector leave a leaf, not its pairs.

    A vector that is null, empty or zero, or holds null, NaN or infinity, and
    one with a null label, has no links and is its own component.  A null id
    has component null and is kept.  Rows of one id share a component.  Vectors
    of different lengths are never compared.  An empty table gives an empty table.
    """
    read = stage(valid_vectors(vectors), "vectors")
    able = read.filter("dim > 0")
    classes = stage(able.groupBy("digest").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("size")), "classes")
    # One row per class: its rows are equal but for their ids.
    reps = able.join(classes, (able["digest"] == classes["digest"]) & (able["vec_id"] == classes["low"]), "inner").drop(classes["digest"]).dropDuplicates(["digest"])
    reps = stage(reps.select(F.col("digest").alias("rep"), "low", "label", "dim", "vector", "size"), "reps")
    leaves = stage(forest(reps, trees, cosine=cosine), "leaves")
    mine = leaves.groupBy("rep").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))  # a few per tree
    crowded = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowded = crowded.select("leaf", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    rows = reps.join(mine, "rep").select("rep", "low", "vector", "size", "leaves", F.explode("leaves").alias("leaf")).join(crowded, "leaf")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("first", F.least("block", "_other")).withColumn("second", F.greatest("block", "_other"))
    key = vectors.schema["vec_id"].dataType.simpleString()
    found = rows.select("rep", "low", "vector", "size", "leaves", "leaf", "block", "first", "second").groupBy("leaf", "first", "second").applyInArrow(
        compare_leaf(cosine), f"rep binary, links bigint, low {key}, part {key}")
    found = stage(found, "near")
    sums = found.groupBy(F.col("rep").alias("digest")).agg(F.sum("links").alias("_links"))
    links = found.select(F.col("part").alias("a"), F.col("low").alias("b")).filter("a != b").distinct()
    links = links.unionByName(repeated_ids(able.join(classes, "digest").select(F.col("low").alias("a"), F.col("vec_id").alias("b"))))
    parts = components(links).withColumnsRenamed({"node": "_node", "component": "_part"})
    out = read.drop("vector").join(classes.join(sums, "digest", "left"), "digest", "left").withColumn("_low", F.coalesce("low", "vec_id"))
    out = out.join(parts, F.col("_low") == F.col("_node"), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("_part", "_low"))
    return out.select("vec_id", (F.coalesce("_links", F.lit(0)) + F.coalesce(F.col("size") - 1, F.lit(0))).cast("bigint").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
