"""MinHash near-duplicates with sequential Bayesian verification."""

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.llm.common import components, repeated_ids, stage
from netspark.llm.hashing import mixed, shingles, text_words

WIDTH = 5
#: Least similarity, as a fraction.
NUMERATOR, DENOMINATOR = 75, 100
#: A pair of the least similarity shares a band but for (1 - 0.75 ** 7) ** 72 = 3e-5 of the cases.
BANDS, ROWS = 72, 7
#: Signature values compared, how many at a time, and the chance of a true pair lost to pruning at one look.
COMPARED, BATCH, MISS = 256, 32, 1e-6
#: Buckets of up to so many rows are compared as joined pairs, larger ones in blocks; both ways compare all.
SMALL_BUCKET = 8
#: Most rows and shingles of a block where buckets are compared within.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1_000_000


@lru_cache
def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def signature(hashes: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """Least value of each permutation over a set of hashes."""
    a, b = permutations(count)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(count, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 512):
        np.minimum(out, (low[i: i + 512, None] * a + b).min(axis=0), out=out)
    return out


def band_keys(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    keys = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + values.reshape(bands, rows)[:, k])
    return keys.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): n_shingles, two sums that name the set, band keys and signature values of 16 bits."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches):
        for batch in batches:
            cols = [[] for _ in range(5)]
            for words in text_words(batch.column("text")):
                hashes = shingles(words, WIDTH)
                row = (len(hashes), 0, 0, None, None)
                if len(hashes):
                    values = signature(hashes)
                    row = (len(hashes), int(hashes.sum().view(np.int64)), int(mixed(hashes).sum().view(np.int64)),
                           band_keys(values), (values[:COMPARED] & np.uint32(0xFFFF)).astype("<u2").tobytes())
                for c, v in zip(cols, row):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types)]],
                                             names=["doc_id", "n_shingles", "sum_a", "sum_b", "bands", "values"])

    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {key}, n_shingles bigint, sum_a bigint, sum_b bigint, bands array<bigint>, values binary")


@lru_cache
def least_matches(threshold: float = NUMERATOR / DENOMINATOR, miss: float = MISS) -> tuple[int, ...]:
    """For each look, the fewest matches at which the posterior chance of reaching the threshold is at least `miss`.

    With a uniform prior, m matches of n leave Beta(m + 1, n - m + 1); its
    upper tail at t is the chance that n + 1 draws of chance t give at most m.
    """
    out = []
    for n in range(BATCH, COMPARED + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def plausible(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Pairs (a, b) left after comparing signatures batch by batch; values: doc_id, values."""
    key = pairs.schema["a"].dataType.simpleString()

    def compare(batches):
        bounds = least_matches()
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.stack([np.frombuffer(v.as_py(), "<u2") for v in batch.column(c)]) for c in ("va", "vb"))
            alive, matched = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for look, least in enumerate(bounds):
                part = slice(look * BATCH, (look + 1) * BATCH)
                matched[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
                alive = alive[matched[alive] >= least]
            keep = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    a, b = (values.select(F.col("doc_id").alias(x), F.col("values").alias(f"v{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "va", "vb").mapInArrow(compare, f"a {key}, b {key}")


def full_sets(docs: DataFrame) -> DataFrame:
    key = docs.schema["doc_id"].dataType.simpleString()

    def sets(batches):
        for batch in batches:
            out = [shingles(w, WIDTH).tobytes() for w in text_words(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(sets, f"doc_id {key}, hashes binary")


def near_enough(x: np.ndarray, y: np.ndarray) -> bool:
    if min(len(x), len(y)) * DENOMINATOR < NUMERATOR * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs whose full shingle sets are similar enough; docs: doc_id, text of the documents named."""
    key = pairs.schema["a"].dataType.simpleString()

    def check(batches):
        for batch in batches:
            keep = [i for i, (x, y) in enumerate(zip(batch.column("ha"), batch.column("hb")))
                    if near_enough(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))]
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    named = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    full = full_sets(docs.join(named, "doc_id", "left_semi"))
    a, b = (full.select(F.col("doc_id").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ha", "hb").mapInArrow(check, f"a {key}, b {key}")


def similar(pairs: DataFrame, values: DataFrame, docs: DataFrame) -> DataFrame:
    return stage(verified(stage(plausible(pairs, values).distinct(), "plausible"), docs), "links")


def block_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, part): places of the pairs of different components in two blocks of a bucket that their signatures leave.

    Signatures are compared batch by batch as in `plausible`.  A pair that
    shares one of the bands inside the compared values stays only in the first.
    """
    part = np.unique(np.array(table.column("part").to_pylist(), dtype=object), return_inverse=True)[1]
    values = np.stack([np.frombuffer(v.as_buffer(), "<u2") for v in table.column("values")])
    block = np.array(table.column("block"), np.int64)
    pairs = np.triu(part[:, None] != part[None, :], 1)
    if table.column("first")[0] != table.column("second")[0]:
        pairs &= block[:, None] != block[None, :]
    a, b = np.nonzero(pairs)
    matched = np.zeros(len(a), np.int64)
    for look, least in enumerate(least_matches()):
        span = slice(look * BATCH, (look + 1) * BATCH)
        for i in range(0, len(a), 1 << 16):
            c = slice(i, i + (1 << 16))
            matched[c] += (values[a[c], span] == values[b[c], span]).sum(axis=1)
        keep = matched >= least
        a, b, matched = a[keep], b[keep], matched[keep]
    inside, here = COMPARED // ROWS, table.column("band_no")[0].as_py()
    bands = values[:, : inside * ROWS].reshape(len(values), inside, ROWS)
    own = np.ones(len(a), bool)
    for i in range(0, len(a), 4096):
        c = slice(i, i + 4096)
        shared = (bands[a[c]] == bands[b[c]]).all(axis=2)
        own[c] = ~shared.any(axis=1) | (shared.argmax(axis=1) == here)
    return a[own], b[own], part


def involved(table: pa.Table) -> pa.Table:
    """The rows of a block pair that stand in some pair left by the signatures."""
    a, b, _ = block_pairs(table)
    return table.take(pa.array(np.unique(np.concatenate([a, b]))))


def compare_block(table: pa.Table) -> pa.Table:
    """Links in a block pair, verified on the full sets: at most one for each two components."""
    a, b, part = block_pairs(table)
    ids, sets = table.column("doc_id").to_pylist(), table.column("hashes")
    joined, links = set(), []
    for i, j in zip(a.tolist(), b.tolist()):
        if (part[i], part[j]) not in joined and near_enough(*(np.frombuffer(sets[k].as_buffer(), np.uint64) for k in (i, j))):
            joined |= {(part[i], part[j]), (part[j], part[i])}
            links.append((i, j))
    key = table.schema.field("doc_id").type
    return pa.table({"a": pa.array([min(ids[i], ids[j]) for i, j in links], key), "b": pa.array([max(ids[i], ids[j]) for i, j in links], key)})


def across(open_: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Links in buckets that hold several components; open_: band, band_no, doc_id, part; reps: doc_id, n_shingles, values.

    A bucket is dealt into blocks of bounded rows and shingles, and each two
    blocks meet in a task: no pair becomes a row unless it is a link.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    held = stage(open_.join(reps.select("doc_id", "n_shingles", "values"), "doc_id"), "held")
    sized = held.groupBy("band").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_s"))
    sized = sized.select("band", F.greatest(F.ceil(F.col("_n") / BLOCK_ROWS), F.ceil(F.col("_s") / BLOCK_SHINGLES)).cast("int").alias("_blocks"))
    rows = held.join(sized, "band").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.withColumn("first", F.least("block", "_other")).withColumn("second", F.greatest("block", "_other"))
    rows = rows.select("band", "band_no", "doc_id", "part", "block", "first", "second", "values")
    # Signatures first; the full sets, much larger, go only to what they leave.
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    left = stage(rows.groupBy("band", "first", "second").applyInArrow(involved, schema), "involved")
    sets = full_sets(docs.join(left.select("doc_id").distinct(), "doc_id", "left_semi"))
    return left.join(sets, "doc_id").groupBy("band", "first", "second").applyInArrow(compare_block, f"a {key}, b {key}")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents with equal sets form a class first, named by its smallest id.
    Class names are banded.  In each bucket all are compared with the smallest;
    then, in buckets that still hold more than one component, those of
    different components are, block by block where a bucket is large.  So every pair that shares a band
    is either compared or already connected, and rows grow with the members of
    buckets, not with their pairs.

    Null or empty texts have no set: they are their own component.  Rows of
    one id share a component.  A null id names nothing: component null, kept
    true.  Other columns are not read; an empty table gives an empty table.
    """
    own = docs.select("doc_id", "text")
    signed = stage(signatures(own), "signatures")
    name = ["n_shingles", "sum_a", "sum_b"]
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy(*name).agg(F.min("doc_id").alias("rep"))
    # A rep may stand in several rows of one id with different sets; each row's bands count.
    first = usable.join(classes.select("rep", *name).withColumnRenamed("rep", "doc_id"), ["doc_id", *name], "left_semi").select("doc_id", "bands", "values")
    rows = first.select("doc_id", F.posexplode("bands").alias("band_no", "band"))
    crowded = rows.groupBy("band").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("_last")).filter("pivot < _last").drop("_last")
    members = stage(rows.join(crowded, "band"), "buckets")
    values = first.select("doc_id", "values")  # an id with two sets has two rows, and either may make a link
    stars = members.filter("doc_id > pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = similar(stars, values, own)
    found = components(links).withColumnsRenamed({"node": "doc_id", "component": "part"})
    placed = members.join(found, "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
    mixed_buckets = placed.groupBy("band").agg(F.min("part").alias("_a"), F.max("part").alias("_b")).filter("_a < _b").select("band")
    open_ = stage(placed.join(mixed_buckets, "band").select("band", "band_no", "doc_id", "part").distinct(), "open")
    sizes = open_.groupBy("band").agg(F.count(F.lit(1)).alias("_n"))
    small = open_.join(sizes.filter(F.col("_n") <= SMALL_BUCKET).select("band"), "band")
    x, y = small.select("band", F.col("doc_id").alias("a"), F.col("part").alias("_pa")), small.select("band", F.col("doc_id").alias("b"), F.col("part").alias("_pb"))
    links = links.unionByName(similar(x.join(y, "band").filter("a < b AND _pa != _pb").select("a", "b").distinct(), values, own))
    large = open_.join(sizes.filter(F.col("_n") > SMALL_BUCKET).select("band"), "band")
    rep_rows = usable.join(classes.select("rep", *name).withColumnRenamed("rep", "doc_id"), ["doc_id", *name], "left_semi").dropDuplicates(["doc_id", *name])
    links = links.unionByName(stage(across(large, rep_rows, own), "links").distinct())
    same_id = usable.join(classes, name).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = links.unionByName(repeated_ids(same_id))
    found = components(links).withColumnsRenamed({"node": "_node", "component": "_part"})
    out = signed.join(classes, name, "left").withColumn("_node0", F.coalesce("rep", "doc_id"))
    out = out.join(found, F.col("_node0") == F.col("_node"), "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("_part", "_node0")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
