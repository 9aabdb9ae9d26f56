"""Shared-folder tables, ordered scans and connected components used by the operators of this package."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Only a plain local master, as in tests, may fall back to a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="llm-"))
    return _own_folder[0]


def stage(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, and a lost executor costs a read.

    `files` bounds the number of files (and of the last step's tasks) of a table whose rows are known to be few.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    (df if files is None else df.coalesce(files)).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark, path = df.sparkSession, df._staged_path
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def salts_for(rows: int, per_task: int = 200_000) -> int:
    return max(1, -(-rows // per_task))


def class_rank(df: DataFrame, key: str, order: list[str], salt: Column, salts: int, name: str) -> DataFrame:
    """Add `name`: 0-based rank of a row among the rows of its key.

    With salts > 1 a key's rows are numbered inside (key, salt) and moved up by
    the counts of the lower salts, so a key with a third of all rows is spread.
    """
    if salts == 1:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("bigint"))
    df = df.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    across = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    below = (df.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
             .select(key, "_salt", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_below")))
    within = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order)) - 1
    return (df.withColumn("_within", within).join(below, [key, "_salt"])
            .withColumn(name, (F.col("_below") + F.col("_within")).cast("bigint")).drop("_salt", "_within", "_below"))


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str, parts: int | None = None) -> DataFrame:
    """Add, in one global order, each sum over the rows before a row.

    The rows are dealt by range of the order and written; sums run inside a
    range, and one row per range carries the totals on.  Equal rows stay in one range.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumns({f"_o{i}": c for i, c in enumerate(order)}).withColumns({f"_s_{k}": c for k, c in sums.items()})
    by = [F.col(f"_o{i}").asc_nulls_last() for i in range(len(order))]
    ranged = stage(keyed.repartitionByRange(parts, *by).withColumn("_range", F.spark_partition_id()), name)
    before = Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: as many as there are partitions.
    across = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    totals = ranged.groupBy("_range").agg(*[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums])
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(across), zero).alias(f"_b_{k}") for k in sums])
    out = ranged.withColumns({f"_h_{k}": F.coalesce(F.sum(f"_s_{k}").over(before), zero) for k in sums}).join(totals, "_range")
    out = out.withColumns({k: F.col(f"_b_{k}") + F.col(f"_h_{k}") for k in sums})
    return out.drop("_range", *[f"_o{i}" for i in range(len(order))], *[f"_{x}_{k}" for k in sums for x in "shb"])


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): rows (node, component), component being the smallest node reached.

    Alternating large-star and small-star steps; each result is written, so no
    step depends on lost executors, and nothing but counts reaches the driver.
    A centre with very many neighbours meets partial aggregation and a join
    that adaptive execution splits.
    """
    edges = stage(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def mark(e):
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    state = mark(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A node keeps its link to the smallest neighbour, or the star would lose its centre.
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = stage(small, "edges")
        discard(edges)
        edges, before = after, state
        state = mark(edges)
        if state == before:
            break
    out = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return out.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).distinct()


def repeated_ids(members: DataFrame) -> DataFrame:
    """Links (rep, id) for ids that stand in more than one class; with ids given once there are none."""
    many = members.groupBy("b").agg(F.min("a").alias("_low"), F.max("a").alias("_high")).filter("_low < _high").select("b")
    return members.join(many, "b", "left_semi").filter("a != b").select("a", "b")
