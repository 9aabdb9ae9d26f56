"""Writing metrics and events."""

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netspark.functions import net
from netspark.operators.prefix import bounded
from netspark.session import cut, settings, work_dir


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


#: A table is written in so many steps at most, a step for each SLICE_ROWS rows: the rows of one step are in shuffle files at a time.
SLICES, SLICE_ROWS = 8, 10_000_000
#: The shuffle files of a write go when it ends, and not when the driver happens to collect its garbage.
SHUFFLES_DROPPED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def store(rows: DataFrame, path: str) -> DataFrame:
    """Write rows as a table to be read several times: a tenth of the room of a checkpoint or of kept rows."""
    with settings(rows.sparkSession, SHUFFLES_DROPPED):
        rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_metrics(metrics: DataFrame, path: str, stored: bool = False) -> None:
    """Write metric rows, one folder per day and hour.

    Only the windows present are replaced, so a repeated run gives the same
    table and a run over part of an hour leaves the other windows: what the
    hours that are written hold of them is written again.  Two runs over one
    hour must not overlap.  A folder holds many windows, as a month has 86,400
    of them; its rows are sorted by window.  The rebalance splits an hour that
    is too large for one task and joins small ones.

    The rows are read several times; unless they are `stored`, that is read
    from files, they are written to the work folder for the time of the run.
    Large tables are written in steps of some hours each, so a run that failed
    may have replaced some hours; repeated, it gives the same table.
    """
    spark = metrics.sparkSession
    stage = None if stored else f"{work_dir(spark)}/{spark.sparkContext.applicationId}/metrics-{uuid4().hex}"
    rows = store(metrics, stage) if stage else metrics
    try:
        with settings(spark, SHUFFLES_DROPPED):
            _write_hours(rows, path)
    finally:
        if stage:
            _drop(spark, stage)


def _write_hours(rows: DataFrame, path: str) -> None:
    spark, slices = rows.sparkSession, min(SLICES, 1 + rows.count() // SLICE_ROWS)
    at = net.as_timestamp("window_us")
    # An hour is in one step, whatever the time zone makes of its windows.
    step = F.pmod(F.hash("day", "hour"), F.lit(slices))
    rows = rows.withColumns({"day": F.date_format(at, "yyyy-MM-dd"), "hour": F.hour(at)})
    seen = None
    if _written(spark, path) is not None:
        seen = cut(rows.select("window_us", "day", "hour").distinct())
        first, last = seen.agg(F.min("day"), F.max("day")).first()
    for i in range(slices):
        part = rows.filter(step == i)
        if seen is not None:
            windows = seen.filter(step == i).select(*[F.col(c).alias(f"_{c}") for c in seen.columns])
            here = F.col("day").eqNullSafe(F.col("_day")) & F.col("hour").eqNullSafe(F.col("_hour"))
            # Listed anew, as a step replaces files.  They are read before the step's folders are replaced.
            old = _written(spark, path).withColumns({"day": F.col("day").cast("string"), "hour": F.col("hour").cast("int")})
            old = old.filter((step == i) & (F.col("day").between(first, last) | F.col("day").isNull()))
            kept = (old.join(bounded(windows.select("_day", "_hour").distinct()), here, "left_semi")
                    .join(bounded(windows), F.col("window_us").eqNullSafe(F.col("_window_us")), "left_anti"))
            part = part.unionByName(kept, allowMissingColumns=True)
        (part.hint("rebalance", "day", "hour").sortWithinPartitions("day", "hour", "window_us")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "hour").parquet(path))


def write_events(events: DataFrame, path: str, run: str) -> None:
    """Write the events of a run, one folder per event code, day and run.

    `run` names the input (an hour, a batch id).  A repeated run replaces its
    own folders and no others, so its rows stand there once.
    """
    rows = events.withColumns({"day": F.date_format(net.as_timestamp("at_us"), "yyyy-MM-dd"), "run": F.lit(run)})
    (rows.hint("rebalance", "event_code", "day")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_code", "day", "run").parquet(path))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)
