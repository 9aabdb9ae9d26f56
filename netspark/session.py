"""Session settings for tests and local runs."""

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkConf
from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cpus: int | str = 8, name: str = "netspark") -> SparkSession:
    """One-machine session for tests and bench; a cluster brings its own."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
               .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false"))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if not SparkConf().get("spark.checkpoint.dir"):
        builder = builder.config("spark.checkpoint.dir", os.path.join(tempfile.gettempdir(), "netspark-work"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside only; a stream keeps those it was started with."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    It is named in spark.checkpoint.dir and nowhere else; `local_session` sets
    one for tests where none is set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return path


def cut(df):
    """Checkpoint a table: its rows go to the shared folder and its plan starts there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(work_dir(df.sparkSession))
    return df.checkpoint()


def with_scheme(spark: SparkSession, path: str) -> str:
    """A plain path in the shared folder with the scheme by which Spark finds that folder, so that every process opens the same one."""
    folder, sc = work_dir(spark).rstrip("/"), spark.sparkContext
    if "://" in path or path.startswith("file:"):
        return path
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    scheme, found, _ = sc.getCheckpointDir().partition(folder)
    return scheme + path if found else path
