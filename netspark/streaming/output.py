"""Output of micro-batches."""

from pyspark.sql import DataFrame, SparkSession


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Output of one batch in its own folder: a repeated batch replaces itself."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_output(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")
