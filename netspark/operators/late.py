"""Packets that arrive behind the newest time seen."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.operators.prefix import Prior, with_priors

RECORD_SLICE = 1 << 20


def newest_time(packets: DataFrame, order: str = "packet_id", keys: list[str] | None = None) -> DataFrame:
    """Time each packet counts at when time never goes back in `order`.

    The whole capture is one sequence; it is cut into slices of records, so
    only one row per slice meets in a single task.
    """
    packets = packets if keys else packets.withColumn("_all", F.lit(0))
    slice_ = F.floor(F.col(order) / RECORD_SLICE)
    rows = with_priors(packets, keys or ["_all"], [order], slice_, [Prior("_newest", "max", F.col("ts_us"))], divided=True)
    rows = rows.withColumns({"account_us": F.greatest("ts_us", "_newest"),
                             "late": F.coalesce(F.col("_newest") > F.col("ts_us"), F.lit(False))})
    return rows.drop("_newest") if keys else rows.drop("_newest", "_all")
