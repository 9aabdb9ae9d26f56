"""Flow records: one head and one body row per session."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark import schema as S
from netspark.functions import net
from netspark.operators import flows, tcp

SIDES = (("client", 1), ("server", -1))


def flow_head(flow_packets: DataFrame, handshakes: DataFrame) -> DataFrame:
    """End points, types, VLAN, age and connect time (s) of each session."""
    rows = flow_packets.groupBy(*S.SESSION, "client_ip", "client_port", "server_ip", "server_port").agg(
        F.max("client_mac").alias("client_mac"), F.max("server_mac").alias("server_mac"), F.max("vlan_id").alias("vlan_id"),
        F.max("eth_type").alias("l2_type"), F.min("start_us").alias("start_us"), F.max("ts_us").alias("_last"))
    rows = rows.withColumns({"age_ms": net.to_ms(F.col("_last") - F.col("start_us")), "l3_type": F.col("ip_proto")}).drop("_last")
    return rows.join(handshakes.select(*S.SESSION, net.to_s("connected_us").alias("connect_time")), S.SESSION, "left")


def _by_side(rows: DataFrame, side: str, columns: dict[str, str]) -> DataFrame:
    """Per-side rows as client_ and server_ columns."""
    return rows.select(*S.SESSION, *[F.when(F.col(side) == d, F.col(c)).alias(f"{name}_{to}")
                                     for name, d in SIDES for c, to in columns.items()])


def flow_body(flow_packets: DataFrame, line: DataFrame) -> DataFrame:
    """Traffic, quality, round trips, windows, gaps and turns of each TCP session.

    The parts are stacked and folded by one aggregation on the session key, so
    the record costs one shuffle of small rows and no chain of joins.
    """
    packets = tcp.tcp(flow_packets)
    summary = flows.flow_summary(packets).select(
        *S.SESSION, "expired", *[f"{n}_{c}" for n, _ in SIDES for c in ("pkts", "bytes", "l2_bytes", "aborts")])
    rtt = tcp.flow_rtt(tcp.rtt_samples(line))
    quality = tcp.sequence_exact(line)
    counts = [c for c in quality.columns if c.endswith(("_count", "_bytes"))]
    parts = [summary, _by_side(rtt, "side", {"rtt_sum": "rtt_sum", "rtt_count": "rtt_count", "rtt_mean": "rtt"}),
             _by_side(tcp.flow_windows(packets), "dir", {"zero_windows": "zwnds", "max_window": "max_window"}),
             _by_side(tcp.packet_gaps(packets), "dir", {"min_gap_us": "nagle_us"}),
             _by_side(quality, "side", {c: c for c in counts}), tcp.turns(packets)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    values = [c for c in stacked.columns if c not in S.SESSION]
    return stacked.groupBy(*S.SESSION).agg(*[F.max(c).alias(c) for c in values])
