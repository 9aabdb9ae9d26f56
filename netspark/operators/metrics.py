"""Named metric rows and their text form."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.functions import net
from netspark.operators.nodes import CASTS, NODE, RANKS, total, total_if

METRIC = ["window_us", "level", "mac", "vlan_id", "ip", "metric", "count", "sum", "min", "max"]

# Labels of the split metrics.
L2_LABEL = {"arp": "ARP", "ipv4": "IPV4", "ipv6": "IPV6", "lacp": "LACP", "mpls": "MPLS", "other": "Others"}
L3_LABEL = {"icmp": "ICMP", "tcp": "TCP", "udp": "UDP", "other": "Others"}


def to_metrics(wide: DataFrame, ids: list[str], names: dict[str, str]) -> DataFrame:
    """Long rows (metric, count) of the non-zero columns.  `names` maps column to metric."""
    values = [F.col(column).cast("bigint").alias(metric) for column, metric in names.items()]
    named = wide.select(*ids, *values)
    return (named.unpivot(ids, [F.col(f"`{metric}`") for metric in names.values()], "metric", "count")
            .filter(F.col("count") != 0))


def complete(rows: DataFrame, level: str | None = None) -> DataFrame:
    """Bring rows to the metric layout."""
    for name, value in (("level", F.lit(level)), ("vlan_id", F.lit(0)), ("ip", F.lit(0).cast("bigint"))):
        if name not in rows.columns:
            rows = rows.withColumn(name, value)
    for name in ("sum", "min", "max"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("bigint"))
    return rows.select(*METRIC)


def _link_sums() -> dict[str, Column]:
    """Sums that both levels tell, by metric."""
    packets = F.col("packets")
    return {"l2.frames": total(packets), "l2.bytes": total("bytes"), **{f"l2.frames_{rank}": total_if(F.col("size_rank") == rank, packets) for rank in RANKS}}


def _mac_sums() -> dict[str, Column]:
    packets, bytes_, out = F.col("packets"), F.col("bytes"), {}
    for cast in [c for c in CASTS if c != "stp"]:
        out[f"l2.{cast}_frames"] = total_if(F.col("cast_class") == cast, packets)
        out[f"l2.{cast}_bytes"] = total_if(F.col("cast_class") == cast, bytes_)
    for kind, label in L2_LABEL.items():
        out[f"l2.frames|l2_type|{label}"] = total_if(F.col("l2_type") == kind, packets)
        out[f"l2.bytes|l2_type|{label}"] = total_if(F.col("l2_type") == kind, bytes_)
    out["l2.frames|l2_type|STP"] = total_if(F.col("cast_class") == "stp", packets)
    out["l2.bytes|l2_type|STP"] = total_if(F.col("cast_class") == "stp", bytes_)
    return out


def _ip_sums() -> dict[str, Column]:
    packets, l4 = F.col("packets"), F.col("l4_bytes")
    out = {"l3.pkts": total(packets), "l3.bytes": total("l3_bytes")}
    for kind, label in L3_LABEL.items():
        out[f"l3.pkts|l3_type|{label}"] = total_if(F.col("l3_type") == kind, packets)
        out[f"l3.bytes|l3_type|{label}"] = total_if(F.col("l3_type") == kind, l4)
    for kind in ("tcp", "udp"):
        for side, direction in (("req", 1), ("rsp", -1)):
            cond = (F.col("l3_type") == kind) & (F.col("dir") == direction)
            out[f"{kind}.{side}_pkts"] = total_if(cond, packets)
            out[f"{kind}.{side}_bytes"] = total_if(cond, l4)
    return out


def _numbered(sums: dict[str, Column]) -> tuple[dict[str, str], list[Column]]:
    """Column names with their metrics, and the sums under these names: names of metrics hold dots."""
    return {f"m{i}": metric for i, metric in enumerate(sums)}, [agg.alias(f"m{i}") for i, agg in enumerate(sums.values())]


def l2_metrics(facts: DataFrame) -> DataFrame:
    names, aggs = _numbered(_link_sums() | _mac_sums())
    wide = facts.groupBy("window_us", "mac").agg(*aggs)
    return complete(to_metrics(wide, ["window_us", "mac"], names), "mac")


def l3_metrics(facts: DataFrame) -> DataFrame:
    names, aggs = _numbered(_link_sums() | _ip_sums())
    wide = facts.filter(F.col("ip").isNotNull()).groupBy(*NODE).agg(*aggs)
    return complete(to_metrics(wide, NODE, names), "ip")


def node_sums() -> list[Column]:
    """Sums over the facts of a period, MAC, VLAN and address that tell the metrics of both levels: one row per node."""
    return _numbered(_link_sums() | _mac_sums() | _ip_sums())[1]


def metrics_of_sums(sums: DataFrame) -> DataFrame:
    """Rows of `node_metrics` from rows of `node_sums`, which are not summed anew but for the MACs."""
    names = _numbered(_link_sums() | _mac_sums() | _ip_sums())[0]
    of_mac, of_ip = ({c: m for c, m in names.items() if m in told} for told in (_link_sums() | _mac_sums(), _link_sums() | _ip_sums()))
    macs = sums.groupBy("window_us", "mac").agg(*[total(c).alias(c) for c in of_mac])
    return (complete(to_metrics(macs, ["window_us", "mac"], of_mac), "mac")
            .unionByName(complete(to_metrics(sums.filter(F.col("ip").isNotNull()), NODE, of_ip), "ip")))


def node_metrics(facts: DataFrame) -> DataFrame:
    """Link and network metrics of every node."""
    return l2_metrics(facts).unionByName(l3_metrics(facts))


def service_metrics(services: DataFrame) -> DataFrame:
    """tcp.req_pkts|l4_group|<port> and the like."""
    ids = [*NODE, "server_port"]
    long = to_metrics(services, ids, {c: f"tcp.{c}" for c in ("req_pkts", "req_bytes", "rsp_pkts", "rsp_bytes")})
    port = F.concat(F.col("metric"), F.lit("|l4_group|"), F.col("server_port").cast("string"))
    return complete(long.withColumn("metric", port), "ip")


def connection_metrics(connections: DataFrame) -> DataFrame:
    return complete(to_metrics(connections, NODE, {"connected": "tcp.connected", "closed": "tcp.closed"}), "ip")


def nonzero_metrics(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("count") != 0)


def export_lines(metrics: DataFrame) -> DataFrame:
    """Check lines period|MAC|IP|metric|value; a four-value metric gives four lines."""
    time = net.to_s("window_us").cast("string")
    mac = F.when(F.col("mac") != 0, net.mac_text("mac")).otherwise("")
    ip = F.when(F.col("ip") != 0, net.ip_text("ip")).otherwise("")
    plain = F.array(F.struct(F.col("metric").alias("name"), F.col("count").alias("value")))
    four = F.array(*[F.struct(F.concat(F.col("metric"), F.lit(f".{c}")).alias("name"), F.col(c).alias("value"))
                     for c in ("count", "sum", "max", "min")])
    parts = F.explode(F.when(F.col("sum").isNull(), plain).otherwise(four)).alias("p")
    return (metrics.filter(F.col("count") != 0)
            .select(time.alias("t"), mac.alias("m"), ip.alias("i"), parts)
            .select(F.concat_ws("|", "t", "m", "i", "p.name", F.col("p.value").cast("string")).alias("line")))


def metric_finish(metrics: DataFrame) -> DataFrame:
    """Finish record of each period: how many metric rows it has."""
    return metrics.groupBy("window_us").agg(F.count(F.lit(1)).alias("metric_count"))


def _side_sums(columns: dict[str, tuple[str, int | None]]):
    """Sums of counter columns over one direction (1 sent, -1 received) or both (None)."""
    return [total(column) if side is None else total_if(F.col("dir") == side, column)
            for column, side in columns.values()]


def _app(rows: DataFrame, columns: dict[str, tuple[str, int | None]], rtt: str | None = None, unit: str | None = None) -> DataFrame:
    """Rows of the counters, of the mean round trip `rtt` and of the four values of `unit`, from one sum per node."""
    aggs = [s.alias(f"m{i}") for i, s in enumerate(_side_sums(columns))]
    names = {f"m{i}": metric for i, metric in enumerate(columns)}
    if rtt:
        aggs.append(net.safe_mean(F.sum("rtt_sum"), F.sum("rtt_count")).alias("m_rtt"))
        names["m_rtt"] = rtt
    four = {}
    if unit:
        aggs += [total("rtt_count").alias("u_count"), total("rtt_sum").alias("sum"), F.min("rtt_min").alias("min"), F.max("rtt_max").alias("max")]
        names["u_count"] = unit
        four = {n: F.when(F.col("metric") == unit, F.col(n).cast("bigint")) for n in ("sum", "min", "max")}
    long = to_metrics(rows.groupBy(*NODE).agg(*aggs), [*NODE, *four], names)
    return complete(long.withColumns(four) if unit else long, "ip")


def app_metrics(dns: DataFrame, http: DataFrame, mysql: DataFrame) -> DataFrame:
    """Application rows of the metric catalogue from the per-node application tables."""
    traffic = ("pkts", "bytes", "l2_bytes")
    sides = (("req", 1), ("rsp", -1))
    http_rows = _app(http, {"http.reqs": ("requests", 1), "http.rsps": ("responses", -1), "http.method": ("methods", 1),
                            "http.error": ("errors", -1),
                            **{f"http.{s}_{c}": (c, d) for s, d in sides for c in traffic}}, "http.rtt")
    mysql_rows = _app(mysql, {"mysql.reqs": ("commands", 1), "mysql.blocks": ("blocks", -1),
                              **{f"mysql.{s}_{c}": (c, d) for s, d in sides for c in traffic}}, "mysql.rtt")
    dns_rows = _app(dns, {**{f"dns.{c}": (c, None) for c in ("req_pkts", "req_bytes", "rsp_pkts", "rsp_bytes")},
                          **{f"dns.req_opcodes|dns_opcode|{i}": (f"req_opcode_{i}", -1) for i in range(3)},
                          **{f"dns.rsp_rcodes|dns_rcode|{i}": (f"rsp_rcode_{i}", None) for i in range(6)},
                          "dns.rsp_errors": ("rsp_errors", 1), "dns.req_timeout": ("timeouts", None)}, unit="dns.rtt")
    return http_rows.unionByName(mysql_rows).unionByName(dns_rows)
