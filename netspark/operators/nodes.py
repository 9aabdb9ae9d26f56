"""Traffic per node, service and protocol."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark import schema as S
from netspark.functions import net

NODE = ["window_us", "mac", "vlan_id", "ip"]
RANKS = [str(n) for n in net.SIZE_RANKS] + ["jumbo"]
L2_TYPES = ["ipv4", "arp", "vlan", "mpls", "lacp", "ipv6", "other"]
L3_TYPES = ["icmp", "tcp", "udp", "other"]
CASTS = ["ucast", "mcast", "bcast", "stp"]


def count() -> Column:
    return F.count(F.lit(1))


def total(value) -> Column:
    return F.coalesce(F.sum(net.col(value).cast("bigint")), F.lit(0))


def total_if(cond, value=None) -> Column:
    value = F.lit(1) if value is None else net.col(value)
    return F.coalesce(F.sum(F.when(cond, value.cast("bigint"))), F.lit(0))


def both_ends(rows: DataFrame, seconds: int = S.PERIOD_S) -> DataFrame:
    """Each row once as sent by its source node (dir 1) and once as received (dir -1).

    The two copies meet the partial aggregation of the same task, so a hot node
    sends one row per task into the shuffle.
    """
    def end(direction, mac, peer, ip):
        return F.struct(F.lit(direction).alias("dir"), F.col(mac).alias("mac"),
                        F.col(peer).alias("peer_mac"), net.node_ip(ip).alias("ip"))
    ends = F.array(end(1, "src_mac", "dst_mac", "src_ip"), end(-1, "dst_mac", "src_mac", "dst_ip"))
    return (rows.withColumn("window_us", net.window_us(seconds))
            .withColumn("_end", F.explode(ends)).select("*", "_end.*").drop("_end"))


# The columns that facts are told by, and those that each report needs.
CLASSES = [*NODE, "dir", "l2_type", "cast_class", "size_rank", "l3_type"]
L2_FACTS = ["window_us", "mac", "dir", "l2_type", "cast_class", "size_rank"]
L3_FACTS = [*NODE, "dir", "l3_type"]


def node_facts(packets: DataFrame, seconds: int = S.PERIOD_S, by: list[str] | None = CLASSES) -> DataFrame:
    """Small table of packets and bytes by period, node and class.

    Every node report is a further sum of this one; the packets are read and
    shuffled once.  A report that needs some of the columns only names them in
    `by`: busy networks have few packets of equal node, class and period, so
    the finest table may be as long as the packets, and what a task holds of it
    grows with its packets and not with the report.  Without `by` each packet's
    end is a fact of its own, for reports that sum them at once: where few
    facts are equal, summing them first costs more than it saves.
    """
    ip = net.is_ipv4()
    whole = ip & (F.col("frag_offset") == 0)
    own_unicast = net.mac_class("mac") == "ucast"
    rows = both_ends(packets, seconds).select(
        "window_us", "mac", F.when(whole, F.col("vlan_id")).alias("vlan_id"),
        F.when(whole, F.col("ip")).alias("ip"), "dir", net.l2_type().alias("l2_type"),
        F.when(own_unicast, net.mac_class("peer_mac")).alias("cast_class"),
        net.size_bucket().alias("size_rank"), F.when(whole, net.l3_type()).alias("l3_type"),
        "wire_len", "l3_len", "l4_len")
    if by is None:
        amounts = [F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(n) for c, n in (("wire_len", "bytes"), ("l3_len", "l3_bytes"), ("l4_len", "l4_bytes"))]
        return rows.select(*CLASSES, F.lit(1).cast("bigint").alias("packets"), *amounts)
    return (rows.groupBy(*by)
            .agg(count().alias("packets"), total("wire_len").alias("bytes"),
                 total("l3_len").alias("l3_bytes"), total("l4_len").alias("l4_bytes")))


def _by_direction(cond, value, name):
    return [total_if(cond & (F.col("dir") == 1), value).alias(f"{name}_out"),
            total_if(cond & (F.col("dir") == -1), value).alias(f"{name}_in")]


def node_l2(facts: DataFrame) -> DataFrame:
    """Per period and MAC: totals with size ranks, by frame type and cast class."""
    always = F.lit(True)
    aggs = _by_direction(always, "packets", "frames") + _by_direction(always, "bytes", "bytes")
    for rank in RANKS:
        aggs.append(total_if(F.col("size_rank") == rank, "packets").alias(f"frames_{rank}"))
    for column, values in (("l2_type", L2_TYPES), ("cast_class", CASTS)):
        for value in values:
            aggs.append(total_if(F.col(column) == value, "packets").alias(f"{value}_frames"))
            aggs.append(total_if(F.col(column) == value, "bytes").alias(f"{value}_bytes"))
    return facts.groupBy("window_us", "mac").agg(*aggs)


def node_l3(facts: DataFrame) -> DataFrame:
    """Per period, MAC, VLAN and address: IPv4 totals and payload by protocol."""
    always = F.lit(True)
    aggs = _by_direction(always, "packets", "packets") + _by_direction(always, "l3_bytes", "bytes")
    for kind in L3_TYPES:
        aggs += _by_direction(F.col("l3_type") == kind, "packets", f"{kind}_packets")
        aggs += _by_direction(F.col("l3_type") == kind, "l4_bytes", f"{kind}_bytes")
    return facts.filter(F.col("ip").isNotNull()).groupBy(*NODE).agg(*aggs)


def node_levels(facts: DataFrame) -> DataFrame:
    """MAC rows and MAC+VLAN+address rows in one result, kept apart by `level`."""
    fine = facts.groupBy(*NODE).agg(total("packets").alias("packets"), total("bytes").alias("bytes"))
    levels = fine.groupingSets(
        [["window_us", "mac"], NODE], *NODE).agg(
        F.when(F.grouping("ip") == 1, "mac").otherwise("ip").alias("level"),
        total("packets").alias("packets"), total("bytes").alias("bytes"))
    return levels.filter((F.col("level") == "mac") | F.col("ip").isNotNull())


def drop_global_nodes(rows: DataFrame, ip: str = "ip") -> DataFrame:
    """Leave out rows of external addresses (0 stands for all of them together)."""
    return rows.filter((F.col(ip) == 0) | net.local_ip(ip))


def service_traffic(flow_packets: DataFrame, seconds: int = S.PERIOD_S) -> DataFrame:
    """Per period, node and server port: TCP packets and bytes sent and received."""
    tcp = flow_packets.filter(F.col("ip_proto") == S.PROTO_TCP)
    out, in_ = F.col("dir") == 1, F.col("dir") == -1
    return (both_ends(tcp.drop("dir"), seconds)
            .groupBy(*NODE, F.col("server_port").cast("int").alias("server_port"))
            .agg(total_if(out).alias("req_pkts"), total_if(out, "l4_len").alias("req_bytes"),
                 total_if(in_).alias("rsp_pkts"), total_if(in_, "l4_len").alias("rsp_bytes")))


def protocol_totals(packets: DataFrame, seconds: int = S.PERIOD_S) -> DataFrame:
    """Per period: total, by frame type and by IPv4 protocol within the type."""
    l3 = F.when(net.is_ipv4(), net.l3_type()).otherwise("none")
    return (packets.select(net.window_us(seconds).alias("window_us"), net.l2_type().alias("l2_type"),
                           l3.alias("l3_type"), "wire_len")
            .groupBy("window_us", "l2_type", "l3_type")
            .agg(count().alias("n"), total("wire_len").alias("b"))
            .groupingSets([["window_us"], ["window_us", "l2_type"], ["window_us", "l2_type", "l3_type"]],
                          "window_us", "l2_type", "l3_type")
            .agg(total("n").alias("packets"), total("b").alias("bytes")))


def capture_statistics(packets: DataFrame) -> DataFrame:
    """Whole-capture totals by frame type, IPv4 protocol and server port class."""
    either = lambda port: (F.col("src_port") == port) | (F.col("dst_port") == port)
    app = (F.when((F.col("ip_proto") == S.PROTO_UDP) & either(53), "dns")
           .when((F.col("ip_proto") == S.PROTO_TCP) & either(80), "http")
           .when((F.col("ip_proto") == S.PROTO_TCP) & either(3306), "mysql").otherwise("none"))
    l3 = F.when(net.is_ipv4(), net.l3_type()).otherwise("none")
    return (packets.groupBy(net.l2_type().alias("l2_type"), l3.alias("l3_type"), app.alias("app"))
            .agg(count().alias("n"), total("wire_len").alias("b"))
            .rollup("l2_type", "l3_type", "app").agg(total("n").alias("packets"), total("b").alias("bytes")))


def tagged_traffic(packets: DataFrame, column: str, seconds: int = S.PERIOD_S) -> DataFrame:
    """Per period and VLAN id or MPLS label."""
    return (packets.filter(F.col(column) > 0).groupBy(net.window_us(seconds).alias("window_us"), column)
            .agg(count().alias("packets"), total("wire_len").alias("bytes")))


def icmp_totals(packets: DataFrame, seconds: int = S.PERIOD_S) -> DataFrame:
    icmp = packets.filter(F.col("ip_proto") == S.PROTO_ICMP)
    aggs = []
    for name, cond in (("total", F.lit(True)), ("request", F.col("icmp_type") == 8),
                       ("response", F.col("icmp_type") == 0)):
        aggs += [total_if(cond).alias(f"{name}_count"), total_if(cond, "l4_len").alias(f"{name}_bytes")]
    return icmp.groupBy(net.window_us(seconds).alias("window_us")).agg(*aggs)


def fragment_count(packets: DataFrame, seconds: int = S.PERIOD_S) -> DataFrame:
    return (packets.filter(net.is_ipv4()).groupBy(net.window_us(seconds).alias("window_us"))
            .agg(total_if(F.col("frag_offset") > 0).alias("fragments")))


FLAG_COUNTS = {
    "syn": lambda: net.pure_syn(), "syn_ack": lambda: net.syn_ack(), "fin": lambda: net.has_flag(S.FIN),
    "rst": lambda: net.has_flag(S.RST), "urg": lambda: net.has_flag(S.URG),
    "ecn": lambda: net.has_flag(S.ECN), "cwr": lambda: net.has_flag(S.CWR),
}


def tcp_flag_counts(packets: DataFrame, seconds: int = S.PERIOD_S) -> DataFrame:
    """Flag counts per period, node and direction, and over all nodes (node columns null)."""
    tcp = packets.filter((F.col("ip_proto") == S.PROTO_TCP) & (F.col("frag_offset") == 0))
    names = [f"{n}_count" for n in FLAG_COUNTS]
    keys = [*NODE, "dir"]
    per_node = (both_ends(tcp, seconds).groupBy(*keys)
                .agg(*[total_if(cond()).alias(f"{n}_count") for n, cond in FLAG_COUNTS.items()]))
    # Every packet is counted once per end, so the sent copies alone make the overall row.
    overall = (per_node.filter(F.col("dir") == 1).groupBy("window_us")
               .agg(*[total(n).alias(n) for n in names]))
    return per_node.unionByName(overall, allowMissingColumns=True)


def active_keys(flow_packets: DataFrame, seconds: int = S.PERIOD_S) -> DataFrame:
    """Distinct nodes, services and sessions per period."""
    rows = both_ends(flow_packets.drop("dir"), seconds)
    service = F.when(F.col("ip_proto") == S.PROTO_TCP, F.struct("mac", "vlan_id", "ip", "server_port"))
    return rows.groupBy("window_us").agg(
        F.countDistinct(F.struct("mac", "vlan_id", "ip")).alias("nodes"),
        F.countDistinct(service).alias("services"),
        F.countDistinct(F.struct(*S.SESSION)).alias("sessions"))


def throughput(packets: DataFrame, seconds: int = S.PERIOD_S) -> DataFrame:
    return (packets.groupBy(net.window_us(seconds).alias("window_us"))
            .agg(total("wire_len").alias("bytes"))
            .withColumn("bits_per_s", F.floor(F.col("bytes") * 8 / seconds).cast("bigint")))


def rollup_windows(rows: DataFrame, seconds: int, keys: list[str], sums=(), mins=(), maxs=()) -> DataFrame:
    """Merge finished periods into longer ones."""
    return (rows.withColumn("window_us", net.window_us(seconds, "window_us"))
            .groupBy("window_us", *keys)
            .agg(*[total(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in mins],
                 *[F.max(c).alias(c) for c in maxs]))


def unit_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(value).alias("count"), total(value).alias("sum"),
                                   F.min(value).cast("bigint").alias("min"), F.max(value).cast("bigint").alias("max"))


def node_registry(facts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row per node seen in a period, with its name where one is known."""
    seen = (facts.select("window_us", "mac", F.coalesce("vlan_id", F.lit(0)).alias("vlan_id"),
                         F.coalesce("ip", F.lit(0)).alias("ip")).distinct())
    return seen if names is None else seen.join(names, ["mac"], "left")
