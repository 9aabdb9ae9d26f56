"""Per-packet expressions and filters."""

from pyspark.sql import functions as F

from netspark import schema as S
from netspark.functions import names, net
from netspark.operators import flows, nodes
from netspark.plans import fixtures as fx
from netspark.plans import oracle as o
from netspark.plans.registry import query

P = o.ORACLE_PACKETS


def per_packet(select: str, where: str = "TRUE") -> str:
    return o.with_(P, f"SELECT packet_id, {select} FROM packets WHERE {where}")


@query("cast_class", per_packet(
    f"CASE WHEN {o.mac_class('dst_mac')} <> 'ucast' THEN {o.mac_class('dst_mac')} ELSE {o.mac_class('src_mac')} END AS cast_class"))
def cast_class(spark, sf):
    return fx.packets(spark, sf).select("packet_id", net.cast_class().alias("cast_class"))


@query("l2_type", per_packet(f"{o.L2} AS l2_type"))
def l2_type(spark, sf):
    return fx.packets(spark, sf).select("packet_id", net.l2_type().alias("l2_type"))


@query("l3_type", per_packet(f"{o.L3} AS l3_type", "ip_proto <> 0"))
def l3_type(spark, sf):
    return fx.packets(spark, sf).filter(net.is_ipv4()).select("packet_id", net.l3_type().alias("l3_type"))


@query("local_ip", per_packet(f"{o.local('src_ip')} AS src_local, {o.local('dst_ip')} AS dst_local"))
def local_ip(spark, sf):
    return fx.packets(spark, sf).select("packet_id", net.local_ip("src_ip").alias("src_local"),
                                        net.local_ip("dst_ip").alias("dst_local"))


@query("node_key", o.with_(P, o.ENDS, "SELECT DISTINCT mac, vlan_id, ip FROM ends WHERE ip_proto <> 0"))
def node_key(spark, sf):
    rows = nodes.both_ends(fx.packets(spark, sf).filter(net.is_ipv4()))
    return rows.select("mac", "vlan_id", "ip").distinct()


@query("drop_global_nodes", o.with_(P, f"""
SELECT src_ip, count(*) AS packets, {o.sum_if('wire_len')} AS bytes FROM packets
WHERE ip_proto <> 0 AND {o.local('src_ip')} GROUP BY src_ip"""))
def drop_global_nodes(spark, sf):
    rows = fx.packets(spark, sf).filter(net.is_ipv4()).groupBy("src_ip").agg(
        nodes.count().alias("packets"), nodes.total("wire_len").alias("bytes"))
    return nodes.drop_global_nodes(rows, "src_ip")


@query("drop_fragments", o.with_(P, "SELECT ip_proto, count(*) AS packets FROM packets "
                                    "WHERE ip_proto <> 0 AND frag_offset = 0 GROUP BY ip_proto"))
def drop_fragments(spark, sf):
    return (fx.packets(spark, sf).filter(net.is_ipv4() & (F.col("frag_offset") == 0))
            .groupBy("ip_proto").agg(nodes.count().alias("packets")))


@query("tcp_flag_columns", per_packet(
    ", ".join(f"(tcp_flags & {bit}) <> 0 AS {name}" for name, bit in net.FLAG_BITS.items()), "ip_proto = 6"))
def tcp_flag_columns(spark, sf):
    return (fx.packets(spark, sf).filter(F.col("ip_proto") == S.PROTO_TCP)
            .select("packet_id", *[net.has_flag(bit).alias(name) for name, bit in net.FLAG_BITS.items()]))


@query("syn_with_data", per_packet("src_ip, dst_ip, payload_len", "ip_proto = 6 AND (tcp_flags & 2) <> 0 AND payload_len > 0"))
def syn_with_data(spark, sf):
    return fx.packets(spark, sf).filter(net.syn_with_data()).select("packet_id", "src_ip", "dst_ip", "payload_len")


@query("size_bucket", per_packet(f"{o.RANK} AS size_bucket"))
def size_bucket(spark, sf):
    return fx.packets(spark, sf).select("packet_id", net.size_bucket().alias("size_bucket"))


@query("flow_key", o.with_(P, o.SESSIONS, f"SELECT {o.KEY}, count(*) AS packets FROM keyed GROUP BY ALL"))
def flow_key(spark, sf):
    return flows.with_flow_key(fx.packets(spark, sf)).groupBy(*S.FLOW_KEY).agg(nodes.count().alias("packets"))


APP_OF_PORT = ("CASE WHEN ip_proto = 17 AND 53 IN (src_port, dst_port) THEN 'dns' "
               "WHEN ip_proto = 6 AND 80 IN (src_port, dst_port) THEN 'http' "
               "WHEN ip_proto = 6 AND 3306 IN (src_port, dst_port) THEN 'mysql' "
               "WHEN ip_proto = 6 THEN 'tcp' WHEN ip_proto = 17 THEN 'udp' WHEN ip_proto = 1 THEN 'icmp' ELSE 'other' END")


@query("export_filter", o.with_(P, f"""
SELECT app, count(*) AS packets, {o.sum_if('wire_len')} AS bytes
FROM (SELECT {APP_OF_PORT} AS app, wire_len FROM packets) WHERE app IN ('http', 'dns') GROUP BY app"""))
def export_filter(spark, sf):
    rows = fx.packets(spark, sf).select(flows.app_of_port().alias("app"), "wire_len")
    return (flows.export_filter(rows, ["http", "dns"]).groupBy("app")
            .agg(nodes.count().alias("packets"), nodes.total("wire_len").alias("bytes")))


@query("format_addresses", o.with_(P, """
SELECT DISTINCT src_mac, src_ip,
  concat_ws(':', substr(h, 1, 2), substr(h, 3, 2), substr(h, 5, 2), substr(h, 7, 2), substr(h, 9, 2), substr(h, 11, 2)) AS mac_text,
  concat_ws('.', (src_ip >> 24) & 255, (src_ip >> 16) & 255, (src_ip >> 8) & 255, src_ip & 255) AS ip_text
FROM (SELECT src_mac, src_ip, lower(lpad(to_hex(src_mac), 12, '0')) AS h FROM packets)"""))
def format_addresses(spark, sf):
    return (fx.packets(spark, sf).select("src_mac", "src_ip").distinct()
            .select("src_mac", "src_ip", net.mac_text("src_mac").alias("mac_text"), net.ip_text("src_ip").alias("ip_text")))


def _case(column, table, default):
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in table.items())
    return f"CASE {column} {whens} ELSE '{default}' END"


@query("code_names", o.with_(P, o.ORACLE_DNS, f"""
SELECT 'ip' AS kind, CAST(ip_proto AS INTEGER) AS code, {_case('ip_proto', names.IP_PROTO, 'other')} AS name, count(*) AS n FROM packets GROUP BY ALL
UNION ALL SELECT 'eth', CAST(eth_type AS INTEGER), {_case('eth_type', names.ETHER_TYPE, 'other')}, count(*) FROM packets GROUP BY ALL
UNION ALL SELECT 'opcode', opcode, {_case('opcode', names.DNS_OPCODE, 'Unknown')}, count(*) FROM dns_msgs GROUP BY ALL
UNION ALL SELECT 'rcode', rcode, {_case('rcode', names.DNS_RCODE, 'Unknown')}, count(*) FROM dns_msgs GROUP BY ALL"""))
def code_names(spark, sf):
    packets, dns = fx.packets(spark, sf), fx.dns_msgs(spark, sf)
    out = None
    for kind, rows, column, table, default in (
            ("ip", packets, "ip_proto", names.IP_PROTO, "other"), ("eth", packets, "eth_type", names.ETHER_TYPE, "other"),
            ("opcode", dns, "opcode", names.DNS_OPCODE, "Unknown"), ("rcode", dns, "rcode", names.DNS_RCODE, "Unknown")):
        part = (rows.groupBy(F.col(column).cast("int").alias("code")).agg(nodes.count().alias("n"))
                .select(F.lit(kind).alias("kind"), "code", names.name_of("code", table, default).alias("name"), "n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("safe_mean", o.with_(P, f"""
SELECT src_ip, {o.big("coalesce(sum(payload_len) // nullif(count(*) FILTER (WHERE payload_len > 0), 0), 0)")} AS mean_payload
FROM packets GROUP BY src_ip"""))
def safe_mean(spark, sf):
    return fx.packets(spark, sf).groupBy("src_ip").agg(net.safe_mean(
        F.sum("payload_len"), F.count(F.when(F.col("payload_len") > 0, 1))).alias("mean_payload"))


# The sequence numbers of the packets are moved to both sides of the wrap.
@query("seq_diff", per_packet("""
CAST(((b - a + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS BIGINT) AS diff""".strip(), "TRUE").replace(
    "FROM packets", "FROM (SELECT packet_id, (tcp_seq + 4294966000) % 4294967296 AS a, tcp_ack AS b FROM packets WHERE ip_proto = 6)"))
def seq_diff(spark, sf):
    base = F.pmod(F.col("tcp_seq") + 4294966000, F.lit(S.UINT32))
    return (fx.packets(spark, sf).filter(F.col("ip_proto") == S.PROTO_TCP)
            .select("packet_id", net.seq_diff(base, F.col("tcp_ack")).alias("diff")))


@query("time_units", per_packet(f"ts_us // 1000 AS ms, ts_us // 1000000 AS s, {o.window()} AS window_us"))
def time_units(spark, sf):
    return fx.packets(spark, sf).select("packet_id", net.to_ms("ts_us").alias("ms"), net.to_s("ts_us").alias("s"),
                                        net.window_us().alias("window_us"))


@query("dimension_names", o.with_(P, o.ORACLE_DNS, """
SELECT 'tcp.pkts|l4_group|' || CAST(dst_port AS VARCHAR) AS metric, count(*) AS count FROM packets WHERE ip_proto = 6 GROUP BY dst_port
UNION ALL SELECT 'dns.rsp_rcodes|dns_rcode|' || CAST(rcode AS VARCHAR), count(*) FROM dns_msgs WHERE qr = 1 GROUP BY rcode"""))
def dimension_names(spark, sf):
    tcp = (fx.packets(spark, sf).filter(F.col("ip_proto") == S.PROTO_TCP).groupBy("dst_port").agg(nodes.count().alias("count"))
           .select(net.dimension("tcp.pkts", "l4_group", "dst_port").alias("metric"), "count"))
    dns = (fx.dns_msgs(spark, sf).filter("qr = 1").groupBy("rcode").agg(nodes.count().alias("count"))
           .select(net.dimension("dns.rsp_rcodes", "dns_rcode", "rcode").alias("metric"), "count"))
    return tcp.unionByName(dns)
