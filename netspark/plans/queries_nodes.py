"""Aggregates per node, service, protocol and period, and metric rows."""

from pyspark.sql import functions as F

from netspark import schema as S
from netspark.functions import net
from netspark.operators import metrics, nodes, tcp
from netspark.plans import fixtures as fx
from netspark.plans import queries_apps as apps
from netspark.plans import oracle as o
from netspark.plans.registry import query
from netspark.session import cut

P, ENDS, FACTS = o.ORACLE_PACKETS, o.ENDS, o.FACTS


def facts(spark, sf, by):
    return nodes.node_facts(fx.packets(spark, sf), by=by)


@query("count_bytes", o.with_(P, f"SELECT ip_proto, count(*) AS count, {o.sum_if('wire_len')} AS bytes FROM packets GROUP BY ip_proto"))
def count_bytes(spark, sf):
    return fx.packets(spark, sf).groupBy("ip_proto").agg(nodes.count().alias("count"), nodes.total("wire_len").alias("bytes"))


@query("unit_stats", o.with_(P, f"""
SELECT src_ip, count(payload_len) AS count, {o.sum_if('payload_len')} AS sum, {o.big('min(payload_len)')} AS min,
  {o.big('max(payload_len)')} AS max FROM packets GROUP BY src_ip"""))
def unit_stats(spark, sf):
    return nodes.unit_stats(fx.packets(spark, sf), ["src_ip"], "payload_len")


@query("size_histogram", o.with_(P, ENDS, FACTS, f"""
SELECT mac, dir, size_rank, count(*) AS packets, {o.sum_if('wire_len')} AS bytes FROM facts GROUP BY mac, dir, size_rank"""))
def size_histogram(spark, sf):
    return (facts(spark, sf, ["mac", "dir", "size_rank"]).groupBy("mac", "dir", "size_rank")
            .agg(nodes.total("packets").alias("packets"), nodes.total("bytes").alias("bytes")))


@query("direction_sums", o.with_(P, ENDS, f"""
SELECT window_us, mac, {o.count_if('dir = 1')} AS packets_out, {o.count_if('dir = -1')} AS packets_in,
  {o.sum_if('wire_len', 'dir = 1')} AS bytes_out, {o.sum_if('wire_len', 'dir = -1')} AS bytes_in
FROM ends GROUP BY window_us, mac"""))
def direction_sums(spark, sf):
    out, in_ = F.col("dir") == 1, F.col("dir") == -1
    return (facts(spark, sf, ["window_us", "mac", "dir"]).groupBy("window_us", "mac")
            .agg(nodes.total_if(out, "packets").alias("packets_out"), nodes.total_if(in_, "packets").alias("packets_in"),
                 nodes.total_if(out, "bytes").alias("bytes_out"), nodes.total_if(in_, "bytes").alias("bytes_in")))


@query("rollup_windows", o.with_(P, ENDS, f"""
SELECT {o.window(seconds=300)} AS window_us, mac, count(*) AS packets, {o.sum_if('wire_len')} AS bytes,
  {o.big('min(wire_len)')} AS min_len, {o.big('max(wire_len)')} AS max_len FROM ends GROUP BY ALL"""))
def rollup_windows(spark, sf):
    fine = (nodes.both_ends(fx.packets(spark, sf)).groupBy("window_us", "mac")
            .agg(nodes.count().alias("packets"), nodes.total("wire_len").alias("bytes"),
                 F.min("wire_len").cast("bigint").alias("min_len"), F.max("wire_len").cast("bigint").alias("max_len")))
    return nodes.rollup_windows(fine, 300, ["mac"], sums=["packets", "bytes"], mins=["min_len"], maxs=["max_len"])


def _dir(value, name, cond="TRUE"):
    return (f"{o.sum_if(value, f'dir = 1 AND {cond}')} AS {name}_out, "
            f"{o.sum_if(value, f'dir = -1 AND {cond}')} AS {name}_in")


_L2_COLUMNS = ", ".join(
    [_dir("1", "frames"), _dir("wire_len", "bytes")]
    + [f"{o.count_if(f'size_rank = {r!r}')} AS frames_{r}" for r in nodes.RANKS]
    + [f"{o.count_if(f'{c} = {v!r}')} AS {v}_frames, {o.sum_if('wire_len', f'{c} = {v!r}')} AS {v}_bytes"
       for c, vs in (("l2_type", nodes.L2_TYPES), ("cast_class", nodes.CASTS)) for v in vs])


@query("node_l2", o.with_(P, ENDS, FACTS, f"SELECT window_us, mac, {_L2_COLUMNS} FROM facts GROUP BY window_us, mac"))
def node_l2(spark, sf):
    return nodes.node_l2(facts(spark, sf, nodes.L2_FACTS))


_L3_COLUMNS = ", ".join(
    [_dir("1", "packets"), _dir("l3_len", "bytes")]
    + [_dir(v, f"{k}_{n}", f"l3_type = '{k}'") for k in nodes.L3_TYPES for v, n in (("1", "packets"), ("l4_len", "bytes"))])


@query("node_l3", o.with_(P, ENDS, FACTS, f"""
SELECT window_us, mac, vlan_id, ip, {_L3_COLUMNS} FROM facts WHERE ip IS NOT NULL GROUP BY window_us, mac, vlan_id, ip"""))
def node_l3(spark, sf):
    return nodes.node_l3(facts(spark, sf, nodes.L3_FACTS))


@query("node_levels", o.with_(P, ENDS, FACTS, f"""
SELECT 'mac' AS level, window_us, mac, CAST(NULL AS INTEGER) AS vlan_id, CAST(NULL AS BIGINT) AS ip, count(*) AS packets,
  {o.sum_if('wire_len')} AS bytes FROM facts GROUP BY window_us, mac
UNION ALL SELECT 'ip', window_us, mac, vlan_id, ip, count(*), {o.sum_if('wire_len')} FROM facts
WHERE ip IS NOT NULL GROUP BY window_us, mac, vlan_id, ip"""))
def node_levels(spark, sf):
    return nodes.node_levels(facts(spark, sf, nodes.NODE))


_SERVICES = f"""services AS (
  SELECT {o.window()} AS window_us, mac, vlan_id, ip, CAST(server_port AS INTEGER) AS server_port,
    {o.count_if('d = 1')} AS req_pkts, {o.sum_if('l4_len', 'd = 1')} AS req_bytes,
    {o.count_if('d = -1')} AS rsp_pkts, {o.sum_if('l4_len', 'd = -1')} AS rsp_bytes
  FROM (SELECT *, 1 AS d, src_mac AS mac, {o.node_ip('src_ip')} AS ip FROM pf WHERE ip_proto = 6
        UNION ALL SELECT *, -1, dst_mac, {o.node_ip('dst_ip')} FROM pf WHERE ip_proto = 6)
  GROUP BY ALL)"""


@query("service_traffic", o.with_(P, o.SESSIONS, _SERVICES, "SELECT * FROM services"))
def service_traffic(spark, sf):
    return nodes.service_traffic(fx.flow_packets(spark, sf))


_L3_NONE = f"CASE WHEN ip_proto <> 0 THEN {o.L3} ELSE 'none' END"


@query("protocol_totals", o.with_(P, f"""
SELECT window_us, l2_type, l3_type, count(*) AS packets, {o.sum_if('wire_len')} AS bytes
FROM (SELECT {o.window()} AS window_us, {o.L2} AS l2_type, {_L3_NONE} AS l3_type, wire_len FROM packets)
GROUP BY GROUPING SETS ((window_us), (window_us, l2_type), (window_us, l2_type, l3_type))"""))
def protocol_totals(spark, sf):
    return nodes.protocol_totals(fx.packets(spark, sf))


@query("capture_statistics", o.with_(P, f"""
SELECT l2_type, l3_type, app, count(*) AS packets, {o.sum_if('wire_len')} AS bytes
FROM (SELECT {o.L2} AS l2_type, {_L3_NONE} AS l3_type, wire_len,
        CASE WHEN ip_proto = 17 AND 53 IN (src_port, dst_port) THEN 'dns' WHEN ip_proto = 6 AND 80 IN (src_port, dst_port) THEN 'http'
             WHEN ip_proto = 6 AND 3306 IN (src_port, dst_port) THEN 'mysql' ELSE 'none' END AS app FROM packets)
GROUP BY ROLLUP (l2_type, l3_type, app)"""))
def capture_statistics(spark, sf):
    return nodes.capture_statistics(fx.packets(spark, sf))


@query("vlan_traffic", o.with_(P, f"""
SELECT {o.window()} AS window_us, vlan_id, count(*) AS packets, {o.sum_if('wire_len')} AS bytes
FROM packets WHERE vlan_id > 0 GROUP BY ALL"""))
def vlan_traffic(spark, sf):
    return nodes.tagged_traffic(fx.packets(spark, sf), "vlan_id")


# The packets carry no labels, so one is derived from the server's MAC.
@query("mpls_traffic", o.with_(P, f"""
SELECT {o.window()} AS window_us, CAST(16 + dst_mac % 7 AS INTEGER) AS mpls_label, count(*) AS packets, {o.sum_if('wire_len')} AS bytes
FROM packets WHERE ip_proto = 17 GROUP BY ALL"""))
def mpls_traffic(spark, sf):
    label = F.when(F.col("ip_proto") == S.PROTO_UDP, 16 + F.col("dst_mac") % 7).otherwise(0).cast("int")
    return nodes.tagged_traffic(fx.packets(spark, sf).withColumn("mpls_label", label), "mpls_label")


@query("icmp_totals", o.with_(P, f"""
SELECT {o.window()} AS window_us, count(*) AS total_count, {o.sum_if('l4_len')} AS total_bytes,
  {o.count_if('icmp_type = 8')} AS request_count, {o.sum_if('l4_len', 'icmp_type = 8')} AS request_bytes,
  {o.count_if('icmp_type = 0')} AS response_count, {o.sum_if('l4_len', 'icmp_type = 0')} AS response_bytes
FROM packets WHERE ip_proto = 1 GROUP BY ALL"""))
def icmp_totals(spark, sf):
    return nodes.icmp_totals(fx.packets(spark, sf))


# The packets have no fragments; every eleventh packet id is taken for one.
@query("fragment_count", o.with_(P, f"""
SELECT {o.window()} AS window_us, {o.count_if('packet_id % 11 = 3')} AS fragments FROM packets WHERE ip_proto <> 0 GROUP BY ALL"""))
def fragment_count(spark, sf):
    offset = F.when(F.col("packet_id") % 11 == 3, 185).otherwise(0)
    return nodes.fragment_count(fx.packets(spark, sf).withColumn("frag_offset", offset))


_FLAG_SQL = ", ".join([f"{o.count_if('(tcp_flags & 18) = 2')} AS syn_count", f"{o.count_if('(tcp_flags & 18) = 18')} AS syn_ack_count"]
                      + [f"{o.count_if(f'(tcp_flags & {net.FLAG_BITS[n]}) <> 0')} AS {n}_count" for n in ("fin", "rst", "urg", "ecn", "cwr")])


@query("tcp_flag_counts", o.with_(P, ENDS, f"""
SELECT window_us, mac, vlan_id, ip, dir, {_FLAG_SQL} FROM ends WHERE ip_proto = 6 GROUP BY window_us, mac, vlan_id, ip, dir
UNION ALL SELECT {o.window()}, NULL, NULL, NULL, NULL, {_FLAG_SQL} FROM packets WHERE ip_proto = 6 GROUP BY 1"""))
def tcp_flag_counts(spark, sf):
    return nodes.tcp_flag_counts(fx.packets(spark, sf))


@query("active_keys", o.with_(P, o.SESSIONS, f"""
SELECT window_us, count(DISTINCT (mac, vlan_id, ip)) AS nodes,
  count(DISTINCT CASE WHEN ip_proto = 6 THEN (mac, vlan_id, ip, server_port) END) AS services,
  count(DISTINCT ({o.SESSION})) AS sessions
FROM (SELECT *, {o.window()} AS window_us, src_mac AS mac, {o.node_ip('src_ip')} AS ip FROM pf
      UNION ALL SELECT *, {o.window()}, dst_mac, {o.node_ip('dst_ip')} FROM pf) GROUP BY window_us"""))
def active_keys(spark, sf):
    return nodes.active_keys(fx.flow_packets(spark, sf))


@query("throughput", o.with_(P, f"""
SELECT {o.window()} AS window_us, {o.sum_if('wire_len')} AS bytes, {o.big('sum(wire_len) * 8 // 30')} AS bits_per_s
FROM packets GROUP BY ALL"""))
def throughput(spark, sf):
    return nodes.throughput(fx.packets(spark, sf))


@query("node_registry", o.with_(P, ENDS, FACTS, """
SELECT DISTINCT window_us, mac, coalesce(vlan_id, 0) AS vlan_id, coalesce(ip, 0) AS ip FROM facts"""))
def node_registry(spark, sf):
    return nodes.node_registry(facts(spark, sf, nodes.NODE))


def _metric_sql(source, ids, where, items):
    """One SELECT per metric of the catalogue."""
    keys = ", ".join(ids)
    parts = [f"SELECT {keys}, '{metric}' AS metric, {value} AS count FROM {source} WHERE {where} GROUP BY {keys}"
             for metric, value in items]
    return " UNION ALL ".join(parts)


def _metrics_oracle(services=True):
    rank = [(f"l2.frames_{r}", o.count_if(f"size_rank = '{r}'")) for r in nodes.RANKS]
    l2 = [("l2.frames", "count(*)"), ("l2.bytes", o.sum_if("wire_len")), *rank]
    l2_only = []
    for cast in ("ucast", "mcast", "bcast"):
        l2_only += [(f"l2.{cast}_frames", o.count_if(f"cast_class = '{cast}'")),
                    (f"l2.{cast}_bytes", o.sum_if("wire_len", f"cast_class = '{cast}'"))]
    for cond, label in [(f"l2_type = '{k}'", v) for k, v in metrics.L2_LABEL.items()] + [("cast_class = 'stp'", "STP")]:
        l2_only += [(f"l2.frames|l2_type|{label}", o.count_if(cond)), (f"l2.bytes|l2_type|{label}", o.sum_if("wire_len", cond))]
    l3 = [("l3.pkts", "count(*)"), ("l3.bytes", o.sum_if("l3_len"))]
    for kind, label in metrics.L3_LABEL.items():
        cond = f"l3_type = '{kind}'"
        l3 += [(f"l3.pkts|l3_type|{label}", o.count_if(cond)), (f"l3.bytes|l3_type|{label}", o.sum_if("l4_len", cond))]
    for kind in ("tcp", "udp"):
        for side, d in (("req", 1), ("rsp", -1)):
            cond = f"l3_type = '{kind}' AND dir = {d}"
            l3 += [(f"{kind}.{side}_pkts", o.count_if(cond)), (f"{kind}.{side}_bytes", o.sum_if("l4_len", cond))]
    mac = _metric_sql("facts", ["window_us", "mac"], "TRUE", l2 + l2_only)
    ip = _metric_sql("facts", ["window_us", "mac", "vlan_id", "ip"], "ip IS NOT NULL", l2 + l3)
    service = " UNION ALL ".join(
        f"SELECT window_us, mac, vlan_id, ip, 'tcp.{c}|l4_group|' || CAST(server_port AS VARCHAR) AS metric, {c} AS count FROM services"
        for c in ("req_pkts", "req_bytes", "rsp_pkts", "rsp_bytes"))
    service += " UNION ALL " + " UNION ALL ".join(
        f"SELECT window_us, mac, vlan_id, ip, 'tcp.{c}', {c} FROM connections" for c in ("connected", "closed"))
    return f"""metrics AS (
  SELECT window_us, level, mac, vlan_id, ip, metric, count, CAST(NULL AS BIGINT) AS sum, CAST(NULL AS BIGINT) AS min, CAST(NULL AS BIGINT) AS max
  FROM (SELECT window_us, 'mac' AS level, mac, 0 AS vlan_id, CAST(0 AS BIGINT) AS ip, metric, count FROM ({mac})
        UNION ALL SELECT window_us, 'ip', mac, vlan_id, ip, metric, count FROM ({ip})
        {f"UNION ALL SELECT window_us, 'ip', mac, vlan_id, ip, metric, count FROM ({service})" if services else ""})
  WHERE count <> 0)"""


_METRICS = [P, ENDS, FACTS, o.SESSIONS, _SERVICES, o.HANDSHAKE, o.CLOSE, o.CONNECTIONS, _metrics_oracle()]


def all_metrics(packets, flow_packets):
    """Link, network and service metrics of a packet table.

    Each level is summed at once from the packets' ends: few of them are of
    equal class, so storing the facts between costs more than a second reading.
    """
    base = metrics.node_metrics(nodes.node_facts(packets, by=None))
    services = nodes.service_traffic(flow_packets)
    marks = cut(tcp.session_marks(flow_packets))
    connections = tcp.node_connections(tcp.handshake(flow_packets, marks), tcp.tcp_close(flow_packets, marks=marks))
    return metrics.nonzero_metrics(base.unionByName(metrics.service_metrics(services))
                                   .unionByName(metrics.connection_metrics(connections)))


@query("metric_rows", o.with_(*_METRICS, *apps.METRICS, f"SELECT * FROM metrics UNION ALL BY NAME ({apps.METRIC_SQL})"))
def metric_rows(spark, sf):
    """The whole catalogue: link, network, service, connection and application metrics in one table."""
    return all_metrics(fx.packets(spark, sf), fx.tcp_flow_packets(spark, sf)).unionByName(metrics.nonzero_metrics(apps.app_metric_rows(spark, sf)))


@query("nonzero_metrics", o.with_(P, ENDS, FACTS, f"""
SELECT mac, {o.count_if("l2_type = 'arp'")} AS count FROM facts GROUP BY mac HAVING count <> 0"""))
def nonzero_metrics(spark, sf):
    rows = facts(spark, sf, ["mac", "l2_type"]).groupBy("mac").agg(nodes.total_if(F.col("l2_type") == "arp", "packets").alias("count"))
    return metrics.nonzero_metrics(rows)


@query("export_lines", o.with_(*_METRICS, """
SELECT concat_ws('|', CAST(window_us // 1000000 AS VARCHAR),
  CASE WHEN mac = 0 THEN '' ELSE concat_ws(':', substr(h, 1, 2), substr(h, 3, 2), substr(h, 5, 2), substr(h, 7, 2), substr(h, 9, 2), substr(h, 11, 2)) END,
  CASE WHEN ip = 0 THEN '' ELSE concat_ws('.', (ip >> 24) & 255, (ip >> 16) & 255, (ip >> 8) & 255, ip & 255) END,
  metric, CAST(count AS VARCHAR)) AS line
FROM (SELECT *, lower(lpad(to_hex(mac), 12, '0')) AS h FROM metrics)"""))
def export_lines(spark, sf):
    return metrics.export_lines(all_metrics(fx.packets(spark, sf), fx.tcp_flow_packets(spark, sf)))
