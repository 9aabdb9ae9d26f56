"""Queries on bytes: captures, frames, options, DNS messages."""

from pyspark.sql import functions as F

from netspark.plans import fixtures as fx
from netspark.plans import frames as fr
from netspark.plans import oracle as o
from netspark.plans.registry import query
from netspark.sources import captures, decode, dns_wire

P = o.ORACLE_PACKETS
TAG = "CASE WHEN vlan_id > 0 THEN 4 ELSE 0 END"


def decoded(spark, sf, options=False):
    return decode.decode(fr.frames(spark, sf, options))


@query("decode_l2", o.with_(P, f"""
SELECT packet_id, src_mac, dst_mac, eth_type, vlan_id, mpls_label, CAST(14 + {TAG} AS INTEGER) AS l3_offset, CAST(wire_len + {TAG} AS INTEGER) AS cap_len FROM packets"""))
def decode_l2(spark, sf):
    return decode.link_layer(fr.frames(spark, sf)).select(
        "packet_id", "src_mac", "dst_mac", "eth_type", "vlan_id", "mpls_label", "l3_offset", "cap_len")


@query("decode_ipv4", o.with_(P, """
SELECT packet_id, src_ip, dst_ip, ip_proto, frag_offset, l3_len, l4_len FROM packets"""))
def decode_ipv4(spark, sf):
    rows = decode.network_layer(decode.link_layer(fr.frames(spark, sf)))
    return rows.select("packet_id", "src_ip", "dst_ip", "ip_proto", "frag_offset", "l3_len", "l4_len")


@query("decode_l4", o.with_(P, """
SELECT packet_id, src_port, dst_port, tcp_seq, tcp_ack, tcp_flags, tcp_window, tcp_urgent, payload_len, icmp_type,
  CASE WHEN icmp_type IS NOT NULL THEN conv_id % 65536 END AS icmp_id, icmp_seq FROM packets"""))
def decode_l4(spark, sf):
    return decoded(spark, sf).select("packet_id", "src_port", "dst_port", "tcp_seq", "tcp_ack", "tcp_flags", "tcp_window", "tcp_urgent",
                                     "payload_len", "icmp_type", "icmp_id", "icmp_seq")


@query("decode_arp", o.with_(P, """
SELECT packet_id, ts_us, arp_op AS opcode, src_mac AS sender_mac, src_ip AS sender_ip, CASE arp_op WHEN 1 THEN 0 ELSE dst_mac END AS target_mac, dst_ip AS target_ip
FROM packets WHERE arp_op IS NOT NULL"""))
def decode_arp(spark, sf):
    return decode.decode_arp(decoded(spark, sf))


# Each DNS packet comes back inside an unreachable message: its IP header and ports are the quoted bytes.
@query("icmp_unreachable", o.with_(P, """
SELECT packet_id, ts_us, 3 AS code, ip_proto AS proto, src_ip AS client_ip, src_port AS client_port, dst_ip AS server_ip, dst_port AS server_port
FROM packets WHERE ip_proto IN (1, 17)"""))
def icmp_unreachable(spark, sf):
    rows = decoded(spark, sf).filter(F.col("ip_proto").isin(1, 17))
    quoted = rows.select("packet_id", "ts_us", F.lit(3).alias("icmp_type"), F.lit(3).alias("icmp_code"),
                         F.substr(F.col("frame"), F.col("l4_offset") - 19, F.lit(28)).alias("payload"))
    return decode.icmp_unreachable(quoted)


@query("tcp_options", o.with_(P, """
SELECT packet_id, CASE WHEN syn THEN 1460 END AS mss, CASE WHEN syn THEN 7 END AS shift, CASE WHEN syn THEN conv_id END AS stamp, syn AS sack_ok,
  CASE WHEN NOT syn THEN tcp_ack END AS sack_left, CASE WHEN NOT syn THEN tcp_ack + 100 END AS sack_right, CASE WHEN syn THEN -1 ELSE tcp_window END AS "window"
FROM (SELECT *, (tcp_flags & 2) <> 0 AS syn FROM packets WHERE ip_proto = 6 AND ((tcp_flags & 2) <> 0 OR (packet_id % 16 = 7 AND conv_id % 25 = 10)))"""))
def tcp_options(spark, sf):
    rows = decode.tcp_options(decoded(spark, sf, options=True))
    return rows.select("packet_id", "mss", "shift", "stamp", "sack_ok", F.get("sacks", F.lit(0))["left"].alias("sack_left"),
                       F.get("sacks", F.lit(0))["right"].alias("sack_right"), "window")


@query("read_captures", o.with_(P, f"""
SELECT ts_us, CAST(wire_len + {TAG} AS INTEGER) AS wire_len, CAST(wire_len + {TAG} AS INTEGER) AS cap_len, src_ip, dst_ip, src_port, dst_port, tcp_seq, TRUE AS unique_id FROM packets"""))
def read_captures(spark, sf):
    """Frames written as capture files by Spark tasks, read by the capture source and decoded."""
    path = fx.fresh_path(spark, "captures")
    fr.write_capture_files(fr.frames(spark, sf), path, files=8)
    frames = captures.number_packets(captures.read_captures(spark, path))
    rows = decode.decode(frames.drop("cap_len"))
    ids = rows.groupBy(F.col("packet_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(ids, F.col("packet_id") == F.col("_id")).select(
        "ts_us", "wire_len", "cap_len", "src_ip", "dst_ip", "src_port", "dst_port", "tcp_seq", (F.col("_n") == 1).alias("unique_id"))


_DATA = ("CASE qtype WHEN 'Address' THEN '10.0.0.' || CAST(i AS VARCHAR) WHEN 'Canonical Name' THEN 'n' || CAST(i AS VARCHAR) || '.' || qname "
         "ELSE 't' || CAST(i AS VARCHAR) END")


@query("dns_messages", o.with_(o.ORACLE_DNS, f"""
SELECT dns_id AS event_id, dns_id % 65536 AS dns_id, ts_us, qr, opcode, rcode, qr = 1 AS authoritative, FALSE AS truncated, qname, qtype, answer_count,
  CASE WHEN i IS NOT NULL THEN qname END AS answer_name, CASE WHEN i IS NOT NULL THEN {_DATA} END AS answer_data, CAST(60 * i AS BIGINT) AS ttl
FROM dns_msgs LEFT JOIN (VALUES (0), (1), (2)) v(i) ON i < answer_count"""))
def dns_messages(spark, sf):
    rows = dns_wire.dns_messages(fr.dns_packets(spark, sf), ["event_id", "flow_id", "ts_us"])
    rows = rows.withColumn("a", F.explode_outer("answers"))
    return rows.select("event_id", "dns_id", "ts_us", "qr", "opcode", "rcode", "authoritative", "truncated", "qname", "qtype", "answer_count",
                       F.col("a.name").alias("answer_name"), F.col("a.data").alias("answer_data"), F.col("a.ttl").alias("ttl"))
