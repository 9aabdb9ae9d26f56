"""Transactions from packets: bytes, framing, matching and what carried them in one path."""

from pyspark.sql import functions as F

from netspark import schema as S
from netspark.operators import flows, paths
from netspark.plans import fixtures as fx
from netspark.plans import frames as fr
from netspark.plans import oracle as o
from netspark.plans.queries_apps import _RCODE
from netspark.plans.queries_events import _LOOKUP, _RULES, rule_lines
from netspark.plans.queries_flows import RTT, SUMMARY
from netspark.plans.registry import query
from netspark.sources import rules

P, SS, SESSION = o.ORACLE_PACKETS, o.SESSIONS, o.SESSION


def app_packets(spark, sf, app):
    return fx.flow_packets(spark, sf).filter(flows.app_of_port() == app).withColumn("payload", fr.payload())


def _rtt(side, steps):
    """Samples of the segments of some steps: (sum, count) per session."""
    return (f"SELECT {SESSION}, {o.sum_if('rtt_us')} AS {side}_rtt_sum, count(*) AS {side}_rtt_count FROM samples JOIN segs USING ({SESSION}, side, sent_us) "
            f"WHERE side = {1 if side == 'req' else -1} {steps} GROUP BY {SESSION}")


def _sides(req, rsp):
    """Packets, bytes and times of the data packets of given steps."""
    out = []
    for name, steps in (("req", req), ("rsp", rsp)):
        cond = f"packet_id % 16 IN ({steps}) AND payload_len > 0"
        out += [f"{o.count_if(cond)} AS {name}_pkts", f"{o.sum_if('wire_len', cond)} AS {name}_l2_bytes",
                f"min(ts_us) FILTER (WHERE {cond}) AS {name}_first_us", f"max(ts_us) FILTER (WHERE {cond}) AS {name}_last_us"]
    return ", ".join(out)


_TIMES = ("(req_last_us - req_first_us) // 1000 AS req_ms, (rsp_last_us - rsp_first_us) // 1000 AS rsp_ms, CAST(floor((rsp_first_us - req_last_us) / 1000) AS BIGINT) AS wait_ms, "
          + ", ".join(f"coalesce({s}_rtt_{k}, 0) AS {s}_rtt_{k}" for s in ("req", "rsp") for k in ("sum", "count")) + ", "
          + ", ".join(f"{o.big(f'coalesce({s}_rtt_sum // nullif({s}_rtt_count, 0), 0)')} AS {s}_rtt" for s in ("req", "rsp")))

_HTTP = [SESSION, "turn_no", "method", "url", "host", "status", "version", "req_us", "rsp_us", "req_bytes", "rsp_bytes", "req_pkts", "rsp_pkts", "req_l2_bytes",
         "rsp_l2_bytes", "req_ms", "rsp_ms", "wait_ms", "req_rtt_sum", "rsp_rtt_sum", "req_rtt_count", "rsp_rtt_count", "req_rtt", "rsp_rtt", "pipelined", "req_aborted", "rsp_aborted"]
_HTTP_ROWS = f"""http_rows AS (
  SELECT {SESSION}, min(conv_id) AS conv, min(client_ip) AS client_ip, min(server_ip) AS server_ip, min(client_mac) AS client_mac, min(server_mac) AS server_mac,
    max(vlan_id) AS vlan_id, min(ts_us) FILTER (WHERE packet_id % 16 = 3) AS req_us, min(ts_us) FILTER (WHERE packet_id % 16 IN (5, 10)) AS rsp_us, {_sides('3', '5, 6, 10')}
  FROM pf WHERE 80 IN (src_port, dst_port) AND ip_proto = 6 GROUP BY {SESSION} HAVING max(payload_len) > 0)"""


@query("http_txn_from_packets", o.with_(P, SS, o.LINE, RTT, _HTTP_ROWS, f"q AS ({_rtt('req', '')})", f"r AS ({_rtt('rsp', '')})", f"""
SELECT {SESSION}, CAST(1 AS BIGINT) AS turn_no, 'GET' AS method, '/item/' || conv AS url, 'h' || (conv % 7) || '.example.org' AS host, 200 AS status, 1 AS version, req_us, rsp_us,
  CAST(0 AS BIGINT) AS req_bytes, CAST(1419 AS BIGINT) AS rsp_bytes, req_pkts, rsp_pkts, req_l2_bytes, rsp_l2_bytes, {_TIMES}, FALSE AS pipelined, FALSE AS req_aborted, FALSE AS rsp_aborted
FROM http_rows LEFT JOIN q USING ({SESSION}) LEFT JOIN r USING ({SESSION})"""))
def http_txn_from_packets(spark, sf):
    """Request and response of each conversation, from the bytes of its packets."""
    return paths.http_txn_from_packets(app_packets(spark, sf, "http")).select(*S.SESSION, *_HTTP[1:])


@query("node_http_from_packets", o.with_(P, SS, o.LINE, RTT, _HTTP_ROWS, f"q AS ({_rtt('req', '')})", f"r AS ({_rtt('rsp', '')})", f"""messages AS (
  SELECT *, 1 AS side, req_us AS ts_us, req_pkts AS pkts, 200 AS bytes, req_l2_bytes AS l2_bytes, req_rtt_sum AS rtt_sum, req_rtt_count AS rtt_count FROM http_rows LEFT JOIN q USING ({SESSION})
  UNION ALL SELECT *, -1, rsp_us, rsp_pkts, 1460, rsp_l2_bytes, rsp_rtt_sum, rsp_rtt_count FROM http_rows LEFT JOIN r USING ({SESSION}))""", f"""
SELECT {o.window()} AS window_us, vlan_id, CASE WHEN side = dir THEN client_mac ELSE server_mac END AS mac,
  CASE WHEN side = dir THEN {o.node_ip('client_ip')} ELSE {o.node_ip('server_ip')} END AS ip, dir, {o.count_if('side = 1')} AS requests, {o.count_if('side = -1')} AS responses,
  {o.sum_if('pkts')} AS pkts, {o.sum_if('bytes')} AS bytes, {o.sum_if('l2_bytes')} AS l2_bytes, {o.count_if('side = 1')} AS methods, CAST(0 AS BIGINT) AS errors,
  {o.sum_if('rtt_sum')} AS rtt_sum, {o.sum_if('rtt_count')} AS rtt_count, {o.big('coalesce(sum(rtt_sum) // nullif(sum(rtt_count), 0), 0)')} AS rtt_mean
FROM messages CROSS JOIN (VALUES (1), (-1)) d(dir) GROUP BY 1, 2, 3, 4, 5"""))
def node_http_from_packets(spark, sf):
    return paths.node_http_from_packets(app_packets(spark, sf, "http"))


@query("mysql_txn_from_packets", o.with_(P, SS, o.LINE, RTT, f"q AS ({_rtt('req', 'AND point > 91')})", f"r AS ({_rtt('rsp', 'AND point > 90')})", f"""mysql_rows AS (
  SELECT {SESSION}, min(conv_id) AS conv, {_sides('6', '7')} FROM pf WHERE 3306 IN (src_port, dst_port) AND ip_proto = 6 GROUP BY {SESSION} HAVING max(payload_len) > 0)""", f"""
SELECT {SESSION}, CAST(1 AS BIGINT) AS command_no, 3 AS command, rpad('SELECT ' || conv, 35, ' ') AS argument, CAST(0 AS BIGINT) AS missing, req_first_us, rsp_last_us, CAST(7 AS BIGINT) AS rsp_count,
  CAST(36 AS BIGINT) AS req_bytes, CAST(272 AS BIGINT) AS rsp_bytes, CAST(3 AS BIGINT) AS rows, CAST(1 AS BIGINT) AS cols, CAST(1 AS BIGINT) AS sets,
  req_pkts, rsp_pkts, req_l2_bytes, rsp_l2_bytes, {_TIMES}
FROM mysql_rows LEFT JOIN q USING ({SESSION}) LEFT JOIN r USING ({SESSION})"""))
def mysql_txn_from_packets(spark, sf):
    """Command and result set of each conversation, from the bytes of its packets."""
    return paths.mysql_txn_from_packets(app_packets(spark, sf, "mysql")).select(
        *S.SESSION, "command_no", "command", "argument", "missing", "req_first_us", "rsp_last_us", "rsp_count", "req_bytes", "rsp_bytes", "rows", "cols", "sets", "req_pkts", "rsp_pkts",
        "req_l2_bytes", "rsp_l2_bytes", "req_ms", "rsp_ms", "wait_ms", "req_rtt_sum", "req_rtt_count", "rsp_rtt_sum", "rsp_rtt_count", "req_rtt", "rsp_rtt")


_SIZE = "12 + 1 + strlen('h' || flow_id) + 13 + 4"
_ANSWER = "CASE qtype WHEN 'Address' THEN 16 WHEN 'Canonical Name' THEN 17 ELSE 15 END"
_TEXT = "CASE q.qtype WHEN 'Address' THEN '10.0.0.' || i WHEN 'Canonical Name' THEN 'n' || i || '.' || q.qname ELSE 't' || i END"


@query("dns_txn_from_packets", o.with_(o.ORACLE_DNS, f"""sized AS (SELECT *, CAST({_SIZE} + answer_count * {_ANSWER} AS BIGINT) AS size FROM dns_msgs)""", f"""
SELECT q.dns_id % 65536 AS dns_id, q.client_ip, q.server_ip, q.qname, q.qtype, q.opcode, r.rcode, {_RCODE} AS error, q.ts_us AS req_us, r.ts_us AS rsp_us,
  (r.ts_us - q.ts_us) // 1000 AS wait_ms, r.ts_us IS NULL AS req_timeout, CAST(1 AS BIGINT) AS req_pkts, {o.big('r.ts_us IS NOT NULL')} AS rsp_pkts,
  q.size AS req_bytes, coalesce(r.size, 0) AS rsp_bytes, q.size + 42 AS req_l2_bytes, coalesce(r.size + 42, 0) AS rsp_l2_bytes,
  CASE WHEN r.ts_us IS NOT NULL THEN FALSE END AS truncated, CASE WHEN r.ts_us IS NOT NULL THEN TRUE END AS authoritative,
  CASE WHEN r.ts_us IS NOT NULL THEN array_to_string(list_transform(range(r.answer_count), lambda i: {_TEXT}), ',') END AS answers
FROM (SELECT * FROM sized WHERE qr = 0) q LEFT JOIN (SELECT * FROM sized WHERE qr = 1) r USING (flow_id, dns_id)"""))
def dns_txn_from_packets(spark, sf):
    """Queries and answers as UDP packets, from their bytes."""
    ends = fx.dns_msgs(spark, sf).select("flow_id", F.col("dns_id").alias("event_id"), "qr", "client_ip", "server_ip")
    rows = fr.dns_packets(spark, sf).withColumn("qr", F.when(F.col("dst_port") == 53, 0).otherwise(1)).join(ends, ["flow_id", "event_id", "qr"])
    query_ = F.col("qr") == 0
    size = F.length("payload")
    packets = rows.select("ts_us", "ip_proto", "src_port", "dst_port", "payload", size.alias("payload_len"), (size + 42).alias("wire_len"),
                          F.when(query_, F.col("client_ip")).otherwise(F.col("server_ip")).alias("src_ip"), F.when(query_, F.col("server_ip")).otherwise(F.col("client_ip")).alias("dst_ip"))
    out = paths.dns_txn_from_packets(packets).withColumn("answers", F.array_join(F.transform("answers", lambda a: a["data"]), ","))
    return out.select("dns_id", "client_ip", "server_ip", "qname", "qtype", "opcode", "rcode", "error", "req_us", "rsp_us", "wait_ms", "req_timeout", "req_pkts", "rsp_pkts",
                      "req_bytes", "rsp_bytes", "req_l2_bytes", "rsp_l2_bytes", "truncated", "authoritative", "answers")


@query("flow_protocol_ruled", o.with_(P, SS, SUMMARY, _RULES, f"""detected AS (
  SELECT {SESSION}, CASE WHEN bool_or(ip_proto = 17 AND 53 IN (src_port, dst_port)) THEN 'dns'
    WHEN bool_or(payload_len > 0 AND ip_proto = 6 AND 80 IN (src_port, dst_port)) THEN 'http'
    WHEN bool_or(payload_len > 0 AND ip_proto = 6 AND 3306 IN (src_port, dst_port)) THEN 'mysql' ELSE 'unknown' END AS app FROM pf GROUP BY {SESSION})""", f"""
SELECT {SESSION}, coalesce({_LOOKUP('s.client_ip', 's.client_port')}, {_LOOKUP('0', 's.client_port')}, {_LOOKUP('s.server_ip', 's.server_port')},
  {_LOOKUP('0', 's.server_port')}, app) AS app FROM summary s JOIN detected USING ({SESSION})"""))
def flow_protocol_ruled(spark, sf):
    """Application of each session where the rule file has the last word."""
    rows = fx.flow_packets(spark, sf)
    tags = rules.app_tags(flows.flow_summary(rows), rules.load_rules(spark, rule_lines(spark, sf)))
    return flows.flow_protocol(rows.withColumn("payload", fr.payload()), tags.select(*S.SESSION, F.col("rule_name").alias("rule_app")))
