"""Events, logs, rules and sinks."""

from pyspark.sql import functions as F

from netspark import schema as S
from netspark.functions import net
from netspark.operators import events, flows, late, tcp, transactions as tx
from netspark.plans import fixtures as fx
from netspark.plans import oracle as o
from netspark.plans.queries_flows import SUMMARY
from netspark.plans.queries_nodes import _METRICS, all_metrics
from netspark.plans.registry import query
from netspark.sources import rules, sinks

P, SS = o.ORACLE_PACKETS, o.SESSIONS


def app_txns(spark, sf):
    """DNS, HTTP and MySQL transactions with end points."""
    ends = {"client_ip": 167772416 + F.col("flow_id"), "server_ip": 3232235776 + F.col("flow_id") % 7}
    return (tx.dns_txn(fx.dns_msgs(spark, sf)), tx.http_txn(tx.http_messages(fx.http_msgs(spark, sf))).withColumns(ends),
            tx.mysql_txn(fx.mysql_msgs(spark, sf)).withColumns(ends))


_ENDS = "167772416 + flow_id AS client_ip, 3232235776 + flow_id % 7 AS server_ip"
_EVENTS = f"""http_n AS (SELECT *, row_number() OVER (PARTITION BY flow_id, kind ORDER BY ts_us, n) AS turn_no FROM http_msgs),
mysql_n AS (SELECT flow_id, command_no, max(ts_us) AS at_us, {o.sum_if('bytes')} AS bytes
  FROM (SELECT *, sum(is_command) OVER (PARTITION BY flow_id ORDER BY ts_us, is_command DESC, bytes ROWS UNBOUNDED PRECEDING) AS command_no FROM mysql_msgs)
  WHERE command_no > 0 GROUP BY ALL),
events_all AS (
  SELECT 1 AS phase, 601 AS event_code, 'arp' AS content, ts_us AS at_us, src_ip AS client_ip, dst_ip AS server_ip, CAST(wire_len AS BIGINT) AS bytes FROM packets WHERE eth_type = 2054
  UNION ALL SELECT 1, 701, 'icmp_unreachable', ts_us, src_ip, dst_ip, wire_len FROM packets WHERE icmp_type = 3
  UNION ALL SELECT 2, CASE ip_proto WHEN 6 THEN 101 ELSE 201 END, 'flow_head', start_us, client_ip, server_ip, 0 FROM summary WHERE ip_proto <> 1
  UNION ALL SELECT 3, 301, 'http', ts_us, {_ENDS.replace(' AS client_ip', '').replace(' AS server_ip', '')}, body_len FROM http_n WHERE kind = 'req'
  UNION ALL SELECT 4, 302, 'http', p.ts_us, 167772416 + flow_id, 3232235776 + flow_id % 7, q.body_len + p.body_len
    FROM (SELECT * FROM http_n WHERE kind = 'req') q JOIN (SELECT * FROM http_n WHERE kind = 'rsp') p USING (flow_id, turn_no)
  UNION ALL SELECT 4, 401, 'dns', max(ts_us), max(client_ip), max(server_ip), sum(bytes) FROM dns_msgs GROUP BY flow_id, dns_id
  UNION ALL SELECT 4, 511, 'mysql_command', at_us, 167772416 + flow_id, 3232235776 + flow_id % 7, bytes FROM mysql_n
  UNION ALL SELECT 5, 0, 'flow_body', unnest(generate_series(start_us + 5000, last_us, 5000)), client_ip, server_ip, 0 FROM summary WHERE ip_proto <> 1
  UNION ALL SELECT 6, CASE ip_proto WHEN 6 THEN 102 ELSE 202 END, 'flow_body', last_us, client_ip, server_ip, client_bytes + server_bytes FROM summary WHERE ip_proto <> 1
  UNION ALL SELECT 6, 701, 'icmp_echo', last_us, client_ip, server_ip, client_bytes + server_bytes FROM summary WHERE ip_proto = 1)"""
_ALL = [P, SS, SUMMARY, o.ORACLE_DNS, o.ORACLE_HTTP, o.ORACLE_MYSQL, _EVENTS]


def _all_events(spark, sf):
    packets = fx.packets(spark, sf)
    summary = flows.flow_summary(fx.flow_packets(spark, sf))
    return events.all_events(packets, summary, *app_txns(spark, sf), cycle_us=5000)


@query("all_events", o.with_(*_ALL, """
SELECT phase, event_code, content, at_us, client_ip, server_ip, CAST(bytes AS BIGINT) AS bytes FROM events_all"""))
def all_events(spark, sf):
    return _all_events(spark, sf)


@query("write_events", o.with_(*_ALL, "SELECT event_code, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM events_all GROUP BY event_code"))
def write_events(spark, sf):
    """Written events, read back and counted; one run is repeated."""
    path = fx.fresh_path(spark, "events")
    rows = _all_events(spark, sf).persist()
    early = F.col("at_us") % 2 == 0
    for run, part in (("a", early), ("b", ~early), ("a", early)):
        sinks.write_events(rows.filter(part), path, run)
    rows.unpersist()
    return (spark.read.parquet(path).groupBy("event_code")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")))


@query("write_metrics", o.with_(*_METRICS, "SELECT window_us, count(*) AS metric_count FROM metrics GROUP BY window_us"))
def write_metrics(spark, sf):
    """Written metrics with the finish record of each period, counted from the table."""
    from netspark.operators.metrics import metric_finish
    path = fx.fresh_path(spark, "metrics")
    rows = sinks.store(all_metrics(fx.packets(spark, sf), fx.tcp_flow_packets(spark, sf)), fx.fresh_path(spark, "rows"))
    sinks.write_metrics(rows, path, stored=True)
    # Half of each hour once more: the other windows stay.
    sinks.write_metrics(rows.filter(F.col("window_us") % 3_600_000_000 < 1_800_000_000), path, stored=True)
    return metric_finish(spark.read.parquet(path))


_TURN_ROWS = f"""turn_rows AS (
  SELECT {o.SESSION}, turn, max(ts_us) - min(ts_us) AS duration_us, {o.big('sum(payload_len)')} AS bytes,
    lead(min(ts_us)) OVER (PARTITION BY {o.SESSION} ORDER BY turn) - max(ts_us) AS interval_us
  FROM (SELECT *, CAST(sum(change) OVER (PARTITION BY {o.SESSION} ORDER BY ts_us, packet_id) AS BIGINT) AS turn
        FROM (SELECT *, CASE WHEN dir IS DISTINCT FROM lag(dir) OVER (PARTITION BY {o.SESSION} ORDER BY ts_us, packet_id) THEN 1 ELSE 0 END AS change
              FROM pf WHERE ip_proto = 6 AND payload_len > 0)) GROUP BY {o.SESSION}, turn)"""


@query("flow_app_events", o.with_(P, SS, SUMMARY, _TURN_ROWS, f"""
SELECT {o.SESSION}, turn, duration_us, interval_us, turn_rows.bytes, client_ip, client_port, server_ip, server_port
FROM turn_rows JOIN summary USING ({o.SESSION}) WHERE interval_us IS NOT NULL"""))
def flow_app_events(spark, sf):
    """Requests and responses (finished turns) with their flow's end points."""
    rows = fx.flow_packets(spark, sf)
    return events.flow_app_events(tcp.turn_rows(rows), flows.flow_summary(rows))


@query("flow_log", o.with_(P, SS, o.HANDSHAKE, o.CLOSE, o.ORACLE_DNS, f"""
SELECT 'packet_error' AS kind, 'syn' AS cause, ts_us AS at_us, src_ip AS client_ip, dst_ip AS server_ip FROM packets WHERE ip_proto = 6 AND (tcp_flags & 2) <> 0 AND payload_len > 0
UNION ALL SELECT 'packet_error', CASE WHEN start_isn IS NULL THEN 'session' ELSE 'ack' END, ts_us, src_ip, dst_ip FROM pf
  WHERE ip_proto = 6 AND (tcp_flags & 18) = 18 AND (start_isn IS NULL OR tcp_ack <> start_isn + 1)
UNION ALL SELECT 'packet_error', 'req', ts_us, client_ip, server_ip FROM dns_msgs r WHERE qr = 1
  AND NOT EXISTS (SELECT 1 FROM dns_msgs q WHERE q.qr = 0 AND q.flow_id = r.flow_id AND q.dns_id = r.dns_id)
UNION ALL SELECT 'create', CASE opened WHEN 'handshake' THEN 'normal' WHEN 'midstream' THEN 'abort' ELSE 'failure' END, coalesce(connected_us, start_us), client_ip, server_ip FROM hs
UNION ALL SELECT 'close', cause, coalesce(closed_us, closes.last_us), client_ip, server_ip FROM closes JOIN hs USING ({o.SESSION})"""))
def flow_log(spark, sf):
    return events.flow_log(fx.packets(spark, sf), fx.flow_packets(spark, sf), tx.dns_txn(fx.dns_msgs(spark, sf)))


# Packets in the order of their ids are not in time order; an older packet counts at the newest time seen.
@query("late_packets", o.with_(P, """
SELECT packet_id, ts_us, greatest(ts_us, coalesce(max(ts_us) OVER (ORDER BY packet_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ts_us)) AS account_us,
  coalesce(max(ts_us) OVER (ORDER BY packet_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > ts_us, FALSE) AS late FROM packets"""))
def late_packets(spark, sf):
    return late.newest_time(fx.packets(spark, sf)).select("packet_id", "ts_us", "account_us", "late")


def rule_lines(spark, sf):
    """A rule file of one line per supplier: some fields empty, some keys repeated, some lines comments."""
    key = F.col("s_suppkey")
    proto = F.when(key % 3 == 0, "TCP").when(key % 3 == 1, "udp").otherwise("tcp")
    ip = F.concat(F.lit("10.0.1."), (key % 200).cast("string"))
    text = F.concat_ws("\t", proto, F.when(key % 5 == 0, F.lit("")).otherwise(ip), (20 + key % 90).cast("string"),
                       F.when(key % 4 == 0, F.lit("")).otherwise((key % 4).cast("string")), (key % 6).cast("string"),
                       F.lit("2"), F.lit(""), F.lit("4"), F.concat(F.lit("rule-"), key.cast("string")))
    rows = fx.table(spark, sf, "supplier").select(F.when(key % 11 == 0, F.concat(F.lit("#"), text)).otherwise(text).alias("value"), "s_suppkey")
    path = fx.fresh_path(spark, "rules")
    rows.orderBy("s_suppkey").select("value").write.text(path)
    return path


_RULES = """rules AS (
  SELECT proto, ip, port, arg_max(flag, k) AS flag, arg_max(application, k) AS application, 2 AS major, 0 AS minor, 4 AS attribute, arg_max(name, k) AS name
  FROM (SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 1 THEN 17 ELSE 6 END AS proto,
          CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 167772416 + s_suppkey % 200 END AS ip, CAST(20 + s_suppkey % 90 AS INTEGER) AS port,
          CAST(s_suppkey % 4 AS INTEGER) AS flag, CAST(s_suppkey % 6 AS INTEGER) AS application, 'rule-' || CAST(s_suppkey AS VARCHAR) AS name
        FROM supplier WHERE s_suppkey % 11 <> 0) GROUP BY proto, ip, port)"""


@query("load_rules", o.with_(_RULES, "SELECT * FROM rules"))
def load_rules(spark, sf):
    return rules.load_rules(spark, rule_lines(spark, sf))


_LOOKUP = lambda ip, port: f"(SELECT name FROM rules r WHERE r.proto = s.ip_proto AND r.ip = {ip} AND r.port = {port})"


@query("app_tags", o.with_(P, SS, SUMMARY, _RULES, f"""
SELECT t.*, r.flag, r.application, r.major, r.minor, r.attribute FROM (
  SELECT {o.SESSION}, coalesce({_LOOKUP('s.client_ip', 's.client_port')}, {_LOOKUP('0', 's.client_port')},
    {_LOOKUP('s.server_ip', 's.server_port')}, {_LOOKUP('0', 's.server_port')}) AS rule_name FROM summary s) t
LEFT JOIN rules r ON r.name = t.rule_name"""))
def app_tags(spark, sf):
    summary = flows.flow_summary(fx.flow_packets(spark, sf))
    tagged = rules.app_tags(summary, rules.load_rules(spark, rule_lines(spark, sf)))
    return tagged.select(*S.SESSION, "rule_name", "flag", "application", "major", "minor", "attribute")
