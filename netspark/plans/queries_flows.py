"""Flows and TCP analysis."""

from pyspark.sql import functions as F

from netspark import schema as S
from netspark.functions import net
from netspark.operators import flows, tcp
from netspark.plans import fixtures as fx
from netspark.plans import oracle as o
from netspark.plans.registry import query

P, SS, KEY, SESSION = o.ORACLE_PACKETS, o.SESSIONS, o.KEY, o.SESSION


def line(spark, sf):
    return fx.tcp_line(spark, sf)


@query("flow_sessions", o.with_(o.ORACLE_SILENT, o.PRIOR, o.walked_sessions(), f"""
SELECT {SESSION}, min(ts_us) AS start_us, max(ts_us) AS last_us, count(*) AS packets FROM walked JOIN ordered USING ({KEY}, place) GROUP BY ALL"""))
def flow_sessions(spark, sf):
    """From the packets themselves, not from the shared table, with silences before, in and after the established phase."""
    return (flows.packets_with_flow(fx.silent_packets(spark, sf)).groupBy(*S.SESSION)
            .agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("last_us"), F.count(F.lit(1)).alias("packets")))


@query("packets_with_flow", o.with_(P, SS, f"""
SELECT packet_id, {SESSION}, start_us, start_packet, client_ip, client_port, server_ip, server_port FROM pf"""))
def packets_with_flow(spark, sf):
    return flows.packets_with_flow(fx.packets(spark, sf)).select(
        "packet_id", *S.SESSION, "start_us", "start_packet", "client_ip", "client_port", "server_ip", "server_port")


@query("flow_direction", o.with_(P, SS, "SELECT packet_id, dir FROM pf"))
def flow_direction(spark, sf):
    return flows.flow_direction(fx.flow_packets(spark, sf))


SUMMARY = f"""summary AS (
  SELECT {SESSION}, client_ip, client_port, server_ip, server_port, min(start_us) AS start_us, max(ts_us) AS last_us,
    """ + ", ".join(
    f"{o.count_if(f'dir = {d}')} AS {s}_pkts, {o.sum_if('payload_len', f'dir = {d}')} AS {s}_bytes, "
    f"{o.sum_if('wire_len', f'dir = {d}')} AS {s}_l2_bytes, {o.count_if(f'dir = {d} AND ip_proto = 6 AND (tcp_flags & 4) <> 0')} AS {s}_aborts"
    for s, d in (("client", 1), ("server", -1))) + """,
    (max(ts_us) - min(start_us)) // 1000 AS age_ms,
    NOT (bool_or(dir = 1 AND ip_proto = 6 AND (tcp_flags & 5) <> 0) AND bool_or(dir = -1 AND ip_proto = 6 AND (tcp_flags & 5) <> 0)) AS expired
  FROM pf GROUP BY ALL)"""


@query("flow_summary", o.with_(P, SS, SUMMARY, "SELECT * FROM summary"))
def flow_summary(spark, sf):
    return flows.flow_summary(fx.flow_packets(spark, sf))


# A cycle of 5 ms gives ticks inside the short conversations of the packets.
@query("flow_open_tick_close", o.with_(P, SS, SUMMARY, f"""
SELECT {SESSION}, 'open' AS way, start_us AS at_us FROM summary UNION ALL SELECT {SESSION}, 'close', last_us FROM summary
UNION ALL SELECT {SESSION}, 'tick', unnest(generate_series(start_us + 5000, last_us, 5000)) FROM summary"""))
def flow_open_tick_close(spark, sf):
    return flows.flow_ticks(flows.flow_summary(fx.flow_packets(spark, sf)), cycle_us=5000)


_HS = ("client_ip, client_port, server_ip, server_port, client_mac, server_mac, vlan_id, start_us, isn, syn_count, opened, "
       "syn_us, synack_us, connected_us, has_data, connect_us")


@query("handshake", o.with_(P, SS, o.HANDSHAKE, f"SELECT {SESSION}, {_HS} FROM hs"))
def handshake(spark, sf):
    return tcp.handshake(fx.flow_packets(spark, sf))


@query("half_open", o.with_(P, SS, o.HANDSHAKE, f"""
SELECT {SESSION}, start_us, syn_count, CASE WHEN isn IS NOT NULL THEN 'syn_unanswered' ELSE 'synack_orphan' END AS kind
FROM hs WHERE (isn IS NOT NULL AND synack_us IS NULL) OR (isn IS NULL AND NOT has_data)"""))
def half_open(spark, sf):
    return tcp.half_open(tcp.handshake(fx.flow_packets(spark, sf)))


# Three in ten SYN-ACK packets get a wrong number so that errors occur.
@query("tcp_errors", o.with_(P, SS, f"""
SELECT window_us, {o.count_if("cause = 'syn'")} AS syn_malformed, {o.count_if("cause = 'session'")} AS syn_broken,
  {o.count_if("cause = 'ack'")} AS ack_broken
FROM (SELECT {o.window()} AS window_us, 'syn' AS cause FROM packets WHERE ip_proto = 6 AND (tcp_flags & 2) <> 0 AND payload_len > 0
      UNION ALL SELECT {o.window()}, CASE WHEN start_isn IS NULL THEN 'session' ELSE 'ack' END FROM pf
      WHERE ip_proto = 6 AND (tcp_flags & 18) = 18
        AND (start_isn IS NULL OR tcp_ack + CASE WHEN packet_id % 10 < 3 THEN 7 ELSE 0 END <> start_isn + 1)) GROUP BY window_us"""))
def tcp_errors(spark, sf):
    wrong = F.col("tcp_ack") + F.when(net.syn_ack() & (F.col("packet_id") % 10 < 3), 7).otherwise(0)
    return tcp.tcp_errors(fx.packets(spark, sf), fx.flow_packets(spark, sf).withColumn("tcp_ack", wrong))


@query("tcp_close", o.with_(P, SS, o.CLOSE, "SELECT * FROM closes"))
def tcp_close(spark, sf):
    return tcp.tcp_close(fx.flow_packets(spark, sf))


@query("node_connections", o.with_(P, SS, o.HANDSHAKE, o.CLOSE, o.CONNECTIONS, "SELECT * FROM connections"))
def node_connections(spark, sf):
    rows = fx.flow_packets(spark, sf)
    return tcp.node_connections(tcp.handshake(rows), tcp.tcp_close(rows))


@query("flow_windows", o.with_(P, SS, f"""
SELECT {SESSION}, dir, max(tcp_window) AS max_window, {o.count_if('tcp_window = 0')} AS zero_windows
FROM pf WHERE ip_proto = 6 AND (tcp_flags & 7) = 0 GROUP BY ALL"""))
def flow_windows(spark, sf):
    return tcp.flow_windows(fx.flow_packets(spark, sf))


# No packet is urgent; one data packet in thirteen is given an urgent part.
@query("flow_urgent", o.with_(P, SS, f"""
SELECT {SESSION}, dir, count(*) AS urgent_pkts, {o.sum_if('packet_id % 13')} AS urgent_bytes
FROM pf WHERE ip_proto = 6 AND payload_len > 0 AND packet_id % 13 = 5 GROUP BY ALL"""))
def flow_urgent(spark, sf):
    urgent = F.when((F.col("payload_len") > 0) & (F.col("packet_id") % 13 == 5), 5).otherwise(0)
    return tcp.flow_urgent(fx.flow_packets(spark, sf).withColumn("tcp_urgent", urgent))


@query("packet_gaps", o.with_(P, SS, f"""
SELECT {SESSION}, dir, min(CASE WHEN gap > 0 THEN gap END) AS min_gap_us, count(*) AS data_pkts
FROM (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY {SESSION}, dir ORDER BY ts_us, packet_id) AS gap
      FROM pf WHERE ip_proto = 6 AND payload_len > 0) GROUP BY ALL"""))
def packet_gaps(spark, sf):
    return tcp.packet_gaps(fx.flow_packets(spark, sf))


@query("turns", o.with_(P, SS, f"""
SELECT {SESSION}, count(*) AS turns, {', '.join(f'CAST({f}({c}) AS BIGINT) AS {f}_{c}' for c in ('time', 'interval', 'bytes') for f in ('sum', 'min', 'max'))}
FROM (SELECT {SESSION}, (max(ts_us) - min(ts_us)) // 1000 AS time, sum(payload_len) AS bytes,
        (lead(min(ts_us)) OVER (PARTITION BY {SESSION} ORDER BY turn) - max(ts_us)) // 1000 AS interval
      FROM (SELECT *, sum(change) OVER (PARTITION BY {SESSION} ORDER BY ts_us, packet_id) AS turn
            FROM (SELECT *, CASE WHEN dir IS DISTINCT FROM lag(dir) OVER (PARTITION BY {SESSION} ORDER BY ts_us, packet_id) THEN 1 ELSE 0 END AS change
                  FROM pf WHERE ip_proto = 6 AND payload_len > 0)) GROUP BY {SESSION}, turn)
WHERE interval IS NOT NULL GROUP BY {SESSION}"""))
def turns(spark, sf):
    return tcp.turns(fx.flow_packets(spark, sf))


RTT = f"""segs AS (
  SELECT {SESSION}, side, pos + payload_len + syn AS point, min(ts_us) AS sent_us FROM line WHERE kind = 'seq' AND payload_len > 0 GROUP BY ALL),
acked AS (
  SELECT {SESSION}, side, point, sent_us, min(a.ts_us) AS acked_us
  FROM segs LEFT JOIN (SELECT {SESSION}, side, pos, ts_us FROM line WHERE kind = 'ack') a USING ({SESSION}, side)
  WHERE a.pos IS NULL OR a.pos >= point GROUP BY ALL),
samples AS (SELECT {SESSION}, side, sent_us, acked_us, acked_us - sent_us AS rtt_us FROM acked WHERE acked_us > sent_us)"""


@query("rtt_samples", o.with_(P, SS, o.LINE, RTT, "SELECT * FROM samples"))
def rtt_samples(spark, sf):
    return tcp.rtt_samples(line(spark, sf)).drop("point")


@query("flow_rtt", o.with_(P, SS, o.LINE, RTT, f"""
SELECT {SESSION}, side, count(*) AS rtt_count, {o.sum_if('rtt_us')} AS rtt_sum, {o.big('sum(rtt_us) // count(*)')} AS rtt_mean FROM samples GROUP BY ALL"""))
def flow_rtt(spark, sf):
    return tcp.flow_rtt(tcp.rtt_samples(line(spark, sf)))


# The client's acknowledgement of the first response (step 7) is given a hole and blocks: one that covers the second segment, one that ends
# within it, or one of bytes that are acknowledged anyway.
_SACK_ACK = "CASE WHEN conv_id % 5 = 0 AND packet_id % 16 = 7 AND conv_id % 3 < 2 THEN 1001 ELSE tcp_ack END"
_SACK_EDGES = ("CASE conv_id % 3 WHEN 0 THEN 2001 WHEN 1 THEN 2001 ELSE 1001 END", "CASE conv_id % 3 WHEN 0 THEN 2461 WHEN 1 THEN 2400 ELSE 2001 END")
_SACKED = "conv_id % 5 = 0 AND packet_id % 16 = 7"


@query("rtt_samples_sack", o.with_(P, SS.replace("FROM packets WHERE", f"FROM (SELECT * REPLACE ({_SACK_ACK} AS tcp_ack) FROM packets) WHERE"), o.LINE, f"""
blocks AS (
  SELECT {SESSION}, side, l.ts_us, l.pos + e_lo - l.value AS lo, l.pos + e_hi - l.value AS hi
  FROM (SELECT *, {_SACK_EDGES[0]} AS e_lo, {_SACK_EDGES[1]} AS e_hi FROM (SELECT *, (packet_id // 16) AS conv_id FROM line) WHERE kind = 'ack' AND {_SACKED}) l
  WHERE e_lo >= l.value)""", f"""
segs AS (SELECT {SESSION}, side, pos + payload_len + syn AS point, min(ts_us) AS sent_us FROM line WHERE kind = 'seq' AND payload_len > 0 GROUP BY ALL),
told AS (
  SELECT {SESSION}, side, point, a.ts_us FROM segs JOIN (SELECT {SESSION}, side, pos, ts_us FROM line WHERE kind = 'ack') a USING ({SESSION}, side) WHERE a.pos >= point
  UNION ALL SELECT {SESSION}, side, point, b.ts_us FROM segs JOIN blocks b USING ({SESSION}, side) WHERE b.lo < point AND point <= b.hi)""", f"""
SELECT {SESSION}, side, sent_us, min(told.ts_us) AS acked_us, min(told.ts_us) - sent_us AS rtt_us FROM segs JOIN told USING ({SESSION}, side, point)
GROUP BY {SESSION}, side, point, sent_us HAVING min(told.ts_us) > sent_us"""))
def rtt_samples_sack(spark, sf):
    """Round trips where segments are acknowledged selectively."""
    edge = [F.expr(e).cast("bigint") for e in _SACK_EDGES]
    sacks = F.when(F.expr(_SACKED), F.array(F.struct(edge[0].alias("left"), edge[1].alias("right"))))
    packets = fx.flow_packets(spark, sf).withColumn("conv_id", F.floor(F.col("packet_id") / 16))
    packets = packets.withColumns({"tcp_ack": F.expr(_SACK_ACK).cast("bigint"), "sacks": sacks})
    return tcp.rtt_samples(tcp.positions(packets)).drop("point")


# A queue of one segment, as the short conversations never fill the usual 128.
@query("outstanding_limit", o.with_(P, SS, o.LINE, RTT, f"""
SELECT {SESSION}, side, count(*) AS segments, {o.count_if('later >= 1')} AS rtt_dropped
FROM (SELECT s.{SESSION.replace(', ', ', s.')}, s.side, s.point, count(n.point) AS later
      FROM (SELECT segs.*, acked.acked_us FROM segs LEFT JOIN acked USING ({SESSION}, side, point)) s
      LEFT JOIN segs n ON {' AND '.join(f's.{k} = n.{k}' for k in SESSION.split(', '))} AND s.side = n.side
        AND (n.sent_us > s.sent_us OR (n.sent_us = s.sent_us AND n.point > s.point)) AND n.sent_us < coalesce(s.acked_us, 4611686018427387904)
      GROUP BY ALL) GROUP BY {SESSION}, side"""))
def outstanding_limit(spark, sf):
    return tcp.outstanding_limit(line(spark, sf), limit=1)


CLASSES = f"""classes AS (
  SELECT *, CASE WHEN rn > 1 THEN 'duplicate' WHEN high IS NULL THEN 'order' WHEN pos > high THEN 'ahead' WHEN pos < high THEN 'fill' ELSE 'order' END AS class
  FROM (SELECT *, row_number() OVER (PARTITION BY {SESSION}, side, pos ORDER BY ts_us, packet_id) AS rn
        FROM (SELECT *, max(pos + payload_len + syn) OVER (PARTITION BY {SESSION}, side ORDER BY ts_us, packet_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high
              FROM line WHERE kind = 'seq') WHERE payload_len > 0))"""


@query("tcp_sequence_quality", o.with_(P, SS, o.LINE, CLASSES, f"""
SELECT {SESSION}, side, {', '.join(f'{o.count_if(f"class = {k!r}")} AS {k}_count, {o.sum_if("payload_len", f"class = {k!r}")} AS {k}_bytes' for k in ('order', 'ahead', 'fill', 'duplicate'))},
  {o.sum_if('pos - high', "class = 'ahead'")} AS skipped_bytes FROM classes GROUP BY {SESSION}, side"""))
def tcp_sequence_quality(spark, sf):
    return tcp.tcp_sequence_quality(tcp.segment_classes(line(spark, sf)))


@query("segments_by_seq", o.with_(P, SS, o.LINE, f"""
SELECT {SESSION}, side, ts_us, payload_len, copies, row_number() OVER (PARTITION BY {SESSION}, side ORDER BY pos) AS rank
FROM (SELECT {SESSION}, side, pos, min(ts_us) AS ts_us, max(payload_len) AS payload_len, count(*) AS copies
      FROM line WHERE kind = 'seq' AND payload_len > 0 GROUP BY ALL)"""))
def segments_by_seq(spark, sf):
    return tcp.segments_by_seq(line(spark, sf)).drop("pos")


_START = f"coalesce(max(pos + 1) FILTER (WHERE syn = 1), arg_min(pos, CAST(ts_us AS HUGEINT) * 100000000000 + packet_id) FILTER (WHERE payload_len > 0))"
_JOIN = " AND ".join(f"r.{k} = q.{k}" for k in SESSION.split(", ")) + " AND r.side = q.side"


@query("tcp_sequence_exact", o.with_(P, SS, o.LINE, f"""sent AS (
  SELECT line.*, start, row_number() OVER (PARTITION BY {SESSION}, side ORDER BY ts_us, packet_id) AS rk
  FROM line JOIN (SELECT {SESSION}, side, {_START} AS start FROM line WHERE kind = 'seq' GROUP BY ALL) USING ({SESSION}, side)
  WHERE kind = 'seq' AND payload_len > 0)""", f"""pieces AS (
  SELECT {SESSION}, side, pos AS lo, max(pos + payload_len) AS hi, min(rk) AS rk, max(start) AS start FROM sent GROUP BY {SESSION}, side, pos)""", f"""passed AS (
  SELECT r.{SESSION.replace(', ', ', r.')}, r.side, r.lo, r.hi, r.rk, coalesce(sum(q.hi - q.lo), 0) = r.lo - r.start AS open, coalesce(max(q.rk), 0) AS at_rk
  FROM pieces r LEFT JOIN pieces q ON {_JOIN} AND q.hi <= r.lo GROUP BY ALL, r.start)""".replace("GROUP BY ALL, r.start", f"GROUP BY r.{SESSION.replace(', ', ', r.')}, r.side, r.lo, r.hi, r.rk, r.start"),
    f"""classed AS (
  SELECT s.*, CASE WHEN open AND greatest(at_rk, p.rk) < s.rk THEN 'old' WHEN pos > start AND (NOT open OR at_rk > s.rk) THEN 'ahead' ELSE 'order' END AS class
  FROM sent s JOIN passed p ON {' AND '.join(f's.{k} = p.{k}' for k in SESSION.split(', '))} AND s.side = p.side AND s.pos = p.lo)""", f"""
SELECT * FROM (SELECT {SESSION}, side, {', '.join(f'{o.count_if(f"class = {k!r}")} AS {n}_count, {o.sum_if("payload_len", f"class = {k!r}")} AS {n}_bytes' for k, n in (('order', 'order'), ('ahead', 'reordered'), ('old', 'dropped')))},
  CAST(0 AS BIGINT) AS retransmit_count, CAST(0 AS BIGINT) AS retransmit_bytes FROM classed GROUP BY {SESSION}, side)
JOIN (SELECT {SESSION}, side, {o.sum_if('hi - lo', 'open')} AS stream_bytes, {o.big('max(hi) - max(start) - sum(hi - lo)')} AS missing_bytes
      FROM (SELECT passed.*, start FROM passed JOIN pieces USING ({SESSION}, side, lo, hi, rk)) GROUP BY {SESSION}, side) USING ({SESSION}, side)"""))
def tcp_sequence_exact(spark, sf):
    return tcp.sequence_exact(line(spark, sf))
