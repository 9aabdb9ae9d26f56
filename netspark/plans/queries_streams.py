"""Queries on reassembled byte streams."""

from pyspark.sql import functions as F

from netspark import schema as S
from netspark.operators import flows, tcp, transactions as tx
from netspark.plans import fixtures as fx
from netspark.plans import frames as fr
from netspark.plans import oracle as o
from netspark.plans.registry import query
from netspark.sources import http_wire, mysql_wire, streams

P, SS, SESSION = o.ORACLE_PACKETS, o.SESSIONS, o.SESSION


def segments(spark, sf, app=None):
    """Data segments of the packets with their bytes."""
    rows = fx.flow_packets(spark, sf)
    if app:
        rows = rows.filter(flows.app_of_port() == app)
    return tcp.data_segments(tcp.positions(rows.withColumn("payload", fr.payload()), payload=True))


CRLF = "chr(13) || chr(10)"
# Content of a packet in upper-case hexadecimal, as `frames.payload` makes it.
CONTENT = f"""content AS (
  SELECT packet_id, CASE WHEN conv_id % 5 = 0 AND packet_id % 16 = 3
      THEN hex(rpad('GET /item/' || conv_id || ' HTTP/1.1' || {CRLF} || 'Host: h' || (conv_id % 7) || '.example.org' || {CRLF} || 'X-Pad: ', 196, 'x') || {CRLF} || {CRLF})
    WHEN conv_id % 5 = 0 AND packet_id % 16 IN (5, 10) THEN hex(rpad('HTTP/1.1 200 OK' || {CRLF} || 'Content-Length: 1419' || {CRLF} || {CRLF}, 1000, 'a'))
    WHEN conv_id % 5 = 0 AND packet_id % 16 = 6 THEN repeat('79', 460)
    WHEN conv_id % 5 = 1 AND packet_id % 16 = 3 THEN rpad('4A0000000A352E372E3100', 156, '0')
    WHEN conv_id % 5 = 1 AND packet_id % 16 = 4 THEN rpad('56000001080200000000000121' || repeat('00', 23) || hex('user' || conv_id) || '0000646200', 180, '0')
    WHEN conv_id % 5 = 1 AND packet_id % 16 = 5 THEN '0700000200000002000000'
    WHEN conv_id % 5 = 1 AND packet_id % 16 = 6 THEN '2400000003' || hex(rpad('SELECT ' || conv_id, 35, ' '))
    WHEN conv_id % 5 = 1 AND packet_id % 16 = 7 THEN '01000001012800000203' || repeat('61', 39) || '05000003FE0000020064000004' || repeat('63', 100)
      || '64000005' || repeat('63', 100) || '15000006' || repeat('14', 21) || '05000007FE00000200'
    ELSE repeat('00', payload_len) END AS hexed
  FROM packets WHERE payload_len > 0)"""


@query("tcp_stream_bytes", o.with_(P, SS, o.LINE, CONTENT, f"""
SELECT {SESSION}, side, pos + greatest(coalesce(high - pos, 0), 0) AS pos, ts_us, CAST(payload_len - greatest(coalesce(high - pos, 0), 0) AS INTEGER) AS bytes,
  md5(substr(hexed, 2 * greatest(coalesce(high - pos, 0), 0) + 1)) AS content, greatest(coalesce(pos - high, 0), 0) AS hole
FROM (SELECT *, max(pos + payload_len) OVER (PARTITION BY {SESSION}, side ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high
      FROM (SELECT {SESSION}, side, pos, min(ts_us) AS ts_us, max(payload_len) AS payload_len, arg_max(hexed, payload_len) AS hexed
            FROM line JOIN content USING (packet_id) WHERE kind = 'seq' AND payload_len > 0 GROUP BY ALL))
WHERE payload_len > greatest(coalesce(high - pos, 0), 0)"""))
def tcp_stream_bytes(spark, sf):
    return (streams.stream_bytes(segments(spark, sf), S.SESSION)
            .select(*S.SESSION, "side", "pos", "ts_us", F.length("payload").alias("bytes"), F.md5(F.hex("payload")).alias("content"), "hole"))


@query("http_body_framing", o.with_(o.ORACLE_HTTP, f"""
SELECT flow_id, CASE kind WHEN 'req' THEN 1 ELSE -1 END AS side, n + 1 AS n,
  CASE WHEN kind = 'req' THEN CASE WHEN body_len > 0 THEN 'length' ELSE 'none' END WHEN page_id % 3 = 2 THEN 'chunked' ELSE 'length' END AS framing,
  md5(CASE WHEN kind = 'req' AND body_len = 0 THEN head
      ELSE line || CASE WHEN kind = 'req' THEN host || 'Content-Length: 100' WHEN page_id % 3 = 2 THEN 'Transfer-Encoding: chunked' ELSE 'Content-Length: ' || strlen(html) END
        || {CRLF} || {CRLF} END) AS head,
  CAST(CASE WHEN kind = 'req' THEN body_len ELSE strlen(html) END AS BIGINT) AS body_len
FROM (SELECT m.*, p.page_id, p.html, substr(m.head, 1, instr(m.head, {CRLF}) + 1) AS line,
        regexp_extract(m.head, 'Host: [^\\r\\n]*\\r\\n') AS host
      FROM http_msgs m JOIN pages p ON p.page_id = m.n * 20 + m.flow_id)"""))
def http_body_framing(spark, sf):
    """With small chunks, so that messages cross them."""
    messages = http_wire.body_framing(fr.http_streams(spark, sf), ["flow_id"], size=16384, ahead=8192)
    return messages.select("flow_id", "side", "n", "framing", F.md5("head").alias("head"), "body_len")


def mysql_parts(spark, sf):
    packets = mysql_wire.mysql_packets(segments(spark, sf, "mysql"), S.SESSION)
    return mysql_wire.mysql_messages(packets, S.SESSION)


_PARTS = """(VALUES (-1, 0, 74, 'greeting', NULL), (1, 1, 86, 'login', NULL), (-1, 2, 7, 'login_reply', NULL), (1, 0, 36, 'command', NULL),
  (-1, 1, 1, 'response', 'set'), (-1, 2, 40, 'response', 'col'), (-1, 3, 5, 'response', 'eof'), (-1, 4, 100, 'response', 'row'),
  (-1, 5, 100, 'response', 'row'), (-1, 6, 21, 'response', 'row'), (-1, 7, 5, 'response', 'eof')) v(side, serial, bytes, kind, part)"""


@query("mysql_messages", o.with_(P, SS, f"""
SELECT {SESSION}, side, serial, CAST(bytes AS BIGINT) AS bytes, kind, part, CASE kind WHEN 'command' THEN rpad('SELECT ' || conv, 35, ' ') END AS argument
FROM (SELECT {SESSION}, min(conv_id) AS conv FROM pf WHERE 3306 IN (src_port, dst_port) AND payload_len > 0 GROUP BY {SESSION}) CROSS JOIN {_PARTS}"""))
def mysql_messages(spark, sf):
    return mysql_parts(spark, sf).select(*S.SESSION, "side", "serial", "bytes", "kind", "part", "argument")


@query("mysql_login", o.with_(P, SS, f"""
SELECT {SESSION}, '5.7.1' AS version, min(CASE packet_id % 16 WHEN 4 THEN ts_us END) AS req_us, min(CASE packet_id % 16 WHEN 5 THEN ts_us END) AS rsp_us,
  'user' || CAST(min(conv_id) AS VARCHAR) AS user, 'db' AS database, 'success' AS status
FROM pf WHERE 3306 IN (src_port, dst_port) GROUP BY {SESSION} HAVING max(payload_len) > 0"""))
def mysql_login(spark, sf):
    return mysql_wire.mysql_login(mysql_parts(spark, sf), S.SESSION)


@query("flow_protocol", o.with_(P, SS, f"""
SELECT {SESSION}, CASE WHEN bool_or(ip_proto = 17 AND 53 IN (src_port, dst_port)) THEN 'dns'
  WHEN bool_or(payload_len > 0 AND ip_proto = 6 AND 80 IN (src_port, dst_port)) THEN 'http'
  WHEN bool_or(payload_len > 0 AND ip_proto = 6 AND 3306 IN (src_port, dst_port)) THEN 'mysql' ELSE 'unknown' END AS app FROM pf GROUP BY {SESSION}"""))
def flow_protocol(spark, sf):
    return flows.flow_protocol(fx.flow_packets(spark, sf).withColumn("payload", fr.payload()))
