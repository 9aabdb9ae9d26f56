"""Packet and message tables derived from the given tables.

The text of each fixture is the same for both engines but for the expression
that turns a timestamp into microseconds.
"""

import itertools
import re
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netspark import schema as S
from netspark.operators import flows, tcp
from netspark.session import with_scheme, work_dir

_WRITTEN: dict[str, set[str]] = {}
_NUMBERS = itertools.count()

SPARK_TS_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"
DUCK_TS_US = "epoch_us(ts)"

F1 = r"""
WITH e AS (
  SELECT event_id, user_id, {TS_US} AS t0, event_id % 5 AS kind, event_id % 7 AS m7, event_id % 35 AS m35
  FROM events
), t(kind, step, dir, dt, plen, flags, cseq, sseq) AS (VALUES
  (0,0, 1,   0,   0,  2,  0,   0),(0,1,-1, 300,   0, 18,  1,   0),(0,2, 1, 500,   0, 16,  1,   1),
  (0,3, 1, 900, 200, 24,  1,   1),(0,4,-1,1400,   0, 16,201,   1),(0,5,-1,5000,1000, 24,201,   1),
  (0,6,-1,5200, 460, 24,201,1001),(0,7, 1,5600,   0, 16,201,1461),(0,8, 1,9000,   0, 17,201,1461),
  (0,9,-1,9300,   0, 17,202,1461),(0,10,-1,6000,1000, 24,201,  1),
  (1,0, 1,   0,   0,  2,  0,   0),(1,1,-1, 200,   0, 18,  1,   0),(1,2, 1, 400,   0, 16,  1,   1),
  (1,3,-1, 700,  78, 24,  1,   1),(1,4, 1,1100,  90, 24,  1,  79),(1,5,-1,1500,  11, 24, 91,  79),
  (1,6, 1,2000,  40, 24, 91,  90),(1,7,-1,7000, 300, 24,131,  90),(1,8, 1,7400,   0, 17,131, 390),
  (2,0, 1,   0,  40,  0,  0,   0),(2,1,-1,20000,120, 0,  0,   0),
  (3,0, 1,   0,  56,  0,  0,   0),(3,1,-1, 800,  56,  0,  0,   0),
  (4,0, 1,   0,  28,  0,  0,   0),(4,1,-1, 100,  28,  0,  0,   0)
), p AS (
  SELECT e.*, t.step, t.dir, t.cseq, t.sseq,
         t.dt + CASE WHEN e.event_id % 25 = 10 AND t.step = 5 THEN 300 ELSE 0 END AS dt,
         CASE WHEN e.event_id % 200 = 100 AND t.step = 0 THEN 10 ELSE t.plen END AS plen,
         CASE WHEN e.event_id % 30 = 1 AND t.step = 8 THEN 20 ELSE t.flags END AS flags,
         167772160 + 256 + user_id                      AS client_ip,
         CASE WHEN m7 = 0 THEN 134744072 ELSE 3232235776 + m7 END AS server_ip,
         20000 + event_id % 40000                       AS client_port,
         CASE e.kind WHEN 0 THEN 80 WHEN 1 THEN 3306 WHEN 2 THEN 53 ELSE 0 END AS server_port,
         CASE e.kind WHEN 0 THEN 6 WHEN 1 THEN 6 WHEN 2 THEN 17 WHEN 3 THEN 1 ELSE 0 END AS ip_proto
  FROM e JOIN t ON e.kind = t.kind
  WHERE NOT (e.m35 = 2 AND t.step = 1)
    AND NOT (e.kind = 0 AND e.m7 = 3 AND t.step IN (8, 9))
    AND NOT (e.event_id % 100 = 0 AND t.step > 0)
    AND NOT (t.step = 10 AND e.event_id % 15 <> 5)
)
SELECT event_id * 16 + step AS packet_id, event_id AS conv_id, t0 + dt AS ts_us,
  CAST(CASE WHEN kind <= 1 THEN 54 WHEN kind = 4 THEN 14 ELSE 42 END + plen AS INT) AS wire_len,
  CAST(plen AS INT) AS payload_len,
  CASE WHEN kind = 4 THEN 2054 ELSE 2048 END AS eth_type,
  CAST(CASE WHEN m7 = 5 THEN 100 ELSE 0 END AS INT) AS vlan_id,
  CASE WHEN dir = 1 THEN 2199023255552 + user_id ELSE 2199023321088 + m7 END AS src_mac,
  CASE WHEN kind = 4 AND step = 0 THEN 281474976710655
       WHEN dir = 1 THEN 2199023321088 + m7 ELSE 2199023255552 + user_id END AS dst_mac,
  CASE WHEN dir = 1 THEN client_ip ELSE server_ip END AS src_ip,
  CASE WHEN dir = 1 THEN server_ip ELSE client_ip END AS dst_ip,
  ip_proto,
  CAST(CASE WHEN ip_proto IN (6,17) THEN CASE WHEN dir = 1 THEN client_port ELSE server_port END ELSE 0 END AS INT) AS src_port,
  CAST(CASE WHEN ip_proto IN (6,17) THEN CASE WHEN dir = 1 THEN server_port ELSE client_port END ELSE 0 END AS INT) AS dst_port,
  flags AS tcp_flags,
  CAST(CASE WHEN ip_proto = 6 THEN 1000 + CASE WHEN dir = 1 THEN cseq ELSE sseq END ELSE 0 END AS BIGINT) AS tcp_seq,
  CAST(CASE WHEN ip_proto = 6 AND step > 0 THEN 1000 + CASE WHEN dir = 1 THEN sseq ELSE cseq END ELSE 0 END AS BIGINT) AS tcp_ack,
  CASE WHEN ip_proto = 6 THEN CASE WHEN event_id % 50 = 0 AND step = 7 THEN 0 ELSE 29200 END ELSE 0 END AS tcp_window,
  CASE WHEN kind = 3 THEN CASE WHEN dir = 1 THEN 8 ELSE 0 END END AS icmp_type,
  CASE WHEN kind = 4 THEN CASE WHEN dir = 1 THEN 1 ELSE 2 END END AS arp_op
FROM p
"""

F2 = r"""
WITH p AS (
  SELECT page_id, page_id % 20 AS flow_id, CAST(floor(page_id / 20) AS BIGINT) AS n,
         regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+(.*)$', 1) AS path,
         CAST(length(html) AS BIGINT) AS html_len
  FROM pages
)
SELECT flow_id, n, 'req' AS kind, n * 50000 AS ts_us,
       concat(CASE page_id % 4 WHEN 0 THEN 'POST' WHEN 1 THEN 'HEAD' ELSE 'GET' END, ' ', path, ' HTTP/1.1', chr(13), chr(10),
              'Host: ', host, chr(13), chr(10), 'User-Agent: ua', CAST(page_id % 3 AS VARCHAR(9)), chr(13), chr(10), chr(13), chr(10)) AS head,
       CAST(CASE WHEN page_id % 4 = 0 THEN 100 ELSE 0 END AS BIGINT) AS body_len
FROM p
UNION ALL
SELECT flow_id, n, 'rsp' AS kind, n * 50000 + 20000 + CASE WHEN n % 7 = 0 THEN 40000 ELSE 0 END AS ts_us,
       concat('HTTP/1.1 ', CASE page_id % 10 WHEN 3 THEN '404 Not Found' WHEN 7 THEN '500 Error' WHEN 9 THEN '302 Found' ELSE '200 OK' END, chr(13), chr(10),
              'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', CAST(html_len AS VARCHAR(9)), chr(13), chr(10), chr(13), chr(10)) AS head,
       html_len AS body_len
FROM p
"""

F3 = r"""
WITH e AS (SELECT event_id, user_id, {TS_US} AS t0 FROM events), q(qr) AS (VALUES (0),(1))
SELECT user_id AS flow_id, event_id AS dns_id, q.qr, t0 + CASE WHEN qr = 1 THEN 1000 + (event_id % 97) * 500 ELSE 0 END AS ts_us,
       167772416 + user_id AS client_ip, 3232235776 + event_id % 7 AS server_ip,
       CAST(CASE WHEN event_id % 40 = 0 THEN 2 ELSE 0 END AS INT) AS opcode,
       CAST(CASE WHEN qr = 1 AND event_id % 10 = 9 THEN event_id % 6 ELSE 0 END AS INT) AS rcode,
       concat('h', CAST(user_id AS VARCHAR(9)), '.example.org') AS qname,
       CASE event_id % 3 WHEN 0 THEN 'Address' WHEN 1 THEN 'Canonical Name' ELSE 'Text' END AS qtype,
       CAST(CASE WHEN qr = 1 THEN event_id % 4 ELSE 0 END AS INT) AS answer_count,
       CAST(40 + 80 * qr AS INT) AS bytes
FROM e CROSS JOIN q
WHERE NOT (qr = 1 AND event_id % 35 = 2)
"""

F4 = r"""
SELECT o_custkey % 50 AS flow_id, o_orderkey * 1000000 AS ts_us, 1 AS is_command, 3 AS command, o_orderkey % 90 + 10 AS bytes
FROM orders
UNION ALL
SELECT o_custkey % 50 AS flow_id,
       o_orderkey * 1000000 + 1000 * row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS ts_us,
       0 AS is_command, 0 AS command, CAST(l_quantity AS BIGINT) + 20 AS bytes
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""


# Seconds by which packets are later, so that silences fall before, in and after the established phase, and behind repeated openings.
SILENCES = """CASE conv_id % 13 WHEN 1 THEN CASE WHEN packet_id % 16 >= 1 THEN 10 ELSE 0 END
  WHEN 2 THEN CASE WHEN packet_id % 16 >= 2 THEN 10 ELSE 0 END WHEN 3 THEN CASE WHEN packet_id % 16 >= 5 THEN 10 ELSE 0 END
  WHEN 4 THEN CASE WHEN packet_id % 16 >= 9 THEN 10 ELSE 0 END WHEN 5 THEN CASE WHEN packet_id % 16 >= 2 THEN 8 WHEN packet_id % 16 = 1 THEN 4 ELSE 0 END
  WHEN 6 THEN CASE WHEN packet_id % 16 >= 4 THEN 601 ELSE 0 END WHEN 7 THEN CASE WHEN packet_id % 16 >= 9 THEN 4 ELSE 0 END ELSE 0 END * 1000000"""

_TABLES = {F1: ["events"], F2: ["pages"], F3: ["events"], F4: ["orders", "lineitem"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    inputs = {name: table(spark, sf_dir, name) for name in _TABLES[text]}
    # The rows made from one input row stay together; a join deals its rows out itself.
    inputs = {name: spread(rows) for name, rows in inputs.items()} if len(inputs) == 1 else inputs
    text = text.replace("{TS_US}", SPARK_TS_US)
    for name in inputs:
        text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
    return spark.sql(text, **inputs)


def spread(rows: DataFrame) -> DataFrame:
    """Rows of very few input splits (small test tables) dealt out over the cores; others as they are.

    For tables that are read only: to count the partitions of a plan with
    shuffles runs these shuffles.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < min(cores, 8) else rows


def materialized(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """The rows of `build()` as a parquet table in the shared work folder.

    Jobs on packets start from a decoded packet table.  It is written once per
    application and read with pushed filters and pruned columns afterwards, so
    a lost executor costs a re-read and not a re-decode.
    """
    path, written = _place(spark, sf_dir, name)
    if path not in written:
        build().write.mode("overwrite").parquet(path)
        written.add(path)
    return spark.read.parquet(path)


def _place(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, set[str]]:
    """Where a shared table lies, and what this application has written."""
    path = f"{work_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{crc32(sf_dir.encode()):08x}"
    return path, _WRITTEN.setdefault(spark.sparkContext.applicationId, set())


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared work folder, with its scheme: files are also opened there without Spark."""
    return with_scheme(spark, f"{work_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{next(_NUMBERS)}")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 in the layout of the packet schema, as a written table."""
    return materialized(spark, sf_dir, "packets", lambda: build_packets(spark, sf_dir))


def silent_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets with silences inside conversations."""
    return packets(spark, sf_dir).withColumn("ts_us", F.col("ts_us") + F.expr(SILENCES).cast("bigint"))


def flow_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets with their flow columns, as a written table that flow jobs share."""
    return materialized(spark, sf_dir, "flow_packets", lambda: flows.packets_with_flow(packets(spark, sf_dir)))


# What flows are made from, and what the reports on connections and services read of them.
FLOW_INPUT = ["packet_id", "ts_us", "src_mac", "dst_mac", "vlan_id", "src_ip", "dst_ip", "ip_proto", "frag_offset", "l4_len", "src_port", "dst_port",
              "tcp_flags", "tcp_seq", "tcp_ack", "payload_len", "icmp_type", "icmp_id", "icmp_seq"]
TCP_REPORTS = ["packet_id", "ts_us", "src_mac", "dst_mac", "vlan_id", "src_ip", "dst_ip", "l4_len", "tcp_flags", "tcp_seq", "tcp_ack", *S.SESSION,
               "start_us", "start_isn", "dir", "client_ip", "client_port", "server_ip", "server_port", "client_mac", "server_mac"]


def tcp_flow_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow packets of TCP with the columns of `TCP_REPORTS`, of the shared table where this application has it.

    A flow is of one protocol, so its sessions do not depend on other packets;
    few columns make the sort by flow and the table cheaper.
    """
    path, written = _place(spark, sf_dir, "flow_packets")
    if path in written:
        return tcp.tcp(flow_packets(spark, sf_dir)).select(*TCP_REPORTS)
    return materialized(spark, sf_dir, "tcp_flow_packets",
                        lambda: flows.packets_with_flow(tcp.tcp(packets(spark, sf_dir)).select(*FLOW_INPUT)).select(*TCP_REPORTS))


def tcp_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unwrapped sequence and acknowledgement numbers, as a written table that the TCP jobs share."""
    return materialized(spark, sf_dir, "tcp_line", lambda: tcp.positions(flow_packets(spark, sf_dir)))


def build_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 with the remaining columns of the packet schema."""
    ip = F.col("ip_proto") != 0
    return _run(spark, sf_dir, F1).withColumns({
        "cap_len": F.col("wire_len"), "mpls_label": F.lit(0), "frag_offset": F.lit(0),
        "l3_len": F.when(ip, F.col("wire_len") - 14).otherwise(0),
        "l4_len": F.when(ip, F.col("wire_len") - 34).otherwise(0),
        "tcp_urgent": F.lit(0), "icmp_code": F.when(F.col("ip_proto") == 1, 0),
        "icmp_id": F.when(F.col("ip_proto") == 1, F.col("conv_id")),
        "icmp_seq": F.when(F.col("ip_proto") == 1, 0)})


def http_msgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, sf_dir, "http_msgs", lambda: _run(spark, sf_dir, F2))


def dns_msgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, sf_dir, "dns_msgs", lambda: _run(spark, sf_dir, F3))


def mysql_msgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, sf_dir, "mysql_msgs", lambda: _run(spark, sf_dir, F4))


def _duck(text: str) -> str:
    return text.replace("{TS_US}", DUCK_TS_US)


# The same tables for the checking engine, as common table expressions.
ORACLE_PACKETS = f"""packets AS (
  SELECT *, wire_len AS cap_len, 0 AS mpls_label, 0 AS frag_offset, 0 AS tcp_urgent,
    CASE WHEN ip_proto <> 0 THEN wire_len - 14 ELSE 0 END AS l3_len,
    CASE WHEN ip_proto <> 0 THEN wire_len - 34 ELSE 0 END AS l4_len,
    CASE WHEN ip_proto = 1 THEN conv_id END AS icmp_id,
    CASE WHEN ip_proto = 1 THEN 0 END AS icmp_seq
  FROM ({_duck(F1)}))"""
ORACLE_SILENT = ORACLE_PACKETS.replace("packets AS (", "plain_packets AS (", 1) + f""",
packets AS (SELECT * REPLACE (ts_us + {SILENCES} AS ts_us) FROM plain_packets)"""
ORACLE_HTTP = f"http_msgs AS ({_duck(F2)})"
ORACLE_DNS = f"dns_msgs AS ({_duck(F3)})"
ORACLE_MYSQL = f"mysql_msgs AS ({_duck(F4)})"
