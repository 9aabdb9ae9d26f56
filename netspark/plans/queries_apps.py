"""DNS, HTTP, MySQL and ICMP transactions."""

from pyspark.sql import functions as F

from netspark.operators import metrics, transactions as tx
from netspark.plans import fixtures as fx
from netspark.plans import oracle as o
from netspark.plans.registry import query

DNS, HTTP, MYSQL = o.ORACLE_DNS, o.ORACLE_HTTP, o.ORACLE_MYSQL


@query("icmp_echo", o.with_(o.ORACLE_PACKETS, f"""
SELECT least(q.src_ip, q.dst_ip) AS ip_a, CASE WHEN q.src_ip < q.dst_ip THEN CAST(0 AS BIGINT) ELSE q.icmp_id END AS port_a,
  greatest(q.src_ip, q.dst_ip) AS ip_b, CASE WHEN q.src_ip < q.dst_ip THEN q.icmp_id ELSE CAST(0 AS BIGINT) END AS port_b,
  1 AS ip_proto, CAST(1 AS BIGINT) AS session_no, q.src_ip AS client_ip, q.dst_ip AS server_ip, q.icmp_id, q.icmp_seq,
  q.ts_us AS req_us, p.ts_us AS rsp_us, {o.big('q.l4_len')} AS out_bytes, {o.big('coalesce(p.l4_len, 0)')} AS in_bytes,
  p.ts_us - q.ts_us AS rtt_us
FROM packets q LEFT JOIN packets p ON p.src_ip = q.dst_ip AND p.dst_ip = q.src_ip AND p.icmp_id = q.icmp_id
  AND p.icmp_seq = q.icmp_seq AND p.icmp_type = 0 AND p.ts_us BETWEEN q.ts_us AND q.ts_us + 5000000
WHERE q.icmp_type = 8"""))
def icmp_echo(spark, sf):
    return tx.icmp_echo(fx.flow_packets(spark, sf))


_RCODE = "CASE r.rcode WHEN 0 THEN 'Okay' WHEN 1 THEN 'Format' WHEN 2 THEN 'Server' WHEN 3 THEN 'Name' WHEN 4 THEN 'Implemented' WHEN 5 THEN 'Refured' END"


@query("dns_txn", o.with_(DNS, f"""
SELECT coalesce(q.flow_id, r.flow_id) AS flow_id, coalesce(q.dns_id, r.dns_id) AS dns_id, CAST(1 AS BIGINT) AS txn_no,
  coalesce(q.client_ip, r.client_ip) AS client_ip, coalesce(q.server_ip, r.server_ip) AS server_ip, coalesce(q.qname, r.qname) AS qname,
  coalesce(q.qtype, r.qtype) AS qtype, coalesce(q.opcode, r.opcode) AS opcode, r.rcode, q.ts_us AS req_us, r.ts_us AS rsp_us,
  {o.big('q.ts_us IS NOT NULL')} AS req_pkts, {o.big('coalesce(q.bytes, 0)')} AS req_bytes, {o.big('r.ts_us IS NOT NULL')} AS rsp_pkts,
  {o.big('coalesce(r.bytes, 0)')} AS rsp_bytes, (r.ts_us - q.ts_us) // 1000 AS wait_ms, r.ts_us IS NULL AS req_timeout, {_RCODE} AS error
FROM (SELECT * FROM dns_msgs WHERE qr = 0) q FULL JOIN (SELECT * FROM dns_msgs WHERE qr = 1) r
  ON q.flow_id = r.flow_id AND q.dns_id = r.dns_id AND r.ts_us BETWEEN q.ts_us AND q.ts_us + 5000000"""))
def dns_txn(spark, sf):
    return tx.dns_txn(fx.dns_msgs(spark, sf))


@query("dns_unanswered", o.with_(DNS, """
SELECT flow_id, dns_id, client_ip, server_ip, qname, ts_us AS req_us FROM dns_msgs q WHERE qr = 0
AND NOT EXISTS (SELECT 1 FROM dns_msgs r WHERE r.qr = 1 AND r.flow_id = q.flow_id AND r.dns_id = q.dns_id)"""))
def dns_unanswered(spark, sf):
    return tx.dns_unanswered(tx.dns_txn(fx.dns_msgs(spark, sf)))


@query("dns_answers", o.with_(DNS, """
SELECT flow_id, dns_id, ts_us, CASE WHEN i IS NOT NULL THEN qname END AS name, CASE WHEN i IS NOT NULL THEN qtype END AS type,
  CASE WHEN i IS NOT NULL THEN concat('a', CAST(i AS VARCHAR)) END AS data, CASE WHEN i IS NOT NULL THEN 60 * i END AS ttl
FROM dns_msgs LEFT JOIN (VALUES (0), (1), (2)) v(i) ON i < answer_count"""))
def dns_answers(spark, sf):
    answer = lambda i: F.struct(F.col("qname").alias("name"), F.col("qtype").alias("type"),
                                F.concat(F.lit("a"), i.cast("string")).alias("data"), (60 * i).cast("int").alias("ttl"))
    numbers = F.when(F.col("answer_count") > 0, F.sequence(F.lit(0), F.col("answer_count") - 1))
    return tx.dns_answers(fx.dns_msgs(spark, sf).withColumn("answers", F.transform(numbers, answer)))


def dns_ends(spark, sf):
    """DNS messages with the addresses of their packets (no MAC is known: 0)."""
    query_ = F.col("qr") == 0
    return fx.dns_msgs(spark, sf).withColumns({
        "src_ip": F.when(query_, F.col("client_ip")).otherwise(F.col("server_ip")),
        "dst_ip": F.when(query_, F.col("server_ip")).otherwise(F.col("client_ip")),
        "src_mac": F.lit(0).cast("bigint"), "dst_mac": F.lit(0).cast("bigint"), "vlan_id": F.lit(0)})


def node_dns_rows(spark, sf):
    zero = F.lit(0).cast("bigint")
    txns = tx.dns_txn(fx.dns_msgs(spark, sf)).withColumns({"src_mac": zero, "dst_mac": zero, "vlan_id": F.lit(0)})
    return tx.node_dns(dns_ends(spark, sf), txns)


_NODE_DNS_SUMS = {
    "req_pkts": o.count_if("qr = 0"), "req_bytes": o.sum_if("bytes", "qr = 0"),
    "rsp_pkts": o.count_if("qr = 1"), "rsp_bytes": o.sum_if("bytes", "qr = 1"),
    **{f"req_opcode_{i}": o.count_if(f"qr = 0 AND opcode = {i}") for i in range(3)},
    **{f"rsp_rcode_{i}": o.count_if(f"qr = 1 AND rcode = {i}") for i in range(6)},
    "rsp_errors": o.count_if("qr = 1 AND rcode BETWEEN 1 AND 5"),
    "rtt_count": o.count_if("took IS NOT NULL"), "rtt_sum": o.sum_if("took"), "timeouts": o.count_if("late"),
    "rtt_min": "min(took)", "rtt_max": "max(took)"}
_NODE_DNS = f"""node_dns AS (
  SELECT {o.window()} AS window_us, CAST(0 AS BIGINT) AS mac, 0 AS vlan_id, ip, dir, {', '.join(f'{v} AS {k}' for k, v in _NODE_DNS_SUMS.items())}
  FROM (SELECT ts_us, qr, bytes, opcode, rcode, CAST(NULL AS BIGINT) AS took, FALSE AS late, CASE qr WHEN 0 THEN 1 ELSE -1 END AS dir, {o.node_ip('client_ip')} AS ip FROM dns_msgs
        UNION ALL SELECT ts_us, qr, bytes, opcode, rcode, NULL, FALSE, CASE qr WHEN 0 THEN -1 ELSE 1 END, {o.node_ip('server_ip')} FROM dns_msgs
        UNION ALL SELECT q.ts_us, NULL, NULL, NULL, NULL, r.ts_us - q.ts_us, r.ts_us IS NULL, d.dir, CASE d.dir WHEN 1 THEN {o.node_ip('q.client_ip')} ELSE {o.node_ip('q.server_ip')} END
        FROM (SELECT * FROM dns_msgs WHERE qr = 0) q LEFT JOIN (SELECT * FROM dns_msgs WHERE qr = 1) r USING (flow_id, dns_id)
        CROSS JOIN (VALUES (1), (-1)) d(dir))
  GROUP BY ALL)"""


@query("node_dns", o.with_(DNS, _NODE_DNS, "SELECT * FROM node_dns"))
def node_dns(spark, sf):
    return node_dns_rows(spark, sf)


_F = lambda name: f"nullif(trim(regexp_extract(head, '(?im)^{name}:[ \\t]*([^\\r\\n]*)', 1)), '')"
_PARSED = f"""parsed AS (
  SELECT flow_id, n, kind, ts_us, body_len,
    CASE WHEN kind = 'req' THEN regexp_extract(head, '^([A-Z]+) ', 1) END AS method,
    CASE WHEN kind = 'req' THEN regexp_extract(head, '^[A-Z]+ ([^ ]*) HTTP', 1) END AS url, 1 AS version,
    CASE WHEN kind = 'rsp' THEN CAST(regexp_extract(head, '^HTTP/1.1 ([0-9]+)', 1) AS INTEGER) END AS status,
    CASE WHEN kind = 'req' THEN {_F('Host')} END AS host, CASE WHEN kind = 'req' THEN {_F('Referer')} END AS referer,
    CASE WHEN kind = 'req' THEN {_F('User-Agent')} END AS user_agent, CASE WHEN kind = 'req' THEN {_F('X-Online-Host')} END AS online_host,
    {_F('Content-Type')} AS content_type, CAST({_F('Content-Length')} AS BIGINT) AS content_length, FALSE AS chunked, FALSE AS compressed
  FROM http_msgs)"""


def parsed(spark, sf):
    return tx.http_messages(fx.http_msgs(spark, sf))


@query("http_messages", o.with_(HTTP, _PARSED, "SELECT * FROM parsed"))
def http_messages(spark, sf):
    return parsed(spark, sf)


@query("http_txn", o.with_(HTTP, _PARSED, """
SELECT q.flow_id, q.turn_no, q.method, q.url, q.host, q.user_agent, q.referer, q.content_type AS req_content_type, p.content_type,
  p.status, p.chunked, p.compressed, q.ts_us AS req_us, p.ts_us AS rsp_us, q.body_len AS req_bytes, p.body_len AS rsp_bytes
FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY ts_us, n) AS turn_no FROM parsed WHERE kind = 'req') q
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY ts_us, n) AS turn_no FROM parsed WHERE kind = 'rsp') p USING (flow_id, turn_no)"""))
def http_txn(spark, sf):
    return tx.http_txn(parsed(spark, sf))


@query("pipelined_requests", o.with_(HTTP, """
SELECT flow_id, n, ts_us, coalesce(pending, 0) > 0 AS pipelined
FROM (SELECT *, sum(CASE kind WHEN 'req' THEN 1 ELSE -1 END) OVER (PARTITION BY flow_id ORDER BY ts_us, kind, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pending
      FROM http_msgs) WHERE kind = 'req'"""))
def pipelined_requests(spark, sf):
    return tx.pipelined_requests(fx.http_msgs(spark, sf))


# Messages are sent in segments of 1460 bytes, 1.1 ms apart.
@query("http_times", o.with_(HTTP, f"""
SELECT flow_id, n + 1 AS turn_no, (max(ts) FILTER (WHERE kind = 'req') - min(ts) FILTER (WHERE kind = 'req')) // 1000 AS req_ms,
  (max(ts) FILTER (WHERE kind = 'rsp') - min(ts) FILTER (WHERE kind = 'rsp')) // 1000 AS rsp_ms,
  CAST(floor((min(ts) FILTER (WHERE kind = 'rsp') - max(ts) FILTER (WHERE kind = 'req')) / 1000) AS BIGINT) AS wait_ms,
  {o.count_if("kind = 'req'")} AS req_pkts, {o.count_if("kind = 'rsp'")} AS rsp_pkts
FROM (SELECT flow_id, n, kind, ts_us + 1100 * unnest(generate_series(0, (length(head) + body_len - 1) // 1460)) AS ts FROM http_msgs)
GROUP BY flow_id, n"""))
def http_times(spark, sf):
    last = F.floor((F.length("head") + F.col("body_len") - 1) / 1460)
    rows = tx.numbered(fx.http_msgs(spark, sf))
    segments = rows.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return tx.http_times(segments.withColumn("ts_us", F.col("ts_us") + 1100 * F.col("_i")))


def http_ends(spark, sf):
    """Parsed messages with derived addresses, packet counts and round trips."""
    size = F.length("head") + F.col("body_len")
    heads = fx.http_msgs(spark, sf).select("flow_id", "n", "kind", size.alias("bytes"))
    client, server = 167772416 + F.col("flow_id"), 3232235776 + F.col("flow_id") % 7
    request = F.col("kind") == "req"
    zero = F.lit(0).cast("bigint")
    return parsed(spark, sf).join(heads, ["flow_id", "n", "kind"]).withColumns({
        "pkts": F.floor((F.col("bytes") + 1459) / 1460), "rtt_sum": 1000 + F.col("n") % 7 * 100, "rtt_count": F.lit(1),
        "src_mac": zero, "dst_mac": zero, "vlan_id": F.lit(0),
        "src_ip": F.when(request, client).otherwise(server), "dst_ip": F.when(request, server).otherwise(client),
    }).withColumn("l2_bytes", F.col("bytes") + 54 * F.col("pkts"))


_HTTP_ENDS = f"""http_ends AS (
  SELECT {o.window()} AS window_us, CAST(0 AS BIGINT) AS mac, 0 AS vlan_id, CASE WHEN (kind = 'req') = (dir = 1) THEN 167772416 + flow_id ELSE 3232235776 + flow_id % 7 END AS ip,
    dir, kind, method, status, bytes, (bytes + 1459) // 1460 AS pkts, 1000 + n % 7 * 100 AS rtt_sum
  FROM (SELECT p.*, length(m.head) + m.body_len AS bytes FROM parsed p JOIN http_msgs m USING (flow_id, n, kind)) CROSS JOIN (VALUES (1), (-1)) d(dir))"""
_NODE_HTTP = f"""node_http AS (
  SELECT window_us, mac, vlan_id, ip, dir, {o.count_if("kind = 'req'")} AS requests, {o.count_if("kind = 'rsp'")} AS responses,
    {o.sum_if('pkts')} AS pkts, {o.sum_if('bytes')} AS bytes, {o.sum_if('bytes + 54 * pkts')} AS l2_bytes,
    {o.count_if("kind = 'req' AND method IS NOT NULL")} AS methods, {o.count_if("kind = 'rsp' AND status >= 400")} AS errors,
    {o.sum_if('rtt_sum')} AS rtt_sum, count(*) AS rtt_count, {o.big('sum(rtt_sum) // count(*)')} AS rtt_mean
  FROM http_ends GROUP BY ALL)"""


@query("node_http", o.with_(HTTP, _PARSED, _HTTP_ENDS, _NODE_HTTP, "SELECT * FROM node_http"))
def node_http(spark, sf):
    return tx.node_http(http_ends(spark, sf))


@query("http_method_counts", o.with_(HTTP, _PARSED, """
SELECT kind, coalesce(method, CAST(status // 100 AS VARCHAR) || 'xx') AS label, count(*) AS n FROM parsed GROUP BY ALL"""))
def http_method_counts(spark, sf):
    return tx.http_method_counts(parsed(spark, sf))


_SIDE = lambda n, c: (f"min(ts_us) FILTER (WHERE is_command = {c}) AS {n}_first_us, max(ts_us) FILTER (WHERE is_command = {c}) AS {n}_last_us, "
                      f"{o.count_if(f'is_command = {c}')} AS {n}_count, {o.sum_if('bytes', f'is_command = {c}')} AS {n}_bytes")


@query("mysql_txn", o.with_(MYSQL, f"""
SELECT flow_id, command_no, max(CASE is_command WHEN 1 THEN command END) AS command, {_SIDE('req', 1)}, {_SIDE('rsp', 0)},
  {o.count_if('is_command = 0 AND bytes % 3 > 0')} AS rows, {o.count_if('is_command = 0 AND bytes % 3 = 0')} AS cols, CAST(0 AS BIGINT) AS sets
FROM (SELECT *, CAST(sum(is_command) OVER (PARTITION BY flow_id ORDER BY ts_us, is_command DESC, bytes ROWS UNBOUNDED PRECEDING) AS BIGINT) AS command_no FROM mysql_msgs)
WHERE command_no > 0 GROUP BY flow_id, command_no"""))
def mysql_txn(spark, sf):
    part = F.when(F.col("is_command") == 0, F.when(F.col("bytes") % 3 > 0, "row").otherwise("col"))
    return tx.mysql_txn(fx.mysql_msgs(spark, sf).withColumn("part", part))


def mysql_ends(spark, sf):
    client, server = 167772416 + F.col("flow_id"), 3232235776 + F.col("flow_id") % 7
    command = F.col("is_command") == 1
    zero = F.lit(0).cast("bigint")
    return fx.mysql_msgs(spark, sf).withColumns({
        "src_ip": F.when(command, client).otherwise(server), "dst_ip": F.when(command, server).otherwise(client),
        "src_mac": zero, "dst_mac": zero, "vlan_id": F.lit(0), "l2_bytes": F.col("bytes") + 58,
        "rtt_sum": 500 + F.col("bytes") % 7, "rtt_count": F.lit(1)})


_NODE_MYSQL = f"""node_mysql AS (
  SELECT {o.window()} AS window_us, CAST(0 AS BIGINT) AS mac, 0 AS vlan_id,
    CASE WHEN (is_command = 1) = (dir = 1) THEN 167772416 + flow_id ELSE 3232235776 + flow_id % 7 END AS ip, dir,
    count(*) AS pkts, {o.sum_if('bytes')} AS bytes, {o.sum_if('bytes + 58')} AS l2_bytes, {o.sum_if('is_command')} AS commands,
    {o.count_if('is_command = 0')} AS blocks, {o.sum_if('500 + bytes % 7')} AS rtt_sum, count(*) AS rtt_count,
    {o.big('sum(500 + bytes % 7) // count(*)')} AS rtt_mean
  FROM mysql_msgs CROSS JOIN (VALUES (1), (-1)) d(dir) GROUP BY ALL)"""


@query("node_mysql", o.with_(MYSQL, _NODE_MYSQL, "SELECT * FROM node_mysql"))
def node_mysql(spark, sf):
    return tx.node_mysql(mysql_ends(spark, sf))


def _app_metric_sql():
    out = []
    for d, c, m in (("dir = 1", "requests", "http.reqs"), ("dir = -1", "responses", "http.rsps"), ("dir = 1", "methods", "http.method"),
                    ("dir = -1", "errors", "http.error"),
                    *((f"dir = {x}", c, f"http.{s}_{c}") for s, x in (("req", 1), ("rsp", -1)) for c in ("pkts", "bytes", "l2_bytes"))):
        out.append(("node_http", m, o.sum_if(c, d)))
    out.append(("node_http", "http.rtt", o.big("sum(rtt_sum) // nullif(sum(rtt_count), 0)")))
    for d, c, m in (("dir = 1", "commands", "mysql.reqs"), ("dir = -1", "blocks", "mysql.blocks"),
                    *((f"dir = {x}", c, f"mysql.{s}_{c}") for s, x in (("req", 1), ("rsp", -1)) for c in ("pkts", "bytes", "l2_bytes"))):
        out.append(("node_mysql", m, o.sum_if(c, d)))
    out.append(("node_mysql", "mysql.rtt", o.big("sum(rtt_sum) // nullif(sum(rtt_count), 0)")))
    for c in ("req_pkts", "req_bytes", "rsp_pkts", "rsp_bytes"):
        out.append(("node_dns", f"dns.{c}", o.sum_if(c)))
    out += [("node_dns", f"dns.req_opcodes|dns_opcode|{i}", o.sum_if(f"req_opcode_{i}", "dir = -1")) for i in range(3)]
    out += [("node_dns", f"dns.rsp_rcodes|dns_rcode|{i}", o.sum_if(f"rsp_rcode_{i}")) for i in range(6)]
    out += [("node_dns", "dns.rsp_errors", o.sum_if("rsp_errors", "dir = 1")), ("node_dns", "dns.req_timeout", o.sum_if("timeouts"))]
    plain = " UNION ALL ".join(
        f"SELECT window_us, 'ip' AS level, mac, vlan_id, ip, '{m}' AS metric, {v} AS count, CAST(NULL AS BIGINT) AS sum, CAST(NULL AS BIGINT) AS min, CAST(NULL AS BIGINT) AS max "
        f"FROM {t} GROUP BY window_us, mac, vlan_id, ip" for t, m, v in out)
    unit = f"SELECT window_us, 'ip', mac, vlan_id, ip, 'dns.rtt', {o.sum_if('rtt_count')}, {o.sum_if('rtt_sum')}, min(rtt_min), max(rtt_max) FROM node_dns GROUP BY window_us, mac, vlan_id, ip"
    return f"SELECT * FROM ({plain} UNION ALL {unit}) WHERE count <> 0"


METRICS, METRIC_SQL = [DNS, HTTP, MYSQL, _NODE_DNS, _PARSED, _HTTP_ENDS, _NODE_HTTP, _NODE_MYSQL], _app_metric_sql()


@query("app_metric_rows", o.with_(*METRICS, METRIC_SQL))
def app_metric_rows(spark, sf):
    """The http.*, mysql.* and dns.* rows of the metric catalogue."""
    return metrics.app_metrics(node_dns_rows(spark, sf), tx.node_http(http_ends(spark, sf)), tx.node_mysql(mysql_ends(spark, sf)))
