"""Pieces of check SQL shared by several queries (text for the checking engine only)."""

from netspark.plans.fixtures import ORACLE_DNS, ORACLE_HTTP, ORACLE_MYSQL, ORACLE_PACKETS, ORACLE_SILENT  # noqa: F401


def with_(*parts: str) -> str:
    *ctes, body = parts
    return "WITH " + ",\n".join(ctes) + "\n" + body


def window(ts: str = "ts_us", seconds: int = 30) -> str:
    return f"({ts} - {ts} % {seconds * 1000000})"


LOCAL = "(({0} >> 24) = 10 OR ({0} >> 20) = 2753 OR ({0} >> 16) = 49320)"


def local(ip: str) -> str:
    return LOCAL.format(ip)


def node_ip(ip: str) -> str:
    return f"CASE WHEN {local(ip)} THEN {ip} ELSE 0 END"


def mac_class(mac: str) -> str:
    return (f"CASE {mac} WHEN 1652522221568 THEN 'stp' WHEN 281474976710655 THEN 'bcast' "
            f"ELSE CASE WHEN (({mac} >> 40) & 1) = 1 THEN 'mcast' ELSE 'ucast' END END")


L2 = ("CASE WHEN vlan_id > 0 THEN 'vlan' WHEN mpls_label > 0 THEN 'mpls' WHEN eth_type = 2048 THEN 'ipv4' "
      "WHEN eth_type = 2054 THEN 'arp' WHEN eth_type = 33024 THEN 'vlan' WHEN eth_type = 34887 THEN 'mpls' "
      "WHEN eth_type = 34825 THEN 'lacp' WHEN eth_type = 34525 THEN 'ipv6' ELSE 'other' END")
L3 = "CASE ip_proto WHEN 1 THEN 'icmp' WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' ELSE 'other' END"
RANK = ("CASE WHEN wire_len <= 64 THEN '64' WHEN wire_len <= 128 THEN '128' WHEN wire_len <= 256 THEN '256' "
        "WHEN wire_len <= 512 THEN '512' WHEN wire_len <= 1024 THEN '1024' WHEN wire_len <= 1514 THEN '1514' "
        "WHEN wire_len <= 1518 THEN '1518' ELSE 'jumbo' END")

# One row per packet and end.
ENDS = f"""ends AS (
  SELECT *, {window()} AS window_us, 1 AS dir, src_mac AS mac, dst_mac AS peer_mac, {node_ip('src_ip')} AS ip FROM packets
  UNION ALL
  SELECT *, {window()} AS window_us, -1 AS dir, dst_mac AS mac, src_mac AS peer_mac, {node_ip('dst_ip')} AS ip FROM packets)"""

# One row per packet and end, with its classes.
FACTS = f"""facts AS (
  SELECT window_us, mac, CASE WHEN ip_proto <> 0 THEN vlan_id END AS vlan_id, CASE WHEN ip_proto <> 0 THEN ip END AS ip, dir,
    {L2} AS l2_type, CASE WHEN {mac_class('mac')} = 'ucast' THEN {mac_class('peer_mac')} END AS cast_class,
    {RANK} AS size_rank, CASE WHEN ip_proto <> 0 THEN {L3} END AS l3_type, wire_len, l3_len, l4_len
  FROM ends)"""


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def count_if(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def sum_if(value: str, cond: str = "TRUE") -> str:
    return big(f"coalesce(sum({value}) FILTER (WHERE {cond}), 0)")


# Sessions of flow keys.
SESSIONS = """keyed AS (
  SELECT *, CASE WHEN s_ip < d_ip OR (s_ip = d_ip AND s_port <= d_port) THEN s_ip ELSE d_ip END AS ip_a,
    CASE WHEN s_ip < d_ip OR (s_ip = d_ip AND s_port <= d_port) THEN s_port ELSE d_port END AS port_a,
    CASE WHEN s_ip < d_ip OR (s_ip = d_ip AND s_port <= d_port) THEN d_ip ELSE s_ip END AS ip_b,
    CASE WHEN s_ip < d_ip OR (s_ip = d_ip AND s_port <= d_port) THEN d_port ELSE s_port END AS port_b,
    CASE WHEN ip_proto = 6 AND (tcp_flags & 18) = 2 THEN tcp_seq END AS isn
  FROM (SELECT *, src_ip AS s_ip, dst_ip AS d_ip,
          CASE WHEN icmp_id IS NULL THEN src_port WHEN icmp_type = 8 THEN icmp_seq ELSE icmp_id END::BIGINT AS s_port,
          CASE WHEN icmp_id IS NULL THEN dst_port WHEN icmp_type = 8 THEN icmp_id ELSE icmp_seq END::BIGINT AS d_port
        FROM packets WHERE ip_proto <> 0 AND frag_offset = 0
          AND NOT (ip_proto = 6 AND (tcp_flags & 2) <> 0 AND payload_len > 0))),
prior AS (
  SELECT *, lag(ts_us) OVER w AS prev_ts,
    last_value(isn IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_isn
  FROM keyed WINDOW w AS (PARTITION BY ip_a, port_a, ip_b, port_b, ip_proto ORDER BY ts_us, packet_id)),
numbered AS (
  SELECT *, CAST(sum(CASE WHEN prev_ts IS NULL OR ts_us - prev_ts > CASE ip_proto WHEN 1 THEN 5000000 ELSE 600000000 END
                  OR (isn IS NOT NULL AND isn IS DISTINCT FROM prev_isn) THEN 1 ELSE 0 END)
    OVER (PARTITION BY ip_a, port_a, ip_b, port_b, ip_proto ORDER BY ts_us, packet_id) AS BIGINT) AS session_no
  FROM prior),
pf AS (
  SELECT *, first_value(ts_us) OVER f AS start_us, first_value(packet_id) OVER f AS start_packet,
    CASE WHEN first_value(s_ip) OVER f = s_ip AND first_value(s_port) OVER f = s_port THEN 1 ELSE -1 END AS dir,
    first_value(s_ip) OVER f AS client_ip, first_value(s_port) OVER f AS client_port,
    first_value(d_ip) OVER f AS server_ip, first_value(d_port) OVER f AS server_port,
    first_value(src_mac) OVER f AS client_mac, first_value(dst_mac) OVER f AS server_mac,
    first_value(isn) OVER f AS start_isn, row_number() OVER f AS rk
  FROM numbered WINDOW f AS (PARTITION BY ip_a, port_a, ip_b, port_b, ip_proto, session_no ORDER BY ts_us, packet_id))"""

KEY = "ip_a, port_a, ip_b, port_b, ip_proto"


def walked_sessions(opening: int = 5, closing: int = 5, active: int = 600, icmp: int = 5) -> str:
    """Sessions by walking each flow packet by packet with the session's phase: 0 SYN, 1 answered, 2 established, 3 closing."""
    same = " AND ".join(f"w.{k} = p.{k}" for k in KEY.split(", "))
    fresh = "CASE WHEN p.ip_proto <> 6 THEN 2 WHEN (p.tcp_flags & 18) = 2 THEN 0 WHEN (p.tcp_flags & 2) <> 0 THEN 1 WHEN (p.tcp_flags & 5) <> 0 THEN 3 ELSE 2 END"
    goes_on = ("CASE WHEN w.phase = 3 OR p.ip_proto <> 6 THEN w.phase WHEN (p.tcp_flags & 2) = 0 AND (p.tcp_flags & 5) <> 0 THEN 3 WHEN (p.tcp_flags & 2) = 0 THEN 2 "
               "WHEN w.phase = 0 AND (p.tcp_flags & 16) <> 0 AND p.tcp_ack = (p.prev_isn + 1) % 4294967296 THEN 1 ELSE w.phase END")
    lives = (f"p.ts_us + 1000000 * CASE {{0}} WHEN 0 THEN {opening} WHEN 1 THEN {opening} WHEN 3 THEN {closing} "
             f"ELSE CASE p.ip_proto WHEN 1 THEN {icmp} ELSE {active} END END")
    return f"""ordered AS (
  SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY ts_us, packet_id) AS place, isn IS NOT NULL AND isn IS DISTINCT FROM prev_isn AS new_isn FROM prior),
walked AS (
  WITH RECURSIVE w AS (
    SELECT {KEY}, place, packet_id, CAST(1 AS BIGINT) AS session_no, {fresh} AS phase, CAST({lives.format(fresh)} AS BIGINT) AS live FROM ordered p WHERE place = 1
    UNION ALL
    SELECT {', '.join(f'p.{k}' for k in KEY.split(', '))}, p.place, p.packet_id, w.session_no + CASE WHEN p.new_isn OR p.ts_us > w.live THEN 1 ELSE 0 END,
      CASE WHEN p.new_isn OR p.ts_us > w.live THEN {fresh} ELSE {goes_on} END,
      CAST(CASE WHEN p.new_isn OR p.ts_us > w.live THEN {lives.format(fresh)}
                WHEN {goes_on} = 2 OR {goes_on} <> w.phase THEN {lives.format(goes_on)} ELSE w.live END AS BIGINT)
    FROM w JOIN ordered p ON {same} AND p.place = w.place + 1)
  SELECT * FROM w)"""


#: The parts of SESSIONS up to the rows with the time and SYN number before, for sessions that are walked.
PRIOR = SESSIONS[:SESSIONS.index("numbered AS (")].rstrip().rstrip(",")
SESSION = KEY + ", session_no"

# Sequence and acknowledgement numbers per sending side, relative to the side's first one.
LINE = f"""marks AS (
  SELECT {SESSION}, ts_us, packet_id, payload_len, (tcp_flags & 2) // 2 AS syn, dir AS side, 'seq' AS kind, tcp_seq AS value
  FROM pf WHERE ip_proto = 6 AND (payload_len > 0 OR (tcp_flags & 3) <> 0)
  UNION ALL SELECT {SESSION}, ts_us, packet_id, payload_len, (tcp_flags & 2) // 2, -dir, 'ack', tcp_ack
  FROM pf WHERE ip_proto = 6 AND (tcp_flags & 16) <> 0),
line AS (
  SELECT *, value - first_value(value) OVER (PARTITION BY {SESSION}, side ORDER BY ts_us, packet_id) AS pos FROM marks)"""

HANDSHAKE = f"""hs0 AS (
  SELECT {SESSION}, client_ip, client_port, server_ip, server_port, min(start_us) AS start_us, max(start_isn) AS isn,
    max(client_mac) AS client_mac, max(server_mac) AS server_mac, max(vlan_id) AS vlan_id,
    count(*) FILTER (WHERE (tcp_flags & 18) = 2) AS syn_count,
    min(rk) FILTER (WHERE answers) AS ack_rk, arg_min(ts_us, rk) FILTER (WHERE answers) AS synack_us,
    arg_min(tcp_seq, rk) FILTER (WHERE answers) AS ack_seq,
    min(rk) FILTER (WHERE (tcp_flags & 2) = 0) AS data_rk, arg_min(ts_us, rk) FILTER (WHERE (tcp_flags & 2) = 0) AS data_us,
    arg_min(dir, rk) FILTER (WHERE (tcp_flags & 2) = 0) AS data_dir, arg_min(tcp_ack, rk) FILTER (WHERE (tcp_flags & 2) = 0) AS data_ack
  FROM (SELECT *, (tcp_flags & 18) = 18 AND dir = -1 AND tcp_ack = (start_isn + 1) % 4294967296 AS answers FROM pf WHERE ip_proto = 6)
  GROUP BY ALL),
hs AS (
  SELECT *, CASE WHEN opened <> 'none' THEN data_us END AS connected_us, CASE WHEN isn IS NOT NULL THEN start_us END AS syn_us,
    CASE WHEN opened = 'handshake' THEN data_us - start_us END AS connect_us, data_rk IS NOT NULL AS has_data
  FROM (SELECT *, CASE WHEN isn IS NULL AND data_rk IS NOT NULL THEN 'midstream'
          WHEN ack_rk < data_rk AND data_dir = 1 AND data_ack = (ack_seq + 1) % 4294967296 THEN 'handshake' ELSE 'none' END AS opened FROM hs0))"""

CLOSE = f"""session_ends AS (
  SELECT {SESSION}, min(start_us) AS start_us, max(ts_us) AS last_us, max(start_isn) AS isn,
    arg_min(dir, rk) FILTER (WHERE fin_rst) AS closer, arg_min(ts_us, rk) FILTER (WHERE fin_rst) AS close_us,
    min(rk) FILTER (WHERE fin_rst AND dir = 1) AS c_rk, min(rk) FILTER (WHERE fin_rst AND dir = -1) AS s_rk,
    arg_min(ts_us, rk) FILTER (WHERE fin_rst AND dir = 1) AS c_us, arg_min(ts_us, rk) FILTER (WHERE fin_rst AND dir = -1) AS s_us,
    bool_or((tcp_flags & 4) <> 0) AS reset, bool_or((tcp_flags & 2) = 0) AS has_data,
    min(ts_us) FILTER (WHERE (tcp_flags & 18) = 18 AND dir = -1 AND tcp_ack = (start_isn + 1) % 4294967296) AS answered_us
  FROM (SELECT *, (tcp_flags & 5) <> 0 AS fin_rst FROM pf WHERE ip_proto = 6) GROUP BY ALL),
states AS (
  SELECT *, CASE WHEN c_rk IS NOT NULL AND s_rk IS NOT NULL THEN 'closed' WHEN close_us IS NOT NULL THEN 'waiting'
      WHEN has_data THEN 'established' WHEN answered_us IS NOT NULL THEN 'ack' WHEN isn IS NOT NULL THEN 'syn' ELSE 'none' END AS state,
    CASE WHEN c_rk IS NOT NULL AND s_rk IS NOT NULL THEN greatest(c_us, s_us) END AS closed_us,
    lead(CASE WHEN isn IS NOT NULL THEN start_us END) OVER (PARTITION BY {KEY} ORDER BY session_no) AS next_syn_us FROM session_ends),
closes AS (
  SELECT {SESSION}, start_us, last_us, state, closer, close_us, closed_us,
    CASE WHEN reset THEN 'reset' WHEN state = 'closed' THEN 'normal' WHEN next_syn_us <= CASE state WHEN 'closed' THEN close_us + 5000000 WHEN 'waiting' THEN close_us + 5000000 WHEN 'established' THEN last_us + 600000000
           ELSE coalesce(answered_us, start_us) + 5000000 END THEN 'abort'
         WHEN state = 'syn' THEN 'broken' ELSE 'timeout' END AS cause FROM states)"""

CONNECTIONS = f"""changes AS (
  SELECT vlan_id, client_mac, client_ip, server_mac, server_ip, 'connected' AS what, connected_us AS hit_us FROM hs WHERE connected_us IS NOT NULL
  UNION ALL SELECT vlan_id, client_mac, client_ip, server_mac, server_ip, 'closed', close_us FROM hs JOIN closes USING ({SESSION})
  WHERE connected_us IS NOT NULL AND close_us IS NOT NULL),
connections AS (
  SELECT {window('hit_us')} AS window_us, vlan_id, mac, ip, {count_if("what = 'connected'")} AS connected, {count_if("what = 'closed'")} AS closed
  FROM (SELECT vlan_id, client_mac AS mac, {node_ip('client_ip')} AS ip, what, hit_us FROM changes
        UNION ALL SELECT vlan_id, server_mac, {node_ip('server_ip')}, what, hit_us FROM changes) GROUP BY ALL)"""
