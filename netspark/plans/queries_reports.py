"""Flow records."""

from netspark.operators import reports, tcp
from netspark.plans import fixtures as fx
from netspark.plans import oracle as o
from netspark.plans import queries_flows  # noqa: F401  (registers the parts)
from netspark.plans.registry import ORACLES, query

SESSION = o.SESSION


@query("flow_head", o.with_(o.ORACLE_PACKETS, o.SESSIONS, o.HANDSHAKE, f"""
SELECT f.*, hs.connected_us // 1000000 AS connect_time
FROM (SELECT {SESSION}, client_ip, client_port, server_ip, server_port, max(client_mac) AS client_mac, max(server_mac) AS server_mac,
        max(vlan_id) AS vlan_id, max(eth_type) AS l2_type, min(start_us) AS start_us, (max(ts_us) - min(start_us)) // 1000 AS age_ms, ip_proto AS l3_type
      FROM pf GROUP BY ALL) f LEFT JOIN hs USING ({SESSION})"""))
def flow_head(spark, sf):
    rows = fx.flow_packets(spark, sf)
    return reports.flow_head(rows, tcp.handshake(rows))


def _sides(key, side, columns):
    picked = ", ".join(f"max(CASE {side} WHEN {d} THEN {c} END) AS {n}_{to}" for n, d in reports.SIDES for c, to in columns.items())
    return f"(SELECT {SESSION}, {picked} FROM ({ORACLES[key]}) GROUP BY {SESSION})"


_QUALITY = {c: c for c in ("order_count", "order_bytes", "reordered_count", "reordered_bytes", "dropped_count", "dropped_bytes",
                           "retransmit_count", "retransmit_bytes", "stream_bytes", "missing_bytes")}


@query("flow_body", f"""
SELECT * FROM (SELECT {SESSION}, expired, {', '.join(f'{n}_{c}' for n, _ in reports.SIDES for c in ('pkts', 'bytes', 'l2_bytes', 'aborts'))}
               FROM ({ORACLES['flow_summary']}) WHERE ip_proto = 6)
LEFT JOIN {_sides('flow_rtt', 'side', {'rtt_sum': 'rtt_sum', 'rtt_count': 'rtt_count', 'rtt_mean': 'rtt'})} USING ({SESSION})
LEFT JOIN {_sides('flow_windows', 'dir', {'zero_windows': 'zwnds', 'max_window': 'max_window'})} USING ({SESSION})
LEFT JOIN {_sides('packet_gaps', 'dir', {'min_gap_us': 'nagle_us'})} USING ({SESSION})
LEFT JOIN {_sides('tcp_sequence_exact', 'side', _QUALITY)} USING ({SESSION})
LEFT JOIN ({ORACLES['turns']}) USING ({SESSION})""")
def flow_body(spark, sf):
    return reports.flow_body(fx.flow_packets(spark, sf), fx.tcp_line(spark, sf))
