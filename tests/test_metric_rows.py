"""Metric rows are summed at once from packets and messages, and equal those of summed tables."""

import pytest
from pyspark.sql import functions as F

from helpers import packets
from netspark import schema as S
from netspark.operators import flows, metrics, nodes, tcp
from netspark.operators import transactions as tx
from netspark.plans import fixtures as fx


def same(a, b):
    assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def frames(spark):
    """Flows with handshakes, resets and repeated openings, foreign frames, fragments and null lengths."""
    rows = []
    for i in range(60):
        at, port = i * 7 * S.US, 1000 + i % 9
        rows += [{"ts_us": at, "src_port": port, "tcp_flags": 2, "tcp_seq": 100 * i, "wire_len": 60 + 90 * (i % 7), "vlan_id": i % 2},
                 {"ts_us": at + 5, "up": "s", "dst_port": port, "tcp_flags": 18, "tcp_seq": 7, "tcp_ack": 100 * i + 1},
                 {"ts_us": at + 9, "src_port": port, "tcp_flags": 16, "tcp_seq": 100 * i + 1, "tcp_ack": 8, "wire_len": None if i % 5 == 0 else 70}]
        rows += [{"ts_us": at + 20, "up": "s", "dst_port": port, "tcp_flags": 4 if i % 3 else 17, "tcp_seq": 8}] if i % 4 else []
        rows += [{"ts_us": at + 30, "ip_proto": 17 if i % 2 else 0, "eth_type": 2048 if i % 2 else S.ETH_ARP, "frag_offset": 9 if i % 7 == 0 else 0,
                  "dst_mac": 0xFFFFFFFFFFFF, "src_ip": None if i % 11 == 0 else 10}]
    return packets(spark, rows)


def test_levels_from_packet_ends_and_from_facts(frames):
    ends = nodes.node_facts(frames, by=None)
    assert ends.count() == 2 * frames.count() and "Aggregate" not in plan(ends)
    same(metrics.node_metrics(ends), metrics.node_metrics(nodes.node_facts(frames)))


def test_stored_marks_give_the_same_handshakes_and_closes(frames):
    flow_packets = flows.packets_with_flow(frames)
    marks = tcp.session_marks(flow_packets)
    shakes, closes = tcp.handshake(flow_packets), tcp.tcp_close(flow_packets)
    same(tcp.handshake(flow_packets, marks), shakes)
    same(tcp.tcp_close(flow_packets, marks=marks), closes)
    assert {r["cause"] for r in closes.select("cause").distinct().collect()} >= {"abort", "reset"}
    assert marks.count() == marks.select(*S.SESSION).distinct().count()


def test_closing_times_alone_need_no_join(frames):
    closes = tcp.tcp_close(flows.packets_with_flow(frames))
    assert "Join" in plan(closes.select(*S.SESSION, "cause"))
    assert "Join" not in plan(closes.select(*S.SESSION, "close_us"))


def test_dns_messages_and_durations_meet_in_one_sum(spark):
    rows = [(i % 3, i // 2, i % 2, i * S.US, 10 << 24 | i % 4, 192 << 24 | 168 << 16 | i % 2, i % 3, i % 6, 40 + i) for i in range(80) if i % 9]
    messages = spark.createDataFrame(rows, "flow_id long, dns_id long, qr int, ts_us long, src_ip long, dst_ip long, opcode int, rcode int, bytes int").withColumns(
        {"client_ip": F.col("src_ip"), "server_ip": F.col("dst_ip"), "src_mac": F.lit(0).cast("bigint"), "dst_mac": F.lit(0).cast("bigint"), "vlan_id": F.lit(0)})
    txns = messages.filter("qr = 0").selectExpr("client_ip", "server_ip", "src_mac", "dst_mac", "vlan_id", "ts_us AS req_us",
                                                "IF(dns_id % 3 = 0, NULL, ts_us + 5 * dns_id) AS rsp_us", "dns_id % 3 = 0 AS req_timeout")
    out = tx.node_dns(messages, txns)
    assert plan(out).count("Aggregate") == 1
    got = out.agg(*[F.sum(c).alias(c) for c in ("req_pkts", "req_bytes", "rsp_pkts", "rsp_errors", "rtt_count", "rtt_sum", "timeouts")], F.max("rtt_max").alias("rtt_max")).first()
    asked = [r for r in rows if r[2] == 0]
    took = [5 * r[1] for r in asked if r[1] % 3]
    assert got.asDict() == {
        "req_pkts": 2 * len(asked), "req_bytes": 2 * sum(r[8] for r in asked), "rsp_pkts": 2 * (len(rows) - len(asked)),
        "rsp_errors": 2 * sum(r[2] == 1 and 1 <= r[7] <= 5 for r in rows), "rtt_count": 2 * len(took), "rtt_sum": 2 * sum(took),
        "timeouts": 2 * (len(asked) - len(took)), "rtt_max": max(took)}


def test_application_rows_without_array_functions(spark):
    zero = F.lit(0).cast("bigint")
    names = ["req_pkts", "req_bytes", "rsp_pkts", "rsp_bytes", *[f"req_opcode_{i}" for i in range(3)], *[f"rsp_rcode_{i}" for i in range(6)], "rsp_errors", "rtt_count",
             "rtt_sum", "timeouts", "rtt_min", "rtt_max"]
    dns = spark.range(3).select(F.col("id").alias("window_us"), *[zero.alias(c) for c in ("mac", "ip")], F.lit(0).alias("vlan_id"), F.lit(1).alias("dir"),
                                *[F.when(F.lit(c in ("req_pkts", "rtt_count", "rtt_sum", "rtt_min", "rtt_max")), F.col("id") * (i + 1)).otherwise(0).alias(c) for i, c in enumerate(names)])
    none = lambda *cs: dns.limit(0).select(*nodes.NODE, "dir", *[zero.alias(c) for c in (*cs, "pkts", "bytes", "l2_bytes", "rtt_sum", "rtt_count")])
    out = metrics.app_metrics(dns, none("requests", "responses", "methods", "errors"), none("commands", "blocks"))
    assert "lambda" not in plan(out)
    at = {n: i + 1 for i, n in enumerate(names)}
    want = [(k, "dns.req_pkts", k, None, None, None) for k in (1, 2)]
    want += [(k, "dns.rtt", *[k * at[c] for c in ("rtt_count", "rtt_sum", "rtt_min", "rtt_max")]) for k in (1, 2)]
    assert sorted(out.select("window_us", "metric", "count", "sum", "min", "max").collect(), key=str) == sorted(want, key=str)


def test_tcp_flow_packets_are_those_of_the_whole_table(spark, tmp_path):
    sf = str(tmp_path)
    spark.range(400).selectExpr("id AS event_id", "id % 6 AS user_id", "CAST(timestamp_micros(1700000000000000 + id * 900000) AS TIMESTAMP_NTZ) AS ts").write.parquet(f"{sf}/events.parquet")
    few = fx.tcp_flow_packets(spark, sf)
    whole = tcp.tcp(flows.packets_with_flow(fx.packets(spark, sf))).select(*fx.TCP_REPORTS)
    same(few, whole)
    fx.flow_packets(spark, sf)
    same(fx.tcp_flow_packets(spark, sf), few)
