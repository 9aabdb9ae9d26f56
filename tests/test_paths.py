"""Which message a packet belongs to, against a look at every pair."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import packets
from netspark import schema as S
from netspark.operators import flows, paths, tcp

KEY = (1, 2, 3, 4, 6, 1, 1)
NAMES = "ip_a bigint, port_a bigint, ip_b bigint, port_b bigint, ip_proto int, session_no bigint, side int"


@pytest.mark.parametrize("seed", range(2))
def test_carried_against_every_pair(spark, seed):
    rng = random.Random(seed)
    starts = sorted(rng.sample(range(5, 400), 12))
    # Segments follow each other; some are sent twice.
    cuts = [0, *sorted(rng.sample(range(1, 420), 20)), 420]
    segments = [(a, b, i, 54 + b - a) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    segments += [(a, b, t + 100, w) for a, b, t, w in segments if rng.random() < 0.3]
    samples = [(b, 10 * i) for i, (_, b, _, _) in enumerate(segments[:21]) if rng.random() < 0.7]
    frame = lambda rows, names: spark.createDataFrame([(*KEY, *r) for r in rows], f"{NAMES}, {names}")
    got = paths.carried(frame([(s,) for s in starts], "offset bigint"), frame(segments, "pos bigint, pos_end bigint, ts_us bigint, wire_len int"),
                        frame(samples, "point bigint, rtt_us bigint"))
    got = {r.offset: (r.pkts, r.l2_bytes, r.rtt_sum, r.rtt_count) for r in got.collect()}
    want = {}
    for start, end in zip(starts, [*starts[1:], 10**9]):
        inside = [s for s in segments if start <= s[0] < end]
        # Of copies that hold the start of a message in their middle one counts.
        over = {(a, b) for a, b, _, _ in segments if a < start < b}
        mine = [r for p, r in samples if start <= p - 1 < end]
        want[start] = (len(inside) + len(over), sum(s[3] for s in inside), sum(mine), len(mine))
    assert got == want


def test_http_requests_that_share_packets(spark):
    """Two requests in one packet, a third one over two; the second answer is cut short."""
    first, second, third = (b"GET /%d HTTP/1.1\r\nHost: h\r\n\r\n" % i for i in range(3))
    answers = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello", b"HTTP/1.1 404 No\r\nContent-Length: 50\r\n\r\nshort"
    client = first + second + third
    cut = len(first) + len(second) + 9
    rows = [{"ts_us": 0, "tcp_flags": S.SYN, "tcp_seq": 99}, {"ts_us": 1000, "tcp_seq": 100, "payload": client[:cut]}, {"ts_us": 3000, "tcp_seq": 100 + cut, "payload": client[cut:]},
            {"ts_us": 9000, "up": "s", "tcp_seq": 500, "tcp_ack": 100 + len(client), "payload": answers[0]},
            {"ts_us": 12_000, "up": "s", "tcp_seq": 500 + len(answers[0]), "payload": answers[1]}]
    rows = [r | {"payload_len": len(r.get("payload", b"")), "wire_len": 54 + len(r.get("payload", b""))} for r in rows]
    got = paths.http_txn_from_packets(flows.packets_with_flow(packets(spark, rows))).orderBy("turn_no").collect()
    assert [(r.url, r.req_pkts, r.req_l2_bytes, r.status, r.rsp_pkts, r.wait_ms, r.pipelined, r.rsp_aborted) for r in got] == [
        ("/0", 1, 54 + cut, 200, 1, 8, False, False), ("/1", 1, 0, 404, 1, 11, True, True), ("/2", 2, 54 + len(client) - cut, None, 0, None, True, None)]
    assert [(r.req_rtt_count, r.req_rtt) for r in got] == [(0, 0), (0, 0), (2, 7000)]
