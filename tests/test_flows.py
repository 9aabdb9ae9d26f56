"""Sessions, connection states and sequence quality on literal packets."""

import random
import time

import pytest
from pyspark.sql import functions as F

from helpers import packets
from netspark import schema as S
from netspark.operators import flows, nodes, tcp
from netspark.session import cut

ACK, SYN, FIN, RST = S.ACK, S.SYN, S.FIN, S.RST
SEC = S.US


def sessions(df, slice_us=S.SLICE_US):
    rows = flows.packets_with_flow(df, slice_us).orderBy("packet_id").collect()
    return [(r.session_no, r.dir, r.start_packet) for r in rows]


def test_sessions_by_gap_and_new_syn(spark):
    df = packets(spark, [
        {"ts_us": 0, "tcp_flags": SYN, "tcp_seq": 5}, {"ts_us": 1 * SEC, "tcp_flags": SYN, "tcp_seq": 5},        # repeat
        {"ts_us": 2 * SEC, "up": "s", "tcp_flags": SYN | ACK, "tcp_seq": 9, "tcp_ack": 6}, {"ts_us": 3 * SEC},
        {"ts_us": 70 * SEC, "tcp_flags": SYN, "tcp_seq": 5}, {"ts_us": 71 * SEC, "tcp_flags": SYN, "tcp_seq": 8},  # repeat, new
        {"ts_us": 700 * SEC, "up": "s"}])                                                                          # silence
    want = [(1, 1, 0), (1, 1, 0), (1, -1, 0), (1, 1, 0), (1, 1, 0), (2, 1, 5), (3, 1, 6)]
    assert sessions(df) == want


@pytest.mark.parametrize("seed", range(2))
def test_sessions_do_not_depend_on_slices(spark, seed):
    rng = random.Random(seed)
    t, rows = 0, []
    for _ in range(250):
        t += rng.choice([1, 5, 40, 300, 601]) * SEC
        rows.append({"ts_us": t, "up": rng.choice("cs"), "tcp_flags": rng.choice([SYN, ACK, ACK, SYN | ACK]), "tcp_seq": rng.randrange(2)})
    df = packets(spark, rows)
    busy = flows.packets_with_flow(df, busy_rows=20)
    assert busy.select("slice_us").distinct().first()[0] < S.SLICE_US * 1000 and busy.agg(F.count_distinct("slice_us")).first()[0] == 1
    want = sessions(df, 10 ** 6 * SEC)
    assert sessions(df, 1 * SEC) == sessions(df, 100 * SEC) == want
    assert [(r.session_no, r.dir, r.start_packet) for r in busy.orderBy("packet_id").collect()] == want


def test_syn_with_data_and_fragments_take_no_part(spark):
    df = packets(spark, [{"ts_us": 0, "tcp_flags": SYN, "payload_len": 3}, {"ts_us": 1, "frag_offset": 10}, {"ts_us": 2}])
    assert sessions(df) == [(1, 1, 2)]


def test_handshake_states(spark):
    rows = [{"ts_us": 0, "tcp_flags": SYN, "tcp_seq": 4294967295}, {"ts_us": 5, "up": "s", "tcp_flags": SYN | ACK, "tcp_seq": 7, "tcp_ack": 1},
            {"ts_us": 6, "up": "s", "tcp_flags": SYN | ACK, "tcp_seq": 7, "tcp_ack": 0}, {"ts_us": 9, "tcp_ack": 8}]
    got = tcp.handshake(flows.packets_with_flow(packets(spark, rows))).first()
    assert (got.opened, got.synack_us, got.connected_us, got.connect_us) == ("handshake", 6, 9, 9)
    middle = tcp.handshake(flows.packets_with_flow(packets(spark, rows[3:]))).first()
    assert (middle.opened, middle.connected_us) == ("midstream", 9)
    lone = tcp.handshake(flows.packets_with_flow(packets(spark, rows[1:2])))
    assert tcp.half_open(lone).first().kind == "synack_orphan"


def test_close_causes(spark):
    def cause(rows):
        return [r.cause for r in tcp.tcp_close(flows.packets_with_flow(packets(spark, rows))).orderBy("session_no").collect()]
    syn = {"ts_us": 0, "tcp_flags": SYN, "tcp_seq": 1}
    data = {"ts_us": 2, "payload_len": 5}
    assert cause([syn]) == ["broken"]
    assert cause([syn, data]) == ["timeout"]
    assert cause([syn, data, {"ts_us": 3, "tcp_flags": FIN | ACK}, {"ts_us": 4, "up": "s", "tcp_flags": FIN | ACK}]) == ["normal"]
    assert cause([syn, data, {"ts_us": 3, "tcp_flags": RST}]) == ["reset"]
    new = {"tcp_flags": SYN, "tcp_seq": 77}
    assert cause([syn, data, {"ts_us": 9, **new}, {"ts_us": 10}]) == ["abort", "timeout"]
    # A half-closed session lives five seconds, an established one ten minutes.
    fin = {"ts_us": 3, "tcp_flags": FIN | ACK}
    assert cause([syn, data, fin, {"ts_us": 4 * SEC, **new}]) == ["abort", "broken"]
    assert cause([syn, data, fin, {"ts_us": 6 * SEC, **new}]) == ["timeout", "broken"]
    assert cause([syn, data, {"ts_us": 6 * SEC, **new}]) == ["abort", "broken"]


def brute_quality(rows, start):
    """Next expected byte kept packet by packet."""
    expected, seen, out, ahead_starts = start, set(), dict.fromkeys(("order", "reordered", "dropped", "retransmit"), 0), set()
    for pos, size in rows:
        if pos + size <= expected:
            out["dropped"] += 1
            continue
        if pos > expected:
            out["reordered"] += 1
            out["retransmit"] += pos in ahead_starts
            ahead_starts.add(pos)
        else:
            out["order"] += 1
        seen.update(range(pos, pos + size))
        while expected in seen:
            expected += 1
    return out, expected - start


@pytest.mark.parametrize("seed", range(2))
def test_exact_sequence_quality(spark, seed):
    """Overlaps, copies, holes and a start near the wrap against a byte-wise replay."""
    rng = random.Random(seed)
    isn = 4294967290
    parts = [(0, 4)] + [(rng.randrange(0, 60), rng.randrange(1, 12)) for _ in range(60)]
    rows = [{"ts_us": 0, "tcp_flags": SYN, "tcp_seq": isn}]
    rows += [{"ts_us": 10 * (i + 1), "tcp_seq": (isn + 1 + p) % S.UINT32, "payload_len": n} for i, (p, n) in enumerate(parts)]
    line = cut(tcp.positions(flows.packets_with_flow(packets(spark, rows))))
    got = tcp.sequence_exact(line).filter("side = 1").first()
    want, stream = brute_quality(parts, 0)
    assert {k: got[f"{k}_count"] for k in want} == want
    assert got.stream_bytes == stream


def test_earliest_cover():
    rng = random.Random(3)
    for _ in range(200):
        segments = [(a, a + rng.randrange(1, 9), (rng.randrange(30), i)) for i, a in enumerate(rng.randrange(30) for _ in range(rng.randrange(9)))]
        got = {p: at for lo, hi, at in tcp.earliest_cover(segments) for p in range(lo, hi)}
        assert got == {p: min(at for lo, hi, at in segments if lo <= p < hi) for p in range(40) if any(lo <= p < hi for lo, hi, _ in segments)}


def test_a_bucket_of_one_byte_segments(spark):
    """Sixteen thousand of them, each sent twice, the odd ones first: linear work."""
    order = [*range(1, 16_000, 2), *range(0, 16_000, 2), *range(0, 16_000, 2)]
    df = spark.createDataFrame([(1, p, p + 1, i, i) for i, p in enumerate(order)], "side INT, pos BIGINT, pos_end BIGINT, ts_us BIGINT, packet_id BIGINT")
    starts = spark.createDataFrame([(1, 0)], "side INT, start BIGINT")
    began = time.time()
    got = tcp.first_arrivals(df, starts, ["side"]).orderBy("lo").collect()
    assert [(r.lo, r.hi, r.at.ts_us) for r in got] == [(p, p + 1, p // 2 if p % 2 else 8000 + p // 2) for p in range(16_000)]
    assert time.time() - began < 60


def test_rtt_over_the_wrap_and_repeats(spark):
    isn = 4294967000
    rows = [{"ts_us": 0, "tcp_flags": SYN, "tcp_seq": isn}, {"ts_us": 10, "tcp_seq": isn + 1, "payload_len": 200},
            {"ts_us": 20, "tcp_seq": (isn + 201) % S.UINT32, "payload_len": 300}, {"ts_us": 25, "tcp_seq": isn + 1, "payload_len": 200},
            {"ts_us": 40, "up": "s", "tcp_ack": (isn + 201) % S.UINT32}, {"ts_us": 90, "up": "s", "tcp_ack": (isn + 501) % S.UINT32}]
    line = tcp.positions(flows.packets_with_flow(packets(spark, rows)))
    got = sorted((r.sent_us, r.rtt_us) for r in tcp.rtt_samples(line).filter("side = 1").collect())
    assert got == [(10, 30), (20, 70)]


def test_covering_nodes_are_the_interval(spark):
    rng = random.Random(1)
    spans = [(a, a + rng.choice([0, 1, 2, 7, 100, 1000])) for a in [rng.randrange(-2000, 5000) for _ in range(60)]]
    df = spark.createDataFrame(spans, "lo bigint, hi bigint")
    for r in df.select("lo", "hi", tcp.covering_nodes(F.col("lo"), F.col("hi")).alias("n")).collect():
        numbers = [x for n in r.n for x in range(n.node << n.level, (n.node + 1) << n.level)]
        assert sorted(numbers) == list(range(r.lo, r.hi)) and len(r.n) <= 2 * 12


@pytest.mark.parametrize("seed", range(2))
def test_selective_acknowledgements(spark, seed):
    """Random blocks, nested, repeated and over the wrap, against a look at every block of every segment."""
    rng = random.Random(seed)
    isn = 4294966000
    seq = lambda p: (isn + p) % S.UINT32
    rows, sent, told = [], {}, []
    t = 0
    for _ in range(80):
        t += 10
        p, n = 100 * rng.randrange(40), 100 * rng.randrange(1, 4)
        if rng.random() < 0.6:
            rows.append({"ts_us": t, "tcp_seq": seq(p), "payload_len": n, "sacks": []})
            sent.setdefault(p + n, t)
        else:
            ack = 100 * rng.randrange(10)
            blocks = [(lo, lo + rng.choice([50, 100, 1000, 3000])) for lo in (100 * rng.randrange(40) for _ in range(rng.randrange(4)))]
            rows.append({"ts_us": t, "up": "s", "tcp_ack": seq(ack), "sacks": [(seq(a), seq(b)) for a, b in blocks]})
            told += [(t, None, ack)] + [(t, a, b) for a, b in blocks if a >= ack]
    rows.insert(0, {"ts_us": 0, "tcp_flags": SYN, "tcp_seq": seq(-1), "sacks": []})
    base = packets(spark, [{k: v for k, v in r.items() if k != "sacks"} for r in rows])
    blocks = spark.createDataFrame([(i, r["sacks"]) for i, r in enumerate(rows)], "packet_id bigint, sacks array<struct<left: bigint, right: bigint>>")
    line = tcp.positions(flows.packets_with_flow(base).join(blocks, "packet_id"))
    got = sorted((r.sent_us, r.rtt_us) for r in tcp.rtt_samples(line).filter("side = 1").collect())
    want = []
    for point, at in sent.items():
        first = min([w for w, lo, hi in told if point <= hi and (lo is None or lo < point)], default=None)
        if first is not None and first > at:
            want.append((at, first - at))
    assert got == sorted(want)


def test_outstanding_limit(spark):
    rows = [{"ts_us": i, "tcp_seq": 10 * i, "payload_len": 10} for i in range(1, 6)] + [{"ts_us": 50, "up": "s", "tcp_ack": 60}]
    line = tcp.positions(flows.packets_with_flow(packets(spark, rows)))
    got = tcp.outstanding_limit(line, limit=3).filter("side = 1").first()
    assert (got.segments, got.rtt_dropped) == (5, 2)


def test_packets_are_counted_once_per_end(spark):
    df = packets(spark, [{"ts_us": i * SEC, "up": "cs"[i % 2], "wire_len": 60 + i} for i in range(100)])
    facts = nodes.node_facts(df)
    assert facts.agg(F.sum("packets")).first()[0] == 200
    fine = nodes.node_facts(df, 30).groupBy("window_us", "mac").agg(F.sum("bytes").alias("bytes"))
    coarse = nodes.rollup_windows(fine, 300, ["mac"], sums=["bytes"])
    direct = nodes.node_facts(df, 300).groupBy("window_us", "mac").agg(F.sum("bytes").alias("bytes"))
    assert sorted(coarse.collect()) == sorted(direct.collect())
