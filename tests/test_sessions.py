"""Session borders against a packet-by-packet state machine."""

import random

import pytest

from helpers import packets
from netspark import schema as S
from netspark.operators import flows
from netspark.operators.sessions import Timeouts

ACK, SYN, FIN, RST = S.ACK, S.SYN, S.FIN, S.RST
SEC = S.US


def walked(rows, t):
    """Session number of each TCP packet, in order; rows hold ts_us, tcp_flags, tcp_seq, tcp_ack."""
    out, number, phase, live, isn = [], 0, None, None, None
    for r in rows:
        now, flags, before = r["ts_us"], r["tcp_flags"], isn
        syn, pure, end = flags & SYN, flags & (SYN | ACK) == SYN, flags & (FIN | RST)
        if pure:
            isn = r["tcp_seq"]
        if phase is None or now > live or pure and before != r["tcp_seq"]:
            number += 1
            phase = ("syn" if pure else "ack") if syn else "closing" if end else "active"
            live = now + SEC * {"syn": t.opening_s, "ack": t.opening_s, "active": t.tcp_s, "closing": t.closing_s}[phase]
        elif not syn and end and phase != "closing":
            phase, live = "closing", now + t.closing_s * SEC
        elif phase == "active" or not syn and phase != "closing":
            phase, live = "active", now + t.tcp_s * SEC
        elif phase == "syn" and not pure and syn and r.get("tcp_ack") == (before + 1) % S.UINT32:
            phase, live = "ack", now + t.opening_s * SEC
        out.append(number)
    return out


def on_port(rows, port):
    """The packets as a flow of their own, that of a client's port."""
    return [{**{k: v for k, v in r.items() if k != "up"}, **({"src_port": 80, "src_ip": 20, "dst_port": port, "dst_ip": 10} if r.get("up") == "s"
             else {"src_port": port, "src_ip": 10, "dst_port": 80, "dst_ip": 20})} for r in rows]


def numbers(df, **args):
    return [r.session_no for r in flows.packets_with_flow(df, **args).orderBy("packet_id").collect()]


def test_silences_before_in_and_after_the_established_phase(spark):
    syn, answer = {"tcp_flags": SYN, "tcp_seq": 5}, {"up": "s", "tcp_flags": SYN | ACK, "tcp_seq": 9, "tcp_ack": 6}
    end = {"tcp_flags": FIN | ACK}
    cases = [
        ([(0, syn), (10, answer)], [1, 2]), ([(0, syn), (4, syn), (6, answer)], [1, 1, 2]), ([(0, syn), (4, answer), (8, {}), (500, {})], [1, 1, 1, 1]),
        ([(0, syn), (4, answer), (10, {})], [1, 1, 2]), ([(0, syn), (1, {}), (11, {}), (611, {})], [1, 1, 1, 1]), ([(0, syn), (1, {}), (602, {})], [1, 1, 2]),
        ([(0, {}), (1, end), (11, {})], [1, 1, 2]), ([(0, {}), (1, end), (3, {}), (5, {}), (7, {}), (8, {})], [1, 1, 1, 1, 2, 2]),
        ([(0, end), (4, end), (6, {}), (300, {})], [1, 1, 2, 2])]
    table = []
    for i, (case, want) in enumerate(cases):
        rows = [{"ts_us": t * SEC, "tcp_flags": ACK, "tcp_seq": 0, "tcp_ack": 0, **r} for t, r in case]
        assert walked(rows, Timeouts()) == want
        table += on_port(rows, 1000 + i)
    assert numbers(packets(spark, table)) == [n for _, want in cases for n in want]


@pytest.mark.parametrize("seed, timeouts", [(0, Timeouts()), (1, Timeouts(opening_s=15, closing_s=60)), (2, Timeouts(opening_s=3, closing_s=40, tcp_s=40))])
def test_random_flows(spark, seed, timeouts):
    rng = random.Random(seed)
    flows_, rows = [], []
    for flow in range(12):
        t, mine = rng.randrange(100) * SEC, []
        steps = rng.choice([[1, 2, 3], [1, 4, 6, 50], [2, 30, 61, 700], [0, 0, 1, 12]])
        for _ in range(60):
            t += rng.choice(steps) * SEC
            seq = rng.randrange(2)
            mine.append({"ts_us": t, "up": rng.choice("cs"), "src_mac": flow, "tcp_seq": seq, "tcp_ack": rng.choice([1, 2, 7]),
                         "tcp_flags": rng.choice([SYN, SYN | ACK, ACK, ACK, ACK, FIN | ACK, RST])})
        flows_.append(walked(mine, timeouts))
        rows += on_port(mine, 1000 + flow)
    want = [n for f in flows_ for n in f]
    df = packets(spark, rows)
    assert numbers(df, timeouts=timeouts) == want
    assert numbers(df, timeouts=timeouts, slice_us=7 * SEC) == want


def test_long_chains_of_soft_starts(spark):
    """Ends every two seconds: each session lives five seconds, whatever comes."""
    rows = [{"ts_us": 2 * i * SEC, "tcp_flags": FIN | ACK} for i in range(100)]
    assert numbers(packets(spark, rows), slice_us=20 * SEC) == walked(rows, Timeouts()) == [i // 3 + 1 for i in range(100)]


def test_timeouts_are_checked():
    with pytest.raises(ValueError):
        Timeouts(closing_s=700)
