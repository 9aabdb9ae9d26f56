"""HTTP and MySQL rows of a bucket, taken as columns."""

import random

import pytest

from netspark import schema as S
from netspark.streaming import keyed
from test_buckets import bucketed, told
from test_streaming import arrivals

SEC = S.US


def test_commands_of_many_flows_with_missing_sizes():
    rng = random.Random(21)
    rows = [{"flow_id": rng.choice([None, 0, 2**62 + 1, *range(5)]), "ts_us": (1000 + rng.randrange(300)) * SEC, "late": rng.choice([0, 1, 1]), "bytes": rng.choice([None, 3, 2**40])}
            for _ in range(400)]
    got, writes = bucketed(lambda: keyed.Commands(600), ["flow_id"], arrivals(rng, rows, 4 * SEC, 60), 5 * SEC)
    want = {}
    for flow in {r["flow_id"] for r in rows}:
        number = 0
        for r in sorted((r for r in rows if r["flow_id"] == flow), key=lambda r: (r["ts_us"], r["late"])):
            number += not r["late"]
            if number:
                sums = want.setdefault((str(flow).replace("None", "<NA>"), number), [0, 0, 0])
                sums[0] += not r["late"]
                sums[1] += r["late"]
                sums[2] += r["late"] * (r["bytes"] or 0)
    sums = {}
    for flow, number, opened, _, count, size in got:
        mine = sums.setdefault((str(flow), int(number)), [0, 0, 0])
        mine[0] += str(opened) != "<NA>"
        mine[1] += int(count)
        mine[2] += int(size)
    assert sums == want and writes < 12


def test_one_time_for_requests_without_a_number():
    rows = [{"flow_id": 1, "ts_us": 1000 * SEC, "kind": k, "n": n} for k, n in (("req", None), ("req", None), ("rsp", 4), (None, None))]
    got, _ = bucketed(lambda: keyed.Turns(600), ["flow_id"], [rows], 5 * SEC)
    assert told(got) == told([(1, t, way, 1000 * SEC, "<NA>") for t in (1, 2) for way in ("open", "close")])


def test_silence_ends_a_flow_and_what_waits_in_it():
    row = lambda flow, t, kind: {"flow_id": flow, "ts_us": t * SEC, "kind": kind, "n": t}
    batches = [[row(1, 1000, "req"), row(2, 1000, "req")], [row(2, 1500, "rsp")], [row(3, 1800, "req")], [row(1, 3000, "rsp"), row(1, 3001, "req")]]
    got, _ = bucketed(lambda: keyed.Turns(600), ["flow_id"], batches, SEC)
    assert told(got) == told([(1, 1, "open", 1000 * SEC, 1000), (2, 1, "open", 1000 * SEC, 1000), (2, 1, "close", 1500 * SEC, 1000), (3, 1, "open", 1800 * SEC, 1800),
                              (1, 1, "close", 3000 * SEC, 3001), (1, 1, "open", 3001 * SEC, 3001)])


def test_a_row_without_a_time_is_refused():
    rows = [{"flow_id": 1, "ts_us": 0, "late": 0, "bytes": 1}]
    processor = keyed.Commands(600)
    with pytest.raises(ValueError):
        processor.advance(["flow_id"], {}, [{n: keyed.np.array([{"nulls": 2}.get(n, rows[0].get(n, 0))]) for n in ("flow_id", "ts_us", "late", "bytes", "nulls")}], 0)


def test_columns_are_kept_short_and_come_back():
    table = {"a": keyed.np.array([0, 255]), "b": keyed.np.array([-1, 300]), "c": keyed.np.array([2**62 + 1, -5]), "d": keyed.np.array([], "int64")}
    short = keyed.narrowed(table)
    assert short["a"].itemsize == 1 and short["b"].itemsize == 4
    assert {n: v.tolist() for n, v in keyed.widened(short).items()} == {n: v.tolist() for n, v in table.items()}
