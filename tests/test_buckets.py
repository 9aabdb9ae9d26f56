"""Keyed state in buckets: the records of each key, and the number of calls."""

import random

import pandas as pd

from netspark import schema as S
from netspark.streaming import keyed
from test_streaming import Mark, Store, arrivals, streamed

SEC = S.US


def frame(rows, keys, held):
    """Rows as Spark hands them over: nulls of numbers as bits."""
    names = [*keys, *held]
    strings = {"qname", "qtype", "kind"}
    out = []
    for r in rows:
        nulls = sum(1 << i for i, n in enumerate(names) if r[n] is None and n not in strings)
        out.append({**{n: 0 if r[n] is None and n not in strings else r[n] for n in names}, keyed.NULLS: nulls})
    return pd.DataFrame(out)


def bucketed(make, keys, batches, delay_us):
    """Records of one bucket over batches, and the writes of its state."""
    store, out, newest, mark = Store(), [], 0, 0
    for rows in [*batches, [], None]:
        if rows is None:
            mark = keyed.NEVER // 1000
        else:
            rows = [r for r in rows if r["ts_us"] > mark * 1000]
        processor = keyed.Buckets(make(), keys)
        processor.init(store)
        if rows:
            frames = [frame(rows[:3], keys, make().held.names), frame(rows[3:], keys, make().held.names)]
            out += list(processor.handleInputRows((5,), iter(f for f in frames if len(f)), Mark(mark)))
            newest = max(newest, *(r["ts_us"] for r in rows))
        while any(t < mark for t in store.timers):
            assert len(store.timers) == 1
            out += list(processor.handleExpiredTimer((5,), Mark(mark), None))
        mark = max(mark, (newest - delay_us) // 1000) if rows is not None else mark
    assert not store.values and not store.timers
    return [tuple(r) for pdf in out for r in pdf.itertuples(index=False, name=None)], store.writes


def told(rows):
    return sorted([str(v) for v in r] for r in rows)


def test_buckets_give_the_records_of_every_key():
    rng = random.Random(11)
    rows = []
    for flow, dns in [(7, 1), (7, 2), (None, 3), (2**62 + 1, 4)]:
        times = sorted(rng.sample(range(1000, 1400), 40))
        rows += [{"flow_id": flow, "dns_id": dns, "ts_us": t * SEC, "qr": rng.randrange(2), "client_ip": 1, "server_ip": 2, "opcode": rng.choice([None, 0, 2]),
                  "qname": rng.choice([None, "a", "b"]), "qtype": "Text", "rcode": rng.choice([None, 0, 3]), "bytes": rng.randrange(50)} for t in times]
    got, _ = bucketed(lambda: keyed.Dns(5), ["flow_id", "dns_id"], arrivals(rng, rows, 3 * SEC, 30), 3 * SEC)
    want = []
    for key in {(r["flow_id"], r["dns_id"]) for r in rows}:
        mine = [r for r in rows if (r["flow_id"], r["dns_id"]) == key]
        want += [tuple(r.values()) for r in streamed(lambda: keyed.Dns(5), key, [mine], 3 * SEC)]
    assert told(got) == told(want)


def test_buckets_keep_waiting_messages_apart():
    rng = random.Random(12)
    rows = [{"flow_id": rng.randrange(3), "ts_us": t * SEC, "kind": rng.choice(["req", "rsp"]), "n": t} for t in sorted(rng.sample(range(1000, 1400), 150))]
    got, _ = bucketed(lambda: keyed.Turns(600), ["flow_id"], arrivals(rng, rows, 4 * SEC, 13), 5 * SEC)
    want = []
    for flow in range(3):
        want += [tuple(r.values()) for r in streamed(lambda: keyed.Turns(600), (flow,), [[r for r in rows if r["flow_id"] == flow]], 5 * SEC)]
    assert told(got) == told(want)


def test_many_keys_cost_one_write_a_batch():
    rows = [{"flow_id": 1, "dns_id": i, "ts_us": (1000 + i % 3) * SEC, "qr": 0, "client_ip": 1, "server_ip": 2, "opcode": 0, "qname": "q", "qtype": "t", "rcode": None,
             "bytes": 40} for i in range(500)]
    got, writes = bucketed(lambda: keyed.Dns(5), ["flow_id", "dns_id"], [rows], 3 * SEC)
    assert len(got) == 500 and writes <= 3


def test_null_numbers_and_keys_of_a_stream(spark, tmp_path):
    from netspark.streaming import jobs

    schema = "flow_id bigint, dns_id bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.Dns.held)
    big = 2**62 + 1
    rows = [(None, 1, 1000 * SEC, 0, big, 2, None, None, "t", None, 10), (None, 1, 1001 * SEC, 1, big, 2, None, None, "t", 3, None), (0, 1, 1000 * SEC, 0, 1, 2, 0, "q", "t", None, 5)]
    path = str(tmp_path / "in")
    for part in (rows, [(9, 9, 9000 * SEC, 0, 1, 2, 0, "q", "t", None, 5)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    query = jobs.stream_dns(jobs.stream_table(spark, path, spark.read.parquet(path).schema, files_per_batch=1), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("flow_id", "dns_id", "client_ip", "opcode", "qname", "rcode", "req_bytes", "rsp_pkts").collect()
    assert told(got) == told([(None, 1, big, None, None, 3, 10, 1), (0, 1, 1, 0, "q", None, 5, 0)])
