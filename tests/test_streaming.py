"""Keyed processors against the batch result, over micro-batches with late rows."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import packets
from netspark import schema as S
from netspark.operators import flows, metrics, nodes, transactions as tx
from netspark.operators.sessions import Timeouts
from netspark.plans import queries_streaming as qs
from netspark.session import settings
from netspark.streaming import jobs, keyed

SEC = S.US


class Store:
    """The state of one key, as a processor's handle gives it."""

    def __init__(self):
        self.values, self.timers, self.writes = {}, set(), 0

    def getValueState(self, name, schema):
        store = self

        class Value:
            def get(self):
                return store.values.get(name)

            def update(self, value):
                assert len(value) == len(schema)
                store.values[name] = value
                store.writes += 1

            def clear(self):
                store.values.pop(name, None)
        return Value()

    def getListState(self, name, schema):
        value = self.getValueState(name, schema)
        value.exists = lambda: name in self.values
        value.get = lambda: iter(self.values.get(name, []))
        value.put = lambda rows: self.values.__setitem__(name, rows)
        return value

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def streamed(make, key, batches, delay_us):
    """Records of one key: rows of each batch, then timers that the watermark passed; at the end it passes all."""
    store, out, newest, mark = Store(), [], 0, 0
    for rows in [*batches, [], None]:
        if rows is None:
            mark = keyed.NEVER // 1000
        else:
            rows = [r for r in rows if r["ts_us"] > mark * 1000]
        processor = make()
        processor.init(store)
        if rows:
            out += list(processor.handleInputRows(key, iter(rows), Mark(mark)))
            newest = max(newest, *(r["ts_us"] for r in rows))
        while any(t < mark for t in store.timers):
            store.timers.remove(min(store.timers))
            out += list(processor.handleExpiredTimer(key, Mark(mark), None))
        mark = max(mark, (newest - delay_us) // 1000) if rows is not None else mark
    assert not store.values and not store.timers
    return [r.asDict() for r in out]


def arrivals(rng, rows, late_us, size):
    """Batches of the rows in the order of their arrival, up to late_us behind their times."""
    rows = sorted(rows, key=lambda r: r["ts_us"] + rng.randrange(late_us + 1))
    return [rows[i:i + size] for i in range(0, len(rows), size)]


@pytest.mark.parametrize("seed, timeouts", [(0, Timeouts()), (1, Timeouts(opening_s=15, closing_s=60))])
def test_flows_over_batches_give_the_batch_sessions(spark, seed, timeouts):
    rng = random.Random(seed)
    t, rows, packed = 1000 * SEC, [], []
    for i in range(150):
        t += rng.choice([0, 1, 3, 6, 20, 62, 650]) * SEC
        flags = rng.choice([S.SYN, S.SYN | S.ACK, S.ACK, S.ACK, S.ACK, S.FIN | S.ACK])
        side, seq, ack, size = rng.choice("cs"), rng.randrange(2), rng.choice([1, 2]), rng.randrange(9) if not flags & S.SYN else 0
        packed.append({"ts_us": t, "up": side, "tcp_flags": flags, "tcp_seq": seq, "tcp_ack": ack, "payload_len": size})
        kind = keyed.END if flags & S.FIN else keyed.PLAIN if flags == S.ACK else keyed.ANSWER if flags & S.ACK else keyed.SYN
        rows.append({"ts_us": t, "packet_id": i, "kind": kind, "seq": seq, "ack": ack, "up": int(side == "c"), "payload_len": size})
    got = streamed(lambda: keyed.Flows(timeouts, 10 * SEC), (10, 1000, 20, 80, 6), arrivals(rng, rows, 8 * SEC, 20), 10 * SEC)
    summary = flows.flow_summary(flows.packets_with_flow(packets(spark, packed), timeouts=timeouts)).collect()
    columns = ("client_ip", "client_port", "start_us", "last_us", *keyed.COUNTERS)
    assert sorted(tuple(r[c] for c in columns) for r in got if r["way"] == "close") == sorted(tuple(r[c] for c in columns) for r in summary)
    assert sorted(r["start_us"] for r in got if r["way"] == "open") == sorted(r.start_us for r in summary)
    ticks = [(r.start_us, at) for r in summary for at in range(r.start_us + 10 * SEC, r.last_us + 1, 10 * SEC)]
    assert sorted((r["start_us"], r["at_us"]) for r in got if r["way"] == "tick") == sorted(ticks)


def test_dns_over_batches_gives_the_batch_transactions(spark):
    rng = random.Random(2)
    t, rows = 1000 * SEC, []
    for _ in range(60):
        t += rng.choice([1, 2, 4, 6, 30]) * SEC
        rows.append({"ts_us": t, "qr": rng.randrange(2), "client_ip": 1, "server_ip": 2, "opcode": rng.choice([None, 0, 2]), "qname": rng.choice([None, "a", "b"]),
                     "qtype": "Text", "rcode": rng.choice([None, 0, 3]), "bytes": rng.randrange(50)})
    got = streamed(lambda: keyed.Dns(5), (7, 9), arrivals(rng, rows, 3 * SEC, 7), 3 * SEC)
    schema = "flow_id bigint, dns_id bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.Dns.held)
    df = spark.createDataFrame([(7, 9, *(r[n] for n in keyed.Dns.held.names)) for r in rows], schema)
    want = tx.dns_txn(df).select(*keyed.Dns.record.names).collect()
    key = lambda r: [str(x) for x in r]
    assert sorted(map(key, (r.values() for r in got))) == sorted(map(key, want))


def test_turns_and_commands_over_batches():
    rng = random.Random(3)
    times = sorted(rng.sample(range(1000, 1400), 120))
    rows = [{"ts_us": t * SEC, "kind": rng.choice(["req", "rsp"]), "n": t} for t in times]
    got = streamed(lambda: keyed.Turns(600), (1,), arrivals(rng, rows, 4 * SEC, 13), 5 * SEC)
    asked, told = ([r for r in rows if r["kind"] == k] for k in ("req", "rsp"))
    want = [(i + 1, "open", r["ts_us"], r["n"]) for i, r in enumerate(asked)] + [(i + 1, "close", p["ts_us"], q["n"]) for i, (q, p) in enumerate(zip(asked, told))]
    assert sorted((r["turn_no"], r["way"], r["at_us"], r["n"]) for r in got) == sorted(want)
    rows = [{"ts_us": t * SEC, "late": rng.choice([0, 1, 1]), "bytes": rng.randrange(9)} for t in times]
    got = streamed(lambda: keyed.Commands(600), (1,), arrivals(rng, rows, 4 * SEC, 13), 5 * SEC)
    number, want = 0, {}
    for r in rows:
        number += not r["late"]
        want.setdefault(number, [0, 0])
        want[number][0] += r["late"]
        want[number][1] += r["late"] * r["bytes"]
    want.pop(0, None)
    sums = {n: [sum(r["rsp_count"] for r in got if r["command_no"] == n), sum(r["rsp_bytes"] for r in got if r["command_no"] == n)] for n in want}
    assert sums == want


def test_a_batch_writes_only_what_it_changed():
    store = Store()
    processor = keyed.Flows(Timeouts(), 10 * SEC)
    processor.init(store)
    key = (10, 1000, 20, 80, 17)
    row = {"ts_us": 5 * SEC, "packet_id": 1, "kind": 0, "seq": 0, "ack": 0, "up": 1, "payload_len": 3}
    assert list(processor.handleInputRows(key, iter([row]), Mark(0))) == [] and store.writes == 0
    assert [r.way for r in processor.handleExpiredTimer(key, Mark(6000), None)] == ["open"] and store.writes == 1
    assert list(processor.handleExpiredTimer(key, Mark(7000), None)) == [] and store.writes == 1


def test_rows_behind_the_watermark_are_dropped_and_counted(spark, tmp_path):
    schema = "flow_id bigint, dns_id bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.Dns.held)
    row = lambda dns, ts, qr: (1, dns, ts * SEC, qr, 1, 2, 0, "q", "t", None if qr == 0 else 0, 10)
    path = str(tmp_path / "in")
    for part in ([row(1, 1000, 0), row(2, 1001, 0)], [row(1, 1002, 1), row(3, 1030, 0)], [row(3, 1031, 1)], [row(2, 1004, 1)], [row(4, 9000, 0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    rows = jobs.stream_table(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    query = jobs.stream_dns(rows, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    # The answer to 2 came 16 seconds behind the mark of 1030 - 10 seconds, by which the batch before it went.
    assert jobs.dropped_rows(query) == 1
    got = spark.read.parquet(str(tmp_path / "out")).select("dns_id", "req_timeout").orderBy("dns_id").collect()
    assert [tuple(r) for r in got] == [(1, False), (2, True), (3, False)]


def test_late_answers_of_the_interval_join(spark, tmp_path):
    schema = "flow_id bigint, dns_id bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.Dns.held)
    row = lambda dns, ts, qr: (1, dns, ts * SEC, qr, 1, 2, 0, "q", "t", None if qr == 0 else 0, 10)
    path = str(tmp_path / "in")
    # 1 is asked twice and answered, 2 is answered six seconds late, 3's answer comes too late in the stream, 5 is never asked.
    for part in ([row(1, 1000, 0), row(1, 1001, 0), row(2, 1001, 0), row(3, 1002, 0)], [row(1, 1003, 1), row(2, 1007, 1), row(5, 1008, 1), row(4, 1040, 0)],
                 [row(4, 1041, 1)], [row(3, 1004, 1)], [row(6, 9000, 0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    rows = jobs.stream_table(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    query = jobs.stream_dns_joined(rows, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("dns_id").collect()
    assert [(r.dns_id, r.req_timeout, r.wait_ms) for r in got] == [(1, False, 3000), (2, True, None), (3, True, None), (4, False, 1000)]
    assert jobs.dropped_rows(query) == 1


def test_late_packets_stand_apart_and_are_counted(spark, tmp_path):
    rng = random.Random(5)
    times = [1000 + i + rng.choice([0, 0, 0, -5]) for i in range(60)]
    df = packets(spark, [{"ts_us": t * SEC} for t in times])
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for low in range(0, 60, 20):
        df.filter((F.col("packet_id") >= low) & (F.col("packet_id") < low + 20)).coalesce(1).write.mode("append").parquet(path)
    counts = []
    query = jobs.stream_late(jobs.stream_table(spark, path, df.schema, files_per_batch=1), out, str(tmp_path / "marks"), str(tmp_path / "cp"), told=lambda n, m: counts.append(m["late"]))
    query.awaitTermination()
    want = [(i, max(times[:i + 1]) * SEC, i > 0 and max(times[:i]) > t) for i, t in enumerate(times)]
    got = spark.read.parquet(out).orderBy("packet_id").collect()
    assert [(r.packet_id, r.account_us, str(r.late).lower() == "true") for r in got] == want
    apart = [f for f in (tmp_path / "out").rglob("late=true/*.parquet")]
    assert sum(spark.read.parquet(str(f)).count() for f in apart) == sum(counts) == sum(w[2] for w in want) > 0


def test_node_metrics_hold_a_row_of_state_a_node(spark, tmp_path):
    """Packets of many classes; the state's bound of memory does not hang on the session's settings."""
    rng, provider = random.Random(6), "spark.sql.streaming.stateStore.providerClass"
    rows = [{"ts_us": t * SEC, "up": rng.choice("cs"), "wire_len": rng.choice([60, 200, 600, 1600, None]), "src_mac": rng.choice([1, 2]), "dst_mac": rng.choice([1, 2, S.MAC_BROADCAST, None]),
             "ip_proto": rng.choice([6, 17, 1]), "frag_offset": rng.choice([0, 0, 0, 9]), "l4_len": rng.choice([None, 5]), "vlan_id": rng.choice([0, 7])} for t in range(1000, 1200)]
    rows += [{**r, "ip_proto": 0, "eth_type": S.ETH_ARP} for r in rows[::9]] + [{"ts_us": 9000 * SEC, "src_mac": 5, "dst_mac": 6}]
    df, path, out = packets(spark, rows), str(tmp_path / "in"), str(tmp_path / "out")
    for low, high in ((0, 1080), (1080, 1150), (1150, 9999)):
        df.filter((F.col("ts_us") >= low * SEC) & (F.col("ts_us") < high * SEC)).coalesce(1).write.mode("append").parquet(path)
    with settings(spark, {provider: "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"}):
        query = jobs.stream_node_metrics(jobs.stream_table(spark, path, df.schema, files_per_batch=3), out, str(tmp_path / "cp"))
        assert "HDFSBacked" in spark.conf.get(provider)
    query.awaitTermination()
    facts = nodes.node_facts(df)
    want = metrics.node_metrics(facts).filter(F.col("window_us") < 9000 * SEC - 30 * SEC)
    got = spark.read.parquet(out).drop("batch")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    states = [op for p in query.recentProgress for op in p["stateOperators"]]
    assert sum(op["numRowsUpdated"] for op in states) == facts.select(*nodes.NODE).distinct().count() < facts.count() / 2
    assert any("rocksdb" in name for op in states for name in op["customMetrics"])
    assert jobs.STATE["spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"] == "true"


def test_parts_are_read_by_their_times(spark, tmp_path):
    spark.range(0, 400, 1, 4).select("id", (F.col("id") * SEC).alias("ts_us")).write.parquet(str(tmp_path / "rows"))
    parts = qs.parts_of(spark.read.parquet(str(tmp_path / "rows")))
    assert all("GreaterThanOrEqual(ts_us" in part._jdf.queryExecution().executedPlan().toString() for part in parts)
    assert sorted(r.id for part in parts for r in part.collect()) == list(range(400))
