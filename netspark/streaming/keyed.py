"""Keyed state of streams: rows of a key in the order of their times, with event-time timers.

Spark holds the state per key, writes only what a batch changed and calls a key
again when the watermark passes its timer.  A processor holds back the rows of
its key until the watermark has passed them, since earlier ones may still come;
rows behind the watermark are dropped and counted by Spark (`dropped_rows`).

Keys may be many with few rows each, so Spark's key is a bucket of them
(`Buckets`): a call of Python and a write of state serve a bucket's keys
together, where a call a key would cost far more than its rows.  A key may also
have very many rows: processors of HTTP and MySQL (`InColumns`) take all rows
of a bucket as columns, not one by one.
"""

import pickle
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState

from netspark import schema as S

NEVER = 2**62


class InOrder(StatefulProcessor):
    """Hands on a key's rows in order.

    A subclass names the columns that it holds (`held`, the first one ts_us,
    then what breaks ties), the fields of its state and of its records, and
    defines `take`.
    """

    held: T.StructType
    state: T.StructType
    record: T.StructType

    def take(self, key: tuple, state: tuple | None, rows: list[tuple], mark_us: int) -> tuple[list[tuple], tuple | None, int]:
        """(records, state, time) after rows that are due in order, all up to mark_us.

        A state of None is removed; the key is called again once the watermark
        has passed the time, if it is not NEVER.
        """
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getListState("held", self.held)
        self._state = handle.getValueState("state", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = self.held.names
        yield from self._advance(tuple(key), [tuple(r[n] for n in names) for r in rows], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(tuple(key), [], timerValues)

    def _advance(self, key: tuple, new: list[tuple], timer_values) -> Iterator[Row]:
        names = self.record.names
        for record in self.advance(key, new, timer_values.getCurrentWatermarkInMs() * 1000):
            yield Row(**dict(zip(names, record)))

    def advance(self, key: tuple, new: list[tuple], mark_us: int) -> list[tuple]:
        """Records with their key, after new rows and up to a time."""
        before = list(map(tuple, self._held.get())) if self._held.exists() else []
        rows = sorted(before + new)
        due = bisect_right(rows, mark_us, key=lambda r: r[0])
        old = self._state.get()
        records, state, wake_us = self.take(key, None if old is None else tuple(old), rows[:due], mark_us)
        if rows[due:] != before:
            if due < len(rows):
                self._held.put(rows[due:])
            elif before:
                self._held.clear()
        if state is None:
            if old is not None:
                self._state.clear()
        elif old is None or tuple(old) != state:
            self._state.update(state)
        self._wake(min(wake_us, rows[due][0] if due < len(rows) else NEVER))
        return [(*key, *record) for record in records]

    def _wake(self, at_us: int) -> None:
        """One timer a key, at the first millisecond that is not before a time."""
        timers = list(self._handle.listTimers())
        at = None if at_us >= NEVER else -(-at_us // 1000)
        for t in timers:
            if t != at:
                self._handle.deleteTimer(t)
        if at is not None and at not in timers:
            self._handle.registerTimer(at)

    def close(self) -> None:
        pass


class Cell:
    """A value or list of one key."""

    def __init__(self, values: dict, name: str):
        self._values, self._name = values, name

    def exists(self) -> bool:
        return self._name in self._values

    def get(self):
        return self._values.get(self._name)

    def update(self, value) -> None:
        self._values[self._name] = value

    put = update

    def clear(self) -> None:
        self._values.pop(self._name, None)


class Kept:
    """The state of one key in its bucket, with the calls of Spark's handle that a processor makes."""

    def __init__(self, values: dict, timers: set[int]):
        self.values, self.timers = values, timers

    def getValueState(self, name: str, schema: T.StructType) -> Cell:
        return Cell(self.values, name)

    getListState = getValueState

    def listTimers(self) -> Iterator[int]:
        return iter(self.timers)

    def registerTimer(self, at: int) -> None:
        self.timers.add(at)

    def deleteTimer(self, at: int) -> None:
        self.timers.discard(at)


class Buckets(StatefulProcessor):
    """Runs a processor for all keys of a bucket.

    The state of a bucket's keys is one value, written when a batch changed
    one of them; its timer is the earliest of theirs.  Rows of a batch come as
    data frames (`packed`).
    """

    def __init__(self, processor: InOrder, keys: list[str]):
        self.processor, self.keys = processor, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._kept = handle.getValueState("keys", T.StructType([T.StructField("kept", T.BinaryType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names, width = [*self.keys, *self.processor.held.names], len(self.keys)
        if isinstance(self.processor, InColumns):
            yield from self._advance_columns([self.processor.coded(pdf, names) for pdf in rows], timerValues)
            return
        new = defaultdict(list)
        for pdf in rows:
            for nulls, *row in zip(pdf[NULLS].tolist(), *(pdf[n].tolist() for n in names)):
                if nulls:
                    row = [None if nulls >> i & 1 else v for i, v in enumerate(row)]
                new[tuple(row[:width])].append(tuple(row[width:]))
        yield from self._advance(new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance_columns([], timerValues) if isinstance(self.processor, InColumns) else self._advance({}, timerValues)

    def _advance_columns(self, new: list[dict], timer_values) -> Iterator[pd.DataFrame]:
        before = self._kept.get()
        kept = {} if before is None else {name: widened(table) for name, table in pickle.loads(before[0]).items()}
        told, kept, wake_us = self.processor.advance(self.keys, kept, new, timer_values.getCurrentWatermarkInMs() * 1000)
        if kept:
            self._kept.update((pickle.dumps({name: narrowed(table) for name, table in kept.items()}, pickle.HIGHEST_PROTOCOL),))
        elif before is not None:
            self._kept.clear()
        self._wake(None if wake_us is None else -(-wake_us // 1000))
        for first in range(0, len(told), FRAME_ROWS):
            yield told[first:first + FRAME_ROWS]

    def _advance(self, new: dict[tuple, list[tuple]], timer_values) -> Iterator[pd.DataFrame]:
        mark_ms = timer_values.getCurrentWatermarkInMs()
        before = self._kept.get()
        kept = {} if before is None else pickle.loads(before[0])
        records = []
        due = [k for k, (_, timers) in kept.items() if k not in new and any(t < mark_ms for t in timers)]
        for key in [*new, *due]:
            values, timers = kept.pop(key, None) or ({}, set())
            timers = {t for t in timers if t >= mark_ms}
            self.processor.init(Kept(values, timers))
            records += self.processor.advance(key, new.get(key, []), mark_ms * 1000)
            if values or timers:
                kept[key] = values, timers
        if kept:
            self._kept.update((pickle.dumps(kept, pickle.HIGHEST_PROTOCOL),))
        elif before is not None:
            self._kept.clear()
        self._wake(min((t for _, timers in kept.values() for t in timers), default=None))
        if records:
            yield pd.DataFrame(records, columns=self.processor.record.names, dtype=object)

    def _wake(self, first: int | None) -> None:
        timers = list(self._handle.listTimers())
        for t in timers:
            if t != first:
                self._handle.deleteTimer(t)
        if first is not None and first not in timers:
            self._handle.registerTimer(first)

    def close(self) -> None:
        pass


# Fixed for the life of a checkpoint.
BUCKETS = 1024
NULLS = "nulls"
FRAME_ROWS = 50_000


class Grouped:
    """The state of a group of Spark's rows, with the calls of a processor's handle that `Buckets` makes: one value, one timer.

    A group's timer holds until its next call only, so there is none to list.
    """

    def __init__(self, state: GroupState):
        self._state = state

    def getValueState(self, name: str, schema: T.StructType) -> "Grouped":
        return self

    def get(self) -> tuple | None:
        return self._state.getOption

    def update(self, value: tuple) -> None:
        self._state.update(value)

    def clear(self) -> None:
        self._state.remove()

    def listTimers(self) -> Iterator[int]:
        return iter(())

    def registerTimer(self, at: int) -> None:
        self._state.setTimeoutTimestamp(at)

    def getCurrentWatermarkInMs(self) -> int:
        return max(self._state.getCurrentWatermarkMs(), 0)


def packed(rows: DataFrame, keys: list[str], held: list[str]) -> DataFrame:
    """Rows with their bucket and, as pandas has no null number, a bit for each number that is null."""
    types = dict(rows.dtypes)
    names = [*keys, *held]
    numbers = [n for n in names if types[n] != "string"]
    nulls = sum((F.col(n).isNull().cast("bigint") * (1 << names.index(n)) for n in numbers), F.lit(0).cast("bigint"))
    return rows.withColumns({"bucket": F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)), NULLS: nulls,
                             **{n: F.coalesce(n, F.lit(0).cast(types[n])) for n in numbers}})


def records(rows: DataFrame, keys: list[str], processor: InOrder) -> DataFrame:
    """Records of a stream of rows with keys and a watermark, made by a processor that takes each key's rows in order.

    `applyInPandasWithState` hands a group's rows to Python as slices of Arrow
    batches; `transformWithStateInPandas` makes an object of each row first.
    """
    def each(bucket, frames, state: GroupState) -> Iterator[pd.DataFrame]:
        buckets, handle = Buckets(processor, keys), Grouped(state)
        buckets.init(handle)
        yield from buckets.handleExpiredTimer(bucket, handle, None) if state.hasTimedOut else buckets.handleInputRows(bucket, frames, handle)

    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return packed(rows, keys, processor.held.names).groupBy("bucket").applyInPandasWithState(each, processor.record, "kept binary", "append", "EventTimeTimeout")


def columns(schema: T.StructType) -> list:
    """The columns of a schema, cast as it says."""
    return [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]


def append(rows: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a query that appends its rows to a folder of files, each row once."""
    return (rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(**(trigger or {"availableNow": True})).start())


def longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


# ---- flows ----

FLOW_KEYS = T.StructType([*longs("ip_a", "port_a", "ip_b", "port_b"), T.StructField("ip_proto", T.IntegerType())])
COUNTERS = ["client_pkts", "client_bytes", "server_pkts", "server_bytes"]
PLAIN, END, SYN, ANSWER = range(4)
OPENED, ANSWERED, ESTABLISHED, CLOSING, OVER = range(5)


class Flows(InOrder):
    """Open, tick and close records of the sessions of a flow; the rules are those of `flows.packets_with_flow`.

    The last SYN number of a flow is remembered for the active time beyond its
    last session.
    """

    held = T.StructType(longs("ts_us", "packet_id", "kind", "seq", "ack", "up", "payload_len"))
    state = T.StructType(longs("phase", "live_us", "isn", "up", "start_us", "last_us", *COUNTERS))
    record = T.StructType([*FLOW_KEYS, *longs("client_ip", "client_port", "server_ip", "server_port", "start_us"), T.StructField("way", T.StringType()),
                           *longs("at_us", "last_us", *COUNTERS)])

    def __init__(self, timeouts, cycle_us: int):
        self.timeouts, self.cycle_us = timeouts, cycle_us

    def lives_us(self, proto: int, phase: int) -> int:
        t = self.timeouts
        if proto != S.PROTO_TCP:
            return (t.udp_s if proto == S.PROTO_UDP else t.icmp_s) * S.US
        return {ESTABLISHED: t.tcp_s, CLOSING: t.closing_s}.get(phase, t.opening_s) * S.US

    def take(self, key, state, rows, mark_us):
        proto, records = key[4], []
        phase, live, isn, client, start, last, *counts = state or (OVER, -1, -1, 1, 0, 0, 0, 0, 0, 0)

        def told(way, at):
            a, b = key[:2], key[2:4]
            ends = (*a, *b) if client else (*b, *a)
            records.append((*ends, start, way, at, last, *counts))

        for ts, _, kind, seq, ack, up, size in rows:
            before, number = isn, phase
            if kind == SYN:
                isn = seq
            if phase == OVER or ts > live or (kind == SYN and before != seq):
                if phase != OVER:
                    told("close", last)
                number, client, start, last, counts = None, up, ts, ts, [0, 0, 0, 0]
                phase = {SYN: OPENED, ANSWER: ANSWERED, END: CLOSING}.get(kind, ESTABLISHED)
            elif kind == END:
                phase = CLOSING
            elif kind == PLAIN and phase < ESTABLISHED:
                phase = ESTABLISHED
            elif kind == ANSWER and phase == OPENED and ack == (before + 1) % S.UINT32:
                phase = ANSWERED
            if phase != number or phase == ESTABLISHED:
                live = ts + self.lives_us(proto, phase)
            side = 0 if up == client else 2
            counts[side] += 1
            counts[side + 1] += size
            if number is None:
                told("open", ts)
            ticked, last = (last - start) // self.cycle_us, ts
            for n in range(ticked + 1, (last - start) // self.cycle_us + 1):
                told("tick", start + n * self.cycle_us)
        if phase != OVER and live < mark_us:
            told("close", last)
            phase = OVER
        if phase == OVER:
            live_on = live + self.timeouts.tcp_s * S.US
            if isn < 0 or live_on < mark_us:
                return records, None, NEVER
            return records, (phase, live, isn, client, start, last, *counts), live_on + 1
        return records, (phase, live, isn, client, start, last, *counts), live + 1


# ---- DNS ----

class Dns(InOrder):
    """Transactions of one (flow, id), as soon as they are answered or their time is over; the rules are those of `transactions.dns_txn`."""

    told = ["client_ip", "server_ip", "opcode", "qname", "qtype"]
    held = T.StructType([*longs("ts_us", "qr", "client_ip", "server_ip", "opcode"), T.StructField("qname", T.StringType()), T.StructField("qtype", T.StringType()),
                         *longs("rcode", "bytes")])
    state = T.StructType([*longs("last_us", "req_pkts", "req_bytes", "client_ip", "server_ip", "opcode"), T.StructField("qname", T.StringType()),
                          T.StructField("qtype", T.StringType())])
    record = T.StructType([*longs("flow_id", "dns_id"), *[f for f in held if f.name in ("client_ip", "server_ip", "opcode", "qname", "qtype")],
                           *longs("rcode", "req_us", "rsp_us", "req_pkts", "req_bytes", "rsp_pkts", "rsp_bytes")])

    def __init__(self, open_s: int):
        self.open_us = open_s * S.US

    def take(self, key, state, rows, mark_us):
        records = []

        def over(open_):
            last, pkts, size, *names = open_
            records.append((*names, None, last, None, pkts, size, 0, 0))

        for ts, qr, *names, rcode, size in rows:
            if state is not None and ts - state[0] > self.open_us:
                over(state)
                state = None
            # Of several values of a transaction the greatest counts.
            merged = names if state is None else [a if b is None else b if a is None else max(a, b) for a, b in zip(state[3:], names)]
            asked = (None, 0, 0) if state is None else state[:3]
            if qr == 0:
                state = (ts, asked[1] + 1, asked[2] + (size or 0), *merged)
            else:
                records.append((*merged, rcode, asked[0], ts, asked[1], asked[2], 1, size or 0))
                state = None
        if state is not None and state[0] + self.open_us < mark_us:
            over(state)
            state = None
        return records, state, NEVER if state is None else state[0] + self.open_us + 1


# ---- HTTP and MySQL ----

Table = dict[str, np.ndarray]


def picked(table: Table, where) -> Table:
    return {name: values[where] for name, values in table.items()}


def joined(tables: list[Table]) -> Table:
    return {name: np.concatenate([t[name] for t in tables]) for name in tables[0]}


def narrowed(table: Table) -> Table:
    """Columns as the shortest numbers that hold them; `widened` undoes it."""
    return {name: v.astype(np.result_type(np.min_scalar_type(v.min()), np.min_scalar_type(v.max()))) if len(v) and min(v.min(), -v.max()) > -2**31 else v
            for name, v in table.items()}


def widened(table: Table) -> Table:
    return {name: v.astype(np.int64) for name, v in table.items()}


def nullable(values: np.ndarray, null: np.ndarray):
    return pd.arrays.IntegerArray(values, null)


class InColumns(StatefulProcessor):
    """Hands on the rows of many keys in the order of their times, as columns of numbers.

    A subclass names `held` and `record` as for `InOrder`, the numbers of a
    key's state (`state`, the last one last_us) and what else it keeps, and
    defines `step`.  Whatever the number of keys and of a key's rows, a call
    takes a few passes over columns.
    """

    held: T.StructType
    state: T.StructType
    record: T.StructType

    def __init__(self, silent_s: int):
        self.silent_us = silent_s * S.US

    def step(self, at: np.ndarray, rows: Table, state: Table, kept: dict[str, Table]) -> tuple[np.ndarray, Table]:
        """(key numbers, record columns) of due rows, sorted by key number `at` and time; brings `state` and `kept` up to date.

        A state has one number a key, zero where the key is new; a kept table
        tells its rows' keys in `at`.
        """
        raise NotImplementedError

    def coded(self, frame: pd.DataFrame, names: list[str]) -> Table:
        """A frame as numbers."""
        return {n: frame[n].to_numpy(np.int64) for n in (*names, NULLS)}

    def advance(self, keys: list[str], kept: dict[str, Table], new: list[Table], mark_us: int) -> tuple[pd.DataFrame, dict[str, Table], int | None]:
        """(records, what is kept, time of the next call) after new rows and up to a time."""
        columns, own = self.held.names, 1 << len(keys)
        if any((t[NULLS] & own).any() for t in new):
            raise ValueError(f"a row has no {columns[0]}")
        none = {n: np.empty(0, np.int64) for n in (*keys, *columns, NULLS)}
        rows = joined([kept.get("held", none), *new])
        rows = picked(rows, np.lexsort([rows[c] for c in reversed(columns)]))
        due = np.searchsorted(rows[columns[0]], mark_us, "right")
        rows, later = picked(rows, slice(due)), picked(rows, slice(due, None))

        # Keys get numbers, those with a state first.
        ids = [*keys, "key_nulls"]
        rows["key_nulls"] = rows[NULLS] & (own - 1)
        old = kept.get("state", {n: np.empty(0, np.int64) for n in (*ids, *self.state.names)})
        named = joined([picked({n: t[n] for n in ids}, slice(None)) for t in (old, rows)])
        number = pd.DataFrame(named).groupby(ids, sort=False).ngroup().to_numpy()
        firsts = np.unique(number, return_index=True)[1]
        known, at = len(old["key_nulls"]), number[len(old["key_nulls"]):]
        state = {n: np.concatenate([old[n], np.zeros(len(firsts) - known, np.int64)]) for n in self.state.names}
        others = {n: t for n, t in kept.items() if n not in ("held", "state")}

        order = np.argsort(at, kind="stable")
        at, rows = at[order], picked(rows, order)
        told_at, told = self.step(at, rows, state, others)
        last = np.append(at[1:] != at[:-1], True) if len(at) else np.empty(0, bool)
        state[self.state.names[-1]][at[last]] = rows[columns[0]][last]

        # A key goes once it has been silent.
        lives = state[self.state.names[-1]] + self.silent_us >= mark_us
        index = np.cumsum(lives) - 1
        named = picked(named, firsts)
        out = {"held": later, "state": picked({**named, **state}, lives)}
        for name, table in others.items():
            table = picked(table, lives[table["at"]])
            out[name] = {**table, "at": index[table["at"]]}
        wakes = [t.min() for t in (out["state"][self.state.names[-1]] + self.silent_us + 1, later[columns[0]]) if len(t)]
        told = {**{k: nullable(named[k][told_at], (named["key_nulls"][told_at] >> i & 1).astype(bool)) for i, k in enumerate(keys)}, **told}
        return pd.DataFrame(told, columns=self.record.names), {n: t for n, t in out.items() if any(map(len, t.values()))}, min(wakes, default=None) and int(min(wakes))

    # One key alone is a bucket of one.

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle

    def _alone(self, key: tuple) -> Buckets:
        buckets = Buckets(self, self.record.names[:len(key)])
        buckets.init(self._handle)
        return buckets

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        buckets = self._alone(key)
        frame = pd.DataFrame([{**dict(zip(buckets.keys, key)), **{n: r[n] for n in self.held.names}, NULLS: 0} for r in rows])
        for pdf in buckets.handleInputRows(key, iter([frame]), timerValues):
            yield from (Row(**r) for r in pdf.to_dict("records"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for pdf in self._alone(key).handleExpiredTimer(key, timerValues, expiredTimerInfo):
            yield from (Row(**r) for r in pdf.to_dict("records"))

    def close(self) -> None:
        pass


def within(at: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Running count of marks inside each run of equal numbers."""
    sums = np.cumsum(marks)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.empty(0, np.int64)
    before = sums[first] - marks[first]
    return sums - np.repeat(before, np.diff(np.append(first, len(at))))


class Turns(InColumns):
    """Open and close events of requests and responses matched first in, first out.

    Requests and responses are numbered alike, so equal numbers match.
    Messages without a partner wait in a table of their own.  Counts and
    waiting messages go once the flow has been silent for the session timeout.
    """

    held = T.StructType([*longs("ts_us"), T.StructField("kind", T.StringType()), *longs("n")])
    state = T.StructType(longs("requests", "responses", "last_us"))
    record = T.StructType([*longs("flow_id", "turn_no"), T.StructField("way", T.StringType()), *longs("at_us", "n")])

    def coded(self, frame, names):
        return super().coded(frame.assign(kind=(frame["kind"] != "req").astype("int64")), names)

    def step(self, at, rows, state, kept):
        sides, none = {}, {n: np.empty(0, np.int64) for n in ("at", "turn_no", "ts_us", "n", "no_n")}
        waits = kept.get("waits", none)
        asked = state["requests"] > state["responses"]
        for side, code, waiting in (("requests", 0, asked[waits["at"]]), ("responses", 1, ~asked[waits["at"]])):
            mine = rows["kind"] == code
            here = at[mine]
            new = {"at": here, "turn_no": state[side][here] + within(here, np.ones(len(here), np.int64)), "ts_us": rows["ts_us"][mine], "n": rows["n"][mine],
                   "no_n": rows[NULLS][mine] >> NULL_N & 1}
            sides[side] = new, joined([picked(waits, waiting), new])
        for side, (new, _) in sides.items():
            state[side] += np.bincount(new["at"], minlength=len(state[side]))
        opened, (asks, answers) = sides["requests"][0], [both for _, both in sides.values()]
        place = lambda t: t["at"] << 40 | t["turn_no"]
        _, a, b = np.intersect1d(place(asks), place(answers), assume_unique=True, return_indices=True)
        kept["waits"] = joined([picked(asks, np.setdiff1d(np.arange(len(asks["at"])), a, True)), picked(answers, np.setdiff1d(np.arange(len(answers["at"])), b, True))])
        closed = {**picked(asks, a), "ts_us": answers["ts_us"][b]}
        told = joined([opened, closed])
        way = np.repeat(np.array(["open", "close"], object), [len(opened["at"]), len(a)])
        return told["at"], {"turn_no": told["turn_no"], "way": way, "at_us": told["ts_us"], "n": nullable(told["n"], told["no_n"].astype(bool))}


# The bit of n behind the flow, time and kind.
NULL_N = 3


class Commands(InColumns):
    """Per command the open time and the sums of its responses, told again whenever some are due (`jobs.mysql_updates` sums them)."""

    held = T.StructType(longs("ts_us", "late", "bytes"))
    state = T.StructType(longs("commands", "last_us"))
    record = T.StructType(longs("flow_id", "command_no", "open_us", "rsp_us", "rsp_count", "rsp_bytes"))

    def step(self, at, rows, state, kept):
        command = rows["late"] == 0
        number = state["commands"][at] + within(at, command.astype(np.int64))
        state["commands"] += np.bincount(at[command], minlength=len(state["commands"]))
        named = number > 0
        at, number, late, ts, size = at[named], number[named], ~command[named], rows["ts_us"][named], rows["bytes"][named]
        if not len(at):
            none = np.empty(0, np.int64)
            return at, {n: none for n in self.record.names[1:]}
        # Rows of a command follow each other, the command first where it is among them.
        first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (number[1:] != number[:-1])))
        last = np.append(first[1:], len(at)) - 1
        responses = np.add.reduceat(late.astype(np.int64), first)
        return at[first], {"command_no": number[first], "open_us": nullable(ts[first], late[first]), "rsp_us": nullable(ts[last], responses == 0),
                           "rsp_count": responses, "rsp_bytes": np.add.reduceat(np.where(late, size, 0), first)}
