"""TCP: connection set-up and end, sequence quality, round trips and turns.

Every function takes packets with flow columns (`flows.packets_with_flow`).
"""

from heapq import heappop, heappush
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark import schema as S
from netspark.functions import net
from netspark.operators.nodes import NODE, count, total, total_if
from netspark.operators.prefix import Prior, grouped, time_slice, unwrap, with_priors, with_steps
from netspark.operators.sessions import Timeouts
from netspark.session import cut

ARRIVAL = ["ts_us", "packet_id"]
SEQ_SLICE = 1 << 20


def tcp(flow_packets: DataFrame) -> DataFrame:
    return flow_packets.filter(F.col("ip_proto") == S.PROTO_TCP)


def next_seq(value) -> Column:
    return F.pmod(net.col(value) + 1, F.lit(S.UINT32))


def session_marks(flow_packets: DataFrame) -> DataFrame:
    """One row per TCP session: what `handshake` and `tcp_close` need of its packets.

    A job that needs both stores this table and hands it to both, so the
    packets are read, sorted and shuffled once.
    """
    at = [F.col(c) for c in ARRIVAL]
    answers = net.syn_ack() & (F.col("dir") == -1) & (F.col("tcp_ack") == next_seq("start_isn"))
    end = net.has_flag(S.FIN | S.RST)
    return tcp(flow_packets).groupBy(*S.SESSION, "client_ip", "client_port", "server_ip", "server_port").agg(
        F.min("start_us").alias("start_us"), F.max("ts_us").alias("last_us"), F.max("start_isn").alias("isn"),
        F.max("client_mac").alias("client_mac"), F.max("server_mac").alias("server_mac"), F.max("vlan_id").alias("vlan_id"),
        total_if(net.pure_syn()).alias("syn_count"),
        F.min(F.when(answers, F.struct(*at, "tcp_seq"))).alias("_ack"),
        F.min(F.when(~net.has_flag(S.SYN), F.struct(*at, "dir", "tcp_ack"))).alias("_data"),
        F.min(F.when(end & (F.col("dir") == 1), F.struct(*at, "dir"))).alias("_c"),
        F.min(F.when(end & (F.col("dir") == -1), F.struct(*at, "dir"))).alias("_s"),
        F.max(net.has_flag(S.RST)).alias("reset"), F.max(~net.has_flag(S.SYN)).alias("_plain"))


def handshake(flow_packets: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Per session: times of SYN, SYN-ACK and completion.

    `opened` is "handshake", "midstream" (first seen with a non-SYN packet) or
    "none".  The first non-SYN packet decides: it completes the handshake when
    the client sends it, after a SYN-ACK that answers the SYN, and it answers
    the SYN-ACK.  `marks` saves the sum over the packets where the caller has it.
    """
    rows = session_marks(flow_packets) if marks is None else marks
    done = ((F.struct("_ack.ts_us", "_ack.packet_id") < F.struct("_data.ts_us", "_data.packet_id"))
            & (F.col("_data.dir") == 1) & (F.col("_data.tcp_ack") == next_seq(F.col("_ack.tcp_seq"))))
    opened = (F.when(F.col("isn").isNull() & F.col("_data").isNotNull(), "midstream")
              .when(F.coalesce(done, F.lit(False)), "handshake").otherwise("none"))
    return (rows.withColumn("opened", opened)
            .select(*S.SESSION, "client_ip", "client_port", "server_ip", "server_port", "client_mac", "server_mac", "vlan_id",
                    "start_us", "isn", "syn_count", "opened",
                    F.when(F.col("isn").isNotNull(), F.col("start_us")).alias("syn_us"),
                    F.col("_ack.ts_us").alias("synack_us"),
                    F.when(F.col("opened") != "none", F.col("_data.ts_us")).alias("connected_us"),
                    F.col("_data").isNotNull().alias("has_data"))
            .withColumn("connect_us", F.when(F.col("opened") == "handshake", F.col("connected_us") - F.col("syn_us"))))


def half_open(handshakes: DataFrame) -> DataFrame:
    """Sessions whose SYN got no SYN-ACK, and sessions of SYN-ACKs without a SYN."""
    kind = (F.when(F.col("isn").isNotNull() & F.col("synack_us").isNull(), "syn_unanswered")
            .when(F.col("isn").isNull() & ~F.col("has_data"), "synack_orphan"))
    return (handshakes.withColumn("kind", kind).filter(F.col("kind").isNotNull())
            .select(*S.SESSION, "start_us", "syn_count", "kind"))


def tcp_errors(packets: DataFrame, flow_packets: DataFrame, seconds: int = S.PERIOD_S) -> DataFrame:
    """Per period: SYN with data, SYN-ACK without a SYN, SYN-ACK with a wrong number."""
    bad_syn = packets.filter(net.syn_with_data()).select("ts_us", F.lit("syn").alias("cause"))
    answers = tcp(flow_packets).filter(net.syn_ack())
    cause = (F.when(F.col("start_isn").isNull(), "session")
             .when(F.col("tcp_ack") != next_seq("start_isn"), "ack"))
    bad = answers.select("ts_us", cause.alias("cause")).filter(F.col("cause").isNotNull())
    return (bad_syn.unionByName(bad).groupBy(net.window_us(seconds).alias("window_us"))
            .agg(total_if(F.col("cause") == "syn").alias("syn_malformed"),
                 total_if(F.col("cause") == "session").alias("syn_broken"),
                 total_if(F.col("cause") == "ack").alias("ack_broken")))


def tcp_close(flow_packets: DataFrame, timeouts: Timeouts = Timeouts(), marks: DataFrame | None = None) -> DataFrame:
    """Per session: final state, closing side, closing times and cause.

    A session cut short by a new SYN on the same tuple, while its state still
    let it live, has cause "abort"; it is found by an equality join with the
    following session number.  That side is grouped by its keys, so Spark knows
    them unique and leaves the join out for readers that do not need the cause.
    `marks` saves the sum over the packets where the caller has it.
    """
    rows = (session_marks(flow_packets) if marks is None else marks).withColumn("_answered", F.col("_ack.ts_us"))
    first = F.least("_c", "_s")
    both = F.col("_c").isNotNull() & F.col("_s").isNotNull()
    state = (F.when(both, "closed").when(first.isNotNull(), "waiting").when(F.col("_plain"), "established")
             .when(F.col("_answered").isNotNull(), "ack").when(F.col("isn").isNotNull(), "syn").otherwise("none"))
    rows = rows.withColumns({"state": state, "closer": first["dir"], "close_us": first["ts_us"],
                             "closed_us": F.when(both, F.greatest("_c", "_s")["ts_us"])})
    follow = (rows.filter(F.col("isn").isNotNull()).groupBy(*S.FLOW_KEY, F.col("session_no").alias("_next"))
              .agg(F.min("start_us").alias("next_syn_us")))
    live = (F.when(F.col("state").isin("closed", "waiting"), F.col("close_us") + timeouts.closing_s * S.US)
            .when(F.col("state") == "established", F.col("last_us") + timeouts.tcp_s * S.US)
            .otherwise(F.coalesce("_answered", "start_us") + timeouts.opening_s * S.US))
    cause = (F.when(F.col("reset"), "reset").when(F.col("state") == "closed", "normal").when(F.col("next_syn_us") <= live, "abort")
             .when(F.col("state") == "syn", "broken").otherwise("timeout"))
    return (rows.withColumn("_next", F.col("session_no") + 1).join(follow, [*S.FLOW_KEY, "_next"], "left")
            .select(*S.SESSION, "start_us", "last_us", "state", "closer", "close_us", "closed_us", cause.alias("cause")))


def node_connections(handshakes: DataFrame, closes: DataFrame, seconds: int = S.PERIOD_S) -> DataFrame:
    """Per period and node: connections opened and connections that began to close."""
    ends = handshakes.join(closes.select(*S.SESSION, "close_us"), S.SESSION)
    happened = F.explode(F.array(F.struct(F.lit("connected").alias("what"), F.col("connected_us").alias("at")),
                                 F.struct(F.lit("closed").alias("what"),
                                          F.when(F.col("connected_us").isNotNull(), F.col("close_us")).alias("at"))))
    node = F.explode(F.array(F.struct(F.col("client_mac").alias("mac"), net.node_ip("client_ip").alias("ip")),
                             F.struct(F.col("server_mac").alias("mac"), net.node_ip("server_ip").alias("ip"))))
    return (ends.select("vlan_id", "client_mac", "client_ip", "server_mac", "server_ip", happened.alias("h"))
            .filter(F.col("h.at").isNotNull())
            .select("vlan_id", "h.what", net.window_us(seconds, "h.at").alias("window_us"), node.alias("n"))
            .select("window_us", "vlan_id", "what", "n.mac", "n.ip").groupBy(*NODE)
            .agg(total_if(F.col("what") == "connected").alias("connected"), total_if(F.col("what") == "closed").alias("closed")))


def flow_windows(flow_packets: DataFrame) -> DataFrame:
    """Per session and side: largest advertised window and number of zero windows."""
    return (tcp(flow_packets).filter(~net.has_flag(S.SYN | S.FIN | S.RST)).groupBy(*S.SESSION, "dir")
            .agg(F.max("tcp_window").alias("max_window"), total_if(F.col("tcp_window") == 0).alias("zero_windows")))


def flow_urgent(flow_packets: DataFrame) -> DataFrame:
    return (tcp(flow_packets).filter(F.col("tcp_urgent") > 0).groupBy(*S.SESSION, "dir")
            .agg(count().alias("urgent_pkts"), total("tcp_urgent").alias("urgent_bytes")))


def data_packets(flow_packets: DataFrame) -> DataFrame:
    return tcp(flow_packets).filter(F.col("payload_len") > 0)


def packet_gaps(flow_packets: DataFrame) -> DataFrame:
    """Per session and side: smallest positive time between data packets."""
    keys = [*S.SESSION, "dir"]
    sent = data_packets(flow_packets).select(*keys, *ARRIVAL, "slice_us")
    rows = with_priors(sent, keys, ARRIVAL, time_slice(sent),
                       [Prior("prev_ts", "lag", F.col("ts_us"))])
    gap = F.col("ts_us") - F.col("prev_ts")
    return rows.groupBy(*keys).agg(F.min(F.when(gap > 0, gap)).alias("min_gap_us"), count().alias("data_pkts"))


def turn_rows(flow_packets: DataFrame) -> DataFrame:
    """Finished runs of same-direction data packets.

    A run's length of silence before the next run is known at the next run's
    first packet; that packet reports it to the run before, so runs are summed
    by (session, run) and no run is looked up.
    """
    rows = data_packets(flow_packets).select(*S.SESSION, *ARRIVAL, "dir", "payload_len", "slice_us")
    rows = with_steps(rows, S.SESSION, ARRIVAL, time_slice(rows), F.struct("dir", "ts_us"), lambda a, b: a["dir"] != b["dir"], "turn",
                      first=1, previous="_last")
    turn = F.col("turn")
    none = F.lit(None).cast("bigint")
    packet = F.struct(turn.alias("turn"), F.col("ts_us").alias("at"), F.col("payload_len").cast("bigint").alias("bytes"),
                      none.alias("gap"))
    report = F.struct((turn - 1).alias("turn"), none.alias("at"), none.alias("bytes"),
                      (F.col("ts_us") - F.col("_last.ts_us")).alias("gap"))
    both = F.when(F.col("_last.dir") != F.col("dir"), F.array(packet, report)).otherwise(F.array(packet))
    return (rows.select(*S.SESSION, F.explode(both).alias("p")).groupBy(*S.SESSION, F.col("p.turn").alias("turn"))
            .agg((F.max("p.at") - F.min("p.at")).alias("duration_us"), F.max("p.gap").alias("interval_us"),
                 total(F.col("p.bytes")).alias("bytes"))
            .filter(F.col("interval_us").isNotNull()))


def turns(flow_packets: DataFrame) -> DataFrame:
    """Per session: number of finished turns and sum, min, max of time, interval (ms) and bytes."""
    rows = turn_rows(flow_packets).select(*S.SESSION, net.to_ms("duration_us").alias("time"),
                                          net.to_ms("interval_us").alias("interval"), "bytes")
    aggs = [f(c).alias(f"{n}_{c}") for c in ("time", "interval", "bytes")
            for n, f in (("sum", F.sum), ("min", F.min), ("max", F.max))]
    return rows.groupBy(*S.SESSION).agg(count().alias("turns"), *aggs)


def positions(flow_packets: DataFrame, payload: bool = False, keep: list[str] = ()) -> DataFrame:
    """Sequence and acknowledgement numbers on one unwrapped line per session and sending side.

    Each packet gives its sequence number to the line of its own side and its
    acknowledgement number to the line of the other side; in arrival order the
    two stay close together, so one pass of circular steps places both.  Where
    the packets have `sacks`, acknowledgements keep theirs as `blocks`, placed
    on the same line.  Columns in `keep` come along.
    """
    own = F.struct(F.col("dir").alias("side"), F.lit("seq").alias("kind"), F.col("tcp_seq").alias("value"))
    peer = F.struct((-F.col("dir")).alias("side"), F.lit("ack").alias("kind"), F.col("tcp_ack").alias("value"))
    sends = (F.col("payload_len") > 0) | net.has_flag(S.SYN | S.FIN)
    marks = F.filter(F.array(F.when(sends, own), F.when(net.has_flag(S.ACK), peer)), lambda m: m.isNotNull())
    kept = [*S.SESSION, *ARRIVAL, "payload_len", "syn", "slice_us", *keep]
    bytes_ = [F.when(F.col("m.kind") == "seq", F.col("payload")).alias("payload")] if payload else []
    sacked = "sacks" in flow_packets.columns
    if sacked:
        bytes_.append(F.when(F.col("m.kind") == "ack", F.col("sacks")).alias("_sacks"))
    rows = (tcp(flow_packets).withColumns({"syn": net.has_flag(S.SYN), "m": F.explode(marks)})
            .select(*kept, *bytes_, "m.*"))
    rows = unwrap(rows, [*S.SESSION, "side"], ARRIVAL, time_slice(rows), "value", "pos")
    length = F.when(F.col("kind") == "seq", F.col("payload_len") + F.col("syn").cast("int")).otherwise(0)
    rows = rows.withColumn("pos_end", F.col("pos") + length)
    if not sacked:
        return rows
    place = lambda edge: F.col("pos") + net.seq_diff(F.col("value"), edge)
    blocks = F.transform("_sacks", lambda b: F.struct(place(b["left"]).alias("lo"), place(b["right"]).alias("hi")))
    # A block before the acknowledgement number tells of a repeat, not of new bytes.
    return rows.withColumn("blocks", F.filter(blocks, lambda b: (b["lo"] >= F.col("pos")) & (b["lo"] < b["hi"]))).drop("_sacks")


LEVELS = 32


def covering_nodes(lo: Column, hi: Column) -> Column:
    """The dyadic intervals (level, node) that make up the whole numbers from lo up to, and without, hi.

    A level has two of them at most: the one left of an odd border, the one
    right of it.
    """
    def pieces(k):
        first, last = F.ceil(lo / F.pow(F.lit(2), k)).cast("bigint"), F.floor(hi / F.pow(F.lit(2), k)).cast("bigint")
        open_ = first < last
        node = lambda cond, n: F.when(open_ & cond, F.struct(k.alias("level"), n.alias("node")))
        return F.filter(F.array(node(F.pmod(first, F.lit(2)) == 1, first), node(F.pmod(last, F.lit(2)) == 1, last - 1)), lambda n: n.isNotNull())

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), pieces))


def sack_times(line: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, point, sack_us): when a selective acknowledgement first covered a point.

    Which blocks a point lies in is an interval stabbing: blocks are cut into
    dyadic intervals, of each the earliest time is kept, and a point looks up
    the one interval of each level that it lies in, of the levels its side
    has.  Points outside the span of their side's blocks are left out before
    they look anything up.  All are equality joins on (side, level, interval),
    so neither many blocks nor many segments of a side meet in one task, and
    nested or repeated blocks collapse before the shuffle.
    """
    blocks = line.filter((F.col("kind") == "ack") & (F.size("blocks") > 0)).select(*keys, "ts_us", F.explode("blocks").alias("b"))
    # The end of a segment is covered where lo < end <= hi.
    nodes = blocks.select(*keys, "ts_us", F.explode(covering_nodes(F.col("b.lo") + 1, F.col("b.hi") + 1)).alias("n"))
    nodes = nodes.groupBy(*keys, F.col("n.level").alias("level"), F.col("n.node").alias("node")).agg(F.min("ts_us").alias("sack_us"))
    levels = nodes.groupBy(*keys).agg(F.collect_set("level").alias("levels"), F.min(F.expr("shiftleft(node, level)")).alias("first"),
                                      F.max(F.expr("shiftleft(node + 1, level)")).alias("end"))
    inside = (F.col("point") >= F.col("first")) & (F.col("point") < F.col("end"))
    sought = points.join(levels, keys).filter(inside).select(*keys, "point", F.explode("levels").alias("level"))
    sought = sought.withColumn("node", F.floor(F.col("point") / F.pow(F.lit(2), F.col("level"))).cast("bigint"))
    return sought.join(nodes, [*keys, "level", "node"]).groupBy(*keys, "point").agg(F.min("sack_us").alias("sack_us"))


def rtt_segments(line: DataFrame) -> DataFrame:
    """First send time of each segment and the time its end was first acknowledged.

    Acknowledgements are cumulative, so the time a position was reached is the
    smallest time over all equal or higher acknowledgement numbers: a running
    minimum in falling position order.  No segment meets more than one value.
    Where the line has `blocks`, a selective acknowledgement of the segment's
    end counts as well.
    """
    keys = [*S.SESSION, "side"]
    if "blocks" in line.columns:
        # Segments and blocks are read several times each; placing the numbers once costs less.
        line = cut(line.select(*keys, "kind", "ts_us", "payload_len", "pos", "pos_end", "slice_us", "blocks"))
    point = F.when(F.col("kind") == "seq", F.col("pos_end")).otherwise(F.col("pos"))
    points = (line.filter((F.col("kind") == "ack") | (F.col("payload_len") > 0))
              .groupBy(*keys, "slice_us", point.alias("point"))
              .agg(F.min(F.when(F.col("kind") == "seq", F.col("ts_us"))).alias("sent_us"),
                   F.min(F.when(F.col("kind") == "ack", F.col("ts_us"))).alias("ack_us")))
    rows = with_priors(points, keys, ["point"], F.floor(F.col("point") / SEQ_SLICE),
                       [Prior("_higher", "min", F.col("ack_us"))], descending=True)
    out = (rows.filter(F.col("sent_us").isNotNull())
           .select(*keys, "point", "sent_us", F.least("ack_us", "_higher").alias("acked_us"), "slice_us"))
    if "blocks" not in line.columns:
        return out
    sacked = sack_times(line, out.select(*keys, "point"), keys)
    return out.join(sacked, [*keys, "point"], "left").withColumn("acked_us", F.least("acked_us", "sack_us")).drop("sack_us")


def rtt_samples(line: DataFrame) -> DataFrame:
    """Time from the first sending of a segment to its first later acknowledgement.

    A segment acknowledged before it was first seen gives no sample.
    """
    return (rtt_segments(line).filter(F.col("acked_us") > F.col("sent_us"))
            .withColumn("rtt_us", F.col("acked_us") - F.col("sent_us")).drop("slice_us"))


def flow_rtt(samples: DataFrame) -> DataFrame:
    return (samples.groupBy(*S.SESSION, "side")
            .agg(count().alias("rtt_count"), total("rtt_us").alias("rtt_sum"))
            .withColumn("rtt_mean", net.safe_mean("rtt_sum", "rtt_count")))


def outstanding_limit(line: DataFrame, limit: int = S.ACK_QUEUE) -> DataFrame:
    """Segments that a queue of `limit` unacknowledged segments would have dropped.

    A segment is dropped when at least `limit` further segments are first sent
    before it is acknowledged.  Sends and acknowledgement times go on one time
    line; the number of sends before each point is a running sum.
    """
    keys = [*S.SESSION, "side"]
    segments = rtt_segments(line)
    never = F.lit(2 ** 62).cast("bigint")
    moments = F.explode(F.array(F.struct(F.col("sent_us").alias("at"), F.lit(1).alias("send")),
                                F.struct(F.coalesce("acked_us", never).alias("at"), F.lit(0).alias("send"))))
    rows = segments.select(*keys, "point", "slice_us", moments.alias("m")).select(*keys, "point", "slice_us", "m.at", "m.send")
    # Acknowledgements go before sends of the same instant.
    rows = with_priors(rows, keys, ["at", "send", "point"], time_slice(rows, "at"),
                       [Prior("sends", "sum", F.col("send"))])
    waited = (F.max(F.when(F.col("send") == 0, F.col("sends"))) - F.max(F.when(F.col("send") == 1, F.col("sends"))) - 1)
    return (rows.groupBy(*keys, "point").agg(waited.alias("later")).groupBy(*keys)
            .agg(count().alias("segments"), total_if(F.col("later") >= limit).alias("rtt_dropped")))


def segment_classes(line: DataFrame) -> DataFrame:
    """Class of each data segment against the highest end seen before it.

    duplicate: same start held already; ahead: starts beyond it; fill: starts
    before it; order: starts at it.
    """
    side = [*S.SESSION, "side"]
    sent = line.filter(F.col("kind") == "seq").select(*side, *ARRIVAL, "payload_len", "pos", "pos_end", "slice_us")
    rows = with_priors(sent, side, ARRIVAL, time_slice(sent),
                       [Prior("high", "max", F.col("pos_end"))])
    rows = with_priors(rows.filter(F.col("payload_len") > 0), [*side, "pos"], ARRIVAL, time_slice(rows),
                       [Prior("copies", "sum", F.lit(1))])
    kind = (F.when(F.col("copies") > 0, "duplicate").when(F.col("high").isNull(), "order")
            .when(F.col("pos") > F.col("high"), "ahead").when(F.col("pos") < F.col("high"), "fill").otherwise("order"))
    return rows.withColumn("class", kind)


def tcp_sequence_quality(classes: DataFrame) -> DataFrame:
    """Per session and side: segments and bytes by class, new bytes and skipped bytes."""
    skip = F.when(F.col("class") == "ahead", F.col("pos") - F.col("high"))
    aggs = []
    for kind in ("order", "ahead", "fill", "duplicate"):
        hit = F.col("class") == kind
        aggs += [total_if(hit).alias(f"{kind}_count"), total_if(hit, "payload_len").alias(f"{kind}_bytes")]
    return classes.groupBy(*S.SESSION, "side").agg(*aggs, total(skip).alias("skipped_bytes"))


def data_segments(line: DataFrame) -> DataFrame:
    return line.filter((F.col("kind") == "seq") & (F.col("payload_len") > 0))


def distinct_segments(line: DataFrame) -> DataFrame:
    """One row per start position: first time, greatest length, number of copies."""
    return data_segments(line).groupBy(*S.SESSION, "side", "pos").agg(
        F.min("ts_us").alias("ts_us"), F.max("payload_len").alias("payload_len"), count().alias("copies"))


def segments_by_seq(line: DataFrame) -> DataFrame:
    """Held segments in sequence order, numbered per session and side."""
    keys = [*S.SESSION, "side"]
    rows = with_priors(distinct_segments(line), keys, ["pos"], F.floor(F.col("pos") / SEQ_SLICE),
                       [Prior("_before", "sum", F.lit(1))])
    return rows.withColumn("rank", F.col("_before") + 1).drop("_before")


BUCKET = 1 << 14


def earliest_cover(segments: list[tuple]) -> list[tuple]:
    """Pieces (lo, hi, at) of the line that segments (lo, hi, at) cover, cut at all their ends, with the least `at` over each.

    A sweep from the left with a heap of the segments open at a place; one that
    has ended leaves the heap when it comes to its top.
    """
    waiting = sorted(segments, reverse=True)
    ends = sorted({end for s in segments for end in s[:2]})
    out, open_ = [], []
    for lo, hi in pairwise(ends):
        while waiting and waiting[-1][0] <= lo:
            _, end, at = waiting.pop()
            heappush(open_, (at, end))
        while open_ and open_[0][1] <= lo:
            heappop(open_)
        if open_:
            out.append((lo, hi, open_[0][0]))
    return out


def first_arrivals(sent: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces of each line with the arrival that first covered them.

    Segments are cut at bucket borders, so an open one goes on in the next
    bucket, and each bucket is swept by itself.  Copies are merged first, so a
    bucket holds distinct segments of 16 KB only.
    """
    at = F.struct(*ARRIVAL)
    segments = sent.groupBy(*keys, "pos", "pos_end").agg(F.min(at).alias("at")).join(starts, keys)
    segments = segments.withColumn("lo", F.greatest("pos", "start")).filter(F.col("lo") < F.col("pos_end"))
    number = F.explode(F.sequence(F.floor(F.col("lo") / BUCKET), F.floor((F.col("pos_end") - 1) / BUCKET)))
    split = segments.withColumn("bucket", number).select(
        *keys, "bucket", F.greatest("lo", F.col("bucket") * BUCKET).alias("lo"), F.least("pos_end", (F.col("bucket") + 1) * BUCKET).alias("hi"), "at.ts_us", "at.packet_id")
    # Of segments that are equal inside the bucket the earliest counts.
    split = split.groupBy(*keys, "bucket", "lo", "hi").agg(F.min(F.struct("ts_us", "packet_id")).alias("at")).select(*keys, "bucket", "lo", "hi", "at.ts_us", "at.packet_id")
    long = [(n, pa.int64(), "BIGINT") for n in ("lo", "hi", "ts_us", "packet_id")]

    def swept(group: list[tuple]) -> list[tuple]:
        return [(lo, hi, *at) for lo, hi, at in earliest_cover([(lo, hi, (ts, n)) for lo, hi, ts, n in group])]

    pieces = grouped(split, [*keys, "bucket"], swept, long)
    return pieces.select(*keys, "lo", "hi", at.alias("at"))


def sequence_exact(line: DataFrame) -> DataFrame:
    """Quality counts against the next expected byte of each side.

    The next expected byte passes a position when the last of the bytes before
    it has arrived: a running maximum of first-arrival times in sequence order,
    and never behind a hole.  Each segment compares its own arrival with the
    times its start and its end were passed: old when the end was passed before,
    reordered when the start was not, else in order.
    """
    keys = [*S.SESSION, "side"]
    at = F.struct(*ARRIVAL)
    rows = line.filter(F.col("kind") == "seq").select(*keys, *ARRIVAL, "pos", "pos_end", "payload_len", "syn", "slice_us")
    data = rows.filter(F.col("payload_len") > 0)
    starts = rows.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("syn"), F.col("pos") + 1)),
                   F.min(F.when(F.col("payload_len") > 0, F.struct(*ARRIVAL, "pos")))["pos"]).alias("start"))
    pieces = first_arrivals(data, starts, keys).join(starts, keys)
    slice_ = F.floor(F.col("lo") / SEQ_SLICE)
    pieces = with_priors(pieces, keys, ["lo"], slice_, [Prior("_high", "max", F.col("hi")), Prior("passed", "max", F.col("at"))])
    pieces = pieces.withColumn("_gap", F.col("lo") - F.coalesce("_high", "start"))
    pieces = with_priors(pieces, keys, ["lo"], slice_, [Prior("_gaps", "sum", F.col("_gap"))])
    # Three readers follow; the pieces are stored once.
    pieces = cut(pieces.withColumn("open", F.col("_gap") + F.col("_gaps") == 0))
    begins = pieces.select(*keys, F.col("lo").alias("_lo"), F.col("open").alias("b_open"), F.col("passed").alias("b_at"))
    ends = pieces.select(*keys, F.col("hi").alias("pos_end"), F.col("open").alias("e_open"), F.greatest("passed", "at").alias("e_at"))
    marked = (data.join(starts, keys).withColumn("_lo", F.greatest("pos", "start"))
              .join(begins, [*keys, "_lo"], "left").join(ends, [*keys, "pos_end"], "left"))
    old = (F.col("pos_end") <= F.col("start")) | F.coalesce(F.col("e_open") & (F.col("e_at") < at), F.lit(False))
    ahead = (F.col("pos") > F.col("start")) & (~F.col("b_open") | F.coalesce(F.col("b_at") > at, F.lit(False)))
    marked = cut(marked.withColumn("class", F.when(old, "old").when(ahead, "ahead").otherwise("order"))
                 .select(*keys, *ARRIVAL, "pos", "payload_len", "class", "slice_us"))
    held = with_priors(marked.filter(F.col("class") == "ahead"), [*keys, "pos"], ARRIVAL,
                       time_slice(marked), [Prior("copies", "sum", F.lit(1))])
    again = held.filter(F.col("copies") > 0).groupBy(*keys).agg(
        count().alias("retransmit_count"), total("payload_len").alias("retransmit_bytes"))
    counts = []
    for kind, name in (("order", "order"), ("ahead", "reordered"), ("old", "dropped")):
        hit = F.col("class") == kind
        counts += [total_if(hit).alias(f"{name}_count"), total_if(hit, "payload_len").alias(f"{name}_bytes")]
    stream = pieces.groupBy(*keys).agg(total_if(F.col("open"), F.col("hi") - F.col("lo")).alias("stream_bytes"),
                                       total("_gap").alias("missing_bytes"))
    out = marked.groupBy(*keys).agg(*counts).join(stream, keys, "left").join(again, keys, "left")
    return out.select(*keys, *[c for c in out.columns if c.endswith(("_count", "_bytes")) and not c.startswith(("retransmit", "stream", "missing"))],
                      *[F.coalesce(c, F.lit(0)).alias(c) for c in ("retransmit_count", "retransmit_bytes", "stream_bytes", "missing_bytes")])
