"""From packets to transactions: what the packets of a stream carried of each message.

Message bytes lie on the line of their session and side, and so do segments and
round-trip samples, so one as-of merge along that line tells which message a
packet belongs to: no packet meets more than the message before it, and a
busy session is spread by stretches of its line.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark import schema as S
from netspark.functions import net
from netspark.operators import tcp, transactions as tx
from netspark.operators.nodes import total, total_if
from netspark.operators.prefix import Prior, with_priors
from netspark.session import cut
from netspark.sources import dns_wire, http_wire, mysql_wire

LINE = [*S.SESSION, "side"]
SUMS = ["pkts", "l2_bytes", "rtt_sum", "rtt_count"]


def carried(starts: DataFrame, segments: DataFrame, samples: DataFrame) -> DataFrame:
    """Per message (line, offset): packets, L2 bytes, first and last time, round trips.

    `starts` has the offsets at which messages begin, `segments` the data
    packets (pos, pos_end, ts_us, wire_len), `samples` those of `rtt_samples`.
    A packet belongs to every message that it holds bytes of, and its L2 bytes
    to the one of its first byte; a sample to that of the last byte
    acknowledged.  Copies are packets like others.
    """
    none = F.lit(None).cast("bigint")
    segment = F.struct(F.col("pos_end").alias("end"), F.col("ts_us").alias("ts"), F.col("wire_len").cast("bigint").alias("wire"))
    rows = segments.select(*LINE, F.col("pos").alias("at"), F.lit(1).alias("rank"), none.alias("start"), segment.alias("seg"), none.alias("rtt"))
    no_segment = F.lit(None).cast(rows.schema["seg"].dataType)
    rows = rows.unionByName(starts.select(*LINE, F.col("offset").alias("at"), F.lit(0).alias("rank"), F.col("offset").alias("start"), no_segment.alias("seg"), none.alias("rtt")))
    rows = rows.unionByName(samples.select(*LINE, (F.col("point") - 1).alias("at"), F.lit(1).alias("rank"), none.alias("start"), no_segment.alias("seg"),
                                           F.col("rtt_us").alias("rtt")))
    rows = with_priors(rows, LINE, ["at", "rank"], F.floor(F.col("at") / tcp.SEQ_SLICE), [Prior("owner", "last", F.col("start")), Prior("before", "last", F.col("seg"))])
    begins = F.col("start").isNotNull()
    owner = F.when(begins, F.col("start")).otherwise(F.col("owner"))
    # At a message's start the packet before it is its own too if it goes on there.
    held = F.when(begins, F.when(F.col("before.end") > F.col("at"), F.col("before"))).otherwise(F.col("seg"))
    rows = rows.select(*LINE, owner.alias("offset"), held.alias("p"), F.when(~begins, F.col("seg.wire")).alias("wire"), "rtt")
    return (rows.filter("offset IS NOT NULL").groupBy(*LINE, "offset")
            .agg(F.count("p").alias("pkts"), total("wire").alias("l2_bytes"), F.min("p.ts").alias("first_us"), F.max("p.ts").alias("last_us"),
                 total("rtt").alias("rtt_sum"), F.count("rtt").alias("rtt_count")))


def _line(flow_packets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(data segments with their bytes, the same without, round-trip samples) of packets with payload."""
    line = cut(tcp.positions(flow_packets, payload=True, keep=["wire_len"]))
    segments = tcp.data_segments(line)
    return segments, segments.drop("payload"), tcp.rtt_samples(line.drop("payload"))


def by_side(rows: DataFrame, keys: list[str], request: str = "req", response: str = "rsp") -> DataFrame:
    """The sums of `carried` of both sides in one row per key; keys have `side`, 1 for requests."""
    out = []
    for side, name in ((1, request), (-1, response)):
        mine = F.col("side") == side
        out += [total_if(mine, c).alias(f"{name}_{c}") for c in SUMS]
        out += [f(F.when(mine, F.col(c))).alias(f"{name}_{c}") for f, c in ((F.min, "first_us"), (F.max, "last_us"))]
    rows = rows.groupBy(*keys).agg(*out)
    took = lambda a, b: net.to_ms(F.col(b) - F.col(a))
    return rows.withColumns({
        "req_ms": took("req_first_us", "req_last_us"), "rsp_ms": took("rsp_first_us", "rsp_last_us"), "wait_ms": took("req_last_us", "rsp_first_us"),
        "req_rtt": net.safe_mean("req_rtt_sum", "req_rtt_count"), "rsp_rtt": net.safe_mean("rsp_rtt_sum", "rsp_rtt_count")})


def flow_of(rows: DataFrame) -> DataFrame:
    """Rows with the session as one value, as message functions name a flow."""
    return rows.withColumn("flow_id", F.struct(*S.SESSION))


def session_of(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col("flow_id")[c].alias(c) for c in S.SESSION], *[c for c in rows.columns if c != "flow_id"])


# ---- HTTP ----

def http_carried(flow_packets: DataFrame) -> DataFrame:
    """HTTP messages of the packets, in the layout of `http_messages`, with what carried them and whether they are cut short."""
    whole, segments, samples = _line(flow_packets)
    framed = cut(http_wire.body_framing(whole, S.SESSION))
    ends = segments.groupBy(*LINE).agg(F.max("pos_end").alias("_last"))
    rows = framed.join(carried(framed, segments, samples), [*LINE, "offset"]).join(ends, LINE)
    aborted = (F.col("framing") == "length") & (F.col("offset") + F.length("head") + F.col("body_len") > F.col("_last"))
    extra = flow_of(http_wire.as_messages(rows)).select("flow_id", "kind", "n", "side", (F.length("head") + F.col("body_len")).alias("bytes"),
                                                        aborted.alias("aborted"), *SUMS, "first_us", "last_us")
    return tx.http_messages(flow_of(http_wire.as_messages(framed))).join(extra, ["flow_id", "kind", "n"])


def http_txn_from_packets(flow_packets: DataFrame) -> DataFrame:
    """Transactions of `http_txn` with packets, L2 bytes, times (ms) and mean round trips (us) each way, and their flags."""
    return http_records(cut(http_carried(flow_packets)))


def http_records(messages: DataFrame) -> DataFrame:
    turns = tx.numbered(messages.select("flow_id", "kind", "n", "ts_us", "side", "aborted", "version", *SUMS, "first_us", "last_us"))
    cut_short = turns.groupBy("flow_id", "turn_no").agg(
        F.max(F.when(F.col("side") == 1, F.col("aborted"))).alias("req_aborted"), F.max(F.when(F.col("side") == -1, F.col("aborted"))).alias("rsp_aborted"),
        F.max(F.when(F.col("side") == 1, F.col("version"))).alias("version"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("n"))
    waiting = tx.pipelined_requests(messages.select("flow_id", "kind", "n", "ts_us")).select("flow_id", "n", "pipelined")
    rows = tx.http_txn(messages).join(by_side(turns, ["flow_id", "turn_no"]), ["flow_id", "turn_no"]).join(cut_short, ["flow_id", "turn_no"])
    return session_of(rows.join(waiting, ["flow_id", "n"], "left").drop("n"))


def node_http_from_packets(flow_packets: DataFrame, seconds: int = S.PERIOD_S) -> DataFrame:
    """Node counters of `node_http` from the packets alone."""
    messages = http_carried(flow_packets)
    ends = flow_packets.groupBy(*S.SESSION).agg(*[F.max(c).alias(c) for c in ("client_mac", "server_mac", "client_ip", "server_ip", "vlan_id")])
    rows = session_of(messages).join(ends, S.SESSION)
    request = F.col("side") == 1
    both = {f"{a}_{k}": F.when(request, F.col(f"{x}_{k}")).otherwise(F.col(f"{y}_{k}")) for a, x, y in (("src", "client", "server"), ("dst", "server", "client")) for k in ("mac", "ip")}
    return tx.node_http(rows.withColumns(both), seconds)


# ---- MySQL ----

def mysql_txn_from_packets(flow_packets: DataFrame) -> DataFrame:
    """Transactions of `mysql_txn` with packets, L2 bytes, times (ms) and mean round trips (us) each way.

    The blocks of an answer share packets, so a command and its whole answer
    are the messages here.
    """
    whole, segments, samples = _line(flow_packets)
    messages = mysql_wire.mysql_messages(mysql_wire.mysql_packets(whole, S.SESSION), S.SESSION)
    messages = cut(messages.filter("command_no > 0 AND kind IN ('command', 'response')"))
    starts = messages.groupBy(*LINE, "command_no").agg(F.min("offset").alias("offset"))
    sums = starts.join(carried(starts, segments, samples), [*LINE, "offset"])
    told = messages.filter("kind = 'command'").select(*S.SESSION, "command_no", "argument", "missing")
    rows = session_of(tx.mysql_txn(flow_of(messages).drop("command_no")))
    sides = by_side(sums, [*S.SESSION, "command_no"]).drop("req_first_us", "req_last_us", "rsp_first_us", "rsp_last_us")
    return rows.join(sides, [*S.SESSION, "command_no"]).join(told, [*S.SESSION, "command_no"], "left")


# ---- DNS ----

def dns_txn_from_packets(packets: DataFrame, open_s: int = S.DNS_OPEN_S) -> DataFrame:
    """Transactions of `dns_txn` with answers, flags and L2 bytes, from UDP packets with their payload."""
    keep = ["ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "wire_len", "payload_len"]
    rows = dns_wire.dns_messages(packets, keep)
    query = F.col("qr") == 0
    end = lambda a, b, name: F.when(query, F.col(a)).otherwise(F.col(b)).cast("bigint").alias(name)
    flow = F.struct(end("src_ip", "dst_ip", "client_ip"), end("src_port", "dst_port", "client_port"), end("dst_ip", "src_ip", "server_ip"), end("dst_port", "src_port", "server_port"))
    rows = rows.withColumns({"flow_id": flow, "client_ip": end("src_ip", "dst_ip", "client_ip"), "server_ip": end("dst_ip", "src_ip", "server_ip"),
                             "bytes": F.col("payload_len").cast("bigint")})
    answer = ~query
    extra = [total_if(query, "wire_len").alias("req_l2_bytes"), total_if(answer, "wire_len").alias("rsp_l2_bytes"),
             F.max(F.when(answer, F.col("truncated"))).alias("truncated"), F.max(F.when(answer, F.col("authoritative"))).alias("authoritative"),
             F.max_by("answers", F.when(answer, F.col("ts_us"))).alias("answers")]
    out = tx.dns_rows(tx.dns_numbered(rows, open_s), extra)
    return out.select(*[F.col("flow_id")[c].alias(c) for c in ("client_port", "server_port")], *[c for c in out.columns if c != "flow_id"])
