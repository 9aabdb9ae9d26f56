"""One stream of session and transaction events, and the connection log."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark import schema as S
from netspark.functions import net
from netspark.functions.names import EVENT_CODE
from netspark.operators import tcp
from netspark.operators.nodes import count

# Order of the event groups of one period.
PHASES = {"event": 1, "flow_open": 2, "txn_open": 3, "txn_close": 4, "tick": 5, "flow_close": 6}
EVENT = ["phase", "event_code", "content", "at_us", "client_ip", "server_ip", "bytes"]


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _event(phase: str, code, content: str, at, size=None):
    """One event as a struct; `at` null tells that it did not happen."""
    code = F.lit(EVENT_CODE[code]) if isinstance(code, str) else code
    return F.struct(F.lit(PHASES[phase]).alias("phase"), code.alias("event_code"), F.lit(content).alias("content"), net.col(at).alias("at_us"),
                    (F.lit(0) if size is None else size).cast("bigint").alias("bytes"))


def _events(rows: DataFrame, events, client: str = "client_ip", server: str = "server_ip") -> DataFrame:
    """The events of each row, so that the rows are computed once for all of them."""
    happened = F.filter(events, lambda e: e["at_us"].isNotNull())
    rows = rows.select(F.explode(happened).alias("e"), F.col(client).alias("client_ip"), F.col(server).alias("server_ip"))
    return rows.select(*[F.col(f"e.{c}") if c not in ("client_ip", "server_ip") else F.col(c) for c in EVENT])


def packet_events(packets: DataFrame) -> DataFrame:
    """ARP packets and ICMP messages of unreachable ends."""
    arp = F.col("eth_type") == S.ETH_ARP
    unreachable = (F.col("ip_proto") == S.PROTO_ICMP) & (F.col("icmp_type") == 3)
    size = F.col("wire_len")
    events = F.array(_event("event", "arp", "arp", F.when(arp, F.col("ts_us")), size),
                     _event("event", "icmp", "icmp_unreachable", F.when(unreachable, F.col("ts_us")), size))
    return _events(packets.filter(arp | unreachable), events, "src_ip", "dst_ip")


def flow_events(summary: DataFrame, cycle_us: int = S.TICK_S * S.US) -> DataFrame:
    """Open, tick and close events of TCP and UDP flows, close events of echo flows."""
    size = F.col("client_bytes") + F.col("server_bytes")
    by_proto = lambda what: (F.when(F.col("ip_proto") == S.PROTO_TCP, EVENT_CODE[f"tcp_{what}"])
                             .otherwise(EVENT_CODE[f"udp_{what}"]))
    step = F.lit(cycle_us).cast("bigint")
    long = F.col("last_us") - F.col("start_us") >= cycle_us
    times = F.when(long, F.sequence(F.col("start_us") + step, F.col("last_us"), step)).otherwise(F.array().cast("array<bigint>"))
    ticks = F.transform(times, lambda at: _event("tick", "flow_tick", "flow_body", at))
    stream = F.concat(F.array(_event("flow_open", by_proto("open"), "flow_head", "start_us"),
                              _event("flow_close", by_proto("close"), "flow_body", "last_us", size)), ticks)
    echo = F.array(_event("flow_close", "icmp", "icmp_echo", "last_us", size))
    return _events(summary, F.when(F.col("ip_proto") == S.PROTO_ICMP, echo).otherwise(stream))


def transaction_events(dns: DataFrame, http: DataFrame, mysql: DataFrame) -> DataFrame:
    """HTTP open events and the close events of finished transactions."""
    size = F.col("req_bytes") + F.col("rsp_bytes")
    return union([
        _events(http, F.array(_event("txn_open", "http_request", "http", "req_us", F.col("req_bytes")),
                              _event("txn_close", "http_response", "http", "rsp_us", size))),
        _events(dns, F.array(_event("txn_close", "dns", "dns", F.coalesce("rsp_us", "req_us"), size))),
        _events(mysql, F.array(_event("txn_close", "mysql", "mysql_command", F.coalesce("rsp_last_us", "req_last_us"), size)))])


def all_events(packets, summary, dns, http, mysql, cycle_us: int = S.TICK_S * S.US) -> DataFrame:
    return union([packet_events(packets), flow_events(summary, cycle_us), transaction_events(dns, http, mysql)])


def event_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("phase", "event_code", "content").agg(count().alias("n"))


def flow_app_events(transactions: DataFrame, flows: DataFrame) -> DataFrame:
    """Transactions with the end points and label of the flow that carried them."""
    owner = flows.select(*S.SESSION, "client_ip", "client_port", "server_ip", "server_port")
    return transactions.join(owner, S.SESSION)


def flow_log(packets: DataFrame, flow_packets: DataFrame, dns: DataFrame) -> DataFrame:
    """Log rows (kind, cause): packet errors, connections created and closed."""
    def rows(df, kind, cause, at, client, server):
        return df.select(F.lit(kind).alias("kind"), (F.lit(cause) if isinstance(cause, str) else cause).alias("cause"),
                         F.col(at).alias("at_us"), F.col(client).alias("client_ip"), F.col(server).alias("server_ip"))

    answers = tcp.tcp(flow_packets).filter(net.syn_ack())
    bad = F.when(F.col("start_isn").isNull(), "session").when(F.col("tcp_ack") != tcp.next_seq("start_isn"), "ack")
    handshakes = tcp.handshake(flow_packets)
    created = (F.when(F.col("opened") == "handshake", "normal").when(F.col("opened") == "midstream", "abort")
               .otherwise("failure"))
    closes = tcp.tcp_close(flow_packets).join(handshakes.select(*S.SESSION, "client_ip", "server_ip"), S.SESSION)
    error = "packet_error"
    return union([
        rows(packets.filter(net.syn_with_data()), error, "syn", "ts_us", "src_ip", "dst_ip"),
        rows(answers.withColumn("cause", bad).filter(F.col("cause").isNotNull()), error, F.col("cause"), "ts_us", "src_ip", "dst_ip"),
        rows(dns.filter(F.col("req_us").isNull()), error, "req", "rsp_us", "client_ip", "server_ip"),
        rows(dns.filter(F.col("req_pkts") > 1), error, "res", "req_us", "client_ip", "server_ip"),
        rows(handshakes.withColumn("at", F.coalesce("connected_us", "start_us")), "create", created, "at", "client_ip", "server_ip"),
        rows(closes.withColumn("at", F.coalesce("closed_us", "last_us")), "close", F.col("cause"), "at", "client_ip", "server_ip")])
