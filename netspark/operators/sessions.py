"""Session borders that depend on the session's own state.

A TCP session lives `opening` seconds behind its SYN and once more behind the
SYN-ACK that answers it, `active` seconds behind each packet while it is
established, and `closing` seconds behind its first FIN or RST, whatever comes
then.  So a packet may start a session though one came just before it, and
whether it does hangs on where the session before it began.

Each packet is seen as a possible start: what becomes of a session begun there,
and so the packet that ends it, follows from the packets behind it alone.  That
makes one pointer per packet, and the starts are what the pointers reach from
the packets that start a session in any case (the first one, a new SYN, one
behind a silence that no session outlives).  Pointers are needed from those
and from packets behind a deadline only, which are few; they are followed by
doubling, so a chain of n sessions takes log n rounds.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark import schema as S
from netspark.functions import net
from netspark.operators.prefix import Prior, time_slice, with_priors
from netspark.session import cut

ARRIVAL = ["ts_us", "packet_id"]
BEHIND_ALL = 2**63 - 1


@dataclass(frozen=True)
class Timeouts:
    """Seconds that a session outlives silence.  Opening and closing must not exceed the active time."""
    opening_s: int = S.TCP_OPENING_S
    closing_s: int = S.TCP_CLOSING_S
    tcp_s: int = S.TCP_ACTIVE_S
    udp_s: int = S.UDP_ACTIVE_S
    icmp_s: int = S.ICMP_ACTIVE_S

    def __post_init__(self):
        if max(self.opening_s, self.closing_s) > self.tcp_s:
            raise ValueError("opening and closing times must not be longer than the active time")

    def longest_us(self) -> Column:
        """The time that no session of a packet's protocol outlives."""
        return (F.when(F.col("ip_proto") == S.PROTO_TCP, self.tcp_s).when(F.col("ip_proto") == S.PROTO_UDP, self.udp_s)
                .otherwise(self.icmp_s) * S.US).cast("bigint")


def new_syn(isn: Column, before: Column) -> Column:
    """A pure SYN that does not repeat the flow's last one."""
    return isn.isNotNull() & (before.isNull() | (before != isn))


def flow_profile(rows: DataFrame, timeouts: Timeouts, busy_rows: int | None) -> DataFrame:
    """Flows that one pass by usual slices does not settle: of more than `busy_rows` packets (_n), or `lasting`: TCP
    longer than the shortest timeout.  Both come from one reading of the packets."""
    shortest = min(timeouts.opening_s, timeouts.closing_s) * S.US
    lasting = (F.col("ip_proto") == S.PROTO_TCP) & (F.col("_span") > shortest)
    busy = F.col("_n") > busy_rows if busy_rows else F.lit(False)
    flows = rows.groupBy(*S.FLOW_KEY).agg(F.count(F.lit(1)).alias("_n"), (F.max("ts_us") - F.min("ts_us")).alias("_span"))
    return cut(flows.select(*S.FLOW_KEY, "_n", lasting.alias("lasting")).filter(busy | F.col("lasting")))


def _line(rows: DataFrame, lasting: DataFrame, timeouts: Timeouts) -> DataFrame:
    """TCP packets of the lasting flows, with what they are to a session.

    kind: "syn", "answer" (SYN-ACK), "end" (FIN or RST) or "plain".
    """
    tcp = rows.filter(F.col("ip_proto") == S.PROTO_TCP).select(*S.FLOW_KEY, *ARRIVAL, "tcp_flags", "tcp_seq", "tcp_ack", "slice_us")
    tcp = tcp.join(lasting, S.FLOW_KEY, "left_semi").withColumn("_isn", F.when(net.pure_syn(), F.col("tcp_seq")))
    tcp = with_priors(tcp, S.FLOW_KEY, ARRIVAL, time_slice(tcp), [Prior("_prev_ts", "lag", F.col("ts_us")), Prior("_prev_isn", "last", F.col("_isn"))])
    kind = (F.when(net.pure_syn(), "syn").when(net.has_flag(S.SYN), "answer").when(net.has_flag(S.FIN | S.RST), "end").otherwise("plain"))
    hard = (F.col("_prev_ts").isNull() | (F.col("ts_us") - F.col("_prev_ts") > timeouts.tcp_s * S.US) | new_syn(F.col("_isn"), F.col("_prev_isn")))
    answers = F.coalesce(F.col("tcp_ack") == F.pmod(F.col("_prev_isn") + 1, F.lit(S.UINT32)), F.lit(False))
    return cut(tcp.select(*S.FLOW_KEY, *ARRIVAL, "slice_us", kind.alias("kind"), hard.alias("hard"), answers.alias("answers")))


def _ahead(line: DataFrame, timeouts: Timeouts) -> DataFrame:
    """Hard starts, and probes at the deadlines that SYN, SYN-ACK and end packets set, each with what follows it.

    One pass in falling order over packets and probes: the next packet, and the
    next end, plain (or end) packet, answer and hard start.
    """
    at = F.struct(*ARRIVAL)
    sets = F.col("kind").isin("syn", "answer", "end")
    lives = F.when(F.col("kind") == "end", timeouts.closing_s).otherwise(timeouts.opening_s).cast("bigint") * S.US
    none = F.lit(None)
    probes = line.filter(sets).select(*S.FLOW_KEY, (F.col("ts_us") + lives).alias("ts_us"), F.lit(BEHIND_ALL).alias("packet_id"), "slice_us",
                                      none.cast("string").alias("kind"), F.lit(False).alias("hard"), F.lit(False).alias("answers"), at.alias("mark"))
    rows = line.withColumn("mark", none.cast(probes.schema["mark"].dataType)).unionByName(probes)
    kind = F.col("kind")
    follows = [Prior("next", "last", F.when(kind.isNotNull(), F.struct(*ARRIVAL, "kind", "hard"))),
               Prior("next_end", "last", F.when(kind == "end", at)),
               Prior("next_plain", "last", F.when(kind.isin("plain", "end"), at)),
               Prior("next_answer", "last", F.when((kind == "answer") & F.col("answers"), at)),
               Prior("next_hard", "last", F.when(F.col("hard"), at))]
    rows = with_priors(rows, S.FLOW_KEY, ARRIVAL, time_slice(rows), follows, descending=True)
    return cut(rows.filter(F.col("hard") | F.col("mark").isNotNull()).drop("answers", "slice_us"))


def _pointers(ahead: DataFrame, timeouts: Timeouts) -> DataFrame:
    """Rows (flow, a, b, a_hard): a session begun at packet a ends at packet b, which is no hard start.

    What follows the packet behind a probe is what follows the probe, but for
    that packet itself, so probes tell about their packets without a lookup.
    """
    at = F.struct(*ARRIVAL)
    seen = ["next_end", "next_plain", "next_answer", "next_hard"]
    hard = ahead.filter("hard").select(*S.FLOW_KEY, at.alias("a"), "kind", F.lit(True).alias("a_hard"),
                                       F.when(F.col("kind") == "end", at).otherwise(F.col("next_end")).alias("next_end"), *seen[1:])
    soft = ahead.filter("mark IS NOT NULL AND NOT next.hard").select(
        *S.FLOW_KEY, F.struct("next.ts_us", "next.packet_id").alias("a"), F.col("next.kind").alias("kind"), F.lit(False).alias("a_hard"), *seen)
    nodes = hard.unionByName(soft.dropDuplicates([*S.FLOW_KEY, "a"]))
    opening = timeouts.opening_s * S.US
    answered = (F.col("kind") == "syn") & (F.col("next_answer.ts_us") <= F.col("a.ts_us") + opening) & F.coalesce(F.col("next_answer") < F.col("next_plain"), F.lit(True))
    last = F.when(F.coalesce(answered, F.lit(False)), F.col("next_answer")).otherwise(F.col("a"))
    established = F.col("kind").isin("plain", "end") | F.coalesce(F.col("next_plain.ts_us") <= last["ts_us"] + opening, F.lit(False))
    nodes = nodes.select(*S.FLOW_KEY, "a", "a_hard", "next_hard", F.when(established, F.col("next_end")).otherwise(last).alias("mark"))
    behind = ahead.filter("mark IS NOT NULL AND next IS NOT NULL").select(*S.FLOW_KEY, "mark", F.struct("next.ts_us", "next.packet_id").alias("b"))
    ends = nodes.join(behind, [*S.FLOW_KEY, "mark"]).filter(F.col("next_hard").isNull() | (F.col("b") < F.col("next_hard")))
    return ends.select(*S.FLOW_KEY, "a", "b", "a_hard")


def soft_starts(rows: DataFrame, profile: DataFrame, timeouts: Timeouts) -> DataFrame | None:
    """(flow, ts_us, packet_id) of packets that start a session because the state of the one before let it end; None where there is none."""
    lasting = profile.filter("lasting").select(*S.FLOW_KEY)
    if lasting.isEmpty():
        return None
    edges = cut(_pointers(_ahead(_line(rows, lasting, timeouts), timeouts), timeouts))
    reached = edges.filter("a_hard").select(*S.FLOW_KEY, F.col("a").alias("at"), F.lit(False).alias("soft"))
    while not edges.isEmpty():
        here = reached.select(*S.FLOW_KEY, F.col("at").alias("a")).distinct()
        step = edges.join(here, [*S.FLOW_KEY, "a"], "left_semi").select(*S.FLOW_KEY, F.col("b").alias("at"), F.lit(True).alias("soft"))
        reached = cut(reached.unionByName(step).distinct())
        onward = edges.select(*S.FLOW_KEY, F.col("a").alias("b"), F.col("b").alias("c"))
        edges = cut(edges.join(onward, [*S.FLOW_KEY, "b"]).select(*S.FLOW_KEY, "a", F.col("c").alias("b")))
    return reached.filter("soft").select(*S.FLOW_KEY, "at.ts_us", "at.packet_id")
