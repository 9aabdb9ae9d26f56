"""Flows: assign packets to sessions and sum them up."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netspark import schema as S
from netspark.functions import net
from netspark.operators import nodes
from netspark.operators.prefix import by_width, time_slice, with_slice_width
from netspark.operators.sessions import Timeouts, flow_profile, new_syn, soft_starts

ARRIVAL = ["ts_us", "packet_id"]


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Packets that belong to flows, with the direction-free flow key.

    Non-first fragments and SYN packets carrying data take no part in flows.
    """
    tracked = packets.filter(net.is_ipv4() & (F.col("frag_offset") == 0) & ~net.syn_with_data())
    return tracked.select("*", *net.flow_key_columns())


def packets_with_flow(packets: DataFrame, slice_us: int = S.SLICE_US, busy_rows: int | None = S.SLICE_ROWS,
                      timeouts: Timeouts = Timeouts()) -> DataFrame:
    """Attach session_no, the first packet's data and the direction to each packet.

    A session starts at the first packet of a flow key, after a silence longer
    than the protocol's timeout, at a pure SYN whose sequence number is not
    that of the last pure SYN, and where the state of the session before lets
    it end sooner (`sessions.soft_starts`).  The latter are known beforehand;
    the others are found slice by slice: inside a slice every row is decided
    except the first row and the first SYN, which need the last time and last
    SYN number of earlier slices.  Flows of more than `busy_rows` packets get
    narrower slices, others are one slice unless `slice_us` asks for narrow
    ones; the width stays in `slice_us` for the jobs that follow.
    """
    first = F.col("_prev_ts").isNull()
    first_syn = F.col("_isn").isNotNull() & F.col("_prev_isn").isNull()
    gap = (F.col("ts_us") - F.col("_prev_ts") > F.col("_timeout")) | F.col("_soft")
    src, dst = net.flow_ends()
    row = F.struct("ts_us", "packet_id", src.alias("src"), dst.alias("dst"),
                   "src_mac", "dst_mac", F.col("_isn").alias("isn"))

    local = Window.partitionBy(*S.FLOW_KEY, "_slice").orderBy(*ARRIVAL)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)

    is_syn = (F.col("ip_proto") == S.PROTO_TCP) & net.pure_syn()
    keyed = with_flow_key(packets)
    profile = flow_profile(keyed, timeouts, busy_rows)
    keyed = (with_slice_width(keyed, S.FLOW_KEY, rows=busy_rows, width_us=slice_us, counts=profile, whole=slice_us >= S.SLICE_US) if busy_rows
             else keyed.withColumn("slice_us", F.lit(slice_us).cast("bigint")))
    soft = soft_starts(keyed, profile, timeouts)
    keyed = (keyed.withColumn("_soft", F.lit(False)) if soft is None else
             keyed.join(soft.withColumn("_soft", F.lit(True)), [*S.FLOW_KEY, *ARRIVAL], "left").withColumn("_soft", F.coalesce("_soft", F.lit(False))))
    keyed = keyed.withColumns({"_timeout": timeouts.longest_us(), "_isn": F.when(is_syn, F.col("tcp_seq"))})
    keyed, whole = by_width(keyed, S.FLOW_KEY, time_slice(keyed))
    rows = (keyed
            .withColumn("_slice", time_slice(keyed))
            .withColumns({"_prev_ts": F.lag("ts_us").over(local),
                          "_prev_isn": F.last("_isn", ignorenulls=True).over(before)})
            .withColumns({
                "_first": first,
                "_open_syn": ~first & ~F.coalesce(gap, F.lit(False)) & first_syn,
                "_start": ~first & (F.coalesce(gap, F.lit(False))
                                    | F.coalesce(F.col("_isn") != F.col("_prev_isn"), F.lit(False)))})
            .withColumns({"_n": F.sum(F.col("_start").cast("bigint")).over(upto),
                          "_after_syn": F.max("_open_syn").over(upto),
                          "_row": row})
            .withColumn("_last_start", F.last(F.when(F.col("_start"), F.col("_row")), ignorenulls=True).over(upto)))

    slices = rows.groupBy(*S.FLOW_KEY, "_slice").agg(
        F.min("ts_us").alias("min_ts"), F.max("ts_us").alias("max_ts"), F.max("_timeout").alias("timeout"),
        F.max("_n").alias("n"), F.max("_last_start").alias("last_start"),
        F.max(F.when(F.col("_first"), F.col("_row"))).alias("_first_row"),
        F.max(F.when(F.col("_first"), F.col("_isn"))).alias("first_isn"), F.max(F.col("_first") & F.col("_soft")).alias("first_soft"),
        F.max(F.when(F.col("_open_syn"), F.col("_row"))).alias("_syn_row"),
        F.max(F.when(F.col("_open_syn"), F.col("_isn"))).alias("syn_isn"),
        F.max_by("_isn", F.when(F.col("_isn").isNotNull(), F.struct(*ARRIVAL))).alias("last_isn"))
    earlier = (Window.partitionBy(*S.FLOW_KEY).orderBy("_slice")
               .rowsBetween(Window.unboundedPreceding, -1))

    def new_isn(isn):
        return F.col(isn).isNotNull() & (F.col("carry_isn").isNull() | (F.col("carry_isn") != F.col(isn)))

    slices = (slices
              .withColumns({"carry_ts": F.max("max_ts").over(earlier),
                            "carry_isn": F.last("last_isn", ignorenulls=True).over(earlier)})
              .withColumns({"_first_starts": F.col("carry_ts").isNull() | new_isn("first_isn") | F.col("first_soft")
                            | (F.col("min_ts") - F.col("carry_ts") > F.col("timeout")),
                            "_syn_starts": new_isn("syn_isn")})
              .withColumns({"_starts": F.col("n") + F.col("_first_starts").cast("bigint")
                            + F.col("_syn_starts").cast("bigint"),
                            "_latest": F.greatest("last_start", F.when(F.col("_syn_starts"), F.col("_syn_row")),
                                                  F.when(F.col("_first_starts"), F.col("_first_row")))})
              .select(*S.FLOW_KEY, "_slice", "_first_starts", "_syn_starts", "_first_row", "_syn_row",
                      F.coalesce(F.sum("_starts").over(earlier), F.lit(0)).alias("_base"),
                      F.last("_latest", ignorenulls=True).over(earlier).alias("_carry")))

    after_syn = F.col("_after_syn") & F.col("_syn_starts")
    start = F.coalesce(F.greatest("_last_start", F.when(after_syn, F.col("_syn_row")),
                                  F.when(F.col("_first_starts"), F.col("_first_row"))), F.col("_carry"))
    number = F.col("_base") + F.col("_n") + F.col("_first_starts").cast("bigint") + after_syn.cast("bigint")
    kept = [*dict.fromkeys([*packets.columns, *S.FLOW_KEY]), "slice_us", "_row", "_at", "session_no"]
    divided = rows.join(slices, [*S.FLOW_KEY, "_slice"]).withColumns({"_at": start, "session_no": number}).select(*kept)

    line = Window.partitionBy(*S.FLOW_KEY).orderBy(*ARRIVAL)
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    whole = (whole
             .withColumns({"_prev_ts": F.lag("ts_us").over(line), "_prev_isn": F.last("_isn", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))})
             .withColumns({"_row": row, "_start": first | F.coalesce(gap, F.lit(False)) | new_syn(F.col("_isn"), F.col("_prev_isn"))})
             .withColumns({"session_no": F.sum(F.col("_start").cast("bigint")).over(upto),
                           "_at": F.last(F.when(F.col("_start"), F.col("_row")), ignorenulls=True).over(upto)})
             .select(*kept))
    return (divided.unionByName(whole)
            .select(*packets.columns, *S.FLOW_KEY[:-1], "session_no",
                    F.col("_at.ts_us").alias("start_us"), F.col("_at.packet_id").alias("start_packet"),
                    F.when(F.col("_at.src") == F.col("_row.src"), 1).otherwise(-1).alias("dir"),
                    F.col("_at.src.ip").alias("client_ip"), F.col("_at.src.port").alias("client_port"),
                    F.col("_at.dst.ip").alias("server_ip"), F.col("_at.dst.port").alias("server_port"),
                    F.col("_at.src_mac").alias("client_mac"), F.col("_at.dst_mac").alias("server_mac"),
                    F.col("_at.isn").alias("start_isn"), "slice_us"))


def flow_id():
    """A label for display.  Joins use the full session key, as a 64-bit label can repeat."""
    return F.xxhash64(*S.FLOW_KEY, "start_us", "start_packet").alias("flow_id")


def flow_direction(flow_packets: DataFrame) -> DataFrame:
    """+1 for packets sent by the side that sent the flow's first packet, -1 for the other side."""
    return flow_packets.select("packet_id", "dir")


def flow_summary(flow_packets: DataFrame) -> DataFrame:
    """One row per session: times, traffic each way, aborts and whether it ended by timeout."""
    rst = (F.col("ip_proto") == S.PROTO_TCP) & net.has_flag(S.RST)
    ends = (F.col("ip_proto") == S.PROTO_TCP) & net.has_flag(S.FIN | S.RST)
    aggs = [F.min("start_us").alias("start_us"), F.max("ts_us").alias("last_us")]
    for side, direction in (("client", 1), ("server", -1)):
        mine = F.col("dir") == direction
        aggs += [nodes.total_if(mine).alias(f"{side}_pkts"), nodes.total_if(mine, "payload_len").alias(f"{side}_bytes"),
                 nodes.total_if(mine, "wire_len").alias(f"{side}_l2_bytes"),
                 nodes.total_if(mine & rst).alias(f"{side}_aborts"),
                 F.max(F.when(mine & ends, 1).otherwise(0)).alias(f"_{side}_ended")]
    closed = (F.col("_client_ended") == 1) & (F.col("_server_ended") == 1)
    return (flow_packets.groupBy(*S.SESSION, "client_ip", "client_port", "server_ip", "server_port")
            .agg(*aggs)
            .withColumns({"age_ms": net.to_ms(F.col("last_us") - F.col("start_us")), "expired": ~closed})
            .drop("_client_ended", "_server_ended"))


def flow_ticks(summary: DataFrame, cycle_us: int = S.TICK_S * S.US) -> DataFrame:
    """Open record at the first packet, a tick per cycle since then, close record at the end."""
    step = F.lit(cycle_us).cast("bigint")
    ticks = F.col("last_us") - F.col("start_us") >= step
    marks = F.array(F.struct(F.lit("open").alias("way"), F.col("start_us").alias("at_us")),
                    F.struct(F.lit("close").alias("way"), F.col("last_us").alias("at_us")))
    tick_rows = F.transform(
        F.when(ticks, F.sequence(F.col("start_us") + step, F.col("last_us"), step)).otherwise(F.array().cast("array<bigint>")),
        lambda t: F.struct(F.lit("tick").alias("way"), t.alias("at_us")))
    return (summary.withColumn("_m", F.explode(F.concat(marks, tick_rows)))
            .select(*S.SESSION, "_m.way", "_m.at_us"))


# Ports that name an application.
APP_PORTS = {"dns": (S.PROTO_UDP, 53), "http": (S.PROTO_TCP, 80), "mysql": (S.PROTO_TCP, 3306)}


def app_of_port():
    """Application by well-known port, else the transport's name."""
    out = F
    for app, (proto, port) in APP_PORTS.items():
        out = out.when((F.col("ip_proto") == proto) & ((F.col("src_port") == port) | (F.col("dst_port") == port)), app)
    return (out.when(F.col("ip_proto") == S.PROTO_TCP, "tcp").when(F.col("ip_proto") == S.PROTO_UDP, "udp")
            .when(F.col("ip_proto") == S.PROTO_ICMP, "icmp").otherwise("other"))


def export_filter(rows: DataFrame, selected: list[str]) -> DataFrame:
    """Keep only the selected protocols or applications; "all" keeps every row."""
    return rows if "all" in selected else rows.filter(F.col("app").isin(selected))


def flow_protocol(flow_packets: DataFrame, rule_app: DataFrame | None = None) -> DataFrame:
    """Application of each session, from its bytes and ports.

    UDP port 53 is DNS, a first payload that is a server greeting is MySQL, a
    segment that starts with a request line is HTTP.  `rule_app` (session key,
    rule_app) overrides what was detected.
    """
    data = F.when((F.col("payload_len") > 0) & (F.col("ip_proto") == S.PROTO_TCP), F.substring("payload", 1, 16))
    greeting = F.col("_first.head")
    length = F.conv(F.concat(*[F.substring(F.hex(greeting), i, 2) for i in (5, 3, 1)]), 16, 10).cast("bigint")
    is_greeting = (F.substring(greeting, 4, 2).isin(bytes([0, 9]), bytes([0, 10])) & (length + 4 <= F.col("_first.payload_len")))
    request = F.decode(data, "ISO-8859-1").rlike("^(GET|POST|PUT|SEARCH|CONNECT|HEAD) ")
    detected = (F.when(F.coalesce(is_greeting, F.lit(False)), "mysql").when(F.col("_http"), "http")
                .when(F.col("_dns"), "dns").otherwise("unknown"))
    rows = flow_packets.groupBy(*S.SESSION).agg(
        F.min(F.when(data.isNotNull(), F.struct(*ARRIVAL, data.alias("head"), "payload_len"))).alias("_first"),
        F.max(F.coalesce(request, F.lit(False))).alias("_http"), F.max(app_of_port() == "dns").alias("_dns"))
    rows = rows.select(*S.SESSION, detected.alias("app"))
    if rule_app is None:
        return rows
    return rows.join(rule_app, S.SESSION, "left").withColumn("app", F.coalesce("rule_app", "app")).drop("rule_app")
