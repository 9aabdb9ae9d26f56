"""Decode frames into the packet table with built-in expressions.

Each layer's header is turned into text once (`_h2`, `_h3`, `_h4`,
hexadecimal) and its fields are cut from fixed places of it, so a filter on
one field stays a short expression when it is pushed towards the scan.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark import schema as S


def _number(head: str, offset: int, size: int) -> Column:
    """Big-endian unsigned number at a byte offset of a header."""
    return F.conv(F.substring(head, offset * 2 + 1, size * 2), 16, 10).cast("bigint")


def _if(cond: Column, value: Column, other=0) -> Column:
    return F.when(cond, value).otherwise(F.lit(other))


def _type_at(offset: int, code: int) -> Column:
    return F.substring("frame", offset + 1, 2) == F.lit(code.to_bytes(2, "big"))


def link_layer(frames: DataFrame) -> DataFrame:
    """MAC addresses, VLAN id, MPLS label, inner type and offset of the inner header."""
    vlan = _type_at(12, S.ETH_VLAN)
    mpls = F.when(vlan, _type_at(16, S.ETH_MPLS)).otherwise(_type_at(12, S.ETH_MPLS))
    inner = F.when(vlan, _number("_h2", 16, 2)).otherwise(_number("_h2", 12, 2))
    label = F.shiftright(F.when(vlan, _number("_h2", 18, 4)).otherwise(_number("_h2", 14, 4)), 12)
    return (frames.withColumns({"_h2": F.hex(F.substring("frame", 1, 22)), "cap_len": F.length("frame")})
            .withColumns({"dst_mac": _number("_h2", 0, 6), "src_mac": _number("_h2", 6, 6),
                          "vlan_id": _if(vlan, _number("_h2", 14, 2).bitwiseAND(F.lit(0x0FFF))).cast("int"),
                          "mpls_label": _if(mpls, label).cast("int"),
                          "eth_type": F.when(mpls, S.ETH_IPV4).otherwise(inner).cast("int"),
                          "l3_offset": F.lit(14) + F.when(vlan, 4).otherwise(0) + F.when(mpls, 4).otherwise(0)}))


def network_layer(rows: DataFrame) -> DataFrame:
    """IPv4 header.  Sizes are clamped to the header's total length."""
    at = F.col("l3_offset")
    ip = (F.col("eth_type") == S.ETH_IPV4) & (F.col("cap_len") >= at + 20)
    arp = (F.col("eth_type") == S.ETH_ARP) & F.col("_h3").startswith("000108000604")
    size = F.least(F.col("wire_len") - at, _number("_h3", 2, 2))
    ihl = _number("_h3", 0, 1).bitwiseAND(F.lit(15)) * 4
    return (rows.withColumn("_h3", F.hex(F.substr(F.col("frame"), at + 1, F.lit(28))))
            .withColumns({
                "ip_proto": _if(ip, _number("_h3", 9, 1)).cast("int"),
                "frag_offset": _if(ip, _number("_h3", 6, 2).bitwiseAND(F.lit(0x1FFF))).cast("int"),
                "src_ip": F.when(ip, _number("_h3", 12, 4)).when(arp, _number("_h3", 14, 4)).otherwise(0),
                "dst_ip": F.when(ip, _number("_h3", 16, 4)).when(arp, _number("_h3", 24, 4)).otherwise(0),
                "l3_len": _if(ip, size).cast("int"),
                "l4_len": _if(ip, F.greatest(size - ihl, F.lit(0))).cast("int"),
                "l4_offset": (at + _if(ip, ihl)).cast("int"),
                "arp_op": F.when(arp, _number("_h3", 6, 2)).cast("int"),
                "arp_sender_mac": F.when(arp, _number("_h3", 8, 6)), "arp_target_mac": F.when(arp, _number("_h3", 18, 6))}))


def transport_layer(rows: DataFrame) -> DataFrame:
    """TCP, UDP and ICMP headers and the payload behind them."""
    at = F.col("l4_offset")
    proto = F.when(F.col("frag_offset") == 0, F.col("ip_proto")).otherwise(0)
    tcp, udp, icmp = (proto == p for p in (S.PROTO_TCP, S.PROTO_UDP, S.PROTO_ICMP))
    ports = tcp | udp
    head = (F.when(tcp, F.shiftright(_number("_h4", 12, 1), 4) * 4).when(udp | icmp, F.lit(8)).otherwise(0)).cast("int")
    echo = icmp & _number("_h4", 0, 1).isin(0, 8)
    size = (F.when(proto != 0, F.greatest(F.col("l4_len") - head, F.lit(0))).when(F.col("ip_proto") != 0, F.col("l4_len"))
            .otherwise(F.col("wire_len") - F.col("l3_offset"))).cast("int")
    urgent = tcp & (_number("_h4", 13, 1).bitwiseAND(F.lit(S.URG)) != 0)
    return (rows.withColumn("_h4", F.hex(F.substr(F.col("frame"), at + 1, F.lit(20))))
            .withColumns({
                "src_port": _if(ports, _number("_h4", 0, 2)).cast("int"), "dst_port": _if(ports, _number("_h4", 2, 2)).cast("int"),
                "tcp_seq": _if(tcp, _number("_h4", 4, 4)), "tcp_ack": _if(tcp, _number("_h4", 8, 4)),
                "tcp_flags": _if(tcp, _number("_h4", 13, 1)).cast("int"), "tcp_window": _if(tcp, _number("_h4", 14, 2)).cast("int"),
                "tcp_urgent": _if(urgent, _number("_h4", 18, 2)).cast("int"),
                "icmp_type": F.when(icmp, _number("_h4", 0, 1)).cast("int"), "icmp_code": F.when(icmp, _number("_h4", 1, 1)).cast("int"),
                "icmp_id": F.when(echo, _number("_h4", 4, 2)), "icmp_seq": F.when(echo, _number("_h4", 6, 2)).cast("int"),
                "payload_len": size,
                "payload": F.when(proto != 0, F.substr(F.col("frame"), at + head + 1, size)),
                "tcp_options": F.when(tcp & (head > 20), F.substr(F.col("frame"), at + 21, head - 20))}))


def decode(frames: DataFrame) -> DataFrame:
    """Frames (packet_id, ts_us, wire_len, frame) as the packet table."""
    rows = transport_layer(network_layer(link_layer(frames)))
    return rows.select(*S.PACKETS.names, "tcp_options", "arp_sender_mac", "arp_target_mac", "l4_offset", "frame")


def decode_arp(packets: DataFrame) -> DataFrame:
    """Ethernet/IPv4 ARP: opcode, sender and target."""
    return (packets.filter(F.col("arp_op").isNotNull())
            .select("packet_id", "ts_us", F.col("arp_op").alias("opcode"), F.col("arp_sender_mac").alias("sender_mac"),
                    F.col("src_ip").alias("sender_ip"), F.col("arp_target_mac").alias("target_mac"), F.col("dst_ip").alias("target_ip")))


def icmp_unreachable(packets: DataFrame) -> DataFrame:
    """Unreachable messages with the end points of the packet they quote."""
    ihl = _number("_h3", 0, 1).bitwiseAND(F.lit(15)) * 4
    proto = _number("_h3", 9, 1).cast("int")
    ports = proto.isin(S.PROTO_TCP, S.PROTO_UDP, S.PROTO_SCTP)
    inner = packets.filter(F.col("icmp_type") == 3).withColumn("_h3", F.hex(F.substring("payload", 1, 20)))
    inner = inner.withColumn("_h4", F.hex(F.substr(F.col("payload"), (ihl + 1).cast("int"), F.lit(4))))
    return inner.select("packet_id", "ts_us", F.col("icmp_code").alias("code"), proto.alias("proto"),
                        _number("_h3", 12, 4).alias("client_ip"), _if(ports, _number("_h4", 0, 2)).cast("int").alias("client_port"),
                        _number("_h3", 16, 4).alias("server_ip"), _if(ports, _number("_h4", 2, 2)).cast("int").alias("server_port"))


OPTIONS = "mss INT, shift INT, stamp BIGINT, sack_ok BOOLEAN, sacks ARRAY<STRUCT<left: BIGINT, right: BIGINT>>"


def _options(data: bytes) -> dict:
    """Walk the kind/length/value list; an unknown kind ends it."""
    out = {"mss": None, "shift": None, "stamp": None, "sack_ok": False, "sacks": []}
    i = 0
    while i < len(data):
        kind = data[i]
        if kind in (0, 1):
            i += 1
            continue
        size = data[i + 1] if i + 1 < len(data) else 0
        if kind not in (2, 3, 4, 5, 8) or size < 2 or i + size > len(data):
            break
        value = data[i + 2:i + size]
        if kind == 2:
            out["mss"] = int.from_bytes(value[:2], "big")
        elif kind == 3:
            out["shift"] = value[0] & 15
        elif kind == 4:
            out["sack_ok"] = True
        elif kind == 5:
            edges = [int.from_bytes(value[j:j + 4], "big") for j in range(0, len(value) // 8 * 8, 4)]
            out["sacks"] = [{"left": a, "right": b} for a, b in zip(edges[::2], edges[1::2])][:4]
        else:
            out["stamp"] = int.from_bytes(value[:4], "big")
        i += size
    return out


def tcp_options(packets: DataFrame) -> DataFrame:
    """MSS, window scale, SACK blocks and time stamp of the TCP packets that carry options.

    The packets without options are left out behind the decoding: a filter
    would be pushed into it, and decode the headers again for each field that
    its condition rests on.
    """
    kept = ["packet_id", "tcp_window", "tcp_flags"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"mss": pa.int32(), "shift": pa.int32(), "stamp": pa.int64(), "sack_ok": pa.bool_(),
                 "sacks": pa.list_(pa.struct([("left", pa.int64()), ("right", pa.int64())]))}
        for batch in batches:
            batch = batch.filter(batch["tcp_options"].is_valid())
            if batch.num_rows:
                parsed = [_options(data) for data in batch["tcp_options"].to_pylist()]
                found = [pa.array([p[name] for p in parsed], kind) for name, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *found], names=[*kept, *kinds])

    types = dict(packets.select(*kept).dtypes)
    return (packets.select(*kept, "tcp_options").mapInArrow(parse, ", ".join([*(f"{c} {types[c]}" for c in kept), OPTIONS]))
            .withColumn("window", F.when(F.col("tcp_flags").bitwiseAND(F.lit(S.SYN | S.RST | S.FIN)) != 0, -1)
                        .otherwise(F.col("tcp_window") * F.pow(F.lit(2), F.coalesce("shift", F.lit(0))).cast("int")))
            .drop("tcp_flags", "tcp_window"))
