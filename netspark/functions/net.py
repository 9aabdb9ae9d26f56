"""Column expressions over packet fields.  All are built-in expressions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from netspark import schema as S

# Upper bound of each packet-size rank.
SIZE_RANKS = [64, 128, 256, 512, 1024, 1514, 1518]
FLAG_BITS = {"fin": S.FIN, "syn": S.SYN, "rst": S.RST, "psh": S.PSH,
             "ack": S.ACK, "urg": S.URG, "ecn": S.ECN, "cwr": S.CWR}


def col(c):
    return F.col(c) if isinstance(c, str) else c


def mac_class(mac) -> Column:
    """stp / bcast / mcast / ucast for one address."""
    mac = col(mac)
    group_bit = F.shiftright(mac, 40).bitwiseAND(F.lit(1))
    return (F.when(mac == S.MAC_STP, "stp")
            .when(mac == S.MAC_BROADCAST, "bcast")
            .when(group_bit == 1, "mcast")
            .otherwise("ucast"))


def cast_class(dst="dst_mac", src="src_mac") -> Column:
    """Class of a frame: by destination, else by source."""
    return F.when(mac_class(dst) != "ucast", mac_class(dst)).otherwise(mac_class(src))


def l2_type(eth_type="eth_type", vlan="vlan_id", mpls="mpls_label") -> Column:
    """Outermost type of the frame."""
    names = {S.ETH_IPV4: "ipv4", S.ETH_ARP: "arp", S.ETH_VLAN: "vlan", S.ETH_MPLS: "mpls",
             S.ETH_LACP: "lacp", S.ETH_IPV6: "ipv6"}
    out = F.when(col(vlan) > 0, "vlan").when(col(mpls) > 0, "mpls")
    for code, name in names.items():
        out = out.when(col(eth_type) == code, name)
    return out.otherwise("other")


def l3_type(proto="ip_proto") -> Column:
    proto = col(proto)
    return (F.when(proto == S.PROTO_ICMP, "icmp").when(proto == S.PROTO_TCP, "tcp")
            .when(proto == S.PROTO_UDP, "udp").otherwise("other"))


def is_ipv4(df_proto="ip_proto") -> Column:
    return col(df_proto) != 0


def local_ip(ip) -> Column:
    """Private address: 10/8, 172.16/12 or 192.168/16."""
    ip = col(ip)
    return (F.shiftright(ip, 24) == 10) | (F.shiftright(ip, 20) == 0xAC1) | (F.shiftright(ip, 16) == 0xC0A8)


def node_ip(ip) -> Column:
    """Address part of a node key: every external address is one node, 0."""
    return F.when(local_ip(ip), col(ip)).otherwise(F.lit(0).cast("bigint"))


def has_flag(bits, flags="tcp_flags") -> Column:
    return col(flags).bitwiseAND(F.lit(bits)) != 0


def pure_syn(flags="tcp_flags") -> Column:
    return has_flag(S.SYN, flags) & ~has_flag(S.ACK, flags)


def syn_ack(flags="tcp_flags") -> Column:
    return has_flag(S.SYN, flags) & has_flag(S.ACK, flags)


def syn_with_data() -> Column:
    return (F.col("ip_proto") == S.PROTO_TCP) & has_flag(S.SYN) & (F.col("payload_len") > 0)


def size_bucket(length="wire_len") -> Column:
    first, *rest = SIZE_RANKS
    out = F.when(col(length) <= first, str(first))
    return reduce(lambda w, n: w.when(col(length) <= n, str(n)), rest, out).otherwise("jumbo")


def window_us(seconds=S.PERIOD_S, ts="ts_us") -> Column:
    """Start of the epoch-aligned period, in microseconds."""
    return col(ts) - F.pmod(col(ts), F.lit(seconds * S.US))


def safe_mean(total, count) -> Column:
    """Integer quotient, 0 when nothing was counted."""
    total, count = col(total), col(count)
    return F.coalesce(F.floor(total / F.nullif(count, F.lit(0))), F.lit(0)).cast("bigint")


def seq_diff(base, value) -> Column:
    """Signed distance from base to value on the 32-bit circle."""
    half = S.UINT32 // 2
    return F.pmod(col(value) - col(base) + half, F.lit(S.UINT32)) - half


def mac_text(mac) -> Column:
    digits = F.lower(F.lpad(F.hex(col(mac)), 12, "0"))
    return F.regexp_replace(digits, "(..)(?=.)", "$1:")


def ip_text(ip) -> Column:
    ip = col(ip)
    return F.concat_ws(".", *[F.shiftright(ip, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def to_ms(us) -> Column:
    return F.floor(col(us) / 1000).cast("bigint")


def to_s(us) -> Column:
    return F.floor(col(us) / S.US).cast("bigint")


def as_timestamp(us="ts_us") -> Column:
    return F.timestamp_micros(col(us))


def endpoint(ip: str, icmp_first: str, port: str) -> Column:
    """(ip, port) of one end; echo messages use their id and sequence as ports."""
    is_echo = (F.col("ip_proto") == S.PROTO_ICMP) & F.col("icmp_id").isNotNull()
    number = F.when(is_echo, F.when(F.col("icmp_type") == 8, F.col(icmp_first))
                    .otherwise(F.col("icmp_id" if icmp_first == "icmp_seq" else "icmp_seq"))).otherwise(F.col(port))
    return F.struct(F.col(ip).alias("ip"), number.cast("bigint").alias("port"))


def flow_ends() -> tuple[Column, Column]:
    return endpoint("src_ip", "icmp_seq", "src_port"), endpoint("dst_ip", "icmp_id", "dst_port")


def flow_key_columns() -> list[Column]:
    """Unordered pair of (ip, port); both directions agree.

    The lower end comes first, null below all numbers.  Ends are compared as
    plain numbers, which stays in generated code; structs would not.
    """
    src, dst = flow_ends()
    number = lambda end, field: F.coalesce(end[field], F.lit(-1))
    same_ip = number(src, "ip") == number(dst, "ip")
    swap = (number(src, "ip") > number(dst, "ip")) | (same_ip & (number(src, "port") > number(dst, "port")))
    pick = lambda a, b, field, name: F.when(swap, a[field]).otherwise(b[field]).alias(name)
    return [pick(dst, src, "ip", "ip_a"), pick(dst, src, "port", "port_a"), pick(src, dst, "ip", "ip_b"), pick(src, dst, "port", "port_b")]


def dimension(metric: str, dim: str, value) -> Column:
    """Name of a metric split by a dimension: metric|dim|value."""
    return F.concat(F.lit(f"{metric}|{dim}|"), col(value).cast("string"))
