"""Column layout of the packet table and the constants every job shares."""

from pyspark.sql import types as T

# Link, network and transport codes.
ETH_IPV4, ETH_ARP, ETH_VLAN, ETH_IPV6, ETH_MPLS, ETH_LACP = 0x0800, 0x0806, 0x8100, 0x86DD, 0x8847, 0x8809
PROTO_ICMP, PROTO_TCP, PROTO_UDP, PROTO_SCTP = 1, 6, 17, 132
FIN, SYN, RST, PSH, ACK, URG, ECN, CWR = 1, 2, 4, 8, 16, 32, 64, 128
MAC_BROADCAST, MAC_STP = 0xFFFFFFFFFFFF, 0x0180C2000000

# Periods and timeouts in seconds.
PERIOD_S, TICK_S = 30, 10
TCP_OPENING_S, TCP_CLOSING_S, TCP_ACTIVE_S = 5, 5, 600
UDP_ACTIVE_S, ICMP_ACTIVE_S = 600, 5
DNS_OPEN_S, DNS_DONE_S = 5, 2
ACK_QUEUE = 128

US = 1_000_000
UINT32 = 1 << 32

# Width of the time slices that ordered jobs split a flow into, so that one
# busy flow spreads over as many tasks as it has slices.
SLICE_US = 60 * US
# A key with more rows than this gets slices narrow enough for about as many rows.
SLICE_ROWS = 2_000_000
# The width of a key with fewer rows: all of them are one slice.
WHOLE = 1 << 62

PACKETS = T.StructType([
    T.StructField("packet_id", T.LongType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("cap_len", T.IntegerType()),
    T.StructField("wire_len", T.IntegerType()),
    T.StructField("src_mac", T.LongType()),
    T.StructField("dst_mac", T.LongType()),
    T.StructField("eth_type", T.IntegerType()),
    T.StructField("vlan_id", T.IntegerType()),
    T.StructField("mpls_label", T.IntegerType()),
    T.StructField("src_ip", T.LongType()),
    T.StructField("dst_ip", T.LongType()),
    T.StructField("ip_proto", T.IntegerType()),
    T.StructField("frag_offset", T.IntegerType()),
    T.StructField("l3_len", T.IntegerType()),
    T.StructField("l4_len", T.IntegerType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("tcp_flags", T.IntegerType()),
    T.StructField("tcp_seq", T.LongType()),
    T.StructField("tcp_ack", T.LongType()),
    T.StructField("tcp_window", T.IntegerType()),
    T.StructField("tcp_urgent", T.IntegerType()),
    T.StructField("payload_len", T.IntegerType()),
    T.StructField("icmp_type", T.IntegerType()),
    T.StructField("icmp_code", T.IntegerType()),
    T.StructField("icmp_id", T.LongType()),
    T.StructField("icmp_seq", T.IntegerType()),
    T.StructField("arp_op", T.IntegerType()),
    T.StructField("payload", T.BinaryType()),
])

FLOW_KEY = ["ip_a", "port_a", "ip_b", "port_b", "ip_proto"]
SESSION = FLOW_KEY + ["session_no"]
