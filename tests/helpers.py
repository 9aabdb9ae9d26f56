"""Small packet tables for tests."""

from netspark import schema as S

DEFAULTS = {"cap_len": 60, "wire_len": 60, "src_mac": 1, "dst_mac": 2, "eth_type": 2048, "vlan_id": 0, "mpls_label": 0, "ip_proto": 6,
            "frag_offset": 0, "l3_len": 40, "l4_len": 20, "tcp_flags": 16, "tcp_seq": 0, "tcp_ack": 0, "tcp_window": 100, "tcp_urgent": 0,
            "payload_len": 0}
CLIENT, SERVER = (10, 1000), (20, 80)


def packets(spark, rows):
    """rows: dicts with ts_us and up ("c" or "s" as sender) and any packet columns."""
    out = []
    for i, row in enumerate(rows):
        row = {**DEFAULTS, "packet_id": i, **row}
        side = row.pop("up", "c")
        src, dst = (CLIENT, SERVER) if side == "c" else (SERVER, CLIENT)
        row = {"src_ip": src[0], "src_port": src[1], "dst_ip": dst[0], "dst_port": dst[1], **row}
        out.append(tuple(row.get(f.name) for f in S.PACKETS))
    return spark.createDataFrame(out, S.PACKETS)
