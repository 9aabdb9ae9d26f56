"""TCP options of packets: which packets are told, and that the decoding runs once."""

import contextlib
import io

from netspark.operators.nodes import count
from netspark.sources import decode


def frame(options: str, flags: int = 0x18, proto: int = 6) -> bytes:
    tcp = "0050" "1f90" "00000001" "00000002" + f"{(20 + len(options) // 2) // 4:x}0{flags:02x}" + "0010" "0000" "0000" + options
    size = 20 + len(tcp) // 2
    return bytes.fromhex("00" * 12 + "0800" + f"4500{size:04x}0000000040{proto:02x}0000" + "0a000001" "0a000002" + tcp)


def rows(spark):
    frames = [frame("020405b4", 0x02), frame(""), frame("0101050a0000000100000009"), frame("03030700", 0x10), frame("020405b4", proto=17), frame("01010101")]
    return decode.decode(spark.createDataFrame([(i, i, len(f), f) for i, f in enumerate(frames)], "packet_id long, ts_us long, wire_len int, frame binary"))


def test_packets_with_options_are_told(spark):
    got = [(r.packet_id, r.mss, r["shift"], r.stamp, r.sack_ok, [tuple(s) for s in r.sacks], r.window) for r in decode.tcp_options(rows(spark)).orderBy("packet_id").collect()]
    assert got == [(0, 1460, None, None, False, [], -1), (2, None, None, None, False, [(1, 9)], 16), (3, None, 7, None, False, [], 16 * 128), (5, None, None, None, False, [], 16)]
    assert decode.tcp_options(rows(spark)).columns == ["packet_id", "mss", "shift", "stamp", "sack_ok", "sacks", "window"]


def test_no_filter_decodes_the_headers_again(spark):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        decode.tcp_options(rows(spark)).agg(count()).explain("simple")
    assert not [line for line in out.getvalue().splitlines() if "Filter" in line and "conv(" in line]
