"""Decoding and reassembly on literal bytes."""

import os
import random

import pytest
from pyspark.sql import functions as F

from netspark.functions import net
from netspark.sources import captures, decode, dns_wire, http_wire, mysql_wire, rules, streams

IP = bytes.fromhex("4500002c0000400040060000" "0a000001" "c0a80102")
TCP = bytes.fromhex("03e8005000000001000000026018ffff00000000" "020405b4" "61626364")
MACS = bytes.fromhex("010203040506" "0a0b0c0d0e0f")


def one(spark, frame, wire=None):
    df = spark.createDataFrame([(1, 7, wire or len(frame), frame)], "packet_id BIGINT, ts_us BIGINT, wire_len INT, frame BINARY")
    return decode.decode(df).first()


def test_plain_tcp(spark):
    r = one(spark, MACS + bytes.fromhex("0800") + IP + TCP)
    assert (r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.tcp_seq, r.tcp_ack) == (0x0A000001, 0xC0A80102, 1000, 80, 1, 2)
    # 44 bytes of IP hold a 24-byte TCP header and no payload: the rest of the frame is padding.
    assert (r.l3_len, r.payload_len, r.tcp_flags, r.tcp_options) == (44, 0, 0x18, bytes.fromhex("020405b4"))


@pytest.mark.parametrize("tag,vlan,label", [("81000064" "0800", 100, 0), ("8847" "00012140", 0, 0x12), ("81000064" "8847" "00012140", 100, 0x12)])
def test_tags(spark, tag, vlan, label):
    r = one(spark, MACS + bytes.fromhex(tag) + IP + TCP)
    assert (r.vlan_id, r.mpls_label, r.eth_type, r.dst_port) == (vlan, label, 0x0800, 80)


def test_fragment_cut_capture_and_stp(spark):
    later = bytearray(IP)
    later[6:8] = b"\x00\x10"
    r = one(spark, MACS + bytes.fromhex("0800") + bytes(later) + TCP)
    assert (r.frag_offset, r.src_port, r.payload) == (16, 0, None)
    r = one(spark, MACS + bytes.fromhex("0800") + IP[:10], wire=60)
    assert (r.ip_proto, r.cap_len, r.wire_len) == (0, 24, 60)
    stp = spark.createDataFrame([(0x0180C2000000, 5)], "dst_mac BIGINT, src_mac BIGINT")
    assert stp.select(net.cast_class()).first()[0] == "stp"


def test_options_stop_at_unknown_kind():
    got = decode._options(bytes.fromhex("0101" "030307" "050a0000000100000005" "fd04ffff" "020405b4"))
    assert (got["shift"], got["sacks"], got["mss"]) == (7, [{"left": 1, "right": 5}], None)


def test_dns_answers_and_loops():
    name = b"\x03www\x07example\x03org\x00"
    head = bytes.fromhex("1234" "8580" "0001" "0002" "0000" "0000")
    a = bytes.fromhex("c00c" "0001" "0001" "0000003c" "0004" "7f000001")
    mx = bytes.fromhex("c00c" "000f" "0001" "0000003c" "0009" "000a" "046d61696c" "c010")
    got = dns_wire.parse_message(head + name + bytes.fromhex("00010001") + a + mx)
    assert got[:8] == (0x1234, 1, 0, 0, True, False, "www.example.org", 1)
    assert [(x["type"], x["data"]) for x in got[9]] == [(1, "127.0.0.1"), (15, "mail.example.org")]
    loop = dns_wire.parse_message(bytes.fromhex("1234" "0100" "0001" "0000" "0000" "0000" "c00c" "0001" "0001"))
    assert loop[6] is None
    assert dns_wire.parse_message(b"short") is None


def test_capture_file_with_cut_off_record(spark, tmp_path):
    import struct
    body = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i in range(3):
        body += struct.pack("<IIII", 10, i, 4, 60) + b"abcd"
    (tmp_path / "a.pcap").write_bytes(body)
    (tmp_path / "b.pcap").write_bytes(body[:-2])
    rows = captures.read_captures(spark, str(tmp_path)).collect()
    assert sorted((r.file[-6:], r.record_no, r.ts_us) for r in rows) == [
        ("a.pcap", 0, 10_000_000), ("a.pcap", 1, 10_000_001), ("a.pcap", 2, 10_000_002), ("b.pcap", 0, 10_000_000), ("b.pcap", 1, 10_000_001)]


def test_stream_of_captures_goes_on(spark, tmp_path):
    """Files come, the last one grows in the middle of a record, old ones go, the query starts again: each record once, ids as if read at once."""
    import struct
    folder, numbers, out, checkpoint = (str(tmp_path / n) for n in ("in", "numbers/last.json", "out", "cp"))
    (tmp_path / "in").mkdir()
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    record = lambda t: struct.pack("<IIII", t, 0, 4, 60) + b"abcd"

    def run():
        frames = captures.number_packets(captures.stream_capture_files(spark, folder, numbers))
        query = frames.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.packet_id >> 40, r.packet_id & 0xFFFF, r.ts_us // 1_000_000) for r in spark.read.parquet(out).collect())

    def put(name, data, at):
        (tmp_path / "in" / name).write_bytes(data)
        os.utime(tmp_path / "in" / name, (at, at))

    put("b.pcap", head + record(1) + record(2), 100)
    put("a.pcap", head + record(3) + record(4)[:-3], 101)
    assert run() == [(1, 0, 1), (1, 1, 2), (2, 0, 3)]
    put("a.pcap", head + record(3) + record(4) + record(5)[:5], 102)
    assert run() == [(1, 0, 1), (1, 1, 2), (2, 0, 3), (2, 1, 4)]
    os.remove(tmp_path / "in" / "b.pcap")
    put("a.pcap", head + record(3) + record(4) + record(5), 103)
    put("0.pcap", head + record(6), 104)
    want = [(1, 0, 1), (1, 1, 2), (2, 0, 3), (2, 1, 4), (2, 2, 5), (3, 0, 6)]
    assert run() == want and run() == want


def segments(spark, parts):
    return spark.createDataFrame([(1, side, pos, ts, bytes(data)) for ts, (side, pos, data) in enumerate(parts)],
                                 "flow_id BIGINT, side INT, pos BIGINT, ts_us BIGINT, payload BINARY")


def test_stream_bytes_do_not_depend_on_order(spark):
    rng = random.Random(1)
    text = bytes(rng.randrange(97, 123) for _ in range(500))
    parts = [(1, p, text[p:p + n]) for p, n in ((p, rng.randrange(1, 40)) for p in range(0, 500, 7))]
    rng.shuffle(parts)
    rows = streams.stream_bytes(segments(spark, parts), ["flow_id"]).orderBy("pos").collect()
    covered = bytearray(500)
    for _, p, d in parts:
        covered[p:p + len(d)] = b"x" * len(d)
    assert all(bytes(r.payload) == text[r.pos:r.pos + len(r.payload)] for r in rows)
    assert sum(len(r.payload) for r in rows) == covered.count(b"x")
    assert sum(r.hole for r in rows) == covered.rstrip(b"\0").count(b"\0")


HTTP = (b"GET /a HTTP/1.1\r\nHost: x\r\n\r\n" b"POST /b HTTP/1.1\r\nContent-Length: 30\r\n\r\n" + b"GET /no HTTP/1.1\r\n\r\n0123456789"
        + b"POST /m HTTP/1.1\r\nContent-Type: multipart/form-data; boundary=XX\r\n\r\n--XX\r\nabc\r\n--XX--\r\n" + b"HEAD /c HTTP/1.0\r\n\r\n")
ANSWER = (b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n12\r\nHTTP/1.1 404 no\r\n\n\r\n0\r\n\r\n"
          b"HTTP/1.1 200 OK\r\nContent-Length: 100\r\n\r\n" + b"HTTP/1.1 500 in a body\r\n\r\n" + b"z" * 74
          + b"HTTP/1.1 204 None\r\n\r\n" + b"HTTP/1.0 200 OK\r\n\r\nall the rest")


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_http_framing_does_not_depend_on_chunks(spark, size):
    parts = [(1, p, HTTP[p:p + 11]) for p in range(0, len(HTTP), 11)] + [(-1, p, ANSWER[p:p + 13]) for p in range(0, len(ANSWER), 13)]
    random.Random(2).shuffle(parts)
    rows = http_wire.body_framing(segments(spark, parts), ["flow_id"], size=size, ahead=128).orderBy("side", "n").collect()
    got = [(r.side, r.head.split("\r\n")[0], r.framing, r.body_len) for r in rows]
    assert got == [(-1, "HTTP/1.1 200 OK", "chunked", 23), (-1, "HTTP/1.1 200 OK", "length", 100), (-1, "HTTP/1.1 204 None", "none", 0),
                   (-1, "HTTP/1.0 200 OK", "close", 0), (1, "GET /a HTTP/1.1", "none", 0), (1, "POST /b HTTP/1.1", "length", 30),
                   (1, "POST /m HTTP/1.1", "multipart", 19), (1, "HEAD /c HTTP/1.0", "none", 0)]


def packet(serial, body):
    return len(body).to_bytes(3, "little") + bytes([serial]) + body


@pytest.mark.parametrize("size", [64, 4096])
def test_mysql_rows_over_chunks(spark, size):
    server = packet(0, b"\x0a5.7\0rest") + packet(2, b"\0\0\0\2\0\0\0")
    body = [b"\x01", b"column", b"\xfe\0\0\x02\0"] + [bytes([i % 200]) * (i % 50 + 1) for i in range(100)] + [b"\xfe\0\0\x02\0"]
    server += b"".join(packet((i + 1) % 256, b) for i, b in enumerate(body))
    login = packet(1, (0x8208).to_bytes(4, "little") + bytes(28) + b"ann\0\x02pwshop\0")
    client = login + packet(0, b"\x03SELECT 1")
    data = [(-1, 0, server[:13]), (1, 0, login), (-1, 13, server[13:24]), (1, len(login), client[len(login):])]
    data += [(-1, 24 + p, server[24 + p:24 + p + 37]) for p in range(0, len(server) - 24, 37)]
    messages = mysql_wire.mysql_messages(mysql_wire.mysql_packets(segments(spark, data), ["flow_id"], size=size, ahead=64), ["flow_id"])
    parts = {r.part: r["count"] for r in messages.filter("kind = 'response'").groupBy("part").count().collect()}
    assert parts == {"set": 1, "col": 1, "eof": 2, "row": 100}
    who = mysql_wire.mysql_login(messages, ["flow_id"]).first()
    assert (who.version, who.user, who.database, who.status) == ("5.7", "ann", "shop", "success")


@pytest.mark.parametrize("size,ahead", [(4096, 256), (1 << 20, 1 << 16)])
def test_heads_of_any_length(spark, size, ahead):
    long = b"GET /a HTTP/1.1\r\nCookie: " + b"c" * 20_000 + b"\r\nHost: x\r\n\r\n"
    text = long + b"PUT /b HTTP/1.1\r\nContent-Length: 18\r\n\r\nGET /no HTTP/1.1\r\n\r\n"[:-2] + b"HEAD /c HTTP/1.1\r\n\r\nGET /d HTTP/1.1\r\n\r\n"
    reply = (b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n" + b"T: " + b"t" * 9000 + b"\r\nU: v\r\n\r\n"
             + b"HTTP/1.1 200 OK\r\nContent-Length: 50\r\n\r\nHTTP/1.1 404 No\r\nContent-Length: 2\r\n\r\nno")
    parts = [(1, p, text[p:p + 997]) for p in range(0, len(text), 997)] + [(-1, p, reply[p:p + 501]) for p in range(0, len(reply), 501)]
    rows = http_wire.body_framing(segments(spark, parts), ["flow_id"], size=size, ahead=ahead).orderBy("side", "n").collect()
    assert [(r.side, r.head.split("\r\n")[0], r.framing, r.body_len) for r in rows] == [
        (-1, "HTTP/1.1 200 OK", "chunked", 5), (-1, "HTTP/1.1 200 OK", "none", 0), (-1, "HTTP/1.1 404 No", "length", 2),
        (1, "GET /a HTTP/1.1", "none", 0), (1, "PUT /b HTTP/1.1", "length", 18), (1, "HEAD /c HTTP/1.1", "none", 0), (1, "GET /d HTTP/1.1", "none", 0)]
    assert rows[3].head.encode("latin-1") == long


def read_in_order(text, side, asked_head):
    """Messages of one whole stream, read from its start: (offset, framing, body length)."""
    starts = sorted({m.start() for m in http_wire.START[side].finditer(text)})
    heads = [s for s in starts if (http_wire.head_end(text, s) or -1) > 0]
    line_heads = [s for s in heads if s == 0 or text[s - 1:s] == b"\n"]
    out, at = [], min(line_heads, default=None)
    while at is not None:
        end = http_wire.head_end(text, at)
        framing, size = http_wire._framing(text[at:end], side)
        x, body = end + size, size
        if side == -1 and framing == "length" and asked_head and end in heads and x not in heads and x != len(text):
            framing, x, body = "none", end, 0
        if framing == "close":
            x = None
        elif framing == "chunked":
            body = 0
            while (m := http_wire.SIZE_LINE.match(text, x)) and text[x - 1:x] == b"\n":
                n = int(m.group(1), 16)
                body += n
                x = m.end() + n + 2 if n else m.end()
                if not n:
                    break
        elif framing.startswith("multipart:"):
            marks = [m for m in http_wire.CLOSING.finditer(text, end) if m.group(1).decode() == framing[10:]]
            stop = marks[0].start() + len(marks[0].group(1)) + 4 if marks else None
            x = None if stop is None else stop + 2 * (text[stop:stop + 2] == b"\r\n")
            body = (len(text) if x is None else x) - end
        out.append((at, framing.split(":")[0], body))
        at = None if x is None else x if x in heads else min((h for h in line_heads if h >= x), default=None)
    return out


def random_stream(rng, side):
    """Messages, and things that look like messages, sizes and marks inside bodies and between them."""
    lure = lambda: rng.choice([b"GET /no HTTP/1.1\r\n\r\n", b"HTTP/1.1 404 No\r\n\r\n", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n", b"5\r\n", b"--XX--\r\n", b"\r\n",
                               b"--YY--", b"a line\n", b"\x00\x01", b"0\r\n\r\n", b"z" * rng.randrange(30), b"POST /x HTTP/1.0\r\nContent-Le"])
    out = b""
    for _ in range(12):
        body = b"".join(lure() for _ in range(rng.randrange(5)))
        pad = b"X-Pad: " + b"p" * rng.choice([0, 5, 60, 300]) + b"\r\n"
        if side == 1:
            kind = rng.randrange(4)
            out += [b"GET /a HTTP/1.1\r\n" + pad + b"\r\n", b"PUT /b HTTP/1.1\r\n" + pad + b"Content-Length: %d\r\n\r\n" % len(body) + body,
                    b"POST /m HTTP/1.1\r\nContent-Type: multipart/form-data; boundary=XX\r\n" + pad + b"\r\n--XX\r\n" + body + b"\r\n--XX--\r\n",
                    rng.choice([b"HEAD /c HTTP/1.1\r\n\r\n", b"noise\r\n", b"GET /open HTTP/1.1\r\nA: b\r\n"])][kind]
        else:
            kind = rng.randrange(4)
            chunks = b"".join(b"%x%s\r\n" % (len(c), rng.choice([b"", b";x=y"])) + c + b"\r\n" for c in (body, b"more") if c)
            out += [b"HTTP/1.1 200 OK\r\n" + pad + b"Content-Length: %d\r\n\r\n" % len(body) + body, b"HTTP/1.1 204 None\r\n" + pad + b"\r\n",
                    b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n" + pad + b"\r\n" + chunks + b"0\r\n" + rng.choice([b"", b"T: v\r\n"]) + b"\r\n",
                    rng.choice([b"HTTP/1.1 200 OK\r\nContent-Length: 70\r\n\r\n", b"noise"])][kind]
    return out


def test_http_of_any_chunk_size_as_read_in_order(spark):
    """Also with guesses that cannot be right: lures stand wherever a chunk may begin."""
    rng = random.Random(7)
    texts = {(flow, side): random_stream(rng, side) for flow in range(6) for side in (1, -1)}
    # A body that begins with a status line, and a start line with no blank line behind it.
    texts[10, -1] = b"HTTP/1.1 200 OK\r\nContent-Length: 9019\r\n\r\n" + (b"HTTP/1.1 200 OK\r\n" + b"log line\r\n" * 1000)[:9019] + b"HTTP/1.1 204 No\r\n\r\n"
    texts[10, 1] = b"GET /log HTTP/1.1\r\n\r\nGET /more HTTP/1.1\r\n\r\n"
    texts[11, 1] = b"GET /a HTTP/1.1\r\n" + b"a line of a log\r\n" * 3000
    rows = [(flow, side, p, p, text[p:p + 700]) for (flow, side), text in texts.items() for p in range(0, len(text), 700)]
    df = spark.createDataFrame(rows, "flow_id BIGINT, side INT, pos BIGINT, ts_us BIGINT, payload BINARY")
    want = {}
    for (flow, side), text in texts.items():
        want[flow, side] = read_in_order(text, side, b"HEAD " in texts.get((flow, 1), b"HEAD "))
    for size in (64, 4096):
        got = {}
        for r in http_wire.body_framing(df, ["flow_id"], size=size, ahead=128).orderBy("n").collect():
            got.setdefault((r.flow_id, r.side), []).append((r.offset, r.framing, r.body_len))
            assert texts[r.flow_id, r.side][r.offset:].startswith(r.head.encode("latin-1"))
        assert got == {k: v for k, v in want.items() if v}
    assert want[10, -1] == [(0, "length", 9019), (9060, "none", 0)] and want[11, 1] == []


def test_http_goes_on_behind_a_gap(spark):
    text = b"GET /a HTTP/1.1\r\nHost: x\r\n\r\n" + b"GET /lost HTTP/1.1\r\nHost: x\r\n\r\n" + b"GET /b HTTP/1.1\r\n\r\n"
    parts = [(1, 0, text[:40]), (1, 55, text[55:])]
    rows = http_wire.body_framing(segments(spark, parts), ["flow_id"]).orderBy("n").collect()
    assert [r.head.split("\r\n")[0] for r in rows] == ["GET /a HTTP/1.1", "GET /b HTTP/1.1"]


@pytest.mark.parametrize("size,ahead", [(20_000, 100), (1 << 20, 1 << 16)])
def test_long_commands(spark, size, ahead):
    queries = [b"\x03SELECT " + bytes([97 + i]) * n for i, n in enumerate((5, 100_000, 7, 2000))]
    client = b"".join(packet(0, q) for q in queries)
    data = [(1, p, client[p:p + 1460]) for p in range(0, len(client), 1460)]
    rows = mysql_wire.mysql_packets(segments(spark, data), ["flow_id"], size=size, ahead=ahead).orderBy("offset").collect()
    assert [(r.argument.encode("latin-1"), r.bytes, r.code) for r in rows] == [(q[1:], len(q), 3) for q in queries]


def test_command_over_sixteen_megabytes(spark):
    query = b"\x03" + b"q" * (0xFFFFFF + 500)
    client = packet(0, query[:0xFFFFFF]) + packet(1, query[0xFFFFFF:]) + packet(0, b"\x03SELECT 1")
    data = [(1, p, client[p:p + 65536]) for p in range(0, len(client), 65536)]
    rows = mysql_wire.mysql_packets(segments(spark, data), ["flow_id"], size=4 << 20).orderBy("offset").collect()
    assert [(r.serial, r.bytes, len(r.argument)) for r in rows] == [(0, len(query), len(query) - 1), (0, 9, 8)]


def test_mysql_invents_nothing_in_a_gap(spark):
    first, second = packet(0, b"\x03SELECT 1"), packet(0, b"\x03SELECT 2")
    data = [(1, 0, first), (1, len(first) + 100, second)]
    rows = mysql_wire.mysql_packets(segments(spark, data), ["flow_id"]).orderBy("offset").collect()
    assert [(r.offset, r.argument) for r in rows] == [(0, "SELECT 1"), (len(first) + 100, "SELECT 2")]


@pytest.mark.parametrize("size,ahead", [(64, 32), (1 << 20, 1 << 16)])
def test_mysql_text_ends_at_a_gap(spark, size, ahead):
    """Missing bytes are counted and not told as text; a login with a gap names nobody."""
    query = packet(0, b"\x03SELECT " + b"a" * 200)
    login = packet(1, (0x8208).to_bytes(4, "little") + bytes(28) + b"ann\0\x02pwshop\0")
    client = login + query + packet(0, b"\x03SELECT 2")
    at = len(login) + 30
    data = [(1, 0, client[:at]), (1, at + 20, client[at + 20:])]
    rows = mysql_wire.mysql_packets(segments(spark, data), ["flow_id"], size=size, ahead=ahead).orderBy("offset").collect()
    assert [(r.argument, r.bytes, r.missing, r.user) for r in rows] == [
        (None, len(login) - 4, 0, "ann"), ("SELECT " + "a" * 18, 208, 20, None), ("SELECT 2", 9, 0, None)]
    data = [(1, 0, client[:38]), (1, 40, client[40:])]
    rows = mysql_wire.mysql_packets(segments(spark, data), ["flow_id"], size=size, ahead=ahead).orderBy("offset").collect()
    assert [(r.missing, r.user, r.database) for r in rows][:1] == [(2, None, None)]


def test_rule_priority(spark, tmp_path):
    path = tmp_path / "rules.tsv"
    path.write_text("#proto\tip\tport\tflag\tapplication\tmajor\tminor\tattribute\tname\n"
                    "tcp\t54.92.46.172\t22\t\t1\t2\t3\t4\texact\nTCP\t\t22\t9\t\t\t\t\tport\nudp\t\t53\t\t\t\t\t\tempty\n")
    table = rules.load_rules(spark, str(path))
    assert sorted((r.ip, r.port, r.flag, r.application, r.name) for r in table.collect()) == [(0, 22, 9, 0, "port"), (912010924, 22, 0, 1, "exact")]
    flows = spark.createDataFrame([(1, 50, 912010924, 22, 6), (1, 22, 5, 6, 6), (2, 9, 3, 22, 6), (2, 9, 3, 23, 6)],
                                  "client_ip BIGINT, client_port BIGINT, server_ip BIGINT, server_port BIGINT, ip_proto INT")
    got = [r.rule_name for r in rules.app_tags(flows, table).orderBy("client_ip", F.desc("client_port"), "server_port").collect()]
    assert got == ["exact", "port", "port", None]
