"""Bytes derived from the fixtures: frames, DNS messages, HTTP and MySQL streams, capture files."""

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netspark import schema as S
from netspark.operators.prefix import Prior, with_priors
from netspark.plans import fixtures as fx
from netspark.sources.captures import file_system


def hexn(value, size: int) -> Column:
    value = F.lit(value) if isinstance(value, int) else value
    return F.lpad(F.hex(value.cast("bigint")), size * 2, "0")


def le(value: Column, size: int) -> Column:
    """Little-endian hexadecimal."""
    big = hexn(value, size)
    return F.concat(*[F.substring(big, size * 2 - 1 - 2 * i, 2) for i in range(size)])


def raw(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def payload() -> Column:
    """Content of the F1 packets: HTTP for kind 0, MySQL for kind 1, else zero bytes."""
    step, kind, conv = F.col("packet_id") % 16, F.col("conv_id") % 5, F.col("conv_id").cast("string")
    size = F.col("payload_len")
    request = F.concat(F.lit("GET /item/"), conv, F.lit(" HTTP/1.1\r\nHost: h"), (F.col("conv_id") % 7).cast("string"),
                       F.lit(".example.org\r\nX-Pad: "))
    request = F.concat(F.rpad(request, 196, "x"), F.lit("\r\n\r\n"))
    first = F.rpad(F.lit("HTTP/1.1 200 OK\r\nContent-Length: 1419\r\n\r\n"), 1000, "a")
    greeting = F.unhex(F.rpad(F.lit("4A0000000A352E372E3100"), 156, "0"))
    user = F.hex(raw(F.concat(F.lit("user"), F.col("conv_id").cast("string"))))
    login = F.unhex(F.rpad(F.concat(F.lit("5600000108020000" + "00000001" + "21" + "00" * 23), user, F.lit("00" + "00" + "646200")), 180, "0"))
    ok = F.unhex(F.lit("0700000200000002000000"))
    command = F.concat(F.unhex(F.lit("2400000003")), raw(F.rpad(F.concat(F.lit("SELECT "), conv), 35, " ")))
    result = F.unhex(F.lit("0100000101" + "28000002" + "03" + "61" * 39 + "05000003FE00000200" + "64000004" + "63" * 100
                           + "64000005" + "63" * 100 + "15000006" + "14" * 21 + "05000007FE00000200"))
    cases = {(0, 3): raw(request), (0, 5): raw(first), (0, 10): raw(first), (0, 6): raw(F.rpad(F.lit("y"), 460, "y")),
             (1, 3): greeting, (1, 4): login, (1, 5): ok, (1, 6): command, (1, 7): result}
    out = F
    for (k, s), value in cases.items():
        out = out.when((kind == k) & (step == s), value)
    return out.otherwise(F.unhex(F.repeat(F.lit("00"), size)))


def packets_with_payload(spark: SparkSession, sf: str) -> DataFrame:
    return fx.packets(spark, sf).withColumn("payload", payload())


def frames(spark: SparkSession, sf: str, options: bool = False) -> DataFrame:
    """Ethernet frames of the F1 packets as a written table."""
    return fx.materialized(spark, sf, f"frames{int(options)}", lambda: build_frames(spark, sf, options))


def build_frames(spark: SparkSession, sf: str, options: bool) -> DataFrame:
    """Ethernet frames of the F1 packets: packet_id, ts_us, wire_len, frame."""
    p = packets_with_payload(spark, sf)
    tcp, udp, icmp, arp = (F.col("ip_proto") == 6, F.col("ip_proto") == 17, F.col("ip_proto") == 1, F.col("eth_type") == S.ETH_ARP)
    syn = F.col("tcp_flags").bitwiseAND(F.lit(S.SYN)) != 0
    sack = (F.col("packet_id") % 16 == 7) & (F.col("conv_id") % 25 == 10)
    text = F.lit("")
    if options:
        text = (F.when(tcp & syn, F.concat(F.lit("020405B4010303070402080A"), hexn(F.col("conv_id"), 4), F.lit("00000000")))
                .when(tcp & sack, F.concat(F.lit("0101050A"), hexn(F.col("tcp_ack"), 4), hexn(F.col("tcp_ack") + 100, 4))).otherwise(""))
    p = p.withColumn("_opt", text)
    extra = F.length("_opt") / 2
    mac = F.concat(hexn(F.col("dst_mac"), 6), hexn(F.col("src_mac"), 6))
    tag = F.when(F.col("vlan_id") > 0, F.concat(F.lit("8100"), hexn(F.col("vlan_id"), 2))).otherwise("")
    ip = F.concat(F.lit("4500"), hexn(F.col("l3_len") + extra, 2), F.lit("000000004000"[:8] + "40"), hexn(F.col("ip_proto"), 1),
                  F.lit("0000"), hexn(F.col("src_ip"), 4), hexn(F.col("dst_ip"), 4))
    tcp_h = F.concat(hexn(F.col("src_port"), 2), hexn(F.col("dst_port"), 2), hexn(F.col("tcp_seq"), 4), hexn(F.col("tcp_ack"), 4),
                     hexn((20 + extra) * 4, 1), hexn(F.col("tcp_flags"), 1), hexn(F.col("tcp_window"), 2), F.lit("00000000"), F.col("_opt"))
    udp_h = F.concat(hexn(F.col("src_port"), 2), hexn(F.col("dst_port"), 2), hexn(F.col("l4_len"), 2), F.lit("0000"))
    icmp_h = F.concat(hexn(F.col("icmp_type"), 1), F.lit("000000"), hexn(F.col("conv_id") % 65536, 2), F.lit("0000"))
    arp_h = F.concat(F.lit("0001080006040000"[:12]), hexn(F.col("arp_op"), 2), hexn(F.col("src_mac"), 6), hexn(F.col("src_ip"), 4),
                     F.when(F.col("arp_op") == 1, F.lit("000000000000")).otherwise(hexn(F.col("dst_mac"), 6)), hexn(F.col("dst_ip"), 4))
    head = F.concat(mac, tag, hexn(F.col("eth_type"), 2), F.when(arp, arp_h).otherwise(
        F.concat(ip, F.when(tcp, tcp_h).when(udp, udp_h).when(icmp, icmp_h).otherwise(""))))
    frame = F.when(arp, F.unhex(head)).otherwise(F.concat(F.unhex(head), F.col("payload")))
    return p.select("packet_id", "ts_us", frame.alias("frame")).select(
        "packet_id", "ts_us", F.length("frame").alias("wire_len"), "frame")


def write_capture_files(rows: DataFrame, path: str, files: int) -> None:
    """Each task writes the frames it holds, in time order, as one capture file."""
    def write(batches):
        from pyspark import TaskContext
        task = TaskContext.get()
        fs, folder = file_system(path)
        fs.create_dir(folder, recursive=True)
        part = f"{folder}/.part-{task.partitionId():05d}.{task.taskAttemptId()}"
        with fs.open_output_stream(part) as out:
            out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
            for pdf in batches:
                for ts, frame, wire in zip(pdf["ts_us"], pdf["frame"], pdf["wire_len"]):
                    out.write(struct.pack("<IIII", ts // 1_000_000, ts % 1_000_000, len(frame), wire) + frame)
        # A repeated task replaces the file of its first attempt.
        fs.move(part, f"{folder}/part-{task.partitionId():05d}.pcap")
        yield from ()

    rows = rows.repartitionByRange(files, "ts_us").sortWithinPartitions("ts_us", "packet_id")
    rows.mapInPandas(write, "done INT").write.format("noop").mode("overwrite").save()


def dns_packets(spark: SparkSession, sf: str) -> DataFrame:
    """F3 as UDP packets; answers repeat the owner name by a pointer."""
    label = F.concat(F.lit("h"), F.col("flow_id").cast("string"))
    qname = F.concat(hexn(F.length(label), 1), F.hex(raw(label)), F.lit("076578616D706C65036F726700"))
    qtype = F.when(F.col("qtype") == "Address", 1).when(F.col("qtype") == "Canonical Name", 5).otherwise(16)
    flags = (F.col("qr") * 32768 + F.col("opcode") * 2048 + 256 + F.when(F.col("qr") == 1, F.col("rcode") + 1024).otherwise(0))

    def answer(i):
        data = (F.when(F.col("qtype") == "Address", F.concat(F.lit("00040A0000"), hexn(i, 1)))
                .when(F.col("qtype") == "Canonical Name", F.concat(F.lit("0005026E"), hexn(48 + i, 1), F.lit("C00C")))
                .otherwise(F.concat(F.lit("00030274"), hexn(48 + i, 1))))
        return F.concat(F.lit("C00C"), hexn(qtype, 2), F.lit("0001"), hexn(60 * i, 4), data)

    numbers = F.when(F.col("answer_count") > 0, F.sequence(F.lit(0), F.col("answer_count") - 1)).otherwise(F.array().cast("array<int>"))
    text = F.concat(hexn(F.col("dns_id") % 65536, 2), hexn(flags, 2), F.lit("0001"), hexn(F.col("answer_count"), 2), F.lit("00000000"),
                    qname, hexn(qtype, 2), F.lit("0001"), F.array_join(F.transform(numbers, answer), ""))
    query = F.col("qr") == 0
    return fx.dns_msgs(spark, sf).withColumnRenamed("dns_id", "event_id").withColumn("dns_id", F.col("event_id")).select(
        "event_id", "flow_id", "ts_us", F.lit(17).alias("ip_proto"), F.when(query, 40000).otherwise(53).alias("src_port"),
        F.when(query, 53).otherwise(40000).alias("dst_port"),
        F.unhex(text).alias("payload"))


def http_streams(spark: SparkSession, sf: str, size: int = 1460) -> DataFrame:
    """F2 as segments of byte streams: flow_id, side, pos, ts_us, payload.

    Requests with a body and answers say its length, every third answer is
    chunked instead; every fifth segment is sent twice.
    """
    pages = fx.table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("html"))
    msgs = fx.http_msgs(spark, sf).withColumn("page_id", F.col("n") * 20 + F.col("flow_id")).join(pages, "page_id")
    request = F.col("kind") == "req"
    chunked = ~request & (F.col("page_id") % 3 == 2)
    half = F.floor(F.length("html") / 2).cast("int")
    piece = lambda data: F.concat(raw(F.concat(F.lower(F.hex(F.length(data).cast("bigint"))), F.lit("\r\n"))), data, raw(F.lit("\r\n")))
    html = F.col("html")
    chunks = F.concat(piece(F.substr(html, F.lit(1), half)), piece(F.substr(html, half + 1, F.length(html))), raw(F.lit("0\r\n\r\n")))
    start = F.regexp_extract("head", r"^([^\r\n]*\r\n)", 1)
    host = F.regexp_extract("head", r"(Host: [^\r\n]*\r\n)", 1)
    head = (F.when(request & (F.col("body_len") > 0), F.concat(start, host, F.lit("Content-Length: 100\r\n\r\n")))
            .when(request, F.col("head")).when(chunked, F.concat(start, F.lit("Transfer-Encoding: chunked\r\n\r\n")))
            .otherwise(F.concat(start, F.lit("Content-Length: "), F.length(html).cast("string"), F.lit("\r\n\r\n"))))
    body = F.when(request, F.unhex(F.repeat(F.lit("62"), F.col("body_len").cast("int")))).when(chunked, chunks).otherwise(html)
    whole = msgs.select("flow_id", F.when(request, 1).otherwise(-1).alias("side"), "n", "ts_us", F.concat(raw(head), body).alias("data"))
    whole = with_priors(whole, ["flow_id", "side"], ["n"], F.floor(F.col("n") / 1000), [Prior("base", "sum", F.length("data"))])
    cuts = F.explode(F.sequence(F.lit(0), F.length("data") - 1, F.lit(size)))
    rows = whole.withColumn("cut", cuts).select(
        "flow_id", "side", (F.col("base") + F.col("cut")).alias("pos"), (F.col("ts_us") + F.col("cut")).alias("ts_us"),
        F.substr(F.col("data"), F.col("cut") + 1, F.lit(size)).alias("payload"))
    again = F.explode(F.when((F.col("pos") / size).cast("bigint") % 5 == 0, F.array(F.lit(0), F.lit(50))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("late", again).withColumn("ts_us", F.col("ts_us") + F.col("late")).drop("late")
