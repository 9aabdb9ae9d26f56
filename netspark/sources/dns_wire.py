"""DNS messages of UDP port 53."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark import schema as S
from netspark.functions import names

ANSWER = pa.struct([("name", pa.string()), ("type", pa.int32()), ("data", pa.string()), ("ttl", pa.int64())])
FIELDS = [("dns_id", pa.int64()), ("qr", pa.int32()), ("opcode", pa.int32()), ("rcode", pa.int32()),
          ("authoritative", pa.bool_()), ("truncated", pa.bool_()), ("qname", pa.string()), ("qtype_code", pa.int32()),
          ("answer_count", pa.int32()), ("answers", pa.list_(ANSWER))]
COLUMNS = ("dns_id BIGINT, qr INT, opcode INT, rcode INT, authoritative BOOLEAN, truncated BOOLEAN, qname STRING, qtype_code INT, "
           "answer_count INT, answers ARRAY<STRUCT<name: STRING, type: INT, data: STRING, ttl: BIGINT>>")
PORT = 53


def _name(data: bytes, at: int) -> tuple[str, int]:
    """Name at an offset and the offset behind it.  Pointers must lead backwards, so a loop ends."""
    labels, behind, limit = [], None, len(data)
    while at < len(data) and data[at]:
        size = data[at]
        if size & 0xC0 == 0xC0:
            if at + 1 >= len(data):
                raise ValueError("cut-off pointer")
            target = (size & 0x3F) << 8 | data[at + 1]
            behind = at + 2 if behind is None else behind
            if target >= min(at, limit):
                raise ValueError("pointer does not lead backwards")
            at = limit = target
            continue
        if at + 1 + size > len(data):
            raise ValueError("cut-off label")
        labels.append(data[at + 1:at + 1 + size].decode("latin-1"))
        at += 1 + size
    return ".".join(labels), (at + 1 if behind is None else behind)


def _value(data: bytes, kind: int, at: int, size: int) -> str | None:
    """Text of an answer's data; None for types that are not listed."""
    if kind == 1 and size == 4:
        return ".".join(map(str, data[at:at + 4]))
    if kind == 28 and size == 16:
        return ":".join(f"{int.from_bytes(data[i:i + 2], 'big'):x}" for i in range(at, at + 16, 2))
    if kind in (2, 5, 12):
        return _name(data, at)[0]
    if kind == 15:
        return _name(data, at + 2)[0]
    if kind == 16 and size > 0:
        return data[at + 1:at + 1 + data[at]].decode("latin-1")
    return None


def parse_message(data: bytes) -> tuple | None:
    """Fields of one message; None when the header is cut off.

    A bad record ends the answer list; the fields read before it stay.
    """
    if len(data) < 12:
        return None
    number = lambda at, n=2: int.from_bytes(data[at:at + n], "big")
    flags, questions, count = number(2), number(4), number(6)
    qname, qtype, answers, at = None, None, [], 12
    try:
        for i in range(questions):
            text, at = _name(data, at)
            if i == 0:
                qname, qtype = text, number(at)
            at += 4
        for _ in range(count):
            owner, at = _name(data, at)
            kind, class_, ttl, size = number(at), number(at + 2), number(at + 4, 4), number(at + 8)
            at += 10
            if at + size > len(data):
                break
            if class_ == 1:
                text = _value(data, kind, at, size)
                if text is not None:
                    answers.append({"name": owner, "type": kind, "data": text, "ttl": ttl})
            at += size
    except ValueError:
        pass
    reply = flags >> 15
    return (number(0), reply, flags >> 11 & 15, (flags & 15) if reply else 0, bool(reply and flags >> 10 & 1),
            bool(reply and flags >> 9 & 1), qname, qtype, len(answers), answers)


def dns_messages(packets: DataFrame, keep: list[str]) -> DataFrame:
    """One row per DNS message with the packet's `keep` columns, the question and the answers."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse_message(p.as_py() or b"") for p in batch["payload"]]
            hits = [i for i, r in enumerate(rows) if r is not None]
            kept = batch.take(pa.array(hits, pa.int64()))
            columns = [kept[c] for c in keep]
            columns += [pa.array([rows[i][j] for i in hits], t) for j, (_, t) in enumerate(FIELDS)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *[n for n, _ in FIELDS]])

    asked = packets.filter((F.col("ip_proto") == S.PROTO_UDP) & ((F.col("src_port") == PORT) | (F.col("dst_port") == PORT)))
    source = asked.select(*keep, "payload")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "payload")
    rows = source.mapInArrow(parse, f"{fields}, {COLUMNS}")
    return rows.withColumn("qtype", names.name_of("qtype_code", names.DNS_TYPE, "Unknown"))
