"""MySQL client/server packets of byte streams."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.operators.prefix import Prior, sliced, time_slice, with_priors
from netspark.sources import streams

# Capability and status bits, command and reply codes.
CONNECT_WITH_DB, PROTOCOL_41, SECURE_CONNECTION, LENENC_AUTH = 0x8, 0x200, 0x8000, 0x200000
MORE_RESULTS = 0x8
OK, INFILE, EOF, ERR = 0x00, 0xFB, 0xFE, 0xFF
HEADER = 4
GUESS_LINKS = 4
# A packet of this size goes on in the next one.
FULL = 0xFFFFFF

UNITS = [("offset", pa.int64(), "BIGINT"), ("ts_us", pa.int64(), "BIGINT"), ("serial", pa.int32(), "INT"), ("bytes", pa.int64(), "BIGINT"),
         ("code", pa.int32(), "INT"), ("more", pa.bool_(), "BOOLEAN"), ("version", pa.string(), "STRING"),
         ("user", pa.string(), "STRING"), ("database", pa.string(), "STRING"), ("argument", pa.string(), "STRING"), ("missing", pa.int64(), "BIGINT"), ("piece", pa.int64(), "BIGINT")]


def _text(data: bytes, at: int) -> tuple[str, int]:
    end = data.find(b"\0", at)
    end = len(data) if end < 0 else end
    return data[at:end].decode("latin-1"), end + 1


def _greeting(body: bytes) -> str | None:
    return _text(body, 1)[0] if body[:1] in (b"\x09", b"\x0a") else None


def _login(body: bytes) -> tuple[str, str | None]:
    """User and database of a login of either protocol."""
    flags = int.from_bytes(body[:4], "little")
    if not flags & PROTOCOL_41:
        user, at = _text(body, 5)
        _, at = _text(body, at)
        return user, (_text(body, at)[0] if flags & CONNECT_WITH_DB and at < len(body) else None)
    user, at = _text(body, 32)
    if at < len(body) and flags & (LENENC_AUTH | SECURE_CONNECTION):
        at += 1 + body[at]
    else:
        _, at = _text(body, at)
    return user, (_text(body, at)[0] if flags & CONNECT_WITH_DB and at < len(body) else None)


def _header(data: bytes, p: int) -> tuple[int, int]:
    return int.from_bytes(data[p:p + 3], "little"), data[p + 3]


def _guess(view: streams.ChunkView, begin: int = 0) -> int | None:
    """First offset from which some packets follow each other with rising serial numbers, none of their headers in a hole."""
    data = view.data
    for p in range(begin, min(view.size, len(data) - HEADER)):
        at, (size, serial), links = p, _header(data, p), 0
        while size and links < GUESS_LINKS:
            at += HEADER + size
            if at + HEADER > len(data):
                break
            size, following = _header(data, at)
            if following != (serial + 1) % 256:
                break
            serial, links = following, links + 1
        if links == GUESS_LINKS and view.hole_at(p, p + HEADER) is None:
            return p
    return None


def _after_hole(view: streams.ChunkView, begin: int) -> int | None:
    """Where packets go on behind a hole: a chain of packets, or a packet that ends with its segment."""
    ends = {p["pos"] - view.start + len(p["payload"]) for p in view.parts}
    if begin + HEADER <= len(view.data):
        size, _ = _header(view.data, begin)
        if size and begin + HEADER + size in ends and view.hole_at(begin, begin + HEADER + size) is None:
            return begin
    return _guess(view, begin)


def parse_chunk(view: streams.ChunkView, side: int, place: streams.Place | None):
    """Packets that start in the chunk, and the pieces in it of packets that started before.

    A mode "body:first:left:full" says that `left` bytes of the packet at `first`
    are still to come, "more:first" that the next packet continues it.  Only
    a command's text is kept; other bodies are stepped over.  A header with
    missing bytes ends the chain, which is taken up again behind the hole.
    Missing bytes of what is read of a body are counted; text ends before them,
    and a greeting or login with some names nothing.
    """
    base, data, own = view.start, view.data, view.size
    if place is None:
        p = _guess(view)
        if p is None:
            return [], (base + own, "lost"), (base + own, "lost")
        place = (base + p, "start")
    at, mode = place
    units = []

    def add(offset, piece, **values):
        units.append(dict.fromkeys(n for n, _, _ in UNITS) | {"offset": offset, "piece": piece, "ts_us": view.time_at(piece), "more": False, "missing": 0} | values)

    def missing(begin, end):
        return sum(max(0, min(b, end) - max(a, begin)) for a, b in view.holes)

    def text(begin, end):
        stop = min((max(a, begin) for a, b in view.holes if a < end and b > begin), default=end)
        return {"argument": data[begin:stop].decode("latin-1"), "missing": missing(begin, end)}

    while at - base < min(own, len(data)):
        p = at - base
        if mode.startswith("body:"):
            first, left, full = map(int, mode.split(":")[1:])
            end = min(p + left, own)
            add(first, at, bytes=0, **text(p, end))
            left -= end - p
            at, mode = base + end, f"body:{first}:{left}:{full}" if left else f"more:{first}" if full else "start"
            continue
        hole = view.hole_at(p, p + HEADER) if p + HEADER <= len(data) else None
        if hole is not None or mode == "lost":
            p = _after_hole(view, hole or p)
            at, mode = (base + own, "lost") if p is None else (base + p, "start")
            if p is None:
                break
            continue
        if p + HEADER > len(data):
            break
        size, serial = _header(data, p)
        begin, reach = p + HEADER, min(p + HEADER + size, max(own, p + HEADER))
        full = int(size == FULL)
        if mode.startswith("more:"):
            first = int(mode[5:])
            add(first, at, bytes=size, **(text(begin, reach) if side == 1 else {}))
            keep = side == 1
        else:
            first, keep = at, side == 1 and serial == 0
            body = data[begin:begin + size] if serial == 0 or side == 1 else data[begin:begin + min(size, 16)]
            whole = not missing(begin, begin + len(body))
            unit = {"serial": serial, "bytes": size, "code": body[0] if body and not missing(begin, begin + 1) else None}
            if side == -1:
                if serial == 0:
                    unit["version"] = _greeting(body) if whole else None
                if body[:1] == b"\xfe" and size < 9:
                    unit["more"] = bool(int.from_bytes(body[3:5], "little") & MORE_RESULTS)
            elif serial:
                unit["user"], unit["database"] = _login(body) if len(body) > 5 and whole else (None, None)
                unit["missing"] = missing(begin, begin + len(body))
            else:
                unit |= text(begin + 1, reach)
            add(at, at, **unit)
        left = begin + size - reach
        if keep and left:
            at, mode = base + reach, f"body:{first}:{left}:{full}"
        else:
            at, mode = base + begin + size, f"more:{first}" if full else "start"
    return units, place, (at, mode)


def mysql_packets(segments: DataFrame, keys: list[str], size: int = streams.CHUNK, ahead: int = streams.AHEAD) -> DataFrame:
    """Protocol packets of the streams: keys, side and the fields of UNITS but `piece` (side 1 is the client).

    A packet in several pieces, over a chunk's edge or over 16 MB, is one row.
    """
    line = [*keys, "side"]
    rows = streams.framed(streams.chunks(streams.stream_bytes(segments, keys), keys, size, ahead), keys, parse_chunk, UNITS, size)
    later = F.sort_array(F.collect_list(F.when(F.col("piece") != F.col("offset"), F.struct("piece", F.coalesce("argument", F.lit("")).alias("argument"), "missing"))))
    rest = rows.filter("piece != offset").groupBy(*line, "offset").agg(F.sum("bytes").alias("_bytes"), F.sum("missing").alias("_missing"), later.alias("_later"))
    # Text goes on up to the piece with the first missing byte.
    gap = F.array_position(F.transform("_later", lambda x: x["missing"] > 0), True)
    rest = rest.withColumn("_later", F.when(gap > 0, F.slice("_later", 1, gap.cast("int"))).otherwise(F.col("_later")))
    whole = rows.filter("piece = offset").join(rest, [*line, "offset"], "left")
    goes_on = F.col("_later").isNotNull() & (F.col("missing") == 0)
    text = F.concat(F.coalesce("argument", F.lit("")), F.array_join(F.transform("_later", lambda x: x["argument"]), ""))
    return whole.withColumns({"bytes": F.col("bytes") + F.coalesce("_bytes", F.lit(0)), "argument": F.when(goes_on, text).otherwise(F.col("argument")),
                              "missing": F.col("missing") + F.coalesce("_missing", F.lit(0))}).drop("piece", "_bytes", "_missing", "_later")


def mysql_messages(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Packets with their role: greeting, login, login_reply, command or response, and the part of a result set.

    A response packet belongs to the last command; inside a command's answer the
    packets before the first EOF are columns, those before the second are rows.
    """
    order = ["ts_us", "_late", "offset"]
    packets = sliced(packets, keys)
    slice_ = time_slice(packets)
    client = F.col("side") == 1
    is_command = client & (F.col("serial") == 0)
    is_login = client & (F.col("serial") == 1)
    rows = packets.withColumns({"_late": F.when(client, 0).otherwise(1), "is_command": is_command.cast("int"), "_login": is_login.cast("int")})
    rows = with_priors(rows, keys, order, slice_, [Prior("_commands", "sum", F.col("is_command")), Prior("_logins", "sum", F.col("_login"))])
    rows = rows.withColumn("command_no", F.col("_commands") + F.col("is_command"))
    answer = ~client & (F.col("command_no") > 0)
    eof = (answer & (F.col("code") == EOF) & (F.col("bytes") < 9)).cast("int")
    rows = with_priors(rows.withColumns({"_eof": eof, "_answer": answer.cast("int")}), [*keys, "command_no"], order, slice_,
                       [Prior("_eofs", "sum", F.col("_eof")), Prior("_answers", "sum", F.col("_answer")), Prior("_last_eof", "lag", F.col("_eof"))])
    head = (F.col("_answers") == 0) | ((F.col("_eofs") % 2 == 0) & (F.col("_last_eof") == 1))
    part = (F.when(~answer, None).when(F.col("_eof") == 1, "eof")
            .when((F.col("_answers") == 0) & F.col("code").isin(OK, ERR, INFILE), "status").when(head, "set")
            .when(F.col("_eofs") % 2 == 0, "col").otherwise("row"))
    kind = (F.when(is_command, "command").when(is_login, "login").when(client, "more")
            .when(F.col("command_no") > 0, "response").when(F.col("_logins") > 0, "login_reply").otherwise("greeting"))
    return (rows.withColumns({"part": part, "kind": kind, "command": F.when(is_command, F.col("code"))})
            .select(*keys, "side", "offset", "ts_us", "serial", "bytes", "code", "kind", "part", "is_command", "command", "command_no",
                    "version", "user", "database", "argument", "missing"))


def mysql_login(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Login request and reply of each flow: times, user, database and status."""
    login, reply = F.col("kind") == "login", F.col("kind") == "login_reply"
    status = F.when(F.col("code") == OK, "success").when(F.col("code") == ERR, "failure")
    return (messages.groupBy(*keys)
            .agg(F.max("version").alias("version"), F.min(F.when(login, F.col("ts_us"))).alias("req_us"),
                 F.min(F.when(reply & status.isNotNull(), F.struct("ts_us", status.alias("status")))).alias("r"),
                 F.max(F.when(login, F.col("user"))).alias("user"), F.max(F.when(login, F.col("database"))).alias("database"))
            .filter(F.col("req_us").isNotNull())
            .select(*keys, "version", "req_us", F.col("r.ts_us").alias("rsp_us"), "user", "database", F.col("r.status").alias("status")))
