"""HTTP/1.x messages of byte streams: heads and where bodies end.

Where a message starts is known only from the one before it, yet a stream is
not read from its start here.  One pass over its chunks lists every place that
may matter, whatever came before: lines that look like start lines, size lines
of chunked bodies, closing marks of multipart ones.  What follows each of them,
were it one, is a pointer to another such place.  The messages are the places
that the pointers reach from the first one.  Pointers are followed inside each
chunk first, and from chunk to chunk by doubling, so a stream of n chunks takes
log n steps over a few rows a chunk, and no byte is read again.
"""

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.operators.prefix import BATCH_ROWS, Prior, arrow_rows, grouped, with_priors
from netspark.session import cut
from netspark.sources import streams

# Start lines, at any place, as a message may follow a body that ends without a new line.
START = {1: re.compile(rb"(?=(?:GET|POST|PUT|SEARCH|CONNECT|HEAD) [^\r\n]*HTTP/1\.\d[ \t]*\r?\n)"),
         -1: re.compile(rb"(?=HTTP/1\.\d +\d+[^\r\n]*\r?\n)")}
# Bytes that no head holds; missing bytes read as zero, so a head with a gap has them.
NO_TEXT = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
SIZE_LINE = re.compile(rb"^([0-9A-Fa-f]{1,15})[ \t]*(?:;[^\r\n]*)?\r?\n", re.M)
CLOSING = re.compile(rb"^--([^\r\n]+)--[ \t]*(?:\r?\n|\Z)", re.M)
BLANK = re.compile(rb"^\r*\n", re.M)

MARKS = [("kind", pa.string(), "STRING"), ("at", pa.int64(), "BIGINT"), ("is_line", pa.bool_(), "BOOLEAN"), ("ts_us", pa.int64(), "BIGINT"),
         ("end", pa.int64(), "BIGINT"), ("framing", pa.string(), "STRING"), ("size", pa.int64(), "BIGINT"), ("text", pa.string(), "STRING")]


def _field(head: bytes, name: bytes) -> bytes | None:
    found = re.search(rb"(?im)^" + name + rb":[ \t]*([^\r\n]*)", head)
    return found.group(1).strip() if found else None


def _framing(head: bytes, side: int) -> tuple[str, int]:
    """How the body ends and its size where the head tells it."""
    length = _field(head, b"Content-Length")
    size = int(length) if length and length.isdigit() else None
    if side == 1:
        if size is not None:
            return "length", size
        if not head.startswith(b"POST "):
            return "none", 0
        boundary = re.match(rb'(?i)multipart/form-data.*boundary="?([^";]+)', _field(head, b"Content-Type") or b"")
        return ("multipart:" + boundary.group(1).decode("latin-1"), 0) if boundary else ("none", 0)
    if (_field(head, b"Transfer-Encoding") or b"").lower().startswith(b"chunked"):
        return "chunked", 0
    if re.match(rb"HTTP/1\.\d +(?:1\d\d|204|304)", head):
        return "none", 0
    return ("length", size) if size is not None else ("close", 0)


def head_end(data: bytes, at: int) -> int | None:
    """Place behind the blank line that ends the head lines from `at`; -1 if they are no text, None if the data end before."""
    while True:
        end = data.find(b"\n", at)
        line = data[at:end if end >= 0 else len(data)]
        if NO_TEXT.search(line):
            return -1
        if end < 0:
            return None
        if not line.rstrip(b"\r"):
            return end + 1
        at = end + 1


def scan(view: streams.ChunkView, side: int) -> list[dict]:
    """Marks of what begins in a chunk.

    kind: "head" (with its end, framing and text), "open" (a head that goes on
    behind the bytes at hand), "size", "close", and once a chunk "blank" and
    "bad" (the first blank line and the first byte that no head holds),
    "newline" (the next chunk begins with a line), "begin" and "end".  Whether
    a line begins at the chunk's first byte is not known here (is_line is null).
    """
    base, data, own = view.start, view.data, view.size
    first = view.parts[0]["pos"] - base
    rest = memoryview(data)[first:]
    out = []

    def add(kind, at, end=None, framing=None, size=None, text=None):
        is_line = None if at == first else data[at - 1:at] == b"\n"
        out.append({"kind": kind, "at": base + at, "is_line": is_line, "ts_us": view.time_at(base + at),
                    "end": None if end is None else base + end, "framing": framing, "size": size, "text": text})

    def places(pattern):
        for found in pattern.finditer(rest):
            if first + found.start() >= own:
                break
            yield first + found.start(), first + found.end(), found

    add("begin", first)
    add("end", len(data))
    if data[own - 1:own] == b"\n":
        add("newline", own)
    for at, _, _ in places(START[side]):
        end = head_end(data, at)
        if end is None:
            add("open", at)
        elif end >= 0:
            framing, size = _framing(data[at:end], side)
            add("head", at, end, framing, size, data[at:end].decode("latin-1"))
    for at, end, found in places(SIZE_LINE) if side == -1 else ():
        add("size", at, end, size=int(found.group(1), 16))
    for at, _, found in places(CLOSING) if side == 1 else ():
        end = at + len(found.group(1)) + 4
        # The line's end belongs to the body.
        add("close", at, end + (2 if data[end:end + 2] == b"\r\n" else 0), text=found.group(1).decode("latin-1"))
    for at, end, _ in places(BLANK):
        add("blank", at, end)
        # One at the chunk's first byte may be the end of a line; the next one counts as well then.
        if at > first:
            break
    bad = NO_TEXT.search(data, first, own)
    if bad:
        add("bad", bad.start())
    return out


def marks_of(chunk_rows: DataFrame, line: list[str], size: int) -> DataFrame:
    """The marks of all chunks: keys, side and the fields of MARKS."""
    types = {f.name: f.dataType.simpleString() for f in chunk_rows.schema}
    columns = ", ".join([*[f"{k} {types[k]}" for k in line], *[f"{n} {d}" for n, _, d in MARKS]])

    def run(batches):
        for batch in batches:
            kinds = [*[batch.schema.field(k).type for k in line], *[t for _, t, _ in MARKS]]
            found, names = [], [*line, *[n for n, _, _ in MARKS]]
            for i, key in enumerate(zip(*(batch[k].to_pylist() for k in line))):
                view = streams.ChunkView(batch["parts"][i].as_py(), batch["chunk"][i].as_py() * size, size)
                found += [(*key, *(m[n] for n, _, _ in MARKS)) for m in scan(view, key[-1])]
                if len(found) >= BATCH_ROWS:
                    yield arrow_rows(found, names, kinds)
                    found = []
            if found:
                yield arrow_rows(found, names, kinds)

    return chunk_rows.select(*line, "chunk", "parts").mapInArrow(run, columns)


def following(marks: DataFrame, probes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Probes (keys, x, ...) with the least `at` of the marks that is not before x."""
    extra = [c for c in probes.columns if c not in (*keys, "x")]
    rows = marks.select(*keys, F.col("at").alias("x"), F.lit(1).alias("_mark"), *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra])
    rows = rows.unionByName(probes.withColumn("_mark", F.lit(0)))
    rows = with_priors(rows, keys, ["x", "_mark"], F.floor(F.col("x") / streams.POS_SLICE), [Prior(name, "last", F.when(F.col("_mark") == 1, F.col("x")))], descending=True)
    return rows.filter("_mark = 0").drop("_mark")


def long_heads(marks: DataFrame, holes: DataFrame, chunk_rows: DataFrame, line: list[str], size: int) -> DataFrame:
    """Heads that go over the bytes of their chunk, in the layout of the marks.

    Each ends at the first blank line behind its chunk, unless a byte that no
    head holds comes before.  Their bytes are fetched from the chunks that they
    lie in, so only places travel until then.
    """
    opened = marks.filter("kind = 'open'").select(*line, ((F.floor(F.col("at") / size) + 1) * size).alias("x"), F.col("at").alias("begin"), "is_line", "ts_us")
    # A blank line at a chunk's first byte is one where the chunk before ends with a line.
    begun = marks.filter("kind = 'newline'").select(*line, "at", F.lit(True).alias("_line"))
    blanks = marks.filter("kind = 'blank'").join(begun, [*line, "at"], "left").filter(F.coalesce("is_line", "_line", F.lit(False)))
    bad = marks.filter("kind = 'bad'").select(*line, "at").unionByName(holes)
    ends = following(bad, following(blanks, opened, line, "blank").withColumnRenamed("x", "_x").withColumn("x", F.col("_x")), line, "bad")
    ends = ends.filter("blank IS NOT NULL AND (bad IS NULL OR bad > blank)").join(blanks.select(*line, F.col("at").alias("blank"), "end"), [*line, "blank"])
    ends = ends.select(*line, "begin", "is_line", "ts_us", "end")
    number = F.explode(F.sequence(F.floor(F.col("begin") / size), F.floor((F.col("end") - 1) / size)))
    pieces = ends.withColumn("chunk", number).join(chunk_rows, [*line, "chunk"])
    inside = F.filter("parts", lambda p: (p["pos"] < F.least("end", (F.col("chunk") + 1) * size)) & (p["pos"] + F.length(p["payload"]) > F.col("begin")))

    def cut_out(p):
        low = F.greatest(p["pos"], F.col("begin"))
        high = F.least(p["pos"] + F.length(p["payload"]), F.col("end"), (F.col("chunk") + 1) * size)
        return F.hex(F.substr(p["payload"], (low - p["pos"] + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")))

    pieces = pieces.select(*line, "begin", "is_line", "ts_us", "end", "chunk", F.array_join(F.transform(inside, cut_out), "").alias("bytes"))
    whole = pieces.groupBy(*line, "begin", "is_line", "ts_us", "end").agg(F.sort_array(F.collect_list(F.struct("chunk", "bytes"))).alias("p"))
    whole = whole.withColumn("bytes", F.unhex(F.array_join(F.transform("p", lambda p: p["bytes"]), "")))

    @F.pandas_udf("framing STRING, size BIGINT")
    def framing(head: pd.Series, side: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_framing(bytes(h), s) for h, s in zip(head, side)], columns=["framing", "size"], dtype=object).astype({"size": "int64"})

    whole = whole.withColumn("f", framing("bytes", "side"))
    return whole.select(*line, F.lit("head").alias("kind"), F.col("begin").alias("at"), "is_line", "ts_us", "end", "f.framing", "f.size", F.decode("bytes", "ISO-8859-1").alias("text"))


def with_empty_answers(heads: DataFrame, ends: DataFrame, keys: list[str], line: list[str]) -> DataFrame:
    """Answers that tell a length and have no body, as after HEAD, get framing "none".

    They can only stand in a flow with a HEAD request, or one whose requests
    were not seen; there the next answer follows at once, and neither an answer
    nor the stream's end follows the length.
    """
    asks = heads.filter("side = 1").groupBy(*keys).agg(F.max(F.col("text").startswith("HEAD ")).alias("_asked"))
    at = heads.select(*line, F.col("at").alias("end"), F.lit(True).alias("_next"))
    behind = heads.select(*line, F.col("at").alias("_after"), F.lit(True).alias("_there"))
    rows = heads.withColumn("_after", F.col("end") + F.col("size")).join(asks, keys, "left").join(ends, line)
    rows = rows.join(at.distinct(), [*line, "end"], "left").join(behind.distinct(), [*line, "_after"], "left")
    empty = ((F.col("side") == -1) & (F.col("framing") == "length") & F.coalesce("_asked", F.lit(True)) & F.col("_next").isNotNull()
             & F.col("_there").isNull() & (F.col("_after") != F.col("last")))
    return rows.withColumns({"framing": F.when(empty, "none").otherwise(F.col("framing")), "size": F.when(empty, 0).otherwise(F.col("size"))}
                            ).drop("_after", "_asked", "_next", "_there")


def pointers(heads: DataFrame, sizes: DataFrame, closes: DataFrame, line: list[str]) -> DataFrame:
    """Rows (line, type, at, body, to_type, to_at): what would follow each head (H) and size line (L); to_at is null at a stream's end."""
    framing = F.col("framing")
    head = heads.select(*line, F.lit("H").alias("type"), "at", "end", "framing", "size", "last")
    boundary = F.regexp_extract("framing", r"(?s)^multipart:(.*)$", 1)
    parts = head.filter(framing.startswith("multipart:")).withColumns({"text": boundary, "x": F.col("end")})
    marked = following(closes, parts, [*line, "text"], "mark").join(closes.select(*line, "text", F.col("at").alias("mark"), F.col("end").alias("mark_end")), [*line, "text", "mark"], "left")
    # A body without its closing mark goes on to the end of the stream.
    marked = marked.select(*line, "type", "at", (F.coalesce("mark_end", "last") - F.col("end")).alias("body"), F.col("mark_end").alias("x"), F.lit(False).alias("sized"))
    plain = head.filter(~framing.startswith("multipart:")).select(
        *line, "type", "at", F.col("size").alias("body"), F.when(framing != "close", F.col("end") + F.col("size")).alias("x"), (framing == "chunked").alias("sized"))
    size = sizes.select(*line, F.lit("L").alias("type"), "at", F.col("size").alias("body"),
                        F.when(F.col("size") > 0, F.col("end") + F.col("size") + 2).otherwise(F.col("end")).alias("x"), (F.col("size") > 0).alias("sized"))
    nodes = plain.unionByName(marked).unionByName(size)
    nodes = nodes.join(sizes.select(*line, F.col("at").alias("x"), F.lit(True).alias("sized"), F.lit("L").alias("_size")), [*line, "x", "sized"], "left")
    nodes = nodes.join(heads.select(*line, F.col("at").alias("x"), F.lit("H").alias("_head")), [*line, "x"], "left")
    hit = F.coalesce("_size", "_head")
    out = [*line, "type", "at", "body"]
    exact = nodes.filter(hit.isNotNull()).select(*out, hit.alias("to_type"), F.col("x").alias("to_at"))
    # Else, also where a size line was due and there is none, on at the next line that is a start line.
    lost = following(heads.filter("is_line"), nodes.filter(hit.isNull() & F.col("x").isNotNull()).select(*out, "x"), line, "to_at")
    last = nodes.filter("x IS NULL").select(*out, F.lit("H").alias("to_type"), F.lit(None).cast("bigint").alias("to_at"))
    return exact.unionByName(lost.select(*out, F.lit("H").alias("to_type"), "to_at")).unionByName(last)


def reached(edges: DataFrame, firsts: DataFrame, line: list[str], size: int) -> DataFrame:
    """The rows of edges that lie on the way from the first head of each line."""
    edges = cut(edges.withColumn("chunk", F.floor(F.col("at") / size)))
    firsts = edges.join(firsts.withColumn("type", F.lit("H")), [*line, "type", "at"], "left_semi")
    entered = edges.filter(F.floor(F.col("to_at") / size) != F.col("chunk")).select(*line, F.col("to_type").alias("type"), F.col("to_at").alias("at"))
    entered = entered.unionByName(firsts.select(*line, "type", "at")).distinct()
    node = [("type", pa.string(), "STRING"), ("at", pa.int64(), "BIGINT")]
    chunk = [*line, "chunk"]
    told = [*chunk, "type", "at", "body", "to_type", "to_at", "entry"]

    def leaves(group: list[tuple]) -> list[tuple]:
        """Where each entry of a chunk leaves it; pointers lead onward, so a pass from the end knows all ends."""
        ends, out = {}, []
        for type_, at, _, to_type, to_at, entry in sorted(group, key=lambda r: -r[1]):
            to = None if to_at is None else (to_type, to_at)
            goal = ends[type_, at] = ends.get(to, to)
            if entry and goal:
                out.append((type_, at, *goal))
        return out

    flagged = edges.join(entered.withColumn("entry", F.lit(True)), [*line, "type", "at"], "left").select(*told)
    jumps = grouped(flagged, chunk, leaves, [*node, ("to_type", pa.string(), "STRING"), ("to_at", pa.int64(), "BIGINT")]).drop("chunk")
    jumps = cut(jumps)
    known = firsts.select(*line, "type", "at")
    while not jumps.isEmpty():
        step = jumps.join(known, [*line, "type", "at"], "left_semi").select(*line, F.col("to_type").alias("type"), F.col("to_at").alias("at"))
        known = cut(known.unionByName(step).distinct())
        on = jumps.select(*line, F.col("type").alias("to_type"), F.col("at").alias("to_at"), F.col("to_type").alias("_type"), F.col("to_at").alias("_at"))
        jumps = cut(jumps.join(on, [*line, "to_type", "to_at"]).select(*line, "type", "at", F.col("_type").alias("to_type"), F.col("_at").alias("to_at")))

    def walked(group: list[tuple]) -> list[tuple]:
        on, out = set(), []
        for type_, at, body, to_type, to_at, entry in sorted(group, key=lambda r: r[1]):
            if entry or (type_, at) in on:
                out.append((type_, at, body))
                on.add((to_type, to_at))
        return out

    flagged = edges.join(known.withColumn("entry", F.lit(True)), [*line, "type", "at"], "left").select(*told)
    return grouped(flagged, chunk, walked, [*node, ("body", pa.int64(), "BIGINT")]).drop("chunk")


def body_framing(segments: DataFrame, keys: list[str], size: int = streams.CHUNK, ahead: int = streams.AHEAD) -> DataFrame:
    """Messages of the streams: keys, side, n, offset, ts_us, framing, head, body_len.

    The result does not depend on `size` and `ahead` as long as start lines fit
    into `ahead`.  Parts of chunked bodies are summed under the head before them.
    """
    line = [*keys, "side"]
    pieces = streams.stream_bytes(segments, keys)
    chunk_rows = cut(streams.chunks(pieces, keys, size, ahead))
    marks = cut(marks_of(chunk_rows, line, size))
    bounds = marks.groupBy(*line).agg(F.min(F.when(F.col("kind") == "begin", F.col("at"))).alias("first"), F.max(F.when(F.col("kind") == "end", F.col("at"))).alias("last"))
    heads = marks.filter("kind = 'head'")
    if not marks.filter("kind = 'open'").isEmpty():
        holes = pieces.filter("hole > 0").select(*line, (F.col("pos") - 1).alias("at"))
        heads = heads.unionByName(long_heads(marks, holes, chunk_rows, line, size).select(*heads.columns))

    begun = marks.filter("kind = 'newline'").select(*line, "at", F.lit(True).alias("_line"))

    def told(rows):
        """Rows that know whether a line begins there: at a chunk's first byte the chunk before says so, or the stream begins."""
        rows = rows.join(begun, [*line, "at"], "left").join(bounds, line)
        return rows.withColumn("is_line", F.coalesce("is_line", "_line", F.col("at") == F.col("first"))).drop("_line")

    heads = cut(with_empty_answers(told(heads).drop("last"), bounds.select(*line, "last"), keys, line))
    sizes, closes = told(marks.filter("kind = 'size'")).filter("is_line"), told(marks.filter("kind = 'close'")).filter("is_line")
    firsts = heads.filter("is_line").groupBy(*line).agg(F.min("at").alias("at"))
    units = reached(pointers(heads, sizes, closes, line), firsts, line, size)
    is_head = (F.col("type") == "H").cast("int")
    rows = with_priors(units.withColumn("_head", is_head), line, ["at"], F.floor(F.col("at") / streams.POS_SLICE), [Prior("_before", "sum", F.col("_head"))])
    rows = (rows.withColumn("n", F.col("_before") + F.col("_head")).groupBy(*line, "n")
            .agg(F.max(F.when(F.col("_head") == 1, F.col("at"))).alias("at"), F.coalesce(F.sum("body"), F.lit(0)).alias("body_len")))
    return (rows.join(heads, [*line, "at"])
            .select(*line, "n", F.col("at").alias("offset"), "ts_us", F.split("framing", ":")[0].alias("framing"), F.col("text").alias("head"), "body_len"))


def as_messages(framed: DataFrame) -> DataFrame:
    """Framed messages in the layout that `transactions.http_messages` reads."""
    return framed.withColumn("kind", F.when(F.col("side") == 1, "req").otherwise("rsp"))
