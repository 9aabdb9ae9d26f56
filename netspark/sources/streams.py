"""Byte streams of flows: de-overlapped pieces, fixed-size chunks and framed messages.

A message stream can only be read from its start, yet one stream may hold most
of the bytes.  Streams are therefore cut into chunks of bounded size that are
parsed in parallel.  Each chunk is entered at a place: the stream offset where
its first unit begins and the reader's mode.  Later chunks first guess their
place.  Then each chunk's place is compared with what the chunks before it
ended with, and only chunks that were entered wrongly are parsed again, until
none is.  The first chunk is right from the start, so the result is the same as
that of one pass; long bodies are stepped over, as a place may lie many chunks
ahead.
"""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.operators.prefix import BATCH_ROWS, Prior, arrow_rows, with_priors
from netspark.session import cut

POS_SLICE = 1 << 20
CHUNK, AHEAD = 1 << 20, 1 << 16


def stream_bytes(segments: DataFrame, keys: list[str]) -> DataFrame:
    """In-order payload pieces without overlaps: keys, side, pos, ts_us, payload, hole.

    `segments` has keys, side, pos, ts_us, payload.  Of copies with one start the
    longest is kept.  `hole` counts missing bytes before the piece.
    """
    line = [*keys, "side"]
    size = F.length("payload")
    single = (segments.groupBy(*line, "pos")
              .agg(F.min("ts_us").alias("ts_us"), F.max_by("payload", size).alias("payload")))
    rows = with_priors(single, line, ["pos"], F.floor(F.col("pos") / POS_SLICE),
                       [Prior("high", "max", F.col("pos") + F.length("payload"))])
    old = F.greatest(F.coalesce(F.col("high") - F.col("pos"), F.lit(0)), F.lit(0))
    return (rows.withColumn("_old", old).filter(F.col("_old") < F.length("payload"))
            .select(*line, (F.col("pos") + F.col("_old")).alias("pos"), "ts_us",
                    F.substr(F.col("payload"), (F.col("_old") + 1).cast("int"), F.length("payload")).alias("payload"),
                    F.greatest(F.coalesce(F.col("pos") - F.col("high"), F.lit(0)), F.lit(0)).alias("hole")))


def chunks(pieces: DataFrame, keys: list[str], size: int = CHUNK, ahead: int = AHEAD) -> DataFrame:
    """Rows of at most size + ahead bytes: keys, side, chunk, parts.

    A chunk also holds the first `ahead` bytes of the next one, so a unit head
    that starts in it can be read to its end.
    """
    first = F.floor((F.col("pos") - ahead) / size)
    last = F.floor((F.col("pos") + F.length("payload") - 1) / size)
    rows = pieces.withColumn("chunk", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("pos"), F.col("chunk") * size)
    end = F.least(F.col("pos") + F.length("payload"), (F.col("chunk") + 1) * size + ahead)
    part = F.struct(begin.alias("pos"), F.col("ts_us"),
                    F.substr(F.col("payload"), (begin - F.col("pos") + 1).cast("int"), (end - begin).cast("int")).alias("payload"))
    return (rows.filter(end > begin).groupBy(*keys, "side", "chunk")
            .agg(F.sort_array(F.collect_list(part)).alias("parts"))
            .filter(F.col("parts")[0]["pos"] < (F.col("chunk") + 1) * size))


class ChunkView:
    """Bytes of one chunk; missing bytes read as zero and are listed in `holes` as (start, end) within `data`."""

    def __init__(self, parts, start: int, size: int):
        self.start, self.size = start, size
        self.parts = parts
        self.end = max(p["pos"] + len(p["payload"]) for p in parts)
        data = bytearray(self.end - start)
        for p in parts:
            data[p["pos"] - start:p["pos"] - start + len(p["payload"])] = p["payload"]
        self.data = bytes(data)
        self.holes, covered = [], 0
        for p in parts:
            if p["pos"] - start > covered:
                self.holes.append((covered, p["pos"] - start))
            covered = max(covered, p["pos"] - start + len(p["payload"]))

    def hole_at(self, begin: int, end: int) -> int | None:
        """End of the first hole that [begin, end) of the data touches."""
        return next((b for a, b in self.holes if a < end and b > begin), None)

    def time_at(self, offset: int) -> int:
        """Arrival time of the piece that holds an offset, else of the one before it."""
        at = self.parts[0]["ts_us"]
        for p in self.parts:
            if p["pos"] > offset:
                break
            at = p["ts_us"]
        return at


Place = tuple[int, str]
Parser = Callable[[ChunkView, int, Place | None], tuple[list[dict], Place, Place]]


def framed(chunk_rows: DataFrame, keys: list[str], parser: Parser, fields: list[tuple[str, pa.DataType, str]],
           size: int = CHUNK) -> DataFrame:
    """Units of all streams: keys, side and the parser's fields.

    `parser(view, side, place)` returns the units that start in the chunk, the
    place it began at (its guess when `place` is None) and the place where the
    next unit starts.
    """
    line = [*keys, "side"]
    chunk_rows = cut(chunk_rows)
    unit = pa.struct([(n, t) for n, t, _ in fields])
    types = {f.name: f.dataType.simpleString() for f in chunk_rows.schema}
    out_columns = ", ".join([*[f"{k} {types[k]}" for k in line], "chunk BIGINT, at BIGINT, mode STRING, next_at BIGINT, next_mode STRING",
                             "units ARRAY<STRUCT<" + ", ".join(f"{n}: {d}" for n, _, d in fields) + ">>"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*line, "chunk", "at", "mode", "next_at", "next_mode", "units"]
        for batch in batches:
            kinds = [*[batch.schema.field(c).type for c in (*line, "chunk")], pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(unit)]
            done, held = [], 0
            for i, (*key, chunk, at, mode) in enumerate(zip(*(batch[c].to_pylist() for c in (*line, "chunk", "at", "mode")))):
                view = ChunkView(batch["parts"][i].as_py(), chunk * size, size)
                place = None if at is None else (at, mode)
                if place and place[0] >= view.start + size:
                    units, began, following = [], place, place
                else:
                    units, began, following = parser(view, key[-1], place)
                done.append((*key, chunk, *began, *following, units))
                held += len(units) + 1
                if held >= BATCH_ROWS:
                    yield arrow_rows(done, names, kinds)
                    done, held = [], 0
            if done:
                yield arrow_rows(done, names, kinds)

    def run(rows: DataFrame) -> DataFrame:
        return rows.select(*line, "chunk", "at", "mode", "parts").mapInArrow(parse, out_columns)

    first = chunk_rows.groupBy(*line).agg(F.min("chunk").alias("_first"))
    start = F.when(F.col("chunk") == F.col("_first"), F.col("parts")[0]["pos"])
    done = cut(run(chunk_rows.join(first, line).withColumns({"at": start, "mode": F.when(start.isNotNull(), "start")})))
    while True:
        ended = F.struct(F.col("next_at").alias("at"), F.col("next_mode").alias("mode"))
        checked = with_priors(done, line, ["chunk"], F.floor(F.col("chunk") / 1024), [Prior("_due", "max", ended)])
        due, used = F.col("_due"), F.struct(F.col("at").alias("at"), F.col("mode").alias("mode"))
        wrong = checked.filter(due.isNotNull() & ~due.eqNullSafe(used)).select(*line, "chunk", due["at"].alias("at"), due["mode"].alias("mode"))
        wrong = cut(wrong)
        if wrong.isEmpty():
            break
        again = run(chunk_rows.join(wrong, [*line, "chunk"]))
        done = cut(done.join(wrong.select(*line, "chunk"), [*line, "chunk"], "left_anti").unionByName(again))
    return done.select(*line, F.explode("units").alias("u")).select(*line, "u.*")
