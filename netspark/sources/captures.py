"""Capture files: a data source with one task per file, for a folder at once or as a stream of what comes into it."""

import json
import struct
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from netspark.session import with_scheme, work_dir

# File magic and header sizes.
MAGIC = 0xA1B2C3D4
FILE_HEADER, RECORD_HEADER = 24, 16

CAPTURES = "file STRING, file_no BIGINT, record_no BIGINT, ts_us BIGINT, cap_len INT, wire_len INT, frame BINARY"
ARROW = pa.schema([("file", pa.string()), ("file_no", pa.int64()), ("record_no", pa.int64()), ("ts_us", pa.int64()), ("cap_len", pa.int32()),
                   ("wire_len", pa.int32()), ("frame", pa.binary())])
BATCH_ROWS, BATCH_BYTES = 4096, 16 << 20


def record_batches(stream, name: str, file_no: int | None = None, begin: int = 0, end: int | None = None) -> Iterator[pa.RecordBatch]:
    """Records of one open file in batches; a cut-off last record is left out.

    With begin and end, those whose last byte lies behind `begin` and not
    behind `end`: of a file that grows, each record in the stretch that
    completed it.  The chain is walked from the file's start, so they keep
    their numbers.
    """
    head = stream.read(FILE_HEADER)
    if len(head) < FILE_HEADER:
        return
    order = next((o for o in "<>" if struct.unpack(o + "I", head[:4])[0] == MAGIC), None)
    if order is None:
        raise ValueError(f"{name} is not a capture file")
    rows: list[tuple] = []
    number, at, held = 0, FILE_HEADER, 0
    while len(head := stream.read(RECORD_HEADER)) == RECORD_HEADER:
        sec, usec, size, wire = struct.unpack(order + "IIII", head)
        frame = stream.read(size)
        at += RECORD_HEADER + size
        if len(frame) < size or (end is not None and at > end):
            break
        if at > begin:
            rows.append((name, file_no, number, sec * 1_000_000 + usec, size, wire, frame))
            held += size
        number += 1
        if len(rows) == BATCH_ROWS or held > BATCH_BYTES:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)


class _File(InputPartition):
    def __init__(self, path: str, number: int, begin: int = 0, end: int | None = None):
        super().__init__(path)
        self.path, self.number, self.begin, self.end = path, number, begin, end


def file_system(path: str):
    """File system and path within it.  A plain path is one on this machine: `shared` refuses it on a cluster."""
    path = path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def shared(spark: SparkSession, path: str) -> str:
    """A path that all executors can open: a cluster wants its scheme, as a plain path is each machine's own disk."""
    if "://" not in path and not path.startswith("file:") and not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"give {path} with its scheme, such as hdfs://, s3:// or file:// for a mounted folder")
    return path


class _Files:
    """The files of a folder, and their records."""

    def __init__(self, path: str):
        self.path = path

    def files(self) -> list[pafs.FileInfo]:
        fs, root = file_system(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        return [f for f in files if f.is_file and not f.base_name.startswith((".", "_"))]

    def read(self, partition):
        fs, _ = file_system(self.path)
        # A file is walked through a buffer, so a task holds one batch and not the file.
        with fs.open_input_stream(partition.path, buffer_size=1 << 20) as stream:
            yield from record_batches(stream, partition.path, partition.number, partition.begin, partition.end)


class _Reader(_Files, DataSourceReader):
    def partitions(self):
        return [_File(path, number) for number, path in enumerate(sorted(f.path for f in self.files()))]


class _StreamReader(_Files, DataSourceStreamReader):
    """Files in the order of their last change, then of their paths; each gets the next number.

    An offset is the last file met, its number and how many of its bytes; the
    last file may go on growing, the ones before it may not change, and a file
    that comes must not be older than those met.  The last offset is also kept
    in a file of its own, so that numbers go on after a restart though old
    files are gone.
    """

    NOTHING = {"number": 0, "changed": -1, "path": "", "size": 0}

    def __init__(self, path: str, numbers: str):
        super().__init__(path)
        self.numbers = numbers

    def initialOffset(self) -> dict:
        return self.NOTHING

    def known(self) -> dict:
        fs, path = file_system(self.numbers)
        if not fs.get_file_info(path).is_file:
            return self.NOTHING
        with fs.open_input_stream(path) as stream:
            return json.loads(stream.read())

    def remember(self, offset: dict) -> None:
        fs, path = file_system(self.numbers)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path + ".new") as out:
            out.write(json.dumps(offset).encode())
        fs.move(path + ".new", path)

    def after(self, offset: dict) -> list[pafs.FileInfo]:
        place = lambda f: (f.mtime_ns, f.path)
        return sorted((f for f in self.files() if place(f) > (offset["changed"], offset["path"]) and f.path != offset["path"]), key=place)

    def latestOffset(self) -> dict:
        at = self.known()
        new = self.after(at)
        last = new[-1] if new else next((f for f in self.files() if f.path == at["path"] and f.size > at["size"]), None)
        if last is not None:
            at = {"number": at["number"] + len(new), "changed": last.mtime_ns, "path": last.path, "size": last.size}
            self.remember(at)
        return at

    def partitions(self, start: dict, end: dict) -> list[_File]:
        if start == end:
            return []
        if start["path"] == end["path"]:
            return [_File(end["path"], end["number"], start["size"], end["size"])]
        new = [f for f in self.after(start) if (f.mtime_ns, f.path) <= (end["changed"], end["path"]) or f.path == end["path"]]
        if len(new) != end["number"] - start["number"]:
            raise FileNotFoundError(f"{end['number'] - start['number']} files came after {start['path']!r}, {len(new)} are there")
        out = [_File(f.path, start["number"] + i + 1, 0, end["size"] if f.path == end["path"] else None) for i, f in enumerate(new)]
        grown = [f for f in self.files() if f.path == start["path"] and f.size > start["size"]]
        return [_File(f.path, start["number"], start["size"]) for f in grown] + out


class CaptureSource(DataSource):
    """spark.read.format("capture").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return CAPTURES

    def reader(self, schema):
        return _Reader(self.options["path"])

    def streamReader(self, schema):
        return _StreamReader(self.options["path"], self.options["numbers"])


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_no, record_no, ts_us, cap_len, wire_len, frame) of a capture file or folder.

    file_no counts the files in order of their paths, so names that begin with
    the time of a rotation put packet numbers in the order of time.

    One file is one task, as a record chain cannot be entered in the middle;
    rotated files give the parallelism.
    """
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture").load(shared(spark, path))


def stream_capture_files(spark: SparkSession, path: str, numbers: str | None = None) -> DataFrame:
    """What comes into a folder of capture files, as a stream of frames; see _StreamReader for what may come.

    File numbers are kept under `numbers`, by default in the shared work folder.
    One file is one task of a batch, of any size.
    """
    spark.dataSource.register(CaptureSource)
    numbers = numbers or with_scheme(spark, f"{work_dir(spark)}/capture-numbers/{crc32(path.encode()):08x}.json")
    return spark.readStream.format("capture").option("numbers", numbers).load(shared(spark, path))


def number_packets(frames: DataFrame) -> DataFrame:
    """Add packet_id from the file's number and the record's: unique, stable when a task is repeated, in the order of files and records."""
    return frames.withColumn("packet_id", F.col("file_no") * (1 << 40) + F.col("record_no")).drop("file_no")
