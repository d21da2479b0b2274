"""Recording files (MCAP) as a Spark data source, read chunk by chunk, and decoding of their messages.

    register(spark)
    spark.read.format("recording").option("topics", "/camera/pose").load("/data/*.mcap")
    spark.read.format("recording_summary").load("/data/*.mcap")

A file's chunk index deals its chunks out to tasks; chunks without a wanted topic are not read. Summaries
read the end of each file only. Payloads are decoded by the message definition that the file carries.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Fixed values of the file format: first and last bytes, and record codes.
MAGIC = b"\x89MCAP0\r\n"
FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, CHUNK_INDEX, STATISTICS = 2, 3, 4, 5, 6, 8, 11
FOOTER_SIZE = 9 + 20 + len(MAGIC)

MESSAGES = "path string, topic string, sequence bigint, log_time bigint, publish_time bigint, schema_name string, definition string, payload binary"
SUMMARY = "path string, topic string, messages bigint, message_count bigint, start_time bigint, end_time bigint"


class Bytes:
    """Little-endian reads from a buffer, in order."""

    def __init__(self, data: bytes | memoryview):
        self.data, self.at = memoryview(data), 0

    def take(self, n: int) -> memoryview:
        if self.at + n > len(self.data):
            raise ValueError("recording record ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str) -> int:
        return struct.unpack("<" + kind, self.take(struct.calcsize("<" + kind)))[0]

    def text(self) -> str:
        return bytes(self.take(self.number("I"))).decode()

    def pairs(self) -> dict[int, int]:
        inner, out = Bytes(self.take(self.number("I"))), {}
        while inner.at < len(inner.data):
            key = inner.number("H")
            out[key] = inner.number("Q")
        return out

    def records(self) -> Iterator[tuple[int, Bytes]]:
        while self.at < len(self.data):
            code = self.number("B")
            yield code, Bytes(self.take(self.number("Q")))


@dataclass
class Index:
    """What the end of a file tells: channels, chunks and counts."""

    channels: dict[int, tuple[str, int]]
    schemas: dict[int, tuple[str, str]]
    chunks: list[tuple[int, int, frozenset[int]]]
    counts: dict[int, int]
    total: int
    start: int
    end: int


def _note(code: int, r: Bytes, channels: dict, schemas: dict) -> None:
    if code == SCHEMA:
        key, name, _, body = r.number("H"), r.text(), r.text(), r.text()
        schemas[key] = (name, body)
    elif code == CHANNEL:
        key, schema = r.number("H"), r.number("H")
        channels[key] = (r.text(), schema)


def read_index(f: pa.NativeFile, path: str) -> Index:
    size = f.size()
    head = f.read_at(len(MAGIC), 0)
    if size < len(MAGIC) + FOOTER_SIZE or bytes(head) != MAGIC:
        raise ValueError(f"not a recording file: {path}")
    foot = Bytes(f.read_at(FOOTER_SIZE, size - FOOTER_SIZE))
    code, _ = foot.number("B"), foot.number("Q")
    start = foot.number("Q")
    if code != FOOTER or not start:
        raise ValueError(f"recording file without a summary: {path}")
    out = Index({}, {}, [], {}, 0, 0, 0)
    for code, r in Bytes(f.read_at(size - FOOTER_SIZE - start, start)).records():
        if code == CHUNK_INDEX:
            r.take(16)
            offset, length = r.number("Q"), r.number("Q")
            out.chunks.append((offset, length, frozenset(r.pairs())))
        elif code == STATISTICS:
            out.total = r.number("Q")
            r.take(18)
            out.start, out.end, out.counts = r.number("Q"), r.number("Q"), r.pairs()
        else:
            _note(code, r, out.channels, out.schemas)
    return out


def _unpacked(r: Bytes) -> Bytes:
    r.take(16)
    size, _, kind = r.number("Q"), r.number("I"), r.text()
    body = r.take(r.number("Q"))
    if kind == "zstd":
        import zstandard

        return Bytes(zstandard.ZstdDecompressor().decompress(bytes(body), max_output_size=size))
    if kind == "lz4":
        return Bytes(pa.decompress(bytes(body), decompressed_size=size, codec="lz4", asbytes=True))
    if kind:
        raise ValueError(f"unknown compression of a recording's chunk: {kind}")
    return Bytes(body)


def _files(pattern: str) -> list[str]:
    """Files of a path, a folder or a pattern in a folder; raises FileNotFoundError if there is none."""
    folder, _, last = pattern.rpartition("/")
    store, base = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + (folder or "/"))
    scheme = folder.split("://")[0] + "://" + folder.split("://")[1].removesuffix(base) if "://" in folder else ""
    if "*" in last:
        rule = re.compile(".*".join(map(re.escape, last.split("*"))))
        found = [i.path for i in store.get_file_info(fs.FileSelector(base)) if i.is_file and rule.fullmatch(i.base_name)]
    else:
        info = store.get_file_info(f"{base.rstrip('/')}/{last}")
        if info.type == fs.FileType.Directory:
            found = [i.path for i in store.get_file_info(fs.FileSelector(info.path)) if i.is_file]
        else:
            found = [info.path] if info.is_file else []
    if not found:
        raise FileNotFoundError(f"no recording file: {pattern}")
    return sorted(scheme + p for p in found)


def _open(path: str) -> pa.NativeFile:
    store, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    return store.open_input_file(inner)


class _Chunks(InputPartition):
    def __init__(self, path: str, chunks: list[tuple[int, int]], channels: dict, schemas: dict):
        self.path, self.chunks, self.channels, self.schemas = path, chunks, channels, schemas


class _MessageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.topics = {t.strip() for t in options.get("topics", "").split(",") if t.strip()}
        self.bytes = int(options.get("partitionBytes", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in _files(self.path):
            with _open(path) as f:
                out += self.parts_of(path, read_index(f, path))
        return out or [_Chunks("", [], {}, {})]

    def parts_of(self, path: str, index: Index, low: int = 0, high: int | None = None) -> list[InputPartition]:
        """Parts of a file's chunks from number low up to high, in the order of their places; chunks without a wanted topic are passed over."""
        out: list[InputPartition] = []
        wanted = {c for c, (topic, _) in index.channels.items() if not self.topics or topic in self.topics}
        part, size = [], 0
        for offset, length, within in sorted(index.chunks)[low:high]:
            if within and not within & wanted:
                continue
            if part and size + length > self.bytes:
                out.append(_Chunks(path, part, index.channels, index.schemas))
                part, size = [], 0
            part.append((offset, length))
            size += length
        return [*out, _Chunks(path, part, index.channels, index.schemas)] if part else out

    def read(self, part: _Chunks) -> Iterator[tuple]:
        if not part.chunks:
            return
        channels, schemas = dict(part.channels), dict(part.schemas)
        with _open(part.path) as f:
            for offset, length in part.chunks:
                for code, chunk in Bytes(f.read_at(length, offset)).records():
                    if code != CHUNK:
                        continue
                    for kind, r in _unpacked(chunk).records():
                        if kind != MESSAGE:
                            _note(kind, r, channels, schemas)
                            continue
                        channel, sequence, log, published = r.number("H"), r.number("I"), r.number("Q"), r.number("Q")
                        topic, schema = channels[channel]
                        if not self.topics or topic in self.topics:
                            yield (part.path, topic, sequence, log, published, *schemas.get(schema, (None, None)), bytes(r.data[r.at :]))


class _MessageStream(DataSourceStreamReader):
    """A growing folder of recordings. An offset tells of each whole file how many of its chunks were taken.

    Files without their closing summary are still being written and wait; a file that is written anew with more chunks gives the
    chunks beyond those taken. The offset, kept in the query's checkpoint, has one entry per file of the folder.
    """

    def __init__(self, options: dict):
        self.batch = _MessageReader(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        try:
            files = _files(self.batch.path)
        except FileNotFoundError:
            return {}
        found = {}
        for path in files:
            try:
                with _open(path) as f:
                    found[path] = len(read_index(f, path).chunks)
            except (ValueError, EOFError, IndexError, struct.error):
                continue
        return found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, chunks in sorted(end.items()):
            if chunks > start.get(path, 0):
                with _open(path) as f:
                    out += self.batch.parts_of(path, read_index(f, path), start.get(path, 0), chunks)
        return out

    def read(self, part: _Chunks) -> Iterator[tuple]:
        return self.batch.read(part)


class RecordingSource(DataSource):
    """Messages of recording files, as a table or, with readStream, as a stream. Options: topics (with commas; all if unset), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return MESSAGES

    def reader(self, schema) -> DataSourceReader:
        return _MessageReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _MessageStream(self.options)


class _SummaryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in _files(self.path)]

    def read(self, part: InputPartition) -> Iterator[tuple]:
        with _open(part.value) as f:
            i = read_index(f, part.value)
        for channel, (topic, _) in sorted(i.channels.items()):
            yield (part.value, topic, i.counts.get(channel, 0), i.total, i.start, i.end)


class RecordingSummary(DataSource):
    """Counts per topic and times of recording files, without their messages."""

    @classmethod
    def name(cls) -> str:
        return "recording_summary"

    def schema(self) -> str:
        return SUMMARY

    def reader(self, schema) -> DataSourceReader:
        return _SummaryReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordingSource)
    spark.dataSource.register(RecordingSummary)


# Names of plain types in message definitions, and their binary kinds.
PLAIN = {"bool": "?", "byte": "B", "char": "B", "uint8": "B", "int8": "b", "uint16": "H", "int16": "h", "uint32": "I", "int32": "i", "uint64": "Q", "int64": "q", "float32": "f", "float64": "d"}
_FIELD = re.compile(r"^([\w/]+)(?:<=\d+)?(\[(<=)?(\d*)\])?\s+(\w+)\s*([^=\s].*)?$")


def fields_of(definition: str) -> dict[str, list[tuple[str, str, int | None]]]:
    """For each type of a definition its fields (name, type, length); length: -1 one value, None any, else fixed. The main type is ''."""
    out: dict[str, list] = {}
    for i, part in enumerate(re.split(r"^=+\s*$", definition, flags=re.M)):
        lines = [line.split("#")[0].strip() for line in part.strip().splitlines()]
        name = ""
        if i:
            name, lines = lines[0].removeprefix("MSG:").strip().split("/")[-1], lines[1:]
        out[name] = []
        for line in filter(None, lines):
            m = _FIELD.match(line)
            if m and "=" not in line.split('"')[0].replace("<=", ""):
                length = -1 if not m[2] else int(m[4]) if m[4] and not m[3] else None
                out[name].append((m[5], m[1].split("/")[-1], length))
    return out


class Payload(Bytes):
    """One message in common data representation: values lie at multiples of their size."""

    def __init__(self, data: bytes):
        super().__init__(memoryview(data)[4:])
        self.order = "<" if data[1] & 1 else ">"

    def plain(self, kind: str, n: int):
        size = struct.calcsize(kind)
        if n:
            self.at += -self.at % size
        return struct.unpack(f"{self.order}{n}{kind}", self.take(n * size))

    def value(self, kind: str, types: dict):
        if kind in PLAIN:
            return self.plain(PLAIN[kind], 1)[0]
        if kind in ("string", "wstring"):
            return bytes(self.take(self.plain("I", 1)[0])).rstrip(b"\0").decode()
        if kind in ("time", "Time", "duration", "Duration") and kind not in types:
            return {"sec": self.plain("i", 1)[0], "nanosec": self.plain("I", 1)[0]}
        return self.message(types[kind], types)

    def message(self, fields: list, types: dict) -> dict:
        out = {}
        for name, kind, length in fields:
            if length == -1:
                out[name] = self.value(kind, types)
                continue
            n = self.plain("I", 1)[0] if length is None else length
            if kind in ("uint8", "byte", "char"):
                out[name] = bytes(self.take(n))
            elif kind in PLAIN:
                out[name] = list(self.plain(PLAIN[kind], n))
            else:
                out[name] = [self.value(kind, types) for _ in range(n)]
        return out


# The parts of messages that the tables of this engine are made of.
_STAMP = "header struct<stamp:struct<sec:int,nanosec:bigint>,frame_id:string>"
_POINT, _TURN = "struct<x:double,y:double,z:double>", "struct<x:double,y:double,z:double,w:double>"
_POSE = f"struct<position:{_POINT},orientation:{_TURN}>"
VIEWS = {
    "image": f"{_STAMP}, format string, data binary",
    "depth": f"{_STAMP}, height int, width int, encoding string, data binary",
    "pose": f"{_STAMP}, pose {_POSE}",
    "camera": f"{_STAMP}, height int, width int, distortion_model string, d array<double>, k array<double>, r array<double>, p array<double>",
    "imu": f"{_STAMP}, orientation {_TURN}, angular_velocity {_POINT}, linear_acceleration {_POINT}",
    "transforms": f"transforms array<struct<header:struct<stamp:struct<sec:int,nanosec:bigint>,frame_id:string>,child_frame_id:string,transform:struct<translation:{_POINT},rotation:{_TURN}>>>",
    "tracking": f"{_STAMP}, state int, reason int, state_str string, reason_str string",
    "cloud": f"{_STAMP}, height int, width int, fields array<struct<name:string,offset:int>>, point_step int, data binary",
    "marker": "points array<struct<x:double,y:double,z:double>>, colors array<struct<r:float,g:float,b:float,a:float>>",
    "path": f"poses array<struct<header:struct<stamp:struct<sec:int,nanosec:bigint>,frame_id:string>,pose:{_POSE}>>",
}


def decoded(messages: DataFrame, view: str) -> DataFrame:
    """messages (path, sequence, log_time, definition, payload) with the columns of a view, or of any DDL text.

    Fields that a message lacks are null. Nothing but the asked parts leaves the decoder.
    """
    ddl = VIEWS.get(view, view)
    base = messages.select("path", "sequence", "log_time", "definition", "payload")
    spark = messages.sparkSession
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(spark.createDataFrame([], ddl).schema)
    names, kinds = wanted.names, wanted.types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            rows = []
            for text, data in zip(batch.column("definition").to_pylist(), batch.column("payload"), strict=True):
                if text not in known:
                    known[text] = fields_of(text)
                rows.append(Payload(data.as_py()).message(known[text][""], known[text]))
            cols = [pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + cols, names=["path", "sequence", "log_time", *names])

    return base.mapInArrow(run, f"path string, sequence bigint, log_time bigint, {ddl}")


def seconds(stamp: str = "header.stamp"):
    return F.col(f"{stamp}.sec") + F.col(f"{stamp}.nanosec") * 1e-9


def cloud_points(clouds: DataFrame) -> DataFrame:
    """(path, sequence, point, x, y, z, r, g, b) of the view cloud; points with a non-finite coordinate are left out, colours may be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                n, step = m["width"] * m["height"], m["point_step"]
                raw = np.frombuffer(m["data"], np.uint8)[: n * step].reshape(n, step)
                part = {f["name"]: np.ascontiguousarray(raw[:, f["offset"] : f["offset"] + 4]) for f in m["fields"] if f["name"] in ("x", "y", "z", "rgb")}
                xyz = [part[c].view("<f4")[:, 0] if c in part else np.zeros(n, np.float32) for c in "xyz"]
                keep = np.flatnonzero(np.isfinite(xyz).all(0))
                rgb = part["rgb"].view("<u4")[keep, 0] if "rgb" in part else None
                for at in range(0, len(keep), 1 << 16):
                    k = keep[at : at + (1 << 16)]
                    shades = [pa.array((rgb[at : at + len(k)] >> s & 255).astype(np.int32)) if rgb is not None else pa.nulls(len(k), pa.int32()) for s in (16, 8, 0)]
                    cols = [pa.array([m["path"]] * len(k)), pa.array(np.full(len(k), m["sequence"])), pa.array(k), *[pa.array(c[k]) for c in xyz], *shades]
                    yield pa.RecordBatch.from_arrays(cols, names=["path", "sequence", "point", "x", "y", "z", "r", "g", "b"])

    return clouds.select("path", "sequence", "height", "width", "fields", "point_step", "data").mapInArrow(run, "path string, sequence bigint, point bigint, x float, y float, z float, r int, g int, b int")


def path_poses(paths: DataFrame) -> DataFrame:
    """One row per pose of the view path."""
    d = paths.select("path", "sequence", F.posexplode("poses").alias("i", "p"))
    p, o = "p.pose.position", "p.pose.orientation"
    return d.select("path", "sequence", "i", seconds("p.header.stamp").alias("ts"), *[F.col(f"{p}.{c}").alias(f"t{c}") for c in "xyz"], *[F.col(f"{o}.{c}").alias(f"q{c}") for c in "xyzw"])
