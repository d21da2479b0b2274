"""Recording files written here byte by byte, episode folders and PLY files read back."""

from __future__ import annotations

import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from strandline.sources.episode import export_episode, middle_frames, write_ply
from strandline.sources.recording import cloud_points, decoded, fields_of, path_poses, register, seconds

POSE = """std_msgs/Header header
geometry_msgs/Pose pose
================================================================================
MSG: std_msgs/Header
builtin_interfaces/Time stamp
string frame_id
================================================================================
MSG: geometry_msgs/Pose
Point position
Quaternion orientation
================================================================================
MSG: geometry_msgs/Point
float64 x
float64 y
float64 z
================================================================================
MSG: geometry_msgs/Quaternion
float64 x 0
float64 w 1
"""
STATE = "uint8 OK=1  # a constant\nuint8 state\nstring state_str\nfloat64[2] pair\nfloat32[] more\nuint8[] data\n"


def text(s: str) -> bytes:
    return struct.pack("<I", len(s)) + s.encode()


def record(code: int, body: bytes) -> bytes:
    return struct.pack("<BQ", code, len(body)) + body


def recording(path, chunks: list[list[tuple[int, int, int, bytes]]], channels: dict[int, tuple[str, str]]) -> None:
    """chunks of (channel, sequence, time, payload); channels: id to (topic, definition)."""
    known = b"".join(record(3, struct.pack("<H", i) + text(f"pkg/msg/T{i}") + text("ros2msg") + text(d)) + record(4, struct.pack("<HH", i, i) + text(t) + text("cdr") + struct.pack("<I", 0)) for i, (t, d) in channels.items())
    out, index, counts = b"\x89MCAP0\r\n" + record(1, text("ros2") + text("test")), b"", {}
    times = [m[2] for c in chunks for m in c]
    for n, chunk in enumerate(chunks):
        inner = known + b"".join(record(5, struct.pack("<HIQQ", ch, seq, at, at) + data) for ch, seq, at, data in chunk)
        kind, packed = ("zstd", zstandard.compress(inner)) if n % 2 == 0 else ("", inner)
        body = record(6, struct.pack("<QQQI", 0, 0, len(inner), 0) + text(kind) + struct.pack("<Q", len(packed)) + packed)
        within = b"".join(struct.pack("<HQ", ch, 0) for ch in sorted({m[0] for m in chunk}))
        index += record(8, struct.pack("<QQQQ", 0, 0, len(out), len(body)) + struct.pack("<I", len(within)) + within + struct.pack("<Q", 0) + text(kind) + struct.pack("<QQ", len(packed), len(inner)))
        out += body
        for m in chunk:
            counts[m[0]] = counts.get(m[0], 0) + 1
    listed = b"".join(struct.pack("<HQ", k, v) for k, v in counts.items())
    stats = record(11, struct.pack("<QHIIIIQQ", len(times), 2, 2, 0, 0, len(chunks), min(times), max(times)) + struct.pack("<I", len(listed)) + listed)
    out += record(15, struct.pack("<I", 0))
    start = len(out)
    out += known + index + stats + record(2, struct.pack("<QQI", start, 0, 0)) + b"\x89MCAP0\r\n"
    path.write_bytes(out)


def pose(sec: int, x: float) -> bytes:
    body = struct.pack("<iI", sec, 500_000_000) + struct.pack("<I", 4) + b"map\0"
    body += b"\0" * (-len(body) % 8) + struct.pack("<5d", x, 2.0, 3.0, 0.0, 1.0)
    return b"\0\1\0\0" + body


def state(n: int) -> bytes:
    body = struct.pack("<B", n) + b"\0" * 3 + struct.pack("<I", 3) + b"ok\0"
    body += b"\0" * (-len(body) % 8) + struct.pack("<2d", 1.5, 2.5) + struct.pack("<I2f", 2, 0.5, 0.25) + struct.pack("<I", 3) + b"\1\2\3"
    return b"\0\1\0\0" + body


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("recordings")
    chunks = [[(1, i, 100 + i, pose(i, float(i))) for i in range(5)], [(2, 0, 200, state(7)), (1, 5, 201, pose(5, 5.0))], [(2, 1, 202, state(8))]]
    recording(out / "a.mcap", chunks, {1: ("/camera/pose", POSE), 2: ("/state", STATE)})
    recording(out / "b.mcap", chunks[:1], {1: ("/camera/pose", POSE), 2: ("/state", STATE)})
    return out


def test_messages_and_summary(spark, folder):
    register(spark)
    d = spark.read.format("recording").option("topics", "/camera/pose").option("partitionBytes", 1).load(str(folder))
    got = decoded(d, "pose").select(F.regexp_extract("path", r"(\w)\.mcap", 1).alias("f"), "sequence", seconds().alias("ts"), "header.frame_id", "pose.position.x", "pose.orientation.w", "pose.orientation.z")
    want = [("a", i, i + 0.5, "map", float(i), 1.0, None) for i in range(6)] + [("b", i, i + 0.5, "map", float(i), 1.0, None) for i in range(5)]
    assert sorted(map(tuple, got.collect())) == want
    every = spark.read.format("recording").load(str(folder / "a*"))
    assert every.groupBy("topic").count().rdd.collectAsMap() == {"/camera/pose": 6, "/state": 2}
    other = decoded(every.where("topic = '/state'"), "state int, state_str string, pair array<double>, more array<float>, data binary, missing int").orderBy("sequence").collect()
    assert [tuple(r)[3:] for r in other] == [(n, "ok", [1.5, 2.5], [0.5, 0.25], bytearray(b"\1\2\3"), None) for n in (7, 8)]
    s = spark.read.format("recording_summary").load(str(folder / "a.mcap")).orderBy("topic").collect()
    assert [tuple(r)[1:] for r in s] == [("/camera/pose", 6, 8, 100, 202), ("/state", 2, 8, 100, 202)]


def test_missing_and_broken_files(spark, folder, tmp_path):
    register(spark)
    with pytest.raises(Exception, match="no recording file"):
        spark.read.format("recording").load(str(tmp_path / "none.mcap")).count()
    (tmp_path / "bad.mcap").write_bytes(b"x" * 100)
    with pytest.raises(Exception, match="not a recording file"):
        spark.read.format("recording").load(str(tmp_path / "bad.mcap")).count()


def test_definition_fields():
    assert fields_of(STATE)[""] == [("state", "uint8", -1), ("state_str", "string", -1), ("pair", "float64", 2), ("more", "float32", None), ("data", "uint8", None)]
    assert fields_of(POSE)["Quaternion"] == [("x", "float64", -1), ("w", "float64", -1)]


def test_clouds_and_paths(spark):
    raw = b"".join(struct.pack("<fffI", x, 1.0, 2.0, 0x010203) for x in (0.0, float("nan"), 2.0))
    fields = [("x", 0), ("y", 4), ("z", 8), ("rgb", 12)]
    rows = [("p", 1, 1, 3, fields, 16, bytearray(raw)), ("p", 2, 1, 3, fields[:3], 16, bytearray(raw)), ("p", 3, 0, 0, fields, 16, bytearray())]
    d = spark.createDataFrame(rows, "path string, sequence bigint, height int, width int, fields array<struct<name:string,offset:int>>, point_step int, data binary")
    got = sorted(tuple(r)[1:] for r in cloud_points(d).where("sequence = 1").collect())
    assert got == [(1, 0, 0.0, 1.0, 2.0, 1, 2, 3), (1, 2, 2.0, 1.0, 2.0, 1, 2, 3)]
    assert [r["r"] for r in cloud_points(d).where("sequence = 2").collect()] == [None, None]
    path = spark.sql("SELECT 'p' AS path, 1L AS sequence, array(named_struct('header', named_struct('stamp', named_struct('sec', 1, 'nanosec', 500000000L)), 'pose', named_struct('position', named_struct('x', 1D, 'y', 2D, 'z', 3D), 'orientation', named_struct('x', 0D, 'y', 0D, 'z', 0D, 'w', 1D)))) AS poses")
    assert [tuple(r) for r in path_poses(path).collect()] == [("p", 1, 0, 1.5, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0)]


def test_episode(spark, tmp_path):
    frames = spark.range(7).select((F.col("id") % 2).alias("recording_id"), F.floor(F.col("id") / 2).alias("frame_idx"), F.col("id").cast("double").alias("ts"), F.col("id").cast("string").cast("binary").alias("image"))
    thumbs = middle_frames(frames)
    assert sorted((r["recording_id"], r["frame_idx"], bytes(r["image"])) for r in thumbs.collect()) == [(0, 2, b"4"), (1, 1, b"3")]
    depth = frames.select("recording_id", "frame_idx", "ts")
    m = export_episode(spark, {"frames": frames, "thumbnail": thumbs, "depth": depth, "imu": None}, str(tmp_path / "e"))
    states = {r["part"]: (r["state"], r["rows"]) for r in m.collect()}
    assert states["frames"] == ("saved", 7) and states["thumbnail"] == ("saved", 2) and states["depth"][0] == states["imu"][0] == "skipped"
    assert spark.read.parquet(str(tmp_path / "e/frames")).where("recording_id = 1").count() == 3
    with pytest.raises(ValueError, match="unknown"):
        export_episode(spark, {"other": frames}, str(tmp_path / "f"))


def test_ply(spark, tmp_path):
    v = spark.range(2 * 5).select((F.col("id") % 2).alias("mesh_id"), F.floor(F.col("id") / 2).alias("v_id"), *[(F.col("id") * k).alias(c) for k, c in enumerate("xyz", 1)], *[F.lit(k).alias(c) for k, c in enumerate("rgb", 1)])
    f = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 2, 3, 4)], "mesh_id bigint, f_id bigint, a bigint, b bigint, c bigint")
    listed = {r["mesh_id"]: r for r in write_ply(v, f, str(tmp_path / "ply")).collect()}
    assert listed["0"]["faces"] == 2 and listed["1"]["faces"] == 0
    head, body = (tmp_path / "ply/0.ply").read_bytes().split(b"end_header\n", 1)
    assert b"element vertex 5" in head and b"element face 2" in head
    points = np.frombuffer(body[: 5 * 15], np.dtype([("p", "<f4", 3), ("c", "u1", 3)]))
    assert points["p"][:, 0].tolist() == [0, 2, 4, 6, 8] and points["c"].tolist() == [[1, 2, 3]] * 5
    faces = np.frombuffer(body[5 * 15 :], np.dtype([("n", "u1"), ("i", "<i4", 3)]))
    assert faces["i"].tolist() == [[0, 1, 2], [2, 3, 4]]
