"""Sinks: a recording's tables as an episode folder with a manifest, and meshes as PLY files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts of an episode and their columns' types; other columns are written as they are.
PARTS = {
    "depth": {"ts": "double", "valid": "boolean", "raw": "binary"},
    "camera_pose": {"ts": "double", "translation": "array<float>", "rotation": "array<float>"},
    "imu": {"ts": "double", "acceleration": "array<float>", "angular_velocity": "array<float>", "orientation": "array<float>"},
    "hands": {"side": "string", "confidence": "float", "valid": "boolean", "joints": "array<float>"},
    "calibration": {"k": "array<double>", "d": "array<double>"},
    "frames": {"ts": "double", "image": "binary"},
    "thumbnail": {"image": "binary"},
}


def middle_frames(frames: DataFrame, by: str = "recording_id", order: str = "frame_idx") -> DataFrame:
    """Each recording's frame number n div 2, as its thumbnail."""
    n = frames.groupBy(by).agg(F.count("*").alias("_n")).select(by, F.floor(F.col("_n") / 2).alias(order))
    return frames.withColumn(order, F.col(order).cast("long")).join(n, [by, order])


def export_episode(spark: SparkSession, parts: dict[str, DataFrame | None], out_dir: str, by: str = "recording_id") -> DataFrame:
    """Writes the given parts, partitioned by recording, and the manifest (part, state, rows, reason), which it returns.

    A part that is missing, or lacks columns, is skipped with a reason; the others are written all the same.
    An unknown part raises. Writing again replaces the parts given.
    """
    unknown = sorted(set(parts) - set(PARTS))
    if unknown:
        raise ValueError(f"unknown parts: {unknown}")
    rows = []
    for name, kinds in PARTS.items():
        d = parts.get(name)
        lacking = [c for c in (by, *kinds) if d is not None and c not in d.columns]
        if d is None or lacking:
            rows.append((name, "skipped", 0, f"no columns {', '.join(lacking)}" if lacking else "not given"))
            continue
        d = d.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})
        d.write.mode("overwrite").option("compression", "zstd").partitionBy(by).parquet(f"{out_dir}/{name}")
        n = spark.read.parquet(f"{out_dir}/{name}").count()
        rows.append((name, "saved", n, None) if n else (name, "skipped", 0, "empty"))
    manifest = spark.createDataFrame(rows, "part string, state string, rows bigint, reason string").coalesce(1)
    manifest.write.mode("overwrite").json(f"{out_dir}/manifest")
    return manifest


@dataclass(frozen=True)
class Episode:
    """What a manifest tells: parts as tables, the state of each (state, rows, reason), attributes by part, and the version."""

    parts: dict[str, DataFrame]
    states: dict[str, tuple[str, int, str | None]]
    attributes: dict[str, dict]
    version: str


def save_episode(spark: SparkSession, parts: dict[str, DataFrame | None], out_dir: str, attributes: dict[str, dict] | None = None, by: str = "recording_id") -> Episode:
    """Writes parts as a new version of an episode, and gives them back as read_episode does.

    A version's parts are written beside the former ones; then its manifest takes the former one's place by a rename. Until
    then readers see the former episode, and if a part fails its new files go and the former episode stays whole. After it the
    former version's files are deleted. Parts are skipped as in export_episode. attributes (numbers and texts) are kept in the
    manifest by part, and rows per recording as the table `counts`.
    """
    unknown = sorted((set(parts) | set(attributes or {})) - set(PARTS))
    if unknown:
        raise ValueError(f"unknown parts: {unknown}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    version = uuid.uuid4().hex
    at = lambda *names: jvm.org.apache.hadoop.fs.Path("/".join([out_dir.rstrip("/"), *names]))
    files = at().getFileSystem(conf)
    former = read_episode(spark, out_dir).version if files.exists(at("manifest.json")) else None
    listed, counts = [], []
    try:
        for name, kinds in PARTS.items():
            d = parts.get(name)
            lacking = [c for c in (by, *kinds) if d is not None and c not in d.columns]
            if d is None or lacking:
                listed.append({"part": name, "state": "skipped", "rows": 0, "reason": f"no columns {', '.join(lacking)}" if lacking else "not given"})
                continue
            d = d.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})
            path = f"{out_dir.rstrip('/')}/{version}/{name}"
            d.write.option("compression", "zstd").partitionBy(by).parquet(path)
            own = spark.read.schema(d.schema).parquet(path).groupBy(by).agg(F.count("*").alias("rows"))
            counts.append(own.select(F.lit(name).alias("part"), F.col(by).cast("string").alias(by), "rows"))
            n = own.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
            listed.append({"part": name, "state": "saved" if n else "skipped", "rows": n, "reason": None if n else "empty", "schema": d.schema.jsonValue()})
        if counts:
            reduce(DataFrame.unionByName, counts).coalesce(1).write.parquet(f"{out_dir.rstrip('/')}/{version}/counts")
        manifest = {"version": version, "by": by, "parts": listed, "attributes": attributes or {}, "counts": bool(counts)}
        out = files.create(at(version, "manifest.json"), True)
        out.write(json.dumps(manifest).encode())
        out.close()
        over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at().toUri() if "://" in out_dir else files.getUri(), conf).rename(at(version, "manifest.json"), at("manifest.json"), over)
    except BaseException:
        files.delete(at(version), True)
        raise
    if former:
        files.delete(at(former), True)
    return read_episode(spark, out_dir)


def read_episode(spark: SparkSession, out_dir: str) -> Episode:
    """The episode of the manifest in a folder: its saved parts with the columns and types they were written with, and `counts`
    (part, by, rows). Raises where there is no manifest."""
    root = out_dir.rstrip("/")
    m = json.loads(spark.read.option("wholetext", True).text(f"{root}/manifest.json").first()[0])
    parts = {p["part"]: spark.read.schema(StructType.fromJson(p["schema"])).parquet(f"{root}/{m['version']}/{p['part']}") for p in m["parts"] if p["state"] == "saved"}
    if m["counts"]:
        parts["counts"] = spark.read.schema(f"part string, `{m['by']}` string, rows bigint").parquet(f"{root}/{m['version']}/counts")
    return Episode(parts, {p["part"]: (p["state"], p["rows"], p["reason"]) for p in m["parts"]}, m["attributes"], m["version"])


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def write_ply(vertices: DataFrame, faces: DataFrame, out_dir: str, by: str = "mesh_id") -> DataFrame:
    """One binary PLY file per mesh; returns (mesh_id, path, vertices, faces).

    vertices: by, v_id, x, y, z and, if there, r, g, b; faces: by, a, b, c as vertex numbers from 0 (see
    spatial.compact). Rows come sorted and are written batch by batch, so memory doesn't grow with a mesh.
    A file appears under its name only when whole, so a task that is run again does no harm. A null mesh has no file.
    """
    colour = all(c in vertices.columns for c in ("r", "g", "b"))
    shades = [F.col(c).cast("int").alias(c) for c in ("r", "g", "b")] if colour else [F.lit(None).cast("int").alias(c) for c in ("r", "g", "b")]
    none: list[Column] = [F.lit(None).cast("long").alias(c) for c in ("fa", "fb", "fc")]
    v = vertices.where(F.col(by).isNotNull()).select(F.col(by).cast("string").alias("mesh"), F.lit(0).alias("kind"), F.col("v_id").cast("long").alias("at"), *[F.col(c).cast("float").alias(c) for c in "xyz"], *shades, *none)
    f = faces.where(F.col(by).isNotNull()).select(F.col(by).cast("string").alias("mesh"), F.lit(1).alias("kind"), F.col("f_id").cast("long").alias("at"), *[F.lit(None).cast("float").alias(c) for c in "xyz"], *[F.lit(None).cast("int").alias(c) for c in ("r", "g", "b")], *[F.col(c).cast("long").alias(f"f{c}") for c in "abc"])
    rows = v.unionByName(f)
    sizes = rows.groupBy("mesh").agg(F.count(F.when(F.col("kind") == 0, 1)).alias("nv"), F.count(F.when(F.col("kind") == 1, 1)).alias("nf"))
    rows = rows.join(sizes, "mesh").repartition("mesh").sortWithinPartitions("mesh", "kind", "at")
    point = np.dtype([(c, "<f4") for c in "xyz"] + ([(c, "u1") for c in ("r", "g", "b")] if colour else []))
    face = np.dtype([("n", "u1"), ("i", "<i4", 3)])

    def head(nv: int, nf: int) -> bytes:
        lines = ["ply", "format binary_little_endian 1.0", f"element vertex {nv}", *[f"property float {c}" for c in "xyz"]]
        lines += [f"property uchar {c}" for c in ("red", "green", "blue")] if colour else []
        lines += [f"element face {nf}", "property list uchar int vertex_indices"] if nf else []
        return ("\n".join([*lines, "end_header"]) + "\n").encode()

    def packed(part: pa.RecordBatch) -> bytes:
        column = lambda c: part.column(c).to_numpy(zero_copy_only=False)
        kind, out = column("kind"), b""
        for k, shape in ((0, point), (1, face)):
            rows = np.flatnonzero(kind == k)
            data = np.zeros(len(rows), shape)
            if not len(rows):
                continue
            if k:
                data["n"], data["i"] = 3, np.stack([column(c)[rows] for c in ("fa", "fb", "fc")], 1)
            else:
                for c in point.names:
                    data[c] = column(c)[rows]
            out += data.tobytes()
        return out

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(out_dir)
        store.create_dir(folder)
        mesh, sink, done = None, None, None

        def finish() -> Iterator[pa.RecordBatch]:
            if sink is not None:
                sink.close()
                store.move(done[0], done[1])
                yield pa.RecordBatch.from_pylist([{"mesh": mesh, "path": done[1], "vertices": done[2], "faces": done[3]}])

        for batch in batches:
            names = batch.column("mesh").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)] if len(names) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if names[lo] != mesh:
                    yield from finish()
                    mesh, nv, nf = names[lo], batch.column("nv")[lo].as_py(), batch.column("nf")[lo].as_py()
                    done = (f"{folder}/.{uuid.uuid4().hex}", f"{folder}/{mesh}.ply", nv, nf)
                    sink = store.open_output_stream(done[0])
                    sink.write(head(nv, nf))
                sink.write(packed(batch.slice(lo, hi - lo)))
        yield from finish()

    # Written once, whatever is done with the returned rows.
    listed = rows.mapInArrow(write, "mesh string, path string, vertices bigint, faces bigint")
    listed.write.mode("overwrite").parquet(f"{out_dir}/_meshes")
    return rows.sparkSession.read.parquet(f"{out_dir}/_meshes").withColumnRenamed("mesh", by)
