"""Meshes as vertex and face tables: cleaning, smoothing, subdivision, plane search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.repair import close_holes, split_pinched, thin_edges
from strandline.operators.spatial import XYZ, compact, face_components, with_shape


def face_edges(faces: DataFrame) -> DataFrame:
    """(lo, hi, opposite) for each side of each face."""
    sides = [F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi"), F.col(r).alias("opposite")) for p, q, r in (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b"))]
    return faces.select(F.explode(F.array(*sides)).alias("e")).select("e.*")


def _placed(d: DataFrame, vertices: DataFrame, key: str, prefix: str) -> DataFrame:
    return d.join(vertices.select(F.col("v_id").alias(key), *[F.col(n).alias(prefix + n) for n in XYZ]), key)


def _neighbours(edges: DataFrame) -> DataFrame:
    """Both directions of edges (lo, hi, border)."""
    return edges.select(F.explode(F.array(F.struct(F.col("lo").alias("v_id"), F.col("hi").alias("other")), F.struct(F.col("hi").alias("v_id"), F.col("lo").alias("other")))).alias("e"), "border").select("e.*", "border")


def _sums(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Per vertex: whether it is on a border, how many neighbours count, and the sum of their positions. On a border, border neighbours count."""
    near = _placed(_neighbours(edges), vertices, "other", "o")
    counted = [F.count("*").alias("n"), F.count(F.when(F.col("border"), 1)).alias("nb")]
    g = near.groupBy("v_id").agg(*counted, *[F.sum(f"o{c}").alias(f"s{c}") for c in XYZ], *[F.sum(F.when(F.col("border"), F.col(f"o{c}"))).alias(f"b{c}") for c in XYZ])
    on = F.col("nb") > 0
    return g.select("v_id", on.alias("border"), F.when(on, F.col("nb")).otherwise(F.col("n")).alias("k"), *[F.when(on, F.col(f"b{c}")).otherwise(F.col(f"s{c}")).alias(f"s{c}") for c in XYZ])


def _edges(faces: DataFrame) -> DataFrame:
    return face_edges(faces).groupBy("lo", "hi").agg(F.count("*").alias("n")).select("lo", "hi", (F.col("n") != 2).alias("border"))


def smooth(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Each vertex moves to the mean of itself and its neighbours; on a border, of its border neighbours. Others stay."""
    s = _sums(_edges(faces), vertices)
    return vertices.join(s, "v_id", "left").select("v_id", *[F.coalesce((F.col(c) + F.col(f"s{c}")) / (F.col("k") + 1), F.col(c)).alias(c) for c in XYZ])


def subdivide(vertices: DataFrame, faces: DataFrame, block: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """One round of Loop subdivision: each face becomes four; old vertices keep their ids, edge points follow them.

    Edges that aren't shared by exactly two faces are borders and keep their shape among themselves. Edge points
    are numbered in the order of their edges, per block of ids with one row per block as offset.
    """
    sides = _placed(face_edges(faces), vertices, "opposite", "o").groupBy("lo", "hi").agg(F.count("*").alias("n"), *[F.sum(f"o{c}").alias(f"o{c}") for c in XYZ])
    sides = _placed(_placed(sides, vertices, "lo", "p"), vertices, "hi", "q")
    ends = lambda c: F.col(f"p{c}") + F.col(f"q{c}")
    points = sides.select("lo", "hi", (F.col("n") != 2).alias("border"), *[F.when(F.col("n") == 2, 0.375 * ends(c) + 0.125 * F.col(f"o{c}")).otherwise(0.5 * ends(c)).alias(c) for c in XYZ])

    numbered = points.withColumn("_b", F.floor(F.col("lo") / block))
    sizes = numbered.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = numbered.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy("lo", "hi"))).join(sizes.select("_b", before.alias("_start")), "_b")
    top = vertices.agg((F.max("v_id") + 1).alias("_top"))  # a single row
    numbered = numbered.join(F.broadcast(top)).select("lo", "hi", (F.col("_top") + F.col("_start") + F.col("_i") - 1).cast("long").alias("v_id"), *XYZ)

    s = _sums(points.select("lo", "hi", "border"), vertices)
    share = (0.625 - F.pow(0.375 + F.cos(2 * np.pi / F.col("k")) / 4, F.lit(2.0))) / F.col("k")

    def moved(c: str) -> Column:
        inner = (1 - F.col("k") * share) * F.col(c) + share * F.col(f"s{c}")
        edge = F.when(F.col("k") == 2, 0.75 * F.col(c) + 0.125 * F.col(f"s{c}")).otherwise(F.col(c))
        return F.when(F.col("k").isNull(), F.col(c)).when(F.col("border"), edge).otherwise(inner).alias(c)

    old = vertices.select(F.col("v_id").cast("long").alias("v_id"), *[F.col(c).cast("double").alias(c) for c in XYZ]).join(s, "v_id", "left").select("v_id", *[moved(c) for c in XYZ])
    f = faces
    for p, q in ("ab", "bc", "ca"):
        mid = numbered.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("v_id").alias(p + q))
        f = f.join(mid, (F.least(p, q) == F.col("_lo")) & (F.greatest(p, q) == F.col("_hi"))).drop("_lo", "_hi")
    parts = [("a", "ab", "ca"), ("ab", "b", "bc"), ("ca", "bc", "c"), ("ab", "bc", "ca")]
    new = F.array(*[F.struct((4 * F.col("f_id") + i).alias("f_id"), *[F.col(x).cast("long").alias(n) for x, n in zip(part, "abc", strict=True)]) for i, part in enumerate(parts)])
    return old.unionByName(numbered.select("v_id", *XYZ)), f.select(F.explode(new).alias("f")).select("f.*")


def clean(vertices: DataFrame, faces: DataFrame, least_faces: int = 2000, least_size: float = 0.15, smoothing: int = 1, most_hole: int = 0) -> tuple[DataFrame, DataFrame]:
    """Merged vertices, no empty or repeated faces, no small parts, then smoothing; vertices are numbered anew.

    A part goes with fewer than least_faces faces or a diagonal under least_size of the mesh's. Ties: the smallest
    id stands for equal positions and equal faces. Vertices with a null or non-finite coordinate go with their faces.
    With most_hole, edges keep their two largest faces, pinched vertices are doubled, and after small parts are gone
    holes of at most so many edges are closed; without, nothing of this is done.
    """
    whole = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in XYZ]
    v = vertices.where(whole[0] & whole[1] & whole[2])
    same = v.groupBy(*XYZ).agg(F.min("v_id").alias("rep"))
    merged = v.join(same, list(XYZ)).select("v_id", "rep")
    f = faces.select("f_id", "a", "b", "c")
    for corner in "abc":
        f = f.join(merged.withColumnRenamed("v_id", corner), corner).drop(corner).withColumnRenamed("rep", corner)
    f = f.where("a <> b and b <> c and c <> a")
    kept = same.select(F.col("rep").alias("v_id"), *XYZ)
    f = with_shape(f, kept).where("area > 0").select("f_id", "a", "b", "c")
    f = f.groupBy(F.array_sort(F.array("a", "b", "c")).alias("_k")).agg(F.min_by(F.struct("f_id", "a", "b", "c"), "f_id").alias("f")).select("f.*").checkpoint()
    if most_hole:
        kept, f = split_pinched(kept, thin_edges(kept, f).checkpoint())
        kept, f = kept.checkpoint(), f.checkpoint()
    part = face_components(f)
    in_part = f.join(part.withColumnRenamed("v_id", "a"), "a")
    counts = in_part.groupBy("component").agg(F.count("*").alias("n"))

    def diagonal() -> Column:
        spans = [F.max(c) - F.min(c) for c in XYZ]
        return F.sqrt(spans[0] * spans[0] + spans[1] * spans[1] + spans[2] * spans[2])

    placed = part.join(kept, "v_id")
    sizes = placed.groupBy("component").agg(diagonal().alias("d")).join(F.broadcast(placed.agg(diagonal().alias("all"))))
    large = sizes.join(counts, "component").where((F.col("n") >= least_faces) & (F.col("d") >= least_size * F.col("all"))).select("component")
    f = in_part.join(large, "component", "left_semi").select("f_id", "a", "b", "c")
    if most_hole:
        f = close_holes(f.checkpoint(), most_hole)
    numbered, f = compact(kept, f)
    v = numbered.select(F.col("new_id").alias("v_id"), *XYZ)
    for _ in range(smoothing):
        v = smooth(v, f)
    return v, f


#: Steps of a point's score in the search for planes.
STEPS = 1 << 20


def plane_distance(eq: tuple[float, float, float, float]) -> Column:
    """Distance of a point from a plane with unit normal."""
    return F.abs(F.col("x") * eq[0] + F.col("y") * eq[1] + F.col("z") * eq[2] + eq[3])


def planes(points: DataFrame, most: int = 15, near: float = 0.03, trials: int = 2000, least: int = 200, share: float = 0.015, key: str = "pt_id") -> list[tuple[tuple[float, float, float, float], int]]:
    """Planes ((a, b, c, d), points near it), found one after the other by random samples of three points.

    The samples are a bounded feature of the method, drawn by a hash of the key, so a run can be repeated. Every
    trial counts over all points that are left: each batch counts for all trials, sums meet in one aggregate.
    The best trial has the highest sum of 1 - (distance / near)^2 over its points, in whole steps, so sums don't depend on
    an order: by their mere number, a plane that is tilted so as to cut others gains their points and still holds its own.
    The search ends when the best trial has fewer than least points or than that share of all.
    """
    left = points.where("x is not null and y is not null and z is not null").select(key, *[F.col(c).cast("double").alias(c) for c in XYZ])
    bound = max(least, int(np.ceil(share * left.count())))
    found: list = []
    for turn in range(most):
        rows = left.orderBy(F.xxhash64(F.col(key), F.lit(turn)), key).limit(3 * trials).select(*XYZ).collect()
        if len(rows) < 3:
            break
        p = np.array(rows[: len(rows) // 3 * 3], float).reshape(-1, 3, 3)
        normal = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
        size = np.linalg.norm(normal, axis=1)
        some = size > 1e-12
        normal, p = normal[some] / size[some, None], p[some]
        if not len(normal):
            break
        offset = -(normal * p[:, 0]).sum(1)

        def count(batches: Iterator[pa.RecordBatch], normal=normal, offset=offset) -> Iterator[pa.RecordBatch]:
            total, score = np.zeros(len(normal), np.int64), np.zeros(len(normal), np.int64)
            for batch in batches:
                xyz = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in XYZ], 1)
                for i in range(0, len(xyz), 1024):
                    apart = np.abs(xyz[i : i + 1024] @ normal.T + offset)
                    total += (apart < near).sum(0)
                    score += np.where(apart < near, np.rint((1 - (apart / near) ** 2) * STEPS), 0).sum(0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(score)], names=["trial", "n", "score"])

        best = left.select(*XYZ).mapInArrow(count, "trial bigint, n bigint, score bigint").groupBy("trial").agg(F.sum("n").alias("n"), F.sum("score").alias("score")).orderBy(F.desc("score"), "trial").first()
        if best is None or best["n"] < bound:
            break
        eq = (*map(float, normal[best["trial"]]), float(offset[best["trial"]]))
        found.append((eq, best["n"]))
        left = left.where(plane_distance(eq) >= near)
    return found
