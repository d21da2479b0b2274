"""Dense coloured clouds from depth frames: sampling, back-projection, exclusion, colour and voxels as one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import geometry as G
from strandline.operators.colour import Lens
from strandline.operators.spatial import XYZ, voxels


@dataclass(frozen=True)
class Cloud:
    """Every n-th frame, points of a frame, metres around the camera that are left out (0: none), voxel edge (0: no voxels), depth bounds."""

    every_n: int = 10
    most_points: int = 5000
    clear: float = 1.0
    voxel: float = 0.02
    near: float = 0.3
    far: float = 5.0
    seed: int = 0


def sample_exactly(df: DataFrame, by: Sequence[str], k: int, draw: Column, ties: Sequence[str], bits: int = 63, buckets: int = 12) -> DataFrame:
    """k rows of each group of by, or all where it has no more: those with the least draw, a number of `bits` bits, then by ties.

    The draw's leading bits name one of 2**buckets buckets. Counts by bucket tell which are taken whole and which one
    holds the border; only the border bucket's rows are ranked, so no window holds a group. Null groups are a group.
    """
    d = df.withColumn("_draw", draw).withColumn("_b", F.shiftright("_draw", max(0, bits - buckets)))
    counts = d.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = counts.withColumn("_before", before).where(F.col("_before") < k)
    quota = quota.select(*[F.col(c).alias(f"_s{c}") for c in by], F.col("_b").alias("_sb"), (k - F.col("_before")).alias("_take"), (F.col("_before") + F.col("_n") > k).alias("_border"))
    same = F.col("_b") == F.col("_sb")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_s{c}"))
    d = d.join(quota, same)
    rank = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_draw", *ties))
    border = d.where("_border").withColumn("_rank", rank).where(F.col("_rank") <= F.col("_take")).drop("_rank")
    return d.where("not _border").unionByName(border).select(*df.columns)


def dense_cloud(depth: DataFrame, frames: DataFrame, pixels: DataFrame, lens: Lens, size: tuple[int, int], c: Cloud = Cloud(), values: tuple[str, ...] = ("r", "g", "b"), link: Column | None = None, draw: Column | None = None, bits: int = 63) -> DataFrame:
    """Coloured points of the frames with a pose, in world axes: voxels (ix, iy, iz, x, y, z, *values, n) or, without voxels, points.

    depth (frame, u, v, mm) is the raster of the camera `lens`; pixels (frame, pu, pv, *values) that of a colour image of
    `size` (width, height). Of a frame's valid pixels most_points are taken by `draw`, a hash of seed, frame and pixel unless
    another is given. A pixel without a colour is left out.
    """
    poses = frames.where((F.col("frame") % c.every_n == 0) & F.col("rot").isNotNull() & F.col("at").isNotNull()).select("frame", "rot", "at")
    z = F.col("mm") / 1000.0
    valid = depth.where((F.col("frame") % c.every_n == 0) & (z > c.near) & (z < c.far)).join(poses.select("frame"), "frame", "left_semi")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(c.seed), "frame", "v", "u"), 1) if draw is None else draw
    taken = sample_exactly(valid.select("frame", "u", "v", "mm"), ["frame"], c.most_points, draw, ["v", "u"], bits)
    d = taken.join(poses, "frame").withColumn("p", G.optical_to_world(G.back_project(F.col("u"), F.col("v"), F.col("mm"), lens.fx, lens.fy, lens.cx, lens.cy), F.col("rot"), F.col("at"), link))
    if c.clear > 0:
        d = d.where(G.norm(G.sub(F.col("p"), F.col("at"))) > c.clear)
    clip = lambda x, wide, deep: F.greatest(F.lit(0), F.least(F.lit(wide - 1), (F.col(x) * wide / deep).cast("long"))).cast("long")
    d = d.select("frame", clip("u", size[0], lens.width).alias("pu"), clip("v", size[1], lens.height).alias("pv"), *[G.at(F.col("p"), i).alias(n) for i, n in enumerate(XYZ)])
    d = d.join(pixels.select("frame", F.col("pu").cast("long").alias("pu"), F.col("pv").cast("long").alias("pv"), *values), ["frame", "pu", "pv"])
    return voxels(d, c.voxel, values) if c.voxel > 0 else d.select(*XYZ, *values)
