"""Refining a scanned mesh: clutter on the table goes, the table is filled, and all stages in order.

Plane equations are few (a bounded number) and known to the driver; vertices and faces are tables throughout.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.geometry import brighten
from strandline.operators import mesh as M
from strandline.operators.colour import Colouring, Lens, colourise
from strandline.operators.detections import outline
from strandline.operators.quantiles import cut_lineage
from strandline.operators.series import numbered
from strandline.operators.spatial import XYZ, compact, grow, near_any, occupancy, shrink, vertex_normals

Plane = tuple[float, float, float, float]


@dataclass(frozen=True)
class Clutter:
    """Cosines that tell level planes and walls, the least points of a wall, metres around walls that are spared, the
    band of heights above the table, how far the table's outline is widened, and how many corners it may have."""

    up: tuple[float, float, float] = (0.0, 1.0, 0.0)
    near: float = 0.03
    level: float = 0.85
    upright: float = 0.30
    wall_least: int = 300
    wall_radius: float = 0.06
    low: float = 0.01
    high: float = 0.80
    pad: float = 1.05
    most_corners: int = 1 << 14


@dataclass(frozen=True)
class Fill:
    """Edge of the grid that is laid, of the cells that count points, least points of a cell, rounds of closing and
    growing, and the distance to what is there already."""

    grid: float = 0.03
    cell: float = 0.05
    least: int = 2
    close: int = 2
    widen: int = 1
    apart: float = 0.05


@dataclass(frozen=True)
class Stripped:
    """Vertices and faces numbered anew, ids of the vertices taken away, and the table: its plane and its points, if there is one."""

    vertices: DataFrame
    faces: DataFrame
    clutter: DataFrame | None = None
    table: Plane | None = None
    table_points: DataFrame | None = None


def plane_axes(eq: Plane, up: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(origin, u, v, n) of a plane; n points up, u and v follow from the equation as it is."""
    size = float(np.linalg.norm(eq[:3]))
    n = np.array(eq[:3], float) / size
    u = np.cross(n, (1.0, 0.0, 0.0) if abs(n[0]) < 0.9 else (0.0, 1.0, 0.0))
    u /= np.linalg.norm(u)
    return -n * eq[3] / size, u, np.cross(n, u), n if n @ np.array(up) >= 0 else -n


def along(axis: np.ndarray, origin: np.ndarray) -> Column:
    return reduce(Column.__add__, [(F.col(n) - float(o)) * float(a) for n, a, o in zip(XYZ, axis, origin, strict=True)])


def first_plane(planes: Sequence[Plane], near: float) -> Column:
    """The number of the first plane that a point is near to; null for none. The planes were found in this order."""
    return F.coalesce(*[F.when(M.plane_distance(eq) < near, i) for i, eq in enumerate(planes)])


def choose_table(planes: Sequence[tuple[Plane, int]], c: Clutter) -> tuple[int | None, list[int]]:
    """Numbers of the table's plane and of the walls. Of the level planes the lowest isn't the table, nor, of three or more, the highest."""
    up, level, walls = np.array(c.up), [], []
    for i, (eq, n) in enumerate(planes):
        normal = np.array(eq[:3]) / (np.linalg.norm(eq[:3]) + 1e-9)
        turn = abs(float(normal @ up))
        if turn > c.level:
            level.append((float(-eq[3] * (normal @ up)), i, n))
        elif turn < c.upright and n >= c.wall_least:
            walls.append(i)
    if len(level) < 2:
        return None, walls
    level.sort()
    return max(level[1:-1] if len(level) > 2 else level[1:], key=lambda x: x[2])[1], walls


def outline_of(points: DataFrame, most: int) -> np.ndarray:
    """Corners (p, q) of the hull of a table of points. Tasks cut their points down to corners, twice, before the few that
    are left meet. Raises if they are more than `most`."""

    def corners(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = np.zeros((0, 2))
        for frame in frames:
            both = np.concatenate((kept, frame[["p", "q"]].to_numpy()))
            kept = outline(both) if len(both) else both
        yield pd.DataFrame({"p": kept[:, 0], "q": kept[:, 1]})

    cut = points.select("p", "q").mapInPandas(corners, "p double, q double").repartition(16, "p", "q").mapInPandas(corners, "p double, q double")
    rows = cut.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError("the outline has too many corners")
    return outline(rows[["p", "q"]].to_numpy()) if len(rows) else np.zeros((0, 2))


def within(corners: np.ndarray, p: Column, q: Column) -> Column:
    """Whether a point lies within a convex outline: on the inner side of all its edges."""
    x, y = corners[:, 0], corners[:, 1]
    turn = 1.0 if (x * np.roll(y, -1) - y * np.roll(x, -1)).sum() >= 0 else -1.0
    edges = [(turn * float(b[1] - a[1]), turn * float(a[0] - b[0]), turn * float((b[1] - a[1]) * a[0] + (a[0] - b[0]) * a[1])) for a, b in zip(corners, np.roll(corners, -1, axis=0))]
    sides = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in edges])
    return F.forall(sides, lambda e: e["a"] * p + e["b"] * q <= e["c"])


def strip_clutter(vertices: DataFrame, faces: DataFrame, planes: Sequence[tuple[Plane, int]], c: Clutter = Clutter()) -> Stripped:
    """The mesh without what stands on its table; planes as found by mesh.planes over its vertices.

    Vertices over the table's widened outline and within the band of heights go, but for those near a wall's points; faces
    with a corner of them go, and vertices without a face. Without a second level plane, or with an outline of under three
    corners, the mesh is returned as it is. Vertices with null coordinates are near no plane and over no table.
    """
    table, walls = choose_table(planes, c)
    if table is None:
        return Stripped(vertices, faces)
    eq = planes[table][0]
    at = vertices.select("v_id", *XYZ, first_plane([p for p, _ in planes], c.near).alias("plane"))
    own = at.where(F.col("plane") == table).select(*XYZ)
    origin, u, v, n = plane_axes(eq, c.up)
    corners = outline_of(own.select(along(u, origin).alias("p"), along(v, origin).alias("q")), c.most_corners)
    if len(corners) < 3:
        return Stripped(vertices, faces, None, eq, own)
    corners = corners.mean(0) + (corners - corners.mean(0)) * c.pad
    height = along(n, origin)
    clutter = at.where((height > c.low) & (height < c.high) & within(corners, along(u, origin), along(v, origin))).select("v_id", *XYZ)
    if walls:
        clutter = near_any(clutter, at.where(F.col("plane").isin(walls)), c.wall_radius, "left_anti", "v_id")
    clutter = clutter.select("v_id")
    hit = faces.select("f_id", F.explode(F.array("a", "b", "c")).alias("v_id")).join(clutter, "v_id", "left_semi").select("f_id").distinct()
    kept = faces.join(hit, "f_id", "left_anti")
    left, kept = compact(vertices, kept)
    left = left.drop("v_id").withColumnRenamed("new_id", "v_id")
    return Stripped(left.select("v_id", *[x for x in left.columns if x != "v_id"]), kept, clutter, eq, own)


def fill_table(eq: Plane, points: DataFrame, existing: DataFrame, f: Fill = Fill(), up: Sequence[float] = (0.0, 1.0, 0.0)) -> tuple[DataFrame, DataFrame]:
    """A flat patch (v_id, x, y, z, nx, ny, nz), (f_id, a, b, c) over the cells of the plane that hold points.

    A grid is laid over the cells, closed and grown; its points that are near existing vertices are left out. Each square of
    the grid with four points makes two faces, with three one. (A triangulation that also bridges single missing points
    would close those holes; here they stay open.) Without any point both tables are empty.
    """
    origin, u, v, n = plane_axes(eq, up)
    flat = points.select(along(u, origin).alias("x"), along(v, origin).alias("y"))
    low = flat.agg(F.min("x").alias("x"), F.min("y").alias("y")).first()
    low = [(low[k] or 0.0) - f.cell * 5 for k in ("x", "y")]
    mask = occupancy(flat.select((F.col("x") - low[0]).alias("x"), (F.col("y") - low[1]).alias("y")), f.cell, f.least).select("ix", "iy")
    for _ in range(f.close):
        mask = grow(mask)
    for _ in range(f.close):
        mask = shrink(mask)
    for _ in range(f.widen):
        mask = grow(mask)
    reach = lambda i: F.sequence(F.floor(F.col(i) * f.cell / f.grid) - 1, F.floor((F.col(i) + 1) * f.cell / f.grid) + 1)
    laid = mask.withColumn("k", F.explode(reach("ix"))).where(F.floor(F.col("k") * f.grid / f.cell) == F.col("ix"))
    laid = laid.withColumn("l", F.explode(reach("iy"))).where(F.floor(F.col("l") * f.grid / f.cell) == F.col("iy")).where("k >= 0 and l >= 0")
    p, q = F.col("k") * f.grid + low[0], F.col("l") * f.grid + low[1]
    laid = laid.select("k", "l", (F.col("l") * (1 << 31) + F.col("k")).alias("spot"), *[(float(origin[i]) + p * float(u[i]) + q * float(v[i])).alias(x) for i, x in enumerate(XYZ)])
    laid = near_any(laid, existing, f.apart, "left_anti", "spot")
    laid = numbered(laid.withColumn("one", F.lit(0)), ["one"], ["spot"], "v_id", 1 << 40)
    squares = F.array(*[F.struct((F.col("k") - i).alias("k"), (F.col("l") - j).alias("l"), F.lit(2 * j + i).alias("corner")) for j in (0, 1) for i in (0, 1)])
    of = laid.select("v_id", F.explode(squares).alias("s")).select("v_id", "s.*")
    of = of.groupBy("k", "l").agg(*[F.max(F.when(F.col("corner") == i, F.col("v_id"))).alias(f"c{i}") for i in range(4)])
    has = [F.col(f"c{i}").isNotNull() for i in range(4)]
    face = lambda when, *c: F.when(when, F.struct(*[F.col(f"c{i}").alias(x) for i, x in zip(c, "abc", strict=True)]))
    made = F.array(
        face(has[0] & has[1] & has[3], 0, 1, 3), face(has[0] & has[3] & has[2], 0, 3, 2),
        face(has[0] & has[1] & has[2] & ~has[3], 0, 1, 2), face(has[1] & has[3] & has[2] & ~has[0], 1, 3, 2),
    )
    faces = of.select((F.col("l") * (1 << 31) + F.col("k")).alias("spot"), F.explode(F.filter(made, lambda x: x.isNotNull())).alias("f")).select("spot", "f.*")
    faces = numbered(faces.withColumn("one", F.lit(0)), ["one"], ["spot", "a", "b"], "f_id", 1 << 40)
    return laid.select("v_id", *XYZ, *[F.lit(float(k)).alias(f"n{x}") for x, k in zip(XYZ, n, strict=True)]), faces.select("f_id", "a", "b", "c")


def joined_meshes(vertices: DataFrame, faces: DataFrame, more: DataFrame, more_faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two meshes as one; the second one's ids follow the first one's. Columns that one lacks are null there."""
    top = vertices.agg(F.coalesce(F.max("v_id") + 1, F.lit(0)).alias("top")).first()["top"]
    last = faces.agg(F.coalesce(F.max("f_id") + 1, F.lit(0)).alias("top")).first()["top"]
    shifted = more.withColumn("v_id", F.col("v_id") + top)
    turned = more_faces.select((F.col("f_id") + last).alias("f_id"), *[(F.col(x) + top).alias(x) for x in "abc"])
    return vertices.unionByName(shifted, allowMissingColumns=True), faces.select("f_id", "a", "b", "c").unionByName(turned)


@dataclass(frozen=True)
class Refining:
    """What is done, in this order: cleaning, subdivision, colours, clutter, fill."""

    least_faces: int = 2000
    least_size: float = 0.15
    smoothing: int = 1
    most_hole: int = 30
    subdivisions: int = 2
    brighter: bool = True
    strip: bool = False
    fill: bool = False
    plane_trials: int = 2000
    plane_least: int = 200
    colouring: Colouring = field(default_factory=Colouring)
    clutter: Clutter = field(default_factory=Clutter)
    filling: Fill = field(default_factory=Fill)


def refine(vertices: DataFrame, faces: DataFrame, r: Refining = Refining(), frames: DataFrame | None = None, pixels: DataFrame | None = None, lens: Lens | None = None, depth: DataFrame | None = None, depth_lens: Lens | None = None, values: tuple[str, ...] = ("r", "g", "b"), link: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices with normals and values, faces) of a mesh after all stages; colours need frames, pixels and lens, else they are 128.

    The filled patch has the mean colour of what was left. Stages are cut off from each other by checkpoints.
    """
    v, f = M.clean(vertices.select("v_id", *XYZ), faces, r.least_faces, r.least_size, r.smoothing, r.most_hole)
    for _ in range(r.subdivisions):
        v, f = (cut_lineage(x) for x in M.subdivide(v, f))
    v = vertex_normals(v, f)
    if frames is not None and pixels is not None and lens is not None:
        paint = colourise(v, frames, pixels, lens, r.colouring, depth, depth_lens, values, link).drop("weight")
        v = v.join(paint, "v_id")
    else:
        v = v.select("*", *[F.lit(128.0).alias(x) for x in values])
    v = v.select("v_id", *XYZ, *[(brighten(F.col(x)) if r.brighter else F.floor(F.col(x) + 1e-9).cast("int")).alias(x) for x in values])
    v, f = cut_lineage(v), cut_lineage(f)
    if r.strip:
        found = M.planes(v, trials=r.plane_trials, least=r.plane_least, near=r.clutter.near, key="v_id")
        s = strip_clutter(v, f, found, r.clutter)
        if s.table is not None and r.fill:
            patch, patch_faces = fill_table(s.table, s.table_points, s.vertices, r.filling, r.clutter.up)
            mean = s.vertices.agg(*[F.coalesce(F.avg(x), F.lit(128.0)).cast("int").alias(x) for x in values]).first()
            v, f = joined_meshes(s.vertices, s.faces, patch.select("v_id", *XYZ, *[F.lit(mean[x]).alias(x) for x in values]), patch_faces)
        else:
            v, f = s.vertices, s.faces
        v, f = cut_lineage(v), cut_lineage(f)
    return vertex_normals(v, f), f
