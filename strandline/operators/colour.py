"""Mesh colours from posed frames: vertices meet frames by cells of space, are tested for sight, and take weighted means.

The pairs to test come from an equi-join on cells: a frame's view is cut into the cells that it may touch, a vertex
has one. Where each vertex needs sums only, frames are dealt in groups: a group meets the vertices in the cells of its
frames and the pixels of its rasters in one task, and sends on a row for each vertex, so pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import geometry as G
from strandline.operators.spatial import XYZ


@dataclass(frozen=True)
class Lens:
    """Intrinsics of a camera, in pixels."""

    fx: float
    fy: float
    cx: float
    cy: float
    width: int
    height: int


@dataclass(frozen=True)
class Colouring:
    """Depth bounds in metres, least cosine between a vertex's normal and the way to the camera, occlusion tolerance in
    metres, and the edge of the cells by which vertices meet frames."""

    every_n: int = 5
    most_frames: int | None = None
    near: float = 0.2
    far: float = 6.0
    least_cos: float = 0.05
    tolerance: float = 0.08
    least_depth: float = 0.1
    occlusion: bool = True
    cell: float = 1.0


def chosen_frames(frames: DataFrame, c: Colouring) -> DataFrame:
    """Every n-th frame of those with a pose, up to most_frames of them in order."""
    out = frames.where((F.col("frame") % c.every_n == 0) & F.col("rot").isNotNull() & F.col("at").isNotNull())
    return out if c.most_frames is None else out.orderBy("frame").limit(c.most_frames)


def with_axes(frames: DataFrame, link: Column | None = None) -> DataFrame:
    """(frame, tx, ty, tz, m00 .. m22): camera position, and the matrix from world axes to optical ones.

    A frame with several poses takes the least. The aggregate is also where Spark stops to move the filters it infers
    for cells: they would carry the whole rotation many times over down to the scan.
    """
    link = G.vec(*G.OPTICAL_TO_LINK) if link is None else link
    turn = [[sum((G.at(link, 3 * k + i) * G.at(F.col("rot"), 3 * j + k) for k in (1, 2)), G.at(link, i) * G.at(F.col("rot"), 3 * j)) for j in range(3)] for i in range(3)]
    values = [*[G.at(F.col("at"), i).alias(f"t{n}") for i, n in enumerate(XYZ)], *[turn[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)]]
    return frames.groupBy("frame").agg(F.min(F.struct("rot", "at")).alias("pose")).select("frame", "pose.rot", "pose.at").select("frame", *values)


def optical(x: Column, y: Column, z: Column) -> list[Column]:
    """Optical coordinates of a world point by the axes of with_axes."""
    d = [x - F.col("tx"), y - F.col("ty"), z - F.col("tz")]
    return [F.col(f"m{i}0") * d[0] + F.col(f"m{i}1") * d[1] + F.col(f"m{i}2") * d[2] for i in range(3)]


def extents(vertices: DataFrame) -> Column:
    """A single value: the box of the finite positions (lox, hix, ...) and the number n of vertices."""
    finite = {n: F.when(F.abs(n) < float("inf"), F.col(n)) for n in XYZ}
    ends = [f(finite[n]).alias(f"{k}{n}") for n in XYZ for k, f in (("lo", F.min), ("hi", F.max))]
    return vertices.agg(F.struct(*ends, F.count("*").alias("n")).alias("box")).scalar()


def view_cells(frames: DataFrame, lens: Lens, c: Colouring) -> DataFrame:
    """frames, with the vertices' extents as _box, with a row for each cell (ix, iy, iz) that may hold a visible point.

    The box around the view's eight corners, as far as there are vertices, is cut into cells; a cell stays unless the ball
    around it lies wholly behind one of the view's six planes. The number of a frame's cells is bounded by far and the cell's edge.
    """
    ends = [sorted(((0 - mid) / f, (end - 1 - mid) / f)) for f, mid, end in ((lens.fx, lens.cx, lens.width), (lens.fy, lens.cy, lens.height))]
    bounds = []
    for j, n in enumerate(XYZ):
        side = lambda pick: sum((pick(F.col(f"m{i}{j}") * lo, F.col(f"m{i}{j}") * hi) for i, (lo, hi) in enumerate(ends)), F.col(f"m2{j}"))  # noqa: B023, E731
        low, high = F.col(f"t{n}") + F.least(side(F.least) * c.near, side(F.least) * c.far), F.col(f"t{n}") + F.greatest(side(F.greatest) * c.near, side(F.greatest) * c.far)
        first, last = F.floor(F.greatest(low, F.col(f"_box.lo{n}")) / c.cell), F.floor(F.least(high, F.col(f"_box.hi{n}")) / c.cell)
        bounds.append(F.when(first <= last, F.sequence(first, last)))
    out = frames
    for n, b in zip(XYZ, bounds, strict=True):
        out = out.withColumn(f"i{n}", F.explode(b))
    x, y, z = optical(*[(F.col(f"i{n}") + 0.5) * c.cell for n in XYZ])
    ball = c.cell * 3**0.5 / 2
    sides = [z - c.near, c.far - z]
    for p, f, mid, end in ((x, lens.fx, lens.cx, lens.width - 1), (y, lens.fy, lens.cy, lens.height - 1)):
        sides += [(p * f + z * mid) / (f * f + mid * mid) ** 0.5, (z * (end - mid) - p * f) / (f * f + (end - mid) ** 2) ** 0.5]
    return out.where(reduce(Column.__and__, [s >= -ball - 1e-9 for s in sides]))


def sightings(vertices: DataFrame, frames: DataFrame, lens: Lens, c: Colouring, facing: bool = True) -> DataFrame:
    """(v_id, frame, px, py, z, u, v, cos) of vertices (v_id, x, y, z, nx, ny, nz) in the image of frames of with_axes.

    facing: only where the normal turns to the camera by least_cos or more; otherwise normals aren't read.
    """
    d = vertices.join(view_cells(frames.withColumn("_box", extents(vertices)), lens, c), [F.floor(F.col(n) / c.cell) == F.col(f"i{n}") for n in XYZ])
    px, py, pz = optical(*[F.col(n) for n in XYZ])
    way = [F.col(n) - F.col(f"t{n}") for n in XYZ]
    size = F.sqrt(way[0] * way[0] + way[1] * way[1] + way[2] * way[2]) + 1e-9
    cos = -(way[0] / size * F.col("nx") + way[1] / size * F.col("ny") + way[2] / size * F.col("nz")) if facing else F.lit(1.0)
    d = d.select("v_id", "frame", px.alias("px"), py.alias("py"), pz.alias("pz"), cos.alias("cos")).where((F.col("pz") > c.near) & (F.col("pz") < c.far))
    d = d.withColumns({"u": F.col("px") * lens.fx / F.col("pz") + lens.cx, "v": F.col("py") * lens.fy / F.col("pz") + lens.cy})
    d = d.where((F.col("u") >= 0) & (F.col("u") < lens.width - 1) & (F.col("v") >= 0) & (F.col("v") < lens.height - 1))
    return d.where(F.col("cos") > c.least_cos) if facing else d


def unhidden(seen: DataFrame, depth: DataFrame, lens: Lens, c: Colouring) -> DataFrame:
    """Sightings that the depth raster (frame, u, v, mm) doesn't hide.

    The pixel is truncated toward zero. A missing or too small depth hides nothing.
    """
    d = seen.withColumns({"du": (F.col("px") * lens.fx / F.col("pz") + lens.cx).cast("long"), "dv": (F.col("py") * lens.fy / F.col("pz") + lens.cy).cast("long")})
    walls = depth.select(F.col("frame").alias("_f"), F.col("u").cast("long").alias("_u"), F.col("v").cast("long").alias("_v"), (F.col("mm") / 1000.0).alias("_m")).where(F.col("_m") > c.least_depth)
    same = (F.col("frame") == F.col("_f")) & (F.col("du") == F.col("_u")) & (F.col("dv") == F.col("_v"))
    return d.join(walls, same & (F.col("pz") > F.col("_m") + c.tolerance), "left_anti").drop("du", "dv")


#: Frames of a group and vertices of a task at most; a group's rasters have this many pixels by their lenses at most, or are of one frame.
GROUP, MOST_VERTICES, MOST_PIXELS = 128, 1 << 18, 1 << 22


def depth_bounds(lens: Lens, depth: Lens) -> tuple[int, int, int, int]:
    """First column and row, width and height of the depth pixels that a point in the image can fall on."""
    out = []
    for f, mid, end, g, to in ((lens.fx, lens.cx, lens.width, depth.fx, depth.cx), (lens.fy, lens.cy, lens.height, depth.fy, depth.cy)):
        ends = sorted((x - mid) / f * g + to for x in (0, end - 1))
        out.append((int(np.floor(ends[0])) - 1, int(np.ceil(ends[1])) + 2))
    return out[0][0], out[1][0], out[0][1] - out[0][0], out[1][1] - out[1][0]


def depth_pixels(depth: DataFrame, lens: Lens, depth_lens: Lens, c: Colouring) -> DataFrame:
    """Rasters' rows (frame, at, values) of a depth raster (frame, u, v, mm): at is negative, the value is in metres. Too small depth is none."""
    u0, v0, width, height = depth_bounds(lens, depth_lens)
    u, v, m = F.col("u").cast("long") - u0, F.col("v").cast("long") - v0, F.col("mm") / 1000.0
    seen = u.between(0, width - 1) & v.between(0, height - 1) & (m > c.least_depth)
    return depth.where(seen).select("frame", (-1 - (v * width + u)).cast("int").alias("at"), F.array(m).alias("values"))


def colour_pixels(pixels: DataFrame, lens: Lens, values: tuple[str, ...]) -> DataFrame:
    """Rasters' rows (frame, at, values) of an image (frame, pu, pv, *values)."""
    u, v = F.col("pu").cast("long"), F.col("pv").cast("long")
    seen = u.between(0, lens.width - 1) & v.between(0, lens.height - 1)
    return pixels.where(seen).select("frame", (v * lens.width + u).cast("int").alias("at"), F.array(*[F.col(x).cast("double") for x in values]).alias("values"))


class Walls:
    """The depth pixels of one frame's raster rows as an image: which sightings do they hide?"""

    def __init__(self, lens: Lens, depth: Lens, c: Colouring, at: np.ndarray, values: np.ndarray):
        self.lens, self.tolerance, self.bounds, mine = depth, c.tolerance, depth_bounds(lens, depth), at < 0
        self.metres = np.full(self.bounds[2] * self.bounds[3], np.inf)
        np.fmin.at(self.metres, -1 - at[mine], values[mine, 0])

    def open(self, seen: dict) -> dict:
        """The sightings that no depth pixel hides. The pixel is truncated toward zero; a missing depth hides nothing."""
        (u0, v0, width, _), d = self.bounds, self.lens
        u, v = (np.trunc(seen[p] * f / seen["pz"] + mid).astype(np.int64) for p, f, mid in (("px", d.fx, d.cx), ("py", d.fy, d.cy)))
        free = ~(seen["pz"] > self.metres[(v - v0) * width + u - u0] + self.tolerance)
        return {k: x[free] for k, x in seen.items()}


def in_view(xyz: np.ndarray, normal: np.ndarray | None, pose: np.ndarray, lens: Lens, c: Colouring) -> dict[str, np.ndarray]:
    """The sightings of points (3, n) in one frame, as those of sightings: which of the points (at), px, py, pz, u, v, and cos if there are normals."""
    d = xyz - pose[:3, None]
    p = lambda i, d: pose[3 + 3 * i] * d[0] + pose[4 + 3 * i] * d[1] + pose[5 + 3 * i] * d[2]
    pz = p(2, d)
    at = np.flatnonzero((pz > c.near) & (pz < c.far))
    if len(at) < len(pz):
        d, pz = d[:, at], pz[at]
    px, py = p(0, d), p(1, d)
    u, v = px * lens.fx / pz + lens.cx, py * lens.fy / pz + lens.cy
    ok = (u >= 0) & (u < lens.width - 1) & (v >= 0) & (v < lens.height - 1)
    out = {"at": at, "px": px, "py": py, "pz": pz, "u": u, "v": v}
    if normal is not None:
        n, size = normal[:, at] if len(at) < normal.shape[1] else normal, np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) + 1e-9
        out["cos"] = -(d[0] / size * n[0] + d[1] / size * n[1] + d[2] / size * n[2])
        ok &= ~(out["cos"] <= c.least_cos)  # not a number counts as large, as in SQL
    return {k: x[ok] for k, x in out.items()}


def fold_views(vertices: DataFrame, frames: DataFrame, lens: Lens, c: Colouring, fold: Callable, schema: str, rasters: DataFrame | None = None, facing: bool = True, more: tuple[str, ...] = (), pixels: int = 1) -> DataFrame:
    """(v_id, *schema): for each group of frames and each vertex that it sees, what fold makes of the vertex's sightings there.

    frames: of with_axes, their numbers c.every_n apart as a rule, with further numbers `more`; rasters: rows (frame, at, values),
    in no order, of frames with `pixels` pixels. fold(n) is made for n vertices; for each frame, begin(frame, more, at, values, known) has its
    raster rows, and add(sightings) follows for each piece of the vertices. rows() gives a mask of the vertices seen and the columns of schema.
    A vertex's rows are to be summed up by v_id.
    """
    box = extents(vertices)
    parts = F.ceil(F.greatest(F.col("_box.n"), F.lit(1)) / MOST_VERTICES)
    group = F.floor(F.col("frame") / (max(1, min(GROUP, MOST_PIXELS // pixels)) * c.every_n))
    cells = view_cells(frames.withColumn("_box", box), lens, c).select(group.alias("_g"), parts.alias("_parts"), *[f"i{n}" for n in XYZ]).distinct()
    columns = [*XYZ, *(["nx", "ny", "nz"] if facing else [])]
    near = vertices.where(reduce(Column.__and__, [F.col(n).isNotNull() for n in columns])).join(cells, [F.floor(F.col(n) / c.cell) == F.col(f"i{n}") for n in XYZ])
    near = near.select((F.col("_g") * F.col("_parts") + F.pmod(F.xxhash64("v_id"), F.col("_parts"))).alias("_task"), F.col("v_id").cast("long").alias("v_id"), *[F.col(n).cast("double").alias(n) for n in columns])
    pose = [F.col(n).cast("double") for n in (*[f"t{n}" for n in XYZ], *[f"m{i}{j}" for i in range(3) for j in range(3)], *more)]
    d = frames.select("frame", F.lit(None).cast("int").alias("at"), F.array(*pose).alias("values"))
    d = (d if rasters is None else d.unionByName(rasters)).withColumn("_box", box)
    d = d.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).select((group * parts + F.col("_part")).alias("_task"), F.col("frame").cast("long").alias("frame"), "at", "values")
    names = ["v_id", *[x.split()[0] for x in schema.split(", ")]]
    schema = f"v_id bigint, {schema}"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        some = lambda name: right[name].combine_chunks()
        place, number, lists = some("at"), some("frame").to_numpy(zero_copy_only=False), some("values")
        is_pose = place.is_null().to_numpy(zero_copy_only=False)
        poses = lists.filter(pa.array(is_pose))
        if not left.num_rows or not len(poses):
            return pa.table({n: [] for n in names})
        points = np.stack([left[n].to_numpy() for n in columns])
        xyz, normal = points[:3], points[3:] if facing else None
        poses, of = pc.list_flatten(poses).to_numpy(zero_copy_only=False).reshape(len(poses), -1), number[is_pose]
        flat, size = pc.list_flatten(lists.filter(pa.array(~is_pose))), pc.list_value_length(lists.filter(pa.array(~is_pose))).to_numpy(zero_copy_only=False)
        order = np.argsort(number[~is_pose], kind="stable")
        at, its = place.filter(pa.array(~is_pose)).to_numpy(zero_copy_only=False)[order].astype(np.int64), number[~is_pose][order]
        known, flat = flat.is_valid().to_numpy(zero_copy_only=False), flat.fill_null(0.0).to_numpy(zero_copy_only=False)
        # Depth has one value, colours have several: rows are filled up to the widest.
        first, wide = np.cumsum(size) - size, int(size.max()) if len(size) else 1
        take = np.minimum(first[:, None] + np.arange(wide), len(flat) - 1)[order] if len(size) else np.zeros((0, wide), int)
        values, known = (flat[take], known[take]) if len(size) else (np.zeros((0, wide)), np.zeros((0, wide), bool))
        out = fold(left.num_rows)
        for frame, p in zip(of, poses, strict=True):
            lo, hi = np.searchsorted(its, [frame, frame + 1])
            out.begin(frame, p[12:], at[lo:hi], values[lo:hi], known[lo:hi])
            for k in range(0, left.num_rows, 1 << 14):
                seen = in_view(xyz[:, k : k + (1 << 14)], None if normal is None else normal[:, k : k + (1 << 14)], p, lens, c)
                seen["at"] = seen["at"] + k
                out.add(seen)
        mask, results = out.rows()
        return pa.table([left["v_id"].combine_chunks().filter(pa.array(mask)), *results], names=names)

    return near.groupBy("_task").cogroup(d.groupBy("_task")).applyInArrow(run, schema)


def counted(vertices: DataFrame, frames: DataFrame, depth: DataFrame, lens: Lens, depth_lens: Lens, c: Colouring) -> DataFrame:
    """(v_id, sightings, unhidden, last_frame): of a vertex that frames of with_axes see, how many do, and how many of them depth leaves unhidden."""

    class Counts:
        def __init__(self, n: int):
            self.all, self.free, self.last = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).min)

        def begin(self, frame, more, at, values, known):
            self.frame, self.walls = frame, Walls(lens, depth_lens, c, at, values)

        def add(self, seen):
            self.all[seen["at"]] += 1
            free = self.walls.open(seen)["at"]
            self.free[free] += 1
            self.last[free] = np.maximum(self.last[free], self.frame)

        def rows(self):
            mask = self.all > 0
            return mask, [pa.array(self.all[mask]), pa.array(self.free[mask]), pa.array(self.last[mask], mask=self.free[mask] == 0)]

    d = fold_views(vertices, frames, lens, c, Counts, "sightings bigint, unhidden bigint, last_frame bigint", depth_pixels(depth, lens, depth_lens, c), pixels=depth_lens.width * depth_lens.height)
    return d.groupBy("v_id").agg(F.sum("sightings").alias("sightings"), F.sum("unhidden").alias("unhidden"), F.max("last_frame").alias("last_frame"))


def shaded(vertices: DataFrame, frames: DataFrame, lens: Lens, c: Colouring) -> DataFrame:
    """(v_id, hits, weighted, plain): over the frames of with_axes that see a vertex, the mean of their shade, by 1 / (z^2 + 1e-3) and plain. Normals aren't read."""

    class Shades:
        def __init__(self, n: int):
            self.hits, self.sums = np.zeros(n, np.int64), np.zeros((3, n))

        def begin(self, frame, more, at, values, known):
            self.shade = more[0]

        def add(self, seen):
            w = 1 / (seen["pz"] * seen["pz"] + 1e-3)
            self.hits[seen["at"]] += 1
            for total, x in zip(self.sums, (w, w * self.shade, self.shade), strict=True):
                total[seen["at"]] += x

        def rows(self):
            mask = self.hits > 0
            return mask, [pa.array(x[mask]) for x in (self.hits, *self.sums)]

    d = fold_views(vertices, frames, lens, c, Shades, "hits bigint, w double, ws double, s double", facing=False, more=("shade",))
    return d.groupBy("v_id").agg(F.sum("hits").alias("hits"), (F.sum("ws") / F.sum("w")).alias("weighted"), (F.sum("s") / F.sum("hits")).alias("plain"))


def weighted_colours(vertices: DataFrame, frames: DataFrame, pixels: DataFrame, lens: Lens, c: Colouring, values: tuple[str, ...], depth: DataFrame | None = None, depth_lens: Lens | None = None) -> DataFrame:
    """(v_id, weight, *values): bilinear colours of the frames' pixels (frame, pu, pv, *values), weighted by cos^2 / (z^2 + 1e-3).

    A pixel that the raster lacks counts for nothing.
    """
    rasters, size = colour_pixels(pixels, lens, values), lens.width * lens.height
    hides = depth is not None and depth_lens is not None
    if hides:
        rasters, size = rasters.unionByName(depth_pixels(depth, lens, depth_lens, c)), size + depth_lens.width * depth_lens.height

    class Colours:
        def __init__(self, n: int):
            self.weight, self.sums, self.known = np.zeros(n), np.zeros((len(values), n)), np.zeros((len(values), n), bool)

        def begin(self, frame, more, at, row, known):
            self.walls, mine = Walls(lens, depth_lens, c, at, row) if hides else None, at >= 0
            total = lambda x=None: np.bincount(at[mine], x, lens.width * lens.height)
            self.rows_of, self.image = total(), [total(row[mine, k]) for k in range(len(values))] if mine.any() else []
            self.whole = bool((self.rows_of == 1).all() and known[mine, : len(values)].all())  # each pixel once, no null
            self.known_of = [total(known[mine, k].astype(float)) > 0 for k in range(len(self.image))]

        def add(self, seen):
            if not self.image:
                return
            seen = self.walls.open(seen) if hides else seen
            u0, v0 = np.floor(seen["u"]), np.floor(seen["v"])
            fu, fv = seen["u"] - u0, seen["v"] - v0
            first = (v0 * lens.width + u0).astype(np.int64)
            weight = seen["cos"] * seen["cos"] / (seen["pz"] * seen["pz"] + 1e-3)
            rows, sums, known = weight if self.whole else 0.0, [0.0] * len(values), [self.whole] * len(values)
            for i in (0, 1):
                for j in (0, 1):
                    pixel, w = first + j * lens.width + i, weight * ((fu if i else 1 - fu) * (fv if j else 1 - fv))
                    for k, image in enumerate(self.image):
                        sums[k] = sums[k] + w * image[pixel]
                    if not self.whole:
                        rows = rows + w * self.rows_of[pixel]
                        known = [x | y[pixel] for x, y in zip(known, self.known_of, strict=True)]
            self.weight[seen["at"]] += rows
            for k in range(len(values)):
                self.sums[k, seen["at"]] += sums[k]
                self.known[k, seen["at"]] |= known[k]

        def rows(self):
            mask = self.weight != 0
            return mask, [pa.array(self.weight[mask]), *[pa.array(x[mask], mask=~k[mask]) for x, k in zip(self.sums, self.known, strict=True)]]

    schema = "weight double, " + ", ".join(f"v{k} double" for k in range(len(values)))
    d = fold_views(vertices, frames, lens, c, Colours, schema, rasters, pixels=size)
    d = d.groupBy("v_id").agg(F.sum("weight").alias("weight"), *[F.sum(f"v{k}").alias(f"v{k}") for k in range(len(values))]).where("weight > 0")
    return d.select("v_id", "weight", *[(F.col(f"v{k}") / F.col("weight")).alias(x) for k, x in enumerate(values)])


def colourise(vertices: DataFrame, frames: DataFrame, pixels: DataFrame, lens: Lens, c: Colouring = Colouring(), depth: DataFrame | None = None, depth_lens: Lens | None = None, values: tuple[str, ...] = ("r", "g", "b"), link: Column | None = None) -> DataFrame:
    """vertices' v_id with weight and values, 0 to 255: colours over all frames that see a vertex; 128 and weight 0 where none does.

    vertices: v_id, position and unit normal; frames: frame, rot (row-major camera to world), at; pixels and depth:
    rasters as tables. Without depth, or with occlusion off, nothing is hidden.
    """
    few = with_axes(chosen_frames(frames, c), link)
    found = weighted_colours(vertices.select("v_id", *XYZ, "nx", "ny", "nz"), few, pixels, lens, c, values, depth if c.occlusion else None, depth_lens)
    out = vertices.select("v_id").join(found, "v_id", "left")
    clip = lambda x: F.when(F.col(x).isNotNull(), F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col(x))))
    return out.select("v_id", F.coalesce("weight", F.lit(0.0)).alias("weight"), *[F.coalesce(clip(x), F.lit(128.0)).alias(x) for x in values])
