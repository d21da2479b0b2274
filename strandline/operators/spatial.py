"""Points, meshes and pixels as tables: voxels, radius joins, normals, edges, colours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def cell(size: float, names: tuple[str, ...] = XYZ) -> list[Column]:
    return [F.floor(F.col(n) / size).alias(f"i{n}") for n in names]


def voxels(points: DataFrame, size: float, values: tuple[str, ...] = ()) -> DataFrame:
    """One row per occupied cell: mean position, mean of values, and the number of points."""
    means = [F.avg(c).alias(c) for c in (*XYZ, *values)]
    return points.groupBy(*cell(size)).agg(*means, F.count("*").alias("n"))


def near_any(points: DataFrame, others: DataFrame, radius: float, how: str = "left_semi", key: str = "pt_id") -> DataFrame:
    """points with (left_semi) or without (left_anti) a row of others nearer than radius.

    Cells are as wide as the radius; others go to the 27 cells around theirs, so the join is an equi-join.
    Matches are reduced to keys before the final join.
    """
    shifted = reduce(lambda d, n: d.withColumn(f"i{n}", F.explode(F.array(*[F.floor(F.col(n) / radius) + k for k in (-1, 0, 1)]))), XYZ, others.select(*[F.col(n).cast("double").alias(n) for n in XYZ]))
    shifted = shifted.select(*[F.col(n).alias(f"o{n}") for n in XYZ], *[F.col(f"i{n}").alias(f"j{n}") for n in XYZ])
    own = points.select("*", *cell(radius))
    apart = reduce(Column.__add__, [(F.col(n) - F.col(f"o{n}")) * (F.col(n) - F.col(f"o{n}")) for n in XYZ])
    same = reduce(Column.__and__, [F.col(f"i{n}") == F.col(f"j{n}") for n in XYZ])
    found = own.join(shifted, same & (apart < radius * radius), "left_semi").select(key)
    return points.join(found, key, how)


def corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """faces (f_id, a, b, c) with the positions of their corners as columns ax, ay ... cz."""
    out = faces
    for corner in "abc":
        v = vertices.select(F.col("v_id").alias(corner), *[F.col(n).alias(f"{corner}{n}") for n in XYZ])
        out = out.join(v, corner)
    return out


def cross_product(a: str, b: str, c: str) -> list[Column]:
    """(b - a) x (c - a) of corner columns."""
    e1, e2 = [F.col(f"{b}{n}") - F.col(f"{a}{n}") for n in XYZ], [F.col(f"{c}{n}") - F.col(f"{a}{n}") for n in XYZ]
    return [e1[(i + 1) % 3] * e2[(i + 2) % 3] - e1[(i + 2) % 3] * e2[(i + 1) % 3] for i in range(3)]


def length(parts: list[Column]) -> Column:
    return F.sqrt(reduce(Column.__add__, [p * p for p in parts]))


def with_shape(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """faces with corner positions, the face normal nx, ny, nz (as long as twice the area), area and edge lengths."""
    d = corners(faces, vertices)
    normal = cross_product("a", "b", "c")
    d = d.withColumns({f"n{n}": c for n, c in zip(XYZ, normal, strict=True)}).withColumn("area", length([F.col(f"n{n}") for n in XYZ]) / 2)
    return d.withColumns({f"edge_{p}{q}": length([F.col(f"{q}{n}") - F.col(f"{p}{n}") for n in XYZ]) for p, q in ("ab", "bc", "ca")})


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """vertices with nx, ny, nz: the sum of their faces' normals, by area, made a unit vector; zero where none."""
    d = with_shape(faces, vertices).select(F.explode(F.array("a", "b", "c")).alias("v_id"), "nx", "ny", "nz")
    sums = d.groupBy("v_id").agg(*[F.sum(f"n{n}").alias(f"s{n}") for n in XYZ])
    size = length([F.coalesce(F.col(f"s{n}"), F.lit(0.0)) for n in XYZ])
    size = F.when(size < 1e-10, 1.0).otherwise(size)
    out = vertices.join(sums, "v_id", "left")
    return out.select(*vertices.columns, *[(F.coalesce(F.col(f"s{n}"), F.lit(0.0)) / size).alias(f"n{n}") for n in XYZ])


def compact(vertices: DataFrame, faces: DataFrame, block: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """Vertices that faces use, numbered from 0 in their old order, and the faces on the new numbers.

    Numbers are dealt per block of old ids; one row per block carries the offset.
    """
    from pyspark.sql import Window

    used = vertices.join(faces.select(F.explode(F.array("a", "b", "c")).alias("v_id")).distinct(), "v_id", "left_semi").withColumn("_b", F.floor(F.col("v_id") / block))
    sizes = used.groupBy("_b").agg(F.count("*").alias("_n"))
    starts = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    numbered = used.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy("v_id"))).join(starts, "_b")
    numbered = numbered.withColumn("new_id", (F.col("_start") + F.col("_i") - 1).cast("long")).drop("_b", "_i", "_start")
    out = faces
    for corner in "abc":
        out = out.withColumnRenamed(corner, "_old").join(numbered.select(F.col("v_id").alias("_old"), F.col("new_id").alias(corner)), "_old").drop("_old")
    return numbered, out.select("f_id", "a", "b", "c")


def face_components(faces: DataFrame, rounds: int = 50) -> DataFrame:
    """(v_id, component): least vertex reachable over faces, by rounds of least labels and pointer jumping.

    Every round is cut off by checkpoint(), so spark.checkpoint.dir must be shared on a cluster.
    """
    e = faces.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("c").alias("v")), F.struct(F.col("c").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
    e = e.union(e.select("v", "u")).distinct()
    label = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l"))
    for _ in range(rounds):
        near = e.join(label.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        new = label.join(near, "u").select("u", F.least("l", "m").alias("k"), F.col("l").alias("was"))
        jump = new.select(F.col("u").alias("k"), F.col("k").alias("kk"))
        new = new.join(jump, "k").select("u", F.least("k", "kk").alias("l"), "was").checkpoint()
        label = new.select("u", "l")
        if new.where("l <> was").isEmpty():
            return label.select(F.col("u").alias("v_id"), F.col("l").alias("component"))
    raise RuntimeError("components did not settle")


def bilinear(at: DataFrame, pixels: DataFrame, width: int, height: int, values: tuple[str, ...] = ("c",), key: str = "pt_id") -> DataFrame:
    """at (key, u, v) with values of the four pixels around, weighted; indices are clipped to the image."""
    u0, v0 = F.floor("u"), F.floor("v")
    fu, fv = F.col("u") - u0, F.col("v") - v0
    clip = lambda c, top: F.greatest(F.lit(0), F.least(F.lit(top - 1), c)).cast("long")
    taps = [F.struct(clip(u0 + i, width).alias("pu"), clip(v0 + j, height).alias("pv"), ((fu if i else 1 - fu) * (fv if j else 1 - fv)).alias("w")) for i in (0, 1) for j in (0, 1)]
    d = at.select(key, F.explode(F.array(*taps)).alias("t")).select(key, "t.*")
    d = d.join(pixels, ["pu", "pv"])
    return d.groupBy(key).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in values])


def occupancy(points: DataFrame, size: float, least: int = 2) -> DataFrame:
    """Cells (ix, iy) of a plane's coordinates with least points or more."""
    return points.groupBy(F.floor(F.col("x") / size).alias("ix"), F.floor(F.col("y") / size).alias("iy")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def grow(cells: DataFrame) -> DataFrame:
    """Cells and their four neighbours."""
    steps = F.array(*[F.struct((F.col("ix") + i).alias("ix"), (F.col("iy") + j).alias("iy")) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    return cells.select(F.explode(steps).alias("c")).select("c.*").distinct()


def shrink(cells: DataFrame) -> DataFrame:
    """Cells whose four neighbours are cells too."""
    steps = F.array(*[F.struct((F.col("ix") + i).alias("ix"), (F.col("iy") + j).alias("iy")) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    return cells.select("ix", "iy").distinct().select(F.explode(steps).alias("c")).groupBy("c").agg(F.count("*").alias("n")).where("n = 5").select("c.*")
