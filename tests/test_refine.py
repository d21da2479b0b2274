"""Clutter removal, table fill and the whole refining of small meshes."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import refine as R

XYZ = "v_id long, x double, y double, z double"
FACES = "f_id long, a long, b long, c long"


def sheet(n, height, start=0, size=1.0):
    """A level square of n x n points."""
    at = np.linspace(-size, size, n)
    v = [(start + i * n + j, float(at[i]), float(height), float(at[j])) for i in range(n) for j in range(n)]
    f = [tri for i in range(n - 1) for j in range(n - 1) for p in [start + i * n + j] for tri in ((p, p + 1, p + n), (p + 1, p + n + 1, p + n))]
    return v, f


def tables(spark, v, f):
    return spark.createDataFrame(v, XYZ), spark.createDataFrame([(i, *x) for i, x in enumerate(f)], FACES)


def test_table_is_neither_lowest_nor_highest():
    level = lambda h, n: ((0.0, 1.0, 0.0, -h), n)
    wall = ((1.0, 0.0, 0.0, -2.0), 500)
    c = R.Clutter()
    assert R.choose_table([level(0, 900), wall, level(0.8, 300), level(2.4, 800), level(1.2, 200)], c) == (2, [1])
    assert R.choose_table([level(0.8, 300), level(0, 900)], c)[0] == 0
    assert R.choose_table([level(0, 900), wall], c)[0] is None and R.choose_table([], c) == (None, [])
    assert R.choose_table([level(0, 9), level(1, 9), ((1.0, 0.0, 0.0, 0.0), 299)], c)[1] == []


def test_axes_of_a_plane():
    for eq in ((0.0, -2.0, 0.0, 1.5), (1.0, 0.0, 0.0, 2.0), (0.3, 0.5, -0.2, 0.7)):
        o, u, v, n = R.plane_axes(eq, (0, 1, 0))
        assert abs(np.dot(eq[:3], o) + eq[3]) < 1e-12 and n[1] >= 0
        assert np.allclose([u @ v, u @ n, v @ n], 0, atol=1e-12) and np.allclose([u @ u, v @ v, n @ n], 1)


def test_outline_and_containment(spark):
    rng = random.Random(4)
    points = [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(500)] + [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]
    df = spark.createDataFrame(points, "p double, q double").repartition(5)
    corners = R.outline_of(df, 100)
    assert sorted(map(tuple, corners.tolist())) == [(-1.0, -1.0), (-1.0, 1.0), (1.0, -1.0), (1.0, 1.0)]
    tested = spark.createDataFrame([(0.0, 0.0), (0.99, -0.99), (1.01, 0.0), (0.0, -1.5), (None, 0.0)], "p double, q double")
    for turned in (corners, corners[::-1]):
        got = [r[0] for r in tested.select(R.within(turned, F.col("p"), F.col("q"))).collect()]
        assert got == [True, True, False, False, None]
    with pytest.raises(ValueError):
        R.outline_of(df, 3)
    assert len(R.outline_of(df.where("false"), 10)) == 0


def room(spark):
    v, f = sheet(21, 0.0, 0, 2.0)
    parts = [sheet(15, 0.75, 1000, 0.5), sheet(5, 0.95, 2000, 0.2), sheet(5, 0.95, 3000, 0.2), sheet(9, 2.5, 4000, 2.0)]
    parts[2] = ([(i, x + 1.5, y, z) for i, x, y, z in parts[2][0]], parts[2][1])
    for a, b in parts:
        v, f = v + a, f + b
    return tables(spark, v, f)


PLANES = [((0.0, 1.0, 0.0, 0.0), 441), ((0.0, 1.0, 0.0, -0.75), 225), ((0.0, 1.0, 0.0, -2.5), 81)]


def test_things_on_the_table_go_and_others_stay(spark):
    v, f = room(spark)
    s = R.strip_clutter(v, f, PLANES)
    assert {r["v_id"] for r in s.clutter.collect()} == set(range(2000, 2025))
    left, kept = s.vertices.collect(), s.faces.collect()
    assert sorted(r["v_id"] for r in left) == list(range(441 + 225 + 25 + 81)) and len(kept) == f.count() - 32
    assert {x for r in kept for x in (r["a"], r["b"], r["c"])} == {r["v_id"] for r in left}
    assert s.table_points.count() == 225
    # A wall within reach spares what stands at it.
    wall = v.unionByName(spark.createDataFrame([(9000 + i, 0.22, 0.95, -0.2 + 0.1 * i) for i in range(5)], XYZ))
    spared = R.strip_clutter(wall, f, [*PLANES, ((1.0, 0.0, 0.0, -0.22), 400)], R.Clutter(near=0.01))
    assert {r["v_id"] for r in spared.clutter.collect()} == set(range(2000, 2020))
    same = R.strip_clutter(v, f, PLANES[:1])
    assert same.table is None and same.vertices is v and same.faces is f


def test_patch_covers_the_table_once(spark):
    v, _ = room(spark)
    own = v.where("abs(y - 0.75) < 0.01")
    eq = PLANES[1][0]
    patch, faces = R.fill_table(eq, own, v.where("v_id >= 4000"), R.Fill(grid=0.03, cell=0.1, least=1))
    p, t = patch.collect(), faces.collect()
    assert sorted(r["v_id"] for r in p) == list(range(len(p))) and sorted(r["f_id"] for r in t) == list(range(len(t)))
    at = {r["v_id"]: (r["x"], r["z"]) for r in p}
    assert all(abs(r["y"] - 0.75) < 1e-12 and (r["nx"], r["ny"], r["nz"]) == (0, 1, 0) for r in p)
    area = lambda r: abs((at[r["b"]][0] - at[r["a"]][0]) * (at[r["c"]][1] - at[r["a"]][1]) - (at[r["c"]][0] - at[r["a"]][0]) * (at[r["b"]][1] - at[r["a"]][1])) / 2
    assert all(abs(area(r) - 0.03**2 / 2) < 1e-12 for r in t)
    assert 1.0 < sum(map(area, t)) < 1.6  # the table is 1 x 1; the mask grows by a cell
    # What is near existing vertices is left out: no grid point within reach of the middle.
    hole, _ = R.fill_table(eq, own, spark.createDataFrame([(1, 0.0, 0.75, 0.0)], XYZ), R.Fill(grid=0.03, cell=0.1, least=1, apart=0.2))
    assert min(np.hypot(r["x"], r["z"]) for r in hole.collect()) >= 0.2
    none, no_faces = R.fill_table(eq, own.where("false"), v)
    assert none.collect() == [] and no_faces.collect() == []


def test_squares_with_a_missing_corner_have_one_face(spark):
    own = spark.createDataFrame([(i, 0.05 + 0.1 * (i % 4), 0.0, 0.05 + 0.1 * (i // 4)) for i in range(16)], XYZ)
    patch, faces = R.fill_table((0.0, 1.0, 0.0, 0.0), own, own.where("false"), R.Fill(grid=0.1, cell=0.1, least=1, close=0, widen=0))
    full = faces.count()
    spot = patch.orderBy("x", "z").first()
    near = spark.createDataFrame([(0, spot["x"], spot["y"], spot["z"])], XYZ)
    _, fewer = R.fill_table((0.0, 1.0, 0.0, 0.0), own, near, R.Fill(grid=0.1, cell=0.1, least=1, close=0, widen=0, apart=0.05))
    assert full - fewer.count() == 1  # a corner of the patch is in one square only


def test_refine_runs_all_stages(spark):
    v, f = room(spark)
    r = R.Refining(least_faces=1, least_size=0.0, smoothing=0, most_hole=0, subdivisions=0, strip=True, fill=True, plane_trials=100, plane_least=60, filling=R.Fill(grid=0.1, cell=0.1, least=1), clutter=R.Clutter(near=0.02))
    out, faces = R.refine(v, f, r, values=("r",))
    rows, tri = out.collect(), faces.collect()
    assert {"v_id", "x", "y", "z", "nx", "ny", "nz", "r"} == set(out.columns) and {row["r"] for row in rows} == {179}
    ids = {row["v_id"] for row in rows}
    assert len(ids) == len(rows) and all({t["a"], t["b"], t["c"]} <= ids for t in tri)
    assert not [row for row in rows if abs(row["x"]) < 0.25 and abs(row["z"]) < 0.25 and 0.8 < row["y"] < 1.0]
    assert [row for row in rows if abs(row["x"] - 1.5) < 0.25 and 0.8 < row["y"] < 1.0]
