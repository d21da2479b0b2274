"""Mesh colours: cells against all pairs, occlusion, grey vertices, decimation."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import geometry as G
from strandline.operators import colour as C
from strandline.plans import catalog

LENS = C.Lens(40.0, 40.0, 16.0, 12.0, 32, 24)
FACING = "v_id long, x double, y double, z double, nx double, ny double, nz double"


def cameras(spark, rows):
    """rows of (frame, angle about y, position)."""
    turn = lambda a: [math.cos(a), 0.0, math.sin(a), 0.0, 1.0, 0.0, -math.sin(a), 0.0, math.cos(a)]
    return spark.createDataFrame([(f, turn(a), list(map(float, at))) for f, a, at in rows], "frame long, rot array<double>, at array<double>")


def seen_plainly(vertices, frames, c):
    out = set()
    for f, a, at in frames:
        for v, x, y, z, nx, ny, nz in vertices:
            d = [x - at[0], y - at[1], z - at[2]]
            # world to camera by the transposed turn about y; the link is the identity
            p = [math.cos(a) * d[0] - math.sin(a) * d[2], d[1], math.sin(a) * d[0] + math.cos(a) * d[2]]
            if c.near < p[2] < c.far:
                u, w = p[0] * LENS.fx / p[2] + LENS.cx, p[1] * LENS.fy / p[2] + LENS.cy
                cos = -(d[0] * nx + d[1] * ny + d[2] * nz) / (math.sqrt(sum(k * k for k in d)) + 1e-9)
                if 0 <= u < LENS.width - 1 and 0 <= w < LENS.height - 1 and cos > c.least_cos:
                    out.add((v, f))
    return out


@pytest.mark.parametrize("size", [0.3, 1.0, 5.0])
def test_cells_lose_no_sighting(spark, size):
    rng = random.Random(3)
    vertices = []
    for v in range(400):
        n = [rng.gauss(0, 1) for _ in range(3)]
        k = math.sqrt(sum(a * a for a in n))
        vertices.append((v, *(rng.uniform(-3, 3) for _ in range(3)), *(a / k for a in n)))
    frames = [(f, rng.uniform(-4, 4), [rng.uniform(-2, 2) for _ in range(3)]) for f in range(25)]
    c = C.Colouring(cell=size, far=3.0)
    axes = C.with_axes(cameras(spark, frames), G.vec(1, 0, 0, 0, 1, 0, 0, 0, 1))
    got = [(r["v_id"], r["frame"]) for r in C.sightings(spark.createDataFrame(vertices, FACING), axes, LENS, c).select("v_id", "frame").collect()]
    want = seen_plainly(vertices, frames, c)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


def test_hidden_unseen_and_turned_vertices_are_grey(spark):
    # Looking along z from the origin: 1 in the open, 2 behind a wall, 3 turned away, 4 behind the camera, 5 where depth is missing.
    vertices = [(1, 0.0, 0.0, 2.0, 0.0, 0.0, -1.0), (2, 0.5, 0.0, 2.0, 0.0, 0.0, -1.0), (3, 0.0, 0.2, 2.0, 0.0, 0.0, 1.0), (4, 0.0, 0.0, -2.0, 0.0, 0.0, 1.0), (5, -0.5, 0.0, 2.0, 0.0, 0.0, -1.0)]
    v = spark.createDataFrame(vertices, FACING)
    frames, same = cameras(spark, [(0, 0.0, [0, 0, 0])]), G.vec(1, 0, 0, 0, 1, 0, 0, 0, 1)
    pixels = spark.range(32 * 24).select(F.lit(0).alias("frame"), (F.col("id") % 32).alias("pu"), F.floor(F.col("id") / 32).alias("pv"), F.lit(200).alias("r"))
    depth = spark.createDataFrame([(0, 26, 12, 1000), (0, 16, 12, 1950), (0, 6, 12, 90)], "frame long, u long, v long, mm int")
    paint = lambda c, d=depth: {r["v_id"]: round(r["r"], 6) for r in C.colourise(v, frames, pixels, LENS, c, d, LENS, ("r",), same).collect()}
    assert paint(C.Colouring()) == {1: 200.0, 2: 128.0, 3: 128.0, 4: 128.0, 5: 200.0}
    assert paint(C.Colouring(occlusion=False)) == paint(C.Colouring(), None) == {1: 200.0, 2: 200.0, 3: 128.0, 4: 128.0, 5: 200.0}
    assert paint(C.Colouring(tolerance=2.0))[2] == 200.0


def test_frames_are_thinned_and_capped(spark):
    frames = cameras(spark, [(f, 0.0, [0, 0, 0]) for f in range(20)]).unionByName(spark.createDataFrame([(25, None, None)], "frame long, rot array<double>, at array<double>"))
    chosen = lambda **k: [r["frame"] for r in C.chosen_frames(frames, C.Colouring(**k)).orderBy("frame").collect()]
    assert chosen() == [0, 5, 10, 15] and chosen(most_frames=2) == [0, 5] and len(chosen(every_n=1)) == 20


def test_plan_has_no_nested_loop(spark):
    v = spark.range(10).select(F.col("id").alias("v_id"), *[(F.col("id") * 0.7).alias(n) for n in ("x", "y", "z", "nx", "ny", "nz")])
    frames = cameras(spark, [(0, 0.0, [0, 0, 0])])
    plan = C.sightings(v, C.with_axes(frames), LENS, C.Colouring())._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def scattered(spark, seed=5, n=300):
    rng = random.Random(seed)
    rows = []
    for v in range(n):
        k = [rng.gauss(0, 1) for _ in range(3)]
        size = math.sqrt(sum(a * a for a in k))
        rows.append((v, *(rng.uniform(-2, 2) for _ in range(3)), *(a / size for a in k)))
    frames = [(f, rng.uniform(-4, 4), [rng.uniform(-2, 2) for _ in range(3)]) for f in range(0, 300, 2)]
    return spark.createDataFrame(rows, FACING), cameras(spark, frames)


def level():
    return G.vec(1, 0, 0, 0, 1, 0, 0, 0, 1)


def test_counts_by_groups_of_frames_are_those_of_rows(spark):
    vertices, frames = scattered(spark)
    c = C.Colouring(every_n=1, far=3.0)
    axes, small = C.with_axes(frames, level()), C.Lens(20.0, 20.0, 8.0, 6.0, 16, 12)
    depth = frames.select("frame", F.explode(F.sequence(F.lit(-2), F.lit(15))).alias("u")).select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("v"))
    depth = depth.select("*", (F.pmod(F.xxhash64("frame", "u", "v"), F.lit(30)) * 100).alias("mm"))
    depth = depth.unionByName(depth.where("u = 7").withColumn("mm", F.lit(None).cast("long")))
    seen = C.sightings(vertices, axes, LENS, c)
    free = C.unhidden(seen, depth, small, c).groupBy("v_id").agg(F.count("*").alias("unhidden"), F.max("frame").alias("last_frame"))
    want = seen.groupBy("v_id").agg(F.count("*").alias("sightings")).join(free, "v_id", "left").select("v_id", "sightings", F.coalesce("unhidden", F.lit(0)), "last_frame")
    got = [tuple(r) for r in C.counted(vertices, axes, depth, LENS, small, c).collect()]
    assert sorted(got, key=str) == sorted((tuple(r) for r in want.collect()), key=str)
    assert sum(r[1] for r in got) > sum(r[2] for r in got) > 100 and len(got) == len({r[0] for r in got})


def test_plans_stay_small(spark):
    """The driver holds several copies of a plan; nested array expressions made those of j11 over a million characters long."""
    d = catalog.QUERIES["j11_f10_occlusion"](spark, "/root/testdata/sf0.001")
    assert len(d._jdf.queryExecution().analyzed().toString()) < 150_000


def test_a_view_is_cut_into_cells_only_where_there_are_vertices(spark):
    vertices, frames = scattered(spark, n=20)
    few = vertices.where("v_id < 3").unionByName(spark.createDataFrame([(90, math.nan, math.nan, math.nan, 0.0, 0.0, 1.0), (91, None, None, None, 0.0, 0.0, 1.0)], FACING))
    c = C.Colouring(far=3.0, cell=0.25)
    cells = C.view_cells(C.with_axes(frames, level()).withColumn("_box", C.extents(few)), LENS, c)
    ends = [[math.floor(f(r[n] for r in few.where("v_id < 3").collect()) / 0.25) for f in (min, max)] for n in "xyz"]
    for (low, high), n in zip(ends, ("ix", "iy", "iz"), strict=True):
        assert cells.where(~F.col(n).between(low, high)).isEmpty()
    assert not cells.isEmpty() and C.sightings(few.where("v_id > 80"), C.with_axes(frames, level()), LENS, c).isEmpty()


def test_colours_of_odd_rasters_are_those_of_rows(spark):
    """Pixels that are missing, there twice, outside of the image or null, over several groups of frames."""
    vertices, frames = scattered(spark, seed=9)
    c = C.Colouring(every_n=1, far=3.0, occlusion=False)
    pixels = frames.select("frame", F.explode(F.sequence(F.lit(-1), F.lit(33))).alias("pu")).select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("pv"))
    h = F.pmod(F.xxhash64("frame", "pu", "pv"), F.lit(10))
    pixels = pixels.where(h > 0).select("*", F.when(h > 2, h * 20).alias("r"), F.lit(None).cast("long").alias("g"))
    pixels = pixels.unionByName(pixels.where("pu % 5 = 0"))
    u0, v0 = F.floor("u"), F.floor("v")
    taps = [F.struct((u0 + i).alias("pu"), (v0 + j).alias("pv"), ((F.col("u") - u0 if i else 1 - F.col("u") + u0) * (F.col("v") - v0 if j else 1 - F.col("v") + v0)).alias("k")) for i in (0, 1) for j in (0, 1)]
    d = C.sightings(vertices, C.with_axes(frames, level()), LENS, c).select("v_id", "frame", (F.col("cos") ** 2 / (F.col("pz") ** 2 + 1e-3)).alias("w"), F.explode(F.array(*taps)).alias("t"))
    d = d.select("v_id", "frame", "t.pu", "t.pv", (F.col("w") * F.col("t.k")).alias("w")).join(pixels, ["frame", "pu", "pv"])
    want = {r["v_id"]: (r["w"], r["r"]) for r in d.groupBy("v_id").agg(F.sum("w").alias("w"), (F.sum(F.col("w") * F.col("r")) / F.sum("w")).alias("r")).collect()}
    got = C.colourise(vertices, frames, pixels, LENS, c, values=("r", "g"), link=level()).collect()
    assert len(got) == 300 and len(want) > 30
    for r in got:
        w, red = want.get(r["v_id"], (0.0, None))
        assert r["weight"] == pytest.approx(w) and r["r"] == pytest.approx(128.0 if red is None else red) and r["g"] == 128.0


def test_colours_make_no_row_for_a_pair(spark):
    """Sightings were rows that met depth and pixels by shuffles of their own."""
    d = catalog.QUERIES["p3_a15_colourised"](spark, "/root/testdata/sf0.001")
    plan = d._jdf.queryExecution()
    assert "FlatMapCoGroupsInArrow" in plan.optimizedPlan().toString() and len(plan.analyzed().toString()) < 150_000


def test_shades_by_groups_of_frames_are_those_of_rows(spark):
    vertices, frames = scattered(spark, seed=13)
    c = C.Colouring(every_n=1, far=3.0)
    axes = C.with_axes(frames, level()).withColumn("shade", F.col("frame") % 7)
    w = 1 / (F.col("pz") ** 2 + 1e-3)
    seen = C.sightings(vertices, axes, LENS, c, facing=False).select("v_id", (F.col("frame") % 7).alias("shade"), w.alias("w"))
    want = {r[0]: tuple(r)[1:] for r in seen.groupBy("v_id").agg(F.count("*"), F.sum(F.col("w") * F.col("shade")) / F.sum("w"), F.avg("shade")).collect()}
    got = {r["v_id"]: (r["hits"], r["weighted"], r["plain"]) for r in C.shaded(vertices, axes, LENS, c).collect()}
    assert got.keys() == want.keys() and len(got) > 100
    for v, x in got.items():
        assert x == pytest.approx(want[v])


def test_shades_make_no_row_for_a_pair(spark):
    """Every pair of a vertex and a frame that sees it was a row, in as many tasks as there are cells."""
    plan = catalog.QUERIES["p2_p3_coloured_vertices"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
