"""Meshes and footprints against brute force."""

from __future__ import annotations

import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from strandline.operators import mesh as M
from strandline.operators.detections import footprints, outline, suppress
from strandline.plans import catalog

VERTEX, FACE = "v_id bigint, x double, y double, z double", "f_id bigint, a bigint, b bigint, c bigint"


def grid(n: int) -> tuple[list, list]:
    v = [(i * n + j, float(i), float(j), 0.1 * i * j) for i in range(n) for j in range(n)]
    f = []
    for i in range(n - 1):
        for j in range(n - 1):
            a, b, c, d = i * n + j, (i + 1) * n + j, i * n + j + 1, (i + 1) * n + j + 1
            f += [(len(f), a, b, c), (len(f) + 1, b, d, c)]
    return v, f


def loop(v: list, f: list) -> tuple[dict, set]:
    """One round of Loop subdivision, point by point."""
    pos, sides = {r[0]: np.array(r[1:]) for r in v}, {}
    for _, *t in f:
        for p, q, r in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
            sides.setdefault((min(t[p], t[q]), max(t[p], t[q])), []).append(t[r])
    name = {e: max(pos) + 1 + i for i, e in enumerate(sorted(sides))}
    out = {}
    for e, opposite in sides.items():
        ends = pos[e[0]] + pos[e[1]]
        out[name[e]] = 3 / 8 * ends + 1 / 8 * sum(pos[o] for o in opposite) if len(opposite) == 2 else ends / 2
    for i, p in pos.items():
        near = [(e[0] if e[1] == i else e[1], len(o)) for e, o in sides.items() if i in e]
        edge = [pos[o] for o, n in near if n != 2]
        k = len(near)
        if edge:
            out[i] = 0.75 * p + sum(edge) / 8 if len(edge) == 2 else p
        elif near:
            b = (5 / 8 - (3 / 8 + math.cos(2 * math.pi / k) / 4) ** 2) / k
            out[i] = (1 - k * b) * p + b * sum(pos[o] for o, _ in near)
        else:
            out[i] = p
    mid = lambda p, q: name[min(p, q), max(p, q)]
    faces = {x for _, a, b, c in f for x in ((a, mid(a, b), mid(a, c)), (mid(a, b), b, mid(b, c)), (mid(a, c), mid(b, c), c), (mid(a, b), mid(b, c), mid(a, c)))}
    return out, faces


def test_subdivision(spark):
    v, f = grid(4)
    v.append((99, 5.0, 5.0, 5.0))
    points, faces = M.subdivide(spark.createDataFrame(v, VERTEX), spark.createDataFrame(f, FACE), block=4)
    want, want_faces = loop(v, f)
    got = {r[0]: np.array(r[1:]) for r in points.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    rows = faces.collect()
    assert len({r["f_id"] for r in rows}) == 4 * len(f) and {(r["a"], r["b"], r["c"]) for r in rows} == want_faces


def test_cleaning(spark):
    v, f = grid(4)
    v += [(100, 0.0, 1.0, 0.0), (101, 9.0, 9.0, 9.0), (102, 9.0, 9.1, 9.0), (103, 9.1, 9.0, 9.0), (104, float("nan"), 0.0, 0.0), (105, 7.0, 7.0, 7.0)]
    n = len(f)
    # A face on a copied vertex, a repeated face, an empty one, a small part, one with a lost corner.
    f += [(n, 0, 4, 100), (n + 1, 4, 0, 1), (n + 2, 2, 2, 3), (n + 3, 101, 102, 103), (n + 4, 0, 1, 104)]
    points, faces = M.clean(spark.createDataFrame(v, VERTEX), spark.createDataFrame(f, FACE), least_faces=2, smoothing=0)
    assert sorted(map(tuple, points.collect())) == sorted(v[:16])
    assert sorted(map(tuple, faces.select("f_id", "a", "b", "c").collect())) == sorted(f[:n])
    still = spark.createDataFrame([], VERTEX), spark.createDataFrame([], FACE)
    assert M.clean(*still)[0].count() == 0


def test_smoothing(spark):
    v, f = grid(3)
    got = {r["v_id"]: (r["x"], r["y"], r["z"]) for r in M.smooth(spark.createDataFrame(v, VERTEX), spark.createDataFrame(f, FACE)).collect()}
    pos = {r[0]: np.array(r[1:]) for r in v}
    assert np.allclose(got[4], sum(pos[i] for i in (4, 1, 2, 3, 5, 6, 7)) / 7)
    assert np.allclose(got[0], (pos[0] + pos[1] + pos[3]) / 3)


def test_planes(spark):
    rng = np.random.default_rng(3)
    flat = np.column_stack([rng.uniform(-1, 1, (600, 2)), rng.normal(0, 0.005, 600)])
    wall = np.column_stack([np.full(400, 1.0), rng.uniform(-1, 1, (400, 2)) + [0, 2]])
    rows = [(i, *map(float, p)) for i, p in enumerate(np.concatenate([flat, wall, rng.uniform(-3, 3, (100, 3))]))]
    d = spark.createDataFrame(rows, "pt_id bigint, x double, y double, z double")
    found = M.planes(d, trials=300)
    assert [abs(round(eq[i])) for (eq, _), i in zip(found, (2, 0), strict=True)] == [1, 1]
    assert found[0][1] >= 600 and found[1][1] >= 380
    assert M.planes(d.where("pt_id < 2")) == []


def test_registered_planes_are_all_found(spark, tmp_path):
    rng = np.random.default_rng(5)
    xyz = np.concatenate([np.insert(rng.uniform(-1, 1, (300, 2)), 2 - i % 2, 5.0 * i, axis=1) for i in range(5)])
    rows = [(i, [0.0] * 7 + [float(c) for c in p] + [0.0] * 54) for i, p in enumerate(xyz)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert catalog.QUERIES["p6_planes"](spark, str(tmp_path)).count() == 5


def test_outline_and_footprints(spark):
    rng = np.random.default_rng(5)
    for n in (3, 5, 40):
        p = np.round(rng.normal(size=(n, 2)), 1)
        o = outline(p)
        for a, b in zip(o, np.roll(o, -1, 0), strict=True):
            assert ((b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0]) > -1e-12).all()
    rows = [(1, 0.0, 0.0), (1, 2.0, 0.0), (1, 2.0, 2.0), (1, 0.0, 2.0), (1, 1.0, 1.0), (1, None, 9.0), (2, 0.0, 0.0), (2, 1.0, 1.0), (2, 2.0, 2.0), (3, 1.0, 1.0), (3, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "k int, x double, z double").repartition(3)
    assert {r["k"]: r["area"] for r in footprints(d, "k").collect()} == {1: 4.0, 2: 0.0, 3: 0.0}


def test_suppression_ties_and_empty(spark):
    rows = [(1, 1, 0.9, 0, 0, 10, 10), (1, 2, 0.9, 1, 0, 11, 10), (1, 3, 0.2, 50, 50, 60, 60), (2, 4, 0.5, 0, 0, 10, 10)]
    d = spark.createDataFrame(rows, "f int, id int, score double, x1 int, y1 int, x2 int, y2 int")
    assert sorted(map(tuple, suppress(d, ["f"], "id", 0.5, 0.3).collect())) == [(1, 1), (2, 4)]
    assert suppress(d.where(F.lit(False)), ["f"], "id").count() == 0


def test_suppression_in_rounds_equals_the_fold(spark):
    import random

    from strandline.operators.detections import suppress, suppress_crowded

    rng = random.Random(6)
    rows = []
    for i in range(400):
        x, y = rng.randint(-50, 90), rng.randint(-50, 90)
        rows.append((rng.choice([1, 2, None]), i, rng.choice([0.1, 0.5, 0.5, 0.9, rng.random()]), float(x), float(y), float(x + rng.randint(0, 60)), float(y + rng.randint(0, 60))))
    df = spark.createDataFrame(rows, "f long, id long, score double, x1 double, y1 double, x2 double, y2 double")
    for most, above, cell in ((0.3, None, 16.0), (0.5, 0.2, 500.0)):
        got = {tuple(r) for r in suppress_crowded(df.where("f is not null"), ["f"], "id", most, above, cell).collect()}
        assert got == {tuple(r) for r in suppress(df.where("f is not null"), ["f"], "id", most, above).collect()}
    assert suppress_crowded(df.where("false"), ["f"], "id").collect() == []


def test_a_tilted_plane_with_more_points_is_no_plane_of_the_room(spark):
    """At sf0.1 a plane through the wall that also cuts floor and ceiling is near to 517 points, the wall to 500."""
    sf = "/root/testdata/sf0.1"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    want = db.execute(catalog.ORACLE_SQL["p6_room_planes"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["p6_room_planes"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and len(got) == 4
