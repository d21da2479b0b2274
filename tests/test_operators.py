"""Small cases worked out by hand, and models of our own on random rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import geometry as G
from strandline.operators import spatial as S
from strandline.operators.asof import nearest, nearest_within, nearest_within_each
from strandline.operators.quality import Health, health_score
from strandline.operators.series import rolling_median, with_previous


def model(left: list[int], right: list[int], tolerance: int | None) -> list[int | None]:
    """Index of the nearest time by binary search in sorted times: ties take the earlier one."""
    out = []
    for t in left:
        i = int(np.searchsorted(right, t))
        if i == 0:
            best = 0
        elif i == len(right):
            best = i - 1
        else:
            best = i - 1 if t - right[i - 1] <= right[i] - t else i
        out.append(best if right and (tolerance is None or abs(right[best] - t) <= tolerance) else None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("tolerance", [None, 7, 100])
def test_nearest_equals_binary_search(spark, seed, tolerance):
    rng = np.random.default_rng(seed)
    right = sorted(int(x) for x in rng.integers(0, 4000, 150))
    left = [int(x) for x in rng.integers(-200, 4300, 200)]
    want = model(left, right, tolerance)
    l = spark.createDataFrame([(0, i, t) for i, t in enumerate(left)], "recording_id long, seq long, t_us long")
    r = spark.createDataFrame([(0, i, t) for i, t in enumerate(right)], "recording_id long, seq long, t_us long")
    got = nearest(l, r, 500) if tolerance is None else nearest_within(l, r, tolerance)
    assert [x["r_seq"] for x in got.orderBy("seq").collect()] == want


def test_nearest_without_right_rows(spark):
    l = spark.createDataFrame([(0, 0, 5), (1, 1, 9)], "recording_id long, seq long, t_us long")
    r = spark.createDataFrame([(1, 0, 50)], "recording_id long, seq long, t_us long")
    assert [x["r_seq"] for x in nearest(l, r, 10).orderBy("seq").collect()] == [None, 0]
    assert [x["r_seq"] for x in nearest_within(l, r.limit(0), 10).orderBy("seq").collect()] == [None, None]


def test_previous_crosses_blocks(spark):
    rows = [(0, i, float(i * i)) for i in range(100)]
    df = spark.createDataFrame(rows, "recording_id long, seq long, v double")
    got = with_previous(df, ["v"], block=7).orderBy("seq").collect()
    assert [x["prev_v"] for x in got] == [None, *[float(i * i) for i in range(99)]]


def test_rolling_median(spark):
    values = list(np.random.default_rng(3).normal(size=60))
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "k int, seq int, v double")
    got = [x["m"] for x in rolling_median(df, "v", "m", ["k"], ["seq"]).orderBy("seq").collect()]
    assert np.allclose(got, [np.median(values[max(0, i - 14) : i + 1]) for i in range(60)])


def test_rotations(spark):
    row = spark.range(1).select(
        G.quat_to_rot(F.lit(0.7071), F.lit(0.0), F.lit(0.7071), F.lit(0.0)).alias("fixed"), G.quat_to_rot(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(2.0)).alias("unit"),
        G.euler_zyx(G.vec(0, -1, 0, 0, 0, 1, -1, 0, 0)).alias("pole"),
    ).first()
    assert np.allclose(row["fixed"], [0, 0, 1, 0, -1, 0, 1, 0, 0])
    assert np.allclose(row["unit"], np.eye(3).ravel())
    assert np.allclose(row["pole"], [math.pi / 2, math.pi / 2, 0])


def test_wrapped_steps(spark):
    angles = [170.0, -170.0, -90.0, 90.0, -90.0]
    df = spark.createDataFrame(list(zip(angles, angles[1:])), "a double, b double")
    got = [x[0] for x in df.select(G.wrapped_step(F.col("b"), F.col("a"), 360.0)).collect()]
    assert np.allclose(got, [20, 80, 180, -180])


def test_elbow(spark):
    rows = [([0.0, 0.0, 0.0], [0.0, 0.0, 0.4]), ([0.0, 0.0, 0.0], [0.0, 0.0, 0.0]), ([0.0, 0.0, 0.0], [0.0, 0.0, 2.0]), ([0.0, 0.0, 0.0], [0.0, -0.4, 0.0])]
    got = [np.array(x["elbow"]) for x in G.with_elbow(spark.createDataFrame(rows, "shoulder array<double>, wrist array<double>")).collect()]
    assert math.isclose(math.acos(got[0][2] / 0.33), 0.7341145372998245, abs_tol=1e-9)
    assert math.isclose(float(np.linalg.norm(got[0])), 0.33, abs_tol=1e-9) and math.isclose(float(np.linalg.norm(got[0] - [0, 0, 0.4])), 0.27, abs_tol=1e-9)
    assert np.allclose(got[1], [0, -0.33, 0]) and np.allclose(got[2], [0, 0, 0.33])
    assert math.isclose(float(np.linalg.norm(got[3] - [0, -0.4, 0])), 0.27, abs_tol=1e-9) and got[3][0] > 0


def test_speed_settings(spark):
    df = spark.createDataFrame([(q,) for q in (0.0, 0.1, 0.15, 0.25, 0.5, 0.75, 1.0)], "q double")
    every, cap, occlusion = G.speed_settings(F.col("q"))
    assert [tuple(x) for x in df.select(every, cap, occlusion).collect()] == [(30, 400, False), (21, 400, False), (18, None, False), (13, None, False), (5, None, True), (2, None, True), (1, None, True)]
    with pytest.raises(Exception, match="quality must be"):
        spark.createDataFrame([(1.5,)], "q double").select(G.speed_settings(F.col("q"))[0]).collect()


def test_health(spark):
    schema = "gap_count int, depth_pct double, has_pose boolean, has_imu boolean, sync_depth_pct double, sync_pose_pct double, hands_any_pct double, hands_one_pct double, hands_two_pct double"
    df = spark.createDataFrame([(3, 60.0, True, True, 70.0, 95.0, 30.0, 30.0, 5.0), (0, None, False, False, None, None, None, None, None)], schema)
    got = health_score(df, Health()).collect()
    assert math.isclose(got[0]["score"], 84.5) and len(got[0]["notes"]) == 5
    assert math.isclose(got[1]["score"], 70.0)


def test_radius_join_equals_all_distances(spark):
    rng = np.random.default_rng(5)
    a, b = rng.random((120, 3)), rng.random((40, 3))
    pa_, pb = (spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "pt_id long, x double, y double, z double") for x in (a, b))
    want = {i for i in range(120) if (((b - a[i]) ** 2).sum(1) < 0.15**2).any()}
    assert {x["pt_id"] for x in S.near_any(pa_, pb, 0.15).collect()} == want
    assert {x["pt_id"] for x in S.near_any(pa_, pb, 0.15, "left_anti").collect()} == set(range(120)) - want


def test_face_components_and_compaction(spark):
    faces = spark.createDataFrame([(0, 0, 1, 2), (1, 2, 3, 4), (2, 7, 8, 9)], "f_id long, a long, b long, c long")
    got = {x["v_id"]: x["component"] for x in S.face_components(faces).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 7: 7, 8: 7, 9: 7}
    vertices = spark.createDataFrame([(i, 0.0, 0.0, 0.0) for i in range(12)], "v_id long, x double, y double, z double")
    numbered, moved = S.compact(vertices, faces.where("f_id > 0"), block=4)
    assert {x["v_id"]: x["new_id"] for x in numbered.collect()} == {2: 0, 3: 1, 4: 2, 7: 3, 8: 4, 9: 5}
    assert sorted(tuple(x) for x in moved.collect()) == [(1, 0, 1, 2), (2, 3, 4, 5)]


def test_nearest_of_several_streams_takes_one_shuffle_and_misses_no_border(spark):
    """Pairs of left and right rows in a bucket of time were rows, and each stream took shuffles of its own."""
    rng = random.Random(11)
    rows = lambda n, top: [(i, rng.choice([0, 1, None]), rng.choice([None, *range(-top, top)])) for i in range(n)]
    left, rights = rows(300, 200), [(rows(400, 200), 7), (rows(90, 260), 0), (rows(60, 200), 25)]
    schema = "seq long, recording_id long, t_us long"
    frame = lambda x: spark.createDataFrame(x, schema)
    d = nearest_within_each(frame(left), [(frame(x), tolerance, f"r{i}_") for i, (x, tolerance) in enumerate(rights)], blocks=2)
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1

    def best(rec, t, right, tolerance):
        some = [(abs(t - rt), rt, -k if rt < t else k, k) for k, r, rt in right if t is not None and rt is not None and r == rec and rec is not None and abs(t - rt) <= tolerance]
        return (min(some)[3], min(some)[1]) if some else (None, None)

    want = {s: sum((best(rec, t, x, tolerance) for x, tolerance in rights), ()) for s, rec, t in left}
    got = {r["seq"]: tuple(r)[3:] for r in d.collect()}
    assert got == want and sum(x[0] is not None for x in want.values()) > 50
