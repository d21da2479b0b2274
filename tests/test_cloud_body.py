"""Exact draws, dense clouds and upper bodies on small tables."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import geometry as G
from strandline.operators.body import Body, upper_body, wrists
from strandline.operators.cloud import Cloud, dense_cloud, sample_exactly
from strandline.operators.colour import Lens
from strandline.operators.session import BODY_JOINTS

def same():
    return G.vec(1, 0, 0, 0, 1, 0, 0, 0, 1)


@pytest.mark.parametrize("buckets", [1, 4, 12])
def test_exact_draw_equals_plain_rank(spark, buckets):
    rows = spark.range(3000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 7 % 3).alias("g"), "id", (F.col("id") * 7919 % 1024).alias("d"))
    got = sample_exactly(rows, ["g"], 100, F.col("d"), ["id"], bits=10, buckets=buckets)
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("d", "id"))).where("n <= 100").drop("n")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == rows.columns
    assert sample_exactly(rows, ["g"], 10**6, F.col("d"), ["id"], bits=10).count() == 3000
    assert sample_exactly(rows.where("false"), ["g"], 5, F.col("d"), ["id"], bits=10).count() == 0


def cloud(spark, **options):
    lens = Lens(10.0, 10.0, 4.0, 3.0, 8, 6)
    frames = spark.createDataFrame([(f, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [0.0, 0.0, float(f)]) for f in range(0, 21)] + [(30, None, None)], "frame long, rot array<double>, at array<double>")
    pixel = spark.range(40 * 48).select(F.floor(F.col("id") / 48).alias("frame"), (F.col("id") % 8).cast("int").alias("u"), (F.floor(F.col("id") / 8) % 6).cast("int").alias("v"))
    depth = pixel.select("*", F.when(F.col("u") == 0, 0).when(F.col("u") == 1, 6000).otherwise(2000).alias("mm"))
    image = pixel.select("frame", F.explode(F.array(F.col("u") * 2, F.col("u") * 2 + 1)).alias("pu"), "v").select("frame", "pu", F.explode(F.array(F.col("v") * 2, F.col("v") * 2 + 1)).alias("pv"), F.col("frame").alias("r"))
    return dense_cloud(depth, frames, image, lens, (16, 12), Cloud(**options), ("r",), same())


def test_cloud_of_posed_frames(spark):
    points = cloud(spark, voxel=0)
    assert points.count() == 3 * 36 and {r["r"] for r in points.select("r").distinct().collect()} == {0, 10, 20}
    assert {round(r["z"], 6) for r in points.select("z").collect()} == {2.0, 12.0, 22.0}
    assert cloud(spark, voxel=0, most_points=7).count() == 21
    first = sorted(map(str, cloud(spark, voxel=0, most_points=7, seed=1).collect()))
    assert first == sorted(map(str, cloud(spark, voxel=0, most_points=7, seed=1).collect())) != sorted(map(str, cloud(spark, voxel=0, most_points=7, seed=2).collect()))
    assert cloud(spark, voxel=0, clear=2.0).count() < 3 * 36 and cloud(spark, voxel=0, clear=0, every_n=5).count() == 5 * 36
    boxes = cloud(spark, voxel=100.0, clear=0)
    assert boxes.agg(F.sum("n")).first()[0] == 108


def frames_of(spark, rows):
    return spark.createDataFrame(rows, "frame long, rot array<double>, at array<double>, up array<double>")


HANDS = "frame long, det_seq long, side string, wrist array<double>"
EYE = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def bodies(spark, rows, hands):
    d = upper_body(frames_of(spark, rows), spark.createDataFrame(hands, HANDS), ["frame"], link=same())
    return {r["frame"]: {n: (p and tuple(round(x, 6) for x in p), s) for n, p, s in zip(BODY_JOINTS, r["joints"], r["visible"])} for r in d.collect()}


def test_body_without_hands_pose_or_up(spark):
    got = bodies(spark, [(1, EYE, [0.0, 1.5, 0.0], [0.0, 1.0, 0.0]), (2, None, None, [0.0, 1.0, 0.0]), (3, EYE, [0.0, 0.0, 0.0], None)], [])
    assert set(got) == {1}
    b = got[1]
    # Forward is x, right is -y by default, which is no level direction: right comes from forward and up.
    assert b["mount_cam"] == ((0.0, 1.5, 0.0), True) and b["neck"] == ((-0.1, 1.3, 0.0), True) and b["head"] == ((-0.1, 1.4, 0.0), True)
    assert b["l_shoulder"] == ((-0.1, 1.18, -0.18), True) and b["r_shoulder"] == ((-0.1, 1.18, 0.18), True) and b["spine"] == ((-0.1, 0.73, 0.0), True)
    assert all(b[n] == (None, False) for n in ("l_elbow", "l_wrist", "r_elbow", "r_wrist"))


def test_body_looking_straight_up_takes_the_axis_after_up(spark):
    up_look = [0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    b = bodies(spark, [(1, up_look, [0.0, 0.0, 0.0], [0.0, 1.0, 0.0])], [])[1]
    assert b["neck"] == ((0.0, -0.2, -0.1), True)


def test_arms_bend_down_and_reach_their_wrists(spark):
    hands = [(1, 1, "left", [0.0, 0.0, 9.0]), (1, 2, "left", [0.2, -0.2, 0.1]), (1, 3, "left", [1.0, 1.0, 0.0]), (1, 4, "right", [5.0, 0.0, 0.5]), (1, 5, None, [0.3, -0.3, 0.3])]
    b = bodies(spark, [(1, EYE, [0.0, 0.0, 0.0], [0.0, 1.0, 0.0])], hands)[1]
    assert b["l_wrist"] == ((0.2, -0.2, 0.1), True) and b["r_wrist"] == ((0.3, -0.3, 0.3), True)  # the last with a depth; any other side is right
    for side in "lr":
        s, e, w = (b[f"{side}_{n}"][0] for n in ("shoulder", "elbow", "wrist"))
        assert math.dist(s, e) == pytest.approx(Body().upper_arm, abs=1e-5) and math.dist(e, w) == pytest.approx(Body().forearm, abs=1e-5)
        assert e[1] < s[1] and e[1] < w[1]


def test_wrists_of_a_frame_without_depth(spark):
    assert wrists(spark.createDataFrame([(1, 1, "left", [0.1, 0.1, 0.0])], HANDS), ["frame"]).collect() == []
