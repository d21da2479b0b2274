"""Parts of a recording put together: rows kept, odd values, hand-computed cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import geometry as G
from strandline.operators import session as S
from strandline.operators.asof import nearest_within


def test_nearest_within_keeps_equal_rows(spark):
    left = spark.createDataFrame([(0, 1, 100), (0, 1, 100), (0, 2, 900), (None, 3, 5), (0, 4, None)], "recording_id long, seq long, t_us long")
    right = spark.createDataFrame([(0, 7, 103), (0, 8, 97), (0, 9, 5000)], "recording_id long, seq long, t_us long")
    got = sorted((r["seq"], r["r_seq"]) for r in nearest_within(left, right, 10).collect())
    assert got == [(1, 8), (1, 8), (2, None), (3, None), (4, None)]


def test_plane_without_normal(spark):
    d = spark.createDataFrame([([0.0, 0.0, 0.0, 2.0],), ([0.0, 0.0, 2.0, 4.0],)], "eq array<double>")
    rows = d.select(G.plane_basis(F.col("eq"))[0].alias("origin")).collect()
    assert rows[0]["origin"] == [None] * 3 and rows[1]["origin"] == [0.0, 0.0, -2.0]


def test_between_keyframes_copies_single_sides(spark):
    rows = [(0, 0, "left", 0.9, [0.0]), (0, 4, "left", 0.5, [4.0]), (0, 4, "right", 0.7, [9.0]), (0, 6, "right", 0.6, [11.0]), (0, 7, "right", 0.6, [0.0]), (1, 3, "left", 1.0, [1.0])]
    keys = spark.createDataFrame(rows, "recording_id long, frame_idx int, side string, confidence double, joints array<double>")
    got = sorted((r["frame_idx"], r["side"], r["confidence"], r["joints"][0]) for r in S.between_keyframes(keys).collect())
    assert got == [(1, "left", 0.5, 1.0), (1, "right", 0.7, 9.0), (2, "left", 0.5, 2.0), (2, "right", 0.7, 9.0), (3, "left", 0.5, 3.0), (3, "right", 0.7, 9.0), (5, "left", 0.5, 4.0), (5, "right", 0.6, 10.0)]
    assert S.between_keyframes(keys.limit(0)).count() == 0


def test_report_values(spark):
    d = spark.createDataFrame([(1, 1234567, 2.345, None), (2, None, float("nan"), 1.0)], "recording_id long, n long, x double, y double")
    got = {(r["recording_id"], r["label"]): (r["value"], r["tone"]) for r in S.long_form(d, "s", [("n", "n", None, None), ("x", "x", 1, F.lit("good")), ("y", "y", 2, None)]).collect()}
    assert got == {(1, "n"): ("1,234,567", "plain"), (1, "x"): ("2.3", "good"), (1, "y"): ("—", "plain"), (2, "n"): ("—", "plain"), (2, "x"): ("NaN", "good"), (2, "y"): ("1.00", "plain")}


def test_link_axes_by_default(spark):
    d = spark.createDataFrame([(None,), ([0.0, 0.0, 1.0, -1.0, 0.0, 0.0, 0.0, -1.0, 0.0],)], "rot array<double>")
    rows = d.select(*[c.alias(f"c{i}") for i, c in enumerate(x for pair in S.link_axes(F.col("rot")) for x in pair)]).collect()
    assert tuple(rows[0]) == (0, 1.0, 2, 1.0, 1, -1.0) and tuple(rows[1]) == (0, 1.0, 2, 1.0, 1, -1.0)


def test_recording_block_of_odd_files(spark):
    """Files without topics, topics without messages, and a recording without a file."""
    files = spark.createDataFrame([(0, "/a/x.mcap", 1 << 20), (1, "y.mcap", None), (2, None, 5)], "recording_id long, path string, size_bytes long")
    topics = spark.createDataFrame([(0, "b", 2, 1_000_000, 4_000_000), (0, "a", 0, None, None), (9, "a", 3, 1, 2)], "recording_id long, topic string, message_count long, start_us long, end_us long")
    got = {r["recording_id"]: r for r in S.recording_block(files, topics, ["c", "a", "b", "a"]).collect()}
    assert sorted(got) == [0, 1, 2]
    assert (got[0]["filename"], got[0]["size_mb"], got[0]["duration_s"], got[0]["duration_hms"], got[0]["start_iso"], got[0]["weekday"]) == ("x.mcap", 1.0, 3.0, "00:00:03", "1970-01-01T00:00:01", "Thursday")
    assert [tuple(x) for x in got[0]["topic_counts"]] == [("a", 0), ("b", 2)] and got[0]["topics_present_count"] == 1 and got[0]["missing_reference_topics"] == ["a", "c"]
    assert (got[1]["filename"], got[1]["size_bytes"], got[1]["message_count"], got[1]["start_iso"], got[1]["topic_counts"], got[1]["missing_reference_topics"]) == ("y.mcap", 0, 0, "", [], ["a", "b", "c"])
    assert got[2]["filename"] is None
    assert S.recording_block(files.limit(0), topics, []).count() == 0 and S.recording_block(files, topics, []).where("size(missing_reference_topics) > 0").count() == 0


def test_skeleton_block_of_odd_frames(spark):
    """A right angle, an arm without length, hidden joints, null joints."""
    at = {0: [0.0, 1.5, 0.0], 3: [1.0, 0.0, 0.0], 4: [0.0, 0.0, 0.0], 5: [0.0, 1.0, 0.0]}
    whole = [at.get(i, [2.0, 2.0, 2.0]) for i in range(10)]
    rows = [(0, whole, [True] * 10), (0, whole, [i > 2 and i != 4 for i in range(10)]), (0, None, None), (1, whole, [False] * 10)]
    d = spark.createDataFrame(rows, "recording_id long, joints array<array<double>>, visible array<boolean>")
    got = {r["recording_id"]: r for r in S.skeleton_block(d).collect()}
    one = got[0]
    assert one["frame_count"] == 3 and round(one["joint_visibility_pct"]["head"], 3) == 33.333 and round(one["joint_visibility_pct"]["l_wrist"], 3) == 66.667
    assert round(one["elbow_left_mean_deg"], 6) == 90.0 and round(one["reach_left_mean_m"], 6) == 1.414214 and one["elbow_right_mean_deg"] is None and one["head_height_mean_m"] == 1.5
    assert got[1]["joint_visibility_pct"]["head"] == 0.0 and got[1]["head_height_mean_m"] is None
    assert S.skeleton_block(d.limit(0)).count() == 0
