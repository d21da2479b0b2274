"""Queries on poses, the inertial stream and depth pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import geometry as G
from strandline.operators.quality import depth_quality, health_score, imu_quality, path_steps, trajectory, turn_rates
from strandline.operators.series import filled_forward, rolling_median
from strandline.plans.base import Tables, query, r6

_STEP = """d AS (SELECT *, ts - lag(ts) OVER w AS dt, tx - lag(tx) OVER w AS dx, ty - lag(ty) OVER w AS dy, tz - lag(tz) OVER w AS dz FROM pose WINDOW w AS (PARTITION BY recording_id ORDER BY seq)),
        e AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS segment, sqrt(dx * dx + dy * dy + dz * dz) / greatest(dt, 1e-6) AS speed, CASE WHEN dx IS NOT NULL THEN atan2(dx, dz) END AS heading FROM d),
        f AS (SELECT *, abs((speed - lag(speed) OVER w) / greatest(dt, 1e-6)) AS acceleration, heading - lag(heading) OVER w AS dh FROM e WINDOW w AS (PARTITION BY recording_id ORDER BY seq)),
        g AS (SELECT *, CASE WHEN abs(dh) < pi() THEN dh WHEN dh > 0 AND dh - 2 * pi() = -pi() THEN pi() WHEN dh >= pi() THEN dh - 2 * pi() ELSE dh + 2 * pi() END AS turn FROM f)"""


@query("w2_w8_path_steps", f"WITH {_STEP} SELECT recording_id, seq, round(dt, 6) AS dt, round(segment, 6) AS segment, round(speed, 6) AS speed, round(acceleration, 6) AS acceleration, round(degrees(heading), 6) AS heading_deg, round(degrees(turn), 6) AS turn_deg FROM g")
def w2(t: Tables) -> DataFrame:
    d = path_steps(t.pose)
    return d.select("recording_id", "seq", *[r6(F.col(c), c) for c in ("dt", "segment", "speed", "acceleration")], r6(F.degrees("heading"), "heading_deg"), r6(F.degrees("turn"), "turn_deg"))


_M4 = ("path_length_m", "net_displacement_m", "tortuosity", "extent_x", "extent_y", "extent_z", "bbox_volume_m3", "height_min_m", "height_max_m", "height_mean_m", "height_std_m", "speed_mean_mps", "speed_median_mps", "speed_p95_mps", "speed_max_mps", "accel_mean_mps2", "accel_max_mps2", "cumulative_rotation_deg", "stationary_duration_s", "stationary_pct", "effective_rate_hz")


@query(
    "m4_m8_trajectory",
    f"""WITH {_STEP}, a AS (SELECT recording_id, count(*) AS pose_count, coalesce(sum(segment), 0) AS path_length_m,
            sqrt((arg_max(tx, seq) - arg_min(tx, seq)) ** 2 + (arg_max(ty, seq) - arg_min(ty, seq)) ** 2 + (arg_max(tz, seq) - arg_min(tz, seq)) ** 2) AS net_displacement_m,
            max(tx) - min(tx) AS extent_x, max(ty) - min(ty) AS extent_y, max(tz) - min(tz) AS extent_z, min(ty) AS height_min_m, max(ty) AS height_max_m, avg(ty) AS height_mean_m, stddev_pop(ty) AS height_std_m,
            avg(speed) AS speed_mean_mps, quantile_cont(speed, 0.5) AS speed_median_mps, quantile_cont(speed, 0.95) AS speed_p95_mps, max(speed) AS speed_max_mps, avg(acceleration) AS accel_mean_mps2, max(acceleration) AS accel_max_mps2,
            coalesce(degrees(sum(abs(turn))), 0) AS cumulative_rotation_deg, count(*) FILTER (abs(turn) > radians(45)) AS turn_count, coalesce(sum(dt) FILTER (speed < 0.05), 0) AS stationary_duration_s FROM g GROUP BY 1),
        b AS (SELECT *, extent_x * extent_y * extent_z AS bbox_volume_m3, path_length_m / nullif(net_displacement_m, 0) AS tortuosity, pose_count / 60.0::DOUBLE AS effective_rate_hz, 100.0 * stationary_duration_s / 60.0::DOUBLE AS stationary_pct FROM a)
        SELECT recording_id, pose_count, turn_count, {", ".join(f"round({c}, 6) AS {c}" for c in _M4)} FROM b""",
)
def m4(t: Tables) -> DataFrame:
    return trajectory(t.pose, F.lit(60.0)).select("recording_id", "pose_count", "turn_count", *[r6(F.col(c), c) for c in _M4])


def _euler_sql(source: str) -> str:
    return f"""n AS (SELECT *, sqrt(qx*qx + qy*qy + qz*qz + qw*qw) AS q FROM {source}),
        u AS (SELECT *, qx/q AS x, qy/q AS y, qz/q AS z, qw/q AS w FROM n),
        m AS (SELECT *, 1-2*(y*y+z*z) AS r00, 2*(x*y-z*w) AS r01, 2*(x*z+y*w) AS r02, 2*(x*y+z*w) AS r10, 1-2*(x*x+z*z) AS r11, 2*(y*z-x*w) AS r12, 2*(x*z-y*w) AS r20, 2*(y*z+x*w) AS r21, 1-2*(x*x+y*y) AS r22 FROM u),
        a AS (SELECT *, asin(greatest(-1, least(1, -r20))) AS pitch, CASE WHEN abs(r20) > 0.9999 THEN atan2(-r01, r11) ELSE atan2(r10, r00) END AS yaw, CASE WHEN abs(r20) > 0.9999 THEN 0 ELSE atan2(r21, r22) END AS roll FROM m)"""


@query(
    "g1_g5_rotation",
    f"WITH {_euler_sql('pose')} SELECT seq, {', '.join(f'round(r{i}{j}, 6) AS r{i}{j}' for i in range(3) for j in range(3))}, round(yaw, 6) AS yaw, round(pitch, 6) AS pitch, round(roll, 6) AS roll FROM a",
)
def g1(t: Tables) -> DataFrame:
    d = t.pose.withColumn("m", G.quat_to_rot(F.col("qx"), F.col("qy"), F.col("qz"), F.col("qw")))
    d = d.withColumn("e", G.euler_zyx(F.col("m")))
    return d.select("seq", *[r6(G.at(F.col("m"), 3 * i + j), f"r{i}{j}") for i in range(3) for j in range(3)], *[r6(G.at(F.col("e"), i), n) for i, n in enumerate(("yaw", "pitch", "roll"))])


@query(
    "g2_rotation_round_trip",
    """WITH n AS (SELECT *, sqrt(qx*qx + qy*qy + qz*qz + qw*qw) AS q FROM pose) SELECT seq, round(abs(qx/q), 6) AS x, round(abs(qy/q), 6) AS y, round(abs(qz/q), 6) AS z, round(abs(qw/q), 6) AS w FROM n""",
)
def g2(t: Tables) -> DataFrame:
    """A quaternion read back from its matrix is the same up to its sign."""
    d = t.pose.withColumn("b", G.rot_to_quat(G.quat_to_rot(F.col("qx"), F.col("qy"), F.col("qz"), F.col("qw"))))
    return d.select("seq", *[r6(F.abs(G.at(F.col("b"), i)), n) for i, n in enumerate("xyzw")])


@query(
    "w10_turn_rates",
    f"""WITH {_euler_sql('pose')}, s AS (SELECT recording_id, greatest(ts - lag(ts) OVER w, 1e-6) AS dt, {', '.join(f'{n} - lag({n}) OVER w AS d_{n}' for n in ('yaw', 'pitch', 'roll'))} FROM a WINDOW w AS (PARTITION BY recording_id ORDER BY seq))
        SELECT recording_id, {', '.join(f'round(degrees(quantile_cont(abs(CASE WHEN abs(d_{n}) < pi() THEN d_{n} WHEN d_{n} > 0 THEN d_{n} - 2 * pi() ELSE d_{n} + 2 * pi() END) / dt, 0.5)), 6) AS {n}_rate_deg_per_s' for n in ('yaw', 'pitch', 'roll'))} FROM s GROUP BY 1""",
)
def w10(t: Tables) -> DataFrame:
    return turn_rates(t.pose).select("recording_id", *[r6(F.col(c), c) for c in ("yaw_rate_deg_per_s", "pitch_rate_deg_per_s", "roll_rate_deg_per_s")])


_AXES = ("ax", "ay", "az", "gx", "gy", "gz")
_M5 = ("rate_jitter_ms", *[f"{a}_{n}" for a in _AXES for n in ("mean", "std", "min", "max")], *[f"{a}_mag_{n}" for a in ("accel", "gyro") for n in ("mean", "std", "p95", "max")], "gravity_magnitude", "gravity_deviation", "motion_duration_s", "still_duration_s", "effective_rate_hz")


@query(
    "m5_imu",
    f"""WITH d AS (SELECT *, ts - lag(ts) OVER w AS dt, sqrt(ax*ax + ay*ay + az*az) AS accel, sqrt(gx*gx + gy*gy + gz*gz) AS gyro, lead(ts) OVER w - ts AS after FROM imu WINDOW w AS (PARTITION BY recording_id ORDER BY seq)),
        a AS (SELECT recording_id, count(*) AS sample_count, arg_max(ts, seq) - arg_min(ts, seq) AS span, stddev_pop(dt) * 1000 AS rate_jitter_ms, count(*) FILTER (accel > 20) AS jolt_count, count(*) FILTER (gyro > 2) AS high_rotation_events,
            {", ".join(f"avg({x}) AS {x}_mean, stddev_pop({x}) AS {x}_std, min({x}) AS {x}_min, max({x}) AS {x}_max" for x in _AXES)},
            {", ".join(f"avg({x}) AS {x}_mag_mean, stddev_pop({x}) AS {x}_mag_std, quantile_cont({x}, 0.95) AS {x}_mag_p95, max({x}) AS {x}_mag_max" for x in ("accel", "gyro"))} FROM d GROUP BY 1),
        b AS (SELECT *, sqrt(ax_mean ** 2 + ay_mean ** 2 + az_mean ** 2) AS gravity_magnitude FROM a),
        c AS (SELECT recording_id, coalesce(sum(after) FILTER (accel > CASE WHEN gravity_magnitude > 0 THEN gravity_magnitude * 1.1 ELSE 11 END), 0) AS motion_duration_s FROM d JOIN b USING (recording_id) GROUP BY 1),
        e AS (SELECT *, abs(gravity_magnitude - 9.81) AS gravity_deviation, greatest(span - motion_duration_s, 0) AS still_duration_s, sample_count / nullif(span, 0) AS effective_rate_hz FROM b JOIN c USING (recording_id))
        SELECT recording_id, sample_count, jolt_count, high_rotation_events, {", ".join(f"round({c}, 5) AS {c}" for c in _M5)} FROM e""",
)
def m5(t: Tables) -> DataFrame:
    return imu_quality(t.imu).select("recording_id", "sample_count", "jolt_count", "high_rotation_events", *[F.round(c, 5).alias(c) for c in _M5])


@query("v2_imu_magnitudes", "SELECT seq, round(sqrt(ax*ax + ay*ay + az*az), 6) AS accel, round(sqrt(gx*gx + gy*gy + gz*gz), 6) AS gyro FROM imu")
def v2(t: Tables) -> DataFrame:
    from strandline.operators.quality import magnitude

    return t.imu.select("seq", r6(magnitude("ax", "ay", "az"), "accel"), r6(magnitude("gx", "gy", "gz"), "gyro"))


_M3 = ("valid_pct_mean", "valid_pct_min", "valid_pct_max", "valid_pct_std", "global_min_m", "global_max_m", "depth_p5_m", "depth_p50_m", "depth_p95_m")


@query(
    "m3_a7_depth",
    f"""WITH f AS (SELECT frame_seq, 100.0::DOUBLE * count(*) FILTER (mm > 0) / count(*) AS v, count(*) FILTER (mm > 0) AS n FROM depth_px GROUP BY 1),
        a AS (SELECT count(*) AS frame_count, avg(v) AS valid_pct_mean, min(v) AS valid_pct_min, max(v) AS valid_pct_max, stddev_pop(v) AS valid_pct_std, count(*) FILTER (n = 0) AS empty_frame_count FROM f),
        z AS (SELECT mm / 1000.0::DOUBLE AS z FROM depth_px WHERE mm > 0),
        b AS (SELECT min(z) AS global_min_m, max(z) AS global_max_m, quantile_cont(z, 0.05) AS depth_p5_m, quantile_cont(z, 0.5) AS depth_p50_m, quantile_cont(z, 0.95) AS depth_p95_m,
            count(*) FILTER (z < 1) AS lt_1m, count(*) FILTER (z >= 1 AND z < 2) AS m1_2, count(*) FILTER (z >= 2 AND z < 5) AS m2_5, count(*) FILTER (z >= 5) AS gt_5m FROM z)
        SELECT frame_count, empty_frame_count, lt_1m, m1_2, m2_5, gt_5m, {", ".join(f"round({c}, 6) AS {c}" for c in _M3)} FROM a, b""",
)
def m3(t: Tables) -> DataFrame:
    return depth_quality(t.depth_px).select("frame_count", "empty_frame_count", "lt_1m", "m1_2", "m2_5", "gt_5m", *[r6(F.col(c), c) for c in _M3])


@query("v3_f6_depth_series", "SELECT frame_seq, round(100.0 * count(*) FILTER (mm > 0) / count(*), 6) AS valid_pct, round(avg(mm / 1000.0::DOUBLE) FILTER (mm > 0), 6) AS mean_depth_m FROM depth_px GROUP BY 1")
def v3(t: Tables) -> DataFrame:
    return t.depth_px.groupBy("frame_seq").agg(r6(G.pct(F.count_if(F.col("mm") > 0), F.count("*")), "valid_pct"), r6(F.avg(F.when(F.col("mm") > 0, F.col("mm") / 1000.0)), "mean_depth_m"))


@query("s7_depth_units", "SELECT seq, CAST(least(65535, greatest(0, trunc(abs(tx) * 1000))) AS INTEGER) AS mm FROM pose")
def s7(t: Tables) -> DataFrame:
    """Metres as floats to whole millimetres, clamped to 16 bits."""
    return t.pose.select("seq", F.least(F.lit(65535), F.greatest(F.lit(0), (F.abs("tx") * 1000).cast("int"))).alias("mm"))


@query("v9_depth_shade", "SELECT frame_seq, u, v, CAST(floor(least(1, mm / 2000.0::DOUBLE) * 255) AS INTEGER) AS shade FROM depth_px")
def v9(t: Tables) -> DataFrame:
    return t.depth_px.select("frame_seq", "u", "v", F.floor(F.least(F.lit(1.0), F.col("mm") / 2000.0) * 255).cast("int").alias("shade"))


@query(
    "g3_g4_back_projection",
    """SELECT frame_seq, u, v, mm, round((u - 320) * (mm / 1000.0::DOUBLE) / 500, 6) AS x, round((v - 240) * (mm / 1000.0::DOUBLE) / 500, 6) AS y, round(mm / 1000.0::DOUBLE, 6) AS z,
        round((u - 320) * (mm / 1000.0::DOUBLE) / 500 + 1, 6) AS wx, round((v - 240) * (mm / 1000.0::DOUBLE) / 500 + 2, 6) AS wy, round(mm / 1000.0::DOUBLE + 3, 6) AS wz
        FROM depth_px WHERE mm > 300 AND mm < 5000""",
)
def g3(t: Tables) -> DataFrame:
    """Pixels within the depth range as points, in camera axes and in the world of a camera whose link axes are its own."""
    p = G.back_project(F.col("u"), F.col("v"), F.col("mm"), 500.0, 500.0, 320.0, 240.0)
    d = t.depth_px.where((F.col("mm") > 300) & (F.col("mm") < 5000)).withColumn("p", p)
    w = G.optical_to_world(F.col("p"), G.vec(1, 0, 0, 0, 1, 0, 0, 0, 1), G.vec(1, 2, 3), G.vec(1, 0, 0, 0, 1, 0, 0, 0, 1))
    d = d.withColumn("w", w)
    return d.select("frame_seq", "u", "v", "mm", *[r6(G.at(F.col("p"), i), n) for i, n in enumerate("xyz")], *[r6(G.at(F.col("w"), i), n) for i, n in enumerate(("wx", "wy", "wz"))])


@query("g6_projection", "SELECT seq, round(tx * 500 / nullif(tz, 0) + 320, 4) AS u, round(ty * 500 / nullif(tz, 0) + 240, 4) AS v, coalesce(tz > 0.01 AND tx * 500 / nullif(tz, 0) + 320 BETWEEN 0 AND 639.999999 AND ty * 500 / nullif(tz, 0) + 240 BETWEEN 0 AND 479.999999, false) AS inside FROM pose")
def g6(t: Tables) -> DataFrame:
    p = G.vec(F.col("tx"), F.col("ty"), F.col("tz"))
    u, v = G.project_extrinsic(p, G.vec(1, 0, 0, 0, 1, 0, 0, 0, 1), G.vec(0, 0, 0), 500.0, 500.0, 320.0, 240.0)
    inside = (F.col("tz") > 0.01) & (u >= 0) & (u < 640) & (v >= 0) & (v < 480)
    return t.pose.select("seq", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"), F.coalesce(inside, F.lit(False)).alias("inside"))


@query("g9_field_of_view", "SELECT p_partkey, round(degrees(2 * atan(640 / (2.0::DOUBLE * (p_size + 400)))), 6) AS fov_x, round(640 / 480.0::DOUBLE, 6) AS aspect, round((p_size - 320.0) / 640 * 100, 6) AS offset_pct FROM part")
def g9(t: Tables) -> DataFrame:
    return t["part"].select("p_partkey", r6(G.field_of_view(F.lit(640.0), F.col("p_size") + 400.0), "fov_x"), r6(F.lit(640 / 480.0), "aspect"), r6((F.col("p_size") - 320.0) / 640 * 100, "offset_pct"))


@query("g14_brighten", "SELECT pt_id, CAST(floor(least(255, greatest(60, r * 1.4::DOUBLE))) AS INTEGER) AS r FROM points")
def g14(t: Tables) -> DataFrame:
    return t.points.select("pt_id", G.brighten(F.col("r").cast("double")).alias("r"))


@query("g15_speed_settings", "SELECT s_suppkey, greatest(1, CAST(round_even(pow(30.0::DOUBLE, 1 - (s_suppkey % 101) / 100.0::DOUBLE), 0) AS INTEGER)) AS every_n, CASE WHEN (s_suppkey % 101) / 100.0::DOUBLE < 0.15 THEN 400 END AS cap, (s_suppkey % 101) / 100.0::DOUBLE >= 0.5 AS occlusion FROM supplier")
def g15(t: Tables) -> DataFrame:
    every, cap, occlusion = G.speed_settings((F.col("s_suppkey") % 101) / 100.0)
    return t["supplier"].select("s_suppkey", every.alias("every_n"), cap.alias("cap"), occlusion.alias("occlusion"))


@query(
    "g16_inflated_box",
    """WITH b AS (SELECT p_partkey, p_size * 10.0::DOUBLE AS x1, p_size * 7.0::DOUBLE AS y1, p_size * 10.0::DOUBLE + 35 AS x2, p_size * 7.0::DOUBLE + 21 AS y2 FROM part)
        SELECT p_partkey, greatest(0, least(640, CAST(round_even((x1 + x2) / 2 - (x2 - x1) / 2 * 1.25, 0) AS INTEGER))) AS x1, greatest(0, least(480, CAST(round_even((y1 + y2) / 2 - (y2 - y1) / 2 * 1.25, 0) AS INTEGER))) AS y1,
            greatest(0, least(640, CAST(round_even((x1 + x2) / 2 + (x2 - x1) / 2 * 1.25, 0) AS INTEGER))) AS x2, greatest(0, least(480, CAST(round_even((y1 + y2) / 2 + (y2 - y1) / 2 * 1.25, 0) AS INTEGER))) AS y2 FROM b""",
)
def g16(t: Tables) -> DataFrame:
    x, y = F.col("p_size") * 10.0, F.col("p_size") * 7.0
    box = G.inflate_box(x, y, x + 35, y + 21, 1.25, 640, 480)
    return t["part"].select("p_partkey", *[c.alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2"), strict=True)])


@query(
    "w11_w12_smoothed_depth",
    """WITH d AS (SELECT user_id % 4 AS side, event_id AS seq, CASE WHEN event_id % 3 <> 0 THEN value END AS z FROM events),
        m AS (SELECT side, seq, quantile_cont(z, 0.5) OVER (PARTITION BY side ORDER BY seq ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS s FROM d WHERE z IS NOT NULL)
        SELECT d.side, d.seq, round(last_value(s IGNORE NULLS) OVER (PARTITION BY d.side ORDER BY d.seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS smoothed FROM d LEFT JOIN m ON d.side = m.side AND d.seq = m.seq""",
)
def w11(t: Tables) -> DataFrame:
    """Median of the last 15 known depths of a side; where depth is missing the last median stands."""
    d = t["events"].select((F.col("user_id") % 4).alias("side"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("z"))
    known = rolling_median(d.where("z is not null"), "z", "s", ["side"], ["seq"])
    both = d.where("z is null").withColumn("s", F.lit(None).cast("double")).unionByName(known)
    return filled_forward(both, "s", "smoothed", ["side"], "seq").select("side", "seq", r6(F.col("smoothed"), "smoothed"))


@query(
    "m14_health",
    """WITH x AS (SELECT s_suppkey, s_suppkey % 15 AS gap_count, CASE WHEN s_suppkey % 7 > 0 THEN (s_suppkey % 101)::DOUBLE END AS depth_pct, s_suppkey % 5 > 0 AS has_pose, s_suppkey % 3 > 0 AS has_imu,
            (s_suppkey * 3 % 101)::DOUBLE AS sd, (s_suppkey * 7 % 101)::DOUBLE AS sp, CASE WHEN s_suppkey % 4 > 0 THEN (s_suppkey * 11 % 101)::DOUBLE END AS ha, (s_suppkey * 13 % 101)::DOUBLE AS h1, (s_suppkey * 17 % 101)::DOUBLE AS h2 FROM supplier)
        SELECT s_suppkey, round(greatest(0, least(100, 100 - least(10, gap_count) - CASE WHEN depth_pct IS NULL THEN 10 ELSE greatest(0, 80 - depth_pct) * 0.3::DOUBLE END - CASE WHEN has_pose THEN 0 ELSE 15 END - CASE WHEN has_imu THEN 0 ELSE 5 END
            - greatest(0, 90 - sd) * 0.1::DOUBLE - greatest(0, 90 - sp) * 0.1::DOUBLE - CASE WHEN ha IS NULL THEN 0 ELSE greatest(0, 50 - ha) * 0.15::DOUBLE + greatest(0, 30 - h1) * 0.05::DOUBLE + greatest(0, 20 - h2) * 0.1::DOUBLE END)), 6) AS score FROM x""",
)
def m14(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    share = lambda m: (k * m % 101).cast("double")
    blocks = t["supplier"].select(
        "s_suppkey", (k % 15).alias("gap_count"), F.when(k % 7 > 0, share(1)).alias("depth_pct"), (k % 5 > 0).alias("has_pose"), (k % 3 > 0).alias("has_imu"), share(3).alias("sync_depth_pct"), share(7).alias("sync_pose_pct"),
        F.when(k % 4 > 0, share(11)).alias("hands_any_pct"), share(13).alias("hands_one_pct"), share(17).alias("hands_two_pct"),
    )
    return health_score(blocks).select("s_suppkey", r6(F.col("score"), "score"))
