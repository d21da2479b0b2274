"""Quality measures of a recording: one row per recording_id and block. Percentiles are exact; a recording bounds them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.geometry import at, euler_zyx, pct, quat_to_rot, safe_div, wrapped_step
from strandline.operators.asof import nearest_gap
from strandline.operators.series import with_previous

DAY = 86_400_000_000


def stream_gaps(stream: DataFrame, all_streams: DataFrame, scale: float = 1) -> DataFrame:
    """Frame count, rate over the whole recording, spacing in ms, and gaps of over twice the median spacing."""
    d = with_previous(stream, ["t_us"]).withColumn("dt", (F.col("t_us") - F.col("prev_t_us")) / (1000.0 * scale))
    span = all_streams.groupBy("recording_id").agg(((F.max("t_us") - F.min("t_us")) / (1e6 * scale)).alias("duration"))
    m = d.groupBy("recording_id").agg(
        F.count("*").alias("frame_count"), F.percentile("dt", F.lit(0.5)).alias("median_dt_ms"), F.min("dt").alias("min_dt_ms"), F.max("dt").alias("max_dt_ms"), F.stddev_pop("dt").alias("dt_std_ms")
    )
    gaps = d.join(m.select("recording_id", "median_dt_ms"), "recording_id").groupBy("recording_id").agg(F.count_if((F.col("dt") > 2 * F.col("median_dt_ms")) & (F.col("median_dt_ms") > 0)).alias("gap_count"))
    return m.join(gaps, "recording_id").join(span, "recording_id").withColumn("effective_fps", safe_div(F.col("frame_count"), F.col("duration")))


def transform_pairs(tf: DataFrame, duration: float) -> DataFrame:
    """Transform pairs by count, ties by first occurrence."""
    p = tf.groupBy("parent", "child").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    # These windows are over one row per pair of frame names.
    place = F.row_number().over(Window.orderBy(F.desc("n"), "first_seq"))
    return p.select("parent", "child", "n", (F.col("n") / max(duration, 1e-3)).alias("rate_hz"), place.cast("long").alias("place"), F.count("*").over(Window.partitionBy()).alias("pairs"))


def sync_quality(left: DataFrame, right: DataFrame, name: str, scale: float = 1) -> DataFrame:
    """Distances of left rows to the nearest right row in ms, however far."""
    d = nearest_gap(left, right, DAY).withColumn("dt", F.col("gap") / (1000.0 * scale))
    n = F.count("dt")
    return d.groupBy("recording_id").agg(
        F.lit(name).alias("stream"),
        F.percentile("dt", F.lit(0.5)).alias("median_ms"),
        F.percentile("dt", F.lit(0.95)).alias("p95_ms"),
        F.max("dt").alias("max_ms"),
        pct(F.count_if(F.col("dt") <= 50), n).alias("within_50ms_pct"),
        pct(F.count_if(F.col("dt") <= 100), n).alias("within_100ms_pct"),
    )


def path_steps(pose: DataFrame) -> DataFrame:
    """pose (recording_id, seq, ts, tx, ty, tz, ...) with dt, segment, speed, acceleration and heading."""
    d = with_previous(pose, ["ts", "tx", "ty", "tz"])
    dx, dy, dz = (F.col(c) - F.col(f"prev_{c}") for c in ("tx", "ty", "tz"))
    d = d.withColumns({"dt": F.col("ts") - F.col("prev_ts"), "segment": F.sqrt(dx * dx + dy * dy + dz * dz), "heading": F.when(dx.isNotNull(), F.atan2(dx, dz))})
    d = d.withColumn("speed", F.col("segment") / F.greatest("dt", F.lit(1e-6))).drop("prev_ts", "prev_tx", "prev_ty", "prev_tz")
    d = with_previous(d, ["speed", "heading"])
    step = wrapped_step(F.col("heading"), F.col("prev_heading"))
    return d.withColumns({"acceleration": F.abs((F.col("speed") - F.col("prev_speed")) / F.greatest("dt", F.lit(1e-6))), "turn": step}).drop("prev_speed", "prev_heading")


def trajectory(pose: DataFrame, duration: Column) -> DataFrame:
    """Path, extent, speed, acceleration and heading measures; duration is the recording's in seconds."""
    d = path_steps(pose)
    first, last = F.min_by(F.struct("tx", "ty", "tz"), "seq"), F.max_by(F.struct("tx", "ty", "tz"), "seq")
    away = F.sqrt(sum(((last[c] - first[c]) * (last[c] - first[c]) for c in ("ty", "tz")), (last["tx"] - first["tx"]) * (last["tx"] - first["tx"])))
    ext = {c: F.max(c) - F.min(c) for c in ("tx", "ty", "tz")}
    g = d.groupBy("recording_id").agg(
        F.count("*").alias("pose_count"), F.coalesce(F.sum("segment"), F.lit(0.0)).alias("path_length_m"), away.alias("net_displacement_m"),
        ext["tx"].alias("extent_x"), ext["ty"].alias("extent_y"), ext["tz"].alias("extent_z"), (ext["tx"] * ext["ty"] * ext["tz"]).alias("bbox_volume_m3"),
        F.min("ty").alias("height_min_m"), F.max("ty").alias("height_max_m"), F.avg("ty").alias("height_mean_m"), F.stddev_pop("ty").alias("height_std_m"),
        F.avg("speed").alias("speed_mean_mps"), F.percentile("speed", F.lit(0.5)).alias("speed_median_mps"), F.percentile("speed", F.lit(0.95)).alias("speed_p95_mps"), F.max("speed").alias("speed_max_mps"),
        F.avg("acceleration").alias("accel_mean_mps2"), F.max("acceleration").alias("accel_max_mps2"),
        F.coalesce(F.degrees(F.sum(F.abs("turn"))), F.lit(0.0)).alias("cumulative_rotation_deg"), F.count_if(F.abs("turn") > F.radians(F.lit(45.0))).alias("turn_count"),
        F.coalesce(F.sum(F.when(F.col("speed") < 0.05, F.col("dt"))), F.lit(0.0)).alias("stationary_duration_s"),
    )
    g = g.withColumn("_d", duration)
    return g.withColumns({"tortuosity": safe_div(F.col("path_length_m"), F.col("net_displacement_m")), "effective_rate_hz": safe_div(F.col("pose_count"), F.col("_d")), "stationary_pct": pct(F.col("stationary_duration_s"), F.col("_d"))}).drop("_d")


def turn_rates(pose: DataFrame) -> DataFrame:
    """Median absolute yaw, pitch and roll rates in degrees per second."""
    e = euler_zyx(quat_to_rot(F.col("qx"), F.col("qy"), F.col("qz"), F.col("qw")))
    d = pose.withColumn("_e", e).select("recording_id", "seq", "ts", *[at(F.col("_e"), i).alias(n) for i, n in enumerate(("yaw", "pitch", "roll"))])
    d = with_previous(d, ["ts", "yaw", "pitch", "roll"])
    dt = F.greatest(F.col("ts") - F.col("prev_ts"), F.lit(1e-6))
    rate = lambda n: F.degrees(F.percentile(F.abs(wrapped_step(F.col(n), F.col(f"prev_{n}")) / dt), F.lit(0.5))).alias(f"{n}_rate_deg_per_s")
    return d.groupBy("recording_id").agg(*[rate(n) for n in ("yaw", "pitch", "roll")])


def magnitude(*names: str) -> Column:
    return F.sqrt(sum((F.col(n) * F.col(n) for n in names[1:]), F.col(names[0]) * F.col(names[0])))


def imu_quality(imu: DataFrame) -> DataFrame:
    """Rates, axis and magnitude measures, gravity, jolts and motion; imu has ts, ax..az, gx..gz."""
    axes = ("ax", "ay", "az", "gx", "gy", "gz")
    d = with_previous(imu, ["ts"]).withColumns({"dt": F.col("ts") - F.col("prev_ts"), "accel": magnitude("ax", "ay", "az"), "gyro": magnitude("gx", "gy", "gz")})
    per_axis = [f(a).alias(f"{a}_{n}") for a in axes for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    per_size = [f(a).alias(f"{a}_mag_{n}") for a in ("accel", "gyro") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("p95", lambda c: F.percentile(c, F.lit(0.95))), ("max", F.max))]
    g = d.groupBy("recording_id").agg(
        F.count("*").alias("sample_count"), (F.max_by("ts", "seq") - F.min_by("ts", "seq")).alias("duration_s"), (F.stddev_pop("dt") * 1000).alias("rate_jitter_ms"),
        *per_axis, *per_size, F.count_if(F.col("accel") > 20).alias("jolt_count"), F.count_if(F.col("gyro") > 2).alias("high_rotation_events"),
    )
    g = g.withColumn("gravity_magnitude", magnitude("ax_mean", "ay_mean", "az_mean"))
    # A sample in motion counts the time until the next sample, so the step's start is tested.
    moving = with_previous(d.select("recording_id", "seq", "dt", "accel"), ["accel"]).join(g.select("recording_id", "gravity_magnitude"), "recording_id")
    limit = F.when(F.col("gravity_magnitude") > 0, F.col("gravity_magnitude") * 1.1).otherwise(11.0)
    moving = moving.groupBy("recording_id").agg(F.coalesce(F.sum(F.when(F.col("prev_accel") > limit, F.col("dt"))), F.lit(0.0)).alias("motion_duration_s"))
    span = F.when(F.col("sample_count") > 1, F.col("duration_s")).otherwise(1e-3)
    g = g.join(moving, "recording_id")
    return g.withColumns({"effective_rate_hz": safe_div(F.col("sample_count"), span), "gravity_deviation": F.abs(F.col("gravity_magnitude") - 9.81), "still_duration_s": F.greatest(span - F.col("motion_duration_s"), F.lit(0.0))}).drop("duration_s")


def depth_quality(pixels: DataFrame) -> DataFrame:
    """One row of depth measures over all pixels (frame_seq, mm): nothing is sampled."""
    z = F.when(F.col("mm") > 0, F.col("mm") / 1000.0)
    frames = pixels.groupBy("frame_seq").agg(pct(F.count_if(F.col("mm") > 0), F.count("*")).alias("valid_pct"), F.count_if(F.col("mm") > 0).alias("valid"))
    per_frame = frames.agg(
        F.count("*").alias("frame_count"), F.avg("valid_pct").alias("valid_pct_mean"), F.min("valid_pct").alias("valid_pct_min"), F.max("valid_pct").alias("valid_pct_max"), F.stddev_pop("valid_pct").alias("valid_pct_std"),
        F.count_if(F.col("valid") == 0).alias("empty_frame_count"),
    )
    bins = (("lt_1m", 0, 1), ("m1_2", 1, 2), ("m2_5", 2, 5), ("gt_5m", 5, float("inf")))
    per_pixel = pixels.select(z.alias("z")).agg(
        F.min("z").alias("global_min_m"), F.max("z").alias("global_max_m"), *[F.percentile("z", F.lit(p / 100)).alias(f"depth_p{p}_m") for p in (5, 50, 95)],
        *[F.count_if((F.col("z") >= a) & (F.col("z") < b)).alias(n) for n, a, b in bins],
    )
    return per_frame.join(per_pixel)


@dataclass(frozen=True)
class Health:
    """Weights and targets of the health score."""

    gap_most: float = 10
    depth_missing: float = 10
    depth_target: float = 80
    depth_weight: float = 0.3
    pose_missing: float = 15
    imu_missing: float = 5
    sync_target: float = 90
    sync_weight: float = 0.1
    hands_missing: float = 0
    any_target: float = 50
    any_weight: float = 0.15
    one_target: float = 30
    one_weight: float = 0.05
    two_target: float = 20
    two_weight: float = 0.10
    depth_required: bool = True
    imu_required: bool = True


def health_score(blocks: DataFrame, h: Health = Health()) -> DataFrame:
    """blocks with score (0..100) and notes, in the order of the penalties.

    Columns: gap_count, depth_pct, has_pose, has_imu, sync_depth_pct, sync_pose_pct, hands_any_pct,
    hands_one_pct, hands_two_pct; a null depth_pct or hands_any_pct says that the block is missing.
    """
    short = lambda c, target, weight: F.greatest(F.lit(0.0), target - F.col(c)) * weight if weight > 0 else F.lit(0.0)
    hands = F.col("hands_any_pct").isNull()
    parts = [
        ("gaps in the camera stream", F.least(F.lit(float(h.gap_most)), F.col("gap_count").cast("double"))),
        ("no depth", F.when(F.col("depth_pct").isNull(), h.depth_missing if h.depth_required else 0.0)),
        ("few valid depth pixels", short("depth_pct", h.depth_target, h.depth_weight)),
        ("no camera pose", F.when(~F.col("has_pose"), h.pose_missing)),
        ("no inertial stream", F.when(~F.col("has_imu"), h.imu_missing if h.imu_required else 0.0)),
        ("depth out of step", short("sync_depth_pct", h.sync_target, h.sync_weight)),
        ("pose out of step", short("sync_pose_pct", h.sync_target, h.sync_weight)),
        ("no hands", F.when(hands, h.hands_missing)),
        ("few frames with a hand", F.when(~hands, short("hands_any_pct", h.any_target, h.any_weight))),
        ("few frames with one hand or more", F.when(~hands, short("hands_one_pct", h.one_target, h.one_weight))),
        ("few frames with both hands", F.when(~hands, short("hands_two_pct", h.two_target, h.two_weight))),
    ]
    costs = [(n, F.coalesce(c.cast("double"), F.lit(0.0))) for n, c in parts]
    total = sum((c for _, c in costs[1:]), costs[0][1])
    notes = F.filter(F.array(*[F.when(c > 0, F.lit(n)) for n, c in costs]), lambda x: x.isNotNull())
    return blocks.withColumns({"score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - total)), "notes": notes})
