"""What puts the parts of a recording together: intrinsics, keyframe segments, bones, report rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.geometry import angle_between, at, hms, iso, mat_vec, norm, sub, vec, weekday
from strandline.operators.series import over_halo


def depth_intrinsics(cameras: DataFrame) -> DataFrame:
    """cameras with dk (fx, fy, cx, cy), dk_width and dk_height of the depth camera; null where nothing is known.

    cameras: rgb and depth, structs (width, height, fx, fy, cx, cy) or null, and depth_width, depth_height of
    the first depth frame or null. Without a depth camera's own values, those of the colour camera are scaled to
    the depth frame, or taken as they are where there is no depth frame either.
    """
    c, d = F.col("rgb"), F.col("depth")
    sx, sy = F.col("depth_width") / c["width"], F.col("depth_height") / c["height"]
    scaled = F.when(sx.isNotNull() & sy.isNotNull(), vec(c["fx"] * sx, c["fy"] * sy, c["cx"] * sx, c["cy"] * sy)).otherwise(vec(c["fx"], c["fy"], c["cx"], c["cy"]))
    own = vec(d["fx"], d["fy"], d["cx"], d["cy"])
    return cameras.withColumns({
        "dk": F.when(d.isNotNull(), own).when(c.isNotNull(), scaled),
        "dk_width": F.coalesce(d["width"], F.when(c.isNotNull(), F.coalesce("depth_width", c["width"]))),
        "dk_height": F.coalesce(d["height"], F.when(c.isNotNull(), F.coalesce("depth_height", c["height"]))),
    })


def between_keyframes(keys: DataFrame, by: str = "recording_id", frame: str = "frame_idx", side: str = "side", values: tuple[str, ...] = ("joints",)) -> DataFrame:
    """Hands of the frames between neighbouring keyframes (by, frame, side, confidence, values...).

    A side that both keyframes have is mixed in proportion, with the lesser confidence; a side that only one
    has is copied to every frame between. keys has one row per keyframe and side, at least one per keyframe.
    """
    gaps = over_halo(keys.select(by, frame).distinct(), [by], [frame], lambda w: {"_to": F.lead(frame).over(w)}, after=1).where(F.col("_to") > F.col(frame) + 1).withColumnRenamed(frame, "_from")
    cols = [side, "confidence", *values]
    start = gaps.join(keys, [gaps[by] == keys[by], gaps["_from"] == keys[frame]]).select(gaps[by], "_from", "_to", F.col(side).alias("_side"), F.struct(*cols).alias("_a"))
    end = gaps.join(keys, [gaps[by] == keys[by], gaps["_to"] == keys[frame]]).select(gaps[by], "_from", "_to", F.col(side).alias("_side"), F.struct(*cols).alias("_b"))
    both = start.join(end, [by, "_from", "_to", "_side"], "full_outer").withColumn(frame, F.explode(F.sequence(F.col("_from") + 1, F.col("_to") - 1)))
    both = both.withColumn("_alpha", (F.col(frame) - F.col("_from")) / (F.col("_to") - F.col("_from")))
    mixed = [F.coalesce(F.zip_with(f"_a.{v}", f"_b.{v}", lambda a, b: a + (b - a) * F.col("_alpha")), f"_a.{v}", f"_b.{v}").alias(v) for v in values]
    return both.select(by, frame, F.col("_side").alias(side), F.least("_a.confidence", "_b.confidence").alias("confidence"), *mixed)


def bones(joints: DataFrame, edges: Sequence[tuple[int, int]], by: Sequence[str]) -> DataFrame:
    """(by..., a, b, from, to) for each edge whose two joints are visible; joints: by, joint, p, visible."""
    table = F.broadcast(joints.sparkSession.createDataFrame(list(edges), "a int, b int"))
    seen = joints.where("visible").select(*by, "joint", "p")
    ends = seen.join(table, seen["joint"] == table["a"]).select(*by, "a", "b", F.col("p").alias("from"))
    return ends.join(seen.select(*by, F.col("joint").alias("b"), F.col("p").alias("to")), [*by, "b"]).select(*by, "a", "b", "from", "to")


def link_axes(rot: Column) -> list[tuple[Column, Column]]:
    """(column, sign) of the link frame's forward, up and right axes: the largest part of each turned camera axis.

    Without a rotation they are columns 0, 2 and, reversed, 1.
    """
    out = []
    for axis, (column, sign) in (((0, 0, 1), (0, 1.0)), ((0, -1, 0), (2, 1.0)), ((1, 0, 0), (1, -1.0))):
        turned = mat_vec(rot, vec(*axis))
        size = F.transform(turned, F.abs)
        at = (F.array_position(size, F.array_max(size)) - 1).cast("int")
        out.append((F.when(rot.isNull(), column).otherwise(at), F.when(rot.isNull(), sign).otherwise(F.signum(F.get(turned, at)))))
    return out


def kept_hands(bodies: DataFrame, least_score: float = 0.5, least_points: int = 3, least_point_score: float = 0.5) -> DataFrame:
    """Rows of people (class 0) above a score whose hand has enough sure points; point_scores is an array."""
    sure = F.size(F.filter("point_scores", lambda s: s > least_point_score))
    return bodies.where((F.col("class") == 0) & (F.col("score") > least_score) & (sure >= least_points))


def recording_block(files: DataFrame, topics: DataFrame, reference: Sequence[str], by: str = "recording_id") -> DataFrame:
    """One row per file (by, path, size_bytes): its name and size, when it runs, what it holds and what it lacks.

    topics has a row (by, topic, message_count, start_us, end_us) for each topic of a recording, as a recording's
    summary does. A file without topics has counts of 0, times of 0, no texts for them, and lacks every reference
    topic; a topic without messages is listed but not present. Only a recording's topics meet in one row.
    """
    held = topics.groupBy(by).agg(
        F.min("start_us").alias("_a"), F.max("end_us").alias("_b"), F.sum("message_count").alias("_n"),
        F.array_sort(F.collect_list(F.struct("topic", "message_count"))).alias("_topics"), F.collect_set(F.when(F.col("message_count") > 0, F.col("topic"))).alias("_present"),
    )
    d = files.join(held, by, "left")
    start, end = (F.coalesce(F.col(c) / 1e6, F.lit(0.0)) for c in ("_a", "_b"))
    none = F.array().cast("array<string>")
    present = F.coalesce("_present", none)
    wanted = F.array(*[F.lit(x) for x in sorted(set(reference))]).cast("array<string>")
    span = F.coalesce((F.col("_b") - F.col("_a")) / 1e6, F.lit(0.0))
    return d.select(
        by, "path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), (F.coalesce("size_bytes", F.lit(0)) / (1 << 20)).alias("size_mb"),
        span.alias("duration_s"), hms(span).alias("duration_hms"), start.alias("start_time"), end.alias("end_time"), iso(start).alias("start_iso"), iso(end).alias("end_iso"), weekday(start).alias("weekday"),
        F.coalesce("_n", F.lit(0)).alias("message_count"), F.coalesce("_topics", F.array().cast(held.schema["_topics"].dataType)).alias("topic_counts"), F.size(present).alias("topics_present_count"),
        F.array_sort(F.array_except(wanted, present)).alias("missing_reference_topics"),
    )


#: The joints of an upper body, in the order of their numbers.
BODY_JOINTS = ("head", "neck", "spine", "l_shoulder", "l_elbow", "l_wrist", "r_shoulder", "r_elbow", "r_wrist", "mount_cam")


def skeleton_block(frames: DataFrame, by: str = "recording_id", least_bone: float = 1e-6) -> DataFrame:
    """One row per recording: share of frames each joint is visible in, mean angle of elbows, mean reach of arms, mean head height.

    frames: by, joints (arrays of three) and visible (booleans), both in the order of BODY_JOINTS, one row per frame
    with a body. An arm counts where its three joints are visible and both bones are longer than least_bone; a
    measure of no frame is null, and so is one of a null or missing joint. All is one aggregate, merged before the shuffle.
    """
    joint = lambda i: F.get("joints", i)
    seen = lambda i: F.coalesce(F.get("visible", i), F.lit(False))
    aggregates = [
        F.count("*").alias("frame_count"), F.lit(100.0).alias("detection_pct"),
        F.struct(*[(100.0 * F.count_if(seen(i)) / F.count("*")).alias(n) for i, n in enumerate(BODY_JOINTS)]).alias("joint_visibility_pct"),
    ]
    arms = {}
    for side, shoulder in (("left", 3), ("right", 6)):
        upper, lower = (sub(joint(i), joint(shoulder + 1)) for i in (shoulder, shoulder + 2))
        counts = seen(shoulder) & seen(shoulder + 1) & seen(shoulder + 2) & (norm(upper) > least_bone) & (norm(lower) > least_bone)
        arms[f"elbow_{side}_mean_deg"] = F.when(counts, angle_between(upper, lower))
        arms[f"reach_{side}_mean_m"] = F.when(counts, norm(sub(joint(shoulder), joint(shoulder + 2))))
    means = [F.mean(c).alias(n) for n, c in sorted(arms.items())]
    return frames.groupBy(by).agg(*aggregates, *means, F.mean(F.when(seen(0), at(joint(0), 1))).alias("head_height_mean_m"))


def all_blocks(recordings: DataFrame, blocks: dict[str, DataFrame], by: str = "recording_id") -> DataFrame:
    """One row per recording with a struct column for each block, null where the recording lacks it.

    Blocks hold one row per recording at most.
    """
    rows = [b.select(by, F.struct(*[c for c in b.columns if c != by]).alias(name)) for name, b in blocks.items()]
    return reduce(lambda left, right: left.join(right, by, "left"), rows, recordings.select(by).distinct())


def shown(value: Column, decimals: int | None = None) -> Column:
    """A value as text: a dash for null, whole numbers with thousands marks, others with decimals; decimals None says whole."""
    if decimals is None:
        return F.coalesce(F.format_number(value, 0), F.lit("—"))
    x = value.cast("double")
    return F.when(x.isNull(), "—").when(F.isnan(x), "NaN").otherwise(F.format_string(f"%.{decimals}f", x))


def long_form(block: DataFrame, section: str, rows: Sequence[tuple], by: str = "recording_id") -> DataFrame:
    """(by, section, place, label, value, tone) for each row (label, column, decimals, tone or None) of a report section."""
    entries = [F.struct(F.lit(i).alias("place"), F.lit(label).alias("label"), shown(F.col(c), d).alias("value"), (t if t is not None else F.lit("plain")).alias("tone")) for i, (label, c, d, t) in enumerate(rows)]
    return block.select(by, F.lit(section).alias("section"), F.explode(F.array(*entries)).alias("_r")).select(by, "section", "_r.*")
