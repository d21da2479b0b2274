"""Queries that put a recording's parts together, and the rows of its report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import geometry as G
from strandline.operators import session as S
from strandline.operators.quality import imu_quality, trajectory, turn_rates
from strandline.plans.base import ORACLE_SQL, Tables, query, r6
from strandline.plans.hands import d_sql, j_sql, joint
from strandline.plans.motion import _euler_sql
from strandline.plans.sync import REQUIRED


@query(
    "s23_depth_intrinsics",
    """WITH c AS (SELECT p_partkey, p_size + 400.0::DOUBLE AS f, CASE WHEN p_partkey % 5 > 0 THEN 640 END AS w, CASE WHEN p_partkey % 3 = 0 THEN 256 END AS kw, CASE WHEN p_partkey % 2 = 0 THEN 192 END AS dw FROM part)
        SELECT p_partkey, CASE WHEN kw IS NOT NULL THEN 210.5 WHEN w IS NOT NULL THEN round(f * coalesce(dw / 640.0::DOUBLE, 1), 6) END AS fx, CASE WHEN kw IS NOT NULL THEN 211.5 WHEN w IS NOT NULL THEN round((f + 1) * coalesce(CASE WHEN dw IS NOT NULL THEN 144 END / 480.0::DOUBLE, 1), 6) END AS fy,
            CASE WHEN kw IS NOT NULL THEN 128.0 WHEN w IS NOT NULL THEN round(320 * coalesce(dw / 640.0::DOUBLE, 1), 6) END AS cx, coalesce(kw, CASE WHEN w IS NOT NULL THEN coalesce(dw, 640) END) AS width FROM c""",
)
def s23(t: Tables) -> DataFrame:
    k, f = F.col("p_partkey"), F.col("p_size") + 400.0
    camera = lambda w, h, fx, fy, cx, cy: F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"), *[F.lit(x).cast("double").alias(n) for x, n in ((fx, "fx"), (fy, "fy"), (cx, "cx"), (cy, "cy"))])
    d = t["part"].select("p_partkey", F.when(k % 5 > 0, camera(640, 480, f, f + 1, 320, 240)).alias("rgb"), F.when(k % 3 == 0, camera(256, 192, 210.5, 211.5, 128, 96)).alias("depth"), F.when(k % 2 == 0, 192).alias("depth_width"), F.when(k % 2 == 0, 144).alias("depth_height"))
    return S.depth_intrinsics(d).select("p_partkey", *[r6(G.at(F.col("dk"), i), n) for i, n in enumerate(("fx", "fy", "cx"))], F.col("dk_width").alias("width"))


_KEYS = """k AS (SELECT frame_idx % 3 AS recording_id, frame_idx, side, arg_min(confidence, det_seq) AS confidence, arg_min(flat, det_seq) AS flat FROM hands GROUP BY 1, 2, 3)"""


@query(
    "j13_between_keyframes",
    f"""WITH {_KEYS}, g AS (SELECT recording_id, frame_idx AS f0, lead(frame_idx) OVER (PARTITION BY recording_id ORDER BY frame_idx) AS f1 FROM (SELECT DISTINCT recording_id, frame_idx FROM k)),
        a AS (SELECT g.recording_id, f0, f1, side, confidence, flat FROM g JOIN k ON k.recording_id = g.recording_id AND k.frame_idx = f0 WHERE f1 > f0 + 1), b AS (SELECT g.recording_id, f0, f1, side, confidence, flat FROM g JOIN k ON k.recording_id = g.recording_id AND k.frame_idx = f1 WHERE f1 > f0 + 1),
        m AS (SELECT coalesce(a.recording_id, b.recording_id) AS recording_id, coalesce(a.f0, b.f0) AS f0, coalesce(a.f1, b.f1) AS f1, coalesce(a.side, b.side) AS side, least(a.confidence, b.confidence) AS confidence, a.flat AS fa, b.flat AS fb FROM a FULL JOIN b ON a.recording_id = b.recording_id AND a.f0 = b.f0 AND a.side = b.side),
        s AS (SELECT *, unnest(range(f0 + 1, f1)) AS frame FROM m)
        SELECT recording_id, CAST(frame AS INTEGER) AS frame_idx, side, confidence, round(coalesce(fa[1]::DOUBLE + (fb[1]::DOUBLE - fa[1]::DOUBLE) * ((frame - f0) / (f1 - f0)::DOUBLE), fa[1], fb[1]), 6) AS x, round(coalesce(fa[3]::DOUBLE + (fb[3]::DOUBLE - fa[3]::DOUBLE) * ((frame - f0) / (f1 - f0)::DOUBLE), fa[3], fb[3]), 6) AS z FROM s""",
)
def j13(t: Tables) -> DataFrame:
    """Hands between keyframes, of both sides or of one."""
    keys = t.hands.groupBy((F.col("frame_idx") % 3).alias("recording_id"), "frame_idx", "side").agg(F.min_by("confidence", "det_seq").alias("confidence"), F.min_by("flat", "det_seq").alias("flat"))
    keys = keys.withColumn("joints", F.transform("flat", lambda x: x.cast("double"))).drop("flat")
    d = S.between_keyframes(keys)
    return d.select("recording_id", "frame_idx", "side", "confidence", r6(F.get("joints", 0), "x"), r6(F.get("joints", 2), "z"))


@query(
    "j14_bones",
    f"""WITH p AS (SELECT det_seq, CAST(unnest(range(5)) AS INTEGER) AS joint, [{', '.join(f'[{j_sql(i, 0)}, {j_sql(i, 1)}, {j_sql(i, 2)}]' for i in range(5))}] AS all_p FROM hands), j AS (SELECT det_seq, joint, all_p[joint + 1] AS p FROM p WHERE all_p[joint + 1][3] > 0),
        e AS (SELECT unnest([0, 1, 2, 0]) AS a, unnest([1, 2, 3, 4]) AS b)
        SELECT x.det_seq, a, b, x.p[1] AS from_x, y.p[3] AS to_z FROM j x JOIN e ON x.joint = a JOIN j y ON y.det_seq = x.det_seq AND y.joint = b""",
)
def j14(t: Tables) -> DataFrame:
    d = t.hands.select("det_seq", F.posexplode(F.array(*[joint(i) for i in range(5)])).alias("joint", "p")).withColumn("visible", G.at(F.col("p"), 2) > 0)
    d = S.bones(d, [(0, 1), (1, 2), (2, 3), (0, 4)], ["det_seq"])
    return d.select("det_seq", "a", "b", G.at(F.col("from"), 0).alias("from_x"), G.at(F.col("to"), 2).alias("to_z"))


@query("a21_first_backend", "SELECT side, arg_min(CASE WHEN det_seq % 3 = 0 THEN 'measured' ELSE 'fitted' END, frame_idx * 1000000 + det_seq) AS backend FROM hands WHERE det_seq % 4 > 0 GROUP BY 1")
def a21(t: Tables) -> DataFrame:
    """The first backend that is named, in order of frame and detection."""
    name = F.when(F.col("det_seq") % 4 > 0, F.when(F.col("det_seq") % 3 == 0, "measured").otherwise("fitted"))
    d = t.hands.withColumn("backend", name).where("backend is not null")
    return d.groupBy("side").agg(F.min_by("backend", F.struct("frame_idx", "det_seq")).alias("backend"))


@query("f16_kept_hands", "SELECT det_seq FROM hands WHERE det_seq % 3 = 0 AND confidence > 0.05 AND len(list_filter(flat[1:21], lambda s: s::DOUBLE > 0.1)) >= 3")
def f16(t: Tables) -> DataFrame:
    d = t.hands.withColumns({"class": F.col("det_seq") % 3, "score": F.col("confidence"), "point_scores": F.transform(F.slice("flat", 1, 21), lambda x: x.cast("double"))})
    return S.kept_hands(d, least_score=0.05, least_points=3, least_point_score=0.1).select("det_seq")


def _world_sql(axis: int, link: tuple = tuple(G.OPTICAL_TO_LINK)) -> str:
    turned = ["(" + " + ".join(f"{float(link[3 * k + i])} * p[{i + 1}]" for i in range(3)) + ")" for k in range(3)]
    return " + ".join(f"r{axis}{k} * {turned[k]}" for k in range(3)) + " + " + ("tx", "ty", "tz")[axis]


@query(
    "r15_world_hands",
    f"""WITH {_euler_sql('pose')}, h AS (SELECT det_seq, unnest([0, 4, 8, 20]) AS joint, unnest([{', '.join(f'[{j_sql(i, 0)}, {j_sql(i, 1)}, {j_sql(i, 2)}]' for i in (0, 4, 8, 20))}]) AS p FROM hands WHERE flat[3] <> 0)
        SELECT det_seq, joint, {', '.join(f'round({_world_sql(i)}, 6) AS {n}' for i, n in enumerate('xyz'))} FROM h JOIN m ON det_seq = seq""",
)
def r15(t: Tables) -> DataFrame:
    """Joints of hands with depth, in world axes by the pose of their frame."""
    pose = t.pose.select(F.col("seq").alias("det_seq"), G.quat_to_rot(F.col("qx"), F.col("qy"), F.col("qz"), F.col("qw")).alias("rot"), G.vec(F.col("tx"), F.col("ty"), F.col("tz")).alias("at"))
    joints = F.array(*[F.struct(F.lit(i).alias("joint"), joint(i).alias("p")) for i in (0, 4, 8, 20)])
    d = t.hands.where(F.element_at("flat", 3) != 0).select("det_seq", F.explode(joints).alias("j")).join(pose, "det_seq")
    d = d.withColumn("w", G.optical_to_world(F.col("j.p"), F.col("rot"), F.col("at")))
    return d.select("det_seq", "j.joint", *[r6(G.at(F.col("w"), i), n) for i, n in enumerate("xyz")])


def _axis_sql(name: str, parts: list[str], default: tuple[int, float]) -> str:
    size = [f"abs({p})" for p in parts]
    at = f"CASE WHEN {size[0]} >= greatest({size[1]}, {size[2]}) THEN 0 WHEN {size[1]} >= {size[2]} THEN 1 ELSE 2 END"
    sign = f"sign(CASE WHEN {size[0]} >= greatest({size[1]}, {size[2]}) THEN {parts[0]} WHEN {size[1]} >= {size[2]} THEN {parts[1]} ELSE {parts[2]} END)"
    return f"CASE WHEN seq % 7 = 0 THEN {default[0]} ELSE {at} END AS {name}, CASE WHEN seq % 7 = 0 THEN {default[1]} ELSE {sign} END::DOUBLE AS {name}_sign"


@query(
    "p11_link_axes",
    f"WITH {_euler_sql('pose')} SELECT seq, {_axis_sql('forward', ['r02', 'r12', 'r22'], (0, 1.0))}, {_axis_sql('up', ['-r01', '-r11', '-r21'], (2, 1.0))}, {_axis_sql('rightward', ['r00', 'r10', 'r20'], (1, -1.0))} FROM m",
)
def p11(t: Tables) -> DataFrame:
    rot = F.when(F.col("seq") % 7 != 0, G.quat_to_rot(F.col("qx"), F.col("qy"), F.col("qz"), F.col("qw")))
    d = t.pose.withColumn("rot", rot)
    cols = [c.alias(n) for name, pair in zip(("forward", "up", "rightward"), S.link_axes(F.col("rot")), strict=True) for c, n in zip(pair, (name, f"{name}_sign"), strict=True)]
    return d.select("seq", *cols)


@query("k4_resized_depth", "SELECT frame_seq, x, d.v, mm FROM depth_px d JOIN (SELECT CAST(unnest(range(5)) AS INTEGER) AS x) n ON d.u = CAST(floor(x * 7 / 5.0::DOUBLE) AS INTEGER)")
def k4(t: Tables) -> DataFrame:
    """Rows of depth resized from 7 to 5 columns: each new column takes the nearest old one at or before it."""
    wanted = F.broadcast(t.spark.range(5).select(F.col("id").cast("int").alias("x"), F.floor(F.col("id") * 7 / 5).cast("int").alias("u")))
    return t.depth_px.join(wanted, "u").select("frame_seq", "x", "v", "mm")


_BLOCKS = f"""t AS ({ORACLE_SQL["m4_m8_trajectory"]}), i AS ({ORACLE_SQL["m5_imu"]}), w AS ({ORACLE_SQL["w10_turn_rates"]}), all_r AS (SELECT DISTINCT vec_id % 4 AS recording_id FROM embeddings)"""


def _blocks(t: Tables) -> DataFrame:
    blocks = {"trajectory": trajectory(t.pose, F.lit(60.0)), "imu": imu_quality(t.imu), "turns": turn_rates(t.pose)}
    return S.all_blocks(t["embeddings"].select((F.col("vec_id") % 4).alias("recording_id")), blocks)


@query(
    "m16_all_blocks",
    f"WITH {_BLOCKS} SELECT recording_id, t.recording_id IS NOT NULL AS has_trajectory, pose_count, path_length_m, i.sample_count, i.gravity_deviation, w.yaw_rate_deg_per_s FROM all_r LEFT JOIN t USING (recording_id) LEFT JOIN i USING (recording_id) LEFT JOIN w USING (recording_id)",
)
def m16(t: Tables) -> DataFrame:
    """Every recording's blocks in one row; the one that has no streams keeps its row."""
    return _blocks(t).select(
        "recording_id", F.col("trajectory").isNotNull().alias("has_trajectory"), "trajectory.pose_count", r6(F.col("trajectory.path_length_m"), "path_length_m"),
        "imu.sample_count", F.round("imu.gravity_deviation", 5).alias("gravity_deviation"), r6(F.col("turns.yaw_rate_deg_per_s"), "yaw_rate_deg_per_s"),
    )


@query(
    "r8_r9_report_rows",
    f"""WITH {_BLOCKS} SELECT recording_id, 'trajectory' AS section, 0 AS place, 'poses' AS label, coalesce(format('{{:,}}', pose_count), '—') AS value, 'plain' AS tone FROM all_r LEFT JOIN t USING (recording_id)
        UNION ALL SELECT recording_id, 'trajectory', 1, 'path, m', coalesce(printf('%.2f', path_length_m), '—'), 'plain' FROM all_r LEFT JOIN t USING (recording_id)
        UNION ALL SELECT recording_id, 'imu', 0, 'samples', coalesce(format('{{:,}}', sample_count), '—'), 'plain' FROM all_r LEFT JOIN i USING (recording_id)
        UNION ALL SELECT recording_id, 'imu', 1, 'jolts', coalesce(format('{{:,}}', jolt_count), '—'), CASE WHEN jolt_count IS NULL THEN 'neutral' WHEN jolt_count = 0 THEN 'good' ELSE 'bad' END FROM all_r LEFT JOIN i USING (recording_id)""",
)
def r8(t: Tables) -> DataFrame:
    """Report sections in long form."""
    d = _blocks(t)
    jolts = F.col("imu.jolt_count")
    path = S.long_form(d, "trajectory", [("poses", "trajectory.pose_count", None, None), ("path, m", "trajectory.path_length_m", 2, None)])
    imu = S.long_form(d, "imu", [("samples", "imu.sample_count", None, None), ("jolts", "imu.jolt_count", None, F.when(jolts.isNull(), "neutral").when(jolts == 0, "good").otherwise("bad"))])
    return path.unionByName(imu)


@query(
    "m1_recording",
    f"""WITH s AS (SELECT recording_id, topic, count(*) AS n, min(t_us) AS a, max(t_us) AS b FROM streams GROUP BY 1, 2),
        g AS (SELECT recording_id, min(a) AS a, max(b) AS b, CAST(sum(n) AS BIGINT) AS n, string_agg(topic || '=' || n, ',' ORDER BY topic) AS topic_counts, CAST(count(*) AS INTEGER) AS present FROM s GROUP BY 1),
        f AS (SELECT CAST(r_regionkey AS BIGINT) AS recording_id, 3000000 * CAST(r_regionkey AS BIGINT) AS size_bytes FROM region),
        m AS (SELECT f.recording_id, string_agg(r.topic, ',' ORDER BY r.topic) AS missing FROM f CROSS JOIN (VALUES {", ".join(f"('{x}')" for x in REQUIRED)}) AS r(topic) ANTI JOIN s ON s.recording_id = f.recording_id AND s.topic = r.topic GROUP BY 1),
        w AS (SELECT recording_id, CAST(round_even((b - a) / 1e6::DOUBLE, 0) AS BIGINT) AS w FROM g)
        SELECT f.recording_id, 'session_' || f.recording_id || '.mcap' AS filename, size_bytes, round(size_bytes / 1048576.0::DOUBLE, 6) AS size_mb, coalesce((b - a) / 1e6::DOUBLE, 0) AS duration_s,
            CASE WHEN w IS NULL THEN '00:00:00' ELSE CASE WHEN w // 3600 < 10 THEN '0' ELSE '' END || w // 3600 || ':' || lpad(CAST(w // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(w % 60 AS VARCHAR), 2, '0') END AS duration_hms,
            coalesce(strftime(make_timestamp(a), '%Y-%m-%dT%H:%M:%S'), '') AS start_iso, coalesce(strftime(make_timestamp(b), '%Y-%m-%dT%H:%M:%S'), '') AS end_iso, coalesce(strftime(make_timestamp(a), '%A'), '') AS weekday,
            coalesce(n, 0) AS message_count, coalesce(topic_counts, '') AS topic_counts, coalesce(present, 0) AS topics_present_count, coalesce(missing, '') AS missing_topics
        FROM f LEFT JOIN g USING (recording_id) LEFT JOIN w USING (recording_id) LEFT JOIN m USING (recording_id)""",
)
def m1(t: Tables) -> DataFrame:
    """The recording block of each file; three files hold no messages."""
    key = F.col("r_regionkey").cast("long")
    files = t["region"].select(key.alias("recording_id"), F.concat(F.lit("/recordings/session_"), key.cast("string"), F.lit(".mcap")).alias("path"), (3000000 * key).alias("size_bytes"))
    topics = t.streams.groupBy("recording_id", "topic").agg(F.count("*").alias("message_count"), F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"))
    d = S.recording_block(files, topics, REQUIRED)
    counts = F.concat_ws(",", F.transform("topic_counts", lambda x: F.concat_ws("=", x["topic"], x["message_count"].cast("string"))))
    return d.select(
        "recording_id", "filename", "size_bytes", r6(F.col("size_mb"), "size_mb"), "duration_s", "duration_hms", "start_iso", "end_iso", "weekday", "message_count",
        counts.alias("topic_counts"), "topics_present_count", F.concat_ws(",", "missing_reference_topics").alias("missing_topics"),
    )


def _arm_sql(side: str, a: int) -> str:
    """Mean elbow angle and reach of the arm whose joints are a, a + 1, a + 2."""
    counts = " AND ".join([*[f"{j_sql(i, 2)} > 0" for i in range(a, a + 3)], f"{d_sql(a, a + 1)} > 1e-6", f"{d_sql(a + 2, a + 1)} > 1e-6"])
    dot = " + ".join(f"({j_sql(a, k)} - {j_sql(a + 1, k)}) * ({j_sql(a + 2, k)} - {j_sql(a + 1, k)})" for k in range(3))
    angle = f"degrees(acos(greatest(-1, least(1, ({dot}) / ({d_sql(a, a + 1)} * {d_sql(a + 2, a + 1)})))))"
    return f"round(avg(CASE WHEN {counts} THEN {angle} END), 5) AS elbow_{side}_mean_deg, round(avg(CASE WHEN {counts} THEN {d_sql(a, a + 2)} END), 6) AS reach_{side}_mean_m"


@query(
    "m13_skeleton",
    f"""SELECT frame_idx % 3 AS recording_id, count(*) AS frame_count, 100.0::DOUBLE AS detection_pct, {", ".join(f"round(100.0::DOUBLE * count(*) FILTER ({j_sql(i, 2)} > 0) / count(*), 6) AS {n}_pct" for i, n in enumerate(S.BODY_JOINTS))},
        {_arm_sql("left", 3)}, {_arm_sql("right", 6)}, round(avg(CASE WHEN {j_sql(0, 2)} > 0 THEN {j_sql(0, 1)} END), 6) AS head_height_mean_m FROM hands GROUP BY 1""",
)
def m13_skeleton(t: Tables) -> DataFrame:
    """The skeleton block; a joint is visible where its depth is positive."""
    joints = F.array(*[joint(i) for i in range(len(S.BODY_JOINTS))])
    d = t.hands.select((F.col("frame_idx") % 3).alias("recording_id"), joints.alias("joints"), F.transform(joints, lambda p: G.at(p, 2) > 0).alias("visible"))
    means = [(c, 5 if c.endswith("deg") else 6) for c in ("elbow_left_mean_deg", "elbow_right_mean_deg", "reach_left_mean_m", "reach_right_mean_m", "head_height_mean_m")]
    shares = [r6(F.col(f"joint_visibility_pct.{n}"), f"{n}_pct") for n in S.BODY_JOINTS]
    return S.skeleton_block(d).select("recording_id", "frame_count", "detection_pct", *shares, *[F.round(c, n).alias(c) for c, n in means])
