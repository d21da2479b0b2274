"""Queries on streams: alignment in time, counts, gaps, distributions. Test streams run 3600 times slower than real ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.asof import nearest, nearest_within, nearest_within_each
from strandline.operators.quality import stream_gaps, sync_quality, transform_pairs
from strandline.operators.quantiles import quantiles
from strandline.operators.series import numbered, with_previous
from strandline.plans.base import Tables, query, r6

#: Microseconds: 0.1 s for depth and pose, 0.05 s for the inertial stream, on the slow clock.
WIDE, NARROW = 360_000_000, 180_000_000
SIDES = (("click", "depth", WIDE), ("purchase", "pose", WIDE), ("signup", "imu", NARROW))
#: The topics a recording must have, here the test streams and two that they lack.
REQUIRED = ("click", "error", "mesh", "point_cloud", "purchase", "signup", "view")


def near_sql(name: str, left: str, right: str, tolerance: int | None = None) -> str:
    """CTEs that give (seq, r_seq, r_t_us) of the nearest row; ties go to the earlier one."""
    within = f"abs(l.t_us - %s) <= {tolerance}" if tolerance is not None else "true"
    take = "CASE WHEN n.t IS NULL OR (p.t IS NOT NULL AND l.t_us - p.t <= n.t - l.t_us) THEN p.{0} ELSE n.{0} END"
    t = take.format("t")
    return f"""{name}_p AS (SELECT l.seq, r.seq AS s, r.t_us AS t FROM {left} l ASOF LEFT JOIN {right} r ON l.recording_id = r.recording_id AND l.t_us >= r.t_us),
        {name}_n AS (SELECT l.seq, r.seq AS s, r.t_us AS t FROM {left} l ASOF LEFT JOIN {right} r ON l.recording_id = r.recording_id AND l.t_us <= r.t_us),
        {name} AS (SELECT l.seq, CASE WHEN {within % t if tolerance is not None else within} THEN {take.format("s")} END AS r_seq, CASE WHEN {within % t if tolerance is not None else within} THEN {t} END AS r_t_us
            FROM {left} l JOIN {name}_p p USING (seq) JOIN {name}_n n USING (seq))"""


def topics_sql(*names: str) -> str:
    return ", ".join(f"{n} AS (SELECT recording_id, seq, t_us, value FROM streams WHERE topic = '{n}')" for n in names)


def sync_frames(t: Tables) -> DataFrame:
    """One shuffle for all four streams."""
    return nearest_within_each(t.topic("view").select("recording_id", "seq", "t_us"), [(t.topic(topic), tolerance, f"{name}_") for topic, name, tolerance in SIDES])


SYNC_CTES = ", ".join([topics_sql("view", "click", "purchase", "signup"), *[near_sql(f"{name}_m", "view", topic, tol) for topic, name, tol in SIDES]])


@query("j1_nearest_row", f"WITH {topics_sql('error', 'click')}, {near_sql('near', 'error', 'click')} SELECT e.recording_id, e.seq, r_seq, r_t_us FROM error e JOIN near USING (seq)")
def j1(t: Tables) -> DataFrame:
    return nearest(t.topic("error").select("recording_id", "seq", "t_us"), t.topic("click"), 86_400_000_000).select("recording_id", "seq", "r_seq", "r_t_us")


@query("j2_nearest_within", f"WITH {topics_sql('error', 'click')}, {near_sql('near', 'error', 'click', WIDE)} SELECT e.recording_id, e.seq, r_seq, r_t_us FROM error e JOIN near USING (seq)")
def j2(t: Tables) -> DataFrame:
    return nearest_within(t.topic("error").select("recording_id", "seq", "t_us"), t.topic("click"), WIDE).select("recording_id", "seq", "r_seq", "r_t_us")


@query(
    "j3_sync_frames",
    f"""WITH {SYNC_CTES} SELECT v.recording_id, v.seq, v.t_us, d.r_seq AS depth_seq, d.r_t_us AS depth_t_us, p.r_seq AS pose_seq, p.r_t_us AS pose_t_us, i.r_seq AS imu_seq, i.r_t_us AS imu_t_us
        FROM view v JOIN depth_m d USING (seq) JOIN pose_m p USING (seq) JOIN imu_m i USING (seq)""",
)
def j3(t: Tables) -> DataFrame:
    return sync_frames(t)


@query("j4_nearest_gap", f"WITH {topics_sql('view', 'signup')}, {near_sql('near', 'view', 'signup')} SELECT v.recording_id, v.seq, abs(v.t_us - r_t_us) AS gap_us FROM view v JOIN near USING (seq)")
def j4(t: Tables) -> DataFrame:
    near = nearest(t.topic("view").select("recording_id", "seq", "t_us"), t.topic("signup"), 86_400_000_000)
    return near.select("recording_id", "seq", F.abs(F.col("t_us") - F.col("r_t_us")).alias("gap_us"))


@query("j5_payload_join", f"WITH {topics_sql('view', 'click')}, {near_sql('near', 'view', 'click', WIDE)} SELECT n.seq, r_seq AS depth_seq, c.value AS payload FROM near n LEFT JOIN click c ON c.seq = r_seq")
def j5(t: Tables) -> DataFrame:
    """Payloads join last, on the row number the alignment found."""
    near = nearest_within(t.topic("view").select("recording_id", "seq", "t_us"), t.topic("click"), WIDE, prefix="depth_")
    return near.join(t.topic("click").select(F.col("seq").alias("depth_seq"), F.col("value").alias("payload")), "depth_seq", "left").select("seq", "depth_seq", "payload")


@query("j12_missing_topics", "SELECT r.topic FROM (VALUES " + ", ".join(f"('{x}')" for x in REQUIRED) + ") AS r(topic) WHERE r.topic NOT IN (SELECT event_type FROM events)")
def j12(t: Tables) -> DataFrame:
    required = t.spark.createDataFrame([(x,) for x in REQUIRED], "topic string")
    return required.join(t.streams.select("topic").distinct(), "topic", "left_anti")


@query("s2_summary", "SELECT recording_id, topic, count(*) AS message_count, min(t_us) AS start_us, max(t_us) AS end_us, (max(t_us) - min(t_us)) / 1e6::DOUBLE AS duration_s FROM streams GROUP BY 1, 2")
def s2(t: Tables) -> DataFrame:
    g = t.streams.groupBy("recording_id", "topic").agg(F.count("*").alias("message_count"), F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"))
    return g.withColumn("duration_s", (F.col("end_us") - F.col("start_us")) / 1e6)


@query("s3_topic_scan", "SELECT seq, recording_id, t_us, value FROM streams WHERE topic = 'signup'")
def s3(t: Tables) -> DataFrame:
    return t.topic("signup").select("seq", "recording_id", "t_us", "value")


@query(
    "s4_s5_first_and_last",
    "SELECT recording_id, topic, arg_min(value, seq) AS first_value, min(seq) AS first_seq, arg_max(value, seq) AS last_value, max(seq) AS last_seq FROM streams GROUP BY 1, 2",
)
def s4(t: Tables) -> DataFrame:
    return t.streams.groupBy("recording_id", "topic").agg(F.min_by("value", "seq").alias("first_value"), F.min("seq").alias("first_seq"), F.max_by("value", "seq").alias("last_value"), F.max("seq").alias("last_seq"))


@query("s16_stamp_seconds", "SELECT seq, (t_us // 1000000) + ((t_us % 1000000) * 1000) * 1e-9::DOUBLE AS ts FROM streams")
def s16(t: Tables) -> DataFrame:
    sec, nanosec = F.floor(F.col("t_us") / 1_000_000), (F.col("t_us") % 1_000_000) * 1000
    return t.streams.select("seq", (sec + nanosec * F.lit(1e-9)).alias("ts"))


@query("s17_schema_text", r"SELECT c_custkey, regexp_replace('geometry_msgs/msg/' || c_mktsegment || ' pose', '(\b\w+)/msg/(\w+)', '\1/\2', 'g') AS schema_text FROM customer")
def s17(t: Tables) -> DataFrame:
    text = F.concat(F.lit("geometry_msgs/msg/"), "c_mktsegment", F.lit(" pose"))
    return t["customer"].select("c_custkey", F.regexp_replace(text, r"(\b\w+)/msg/(\w+)", "$1/$2").alias("schema_text"))


@query(
    "s18_r2_typed_views",
    "SELECT topic, recording_id, seq, row_number() OVER (PARTITION BY recording_id, topic ORDER BY seq) - 1 AS idx, t_us / 1e6::DOUBLE AS ts FROM streams",
)
def s18(t: Tables) -> DataFrame:
    return numbered(t.streams, ["recording_id", "topic"], ["seq"], "idx").select("topic", "recording_id", "seq", "idx", (F.col("t_us") / 1e6).alias("ts"))


@query(
    "s21_cloud_choice",
    """WITH x AS (SELECT recording_id, topic, seq, value FROM streams WHERE topic IN ('error', 'click')),
        c AS (SELECT recording_id, max(seq) FILTER (topic = 'error') AS last_mesh, min(seq) FILTER (topic = 'click') AS first_cloud FROM x GROUP BY 1)
        SELECT c.recording_id, x.seq, x.value FROM c JOIN x ON x.seq = coalesce(last_mesh, first_cloud)""",
)
def s21(t: Tables) -> DataFrame:
    """The last message of one topic, else the first of another."""
    x = t.streams.where(F.col("topic").isin("error", "click"))
    row = F.struct("seq", "value")
    last, first = F.max_by(F.when(F.col("topic") == "error", row), F.when(F.col("topic") == "error", F.col("seq"))), F.min_by(F.when(F.col("topic") == "click", row), F.when(F.col("topic") == "click", F.col("seq")))
    return x.groupBy("recording_id").agg(F.coalesce(last, first).alias("x")).select("recording_id", "x.seq", "x.value")


@query(
    "s24_format_check",
    "SELECT s.recording_id, r.topic FROM (VALUES " + ", ".join(f"('{x}')" for x in REQUIRED) + ") AS r(topic), (SELECT DISTINCT recording_id FROM streams) s WHERE NOT EXISTS (SELECT 1 FROM streams x WHERE x.recording_id = s.recording_id AND x.topic = r.topic)",
)
def s24(t: Tables) -> DataFrame:
    """Each recording's missing topics: one array per recording, no join of all topics with all recordings."""
    have = t.streams.groupBy("recording_id").agg(F.collect_set("topic").alias("have"))
    return have.select("recording_id", F.explode(F.array_except(F.array(*map(F.lit, REQUIRED)), "have")).alias("topic"))


@query("f1_decimate", "SELECT recording_id, seq FROM streams WHERE seq % 10 = 0")
def f1(t: Tables) -> DataFrame:
    return t.streams.where(F.pmod("seq", F.lit(10)) == 0).select("recording_id", "seq")


@query("f2_f3_schedule", "WITH x AS (SELECT recording_id, seq, max(seq) OVER (PARTITION BY recording_id) AS last, row_number() OVER (PARTITION BY recording_id ORDER BY seq) AS n FROM streams) SELECT recording_id, seq, n FROM x WHERE (seq % 7 = 0 OR seq = last) AND n <= 5000")
def f2(t: Tables) -> DataFrame:
    """Every seventh frame and the last one, within a cap on the frame number."""
    x = numbered(t.streams.select("recording_id", "seq"), ["recording_id"], ["seq"]).withColumn("n", F.col("n") + 1).where("n <= 5000")
    last = t.streams.groupBy("recording_id").agg(F.max("seq").alias("last"))
    return x.join(last, "recording_id").where((F.col("seq") % 7 == 0) | (F.col("seq") == F.col("last"))).select("recording_id", "seq", "n")


@query("a1_topic_counts", "SELECT recording_id, topic, count(*) AS n FROM streams GROUP BY 1, 2")
def a1(t: Tables) -> DataFrame:
    return t.streams.groupBy("recording_id", "topic").agg(F.count("*").alias("n"))


@query(
    "a4_a5_distribution",
    "SELECT topic, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (5, 10, 50, 90, 95)) + ", round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS low, max(value) AS high FROM streams GROUP BY 1",
)
def a4(t: Tables) -> DataFrame:
    at = (5, 10, 50, 90, 95)
    g = t.streams.groupBy("topic").agg(r6(F.avg("value"), "mean"), r6(F.stddev_pop("value"), "std"), F.min("value").alias("low"), F.max("value").alias("high"))
    q = quantiles(t.streams, ["topic"], {"value": {f"p{p}": p / 100 for p in at}})
    return g.join(q, "topic", "left").select("topic", *[r6(F.col(f"p{p}"), f"p{p}") for p in at], "mean", "std", "low", "high")


@query(
    "a8_equal_width_histogram",
    """WITH e AS (SELECT topic, min(value) AS lo, max(value) AS hi FROM streams GROUP BY 1)
        SELECT topic, least(39, CAST(floor((value - lo) / ((hi - lo) / 40)) AS BIGINT)) AS bin, count(*) AS n FROM streams JOIN e USING (topic) GROUP BY 1, 2""",
)
def a8(t: Tables) -> DataFrame:
    ends = t.streams.groupBy("topic").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # One value alone has no width: it is in bin 0.
    at = F.coalesce(F.try_divide(F.col("value") - F.col("lo"), (F.col("hi") - F.col("lo")) / 40), F.lit(0.0))
    bin_ = F.least(F.lit(39).cast("long"), F.floor(at))
    return t.streams.join(ends, "topic").groupBy("topic", bin_.alias("bin")).agg(F.count("*").alias("n"))


@query(
    "a9_a12_a23_conditional",
    """SELECT recording_id, count(*) FILTER (value > 400) AS large, coalesce(round(100.0 * count(*) FILTER (value > 400) / nullif(count(*), 0), 6), 0) AS large_pct,
        round(sum(value) FILTER (value > 400) / nullif(sum(value) FILTER (value < -1), 0), 6) AS ratio, bool_or(value > 400) AS any_large, bool_and(value > 0) AS all_positive, count(DISTINCT topic) AS topics FROM streams GROUP BY 1""",
)
def a9(t: Tables) -> DataFrame:
    v = F.col("value")
    large = F.count_if(v > 400)
    return t.streams.groupBy("recording_id").agg(
        large.alias("large"),
        F.coalesce(r6(100.0 * large / F.nullif(F.count("*"), F.lit(0))), F.lit(0.0)).alias("large_pct"),
        r6(F.try_divide(F.sum(F.when(v > 400, v)), F.sum(F.when(v < -1, v))), "ratio"),
        F.bool_or(v > 400).alias("any_large"),
        F.bool_and(v > 0).alias("all_positive"),
        F.countDistinct("topic").alias("topics"),
    )


@query(
    "m2_rgb_stream",
    """WITH d AS (SELECT recording_id, (t_us - lag(t_us) OVER (PARTITION BY recording_id ORDER BY seq)) / 3600000.0::DOUBLE AS dt FROM streams WHERE topic = 'view'),
        m AS (SELECT recording_id, count(*) AS frame_count, quantile_cont(dt, 0.5) AS med, min(dt) AS lo, max(dt) AS hi, stddev_pop(dt) AS sd FROM d GROUP BY 1),
        g AS (SELECT recording_id, count(*) FILTER (dt > 2 * med) AS gap_count FROM d JOIN m USING (recording_id) GROUP BY 1),
        s AS (SELECT recording_id, (max(t_us) - min(t_us)) / 3600000000.0::DOUBLE AS duration FROM streams GROUP BY 1)
        SELECT recording_id, frame_count, round(frame_count / nullif(duration, 0), 6) AS effective_fps, round(med, 6) AS median_dt_ms, round(lo, 6) AS min_dt_ms, round(hi, 6) AS max_dt_ms, round(sd, 6) AS dt_std_ms, gap_count
        FROM m JOIN g USING (recording_id) JOIN s USING (recording_id)""",
)
def m2(t: Tables) -> DataFrame:
    q = stream_gaps(t.topic("view"), t.streams, scale=3600)
    return q.select("recording_id", "frame_count", *[r6(F.col(c), c) for c in ("effective_fps", "median_dt_ms", "min_dt_ms", "max_dt_ms", "dt_std_ms")], "gap_count")


@query(
    "m6_a3_tracking_states",
    "SELECT state_str AS state, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM tracking), 6) AS pct FROM tracking GROUP BY 1",
)
def m6(t: Tables) -> DataFrame:
    g = t.tracking.groupBy(F.coalesce("state_str", F.lit("?")).alias("state")).agg(F.count("*").alias("n"))
    # The window is over one row per state.
    return g.select("state", "n", r6(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), "pct"))


@query(
    "m7_a2_transform_pairs",
    """WITH p AS (SELECT parent, child, count(*) AS n, min(seq) AS first_seq FROM tf GROUP BY 1, 2)
        SELECT parent, child, n, round(n / 120.0::DOUBLE, 6) AS rate_hz, row_number() OVER (ORDER BY n DESC, first_seq) AS place, count(*) OVER () AS pairs FROM p""",
)
def m7(t: Tables) -> DataFrame:
    p = transform_pairs(t.tf, 120.0)
    return p.select("parent", "child", "n", r6(F.col("rate_hz"), "rate_hz"), "place", "pairs")


@query(
    "s25_link_rotation",
    "SELECT arg_min(child, seq) AS child, min(seq) AS seq FROM tf WHERE contains(parent, 'AS') AND contains(child, 'NATION')",
)
def s25(t: Tables) -> DataFrame:
    """The first transform whose frame names match."""
    x = t.tf.where(F.contains("parent", F.lit("AS")) & F.contains("child", F.lit("NATION")))
    return x.agg(F.min_by("child", "seq").alias("child"), F.min("seq").alias("seq"))


def m11_sql() -> str:
    parts = [
        f"""SELECT recording_id, '{name}' AS stream, round(quantile_cont(gap, 0.5), 6) AS median_ms, round(quantile_cont(gap, 0.95), 6) AS p95_ms, round(max(gap), 6) AS max_ms,
        round(100.0 * count(*) FILTER (gap <= 50) / count(*), 6) AS within_50ms_pct, round(100.0 * count(*) FILTER (gap <= 100) / count(*), 6) AS within_100ms_pct
        FROM (SELECT v.recording_id, abs(v.t_us - r_t_us) / 3600000.0::DOUBLE AS gap FROM view v JOIN {name}_m USING (seq)) GROUP BY 1"""
        for _, name, _ in SIDES
    ]
    return f"WITH {topics_sql('view', 'click', 'purchase', 'signup')}, " + ", ".join(near_sql(f"{name}_m", "view", topic) for topic, name, _ in SIDES) + " " + " UNION ALL ".join(parts)


@query("m11_sync_quality", m11_sql())
def m11(t: Tables) -> DataFrame:
    left = t.topic("view").select("recording_id", "seq", "t_us")
    parts = [sync_quality(left, t.topic(topic), name, scale=3600) for topic, name, _ in SIDES]
    out = reduce(DataFrame.unionByName, parts)
    return out.select("recording_id", "stream", *[r6(F.col(c), c) for c in ("median_ms", "p95_ms", "max_ms", "within_50ms_pct", "within_100ms_pct")])


@query(
    "r1_session_counts",
    "SELECT recording_id, (max(t_us) - min(t_us)) / 1e6::DOUBLE AS duration_s, count(*) FILTER (topic = 'view') AS num_rgb_frames, count(*) FILTER (topic = 'click') AS num_depth_frames FROM streams GROUP BY 1",
)
def r1(t: Tables) -> DataFrame:
    return t.streams.groupBy("recording_id").agg(((F.max("t_us") - F.min("t_us")) / 1e6).alias("duration_s"), F.count_if(F.col("topic") == "view").alias("num_rgb_frames"), F.count_if(F.col("topic") == "click").alias("num_depth_frames"))


@query(
    "w1_first_difference",
    "SELECT recording_id, topic, seq, (t_us - lag(t_us) OVER (PARTITION BY recording_id, topic ORDER BY seq)) / 1e6::DOUBLE AS dt FROM streams",
)
def w1(t: Tables) -> DataFrame:
    x = t.streams.withColumn("lane", F.concat_ws("/", "recording_id", "topic"))
    return with_previous(x, ["t_us"], by="lane").select("recording_id", "topic", "seq", ((F.col("t_us") - F.col("prev_t_us")) / 1e6).alias("dt"))


@query(
    "v4_gap_histogram",
    f"WITH {topics_sql('view', 'click')}, {near_sql('near', 'view', 'click')} SELECT CAST(least(59, abs(v.t_us - r_t_us) // 60000000) AS BIGINT) AS bin, count(*) AS n, bool_and(abs(v.t_us - r_t_us) <= {NARROW}) AS within FROM view v JOIN near USING (seq) GROUP BY 1",
)
def v4(t: Tables) -> DataFrame:
    near = nearest(t.topic("view").select("recording_id", "seq", "t_us"), t.topic("click"), 86_400_000_000)
    gap = F.abs(F.col("t_us") - F.col("r_t_us"))
    return near.groupBy(F.least(F.lit(59).cast("long"), F.floor(gap / 60_000_000)).alias("bin")).agg(F.count("*").alias("n"), F.bool_and(gap <= NARROW).alias("within"))


@query(
    "v6_coverage",
    """WITH b AS (SELECT recording_id, min(t_us) AS t0 FROM streams GROUP BY 1)
        SELECT recording_id, topic, (t_us - t0) // 3600000000 AS slot, count(*) AS n FROM streams JOIN b USING (recording_id) GROUP BY 1, 2, 3""",
)
def v6(t: Tables) -> DataFrame:
    base = t.streams.groupBy("recording_id").agg(F.min("t_us").alias("t0"))
    return t.streams.join(base, "recording_id").groupBy("recording_id", "topic", F.floor((F.col("t_us") - F.col("t0")) / 3_600_000_000).alias("slot")).agg(F.count("*").alias("n"))


@query(
    "x1_x3_time_text",
    """WITH x AS (SELECT event_id AS seq, event_id * 37.5::DOUBLE AS s, epoch_us(ts) // 1000000 AS t FROM events), y AS (SELECT *, CAST(round_even(s, 0) AS BIGINT) AS w FROM x)
        SELECT seq, CASE WHEN w // 3600 < 10 THEN '0' ELSE '' END || w // 3600 || ':' || lpad(CAST(w // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(w % 60 AS VARCHAR), 2, '0') AS hms,
        strftime(make_timestamp(t * 1000000), '%Y-%m-%dT%H:%M:%S') AS iso, strftime(make_timestamp(t * 1000000), '%A') AS weekday FROM y""",
)
def x1(t: Tables) -> DataFrame:
    from strandline.functions.geometry import hms, iso, weekday

    t_s = F.floor(F.col("t_us") / 1_000_000).cast("double")
    return t.streams.select("seq", hms(F.col("seq") * F.lit(37.5)).alias("hms"), iso(t_s).alias("iso"), weekday(t_s).alias("weekday"))


@query(
    "x5_x7_tones",
    "SELECT seq, CASE WHEN value >= 300 THEN 'good' WHEN value >= 100 THEN 'warn' ELSE 'bad' END AS tone, CASE WHEN value >= 300 THEN 'Good' WHEN value >= 100 THEN 'Watch' ELSE 'Issues' END AS label, CASE WHEN abs(value - 9.81) < 0.5 THEN 'good' ELSE 'warn' END AS gravity_tone FROM streams",
)
def x5(t: Tables) -> DataFrame:
    from strandline.functions.geometry import tone

    name = tone(F.col("value"), 300, 100)
    label = F.when(name == "good", "Good").when(name == "warn", "Watch").when(name == "bad", "Issues")
    return t.streams.select("seq", name.alias("tone"), label.alias("label"), F.when(F.abs(F.col("value") - 9.81) < 0.5, "good").otherwise("warn").alias("gravity_tone"))
