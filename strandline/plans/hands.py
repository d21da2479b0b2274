"""Queries on hand detections: selection, dense tables, sanity, measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import geometry as G
from strandline.operators.quantiles import quantiles
from strandline.operators.series import interpolate, over_halo
from strandline.plans.base import Tables, query, r6

FRAMES = 240


def joint(i: int) -> Column:
    return G.vec(*[F.element_at("flat", 3 * i + k + 1).cast("double") for k in range(3)])


def j_sql(i: int, axis: int) -> str:
    return f"flat[{3 * i + axis + 1}]::DOUBLE"


def d_sql(i: int, j: int) -> str:
    return "sqrt(" + " + ".join(f"({j_sql(i, k)} - {j_sql(j, k)}) ** 2" for k in range(3)) + ")"


def spread() -> Column:
    xs, ys = (F.array(*[F.element_at("flat", 3 * i + k + 1).cast("double") for i in range(21)]) for k in (0, 1))
    return F.array_max(xs) - F.array_min(xs) + F.array_max(ys) - F.array_min(ys)


def _list_sql(axis: int) -> str:
    return "[" + ", ".join(j_sql(i, axis) for i in range(21)) + "]"


SPREAD_SQL = f"(list_max({_list_sql(0)}) - list_min({_list_sql(0)}) + list_max({_list_sql(1)}) - list_min({_list_sql(1)}))"


@query("t1_widest_hand", f"SELECT frame_idx, side, det_seq FROM (SELECT frame_idx, side, det_seq, row_number() OVER (PARTITION BY frame_idx, side ORDER BY {SPREAD_SQL} DESC, det_seq) AS n FROM hands) WHERE n = 1")
def t1(t: Tables) -> DataFrame:
    """An aggregate, not a window: partial on each side of the shuffle."""
    return t.hands.groupBy("frame_idx", "side").agg(F.max_by("det_seq", F.struct(spread(), -F.col("det_seq"))).alias("det_seq"))


@query("t2_surest_hand", "SELECT frame_idx, side, det_seq FROM (SELECT *, row_number() OVER (PARTITION BY frame_idx, side ORDER BY confidence DESC, det_seq) AS n FROM hands) WHERE n = 1")
def t2(t: Tables) -> DataFrame:
    return t.hands.groupBy("frame_idx", "side").agg(F.max_by("det_seq", F.struct("confidence", -F.col("det_seq"))).alias("det_seq"))


@query("t7_last_write", "SELECT frame_idx, max(det_seq) AS det_seq, arg_max(confidence, det_seq) AS confidence FROM hands GROUP BY 1")
def t7(t: Tables) -> DataFrame:
    return t.hands.groupBy("frame_idx").agg(F.max("det_seq").alias("det_seq"), F.max_by("confidence", "det_seq").alias("confidence"))


@query(
    "k7_dense_hands",
    f"""WITH l AS (SELECT frame_idx, side, arg_max(confidence, det_seq) AS confidence, max(det_seq) AS det_seq FROM hands WHERE frame_idx >= 0 AND frame_idx < {FRAMES} GROUP BY 1, 2), f AS (SELECT CAST(unnest(range({FRAMES})) AS INTEGER) AS frame_idx)
        SELECT f.frame_idx, a.det_seq AS left_seq, b.det_seq AS right_seq, a.confidence AS left_confidence, b.confidence AS right_confidence, a.det_seq IS NOT NULL AS left_valid, b.det_seq IS NOT NULL AS right_valid
        FROM f LEFT JOIN l a ON a.frame_idx = f.frame_idx AND a.side = 'left' LEFT JOIN l b ON b.frame_idx = f.frame_idx AND b.side = 'right'""",
)
def k7(t: Tables) -> DataFrame:
    """One row per frame; of several hands of a side the last one stands."""
    one = lambda side, c: F.max_by(F.when(F.col("side") == side, F.col(c)), F.when(F.col("side") == side, F.col("det_seq")))
    g = t.hands.groupBy("frame_idx").agg(one("left", "det_seq").alias("left_seq"), one("right", "det_seq").alias("right_seq"), one("left", "confidence").alias("left_confidence"), one("right", "confidence").alias("right_confidence"))
    frames = t.spark.range(FRAMES).select(F.col("id").cast("int").alias("frame_idx"))
    return frames.join(g, "frame_idx", "left").withColumns({"left_valid": F.col("left_seq").isNotNull(), "right_valid": F.col("right_seq").isNotNull()})


@query(
    "f11_f15_sane_hands",
    f"SELECT det_seq, side FROM hands WHERE list_max(list_transform(flat[1:63], lambda x: abs(x::DOUBLE))) <= 0.4 AND {j_sql(0, 2)} >= -0.2 AND greatest({', '.join(d_sql(i, 0) for i in range(1, 21))}) BETWEEN 0.02 AND 0.5",
)
def f11(t: Tables) -> DataFrame:
    """No far coordinate, a wrist in front, joints neither too near to it nor too far."""
    reach = F.array_max(F.array(*[G.norm(G.sub(joint(i), joint(0))) for i in range(1, 21)]))
    far = F.exists(F.slice("flat", 1, 63), lambda x: F.abs(x.cast("double")) > 0.4)
    return t.hands.where(~far & (G.at(joint(0), 2) >= -0.2) & reach.between(0.02, 0.5)).select("det_seq", "side")


@query(
    "g13_palm_and_grip",
    f"SELECT det_seq, round({d_sql(5, 17)}, 6) AS palm_width, round(({' + '.join(d_sql(i, 0) for i in (4, 8, 12, 16, 20))}) / 5, 6) AS grip FROM hands",
)
def g13(t: Tables) -> DataFrame:
    tips = [G.norm(G.sub(joint(i), joint(0))) for i in (4, 8, 12, 16, 20)]
    return t.hands.select("det_seq", r6(G.norm(G.sub(joint(5), joint(17))), "palm_width"), r6(sum(tips[1:], tips[0]) / 5, "grip"))


@query("g18_turned_joints", "SELECT det_seq, i AS joint, -flat[3 * i + 2] AS x, flat[3 * i + 1] AS y, flat[3 * i + 3] AS z FROM (SELECT det_seq, flat, unnest(range(21)) AS i FROM hands)")
def g18(t: Tables) -> DataFrame:
    """Joints of an image turned by 90 degrees."""
    d = t.hands.select("det_seq", "flat", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    e = lambda k: F.get("flat", 3 * F.col("i") + k)
    return d.select("det_seq", F.col("i").cast("long").alias("joint"), (-e(1)).alias("x"), e(0).alias("y"), e(2).alias("z"))


@query(
    "t8_anchor_joint",
    "SELECT det_seq, coalesce(CASE WHEN a > 0 THEN a END, CASE WHEN b > 0 THEN b END, CASE WHEN c > 0 THEN c END, CASE WHEN len(list_filter(z, lambda x: x > 0)) >= 3 THEN list_aggregate(list_filter(z, lambda x: x > 0), 'median') END) AS depth FROM (SELECT det_seq, flat[3]::DOUBLE AS a, flat[30]::DOUBLE AS b, flat[18]::DOUBLE AS c, [flat[3]::DOUBLE, flat[6]::DOUBLE, flat[9]::DOUBLE, flat[12]::DOUBLE, flat[15]::DOUBLE] AS z FROM hands)",
)
def t8(t: Tables) -> DataFrame:
    """The first joint of a list with a depth; else the median of three known depths or more."""
    e = lambda i: F.element_at("flat", i).cast("double")
    known = F.array_sort(F.filter(F.array(*[e(i) for i in (3, 6, 9, 12, 15)]), lambda x: x > 0))
    n = F.size(known)
    middle = (F.get(known, F.floor((n - 1) / 2).cast("int")) + F.get(known, F.floor(n / 2).cast("int"))) / 2
    return t.hands.select("det_seq", F.coalesce(*[F.when(e(i) > 0, e(i)) for i in (3, 30, 18)], F.when(n >= 3, middle)).alias("depth"))


@query(
    "w13_interpolated",
    """WITH k AS (SELECT side, frame_idx, max(det_seq) AS det_seq, arg_max(confidence, det_seq) AS confidence, arg_max(flat[1]::DOUBLE, det_seq) AS x FROM hands GROUP BY 1, 2),
        s AS (SELECT *, lead(frame_idx) OVER w AS nf, lead(confidence) OVER w AS nc, lead(x) OVER w AS nx FROM k WINDOW w AS (PARTITION BY side ORDER BY frame_idx)), g AS (SELECT *, unnest(range(frame_idx + 1, nf)) AS f FROM s WHERE nf > frame_idx + 1)
        SELECT g.side, CAST(g.f AS INTEGER) AS frame_idx, least(g.confidence, g.nc) AS confidence, round(g.x + (g.nx - g.x) * ((g.f - g.frame_idx) / (g.nf - g.frame_idx)::DOUBLE), 6) AS x FROM g""",
)
def w13(t: Tables) -> DataFrame:
    joints = F.array(F.element_at("flat", 1).cast("double"))
    keys = t.hands.withColumn("joints", joints).groupBy("side", "frame_idx").agg(F.max_by("confidence", "det_seq").alias("confidence"), F.max_by("joints", "det_seq").alias("joints"))
    return interpolate(keys, ["side"]).select("side", "frame_idx", "confidence", r6(F.col("joints")[0], "x"))


@query(
    "m12_w14_hands",
    f"""WITH h AS (SELECT *, {j_sql(0, 2)} AS wrist_z FROM hands WHERE frame_idx < {FRAMES}), f AS (SELECT frame_idx, count(*) AS n, bool_or(side = 'left') AS l, bool_or(side = 'right') AS r FROM h GROUP BY 1),
        a AS (SELECT count(*) AS frames_any, count(*) FILTER (n = 2) AS frames_two, count(*) FILTER (n > 2) AS frames_more, count(*) FILTER (l) AS frames_left, count(*) FILTER (r) AS frames_right, count(*) FILTER (l AND r) AS frames_both FROM f),
        w AS (SELECT side, sqrt((x - lag(x) OVER o) ** 2 + (y - lag(y) OVER o) ** 2 + (wrist_z - lag(wrist_z) OVER o) ** 2) AS s FROM (SELECT *, {j_sql(0, 0)} AS x, {j_sql(0, 1)} AS y FROM h) WINDOW o AS (PARTITION BY side ORDER BY frame_idx, det_seq)),
        t AS (SELECT side, sum(s) AS track, max(s) * 30 AS fastest FROM w GROUP BY 1), c AS (SELECT side, avg(confidence) AS mean, quantile_cont(confidence, 0.1) AS p10, quantile_cont(confidence, 0.5) AS p50, quantile_cont(confidence, 0.9) AS p90, avg(wrist_z) AS depth FROM h GROUP BY 1)
        SELECT c.side, frames_any, frames_two, frames_more, frames_left, frames_right, frames_both, round(100.0 * frames_any / {FRAMES}, 6) AS any_pct, round(mean, 6) AS conf_mean, round(p10, 6) AS conf_p10, round(p50, 6) AS conf_p50, round(p90, 6) AS conf_p90, round(depth, 6) AS wrist_depth, round(track, 6) AS track_m, round(fastest, 6) AS fastest_mps
        FROM a, c JOIN t USING (side)""",
)
def m12(t: Tables) -> DataFrame:
    h = t.hands.where(F.col("frame_idx") < FRAMES).withColumn("wrist", joint(0))
    f = h.groupBy("frame_idx").agg(F.count("*").alias("n"), F.bool_or(F.col("side") == "left").alias("l"), F.bool_or(F.col("side") == "right").alias("r"))
    a = f.agg(F.count("*").alias("frames_any"), F.count_if(F.col("n") == 2).alias("frames_two"), F.count_if(F.col("n") > 2).alias("frames_more"), F.count_if(F.col("l")).alias("frames_left"), F.count_if(F.col("r")).alias("frames_right"), F.count_if(F.col("l") & F.col("r")).alias("frames_both"))
    step = over_halo(h, ["side"], ["frame_idx", "det_seq"], lambda w: {"s": G.norm(G.sub(F.col("wrist"), F.lag("wrist").over(w)))}, before=1)
    at = {"confidence": {"conf_p10": 0.1, "conf_p50": 0.5, "conf_p90": 0.9}}
    c = step.groupBy("side").agg(r6(F.avg("confidence"), "conf_mean"), r6(F.avg(G.at(F.col("wrist"), 2)), "wrist_depth"), r6(F.sum("s"), "track_m"), r6(F.max("s") * 30, "fastest_mps"))
    d = c.join(quantiles(h, ["side"], at), "side", "left").join(F.broadcast(a))
    return d.select("side", *a.columns, r6(100.0 * F.col("frames_any") / FRAMES, "any_pct"), "conf_mean", *[r6(F.col(n), n) for n in at["confidence"]], "wrist_depth", "track_m", "fastest_mps")


@query(
    "v5_hand_buckets",
    f"""WITH f AS (SELECT frame_idx, count(*) AS n FROM hands WHERE frame_idx < {FRAMES} GROUP BY 1), b AS (SELECT CASE WHEN n > 2 THEN '>2' ELSE CAST(n AS VARCHAR) END AS bucket, count(*) AS frames FROM f GROUP BY 1)
        SELECT bucket, frames FROM b UNION ALL SELECT '0', {FRAMES} - (SELECT count(*) FROM f)""",
)
def v5(t: Tables) -> DataFrame:
    f = t.hands.where(F.col("frame_idx") < FRAMES).groupBy("frame_idx").agg(F.count("*").alias("n"))
    dense = t.spark.range(FRAMES).select(F.col("id").cast("int").alias("frame_idx")).join(f, "frame_idx", "left")
    n = F.coalesce("n", F.lit(0))
    return dense.groupBy(F.when(n > 2, ">2").otherwise(n.cast("string")).alias("bucket")).agg(F.count("*").alias("frames"))


@query(
    "w15_trail",
    "SELECT det_seq, list(det_seq) OVER (PARTITION BY side ORDER BY det_seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)[1] AS trail_start, count(*) OVER (PARTITION BY side ORDER BY det_seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS trail_len FROM hands",
)
def w15(t: Tables) -> DataFrame:
    d = over_halo(t.hands.select("side", "det_seq"), ["side"], ["det_seq"], lambda w: {"trail": F.collect_list("det_seq").over(w.rowsBetween(-4, 0))}, before=4)
    return d.select("det_seq", F.get("trail", 0).alias("trail_start"), F.size("trail").cast("long").alias("trail_len"))


@query(
    "r6_hand_builder",
    "SELECT det_seq, k // 4 AS finger, k % 4 AS knuckle, flat[3 * (k + 1) + 1] AS x, flat[3 * (k + 1) + 2] AS y, flat[3 * (k + 1) + 3] AS z, confidence FROM (SELECT *, unnest(range(20)) AS k FROM hands)",
)
def r6_builder(t: Tables) -> DataFrame:
    """Five fingers of four named joints each, from a flat list that starts with the wrist."""
    fingers = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda f: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(f.alias("finger"), k.alias("knuckle"), *[F.get("flat", 3 * (4 * f + k + 1) + i).alias(n) for i, n in enumerate("xyz")])))
    d = t.hands.select("det_seq", "confidence", F.explode(F.flatten(fingers)).alias("j"))
    return d.select("det_seq", F.col("j.finger").cast("long").alias("finger"), F.col("j.knuckle").cast("long").alias("knuckle"), "j.x", "j.y", "j.z", "confidence")


@query(
    "m13_g12_arm_angles",
    f"SELECT det_seq, round(degrees(acos(greatest(-1, least(1, ({' + '.join(f'({j_sql(3, k)} - {j_sql(4, k)}) * ({j_sql(5, k)} - {j_sql(4, k)})' for k in range(3))}) / ({d_sql(3, 4)} * {d_sql(5, 4)}))))), 5) AS elbow_deg, round({d_sql(3, 5)}, 6) AS reach_m FROM hands",
)
def m13(t: Tables) -> DataFrame:
    v1, v2 = G.sub(joint(3), joint(4)), G.sub(joint(5), joint(4))
    return t.hands.select("det_seq", F.round(G.angle_between(v1, v2), 5).alias("elbow_deg"), r6(G.norm(G.sub(joint(3), joint(5))), "reach_m"))


_ELBOW_SQL = f"""WITH a AS (SELECT det_seq, {", ".join(f"{j_sql(0, k)} AS s{k}, {j_sql(1, k)} - {j_sql(0, k)} AS d{k}" for k in range(3))} FROM hands), r AS (SELECT *, sqrt(d0 * d0 + d1 * d1 + d2 * d2) AS reach FROM a),
        n AS (SELECT *, d0 / nullif(reach, 0) AS a0, d1 / nullif(reach, 0) AS a1, d2 / nullif(reach, 0) AS a2 FROM r), h AS (SELECT *, sqrt(a0 * a0 + a2 * a2) AS flat_part FROM n),
        x AS (SELECT *, CASE WHEN flat_part > 1e-6 THEN a2 / flat_part ELSE 0 END AS x0, CASE WHEN flat_part > 1e-6 THEN 0 ELSE a2 / nullif(sqrt(a1 * a1 + a2 * a2), 0) END AS x1, CASE WHEN flat_part > 1e-6 THEN -a0 / flat_part ELSE -a1 / nullif(sqrt(a1 * a1 + a2 * a2), 0) END AS x2 FROM h),
        c AS (SELECT *, greatest(-1, least(1, (0.33 * 0.33 + reach * reach - 0.27 * 0.27) / nullif(2 * 0.33 * reach, 0)))::DOUBLE AS cosine, x1 * a2 - x2 * a1 AS b0, x2 * a0 - x0 * a2 AS b1, x0 * a1 - x1 * a0 AS b2 FROM x)
        SELECT det_seq, {", ".join(f"round(s{k} + CASE WHEN reach < 1e-6 THEN {-0.33 if k == 1 else 0} WHEN reach >= 0.99 * 0.6 THEN a{k} * 0.33 ELSE a{k} * 0.33 * cosine + b{k} * 0.33 * sqrt(1 - cosine * cosine) END::DOUBLE, 6) AS {n}" for k, n in enumerate("xyz"))} FROM c"""


@query("g11_p10_elbow", _ELBOW_SQL)
def g11(t: Tables) -> DataFrame:
    """Elbows of two-bone arms."""
    d = t.hands.select("det_seq", joint(0).alias("shoulder"), joint(1).alias("wrist"))
    return G.with_elbow(d).select("det_seq", *[r6(G.at(F.col("elbow"), i), n) for i, n in enumerate("xyz")])


@query("r4_box_parts", "SELECT p_partkey, p_size + 3.5 AS width, p_size * 2 + 1.0 AS height, p_size + (p_size + 3.5) / 2 AS center_x FROM part")
def r4(t: Tables) -> DataFrame:
    x1, x2, y1, y2 = F.col("p_size").cast("double"), F.col("p_size") * 2 + 3.5, F.lit(0.0), F.col("p_size") * 2 + 1.0
    return t["part"].select("p_partkey", (x2 - x1).alias("width"), (y2 - y1).alias("height"), ((x1 + x2) / 2).alias("center_x"))
