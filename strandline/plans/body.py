"""Queries on upper bodies: all joints, and the skeleton block made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import geometry as G
from strandline.operators import session as S
from strandline.operators.body import upper_body
from strandline.plans.base import Tables, query, r6
from strandline.plans.hands import joint, j_sql
from strandline.plans.motion import _euler_sql
from strandline.plans.session import _world_sql


def _wrist_sql(side: str) -> str:
    return ", ".join(f"arg_max({j_sql(0, k)}, det_seq) FILTER (side = '{side}') AS {side[0]}{k}" for k in range(3))


def _arm_sql(side: str) -> str:
    world = [_world_sql(i).replace("p[1]", f"{side}0").replace("p[2]", f"{side}1").replace("p[3]", f"{side}2") for i in range(3)]
    sign = "-" if side == "l" else "+"
    return f"SELECT frame, '{side}' AS side, s, bx {sign} 0.18 * rx AS s0, \"by\" AS s1, bz {sign} 0.18 * rz AS s2, {', '.join(f'{w} AS w{i}' for i, w in enumerate(world))} FROM body LEFT JOIN wr USING (frame)"


#: Every fifth camera hangs upside down. Two detections make a frame's hands.
_BODY = f"""{_euler_sql("pose").split(",\n        a AS")[0]}, cam AS (SELECT *, seq AS frame, CASE WHEN seq % 5 = 0 THEN -1 ELSE 1 END::DOUBLE AS s, sqrt(r00*r00 + r20*r20) AS fn, sqrt(r01*r01 + r21*r21) AS rn FROM m),
        body AS (SELECT *, r00 / fn AS fx, r20 / fn AS fz, -r01 / rn AS rx, -r21 / rn AS rz, tx - 0.1 * r00 / fn AS bx, ty - s * 0.32 AS "by", tz - 0.1 * r20 / fn AS bz FROM cam),
        wr AS (SELECT det_seq // 2 AS frame, {_wrist_sql('left')}, {_wrist_sql('right')} FROM hands WHERE {j_sql(0, 2)} <> 0 GROUP BY 1),
        arm AS ({_arm_sql('l')} UNION ALL {_arm_sql('r')}), d AS (SELECT *, w0 - s0 AS d0, w1 - s1 AS d1, w2 - s2 AS d2 FROM arm), re AS (SELECT *, sqrt(d0*d0 + d1*d1 + d2*d2) AS reach FROM d),
        un AS (SELECT *, d0 / reach AS a0, d1 / reach AS a1, d2 / reach AS a2 FROM re), h AS (SELECT *, sqrt(a0*a0 + a2*a2) AS flat FROM un),
        x AS (SELECT *, CASE WHEN flat > 1e-6 THEN s * a2 / flat ELSE 0 END AS x0, CASE WHEN flat > 1e-6 THEN 0 ELSE a2 / sqrt(a1*a1 + a2*a2) END AS x1, CASE WHEN flat > 1e-6 THEN -s * a0 / flat ELSE -a1 / sqrt(a1*a1 + a2*a2) END AS x2,
            greatest(-1, least(1, (0.33 * 0.33 + reach * reach - 0.27 * 0.27) / (2 * 0.33 * reach)))::DOUBLE AS cosine FROM h),
        e AS (SELECT *, x1 * a2 - x2 * a1 AS b0, x2 * a0 - x0 * a2 AS b1, x0 * a1 - x1 * a0 AS b2 FROM x),
        el AS (SELECT *, {', '.join(f's{k} + CASE WHEN reach >= 0.99 * 0.6 THEN a{k} * 0.33 ELSE a{k} * 0.33 * cosine + b{k} * 0.33 * sqrt(1 - cosine * cosine) END AS e{k}' for k in range(3))} FROM e),
        j AS (SELECT frame, 0 AS joint, bx AS x, "by" + s * 0.22 AS y, bz AS z FROM body UNION ALL SELECT frame, 1, bx, "by" + s * 0.12, bz FROM body UNION ALL SELECT frame, 2, bx, "by" - s * 0.45, bz FROM body UNION ALL SELECT frame, 9, tx, ty, tz FROM body
            UNION ALL SELECT frame, CASE side WHEN 'l' THEN 3 ELSE 6 END, s0, s1, s2 FROM el UNION ALL SELECT frame, CASE side WHEN 'l' THEN 4 ELSE 7 END, e0, e1, e2 FROM el UNION ALL SELECT frame, CASE side WHEN 'l' THEN 5 ELSE 8 END, w0, w1, w2 FROM el)"""


def _bodies(t: Tables) -> DataFrame:
    up = G.vec(0.0, F.when(F.col("seq") % 5 == 0, -1.0).otherwise(1.0), 0.0)
    frames = t.pose.select(F.col("seq").alias("frame"), G.quat_to_rot(F.col("qx"), F.col("qy"), F.col("qz"), F.col("qw")).alias("rot"), G.vec(F.col("tx"), F.col("ty"), F.col("tz")).alias("at"), up.alias("up"))
    hands = t.hands.select(F.floor(F.col("det_seq") / 2).alias("frame"), "det_seq", "side", joint(0).alias("wrist"))
    return upper_body(frames, hands, ["frame"])


@query("p10_upper_body", f"WITH {_BODY} SELECT frame, joint, x IS NOT NULL AS visible, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM j")
def p10(t: Tables) -> DataFrame:
    """Ten joints a frame; wrists and elbows where a hand with depth was seen."""
    d = _bodies(t).select("frame", F.posexplode(F.arrays_zip("joints", "visible")).alias("joint", "j"))
    return d.select("frame", "joint", F.col("j.visible").alias("visible"), *[F.round(G.at(F.col("j.joints"), i), 5).alias(n) for i, n in enumerate("xyz")])


@query(
    "p10_m13_body_block",
    f"""WITH {_BODY}, v AS (SELECT frame % 3 AS recording_id, {', '.join(f"round(100.0 * count(x) FILTER (joint = {i}) / count(*) FILTER (joint = {i}), 6) AS {n}_pct" for i, n in enumerate(S.BODY_JOINTS))}, round(avg(y) FILTER (joint = 0), 6) AS head_height_mean_m FROM j GROUP BY 1),
        r AS (SELECT frame % 3 AS recording_id, {', '.join(f"round(avg(reach) FILTER (side = '{s[0]}'), 6) AS reach_{s}_mean_m" for s in ('left', 'right'))} FROM el GROUP BY 1), nf AS (SELECT frame % 3 AS recording_id, count(*) AS frame_count FROM body GROUP BY 1)
        SELECT * FROM v JOIN r USING (recording_id) JOIN nf USING (recording_id)""",
)
def p10_m13(t: Tables) -> DataFrame:
    """The skeleton block of these bodies."""
    d = S.skeleton_block(_bodies(t).withColumn("recording_id", F.col("frame") % 3))
    return d.select("recording_id", "frame_count", *[r6(F.col(f"joint_visibility_pct.{n}"), f"{n}_pct") for n in S.BODY_JOINTS], *[r6(F.col(c), c) for c in ("reach_left_mean_m", "reach_right_mean_m", "head_height_mean_m")])
