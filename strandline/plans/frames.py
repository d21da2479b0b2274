"""Queries on frames: poses as matrices, crops, boxes, depth at pixels, hands at measured depth, footprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import geometry as G
from strandline.operators import detections as D
from strandline.plans.base import Tables, query, r6


def e_sql(i: int) -> str:
    return f"embedding[{i}]::DOUBLE"


_ROT = """q AS (SELECT *, sqrt(qx*qx + qy*qy + qz*qz + qw*qw) AS n FROM pose ), u AS (SELECT seq, recording_id, tx, ty, tz, qx/n AS x, qy/n AS y, qz/n AS z, qw/n AS w FROM q),
        m AS (SELECT seq, recording_id, tx, ty, tz, [1-2*(y*y+z*z), 2*(x*y-z*w), 2*(x*z+y*w), 2*(x*y+z*w), 1-2*(x*x+z*z), 2*(y*z-x*w), 2*(x*z-y*w), 2*(y*z+x*w), 1-2*(x*x+y*y)] AS r FROM u)"""


def rotation():
    return G.quat_to_rot(*[F.col(c) for c in ("qx", "qy", "qz", "qw")])


@query(
    "g8_pose_matrix",
    f"WITH {_ROT}, i AS (SELECT seq, unnest(range(16)) AS i, [r[1], r[2], r[3], tx, r[4], r[5], r[6], ty, r[7], r[8], r[9], tz, 0, 0, 0, 1] AS a, [r[1], r[2], r[3], r[4], r[5], r[6], r[7], r[8], r[9], tx, ty, tz] AS b FROM m) SELECT seq, CAST(i AS INTEGER) AS i, round(a[i + 1], 6) AS value, round(b[i + 1], 6) AS part FROM i",
)
def g8(t: Tables) -> DataFrame:
    """4x4 matrices of poses, and the rotation and translation read back from them."""
    d = t.pose.withColumn("m", G.pose_matrix(rotation(), G.vec(*[F.col(c) for c in ("tx", "ty", "tz")])))
    rot, trans = G.matrix_pose(F.col("m"))
    d = d.select("seq", "m", F.concat(rot, trans).alias("p")).select("seq", "p", F.posexplode("m").alias("i", "value"))
    return d.select("seq", "i", r6(F.col("value"), "value"), r6(F.get("p", F.col("i")), "part"))


_Z = f"2 * (5000.0::DOUBLE / 256 * 640) / (256 * (1 + abs({e_sql(1)})) + 1e-9)"


@query(
    "g17_crop_camera",
    f"""WITH a AS (SELECT vec_id, label % 2 = 0 AS is_left, {e_sql(2)} AS tx, {e_sql(3)} AS ty, 320 + {e_sql(4)} * 100 AS bx, 240 + {e_sql(5)} * 100 AS "by", 200 + {e_sql(6)} * 100 AS size, {e_sql(7)} AS ku, {e_sql(8)} AS kv, {_Z} AS z FROM embeddings)
        SELECT vec_id, round(tx + 2 * (bx - 320) / 640 * z, 6) AS x, round(ty + 2 * ("by" - 240) / 640 * z, 6) AS y, round(z, 6) AS z,
            round(((CASE WHEN is_left THEN -ku ELSE ku END) + 0.5) * size + (bx - size / 2), 5) AS u, round((kv + 0.5) * size + ("by" - size / 2), 5) AS v FROM a""",
)
def g17(t: Tables) -> DataFrame:
    e = t._e
    bx, by, size = 320 + e(4) * 100, 240 + e(5) * 100, 200 + e(6) * 100
    cam = G.weak_perspective(1 + F.abs(e(1)), e(2), e(3), bx, by, 640, 480)
    u, v = G.crop_to_image(e(7), e(8), F.col("label") % 2 == 0, bx, by, size)
    return t["embeddings"].select("vec_id", *[r6(G.at(cam, i), n) for i, n in enumerate("xyz")], F.round(u, 5).alias("u"), F.round(v, 5).alias("v"))


@query("g19_turned_image", "SELECT p_partkey, (640 + p_size * 10 > 900) <> (256 > 192) AS turned FROM part")
def g19(t: Tables) -> DataFrame:
    return t["part"].select("p_partkey", G.turned_against(640 + F.col("p_size") * 10, F.lit(900), F.lit(256), F.lit(192)).alias("turned"))


_CORNERS = {0: (-0.64, -0.48), 1: (0.64, -0.48), 2: (0.64, 0.48), 3: (-0.64, 0.48)}


@query(
    "g24_frustum",
    f"WITH {_ROT}, c AS (SELECT seq, CAST(k AS INTEGER) AS corner, r, tx, ty, tz, 1.0::DOUBLE AS lx, -y AS ly, x AS lz FROM m, (VALUES "
    + ", ".join(f"({k}, {x}::DOUBLE, {y}::DOUBLE)" for k, (x, y) in _CORNERS.items())
    + ") v(k, x, y)) SELECT seq, corner, "
    + ", ".join(f"round(r[{3 * i + 1}] * lx + r[{3 * i + 2}] * ly + r[{3 * i + 3}] * lz + t{n}, 6) AS {n}" for i, n in enumerate("xyz"))
    + " FROM c",
)
def g24(t: Tables) -> DataFrame:
    """Image corners one metre before the camera, in the world."""
    d = t.pose.withColumns({"r": rotation(), "t": G.vec(*[F.col(c) for c in ("tx", "ty", "tz")])})
    corners = F.array(*[G.optical_to_world(c, F.col("r"), F.col("t")) for c in G.frustum(640, 480, 500.0, 500.0, 320.0, 240.0, 1.0)])
    d = d.select("seq", F.posexplode(corners).alias("corner", "p"))
    return d.select("seq", "corner", *[r6(G.at(F.col("p"), i), n) for i, n in enumerate("xyz")])


@query(
    "w16_up_vector",
    f"WITH {_ROT}, k AS (SELECT recording_id, seq, r[6] AS up, row_number() OVER (PARTITION BY recording_id ORDER BY seq) AS n FROM m), s AS (SELECT recording_id, avg(up) AS up, max(seq) AS decided_at FROM k WHERE n <= 10 GROUP BY 1 HAVING count(*) = 10) SELECT k.recording_id, k.seq, CASE WHEN s.up < 0 THEN -1 ELSE 1 END AS up_y FROM k JOIN s USING (recording_id) WHERE k.seq >= s.decided_at",
)
def w16(t: Tables) -> DataFrame:
    """Up axis of each recording, known from its tenth posed frame on."""
    signs = D.up_signs(t.pose, G.at(rotation(), 5))
    return t.pose.join(signs, "recording_id").where("seq >= decided_at").select("recording_id", "seq", "up_y")


_BOX = f"SELECT vec_id AS id, vec_id % 50 AS frame_no, abs({e_sql(4)}) AS score, floor(({e_sql(1)} + 1) * 100) AS x1, floor(({e_sql(2)} + 1) * 100) AS y1, floor(({e_sql(1)} + 1) * 100) + 40 + floor(abs({e_sql(3)}) * 200) AS x2, floor(({e_sql(2)} + 1) * 100) + 60 AS y2 FROM embeddings"
_CROWDED = _BOX.replace("vec_id % 50 AS frame_no", "vec_id // 40 AS frame_no")
_BOTH = "(greatest(0, least(q.x2, b.x2) - greatest(q.x1, b.x1)) * greatest(0, least(q.y2, b.y2) - greatest(q.y1, b.y1)))"


def _suppressed_sql(boxes: str) -> str:
    return f"""WITH RECURSIVE k AS ({boxes}), b AS (SELECT *, row_number() OVER (PARTITION BY frame_no ORDER BY score DESC, id) AS n FROM k),
        r AS (SELECT frame_no, n, [{{'id': id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM b WHERE n = 1
            UNION ALL SELECT b.frame_no, b.n, CASE WHEN len(list_filter(r.kept, lambda q: {_BOTH} / ((q.x2 - q.x1) * (q.y2 - q.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_BOTH}) > 0.5)) = 0 THEN list_append(r.kept, {{'id': b.id, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2}}) ELSE r.kept END
            FROM r JOIN b ON b.frame_no = r.frame_no AND b.n = r.n + 1),
        f AS (SELECT frame_no, unnest(arg_max(kept, n)) AS x FROM r GROUP BY 1) SELECT f.frame_no, f.x.id AS id FROM f JOIN k ON k.id = f.x.id WHERE k.score > 0.05"""


def _boxes(t: Tables, frame_no) -> DataFrame:
    e, low = t._e, lambda c: F.floor((c + 1) * 100).cast("double")
    return t["embeddings"].select(F.col("vec_id").alias("id"), frame_no.alias("frame_no"), F.abs(e(4)).alias("score"), low(e(1)).alias("x1"), low(e(2)).alias("y1"), (low(e(1)) + 40 + F.floor(F.abs(e(3)) * 200)).alias("x2"), (low(e(2)) + 60).alias("y2"))


@query("t3_suppressed_boxes", _suppressed_sql(_BOX))
def t3(t: Tables) -> DataFrame:
    return D.suppress(_boxes(t, F.col("vec_id") % 50), ["frame_no"], "id", 0.5, 0.05)


@query("t3_crowded_frames", _suppressed_sql(_CROWDED))
def t3_crowded(t: Tables) -> DataFrame:
    """Frames of many boxes, whose number grows with the table, by rounds of local maxima."""
    return D.suppress_crowded(_boxes(t, F.floor(F.col("vec_id") / 40)), ["frame_no"], "id", 0.5, 0.05)


@query(
    "g20_depth_at_pixel",
    """WITH p AS (SELECT frame_seq % 200 AS f, u, v, mm FROM depth_px ), t AS (SELECT DISTINCT f AS id, f, 4 + (f % 8) AS tu, f % 60 AS tv FROM p),
        s AS (SELECT t.id, count(*) AS n, median(p.mm) AS m, any_value((least(7, tu + 2) - greatest(0, tu - 2) + 1) * (least(47, tv + 2) - greatest(0, tv - 2) + 1)) AS size
            FROM t JOIN p ON p.f = t.f AND p.u BETWEEN tu - 2 AND tu + 2 AND p.v BETWEEN tv - 2 AND tv + 2 WHERE tu < 8 AND tv < 48 AND mm > 50 AND mm < 2000 GROUP BY 1)
        SELECT t.id, round(CASE WHEN s.n >= greatest(3, 0.15 * s.size) THEN s.m / 1000 END, 6) AS z FROM t LEFT JOIN s USING (id)""",
)
def g20(t: Tables) -> DataFrame:
    px = t.depth_px.select((F.col("frame_seq") % 200).alias("f"), "u", "v", "mm")
    at = px.select("f").distinct().select(F.col("f").alias("id"), "f", (4 + F.col("f") % 8).alias("u"), (F.col("f") % 60).alias("v"))
    return D.sample_depth(at, px, "f", "id", 8, 48, radius=2).select("id", r6(F.col("z"), "z"))


_ANCHOR_Z = "CASE WHEN abs(flat[64 - j]) > 0.15 THEN abs(flat[64 - j]::DOUBLE) END"


@query(
    "g21_g22_anchored_hands",
    f"""WITH s AS (SELECT det_seq, unnest(range(21)) AS j, side, flat FROM hands ), d AS (SELECT det_seq, j, 320 + flat[3*j+1]::DOUBLE * 100 AS u, 240 + flat[3*j+2]::DOUBLE * 100 AS v, {_ANCHOR_Z} AS z, abs(flat[j + 1]::DOUBLE) AS zs, list_position([0, 9, 5, 13, 17], j) AS o FROM s),
        g AS (SELECT det_seq, arg_min({{'u': u, 'v': v, 'z': z}}, o) FILTER (o IS NOT NULL AND z IS NOT NULL) AS a, median(CASE WHEN zs > 0.1 THEN zs END) AS m, count(*) FILTER (zs > 0.1) AS n, max(CASE WHEN j = 0 THEN u END) AS wu, max(CASE WHEN j = 0 THEN v END) AS wv FROM d GROUP BY 1),
        k AS (SELECT det_seq, coalesce(a.z, m) AS z, coalesce(a.u, wu) AS u, coalesce(a.v, wv) AS v FROM g WHERE a IS NOT NULL OR n >= 3),
        r AS (SELECT s.det_seq, j, (flat[3*j+1]::DOUBLE - flat[1]::DOUBLE) * (CASE WHEN side = 'left' THEN -1 ELSE 1 END) AS x, flat[3*j+2]::DOUBLE - flat[2]::DOUBLE AS y, flat[3*j+3]::DOUBLE - flat[3]::DOUBLE AS z FROM s)
        SELECT r.det_seq, CAST(j AS INTEGER) AS joint, round(-r.y + (k.u - 320) * k.z / 500, 6) AS x, round(r.x + (k.v - 240) * k.z / 500, 6) AS y, round(r.z + k.z, 6) AS z FROM r JOIN k USING (det_seq)""",
)
def g21(t: Tables) -> DataFrame:
    """Joints relative to the wrist, put where the depth image has the hand."""
    f = lambda i: F.element_at("flat", (i).cast("int")).cast("double")
    j = F.col("joint")
    s = t.hands.withColumn("joint", F.explode(F.sequence(F.lit(0), F.lit(20))))
    s = s.select("det_seq", "joint", (320 + f(3 * j + 1) * 100).alias("u"), (240 + f(3 * j + 2) * 100).alias("v"), F.when(F.abs(F.element_at("flat", 64 - j)) > 0.15, F.abs(f(64 - j))).alias("z"), F.when(F.abs(f(j + 1)) > 0.1, F.abs(f(j + 1))).alias("z_small"))
    at = D.anchor_points(s, "det_seq", 500.0, 500.0, 320.0, 240.0)
    joints = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.array(*[F.element_at("flat", (3 * i + k + 1).cast("int")).cast("double") for k in range(3)]))
    d = t.hands.join(at, "det_seq").withColumn("joints", joints)
    d = d.select("det_seq", F.posexplode(G.hand_at(F.col("joints"), F.col("anchor"), F.col("side") == "left", F.lit(True))).alias("joint", "p"))
    return d.select("det_seq", "joint", *[r6(G.at(F.col("p"), i), n) for i, n in enumerate("xyz")])


@query(
    "a18_footprint",
    f"""WITH p AS (SELECT label, vec_id, {e_sql(8)} AS x, {e_sql(10)} AS z FROM embeddings),
        s AS (SELECT a.label, a.x AS ax, a.z AS az, b.x AS bx, b.z AS bz FROM p a JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.label = a.label AND (b.x - a.x) * (c.z - a.z) - (b.z - a.z) * (c.x - a.x) < 0 AND c.vec_id <> a.vec_id AND c.vec_id <> b.vec_id))
        SELECT label, round(abs(sum(ax * bz - az * bx)) / 2, 6) AS area FROM s GROUP BY 1""",
)
def a18(t: Tables) -> DataFrame:
    d = t["embeddings"].select("label", t._e(8).alias("x"), t._e(10).alias("z"))
    return D.footprints(d, "label").select("label", r6(F.col("area"), "area"))
