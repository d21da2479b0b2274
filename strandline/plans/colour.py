"""Queries on mesh colours: real rotations, rasters of colour and depth that grow with the frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import geometry as G
from strandline.operators import colour as C
from strandline.operators import spatial as S
from strandline.operators.cloud import Cloud, dense_cloud
from strandline.plans.base import Tables, query, r6
from strandline.plans.motion import _euler_sql

#: The cameras of the test rasters, and how far the camera stands behind its pose's place.
LENS, DEPTH_LENS, BACK = C.Lens(60.0, 60.0, 32.0, 24.0, 64, 48), C.Lens(30.0, 30.0, 16.0, 12.0, 32, 24), 0.6


def _frames(t: Tables) -> DataFrame:
    """Poses with real rotations; each camera stands a little behind its place, so that it sees the points around it."""
    rot = G.quat_to_rot(F.col("qx"), F.col("qy"), F.col("qz"), F.col("qw"))
    d = t.pose.select(F.col("seq").alias("frame"), rot.alias("rot"), G.vec(F.col("tx"), F.col("ty"), F.col("tz")).alias("to"))
    # The optical axis in the link's axes is known here: nested array expressions would grow many times over with each step.
    ahead = [sum((G.at(F.col("rot"), 3 * i + k) * G.OPTICAL_TO_LINK[3 * k + 2] for k in (1, 2)), G.at(F.col("rot"), 3 * i) * G.OPTICAL_TO_LINK[2]) for i in range(3)]
    return d.select("frame", "rot", G.vec(*[G.at(F.col("to"), i) - ahead[i] * BACK for i in range(3)]).alias("at"))


def _raster(frames: DataFrame, width: int, height: int, u: str, v: str) -> DataFrame:
    d = frames.select("frame").withColumn(u, F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return d.withColumn(v, F.explode(F.sequence(F.lit(0), F.lit(height - 1))))


def _pixels(frames: DataFrame) -> DataFrame:
    d = _raster(frames, LENS.width, LENS.height, "pu", "pv")
    return d.select("*", ((F.col("frame") * 7 + F.col("pu") * 13 + F.col("pv") * 29) % 256).alias("r"), ((F.col("frame") * 3 + F.col("pu") * F.col("pv")) % 256).alias("g"))


def _depth(frames: DataFrame) -> DataFrame:
    """A raster that lacks its last rows, has pixels without depth, and walls before and behind the points."""
    d = _raster(frames, DEPTH_LENS.width, 20, "u", "v")
    h = (F.col("frame") * 31 + F.col("u") * 17 + F.col("v") * 5) % 11
    return d.select("*", F.when(h < 2, 0).otherwise(250 + 60 * h).alias("mm"))


def _normals(t: Tables) -> DataFrame:
    return S.vertex_normals(t.vertices, t.faces)


_NORMALS = """c AS (SELECT f.f_id, f.a, f.b, f.c, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS "by", b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM faces f JOIN vertices a ON a.v_id = f.a JOIN vertices b ON b.v_id = f.b JOIN vertices c ON c.v_id = f.c),
        fn AS (SELECT unnest([a, b, c]) AS v_id, ("by" - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - ("by" - ay) * (cx - ax) AS nz FROM c),
        sn AS (SELECT v_id, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz FROM fn GROUP BY 1),
        vn AS (SELECT v.v_id, v.x, v.y, v.z, coalesce(sx, 0) / d AS nx, coalesce(sy, 0) / d AS ny, coalesce(sz, 0) / d AS nz FROM (SELECT v.*, sx, sy, sz, CASE WHEN sqrt(coalesce(sx*sx + sy*sy + sz*sz, 0)) < 1e-10 THEN 1 ELSE sqrt(sx*sx + sy*sy + sz*sz) END AS d FROM vertices v LEFT JOIN sn USING (v_id)) v)"""


def _seen_sql(every: int) -> str:
    """DuckDB: every vertex in every chosen frame, by rotations, depth bounds, image bounds and the turn of the normal."""
    m = _euler_sql("(SELECT * FROM pose WHERE seq % " + str(every) + " = 0)").split(",\n        a AS")[0]
    link = G.OPTICAL_TO_LINK
    ahead = [" + ".join(f"r{i}{k} * {link[3 * k + 2]}" for k in range(3)) for i in range(3)]
    turn = [[" + ".join(f"{link[3 * k + i]} * r{j}{k}" for k in range(3)) for j in range(3)] for i in range(3)]
    cols = ", ".join(f"{turn[i][j]} AS m{i}{j}" for i in range(3) for j in range(3))
    at = ", ".join(f"t{n} - {BACK} * ({ahead[i]}) AS t{n}" for i, n in enumerate("xyz"))
    p = ", ".join(f"m{i}0 * wx + m{i}1 * wy + m{i}2 * wz AS p{n}" for i, n in enumerate("xyz"))
    return f"""{m}, {_NORMALS}, fr AS (SELECT seq AS frame, {at}, {cols} FROM m),
        w AS (SELECT v_id, frame, x - tx AS wx, y - ty AS wy, z - tz AS wz, nx, ny, nz, fr.* EXCLUDE (frame) FROM vn, fr),
        p AS (SELECT v_id, frame, {p}, -(wx * nx + wy * ny + wz * nz) / (sqrt(wx*wx + wy*wy + wz*wz) + 1e-9) AS cos FROM w),
        s AS (SELECT *, px * {LENS.fx} / pz + {LENS.cx} AS u, py * {LENS.fy} / pz + {LENS.cy} AS v FROM p WHERE pz > 0.2 AND pz < 6),
        seen AS (SELECT *, CAST(trunc(px * {DEPTH_LENS.fx} / pz + {DEPTH_LENS.cx}) AS BIGINT) AS du, CAST(trunc(py * {DEPTH_LENS.fy} / pz + {DEPTH_LENS.cy}) AS BIGINT) AS dv FROM s
            WHERE u >= 0 AND u < {LENS.width - 1} AND v >= 0 AND v < {LENS.height - 1} AND cos > 0.05),
        hid AS (SELECT *, (frame * 31 + du * 17 + dv * 5) % 11 AS h, du >= 0 AND du < {DEPTH_LENS.width} AND dv >= 0 AND dv < 20 AS inside FROM seen),
        open AS (SELECT * FROM hid WHERE NOT (inside AND h >= 2 AND pz > (250 + 60 * h) / 1000.0::DOUBLE + 0.08))"""


@query(
    "j11_f10_occlusion",
    f"WITH {_seen_sql(5)}, k AS (SELECT v_id, count(*) AS sightings FROM seen GROUP BY 1), o AS (SELECT v_id, count(*) AS unhidden, max(frame) AS last_frame FROM open GROUP BY 1) SELECT v_id, sightings, coalesce(unhidden, 0) AS unhidden, last_frame FROM k LEFT JOIN o USING (v_id)",
)
def j11(t: Tables) -> DataFrame:
    """How many frames face a vertex, and how many of them the depth raster leaves unhidden."""
    c = C.Colouring(cell=0.25, far=6.0)
    few = C.chosen_frames(_frames(t), c)
    return C.counted(_normals(t), C.with_axes(few), _depth(few), LENS, DEPTH_LENS, c)


@query(
    "p3_a15_colourised",
    f"""WITH {_seen_sql(5)}, q AS (SELECT v_id, frame, cos * cos / (pz * pz + 1e-3::DOUBLE) AS w, u, v, unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j FROM open),
        k AS (SELECT v_id, frame, CAST(floor(u) AS BIGINT) + i AS pu, CAST(floor(v) AS BIGINT) + j AS pv, w * (CASE WHEN i = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN j = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS w FROM q),
        g AS (SELECT v_id, sum(w) AS weight, sum(w * ((frame * 7 + pu * 13 + pv * 29) % 256)) / sum(w) AS r, sum(w * ((frame * 3 + pu * pv) % 256)) / sum(w) AS g FROM k GROUP BY 1)
        SELECT v_id, round(coalesce(weight, 0), 5) AS weight, round(coalesce(r, 128), 5) AS r, round(coalesce(g, 128), 5) AS g FROM vertices LEFT JOIN g USING (v_id)""",
)
def p3(t: Tables) -> DataFrame:
    """Colours by cos^2 / (z^2 + 1e-3) from every fifth frame, behind a depth raster; hidden vertices are grey."""
    frames, c = _frames(t), C.Colouring(cell=0.25)
    few = C.chosen_frames(frames, c)
    out = C.colourise(_normals(t), frames, _pixels(few), LENS, c, _depth(few), DEPTH_LENS, ("r", "g"))
    return out.select("v_id", *[F.round(n, 5).alias(n) for n in ("weight", "r", "g")])


_CLOUD = Cloud(most_points=300, voxel=0.25)
#: A draw that SQL can make, too: below 2**20.
_DRAW = "(frame * 7919 + u * 104729 + v * 1299709) % 1048576"


def _far_depth(frames: DataFrame) -> DataFrame:
    d = _raster(frames, DEPTH_LENS.width, DEPTH_LENS.height, "u", "v")
    h = (F.col("frame") * 31 + F.col("u") * 17 + F.col("v") * 5) % 13
    return d.select("*", F.when(h < 2, 0).otherwise(500 * h + 7 * F.col("u")).alias("mm"))


def _cloud_sql() -> str:
    m = _euler_sql("(SELECT * FROM pose WHERE seq % 10 = 0)").split(",\n        a AS")[0]
    link = G.OPTICAL_TO_LINK
    p = [f"((u - {DEPTH_LENS.cx}) * (mm / 1000.0::DOUBLE) / {DEPTH_LENS.fx})", f"((v - {DEPTH_LENS.cy}) * (mm / 1000.0::DOUBLE) / {DEPTH_LENS.fy})", "(mm / 1000.0::DOUBLE)"]
    turned = ["(" + " + ".join(f"{link[3 * k + i]} * {p[i]}" for i in range(3)) + ")" for k in range(3)]
    ahead = [" + ".join(f"r{i}{k} * {link[3 * k + 2]}" for k in range(3)) for i in range(3)]
    world = ", ".join(" + ".join(f"r{i}{k} * {turned[k]}" for k in range(3)) + f" + o{n} AS {n}" for i, n in enumerate("xyz"))
    return f"""{m}, fr AS (SELECT seq AS frame, {', '.join(f't{n} - {BACK} * ({ahead[i]}) AS o{n}' for i, n in enumerate('xyz'))}, {', '.join(f'r{i}{j}' for i in range(3) for j in range(3))} FROM m),
        px AS (SELECT frame, u, v, (frame * 31 + u * 17 + v * 5) % 13 AS h FROM fr, (SELECT unnest(range(0, {DEPTH_LENS.width})) AS u), (SELECT unnest(range(0, {DEPTH_LENS.height})) AS v)),
        mm AS (SELECT frame, u, v, CASE WHEN h < 2 THEN 0 ELSE 500 * h + 7 * u END AS mm FROM px), ok AS (SELECT * FROM mm WHERE mm > 300 AND mm < 5000),
        k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY {_DRAW}, v, u) AS place FROM ok),
        w AS (SELECT frame, u, v, ox, oy, oz, {world} FROM k JOIN fr USING (frame) WHERE place <= 300),
        far AS (SELECT frame, u * 2 AS pu, v * 2 AS pv, x, y, z FROM w WHERE sqrt((x-ox)**2 + (y-oy)**2 + (z-oz)**2) > 1)"""


@query(
    "p1_t4_dense_cloud",
    f"""WITH {_cloud_sql()} SELECT CAST(floor(x / 0.25) AS BIGINT) AS ix, CAST(floor(y / 0.25) AS BIGINT) AS iy, CAST(floor(z / 0.25) AS BIGINT) AS iz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z,
        round(avg((frame * 7 + pu * 13 + pv * 29) % 256), 6) AS r, round(avg((frame * 3 + pu * pv) % 256), 6) AS g, count(*) AS n FROM far GROUP BY 1, 2, 3""",
)
def p1(t: Tables) -> DataFrame:
    """Depth of every tenth frame, 300 of its pixels, in world axes, coloured and put into voxels."""
    frames = _frames(t).where("frame % 10 = 0")
    d = dense_cloud(_far_depth(frames), frames, _pixels(frames), DEPTH_LENS, (LENS.width, LENS.height), _CLOUD, ("r", "g"), draw=F.expr(_DRAW), bits=20)
    return d.select("ix", "iy", "iz", *[r6(F.col(c), c) for c in ("x", "y", "z", "r", "g")], "n")
