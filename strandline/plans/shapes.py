"""Queries on points and meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import geometry as G
from strandline.operators import colour as C
from strandline.operators import mesh as M
from strandline.operators import spatial as S
from strandline.operators.quantiles import quantiles
from strandline.plans.base import Tables, query, r6

_SHAPE = """c AS (SELECT f.f_id, f.a, f.b, f.c, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS "by", b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM faces f JOIN vertices a ON a.v_id = f.a JOIN vertices b ON b.v_id = f.b JOIN vertices c ON c.v_id = f.c),
        n AS (SELECT *, ("by" - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - ("by" - ay) * (cx - ax) AS nz,
            sqrt((bx-ax)**2 + ("by"-ay)**2 + (bz-az)**2) AS edge_ab, sqrt((cx-bx)**2 + (cy-"by")**2 + (cz-bz)**2) AS edge_bc, sqrt((ax-cx)**2 + (ay-cy)**2 + (az-cz)**2) AS edge_ca FROM c),
        s AS (SELECT *, sqrt(nx*nx + ny*ny + nz*nz) / 2 AS area FROM n)"""


@query("a13_voxels", "SELECT CAST(floor(x / 0.05) AS BIGINT) AS ix, CAST(floor(y / 0.05) AS BIGINT) AS iy, CAST(floor(z / 0.05) AS BIGINT) AS iz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, CAST(trunc(avg(r)) AS INTEGER) AS r, count(*) AS n FROM points GROUP BY 1, 2, 3")
def a13(t: Tables) -> DataFrame:
    d = S.voxels(t.points, 0.05, ("r",))
    return d.select("ix", "iy", "iz", *[r6(F.col(c), c) for c in "xyz"], F.col("r").cast("int").alias("r"), "n")


@query("j9_near_points", "SELECT p.pt_id FROM points p WHERE EXISTS (SELECT 1 FROM points o WHERE o.pt_id % 10 = 0 AND p.pt_id <> o.pt_id AND p.pt_id % 10 <> 0 AND (p.x-o.x)*(p.x-o.x) + (p.y-o.y)*(p.y-o.y) + (p.z-o.z)*(p.z-o.z) < 0.06 * 0.06::DOUBLE)")
def j9(t: Tables) -> DataFrame:
    return S.near_any(t.points.where("pt_id % 10 <> 0"), t.points.where("pt_id % 10 = 0"), 0.06).select("pt_id")


@query("j9_far_points", "SELECT p.pt_id FROM points p WHERE p.pt_id % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM points o WHERE o.pt_id % 10 = 0 AND (p.x-o.x)*(p.x-o.x) + (p.y-o.y)*(p.y-o.y) + (p.z-o.z)*(p.z-o.z) < 0.05 * 0.05::DOUBLE)")
def j9_far(t: Tables) -> DataFrame:
    return S.near_any(t.points.where("pt_id % 10 <> 0"), t.points.where("pt_id % 10 = 0"), 0.05, "left_anti").select("pt_id")


@query("s14_j6_face_shapes", f"WITH {_SHAPE} SELECT f_id, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz, round(area, 6) AS area, round(edge_ab, 6) AS edge_ab, round(edge_bc, 6) AS edge_bc, round(edge_ca, 6) AS edge_ca FROM s")
def s14(t: Tables) -> DataFrame:
    return S.with_shape(t.faces, t.vertices).select("f_id", *[r6(F.col(c), c) for c in ("nx", "ny", "nz", "area", "edge_ab", "edge_bc", "edge_ca")])


@query("f13_face_filter", f"WITH {_SHAPE} SELECT f_id FROM s WHERE edge_ab < 0.35 AND edge_bc < 0.35 AND edge_ca < 0.35 AND area > 1e-8")
def f13(t: Tables) -> DataFrame:
    """Faces with short edges only and some area."""
    return S.with_shape(t.faces, t.vertices).where("edge_ab < 0.35 and edge_bc < 0.35 and edge_ca < 0.35 and area > 1e-8").select("f_id")


@query(
    "a14_vertex_normals",
    f"""WITH {_SHAPE}, k AS (SELECT unnest([a, b, c]) AS v_id, nx, ny, nz FROM s), m AS (SELECT v_id, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz FROM k GROUP BY 1),
        q AS (SELECT v.v_id, coalesce(sx, 0) AS sx, coalesce(sy, 0) AS sy, coalesce(sz, 0) AS sz FROM vertices v LEFT JOIN m USING (v_id)), l AS (SELECT *, CASE WHEN sqrt(sx*sx + sy*sy + sz*sz) < 1e-10 THEN 1 ELSE sqrt(sx*sx + sy*sy + sz*sz) END AS d FROM q)
        SELECT v_id, round(sx / d, 6) AS nx, round(sy / d, 6) AS ny, round(sz / d, 6) AS nz FROM l""",
)
def a14(t: Tables) -> DataFrame:
    return S.vertex_normals(t.vertices, t.faces).select("v_id", *[r6(F.col(c), c) for c in ("nx", "ny", "nz")])


@query(
    "m9_a19_mesh",
    f"""WITH {_SHAPE}, e AS (SELECT unnest([edge_ab, edge_bc, edge_ca]) AS e FROM s), a AS (SELECT count(*) AS face_count, sum(area) AS area FROM s), b AS (SELECT avg(e) AS mean, quantile_cont(e, 0.05) AS p5, quantile_cont(e, 0.95) AS p95 FROM e),
        v AS (SELECT count(*) AS vertex_count, max(x) - min(x) AS extent_x, max(y) - min(y) AS extent_y, max(z) - min(z) AS extent_z FROM vertices)
        SELECT vertex_count, face_count, round(extent_x, 6) AS extent_x, round(extent_y, 6) AS extent_y, round(extent_z, 6) AS extent_z, round(extent_x * extent_y * extent_z, 6) AS bbox_volume_m3, round(area, 6) AS surface_area_m2,
            round(mean, 6) AS edge_length_mean_m, round(p5, 6) AS edge_length_p5_m, round(p95, 6) AS edge_length_p95_m, round(vertex_count / nullif(area, 0), 6) AS verts_per_m2, round(face_count / nullif(area, 0), 6) AS faces_per_m2 FROM a, b, v""",
)
def m9(t: Tables) -> DataFrame:
    s = S.with_shape(t.faces, t.vertices)
    ext = {n: F.max(n) - F.min(n) for n in S.XYZ}
    v = t.vertices.agg(F.count("*").alias("vertex_count"), *[c.alias(f"extent_{n}") for n, c in ext.items()], (ext["x"] * ext["y"] * ext["z"]).alias("bbox_volume_m3"))
    e = s.select(F.explode(F.array("edge_ab", "edge_bc", "edge_ca")).alias("e"))
    e = e.agg(F.avg("e").alias("edge_length_mean_m")).join(quantiles(e, [], {"e": {"edge_length_p5_m": 0.05, "edge_length_p95_m": 0.95}}))
    a = s.agg(F.count("*").alias("face_count"), F.sum("area").alias("surface_area_m2"))
    d = a.join(e).join(v)
    d = d.withColumns({"verts_per_m2": G.safe_div(F.col("vertex_count"), F.col("surface_area_m2")), "faces_per_m2": G.safe_div(F.col("face_count"), F.col("surface_area_m2"))})
    return d.select("vertex_count", "face_count", *[r6(F.col(c), c) for c in d.columns if c not in ("vertex_count", "face_count")])


@query(
    "m10_a11_a20_cloud",
    """WITH a AS (SELECT count(*) AS point_count, max(x) - min(x) AS ex, max(y) - min(y) AS ey, max(z) - min(z) AS ez, count(*) FILTER (r <> 0) AS coloured FROM points)
        SELECT point_count, round(ex, 6) AS extent_x, round(ey, 6) AS extent_y, round(ez, 6) AS extent_z, round(ex * ey * ez, 6) AS bbox_volume_m3, round(point_count / nullif(ex * ey * ez, 0), 6) AS density_pts_per_m3, round(100.0::DOUBLE * coloured / point_count, 6) AS color_coverage_pct FROM a""",
)
def m10(t: Tables) -> DataFrame:
    ext = {n: F.max(n) - F.min(n) for n in S.XYZ}
    volume = ext["x"] * ext["y"] * ext["z"]
    n = F.count("*")
    return t.points.agg(n.alias("point_count"), *[r6(c, f"extent_{k}") for k, c in ext.items()], r6(volume, "bbox_volume_m3"), r6(G.safe_div(n, volume), "density_pts_per_m3"), r6(G.pct(F.count_if(F.col("r") != 0), n), "color_coverage_pct"))


@query("a17_occupancy", "SELECT CAST(floor(x / 0.03) AS BIGINT) AS ix, CAST(floor(y / 0.03) AS BIGINT) AS iy, count(*) AS n FROM points GROUP BY 1, 2 HAVING count(*) >= 2")
def a17(t: Tables) -> DataFrame:
    return S.occupancy(t.points, 0.03)


_GROW = "SELECT DISTINCT ix + i AS ix, iy + j AS iy FROM {0}, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) s(i, j)"
_SHRINK = "SELECT ix, iy FROM (SELECT ix + i AS ix, iy + j AS iy FROM {0}, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) s(i, j)) GROUP BY 1, 2 HAVING count(*) = 5"


@query("p8_filled_mask", f"WITH m AS (SELECT CAST(floor(x / 0.03) AS BIGINT) AS ix, CAST(floor(y / 0.03) AS BIGINT) AS iy FROM points GROUP BY 1, 2 HAVING count(*) >= 2), g1 AS ({_GROW.format('m')}), g2 AS ({_GROW.format('g1')}), h1 AS ({_SHRINK.format('g2')}), h2 AS ({_SHRINK.format('h1')}), o AS ({_GROW.format('h2')}) SELECT ix, iy FROM o")
def p8_mask(t: Tables) -> DataFrame:
    """Occupied cells, closed twice and grown once."""
    m = S.occupancy(t.points, 0.03).select("ix", "iy")
    return S.grow(S.shrink(S.shrink(S.grow(S.grow(m)))))


@query("u4_compacted_vertices", "WITH f AS (SELECT * FROM faces WHERE f_id % 2 = 0), u AS (SELECT DISTINCT unnest([a, b, c]) AS v_id FROM f) SELECT v_id, row_number() OVER (ORDER BY v_id) - 1 AS new_id FROM vertices WHERE v_id IN (SELECT v_id FROM u)")
def u4(t: Tables) -> DataFrame:
    return S.compact(t.vertices, t.faces.where("f_id % 2 = 0"))[0].select("v_id", "new_id")


@query("u4_compacted_vertices_all", "WITH u AS (SELECT DISTINCT unnest([a, b, c]) AS v_id FROM faces) SELECT v_id, row_number() OVER (ORDER BY v_id) - 1 AS new_id FROM vertices WHERE v_id IN (SELECT v_id FROM u)")
def u4_all(t: Tables) -> DataFrame:
    """The same over all faces; the gaps are the data's own unused vertices."""
    return S.compact(t.vertices, t.faces)[0].select("v_id", "new_id")


@query("u1_u2_union_distinct", "SELECT DISTINCT CAST(floor(x * 20) AS BIGINT) AS ix, CAST(floor(y * 20) AS BIGINT) AS iy FROM (SELECT x, y FROM points UNION ALL SELECT x, y FROM vertices)")
def u1(t: Tables) -> DataFrame:
    both = t.points.select("x", "y").unionByName(t.vertices.select("x", "y"))
    return both.select(F.floor(F.col("x") * 20).alias("ix"), F.floor(F.col("y") * 20).alias("iy")).distinct()


@query("u3_missing_cells", "SELECT ix FROM (SELECT DISTINCT CAST(floor(x * 50) AS BIGINT) AS ix FROM vertices) EXCEPT SELECT CAST(floor(x * 50) AS BIGINT) FROM points")
def u3(t: Tables) -> DataFrame:
    c = F.floor(F.col("x") * 50).alias("ix")
    return t.vertices.select(c).distinct().join(t.points.select(c).distinct(), "ix", "left_anti")


@query("f5_f8_far_from_camera", "SELECT pt_id FROM points WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND sqrt((x - 0.1) ** 2 + (y - 0.1) ** 2 + (z - 0.1) ** 2) > 0.25")
def f5(t: Tables) -> DataFrame:
    finite = [~F.isnan(n) & (F.abs(n) < float("inf")) for n in S.XYZ]
    return t.points.where(finite[0] & finite[1] & finite[2] & (S.length([F.col(n) - 0.1 for n in S.XYZ]) > 0.25)).select("pt_id")


_PIX = "pix AS (SELECT l_partkey % 64 AS pu, l_suppkey % 48 AS pv, avg(l_quantity) AS c FROM lineitem GROUP BY 1, 2)"


@query(
    "j8_bilinear",
    f"""WITH {_PIX}, p AS (SELECT pt_id, (x + 1) * 31 AS u, (y + 1) * 23 AS v FROM points), q AS (SELECT pt_id, u, v, unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j FROM p),
        k AS (SELECT pt_id, greatest(0, least(63, CAST(floor(u) AS BIGINT) + i)) AS pu, greatest(0, least(47, CAST(floor(v) AS BIGINT) + j)) AS pv, (CASE WHEN i = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN j = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS w FROM q)
        SELECT pt_id, round(sum(w * c), 6) AS c FROM k JOIN pix USING (pu, pv) GROUP BY 1""",
)
def j8(t: Tables) -> DataFrame:
    pix = t["lineitem"].groupBy((F.col("l_partkey") % 64).alias("pu"), (F.col("l_suppkey") % 48).alias("pv")).agg(F.avg("l_quantity").alias("c"))
    at = t.points.select("pt_id", ((F.col("x") + 1) * 31).alias("u"), ((F.col("y") + 1) * 23).alias("v"))
    return S.bilinear(at, pix, 64, 48).select("pt_id", r6(F.col("c"), "c"))


@query("j7_nearest_pixel", f"WITH {_PIX} SELECT pt_id, round(c, 6) AS c FROM (SELECT pt_id, greatest(0, least(63, CAST(trunc((x + 1) * 31) AS BIGINT))) AS pu, greatest(0, least(47, CAST(trunc((y + 1) * 23) AS BIGINT))) AS pv FROM points) JOIN pix USING (pu, pv)")
def j7(t: Tables) -> DataFrame:
    pix = t["lineitem"].groupBy((F.col("l_partkey") % 64).alias("pu"), (F.col("l_suppkey") % 48).alias("pv")).agg(F.avg("l_quantity").alias("c"))
    clip = lambda c, top: F.greatest(F.lit(0), F.least(F.lit(top), c.cast("long"))).cast("long")
    at = t.points.select("pt_id", clip((F.col("x") + 1) * 31, 63).alias("pu"), clip((F.col("y") + 1) * 23, 47).alias("pv"))
    return at.join(pix, ["pu", "pv"]).select("pt_id", r6(F.col("c"), "c"))


_FRAMES = "fr AS (SELECT vec_id AS frame, embedding[1]::DOUBLE AS cx, embedding[2]::DOUBLE AS cy, embedding[3]::DOUBLE - 1 AS cz FROM embeddings WHERE vec_id % 50 = 0)"


@query(
    "p2_p3_coloured_vertices",
    f"""WITH {_FRAMES}, h AS (SELECT v_id, frame, (x - cx) AS px, (y - cy) AS py, (z - cz) AS pz FROM vertices, fr),
        k AS (SELECT *, px * 500 / nullif(pz, 0) + 320 AS u, py * 500 / nullif(pz, 0) + 240 AS v FROM h),
        w AS (SELECT v_id, frame % 251 AS shade, 1 / (pz * pz + 1e-3::DOUBLE) AS w FROM k WHERE pz > 0.2 AND pz < 5 AND u >= 0 AND u < 639 AND v >= 0 AND v < 479),
        m AS (SELECT v_id, count(*) AS hits, sum(w * shade) / sum(w) AS weighted, avg(shade) AS plain FROM w GROUP BY 1)
        SELECT v.v_id, coalesce(hits, 0) AS hits, round(coalesce(weighted, 128), 6) AS weighted, round(coalesce(plain, 128), 6) AS plain FROM vertices v LEFT JOIN m USING (v_id)""",
)
def p2(t: Tables) -> DataFrame:
    """Vertices in the frames that its SQL names, met by cells of space; no occlusion, normals aren't read."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    same = G.vec(1, 0, 0, 0, 1, 0, 0, 0, 1)
    frames = t["embeddings"].where("vec_id % 50 = 0").select(F.col("vec_id").alias("frame"), same.alias("rot"), G.vec(e(1), e(2), e(3) - 1).alias("at"))
    axes = C.with_axes(frames, same).withColumn("shade", F.col("frame") % 251)
    m = C.shaded(t.vertices, axes, C.Lens(500.0, 500.0, 320.0, 240.0, 640, 480), C.Colouring(every_n=50, far=5.0, cell=0.25))
    d = t.vertices.join(m, "v_id", "left")
    return d.select("v_id", F.coalesce("hits", F.lit(0)).alias("hits"), r6(F.coalesce("weighted", F.lit(128.0)), "weighted"), r6(F.coalesce("plain", F.lit(128.0)), "plain"))


@query(
    "g10_plane_basis",
    """WITH p AS (SELECT seq, qx, qy, qz, qw, sqrt(qx*qx + qy*qy + qz*qz) AS s FROM pose), n AS (SELECT seq, qx/s AS a, qy/s AS b, qz/s AS c, -qw/s AS d FROM p)
        SELECT seq, round(a, 6) AS nx, round(b, 6) AS ny, round(c, 6) AS nz, round(a * d, 6) AS ox, round(b * d, 6) AS oy, round(c * d, 6) AS oz FROM n""",
)
def g10(t: Tables) -> DataFrame:
    origin, _, _, n = G.plane_basis(G.vec(F.col("qx"), F.col("qy"), F.col("qz"), F.col("qw")))
    return t.pose.select("seq", *[r6(G.at(n, i), f"n{k}") for i, k in enumerate("xyz")], *[r6(G.at(origin, i), f"o{k}") for i, k in enumerate("xyz")])


@query(
    "t6_table_plane",
    """WITH h AS (SELECT vec_id % 3 AS recording_id, vec_id AS plane, embedding[5]::DOUBLE AS height, vec_id * 37 % 101 AS inliers FROM embeddings WHERE vec_id < 30), o AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY height, plane) AS up, count(*) OVER (PARTITION BY recording_id) AS n FROM h)
        SELECT recording_id, arg_max(plane, inliers * 1000 - up) AS plane FROM o WHERE up > 1 AND (n <= 2 OR up < n) GROUP BY 1""",
)
def t6(t: Tables) -> DataFrame:
    return _table_plane(_level_planes(t).where("plane < 30"))


@query(
    "t6_table_plane_all",
    """WITH h AS (SELECT vec_id % 3 AS recording_id, vec_id AS plane, embedding[5]::DOUBLE AS height, vec_id * 37 % 101 AS inliers FROM embeddings), o AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY height, plane) AS up, count(*) OVER (PARTITION BY recording_id) AS n FROM h),
        b AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY inliers DESC, up) AS best FROM o WHERE up > 1 AND (n <= 2 OR up < n)) SELECT recording_id, plane FROM b WHERE best = 1""",
)
def t6_all(t: Tables) -> DataFrame:
    """The same over all planes; t6_table_plane keeps to the planes of its SQL."""
    return _table_plane(_level_planes(t))


def _level_planes(t: Tables) -> DataFrame:
    return t["embeddings"].select((F.col("vec_id") % 3).alias("recording_id"), F.col("vec_id").alias("plane"), F.element_at("embedding", 5).cast("double").alias("height"), (F.col("vec_id") * 37 % 101).alias("inliers"))


def _table_plane(h: DataFrame) -> DataFrame:
    """Of a recording's level planes, without the lowest and, of more than two, the highest, the one with most inliers."""
    at = F.struct("height", "plane")
    ends = h.groupBy("recording_id").agg(F.min(at).alias("lowest"), F.max(at).alias("highest"), F.count("*").alias("n"))
    o = h.join(ends, "recording_id").where((at != F.col("lowest")) & ((F.col("n") <= 2) | (at != F.col("highest"))))
    return o.groupBy("recording_id").agg(F.max_by("plane", F.struct("inliers", -F.col("height"), -F.col("plane"))).alias("plane"))


@query(
    "p5_subdivided_vertices",
    """WITH k AS (SELECT unnest([{'l': least(a, b), 'h': greatest(a, b)}, {'l': least(b, c), 'h': greatest(b, c)}, {'l': least(c, a), 'h': greatest(c, a)}]) AS e FROM faces ), g AS (SELECT e.l AS lo, e.h AS hi, row_number() OVER (ORDER BY e.l, e.h) - 1 AS n FROM k),
        m AS (SELECT (SELECT max(v_id) + 1 FROM vertices) + g.n AS v_id, (p.x + q.x) / 2 AS x, (p.y + q.y) / 2 AS y, (p.z + q.z) / 2 AS z FROM g JOIN vertices p ON p.v_id = lo JOIN vertices q ON q.v_id = hi),
        w AS (SELECT lo AS v_id, hi AS o FROM g UNION ALL SELECT hi, lo FROM g), s AS (SELECT w.v_id, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM w JOIN vertices v ON v.v_id = w.o GROUP BY 1),
        u AS (SELECT v.v_id, coalesce(0.75 * v.x + 0.125 * s.x, v.x) AS x, coalesce(0.75 * v.y + 0.125 * s.y, v.y) AS y, coalesce(0.75 * v.z + 0.125 * s.z, v.z) AS z FROM vertices v LEFT JOIN s USING (v_id) UNION ALL SELECT * FROM m)
        SELECT v_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM u""",
)
def p5(t: Tables) -> DataFrame:
    """Loop subdivision; the test mesh is of single triangles, so SQL needs the border rules only."""
    v, _ = M.subdivide(t.vertices, t.faces)
    return v.select("v_id", *[r6(F.col(c), c) for c in "xyz"])


@query("p6_planes")
def p6(t: Tables) -> DataFrame:
    found = M.planes(t.points)
    return t.spark.createDataFrame([(i, *map(float, eq), n) for i, (eq, n) in enumerate(found)], "plane int, a double, b double, c double, d double, points bigint")
