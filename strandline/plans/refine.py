"""Queries on refined meshes: a room whose floor, table, ceiling and wall are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import mesh as M
from strandline.operators import refine as R
from strandline.plans.base import Tables, query, r6

#: The room's planes, with counts that order them as their points do.
PLANES = [((0.0, 1.0, 0.0, 0.0), 4000), ((1.0, 0.0, 0.0, -0.55), 3000), ((0.0, 1.0, 0.0, -0.75), 2000), ((0.0, 1.0, 0.0, -2.5), 1000)]
_NEAR = ["abs(y) < 0.03", "abs(x - 0.55) < 0.03", "abs(y - 0.75) < 0.03", "abs(y - 2.5) < 0.03"]
_STRIP = f"""near AS (SELECT v_id, x, y, z, CASE {' '.join(f'WHEN {n} THEN {i}' for i, n in enumerate(_NEAR))} END AS plane FROM scene),
        e AS (SELECT min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1 FROM near WHERE plane = 2),
        over AS (SELECT a.* FROM near a, e WHERE abs(x - (x0 + x1) / 2) <= (x1 - x0) / 2 * 1.05 AND abs(z - (z0 + z1) / 2) <= (z1 - z0) / 2 * 1.05 AND y - 0.75 > 0.01 AND y - 0.75 < 0.8),
        gone AS (SELECT v_id FROM over o WHERE NOT EXISTS (SELECT 1 FROM near w WHERE w.plane = 1 AND (w.x-o.x)**2 + (w.y-o.y)**2 + (w.z-o.z)**2 < 0.06 * 0.06::DOUBLE)),
        kept AS (SELECT * FROM faces WHERE a NOT IN (SELECT v_id FROM gone) AND b NOT IN (SELECT v_id FROM gone) AND c NOT IN (SELECT v_id FROM gone)),
        ids AS (SELECT v_id, row_number() OVER (ORDER BY v_id) - 1 AS new_id FROM scene WHERE v_id IN (SELECT unnest([a, b, c]) FROM kept))"""


def _stripped(t: Tables) -> R.Stripped:
    return R.strip_clutter(t.scene.select("v_id", "x", "y", "z"), t.faces, PLANES)


@query("p7_stripped_faces", f"WITH {_STRIP} SELECT f_id, p.new_id AS a, q.new_id AS b, r.new_id AS c FROM kept JOIN ids p ON p.v_id = a JOIN ids q ON q.v_id = b JOIN ids r ON r.v_id = c")
def p7_faces(t: Tables) -> DataFrame:
    return _stripped(t).faces.select("f_id", "a", "b", "c")


@query("p7_clutter", f"WITH {_STRIP} SELECT v_id, kind FROM gone JOIN scene USING (v_id)")
def p7_clutter(t: Tables) -> DataFrame:
    """Things on the table, but for those at the wall."""
    return t.scene.join(_stripped(t).clutter, "v_id").select("v_id", "kind")


_SPREAD = "SELECT DISTINCT ix + i AS ix, iy + j AS iy FROM {0}, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) s(i, j)"
_WORN = "SELECT ix, iy FROM (SELECT ix + i AS ix, iy + j AS iy FROM {0}, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) s(i, j)) GROUP BY 1, 2 HAVING count(*) = 5"
#: The table's axes are u = -z and v = -x. Cells as wide as its points are apart make one region.
_FILL = f"""{_STRIP}, uv AS (SELECT -z AS p, -x AS q FROM near WHERE plane = 2), lo AS (SELECT min(p) - 0.25 * 5 AS p0, min(q) - 0.25 * 5 AS q0 FROM uv),
        m AS (SELECT CAST(floor((p - p0) / 0.25) AS BIGINT) AS ix, CAST(floor((q - q0) / 0.25) AS BIGINT) AS iy FROM uv, lo GROUP BY 1, 2 HAVING count(*) >= 2),
        g1 AS ({_SPREAD.format('m')}), g2 AS ({_SPREAD.format('g1')}), h1 AS ({_WORN.format('g2')}), h2 AS ({_WORN.format('h1')}), o AS ({_SPREAD.format('h2')}),
        n AS (SELECT unnest(range(0, 200)) AS k), grid AS (SELECT k.k, l.k AS l FROM n k, n l JOIN o ON iy = CAST(floor(l.k * 0.1::DOUBLE / 0.25) AS BIGINT) WHERE ix = CAST(floor(k.k * 0.1::DOUBLE / 0.25) AS BIGINT)),
        xyz AS (SELECT k, l, -(l * 0.1::DOUBLE + q0) AS x, 0.75::DOUBLE AS y, -(k * 0.1::DOUBLE + p0) AS z FROM grid, lo),
        stays AS (SELECT s.* FROM scene s JOIN ids USING (v_id)),
        far AS (SELECT *, row_number() OVER (ORDER BY l, k) - 1 AS v_id FROM xyz g WHERE NOT EXISTS (SELECT 1 FROM stays s WHERE (s.x-g.x)**2 + (s.y-g.y)**2 + (s.z-g.z)**2 < 0.05 * 0.05::DOUBLE))"""
_FILLING = R.Fill(grid=0.1, cell=0.25)


def _filled(t: Tables) -> tuple[DataFrame, DataFrame]:
    s = _stripped(t)
    return R.fill_table(s.table, s.table_points, s.vertices, _FILLING)


@query("p8_filled_vertices", f"WITH {_FILL} SELECT v_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM far")
def p8_vertices(t: Tables) -> DataFrame:
    """The patch on the table, where no vertex that stays is near."""
    return _filled(t)[0].select("v_id", *[r6(F.col(n), n) for n in "xyz"])


@query(
    "p8_filled_faces",
    f"""WITH {_FILL}, sq AS (SELECT k - i AS k, l - j AS l, max(v_id) FILTER (i = 0 AND j = 0) AS c0, max(v_id) FILTER (i = 1 AND j = 0) AS c1, max(v_id) FILTER (i = 0 AND j = 1) AS c2, max(v_id) FILTER (i = 1 AND j = 1) AS c3 FROM far, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) s(i, j) GROUP BY 1, 2)
        SELECT c0 AS a, c1 AS b, c3 AS c FROM sq WHERE c0 + c1 + c3 IS NOT NULL UNION ALL SELECT c0, c3, c2 FROM sq WHERE c0 + c3 + c2 IS NOT NULL
        UNION ALL SELECT c0, c1, c2 FROM sq WHERE c0 + c1 + c2 IS NOT NULL AND c3 IS NULL UNION ALL SELECT c1, c3, c2 FROM sq WHERE c1 + c3 + c2 IS NOT NULL AND c0 IS NULL""",
)
def p8_faces(t: Tables) -> DataFrame:
    return _filled(t)[1].select("a", "b", "c")


@query(
    "p6_room_planes",
    """SELECT plane, count(*) AS points FROM (SELECT CASE WHEN abs(y) < 0.03 THEN 'floor' WHEN abs(x - 0.55) < 0.03 THEN 'wall' WHEN abs(y - 0.75) < 0.03 THEN 'table' WHEN abs(y - 2.5) < 0.03 THEN 'ceiling' END AS plane FROM scene WHERE kind < 6 AND (kind IN (2, 4, 5) OR abs(x - 0.55) >= 0.06)) GROUP BY 1""",
)
def p6_room(t: Tables) -> DataFrame:
    """The planes of the room without its things and where planes meet, as the search finds them, by name of where they lie."""
    found = M.planes(t.scene.where("kind < 6 and (kind in (2, 4, 5) or abs(x - 0.55) >= 0.06)"), least=20, key="v_id")
    where = F.when(F.abs("b") < 0.5, "wall").when(F.abs("d") < 0.1, "floor").when(F.abs(F.abs("d") - 0.75) < 0.1, "table").otherwise("ceiling")
    rows = [(*map(float, eq), int(n)) for eq, n in found]
    return t.spark.createDataFrame(rows, "a double, b double, c double, d double, points bigint").select(where.alias("plane"), "points")
