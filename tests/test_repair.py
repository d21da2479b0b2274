"""Mesh repair on meshes with planted holes, fans and edges of many faces."""

from __future__ import annotations

from collections import defaultdict

from strandline.operators import mesh as M
from strandline.operators import repair as R

XYZ = "v_id long, x double, y double, z double"
FACES = "f_id long, a long, b long, c long"


def grid(n, skip=()):
    v = [(i * n + j, float(i), 0.0, float(j)) for i in range(n) for j in range(n)]
    cells = [(i, j) for i in range(n - 1) for j in range(n - 1) if (i, j) not in skip]
    return v, [t for i, j in cells for p in [i * n + j] for t in ((p, p + 1, p + n), (p + 1, p + n + 1, p + n))]


def tables(spark, v, f):
    return spark.createDataFrame(v, XYZ), spark.createDataFrame([(i, *x) for i, x in enumerate(f)], FACES)


def borders(faces):
    half = {(x[i], x[(i + 1) % 3]) for x in faces for i in range(3)}
    return {(p, q) for p, q in half if (q, p) not in half}


def loops_plainly(faces):
    step = defaultdict(list)
    for p, q in borders(faces):
        step[q].append(p)
    out, seen = [], set()
    for v in sorted(step):
        loop, x = [], v
        while x not in seen and len(step[x]) == 1:
            seen.add(x)
            loop.append(x)
            x = step[x][0]
        if loop and x == v:
            out.append(loop)
    return out


def triples(df):
    return [(r["a"], r["b"], r["c"]) for r in df.collect()]


def test_loops_equal_a_walk(spark):
    v, f = grid(12, {(2, 2), (5, 5), (5, 6), (6, 5), (8, 2), (8, 3), (8, 4), (8, 5), (8, 6)})
    _, faces = tables(spark, v, f)
    for most in (3, 4, 12, 30, 60):
        got = {tuple(r["loop"]) for r in R.border_loops(faces, most).collect()}
        assert got == {tuple(x) for x in loops_plainly(f) if len(x) <= most}
    assert len(loops_plainly(f)) == 4  # three holes and the rim


def test_holes_close_and_larger_ones_stay(spark):
    v, f = grid(12, {(2, 2), (5, 5), (5, 6), (6, 5)})
    _, faces = tables(spark, v, f)
    closed = R.close_holes(faces, 30)
    new = triples(closed)
    rim = [x for x in loops_plainly(f) if len(x) > 30]
    assert loops_plainly(new) == rim and len(rim) == 1
    assert len(new) - len(f) == sum(len(x) - 2 for x in loops_plainly(f) if len(x) <= 30)
    half = [(x[i], x[(i + 1) % 3]) for x in new for i in range(3)]
    assert len(half) == len(set(half))  # every face turns as its neighbours do
    assert sorted(r["f_id"] for r in closed.collect()) == list(range(len(new)))
    assert triples(R.close_holes(closed, 30)) and len(triples(R.close_holes(closed, 30))) == len(new)
    assert R.close_holes(faces.where("false")).collect() == []


def test_two_holes_at_one_vertex_stay_open(spark):
    v, f = grid(9, {(2, 2), (3, 3)})
    _, faces = tables(spark, v, f)
    assert len(triples(R.close_holes(faces, 20))) == len(f)


def fans_plainly(faces):
    around = defaultdict(list)
    for i, x in enumerate(faces):
        for p in x:
            around[p].append(i)
    out = {}
    for p, own in around.items():
        up = {i: i for i in own}

        def root(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        for i in own:
            for j in own:
                if len(set(faces[i]) & set(faces[j])) >= 2 and i != j:
                    up[root(i)] = root(j)
        out[p] = len({root(i) for i in own})
    return out


def test_pinched_vertices_are_doubled(spark):
    # Two holes that meet in a vertex, and two sheets that touch in one.
    v, f = grid(6, {(1, 1), (2, 2)})
    far = [(100 + i, x + 5.0, y, z + 5.0) for i, x, y, z in grid(3)[0]]
    more = [tuple(35 if p == 0 else 100 + p for p in x) for x in grid(3)[1]]
    vertices, faces = tables(spark, v + far[1:], f + more)
    before = fans_plainly(f + more)
    assert sorted(p for p, n in before.items() if n > 1) == [14, 35]
    out_v, out_f = R.split_pinched(vertices, faces)
    rows = sorted(map(tuple, out_f.select("f_id", "a", "b", "c").collect()))
    assert len(rows) == len(f + more) and set(fans_plainly([r[1:] for r in rows]).values()) == {1}
    at = {r["v_id"]: (r["x"], r["y"], r["z"]) for r in out_v.collect()}
    old = {i: (x, y, z) for i, x, y, z in v + far[1:]}
    assert set(at) == set(old) | {109, 110}
    assert all([at[p] for p in r[1:]] == [old[p] for p in x] for r, x in zip(rows, f + more))
    same_v, same_f = R.split_pinched(*tables(spark, *grid(4)))
    assert same_v.count() == 16 and sorted(triples(same_f)) == sorted(grid(4)[1])


def test_edges_keep_their_two_largest_faces(spark):
    v = [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 2.0, 0.0), (3, 0.0, 0.0, 3.0), (4, 0.0, -1.0, 0.0), (5, 0.0, 0.0, -1.0)]
    vertices, faces = tables(spark, v, [(0, 1, 4), (0, 1, 2), (1, 0, 3), (0, 1, 5)])
    assert sorted(triples(R.thin_edges(vertices, faces))) == [(0, 1, 2), (1, 0, 3)]
    tie = [(0, 1, 4), (0, 1, 5), (0, 1, 2)]
    assert sorted(triples(R.thin_edges(*tables(spark, v, tie)))) == [(0, 1, 2), (0, 1, 4)]


def test_cleaning_repairs_when_asked(spark):
    v, f = grid(7, {(3, 3)})
    vertices, faces = tables(spark, [*v, (99, 1.0, 0.1, 1.5)], [*f, (8, 9, 99)])  # a third, small face at an edge
    _, mended = M.clean(vertices, faces, least_faces=1, least_size=0.0, smoothing=0, most_hole=6)
    rows = triples(mended)
    assert len(rows) == len(f) + 2 and [len(x) for x in loops_plainly(rows)] == [24]


def test_a_hole_with_an_edge_across_stays_open(spark):
    # The square 0 1 2 3 lacks its faces, but 0 and 2 are joined elsewhere: by faces with 9.
    f = [(1, 0, 4), (2, 1, 5), (3, 2, 6), (0, 3, 7), (0, 2, 9), (2, 0, 8)]
    faces = spark.createDataFrame([(i, *x) for i, x in enumerate(f)], FACES)
    assert sorted(triples(R.close_holes(faces, 4))) == sorted(f)
