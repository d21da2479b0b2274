"""Mesh repair on vertex and face tables: edges of many faces, pinched vertices, holes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.quantiles import cut_lineage
from strandline.operators.series import numbered
from strandline.operators.spatial import face_components, with_shape


def _top(df: DataFrame, key: str) -> int:
    return df.agg(F.coalesce(F.max(key) + 1, F.lit(0)).alias("top")).first()["top"]


def thin_edges(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """faces, of which at most the two largest stay at each edge; of equal ones those with the smallest ids.

    A face goes if a single one of its edges has two larger ones. All edges are judged at once, so where edges of one face
    compete more may go than by taking faces away one at a time.
    """
    sides = F.array(*[F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi")) for p, q in ("ab", "bc", "ca")])
    at = with_shape(faces, vertices).select("f_id", "area", F.explode(sides).alias("e")).select("f_id", "area", "e.*")
    rank = F.row_number().over(Window.partitionBy("lo", "hi").orderBy(F.desc("area"), "f_id"))
    extra = at.withColumn("rank", rank).where("rank > 2").select("f_id").distinct()
    return faces.join(extra, "f_id", "left_anti")


def split_pinched(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) where faces around a vertex hang together by edges; else the vertex is doubled.

    Of a vertex's fans, that with the smallest face corner keeps its id; the others get new ones, after the largest, in order.
    Corners of a face are numbered 3 * f_id + 0, 1, 2. The fans are components of corners that share an edge.
    """
    corner = lambda k: 3 * F.col("f_id") + k
    spots = faces.select("f_id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), corner(k).alias("node"), F.col(c).alias("v_id")) for k, c in enumerate("abc")])).alias("s")).select("f_id", "s.*")
    ends = []
    for (p, i), (q, j) in ((("a", 0), ("b", 1)), (("b", 1), ("c", 2)), (("c", 2), ("a", 0))):
        first = F.col(p) < F.col(q)
        ends.append(F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi"), F.when(first, corner(i)).otherwise(corner(j)).alias("x"), F.when(first, corner(j)).otherwise(corner(i)).alias("y")))
    sides = faces.select(F.explode(F.array(*ends)).alias("e")).select("e.*")
    least = sides.groupBy("lo", "hi").agg(F.min("x").alias("mx"), F.min("y").alias("my"))
    links = sides.join(least, ["lo", "hi"]).select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("mx").alias("b")), F.struct(F.col("y").alias("a"), F.col("my").alias("b")))).alias("l"))
    fans = face_components(links.select(F.lit(0).alias("f_id"), "l.a", "l.b", F.col("l.a").alias("c")))
    spots = spots.join(fans.select(F.col("v_id").alias("node"), "component"), "node")
    own = spots.groupBy("v_id").agg(F.min("component").alias("own"))
    others = spots.join(own, "v_id").where("component <> own").select("v_id", "component").distinct()
    top = _top(vertices, "v_id")
    new = numbered(others.withColumn("one", F.lit(0)), ["one"], ["v_id", "component"], "n").select("component", F.col("v_id").alias("old"), (F.col("n") + top).alias("new_id"))
    turned = spots.join(new.select("component", "new_id"), "component", "left").withColumn("v_id", F.coalesce("new_id", "v_id"))
    rebuilt = turned.groupBy("f_id").agg(*[F.max(F.when(F.col("k") == k, F.col("v_id"))).alias(c) for k, c in enumerate("abc")])
    copies = vertices.join(new.select(F.col("old").alias("v_id"), "new_id"), "v_id").withColumn("v_id", F.col("new_id")).drop("new_id")
    return vertices.unionByName(copies), rebuilt


def _edges(faces: DataFrame) -> DataFrame:
    """(lo, hi, n, side): each edge, its number of faces, and the way (p, q) in which one of them runs along it."""
    half = faces.select(F.explode(F.array(*[F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in ("ab", "bc", "ca")])).alias("side"))
    return half.groupBy(F.least("side.p", "side.q").alias("lo"), F.greatest("side.p", "side.q").alias("hi")).agg(F.count("*").alias("n"), F.min("side").alias("side"))


def border_loops(faces: DataFrame, most: int = 30) -> DataFrame:
    """(low, loop): edges of a single face make borders. The vertices of each hole with at most `most` edges, from its smallest vertex on, in the order in which faces that close it turn.

    Each border vertex knows the next one; by doubling, after r rounds the smallest of the 2**r vertices ahead and how
    far it is. Where all of a loop is in sight its smallest vertex stands for it; longer ones never close on it. Loops
    through a vertex where several borders meet are left out.
    """
    border = _edges(faces).where("n = 1").select(F.col("side.q").alias("v"), F.col("side.p").alias("to"))
    one_out = border.groupBy("v").agg(F.count("*").alias("n")).where("n = 1").select("v")
    one_in = border.groupBy("to").agg(F.count("*").alias("n")).where("n = 1").select("to")
    # Each round reads the last one twice, so rounds are cut off from each other.
    step = cut_lineage(border.join(one_out, "v", "left_semi").join(one_in, "to", "left_semi"))
    seen, reach = step.select("v", "to", F.col("v").alias("low"), F.lit(0).alias("at")), 1
    while reach <= most:
        ahead = seen.select(F.col("v").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"), F.col("at").alias("at2"))
        less = F.col("low2") < F.col("low")
        seen = seen.join(ahead, "to").select("v", F.col("to2").alias("to"), F.when(less, F.col("low2")).otherwise(F.col("low")).alias("low"), F.when(less, reach + F.col("at2")).otherwise(F.col("at")).alias("at"))
        seen, reach = cut_lineage(seen), 2 * reach
    loops = seen.groupBy("low").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("at", "v")), False).alias("back")).where(f"n between 3 and {most}")
    # Back at its smallest vertex: the vertex after it has all others ahead of it.
    closed = step.select(F.col("v").alias("low"), F.col("to").alias("v")).join(seen.select("v", F.col("low").alias("same"), "at"), "v").where("same = low").select("low", "at")
    loops = loops.join(closed, "low").where("at = n - 1")
    around = F.concat(F.array("low"), F.transform(F.filter("back", lambda x: x["at"] > 0), lambda x: x["v"]))
    return loops.select("low", around.alias("loop"))


def close_holes(faces: DataFrame, most: int = 30) -> DataFrame:
    """faces and, for each hole of at most `most` edges, a fan of faces around its smallest vertex, numbered after the others.

    A hole across which the mesh has an edge already, where the fan would lay another, stays open.
    """
    loops = cut_lineage(border_loops(faces, most))
    across = loops.where(F.size("loop") > 3).select("low", F.explode(F.slice("loop", F.lit(3), F.size("loop") - 3)).alias("far"))
    taken = across.join(_edges(faces), (F.least("low", "far") == F.col("lo")) & (F.greatest("low", "far") == F.col("hi")), "left_semi").select("low").distinct()
    loops = loops.join(taken, "low", "left_anti").select("low", "loop", F.explode(F.sequence(F.lit(1), F.size("loop") - 2)).alias("i"))
    fan = loops.select("low", "i", F.get("loop", F.lit(0)).alias("a"), F.get("loop", F.col("i")).alias("b"), F.get("loop", F.col("i") + 1).alias("c"))
    fan = numbered(fan.withColumn("one", F.lit(0)), ["one"], ["low", "i"], "n")
    return faces.select("f_id", "a", "b", "c").unionByName(fan.select((F.col("n") + _top(faces, "f_id")).alias("f_id"), "a", "b", "c"))
