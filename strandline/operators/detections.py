"""Detections on frames: suppression of overlapping boxes, depth at a pixel, hands put at measured depth, footprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import geometry as G
from strandline.operators.quantiles import cut_lineage

#: Joints whose depth places a hand, in this order: wrist, then the bases of middle, index, ring and little finger.
ANCHORS = (0, 9, 5, 13, 17)


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes, structs of x1, y1, x2, y2."""
    area = lambda k: (k["x2"] - k["x1"]) * (k["y2"] - k["y1"])
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    both = side("x1", "x2") * side("y1", "y2")
    return both / F.nullif(area(a) + area(b) - both, F.lit(0.0))


def suppress(boxes: DataFrame, frame: list[str], id_col: str, most: float = 0.5, above: float | None = None) -> DataFrame:
    """(frame, id_col) of the boxes that stay: best score first, each drops those that overlap it by more than most.

    boxes: frame, id_col, score, x1, y1, x2, y2. Ties go to the smaller id. What a detector returns for one
    frame is a short list, so a frame's boxes are one array and the greedy choice is a fold over it.
    Scores are held against above after the choice, so a box below it may still have dropped others.
    """
    box = F.struct((-F.col("score")).alias("rank"), F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    listed = boxes.groupBy(*frame).agg(F.sort_array(F.collect_list(box)).alias("all"))
    fold = F.aggregate("all", F.slice("all", 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: overlap(k, b) > most), kept).otherwise(F.concat(kept, F.array(b))))
    out = listed.select(*frame, F.explode(fold).alias("b"))
    if above is not None:
        out = out.where(-F.col("b.rank") > above)
    return out.select(*frame, F.col("b.id").alias(id_col))


def overlapping(boxes: DataFrame, frame: list[str], id_col: str, most: float, cell: float) -> DataFrame:
    """(frame, winner, loser): pairs of a frame's boxes that overlap by more than most; the winner has the better score, or the smaller id.

    Boxes meet in the cells that they touch; a pair counts in the one cell that holds the corner of its intersection, so it
    comes up once. Boxes without an area overlap nothing.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    b = boxes.select(*frame, F.col(id_col).alias("id"), F.col("score").cast("double").alias("score"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    b = b.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    b = b.withColumn("ix", F.explode(F.sequence(at("x1"), at("x2")))).withColumn("iy", F.explode(F.sequence(at("y1"), at("y2"))))
    other = b.select(*[F.col(c).alias(f"f{i}") for i, c in enumerate(frame)], *[F.col(c).alias(f"o_{c}") for c in ("id", "score", "x1", "y1", "x2", "y2", "ix", "iy")])
    same = [F.col(c).eqNullSafe(F.col(f"f{i}")) for i, c in enumerate(frame)] + [F.col("ix") == F.col("o_ix"), F.col("iy") == F.col("o_iy")]
    better = (F.col("score") > F.col("o_score")) | ((F.col("score") == F.col("o_score")) & (F.col("id") < F.col("o_id")))
    own = (F.floor(F.greatest("x1", "o_x1") / cell) == F.col("ix")) & (F.floor(F.greatest("y1", "o_y1") / cell) == F.col("iy"))
    box = lambda p: F.struct(*[F.col(p + c).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return b.join(other, same).where(better & own & (overlap(box(""), box("o_")) > most)).select(*frame, F.col("id").alias("winner"), F.col("o_id").alias("loser"))


def suppress_crowded(boxes: DataFrame, frame: list[str], id_col: str, most: float = 0.5, above: float | None = None, cell: float = 64.0) -> DataFrame:
    """The same boxes as suppress, for frames of any number of boxes: no frame is gathered.

    In each round the boxes that no undecided better box overlaps stay, and those that they overlap go. The best undecided box
    of a frame is always decided, so the rounds end; each one is cut off from the last by a checkpoint. A null score is the worst.
    Rows of a null frame all stay.
    """
    d = boxes.withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))))
    pairs = cut_lineage(overlapping(d, frame, id_col, most, cell))
    gone = None
    while not pairs.isEmpty():
        lost = pairs.select(*frame, F.col("loser").alias("winner")).distinct()
        safe = pairs.join(lost, [*frame, "winner"], "left_anti").select(*frame, "winner").distinct()
        new = cut_lineage(pairs.join(safe, [*frame, "winner"], "left_semi").select(*frame, F.col("loser").alias(id_col)).distinct())
        gone = new if gone is None else gone.unionByName(new)
        for end in ("winner", "loser"):
            pairs = pairs.join(new.withColumnRenamed(id_col, end), [*frame, end], "left_anti")
        pairs = cut_lineage(pairs)
    out = d if gone is None else d.join(gone, [*frame, id_col], "left_anti")
    return (out if above is None else out.where(F.col("score") > above)).select(*frame, id_col)


def sample_depth(targets: DataFrame, pixels: DataFrame, frame: str, id_col: str, width: int, height: int, radius: int = 7, near: int = 50, far: int = 2000) -> DataFrame:
    """targets (frame, id_col, u, v) with z, the median depth in metres around each; null where too little is valid.

    A target's window is spread into its pixels, so the join is on equal (frame, u, v) and a frame of any
    size meets only the pixels it needs. At least 3 and 15 % of the clipped window must lie between near and far.
    """
    u, v = F.bround("u").cast("long"), F.bround("v").cast("long")
    inside = targets.withColumns({"_u": u, "_v": v}).where((F.col("_u") >= 0) & (F.col("_u") < width) & (F.col("_v") >= 0) & (F.col("_v") < height))
    low = lambda c: F.greatest(F.lit(0), F.col(c) - radius)
    high = lambda c, top: F.least(F.lit(top - 1), F.col(c) + radius)
    window = inside.withColumn("_size", (high("_u", width) - low("_u") + 1) * (high("_v", height) - low("_v") + 1))
    window = window.withColumn("_pu", F.explode(F.sequence(low("_u"), high("_u", width)))).withColumn("_pv", F.explode(F.sequence(low("_v"), high("_v", height))))
    valid = pixels.where((F.col("mm") > near) & (F.col("mm") < far)).select(F.col(frame).alias("_f"), F.col("u").cast("long").alias("_pu"), F.col("v").cast("long").alias("_pv"), "mm")
    found = window.select(F.col(frame).alias("_f"), id_col, "_size", "_pu", "_pv").join(valid, ["_f", "_pu", "_pv"])
    z = found.groupBy(id_col).agg(F.count("*").alias("_n"), F.max("_size").alias("_size"), F.percentile("mm", F.lit(0.5)).alias("_mm"))
    z = z.where(F.col("_n") >= F.greatest(F.lit(3.0), 0.15 * F.col("_size"))).select(id_col, (F.col("_mm") / 1000.0).alias("z"))
    return targets.join(z, id_col, "left")


def anchor_points(samples: DataFrame, id_col: str, fx: float, fy: float, cx: float, cy: float) -> DataFrame:
    """(id_col, z, anchor) of hands, from depth samples (id_col, joint, u, v, z near, z_small) of their joints.

    The first of ANCHORS with a depth places the hand; else the wrist's pixel at the median of the
    small windows' depths, if three joints have one at least. Hands with neither are left out.
    """
    rank = F.coalesce(*[F.when(F.col("joint") == j, F.lit(i)) for i, j in enumerate(ANCHORS)])
    first = F.min_by(F.struct("u", "v", "z"), F.when(rank.isNotNull() & F.col("z").isNotNull(), rank))
    g = samples.groupBy(id_col).agg(first.alias("a"), F.count("z_small").alias("n"), F.percentile("z_small", F.lit(0.5)).alias("m"), F.max_by(F.struct("u", "v"), F.when(F.col("joint") == 0, 1)).alias("w"))
    g = g.where(F.col("a").isNotNull() | ((F.col("n") >= 3) & F.col("w").isNotNull()))
    g = g.select(id_col, F.coalesce("a.z", "m").alias("z"), F.coalesce("a.u", "w.u").alias("u"), F.coalesce("a.v", "w.v").alias("v"))
    return g.select(id_col, "z", G.back_project(F.col("u"), F.col("v"), F.col("z") * 1000.0, fx, fy, cx, cy).alias("anchor"))


def outline(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of (n, 2) points, in order: the farthest point of each side splits it."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def beyond(a: np.ndarray, b: np.ndarray, some: np.ndarray) -> list[np.ndarray]:
        if not len(some):
            return []
        away = (b[0] - a[0]) * (some[:, 1] - a[1]) - (b[1] - a[1]) * (some[:, 0] - a[0])
        out = away < 0
        if not out.any():
            return []
        some, away = some[out], away[out]
        top = some[np.argmin(away)]
        return [*beyond(a, top, some), top, *beyond(top, b, some)]

    a, b = points[0], points[-1]
    return np.array([a, *beyond(a, b, points), b, *beyond(b, a, points)])


def footprints(points: DataFrame, key: str, axes: tuple[str, str] = ("x", "z")) -> DataFrame:
    """(key, area) of the convex hull of each key's points; 0 for fewer than three different points or a line.

    Every Arrow batch is first cut down to its hulls' corners. A key's corners of all batches are dealt to
    salts and cut down again, so that no task meets more of a key than corners.
    """
    p, q = axes
    rows = points.where(F.col(p).isNotNull() & F.col(q).isNotNull()).select(key, F.col(p).cast("double").alias("p"), F.col(q).cast("double").alias("q"))
    kind = rows.schema[key].dataType.simpleString()

    def corners(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for value, part in frame.groupby(key, dropna=False):
                o = outline(part[["p", "q"]].to_numpy())
                yield pd.DataFrame({key: [value] * len(o), "p": o[:, 0], "q": o[:, 1]})

    def again(frame: pd.DataFrame) -> pd.DataFrame:
        o = outline(frame[["p", "q"]].to_numpy())
        return pd.DataFrame({key: [frame[key].iloc[0]] * len(o), "p": o[:, 0], "q": o[:, 1]})

    def area(frame: pd.DataFrame) -> pd.DataFrame:
        o = outline(frame[["p", "q"]].to_numpy())
        x, y = o[:, 0], o[:, 1]
        return pd.DataFrame({key: [frame[key].iloc[0]], "area": [float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2) if len(o) > 2 else 0.0]})

    shape = f"`{key}` {kind}, p double, q double"
    cut = rows.mapInPandas(corners, shape).withColumn("_salt", F.pmod(F.xxhash64("p", "q"), F.lit(64)))
    cut = cut.groupBy(key, "_salt").applyInPandas(lambda f: again(f), shape)
    return cut.groupBy(key).applyInPandas(area, f"`{key}` {kind}, area double")


def up_signs(poses: DataFrame, up: Column, frames: int = 10) -> DataFrame:
    """(recording_id, decided_at, up_y): sign of the mean upward component over a recording's first posed frames.

    Nothing is decided for recordings with fewer frames; 0 counts as up. The row number's bound is pushed
    below the shuffle, so tasks pass on only the first frames of each recording.
    """
    w = Window.partitionBy("recording_id").orderBy("seq")
    first = poses.select("recording_id", "seq", up.alias("up")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= frames)
    g = first.groupBy("recording_id").agg(F.max("seq").alias("decided_at"), F.avg("up").alias("up"), F.count("*").alias("n")).where(F.col("n") == frames)
    return g.select("recording_id", "decided_at", F.when(F.col("up") < 0, -1).otherwise(1).alias("up_y"))
