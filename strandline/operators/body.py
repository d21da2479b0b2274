"""An upper body from camera poses and hands: a chain of joints, each from those before it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import geometry as G
from strandline.operators.session import BODY_JOINTS


@dataclass(frozen=True)
class Body:
    """Fixed values, in metres: where the neck, head, shoulders and spine are, and the lengths of the arm's bones."""

    neck_back: float = 0.10
    neck_drop: float = 0.20
    head_up: float = 0.10
    shoulder_drop: float = 0.12
    shoulder_side: float = 0.18
    spine_drop: float = 0.45
    upper_arm: float = 0.33
    forearm: float = 0.27


def wrists(hands: DataFrame, by: list[str], order: str = "det_seq") -> DataFrame:
    """(by, l_hand, r_hand): the last hand of each side with a depth; hands: by, order, side, wrist in optical axes.

    Any side but 'left' is right.
    """
    last = lambda own: F.max_by(F.when(own, F.col("wrist")), F.when(own, F.col(order)))
    left = F.col("side").eqNullSafe("left")
    return hands.where(G.at(F.col("wrist"), 2) != 0).groupBy(*by).agg(last(left).alias("l_hand"), last(~left).alias("r_hand"))


def upper_body(frames: DataFrame, hands: DataFrame, by: list[str], b: Body = Body(), forward: tuple[int, float] = (0, 1.0), right: tuple[int, float] = (1, -1.0), link: Column | None = None, order: str = "det_seq") -> DataFrame:
    """frames' by with joints (ten points in world axes, in the order of BODY_JOINTS) and visible (ten booleans).

    frames: by, rot and at of the camera, up (a unit axis); one row per by. forward and right name a column of rot and its
    sign. Neck, head, shoulders and spine follow from level directions, so a nod doesn't move them; where the camera looks
    straight up or down, forward is the axis after up. Wrists are those of the hands, elbows bend downward. A joint
    without its hand is null and not visible. Frames without a pose or without up are left out.
    """
    column = lambda k, sign: G.vec(*[G.at(F.col("rot"), 3 * i + k) * sign for i in range(3)])
    level = lambda v: G.vec(*[G.at(v, i) * (1 - F.abs(G.at(F.col("up"), i))) for i in range(3)])
    d = frames.where(F.col("rot").isNotNull() & F.col("at").isNotNull() & F.col("up").isNotNull()).select(*by, "rot", "at", "up")
    d = d.withColumns({"_f": level(column(*forward)), "_r": level(column(*right))}).withColumns({"_fn": G.norm(F.col("_f")), "_rn": G.norm(F.col("_r"))})
    after_up = G.vec(*[F.abs(G.at(F.col("up"), i)) for i in (2, 0, 1)])
    d = d.withColumn("_f", F.when(F.col("_fn") > 1e-6, G.times(F.col("_f"), 1 / F.when(F.col("_fn") > 0, F.col("_fn")))).otherwise(after_up))
    d = d.withColumn("_x", G.cross(F.col("_f"), F.col("up")))
    d = d.withColumn("_r", F.when(F.col("_rn") > 1e-6, G.times(F.col("_r"), 1 / F.when(F.col("_rn") > 0, F.col("_rn")))).otherwise(G.times(F.col("_x"), 1 / (G.norm(F.col("_x")) + 1e-9))))
    below = lambda p, k: G.sub(p, G.times(F.col("up"), k))
    d = d.withColumn("neck", below(G.sub(F.col("at"), G.times(F.col("_f"), b.neck_back)), b.neck_drop)).withColumn("_base", below(F.col("neck"), b.shoulder_drop))
    d = d.withColumns({
        "head": below(F.col("neck"), -b.head_up), "l_shoulder": G.sub(F.col("_base"), G.times(F.col("_r"), b.shoulder_side)),
        "r_shoulder": G.add(F.col("_base"), G.times(F.col("_r"), b.shoulder_side)), "spine": below(F.col("_base"), b.spine_drop), "mount_cam": F.col("at"),
    })
    d = d.join(wrists(hands, by, order), by, "left").withColumn("_down", G.times(F.col("up"), -1))
    for side in "lr":
        hand = F.col(f"{side}_hand")
        d = d.withColumns({"wrist": F.when(hand.isNotNull(), G.optical_to_world(hand, F.col("rot"), F.col("at"), link)), "shoulder": F.col(f"{side}_shoulder")})
        d = G.with_elbow(d, b.upper_arm, b.forearm, F.col("_down"))
        d = d.withColumns({f"{side}_wrist": F.col("wrist"), f"{side}_elbow": F.when(F.col("wrist").isNotNull(), F.col("elbow"))}).drop("wrist", "shoulder", "elbow")
    return d.select(*by, F.array(*BODY_JOINTS).alias("joints"), F.array(*[F.col(n).isNotNull() for n in BODY_JOINTS]).alias("visible"))
