"""Nearest-in-time joins on whole microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_within(left: DataFrame, right: DataFrame, tolerance: int, by: str = "recording_id", time: str = "t_us", key: str = "seq", values: tuple[str, ...] = ("seq", "t_us"), prefix: str = "r_") -> DataFrame:
    """left with the columns values of the nearest right row, |dt| <= tolerance, else null.

    Ties take the earlier row; of right rows at one time the first by seq, or the last where that time is before the left
    row's. No row of left is lost or merged.
    """
    return nearest_within_each(left, [(right, tolerance, prefix)], by, time, key, values)


def nearest_within_each(left: DataFrame, rights: list[tuple[DataFrame, int, str]], by: str = "recording_id", time: str = "t_us", key: str = "seq", values: tuple[str, ...] = ("seq", "t_us"), blocks: int = 16) -> DataFrame:
    """left with values of the nearest row of each of rights (right, tolerance, prefix), as by nearest_within, over one shuffle.

    Time is cut into blocks of `blocks` times the largest tolerance. All streams are dealt by (by, block), narrow and as they are; right
    rows within their tolerance of a block's border go to the neighbour, too. Running windows over a block know the last
    right row before a left row and the first one at or behind it.
    """
    width = blocks * max(1, *[tolerance for _, tolerance, _ in rights])
    block = F.floor(F.col(time) / width)
    more = [v for v in values if v not in (key, time)]
    rest = [c for c in left.columns if c not in (by, time)]
    both = left.select(F.col(by).alias("_by"), block.alias("_b"), F.col(time).alias("_t"), F.lit(0).cast("byte").alias("_side"), F.struct(*rest).alias("_l") if rest else F.lit(0).alias("_l"))
    for i, (right, tolerance, _) in enumerate(rights, 1):
        at = F.col(time) - block * width
        seen = F.array_compact(F.array(block, F.when(at < tolerance, block - 1), F.when(width - at <= tolerance, block + 1)))
        r = right.where(F.col(by).isNotNull() & F.col(time).isNotNull())
        r = r.select(F.col(by).alias("_by"), F.explode(seen).alias("_b"), F.col(time).alias("_t"), F.lit(i).cast("byte").alias("_side"), F.col(key).alias("_k"), *([F.struct(*more).alias(f"_x{i}")] if more else []))
        both = both.unionByName(r, allowMissingColumns=True)
    up = Window.partitionBy("_by", "_b").orderBy("_t", "_side", "_k").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_by", "_b").orderBy(F.desc("_t"), F.desc("_side"), F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    mark = lambda i: F.when(F.col("_side") == i, F.struct("_t", "_k", *([f"_x{i}"] if more else [])))
    for name, window in (("p", up), ("n", down)):
        both = both.withColumns({f"_{name}{i}": F.last(mark(i), True).over(window) for i in range(1, len(rights) + 1)})
    out = [F.col("_by").cast(left.schema[by].dataType).alias(by), F.col("_t").cast(left.schema[time].dataType).alias(time), *[F.col(f"_l.{c}").alias(c) for c in rest]]
    near = {}
    for i, (_, tolerance, _) in enumerate(rights, 1):
        before, behind = F.col("_t") - F.col(f"_p{i}._t"), F.col(f"_n{i}._t") - F.col("_t")
        earlier = (before <= tolerance) & (behind.isNull() | (before <= behind))
        near[f"_v{i}"] = F.when(earlier, F.col(f"_p{i}")).when(behind <= tolerance, F.col(f"_n{i}"))
    for i, (right, _, prefix) in enumerate(rights, 1):
        of = {key: f"_v{i}._k", time: f"_v{i}._t"} | {v: f"_v{i}._x{i}.{v}" for v in more}
        out += [F.col(of[v]).cast(right.schema[v].dataType).alias(prefix + v) for v in values]
    d = both.where("_side = 0").withColumns(near).select(*out)
    return d.select(*left.columns, *[prefix + v for _, _, prefix in rights for v in values])


def nearest(left: DataFrame, right: DataFrame, width: int, by: str = "recording_id", time: str = "t_us", key: str = "seq", prefix: str = "r_") -> DataFrame:
    """left with key and time of the nearest right row, however far; nulls where by has no right row.

    Running windows cover one bucket of time each; what lies beyond a bucket is its neighbours' last and
    first right row, known from one small row per bucket. Ties as in nearest_within.
    """
    bucket = F.floor(F.col(time) / width)
    mark = F.struct(F.col(time).alias("t"), F.col(key).alias("k"))
    l, r = left.withColumn("_b", bucket), right.select(F.col(by), bucket.alias("_b"), mark.alias("_r"))
    edges = r.groupBy(by, "_b").agg(F.min("_r").alias("lo"), F.min(F.struct(-F.col("_r.t"), -F.col("_r.k"))).alias("hi"))
    edges = edges.select(by, "_b", "lo", F.struct((-F.col("hi.col1")).alias("t"), (-F.col("hi.col2")).alias("k")).alias("hi"))
    spots = edges.unionByName(l.select(by, "_b").distinct(), allowMissingColumns=True)
    spots = spots.groupBy(by, "_b").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    spots = spots.select(by, "_b", F.last("hi", True).over(before).alias("_prev"), F.last("lo", True).over(after).alias("_next"))
    rows = l.withColumns({"_t": F.col(time), "_left": F.lit(True), "_k": F.lit(None).cast("long")})
    marks = r.select(by, "_b", "_r", F.col("_r.t").alias("_t"), F.lit(False).alias("_left"), F.col("_r.k").alias("_k"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    up = Window.partitionBy(by, "_b").orderBy("_t", "_left", "_k").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(by, "_b").orderBy(F.desc("_t"), "_left", F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_p", F.last("_r", True).over(up)).withColumn("_n", F.last("_r", True).over(down)).where("_left")
    near = near.join(spots, [by, "_b"], "left")
    p, n = F.coalesce("_p", "_prev"), F.coalesce("_n", "_next")
    near = near.withColumn("_p", p).withColumn("_n", n)
    earlier = F.col("_n").isNull() | ((F.col(time) - F.col("_p.t") <= F.col("_n.t") - F.col(time)) & (F.col("_p.t") < F.col(time)))
    best = F.when(F.col("_p").isNotNull() & earlier, F.col("_p")).otherwise(F.col("_n"))
    return near.withColumn("_v", best).select(*left.columns, F.col("_v.k").alias(prefix + key), F.col("_v.t").alias(prefix + time))


def nearest_gap(left: DataFrame, right: DataFrame, width: int, by: str = "recording_id", time: str = "t_us") -> DataFrame:
    """left with gap = distance to the nearest right time, however far."""
    near = nearest(left, right, width, by, time, prefix="_near_")
    return near.withColumn("gap", F.abs(F.col(time) - F.col(f"_near_{time}"))).select(*left.columns, "gap")
