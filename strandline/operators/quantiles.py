"""Exact quantiles by selection: histogram passes narrow the bins that hold the wanted ranks.

No task gathers a group's values: a pass counts them in bins (a partial aggregate), and only the bins that hold a wanted
rank are looked at again, cut anew between their own least and greatest value. Once a bin has few values, or one, its
values are ranked.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, written to the session's checkpoint folder and read from there; a temporary folder in local mode only."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strandline-"))
    return df.checkpoint()


def quantiles(df: DataFrame, by: list[str], wanted: dict[str, dict[str, float]], bins: int = 512, few: int = 1 << 16) -> DataFrame:
    """by and a column for each name of wanted, {column: {name: share}}: continuous quantiles of the column's known values.

    Ranks between two values are interpolated. Groups without any value of any column are left out; a column without
    values gives nulls. Rows are ranked in one window only where `few` or less of them, or equal ones, share a bin.
    Null groups are a group. NaN is ranked as the greatest value, and no quantile is made of it but NaN.
    """
    shares = sorted({q for names in wanted.values() for q in names.values()})
    cells = F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_v")) for c in wanted])
    v = df.select(*by, F.explode(cells).alias("_x")).select(*by, "_x.*").where("_v is not null")
    keys = [*by, "_col"]
    spots = v.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    places = [F.lit(q) * (F.col("_n") - 1) for q in shares]
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)]))
    spots = spots.select("*", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_m"), F.explode(ranks).alias("_rank"))
    wide = (F.col("_lo") < F.col("_hi")) & (F.col("_m") > few)
    while not spots.where(wide).isEmpty():
        marks = spots.where(wide).select(*[F.col(k).alias(f"s{k}") for k in keys], F.col("_lo").alias("lo"), F.col("_hi").alias("hi")).distinct()
        inside = v.join(marks, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"s{k}")) for k in keys]) & (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
        # Halves first: the width of a bin is finite for all finite bounds.
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins))
        bin_ = F.when(F.isnan("hi") | (F.col("hi") == float("inf")) | (F.col("lo") == float("-inf")), F.when(F.col("_v") == F.col("lo"), 0).when(F.isnan("_v"), 3).when(F.col("_v") == float("inf"), 2).otherwise(1)).otherwise(bin_)
        counts = inside.groupBy(*keys, "lo", "hi", bin_.cast("long").alias("bin")).agg(F.count("*").alias("c"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        before = F.sum("c").over(Window.partitionBy(*keys, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.withColumn("before", F.coalesce(before, F.lit(0))).select(*[F.col(k).alias(f"s{k}") for k in keys], "lo", "hi", "c", "low", "high", "before")
        old = spots.where(wide)
        held = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"s{k}")) for k in keys]) & (F.col("_lo") == F.col("lo")) & (F.col("_hi") == F.col("hi"))
        at = F.col("_rank") - F.col("_below") - F.col("before")
        new = old.join(counts, held).where((at >= 0) & (at < F.col("c"))).select(*keys, "_n", F.col("low").alias("_lo"), F.col("high").alias("_hi"), (F.col("_below") + F.col("before")).alias("_below"), F.col("c").alias("_m"), "_rank")
        spots = cut_lineage(spots.where(~wide).select(*keys, "_n", "_lo", "_hi", "_below", "_m", "_rank").unionByName(new))
    marks = spots.where("_lo < _hi").select(*[F.col(k).alias(f"s{k}") for k in keys], F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_below").alias("low")).distinct()
    inside = v.join(marks, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"s{k}")) for k in keys]) & (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
    place = F.row_number().over(Window.partitionBy(*[f"s{k}" for k in keys], "lo").orderBy("_v"))
    ranked = inside.select(*[f"s{k}" for k in keys], (F.col("low") + place - 1).alias("rank"), F.col("_v").alias("value"))
    found = spots.join(ranked, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"s{k}")) for k in keys]) & (F.col("_rank") == F.col("rank")) & (F.col("_lo") < F.col("_hi")), "left")
    found = found.select(*keys, "_n", "_rank", F.when(F.col("_lo") < F.col("_hi"), F.col("value")).otherwise(F.col("_lo")).alias("value"))
    of = found.groupBy(*keys).agg(F.max("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_rank", "value"))).alias("_at"))

    def quantile(share: float) -> Column:
        p = F.lit(share) * (F.col("_n") - 1)
        low, high = F.element_at("_at", F.floor(p).cast("long")), F.element_at("_at", F.ceil(p).cast("long"))
        return F.when(low == high, low).otherwise(low + (high - low) * (p - F.floor(p)))

    return of.groupBy(*by).agg(*[F.max(F.when(F.col("_col") == c, quantile(q))).alias(name) for c, names in wanted.items() for name, q in names.items()])
