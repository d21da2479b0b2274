"""Operators along a recording's order: row numbers, previous rows, rolling frames, filling, interpolation.

All windows cover a block of the order, so a recording of any length is spread over tasks; what a block needs from
its neighbours is one small row per block, or copies of the k rows next to the border (a halo).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 1 << 16


def _same(names: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.col(prefix + n))
    return out


def with_previous(df: DataFrame, columns: list[str], by: str = "recording_id", order: str = "seq", block: int = 1 << 16, prefix: str = "prev_") -> DataFrame:
    """df with each column's value in the row before (null in a recording's first row).

    Windows cover a block of the order; one row per block carries the last row over the border, so a
    recording of any length is spread over tasks. order is a whole number, unique within by.
    """
    b = F.floor(F.col(order) / block)
    values = F.struct(*columns)
    last = df.groupBy(by, b.alias("_b")).agg(F.max_by(values, F.col(order)).alias("_last"))
    carried = last.select(F.col(by).alias("_by"), F.col("_b").alias("_cb"), F.lag("_last").over(Window.partitionBy(by).orderBy("_b")).alias("_carried"))
    inside = df.withColumn("_b", b).withColumn("_prev", F.lag(values).over(Window.partitionBy(by, "_b").orderBy(order)))
    joined = inside.join(carried, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_b") == F.col("_cb")))
    prev = F.coalesce("_prev", "_carried")
    return joined.withColumn("_prev", prev).select(*df.columns, *[F.col(f"_prev.{c}").alias(prefix + c) for c in columns])


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "n", block: int = BLOCK) -> DataFrame:
    """df with name: each row's place, from 0, among the rows of by in order. Ties of order are numbered in any order.

    order's first column is a whole number; a block has the rows of `block` of its values. Its row count goes to the blocks
    behind it. A null order comes first.
    """
    b = F.coalesce(F.floor(F.col(order[0]) / block), F.lit(-(1 << 62)))
    d = df.withColumn("_b", b)
    counts = d.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*[F.col(c).alias(f"_s{c}") for c in by], F.col("_b").alias("_s_b"), F.coalesce(before, F.lit(0)).alias("_start"))
    d = d.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order)))
    d = d.join(starts, _same([*by, "_b"], "_s"))
    return d.select(*df.columns, (F.col("_start") + F.col("_i") - 1).cast("long").alias(name))


def over_halo(df: DataFrame, by: list[str], order: list[str], columns: Callable[[WindowSpec], dict[str, Column]], before: int = 0, after: int = 0, size: int = 1 << 14, block: int = BLOCK) -> DataFrame:
    """df with columns(window), whose frames reach at most `before` rows back and `after` rows ahead of a row.

    Rows are numbered and cut into blocks of `size` rows exactly; the last `before` and first `after` rows of a block are
    copied to its neighbours, where they are seen but not kept. The window is by block and in order.
    Columns named _place, _own or _seen are not allowed in df.
    """
    if size <= before + after:
        raise ValueError("a block must hold more rows than its halo")
    d = numbered(df, by, order, "_place", block).withColumn("_own", F.floor(F.col("_place") / size))
    at = F.col("_place") % size
    blocks = [F.col("_own")]
    if before:
        blocks.append(F.when(at >= size - before, F.col("_own") + 1))
    if after:
        blocks.append(F.when(at < after, F.col("_own") - 1))
    d = d.withColumn("_seen", F.explode(F.filter(F.array(*blocks), lambda x: x.isNotNull())))
    d = d.withColumns(columns(Window.partitionBy(*by, "_seen").orderBy("_place")))
    return d.where(F.col("_seen") == F.col("_own")).drop("_place", "_own", "_seen")


def rolling_median(df: DataFrame, value: str, name: str, by: list[str], order: list[str], rows: int = 15, size: int = 1 << 14) -> DataFrame:
    """df with name: the median of the last rows values in order."""
    return over_halo(df, by, order, lambda w: {name: F.percentile(value, F.lit(0.5)).over(w.rowsBetween(1 - rows, 0))}, before=rows - 1, size=size)


def filled_forward(df: DataFrame, value: str, name: str, by: list[str], order: str, block: int = BLOCK) -> DataFrame:
    """df with name: the last known value up to each row in order, a whole number unique within by.

    A block's last known value goes to the blocks behind it.
    """
    d = df.withColumn("_b", F.floor(F.col(order) / block))
    known = F.col(value).isNotNull()
    last = d.groupBy(*by, "_b").agg(F.max_by(F.when(known, F.col(value)), F.when(known, F.col(order))).alias("_last"))
    before = F.last("_last", True).over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    carried = last.select(*[F.col(c).alias(f"_s{c}") for c in by], F.col("_b").alias("_s_b"), before.alias("_carried"))
    own = F.last(value, True).over(Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_own", own).join(carried, _same([*by, "_b"], "_s"))
    return d.select(*df.columns, F.coalesce("_own", "_carried").alias(name))


def interpolate(keys: DataFrame, by: list[str], order: str = "frame_idx", values: tuple[str, ...] = ("joints",)) -> DataFrame:
    """Rows for the frames between consecutive keyframes of a series, arrays mixed in proportion.

    keys has by, order, confidence and array columns; confidence of a made row is the lesser of both ends.
    """
    seg = over_halo(keys, by, [order], lambda w: {"_n": F.lead(F.struct(order, "confidence", *values)).over(w)}, after=1).where(F.col(f"_n.{order}") > F.col(order) + 1)
    seg = seg.withColumn("_f", F.explode(F.sequence(F.col(order) + 1, F.col(f"_n.{order}") - 1)))
    # A column of its own: within the lambda, the name of order would mean the new one.
    seg = seg.withColumn("_alpha", (F.col("_f") - F.col(order)) / (F.col(f"_n.{order}") - F.col(order)))
    mixed = [F.zip_with(F.col(v), F.col(f"_n.{v}"), lambda a, b: a + (b - a) * F.col("_alpha")).alias(v) for v in values]
    return seg.select(*by, F.col("_f").alias(order), F.least("confidence", "_n.confidence").alias("confidence"), *mixed)
