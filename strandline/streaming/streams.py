"""Structured Streaming forms: coverage per window, alignment of two streams in time, upserts, and state per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType


def coverage(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Rows per recording, topic and tumbling window of ts; windows close when the watermark passes them."""
    w = F.window("ts", width)
    counts = stream.withWatermark("ts", late).groupBy("recording_id", "topic", w.alias("w")).agg(F.count("*").alias("n"))
    return counts.select("recording_id", "topic", F.col("w.start").alias("start"), "n")


def candidates_within(left: DataFrame, right: DataFrame, tolerance_s: float, late: str = "10 minutes") -> DataFrame:
    """Pairs of rows at most tolerance_s apart, as an interval join of two streams with bounded state.

    left and right have recording_id, seq and ts. The nearest one of a left row's pairs is taken by nearest_of.
    """
    l = left.select("recording_id", "seq", "ts").withWatermark("ts", late)
    r = right.select(F.col("recording_id").alias("r_recording"), F.col("seq").alias("r_seq"), F.col("ts").alias("r_ts")).withWatermark("r_ts", late)
    span = F.expr(f"INTERVAL {tolerance_s} SECONDS")
    return l.join(r, (F.col("recording_id") == F.col("r_recording")) & (F.col("r_ts") >= F.col("ts") - span) & (F.col("r_ts") <= F.col("ts") + span)).drop("r_recording")


def nearest_of(pairs: DataFrame) -> DataFrame:
    """The nearest right row of each left row, ties to the earlier one; for a finished batch of pairs."""
    apart = F.abs(F.unix_micros("ts") - F.unix_micros("r_ts"))
    return pairs.groupBy("recording_id", "seq").agg(F.min_by("r_seq", F.struct(apart, "r_ts", "r_seq")).alias("r_seq"))


def follow(spark: SparkSession, folder: str, schema: str | StructType, files_per_trigger: int = 64) -> DataFrame:
    """A folder of Parquet files as a stream; each micro-batch takes a bounded number of new files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def latest(stream: DataFrame, keys: list[str], order: str, late: str | None = None) -> DataFrame:
    """The last write of each key as an upsert table: one row (keys, order, last) per key, for output mode update or complete.

    Ties go to the larger row. With a watermark on a key named ts, old keys leave the state.
    """
    if late:
        stream = stream.withWatermark("ts", late)
    rest = [c for c in stream.columns if c not in (*keys, order)]
    return stream.groupBy(*keys).agg(F.max(order).alias(order), F.max(F.struct(order, *rest)).alias("last"))


def _per_key(stream: DataFrame, keys: list[str], added: str, state: str, step: Callable) -> DataFrame:
    """stream with columns that step(rows in order of seq, state or None) -> (rows, state) adds, key by key, across micro-batches.

    Rows of one micro-batch are put in order of seq; a row that is older than an earlier micro-batch counts as new.
    """
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema] + [added])

    def run(_, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable").reset_index(drop=True)
        rows, new = step(rows, kept.get if kept.exists else None)
        kept.update(new)
        yield rows

    return stream.groupBy(*keys).applyInPandasWithState(run, out, state, "append", "NoTimeout")


def smoothed(stream: DataFrame, rows: int = 15, keys: tuple[str, ...] = ("recording_id", "side")) -> DataFrame:
    """stream (keys, seq, value) with the median of each key's last rows values; null values are passed over."""

    def step(d: pd.DataFrame, state):
        held, medians = list(state[0]) if state else [], []
        for v in d["value"]:
            if v == v and v is not None:
                held = [*held, float(v)][-rows:]
            medians.append(float(np.median(held)) if held else None)
        return d.assign(median=pd.array(medians, "Float64").astype("float64")), (held,)

    return _per_key(stream, list(keys), "median double", "held array<double>", step)


def trail(stream: DataFrame, rows: int = 30, keys: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """stream (keys, seq, tx, ty, tz) with the last rows positions, oldest first, flattened."""

    def step(d: pd.DataFrame, state):
        held, out = list(state[0]) if state else [], []
        for p in zip(d["tx"], d["ty"], d["tz"], strict=True):
            held = [*held, *map(float, p)][-3 * rows :]
            out.append(held)
        return d.assign(trail=out), (held,)

    return _per_key(stream, list(keys), "trail array<double>", "held array<double>", step)


def warmed_up(stream: DataFrame, rows: int = 10, keys: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """stream (keys, seq, up) from each key's row number rows on, with up_y, the sign of the mean of the first ones (0 is up)."""

    def step(d: pd.DataFrame, state):
        n, total = state or (0, 0.0)
        first = d["up"].to_numpy()[: max(0, rows - n)]
        skip = max(0, rows - 1 - n)
        n, total = n + len(first), total + float(first.sum())
        return d.iloc[skip:].assign(up_y=-1 if total < 0 else 1), (n, total)

    return _per_key(stream, list(keys), "up_y int", "n int, total double", step)
