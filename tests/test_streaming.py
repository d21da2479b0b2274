"""Streams read from files, against the same rows as a batch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandline.plans.base import Tables
from strandline.streaming.streams import candidates_within, coverage, follow, latest, nearest_of, smoothed, trail, warmed_up

SF = "/root/testdata/sf0.001"


def run(spark, df, name: str, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_coverage_and_alignment(spark, tmp_path):
    rows = Tables(spark, SF).streams.select("seq", "recording_id", "topic", F.timestamp_micros("t_us").alias("ts")).where("seq < 300")
    # A last row far ahead moves the watermark past all others.
    ahead = rows.agg(F.max("seq").alias("seq"), F.lit(9).cast("long").alias("recording_id"), F.lit("view").alias("topic"), (F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    for i, part in enumerate((rows, ahead)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(spark, coverage(stream), "covered", tmp_path).where("recording_id < 9")
    want = rows.groupBy("recording_id", "topic", F.date_trunc("hour", "ts").alias("start")).agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    views, clicks = stream.where("topic = 'view'"), stream.where("topic = 'click'")
    pairs = run(spark, candidates_within(views, clicks, 3600), "pairs", tmp_path)
    near = {r["seq"]: r["r_seq"] for r in nearest_of(pairs).collect()}
    batch = candidates_within(rows.where("topic = 'view'"), rows.where("topic = 'click'"), 3600)
    assert near and near == {r["seq"]: r["r_seq"] for r in nearest_of(batch).collect()}


def test_state_per_key(spark, tmp_path):
    rows = Tables(spark, SF).streams.where("seq < 240").select("seq", "recording_id", F.col("topic").alias("side"), F.when(F.col("seq") % 7 != 0, F.col("value")).alias("value"))
    for lo in range(0, 240, 80):
        rows.where(F.col("seq").between(lo, lo + 79)).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    stream = follow(spark, str(tmp_path / "rows"), rows.schema, 1)
    table = rows.toPandas().sort_values("seq")
    keys = table.groupby(["recording_id", "side"])
    got = {r["seq"]: r["median"] for r in run(spark, smoothed(stream), "smoothed", tmp_path).collect()}
    assert len(got) == len(table)
    for _, part in keys:
        seen: list = []
        for s, v in zip(part["seq"], part["value"], strict=True):
            seen = [*seen, v][-15:] if v == v else seen
            assert got[s] == (float(np.median(seen)) if seen else None) or (not seen and got[s] != got[s])
    placed = stream.select("seq", "recording_id", F.col("seq").cast("double").alias("tx"), F.lit(0.0).alias("ty"), F.lit(1.0).alias("tz"))
    trails = {r["seq"]: r["trail"] for r in run(spark, trail(placed), "trails", tmp_path).collect()}
    for _, part in table.groupby("recording_id"):
        order = list(part["seq"])
        for i, s in enumerate(order):
            assert trails[s][::3] == [float(x) for x in order[max(0, i - 29) : i + 1]]
    ups = stream.select("seq", "recording_id", F.when(F.col("seq") < 100, -1.0).otherwise(9.0).alias("up"))
    warm = run(spark, warmed_up(ups), "warm", tmp_path)
    assert {r["up_y"] for r in warm.collect()} == {-1} and warm.count() == len(table) - 9 * table["recording_id"].nunique()


def test_upserts(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 7).alias("frame_idx"), F.col("id").alias("det_seq"), (F.col("id") * 2).alias("value"))
    for lo in (0, 30):
        rows.where(F.col("det_seq").between(lo, lo + 29)).coalesce(1).write.mode("append").parquet(str(tmp_path / "u"))
    q = latest(follow(spark, str(tmp_path / "u"), rows.schema, 1), ["frame_idx"], "det_seq").writeStream.format("memory").queryName("upserts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["frame_idx"]: (r["det_seq"], r["last"]["value"]) for r in spark.table("upserts").collect()}
    assert got == {k: (m, 2 * m) for k in range(7) for m in [max(i for i in range(60) if i % 7 == k)]}
