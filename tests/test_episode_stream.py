"""A growing folder of recordings as a stream, and episodes that are replaced whole or not at all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandline.sources.episode import read_episode, save_episode
from strandline.sources.recording import register
from test_sources import STATE, recording, state

CHANNELS = {1: ("/state", STATE), 2: ("/other", STATE)}


def chunks(start, n, topics=(1, 2)):
    """n chunks of two messages each."""
    return [[(c, start + k, 1000 * (start + k), state(k % 3)) for c in topics] for k in range(n)]


def drained(spark, folder, place, **options):
    """Runs the stream over what is there now and returns all that its sink holds."""
    stream = spark.readStream.format("recording").options(path=f"{folder}/*.mcap", **options).load()
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{place}/log").option("path", f"{place}/out").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted((r["topic"], r["sequence"], r["path"].rpartition("/")[2]) for r in spark.read.parquet(f"{place}/out").collect())


def test_stream_follows_a_growing_folder_once(spark, tmp_path):
    register(spark)
    folder, place = tmp_path / "in", tmp_path / "sink"
    folder.mkdir()
    recording(folder / "a.mcap", chunks(0, 3), CHANNELS)
    (folder / "open.mcap").write_bytes((folder / "a.mcap").read_bytes()[:-40])  # still being written
    first = drained(spark, folder, place)
    assert len(first) == 6 and {x[2] for x in first} == {"a.mcap"}
    recording(folder / "b.mcap", chunks(10, 2), CHANNELS)
    recording(folder / "a.mcap", chunks(0, 5), CHANNELS)  # the same file with more chunks
    recording(folder / "open.mcap", chunks(50, 1), CHANNELS)
    second = drained(spark, folder, place)
    assert len(second) == len(set(second)) == 6 + 4 + 4 + 2 and set(first) < set(second)
    assert drained(spark, folder, place) == second
    whole = spark.read.format("recording").option("path", f"{folder}/*.mcap").load()
    assert sorted((r["topic"], r["sequence"], r["path"].rpartition("/")[2]) for r in whole.collect()) == second


def test_stream_of_one_topic_and_of_no_file(spark, tmp_path):
    register(spark)
    (tmp_path / "in").mkdir()
    recording(tmp_path / "in" / "a.mcap", chunks(0, 2), CHANNELS)
    got = drained(spark, tmp_path / "in", tmp_path / "sink", topics="/state")
    assert {x[0] for x in got} == {"/state"} and len(got) == 2


def parts(spark, n):
    frames = spark.range(n).select((F.col("id") % 2).cast("string").alias("recording_id"), F.col("id").alias("frame_idx"), (F.col("id") / 10).alias("ts"), F.lit(b"x").alias("image"))
    return {"frames": frames, "depth": frames.select("recording_id", "ts"), "imu": None}


def test_episode_round_trip_and_replacement(spark, tmp_path):
    place = "file://" + str(tmp_path / "e")
    one = save_episode(spark, parts(spark, 7), place, {"frames": {"fps": 30, "codec": "raw"}})
    got = read_episode(spark, place)
    assert got.version == one.version and got.attributes == {"frames": {"fps": 30, "codec": "raw"}}
    assert got.states["frames"] == ("saved", 7, None) and got.states["depth"][0] == "skipped" and "valid" in got.states["depth"][2]
    assert set(got.parts) == {"frames", "counts"}
    back = got.parts["frames"]
    assert dict(back.dtypes) == dict(parts(spark, 7)["frames"].dtypes)
    assert sorted(map(tuple, back.select("recording_id", "frame_idx", "ts").collect())) == sorted(map(tuple, parts(spark, 7)["frames"].select("recording_id", "frame_idx", "ts").collect()))
    assert {(r["part"], r["recording_id"], r["rows"]) for r in got.parts["counts"].collect()} == {("frames", "0", 4), ("frames", "1", 3)}
    two = save_episode(spark, parts(spark, 3), place)
    assert read_episode(spark, place).parts["frames"].count() == 3
    assert sorted(p.name for p in (tmp_path / "e").iterdir() if not p.name.startswith(".")) == sorted([two.version, "manifest.json"])


def test_failed_episode_leaves_the_former_one_whole(spark, tmp_path):
    place = "file://" + str(tmp_path / "e")
    one = save_episode(spark, parts(spark, 5), place)
    bad = parts(spark, 9)
    bad["thumbnail"] = bad["frames"].select("recording_id", F.when(F.col("frame_idx") == 4, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("image")).alias("image"))
    with pytest.raises(Exception, match="broken"):
        save_episode(spark, bad, place)
    after = read_episode(spark, place)
    assert after.version == one.version and after.parts["frames"].count() == 5
    assert sorted(p.name for p in (tmp_path / "e").iterdir() if not p.name.startswith(".")) == sorted([one.version, "manifest.json"])
    with pytest.raises(ValueError, match="unknown"):
        save_episode(spark, {"other": parts(spark, 1)["frames"]}, place)
