"""Streams give what the batch operators give, whatever the order and the batches."""

import os
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from postura import tables as T
from postura.operators.frames import classify
from postura.sources import adapters
from postura.streaming import posture_stream as ST
from postura.streaming import replay as RP

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
COLUMNS = ["video_id", "raw_id", "frame_idx", "ts", "trunk", "hip", "knee", "disp", "conf"]


def outcome(df):
    return sorted(map(tuple, df.select("video_id", "raw_id", "frame_idx", "raw_label", "label").collect()))


@pytest.mark.parametrize("given", [True, False])
def test_labels_over_shuffled_batches(spark, tmp_path, given):
    """Twelve batches and more, frames up to 20 seconds late; with a given displacement, and with one from the ankle point."""
    frames = adapters.frames(spark, SF).select(*COLUMNS)
    if not given:
        ankle = F.when(F.col("disp").isNotNull(), F.struct((F.col("disp") * 7 % 40).alias("x"), F.col("trunk").alias("y")))
        frames = frames.withColumn("ankle", F.when(F.col("trunk").isNotNull(), ankle)).drop("disp")
    at = F.col("ts") + F.pmod(F.xxhash64("frame_idx", "raw_id"), F.lit(2000)) / 100.0
    source, width = str(tmp_path / "in"), RP.slice_width(frames, at)
    RP.deliver(frames, at, source, files=1)
    got, batches = RP.play(spark, source, frames.schema, str(tmp_path / "work"),
                           lambda df: ST.stream_posture(df, lateness=f"{int(width) + 22} seconds", slice_s=7.0), "ts", 1)
    assert batches >= 10 and outcome(got) == outcome(classify(frames))


def test_late_frames_are_dropped_and_held_ones_wait(spark, tmp_path):
    rows = [[(1, 1, i, float(i), 5.0, 170.0, 170.0, 0.0, 0.9) for i in range(k, k + 10)] for k in (0, 10, 100, 110)]
    # a batch goes by the watermark of the one before: 89 seconds for the last
    rows.append([(1, 1, 50, 50.0, 5.0, 170.0, 170.0, 0.0, 0.9), (1, 1, 95, 95.0, 5.0, 170.0, 170.0, 0.0, 0.9)])
    schema = "video_id long, raw_id long, frame_idx long, ts double, trunk double, hip double, knee double, disp double, conf double"
    source = str(tmp_path / "in")
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    kind = spark.createDataFrame([], schema).schema
    work = str(tmp_path / "work")
    got, _ = RP.play(spark, source, kind, work, lambda df: ST.stream_posture(df, lateness="20 seconds", slice_s=5.0), "ts", 1)
    assert [r.frame_idx for r in got.orderBy("frame_idx").collect()] == [*range(20), 95, *range(100, 120)]


def test_idle_tracks_start_anew(spark, tmp_path):
    """A run of movement and the votes do not go on over a longer rest."""
    rows = [(1, 1, i, i + (0.0 if i < 5 else 200.0), 5.0, 170.0, 170.0, 40.0, 0.9) for i in range(9)]
    schema = "video_id long, raw_id long, frame_idx long, ts double, trunk double, hip double, knee double, disp double, conf double"
    kind = spark.createDataFrame([], schema).schema
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    for idle, first in ((60.0, "standing"), (500.0, "walking")):
        work = str(tmp_path / f"work{idle}")
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"in{idle}"))
        got, _ = RP.play(spark, str(tmp_path / f"in{idle}"), kind, work, lambda df, idle=idle: ST.stream_posture(df, idle_s=idle), "ts")
        assert {r.frame_idx: r.raw_label for r in got.collect()}[5] == first


def test_slices_hold_a_part_of_a_track():
    """What the arrays give for one slice after another equals one pass over all."""
    rng = np.random.default_rng(4)
    label, weight = rng.integers(0, 3, 300), rng.choice([0.1, 0.5, 0.9], 300)
    whole = ST.votes(label, weight, 0, 5)
    for at in (1, 3, 4, 77):
        low = max(0, at - 4)
        assert (ST.votes(label[low:], weight[low:], at - low, 5) == whole[at:]).all()
    moving = rng.random(300) < 0.7
    runs, run = [], 0
    for m in moving:
        run = run + 1 if m else 0
        runs.append(run)
    assert ST.run_lengths(moving, 0).tolist() == runs
    assert ST.run_lengths(moving[40:], runs[39]).tolist() == runs[40:]
    assert ST.WALKING == T.LABELS.index("walking")


BASE = datetime(2024, 5, 1, tzinfo=timezone.utc)
TIMED = "video_id long, worker_id long, frame_idx long, label string, event_time timestamp"


def timed(frame, label="sitting", worker=1):
    return (1, worker, frame, label, BASE + timedelta(seconds=frame))


def test_exposure_of_repeated_and_late_frames(spark, tmp_path):
    source = str(tmp_path / "in")
    parts = [[timed(i) for i in range(0, 400, 10)], [timed(i, "bending") for i in range(400, 900, 10)] + [timed(i) for i in range(300, 400, 10)],
             [timed(905), timed(2000)], [timed(10, "walking"), timed(1500, "standing"), timed(2000)], [timed(20), timed(2010, "walking", 2)]]
    for part in parts:
        spark.createDataFrame(part, TIMED).coalesce(1).write.mode("append").parquet(source)
    kind = spark.createDataFrame([], TIMED).schema
    got, batches = RP.play(spark, source, kind, str(tmp_path / "work"), lambda df: ST.exposure_5min(df, frame="frame_idx"), "event_time", 1)
    assert batches == 5
    # frames 10 and 20 of the last two files are behind the watermark (2000 - 600 seconds); 300 to 390 and 2000 came twice
    want = [r for part in (*parts[:3], parts[3][1:], parts[4][1:]) for r in part]
    batch = ST.exposure_5min(spark.createDataFrame(want, TIMED), frame="frame_idx")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert {(r.worker_id, r.n_frames) for r in got.collect()} == {(1, 30), (1, 1), (2, 1)}


def test_exposure_windows(spark, tmp_path):
    rng = random.Random(2)
    rows = [timed(i, rng.choice(["sitting", "bending"]), i % 5) for i in range(0, 9000, 7)]
    df = spark.createDataFrame(rows, TIMED)
    batch = {tuple(r) for r in ST.exposure_5min(df).collect()}
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    got, _ = RP.play(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "work"), ST.exposure_5min, "event_time")
    assert {tuple(r) for r in got.collect()} == batch
    for r in batch:
        assert abs(sum(r[4:]) - 100) <= 0.5
