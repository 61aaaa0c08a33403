"""Results that must not depend on sizes, splits or the number of slices, and values taken from the definitions."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postura.config import Thresholds
from postura.operators import ordered, scoring, trips
from postura.operators.frames import classify
from postura.operators.ordered import stage, staging_path
from postura.sources import observation
from postura.streaming import posture_stream as ST
from postura.streaming import replay as RP


def walk(n_slices, per, turns):
    """A path along x that turns back in the given slices; one point per second."""
    out, x, way = [], 0.0, 1.0
    for k in range(n_slices):
        for i in range(per):
            if k in turns and i == per // 2:
                way = -way
            x += 30.0 * way
            out.append((1, 1, k * per + i, float(k * per + i), x, 0.2 * way))
    return out


def legs(n, per, turn, seed=None):
    """Legs of equal length; the direction turns by so many degrees after each, or by a random angle."""
    rng, out, x, y, way = random.Random(seed), [], 0.0, 0.0, 0.0
    for k in range(n):
        for i in range(per):
            x, y = x + 30 * math.cos(math.radians(way)), y + 30 * math.sin(math.radians(way))
            out.append((1, 1, k * per + i, float(k * per + i), x, y))
        way += turn(k) if seed is None else rng.uniform(-170, 170)
    return out


PATHS = {
    "one way": walk(100, 12, ()),
    "there and back": walk(100, 12, tuple(range(1, 100, 3))),
    # trips of two legs each: where they begin never agrees between two phases
    "two phases": legs(130, 9, lambda k: 60),
    "three phases": legs(130, 9, lambda k: 31),
    # slices see turns of their own, but the first trip never ends
    "outlasts all": legs(131, 9, lambda k: 80 if k == 0 else (-160 if k % 2 else 160)),
    "any": legs(130, 9, None, seed=3),
}


@pytest.mark.parametrize(("path", "per"), [(path, 12) for path in PATHS] + [("any", 7)])
def test_trips_settle_in_few_rounds(spark, path, per, monkeypatch):
    limits = Thresholds(chunk_s=per)
    df = spark.createDataFrame(PATHS[path], "video_id long, worker_id long, frame_idx long, ts double, x double, y double")
    smoothed = stage(trips.moving_avg(df, limits=limits))
    folded = []
    keep = trips.stage

    def watched(t):
        out = keep(t)
        if {"out", "given"} <= set(t.columns):
            folded.append([r.pos for r in out.select("pos").collect()])
        return out

    monkeypatch.setattr(trips, "stage", watched)
    got = sorted(tuple(r) for r in trips.trips(smoothed, limits=limits).collect())
    monkeypatch.undo()
    states = max(Counter(x for f in folded for x in f).values())  # that a slice was folded from
    whole = Thresholds(chunk_s=10 ** 6)
    want = sorted(tuple(r) for r in trips.trips(stage(trips.moving_avg(df, limits=whole)), limits=whole).collect())
    assert got == want and bool(want) == (path not in ("one way", "outlasts all"))
    slices = len(PATHS[path]) // per
    # as many rounds as states that differ, or the logarithm of the slices; never one per slice
    assert len(folded) <= states + math.log2(slices) and len(folded) < slices / 6, (len(folded), states, slices)


def test_p90_truncates_the_float(spark):
    rows = [(1, 1, i, s) for i, s in enumerate([1] * 7 + [11])]
    df = spark.createDataFrame(rows, "video_id long, worker_id long, frame_idx long, final_score int").withColumn("ts", F.col("frame_idx"))
    assert scoring.p90_of_scores(df, [], 15).first().p90_score == 3  # 3.9999999999999982 in floating point


@pytest.mark.parametrize("n", [1, 4, 5, 9])
@pytest.mark.parametrize("chunk", [1, 3, 1800])
def test_short_trajectories_stay(spark, n, chunk):
    xs = [float(3 * i * i) for i in range(n)]
    df = spark.createDataFrame([(1, 1, i, float(i), x, 1.0) for i, x in enumerate(xs)],
                               "video_id long, worker_id long, frame_idx long, ts double, x double, y double")
    got = [r.sx for r in trips.moving_avg(df, limits=Thresholds(chunk_s=chunk)).orderBy("ts").collect()]
    want = xs if n < 5 else [sum(xs[max(0, i - 2):i + 3]) / 5 for i in range(n)]
    assert all(math.isclose(a, b) for a, b in zip(got, want)) and len(got) == n


def test_all_joints(spark):
    df = spark.createDataFrame([(1, [{"x": float(i), "y": 0.0} for i in range(17)], [0.5] * 17)],
                               "obs_id long, keypoints array<struct<x:double,y:double>>, conf array<double>")
    got = [(r.joint_no, r.joint) for r in observation.joints_long(df, ["obs_id"]).orderBy("joint_no").collect()]
    assert [n for n, _ in got] == list(range(17))
    assert [j for _, j in got[:6]] == ["nose", "l_eye", "r_eye", "l_ear", "r_ear", "l_sh"]


class _Nowhere:
    """A session that names no shared folder."""

    class conf:  # noqa: N801
        @staticmethod
        def get(name, default=None):
            return default

    class sparkContext:  # noqa: N801
        @staticmethod
        def getCheckpointDir():
            return None


def test_no_shared_folder_is_an_error(spark):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging_path(_Nowhere())
    held = [*ordered._staged]
    ordered._staged.clear()
    stage(spark.range(3))
    assert ordered.drop_staged(spark) == 1 and ordered.drop_staged(spark) == 0
    ordered._staged.extend(held)


@pytest.mark.parametrize("batch", [100, 10_000])
def test_stream_of_one_long_track(spark, tmp_path, batch):
    rng = random.Random(1)
    n = 24_000
    rows = [(1, 1, i, i * 0.5, rng.choice([5.0, 45.0, None]), rng.choice([90.0, 170.0]), rng.choice([100.0, 170.0]),
             rng.choice([None, 2.0, 20.0, 20.0]), 0.5 + rng.random() / 2) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "video_id long, raw_id long, frame_idx long, ts double, trunk double, hip double, knee double, disp double, conf double")
    source = str(tmp_path / "in")
    df.repartition(5).write.parquet(source)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(batch))
    try:
        played, _ = RP.play(spark, source, df.schema, str(tmp_path / "work"), ST.stream_posture, "ts")
        out = played.select("frame_idx", "raw_label", "label").collect()
    finally:
        spark.conf.set(name, before)
    want = classify(df, "raw_id").select("frame_idx", "raw_label", "label").collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, want))
