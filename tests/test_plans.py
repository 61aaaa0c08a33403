"""What the plans must and must not contain, and the whole report from keypoints."""

import os

import pytest

from postura import catalog
from postura.operators import aggregates as A
from postura.operators import scoring as SC
from postura.operators import tracklets as K
from postura.operators.frames import classify, pose_frames
from postura.plans.worker_report import analyse, assemble
from postura.sources import adapters, observation, sampling

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["join_object_person", "join_near_person", "join_stitch_candidates", "sample_frames",
                                  "segment", "win_smooth_vote", "agg_p90_reba", "rank_leaderboard", "adi_recommend",
                                  "agg_run_summary", "join_load_at_frame", "sink_csv"])
def test_no_cross_joins(spark, name):
    text = plan(catalog.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "det")
    adapters.detections(spark, SF).write.parquet(path)
    text = plan(observation.work_objects(spark.read.parquet(path)).select("det_id", "class_name"))
    assert "PushedFilters" in text and "GreaterThanOrEqu" in text and "class_id" in text.split("PushedFilters")[1]
    assert "bbox" not in text.split("ReadSchema")[1]
    frames = str(tmp_path / "frames")
    adapters.frames(spark, SF).write.parquet(frames)
    text = plan(A.arm_share(spark.read.parquet(frames)))
    schema = text.split("ReadSchema")[1]
    assert "shoulder" in schema and "trunk" not in schema and text.count("Exchange hashpartitioning") == 1


def test_frame_pass_shuffles_frames_once(spark, tmp_path):
    path = str(tmp_path / "frames")
    adapters.frames(spark, SF).write.parquet(path)
    text = plan(classify(spark.read.parquet(path)))
    # rows by slice; boundary rows by slice, cut to six per slice before their shuffle, then by track
    assert text.count("Exchange hashpartitioning") == 3 and "WindowGroupLimit" in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_frame_aggregates_hash_without_sorting(spark, tmp_path):
    path = str(tmp_path / "frames")
    adapters.frames(spark, SF).write.parquet(path)
    frames = spark.read.parquet(path)
    for df in (K.tracklet_meta(frames), SC.reba_worker(frames), A.frame_facts(frames)):
        assert "SortAggregate" not in plan(df)


def test_stride_counts_frames_not_persons(spark):
    rows = [(1, i, p) for i in range(0, 63, 3) for p in range(2)]
    df = spark.createDataFrame(rows, "video_id long, frame_idx long, raw_id long")
    assert sorted(r.frame_idx for r in sampling.object_frames(df).collect()) == [0, 30, 60]


def test_report_from_keypoints(spark):
    """Two people, one upright and one stooping, the first lost and found again under another id."""

    def person(x, lean):
        top = 40 if lean else 0
        kp = [{"x": 0.0, "y": 0.0} for _ in range(17)]
        for i, (dx, y) in {0: (top, 60), 5: (-10 + 2 * top, 100), 6: (10 + 2 * top, 100), 7: (-10 + top, 150), 8: (10 + top, 150),
                           9: (-10 + top, 200), 10: (10 + top, 200), 11: (-5, 200), 12: (5, 200), 13: (-5, 300), 14: (5, 300),
                           15: (-5, 400), 16: (5, 400)}.items():
            kp[i] = {"x": float(x + dx), "y": float(y)}
        return kp, [0.9] * 17, (float(x - 40), 80.0, float(x + 40), 420.0)

    rows = []
    for i in range(40):
        if not 18 <= i < 22:
            rows.append((1, 10 if i < 18 else 11, i * 10, i * 1.0, *person(300, False)))
        rows.append((1, 20, i * 10, i * 1.0, *person(2000, True)))
    rows.append((1, None, 0, 0.0, *person(900, False)))
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    obs = spark.createDataFrame(rows, "video_id long, raw_id long, frame_idx long, ts double, "
                                f"keypoints array<struct<x:double,y:double>>, conf array<double>, bbox {box}")
    found = spark.createDataFrame([(1, 1, 0, 0.0, 24, 0.9, (280.0, 200.0, 320.0, 260.0)),
                                   (2, 1, 100, 10.0, 43, 0.9, (1990.0, 200.0, 2010.0, 260.0)),
                                   (3, 1, 100, 10.0, 43, 0.2, (1990.0, 200.0, 2010.0, 260.0))],
                                  f"det_id long, video_id long, frame_idx long, ts double, class_id int, confidence double, bbox {box}")
    frames = pose_frames(obs)
    run = analyse(frames, found)
    out = {r.dominant_posture: r for r in assemble(run).collect()}
    assert set(out) == {"standing", "bending"}
    up, stoop = out["standing"], out["bending"]
    assert (up.n_frames, stoop.n_frames) == (36, 40) and {up.worker_id, stoop.worker_id} == {1, 2}
    assert up.tracked_s == stoop.tracked_s == 39.0 and up.rest_s == 39.0 and stoop.rest_s == 0.0
    assert up.load_events == 1 and up.tools == ["backpack"] and stoop.tools == ["knife"]
    assert stoop.avg_trunk > 30 and stoop.reba_score > up.reba_score and stoop.iso_violated and not up.iso_violated
    assert stoop.task.startswith("Manual Weeding") and up.trip_count == 0
    assert frames.where("raw_id is null").count() == 0
