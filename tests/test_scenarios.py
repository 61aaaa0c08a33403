"""Small scenarios per operator, and one test per semantic trap."""

import math

import pytest
from pyspark.sql import functions as F

from postura import tables as T
from postura.config import Thresholds
from postura.functions import geometry as G
from postura.functions import numeric as N
from postura.functions import posture as P
from postura.functions import scoring as S
from postura.operators import aggregates as A
from postura.operators import association as J
from postura.operators import bouts as B
from postura.operators import frames as Fr
from postura.operators import scoring as SC
from postura.operators import signals as SG
from postura.operators import tracklets as K
from postura.sources import observation, sampling

FRAMES = "video_id long, worker_id long, frame_idx long, ts double, label string, disp double"
D = "double"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def pt(x, y):
    return G.Point(F.lit(float(x)), F.lit(float(y)))


@pytest.mark.parametrize("a,b,c,want", [((0, 1), (0, 0), (1, 0), 90), ((0, 1), (0, 0), (0, -1), 180)])
def test_angle_between_points(spark, a, b, c, want):
    assert math.isclose(one(spark, G.angle_3pt(pt(*a), pt(*b), pt(*c)))[0], want, abs_tol=0.1)


@pytest.mark.parametrize("top,want", [((100, 50), 0), ((150, 100), 45)])
def test_angle_from_vertical(spark, top, want):
    assert math.isclose(one(spark, G.angle_vertical(pt(*top), pt(100, 150)))[0], want, abs_tol=0.1)


POSE = "obs_id long, keypoints array<struct<x:double,y:double>>, conf array<double>"


def pose(spark, points, conf=0.9):
    kp = [{"x": 0.0, "y": 0.0} for _ in range(17)]
    for i, (x, y) in points.items():
        kp[i] = {"x": float(x), "y": float(y)}
    df = spark.createDataFrame([(1, kp, [conf] * 17)], POSE)
    return G.unroll(df, ["obs_id"])


UPRIGHT = {5: (90, 100), 6: (110, 100), 11: (95, 200), 12: (105, 200), 13: (95, 300), 14: (105, 300), 15: (95, 400),
           16: (105, 400)}


def test_upright_person(spark):
    r = G.joint_angles(pose(spark, UPRIGHT), ["obs_id"]).first()
    assert abs(r.trunk) < 5 and r.avg_hip > 170 and r.neck is None and r.left_elbow is None
    assert not r.arm_above_45


def test_arm_study(spark):
    arms = {**UPRIGHT, 7: (90, 150), 9: (90, 200), 8: (160, 100), 10: (160, 50)}
    r = G.joint_angles(pose(spark, arms), ["obs_id"]).first()
    assert abs(r.left_shoulder) < 10 and abs(r.right_shoulder - 90) < 10
    assert math.isclose(r.left_elbow, 180, abs_tol=0.1) and math.isclose(r.right_elbow, 90, abs_tol=0.1)
    assert r.arm_above_45


def test_placeholder_and_weak_points_are_invalid(spark):  # T2, T3
    ok = lambda x, y, c: one(spark, G.kp_valid(F.lit(x), F.lit(y), F.lit(c)))[0]
    assert ok(5.0, 0.0, 0.3) and not ok(0.0, 1e-9, 0.9) and not ok(5.0, 5.0, 0.29)
    weak = pose(spark, UPRIGHT, 0.3)
    assert weak.select(G.centroid(G.Pose())["x"]).first()[0] == 100.0
    assert weak.select(G.hips_low(G.Pose())).first()[0] is False


def test_zero_angle_counts_as_missing(spark):  # T1
    pick = lambda a, b: one(spark, G.side_pick(F.lit(a).cast(D), F.lit(b).cast(D)))[0]
    assert pick(0.0, 7.0) == 7.0 and pick(None, 7.0) == 7.0 and pick(3.0, 7.0) == 3.0 and pick(0.0, None) is None


def raw(spark, trunk, hip, knee=None, walking=False, low=False):
    lit = lambda v: F.lit(v).cast(D)
    return one(spark, P.posture_raw(lit(trunk), lit(hip), lit(knee), F.lit(walking), F.lit(low)))[0]


@pytest.mark.parametrize("args,label", [
    ((45, 160), "bending"), ((10, 90), "sitting"), ((15, 90, 70), "squatting"), ((5, 175), "standing"),
    ((None, None), "unknown"), ((20, None), "standing"), ((30, None, 100), "bending"), ((5, 100, 90, True), "walking"),
    ((5, 170, 90, False, True), "squatting"), ((45, 110, 120), "sitting")])
def test_posture_rules(spark, args, label):
    assert raw(spark, *args).label == label


def labelled(spark, rows, window=5, limits=None):
    df = spark.createDataFrame(
        [(1, 1, i, i * 0.2, t, h, k, d, c) for i, (t, h, k, d, c) in enumerate(rows)],
        "video_id long, raw_id long, frame_idx long, ts double, trunk double, hip double, knee double, disp double, conf double")
    out = Fr.classify(df, limits=limits or Thresholds(vote_frames=window)).orderBy("frame_idx").collect()
    return [(r.raw_label, r.label) for r in out]


def test_one_flicker_frame_is_outvoted(spark):
    stand, bend = (5.0, 175.0, None, None, 0.5), (45.0, 160.0, None, None, 0.5)
    assert labelled(spark, [stand, stand, bend], 3)[2] == ("bending", "standing")


def test_vote_tie_goes_to_first_seen(spark):  # T6
    none = (None, None, None, None, 0.5)
    a, b = (5.0, 170.0, None, None, 0.0), (45.0, 160.0, None, None, 0.0)
    assert [x[1] for x in labelled(spark, [a, b, none])] == ["standing", "standing", "standing"]


def test_walking_needs_three_moving_frames_in_a_row(spark):  # T5
    m, s, n = (5.0, 170.0, None, 20.0, 1.0), (5.0, 170.0, None, 15.0, 1.0), (5.0, 170.0, None, None, 1.0)
    raws = [x[0] for x in labelled(spark, [m, m, m, m, n, m, m, s, m, m, m])]
    assert [i for i, v in enumerate(raws) if v == "walking"] == [2, 3, 10]


def seg(spark, labels, dt=0.2, disp=None):
    rows = [(1, 1, i, round(i * dt, 3), v, None if disp is None else disp[i]) for i, v in enumerate(labels)]
    return B.segment(spark.createDataFrame(rows, FRAMES)).orderBy("start_time").collect()


def test_two_bouts(spark):
    out = seg(spark, ["standing"] * 10 + ["bending"] * 15)
    assert [b.label for b in out] == ["standing", "bending"]
    assert out[0].end_time == out[1].start_time == 2.0  # T7


def test_last_single_frame_is_no_bout(spark):  # T8
    out = seg(spark, ["standing"] * 10 + ["bending"])
    assert [(b.label, b.end_frame) for b in out] == [("standing", 10)]
    single = seg(spark, ["sitting"])
    assert [(b.label, b.duration) for b in single] == [("sitting", 0.0)]


def test_short_bouts(spark):  # T9
    out = seg(spark, ["bending"] * 3 + ["standing"] * 8 + ["sitting"] * 2 + ["walking"] * 9)
    assert [(b.label, b.start_frame, b.end_frame) for b in out] == [("standing", 3, 13), ("walking", 13, 21)]
    short = seg(spark, ["bending"] * 2 + ["standing"] * 2 + ["sitting"] * 3)
    assert [(b.label, b.start_frame, b.end_frame) for b in short] == [("bending", 0, 2)]


def test_merging_averages_pairwise(spark):  # T10, T11
    labels = ["standing"] * 8 + ["sitting"] * 2 + ["standing"] * 8 + ["sitting"] * 2 + ["standing"] * 8
    disp = [1.0] * 10 + [5.0] * 10 + [9.0] * 8
    out = seg(spark, labels, disp=disp)
    assert len(out) == 1
    d1, d2, d3 = 1.0, (7 * 5.0 + 5.0 + 5.0) / 9, 9.0
    assert math.isclose(out[0].avg_disp, ((d1 + d2) / 2 + d3) / 2)
    still = seg(spark, ["standing"] * 30)
    assert still[0].is_rest and not seg(spark, ["bending"] * 30)[0].is_rest
    assert not seg(spark, ["standing"] * 30, disp=[5.0] * 30)[0].is_rest


def bouts_df(spark, rows):
    return spark.createDataFrame([(1, 1, v, float(s), float(e), round(float(e - s), 2), r) for v, s, e, r in rows],
                                 "video_id long, worker_id long, label string, start_time double, end_time double, "
                                 "duration double, is_rest boolean")


def test_rest_counts_as_sitting_but_not_as_standing(spark):  # T12, T13, T14
    df = bouts_df(spark, [("standing", 0, 10, True), ("sitting", 10, 20, True), ("bending", 20, 30, False),
                          ("standing", 30, 35, False), ("unknown", 35, 39, False)])
    t = A.posture_time(df).first()
    assert (t.standing_s, t.standing_reps, t.sitting_s, t.bending_s) == (5.0, 1, 10.0, 10.0)
    assert A.dominant(df).first().dominant_posture == "standing"
    tie = bouts_df(spark, [("sitting", 0, 10, True), ("bending", 10, 20, False)])
    assert A.dominant(tie).first().dominant_posture == "sitting"
    w = A.work_rest(df).first()
    assert (w.longest_work_s, w.rest_s, w.rest_count, w.avg_rest_s, w.work_bouts) == (10.0, 20.0, 2, 10.0, 3)
    pct = {r.label: r.pct for r in A.distribution(df).collect()}
    assert abs(sum(pct.values()) - 100) < 0.5 and pct["unknown"] == 10.3


def test_severe_and_arm_limits(spark):  # T15
    rows = [(1, 1, 60.0, 45.0), (1, 1, 60.1, 90.0), (1, 1, None, None), (1, 1, 80.0, 10.0)]
    df = spark.createDataFrame(rows, "video_id long, worker_id long, trunk double, shoulder double")
    assert A.severe_frames(df).first().severe_frames == 2
    a = A.arm_share(df).first()
    assert (a.sh45_pct, a.sh90_pct) == (66.7, 33.3)
    assert one(spark, S.arm_risk(F.lit(50.0), F.lit(15.0)))[0] == "Moderate"


def test_every_near_load_detection_is_an_event(spark):  # T16
    near = spark.createDataFrame([(1, 1, "backpack"), (1, 1, "backpack"), (1, 1, "knife"), (1, 1, "suitcase")],
                                 "video_id long, worker_id long, class_name string")
    assert A.load_events(near).first().load_events == 3


def test_near_is_strict_in_the_pipeline(spark):
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    p = spark.createDataFrame([(1, 5, 7, (0.0, 0.0, 60.0, 80.0))], f"video_id long, frame_idx long, raw_id long, bbox {box}")
    o = spark.createDataFrame([(i, 1, 5, (x, 35.0, x + 10.0, 45.0)) for i, x in enumerate([25.0, 84.9, 85.0, 200.0])],
                              f"det_id long, video_id long, frame_idx long, bbox {box}")
    ids = lambda df: sorted(r.det_id for r in df.collect())
    assert ids(J.objects_of_persons(p, o)) == [0, 1]
    assert ids(J.near_person(p, o, 0.6, True)) == [0, 1, 2]


def test_crowds_of_a_frame_meet_on_a_grid(spark):
    """Boxes of all sizes, none included, on both sides of zero: the pairs are those of all with all."""
    import math
    import random

    rnd = random.Random(3)
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    people, things = [], []
    for i in range(200):
        x, y, w = rnd.uniform(-400, 400), rnd.uniform(-300, 300), rnd.choice([0.0, 0.3, 6.0, 30.0, 48.0, 400.0])
        people.append((1, i % 2, i, (x, y, x + w, y + w / 0.75)))
        things.append((i, 1, i % 2, (x, y, x, y) if i % 9 == 0 else (x + rnd.uniform(-30, 30), y, x + 30, y + 10)))
    things.append((999, 1, 0, None))
    p = spark.createDataFrame(people, f"video_id long, frame_idx long, raw_id long, bbox {box}")
    o = spark.createDataFrame(things, f"det_id long, video_id long, frame_idx long, bbox {box}")
    mid = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    want = sorted((t[0], q[2]) for q in people for t in things if t[3] and t[2] == q[1]
                  and math.dist(mid(t[3]), mid(q[3])) <= math.hypot(q[3][2] - q[3][0], q[3][3] - q[3][1]) * 0.5)
    near = J.near_person(p, o)
    assert sorted((r.det_id, r.raw_id) for r in near.collect()) == want and len(want) > 400
    assert near.columns == ["video_id", "frame_idx", "det_id", "raw_id"]
    assert "_cx" in near._jdf.queryExecution().optimizedPlan().toString()


ANG = "video_id long, worker_id long, frame_idx long, ts double, trunk double, neck double, knee double, shoulder double, elbow double, wrist double"


def test_reba_high_risk(spark):
    df = spark.createDataFrame([(1, 1, 0, 0.0, 65.0, 25.0, 170.0, 80.0, 90.0, None)], ANG)
    t = F.lit(True)
    assert SC.reba_frame(df, static=t, repetitive=t).first().final_score >= 4


def test_range_limits(spark):  # T22
    score = lambda v, part, missing: one(spark, S.range_score(F.lit(v).cast(D), T.REBA_RANGES[part], missing))[0]
    assert score(180.0, "trunk", 2) == 4 and score(None, "trunk", 2) == 2 and score(None, "neck", 1) == 1
    assert [score(v, "lower_arm", 1) for v in (59.9, 60.0, 100.0, 180.0)] == [2, 1, 2, 2]


def test_rula_neutral_and_severe(spark):
    cols = "trunk double, neck double, knee double, shoulder double, elbow double, wrist double"
    low = spark.createDataFrame([(0.0, 5.0, 180.0, 10.0, 90.0, 90.0)], cols)
    assert SC.rula_frame(low).first().final_score <= 3
    high = spark.createDataFrame([(65.0, 35.0, 80.0, 95.0, 120.0, 40.0)], cols)
    assert SC.rula_frame(high, F.lit(True), F.lit(2)).first().final_score >= 5


@pytest.mark.parametrize("scores,want", [([1, 2, 3], 2), ([4] * 9 + [8], 4), ([1], 1), ([2, 9, 9, 9], 9),
                                         (list(range(1, 12)), 10)])
def test_p90_is_interpolated_then_truncated(spark, scores, want):  # T21
    import numpy as np

    df = spark.createDataFrame([(1, 1, i, float(i), s, s * 10) for i, s in enumerate(scores)],
                               "video_id long, worker_id long, frame_idx long, ts double, final_score int, part int")
    r = SC.p90_of_scores(df, ["part"], 15).first()
    assert r.p90_score == want == int(np.percentile(scores, 90))
    nearest = min(scores, key=lambda s: abs(s - want))
    assert r.part == nearest * 10


@pytest.mark.parametrize("kg,trunk,h,risk,over", [(5.0, 10.0, 30.0, "Low Risk (Safe)", False),
                                                  (25.0, 65.0, 55.0, "High Risk (Severe Spinal Strain)", True)])
def test_lifting(spark, kg, trunk, h, risk, over):
    df = spark.createDataFrame([(kg, trunk, h)], "kg double, trunk double, h double")
    r = SC.niosh(df, F.col("kg"), F.col("trunk"), F.col("h")).first()
    assert r.lift_risk == risk and r.compression_exceeded is over
    assert r.lifting_index == round(kg / r.rwl_kg, 2)


DRUDGE = ("video_id long, worker_id long, reba_score int, rula_score int, bending_pct double, squatting_pct double, "
          "cycles_per_minute double, tracked_s double, longest_work_s double, rest_s double, load_events long, "
          "severe_pct double, sh45_pct double, sh90_pct double")


def test_drudgery(spark):  # T29
    df = SC.drudgery(spark.createDataFrame([(1, 1, 8, 5, 40.0, 20.0, 45.0, 600.0, 300.0, 30.0, 2, 0.0, 0.0, 0.0)], DRUDGE))
    r = df.first()
    posture = 8 / 15 * 35 + 5 / 7 * 25 + 40 * 0.2 + 20 * 0.1
    repeat = 100 / (1 + math.exp(-0.08 * 20))
    rest = 15 + 100 - 5 * 2.5
    want = round(posture * 0.35 + repeat * 0.2 + min(100, rest) * 0.2 + 30 * 0.1, 1)
    assert r.drudgery_index == want and r.drudgery_category in ("Moderate Drudgery", "High Drudgery")
    assert len(r.advice) >= 1 and r.advice[0] == T.ADVICE_REPEAT
    curve = SC.fatigue_curve(df).orderBy("minute").collect()
    assert len(curve) == 10 and curve[-1].fatigue == round(r.fatigue_level * (1 - math.exp(-2.5)), 1)
    idle = SC.drudgery(spark.createDataFrame([(1, 1, 1, 1, 0.0, 0.0, None, 600.0, 0.0, 600.0, 0, 0.0, 0.0, 0.0)], DRUDGE)).first()
    assert idle.repetition == 10.0 and idle.advice == [T.ADVICE_NONE]


def hourly(spark, tracked, **over):
    base = {f"{p}_s": 10.0 for p in S.HOURLY_PARTS}
    base.update(tracked_s=tracked, rest_count=1, load_events=2, trip_count=3, is_repetitive=True, cycles_per_minute=20.0,
                sh45_pct=30.0, sh90_pct=10.0, rest_s=6.0, **over)
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in base.items()])
    return SC.hourly(df).first()


def test_one_hour_standard(spark):  # T20
    r = hourly(spark, 60.0)
    assert r.scaling_factor == 60.0 and r.sitting_1hr == 600.0 and r.sitting_hms_1hr == "00:10:00"
    assert (r.rest_1hr, r.load_events_1hr, r.trips_1hr, r.rest_count_1hr) == (360.0, 120, 180, 60)
    assert r.active_1hr == 3240.0 and r.cycles_1hr == 1080 and r.arm_above_45_1hr == 1080.0
    assert hourly(spark, 0.0).scaling_factor == 1.0
    capped = hourly(spark, 1.0)
    assert capped.sitting_1hr == 3600.0


def test_time_texts(spark):  # T30
    r = one(spark, N.hms_rounded(F.lit(59.5)), N.hms_truncated(F.lit(59.9)), N.hms_truncated(F.lit(-4.0)),
            N.hms_rounded(F.lit(360000.0)), N.hms_rounded(F.lit(60.5)))
    assert list(r) == ["00:01:00", "00:00:59", "00:00:00", "100:00:00", "00:01:00"]


def test_rounding_is_half_even(spark):  # T31
    r = one(spark, N.rnd(F.lit(0.125), 2), N.rnd(F.lit(2.5)), N.rnd(F.lit(2.675), 2), N.rnd(F.lit(None).cast(D), 1))
    assert list(r) == [0.12, 2.0, 2.68, None]


def test_exposure_limit(spark):  # T28
    df = spark.createDataFrame([(300.0, 1800.0), (200.0, 1800.0), (10.0, 30.0), (5.0, 0.0)], "bending_s double, tracked_s double")
    out = SC.iso_exposure(df).collect()
    assert [r.iso_violated for r in out] == [True, False, True, False]
    assert "5.0 mins" in out[0].iso_message and "3.3 mins" in out[1].iso_message and out[3].iso_message == T.ISO_NO_DATA


@pytest.mark.parametrize("dist,cpm,joint,tools,loads,sh90,want", [
    ({"walking": 30.0}, 0.0, "elbow", [], 3, 0.0, "transport"),
    ({"standing": 40.0}, 0.0, "elbow", ["backpack"], 0, 0.0, "transport"),
    ({"bending": 30.0, "squatting": 20.0}, 10.0, "elbow", [], 0, 0.0, "weeding"),
    ({"bending": 25.0, "standing": 60.0}, 30.0, "trunk", [], 0, 0.0, "hoeing"),
    ({"standing": 96.0}, 30.0, "trunk", [], 0, 0.0, "general"),
    ({"standing": 80.0}, 20.0, "shoulder", [], 0, 20.0, "picking"),
    ({"standing": 80.0}, 20.0, "shoulder", [], 0, 2.0, "general"),
    ({"standing": 80.0}, 30.0, "wrist", [], 0, 0.0, "pruning"),
])
def test_tasks(spark, dist, cpm, joint, tools, loads, sh90, want):
    df = spark.range(1).select(
        *[F.lit(dist.get(p, 0.0)).alias(f"{p}_pct") for p in ("bending", "squatting", "standing", "walking")],
        F.lit(cpm).alias("cycles_per_minute"), F.lit(joint).alias("primary_joint"),
        F.array(*[F.lit(v) for v in tools]).cast("array<string>").alias("tools"), F.lit(loads).alias("load_events"),
        F.lit(sh90).alias("sh90_pct"))
    r = SC.classify_task(df).first()
    assert r.task == T.TASKS[want][0] and r.task_hazard == T.TASKS[want][2] and 0.6 <= r.task_confidence <= 0.95


TRACK = "video_id long, raw_id long, frame_idx long, ts double, x double, y double"


def test_fragments_of_one_person_are_joined(spark):
    rows = [(1, 100, i, t, 100.0 + t, 200.0 + t) for i, t in enumerate([0.0, 10.0, 20.0, 30.0])]
    rows += [(1, 200, i, t, 90.0 + t, 180.0 + t) for i, t in enumerate([35.0, 45.0, 60.0, 70.0])]
    rows += [(1, 300, i, t, 600.0, 800.0) for i, t in enumerate([0.0, 20.0, 40.0, 60.0])]
    df = spark.createDataFrame(rows, TRACK)
    limits = Thresholds(max_gap_s=60.0, max_link_px=100.0)
    ids = {r.raw_id: r.unified_id for r in K.stitch(df, limits).collect()}
    assert ids[100] == ids[200] != ids[300]
    assert K.peak_concurrency(K.tracklet_meta(df, limits)).first().peak_concurrency == 2


def test_simultaneous_tracks_stay_apart(spark):
    rows = [(1, 1, i, t, 100.0, 100.0) for i, t in enumerate([10.0, 20.0, 40.0, 50.0])]
    rows += [(1, 2, i, t, 110.0, 110.0) for i, t in enumerate([15.0, 25.0, 45.0, 55.0])]
    rows += [(1, 9, i, t, 110.0, 110.0) for i, t in enumerate([70.0, 71.0])]
    df = spark.createDataFrame(rows, TRACK)
    ids = K.stitch(df)
    got = {r.raw_id: r.unified_id for r in ids.collect()}
    assert got[1] != got[2] and 9 not in got
    assert {r.worker_id for r in J.unify_ids(df, ids).where("raw_id = 9").collect()} == {-9}  # T26


def test_sine_is_repetitive(spark):
    rows = [(1, 1, i, i / 10, 90 + 20 * math.sin(2 * math.pi * i / 10)) for i in range(100)]
    df = spark.createDataFrame(rows, "video_id long, worker_id long, frame_idx long, ts double, elbow double")
    r = SG.repetition(df, limits=Thresholds(sample_fps=10.0)).first()
    assert r.is_repetitive and abs(r.freq_hz - 1.0) < 0.2


def test_short_and_slow_series(spark):  # T19, T32
    rows = [(1, w, i, i * 1.0, float(i % 4)) for w, n in [(1, 24), (2, 12)] for i in range(n)]
    df = spark.createDataFrame(rows, "video_id long, worker_id long, frame_idx long, ts double, elbow double")
    assert SG.repetition(df).count() == 0
    slow = {r.worker_id: r for r in SG.repetition(df, limits=Thresholds(sample_fps=2.0)).collect()}
    assert set(slow) == {1, 2} and slow[2].confidence == 0.0 and slow[2].freq_hz is None
    best = SG.best_joint(SG.repetition(df), df.select("video_id", "worker_id").distinct()).collect()
    assert [(b.primary_joint, b.confidence, b.is_repetitive) for b in best] == [("elbow", 0.0, False)] * 2


def test_sampling(spark):
    v = spark.createDataFrame([(1, 30.0, 100.0), (2, 30.0, 600.0), (3, 0.2, 2000.0)], "video_id long, fps double, duration_s double")
    fps = lambda mode: [r[0] for r in v.orderBy("video_id").select(sampling.adaptive_fps(F.col("duration_s"), F.lit(mode))).collect()]
    assert fps("Lightning Fast") == [0.5, 0.25, 0.15]
    assert fps("High Precision Research") == [3.0, 1.5, 1.0]
    assert fps("anything") == [1.0, 0.5, 0.25]
    f = spark.createDataFrame([(1, i, None if i == 30 else i * 100.0) for i in range(61)], "video_id long, frame_idx long, pos_ms double")
    kept = {r.frame_idx: r.ts for r in sampling.sample_frames(f, v).collect()}
    assert kept == {0: 0.0, 30: 1.0, 60: 6.0}


def test_file_filters(spark):
    df = spark.createDataFrame([("a.MP4", 10), ("b.txt", 10), ("c.tar.mkv", 3000), ("noext", 1)], "name string, size_mb long")
    assert [r.name for r in observation.accepted_formats(df).collect()] == ["a.MP4", "c.tar.mkv"]
    assert [r.name for r in observation.accepted_sizes(df).collect()] == ["a.MP4", "b.txt", "noext"]
