"""Registered queries: one per operator, over the whole test tables, each with its SQL check where one exists."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postura import oracle as O
from postura import tables as T
from postura.functions import geometry as G
from postura.functions import posture as P
from postura.functions import scoring as S
from postura.functions.numeric import dbl, hms_rounded, hms_truncated, rnd, share
from postura.operators import aggregates as A
from postura.operators import association as J
from postura.operators import bouts as B
from postura.operators import frames as Fr
from postura.operators import report_tables as R
from postura.operators import rollup as RU
from postura.operators import scoring as SC
from postura.operators import signals as SG
from postura.operators import tracklets as K
from postura.operators import trips as TR
from postura.operators.ordered import drop_staged, stage, staging_path
from postura.plans import worker_report as W
from postura.sources import adapters, observation, sampling, sinks
from postura.streaming import posture_stream as ST
from postura.streaming import replay as RP

Query = Callable[["Tables"], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

VW = ["video_id", "worker_id"]


class Tables:
    """Tables of one data folder that several queries start from; each is derived once per session."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def frames(self) -> DataFrame:
        return stage(adapters.boxes(adapters.frames(self.spark, self.sf_dir)))

    @cached_property
    def detections(self) -> DataFrame:
        return adapters.detections(self.spark, self.sf_dir)

    @cached_property
    def videos(self) -> DataFrame:
        return observation.video_info(adapters.videos(self.spark, self.sf_dir))

    @cached_property
    def poses(self) -> DataFrame:
        return adapters.poses(self.spark, self.sf_dir)

    @cached_property
    def joints(self) -> DataFrame:
        return G.unroll(self.poses, ["obs_id", "video_id", "raw_id", "frame_idx", "ts", "conf"])

    @cached_property
    def angles(self) -> DataFrame:
        return G.joint_angles(self.joints, ["obs_id"])

    @cached_property
    def labelled(self) -> DataFrame:
        """Labelled frames keyed by the test table's own person number."""
        return stage(Fr.classify(self.frames, "worker_id"))

    @cached_property
    def raw_bouts(self) -> DataFrame:
        return stage(B.raw_bouts(self.labelled))

    @cached_property
    def bouts(self) -> DataFrame:
        return stage(B.mark_rest(B.merge_adjacent(B.absorb_short(self.raw_bouts))))

    @cached_property
    def near(self) -> DataFrame:
        return stage(J.objects_of_persons(self.frames, observation.work_objects(self.detections),
                                          keep=("raw_id", "worker_id")))

    @cached_property
    def meta(self) -> DataFrame:
        return stage(K.tracklet_meta(self.frames))

    @cached_property
    def ids(self) -> DataFrame:
        roots = K.chains(self.meta, K.nearest_successors(self.meta))
        return stage(K.rank_clusters(self.meta, roots))

    @cached_property
    def smoothed(self) -> DataFrame:
        return stage(TR.moving_avg(self.frames))

    @cached_property
    def filled(self) -> DataFrame:
        return stage(SG.fill_gaps(self.frames))

    @cached_property
    def flat(self) -> DataFrame:
        return stage(SG.detrend(self.filled).where("n >= 25"))

    @cached_property
    def peaks(self) -> DataFrame:
        return stage(SG.peaks(self.flat))

    @cached_property
    def rates(self) -> tuple[DataFrame, DataFrame]:
        names = self.flat.select(*VW, "joint").distinct()
        return stage(SG.peak_rate(self.peaks, names)), stage(SG.spectrum_rate(self.flat))

    @cached_property
    def run(self) -> W.Analysis:
        return W.analyse(self.frames, self.detections)

    @cached_property
    def report(self) -> DataFrame:
        return stage(W.assemble(self.run))


def query(name: str, select: str | None = None, mode: str = "plain"):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if select is not None:
            SQL[name] = O.sql(select, mode)
        return fn

    return register


def rounded(*names: str, k: int = 4) -> list[Column]:
    return [rnd(F.col(n), k).alias(n) for n in names]


def r4(*names: str) -> str:
    return ", ".join(f"{O.r(n, 4)} AS {n}" for n in names)


# ================================================================== sources and sampling


@query("src_pose", f"SELECT obs_id, video_id, raw_id, frame_idx, {r4('ts')} FROM kp WHERE obs_id % 7 <> 0")
def _(t):
    seen = t.poses.withColumn("raw_id", F.when(F.col("obs_id") % 7 != 0, F.col("raw_id")))
    return observation.pose_rows(seen).select("obs_id", "video_id", "raw_id", "frame_idx", *rounded("ts"))


@query("src_pose_unroll", "SELECT obs_id, j AS joint_no, n AS joint, " + ", ".join(
    f"{O.r(f'{src}[j+1]', 4)} AS {dst}" for src, dst in (("kx", "x"), ("ky", "y"), ("kc", "conf")))
    + " FROM kp, (VALUES " + "(0, 'nose'), (1, 'l_eye'), (2, 'r_eye'), (3, 'l_ear'), (4, 'r_ear'), (5, 'l_sh'), (6, 'r_sh'), (7, 'l_el'), (8, 'r_el'), "
    "(9, 'l_wr'), (10, 'r_wr'), (11, 'l_hip'), (12, 'r_hip'), (13, 'l_kn'), (14, 'r_kn'), (15, 'l_an'), (16, 'r_an')) AS z(j, n)")
def _(t):
    return observation.joints_long(t.poses, ["obs_id"]).select("obs_id", "joint_no", "joint", *rounded("x", "y", "conf"))


@query("src_detections", f"SELECT det_id, video_id, frame_idx, class_id, class_name, {r4('confidence')} FROM obj")
def _(t):
    return observation.work_objects(t.detections).select("det_id", "video_id", "frame_idx", "class_id", "class_name",
                                                         *rounded("confidence"))


@query("src_videos", "SELECT video_id, name, fps, total_frames, duration_s FROM vid")
def _(t):
    return t.videos.select("video_id", "name", "fps", "total_frames", "duration_s")


@query("src_format_filter", "SELECT video_id, name FROM vid WHERE name NOT LIKE '%.txt'")
def _(t):
    return observation.accepted_formats(t.videos).select("video_id", "name")


@query("src_size_filter", "SELECT video_id, name, size_mb FROM vid WHERE size_mb <= 2000")
def _(t):
    return observation.accepted_sizes(t.videos).select("video_id", "name", "size_mb")


MODES = ["Lightning Fast", "Balanced Fast", "High Precision Research"]
_FPS = """CASE WHEN mode = 'Lightning Fast' THEN CASE WHEN duration_s < 180 THEN 0.5e0 WHEN duration_s < 900 THEN 0.25e0 ELSE 0.15e0 END
  WHEN mode = 'Balanced Fast' THEN CASE WHEN duration_s < 180 THEN 1e0 WHEN duration_s < 900 THEN 0.5e0 ELSE 0.25e0 END
  ELSE CASE WHEN duration_s < 180 THEN 3e0 WHEN duration_s < 900 THEN 1.5e0 ELSE 1e0 END END"""
_MODES = "(VALUES ('Lightning Fast'), ('Balanced Fast'), ('High Precision Research')) AS m(mode)"


def _per_mode(t: Tables) -> DataFrame:
    modes = t.videos.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in MODES])))
    return modes.withColumn("sample_fps", sampling.adaptive_fps(F.col("duration_s"), F.col("mode")))


@query("sample_adaptive_fps", f"SELECT video_id, mode, {_FPS} AS sample_fps FROM vid, {_MODES}")
def _(t):
    return _per_mode(t).select("video_id", "mode", "sample_fps")


@query("sample_count", f"""SELECT video_id, mode, CAST(total_frames // greatest(1, CAST(round_even(fps/s, 0) AS BIGINT))
  AS BIGINT) AS n_sampled FROM (SELECT *, {_FPS} AS s FROM vid, {_MODES})""")
def _(t):
    n = sampling.sampled_count(F.col("total_frames"), F.col("fps"), F.col("sample_fps"))
    return _per_mode(t).select("video_id", "mode", n.alias("n_sampled"))


@query("sample_frames", f"""SELECT event_id, video_id, frame_idx,
  {O.r('CASE WHEN pos_ms > 0 THEN pos_ms/1000 ELSE frame_idx/fps END', 3)} AS ts
  FROM (SELECT f.event_id, f.video_id, f.frame_idx, f.ts*1000 AS pos_ms, v.fps,
    CAST(round_even(v.fps/(CASE WHEN duration_s < 180 THEN 3e0 WHEN duration_s < 900 THEN 1.5e0 ELSE 1e0 END), 0) AS BIGINT) AS every
    FROM f JOIN vid v ON v.video_id = f.video_id) WHERE frame_idx % every = 0""")
def _(t):
    positioned = t.frames.withColumn("pos_ms", F.col("ts") * 1000.0)
    return sampling.sample_frames(positioned, t.videos, "High Precision Research").select(
        "event_id", "video_id", "frame_idx", "ts")


@query("sample_stride", """SELECT video_id, frame_idx FROM (SELECT video_id, frame_idx,
  row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 AS i FROM (SELECT DISTINCT video_id, frame_idx FROM f))
  WHERE i % 10 = 0""")
def _(t):
    return sampling.object_frames(t.frames)


# ================================================================== per-frame geometry


@query("angle_3pt", f"SELECT obs_id, {O.r(O._a3('l_sh', 'l_el', 'l_wr'), 4)} AS angle FROM joints")
def _(t):
    p = G.Pose()
    return t.joints.select("obs_id", rnd(G.angle_3pt(p.at("l_sh"), p.at("l_el"), p.at("l_wr")), 4).alias("angle"))


@query("angle_vertical", f"SELECT obs_id, {O.r(O._av('l_sh_x', 'l_sh_y', 'l_hip_x', 'l_hip_y'), 4)} AS angle FROM joints")
def _(t):
    p = G.Pose()
    return t.joints.select("obs_id", rnd(G.angle_vertical(p.at("l_sh"), p.at("l_hip")), 4).alias("angle"))


@query("midpoint", f"SELECT obs_id, {O.r('(l_hip_x+r_hip_x)/2', 4)} AS x, {O.r('(l_hip_y+r_hip_y)/2', 4)} AS y FROM joints")
def _(t):
    p = G.Pose()
    m = G.midpoint(p.at("l_hip"), p.at("r_hip"))
    return t.joints.select("obs_id", rnd(m.x, 4).alias("x"), rnd(m.y, 4).alias("y"))


@query("kp_valid", "SELECT obs_id, " + ", ".join(f"{j}_ok" for j in G.JOINTS) + " FROM joints")
def _(t):
    return t.joints.select("obs_id", *[f"{j}_ok" for j in G.JOINTS])


def _angle_query(name: str, cols: list[str]) -> None:
    @query(name, f"SELECT obs_id, {r4(*cols)} FROM angles")
    def _(t):
        return t.angles.select("obs_id", *rounded(*cols))


_angle_query("trunk_flexion", ["trunk"])
_angle_query("neck_flexion", ["neck"])
_angle_query("wrist_angle", ["left_wrist", "right_wrist"])
for _part in ("hip", "knee", "elbow"):
    _angle_query(f"{_part}_angle", [f"left_{_part}", f"right_{_part}", f"avg_{_part}"])

_SH = ["left_shoulder", "right_shoulder", "avg_shoulder", "max_shoulder"]
_FLAGS = ("coalesce(max_shoulder >= 45, false) AS arm_above_45, coalesce(max_shoulder >= 90, false) AS arm_above_90")


@query("shoulder_elev", f"SELECT obs_id, {r4(*_SH)}, {_FLAGS} FROM angles")
def _(t):
    return t.angles.select("obs_id", *rounded(*_SH), "arm_above_45", "arm_above_90")


_ALL = ["trunk", "neck", *[f"{s}_{p}" for p in ("hip", "knee", "elbow", "wrist") for s in ("left", "right")],
        "avg_hip", "avg_knee", "avg_elbow", *_SH]


@query("joint_angles", f"SELECT obs_id, {r4(*_ALL)}, {_FLAGS} FROM angles")
def _(t):
    return t.angles.select("obs_id", *rounded(*_ALL), "arm_above_45", "arm_above_90")


@query("side_pick", "SELECT obs_id, " + ", ".join(
    O.r(f"CASE WHEN left_{p} IS NULL OR left_{p} = 0 THEN right_{p} ELSE left_{p} END", 4) + f" AS {p}"
    for p in ("elbow", "wrist", "shoulder")) + " FROM angles")
def _(t):
    return t.angles.select("obs_id", *[rnd(G.side_pick(F.col(f"left_{p}"), F.col(f"right_{p}")), 4).alias(p)
                                       for p in ("elbow", "wrist", "shoulder")])


@query("centroid", f"SELECT obs_id, {O.r('cx', 4)} AS x, {O.r('cy', 4)} AS y FROM points")
def _(t):
    c = t.joints.select("obs_id", G.centroid(G.Pose()).alias("c"))
    return c.select("obs_id", rnd(F.col("c.x"), 4).alias("x"), rnd(F.col("c.y"), 4).alias("y"))


@query("ankle_point", f"SELECT obs_id, {O.r('ax', 4)} AS x, {O.r('ay', 4)} AS y FROM points")
def _(t):
    c = t.joints.select("obs_id", G.ankle_point(G.Pose()).alias("c"))
    return c.select("obs_id", rnd(F.col("c.x"), 4).alias("x"), rnd(F.col("c.y"), 4).alias("y"))


@query("mean_kp_conf", f"SELECT obs_id, {O.r('mean_conf', 4)} AS mean_conf FROM points")
def _(t):
    return t.joints.select("obs_id", rnd(G.mean_kp_conf(F.col("conf")), 4).alias("mean_conf"))


@query("hips_low", """SELECT obs_id, coalesce(abs(hh-sh) > 0 AND abs(ah-hh) < abs(hh-sh)*0.75e0, false) AS hips_low
  FROM points""")
def _(t):
    return t.joints.select("obs_id", G.hips_low(G.Pose()).alias("hips_low"))


@query("posture_raw", f"SELECT event_id, raw_label, {O.r('rule_conf', 4)} AS rule_conf FROM low_2")
def _(t):
    c = F.col
    raw = P.posture_raw(c("trunk"), c("hip"), c("knee"), c("walking"), c("event_id") % 5 == 0)
    return t.labelled.select("event_id", raw.alias("r")).select("event_id", c("r.label").alias("raw_label"),
                                                                rnd(c("r.conf"), 4).alias("rule_conf"))


@query("frame_conf", f"SELECT event_id, {O.r('frame_conf', 2)} AS confidence FROM lab_worker_id")
def _(t):
    return t.labelled.select("event_id", rnd(F.col("frame_conf"), 2).alias("confidence"))


@query("direction_deg", f"SELECT video_id, worker_id, frame_idx, {O.r('dir', 4)} AS direction FROM sm")
def _(t):
    return t.smoothed.select(*VW, "frame_idx", *rounded("direction"))


@query("angle_diff", f"""SELECT video_id, worker_id, frame_idx,
  {O.r('CASE WHEN d > 180 THEN d - 360 WHEN d < -180 THEN d + 360 ELSE d END', 4)} AS turn
  FROM (SELECT *, dir - (trunk_dir) AS d FROM (SELECT *, (frame_idx*7 % 360) - 180e0 AS trunk_dir FROM sm))""")
def _(t):
    fixed = F.col("frame_idx") * 7 % 360 - dbl(180)
    return t.smoothed.select(*VW, "frame_idx", rnd(TR.angle_diff(F.col("direction"), fixed), 4).alias("turn"))


_PARTS = ["trunk_score", "neck_score", "legs_score", "upper_arm_score", "lower_arm_score", "wrist_score"]


@query("range_score", f"SELECT event_id, {', '.join(_PARTS)} FROM rs0")
def _(t):
    return SC.reba_frame(t.frames).select("event_id", *_PARTS)


@query("table_lookup", "SELECT event_id, score_a, score_b, "
       f"{T.RULA_A}[least(upper_arm_score,6)][least(lower_arm_score,3)][least(wrist_score,4)] AS rula_a, "
       f"{T.RULA_B}[least(neck_score,6)][least(trunk_score,6)][least(legs_score,2)] AS rula_b FROM rs1")
def _(t):
    c = F.col
    rula_a = S.table_lookup(T.RULA_A, c("upper_arm_score"), c("lower_arm_score"), c("wrist_score"))
    rula_b = S.table_lookup(T.RULA_B, c("neck_score"), c("trunk_score"), c("legs_score"))
    return SC.reba_frame(t.frames).select("event_id", "score_a", "score_b", rula_a.alias("rula_a"),
                                          rula_b.alias("rula_b"))


@query("level_map", f"""SELECT event_id, final_score, {O.level('final_score', T.REBA_LEVELS, 2)} AS risk_level,
  {O.level('final_score', T.REBA_LEVELS, 3)} AS action FROM reba""")
def _(t):
    return SC.reba_frame(t.frames).select("event_id", "final_score", "risk_level", "action")


@query("fmt_hms_round", f"SELECT event_id, {O.hms_r('ts*137')} AS hms FROM f")
def _(t):
    return t.frames.select("event_id", hms_rounded(F.col("ts") * 137.0).alias("hms"))


@query("fmt_hms_trunc", f"SELECT event_id, {O.hms_t('ts*137')} AS hms FROM f")
def _(t):
    return t.frames.select("event_id", hms_truncated(F.col("ts") * 137.0).alias("hms"))


@query("pct_safe", f"""SELECT video_id, worker_id, CASE WHEN tracked_s > 0 THEN {O.r('sitting_s/tracked_s*100', 1)} ELSE 0e0 END
  AS sitting_share FROM bf""")
def _(t):
    both = A.posture_time(t.bouts).join(A.tracked_time(t.bouts), VW)
    return both.select(*VW, share(F.col("sitting_s"), F.col("tracked_s")).alias("sitting_share"))


@query("stoop_band", """SELECT video_id, worker_id, avg_trunk, CASE WHEN avg_trunk > 60 THEN 'severe' WHEN avg_trunk > 20
  THEN 'moderate' ELSE 'safe' END AS band FROM ff""")
def _(t):
    return A.angle_stats(t.frames).select(*VW, "avg_trunk", P.stoop_band(F.col("avg_trunk")).alias("band"))


@query("hud_band", """SELECT event_id, CASE WHEN trunk > 60 THEN 'red' WHEN trunk > 20 OR final_score > 3 THEN 'yellow'
  ELSE 'green' END AS colour, CASE WHEN shoulder >= 90 THEN 'overhead' WHEN shoulder >= 45 THEN 'warn' ELSE 'ok' END AS arm_tag
  FROM reba""")
def _(t):
    return SC.reba_frame(t.frames).select("event_id", P.hud_band(F.col("trunk"), F.col("final_score")).alias("colour"),
                                          P.hud_arm_tag(F.col("shoulder")).alias("arm_tag"))


@query("gauge_band", """SELECT event_id, CASE WHEN shoulder < 0 OR shoulder > 140 THEN NULL WHEN shoulder < 20 THEN 'safe'
    WHEN shoulder < 45 THEN 'moderate' WHEN shoulder < 90 THEN 'severe' ELSE 'overhead' END AS arm,
  CASE WHEN trunk < 0 OR trunk > 120 THEN NULL WHEN trunk < 20 THEN 'safe' WHEN trunk < 60 THEN 'moderate'
    WHEN trunk IS NOT NULL THEN 'severe' END AS trunk_band FROM f""")
def _(t):
    return t.frames.select("event_id", P.arm_gauge(F.col("shoulder")).alias("arm"),
                           P.trunk_gauge(F.col("trunk")).alias("trunk_band"))


# ================================================================== joins


@query("join_object_person", f"SELECT det_id, video_id, frame_idx, class_name, raw_id, worker_id FROM near")
def _(t):
    return t.near.select("det_id", "video_id", "frame_idx", "class_name", "raw_id", "worker_id")


@query("join_near_person", "SELECT det_id, video_id, frame_idx, class_name, raw_id FROM pairs WHERE dist <= diag*0.5e0")
def _(t):
    objects = observation.work_objects(t.detections)
    return J.near_person(t.frames, objects).select("det_id", "video_id", "frame_idx", "class_name", "raw_id")


@query("join_load_class", """SELECT det_id, raw_id, class_name FROM near
  WHERE class_name IN ('backpack', 'handbag', 'suitcase')""")
def _(t):
    return J.loads(t.near).select("det_id", "raw_id", "class_name")


@query("join_load_at_frame", """SELECT f.event_id, CASE WHEN EXISTS (SELECT 1 FROM near n WHERE n.video_id = f.video_id
  AND n.raw_id = f.raw_id AND n.frame_idx = f.frame_idx AND n.class_name IN ('backpack', 'handbag', 'suitcase'))
  THEN 2 ELSE 0 END AS load_force FROM f""")
def _(t):
    return J.load_force(t.frames, t.near).select("event_id", "load_force")


@query("join_unify_ids", "SELECT event_id, worker_id FROM wf", "linked")
def _(t):
    return J.unify_ids(t.frames.drop("worker_id"), t.ids).select("event_id", "worker_id")


@query("join_stitch_candidates", f"SELECT video_id, raw_1, raw_2, {O.r('gap', 4)} AS gap, {O.r('d', 4)} AS distance FROM cand")
def _(t):
    return K.stitch_candidates(t.meta).select("video_id", "raw_1", "raw_2", *rounded("gap", "distance"))


@query("join_series_align", f"SELECT event_id, {r4('ts', 'trunk', 'hip', 'knee', 'shoulder', 'elbow')} FROM f")
def _(t):
    return t.frames.select("event_id", *rounded("ts", "trunk", "hip", "knee", "shoulder", "elbow"))


@query("join_lookup", """SELECT det.det_id, names.class_name FROM det LEFT JOIN names ON names.class_id = det.class_id""")
def _(t):
    return t.detections.select("det_id", J.class_name(F.col("class_id")).alias("class_name"))


# ================================================================== aggregates


@query("agg_tracklet_meta", f"""SELECT video_id, raw_id, {O.r('t0', 4)} AS start_time, {O.r('t1', 4)} AS end_time,
  {O.r('greatest(1, t1-t0)', 4)} AS duration, n AS n_frames, {O.r('x0', 4)} AS start_x, {O.r('x1', 4)} AS end_x,
  {O.r('mx', 4)} AS mean_x, {O.r('my', 4)} AS mean_y FROM meta""")
def _(t):
    return t.meta.select("video_id", "raw_id", *rounded("start_time", "end_time", "duration"), "n_frames",
                         *rounded("start_x", "end_x", "mean_x", "mean_y"))


@query("agg_frame_count", "SELECT video_id, raw_id, count(*) AS n_frames FROM f GROUP BY 1, 2")
def _(t):
    return A.frame_count(t.frames)


@query("agg_min_records", "SELECT video_id, worker_id, n_frames FROM ff")
def _(t):
    return A.min_records(t.frames)


_PT = [f"{v}_{s}" for v in A.TIMED for s in ("s", "reps")]


@query("agg_posture_time", f"SELECT video_id, worker_id, {', '.join(_PT)} FROM bf")
def _(t):
    return A.posture_time(t.bouts)


@query("agg_tracked_time", "SELECT video_id, worker_id, tracked_s FROM bf")
def _(t):
    return A.tracked_time(t.bouts)


@query("agg_distribution", "SELECT video_id, worker_id, label, pct FROM dist")
def _(t):
    return A.distribution(t.bouts)


@query("agg_dominant", "SELECT video_id, worker_id, dominant_posture FROM lf")
def _(t):
    return A.dominant(t.bouts)


@query("agg_severe_bend", f"""SELECT ff.video_id, ff.worker_id, severe_frames,
  {O.r('severe_frames*(tracked_s/greatest(1, n_frames))', 2)} AS severe_bending_s
  FROM ff JOIN bf ON bf.video_id = ff.video_id AND bf.worker_id = ff.worker_id""")
def _(t):
    both = A.severe_frames(t.frames).join(A.tracked_time(t.bouts), VW)
    return both.select(*VW, "severe_frames", A.severe_seconds(F.col("severe_frames"), F.col("n_frames"),
                                                             F.col("tracked_s")).alias("severe_bending_s"))


_ST = ["avg_trunk", "max_trunk", "avg_hip", "avg_knee", "avg_shoulder", "max_shoulder", "avg_elbow"]


@query("agg_angle_stats", f"SELECT video_id, worker_id, {', '.join(_ST)} FROM ff")
def _(t):
    return A.angle_stats(t.frames)


@query("agg_arm_exposure", f"""SELECT ff.video_id, ff.worker_id, sh45_pct, sh90_pct, {O.r('sh45_pct/100*tracked_s', 2)} AS sh45_s,
  {O.r('sh90_pct/100*tracked_s', 2)} AS sh90_s, CASE WHEN sh90_pct > 15 OR sh45_pct > 50 THEN 'High' WHEN sh45_pct > 25
  THEN 'Moderate' ELSE 'Low' END AS arm_risk
  FROM ff JOIN bf ON bf.video_id = ff.video_id AND bf.worker_id = ff.worker_id""")
def _(t):
    both = A.arm_share(t.frames).join(A.tracked_time(t.bouts), VW)
    return A.with_arm_exposure(both).select(*VW, "sh45_pct", "sh90_pct", "sh45_s", "sh90_s", "arm_risk")


@query("agg_tool_usage", f"""SELECT video_id, worker_id, class_name, {O.r('min(ts)', 2)} AS first_seen,
  {O.r('max(ts)', 2)} AS last_seen, {O.r('max(ts)-min(ts)', 2)} AS span_s, count(*) AS detections FROM near
  GROUP BY video_id, worker_id, class_name""")
def _(t):
    return A.tool_usage(t.near)


@query("agg_load_events", "SELECT video_id, worker_id, load_events FROM loads")
def _(t):
    return A.load_events(t.near)


_WR = ["longest_work_s", "avg_work_s", "work_bouts", "rest_s", "rest_count", "avg_rest_s"]


@query("agg_work_rest", f"SELECT video_id, worker_id, {', '.join(_WR)} FROM bf")
def _(t):
    return A.work_rest(t.bouts)


@query("agg_p90_reba", "SELECT video_id, worker_id, p90_score, score_a, score_b FROM rw")
def _(t):
    return SC.p90_of_scores(SC.reba_frame(t.frames), ["score_a", "score_b"], 15)


@query("agg_p90_rula", "SELECT video_id, worker_id, p90_score, ra AS score_a, rb AS score_b FROM ruw")
def _(t):
    return SC.p90_of_scores(SC.rula_frame(t.frames), ["score_a", "score_b"], 7)


@query("agg_peak_concurrency", "SELECT video_id, peak_concurrency FROM peak")
def _(t):
    return K.peak_concurrency(t.meta)


@query("agg_path_length", "SELECT video_id, worker_id, n_points, path_px FROM path")
def _(t):
    return TR.long_enough(t.smoothed)


@query("agg_angle_series", f"""SELECT video_id, worker_id, frame_idx, {O.r('ts', 2)} AS ts, {O.r('trunk', 1)} AS trunk,
  {O.r('hip', 1)} AS hip, {O.r('knee', 1)} AS knee FROM f WHERE coalesce(trunk, hip, knee) IS NOT NULL""")
def _(t):
    return A.angle_series(t.frames)


@query("agg_arm_series", f"""SELECT video_id, worker_id, frame_idx, {O.r('ts', 2)} AS ts, {O.r('shoulder', 1)} AS shoulder,
  {O.r('elbow', 1)} AS elbow FROM f WHERE coalesce(shoulder, elbow) IS NOT NULL""")
def _(t):
    return A.arm_series(t.frames)


@query("agg_run_summary", """SELECT v.video_id, coalesce(w, 0) AS workers, n AS frames_processed,
  coalesce(peak_concurrency, 0) AS peak_concurrency
  FROM (SELECT video_id, count(DISTINCT frame_idx) AS n FROM f GROUP BY 1) v
  LEFT JOIN (SELECT video_id, count(*) AS w FROM ff GROUP BY 1) r ON r.video_id = v.video_id
  LEFT JOIN peak ON peak.video_id = v.video_id""", "linked")
def _(t):
    return A.run_summary(t.report, t.frames, K.peak_concurrency(t.meta))


# ================================================================== windows and ordered state


@query("win_displacement", f"""SELECT obs_id, {O.r('sqrt((ax-px)^2 + (ay-py)^2)', 4)} AS disp FROM (
  SELECT obs_id, ax, ay, last_value(ax IGNORE NULLS) OVER w AS px, last_value(ay IGNORE NULLS) OVER w AS py FROM points
  WINDOW w AS (PARTITION BY video_id, raw_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def _(t):
    return Fr.displacement(Fr.pose_frames(t.poses)).select("obs_id", *rounded("disp"))


@query("win_walk_run", """SELECT event_id, CAST(CASE WHEN moving THEN rn - coalesce(max(CASE WHEN NOT moving THEN rn END)
  OVER (PARTITION BY video_id, worker_id ORDER BY rn ROWS UNBOUNDED PRECEDING), 0) ELSE 0 END AS BIGINT) AS run
  FROM lab_worker_id_0""")
def _(t):
    return Fr.walk_run(t.frames, "worker_id").select("event_id", "run")


@query("win_smooth_vote", "SELECT event_id, raw_label, label FROM lab_worker_id")
def _(t):
    return t.labelled.select("event_id", "raw_label", "label")


_BO = ["label", "start_time", "end_time", "duration", "start_frame", "end_frame", "avg_disp"]


def _bout_sql(block: str, extra: str = "") -> str:
    return (f"SELECT video_id, worker_id, label, {O.r('s', 4)} AS start_time, {O.r('e', 4)} AS end_time, dur AS duration, "
            f"sf AS start_frame, ef AS end_frame, {O.r('avd', 4)} AS avg_disp{extra} FROM {block}")


def _bout_cols(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(*VW, "label", *rounded("start_time", "end_time"), "duration", "start_frame", "end_frame",
                     *rounded("avg_disp"), *extra)


@query("win_islands", _bout_sql("rb"))
def _(t):
    return _bout_cols(t.raw_bouts)


@query("win_absorb_short", _bout_sql("ab"))
def _(t):
    return _bout_cols(B.absorb_short(t.raw_bouts))


@query("win_merge_adjacent", _bout_sql("mg"))
def _(t):
    return _bout_cols(B.merge_adjacent(B.absorb_short(t.raw_bouts)))


@query("win_rest", "SELECT video_id, worker_id, label, sf AS start_frame, is_rest FROM bouts")
def _(t):
    return t.bouts.select(*VW, "label", "start_frame", "is_rest")


@query("segment", _bout_sql("bouts", ", is_rest"))
def _(t):
    return _bout_cols(B.segment(t.labelled), "is_rest")


@query("win_moving_avg", f"SELECT video_id, worker_id, frame_idx, {r4('sx', 'sy')} FROM sm")
def _(t):
    return TR.moving_avg(t.frames).select(*VW, "frame_idx", *rounded("sx", "sy"))


@query("fold_trips", f"""SELECT video_id, worker_id, {O.r('q_t0', 4)} AS start_time, {O.r('q_t1', 4)} AS end_time,
  {O.r('q_x0', 4)} AS start_x, {O.r('q_x1', 4)} AS end_x, {O.r('q_d', 1)} AS distance, {O.r('q_dir', 1)} AS direction
  FROM fold WHERE hit""")
def _(t):
    return TR.trips(t.smoothed).select(*VW, *rounded("start_time", "end_time", "start_x", "end_x"), "distance",
                                       "direction")


@query("count_trips", "SELECT video_id, worker_id, trip_count, path_px FROM trips")
def _(t):
    return TR.count_trips(t.frames)


@query("fold_stitch", "SELECT video_id, raw_id, root_raw AS root FROM ids")
def _(t):
    links = K.nearest_successors(t.meta)
    return K.chains(t.meta, links).select("video_id", "raw_id", "root")


@query("rank_clusters", "SELECT video_id, raw_id, unified_id, worker_frames FROM ids")
def _(t):
    return t.ids.select("video_id", "raw_id", "unified_id", "worker_frames")


# ================================================================== signals


@query("sig_fill_gaps", f"SELECT video_id, worker_id, joint, pos, {O.r('v', 4)} AS value FROM fill")
def _(t):
    return t.filled.select(*VW, "joint", "pos", *rounded("value"))


@query("sig_detrend", f"SELECT video_id, worker_id, joint, pos, {O.r('z', 6)} AS value FROM flat0")
def _(t):
    return SG.detrend(t.filled).select(*VW, "joint", "pos", *rounded("value", k=6))


@query("sig_peaks", "SELECT video_id, worker_id, joint, pos FROM pk")
def _(t):
    return t.peaks.select(*VW, "joint", "pos")


_RES = "freq_hz", "cpm", "confidence"


@query("sig_peak_rate", f"SELECT video_id, worker_id, joint, peak_count, {r4(*_RES)}, is_repetitive FROM pr")
def _(t):
    return t.rates[0].select(*VW, "joint", "peak_count", *rounded(*_RES), "is_repetitive")


@query("sig_spectrum", f"SELECT video_id, worker_id, joint, {r4(*_RES)}, is_repetitive FROM sp")
def _(t):
    return t.rates[1].select(*VW, "joint", *rounded(*_RES), "is_repetitive")


@query("sig_combine", f"SELECT video_id, worker_id, joint, peak_count, {r4(*_RES)}, is_repetitive FROM cb")
def _(t):
    return SG.combine(*t.rates).select(*VW, "joint", "peak_count", *rounded(*_RES), "is_repetitive")


@query("sig_repetition", f"SELECT video_id, worker_id, joint, peak_count, {r4(*_RES)}, is_repetitive FROM cb")
def _(t):
    return SG.repetition(t.frames).select(*VW, "joint", "peak_count", *rounded(*_RES),
                                                           "is_repetitive")


_BEST = ["primary_joint", "freq_hz", "cycles_per_minute", "peak_count", "confidence", "is_repetitive"]


@query("sig_best_joint", f"""SELECT video_id, worker_id, primary_joint, {r4('freq_hz', 'cycles_per_minute')}, peak_count,
  {r4('confidence')}, is_repetitive FROM best""")
def _(t):
    best = SG.best_joint(SG.combine(*t.rates), A.min_records(t.frames))
    return best.select(*VW, "primary_joint", *rounded("freq_hz", "cycles_per_minute"), "peak_count",
                       *rounded("confidence"), "is_repetitive")


# ================================================================== scores

_RF = [*_PARTS, "score_a", "score_b", "final_score"]


@query("reba_frame", f"SELECT event_id, {', '.join(_RF)}, {O.level('final_score', T.REBA_LEVELS, 2)} AS risk_level FROM reba")
def _(t):
    return SC.reba_frame(t.frames).select("event_id", *_RF, "risk_level")


@query("reba_worker", f"""SELECT video_id, worker_id, p90_score, {', '.join(_PARTS)}, score_a, score_b,
  {O.level('p90_score', T.REBA_LEVELS, 2)} AS risk_level FROM rw""")
def _(t):
    return SC.reba_worker(t.frames).select(*VW, "p90_score", *_PARTS, "score_a", "score_b", "risk_level")


_P = "(n-1)*0.9e0 - floor((n-1)*0.9e0)"


@query("agg_rollup", f"""SELECT level, site, video_id, worker_id, n_workers, n_frames,
  {', '.join(f"{O.r(f'_{v}/n*100e0', 1)} AS {v}_pct" for v in T.LABELS)}, max_score, p90_score, {O.level('p90_score', T.REBA_LEVELS, 2)} AS risk_level
  FROM (SELECT *, n AS n_frames, greatest(1, least(15, CAST(floor(CASE WHEN t >= 0.5e0 THEN hi - (hi-lo)*(1e0-t) ELSE lo + (hi-lo)*t END)
      AS INTEGER))) AS p90_score
    FROM (SELECT *, {_P} AS t, CAST(a[CAST(floor((n-1)*0.9e0) AS BIGINT)+1] AS DOUBLE) AS lo,
        CAST(a[least(n, CAST(floor((n-1)*0.9e0) AS BIGINT)+2)] AS DOUBLE) AS hi
      FROM (SELECT CASE WHEN grouping(worker_id) = 0 THEN 'worker' WHEN grouping(video_id) = 0 THEN 'video'
            WHEN grouping(site) = 0 THEN 'site' ELSE 'all' END AS level, site, video_id, worker_id, count(*) AS n,
          count(DISTINCT video_id * 1000000 + worker_id) AS n_workers, max(final_score) AS max_score,
          {', '.join(f"count(*) FILTER (label = '{v}') AS _{v}" for v in T.LABELS)}, list(final_score ORDER BY final_score) AS a
        FROM (SELECT *, video_id % 4 AS site FROM reba)
        GROUP BY GROUPING SETS ((site, video_id, worker_id), (site, video_id), (site), ())) WHERE n > 0))""")
def _(t):
    sites = t.videos.select("video_id", (F.col("video_id") % 4).alias("site"))
    return RU.rollup(RU.score_counts(SC.reba_frame(t.labelled)), sites)


_RU = {"upper_arm_score": "ru_arm", "lower_arm_score": "ru_low", "wrist_score": "ru_wrist", "score_a": "ra",
       "neck_score": "ru_neck", "trunk_score": "ru_trunk", "legs_score": "ru_legs", "score_b": "rb"}
_RUS = ", ".join(f"{b} AS {a}" for a, b in _RU.items())


@query("rula_frame", f"""SELECT event_id, {_RUS}, final_score, {O.level('final_score', T.RULA_LEVELS, 2)} AS action_level
  FROM wf_rula""")
def _(t):
    return SC.rula_frame(t.frames).select("event_id", *_RU, "final_score", "action_level")


@query("rula_worker", f"""SELECT video_id, worker_id, p90_score, {_RUS}, {O.level('p90_score', T.RULA_LEVELS, 2)} AS action_level
  FROM ruw""")
def _(t):
    return SC.rula_worker(t.frames).select(*VW, "p90_score", *_RU, "action_level")


_NF = "radians(greatest(0e0, coalesce(trunk, 0)))"
_NW = "greatest(0.5e0, k/3e0)"
_NH = "(20e0 + event_id%50)"
_NRWL = "*".join([
    "23e0", f"(25/{O.clip(_NH, '25e0', '63e0')})",
    f"(1 - 0.003e0*abs({O.clip('(event_id*7)%190', '0e0', '175e0')} - 75))",
    f"(0.82e0 + 4.5e0/{O.clip('(event_id*3)%200', '25e0', '175e0')})",
    f"(1 - 0.0032e0*{O.clip('event_id%150', '0e0', '135e0')})",
    "(CASE WHEN event_id%8 <= 0 THEN 1e0 WHEN event_id%8 <= 1 THEN 0.94e0 WHEN event_id%8 <= 4 THEN 0.84e0 ELSE 0.72e0 END)",
    "0.95e0"])
_NFORCE = (f"(42e0*9.81e0*(0.20e0*sin({_NF}) + 0.05e0) + {_NW}*9.81e0*({_NH}/100*sin({_NF}) + 0.15e0))/0.05e0"
           f" + (42e0 + {_NW})*9.81e0*cos({_NF})")


@query("niosh", f"""SELECT event_id, rwl_kg, lifting_index, compression_n, compression_n > 3400 AS compression_exceeded,
  CASE WHEN lifting_index <= 1 AND NOT compression_n > 3400 THEN {O.q(T.LIFT_LOW[0])} WHEN lifting_index <= 2
    AND compression_n <= 4000 THEN {O.q(T.LIFT_MODERATE[0])} ELSE {O.q(T.LIFT_HIGH[0])} END AS lift_risk
  FROM (SELECT *, {O.r(f'{_NW}/rwl_kg', 2)} AS lifting_index FROM (
   SELECT event_id, k, greatest(0.5e0, {O.r(_NRWL, 2)}) AS rwl_kg, {O.r(_NFORCE, 1)} AS compression_n FROM f))""")
def _(t):
    e = F.col("event_id")
    d = lambda c: c.cast("double")
    out = SC.niosh(t.frames, F.col("k") / dbl(3), F.coalesce("trunk", dbl(0)), d(e % 50) + 20.0, d(e * 7 % 190),
                   d(e * 3 % 200), d(e % 150), d(e % 8))
    return out.select("event_id", "rwl_kg", "lifting_index", "compression_n", "compression_exceeded", "lift_risk")


def report_query(name: str, cols: list[str], sql_cols: list[str] | None = None) -> None:
    """A query over the columns of the full worker report."""

    @query(name, f"SELECT video_id, worker_id, {', '.join(sql_cols or cols)} FROM rep", "linked")
    def _(t):
        return t.report.select(*VW, *cols)


report_query("niosh_worker", ["rwl_kg", "lifting_index", "compression_n", "compression_exceeded", "lift_risk", "lift_advice"])
report_query("adi_pillars", ["postural", "repetition", "work_rest", "load", "arm"])
report_query("adi_index", ["drudgery_index", "drudgery_category"])
report_query("adi_fatigue", ["drudgery_index", "fatigue_level"])
report_query("task_class", ["task", "task_confidence", "task_description", "task_hazard"])
report_query("hourly", ["scaling_factor", *[f"{p}_{s}" for p in S.HOURLY_PARTS for s in ("1hr", "hms_1hr", "share_1hr")],
                        "rest_count_1hr", "active_1hr", "active_hms_1hr", "cycles_1hr", "load_events_1hr", "trips_1hr",
                        "arm_above_45_1hr", "arm_above_90_1hr"])

_WIDE = ["n_frames", "tracked_s", *_PT, "severe_bending_s", *_ST, "sh45_pct", "sh90_pct", "sh45_s", "sh90_s", "arm_risk",
         "dominant_posture", *_WR, *[f"{v}_pct" for v in T.LABELS], "primary_joint", "is_repetitive", "trip_count",
         "path_px", "load_events", "reba_score", "reba_level", "rula_score", "rula_level", "drudgery_index",
         "drudgery_category", "fatigue_level", "rwl_kg", "lifting_index", "compression_n", "lift_risk", "task",
         "task_confidence", "iso_violated", "iso_message"]
report_query("worker_report", _WIDE)


@query("join_worker_report", "SELECT video_id, worker_id, tracked_s, tools_text, load_events, trip_count, reba_score, "
       "rula_score, dominant_posture FROM rep", "linked")
def _(t):
    return t.report.select(*VW, "tracked_s", F.array_join("tools", ", ").alias("tools_text"), "load_events",
                           "trip_count", "reba_score", "rula_score", "dominant_posture")


@query("adi_fatigue_curve", f"""SELECT video_id, worker_id, m AS minute,
  {O.r('fatigue_level*(1 - exp(-2.5e0*(m/n)))', 1)} AS fatigue
  FROM (SELECT *, unnest(range(1, n+1)) AS m FROM (
    SELECT video_id, worker_id, fatigue_level, greatest(1, CAST(ceil(tracked_s/60) AS BIGINT)) AS n FROM rep))""", "linked")
def _(t):
    return SC.fatigue_curve(t.report)


@query("adi_recommend", "SELECT video_id, worker_id, advice_text, first_advice FROM rep", "linked")
def _(t):
    return t.report.select(*VW, F.array_join("advice", " | ").alias("advice_text"),
                           F.element_at("advice", 1).alias("first_advice"))


@query("iso_exposure", f"SELECT video_id, worker_id, {O.r('iso_minutes', 4)} AS iso_minutes, iso_violated, iso_message FROM rep",
       "linked")
def _(t):
    return t.report.select(*VW, *rounded("iso_minutes"), "iso_violated", "iso_message")


_UN = "SELECT video_id, worker_id, unnest([{}], recursive := true) FROM rep"


def _row_sql(rows: list[dict[str, str]]) -> str:
    return _UN.format(", ".join("{" + ", ".join(f"'{k}': {v}" for k, v in r.items()) + "}" for r in rows))


def _timed(no: str, name: str, part: str, extra: str = "") -> dict[str, str]:
    pct = O.r(f"{part}_s/greatest(1, tracked_s)*100", 1)
    return {"no": O.q(no), "parameter": O.q(name),
            "value": f"{part}_s || 's (' || {pct} || '%) | Reps: ' || {part}_reps{extra}"}


def _plain(no: str, name: str, value: str) -> dict[str, str]:
    return {"no": O.q(no), "parameter": O.q(name), "value": value}


def _or(c: str) -> str:
    return f"coalesce({c}::VARCHAR, 'None')"


@query("param_table", _row_sql([
    _timed("1", "Sitting Duration & Reps", "sitting"), _timed("1b", "Squatting Duration & Reps", "squatting"),
    _timed("2", "Standing Duration & Reps", "standing"),
    _timed("3", "Bending Duration & Reps", "bending", " || ' (Severe: ' || severe_bending_s || 's)'"),
    _timed("4", "Walking Duration", "walking"),
    _plain("5", "Load Carried", "load_events || ' carrying events detected'"),
    _plain("6", "Repetitive Movement", "CASE WHEN is_repetitive THEN cycles_per_minute || ' cycles/min on ' || primary_joint "
           "|| ' (' || freq_hz || ' Hz)' ELSE 'None detected' END"),
    _plain("7", "Number of Trips", "trip_count || ' trips (' || path_px || ' px travel)'"),
    _plain("8", "Tools/Equipment Used", "CASE WHEN len(tools) > 0 THEN tools_text ELSE 'None detected' END"),
    _plain("9", "Posture & Angles (Trunk & Arms)", f"'Trunk: ' || {_or('avg_trunk')} || '° | Shoulder Elv: ' || "
           f"{_or('avg_shoulder')} || '° | Elbow: ' || {_or('avg_elbow')} || '° | Knee: ' || {_or('avg_knee')} || '°'"),
    _plain("10", "Continuous Work Duration", "'Longest: ' || longest_work_s || 's | Avg: ' || avg_work_s || 's (' || "
           "work_bouts || ' bouts)'"),
    _plain("11", "Rest Duration & Pauses", "'Total Rest: ' || rest_s || 's across ' || rest_count || ' rest periods'"),
]), "linked")
def _(t):
    return R.param_table(t.report)


def _hour(name: str, part: str, entries: str) -> dict[str, str]:
    return {"activity": O.q(name), "sampled": f"{part}_s || 's'", "per_hour": f"{part}_hms_1hr",
            "share": f"{part}_share_1hr || '%'", "entries": entries}


@query("hourly_table", _row_sql([
    _hour("1. Sitting", "sitting", "sitting_reps::VARCHAR"), _hour("1b. Squatting", "squatting", "squatting_reps::VARCHAR"),
    _hour("2. Standing", "standing", "standing_reps::VARCHAR"),
    _hour("3. Bending (Stooping)", "bending", "bending_reps::VARCHAR"),
    _hour("4. Walking", "walking", "walking_reps::VARCHAR"),
    {"activity": "'5. Carried Load Events'", "sampled": "load_events || ' events'",
     "per_hour": "load_events_1hr || ' events/hr'", "share": "'N/A'", "entries": "load_events::VARCHAR"},
    _hour("7. Work Pause (Rest)", "rest", "rest_count_1hr || ' pauses/hr'"),
    {"activity": "'Active Work Session'", "sampled": f"{O.r('tracked_s - rest_s', 1)} || 's'",
     "per_hour": "active_hms_1hr", "share": f"{O.r('100 - rest_share_1hr', 1)} || '%'", "entries": "''"},
]), "linked")
def _(t):
    return R.hourly_table(t.report)


@query("angle_table", _row_sql([
    {"angle": "'Trunk Flexion (Torso Bending)'", "measured": f"'Avg: ' || {_or('avg_trunk')} || '° | Peak: ' || {_or('max_trunk')} || '°'",
     "standard": "'ISO 11226 Limit: <60° (<4 min/shift)'"},
    {"angle": "'Knee Flexion Angle'", "measured": f"'Avg: ' || {_or('avg_knee')} || '°'",
     "standard": "'Stoop: >140° | Deep Squat: <90°'"},
    {"angle": "'Shoulder Upper Arm Elevation'",
     "measured": f"'Avg: ' || {_or('avg_shoulder')} || '° | Peak: ' || {_or('max_shoulder')} || '°'",
     "standard": "'Time >45°: ' || sh45_pct || '% | >90°: ' || sh90_pct || '%'"},
    {"angle": "'Elbow Flexion Angle'", "measured": f"'Avg: ' || {_or('avg_elbow')} || '°'",
     "standard": "'Neutral: 60°–100° (REBA Table B)'"},
]), "linked")
def _(t):
    return R.angle_table(t.report)


@query("scorecard", """SELECT video_id, worker_id, reba_score AS reba, reba_level, rula_score AS rula, drudgery_index,
  drudgery_index AS drudgery_pct, drudgery_category, compression_n, arm_risk, sh45_pct FROM rep""", "linked")
def _(t):
    return R.scorecard(t.report)


@query("rank_leaderboard", """SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY drudgery_index DESC, worker_id)
  AS place, worker_id, task, reba_score || ' (' || reba_level || ')' AS reba_risk, rula_score::VARCHAR AS rula_risk,
  drudgery_index || ' / 100' AS drudgery, compression_n || ' N' AS compression,
  upper(dominant_posture[1]) || dominant_posture[2:] AS posture FROM rep""", "linked")
def _(t):
    return R.leaderboard(t.report)


@query("top_risk_workers", """SELECT video_id, worker_id, drudgery_index FROM rep
  ORDER BY drudgery_index DESC, video_id, worker_id LIMIT 10""", "linked")
def _(t):
    return R.top_risk_workers(t.report, 10)


@query("bout_timeline", f"""SELECT video_id, worker_id, upper(label[1]) || label[2:] AS activity, {O.r('s', 4)} AS start_time,
  {O.r('e', 4)} AS end_time, dur AS duration, CASE WHEN is_rest THEN 'Rest' ELSE 'Work' END AS kind FROM bouts""")
def _(t):
    return R.bout_timeline(t.bouts).select(*VW, "activity", *rounded("start_time", "end_time"), "duration", "kind")


# ================================================================== sinks


def _share_sql(p: str) -> str:
    return f"CASE WHEN tracked_s > 0 THEN {O.r(f'{p}_s/tracked_s*100', 1)} ELSE 0e0 END"


@query("sink_csv", "SELECT v.name AS \"Video File\", worker_id AS \"Worker ID\", tracked_s AS \"Total Tracked Time (s)\", "
       + ", ".join(f"{p}_s AS \"{p.title()} Duration (s)\", {_share_sql(p)} AS \"{p.title()} %\""
                   for p in ("sitting", "standing", "bending", "walking"))
       + """, load_events AS "Load Events", CASE WHEN is_repetitive THEN cycles_per_minute::VARCHAR ELSE 'N/A' END
  AS "Repetitive (cycles/min)", trip_count AS "Trip Count", dominant_posture AS "Dominant Posture",
  coalesce(avg_trunk::VARCHAR, '') AS "Avg Trunk Flexion (°)", coalesce(max_trunk::VARCHAR, '') AS "Max Trunk Flexion (°)",
  longest_work_s AS "Longest Work Bout (s)", avg_work_s AS "Avg Work Bout (s)", rest_s AS "Total Rest Duration (s)",
  rest_count AS "Rest Count", avg_rest_s AS "Avg Rest Duration (s)",
  CASE WHEN len(tools) > 0 THEN tools_text ELSE 'None' END AS "Tools Detected", reba_score::VARCHAR AS "REBA Score",
  reba_level AS "Risk Level" FROM rep LEFT JOIN vid v ON v.video_id = rep.video_id""", "linked")
def _(t):
    path, table = staging_path(t.spark), R.csv_table(t.report, t.videos)
    sinks.write_csv(t.report, t.videos, path)
    return sinks.read_csv(t.spark, table, path)


_JSON = {
    "filename": ("$.video_info.filename", "v.name"), "worker": ("$.worker_id", "worker_id::VARCHAR"),
    "tracked_hms": ("$.total_tracked_time_formatted", O.hms_t("tracked_s")),
    "bend_hms": ("$.parameters.3_bending.duration_formatted", O.hms_t("bending_s")),
    "bend_pct": ("$.parameters.3_bending.percentage", f"({_share_sql('bending')})::VARCHAR"),
    "loads": ("$.parameters.5_load_carried.total_events", "load_events::VARCHAR"),
    "trips": ("$.parameters.7_trips.count", "trip_count::VARCHAR"),
    "posture": ("$.parameters.9_posture.dominant_posture", "dominant_posture"),
    "reps": ("$.parameters.9_posture.reps.walking_reps", "walking_reps::VARCHAR"),
    "arm": ("$.parameters.arm_postural_study.arm_postural_risk", "arm_risk"),
    "hour_active": ("$.standardised_1hr_activity.active_work_formatted", "active_hms_1hr"),
    "reba": ("$.ergonomic_score.reba_score", "reba_score::VARCHAR"),
    "adi": ("$.drudgery_assessment.drudgery_index", "drudgery_index::VARCHAR"),
    "task": ("$.task_classification.primary_task", "task"),
    "iso": ("$.shift_assessment.iso_11226_message", "iso_message"),
}


@query("sink_json", "SELECT " + ", ".join(f"{v} AS {k}" for k, (_, v) in _JSON.items())
       + " FROM rep LEFT JOIN vid v ON v.video_id = rep.video_id", "linked")
def _(t):
    path = staging_path(t.spark)
    sinks.write_nested_json(t.report, t.videos, W.report_series(t.run)["activity_timeline"], path)
    fields = {k: F.get_json_object("document", place) for k, (place, _) in _JSON.items() if k != "filename"}
    return sinks.read_nested_json(t.spark, path).select("filename", *[c.alias(k) for k, c in fields.items()])


@query("sink_partitioned", "SELECT video_id, worker_id, tracked_s, task FROM rep", "linked")
def _(t):
    path = staging_path(t.spark)
    rows = t.report.drop("distribution")
    sinks.write_partitioned(rows, path)
    sinks.write_partitioned(rows.where("video_id % 3 = 0"), path)  # some videos again
    return sinks.read_partitioned(t.spark, path).select(F.col("video_id").cast("long"), "worker_id", "tracked_s", "task")


# ================================================================== streaming


@query("stream_posture", "SELECT video_id, raw_id, frame_idx, raw_label, label FROM lab_raw_id")
def _(t):
    """The frames as a file stream: up to 24 seconds late and out of order, in twelve micro-batches."""
    rows = t.frames.select("video_id", "raw_id", "frame_idx", "ts", "trunk", "hip", "knee", "disp", "conf", "event_id")
    late = F.col("ts") + F.pmod(F.col("event_id") * 37, F.lit(240)) / 10.0
    return _streamed(t, rows, late, 24, "ts", lambda df, wait: ST.stream_posture(df, lateness=wait)).select(
        "video_id", "raw_id", "frame_idx", "raw_label", "label")


def _streamed(t, rows: DataFrame, at: Column, late_s: float, ts: str, run) -> DataFrame:
    """Play a table as a stream whose rows are at most ``late_s`` later than their time; a micro-batch holds one slice."""
    source, wait = staging_path(t.spark), late_s + RP.slice_width(rows, at) + 1
    RP.deliver(rows, at, source)
    return RP.play(t.spark, source, rows.schema, staging_path(t.spark), lambda df: run(df, f"{int(wait) + 1} seconds"), ts, 4)[0]


@query("stream_exposure_5min", "SELECT video_id, worker_id, CAST(epoch(time_bucket(INTERVAL '5 minutes', tm)) AS BIGINT) "
       "AS window_start, count(*) AS n_frames, " + ", ".join(
           f"{O.r(f'(count(*) FILTER (label = {O.q(v)}))/count(*)*100e0', 1)} AS {v}_pct" for v in T.LABELS)
       + """ FROM (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(frame_idx AS BIGINT)) AS tm FROM lab_worker_id)
  GROUP BY 1, 2, 3""")
def _(t):
    """The labelled frames as a file stream: up to four minutes late, and every seventh frame twice."""
    start = F.timestamp_seconds(F.lit(1704067200))  # 2024-01-01 00:00:00 UTC
    timed = t.labelled.select("video_id", "worker_id", "frame_idx", "label", "event_id", ST.event_time(F.col("frame_idx").cast("double"), start)
                              .alias("event_time"))
    rows = timed.withColumn("again", F.lit(0)).unionByName(timed.where("event_id % 7 = 0").withColumn("again", F.lit(300)))
    late = F.unix_seconds("event_time") + F.pmod(F.col("event_id") * 37, F.lit(240)) + F.col("again")
    out = _streamed(t, rows, late.cast("double"), 540, "event_time",
                    lambda df, wait: ST.exposure_5min(df, lateness=wait, frame="frame_idx"))
    return out.withColumn("window_start", F.unix_seconds("window_start"))


_tables: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _tables:
        _tables[key] = Tables(spark, sf_dir)
    return _tables[key]


def forget() -> None:
    """Derive everything anew, as for a measurement; intermediate tables are deleted."""
    for known in _tables.values():
        drop_staged(known.spark)
    _tables.clear()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, fn=fn: fn(tables(spark, sf_dir))) for name, fn in QUERIES.items()}
