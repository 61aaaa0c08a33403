"""Per-frame state of a tracked person: displacement, walking run, smoothed posture label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postura import tables as T
from postura.config import DEFAULTS, Thresholds
from postura.functions import geometry as G
from postura.functions.numeric import dbl
from postura.functions.posture import posture_raw
from postura.operators.ordered import Series, chunk_of, drop_halo, scan, with_halo


def tracks(key: str = "raw_id") -> Series:
    return Series(keys=("video_id", key), order=("ts", "frame_idx"))


def with_chunk(df: DataFrame, limits: Thresholds = DEFAULTS, ts: str = "ts") -> DataFrame:
    return df.withColumn("chunk", chunk_of(F.col(ts), limits.chunk_s))


def displacement(df: DataFrame, key: str = "raw_id", ankle: str = "ankle", limits: Thresholds = DEFAULTS) -> DataFrame:
    """Adds ``disp``: distance of the ankle point from the last valid one, however many frames ago that was.

    For the displacement alone; ``classify`` takes it along in its own pass.
    """
    here = df.columns
    seen = scan(with_chunk(df, limits), tracks(key), before={"_prev_ankle": F.col(ankle)})
    now, prev = G.point(F.col(ankle)), G.point(F.col("_prev_ankle"))
    return seen.select(*here, (now - prev).norm().alias("disp"))


def walking_flag(s: Series, limits: Thresholds = DEFAULTS) -> Column:
    """True from the n-th consecutive moving frame on; a missing displacement ends the run."""
    n = limits.walk_frames
    recent = s.window().rowsBetween(-(n - 1), 0)
    moving = F.coalesce(F.col("disp") > limits.walk_px, F.lit(False)).cast("int")
    return F.sum(moving).over(recent) == n


def _vote(s: Series, limits: Thresholds) -> Column:
    """Confidence-weighted majority of the last frames; a tie goes to the label seen first among them."""
    recent = s.window().rowsBetween(-(limits.vote_frames - 1), 0)
    weight = F.greatest(dbl(0.1), F.col("frame_conf"))
    bids = []
    for label in T.LABELS:
        mine = F.col("raw_label") == label
        total = F.sum(F.when(mine, weight)).over(recent)
        first = F.min(F.when(mine, F.col("_pos"))).over(recent)
        bids.append(F.when(total.isNotNull(), F.struct(total.alias("w"), (-first).alias("age"),
                                                       F.lit(label).alias("label"))))
    return F.greatest(*bids)["label"]


def classify(df: DataFrame, key: str = "raw_id", limits: Thresholds = DEFAULTS) -> DataFrame:
    """Frames (trunk, hip, knee, conf[, hips_low] and disp or ankle) → disp, walking, raw_label, frame_conf, label.

    One shuffle of the frames by (video, track, time slice). Each slice also receives the few rows before it that the
    walking run and the vote look back at and, where the displacement is still to be taken from the ankle point, as many
    earlier rows with a valid one: at least one of those lies before every copied row.
    """
    s = tracks(key)
    cols = [c for c in df.columns if c != "ankle"]
    from_ankle = "disp" not in df.columns
    if "hips_low" not in df.columns:
        df = df.withColumn("hips_low", F.lit(False))
    look_back = limits.vote_frames - 1 + limits.walk_frames - 1
    needs = ["trunk", "hip", "knee", "conf", "hips_low", "ankle" if from_ankle else "disp"]
    rows = with_halo(with_chunk(df, limits), s, back=look_back, carry=needs,
                     back_known=("ankle", look_back + 1) if from_ankle else None)
    if from_ankle:
        seen = F.last("ankle", ignorenulls=True).over(s.window().rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_seen", seen)
        rows = rows.withColumn("disp", (G.point(F.col("ankle")) - G.point(F.col("_seen"))).norm())
        cols = [*cols, "disp"]
    walked = rows.withColumn("walking", walking_flag(s, limits)).withColumn("_pos", F.row_number().over(s.window()))
    raw = walked.withColumn("_raw", posture_raw(F.col("trunk"), F.col("hip"), F.col("knee"), F.col("walking"),
                                                F.col("hips_low"), limits))
    ruled = raw.select("*", F.col("_raw")["label"].alias("raw_label"),
                       (F.col("_raw")["conf"] * F.col("conf")).alias("frame_conf"))
    voted = ruled.withColumn("label", _vote(s, limits))
    return drop_halo(voted).select(*cols, "walking", "raw_label", "frame_conf", "label")


def walk_run(df: DataFrame, key: str = "raw_id", limits: Thresholds = DEFAULTS) -> DataFrame:
    """Adds ``run``: length so far of the current run of moving frames (0 where not moving)."""
    cols = df.columns
    moving = F.coalesce(F.col("disp") > limits.walk_px, F.lit(False))
    numbered = scan(with_chunk(df, limits), tracks(key), count="_n")
    still = scan(numbered, tracks(key), before={"_still": F.when(~moving, F.col("_n"))})
    return still.select(*cols, F.when(moving, F.col("_n") - F.coalesce("_still", F.lit(0)))
                        .otherwise(F.lit(0)).cast("long").alias("run"))


def pose_frames(pose_obs: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Observation rows with keypoints → the canonical frame table (angles, centroid, ankle point, confidence).

    Expressions only: one pass over the observations without a shuffle.
    """
    keep = [c for c in pose_obs.columns if c not in ("keypoints", "conf")]
    p = G.Pose(limits)
    base = pose_obs.where(F.col("raw_id").isNotNull()).withColumn("_conf", G.mean_kp_conf(F.col("conf"), limits))
    flat = G.unroll(base, [*keep, "_conf"], limits)
    points = flat.withColumns({"ankle": G.ankle_point(p), "_centre": G.centroid(p), "hips_low": G.hips_low(p)})
    angles = G.joint_angles(points, [*keep, "_conf", "ankle", "_centre", "hips_low"], limits)
    pick = {part: G.side_pick(F.col(f"left_{part}"), F.col(f"right_{part}")) for part in ("elbow", "wrist", "shoulder")}
    return angles.select(
        *keep, "trunk", "neck", F.col("avg_hip").alias("hip"), F.col("avg_knee").alias("knee"),
        *[c.alias(n) for n, c in pick.items()],
        F.col("max_shoulder").alias("shoulder_high"), F.col("avg_elbow").alias("elbow_mean"),
        G.mean_of(F.col("left_wrist"), F.col("right_wrist")).alias("wrist_mean"),
        F.col("_centre.x").alias("x"), F.col("_centre.y").alias("y"),
        F.col("_conf").alias("conf"), "hips_low", "ankle",
    )
