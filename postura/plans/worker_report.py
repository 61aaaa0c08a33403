"""The whole analysis: frames and detections in, one wide row per worker out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postura.config import DEFAULTS, Thresholds
from postura.functions.numeric import dbl, rnd
from postura.operators import aggregates as A
from postura.operators import association as J
from postura.operators import bouts as B
from postura.operators import scoring as SC
from postura.operators import signals as G
from postura.operators import tracklets as K
from postura.operators import trips as T
from postura.operators.frames import classify
from postura.operators.ordered import stage, stage_together
from postura.sources.observation import work_objects


@dataclass
class Analysis:
    """Tables of one run; each is written once and read by several steps."""

    frames: DataFrame      # labelled frames with worker_id
    ids: DataFrame         # raw_id → unified_id
    near: DataFrame        # objects near a worker
    bouts: DataFrame
    facts: DataFrame       # frame statistics per worker
    repetition: DataFrame
    trips: DataFrame
    reba: DataFrame


def analyse(frames: DataFrame, detections: DataFrame, limits: Thresholds = DEFAULTS) -> Analysis:
    """Labels per raw track and re-linked ids, then everything that needs only the labelled frames."""
    if "ankle" in frames.columns:  # straight from keypoints: read those once
        frames = stage(frames)
    first = stage_together(ids=lambda: K.stitch(frames, limits), labels=lambda: classify(frames, "raw_id", limits))
    labelled = stage(J.unify_ids(first["labels"], first["ids"]))
    objects = work_objects(detections, limits)
    parts = stage_together(
        near=lambda: J.objects_of_persons(labelled, objects, limits, keep=("raw_id", "worker_id")),
        bouts=lambda: B.segment(labelled, "worker_id", limits),
        facts=lambda: A.frame_facts(labelled, limits=limits),
        repetition=lambda: G.best_joint(G.repetition(labelled, limits=limits), A.min_records(labelled, limits=limits)),
        trips=lambda: T.count_trips(labelled, limits=limits),
        reba=lambda: SC.reba_worker(labelled))
    return Analysis(labelled, first["ids"], **parts)


def assemble(run: Analysis) -> DataFrame:
    """Left joins of the per-worker parts, all on (video, worker), then the derived measures."""
    on = ["video_id", "worker_id"]
    rula = SC.rula_worker_pipeline(run.frames, run.repetition)
    parts = [
        A.bout_facts(run.bouts), A.label_facts(run.bouts), run.repetition, run.trips, A.tools_of_worker(run.near),
        A.load_events(run.near),
        run.reba.select(*on, F.col("p90_score").alias("reba_score"), F.col("risk_level").alias("reba_level")),
        rula.select(*on, F.col("p90_score").alias("rula_score"), F.col("action_level").alias("rula_level")),
    ]
    wide = run.facts
    for part in parts:
        wide = wide.join(part, on, "left")
    wide = stage(wide)
    c = F.col
    no_use = F.array().cast(dict(wide.dtypes)["tool_usage"])
    wide = wide.withColumns({
        "load_events": F.coalesce("load_events", F.lit(0)), "trip_count": F.coalesce("trip_count", F.lit(0)),
        "tools": F.coalesce("tools", F.array().cast("array<string>")), "tool_usage": F.coalesce("tool_usage", no_use),
        "severe_bending_s": A.severe_seconds(c("severe_frames"), c("n_frames"), c("tracked_s"))})
    wide = A.with_arm_exposure(wide.withColumn(
        "severe_pct", rnd(c("severe_bending_s") / F.greatest(dbl(1), c("tracked_s")) * 100.0, 1)))
    wide = SC.hourly(SC.drudgery(wide))
    lifted = F.when(c("load_events") > 0, dbl(5)).otherwise(dbl(0.5))
    wide = SC.niosh(wide, lifted, F.coalesce("avg_trunk", dbl(0)))
    return SC.iso_exposure(SC.classify_task(wide)).withColumns({
        p: rnd(c(p), 1) for p in ("postural", "repetition", "work_rest", "load", "arm")})


def worker_report(frames: DataFrame, detections: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Frames (see ``pose_frames``, with ``bbox``) and detections → one wide row per worker."""
    return assemble(analyse(frames, detections, limits))


def report_series(run: Analysis) -> dict[str, DataFrame]:
    """The series that accompany the worker documents, one row per element."""
    return {
        "activity_timeline": run.bouts.select("video_id", "worker_id", F.col("label").alias("activity"), "start_time",
                                              "end_time", "duration", "is_rest"),
        "angle_time_series": A.angle_series(run.frames),
        "arm_angle_time_series": A.arm_series(run.frames),
        "load_instances": J.loads(run.near).select("video_id", "worker_id", F.col("ts").alias("timestamp"),
                                                   F.col("class_name").alias("object_class"),
                                                   F.lit(None).cast("double").alias("weight_kg")),  # never estimated
    }
