"""Score tables per frame and per worker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postura import tables as T
from postura.functions import scoring as S
from postura.functions.numeric import dbl


def project(df: DataFrame, stages: list[dict[str, Column]]) -> DataFrame:
    for columns in stages:
        df = df.withColumns(columns)
    return df


def _angle(df: DataFrame, *names: str) -> Column:
    """First of the named columns that the frame table has, else a missing angle."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    return F.lit(None).cast("double")


def reba_frame(frames: DataFrame, load_force: Column | None = None, static: Column | None = None,
               repetitive: Column | None = None, rapid: Column | None = None) -> DataFrame:
    no = F.lit(False)
    parts = S.reba_parts(_angle(frames, "trunk"), _angle(frames, "neck"), _angle(frames, "knee"),
                         _angle(frames, "shoulder_high", "shoulder"), _angle(frames, "elbow_mean", "elbow"),
                         _angle(frames, "wrist_mean", "wrist"))
    load = F.lit(0) if load_force is None else load_force
    totals = S.reba_totals(load, no if static is None else static, no if repetitive is None else repetitive,
                           no if rapid is None else rapid)
    out = project(frames.withColumns(parts), totals)
    return out.withColumns({"risk_level": S.level_map(F.col("final_score"), T.REBA_LEVELS, 2),
                            "action": S.level_map(F.col("final_score"), T.REBA_LEVELS, 3)})


def rula_frame(frames: DataFrame, repetitive: Column | None = None, load_force: Column | None = None) -> DataFrame:
    parts = S.rula_parts(_angle(frames, "trunk"), _angle(frames, "neck"), _angle(frames, "knee"),
                         _angle(frames, "shoulder_high", "shoulder"), _angle(frames, "elbow"),
                         _angle(frames, "wrist"))
    totals = S.rula_totals(F.lit(False) if repetitive is None else repetitive,
                           F.lit(0) if load_force is None else load_force)
    out = project(frames.withColumns(parts), totals)
    return out.withColumns({"action_level": S.level_map(F.col("final_score"), T.RULA_LEVELS, 2),
                            "action": S.level_map(F.col("final_score"), T.RULA_LEVELS, 3)})


def p90_of_scores(scored: DataFrame, fields: list[str], top: int, key: str = "worker_id") -> DataFrame:
    """90th percentile of small integer scores per worker, with the breakdown of the nearest frame.

    Frames are first reduced to at most one row per (worker, score value), before any shuffle (number buffers, so by
    hashing); percentile and nearest frame come from those few rows. "First" goes by frame number.
    """
    if "_n" not in scored.columns:
        scored = scored.withColumns({"_n": F.lit(1), "_at": F.col("frame_idx")})
    per_score = scored.groupBy("video_id", key, "final_score").agg(
        F.sum("_n").alias("_n"), F.min("_at").alias("_at"), *[F.min_by(f, "_at").alias(f) for f in fields])
    worker = Window.partitionBy("video_id", key)
    run = F.sum("_n").over(worker.orderBy("final_score").rowsBetween(Window.unboundedPreceding, 0))
    ranked = per_score.withColumns({"_upto": run, "_all": F.sum("_n").over(worker)})
    # linear interpolation between the two neighbouring order statistics, from the nearer one, then truncation
    pos = (F.col("_all") - 1) * dbl(0.9)
    low, frac = F.floor(pos), pos - F.floor(pos)
    reached = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("final_score"))).over(worker)
    ranked = ranked.withColumns({"_lo": reached(low), "_hi": reached(low + 1)}).withColumn("_frac", frac)
    high, gap = F.coalesce("_hi", "_lo"), F.coalesce("_hi", "_lo") - F.col("_lo")
    exact = F.when(F.col("_frac") >= 0.5, high - gap * (dbl(1) - F.col("_frac"))).otherwise(F.col("_lo") + gap * F.col("_frac"))
    p90 = F.greatest(F.lit(1), F.least(F.lit(top), F.floor(exact).cast("int")))
    ranked = ranked.withColumn("_p90", p90)
    nearest = worker.orderBy(F.abs(F.col("final_score") - F.col("_p90")), "_at")
    best = ranked.withColumn("_place", F.row_number().over(nearest)).where("_place = 1")
    return best.select("video_id", key, F.col("_p90").alias("p90_score"), *fields)


def reba_worker(frames: DataFrame, key: str = "worker_id", load_force: Column | None = None) -> DataFrame:
    best = p90_of_scores(reba_frame(frames, load_force), S.REBA_FIELDS, 15, key)
    return best.withColumns({"risk_level": S.level_map(F.col("p90_score"), T.REBA_LEVELS, 2),
                             "action": S.level_map(F.col("p90_score"), T.REBA_LEVELS, 3)})


def rula_worker(frames: DataFrame, key: str = "worker_id", repetitive: Column | None = None) -> DataFrame:
    best = p90_of_scores(rula_frame(frames, repetitive), S.RULA_FIELDS, 7, key)
    return _rula_levels(best)


def _rula_levels(best: DataFrame) -> DataFrame:
    return best.withColumns({"action_level": S.level_map(F.col("p90_score"), T.RULA_LEVELS, 2),
                             "action": S.level_map(F.col("p90_score"), T.RULA_LEVELS, 3)})


def rula_worker_pipeline(frames: DataFrame, flags: DataFrame, key: str = "worker_id") -> DataFrame:
    """Overall RULA as the pipeline takes it: trunk angle only, plus the worker's repetition flag.

    Frames are counted per trunk score first, so only a few rows per worker meet the flag.
    """
    none = F.lit(None).cast("double")
    parts = S.rula_parts(F.col("trunk"), none, none, none, none, none)
    counted = frames.withColumns(parts).groupBy("video_id", key, *parts).agg(
        F.count(F.lit(1)).alias("_n"), F.min("frame_idx").alias("_at"))
    scored = project(counted.join(flags.select("video_id", key, "is_repetitive"), ["video_id", key]),
                     S.rula_totals(F.col("is_repetitive"), F.lit(0)))
    return _rula_levels(p90_of_scores(scored, S.RULA_FIELDS, 7, key))


def niosh(df: DataFrame, weight: Column, trunk: Column, h_cm: Column | None = None, v_cm: Column | None = None,
          travel_cm: Column | None = None, asym_deg: Column | None = None,
          lifts_min: Column | None = None) -> DataFrame:
    d = lambda c, v: dbl(v) if c is None else c
    return project(df, S.niosh(weight, trunk, d(h_cm, 30), d(v_cm, 75), d(travel_cm, 50), d(asym_deg, 0),
                               d(lifts_min, 1)))


def drudgery(df: DataFrame) -> DataFrame:
    """Needs the worker columns named below; adds unrounded pillars, index, category, fatigue and advice."""
    c = F.col
    pillars = S.adi_pillars(c("reba_score").cast("double"), c("rula_score").cast("double"), c("bending_pct"),
                            c("squatting_pct"), c("cycles_per_minute"), c("tracked_s"), c("longest_work_s"),
                            c("rest_s"), c("load_events").cast("double"), c("severe_pct"), c("sh45_pct"),
                            c("sh90_pct"))
    return project(df, [
        pillars,
        {"drudgery_index": S.adi_index(), "advice": S.adi_advice()},
        {"drudgery_category": S.adi_category(c("drudgery_index")),
         "fatigue_level": S.adi_fatigue(c("drudgery_index"), c("longest_work_s"))},
    ])


def fatigue_curve(df: DataFrame) -> DataFrame:
    """One row per started minute of the session."""
    minutes = df.withColumn("_minutes", S.fatigue_minutes(F.col("tracked_s")))
    rows = minutes.withColumn("minute", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_minutes"))))
    return rows.select("video_id", "worker_id", "minute",
                       S.fatigue_at(F.col("fatigue_level"), F.col("minute"), F.col("_minutes")).alias("fatigue"))


def iso_exposure(df: DataFrame, exposure_col: str = "bending_s") -> DataFrame:
    return project(df, S.iso_exposure(F.col(exposure_col), F.col("tracked_s")))


def hourly(df: DataFrame) -> DataFrame:
    c = F.col
    durations = {p: c(f"{p}_s") for p in S.HOURLY_PARTS}
    gated = F.when(c("is_repetitive"), c("cycles_per_minute"))
    return project(df, S.hourly(c("tracked_s"), durations, c("rest_count"), c("load_events"), c("trip_count"), gated,
                                c("sh45_pct"), c("sh90_pct")))


def classify_task(df: DataFrame) -> DataFrame:
    c = F.col
    key, conf = S.task_class(c("bending_pct"), c("squatting_pct"), c("standing_pct"), c("walking_pct"),
                             c("cycles_per_minute"), c("primary_joint"), c("tools"), c("load_events"), c("sh90_pct"))
    return project(df, [
        {"_task": key, "task_confidence": conf},
        {"task": S.task_text(c("_task"), 0), "task_description": S.task_text(c("_task"), 1),
         "task_hazard": S.task_text(c("_task"), 2)},
    ]).drop("_task")
