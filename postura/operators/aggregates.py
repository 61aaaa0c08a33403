"""Per-worker and per-video aggregates. All are hash aggregates with partial aggregation before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postura import tables as T
from postura.config import DEFAULTS, Thresholds
from postura.functions.numeric import cents, dbl, rnd
from postura.functions.scoring import arm_risk

TIMED = ["sitting", "squatting", "standing", "bending", "walking"]


def _sum_s(test: Column) -> Column:
    """Sum of two-decimal durations, exact and independent of row order."""
    return F.coalesce(F.sum(F.when(test, cents(F.col("duration")))), F.lit(0)) / dbl(100)


def frame_count(frames: DataFrame) -> DataFrame:
    return frames.groupBy("video_id", "raw_id").agg(F.count(F.lit(1)).alias("n_frames"))


def min_records(frames: DataFrame, key: str = "worker_id", limits: Thresholds = DEFAULTS) -> DataFrame:
    counts = frames.groupBy("video_id", key).agg(F.count(F.lit(1)).alias("n_frames"))
    return counts.where(F.col("n_frames") >= limits.min_records)


def _tracked() -> list[Column]:
    return [rnd(F.max("end_time") - F.min("start_time"), 2).alias("tracked_s")]


def _posture_time() -> list[Column]:
    aggs = []
    for label in TIMED:
        mine = F.col("label") == label
        if label == "standing":
            mine = mine & ~F.col("is_rest")
        aggs += [_sum_s(mine).alias(f"{label}_s"), F.count_if(mine).alias(f"{label}_reps")]
    return aggs


def _work_rest() -> list[Column]:
    rest, work = F.col("is_rest"), ~F.col("is_rest")

    def mean(test: Column) -> Column:
        n = F.count_if(test)
        return F.when(n > 0, rnd(_sum_s(test) / n, 2)).otherwise(dbl(0))

    return [F.coalesce(rnd(F.max(F.when(work, F.col("duration"))), 2), dbl(0)).alias("longest_work_s"),
            mean(work).alias("avg_work_s"), F.count_if(work).alias("work_bouts"),
            _sum_s(rest).alias("rest_s"), F.count_if(rest).alias("rest_count"), mean(rest).alias("avg_rest_s")]


def tracked_time(bouts: DataFrame, key: str = "worker_id") -> DataFrame:
    return bouts.groupBy("video_id", key).agg(*_tracked())


def posture_time(bouts: DataFrame, key: str = "worker_id") -> DataFrame:
    """Seconds and entries per posture. Resting counts as sitting but not as standing."""
    return bouts.groupBy("video_id", key).agg(*_posture_time())


def work_rest(bouts: DataFrame, key: str = "worker_id") -> DataFrame:
    return bouts.groupBy("video_id", key).agg(*_work_rest())


def bout_facts(bouts: DataFrame, key: str = "worker_id") -> DataFrame:
    """The three tables above in one pass."""
    return bouts.groupBy("video_id", key).agg(*_tracked(), *_posture_time(), *_work_rest())


def _per_label(bouts: DataFrame, key: str) -> DataFrame:
    return bouts.groupBy("video_id", key, "label").agg(
        F.sum(cents(F.col("duration"))).alias("_cents"), F.min("start_time").alias("_first"))


def distribution(bouts: DataFrame, key: str = "worker_id") -> DataFrame:
    """Long form: share of each label in the total bout time (at most six rows per worker)."""
    total = F.sum("_cents").over(Window.partitionBy("video_id", key))
    pct = F.when(total > 0, rnd(F.col("_cents") / total * 100.0, 1)).otherwise(dbl(0))
    return _per_label(bouts, key).select("video_id", key, "label", pct.alias("pct"))


def label_facts(bouts: DataFrame, key: str = "worker_id") -> DataFrame:
    """Distribution as a map and as columns, and the dominant label (see ``dominant``), in one pass."""
    total = F.sum("_cents").over(Window.partitionBy("video_id", key))
    pct = F.when(total > 0, rnd(F.col("_cents") / total * 100.0, 1)).otherwise(dbl(0))
    long = _per_label(bouts, key).withColumn("pct", pct)
    return long.groupBy("video_id", key).agg(
        _leading().alias("dominant_posture"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "pct")))).alias("distribution"),
        *[F.coalesce(F.max(F.when(F.col("label") == v, F.col("pct"))), dbl(0)).alias(f"{v}_pct") for v in T.LABELS])


def _leading() -> Column:
    return F.max_by("label", F.struct("_cents", -F.col("_first")))


def dominant(bouts: DataFrame, key: str = "worker_id") -> DataFrame:
    """Label with most time; a tie goes to the one that occurred first."""
    return _per_label(bouts, key).groupBy("video_id", key).agg(_leading().alias("dominant_posture"))


def _angle_stats() -> list[Column]:
    a = lambda c: rnd(F.avg(c), 1)
    return [a("trunk").alias("avg_trunk"), rnd(F.max("trunk"), 1).alias("max_trunk"), a("hip").alias("avg_hip"),
            a("knee").alias("avg_knee"), a("shoulder").alias("avg_shoulder"),
            rnd(F.max("shoulder"), 1).alias("max_shoulder"), a("elbow").alias("avg_elbow")]


def _arm_share() -> list[Column]:
    n = F.count("shoulder")
    pct = lambda edge: F.when(n > 0, rnd(F.count_if(F.col("shoulder") >= edge) / n * 100.0, 1)).otherwise(dbl(0))
    return [pct(45.0).alias("sh45_pct"), pct(90.0).alias("sh90_pct")]


def _severe(limits: Thresholds) -> list[Column]:
    return [F.count_if(F.col("trunk") > limits.severe_deg).alias("severe_frames"), F.count(F.lit(1)).alias("n_frames")]


def angle_stats(frames: DataFrame, key: str = "worker_id") -> DataFrame:
    return frames.groupBy("video_id", key).agg(*_angle_stats())


def arm_share(frames: DataFrame, key: str = "worker_id") -> DataFrame:
    """Share of frames with a raised arm, over frames with a shoulder angle."""
    return frames.groupBy("video_id", key).agg(*_arm_share())


def severe_frames(frames: DataFrame, key: str = "worker_id", limits: Thresholds = DEFAULTS) -> DataFrame:
    return frames.groupBy("video_id", key).agg(*_severe(limits))


def frame_facts(frames: DataFrame, key: str = "worker_id", limits: Thresholds = DEFAULTS) -> DataFrame:
    """The three tables above in one pass; workers with too few frames drop out."""
    facts = frames.groupBy("video_id", key).agg(*_severe(limits), *_angle_stats(), *_arm_share())
    return facts.where(F.col("n_frames") >= limits.min_records)


def with_arm_exposure(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({
        "sh45_s": rnd(c("sh45_pct") / 100.0 * c("tracked_s"), 2),
        "sh90_s": rnd(c("sh90_pct") / 100.0 * c("tracked_s"), 2),
        "arm_risk": arm_risk(c("sh45_pct"), c("sh90_pct"))})


def severe_seconds(n_severe: Column, n_frames: Column, tracked: Column) -> Column:
    return rnd(n_severe * (tracked / F.greatest(F.lit(1), n_frames)), 2)


def tool_usage(near: DataFrame, key: str = "worker_id") -> DataFrame:
    return near.groupBy("video_id", key, "class_name").agg(
        F.min("ts").alias("_a"), F.max("ts").alias("_b"), F.count(F.lit(1)).alias("detections"),
    ).select("video_id", key, "class_name", rnd(F.col("_a"), 2).alias("first_seen"),
             rnd(F.col("_b"), 2).alias("last_seen"), rnd(F.col("_b") - F.col("_a"), 2).alias("span_s"), "detections")


def tools_of_worker(near: DataFrame, key: str = "worker_id") -> DataFrame:
    """Tools per worker in order of first sight, as names and with their usage; the classes bound both lists to 15."""
    used = near.groupBy("video_id", key, "class_name").agg(
        F.min(F.struct("ts", "det_id")).alias("_at"), F.max("ts").alias("_b"), F.count(F.lit(1)).alias("n"))
    first, last = F.col("_at.ts"), F.col("_b")
    record = F.struct(F.col("class_name").alias("tool_name"), rnd(first, 2).alias("first_seen"),
                      rnd(last, 2).alias("last_seen"), rnd(last - first, 2).alias("duration"),
                      F.col("n").alias("detection_count"))
    seen = used.groupBy("video_id", key).agg(F.array_sort(F.collect_list(F.struct("_at", record.alias("u")))).alias("_s"))
    return seen.select("video_id", key, F.transform("_s", lambda t: t["u"]["tool_name"]).alias("tools"),
                       F.transform("_s", lambda t: t["u"]).alias("tool_usage"))


def load_events(near: DataFrame, key: str = "worker_id") -> DataFrame:
    loads = near.where(F.col("class_name").isin(T.LOAD_CLASSES))
    return loads.groupBy("video_id", key).agg(F.count(F.lit(1)).alias("load_events"))


def angle_series(frames: DataFrame, key: str = "worker_id") -> DataFrame:
    a = lambda c: rnd(F.col(c), 1).alias(c)
    kept = frames.where(F.coalesce("trunk", "hip", "knee").isNotNull())
    return kept.select("video_id", key, "frame_idx", rnd(F.col("ts"), 2).alias("ts"), a("trunk"), a("hip"), a("knee"))


def arm_series(frames: DataFrame, key: str = "worker_id") -> DataFrame:
    a = lambda c: rnd(F.col(c), 1).alias(c)
    kept = frames.where(F.coalesce("shoulder", "elbow").isNotNull())
    return kept.select("video_id", key, "frame_idx", rnd(F.col("ts"), 2).alias("ts"), a("shoulder"), a("elbow"))


def run_summary(reports: DataFrame, frames: DataFrame, peak: DataFrame) -> DataFrame:
    """Per video: workers reported, frames processed, peak number of workers at once.

    The distinct frame count is two-level (per frame, then per video), so one large video is spread over tasks.
    """
    workers = reports.groupBy("video_id").agg(F.count(F.lit(1)).alias("workers"))
    seen = frames.groupBy("video_id", "frame_idx").agg(F.lit(1).alias("_one"))
    counts = seen.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames_processed"))
    return (counts.join(workers, "video_id", "left").join(peak, "video_id", "left")
            .select("video_id", F.coalesce("workers", F.lit(0)).alias("workers"), "frames_processed",
                    F.coalesce("peak_concurrency", F.lit(0)).alias("peak_concurrency")))
