"""Adaptive frame sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postura import tables as T
from postura.config import DEFAULTS, Thresholds
from postura.functions.numeric import dbl, rnd
from postura.operators.ordered import Series, scan, stage


def adaptive_fps(duration: Column, mode: Column) -> Column:
    """Frames per second to keep, from the length of the video and the speed mode (matched by substring)."""

    def by_length(values: tuple) -> Column:
        return (F.when(duration < T.SAMPLING_BANDS[0], dbl(values[0]))
                .when(duration < T.SAMPLING_BANDS[1], dbl(values[1])).otherwise(dbl(values[2])))

    return (F.when(F.contains(mode, F.lit("Lightning")), by_length(T.SAMPLING_FPS["Lightning"]))
            .when(F.contains(mode, F.lit("Precision")), by_length(T.SAMPLING_FPS["Precision"]))
            .otherwise(by_length(T.SAMPLING_FPS["Balanced"])))


def frame_interval(video_fps: Column, fps: Column) -> Column:
    return F.when(fps >= video_fps, 1).otherwise(F.greatest(F.lit(1), F.rint(video_fps / fps).cast("int")))


def sampled_count(total_frames: Column, video_fps: Column, fps: Column) -> Column:
    """Estimated number of sampled frames of a video."""
    step = frame_interval(video_fps, fps)
    return F.when(fps >= video_fps, total_frames).otherwise(F.floor(total_frames / step)).cast("long")


def sample_frames(frames: DataFrame, videos: DataFrame, mode: str = "Balanced Fast") -> DataFrame:
    """Every n-th frame of each video with its time; n depends on the video.

    ``videos`` (with ``duration_s``, ``fps``) is joined on the video; Spark broadcasts it only below its size limit.
    """
    plan = videos.select("video_id", "fps", frame_interval(
        F.col("fps"), adaptive_fps(F.col("duration_s"), F.lit(mode))).alias("_every"))
    kept = frames.join(plan, "video_id").where(F.pmod(F.col("frame_idx"), F.col("_every")) == 0)
    at = F.when(F.col("pos_ms") > 0, F.col("pos_ms") / 1000.0).otherwise(F.col("frame_idx") / F.col("fps"))
    return kept.withColumn("ts", rnd(at, 3)).drop("_every", "fps")


def object_frames(frames: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Frames that get object detection: every n-th of the sampled frames of a video, counted over all persons."""
    distinct = stage(frames.groupBy("video_id", "frame_idx").agg(F.lit(1).alias("_one")).drop("_one")
                     .withColumn("chunk", F.floor(F.col("frame_idx") / 100000)))
    numbered = scan(distinct, Series(("video_id",), ("frame_idx",)), count="_n")
    every = F.col("_n") % limits.object_stride == 1
    return numbered.where(every).select("video_id", "frame_idx")
