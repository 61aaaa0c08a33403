"""Readers' side: which observation, detection and video rows take part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postura import tables as T
from postura.config import DEFAULTS, Thresholds
from postura.functions.numeric import dbl, rnd
from postura.operators.association import class_name


def pose_rows(obs: DataFrame) -> DataFrame:
    """Rows of tracked persons; detections without an id are skipped."""
    return obs.where(F.col("raw_id").isNotNull())


#: All 17 joints by position. Fixed values.
JOINT_NAMES = ("nose", "l_eye", "r_eye", "l_ear", "r_ear", "l_sh", "r_sh", "l_el", "r_el", "l_wr", "r_wr", "l_hip", "r_hip",
               "l_kn", "r_kn", "l_an", "r_an")


def joints_long(obs: DataFrame, keep: list[str]) -> DataFrame:
    """One row per named joint."""
    long = obs.select(*keep, F.posexplode(F.arrays_zip("keypoints", "conf")).alias("joint_no", "_j"))
    name = F.get(F.array(*[F.lit(n) for n in JOINT_NAMES]), F.col("joint_no"))
    return long.select(*keep, "joint_no", name.alias("joint"), F.col("_j.keypoints.x").alias("x"),
                       F.col("_j.keypoints.y").alias("y"), F.col("_j.conf").alias("conf")).where("joint is not null")


def work_objects(detections: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Confident detections of work-relevant classes other than persons, named."""
    wanted = [c for c in T.WORK_CLASSES if c != 0]
    kept = detections.where(F.col("class_id").isin(wanted) & (F.col("confidence") >= limits.detection_conf))
    return kept.withColumn("class_name", class_name(F.col("class_id")))


def video_info(videos: DataFrame) -> DataFrame:
    seconds = F.when(F.col("fps") > 0, rnd(F.col("total_frames") / F.col("fps"), 2)).otherwise(dbl(0))
    return videos.withColumn("duration_s", seconds)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def accepted_formats(files: DataFrame, name: str = "name") -> DataFrame:
    return files.where(extension(F.col(name)).isin(T.VIDEO_FORMATS))


def accepted_sizes(files: DataFrame, size_mb: str = "size_mb", limits: Thresholds = DEFAULTS) -> DataFrame:
    return files.where(F.col(size_mb) <= limits.max_file_mb)


def list_videos(spark, path: str) -> DataFrame:
    """Accepted video files under a folder; the listing never reads file contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select("path", "length", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
                         (F.col("length") / dbl(1024 * 1024)).alias("size_mb"))
    return accepted_sizes(accepted_formats(named))
