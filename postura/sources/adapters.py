"""Views of the generic test tables as observation tables, so that every operator can be checked against SQL.

Integer arithmetic and row positions only. The formulas are part of the test contract, not of the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postura.functions.numeric import dbl
from postura.operators.ordered import Series, scan


def _pick(i: Column, *values: float) -> Column:
    return F.element_at(F.array(*[dbl(v) for v in values]), (i + 1).cast("int"))


def _shape(numbered: DataFrame, eid: Column, user: Column) -> DataFrame:
    """Frame columns from (seq, an event number, a person number); a pause of three steps after every 17 rows."""
    seq = F.col("seq")
    df = numbered.select("*", eid.alias("_e"), user.alias("_u")).withColumn("seq", F.expr("(seq div 17) * 20 + seq % 17"))
    e, u = F.col("_e"), F.col("_u")
    df = df.withColumn("_blk", F.expr("(seq + _u) div (4 + _u % 5)"))
    df = df.withColumn("_phase", (F.col("_blk") * 7 + u * 3) % 6)
    phase = F.col("_phase")
    return df.select(
        F.col("_e").alias("event_id"), "k", "seq", (u % 25).alias("video_id"), u.alias("worker_id"),
        (u * 10 + F.expr("seq div 20")).alias("raw_id"), (seq * 15).alias("frame_idx"),
        (seq * dbl(0.8) + u * dbl(0.13)).alias("ts"),
        F.when(e % 23 != 0, _pick(phase, 5, 10, 45, 70, 12, 8) + (e % 8) * dbl(0.25)).alias("trunk"),
        _pick(phase, 170, 90, 150, 140, 100, 165).alias("hip"),
        F.when(e % 17 != 0, _pick(phase, 172, 110, 165, 150, 80, 168)).alias("knee"),
        F.when(e % 29 != 0, F.when(phase == 5, dbl(18) + (e % 10)).otherwise((e % 12) * dbl(0.4))).alias("disp"),
        (dbl(0.5) + (e % 50) * dbl(0.01)).alias("conf"),
        (dbl(20.25) + (e * 13) % 90).alias("shoulder"),
        (dbl(80) + F.abs(seq % (u % 7 + 6) - 3) * dbl(8)).alias("elbow"),
        F.when(e % 31 != 0, dbl(0.25) + (e * 11) % 180).alias("wrist"),
        F.when(e % 19 != 0, dbl(0.5) + (e * 7) % 40).alias("neck"),
        (dbl(100) + u * dbl(7.1) + F.abs(seq % 40 - 20) * dbl(12)).alias("x"),
        (dbl(200) + u * dbl(11.3)).alias("y"),
    )


def event_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their position ``seq`` per user, counted day by day."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "user_id", "ts",
        F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"),
        F.unix_date(F.to_date("ts")).alias("day"))
    numbered = scan(events, Series(("user_id",), ("ts", "event_id"), "day"), count="_pos")
    return numbered.select("event_id", "user_id", "k", (F.col("_pos") - 1).alias("seq"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(event_numbers(spark, sf_dir), F.col("event_id"), F.col("user_id"))


def bulk_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same shape from ``lineitem`` (six rows per event row): volume for benchmarks."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = lines.columns
    part = lines.withColumn("_part", F.expr("l_orderkey div 8192"))
    numbered = scan(part, Series(("l_suppkey",), tuple(order), "_part"), count="_pos")
    slim = numbered.select("l_suppkey", (F.col("l_orderkey") + F.col("l_linenumber")).alias("_id"),
                           F.col("l_quantity").cast("long").alias("k"), (F.col("_pos") - 1).alias("seq"))
    return _shape(slim, F.col("_id"), F.col("l_suppkey"))


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding vectors as 17-joint poses; four tracks per video, one frame per vector."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("obs_id"), F.col("label").cast("long").alias("video_id"), e.alias("e"))
    joints = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.struct(
        (dbl(320) + F.get("e", i * 2) * dbl(400)).alias("x"), (dbl(240) + F.get("e", i * 2 + 1) * dbl(400)).alias("y")))
    conf = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.least(
        dbl(1), F.abs(F.get("e", i + 34)) * dbl(10)))
    return raw.select("obs_id", "video_id", (F.col("obs_id") % 4).alias("raw_id"), F.col("obs_id").alias("frame_idx"),
                      (F.col("obs_id") * dbl(0.2)).alias("ts"), joints.alias("keypoints"), conf.alias("conf"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object detection per event; object centre relative to the person of the same frame."""
    classes = F.array(*[F.lit(c) for c in (24, 26, 28, 43, 76, 39, 0, 99)])
    f = frames(spark, sf_dir)
    cx = F.col("x") + (F.col("event_id") % 300) - dbl(150)
    return f.select(
        F.col("event_id").alias("det_id"), "video_id", "frame_idx", "ts",
        F.element_at(classes, (F.col("k") % 8 + 1).cast("int")).alias("class_id"),
        (dbl(0.2) + (F.col("event_id") % 80) / dbl(100)).alias("confidence"),
        F.struct((cx - 10.0).alias("x1"), (F.col("y") - 10.0).alias("y1"), (cx + 10.0).alias("x2"),
                 (F.col("y") + 10.0).alias("y2")).alias("bbox"))


def boxes(df: DataFrame) -> DataFrame:
    """Adds the person box around (x, y)."""
    x, y = F.col("x"), F.col("y")
    return df.withColumn("bbox", F.struct((x - 40.0).alias("x1"), (y - 90.0).alias("y1"), (x + 40.0).alias("x2"),
                                          (y + 90.0).alias("y2")))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.array(*[F.lit(s) for s in (".mp4", ".avi", ".mov", ".mkv", ".wmv", ".txt")])
    n = F.col("n_nationkey")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        n.cast("long").alias("video_id"),
        F.concat(F.lower("n_name"), F.element_at(suffix, (n % 6 + 1).cast("int"))).alias("name"),
        F.lit(1280).alias("width"), F.lit(720).alias("height"),
        (dbl(24) + (n % 3) * dbl(3)).alias("fps"), (F.lit(2000) + n * 3000).cast("long").alias("total_frames"),
        (n * 100).cast("long").alias("size_mb"))
