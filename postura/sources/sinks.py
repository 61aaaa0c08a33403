"""Report writers. Output is partitioned by video and written by all tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postura.operators import report_tables as R
from postura.operators.ordered import stage

RUN, MANIFEST = "_run", "_manifest"


def write_json(report: DataFrame, videos: DataFrame, path: str, series: dict[str, DataFrame] | None = None) -> None:
    """``<path>/videos`` and ``<path>/workers`` hold one document per row, ``<path>/<kind>`` the lines of each growing
    series (see ``report_series``)."""
    tables = {"videos": R.video_documents(report, videos), "workers": R.json_documents(report, videos)}
    tables.update({kind: R.series_documents(rows, kind) for kind, rows in (series or {}).items()})
    for kind, docs in tables.items():
        docs.select("video_id", "document").write.partitionBy("video_id").text(f"{path}/{kind}")


def write_nested_json(report: DataFrame, videos: DataFrame, timeline: DataFrame, path: str) -> None:
    """One file per video with one JSON document: the video, its workers and their timelines. A file is one task's stream of
    sorted lines, one worker or bout on each."""
    R.nested_lines(report, videos, timeline).write.partitionBy("video_id").text(path)


def read_nested_json(spark: SparkSession, path: str) -> DataFrame:
    """``video_id``, ``filename``, ``document`` (one worker's) of every worker in the files."""
    whole = spark.read.text(path, wholetext=True)
    doc = F.from_json("value", "struct<video_info:struct<filename:string>,workers:array<string>>")
    return whole.select(F.col("video_id").cast("long").alias("video_id"), doc.alias("d")).select(
        "video_id", "d.video_info.filename", F.explode("d.workers").alias("document"))


def write_csv(report: DataFrame, videos: DataFrame, path: str) -> None:
    R.csv_table(report, videos).write.option("header", True).csv(path)


def read_csv(spark: SparkSession, like: DataFrame, path: str) -> DataFrame:
    """The file's rows with the types of the table that was written; the header must name its columns."""
    return spark.read.schema(like.schema).option("header", True).option("enforceSchema", False).csv(path)


def write_partitioned(report: DataFrame, path: str) -> str:
    """Results by video; a rerun replaces the videos that it holds and no others. Returns the run's name.

    Rows carry the name of their run. When all files stand, a manifest is appended with the rows of each video of the run; a reader goes
    by the last entry of a video, so a run that stopped half-way shows no rows rather than mixed ones.
    """
    run = uuid.uuid4().hex
    rows = stage(report.withColumn(RUN, F.lit(run)))  # one set of rows for files and manifest
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").parquet(path))
    counts = rows.groupBy("video_id", RUN).agg(F.count(F.lit(1)).alias("rows"))
    counts.select("*", F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}")
    return run


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """The rows of each video's last finished run."""
    last = manifest(spark, path).select(F.col("video_id").alias("_video"), F.col(RUN).alias("_last"))
    rows = spark.read.parquet(path)
    return rows.join(last, (rows["video_id"] == last["_video"]) & (rows[RUN] == last["_last"]), "left_semi").drop(RUN)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last entry of each video: video_id, run, rows, at."""
    entries = spark.read.parquet(f"{path}/{MANIFEST}")
    newest = F.row_number().over(Window.partitionBy("video_id").orderBy(F.col("at").desc(), RUN))
    return entries.withColumn("_n", newest).where("_n = 1").drop("_n")


def unfinished(spark: SparkSession, path: str) -> DataFrame:
    """Videos whose files are not those of their last manifest entry: ``video_id``, ``expected``, ``found``."""
    found = spark.read.parquet(path).groupBy("video_id", RUN).agg(F.count(F.lit(1)).alias("found"))
    both = manifest(spark, path).join(found, ["video_id", RUN], "full")
    wrong = ~F.col("rows").eqNullSafe(F.col("found"))
    return both.where(wrong).select("video_id", F.col("rows").alias("expected"), "found")
