"""Report tables: projections and unpivots of the wide worker report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postura.functions.numeric import dbl, hms_truncated, rnd, share


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _or(c: str, other: str) -> Column:
    return F.coalesce(_text(c), F.lit(other))


def _rows(df: DataFrame, rows: list[dict[str, Column]]) -> DataFrame:
    """One output row per dict, from the same input row (a generator, no shuffle)."""
    packed = F.array(*[F.struct(*[c.alias(n) for n, c in r.items()]) for r in rows])
    return df.select("video_id", "worker_id", F.explode(packed).alias("_r")).select("video_id", "worker_id", "_r.*")


def _join(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def param_table(report: DataFrame) -> DataFrame:
    """Twelve parameters per worker as text; percentages are of max(1, tracked seconds)."""
    c = F.col

    def timed(no: str, name: str, part: str, extra: tuple = ()) -> dict:
        pct = rnd(c(f"{part}_s") / F.greatest(dbl(1), c("tracked_s")) * 100.0, 1)
        return {"no": F.lit(no), "parameter": F.lit(name),
                "value": _join(_text(f"{part}_s"), "s (", _text(pct), "%) | Reps: ", _text(f"{part}_reps"), *extra)}

    def plain(no: str, name: str, value: Column) -> dict:
        return {"no": F.lit(no), "parameter": F.lit(name), "value": value}

    repeats = F.when(c("is_repetitive"), _join(_text("cycles_per_minute"), " cycles/min on ", c("primary_joint"), " (",
                                               _text("freq_hz"), " Hz)")).otherwise("None detected")
    angles = _join("Trunk: ", _or("avg_trunk", "None"), "° | Shoulder Elv: ", _or("avg_shoulder", "None"),
                   "° | Elbow: ", _or("avg_elbow", "None"), "° | Knee: ", _or("avg_knee", "None"), "°")
    return _rows(report, [
        timed("1", "Sitting Duration & Reps", "sitting"),
        timed("1b", "Squatting Duration & Reps", "squatting"),
        timed("2", "Standing Duration & Reps", "standing"),
        timed("3", "Bending Duration & Reps", "bending", (" (Severe: ", _text("severe_bending_s"), "s)")),
        timed("4", "Walking Duration", "walking"),
        plain("5", "Load Carried", _join(_text("load_events"), " carrying events detected")),
        plain("6", "Repetitive Movement", repeats),
        plain("7", "Number of Trips", _join(_text("trip_count"), " trips (", _text("path_px"), " px travel)")),
        plain("8", "Tools/Equipment Used", F.when(F.size("tools") > 0, F.array_join("tools", ", "))
              .otherwise("None detected")),
        plain("9", "Posture & Angles (Trunk & Arms)", angles),
        plain("10", "Continuous Work Duration", _join("Longest: ", _text("longest_work_s"), "s | Avg: ",
                                                      _text("avg_work_s"), "s (", _text("work_bouts"), " bouts)")),
        plain("11", "Rest Duration & Pauses", _join("Total Rest: ", _text("rest_s"), "s across ",
                                                    _text("rest_count"), " rest periods")),
    ])


def hourly_table(report: DataFrame) -> DataFrame:
    """Sampled time, one-hour time, share and entries per activity, with the load and active-work rows."""
    c = F.col

    def timed(name: str, part: str, entries: Column) -> dict:
        return {"activity": F.lit(name), "sampled": _join(_text(f"{part}_s"), "s"), "per_hour": c(f"{part}_hms_1hr"),
                "share": _join(_text(f"{part}_share_1hr"), "%"), "entries": entries}

    active = rnd(c("tracked_s") - c("rest_s"), 1)
    return _rows(report, [
        timed("1. Sitting", "sitting", _text("sitting_reps")),
        timed("1b. Squatting", "squatting", _text("squatting_reps")),
        timed("2. Standing", "standing", _text("standing_reps")),
        timed("3. Bending (Stooping)", "bending", _text("bending_reps")),
        timed("4. Walking", "walking", _text("walking_reps")),
        {"activity": F.lit("5. Carried Load Events"), "sampled": _join(_text("load_events"), " events"),
         "per_hour": _join(_text("load_events_1hr"), " events/hr"), "share": F.lit("N/A"),
         "entries": _text("load_events")},
        timed("7. Work Pause (Rest)", "rest", _join(_text("rest_count_1hr"), " pauses/hr")),
        {"activity": F.lit("Active Work Session"), "sampled": _join(_text(active), "s"),
         "per_hour": c("active_hms_1hr"),
         "share": _join(_text(rnd(dbl(100) - c("rest_share_1hr"), 1)), "%"), "entries": F.lit("")},
    ])


def angle_table(report: DataFrame) -> DataFrame:
    n = "None"
    return _rows(report, [
        {"angle": F.lit("Trunk Flexion (Torso Bending)"),
         "measured": _join("Avg: ", _or("avg_trunk", n), "° | Peak: ", _or("max_trunk", n), "°"),
         "standard": F.lit("ISO 11226 Limit: <60° (<4 min/shift)")},
        {"angle": F.lit("Knee Flexion Angle"), "measured": _join("Avg: ", _or("avg_knee", n), "°"),
         "standard": F.lit("Stoop: >140° | Deep Squat: <90°")},
        {"angle": F.lit("Shoulder Upper Arm Elevation"),
         "measured": _join("Avg: ", _or("avg_shoulder", n), "° | Peak: ", _or("max_shoulder", n), "°"),
         "standard": _join("Time >45°: ", _text("sh45_pct"), "% | >90°: ", _text("sh90_pct"), "%")},
        {"angle": F.lit("Elbow Flexion Angle"), "measured": _join("Avg: ", _or("avg_elbow", n), "°"),
         "standard": F.lit("Neutral: 60°–100° (REBA Table B)")},
    ])


def scorecard(report: DataFrame) -> DataFrame:
    c = F.col
    return report.select(
        "video_id", "worker_id", F.coalesce("reba_score", F.lit(1)).alias("reba"),
        _or("reba_level", "N/A").alias("reba_level"), F.coalesce("rula_score", F.lit(1)).alias("rula"),
        F.coalesce("drudgery_index", dbl(0)).alias("drudgery_index"),
        F.coalesce("drudgery_index", dbl(0)).alias("drudgery_pct"),
        F.coalesce("drudgery_category", F.lit("Low Drudgery")).alias("drudgery_category"),
        F.coalesce("compression_n", dbl(0)).alias("compression_n"),
        F.coalesce("arm_risk", F.lit("Low")).alias("arm_risk"), c("sh45_pct"))


def leaderboard(report: DataFrame) -> DataFrame:
    """Workers of a video by drudgery index (missing counts as 0).

    The rank is the number of workers with a higher index plus those before this one among equals, taken from counts
    per index value (the index has one decimal), so a large video is not sorted in one task.
    """
    idx = F.coalesce("drudgery_index", dbl(0))
    rows = report.withColumn("_idx", idx)
    per_value = rows.groupBy("video_id", "_idx").agg(F.count(F.lit(1)).alias("_n"))
    higher = Window.partitionBy("video_id").orderBy(F.col("_idx").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offset = per_value.select("video_id", "_idx", F.coalesce(F.sum("_n").over(higher), F.lit(0)).alias("_above"))
    within = F.row_number().over(Window.partitionBy("video_id", "_idx").orderBy("worker_id"))
    return rows.withColumn("_within", within).join(offset, ["video_id", "_idx"]).select(
        "video_id", (F.col("_above") + F.col("_within")).alias("place"), "worker_id", "task",
        _join(_or("reba_score", "N/A"), " (", _or("reba_level", "N/A"), ")").alias("reba_risk"),
        _or("rula_score", "N/A").alias("rula_risk"), _join(_text("_idx"), " / 100").alias("drudgery"),
        _join(_text("compression_n"), " N").alias("compression"), F.initcap("dominant_posture").alias("posture"))


def top_risk_workers(report: DataFrame, k: int) -> DataFrame:
    return report.orderBy(F.coalesce("drudgery_index", dbl(0)).desc(), "video_id", "worker_id").limit(k).select(
        "video_id", "worker_id", F.coalesce("drudgery_index", dbl(0)).alias("drudgery_index"))


def bout_timeline(bouts: DataFrame) -> DataFrame:
    return bouts.select("video_id", "worker_id", F.initcap("label").alias("activity"), "start_time", "end_time",
                        "duration", F.when(F.col("is_rest"), "Rest").otherwise("Work").alias("kind"))


def csv_table(report: DataFrame, videos: DataFrame) -> DataFrame:
    """The 25-column summary, one row per worker; missing values as "N/A" / "None"."""
    c = F.col
    named = report.join(videos.select("video_id", c("name").alias("_file")), "video_id", "left")
    pct = lambda part: share(c(f"{part}_s"), c("tracked_s"))
    timed = [col for p in ("sitting", "standing", "bending", "walking")
             for col in (c(f"{p}_s").alias(f"{p.title()} Duration (s)"), pct(p).alias(f"{p.title()} %"))]
    return named.select(
        c("_file").alias("Video File"), c("worker_id").alias("Worker ID"),
        c("tracked_s").alias("Total Tracked Time (s)"), *timed, c("load_events").alias("Load Events"),
        F.when(c("is_repetitive"), _text("cycles_per_minute")).otherwise("N/A").alias("Repetitive (cycles/min)"),
        c("trip_count").alias("Trip Count"), c("dominant_posture").alias("Dominant Posture"),
        _or("avg_trunk", "").alias("Avg Trunk Flexion (°)"), _or("max_trunk", "").alias("Max Trunk Flexion (°)"),
        c("longest_work_s").alias("Longest Work Bout (s)"), c("avg_work_s").alias("Avg Work Bout (s)"),
        c("rest_s").alias("Total Rest Duration (s)"), c("rest_count").alias("Rest Count"),
        c("avg_rest_s").alias("Avg Rest Duration (s)"),
        F.when(F.size("tools") > 0, F.array_join("tools", ", ")).otherwise("None").alias("Tools Detected"),
        _or("reba_score", "N/A").alias("REBA Score"), _or("reba_level", "N/A").alias("Risk Level"))


def _json(doc: Column) -> Column:
    """Absent values are written as null."""
    return F.to_json(doc, {"ignoreNullFields": "false"})


def _metadata() -> Column:
    return F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"),
                    F.lit("postura").alias("platform"), F.lit("ergonomic_assessment").alias("report_type"))


def _video_info() -> Column:
    return F.struct(F.col("name").alias("filename"), F.col("duration_s").alias("duration_seconds"),
                    F.concat_ws("x", "width", "height").alias("resolution"), "fps", "total_frames",
                    hms_truncated(F.col("duration_s")).alias("duration_formatted"))


def video_documents(report: DataFrame, videos: DataFrame) -> DataFrame:
    """One JSON document per video: its data and the number of workers."""
    workers = report.groupBy("video_id").agg(F.count(F.lit(1)).alias("_w"))
    summary = F.struct(F.coalesce("_w", F.lit(0)).alias("total_workers_detected"),
                       hms_truncated(F.col("duration_s")).alias("video_duration_formatted"))
    doc = F.struct(_metadata().alias("report_metadata"), _video_info().alias("video_info"), summary.alias("summary"))
    return videos.join(workers, "video_id", "left").select("video_id", _json(doc).alias("document"))


def _worker_fields() -> list[Column]:
    """Every bounded block of a worker's document."""
    c = F.col
    block = lambda p: F.struct(c(f"{p}_s").alias("duration_seconds"), hms_truncated(c(f"{p}_s")).alias("duration_formatted"),
                               share(c(f"{p}_s"), c("tracked_s")).alias("percentage"))
    reps = F.struct(*[c(f"{p}_reps") for p in ("sitting", "squatting", "standing", "bending", "walking")])
    params = F.struct(
        block("sitting").alias("1_sitting"), block("squatting").alias("1b_squatting"),
        block("standing").alias("2_standing"), block("bending").alias("3_bending"), block("walking").alias("4_walking"),
        F.struct(c("load_events").alias("total_events")).alias("5_load_carried"),
        F.struct("is_repetitive", "cycles_per_minute", c("freq_hz").alias("frequency_hz"),
                 c("confidence")).alias("6_repetitive_movement"),
        F.struct(c("trip_count").alias("count"), c("path_px").alias("total_distance_pixels")).alias("7_trips"),
        c("tool_usage").alias("8_tools_equipment"),
        F.struct("dominant_posture", "distribution", c("avg_trunk").alias("avg_trunk_flexion_degrees"),
                 c("max_trunk").alias("max_trunk_flexion_degrees"), c("avg_knee").alias("avg_knee_angle_degrees"),
                 c("severe_bending_s").alias("severe_bending_seconds"), reps.alias("reps")).alias("9_posture"),
        F.struct(c("avg_shoulder").alias("avg_shoulder_elevation_degrees"),
                 c("max_shoulder").alias("max_shoulder_elevation_degrees"),
                 c("avg_elbow").alias("avg_elbow_flexion_degrees"), c("sh45_pct").alias("shoulder_above_45_pct"),
                 c("sh90_pct").alias("shoulder_above_90_pct"), c("arm_risk").alias("arm_postural_risk"),
                 ).alias("arm_postural_study"),
        F.struct(c("longest_work_s").alias("longest_bout_seconds"),
                 hms_truncated(c("longest_work_s")).alias("longest_bout_formatted"),
                 c("avg_work_s").alias("avg_bout_seconds"), c("work_bouts").alias("total_work_bouts"),
                 ).alias("10_continuous_work"),
        F.struct(c("rest_s").alias("total_duration_seconds"), hms_truncated(c("rest_s")).alias("total_duration_formatted"),
                 "rest_count", c("avg_rest_s").alias("avg_rest_seconds")).alias("11_rest"))
    hour = F.struct("scaling_factor", *[c(f"{p}_hms_1hr").alias(f"{p}_formatted") for p in
                                        ("sitting", "squatting", "standing", "bending", "severe_bending", "walking",
                                         "rest")],
                    c("active_hms_1hr").alias("active_work_formatted"),
                    c("cycles_1hr").alias("repetitive_cycles_1hr"), "load_events_1hr", "trips_1hr")
    return [
        c("worker_id"), c("tracked_s").alias("total_tracked_time"),
        hms_truncated(c("tracked_s")).alias("total_tracked_time_formatted"), params.alias("parameters"),
        hour.alias("standardised_1hr_activity"),
        F.struct("reba_score", c("reba_level").alias("reba_risk_level"), "rula_score",
                 c("rula_level").alias("rula_action_level")).alias("ergonomic_score"),
        F.struct("drudgery_index", c("drudgery_index").alias("drudgery_percentage"), "drudgery_category",
                 c("fatigue_level").alias("estimated_fatigue_level"), c("advice").alias("recommendations"),
                 ).alias("drudgery_assessment"),
        F.struct("rwl_kg", "lifting_index", c("compression_n").alias("l5s1_compression_n"),
                 c("lift_risk").alias("risk_assessment")).alias("niosh_assessment"),
        F.struct(c("task").alias("primary_task"), c("task_confidence").alias("confidence"),
                 c("task_hazard").alias("hazard_profile")).alias("task_classification"),
        F.struct(c("iso_violated").alias("iso_11226_violated"), c("iso_message").alias("iso_11226_message"),
                 ).alias("shift_assessment")]


def json_documents(report: DataFrame, videos: DataFrame) -> DataFrame:
    """One JSON document per worker with every bounded block.

    Series that grow with the session (timeline, angle series, load events) are separate line documents, see
    ``series_documents``; nothing unbounded is collected into one row.
    """
    v = videos.select("video_id", _video_info().alias("video_info"))
    doc = F.struct(_metadata().alias("report_metadata"), F.col("video_info"), *_worker_fields())
    return report.join(v, "video_id", "left").select("video_id", "worker_id", _json(doc).alias("document"))


def nested_lines(report: DataFrame, videos: DataFrame, timeline: DataFrame) -> DataFrame:
    """Lines (``video_id``, ``line``) that make one JSON document per video when they are written in the order in which they
    come: the video's data, its workers by number, and in each worker the timeline by time.

    The lines of a video are sorted into one run and separated by what stands before them, so nothing is collected: a task
    streams the documents of its videos. Videos without a worker have an empty list.
    """
    none, text = F.lit(None), lambda s: F.lit(s)
    start, end = none.cast("double"), none.cast("double")

    def rows(df: DataFrame, place: int, worker: Column, part: int, line: Column, start: Column = start, end: Column = end) -> DataFrame:
        return df.select(F.col("video_id").cast("long").alias("video_id"), F.lit(place).alias("place"), worker.cast("long").alias("worker"),
                         F.lit(part).alias("part"), start.alias("start"), end.alias("end"), line.alias("line"))

    opened = lambda doc, name: F.concat(F.expr("substr(doc, 1, length(doc) - 1)"), text(f',"{name}":['))
    every = videos.join(report.select("video_id").distinct(), "video_id", "full")  # a video without data has workers all the same
    heads = video_documents(report, every).withColumnRenamed("document", "doc")
    workers = report.select("video_id", "worker_id", _json(F.struct(*_worker_fields())).alias("doc"))
    known = timeline.join(report.select("video_id", "worker_id"), ["video_id", "worker_id"], "left_semi")
    bout = F.struct("activity", "start_time", "end_time", "duration", "is_rest")
    worker, nobody = F.col("worker_id"), none
    lines = [rows(heads, 0, nobody, 0, opened("doc", "workers")), rows(workers, 1, worker, 0, opened("doc", "activity_timeline")),
             rows(known, 1, worker, 1, _json(bout), F.col("start_time"), F.col("end_time")), rows(workers, 1, worker, 2, text("]}")),
             rows(heads, 2, nobody, 0, text("]}"))]
    whole = lines[0]
    for more in lines[1:]:
        whole = whole.unionByName(more)
    order = Window.partitionBy("video_id").orderBy("place", "worker", "part", "start", "end")
    before = F.lag(F.struct("place", "part")).over(order)
    comma = (F.col("place") == 1) & (before["place"] == 1) & (
        ((F.col("part") == 0) & (before["part"] == 2)) | ((F.col("part") == 1) & (before["part"] == 1)))
    return whole.select("video_id", F.concat(F.when(comma, ",").otherwise(""), "line").alias("line"))


def series_documents(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of a growing series (timeline, angles, loads) as JSON lines, one per row, tagged with their kind."""
    body = [c for c in rows.columns if c not in ("video_id", "worker_id")]
    return rows.select("video_id", "worker_id", F.lit(kind).alias("kind"), _json(F.struct(*body)).alias("document"))
