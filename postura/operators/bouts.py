"""Activity bouts: islands of equal labels, absorption of short ones, merging, rest.

Bouts of one worker are handled slice by slice like frames (see ordered.py); whole-worker facts travel as one
row per slice or as ordinary hash aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postura.config import DEFAULTS, Thresholds
from postura.functions.numeric import dbl, rnd
from postura.operators.frames import with_chunk
from postura.operators.ordered import Series, scan, stage


def _by_start(key: str) -> Series:
    return Series(keys=("video_id", key), order=("start_time", "start_frame"))


def _pieces(frames: DataFrame, key: str, limits: Thresholds) -> DataFrame:
    """Runs of equal labels inside one time slice: the only step that shuffles frames."""
    s = Series(keys=("video_id", key), order=("ts", "frame_idx"))
    w = s.window()
    marked = with_chunk(frames.select("video_id", key, "ts", "frame_idx", "label", "disp"), limits).withColumn(
        "_new", F.coalesce((F.lag("label").over(w) != F.col("label")).cast("int"), F.lit(1)))
    runs = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # the label is a key as well: number buffers only, hence a hash aggregate
    return runs.groupBy("video_id", key, "chunk", "_run", "label").agg(
        F.min("ts").alias("_t0"), F.min("frame_idx").alias("_f0"), F.max("ts").alias("_t1"),
        F.max("frame_idx").alias("_f1"), F.min_by("disp", "ts").alias("head_disp"),
        F.count(F.lit(1)).alias("n"), F.sum("disp").alias("sum_disp"), F.count("disp").alias("n_disp"),
    ).withColumn("_from", F.struct(F.col("_t0").alias("ts"), F.col("_f0").alias("frame_idx")))


def islands(frames: DataFrame, key: str = "worker_id", limits: Thresholds = DEFAULTS) -> DataFrame:
    """Maximal runs of equal labels per worker, with the displacement facts of their frames."""
    pieces = stage(_pieces(frames, key, limits))
    # Only the first piece of a slice can continue an island that began in an earlier slice.
    edges = pieces.groupBy("video_id", key, "chunk").agg(
        F.min_by("label", "_from").alias("_first"), F.max_by("label", "_from").alias("_last"),
        F.max("_from").alias("_last_from"), F.count(F.lit(1)).alias("_pieces"))
    across = Window.partitionBy("video_id", key).orderBy("chunk")
    joins = F.coalesce(F.lag("_last").over(across) == F.col("_first"), F.lit(False))
    edges = edges.withColumn("_joins", joins)
    opened = F.when((F.col("_pieces") > 1) | ~F.col("_joins"), F.col("_last_from"))
    edges = edges.select("video_id", key, "chunk", "_joins",
                         F.last(opened, ignorenulls=True)
                         .over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_open"))
    linked = pieces.join(edges, ["video_id", key, "chunk"]).withColumn(
        "_island", F.when((F.col("_run") == 1) & F.col("_joins"), F.col("_open")).otherwise(F.col("_from")))
    return linked.groupBy("video_id", key, "_island", "label").agg(
        F.max("_t1").alias("last_time"), F.max("_f1").alias("last_frame"),
        F.min_by("head_disp", "_t0").alias("head_disp"),
        F.sum("n").alias("n"), F.sum("sum_disp").alias("sum_disp"), F.sum("n_disp").alias("n_disp"),
    ).select(
        "video_id", key, "label",
        F.col("_island.ts").alias("start_time"), F.col("_island.frame_idx").alias("start_frame"),
        "last_time", "last_frame", "head_disp", "n", "sum_disp", "n_disp",
    )


def _duration() -> Column:
    return rnd(F.col("end_time") - F.col("start_time"), 2)


_BOUT = ["label", "start_time", "end_time", "duration", "start_frame", "end_frame", "avg_disp"]


def raw_bouts(frames: DataFrame, key: str = "worker_id", limits: Thresholds = DEFAULTS) -> DataFrame:
    """Islands as bouts: each ends at the first frame of the next one and shares that frame's displacement."""
    runs = stage(with_chunk(islands(frames, key, limits), limits, "start_time"))
    here = F.struct("start_time", "start_frame", "head_disp")
    seen = scan(runs, _by_start(key), before={"_prev": F.col("start_time")}, after={"_next": here})
    # a one-frame island at the very end of a longer series is never closed
    kept = seen.where(F.col("_next").isNotNull() | F.col("_prev").isNull() | (F.col("n") > 1))
    head = F.col("_next.head_disp")
    total = F.coalesce("sum_disp", dbl(0)) + F.coalesce(head, dbl(0))
    frames_with = F.col("n_disp") + head.isNotNull().cast("int")
    return kept.select(
        "video_id", key, "label", "start_time",
        F.coalesce("_next.start_time", "last_time").alias("end_time"),
        "start_frame", F.coalesce("_next.start_frame", "last_frame").alias("end_frame"),
        F.when(frames_with > 0, total / frames_with).otherwise(dbl(0)).alias("avg_disp"),
    ).withColumn("duration", _duration()).select("video_id", key, *_BOUT)


def absorb_short(bouts: DataFrame, key: str = "worker_id", limits: Thresholds = DEFAULTS) -> DataFrame:
    """Short bouts extend the kept bout before them; those before the first kept bout vanish.

    A worker with a single bout keeps it; one with only short bouts keeps the first, unextended.
    Also leaves what merging needs: ``prev_label``, ``pos`` and ``n_bouts`` among the kept bouts of the worker.
    """
    long_enough = F.col("duration") >= limits.min_bout_s
    facts = bouts.groupBy("video_id", key).agg(
        F.count(F.lit(1)).alias("_raw"), F.count_if(long_enough).alias("_kept"),
        F.min("start_frame").alias("_first"),
        F.max(F.struct("end_time", "end_frame")).alias("_end"))
    with_facts = bouts.join(facts, ["video_id", key])
    is_first = F.col("start_frame") == F.col("_first")
    kept = stage(with_chunk(with_facts.where(long_enough | ((F.col("_kept") == 0) & is_first)), limits, "start_time"))
    next_start = F.struct(F.col("start_time").alias("end_time"), F.col("start_frame").alias("end_frame"))
    seen = scan(kept, _by_start(key), before={"prev_label": F.col("label")}, after={"_next": next_start}, count="pos")
    own = F.struct("end_time", "end_frame")
    end = F.when((F.col("_raw") == 1) | (F.col("_kept") == 0), own).otherwise(F.coalesce("_next", "_end"))
    return (seen.withColumn("_stop", end)
            .withColumns({"end_time": F.col("_stop.end_time"), "end_frame": F.col("_stop.end_frame")})
            .withColumn("duration", _duration())
            .select("video_id", key, *_BOUT, "prev_label", "pos", F.greatest("_kept", F.lit(1)).alias("n_bouts")))


def merge_adjacent(kept: DataFrame, key: str = "worker_id", limits: Thresholds = DEFAULTS) -> DataFrame:
    """Neighbouring kept bouts of one label become one; displacement is averaged pairwise from left to right.

    The pairwise average of b1..bm weighs b1 with 2^-(m-1) and b_i with 2^-(m-i+1): a plain weighted sum, so the
    fold needs no sequential step.
    """
    opens = F.coalesce(F.col("prev_label") != F.col("label"), F.lit(True))
    marked = with_chunk(kept, limits, "start_time").withColumn("_opens", opens)
    spot = F.struct("start_time", "start_frame", "pos")
    seen = scan(marked, _by_start(key), before={"_open": F.when(F.col("_opens"), spot)},
                after={"_next": F.when(F.col("_opens"), F.col("pos"))})
    seen = seen.withColumn("_open", F.when(F.col("_opens"), spot).otherwise(F.col("_open")))
    first, past = F.col("_open.pos"), F.coalesce(F.col("_next"), F.col("n_bouts") + 1)
    steps = F.when(F.col("pos") == first, past - first - 1).otherwise(past - F.col("pos"))
    weighted = seen.withColumn("_part", F.col("avg_disp") * F.pow(dbl(2), -steps.cast("double")))
    return weighted.groupBy("video_id", key, "_open", "label").agg(
        F.max("end_time").alias("end_time"), F.max("end_frame").alias("end_frame"), F.sum("_part").alias("avg_disp"),
    ).select(
        "video_id", key, "label", F.col("_open.start_time").alias("start_time"), "end_time",
        F.col("_open.start_frame").alias("start_frame"), "end_frame", "avg_disp",
    ).withColumn("duration", _duration()).select("video_id", key, *_BOUT)


def mark_rest(bouts: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    calm = F.col("label").isin("standing", "sitting")
    return bouts.withColumn("is_rest", calm & (F.col("avg_disp") < limits.rest_px)
                            & (F.col("duration") >= limits.rest_s))


def segment(frames: DataFrame, key: str = "worker_id", limits: Thresholds = DEFAULTS) -> DataFrame:
    """Frames (video_id, worker, ts, frame_idx, label, disp) → final bouts."""
    raw = raw_bouts(frames, key, limits)
    return mark_rest(merge_adjacent(absorb_short(raw, key, limits), key, limits), limits)
