"""Repetition of joint angles: gaps, trend, peaks, spectrum, and the joint that repeats most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postura.config import DEFAULTS, Thresholds
from postura.functions.numeric import dbl, rnd
from postura.operators.frames import with_chunk
from postura.operators.long_series import band_spectrum, prominent_peaks, whole_series
from postura.operators.ordered import Series, scan, stage, stage_together

# ---- fixed values: joints in order of preference ----
JOINT_ORDER = ["elbow", "wrist", "shoulder", "trunk"]


def _keys(key: str) -> list[str]:
    return ["video_id", key, "joint"]


def fill_gaps(frames: DataFrame, key: str = "worker_id", limits: Thresholds = DEFAULTS) -> DataFrame:
    """Wide angles → long form (video, worker, joint, pos, n, value) without missing values.

    Missing values are interpolated linearly by position, ends held. Series without any value, or with gaps and fewer
    than three values, are dropped. The joints share their positions, so rows are numbered and searched while still
    wide and only then turned into one row per joint.
    """
    s = Series(("video_id", key), ("ts", "frame_idx"))
    joints = [j for j in JOINT_ORDER if j in frames.columns]
    wide = with_chunk(frames.select("video_id", key, "ts", "frame_idx", *joints), limits)
    numbered = stage(scan(wide, s, count="pos"))
    known = {j: F.when(F.col(j).isNotNull(), F.struct("pos", F.col(j).alias("value"))) for j in joints}
    near = scan(numbered, s, before={f"_l_{j}": e for j, e in known.items()},
                after={f"_r_{j}": e for j, e in known.items()})

    def filled(j: str) -> Column:
        left, right = F.col(f"_l_{j}"), F.col(f"_r_{j}")
        slope = (right["value"] - left["value"]) / (right["pos"] - left["pos"]).cast("double")
        return F.coalesce(F.col(j), slope * (F.col("pos") - left["pos"]) + left["value"], left["value"], right["value"])

    counts = numbered.groupBy("video_id", key).agg(F.count(F.lit(1)).alias("n"), *[F.count(j).alias(f"_n_{j}") for j in joints])
    usable = {j: (F.col(f"_n_{j}") >= 3) | (F.col(f"_n_{j}") == F.col("n")) for j in joints}
    # joined while wide; a usable series has no missing value after filling
    wide = near.join(counts, ["video_id", key]).select(
        "video_id", key, (F.col("pos") - 1).alias("pos"), "n", *[F.when(usable[j], filled(j)).alias(j) for j in joints])
    long = wide.unpivot(["video_id", key, "pos", "n"], joints, "joint", "value").where(F.col("value").isNotNull())
    return long.select(*_keys(key), "pos", "value", "n")


def detrend(filled: DataFrame, key: str = "worker_id") -> DataFrame:
    """Value minus the least-squares line over the positions of its series.

    Kept to nine decimals, so that equal neighbours (plateaus) stay equal whatever the last bits of the line are.
    """
    line = filled.groupBy(*_keys(key)).agg(
        F.regr_slope("value", "pos").alias("_m"), F.avg("value").alias("_v"), F.avg("pos").alias("_p"))
    flat = F.col("value") - (F.col("_v") + F.coalesce("_m", dbl(0)) * (F.col("pos") - F.col("_p")))
    return filled.join(line, _keys(key)).withColumn("value", rnd(flat, 9)).drop("_m", "_v", "_p")


# ------------------------------------------------------------------ operators


def peaks(detrended: DataFrame, key: str = "worker_id", limits: Thresholds = DEFAULTS, whole: DataFrame | None = None) -> DataFrame:
    """Positions of prominent peaks per series, judged block by block of ``series_rows`` positions."""
    distance = max(1, int(limits.sample_fps / limits.freq_max_hz)) if limits.freq_max_hz > 0 else 1
    return prominent_peaks(detrended, _keys(key), distance, limits.prominence_deg, limits.series_rows, whole)


def _repeat_columns(freq: Column, conf: Column, rounded: Column, limit: float) -> dict[str, Column]:
    return {
        "freq_hz": F.when(rounded, rnd(freq, 3)).otherwise(freq),
        "cpm": F.when(rounded, rnd(freq * 60.0, 1)).otherwise(freq * 60.0),
        "confidence": rnd(conf, 2),
        "is_repetitive": F.coalesce(rounded & (conf > limit), F.lit(False)),
    }


def peak_rate(found: DataFrame, series: DataFrame, key: str = "worker_id", limits: Thresholds = DEFAULTS) -> DataFrame:
    """Rate and regularity of the peaks of each series in ``series`` (keys only)."""
    s = Series(tuple(_keys(key)), ("pos",))
    gaps = scan(found.withColumn("chunk", F.floor(F.col("pos") / 8192)), s, before={"_prev": F.col("pos")})
    gap = (F.col("pos") - F.col("_prev")) / dbl(limits.sample_fps)
    stats = gaps.groupBy(*_keys(key)).agg(F.count(F.lit(1)).alias("peak_count"), F.avg(gap).alias("_m"),
                                          F.stddev_pop(gap).alias("_sd"))
    rows = series.join(stats, _keys(key), "left").withColumn("peak_count", F.coalesce("peak_count", F.lit(0)))
    enough = F.col("peak_count") >= 3
    freq = F.when(enough, dbl(1) / F.col("_m"))
    in_band = freq.between(limits.freq_min_hz, limits.freq_max_hz)
    steady = F.greatest(dbl(0), F.least(dbl(1), dbl(1) - F.col("_sd") / F.col("_m")))
    conf = F.when(~enough, dbl(0)).when(in_band, steady).otherwise(dbl(0.2))
    cols = _repeat_columns(freq, conf, F.coalesce(in_band, F.lit(False)), 0.4)
    return rows.select(*_keys(key), "peak_count", *[c.alias(n) for n, c in cols.items()])


def spectrum_rate(detrended: DataFrame, key: str = "worker_id", limits: Thresholds = DEFAULTS,
                  whole: DataFrame | None = None) -> DataFrame:
    raw = band_spectrum(detrended, _keys(key), limits.sample_fps, limits.freq_min_hz, limits.freq_max_hz, limits.series_rows, whole)
    ratio = (F.col("peak") / (F.col("mean") + dbl(1e-8)) - 1.0) / 5.0
    conf = F.when(F.col("hz").isNull(), dbl(0)).otherwise(F.greatest(dbl(0), F.least(dbl(1), ratio)))
    cols = _repeat_columns(F.col("hz"), conf, F.col("hz").isNotNull(), 0.3)
    return raw.select(*_keys(key), *[c.alias(n) for n, c in cols.items()])


_RESULT = ["freq_hz", "cpm", "peak_count", "confidence", "is_repetitive"]


def combine(by_peaks: DataFrame, by_spectrum: DataFrame, key: str = "worker_id") -> DataFrame:
    """Agreeing results are averaged and gain confidence; otherwise the more confident one, peaks on a tie."""
    t = by_peaks.select(*_keys(key), F.struct(*_RESULT).alias("t"))
    f = by_spectrum.withColumn("peak_count", F.lit(0).cast("long")).select(*_keys(key), F.struct(*_RESULT).alias("f"))
    both = t.join(f, _keys(key))
    ct, cf = F.col("t.confidence"), F.col("f.confidence")
    agree = (F.col("t.is_repetitive") & F.col("f.is_repetitive")
             & (F.abs(F.col("t.freq_hz") - F.col("f.freq_hz")) < 0.2))
    merged = F.struct(
        rnd((F.col("t.freq_hz") + F.col("f.freq_hz")) / 2.0, 3).alias("freq_hz"),
        rnd((F.col("t.cpm") + F.col("f.cpm")) / 2.0, 1).alias("cpm"),
        F.col("t.peak_count").cast("long").alias("peak_count"),
        F.least(dbl(1), F.greatest(ct, cf) + dbl(0.15)).alias("confidence"),
        F.lit(True).alias("is_repetitive"))
    return both.select(*_keys(key), F.when(F.coalesce(agree, F.lit(False)), merged)
                       .when(ct >= cf, F.col("t")).otherwise(F.col("f")).alias("r")).select(*_keys(key), "r.*")


def repetition(frames: DataFrame, key: str = "worker_id", limits: Thresholds = DEFAULTS) -> DataFrame:
    """Wide angles → one repetition result per (worker, joint) series that is long enough."""
    flat = stage(detrend(stage(fill_gaps(frames, key, limits)), key)
                 .where((F.col("n") >= int(limits.min_signal_s * limits.sample_fps)) & (F.col("n") >= 10)))
    whole = stage(whole_series(flat, _keys(key), limits.series_rows))  # for both
    names = whole.select(*_keys(key)).unionByName(flat.where(F.col("n") > limits.series_rows).select(*_keys(key)).distinct())
    rates = stage_together(peaks=lambda: peak_rate(stage(peaks(flat, key, limits, whole)), names, key, limits),
                           spectrum=lambda: spectrum_rate(flat, key, limits, whole))
    return combine(rates["peaks"], rates["spectrum"], key)


def best_joint(results: DataFrame, workers: DataFrame, key: str = "worker_id") -> DataFrame:
    """Per worker the result with the highest positive confidence; the earlier joint on a tie."""
    rank = F.array_position(F.array(*[F.lit(j) for j in JOINT_ORDER]), F.col("joint"))
    best = results.where(F.col("confidence") > 0).groupBy("video_id", key).agg(
        F.max_by(F.struct(F.col("joint").alias("primary_joint"), *_RESULT),
                 F.struct("confidence", -rank)).alias("b"))
    rows = workers.select("video_id", key).join(best, ["video_id", key], "left")
    return rows.select(
        "video_id", key, F.coalesce("b.primary_joint", F.lit("elbow")).alias("primary_joint"),
        F.col("b.freq_hz").alias("freq_hz"), F.col("b.cpm").alias("cycles_per_minute"),
        F.coalesce("b.peak_count", F.lit(0)).cast("long").alias("peak_count"),
        F.coalesce("b.confidence", dbl(0)).alias("confidence"),
        F.coalesce("b.is_repetitive", F.lit(False)).alias("is_repetitive"))
