"""Frame-level posture rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postura.config import DEFAULTS, Thresholds
from postura.functions.numeric import dbl


def posture_raw(trunk: Column, hip: Column, knee: Column, walking: Column, low: Column,
                limits: Thresholds = DEFAULTS) -> Column:
    """First matching rule → STRUCT<label, conf>. A comparison with a missing angle never matches."""

    def verdict(label: str, conf) -> Column:
        return F.struct(F.lit(label).alias("label"), (conf if isinstance(conf, Column) else dbl(conf)).alias("conf"))

    squat = (knee < 95.0) & (F.coalesce(low, F.lit(False)) | F.coalesce(hip < 105.0, F.lit(False)))
    stoop = (trunk > limits.bending_deg) & (knee.isNull() | (knee >= 130.0))
    seated = hip < limits.sitting_hip_deg
    upright = trunk < limits.upright_deg
    return (
        F.when(walking, verdict("walking", 0.88))
        .when(squat, verdict("squatting", 0.92))
        .when(stoop, verdict("bending", F.least(dbl(0.96), dbl(0.65) + trunk / 100.0)))
        .when(seated & knee.between(70.0, 135.0), verdict("sitting", 0.85))
        .when(seated & (trunk < 30.0), verdict("sitting", 0.80))
        .when(upright & (hip > 145.0), verdict("standing", 0.92))
        .when(upright & (knee > 150.0), verdict("standing", 0.90))
        .when(trunk < limits.bending_deg, verdict("standing", 0.65))
        .when(trunk.isNotNull(), verdict("bending", 0.70))
        .otherwise(verdict("unknown", 0.0))
    )


def stoop_band(avg_trunk: Column) -> Column:
    return F.when(avg_trunk > 60.0, "severe").when(avg_trunk > 20.0, "moderate").otherwise("safe")


def hud_band(trunk: Column, reba: Column) -> Column:
    return F.when(trunk > 60.0, "red").when((trunk > 20.0) | (reba > 3), "yellow").otherwise("green")


def hud_arm_tag(shoulder: Column) -> Column:
    return F.when(shoulder >= 90.0, "overhead").when(shoulder >= 45.0, "warn").when(shoulder.isNotNull(), "ok")


def gauge_band(value: Column, edges: list[float], names: list[str]) -> Column:
    """Name of the gauge step a value falls in; steps are closed below, open above except the last."""
    band = F.lit(None).cast("string")
    for i, name in enumerate(names):
        top = value <= edges[i + 1] if i == len(names) - 1 else value < edges[i + 1]
        band = F.when((value >= edges[i]) & top, name).otherwise(band)
    return band


def arm_gauge(value: Column) -> Column:
    return gauge_band(value, [0, 20, 45, 90, 140], ["safe", "moderate", "severe", "overhead"])


def trunk_gauge(value: Column) -> Column:
    return gauge_band(value, [0, 20, 60, 120], ["safe", "moderate", "severe"])
