"""Rounding and clamping helpers. Every rounded column of the library goes through them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dbl(value) -> Column:
    return F.lit(float(value))


def rnd(value: Column, places: int = 0) -> Column:
    """Half-even rounding of a double (Spark's own ``round`` is half-up on the decimal text)."""
    if places == 0:
        return F.rint(value)
    scale = dbl(10**places)
    return F.rint(value * scale) / scale


def rnd_int(value: Column) -> Column:
    return F.rint(value).cast("long")


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp; NULL stays NULL (greatest/least alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(dbl(low), F.least(dbl(high), value)))


def share(part: Column, whole: Column) -> Column:
    """Percentage at one decimal, 0 where the whole is not positive."""
    return F.when(whole > 0, rnd(part / whole * 100.0, 1)).otherwise(dbl(0))


def cents(value: Column) -> Column:
    """A two-decimal amount as whole hundredths, so that sums do not depend on row order."""
    return F.rint(value * 100.0).cast("long")


def mean_of(*values: Column) -> Column:
    """Mean of the non-null arguments, NULL if there are none."""
    total = sum((F.coalesce(v, dbl(0)) for v in values), dbl(0))
    n = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    return F.when(n > 0, total / n)


def hms(whole_seconds: Column) -> Column:
    s = whole_seconds.cast("long")

    def two(c: Column) -> Column:
        text = c.cast("string")
        return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)

    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(F.pmod(s, F.lit(3600)) / 60)),
                       two(F.pmod(s, F.lit(60))))


def hms_rounded(seconds: Column) -> Column:
    return hms(F.greatest(dbl(0), F.rint(seconds)))


def hms_truncated(seconds: Column) -> Column:
    return hms(F.greatest(dbl(0), F.floor(seconds).cast("double")))
