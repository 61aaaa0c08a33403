"""Peaks and spectrum of series of any length, block by block.

No task holds more of a series than a block. Work is cut into blocks of positions; what must be known across
blocks travels as one minimum and maximum per block, or, for the spectrum, as the columns and rows of a two-step transform.
"""

from __future__ import annotations

import bisect
import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postura.functions.numeric import dbl
from postura.operators.ordered import Series, scan, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = list[str]


# ------------------------------------------------------------------ peaks


def _tops(rows: DataFrame, keys: KEYS) -> DataFrame:
    """Middles of runs of equal values that are higher than both neighbouring runs."""
    s = Series(tuple(keys), ("pos",))
    near = scan(rows, s, before={"_p": F.col("value")}, after={"_n": F.col("value")})
    v = F.col("value")
    opens, closes = F.col("_p").isNull() | (F.col("_p") != v), F.col("_n").isNull() | (F.col("_n") != v)
    edges = stage(near.withColumns({"_opens": opens, "_closes": closes}).where("_opens or _closes"))
    end = F.struct("pos", "_n")
    runs = scan(edges, s, after={"_e": F.when(F.col("_closes"), end)}).where("_opens and _p < value")
    runs = runs.withColumn("_e", F.when(F.col("_closes"), end).otherwise(F.col("_e"))).where(F.col("_e._n") < v)
    return runs.select(*keys, "n", F.expr("(pos + _e.pos) div 2").alias("pos"), "value")


def _apart(tops: DataFrame, keys: KEYS, distance: int) -> DataFrame:
    """Higher peaks remove lower ones closer than ``distance``: in every round those without a higher open neighbour stay
    and their neighbours go. Neighbours meet in cells of ``distance`` positions."""
    rank = F.struct("value", "pos")
    left = stage(tops.withColumn("_cell", F.floor(F.col("pos") / distance)))
    kept = left.where(F.lit(False))

    def close(df: DataFrame, other: DataFrame, higher: bool, how: str) -> DataFrame:
        o = other.select(*keys, F.col("pos").alias("_pos"), F.struct("value", "pos").alias("_rank"),
                         F.explode(F.array(*[F.col("_cell") + i for i in (-1, 0, 1)])).alias("_cell"))
        near = (F.abs(F.col("pos") - F.col("_pos")) < distance) & (F.col("pos") != F.col("_pos"))
        on = [df[c] == o[c] for c in [*keys, "_cell"]]
        test = near & (F.col("_rank") > rank) if higher else near
        for c in on:
            test = test & c
        return df.join(o, test, how)

    while not left.isEmpty():
        winners = stage(close(left, left, True, "left_anti"))
        kept = kept.unionByName(winners)
        rest = left.join(winners.select(*keys, "pos"), [*keys, "pos"], "left_anti")
        left = stage(close(rest, winners, False, "left_anti"))
    return kept.drop("_cell")


def _lows(x: np.ndarray) -> np.ndarray:
    """Per position the lowest value back to the nearest higher one. The loop runs on plain floats; those of an array are slow one by one."""
    lows, tall, deep = [], [], []  # values that fall from bottom to top, each with the lowest since the one below it
    for v in x.tolist():
        low = v
        while tall and tall[-1] <= v:
            tall.pop()
            hidden = deep.pop()
            if hidden < low:
                low = hidden
        tall.append(v)
        deep.append(low)
        lows.append(low)
    return np.array(lows, dtype=x.dtype)


def _judge(prominence: float):
    """Per block: for each peak and side 1 (drops far enough before rising above), 0 (rises first) or 2 (open)."""

    def side(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        falls = x[at] - _lows(x)[at] >= prominence
        return np.where(falls, 1, np.where(np.maximum.accumulate(x)[at] > x[at], 0, 2))

    @F.pandas_udf("array<int>")
    def codes(values: pd.Series, tops: pd.Series) -> pd.Series:
        out = []
        for v, t in zip(values, tops):
            x, at = np.asarray(v), np.asarray(t, dtype=np.int64)
            out.append((side(x, at) * 3 + side(x[::-1], len(x) - 1 - at)).astype(np.int32))
        return pd.Series(out)

    return codes


def _nearest_blocks(prominence: float):
    """Per series, from one row per block: for each open side of a peak the nearest block beyond it that holds a value above the
    peak or one that is low enough. Two stacks of blocks are kept, of falling maxima and of rising minima; what a block hides
    from the blocks behind it is taken off, so a peak's block is found by bisection in either.
    """

    def one_way(peaks: pd.DataFrame, chunks: np.ndarray, low: np.ndarray, high: np.ndarray, back: bool) -> pd.DataFrame:
        order = np.argsort(chunks)[::-1] if back else np.argsort(chunks)
        asked = peaks.sort_values("chunk", ascending=not back, kind="stable")
        homes, values, at, k = asked["chunk"].to_numpy(), asked["value"].to_numpy(), np.full(len(asked), -1, dtype=np.int64), 0
        tall: list[int] = []  # maxima fall from bottom to top
        deep: list[int] = []  # minima rise from bottom to top
        for i in order:
            while k < len(asked) and homes[k] == chunks[i]:
                above = bisect.bisect_left(tall, -values[k], key=lambda j: -high[j])  # the first that is not above the peak
                below = bisect.bisect_right(deep, values[k], key=lambda j: low[j] + prominence)
                below = _exact(deep, below, low, values[k], prominence)
                found = [chunks[stack[n - 1]] for stack, n in ((tall, above), (deep, below)) if n]
                if found:
                    at[k] = min(found) if back else max(found)
                k += 1
            while tall and high[tall[-1]] <= high[i]:
                tall.pop()
            while deep and low[deep[-1]] >= low[i]:
                deep.pop()
            tall.append(i)
            deep.append(i)
        return asked.assign(at=at)[at >= 0]

    def _exact(deep: list[int], n: int, low: np.ndarray, value: float, prominence: float) -> int:
        """The count of blocks that are low enough by the very difference that is tested elsewhere."""
        while n < len(deep) and value - low[deep[n]] >= prominence:
            n += 1
        while n and value - low[deep[n - 1]] < prominence:
            n -= 1
        return n

    def search(peaks: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        chunks, low, high = (blocks[c].to_numpy() for c in ("chunk", "mn", "mx"))
        return pd.concat([one_way(peaks[peaks["side"] == side], chunks, low, high, side == 1) for side in (0, 1)])

    return search


def _asked(alive: DataFrame, rows: DataFrame, keys: KEYS) -> tuple[DataFrame, DataFrame]:
    """Open sides of peaks, and the extremes of blocks, of series of several blocks. A series of one block has no other, so its
    open sides stay open."""
    blocks = rows.groupBy(*keys, "chunk").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    many = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_blocks")).where("_blocks > 1").select(*keys)
    long = alive.join(many, keys, "left_semi")
    sides = [long.where(f"{name} = 2").select(*keys, "chunk", "pos", "value", F.lit(k).alias("side"))
             for k, name in enumerate(("_left", "_right"))]
    return sides[0].unionByName(sides[1]), blocks.join(many, keys, "left_semi")


def _confirmed(alive: DataFrame, rows: DataFrame, keys: KEYS, prominence: float) -> DataFrame:
    """Peaks whose open sides, if any, fall far enough in other blocks before they rise. A fixed number of steps: the block of each open
    side from one ordered pass over the blocks' extremes, then the nearest decisive value inside that block."""
    asked, blocks = _asked(alive, rows, keys)
    kind = asked.withColumn("at", F.lit(0).cast("long")).schema
    placed = asked.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(_nearest_blocks(prominence), kind)
    there = rows.select(*keys, F.col("chunk").alias("at"), F.col("pos").alias("_pos"), F.col("value").alias("_v"))
    inside = placed.join(there, [*keys, "at"])
    falls = F.col("value") - F.col("_v") >= prominence
    near = F.when(F.col("side") == 0, F.col("_pos")).otherwise(-F.col("_pos"))
    decisive = inside.where((F.col("_v") > F.col("value")) | falls)
    answer = decisive.groupBy(*keys, "pos", "side").agg(F.max_by(falls, near).alias("_ok")).where("_ok")
    good = answer.groupBy(*keys, "pos").agg(F.count(F.lit(1)).alias("_good"))
    open_sides = (F.col("_left") == 2).cast("int") + (F.col("_right") == 2).cast("int")
    return alive.join(good, [*keys, "pos"], "left").where(F.coalesce("_good", F.lit(0)) == open_sides)


def _whole_peaks(distance: int, prominence: float):
    """Prominent peaks of whole series of one block each, by the rules of ``_tops``, ``_apart`` and ``_judge``; a side that stays open at
    an end of the series is none."""

    def higher(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a > b) | (np.isnan(a) & ~np.isnan(b))  # as Spark orders them

    def tops(x: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(np.append(True, higher(x[1:], x[:-1]) | higher(x[:-1], x[1:])))  # of each run of equal values
        v = x[first]
        inner = np.flatnonzero(higher(v[1:-1], v[:-2]) & higher(v[1:-1], v[2:])) + 1
        return (first[inner] + first[inner + 1] - 1) // 2

    def apart(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) < 2 or np.diff(at).min() >= distance:
            return at
        keep = np.ones(len(at), dtype=bool)
        for i in np.lexsort((at, x[at]))[::-1]:
            if keep[i]:
                low, high = np.searchsorted(at, at[i] - distance, "right"), np.searchsorted(at, at[i] + distance)
                keep[low:high] = False
                keep[i] = True
        return at[keep]

    @F.pandas_udf("array<long>")
    def whole(index: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for i, v in zip(index, values):
            x = np.empty(len(v))
            x[np.asarray(i, dtype=np.int64)] = v
            at = apart(x, tops(x))
            if len(at):
                falls = (x[at] - _lows(x)[at] >= prominence) & (x[at] - _lows(x[::-1])[::-1][at] >= prominence)
                at = at[falls]
            out.append(at.astype(np.int64))
        return pd.Series(out, dtype=object)

    return whole


def whole_series(flat: DataFrame, keys: KEYS, width: int) -> DataFrame:
    """Series of at most ``width`` values, one block, as one row (keys, n, _m) each."""
    return flat.where(F.col("n") <= width).groupBy(*keys, "n").agg(F.collect_list(F.struct("pos", "value")).alias("_m"))


def prominent_peaks(flat: DataFrame, keys: KEYS, distance: int, prominence: float, width: int, whole: DataFrame | None = None) -> DataFrame:
    """Prominent peaks (keys, n, pos); ``width`` sets the positions of a block, never the result.

    A series of at most ``width`` values, one block, is searched as it is; a longer one block by block. ``whole`` is
    ``whole_series`` of the same rows where it is at hand.
    """
    short = whole_series(flat, keys, width) if whole is None else whole
    found = _whole_peaks(distance, prominence)(F.transform("_m", lambda m: m["pos"]), F.transform("_m", lambda m: m["value"]))
    return short.select(*keys, "n", F.explode(found).alias("pos")).unionByName(
        _long_peaks(flat.where(F.col("n") > width), keys, distance, prominence, width))


def _long_peaks(flat: DataFrame, keys: KEYS, distance: int, prominence: float, width: int) -> DataFrame:
    """Tops by scans over slices, judged block by block; what a block leaves open is decided by one pass over the blocks' extremes."""
    rows = stage(flat.select(*keys, "n", "pos", "value", F.lit(width).cast("long").alias("_width"),
                             F.floor(F.col("pos") / width).alias("chunk")))
    tops = _tops(rows, keys)
    if distance > 1:
        tops = _apart(tops, keys, distance)
    slot = [*keys, "n", "_width", "chunk"]
    values = rows.groupBy(*slot).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))),
                                                 lambda p: p["value"]).alias("_values"))
    at = tops.withColumns({"_width": F.lit(width).cast("long"), "chunk": F.floor(F.col("pos") / width)})
    at = at.groupBy(*slot).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_tops"))
    local = F.transform("_tops", lambda p: p["pos"] - F.col("chunk") * F.col("_width"))
    judged = values.join(at, slot).withColumn("_local", local).withColumn(
        "_codes", _judge(prominence)("_values", "_local"))
    each = stage(judged.select(*slot, F.explode(F.arrays_zip("_tops", "_codes")).alias("_z")).select(
        *slot, F.col("_z._tops.pos").alias("pos"), F.col("_z._tops.value").alias("value"),
        F.expr("_z._codes div 3").alias("_left"), (F.col("_z._codes") % 3).alias("_right")))
    alive = each.where("_left > 0 and _right > 0")
    return _confirmed(alive, rows, keys, prominence).select(*keys, "n", "pos")


# ------------------------------------------------------------------ spectrum


def _transform():
    """FFT of both complex columns of a group; members that are absent count as zero."""

    @F.pandas_udf("array<array<double>>")
    def fft(index: pd.Series, parts: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for i, p, m in zip(index, parts, n):
            grid = np.zeros((4, int(m)))
            grid[:, np.asarray(i, dtype=np.int64)] = np.stack([np.asarray(row) for row in p]).T
            a, b = np.fft.fft(grid[0] + 1j * grid[1]), np.fft.fft(grid[2] + 1j * grid[3])
            out.append(list(np.stack([a.real, a.imag, b.real, b.imag], axis=1)))
        return pd.Series(out)

    return fft


def _pass(df: DataFrame, keys: KEYS, group: str, member: str, size: str) -> DataFrame:
    grouped = df.groupBy(*keys, group).agg(
        F.collect_list(F.struct(F.col(member).alias("i"), F.col("z").alias("z"))).alias("_m"))
    spread = _transform()(F.transform("_m", lambda m: m["i"]), F.transform("_m", lambda m: m["z"]), F.col(size))
    return grouped.select(*keys, group, F.posexplode(spread).alias("_k", "z"))


def _turn(z: Column, angle: Column) -> Column:
    """Both complex numbers of ``z`` times exp(-i angle)."""
    c, s = F.cos(angle), F.sin(angle)

    def part(k: int) -> list[Column]:
        return [z[k] * c + z[k + 1] * s, z[k + 1] * c - z[k] * s]

    return F.array(*part(0), *part(2))


def _fft(df: DataFrame, keys: KEYS) -> DataFrame:
    """Transform of length M = size_r·size_c of rows (keys, size_r, size_c, j, z): first over each residue of j modulo R, then across them.
    Every group holds about the square root of the series."""
    k = [*keys, "size_r", "size_c"]
    split = df.select(*k, (F.col("j") % F.col("size_r")).alias("r"), F.expr("j div size_r").alias("c"), "z")
    inner = _pass(split, k, "r", "c", "size_c").withColumnRenamed("_k", "q")
    angle = dbl(2 * math.pi) * ((F.col("r") * F.col("q")) / (F.col("size_r") * F.col("size_c")))
    outer = _pass(inner.withColumn("z", _turn(F.col("z"), angle)), k, "q", "r", "size_r")
    return outer.select(*k, (F.col("q") + F.col("size_c") * F.col("_k")).alias("j"), "z")


def _band(fps: float, low: float, high: float):
    """The strongest in-band bin of whole series of one block each."""

    @F.pandas_udf("hz double, peak double, mean double")
    def best(index: pd.Series, values: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for i, v, m in zip(index, values, n):
            x = np.zeros(int(m))
            x[np.asarray(i, dtype=np.int64)] = v
            hz = np.arange(int(m) // 2 + 1) * (1.0 / (m * (1.0 / fps)))
            inside = (hz >= low) & (hz <= high)
            if m < 16 or not inside.any():
                out.append((None, None, None))
                continue
            amp = np.abs(np.fft.rfft(x * np.hanning(len(x))))[inside]
            at = int(amp.argmax())
            out.append((float(hz[inside][at]), float(amp[at]), float(amp.mean())))
        return pd.DataFrame(out, columns=["hz", "peak", "mean"], dtype="float64")

    return best


def band_spectrum(flat: DataFrame, keys: KEYS, fps: float, low: float, high: float, width: int = 8192,
                  whole: DataFrame | None = None) -> DataFrame:
    """(hz, peak, mean) of the strongest in-band bin of the Hann-windowed series; fewer than 16 values have none.

    A series of at most ``width`` values, one block, is transformed as it is; a longer one in two steps, so that no group holds it.
    """
    short = whole_series(flat, keys, width) if whole is None else whole
    found = _band(fps, low, high)(F.transform("_m", lambda m: m["pos"]), F.transform("_m", lambda m: m["value"]), F.col("n"))
    best = short.select(*keys, found.alias("_b")).select(*keys, "_b.*")
    return best.unionByName(_long_spectrum(flat.where(F.col("n") > width), keys, fps, low, high))


def _long_spectrum(flat: DataFrame, keys: KEYS, fps: float, low: float, high: float) -> DataFrame:
    """The transform of a length n is a convolution with a chirp, done with transforms of a power of two at least 2n."""
    k = [*keys, "n"]
    bits = F.ceil(F.log2(F.col("n") * 2)).cast("int")
    sized = flat.select(*k, "pos", "value", F.expr("1L").alias("_one"), bits.alias("_bits"))
    sized = sized.withColumns({"size_r": F.expr("shiftleft(_one, _bits div 2)"),
                               "size_c": F.expr("shiftleft(_one, _bits - _bits div 2)")})
    n, j = F.col("n"), F.col("pos")
    # exact square modulo 2n, so that the phase keeps its precision for any length
    square = F.expr("cast((cast(pos as decimal(19,0)) * cast(pos as decimal(19,0))) % (2 * n) as double)")
    chirp = dbl(math.pi) * square / n
    hann = dbl(0.5) - dbl(0.5) * F.cos(dbl(2 * math.pi) * j / (n - 1))
    base = [*k, "size_r", "size_c"]
    zero = dbl(0)
    x = F.col("value") * hann
    forward = sized.select(*base, j.alias("j"), F.array(x * F.cos(chirp), -x * F.sin(chirp), F.cos(chirp),
                                                         F.sin(chirp)).alias("z"))
    mirror = sized.where(j > 0).select(*base, (F.col("size_r") * F.col("size_c") - j).alias("j"),
                                       F.array(zero, zero, F.cos(chirp), F.sin(chirp)).alias("z"))
    z = F.col("z")
    spectra = _fft(forward.unionByName(mirror), k)
    # product of the two transforms, conjugated for the way back
    product = spectra.withColumn("z", F.array(z[0] * z[2] - z[1] * z[3], -(z[0] * z[3] + z[1] * z[2]), zero, zero))
    back = _fft(product, k).where(F.col("j") <= F.expr("n div 2"))
    amp = F.sqrt(z[0] * z[0] + z[1] * z[1]) / (F.col("size_r") * F.col("size_c"))
    hz = F.col("j") * (dbl(1) / (n * dbl(1.0 / fps)))
    inside = back.where(F.col("n") >= 16).select(*keys, "j", hz.alias("hz"), amp.alias("amp")).where(
        F.col("hz").between(low, high))
    best = inside.groupBy(*keys).agg(F.max_by("hz", F.struct("amp", -F.col("j"))).alias("hz"),
                                     F.max("amp").alias("peak"), F.avg("amp").alias("mean"))
    return flat.select(*keys).distinct().join(best, keys, "left")
