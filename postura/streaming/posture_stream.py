"""Online posture labels and five-minute posture shares on Structured Streaming."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from postura import tables as T
from postura.config import DEFAULTS, Thresholds
from postura.functions.numeric import dbl, rnd
from postura.functions.posture import posture_raw

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_OUT = "video_id long, raw_id long, frame_idx long, ts double, raw_label string, label string"
_HELD = np.dtype([("ms", "<i8"), ("frame_idx", "<i8"), ("ts", "<f8"), ("disp", "<f8"), ("ax", "<f8"), ("ay", "<f8"), ("conf", "<f8"),
                  ("still", "u1"), ("still_conf", "<f8"), ("video_id", "<i8"), ("raw_id", "<i8"), ("has_video", "u1"), ("has_track", "u1")])
#: Of the last frames of a track: label and weight.
_SEEN = np.dtype([("label", "u1"), ("weight", "<f8")])
#: Of a track: running movement, last ankle point, time of the last frame; its last frames follow.
_TRACK = np.dtype([("run", "<i8"), ("ax", "<f8"), ("ay", "<f8"), ("ms", "<i8")])
#: Frames that are labelled at once: as many slices of a group as make this number, one at least.
PASS = 65_536
#: Where ``ts`` as a clock begins (2000-01-01): a watermark begins at 1970 and takes what lies there as late.
START = 946_684_800
#: The labels by number, held here: what the state step names of this module travels with it, other modules would have to be on the path.
LABELS = tuple(T.LABELS)
WALKING = LABELS.index("walking")


def moves(rows: np.ndarray, start: np.ndarray, ax: np.ndarray, ay: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance of each ankle point from the last valid one before it in its series, and the last valid one up to each row.

    ``start`` is where the series of a row begins, ``ax`` and ``ay`` the last valid point before that (nan: none).
    """
    at = np.arange(len(rows))
    valid = np.maximum.accumulate(np.where(np.isnan(rows["ax"]), -1, at))
    before = np.concatenate([[-1], valid[:-1]])

    def known(name: str, first: np.ndarray, where: np.ndarray) -> np.ndarray:
        return np.where(where >= start, rows[name][np.maximum(where, 0)], first)

    dx, dy = rows["ax"] - known("ax", ax, before), rows["ay"] - known("ay", ay, before)
    return np.sqrt(dx * dx + dy * dy), known("ax", ax, valid), known("ay", ay, valid)


def run_lengths(moving: np.ndarray, before: int | np.ndarray, start: int | np.ndarray = 0) -> np.ndarray:
    """Length so far of the run of true values in a series that begins at ``start``, where a run of the given length came before."""
    at = np.arange(len(moving))
    last = np.maximum.accumulate(np.where(moving, -1, at))
    return np.where(last < start, at - start + 1 + before, at - last)


def votes(label: np.ndarray, weight: np.ndarray, first: int, window: int, start: int | np.ndarray = 0) -> np.ndarray:
    """Weighted majority of each position from ``first`` on over the window that ends there, in a series that begins at ``start``;
    a tie goes to the label seen first."""
    at = np.arange(first, len(label))
    total, seen = np.zeros((len(at), len(LABELS))), np.full((len(at), len(LABELS)), len(label))
    rows = np.arange(len(at))
    for back in range(window - 1, -1, -1):
        inside = at - back >= start
        some, k = rows[inside], at[inside] - back
        total[some, label[k]] += weight[k]
        seen[some, label[k]] = np.minimum(seen[some, label[k]], k)
    best = total == total.max(1, keepdims=True)
    return np.where(best, seen, len(label) + 1).argmin(1)


class _Vote(StatefulProcessor):
    """Frames wait in slices of event time until the watermark has passed a slice; then it is labelled in order.

    A key is a group of tracks, so that what each call and each message to the state store costs is shared by the frames of
    many tracks. The buffer is a map from slice to frames of the group; what is in hand at once is one slice of a group,
    or some that have few frames, and what is stored is bounded by the lateness. Between slices a track's entry keeps the labels that
    the vote looks back at, the running movement and the last ankle point.
    """

    def __init__(self, limits: Thresholds, given: bool, slice_ms: int, idle_ms: int | None):
        self.window, self.walk_frames, self.walk_px = limits.vote_frames, limits.walk_frames, limits.walk_px
        self.given, self.slice_ms, self.idle_ms = given, slice_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "slice long", "frames binary")
        self.tracks = handle.getMapState("tracks", "track string", "state binary")
        self.clock = handle.getValueState("clock", "due long, sweep long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = None
        for chunk in rows:
            packed = np.zeros(len(chunk), dtype=_HELD)
            for name in _HELD.names:
                packed[name] = chunk[name].to_numpy()
            packed = packed[packed["has_track"] == 1]  # a row without a track only moves the time on
            if not len(packed):
                continue
            held = {k for (k,) in self.held.keys()} if held is None else held
            packed = packed[np.argsort(packed["ms"] // self.slice_ms, kind="stable")]
            slices, at = np.unique(packed["ms"] // self.slice_ms, return_index=True)
            for k, some in zip(slices.tolist(), np.split(packed, at[1:])):
                before = bytes(self.held.getValue((k,))[0]) if k in held else b""
                self.held.updateValue((k,), (before + some.tobytes(),))
                held.add(k)
        if held:
            self._wake((min(held) + 1) * self.slice_ms, *self._planned())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // self.slice_ms
        held = sorted(k for (k,) in self.held.keys())
        over = [k for k in held if k < now]
        some, size = [], 0
        for k in over:
            some.append(np.frombuffer(bytes(self.held.getValue((k,))[0]), dtype=_HELD))
            self.held.removeKey((k,))
            size += len(some[-1])
            if size >= PASS or k == over[-1]:
                yield self._labelled(np.concatenate(some))
                some, size = [], 0
        due, sweep = self._planned()
        if self.idle_ms is not None and (over or sweep is not None):
            sweep = self._swept(now * self.slice_ms, sweep)
        if len(over) < len(held):
            self._wake((held[len(over)] + 1) * self.slice_ms, due, sweep)
        else:
            self.clock.update((None, sweep))

    def _planned(self) -> tuple[int | None, int | None]:
        return self.clock.get() if self.clock.exists() else (None, None)

    def _wake(self, at: int, due: int | None, sweep: int | None) -> None:
        """One timer a group, at the end of its first slice; one that an earlier frame made needless finds nothing to do."""
        if at != due:
            self.handle.registerTimer(at)
        self.clock.update((at, sweep))

    def _swept(self, now: int, sweep: int | None) -> int | None:
        """Give up the tracks that were silent for too long, once in such a time; the next time to do so, never the end of a slice."""
        if sweep is not None:
            if now < sweep:
                return sweep
            states = [(track, np.frombuffer(bytes(state), dtype=_TRACK, count=1)["ms"][0]) for (track,), (state,) in self.tracks.iterator()]
            idle = [track for track, ms in states if ms + self.idle_ms < now]
            for track in idle:
                self.tracks.removeKey((track,))
            if len(idle) == len(states):
                return None
        after = ((now + self.idle_ms) // self.slice_ms + 1) * self.slice_ms + 1
        self.handle.registerTimer(after)
        return after

    def _labelled(self, rows: np.ndarray) -> pd.DataFrame:
        """The frames of some slices of many tracks; a series is a track, or what follows a long rest in it."""
        slices = rows["ms"] // self.slice_ms
        order = np.lexsort((rows["frame_idx"], rows["ts"], slices, rows["raw_id"], rows["video_id"], rows["has_video"]))
        rows, slices, at = rows[order], slices[order], np.arange(len(rows))
        differs = lambda a: np.concatenate([[True], a[1:] != a[:-1]])
        new = differs(rows["raw_id"]) | differs(rows["video_id"]) | differs(rows["has_video"])
        first = np.flatnonzero(new)
        names = [f"{r['video_id'] if r['has_video'] else ''}:{r['raw_id']}" for r in rows[first]]
        packed = [bytes(self.tracks.getValue((n,))[0]) if self.tracks.containsKey((n,)) else None for n in names]
        fresh = np.array([p is None for p in packed])
        before = np.zeros(len(names), dtype=_TRACK)
        before["ax"] = before["ay"] = np.nan
        for i, p in enumerate(packed):
            if p is not None:
                before[i] = np.frombuffer(p, dtype=_TRACK, count=1)[0]
        begin = new
        if self.idle_ms is not None:
            silent = rows["ms"] - np.concatenate([[0], rows["ms"][:-1]])
            silent[first] = np.where(fresh, 0, rows["ms"][first] - before["ms"])
            rested = (new | differs(slices)) & (silent > self.idle_ms)
            fresh |= rested[first]
            begin = new | rested
            before["run"][fresh], before["ax"][fresh], before["ay"][fresh] = 0, np.nan, np.nan
        start, number = np.maximum.accumulate(np.where(begin, at, 0)), np.cumsum(begin) - 1
        carried = np.zeros(len(rows), dtype=_TRACK)
        carried["ax"] = carried["ay"] = np.nan
        carried[first] = before
        carried = carried[start]
        moved, ax, ay = (rows["disp"], carried["ax"], carried["ay"]) if self.given else moves(rows, start, carried["ax"], carried["ay"])
        runs = run_lengths(moved > self.walk_px, carried["run"], start)  # a missing displacement (nan) ends the run
        walks = runs >= self.walk_frames
        here = np.zeros(len(rows), dtype=_SEEN)
        here["label"] = np.where(walks, WALKING, rows["still"])
        here["weight"] = np.fmax(0.1, np.where(walks, 0.88, rows["still_conf"]) * rows["conf"])
        # the last frames of a series stand before its new ones
        seen = [np.frombuffer(p[_TRACK.itemsize:], dtype=_SEEN) if p is not None and not f else here[:0] for p, f in zip(packed, fresh)]
        whose = np.concatenate([np.repeat(number[first], [len(s) for s in seen]), number])
        order = np.argsort(whose, kind="stable")
        both, whose = np.concatenate([*seen, here])[order], whose[order]
        of_both = np.searchsorted(whose, np.arange(number[-1] + 2))  # where each series begins, and the end
        best = votes(both["label"], both["weight"], 0, self.window, of_both[whose])[order >= len(order) - len(rows)]
        for n, end in zip(names, np.append(first[1:], len(rows)) - 1):
            low, high = of_both[number[end]], of_both[number[end] + 1]
            state = np.array([(runs[end], ax[end], ay[end], rows["ms"][end])], dtype=_TRACK)
            self.tracks.updateValue((n,), (state.tobytes() + both[max(low, high - self.window + 1):high].tobytes(),))
        text = np.array(LABELS, dtype=object)
        video = pd.arrays.IntegerArray(rows["video_id"].copy(), rows["has_video"] == 0)
        return pd.DataFrame({"video_id": video, "raw_id": rows["raw_id"], "frame_idx": rows["frame_idx"], "ts": rows["ts"],
                             "raw_label": text[here["label"]], "label": text[best]})

    def close(self) -> None:
        pass


def stream_posture(frames: DataFrame, limits: Thresholds = DEFAULTS, lateness: str = "30 seconds", slice_s: float = 10.0,
                   idle_s: float | None = None, event_time: str | None = None, groups: int = 128) -> DataFrame:
    """Streaming frames of each track to raw and smoothed labels, equal to the batch result.

    Frames may come in any order and in any batch, as long as none comes after one that is ``lateness`` newer (in the whole
    stream, by ``event_time``, else by ``ts`` as seconds of a common clock): a frame comes out once the watermark has
    passed the end of its slice, and one behind the watermark is dropped. A row without ``raw_id`` only moves the time on. A frame
    without a time is dropped.

    With ``idle_s`` (at least a slice), a track that was silent for longer starts anew and its state is given up.

    Tracks are dealt to ``groups`` keys of the state. A task holds a slice of one group at a time, so more tracks at once want more groups, and
    fewer frames at a time fewer; a checkpoint goes with its number.

    The rules run as columns on the JVM; the stateful part only orders frames, counts movement and votes, in arrays. Needs the
    RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    slice_ms, idle_ms = round(slice_s * 1000), None if idle_s is None else round(idle_s * 1000)
    if idle_ms is not None and idle_ms < slice_ms:
        raise ValueError("a track cannot be idle for less than a slice")
    low = F.col("hips_low") if "hips_low" in frames.columns else F.lit(False)
    still = posture_raw(F.col("trunk"), F.col("hip"), F.col("knee"), F.lit(False), low, limits)
    given = "disp" in frames.columns  # else the displacement is taken from the ankle point, kept in the state
    none = F.lit(None).cast("double")
    moved = [F.col("disp") if given else none.alias("disp")]
    moved += [none.alias("ax"), none.alias("ay")] if given else [F.col("ankle.x").alias("ax"), F.col("ankle.y").alias("ay")]
    own = F.timestamp_micros((F.rint(F.col("ts") * 1e6) + F.lit(START * 1e6)).cast("long"))
    time = F.col(event_time).cast("timestamp") if event_time else own
    number = F.create_map(*[x for i, v in enumerate(LABELS) for x in (F.lit(v), F.lit(i))])
    ready = frames.select("video_id", "raw_id", "frame_idx", "ts", F.col("conf").cast("double").alias("conf"), *moved, still.alias("_s"),
                          time.alias("event_time")).where(F.col("event_time").isNotNull())
    rows = ready.select("video_id", "raw_id", "event_time", F.unix_millis("event_time").alias("ms"),
                        F.coalesce("frame_idx", F.lit(0)).alias("frame_idx"), F.coalesce("ts", F.lit(0.0)).alias("ts"), "disp", "ax", "ay",
                        "conf", F.element_at(number, F.col("_s.label")).alias("still"), F.col("_s.conf").alias("still_conf"),
                        F.col("video_id").isNotNull().cast("int").alias("has_video"), F.col("raw_id").isNotNull().cast("int").alias("has_track"),
                        F.pmod(F.xxhash64("video_id", "raw_id"), F.lit(groups)).alias("tracks"))
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("video_id", "raw_id")})
    return rows.withWatermark("event_time", lateness).groupBy("tracks").transformWithStateInPandas(
        statefulProcessor=_Vote(limits, given, slice_ms, idle_ms), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")


def exposure_5min(labelled: DataFrame, ts: str = "event_time", lateness: str = "10 minutes", width: str = "5 minutes",
                  frame: str | None = None) -> DataFrame:
    """Share of each label among the frames of a worker in tumbling windows; one function for batch and stream.

    A stream gives a window out when the watermark has passed its end; a frame behind the watermark is dropped. ``frame`` names the
    column that tells the frames of a worker apart: a frame that is delivered again counts once (in a stream: within the
    lateness, which is how long it is remembered).
    """
    key = ["video_id", "worker_id", frame]
    if labelled.isStreaming:
        labelled = labelled.withWatermark(ts, lateness)
        labelled = labelled.dropDuplicatesWithinWatermark(key) if frame else labelled
    elif frame:
        labelled = labelled.dropDuplicates(key)
    counts = [F.count_if(F.col("label") == v).alias(f"_{v}") for v in T.LABELS]
    per = labelled.groupBy("video_id", "worker_id", F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("n_frames"), *counts)
    pct = lambda v: rnd(F.col(f"_{v}") / F.col("n_frames") * dbl(100), 1).alias(f"{v}_pct")
    return per.select("video_id", "worker_id", F.col("w.start").alias("window_start"), "n_frames",
                      *[pct(v) for v in T.LABELS])


def event_time(ts_seconds: Column, start: Column) -> Column:
    """Video start plus seconds."""
    return F.timestamp_micros((F.unix_micros(start) + F.rint(ts_seconds * 1e6)).cast("long"))
