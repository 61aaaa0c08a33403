"""A group of tracks in one state key gives what each track alone gives, with messages to the store by slices, not by tracks."""

import os
import subprocess
import sys
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle

from postura.config import DEFAULTS
from postura.streaming import posture_stream as ST


class Store:
    """Map and value state of one key in a dict; ``calls`` counts what is asked of the map."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def _row(self, key):
        self.calls += 1
        return self.rows.get(key)

    getValue = _row

    def containsKey(self, key):
        return self._row(key) is not None

    def updateValue(self, key, value):
        self._row(key)
        self.rows[key] = value

    def removeKey(self, key):
        self._row(key)
        del self.rows[key]

    def keys(self):
        self.calls += 1
        return iter(list(self.rows))

    def iterator(self):
        return iter(list(self.rows.items()))

    def exists(self):
        return () in self.rows

    def get(self):
        return self.rows[()]

    def update(self, value):
        self.rows[()] = value


class Key:
    """One state key played by hand: frames, then the timers that a watermark lets expire."""

    def __init__(self, given, idle_ms=None):
        self.stores, self.timers = {}, set()
        self.step = ST._Vote(DEFAULTS, given, 10_000, idle_ms)
        make = lambda name, *_: self.stores.setdefault(name, Store())
        self.step.init(SimpleNamespace(getMapState=make, getValueState=make, registerTimer=self.timers.add))

    def play(self, frames, watermark):
        list(self.step.handleInputRows((0,), iter([frames]), None))
        out = []
        for at in sorted(t for t in self.timers if t < watermark):
            self.timers.discard(at)
            out += self.step.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), None)
        return out


def frames(tracks, seed=3):
    """Tracks of two videos and of none with pauses, in no order."""
    rng = np.random.default_rng(seed)
    parts = []
    for k in range(tracks):
        n = int(rng.integers(1, 60))
        ms = np.cumsum(rng.choice([400, 800, 1200, 31_000], n, p=[0.4, 0.4, 0.15, 0.05])) + int(rng.integers(0, 20_000))
        parts.append(pd.DataFrame({
            "ms": ms, "frame_idx": np.arange(n), "ts": ms / 1000, "disp": np.where(rng.random(n) < 0.1, np.nan, rng.choice([0.0, 90.0], n, p=[0.3, 0.7])),
            "ax": np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, 90, n)), "ay": rng.integers(0, 90, n).astype(float),
            "conf": rng.choice([0.5, 0.9], n), "still": rng.integers(0, 4, n), "still_conf": rng.choice([0.6, 0.8], n),
            "video_id": k % 3 % 2, "raw_id": k // 3, "has_video": int(k % 3 < 2), "has_track": 1}))
    return pd.concat(parts).sample(frac=1, random_state=seed)


def labels(key, rows):
    out = []
    for k, upto in enumerate((25_000, 60_000, 10 ** 9)):
        low = (0, 25_000, 60_000)[k]
        out += key.play(rows[(rows["ms"] >= low) & (rows["ms"] < upto)], upto)
    some = pd.concat(out)
    return {(None if v is pd.NA or v != v else int(v), r, f): (a, b) for v, r, f, a, b in
            zip(some["video_id"], some["raw_id"], some["frame_idx"], some["raw_label"], some["label"])}


@pytest.mark.parametrize("given", [True, False])
@pytest.mark.parametrize("idle_ms", [None, 15_000])
def test_a_group_labels_as_each_track_alone(given, idle_ms):
    rows = frames(40)
    alone = {}
    for _, mine in rows.groupby(["has_video", "video_id", "raw_id"]):
        alone |= labels(Key(given, idle_ms), mine)
    assert labels(Key(given, idle_ms), rows) == alone and len(alone) == len(rows)


def test_tracks_that_rest_are_given_up():
    key = Key(True, 15_000)
    rows = frames(40)
    end = (int(rows["ms"].max()) // 10_000 + 1) * 10_000
    key.play(rows, end + 1)
    assert key.stores["held"].rows == {} and len(key.stores["tracks"].rows) == 40
    for at in (10 ** 9, 2 * 10 ** 9):
        key.play(rows[:0], at)
    assert key.stores["tracks"].rows == {} and not key.timers


def test_messages_go_by_slices():
    """Ten times the tracks ask the buffer no more often."""
    def asked(tracks):
        key, rows = Key(True), frames(tracks)
        rows["ms"] = rows["ms"] % 40_000
        key.play(rows, 10 ** 9)
        return key.stores["held"].calls

    assert asked(300) == asked(30) <= 2 + 3 * 4


def test_the_state_step_needs_no_copy_of_the_package(tmp_path):
    """Executors, and the driver's own Python process, unpickle it without the package on their path."""
    (tmp_path / "step").write_bytes(cloudpickle.dumps(ST._Vote(DEFAULTS, True, 10_000, None)))
    code = "import pickle; step = pickle.load(open('step', 'rb')); assert step.window; import sys; assert 'postura' not in sys.modules"
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=clean, check=True, timeout=120)
