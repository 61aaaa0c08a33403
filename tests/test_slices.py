"""Ordered operators against plain loops, for several slice widths: a width must never change a result."""

import math
import random

import pytest
from pyspark.sql import functions as F

from postura.config import Thresholds
from postura.functions.posture import posture_raw
from postura.operators import bouts as B
from postura.operators import frames as Fr
from postura.operators import long_series as LS
from postura.operators import signals as SG
from postura.operators import tracklets as K
from postura.operators import trips as TR
from postura.operators.long_series import band_spectrum, prominent_peaks
from postura.operators.ordered import Series, scan
from postura.operators.ordered import stage
from tests import plain

WIDTHS = [1e6, 3.0, 0.7]


def frame_rows(seed, workers=6, n=90):
    rnd = random.Random(seed)
    rows = []
    for w in range(workers):
        label, ts, moving = "standing", 0.0, False
        for i in range(rnd.choice([1, 2, 5, n, n])):
            if rnd.random() < 0.35:
                label = rnd.choice(["standing", "sitting", "bending", "walking", "unknown"])
            if rnd.random() < 0.15:
                moving = not moving
            ts = round(ts + rnd.choice([0.2, 0.4, 0.2, 2.5 if rnd.random() < 0.1 else 0.2]), 3)
            disp = None if rnd.random() < 0.1 else round((20 if moving else 2) + rnd.random() * 4, 2)
            trunk = None if rnd.random() < 0.1 else rnd.choice([5.0, 12.0, 25.0, 45.0, 70.0])
            hip = rnd.choice([None, 90.0, 110.0, 150.0, 170.0])
            knee = rnd.choice([None, 80.0, 110.0, 140.0, 170.0])
            rows.append((1, w, i, ts, label, disp, trunk, hip, knee, round(rnd.random(), 2)))
    return rows


SCHEMA = ("video_id long, worker_id long, frame_idx long, ts double, label string, disp double, trunk double, "
          "hip double, knee double, conf double")


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("seed", [1, 2])
def test_segment_equals_plain_loop(spark, width, seed):
    rows = frame_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.worker_id, r.start_frame): r for r in B.segment(df, limits=Thresholds(chunk_s=width)).collect()}
    want = {}
    for w in {r[1] for r in rows}:
        for b in plain.bouts([(r[3], r[2], r[4], r[5]) for r in rows if r[1] == w]):
            want[(w, b["sf"])] = b
    assert got.keys() == want.keys()
    for k, b in want.items():
        g = got[k]
        assert (g.label, g.start_time, g.end_time, g.end_frame, g.is_rest) == (b["label"], b["s"], b["e"], b["ef"], b["rest"])
        assert math.isclose(g.duration, b["dur"], abs_tol=1e-9) and math.isclose(g.avg_disp, b["d"], abs_tol=1e-9)


@pytest.mark.parametrize("width", WIDTHS)
def test_labels_equal_plain_loop(spark, width):
    rows = frame_rows(5)
    df = spark.createDataFrame(rows, SCHEMA).drop("label")
    got = {(r.worker_id, r.frame_idx): (r.raw_label, r.label)
           for r in Fr.classify(df, "worker_id", Thresholds(chunk_s=width)).collect()}
    c = F.col
    still = df.select("*", posture_raw(c("trunk"), c("hip"), c("knee"), F.lit(False), F.lit(False)).alias("r"))
    raw = {(r.worker_id, r.frame_idx): (r.r.label, r.r.conf) for r in still.collect()}
    for w in {r[1] for r in rows}:
        run, seen = 0, []
        for r in (r for r in rows if r[1] == w):
            run = run + 1 if r[5] is not None and r[5] > 15 else 0
            label, conf = ("walking", 0.88) if run >= 3 else raw[(w, r[2])]
            seen = [*seen, (label, conf * r[9])][-5:]
            assert got[(w, r[2])] == (label, plain.vote(seen))


@pytest.mark.parametrize("width", WIDTHS)
def test_displacement_from_last_valid_point(spark, width):
    rnd = random.Random(3)
    rows = [(1, t, i, i * 0.4, {"x": rnd.random() * 9, "y": rnd.random() * 9} if rnd.random() < 0.5 else None)
            for t in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "video_id long, raw_id long, frame_idx long, ts double, ankle struct<x:double,y:double>")
    got = {(r.raw_id, r.frame_idx): r.disp for r in Fr.displacement(df, limits=Thresholds(chunk_s=width)).collect()}
    for t in range(3):
        last = None
        for r in (r for r in rows if r[1] == t):
            want = None
            if r[4] is not None:
                want = None if last is None else math.dist((r[4]["x"], r[4]["y"]), last)
                last = (r[4]["x"], r[4]["y"])
            assert (got[(t, r[2])] is None) == (want is None)
            assert want is None or math.isclose(got[(t, r[2])], want)
    # the labelling pass takes the displacement along: same values, and same labels as from a given one
    c = F.col
    frames = df.select("*", ((c("frame_idx") * 7 + c("raw_id")) % 50).cast("double").alias("trunk"),
                       F.lit(160.0).alias("hip"), F.lit(None).cast("double").alias("knee"), F.lit(0.7).alias("conf"))
    limits = Thresholds(chunk_s=width, walk_px=4.0)
    along = Fr.classify(frames, limits=limits)
    given = Fr.classify(Fr.displacement(frames, limits=limits).drop("ankle"), limits=limits)
    pick = lambda d: sorted((r.raw_id, r.frame_idx, -1.0 if r.disp is None else r.disp, r.raw_label, r.label) for r in d.collect())
    assert pick(along) == pick(given) and any(r[3] == "walking" for r in pick(along))


def walk(seed, n):
    rnd = random.Random(seed)
    x, y, step, out = 300.0, 200.0, 14.0, []
    for i in range(n):
        if rnd.random() < 0.06:
            step = -step
        x, y = x + step + rnd.random() * 3, y + rnd.random() * 4 - 2
        out.append((i * 0.5, x, y))
    return out


@pytest.mark.parametrize("width", [1e6, 9.0, 2.0])
def test_trips_equal_plain_loop(spark, width):
    paths = {w: walk(w, n) for w, n in [(1, 120), (2, 9), (3, 10), (4, 150)]}
    rows = [(1, w, i, t, x, y) for w, p in paths.items() for i, (t, x, y) in enumerate(p)]
    df = spark.createDataFrame(rows, "video_id long, worker_id long, frame_idx long, ts double, x double, y double")
    limits = Thresholds(chunk_s=width)
    smoothed = stage(TR.moving_avg(df, limits=limits))
    got = sorted((r.worker_id, r.start_time, r.end_time) for r in TR.trips(smoothed, limits=limits).collect())
    want, dist = [], {}
    for w, p in paths.items():
        pts = list(zip([q[0] for q in p], plain.smooth([q[1] for q in p]), plain.smooth([q[2] for q in p])))
        enough = len(p) >= 10
        want += [(w, a, b) for a, b in plain.trips(pts)] if enough else []
        dist[w] = sum(math.dist(pts[i][1:], pts[i - 1][1:]) for i in range(1, len(pts))) if enough else 0.0
    assert got == sorted(want) and len(want) > 3
    counts = {r.worker_id: r for r in TR.count_trips(df, limits=limits).collect()}
    for w in paths:
        assert counts[w].trip_count == sum(1 for t in want if t[0] == w)
        assert math.isclose(counts[w].path_px, round(dist[w], 1), abs_tol=0.051)


def tracks(seed, n=40):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        start, x, y = rnd.random() * 600, rnd.random() * 1500, rnd.random() * 900
        for k in range(rnd.choice([2, 3, 6, 9])):
            rows.append((seed, i, k, round(start + k * 5, 3), x + k * rnd.random() * 30, y + k * rnd.random() * 30))
    return rows


def crowd(rng, n, late):
    """Everyone is lost at about the same time on a small place; a share is seen again soon after."""
    facts = []
    for i in range(n):
        again = i >= n * (1 - late)
        t0 = rng.uniform(60, 90) if again else rng.uniform(0, 20)
        p, q = [(rng.uniform(0, 300), rng.uniform(0, 300)) for _ in range(2)]
        facts.append({"id": i, "t0": round(t0, 3), "t1": round(t0 + rng.uniform(5, 30), 3), "p0": p, "p1": q, "n": 5,
                      "m": ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)})
    return sorted(facts, key=lambda f: (f["t0"], f["id"]))


@pytest.mark.parametrize("late", [0.5, 0.3])
def test_crowds_take_few_pairs(spark, late, monkeypatch):
    """All may follow all: the pairs that are looked at grow with the tracklets, not with their square."""
    looked = {}
    keep = K._nearest
    for n in (150, 600):
        facts = crowd(random.Random(n), n, late)
        meta = stage(spark.createDataFrame(
            [(1, f["id"], f["t0"], f["t1"], f["n"], *f["p0"], *f["p1"], *f["m"]) for f in facts],
            "video_id long, raw_id long, start_time double, end_time double, n_frames long, start_x double, start_y double, end_x double, "
            "end_y double, mean_x double, mean_y double"))
        pairs = []
        monkeypatch.setattr(K, "_nearest", lambda *a: pairs.append((found := stage(keep(*a))).count()) or found)
        got = {r.raw_1: r.raw_2 for r in K.nearest_successors(meta).collect()}
        monkeypatch.undo()
        assert got == plain.links(facts) and len(got) > n / 5
        looked[n] = sum(pairs)
    every = 600 * 600 * late * (1 - late)
    assert looked[600] < every / 4 and looked[600] < 8 * looked[150], (looked, every)


@pytest.mark.parametrize("packed", [0, 80])
def test_wide_videos_look_once(spark, packed, monkeypatch):
    """Many tracklets far apart are no crowd: one round of looking, and only a crowd among them takes more."""
    rng = random.Random(5)
    facts = crowd(rng, packed, 0.4)
    for i in range(packed, packed + 500):
        x, y = (i % 40) * 500 + rng.uniform(0, 250), (i // 40) * 500 + rng.uniform(0, 250)
        for k in range(2):
            t0 = rng.uniform(0, 20) + 60 * k
            p, q = [(x + rng.uniform(0, 200), y + rng.uniform(0, 200)) for _ in range(2)]
            facts.append({"id": 1000 * (k + 1) + i, "t0": round(t0, 3), "t1": round(t0 + rng.uniform(5, 30), 3), "p0": p, "p1": q, "n": 5,
                          "m": ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)})
    facts.sort(key=lambda f: (f["t0"], f["id"]))
    meta = stage(spark.createDataFrame(
        [(1, f["id"], f["t0"], f["t1"], f["n"], *f["p0"], *f["p1"], *f["m"]) for f in facts],
        "video_id long, raw_id long, start_time double, end_time double, n_frames long, start_x double, start_y double, end_x double, "
        "end_y double, mean_x double, mean_y double"))
    looked, keep = [], K._nearest
    monkeypatch.setattr(K, "_nearest", lambda active, *a: looked.append(active.count()) or keep(active, *a))
    got = {r.raw_1: r.raw_2 for r in K.nearest_successors(meta).collect()}
    assert got == plain.links(facts) and len(got) > 300
    assert looked == [len(facts)] if not packed else sum(looked[1:]) < 5 * packed, looked


@pytest.mark.parametrize("width", [1e6, 20.0])
@pytest.mark.parametrize("seed", [11, 12, 13])
def test_stitch_equals_greedy_loop(spark, width, seed):
    rows = tracks(seed)
    df = spark.createDataFrame(rows, "video_id long, raw_id long, frame_idx long, ts double, x double, y double")
    limits = Thresholds(chunk_s=width)
    meta = stage(K.tracklet_meta(df, limits))
    facts = []
    for i in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == i]
        if len(mine) >= 3:
            facts.append({"id": i, "t0": mine[0][3], "t1": mine[-1][3], "p0": mine[0][4:], "p1": mine[-1][4:], "n": len(mine),
                          "m": (sum(r[4] for r in mine) / len(mine), sum(r[5] for r in mine) / len(mine))})
    facts.sort(key=lambda f: (f["t0"], f["id"]))
    want = plain.links(facts)
    got = {r.raw_1: r.raw_2 for r in K.successors(K.stitch_candidates(meta, limits), rounds=2).collect()}
    assert got == want and len(want) > 5
    assert {r.raw_1: r.raw_2 for r in K.nearest_successors(meta, limits, rounds=2).collect()} == want
    # chains and worker numbers
    root = {f["id"]: f["id"] for f in facts}
    for f in facts:
        if f["id"] in want:
            root[want[f["id"]]] = root[f["id"]]
    size, first = {}, {}
    for f in facts:
        size[root[f["id"]]] = size.get(root[f["id"]], 0) + f["n"]
        first.setdefault(root[f["id"]], f["t0"])
    order = sorted(size, key=lambda k: (-size[k], first[k], k))
    ids = {r.raw_id: r.unified_id for r in K.stitch(df, limits).collect()}
    assert ids == {f["id"]: order.index(root[f["id"]]) + 1 for f in facts}
    # concurrency
    moments = sorted([(f["t0"], -1) for f in facts] + [(f["t1"], 1) for f in facts])
    now = peak = 0
    for _, step in moments:
        now -= step
        peak = max(peak, now)
    assert K.peak_concurrency(meta, limits).first().peak_concurrency == peak


def test_mean_places_do_not_depend_on_the_order_of_rows(spark):
    """Sums of doubles end in other bits when rows arrive in another order, and equal distances then are no longer equal."""
    rows = [(1, r, i, i * 0.5, 100 + r * 7.1 + abs(i % 40 - 20) * 12 + 0.1 * i, 200 + r * 11.3 + i / 3) for r in range(40) for i in range(60)]
    seen = set()
    for seed in range(6):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "video_id long, raw_id long, frame_idx long, ts double, x double, y double").repartition(1 + seed)
        seen.add(tuple(sorted((r.raw_id, r.mean_x, r.mean_y) for r in K.tracklet_meta(df).collect())))
    assert len(seen) == 1
    odd = [(1, 1, i, float(i), math.nan, 1e30) for i in range(30)]
    got = K.tracklet_meta(spark.createDataFrame(odd, "video_id long, raw_id long, frame_idx long, ts double, x double, y double")).first()
    assert math.isnan(got.mean_x) and math.isclose(got.mean_y, 1e30)


def test_scan_positions_and_neighbours(spark):
    rnd = random.Random(4)
    rows = [(k, i, rnd.choice([None, i]), i // 7) for k in range(3) for i in range(50) if rnd.random() < 0.8]
    df = spark.createDataFrame(rows, "k long, i long, v long, chunk long")
    got = scan(df, Series(("k",), ("i",)), before={"b": F.col("v")}, after={"a": F.col("v")}, count="n").collect()
    for k in range(3):
        mine = sorted([r for r in rows if r[0] == k], key=lambda r: r[1])
        by = {r.i: r for r in got if r.k == k}
        for p, r in enumerate(mine):
            earlier = [q[2] for q in mine[:p] if q[2] is not None]
            later = [q[2] for q in mine[p + 1:] if q[2] is not None]
            assert (by[r[1]].n, by[r[1]].b, by[r[1]].a) == (p + 1, earlier[-1] if earlier else None,
                                                             later[0] if later else None)


def test_peaks_take_a_fixed_number_of_tables(spark, monkeypatch):
    """However many blocks a series has; slopes leave peaks open over many of them."""
    counts = []
    for n in (64, 1024):
        rows = [(1, 1, "elbow", n, i, float(i % 13) / 13 + (i if i < n // 2 else n - i) * 0.9) for i in range(n)]
        df = spark.createDataFrame(rows, "video_id long, worker_id long, joint string, n int, pos int, value double")
        staged = []
        keep = LS.stage
        monkeypatch.setattr(LS, "stage", lambda t: staged.append(1) or keep(t))
        got = [r.pos for r in LS.prominent_peaks(df, ["video_id", "worker_id", "joint"], 1, 5.0, 8).collect()]
        monkeypatch.undo()
        values = [r[5] for r in rows]
        assert len(got) == 1 and values[got[0]] == max(values)
        counts.append(len(staged))
    assert counts[0] == counts[1]


@pytest.mark.parametrize(("distance", "width"), [(1, 8), (3, 8), (3, 8192)])
def test_find_peaks_equals_plain_loop(spark, distance, width):
    rnd = random.Random(9)
    series = {}
    for w in range(30):
        x = [rnd.choice([0.0, 2.0, 4.0, 6.0, 9.0, 12.0]) for _ in range(rnd.choice([2, 5, 40]))]
        series[w] = [v + i * 1e-6 for i, v in enumerate(x)] if distance > 1 else x
    rows = [(w, i, len(x), v) for w, x in series.items() for i, v in enumerate(x)]
    df = stage(spark.createDataFrame(rows, "worker_id long, pos long, n long, value double"))
    got = sorted((r.worker_id, r.pos) for r in prominent_peaks(df, ["worker_id"], distance, 5.0, width).collect())
    assert got == sorted((w, p) for w, x in series.items() for p in plain.peaks(x, distance, 5.0)) and got


def numpy_spectrum(x, fps, low, high):
    """(hz, amplitude, mean amplitude) of the strongest in-band bin of the windowed series."""
    import numpy as np

    amplitude, hz = np.abs(np.fft.rfft(np.array(x) * np.hanning(len(x)))), np.fft.rfftfreq(len(x), 1 / fps)
    inside = (hz >= low) & (hz <= high)
    if len(x) < 16 or not inside.any():
        return None, None, None
    k = int(np.argmax(amplitude[inside]))
    return float(hz[inside][k]), float(amplitude[inside][k]), float(amplitude[inside].mean())


def test_spectrum_equals_numpy(spark):
    rows = joint_rows(5) + [(1, 7, "trunk", i, 12, float(i % 3)) for i in range(12)]
    df = stage(spark.createDataFrame(rows, "video_id long, worker_id long, joint string, pos long, n long, value double"))
    got = {r.worker_id: r for r in band_spectrum(df, ["video_id", "worker_id", "joint"], 5.0, 0.1, 2.0).collect()}
    for w in (1, 2, 3, 7):
        want = numpy_spectrum([r[5] for r in rows if r[1] == w], 5.0, 0.1, 2.0)
        if want[0] is None:
            assert got[w].hz is None
        else:
            assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip((got[w].hz, got[w].peak, got[w].mean), want))


def test_short_series_take_no_pass_over_blocks(spark, monkeypatch):
    """Only series of several blocks are searched beyond a block, and only those are transformed in two steps; both give the same."""
    rows = joint_rows(5)
    keys = ["video_id", "worker_id", "joint"]
    df = stage(spark.createDataFrame(rows, "video_id long, worker_id long, joint string, pos long, n long, value double"))
    asked, keep, two_step = [], LS._asked, []
    monkeypatch.setattr(LS, "_asked", lambda *a: asked.append([t.count() for t in keep(*a)]) or keep(*a))
    keep_long = LS._long_spectrum
    monkeypatch.setattr(LS, "_long_spectrum", lambda flat, *a: two_step.append(flat.count()) or keep_long(flat, *a))
    peaks = [sorted(tuple(r) for r in prominent_peaks(df, keys, 1, 5.0, width).collect()) for width in (8192, 8)]
    assert peaks[0] == peaks[1] and asked[0] == [0, 0] and asked[1][1] > 0
    whole, cut = ({r.worker_id: r for r in band_spectrum(df, keys, 5.0, 0.1, 2.0, width).collect()} for width in (8192, 8))
    assert two_step[0] == 0 < two_step[1]
    for w in whole:
        assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(whole[w][3:], cut[w][3:]))


def test_peaks_of_series_of_one_block_take_no_scan(spark, monkeypatch):
    """Only series of several blocks go through the scans over slices; both ways give the same peaks, plateaus and ties among them."""
    rnd, series = random.Random(4), {}
    for w in range(60):
        series[w] = [rnd.choice([-3.0, 0.0, 2.0, 2.5, 4.0, 9.0, 9.5, 16.0]) for _ in range(rnd.choice([1, 2, 3, 7, 40]))]
    rows = [(w, i, len(x), v) for w, x in series.items() for i, v in enumerate(x)]
    df = stage(spark.createDataFrame(rows, "worker_id long, pos long, n long, value double"))
    scanned, keep = [], LS._tops
    monkeypatch.setattr(LS, "_tops", lambda t, *a: scanned.append(t.count()) or keep(t, *a))
    for distance in (1, 4):
        whole, cut = (sorted(tuple(r) for r in prominent_peaks(df, ["worker_id"], distance, 5.0, width).collect()) for width in (8192, 4))
        assert whole == cut and len(whole) > 40
        assert [r[::2] for r in whole] == sorted((w, p) for w, x in series.items() for p in plain.peaks(x, distance, 5.0))
    assert scanned == 2 * [0, sum(len(x) for x in series.values() if len(x) > 4)]


@pytest.mark.parametrize("width", [1e6, 2.0])
def test_gaps_are_filled_like_interp(spark, width):
    import numpy as np

    rnd = random.Random(8)
    rows = [(1, w, i, i * 0.5, None if rnd.random() < miss else round(rnd.random() * 50, 1))
            for w, miss in [(1, 0.0), (2, 0.5), (3, 1.0), (4, 0.93)] for i in range(30)]
    df = spark.createDataFrame(rows, "video_id long, worker_id long, frame_idx long, ts double, trunk double")
    got = {}
    for r in SG.fill_gaps(df, limits=Thresholds(chunk_s=width)).collect():
        got.setdefault(r.worker_id, {})[r.pos] = r.value
    for w in (1, 2, 3, 4):
        v = np.array([np.nan if r[4] is None else r[4] for r in rows if r[1] == w])
        ok = ~np.isnan(v)
        if ok.all() or ok.sum() >= 3:
            want = np.interp(np.arange(len(v)), np.flatnonzero(ok), v[ok])
            assert np.allclose([got[w][i] for i in range(len(v))], want)
        else:
            assert w not in got


def test_gaps_are_joined_while_wide_and_series_grouped_once(spark, monkeypatch):
    """What is known of a series meets one row per frame, not one per frame and joint; peaks and spectrum read the same groups."""
    rows = [(1, w, i, i * 0.5, 20 + 15 * math.sin(i), None if i % 7 else 40.0 + i, 5.0) for w in (1, 2) for i in range(60)]
    df = stage(spark.createDataFrame(rows, "video_id long, worker_id long, frame_idx long, ts double, trunk double, elbow double, wrist double"))
    plan = SG.fill_gaps(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Join" not in plan[:plan.index("Expand")]
    grouped, keep = [], LS.whole_series
    for module in (LS, SG):
        monkeypatch.setattr(module, "whole_series", lambda *a: grouped.append(1) or keep(*a))
    got = {(r.worker_id, r.joint): r for r in SG.repetition(df).collect()}
    assert len(grouped) == 1 and len(got) == 6 and got[1, "trunk"].peak_count == 10  # of the sine


def joint_rows(seed):
    rnd = random.Random(seed)
    rows = []
    for w, n in [(1, 61), (2, 64), (3, 97)]:
        level = 0.0
        for i in range(n):
            level = level + rnd.choice([-4.0, -2.0, 0.0, 2.0, 4.0])
            wave = 25 * math.sin(2 * math.pi * i * (0.05 + 0.06 * w)) if w != 3 else 0.0
            rows.append((1, w, "trunk", i, n, round(level + wave, 3)))
    return rows


@pytest.mark.parametrize("rows_per_task,fps", [(8, 5.0), (30, 5.0), (8, 14.0)])
def test_blocks_never_change_a_series(spark, rows_per_task, fps):
    df = stage(spark.createDataFrame(joint_rows(21), "video_id long, worker_id long, joint string, pos long, n long, value double"))
    whole, cut = Thresholds(sample_fps=fps), Thresholds(sample_fps=fps, series_rows=rows_per_task)
    key = lambda limits: sorted((r.worker_id, r.pos) for r in SG.peaks(df, limits=limits).collect())
    assert key(cut) == key(whole) and len(key(whole)) > 10
    a, b = ({r.worker_id: r for r in SG.spectrum_rate(df, limits=x).collect()} for x in (whole, cut))
    assert a == b
