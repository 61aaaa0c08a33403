"""Plain loops that restate the sequential definitions, to compare the Spark operators with on small inputs."""

import math


def vote(history):
    totals = {}
    for label, conf in history:
        totals[label] = totals.get(label, 0.0) + max(0.1, conf)
    best = max(totals.values())
    return next(label for label in totals if totals[label] == best)


def bouts(rows, min_s=1.0, rest_px=5.0, rest_s=5.0):
    """rows: (ts, frame, label, disp or None) in time order → list of dicts."""
    raw, start, disps = [], 0, []
    for i, (ts, frame, label, disp) in enumerate(rows):
        if disp is not None:
            disps.append(disp)
        current = rows[start][2]
        if label == current and i < len(rows) - 1:
            continue
        raw.append({"label": current, "s": rows[start][0], "e": ts, "sf": rows[start][1], "ef": frame,
                    "d": sum(disps) / len(disps) if disps else 0.0})
        if label != current:
            start, disps = i, [] if disp is None else [disp]
    kept = raw
    if len(raw) > 1:
        kept = []
        for b in raw:
            if round(b["e"] - b["s"], 2) >= min_s:
                kept.append(dict(b))
            elif kept:
                kept[-1].update(e=b["e"], ef=b["ef"])
        kept = kept or raw[:1]
    out = []
    for b in kept:
        if out and out[-1]["label"] == b["label"]:
            out[-1].update(e=b["e"], ef=b["ef"], d=(out[-1]["d"] + b["d"]) / 2)
        else:
            out.append(dict(b))
    for b in out:
        b["dur"] = round(b["e"] - b["s"], 2)
        b["rest"] = b["label"] in ("standing", "sitting") and b["d"] < rest_px and b["dur"] >= rest_s
    return out


def turn(a, b):
    d = a - b
    return d - 360 if d > 180 else d + 360 if d < -180 else d


def smooth(values):
    n = len(values)
    return [sum(values[j] for j in range(max(0, i - 2), min(n, i + 3))) / 5 for i in range(n)]


def trips(points):
    """points: (ts, x, y), already smoothed → list of (start, end)."""
    heading = [None] + [math.degrees(math.atan2(points[i][2] - points[i - 1][2], points[i][1] - points[i - 1][1]))
                        for i in range(1, len(points))]
    found, origin, course, fresh, held = [], 0, heading[1], None, 0
    for i in range(2, len(points)):
        reach = math.hypot(points[i][1] - points[origin][1], points[i][2] - points[origin][2])
        if not (abs(turn(heading[i], course)) > 90 and reach > 50):
            fresh, held = None, 0
            continue
        if fresh is None:
            fresh, held = heading[i], 1
        elif abs(turn(heading[i], fresh)) < 45:
            held += 1
        else:
            fresh, held = None, 0
        if held >= 5:
            found.append((points[origin][0], points[i][0]))
            origin, course, fresh, held = i, heading[i], None, 0
    return found


def links(meta, gap=120.0, far=400.0):
    """meta: dicts with id, t0, t1, p0, p1, m, in start order → {earlier id: later id}."""
    taken, out = set(), {}
    for i, a in enumerate(meta):
        best = None
        for b in meta[i + 1:]:
            if b["id"] in taken or not -2.0 <= b["t0"] - a["t1"] <= gap:
                continue
            d = min(math.dist(a["p1"], b["p0"]), math.dist(a["m"], b["m"]))
            if d <= far and (best is None or d < best[0]):
                best = (d, b["id"])
        if best:
            taken.add(best[1])
            out[a["id"]] = best[1]
    return out


def peaks(x, distance, prominence):
    tops, i = [], 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if j < len(x) - 1 and x[j + 1] < x[i]:
                tops.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    kept = set(tops)
    for p in sorted(tops, key=lambda p: (x[p], p), reverse=True):
        if p in kept:
            kept -= {q for q in tops if q != p and abs(q - p) < distance}
    out = []
    for p in sorted(kept):
        lo = hi = x[p]
        for q in range(p, -1, -1):
            if x[q] > x[p]:
                break
            lo = min(lo, x[q])
        for q in range(p, len(x)):
            if x[q] > x[p]:
                break
            hi = min(hi, x[q])
        if x[p] - max(lo, hi) >= prominence:
            out.append(p)
    return out
