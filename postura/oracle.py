"""Independent SQL for the registered queries, for checking them on the test tables with another engine.

Written from the definitions, not from the Spark code: plain windows, joins and recursion over whole tables. Named
building blocks (``BLOCKS``) are put together into one WITH clause per query.
"""

from __future__ import annotations

import re

from postura import tables as T


def r(x: str, k: int) -> str:
    """Half-even rounding to k places."""
    return f"(round_even(({x})*1e{k}, 0)/1e{k})"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hms(s: str) -> str:
    """HH:MM:SS of whole, non-negative seconds."""
    v = f"CAST({s} AS BIGINT)"
    return f"printf('%02d:%02d:%02d', {v}//3600, ({v}%3600)//60, {v}%60)"


def hms_r(x: str) -> str:
    return hms(f"greatest(0e0, round_even({x}, 0))")


def hms_t(x: str) -> str:
    return hms(f"greatest(0e0, floor({x}))")


def clip(x: str, a: str, b: str) -> str:
    return f"greatest({a}, least({b}, {x}))"


def ranges(x: str, rows: list, missing: int) -> str:
    whens = " ".join(f"WHEN {x} >= {a} AND {x} < {b} THEN {s}" for a, b, s in rows)
    return f"(CASE WHEN {x} IS NULL THEN {missing} {whens} ELSE {rows[-1][2]} END)"


def level(x: str, rows: list, which: int) -> str:
    return "(CASE " + " ".join(f"WHEN {x} BETWEEN {w[0]} AND {w[1]} THEN {q(w[which])}" for w in rows) + " END)"


BLOCKS: dict[str, str] = {}

# ------------------------------------------------------------------ test views

BLOCKS["f"] = """
  SELECT e AS event_id, k, seq, u % 25 AS video_id, u AS worker_id, u*10 + seq//20 AS raw_id, seq*15 AS frame_idx,
    seq*0.8e0 + u*0.13e0 AS ts,
    CASE WHEN e%23 <> 0 THEN [5e0,10e0,45e0,70e0,12e0,8e0][phase+1] + (e%8)*0.25e0 END AS trunk,
    [170e0,90e0,150e0,140e0,100e0,165e0][phase+1] AS hip,
    CASE WHEN e%17 <> 0 THEN [172e0,110e0,165e0,150e0,80e0,168e0][phase+1] END AS knee,
    CASE WHEN e%29 <> 0 THEN CASE WHEN phase = 5 THEN 18e0 + e%10 ELSE (e%12)*0.4e0 END END AS disp,
    0.5e0 + (e%50)*0.01e0 AS conf, 20.25e0 + (e*13)%90 AS shoulder,
    80e0 + 8e0*abs(seq % (6 + u%7) - 3) AS elbow,
    CASE WHEN e%31 <> 0 THEN 0.25e0 + (e*11)%180 END AS wrist,
    CASE WHEN e%19 <> 0 THEN 0.5e0 + (e*7)%40 END AS neck,
    100e0 + u*7.1e0 + 12e0*abs(seq%40 - 20) AS x, 200e0 + u*11.3e0 AS y
  FROM (SELECT *, (((seq+u)//(4 + u%5))*7 + u*3) % 6 AS phase FROM (SELECT e, u, k, (n//17)*20 + n%17 AS seq FROM (
    SELECT event_id AS e, user_id AS u, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)))"""

BLOCKS["vid"] = """
  SELECT CAST(n_nationkey AS BIGINT) AS video_id,
    lower(n_name) || ['.mp4','.avi','.mov','.mkv','.wmv','.txt'][n_nationkey%6 + 1] AS name,
    24e0 + (n_nationkey%3)*3e0 AS fps, CAST(2000 + n_nationkey*3000 AS BIGINT) AS total_frames,
    CAST(n_nationkey*100 AS BIGINT) AS size_mb,
    """ + r("(2000 + n_nationkey*3000)/(24e0 + (n_nationkey%3)*3e0)", 2) + """ AS duration_s
  FROM nation"""

BLOCKS["kp"] = """
  SELECT vec_id AS obs_id, CAST(label AS BIGINT) AS video_id, vec_id % 4 AS raw_id, vec_id AS frame_idx,
    vec_id*0.2e0 AS ts,
    [320e0 + 400e0*CAST(embedding[2*i+1] AS DOUBLE) FOR i IN range(17)] AS kx,
    [240e0 + 400e0*CAST(embedding[2*i+2] AS DOUBLE) FOR i IN range(17)] AS ky,
    [least(1e0, 10e0*abs(CAST(embedding[i+35] AS DOUBLE))) FOR i IN range(17)] AS kc
  FROM embeddings"""

_J = {"nose": 0, "l_sh": 5, "r_sh": 6, "l_el": 7, "r_el": 8, "l_wr": 9, "r_wr": 10, "l_hip": 11, "r_hip": 12,
      "l_kn": 13, "r_kn": 14, "l_an": 15, "r_an": 16}

BLOCKS["joints"] = (
    "\n  SELECT obs_id, video_id, raw_id, frame_idx, ts, kc, "
    + ", ".join(f"kx[{i+1}] AS {j}_x, ky[{i+1}] AS {j}_y, kc[{i+1}] AS {j}_c, "
                f"kc[{i+1}] >= 0.3e0 AND NOT (abs(kx[{i+1}]) <= 1e-8 AND abs(ky[{i+1}]) <= 1e-8) AS {j}_ok"
                for j, i in _J.items()) + " FROM kp")


def _a3(a: str, b: str, c: str) -> str:
    ux, uy, vx, vy = f"({a}_x-{b}_x)", f"({a}_y-{b}_y)", f"({c}_x-{b}_x)", f"({c}_y-{b}_y)"
    cos = f"({ux}*{vx}+{uy}*{vy})/(sqrt({ux}*{ux}+{uy}*{uy})*sqrt({vx}*{vx}+{vy}*{vy})+1e-8)"
    return f"degrees(acos({clip(cos, '-1e0', '1e0')}))"


def _av(tx: str, ty: str, bx: str, by: str) -> str:
    dx, dy = f"(({tx})-({bx}))", f"(({ty})-({by}))"
    cos = f"(-{dy})/(sqrt({dx}*{dx}+{dy}*{dy})+1e-8)"
    return f"degrees(acos({clip(cos, '-1e0', '1e0')}))"


def _ok(*js: str) -> str:
    return " AND ".join(f"{j}_ok" for j in js)


def _three(a: str, b: str, c: str) -> str:
    return f"CASE WHEN {_ok(a, b, c)} THEN {_a3(a, b, c)} END"


_MSX, _MSY, _MHX, _MHY = "(l_sh_x+r_sh_x)/2", "(l_sh_y+r_sh_y)/2", "(l_hip_x+r_hip_x)/2", "(l_hip_y+r_hip_y)/2"
BLOCKS["sides"] = (
    "\n  SELECT obs_id, "
    f"CASE WHEN {_ok('l_sh','r_sh','l_hip','r_hip')} THEN {_av(_MSX, _MSY, _MHX, _MHY)} END AS trunk, "
    f"CASE WHEN {_ok('nose','l_sh','r_sh')} THEN {_av('nose_x','nose_y',_MSX,_MSY)} END AS neck, "
    + ", ".join(
        f"{_three(s+'_sh', s+'_hip', s+'_kn')} AS {n}_hip, {_three(s+'_hip', s+'_kn', s+'_an')} AS {n}_knee, "
        f"{_three(s+'_sh', s+'_el', s+'_wr')} AS {n}_elbow, {_three(s+'_hip', s+'_sh', s+'_el')} AS {n}_shoulder, "
        f"CASE WHEN {_ok(s+'_el', s+'_wr')} THEN {_av(s+'_wr_x', s+'_wr_y', s+'_el_x', s+'_el_y')} END AS {n}_wrist"
        for s, n in (("l", "left"), ("r", "right"))) + " FROM joints")
BLOCKS["angles"] = (
    "\n  SELECT *, "
    + ", ".join(f"(CASE WHEN left_{p} IS NULL THEN right_{p} WHEN right_{p} IS NULL THEN left_{p} "
                f"ELSE (left_{p}+right_{p})/2 END) AS avg_{p}" for p in ("hip", "knee", "elbow", "shoulder"))
    + ", greatest(left_shoulder, right_shoulder) AS max_shoulder FROM sides")


def _pt(a: str, b: str, axis: str) -> str:
    return (f"CASE WHEN {a}_c >= 0.3e0 AND {b}_c >= 0.3e0 THEN ({a}_{axis}+{b}_{axis})/2 "
            f"WHEN {a}_c >= 0.3e0 THEN {a}_{axis} WHEN {b}_c >= 0.3e0 THEN {b}_{axis} END")


def _height(a: str, b: str) -> str:
    return (f"CASE WHEN {a}_c > 0.3e0 AND {b}_c > 0.3e0 THEN ({a}_y+{b}_y)/2 "
            f"WHEN {a}_c > 0.3e0 THEN {a}_y WHEN {b}_c > 0.3e0 THEN {b}_y END")


BLOCKS["points"] = (
    "\n  SELECT obs_id, video_id, raw_id, frame_idx, ts, "
    f"{_pt('l_hip','r_hip','x')} AS cx, {_pt('l_hip','r_hip','y')} AS cy, {_pt('l_an','r_an','x')} AS ax, "
    f"{_pt('l_an','r_an','y')} AS ay, {_height('l_hip','r_hip')} AS hh, {_height('l_an','r_an')} AS ah, "
    f"{_height('l_sh','r_sh')} AS sh, coalesce(list_avg(list_filter(kc, lambda c: c > 0.1e0)), 0.5e0) AS mean_conf "
    "FROM joints")

BLOCKS["det"] = """
  SELECT event_id AS det_id, video_id, frame_idx, ts, [24,26,28,43,76,39,0,99][k%8 + 1] AS class_id,
    0.2e0 + (event_id%80)/100e0 AS confidence, x + (event_id%300) - 150e0 AS cx, y AS cy
  FROM f"""
BLOCKS["names"] = "\n  SELECT * FROM (VALUES " + ", ".join(
    f"({k}, {q(v)})" for k, v in sorted(T.WORK_CLASSES.items())) + ") AS t(class_id, class_name)"
BLOCKS["obj"] = """
  SELECT det.*, class_name FROM det JOIN names USING (class_id) WHERE class_id <> 0 AND confidence >= 0.35e0"""

# ------------------------------------------------------------------ labels


def labels(source: str, key: str, low: str = "false", name: str = "") -> dict[str, str]:
    p = name or f"lab_{key}"
    return {
        p + "_0": f"""
  SELECT *, row_number() OVER w AS rn, coalesce(disp > 15, false) AS moving,
    coalesce(sum(CASE WHEN disp > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, {key} ORDER BY ts, frame_idx
      ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0) = 3 AS walking
  FROM {source} WINDOW w AS (PARTITION BY video_id, {key} ORDER BY ts, frame_idx)""",
        p + "_1": f"""
  SELECT *, CASE WHEN walking THEN 1
    WHEN knee < 95 AND ({low} OR hip < 105) THEN 2
    WHEN trunk > 30 AND (knee IS NULL OR knee >= 130) THEN 3
    WHEN hip < 120 AND knee BETWEEN 70 AND 135 THEN 4
    WHEN hip < 120 AND trunk < 30 THEN 5
    WHEN trunk < 15 AND hip > 145 THEN 6
    WHEN trunk < 15 AND knee > 150 THEN 7
    WHEN trunk < 30 THEN 8 WHEN trunk IS NOT NULL THEN 9 ELSE 10 END AS rule FROM {p}_0""",
        p + "_2": f"""
  SELECT *, ['walking','squatting','bending','sitting','sitting','standing','standing','standing','bending',
             'unknown'][rule] AS raw_label,
    CASE WHEN rule = 3 THEN least(0.96e0, 0.65e0 + trunk/100)
         ELSE [0.88e0,0.92e0,0e0,0.85e0,0.80e0,0.92e0,0.90e0,0.65e0,0.70e0,0e0][rule] END AS rule_conf FROM {p}_1""",
        p + "_3": f"""
  SELECT video_id, {key}, rn, label FROM (
    SELECT a.video_id, a.{key}, a.rn, b.raw_label AS label,
      row_number() OVER (PARTITION BY a.video_id, a.{key}, a.rn
        ORDER BY sum(greatest(0.1e0, b.rule_conf*b.conf) ORDER BY b.rn) DESC, min(b.rn)) AS place
    FROM {p}_2 a JOIN {p}_2 b ON a.video_id = b.video_id AND a.{key} = b.{key} AND b.rn BETWEEN a.rn-4 AND a.rn
    GROUP BY a.video_id, a.{key}, a.rn, b.raw_label) WHERE place = 1""",
        p: f"""
  SELECT a.*, a.rule_conf*a.conf AS frame_conf, v.label FROM {p}_2 a
  JOIN {p}_3 v ON a.video_id = v.video_id AND a.{key} = v.{key} AND a.rn = v.rn""",
    }


BLOCKS.update(labels("f", "worker_id"))
BLOCKS.update(labels("f", "raw_id"))
BLOCKS.update(labels("f", "worker_id", "event_id % 5 = 0", "low"))

# ------------------------------------------------------------------ re-linking

BLOCKS["meta"] = """
  SELECT video_id, raw_id, min(ts) AS t0, max(ts) AS t1, count(*) AS n, first(x ORDER BY ts, frame_idx) AS x0,
    first(y ORDER BY ts, frame_idx) AS y0, last(x ORDER BY ts, frame_idx) AS x1, last(y ORDER BY ts, frame_idx) AS y1,
    avg(x) AS mx, avg(y) AS my
  FROM f GROUP BY 1, 2 HAVING count(*) >= 3"""
BLOCKS["ord"] = """
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t0, raw_id) AS i FROM meta"""
BLOCKS["cand"] = """
  SELECT a.video_id, a.raw_id AS raw_1, b.raw_id AS raw_2, a.i, b.i AS j, b.t0 - a.t1 AS gap,
    least(sqrt((b.x0-a.x1)^2 + (b.y0-a.y1)^2), sqrt((b.mx-a.mx)^2 + (b.my-a.my)^2)) AS d
  FROM ord a JOIN ord b ON a.video_id = b.video_id AND b.i > a.i AND b.t0 - a.t1 BETWEEN -2 AND 120
  WHERE least(sqrt((b.x0-a.x1)^2 + (b.y0-a.y1)^2), sqrt((b.mx-a.mx)^2 + (b.my-a.my)^2)) <= 400"""
BLOCKS["cands"] = """
  SELECT o.video_id, o.i, coalesce((SELECT list(j ORDER BY d, j) FROM cand c
    WHERE c.video_id = o.video_id AND c.i = o.i), []) AS js FROM ord o"""
BLOCKS["greedy"] = """
  SELECT video_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS j, CAST([] AS BIGINT[]) AS taken
  FROM (SELECT DISTINCT video_id FROM ord)
  UNION ALL
  SELECT video_id, i, j, CASE WHEN j IS NULL THEN taken ELSE list_append(taken, j) END FROM (
    SELECT g.video_id, c.i, list_filter(c.js, lambda z: NOT list_contains(g.taken, z))[1] AS j, g.taken
    FROM greedy g JOIN cands c ON c.video_id = g.video_id AND c.i = g.i + 1)"""
BLOCKS["link"] = "\n  SELECT video_id, i, j FROM greedy WHERE j IS NOT NULL"
BLOCKS["chain"] = """
  SELECT o.video_id, o.i, o.i AS root FROM ord o
  WHERE NOT EXISTS (SELECT 1 FROM link l WHERE l.video_id = o.video_id AND l.j = o.i)
  UNION ALL
  SELECT c.video_id, l.j, c.root FROM chain c JOIN link l ON l.video_id = c.video_id AND l.i = c.i"""
BLOCKS["ids"] = """
  SELECT c.video_id, o.raw_id, o.n, s.unified_id, s.n AS worker_frames, s.root_raw FROM chain c
  JOIN ord o ON o.video_id = c.video_id AND o.i = c.i
  JOIN (SELECT c.video_id, c.root, CAST(sum(o.n) AS BIGINT) AS n, first(o.raw_id ORDER BY o.i) AS root_raw,
          row_number() OVER (PARTITION BY c.video_id ORDER BY sum(o.n) DESC, min(o.i)) AS unified_id
        FROM chain c JOIN ord o ON o.video_id = c.video_id AND o.i = c.i GROUP BY 1, 2) s
    ON s.video_id = c.video_id AND s.root = c.root"""
BLOCKS["peak"] = """
  SELECT video_id, greatest(1, max(now)) AS peak_concurrency FROM (
    SELECT video_id, CAST(sum(step) OVER (PARTITION BY video_id ORDER BY t, step DESC ROWS UNBOUNDED PRECEDING)
      AS BIGINT) AS now
    FROM (SELECT video_id, t0 AS t, 1 AS step FROM meta UNION ALL SELECT video_id, t1, -1 FROM meta)) GROUP BY 1"""

# the worker frame table of the plain queries, and of the whole report
WF = {
    "plain": "\n  SELECT * FROM lab_worker_id",
    "linked": """
  SELECT l.* EXCLUDE (worker_id), coalesce(ids.unified_id, -l.raw_id) AS worker_id FROM lab_raw_id l
  LEFT JOIN ids ON ids.video_id = l.video_id AND ids.raw_id = l.raw_id""",
}

# ------------------------------------------------------------------ bouts

_W = "(PARTITION BY video_id, worker_id ORDER BY ts, frame_idx)"
_B = "(PARTITION BY video_id, worker_id ORDER BY s)"
BLOCKS["isl"] = f"""
  SELECT video_id, worker_id, any_value(label) AS label, min(ts) AS s, min(frame_idx) AS sf, max(ts) AS l,
    max(frame_idx) AS lf, first(disp ORDER BY ts) AS hd, count(*) AS n, sum(disp) AS sd, count(disp) AS nd
  FROM (SELECT *, sum(nw) OVER (PARTITION BY video_id, worker_id ORDER BY ts, frame_idx ROWS UNBOUNDED PRECEDING) AS g
    FROM (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER {_W} THEN 1 ELSE 0 END AS nw FROM wf))
  GROUP BY video_id, worker_id, g"""
BLOCKS["rb"] = f"""
  SELECT video_id, worker_id, label, s, sf, coalesce(ns, l) AS e, coalesce(nsf, lf) AS ef,
    {r('coalesce(ns, l) - s', 2)} AS dur,
    CASE WHEN nd + (CASE WHEN nhd IS NULL THEN 0 ELSE 1 END) = 0 THEN 0e0
      ELSE (coalesce(sd, 0) + coalesce(nhd, 0))/(nd + (CASE WHEN nhd IS NULL THEN 0 ELSE 1 END)) END AS avd
  FROM (SELECT *, lead(s) OVER {_B} AS ns, lead(sf) OVER {_B} AS nsf, lead(hd) OVER {_B} AS nhd, lag(s) OVER {_B} AS ps
    FROM isl)
  WHERE ns IS NOT NULL OR ps IS NULL OR n > 1"""
BLOCKS["rbf"] = """
  SELECT *, count(*) OVER p AS n_raw, count(*) FILTER (dur >= 1) OVER p AS n_kept, max(e) OVER p AS fin,
    max(ef) OVER p AS finf, row_number() OVER (PARTITION BY video_id, worker_id ORDER BY s) AS i
  FROM rb WINDOW p AS (PARTITION BY video_id, worker_id)"""
BLOCKS["ab"] = f"""
  SELECT video_id, worker_id, label, s, sf, e, ef, {r('e - s', 2)} AS dur, avd FROM (
    SELECT video_id, worker_id, label, s, sf, avd,
      CASE WHEN n_raw = 1 OR n_kept = 0 THEN e ELSE coalesce(lead(s) OVER {_B}, fin) END AS e,
      CASE WHEN n_raw = 1 OR n_kept = 0 THEN ef ELSE coalesce(lead(sf) OVER {_B}, finf) END AS ef
    FROM rbf WHERE dur >= 1 OR (n_kept = 0 AND i = 1))"""
BLOCKS["mg"] = f"""
  SELECT video_id, worker_id, any_value(label) AS label, min(s) AS s, min(sf) AS sf, max(e) AS e, max(ef) AS ef,
    {r('max(e) - min(s)', 2)} AS dur, list_reduce(list(avd ORDER BY s), lambda a, b: (a + b)/2) AS avd
  FROM (SELECT *, sum(nw) OVER (PARTITION BY video_id, worker_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS g
    FROM (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER {_B} THEN 1 ELSE 0 END AS nw FROM ab))
  GROUP BY video_id, worker_id, g"""
BLOCKS["bouts"] = """
  SELECT *, label IN ('standing','sitting') AND avd < 5 AND dur >= 5 AS is_rest FROM mg"""

# ------------------------------------------------------------------ per-worker parts

_T = ["sitting", "squatting", "standing", "bending", "walking"]


def _sec(cond: str) -> str:
    return f"coalesce(CAST(sum(CAST(round_even(dur*100, 0) AS BIGINT)) FILTER ({cond}) AS BIGINT), 0)/100e0"


def _mine(v: str) -> str:
    return f"label = '{v}'" + (" AND NOT is_rest" if v == "standing" else "")


BLOCKS["bf"] = (
    f"\n  SELECT video_id, worker_id, {r('max(e) - min(s)', 2)} AS tracked_s, "
    + ", ".join(f"{_sec(_mine(v))} AS {v}_s, count(*) FILTER ({_mine(v)}) AS {v}_reps" for v in _T)
    + ", coalesce(max(dur) FILTER (NOT is_rest), 0e0) AS longest_work_s, "
    f"CASE WHEN count(*) FILTER (NOT is_rest) > 0 THEN {r(_sec('NOT is_rest') + '/count(*) FILTER (NOT is_rest)', 2)} "
    "ELSE 0e0 END AS avg_work_s, count(*) FILTER (NOT is_rest) AS work_bouts, "
    f"{_sec('is_rest')} AS rest_s, count(*) FILTER (is_rest) AS rest_count, "
    f"CASE WHEN count(*) FILTER (is_rest) > 0 THEN {r(_sec('is_rest') + '/count(*) FILTER (is_rest)', 2)} "
    "ELSE 0e0 END AS avg_rest_s FROM bouts GROUP BY 1, 2")
BLOCKS["dist"] = f"""
  SELECT video_id, worker_id, label, first_s, secs, CASE WHEN sum(secs) OVER p > 0
    THEN {r('secs/(sum(secs) OVER p)*100', 1)} ELSE 0e0 END AS pct
  FROM (SELECT video_id, worker_id, label, min(s) AS first_s,
      CAST(sum(CAST(round_even(dur*100, 0) AS BIGINT)) AS DOUBLE) AS secs FROM bouts GROUP BY 1, 2, 3)
  WINDOW p AS (PARTITION BY video_id, worker_id)"""
BLOCKS["lf"] = (
    "\n  SELECT video_id, worker_id, first(label ORDER BY secs DESC, first_s) AS dominant_posture, "
    + ", ".join(f"coalesce(max(pct) FILTER (label = '{v}'), 0e0) AS {v}_pct" for v in T.LABELS)
    + " FROM dist GROUP BY 1, 2")
BLOCKS["ff"] = f"""
  SELECT video_id, worker_id, count(*) AS n_frames, count(*) FILTER (trunk > 60) AS severe_frames,
    {r('avg(trunk)', 1)} AS avg_trunk, {r('max(trunk)', 1)} AS max_trunk, {r('avg(hip)', 1)} AS avg_hip,
    {r('avg(knee)', 1)} AS avg_knee, {r('avg(shoulder)', 1)} AS avg_shoulder, {r('max(shoulder)', 1)} AS max_shoulder,
    {r('avg(elbow)', 1)} AS avg_elbow,
    CASE WHEN count(shoulder) > 0 THEN {r('(count(*) FILTER (shoulder >= 45))/count(shoulder)*100e0', 1)}
      ELSE 0e0 END AS sh45_pct,
    CASE WHEN count(shoulder) > 0 THEN {r('(count(*) FILTER (shoulder >= 90))/count(shoulder)*100e0', 1)}
      ELSE 0e0 END AS sh90_pct
  FROM wf GROUP BY 1, 2 HAVING count(*) >= 3"""

_RR = T.REBA_RANGES
BLOCKS["rs0"] = (
    "\n  SELECT *, " + ", ".join([
        f"{ranges('trunk', _RR['trunk'], 2)} AS trunk_score", f"{ranges('neck', _RR['neck'], 1)} AS neck_score",
        f"{ranges('abs(180-knee)', _RR['legs'], 1)} AS legs_score",
        f"{ranges('shoulder', _RR['upper_arm'], 1)} AS upper_arm_score",
        f"{ranges('elbow', _RR['lower_arm'], 1)} AS lower_arm_score",
        f"{ranges('abs(90-wrist)', _RR['wrist'], 1)} AS wrist_score"]) + " FROM wf")
BLOCKS["rs1"] = f"""
  SELECT *, {T.REBA_A}[least(trunk_score,5)][least(neck_score,2)][least(legs_score,4)] AS score_a,
    {T.REBA_B}[least(upper_arm_score,6)][least(lower_arm_score,2)][least(wrist_score,2)] AS score_b FROM rs0"""
BLOCKS["reba"] = f"""
  SELECT *, least(15, {T.REBA_C}[least(score_a,12)][least(score_b,12)]) AS final_score FROM rs1"""


def p90(source: str, top: int, fields: list[str]) -> str:
    cols = ", ".join(f"first({c} ORDER BY abs(final_score-p), ts, frame_idx) AS {c}" for c in fields)
    return f"""
  SELECT video_id, worker_id, any_value(p) AS p90_score{', ' + cols if cols else ''} FROM (
    SELECT s.*, greatest(1, least({top}, CAST(floor(CASE WHEN t >= 0.5e0 THEN hi - (hi-lo)*(1e0-t) ELSE lo + (hi-lo)*t END)
      AS INTEGER))) AS p FROM {source} s JOIN (
      SELECT video_id, worker_id, (n-1)*0.9e0 - floor((n-1)*0.9e0) AS t, CAST(a[CAST(floor((n-1)*0.9e0) AS BIGINT)+1] AS DOUBLE) AS lo,
        CAST(a[least(n, CAST(floor((n-1)*0.9e0) AS BIGINT)+2)] AS DOUBLE) AS hi
      FROM (SELECT video_id, worker_id, count(*) AS n, list(final_score ORDER BY final_score) AS a FROM {source} GROUP BY 1, 2))
      USING (video_id, worker_id))
  GROUP BY 1, 2"""


BLOCKS["rw"] = p90("reba", 15, ["trunk_score", "neck_score", "legs_score", "upper_arm_score", "lower_arm_score",
                                "wrist_score", "score_a", "score_b"])


def rula(source: str, arm: str, elbow: str, wrist: str, neck: str, knee: str, flag: str) -> dict[str, str]:
    p = source
    return {
        p + "_r0": f"""
  SELECT *, CASE WHEN {arm} >= 90 THEN 4 WHEN {arm} >= 45 THEN 3 WHEN {arm} >= 20 THEN 2 ELSE 1 END AS ru_arm,
    CASE WHEN {elbow} IS NULL OR {elbow} BETWEEN 60 AND 100 THEN 1 ELSE 2 END AS ru_low,
    CASE WHEN {wrist} IS NULL OR abs(90-{wrist}) < 15 THEN 1 ELSE 2 END AS ru_wrist,
    CASE WHEN {neck} >= 20 THEN 3 WHEN {neck} >= 10 THEN 2 ELSE 1 END AS ru_neck,
    CASE WHEN trunk >= 60 THEN 4 WHEN trunk >= 20 THEN 3 WHEN trunk >= 5 THEN 2 ELSE 1 END AS ru_trunk,
    CASE WHEN {knee} < 110 THEN 2 ELSE 1 END AS ru_legs, CASE WHEN {flag} THEN 1 ELSE 0 END AS muscle FROM {p}""",
        p + "_r1": f"""
  SELECT *, {T.RULA_A}[ru_arm][ru_low][ru_wrist] AS ra, {T.RULA_B}[ru_neck][ru_trunk][ru_legs] AS rb FROM {p}_r0""",
        p + "_rula": f"""
  SELECT *, {T.RULA_C}[least(ra+muscle, 8)][least(rb+muscle, 7)] AS final_score FROM {p}_r1""",
    }


BLOCKS.update(rula("wf", "shoulder", "elbow", "wrist", "neck", "knee", "false"))
BLOCKS["ruw"] = p90("wf_rula", 7, ["ru_arm", "ru_low", "ru_wrist", "ra", "ru_neck", "ru_trunk", "ru_legs", "rb"])

# ------------------------------------------------------------------ objects

BLOCKS["wb"] = "\n  SELECT *, x - 40e0 AS bx1, y - 90e0 AS by1, x + 40e0 AS bx2, y + 90e0 AS by2 FROM wf"
BLOCKS["pairs"] = """
  SELECT o.det_id, o.video_id, o.frame_idx, o.ts, o.class_id, o.class_name, p.raw_id, p.worker_id,
    sqrt((o.cx-(p.bx1+p.bx2)/2)^2 + (o.cy-(p.by1+p.by2)/2)^2) AS dist,
    sqrt((p.bx2-p.bx1)^2 + (p.by2-p.by1)^2) AS diag
  FROM obj o JOIN wb p ON o.video_id = p.video_id AND o.frame_idx = p.frame_idx"""
BLOCKS["near"] = "\n  SELECT * FROM pairs WHERE dist < diag*0.6e0"
BLOCKS["tools"] = """
  SELECT video_id, worker_id, list(class_name ORDER BY t, d) AS tools FROM (
    SELECT video_id, worker_id, class_name, min(ts) AS t, first(det_id ORDER BY ts, det_id) AS d FROM near GROUP BY 1,2,3)
  GROUP BY 1, 2"""
BLOCKS["loads"] = """
  SELECT video_id, worker_id, count(*) AS load_events FROM near
  WHERE class_name IN ('backpack','handbag','suitcase') GROUP BY 1, 2"""

# ------------------------------------------------------------------ trips

_5 = " + ".join
BLOCKS["sm0"] = f"""
  SELECT video_id, worker_id, ts, frame_idx, x, y, row_number() OVER w - 1 AS p, count(*) OVER c AS n,
    (coalesce(lag(x,2) OVER w,0) + coalesce(lag(x,1) OVER w,0) + x + coalesce(lead(x,1) OVER w,0)
      + coalesce(lead(x,2) OVER w,0))/5 AS mx,
    (coalesce(lag(y,2) OVER w,0) + coalesce(lag(y,1) OVER w,0) + y + coalesce(lead(y,1) OVER w,0)
      + coalesce(lead(y,2) OVER w,0))/5 AS my
  FROM wf WINDOW w AS {_W}, c AS (PARTITION BY video_id, worker_id)"""
BLOCKS["sm"] = f"""
  SELECT *, sqrt((sx-px)*(sx-px) + (sy-py)*(sy-py)) AS step, degrees(atan2(sy-py, sx-px)) AS dir FROM (
    SELECT *, lag(sx) OVER {_W} AS px, lag(sy) OVER {_W} AS py FROM (
      SELECT *, CASE WHEN n < 5 THEN x ELSE mx END AS sx, CASE WHEN n < 5 THEN y ELSE my END AS sy FROM sm0))"""
BLOCKS["path"] = f"""
  SELECT video_id, worker_id, count(*) AS n_points, {r('coalesce(sum(step ORDER BY p), 0)', 1)} AS path_px FROM sm
  GROUP BY 1, 2 HAVING count(*) >= 10"""


def _diff(a: str, b: str) -> str:
    d = f"({a}-{b})"
    return f"abs(CASE WHEN {d} > 180 THEN {d}-360 WHEN {d} < -180 THEN {d}+360 ELSE {d} END)"


BLOCKS["fold"] = f"""
  SELECT b.video_id, b.worker_id, b.p, a.ts AS t0, a.sx AS x0, a.sy AS y0, b.dir AS dir0, CAST(NULL AS DOUBLE) AS dir1,
    0 AS held, false AS hit, CAST(NULL AS DOUBLE) AS q_t0, CAST(NULL AS DOUBLE) AS q_t1, CAST(NULL AS DOUBLE) AS q_x0,
    CAST(NULL AS DOUBLE) AS q_y0, CAST(NULL AS DOUBLE) AS q_x1, CAST(NULL AS DOUBLE) AS q_y1,
    CAST(NULL AS DOUBLE) AS q_d, CAST(NULL AS DOUBLE) AS q_dir
  FROM sm a JOIN sm b ON a.video_id = b.video_id AND a.worker_id = b.worker_id AND a.p = 0 AND b.p = 1 AND b.n >= 10
  UNION ALL
  SELECT video_id, worker_id, p, CASE WHEN h >= 5 THEN ts ELSE t0 END, CASE WHEN h >= 5 THEN sx ELSE x0 END,
    CASE WHEN h >= 5 THEN sy ELSE y0 END, CASE WHEN h >= 5 THEN dir ELSE dir0 END,
    CASE WHEN h >= 5 OR h = 0 THEN NULL ELSE coalesce(dir1, dir) END, CASE WHEN h >= 5 THEN 0 ELSE h END, h >= 5,
    t0, ts, x0, y0, sx, sy, reach, dir0
  FROM (SELECT *, CASE WHEN NOT ({_diff('dir', 'dir0')} > 90 AND reach > 50) THEN 0 WHEN dir1 IS NULL THEN 1
          WHEN {_diff('dir', 'dir1')} < 45 THEN held + 1 ELSE 0 END AS h
    FROM (SELECT s.video_id, s.worker_id, s.p, s.ts, s.sx, s.sy, s.dir, f.t0, f.x0, f.y0, f.dir0, f.dir1, f.held,
            sqrt((s.sx-f.x0)^2 + (s.sy-f.y0)^2) AS reach
          FROM fold f JOIN sm s ON s.video_id = f.video_id AND s.worker_id = f.worker_id AND s.p = f.p + 1))"""
BLOCKS["trips"] = """
  SELECT w.video_id, w.worker_id, coalesce(t.n, 0) AS trip_count, coalesce(p.path_px, 0e0) AS path_px
  FROM (SELECT DISTINCT video_id, worker_id FROM wf) w
  LEFT JOIN path p ON p.video_id = w.video_id AND p.worker_id = w.worker_id
  LEFT JOIN (SELECT video_id, worker_id, count(*) AS n FROM fold WHERE hit GROUP BY 1, 2) t
    ON t.video_id = w.video_id AND t.worker_id = w.worker_id"""

# ------------------------------------------------------------------ signals

_S = "(PARTITION BY video_id, worker_id, joint ORDER BY ts, frame_idx"
BLOCKS["ser"] = "\n  " + " UNION ALL ".join(
    f"SELECT video_id, worker_id, '{j}' AS joint, ts, frame_idx, {j} AS v FROM wf"
    for j in ("elbow", "wrist", "shoulder", "trunk"))
BLOCKS["fill0"] = f"""
  SELECT *, row_number() OVER {_S}) - 1 AS pos, count(*) OVER c AS n, count(v) OVER c AS nv FROM ser
  WINDOW c AS (PARTITION BY video_id, worker_id, joint)"""
BLOCKS["fill"] = f"""
  SELECT video_id, worker_id, joint, ts, frame_idx, pos, n,
    CASE WHEN v IS NOT NULL THEN v WHEN lv IS NULL THEN rv WHEN rv IS NULL THEN lv
      ELSE (rv-lv)/(rp-lp)*(pos-lp) + lv END AS v
  FROM (SELECT *,
      last_value(v IGNORE NULLS) OVER {_S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv,
      last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER {_S}
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lp,
      first_value(v IGNORE NULLS) OVER {_S} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rv,
      first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER {_S}
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rp
    FROM fill0 WHERE nv >= 3 OR (nv = n AND n > 0))"""
BLOCKS["flat0"] = """
  SELECT f.*, round_even((v - (m*pos + c))*1e9, 0)/1e9 AS z FROM fill f JOIN (
    SELECT video_id, worker_id, joint, coalesce(regr_slope(v, pos), 0) AS m,
      avg(v) - coalesce(regr_slope(v, pos), 0)*avg(pos) AS c FROM fill GROUP BY 1, 2, 3) g
    USING (video_id, worker_id, joint)"""
BLOCKS["flat"] = "\n  SELECT * FROM flat0 WHERE n >= 25 AND n >= 10"
BLOCKS["runs"] = """
  SELECT video_id, worker_id, joint, g, min(pos) AS a, max(pos) AS b, any_value(z) AS z, any_value(n) AS n FROM (
    SELECT *, sum(nw) OVER (PARTITION BY video_id, worker_id, joint ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, CASE WHEN z IS DISTINCT FROM lag(z) OVER (PARTITION BY video_id, worker_id, joint ORDER BY pos)
        THEN 1 ELSE 0 END AS nw FROM flat)) GROUP BY 1, 2, 3, 4"""
BLOCKS["tops"] = """
  SELECT video_id, worker_id, joint, n, z, (a+b)//2 AS pos FROM (
    SELECT *, lag(z) OVER w AS lz, lead(z) OVER w AS rz FROM runs
    WINDOW w AS (PARTITION BY video_id, worker_id, joint ORDER BY g)) WHERE z > lz AND z > rz"""
BLOCKS["pb"] = """
  SELECT t.video_id, t.worker_id, t.joint, t.pos, t.n, t.z,
    coalesce(max(CASE WHEN s.z > t.z AND s.pos < t.pos THEN s.pos END), -1) AS lo,
    coalesce(min(CASE WHEN s.z > t.z AND s.pos > t.pos THEN s.pos END), t.n) AS hi
  FROM tops t JOIN flat s ON s.video_id = t.video_id AND s.worker_id = t.worker_id AND s.joint = t.joint
  GROUP BY t.video_id, t.worker_id, t.joint, t.pos, t.n, t.z"""
BLOCKS["pk"] = """
  SELECT video_id, worker_id, joint, pos, n FROM (
    SELECT b.video_id, b.worker_id, b.joint, b.pos, b.n, b.z,
      min(CASE WHEN s.pos > b.lo AND s.pos <= b.pos THEN s.z END) AS ml,
      min(CASE WHEN s.pos < b.hi AND s.pos >= b.pos THEN s.z END) AS mr
    FROM pb b JOIN flat s ON s.video_id = b.video_id AND s.worker_id = b.worker_id AND s.joint = b.joint
    GROUP BY b.video_id, b.worker_id, b.joint, b.pos, b.n, b.z)
  WHERE z - greatest(ml, mr) >= 5"""
BLOCKS["pr0"] = """
  SELECT k.video_id, k.worker_id, k.joint, coalesce(c, 0) AS peak_count, 1/m AS hz, sd/m AS cv FROM (
    SELECT DISTINCT video_id, worker_id, joint FROM flat) k LEFT JOIN (
    SELECT video_id, worker_id, joint, count(*) AS c, avg(g) AS m, stddev_pop(g) AS sd FROM (
      SELECT *, (pos - lag(pos) OVER (PARTITION BY video_id, worker_id, joint ORDER BY pos))/5e0 AS g FROM pk)
    GROUP BY 1, 2, 3) p USING (video_id, worker_id, joint)"""
_INB = "peak_count >= 3 AND hz BETWEEN 0.2e0 AND 3e0"
_STEADY = clip("1 - cv", "0e0", "1e0")
BLOCKS["pr"] = f"""
  SELECT video_id, worker_id, joint, peak_count,
    CASE WHEN peak_count < 3 THEN NULL WHEN {_INB} THEN {r('hz', 3)} ELSE hz END AS freq_hz,
    CASE WHEN peak_count < 3 THEN NULL WHEN {_INB} THEN {r('hz*60', 1)} ELSE hz*60 END AS cpm,
    {r(f'CASE WHEN peak_count < 3 THEN 0e0 WHEN {_INB} THEN {_STEADY} ELSE 0.2e0 END', 2)} AS confidence,
    coalesce({_INB} AND {_STEADY} > 0.4e0, false) AS is_repetitive FROM pr0"""
BLOCKS["dft"] = """
  SELECT video_id, worker_id, joint, n, k, k*(1e0/(n*(1e0/5e0))) AS hz, sqrt(sum(h*cos(2*pi()*k*pos/n))^2 + sum(h*sin(2*pi()*k*pos/n))^2)
    AS amp
  FROM (SELECT *, z*(0.5e0 - 0.5e0*cos(2*pi()*pos/(n-1))) AS h, unnest(range(0, n//2 + 1)) AS k FROM flat WHERE n >= 16)
  WHERE k*(1e0/(n*(1e0/5e0))) BETWEEN 0.2e0 AND 3e0 GROUP BY 1, 2, 3, 4, 5"""
BLOCKS["sp0"] = """
  SELECT k.video_id, k.worker_id, k.joint, s.hz, s.c FROM (SELECT DISTINCT video_id, worker_id, joint FROM flat) k
  LEFT JOIN (SELECT video_id, worker_id, joint, first(hz ORDER BY amp DESC, k) AS hz,
      greatest(0e0, least(1e0, (max(amp)/(avg(amp) + 1e-8) - 1)/5)) AS c FROM dft GROUP BY 1, 2, 3) s
    USING (video_id, worker_id, joint)"""
BLOCKS["sp"] = f"""
  SELECT video_id, worker_id, joint, {r('hz', 3)} AS freq_hz, {r('hz*60', 1)} AS cpm,
    {r('coalesce(c, 0)', 2)} AS confidence, coalesce(c > 0.3e0, false) AS is_repetitive FROM sp0"""
BLOCKS["cb"] = f"""
  SELECT video_id, worker_id, joint,
    CASE WHEN agree THEN {r('(tf+ff)/2', 3)} WHEN tc >= fc THEN tf ELSE ff END AS freq_hz,
    CASE WHEN agree THEN {r('(tm+fm)/2', 1)} WHEN tc >= fc THEN tm ELSE fm END AS cpm,
    CASE WHEN agree OR tc >= fc THEN peak_count ELSE 0 END AS peak_count,
    CASE WHEN agree THEN least(1e0, greatest(tc, fc) + 0.15e0) ELSE greatest(tc, fc) END AS confidence,
    CASE WHEN agree THEN true WHEN tc >= fc THEN tr ELSE fr END AS is_repetitive
  FROM (SELECT a.video_id, a.worker_id, a.joint, a.freq_hz AS tf, a.cpm AS tm, a.peak_count, a.confidence AS tc,
      a.is_repetitive AS tr, b.freq_hz AS ff, b.cpm AS fm, b.confidence AS fc, b.is_repetitive AS fr,
      coalesce(a.is_repetitive AND b.is_repetitive AND abs(a.freq_hz - b.freq_hz) < 0.2e0, false) AS agree
    FROM pr a JOIN sp b USING (video_id, worker_id, joint))"""
BLOCKS["best"] = """
  SELECT w.video_id, w.worker_id, coalesce(b.joint, 'elbow') AS primary_joint, b.freq_hz,
    b.cpm AS cycles_per_minute, coalesce(b.peak_count, 0) AS peak_count, coalesce(b.confidence, 0e0) AS confidence,
    coalesce(b.is_repetitive, false) AS is_repetitive
  FROM ff w LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY video_id, worker_id ORDER BY confidence DESC,
      list_position(['elbow','wrist','shoulder','trunk'], joint)) AS place FROM cb WHERE confidence > 0) b
    ON b.video_id = w.video_id AND b.worker_id = w.worker_id AND b.place = 1"""

# ------------------------------------------------------------------ worker report

BLOCKS["wt"] = """
  SELECT wf.*, best.is_repetitive FROM wf JOIN best USING (video_id, worker_id)"""
BLOCKS.update(rula("wt", "NULL::DOUBLE", "NULL::DOUBLE", "NULL::DOUBLE", "NULL::DOUBLE", "NULL::DOUBLE",
                   "is_repetitive"))
BLOCKS["rup"] = p90("wt_rula", 7, [])
BLOCKS["r0"] = f"""
  SELECT ff.*, bf.* EXCLUDE (video_id, worker_id), lf.* EXCLUDE (video_id, worker_id),
    best.* EXCLUDE (video_id, worker_id), trip_count, path_px, coalesce(tools, []) AS tools,
    coalesce(load_events, 0) AS load_events, rw.p90_score AS reba_score, rup.p90_score AS rula_score,
    {r('severe_frames*(tracked_s/greatest(1, n_frames))', 2)} AS severe_bending_s,
    {r('sh45_pct/100*tracked_s', 2)} AS sh45_s, {r('sh90_pct/100*tracked_s', 2)} AS sh90_s,
    CASE WHEN sh90_pct > 15 OR sh45_pct > 50 THEN 'High' WHEN sh45_pct > 25 THEN 'Moderate' ELSE 'Low' END AS arm_risk
  FROM ff LEFT JOIN bf USING (video_id, worker_id) LEFT JOIN lf USING (video_id, worker_id)
  LEFT JOIN best USING (video_id, worker_id) LEFT JOIN trips USING (video_id, worker_id)
  LEFT JOIN tools USING (video_id, worker_id) LEFT JOIN loads USING (video_id, worker_id)
  LEFT JOIN rw USING (video_id, worker_id) LEFT JOIN rup USING (video_id, worker_id)"""
BLOCKS["r1"] = f"""
  SELECT *, {level('reba_score', T.REBA_LEVELS, 2)} AS reba_level, {level('rula_score', T.RULA_LEVELS, 2)} AS rula_level,
    {r('severe_bending_s/greatest(1, tracked_s)*100', 1)} AS severe_pct,
    coalesce(cycles_per_minute, 0) AS rate FROM r0"""
BLOCKS["r2"] = f"""
  SELECT *,
    {clip('reba_score/15e0*35 + rula_score/7e0*25 + bending_pct*0.20e0 + severe_pct*0.15e0 + squatting_pct*0.10e0', '0e0', '100e0')}
      AS p_posture,
    {clip('CASE WHEN rate > 0 THEN 100/(1 + exp(-0.08e0*(rate - 25))) ELSE 10e0 END', '0e0', '100e0')} AS p_rep,
    {clip('longest_work_s/60*3 + (100 - least(100e0, rest_s/greatest(1e0, tracked_s)*100*2.5e0))', '0e0', '100e0')} AS p_rest,
    {clip('load_events*15e0', '0e0', '100e0')} AS p_load,
    {clip('sh45_pct*0.6e0 + sh90_pct*1.2e0', '0e0', '100e0')} AS p_arm FROM r1"""
BLOCKS["r3"] = f"""
  SELECT *, {r(clip('p_posture*0.35e0 + p_rep*0.20e0 + p_rest*0.20e0 + p_load*0.10e0 + p_arm*0.15e0', '0e0', '100e0'), 1)}
    AS drudgery_index FROM r2"""
_LEAN = "radians(greatest(0e0, coalesce(avg_trunk, 0)))"
_KG = "(CASE WHEN load_events > 0 THEN 5e0 ELSE 0.5e0 END)"
_LOW = "(bending_pct + squatting_pct)"
BLOCKS["r4"] = f"""
  SELECT *, CASE WHEN drudgery_index < 30 THEN 'Low Drudgery' WHEN drudgery_index < 55 THEN 'Moderate Drudgery'
      WHEN drudgery_index < 75 THEN 'High Drudgery' ELSE 'Severe Drudgery' END AS drudgery_category,
    {r(clip('drudgery_index*0.85e0 + longest_work_s/60*0.5e0', '0e0', '100e0'), 1)} AS fatigue_level,
    {r('23e0*(25e0/30)*1*(0.82e0 + 4.5e0/50)*1*0.94e0*0.95e0', 2)} AS rwl_kg,
    {r(f'(42e0*9.81e0*(0.20e0*sin({_LEAN}) + 0.05e0) + {_KG}*9.81e0*(0.3e0*sin({_LEAN}) + 0.15e0))/0.05e0 + (42e0 + {_KG})*9.81e0*cos({_LEAN})', 1)}
      AS compression_n,
    CASE WHEN (load_events > 0 OR list_contains(tools, 'backpack') OR list_contains(tools, 'suitcase'))
        AND (walking_pct > 15 OR standing_pct > 30) THEN 'transport'
      WHEN {_LOW} > 40 THEN 'weeding'
      WHEN rate > 20 AND primary_joint IN ('trunk','elbow') AND (bending_pct > 15 OR {_LOW} > 20) THEN 'hoeing'
      WHEN standing_pct > 50 AND rate > 15 AND primary_joint = 'shoulder' AND sh90_pct > 5 THEN 'picking'
      WHEN rate > 25 AND primary_joint = 'wrist' THEN 'pruning' ELSE 'general' END AS task_key,
    bending_s/60*(1800/greatest(60e0, tracked_s)) AS iso_minutes,
    CASE WHEN tracked_s > 0 THEN 3600/tracked_s ELSE 1e0 END AS scale FROM r3"""
_HP = ["sitting", "squatting", "standing", "bending", "severe_bending", "walking", "rest"]


def _task_text(which: int) -> str:
    return "(CASE task_key " + " ".join(f"WHEN '{k}' THEN {q(v[which])}" for k, v in T.TASKS.items()) + " END)"


BLOCKS["r5"] = (
    f"\n  SELECT *, {r(_KG + '/rwl_kg', 2)} AS lifting_index, compression_n > 3400 AS compression_exceeded, "
    f"{_task_text(0)} AS task, {_task_text(1)} AS task_description, {_task_text(2)} AS task_hazard, "
    f"CASE task_key WHEN 'transport' THEN 0.88e0 WHEN 'weeding' THEN {r(f'least(0.95e0, 0.60e0 + {_LOW}/200)', 2)} "
    f"WHEN 'hoeing' THEN {r('least(0.92e0, 0.70e0 + bending_pct/100)', 2)} "
    f"WHEN 'picking' THEN {r('least(0.93e0, 0.70e0 + sh90_pct/100)', 2)} WHEN 'pruning' THEN 0.84e0 "
    "ELSE 0.60e0 END AS task_confidence, "
    "tracked_s > 0 AND iso_minutes > 4 AS iso_violated, "
    f"CASE WHEN tracked_s <= 0 THEN {q(T.ISO_NO_DATA)} WHEN iso_minutes > 4 THEN "
    f"{q(T.ISO_BAD[0])} || printf('%.1f', {r('iso_minutes', 1)}) || {q(T.ISO_BAD[1])} ELSE "
    f"{q(T.ISO_OK[0])} || printf('%.1f', {r('iso_minutes', 1)}) || {q(T.ISO_OK[1])} END AS iso_message, "
    f"{r('scale', 3)} AS scaling_factor, "
    + ", ".join(f"least(3600e0, {r(f'{p}_s*scale', 1)}) AS {p}_1hr" for p in _HP)
    + ", CAST(round_even(rest_count*scale, 0) AS BIGINT) AS rest_count_1hr, "
    "CAST(round_even(load_events*scale, 0) AS BIGINT) AS load_events_1hr, "
    "CAST(round_even(trip_count*scale, 0) AS BIGINT) AS trips_1hr, "
    f"{r('sh45_pct/100*3600', 1)} AS arm_above_45_1hr, {r('sh90_pct/100*3600', 1)} AS arm_above_90_1hr FROM r4")
BLOCKS["r6"] = (
    "\n  SELECT *, " + ", ".join(f"{hms_r(f'{p}_1hr')} AS {p}_hms_1hr, {r(f'{p}_1hr/3600*100', 1)} AS {p}_share_1hr"
                                for p in _HP)
    + f", greatest(0e0, {r('3600 - rest_1hr', 1)}) AS active_1hr, "
    f"CASE WHEN lifting_index <= 1 AND NOT compression_exceeded THEN {q(T.LIFT_LOW[0])} "
    f"WHEN lifting_index <= 2 AND compression_n <= 4000 THEN {q(T.LIFT_MODERATE[0])} ELSE {q(T.LIFT_HIGH[0])} END "
    "AS lift_risk, "
    f"CASE WHEN lifting_index <= 1 AND NOT compression_exceeded THEN {q(T.LIFT_LOW[1])} "
    f"WHEN lifting_index <= 2 AND compression_n <= 4000 THEN {q(T.LIFT_MODERATE[1])} ELSE {q(T.LIFT_HIGH[1])} END "
    "AS lift_advice, "
    + ", ".join(f"{r(a, 1)} AS {b}" for a, b in (("p_posture", "postural"), ("p_rep", "repetition"),
                                                 ("p_rest", "work_rest"), ("p_load", "load"), ("p_arm", "arm")))
    + ", list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(t)} END" for c, t in (
        ("p_arm > 40", T.ADVICE_ARM), ("p_posture > 50", T.ADVICE_POSTURE), ("p_rep > 50", T.ADVICE_REPEAT),
        ("p_rest > 50", T.ADVICE_REST), ("p_load > 30", T.ADVICE_LOAD)))
    + "], lambda z: z IS NOT NULL) AS said FROM r5")
BLOCKS["rep"] = f"""
  SELECT *, {hms_r('active_1hr')} AS active_hms_1hr,
    CASE WHEN is_repetitive AND cycles_per_minute > 0 THEN CAST(round_even(cycles_per_minute*(active_1hr/60), 0) AS BIGINT)
      ELSE 0 END AS cycles_1hr,
    CASE WHEN len(said) > 0 THEN array_to_string(said, ' | ') ELSE {q(T.ADVICE_NONE)} END AS advice_text,
    CASE WHEN len(said) > 0 THEN said[1] ELSE {q(T.ADVICE_NONE)} END AS first_advice,
    array_to_string(tools, ', ') AS tools_text FROM r6"""

_RECURSIVE = {"greedy", "chain", "fold"}


def sql(select: str, mode: str = "plain") -> str:
    """A complete statement: the blocks a select needs, in order, and the select."""
    blocks = {**BLOCKS, "wf": WF[mode]}
    order: list[str] = []

    def need(text: str, me: str = "") -> None:
        for name in blocks:
            if name != me and name not in order and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                need(blocks[name], name)
                if name not in order:
                    order.append(name)

    need(select)
    if not order:
        return select
    head = "WITH RECURSIVE " if _RECURSIVE & set(order) else "WITH "
    return head + ",\n".join(f"{n} AS ({blocks[n]})" for n in order) + "\n" + select
