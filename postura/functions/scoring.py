"""Risk scores as column expressions: range scores, table look-ups, REBA, RULA, lifting, drudgery, exposure, tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postura import tables as T
from postura.functions.numeric import clip, dbl, hms_rounded, rnd, rnd_int

# ---------------------------------------------------------------- look-ups


def range_score(angle: Column, ranges: list[tuple], missing: int) -> Column:
    """Score of the first range [from, below) that holds the angle; beyond all ranges the last score."""
    chain = F.when(angle.isNull(), missing)
    for low, high, score in ranges:
        chain = chain.when((angle >= low) & (angle < high), score)
    return chain.otherwise(ranges[-1][2])


def table_lookup(table: list, *scores: Column) -> Column:
    """Cell of a nested table at 1-based scores, each clamped to the table's extent.

    The table is a literal array folded into the expression: no join, no shuffle.
    """
    sizes, level = [], table
    while isinstance(level, list):
        sizes.append(len(level))
        level = level[0]

    def flatten(part):
        return [part] if not isinstance(part, list) else [v for p in part for v in flatten(p)]

    position = F.lit(0)
    for score, size in zip(scores, sizes):
        position = position * size + F.greatest(F.lit(1), F.least(F.lit(size), score)) - 1
    return F.element_at(F.array(*[F.lit(v) for v in flatten(table)]), position + 1)


def level_map(score: Column, levels: list[tuple], which: int) -> Column:
    """Level name (which=2) or action (which=3) of a score by closed range."""
    chain = None
    for row in levels:
        test = score.between(row[0], row[1])
        chain = F.when(test, row[which]) if chain is None else chain.when(test, row[which])
    return chain.otherwise(levels[-1][which])


# ---------------------------------------------------------------- REBA


def reba_parts(trunk: Column, neck: Column, knee: Column, shoulder: Column, elbow: Column,
               wrist: Column) -> dict[str, Column]:
    """Segment scores. ``shoulder`` is the worse side, ``elbow`` and ``wrist`` the mean of the present sides."""
    r = T.REBA_RANGES
    return {
        "trunk_score": range_score(trunk, r["trunk"], 2),
        "neck_score": range_score(neck, r["neck"], 1),
        "legs_score": range_score(F.abs(dbl(180) - knee), r["legs"], 1),
        "upper_arm_score": range_score(shoulder, r["upper_arm"], 1),
        "lower_arm_score": range_score(elbow, r["lower_arm"], 1),
        "wrist_score": range_score(F.abs(dbl(90) - wrist), r["wrist"], 1),
    }


def reba_totals(load_force: Column, static: Column, repetitive: Column, rapid: Column) -> list[dict[str, Column]]:
    """Successive projections over the segment scores."""
    c = F.col
    return [
        {"score_a": table_lookup(T.REBA_A, c("trunk_score"), c("neck_score"), c("legs_score")),
         "score_b": table_lookup(T.REBA_B, c("upper_arm_score"), c("lower_arm_score"), c("wrist_score")),
         "load_force_score": F.greatest(F.lit(0), F.least(F.lit(3), load_force)),
         "activity_score": static.cast("int") + repetitive.cast("int") + rapid.cast("int")},
        {"score_a_adjusted": c("score_a") + c("load_force_score"), "score_b_adjusted": c("score_b")},
        {"score_c": table_lookup(T.REBA_C, c("score_a_adjusted"), c("score_b_adjusted"))},
        {"final_score": F.least(F.lit(15), c("score_c") + c("activity_score"))},
    ]


REBA_FIELDS = ["trunk_score", "neck_score", "legs_score", "upper_arm_score", "lower_arm_score", "wrist_score",
               "score_a", "score_b", "load_force_score", "activity_score", "score_a_adjusted", "score_b_adjusted",
               "score_c"]


# ---------------------------------------------------------------- RULA


def steps(value: Column, edges: list[float]) -> Column:
    """1 + number of edges reached; 1 for a missing value."""
    return F.lit(1) + sum((F.coalesce(value >= e, F.lit(False)).cast("int") for e in edges), F.lit(0))


def rula_parts(trunk: Column, neck: Column, knee: Column, shoulder: Column, elbow: Column,
               wrist: Column) -> dict[str, Column]:
    off = lambda bad: F.when(F.coalesce(bad, F.lit(False)), 2).otherwise(1)
    return {
        "upper_arm_score": steps(shoulder, [20.0, 45.0, 90.0]),
        "lower_arm_score": off(~elbow.between(60.0, 100.0)),
        "wrist_score": off(F.abs(dbl(90) - wrist) >= 15.0),
        "neck_score": steps(neck, [10.0, 20.0]),
        "trunk_score": steps(trunk, [5.0, 20.0, 60.0]),
        "legs_score": off(knee < 110.0),
    }


def rula_totals(repetitive: Column, load_force: Column) -> list[dict[str, Column]]:
    c = F.col
    return [
        {"score_a": table_lookup(T.RULA_A, c("upper_arm_score"), c("lower_arm_score"), c("wrist_score")),
         "score_b": table_lookup(T.RULA_B, c("neck_score"), c("trunk_score"), c("legs_score")),
         "muscle_score": repetitive.cast("int"),
         "load_score": F.greatest(F.lit(0), F.least(F.lit(3), load_force))},
        {"score_a_total": c("score_a") + c("muscle_score") + c("load_score"),
         "score_b_total": c("score_b") + c("muscle_score") + c("load_score")},
        {"final_score": table_lookup(T.RULA_C, c("score_a_total"), c("score_b_total"))},
    ]


RULA_FIELDS = ["upper_arm_score", "lower_arm_score", "wrist_score", "score_a", "neck_score", "trunk_score",
               "legs_score", "score_b", "muscle_score", "load_score", "score_a_total", "score_b_total"]


# ---------------------------------------------------------------- lifting limit and spinal compression


def niosh(weight: Column, trunk: Column, h_cm: Column, v_cm: Column, travel_cm: Column, asym_deg: Column,
          lifts_min: Column) -> list[dict[str, Column]]:
    """Successive projections: multipliers → limit → index and compression → verdict."""
    c = F.col
    w, lean = F.greatest(dbl(0.5), weight), F.radians(F.greatest(dbl(0), trunk))
    hm = dbl(25) / clip(h_cm, 25, 63)
    vm = dbl(1) - dbl(0.003) * F.abs(clip(v_cm, 0, 175) - dbl(75))
    dm = dbl(0.82) + dbl(4.5) / clip(travel_cm, 25, 175)
    am = dbl(1) - dbl(0.0032) * clip(asym_deg, 0, 135)
    fm = (F.when(lifts_min <= 0.2, dbl(1.0)).when(lifts_min <= 1.0, dbl(0.94))
          .when(lifts_min <= 4.0, dbl(0.84)).otherwise(dbl(0.72)))
    g, upper_kg, muscle_arm = 9.81, 42.0, 0.05
    trunk_torque = dbl(upper_kg) * g * (dbl(0.20) * F.sin(lean) + dbl(0.05))
    load_torque = w * g * (h_cm / 100.0 * F.sin(lean) + dbl(0.15))
    force = (trunk_torque + load_torque) / muscle_arm + (dbl(upper_kg) + w) * g * F.cos(lean)
    low = (c("lifting_index") <= 1.0) & ~c("compression_exceeded")
    mid = (c("lifting_index") <= 2.0) & (c("compression_n") <= 4000.0)

    def say(which: int) -> Column:
        return (F.when(low, T.LIFT_LOW[which]).when(mid, T.LIFT_MODERATE[which]).otherwise(T.LIFT_HIGH[which]))

    return [
        {"rwl_kg": F.greatest(dbl(0.5), rnd(dbl(23) * hm * vm * dm * am * fm * dbl(0.95), 2)),
         "compression_n": rnd(force, 1)},
        {"lifting_index": rnd(w / c("rwl_kg"), 2), "compression_exceeded": c("compression_n") > 3400.0},
        {"lift_risk": say(0), "lift_advice": say(1)},
    ]


# ---------------------------------------------------------------- drudgery index


def adi_pillars(reba: Column, rula: Column, bending: Column, squatting: Column, cpm: Column, tracked: Column,
                longest: Column, rest: Column, loads: Column, severe: Column, sh45: Column,
                sh90: Column) -> dict[str, Column]:
    posture = (reba / 15.0 * 35.0 + rula / 7.0 * 25.0 + bending * 0.20 + severe * 0.15 + squatting * 0.10)
    rate = F.coalesce(cpm, dbl(0))
    repeat = F.when(rate > 0, dbl(100) / (dbl(1) + F.exp((rate - 25.0) * -0.08))).otherwise(dbl(10))
    rest_share = rest / F.greatest(dbl(1), tracked) * 100.0
    work_rest = longest / 60.0 * 3.0 + (dbl(100) - F.least(dbl(100), rest_share * 2.5))
    return {
        "postural": clip(posture, 0, 100),
        "repetition": clip(repeat, 0, 100),
        "work_rest": clip(work_rest, 0, 100),
        "load": clip(loads * dbl(15), 0, 100),
        "arm": clip(sh45 * 0.6 + sh90 * 1.2, 0, 100),
    }


def adi_index() -> Column:
    """Weighted sum of the (unrounded) pillars."""
    c = F.col
    total = (c("postural") * 0.35 + c("repetition") * 0.20 + c("work_rest") * 0.20 + c("load") * 0.10
             + c("arm") * 0.15)
    return rnd(clip(total, 0, 100), 1)


def adi_category(index: Column) -> Column:
    return (F.when(index < 30.0, "Low Drudgery").when(index < 55.0, "Moderate Drudgery")
            .when(index < 75.0, "High Drudgery").otherwise("Severe Drudgery"))


def adi_fatigue(index: Column, longest_bout_s: Column) -> Column:
    return rnd(clip(index * 0.85 + longest_bout_s / 60.0 * 0.5, 0, 100), 1)


def fatigue_minutes(tracked: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(tracked / 60.0)).cast("long")


def fatigue_at(fatigue: Column, minute: Column, minutes: Column) -> Column:
    return rnd(fatigue * (dbl(1) - F.exp(dbl(-2.5) * (minute.cast("double") / minutes))), 1)


def adi_advice() -> Column:
    """Texts in fixed order for every pillar above its limit, or the all-clear."""
    c = F.col
    said = F.array_compact(F.array(
        F.when(c("arm") > 40, T.ADVICE_ARM), F.when(c("postural") > 50, T.ADVICE_POSTURE),
        F.when(c("repetition") > 50, T.ADVICE_REPEAT), F.when(c("work_rest") > 50, T.ADVICE_REST),
        F.when(c("load") > 30, T.ADVICE_LOAD)))
    return F.when(F.size(said) > 0, said).otherwise(F.array(F.lit(T.ADVICE_NONE)))


# ---------------------------------------------------------------- exposure limit, one-hour standard, task


def one_decimal(value: Column) -> Column:
    """Text of a value already rounded to one decimal."""
    return F.format_string("%.1f", value)


def iso_exposure(exposure_s: Column, tracked: Column) -> list[dict[str, Column]]:
    scaled = exposure_s / 60.0 * (dbl(1800) / F.greatest(dbl(60), tracked))
    c = F.col
    text = one_decimal(rnd(c("iso_minutes"), 1))
    return [
        {"iso_minutes": scaled},
        {"iso_violated": (tracked > 0) & (c("iso_minutes") > 4.0)},
        {"iso_message": F.when(tracked <= 0, T.ISO_NO_DATA)
         .when(c("iso_violated"), F.concat(F.lit(T.ISO_BAD[0]), text, F.lit(T.ISO_BAD[1])))
         .otherwise(F.concat(F.lit(T.ISO_OK[0]), text, F.lit(T.ISO_OK[1])))},
    ]


HOURLY_PARTS = ["sitting", "squatting", "standing", "bending", "severe_bending", "walking", "rest"]


def hourly(tracked: Column, durations: dict[str, Column], rest_count: Column, loads: Column, trips: Column,
           cpm: Column, sh45: Column, sh90: Column) -> list[dict[str, Column]]:
    """Successive projections that scale one worker's session to 3600 s."""
    c = F.col
    scale = F.when(tracked > 0, dbl(3600) / tracked).otherwise(dbl(1))
    secs = {f"{p}_1hr": F.least(dbl(3600), rnd(durations[p] * scale, 1)) for p in HOURLY_PARTS}
    texts = {f"{p}_hms_1hr": hms_rounded(c(f"{p}_1hr")) for p in HOURLY_PARTS}
    shares = {f"{p}_share_1hr": rnd(c(f"{p}_1hr") / 3600.0 * 100.0, 1) for p in HOURLY_PARTS}
    active = F.greatest(dbl(0), rnd(dbl(3600) - c("rest_1hr"), 1))
    cycles = F.when(cpm > 0, rnd_int(cpm * (c("active_1hr") / 60.0))).otherwise(F.lit(0).cast("long"))
    return [
        {"scaling_factor": rnd(scale, 3), **secs,
         "rest_count_1hr": rnd_int(rest_count * scale), "load_events_1hr": rnd_int(loads * scale),
         "trips_1hr": rnd_int(trips * scale),
         "arm_above_45_1hr": rnd(sh45 / 100.0 * 3600.0, 1), "arm_above_90_1hr": rnd(sh90 / 100.0 * 3600.0, 1)},
        {**texts, **shares, "active_1hr": active},
        {"active_hms_1hr": hms_rounded(c("active_1hr")), "cycles_1hr": cycles},
    ]


def task_class(bending: Column, squatting: Column, standing: Column, walking: Column, cpm: Column, joint: Column,
               tools: Column, loads: Column, sh90: Column) -> tuple[Column, Column]:
    """Key of the first matching task rule and its confidence."""
    rate, low = F.coalesce(cpm, dbl(0)), bending + squatting
    carries = (loads > 0) | F.array_contains(tools, "backpack") | F.array_contains(tools, "suitcase")
    transport = carries & ((walking > 15.0) | (standing > 30.0))
    weeding = low > 40.0
    hoeing = (rate > 20.0) & joint.isin("trunk", "elbow") & ((bending > 15.0) | (low > 20.0))
    picking = (standing > 50.0) & (rate > 15.0) & (joint == "shoulder") & (sh90 > 5.0)
    pruning = (rate > 25.0) & (joint == "wrist")
    key = (F.when(transport, "transport").when(weeding, "weeding").when(hoeing, "hoeing").when(picking, "picking")
           .when(pruning, "pruning").otherwise("general"))
    conf = (F.when(transport, dbl(0.88))
            .when(weeding, rnd(F.least(dbl(0.95), dbl(0.60) + low / 200.0), 2))
            .when(hoeing, rnd(F.least(dbl(0.92), dbl(0.70) + bending / 100.0), 2))
            .when(picking, rnd(F.least(dbl(0.93), dbl(0.70) + sh90 / 100.0), 2))
            .when(pruning, dbl(0.84)).otherwise(dbl(0.60)))
    return key, conf


def task_text(key: Column, which: int) -> Column:
    """Name (0), description (1) or hazard (2) from the fixed catalogue."""
    return F.element_at(F.create_map(*[F.lit(v) for k, row in T.TASKS.items() for v in (k, row[which])]), key)


def arm_risk(sh45: Column, sh90: Column) -> Column:
    return F.when((sh90 > 15.0) | (sh45 > 50.0), "High").when(sh45 > 25.0, "Moderate").otherwise("Low")


