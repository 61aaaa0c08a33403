"""Angles and points from 17-joint poses, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postura import tables as T
from postura.config import DEFAULTS, Thresholds
from postura.functions.numeric import dbl, mean_of


@dataclass(frozen=True)
class Point:
    x: Column
    y: Column

    def __sub__(self, other: "Point") -> "Point":
        return Point(self.x - other.x, self.y - other.y)

    def norm(self) -> Column:
        return F.sqrt(self.x * self.x + self.y * self.y)

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"))


def point(struct: Column) -> Point:
    return Point(struct["x"], struct["y"])


def _arc(cosine: Column) -> Column:
    return F.degrees(F.acos(F.greatest(dbl(-1), F.least(dbl(1), cosine))))


def angle_3pt(a: Point, b: Point, c: Point) -> Column:
    """Angle at ``b`` between the rays to ``a`` and ``c``, in degrees."""
    u, v = a - b, c - b
    return _arc((u.x * v.x + u.y * v.y) / (u.norm() * v.norm() + dbl(1e-8)))


def angle_vertical(top: Point, bottom: Point) -> Column:
    """Angle of the segment bottom→top against image-up (y grows downwards)."""
    d = top - bottom
    return _arc(-d.y / (d.norm() + dbl(1e-8)))


def midpoint(a: Point, b: Point) -> Point:
    return Point((a.x + b.x) / 2.0, (a.y + b.y) / 2.0)


# joints that any operator reads, with the short names of their un-nested columns
JOINTS = {
    "nose": T.NOSE,
    "l_sh": T.L_SHOULDER, "r_sh": T.R_SHOULDER,
    "l_el": T.L_ELBOW, "r_el": T.R_ELBOW,
    "l_wr": T.L_WRIST, "r_wr": T.R_WRIST,
    "l_hip": T.L_HIP, "r_hip": T.R_HIP,
    "l_kn": T.L_KNEE, "r_kn": T.R_KNEE,
    "l_an": T.L_ANKLE, "r_an": T.R_ANKLE,
}


class Pose:
    """Column access to one pose; joints are read from un-nested columns ``<joint>_x/_y/_c``."""

    def __init__(self, limits: Thresholds = DEFAULTS):
        self.min_conf = limits.keypoint_conf

    def at(self, joint: str) -> Point:
        return Point(F.col(f"{joint}_x"), F.col(f"{joint}_y"))

    def conf(self, joint: str) -> Column:
        return F.col(f"{joint}_c")

    def sure(self, joint: str, strict: bool = False) -> Column:
        """Confidence test alone (no zero-point test)."""
        c = self.conf(joint)
        return (c > self.min_conf) if strict else (c >= self.min_conf)

    def valid(self, *joints: str) -> Column:
        ok = F.lit(True)
        for j in joints:
            ok = ok & F.col(f"{j}_ok")
        return ok


def kp_valid(x: Column, y: Column, conf: Column, min_conf: float = DEFAULTS.keypoint_conf) -> Column:
    """Confident and not the (0, 0) placeholder."""
    at_origin = (F.abs(x) <= 1e-8) & (F.abs(y) <= 1e-8)
    return (conf >= min_conf) & ~at_origin


def unroll(df: DataFrame, keep: list[str], limits: Thresholds = DEFAULTS) -> DataFrame:
    """keypoints/conf arrays → one x, y, confidence and validity column per joint."""
    out = [F.col(c) for c in keep]
    for name, i in JOINTS.items():
        x, y, c = F.col("keypoints")[i]["x"], F.col("keypoints")[i]["y"], F.col("conf")[i]
        out += [x.alias(f"{name}_x"), y.alias(f"{name}_y"), c.alias(f"{name}_c"),
                kp_valid(x, y, c, limits.keypoint_conf).alias(f"{name}_ok")]
    return df.select(*out)


def trunk_flexion(p: Pose) -> Column:
    ok = p.valid("l_sh", "r_sh", "l_hip", "r_hip")
    return F.when(ok, angle_vertical(midpoint(p.at("l_sh"), p.at("r_sh")), midpoint(p.at("l_hip"), p.at("r_hip"))))


def neck_flexion(p: Pose) -> Column:
    ok = p.valid("nose", "l_sh", "r_sh")
    return F.when(ok, angle_vertical(p.at("nose"), midpoint(p.at("l_sh"), p.at("r_sh"))))


def three_joint(p: Pose, a: str, b: str, c: str) -> Column:
    return F.when(p.valid(a, b, c), angle_3pt(p.at(a), p.at(b), p.at(c)))


def wrist_angle(p: Pose, side: str) -> Column:
    return F.when(p.valid(f"{side}_el", f"{side}_wr"), angle_vertical(p.at(f"{side}_wr"), p.at(f"{side}_el")))


def joint_angles(unrolled: DataFrame, keep: list[str], limits: Thresholds = DEFAULTS) -> DataFrame:
    """All angles of a pose in two narrow projections (sides first, then their combinations)."""
    p = Pose(limits)
    sides = {"trunk": trunk_flexion(p), "neck": neck_flexion(p)}
    for s, t in (("l", "left"), ("r", "right")):
        sides[f"{t}_hip"] = three_joint(p, f"{s}_sh", f"{s}_hip", f"{s}_kn")
        sides[f"{t}_knee"] = three_joint(p, f"{s}_hip", f"{s}_kn", f"{s}_an")
        sides[f"{t}_elbow"] = three_joint(p, f"{s}_sh", f"{s}_el", f"{s}_wr")
        sides[f"{t}_shoulder"] = three_joint(p, f"{s}_hip", f"{s}_sh", f"{s}_el")
        sides[f"{t}_wrist"] = wrist_angle(p, s)
    one = unrolled.select(*keep, *[c.alias(n) for n, c in sides.items()])
    pair = {part: (F.col(f"left_{part}"), F.col(f"right_{part}")) for part in ("hip", "knee", "elbow", "shoulder")}
    high = F.greatest(*pair["shoulder"])
    return one.select(
        "*",
        *[mean_of(*pair[part]).alias(f"avg_{part}") for part in pair],
        high.alias("max_shoulder"),
        F.coalesce(high >= 90.0, F.lit(False)).alias("arm_above_90"),
        F.coalesce(high >= 45.0, F.lit(False)).alias("arm_above_45"),
    )


def side_pick(left: Column, right: Column) -> Column:
    """Left value unless it is missing; an angle of exactly 0 counts as missing."""
    return F.coalesce(F.nullif(left, dbl(0)), right)


def pair_point(p: Pose, left: str, right: str) -> Column:
    """Midpoint of a joint pair, or its confident member, or NULL. Tests confidence only."""
    a, b = p.sure(left), p.sure(right)
    return (F.when(a & b, midpoint(p.at(left), p.at(right)).struct())
            .when(a, p.at(left).struct())
            .when(b, p.at(right).struct()))


def centroid(p: Pose) -> Column:
    return pair_point(p, "l_hip", "r_hip")


def ankle_point(p: Pose) -> Column:
    return pair_point(p, "l_an", "r_an")


def mean_kp_conf(conf: Column, limits: Thresholds = DEFAULTS) -> Column:
    good = F.filter(conf, lambda c: c > limits.mean_conf_floor)
    total = F.aggregate(good, dbl(0), lambda acc, c: acc + c)
    return F.when(F.size(good) > 0, total / F.size(good)).otherwise(dbl(limits.mean_conf_default))


def hips_low(p: Pose) -> Column:
    """Leg height below three quarters of the torso height, from strictly confident joints."""

    def height(left: str, right: str) -> Column:
        return mean_of(F.when(p.sure(left, True), p.at(left).y), F.when(p.sure(right, True), p.at(right).y))

    hip, ankle, shoulder = height("l_hip", "r_hip"), height("l_an", "r_an"), height("l_sh", "r_sh")
    torso, leg = F.abs(hip - shoulder), F.abs(ankle - hip)
    return F.coalesce((torso > 0) & (leg < torso * 0.75), F.lit(False))
