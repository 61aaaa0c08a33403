"""Objects near persons: equi join on frame and grid cell, distance as residual condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postura import tables as T
from postura.config import DEFAULTS, Thresholds


def near_person(persons: DataFrame, objects: DataFrame, ratio: float = 0.5, inclusive: bool = True,
                keep: tuple[str, ...] = ("raw_id",)) -> DataFrame:
    """Pairs of one frame whose centres are within ``ratio`` of the person box diagonal.

    A frame may hold a crowd, so both sides also meet on a grid cell. Cells are two to four times as wide as the reach of the
    person, a power of two: a person looks into the one to four cells that its reach touches on the grid of its own width, an object
    stands in one cell of each grid that some person of its frame uses. So a pair meets once.
    """
    b, o = F.col("_person"), F.col("bbox")
    middle = lambda box, c: (box[f"{c}1"] + box[f"{c}2"]) / 2.0
    dx, dy = middle(o, "x") - middle(b, "x"), middle(o, "y") - middle(b, "y")
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    dist, reach = F.sqrt(dx * dx + dy * dy), F.sqrt(w * w + h * h) * float(ratio)
    on = ["video_id", "frame_idx"]
    side = F.pow(F.lit(2.0), F.col("_grid"))
    cell = lambda box, c: F.floor(middle(box, c) / side)
    p = persons.select(*on, *keep, F.col("bbox").alias("_person"))
    # a box without extent reaches its own centre only, on the finest grid
    grid = F.when(reach > 1.0, F.floor(F.log2(reach)).cast("int") + 2).otherwise(F.lit(2))
    p = p.where(reach.isNotNull()).withColumn("_grid", grid)
    grids = p.select(*on, "_grid").distinct()
    pad = reach * 1.001 + 1e-3  # rounding of cell edges loses none
    touched = lambda c: F.sequence(F.floor((middle(b, c) - pad) / side), F.floor((middle(b, c) + pad) / side))
    p = p.withColumn("_cx", F.explode(touched("x"))).withColumn("_cy", F.explode(touched("y")))
    stands = objects.join(grids, on).withColumns({"_cx": cell(o, "x"), "_cy": cell(o, "y")})
    near = dist <= reach if inclusive else dist < reach
    return stands.join(p, [*on, "_grid", "_cx", "_cy"]).where(near).drop("bbox", "_person", "_grid", "_cx", "_cy")


def objects_of_persons(persons: DataFrame, objects: DataFrame, limits: Thresholds = DEFAULTS,
                       keep: tuple[str, ...] = ("raw_id",)) -> DataFrame:
    """The pipeline's association: strictly within 0.6 of the diagonal."""
    return near_person(persons, objects, limits.near_ratio, False, keep)


def loads(near: DataFrame) -> DataFrame:
    return near.where(F.col("class_name").isin(T.LOAD_CLASSES))


def load_force(frames: DataFrame, near: DataFrame, key: str = "raw_id") -> DataFrame:
    """Adds ``load_force``: 2 on frames where the person carries a load, else 0 (distinct keys, left join)."""
    carried = loads(near).select("video_id", key, "frame_idx").distinct().withColumn("_carried", F.lit(True))
    return (frames.join(carried, ["video_id", key, "frame_idx"], "left")
            .withColumn("load_force", F.when(F.col("_carried"), 2).otherwise(0)).drop("_carried"))


def unify_ids(df: DataFrame, id_map: DataFrame) -> DataFrame:
    """raw_id → worker_id; ids without a unified one stay apart from unified ones as negative numbers."""
    return (df.join(id_map.select("video_id", "raw_id", "unified_id"), ["video_id", "raw_id"], "left")
            .withColumn("worker_id", F.coalesce("unified_id", -F.col("raw_id"))).drop("unified_id"))


def class_name(class_id: Column) -> Column:
    pairs = [F.lit(v) for k, name in sorted(T.WORK_CLASSES.items()) for v in (k, name)]
    return F.element_at(F.create_map(*pairs), class_id)
