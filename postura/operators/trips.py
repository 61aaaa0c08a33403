"""Trajectories: smoothing, path length, trips between direction reversals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postura.config import DEFAULTS, Thresholds
from postura.functions.numeric import dbl, rnd
from postura.operators.frames import with_chunk
from postura.operators.ordered import Series, drop_halo, stage, with_halo


def direction_deg(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def angle_diff(a: Column, b: Column) -> Column:
    """a − b brought into [-180, 180]; both lie within ±180."""
    d = a - b
    return F.when(d > 180.0, d - 360.0).when(d < -180.0, d + 360.0).otherwise(d)


def _series(key: str) -> Series:
    return Series(("video_id", key), ("ts", "frame_idx"))


def moving_avg(frames: DataFrame, key: str = "worker_id", limits: Thresholds = DEFAULTS) -> DataFrame:
    """Centroids with their five-point moving average (``sx``, ``sy``), the step before and its direction.

    Missing neighbours at the ends count as zero, so the path bends towards the origin there. A trajectory of fewer than five
    points stays as it is; four rows on either side tell, so no trajectory is counted as a whole.
    """
    s = _series(key)
    seen = frames.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    rows = with_halo(with_chunk(seen.select("video_id", key, "ts", "frame_idx", "x", "y"), limits), s, back=4, ahead=4)
    five = s.window().rowsBetween(-2, 2)
    short = F.count(F.lit(1)).over(s.window().rowsBetween(-4, 4)) < 5
    smooth = rows.withColumn("_short", short).withColumns({
        f"s{v}": F.when(F.col("_short"), F.col(v)).otherwise(F.sum(v).over(five) / 5.0) for v in ("x", "y")})
    prev = smooth.withColumns({"_px": F.lag("sx").over(s.window()), "_py": F.lag("sy").over(s.window())})
    dx, dy = F.col("sx") - F.col("_px"), F.col("sy") - F.col("_py")
    return drop_halo(prev).select("video_id", key, "ts", "frame_idx", "x", "y", "sx", "sy", "chunk",
                                  F.sqrt(dx * dx + dy * dy).alias("step"), direction_deg(dx, dy).alias("direction"))


def long_enough(smoothed: DataFrame, key: str = "worker_id", limits: Thresholds = DEFAULTS) -> DataFrame:
    """Number of points and path length of every trajectory that is long enough to hold a trip."""
    return smoothed.groupBy("video_id", key).agg(
        F.count(F.lit(1)).alias("n_points"), rnd(F.coalesce(F.sum("step"), dbl(0)), 1).alias("path_px"),
    ).where(F.col("n_points") >= 2 * limits.sustain_frames)


_STATE = ("struct<n:int,t0:double,x0:double,y0:double,dir0:double,dir1:double,held:int,"
          "trips:array<struct<start_time:double,end_time:double,start_x:double,start_y:double,"
          "end_x:double,end_y:double,distance:double,direction:double>>>")
_CARRY = ["n", "t0", "x0", "y0", "dir0", "dir1", "held"]


def _state(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()]).cast(_STATE)


def _fresh() -> Column:
    none = F.lit(None).cast("double")
    return _state(n=F.lit(0), t0=none, x0=none, y0=none, dir0=none, dir1=none, held=F.lit(0),
                  trips=F.array().cast("array<struct<start_time:double,end_time:double,start_x:double,"
                                       "start_y:double,end_x:double,end_y:double,distance:double,direction:double>>"))


def _advance(limits: Thresholds):
    """One point of a trajectory against the reversal state: where the current trip began and its direction,
    and how long a new direction has been held."""

    def step(a: Column, p: Column) -> Column:
        reach = F.sqrt(F.pow(p["sx"] - a["x0"], 2) + F.pow(p["sy"] - a["y0"], 2))
        turned = ((F.abs(angle_diff(p["direction"], a["dir0"])) > limits.reversal_deg) & (reach > limits.trip_px))
        held = (F.when(~turned, 0).when(a["dir1"].isNull(), 1)
                .when(F.abs(angle_diff(p["direction"], a["dir1"])) < 45.0, a["held"] + 1).otherwise(0))
        goes_on = F.when(held > 0, F.coalesce(a["dir1"], p["direction"]))
        trip = F.struct(a["t0"].alias("start_time"), p["ts"].alias("end_time"), a["x0"].alias("start_x"),
                        a["y0"].alias("start_y"), p["sx"].alias("end_x"), p["sy"].alias("end_y"),
                        rnd(reach, 1).alias("distance"), rnd(a["dir0"], 1).alias("direction"))
        none = F.lit(None).cast("double")
        return (
            F.when(a["n"] == 0, _state(n=F.lit(1), t0=p["ts"], x0=p["sx"], y0=p["sy"], dir0=none, dir1=none,
                                       held=F.lit(0), trips=a["trips"]))
            .when(a["n"] == 1, _state(n=F.lit(2), t0=a["t0"], x0=a["x0"], y0=a["y0"], dir0=p["direction"], dir1=none,
                                      held=F.lit(0), trips=a["trips"]))
            .when(held >= limits.sustain_frames,
                  _state(n=F.lit(2), t0=p["ts"], x0=p["sx"], y0=p["sy"], dir0=p["direction"], dir1=none,
                         held=F.lit(0), trips=F.concat(a["trips"], F.array(trip))))
            .otherwise(_state(n=F.lit(2), t0=a["t0"], x0=a["x0"], y0=a["y0"], dir0=a["dir0"], dir1=goes_on,
                              held=held, trips=a["trips"]))
        )

    return step


def _carry_of(state: Column) -> Column:
    """The state without its finished trips: what the next slice needs."""
    empty = _fresh()["trips"]
    return F.struct(*[state[f].alias(f) for f in _CARRY], empty.alias("trips")).cast(_STATE)


def _demands(folded: DataFrame, spans: DataFrame, key: str, reach: int) -> DataFrame:
    """States that later slices may be given: what a slice hands over goes to the next one as it is. The trip that is under way
    goes to further ones as well, up to the next slice that ends trips of its own, or ``reach`` slices, since it may outlast
    them all; a new direction is taken as not yet held there."""
    whole = F.col("pos") == 0
    seen = folded.where(whole | (F.size("out.trips") > 0) | (F.col("given.n") > 0))  # else it began at the slice, not at a trip
    ahead = seen.join(spans, ["video_id", key, "pos"]).where("pos < last").select(
        "video_id", key, "pos", "last", "stop", _carry_of(F.col("out")).alias("_out"))
    far = F.least("last", F.when(F.col("_out.n") > 1, F.greatest("stop", F.col("pos") + reach)).otherwise(F.col("pos") + 1))
    sent = ahead.select("video_id", key, "pos", "_out", F.explode(F.sequence(F.col("pos") + 1, far)).alias("at"))
    none = F.lit(None).cast("double")
    begun = _state(**{f: F.col(f"_out.{f}") for f in ("n", "t0", "x0", "y0", "dir0")}, dir1=none, held=F.lit(0), trips=_fresh()["trips"])
    given = F.when(F.col("at") == F.col("pos") + 1, F.col("_out")).otherwise(begun)
    return sent.select("video_id", key, F.col("at").alias("pos"), given.alias("given")).distinct()


def _true_path(steps: DataFrame, key: str, slices: int) -> DataFrame:
    """Of transitions ``given`` to ``to`` between neighbouring slices: those on the way from the first slice, by pointer doubling."""
    on = ["video_id", key, "pos", "given"]
    path, hop, width = steps.where("pos = 0").select(*on), steps, 1
    while width < slices:
        moved = path.join(hop, on).select("video_id", key, (F.col("pos") + width).alias("pos"), F.col("to").alias("given"))
        path = stage(path.unionByName(moved))
        after = hop.select("video_id", key, (F.col("pos") - width).alias("pos"), F.col("given").alias("to"), F.col("to").alias("_to"))
        if 2 * width < slices:
            hop = stage(hop.join(after, ["video_id", key, "pos", "to"]).select(*on, F.col("_to").alias("to")))
        width *= 2
    return path.join(steps.select(*on), on, "left_semi")  # the last slice hands over to none


def trips(smoothed: DataFrame, key: str = "worker_id", limits: Thresholds = DEFAULTS) -> DataFrame:
    """Trips of every trajectory that is long enough.

    The reversal state runs over all points of a worker. Once a trip ends the state depends on that point alone, so few
    different states ever enter a slice. Every time slice is folded from each of them: first all slices from nothing, then from
    what other slices hand over, all new states of a round at once, until there are none. These transitions are composed
    by pointer doubling, which tells what really entered each slice. A trip under way is sent on over a growing number of slices, so
    one that lasts does not cost a round per slice; the rounds are as many as states that differ, or the logarithm of the slices.
    """
    on = ["video_id", key, "pos", "given"]
    enough = long_enough(smoothed, key, limits).select("video_id", key)
    points = F.array_sort(F.collect_list(F.struct("ts", "frame_idx", "sx", "sy", "direction")))
    # grouped before the join: rows spread by slice, not by worker
    sliced = stage(smoothed.groupBy("video_id", key, "chunk").agg(points.alias("pts")).join(enough, ["video_id", key], "left_semi"))
    across = _series(key).across()
    place = sliced.select("video_id", key, "chunk", (F.row_number().over(across) - 1).alias("pos"))
    slices = stage(sliced.join(place, ["video_id", key, "chunk"]).drop("chunk"))

    def fold(df: DataFrame) -> DataFrame:
        return stage(df.select(*on, F.aggregate("pts", F.col("given"), _advance(limits)).alias("out")))

    folded = [fold(slices.withColumn("given", _fresh()))]
    ordered = Window.partitionBy("video_id", key).orderBy("pos")
    ended = F.when(F.size("out.trips") > 0, F.col("pos"))
    last = F.max("pos").over(Window.partitionBy("video_id", key))
    spans = stage(folded[0].select("video_id", key, "pos", last.alias("last"), ended.alias("_e")).select(
        "video_id", key, "pos", "last",
        F.coalesce(F.min("_e").over(ordered.rowsBetween(1, Window.unboundedFollowing)), F.col("last")).alias("stop")))
    known, reach = folded[0].select(*on), 1
    while True:
        new = stage(_demands(folded[-1], spans, key, reach).join(known, on, "left_anti"))
        if new.isEmpty():
            break
        folded.append(fold(slices.join(new, ["video_id", key, "pos"])))
        known, reach = known.unionByName(folded[-1].select(*on)), 2 * reach
    every = folded[0]
    for more in folded[1:]:
        every = every.unionByName(more)
    steps = stage(every.select(*on, _carry_of(F.col("out")).alias("to")))
    longest = spans.agg(F.max("last")).first()[0]
    path = _true_path(steps, key, 1 if longest is None else longest + 1)
    found = every.join(path, on, "left_semi")
    return found.select("video_id", key, F.explode("out.trips").alias("_t")).select("video_id", key, "_t.*")


def count_trips(frames: DataFrame, key: str = "worker_id", limits: Thresholds = DEFAULTS) -> DataFrame:
    """Trips and path length per worker; a short trajectory has neither."""
    smoothed = stage(moving_avg(frames, key, limits))
    found = trips(smoothed, key, limits).groupBy("video_id", key).agg(F.count(F.lit(1)).alias("_trips"))
    workers = frames.groupBy("video_id", key).agg(F.count(F.lit(1)).alias("_frames"))
    return (workers.join(long_enough(smoothed, key, limits), ["video_id", key], "left")
            .join(found, ["video_id", key], "left")
            .select("video_id", key, F.coalesce("_trips", F.lit(0)).alias("trip_count"),
                    F.coalesce("path_px", dbl(0)).alias("path_px")))
