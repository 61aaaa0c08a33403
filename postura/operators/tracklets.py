"""Tracklets: extent, concurrency, re-linking into persistent workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from postura.config import DEFAULTS, Thresholds
from postura.functions.numeric import dbl
from postura.operators.ordered import Series, chunk_of, scan, stage


def _mean(c: str) -> Column:
    """Mean by an exact sum, so that it is the same in whatever order the rows arrive: equal distances must stay equal. What no decimal
    holds (not finite, or very large) falls back on the sum of doubles."""
    exact = F.col(c).try_cast("decimal(28,12)")
    mean = F.sum(exact).cast("double") / F.count(exact)
    return F.when(F.count(exact) == F.count(c), mean).otherwise(F.avg(c))


def tracklet_meta(frames: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Extent of every raw id: one hash aggregate over the frames that have a centroid.

    First and last positions go by frame number, which runs with time inside a track; number buffers of fixed width keep the
    aggregate hash-based.
    """
    seen = frames.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    ends = [pick(c, "frame_idx").alias(f"{end}_{c}") for end, pick in (("start", F.min_by), ("end", F.max_by))
            for c in ("x", "y")]
    meta = seen.groupBy("video_id", "raw_id").agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count(F.lit(1)).alias("n_frames"), *ends,
        _mean("x").alias("mean_x"), _mean("y").alias("mean_y"),
    ).where(F.col("n_frames") >= limits.min_tracklet_frames)
    return meta.withColumn("duration", F.greatest(dbl(1), F.col("end_time") - F.col("start_time")))


def peak_concurrency(meta: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Most tracklets present at once per video; a start counts before an end of the same instant.

    Starts and ends are summed per instant, then running sums are taken slice by slice: only one row per time slice
    is ordered over a whole video.
    """
    edge = lambda t, s, e: meta.select("video_id", F.col(t).alias("t"), F.lit(s).alias("s"), F.lit(e).alias("e"))
    moments = (edge("start_time", 1, 0).unionByName(edge("end_time", 0, 1))
               .groupBy("video_id", "t").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
               .withColumn("chunk", chunk_of(F.col("t"), limits.chunk_s)))
    s = Series(("video_id",), ("t",))
    before = F.coalesce(F.sum(F.col("s") - F.col("e")).over(s.window().rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0))
    local = moments.withColumn("_now", before + F.col("s"))
    slices = local.groupBy("video_id", "chunk").agg(F.max("_now").alias("_high"),
                                                    F.sum(F.col("s") - F.col("e")).alias("_net"))
    carried = F.coalesce(F.sum("_net").over(s.across().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (slices.withColumn("_peak", F.col("_high") + carried)
            .groupBy("video_id").agg(F.greatest(F.lit(1), F.max("_peak")).alias("peak_concurrency")))


def _cells(x: Column, y: Column, size: float, reach: int) -> Column:
    cx, cy = F.floor(x / size), F.floor(y / size)
    steps = range(-reach, reach + 1)
    return F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in steps for j in steps])


def stitch_candidates(meta: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Pairs (earlier tracklet, later tracklet) that may be one person.

    Interval and distance conditions become equi-join keys: the start time falls in one time bucket and a position in
    one grid cell, and the earlier side looks in the neighbouring buckets and cells. End→start and mean→mean
    distances use separate cells, tagged ``how``; a pair found by both is taken once.
    """
    width = limits.max_gap_s + limits.overlap_s
    far = limits.max_link_px
    spot = lambda how, cell: F.struct(F.lit(how).alias("how"), cell.alias("cell"))

    later = meta.withColumn("_tb", F.floor(F.col("start_time") / width)).withColumn("_key", F.explode(F.array(
        spot("near", _cells(F.col("start_x"), F.col("start_y"), far, 0)[0]),
        spot("mean", _cells(F.col("mean_x"), F.col("mean_y"), far, 0)[0]))))
    first = F.floor((F.col("end_time") - limits.overlap_s) / width)
    last = F.floor((F.col("end_time") + limits.max_gap_s) / width)
    near = F.transform(_cells(F.col("end_x"), F.col("end_y"), far, 1), lambda c: spot("near", c))
    mean = F.transform(_cells(F.col("mean_x"), F.col("mean_y"), far, 1), lambda c: spot("mean", c))
    earlier = meta.withColumn("_tb", F.explode(F.sequence(first, last))).withColumn(
        "_key", F.explode(F.concat(near, mean)))

    a = earlier.select("video_id", "_tb", "_key", F.struct("start_time", "raw_id").alias("o1"), "end_time", "end_x",
                       "end_y", F.col("mean_x").alias("m1x"), F.col("mean_y").alias("m1y"))
    b = later.select("video_id", "_tb", "_key", F.struct("start_time", "raw_id").alias("o2"), "start_x", "start_y",
                     F.col("mean_x").alias("m2x"), F.col("mean_y").alias("m2y"))
    d = lambda x1, y1, x2, y2: F.sqrt(F.pow(F.col(x2) - F.col(x1), 2) + F.pow(F.col(y2) - F.col(y1), 2))
    pairs = a.join(b, ["video_id", "_tb", "_key"]).withColumns({
        "gap": F.col("o2.start_time") - F.col("end_time"),
        "_near": d("end_x", "end_y", "start_x", "start_y"), "_mean": d("m1x", "m1y", "m2x", "m2y")})
    found = F.when(F.col("_key.how") == "near", F.col("_near") <= far).otherwise(
        (F.col("_mean") <= far) & (F.col("_near") > far))
    ok = (F.col("o2") > F.col("o1")) & F.col("gap").between(-limits.overlap_s, limits.max_gap_s) & found
    return pairs.where(ok).select("video_id", "o1", "o2", F.col("o1.raw_id").alias("raw_1"),
                                  F.col("o2.raw_id").alias("raw_2"), "gap",
                                  F.least("_near", "_mean").alias("distance"))


def _ask(edges: DataFrame) -> DataFrame:
    """One round: every earlier tracklet asks for its nearest later one, and a later one listens only to its earliest
    asker. Adds ``asks`` and ``lives`` (false where an earlier asker holds the later tracklet)."""
    asker = Window.partitionBy("video_id", "o1").orderBy("distance", "o2")
    asked = Window.partitionBy("video_id", "o2")
    edges = edges.withColumn("asks", F.row_number().over(asker) == 1)
    held = F.min(F.when(F.col("asks"), F.col("o1"))).over(asked)
    return edges.withColumn("lives", F.coalesce(F.col("o1") <= held, F.lit(True)))


def _settled(edges: DataFrame, rounds: int = 4) -> DataFrame:
    """Repeated asking until no edge is dropped; the edges that are left, staged, with ``asks``. Rounds run in batches."""
    while True:
        for _ in range(rounds - 1):
            edges = _ask(edges).where("lives").drop("asks", "lives")
        dropped = Observation()
        last = _ask(edges).observe(dropped, F.count_if(~F.col("lives")).alias("n"))
        edges = stage(last.where("lives").drop("lives"))
        if not dropped.get["n"]:
            return edges
        edges = edges.drop("asks")


def successors(candidates: DataFrame, rounds: int = 4) -> DataFrame:
    """The greedy choice "in start order, take the nearest tracklet still free", found in parallel rounds.

    Later tracklets all prefer the earliest asker, so the greedy result is the one stable matching of askers and
    asked, and repeated asking reaches it. Each round is two window steps over candidate edges; no video is processed
    in one piece. A batch of rounds whose last one drops no edge is the last.
    """
    edges = _settled(candidates.select("video_id", "o1", "o2", "distance"), rounds)
    return _links(edges.where("asks"))


def _links(matched: DataFrame) -> DataFrame:
    return matched.select("video_id", F.col("o1.raw_id").alias("raw_1"), F.col("o2.raw_id").alias("raw_2"))


#: Tracklets that a grid cell should hold at the finest level, and the most levels. A cell of the coarsest level is divided only
#: if it holds more than ``DENSE``.
CROWD, LEVELS, DENSE = 4, 12, 32


def _asked(meta: DataFrame, finest: DataFrame, limits: Thresholds) -> DataFrame:
    """Every tracklet as one that may be asked: a row per grid level and kind of place, with its cell and time bucket."""
    rows = meta.join(finest, "video_id").select(
        "video_id", F.struct("start_time", "raw_id").alias("o2"), _bucket(F.col("start_time"), limits).alias("tb"), "start_x", "start_y",
        F.col("mean_x").alias("m2x"), F.col("mean_y").alias("m2y"), F.explode(F.sequence(F.lit(0), "finest")).alias("level"))
    side = _side(limits)
    spots = [F.struct(F.lit(how).alias("how"), F.floor(F.col(x) / side).alias("cx"), F.floor(F.col(y) / side).alias("cy"))
             for how, x, y in (("near", "start_x", "start_y"), ("mean", "m2x", "m2y"))]
    return rows.withColumn("_p", F.explode(F.array(*spots))).select(
        "video_id", "o2", "tb", "level", "_p.how", "_p.cx", "_p.cy", "start_x", "start_y", "m2x", "m2y")


def _crowds(meta: DataFrame, limits: Thresholds) -> DataFrame:
    """Coarsest cells (video, time bucket, kind of place, cell) that look into a dense one, with the level at which to begin there."""
    side = limits.max_link_px
    cell = lambda how, x, y: F.struct(F.lit(how).alias("how"), F.floor(F.col(x) / side).alias("cx"), F.floor(F.col(y) / side).alias("cy"))
    held = meta.select("video_id", _bucket(F.col("start_time"), limits).alias("tb"), F.explode(F.array(
        cell("near", "start_x", "start_y"), cell("mean", "mean_x", "mean_y"))).alias("_p"))
    dense = held.groupBy("video_id", "tb", "_p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > DENSE)
    depth = F.least(F.ceil(F.log2(F.col("n") / CROWD) / 2).cast("int"), F.lit(LEVELS))
    # an asker looks at its own bucket and the next, and at the cells around its own
    steps = [F.struct(F.lit(t).alias("t"), F.lit(i).alias("i"), F.lit(j).alias("j")) for t in (0, 1) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    around = dense.select("video_id", "tb", "_p", depth.alias("depth"), F.explode(F.array(*steps)).alias("_d"))
    return around.groupBy("video_id", (F.col("tb") - F.col("_d.t")).alias("tb"), "_p.how", (F.col("_p.cx") + F.col("_d.i")).alias("cx"),
                          (F.col("_p.cy") + F.col("_d.j")).alias("cy")).agg(F.max("depth").alias("depth"))


def _begins(meta: DataFrame, crowds: DataFrame, limits: Thresholds) -> DataFrame:
    """Adds ``level``, at which a tracklet begins to ask: 0 where no dense cell is near its end or its mean."""
    for how, x, y in (("near", "end_x", "end_y"), ("mean", "mean_x", "mean_y")):
        mine = crowds.where(F.col("how") == how).select("video_id", F.col("tb").alias("_tb"), F.col("cx").alias("_cx"),
                                                        F.col("cy").alias("_cy"), F.col("depth").alias(f"_{how}"))
        meta = meta.withColumns({"_tb": _bucket(F.col("end_time") - limits.overlap_s, limits), "_cx": F.floor(F.col(x) / limits.max_link_px),
                                 "_cy": F.floor(F.col(y) / limits.max_link_px)}).join(mine, ["video_id", "_tb", "_cx", "_cy"], "left")
        meta = meta.drop("_tb", "_cx", "_cy")
    return meta.withColumn("level", F.greatest(F.coalesce("_near", F.lit(0)), F.coalesce("_mean", F.lit(0)))).drop("_near", "_mean")


def _bucket(t: Column, limits: Thresholds) -> Column:
    return F.floor(t / (limits.max_gap_s + limits.overlap_s))


def _side(limits: Thresholds) -> Column:
    """Side of a cell of a level: the reach at that level."""
    return F.lit(limits.max_link_px) / F.pow(F.lit(2.0), F.col("level"))


def _nearest(active: DataFrame, asked: DataFrame, held: DataFrame, limits: Thresholds) -> DataFrame:
    """Edges from each active asker to what lies beyond its former reach and within that of its level, without tracklets that an
    earlier asker holds; those never change to a later one. A cell in which all are held so is passed over as a whole."""
    first, last = _bucket(F.col("end_time") - limits.overlap_s, limits), _bucket(F.col("end_time") + limits.max_gap_s, limits)
    steps = range(-1, 2)
    side = _side(limits)
    spots = [F.struct(F.lit(how).alias("how"), (F.floor(F.col(x) / side) + i).alias("cx"), (F.floor(F.col(y) / side) + j).alias("cy"))
             for how, x, y in (("near", "end_x", "end_y"), ("mean", "m1x", "m1y")) for i in steps for j in steps]
    looks = active.withColumn("tb", F.explode(F.sequence(first, last))).withColumn("_p", F.explode(F.array(*spots))).select(
        *active.columns, "tb", "_p.how", "_p.cx", "_p.cy")
    cell = ["video_id", "tb", "level", "how", "cx", "cy"]
    members = asked.join(held, ["video_id", "o2"], "left")
    free = F.col("holder").isNull()
    # the latest asker that a member of the cell would leave its holder for, or any
    cells = members.groupBy(*cell).agg(F.max(free).alias("_free"), F.max("holder").alias("_latest"))
    looks = looks.join(cells, cell).where(F.col("_free") | (F.col("_latest") > F.col("o1")))
    pairs = looks.join(members, cell).where(free | (F.col("holder") > F.col("o1")))
    d = lambda x1, y1, x2, y2: F.sqrt(F.pow(F.col(x2) - F.col(x1), 2) + F.pow(F.col(y2) - F.col(y1), 2))
    pairs = pairs.withColumns({"gap": F.col("o2.start_time") - F.col("end_time"), "_near": d("end_x", "end_y", "start_x", "start_y"),
                               "_mean": d("m1x", "m1y", "m2x", "m2y")}).withColumn("distance", F.least("_near", "_mean"))
    found = F.when(F.col("how") == "near", F.col("_near") <= side).otherwise((F.col("_mean") <= side) & (F.col("_near") > side))
    ok = (F.col("o2") > F.col("o1")) & F.col("gap").between(-limits.overlap_s, limits.max_gap_s) & found
    return pairs.where(ok & (F.col("distance") > F.col("reach"))).select("video_id", "o1", "o2", "distance")


def nearest_successors(meta: DataFrame, limits: Thresholds = DEFAULTS, rounds: int = 4) -> DataFrame:
    """The same choice without all pairs of a crowd: ``meta`` (staged) to raw_1, raw_2.

    Askers begin with the cells of a fine grid; one that finds all of those taken looks twice as far, until the limit. A tracklet that
    an earlier asker holds is not looked at any more. Asking in any order leads to the one stable matching, so the result is the
    greedy one. Each asker begins at a level that follows from the most crowded cell it can look into; the cells of a crowd
    are small, so no key holds it all. Where there is no crowd one round of looking sees everything, however large the video.
    """
    crowds = stage(_crowds(meta, limits))
    finest = meta.select("video_id").distinct().join(crowds.groupBy("video_id").agg(F.max("depth").alias("_f")), "video_id", "left").select(
        "video_id", F.coalesce("_f", F.lit(0)).alias("finest"))
    asked = stage(_asked(meta, finest, limits))
    askers = stage(_begins(meta, crowds, limits).select(
        "video_id", F.struct("start_time", "raw_id").alias("o1"), "end_time", "end_x", "end_y", F.col("mean_x").alias("m1x"),
        F.col("mean_y").alias("m1y"), "level", F.lit(-1.0).alias("reach")))
    edges, active = None, askers
    held = askers.limit(0).select("video_id", F.col("o1").alias("o2"), F.col("o1").alias("holder"))
    while True:
        found = _nearest(active, asked, held, limits)
        edges = _settled(found if edges is None else edges.drop("asks").unionByName(found), rounds)
        matched = edges.where("asks")
        waits = askers.join(matched.select("video_id", "o1"), ["video_id", "o1"], "left_anti").where("level > 0")
        further = waits.withColumns({"level": F.col("level") - 1, "reach": _side(limits)})
        active = stage(further)
        if active.isEmpty():
            return _links(matched)
        same = askers.join(active.select("video_id", "o1"), ["video_id", "o1"], "left_anti")
        askers = stage(same.unionByName(active))
        held = stage(matched.select("video_id", "o2", F.col("o1").alias("holder")))


def chains(meta: DataFrame, links: DataFrame) -> DataFrame:
    """First tracklet of every chain, by pointer doubling: log2(chain length) rounds of an equi join.

    Tracklets whose pointer has reached the first one take no further part.
    """
    back = links.select("video_id", F.col("raw_2").alias("raw_id"), F.col("raw_1").alias("_pred"))
    start = meta.select("video_id", "raw_id").join(back, ["video_id", "raw_id"], "left")
    nodes = stage(start.select("video_id", "raw_id", F.coalesce("_pred", "raw_id").alias("root"),
                               F.col("_pred").isNull().alias("done")))
    while not nodes.where(~F.col("done")).isEmpty():
        target = nodes.select("video_id", F.col("raw_id").alias("root"), F.col("root").alias("_next"),
                              F.col("done").alias("_done"))
        moved = nodes.where(~F.col("done")).join(target, ["video_id", "root"]).select(
            "video_id", "raw_id", F.col("_next").alias("root"), F.col("_done").alias("done"))
        nodes = stage(nodes.where("done").unionByName(moved))
    return nodes.drop("done")


def rank_clusters(meta: DataFrame, roots: DataFrame) -> DataFrame:
    """Worker numbers 1..n per video by total frames; a tie goes to the chain that starts first."""
    members = meta.join(roots, ["video_id", "raw_id"])
    sizes = members.groupBy("video_id", "root").agg(
        (-F.sum("n_frames")).alias("_size"), F.min("start_time").alias("_start"))
    part = sizes.withColumn("_slice", F.struct("_size", chunk_of(F.col("_start"), 600.0).alias("t")))
    ranked = scan(stage(part), Series(("video_id",), ("_size", "_start", "root"), "_slice"), count="unified_id")
    return members.select("video_id", "raw_id", "root", "n_frames").join(
        ranked.select("video_id", "root", "unified_id", (-F.col("_size")).alias("worker_frames")),
        ["video_id", "root"])


def stitch(frames: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Frames → (video_id, raw_id, unified_id)."""
    meta = stage(tracklet_meta(frames, limits))
    roots = chains(meta, nearest_successors(meta, limits))
    return rank_clusters(meta, roots).select("video_id", "raw_id", "unified_id")
