"""Worker figures rolled up to videos, sites and all: every level from the same few counts.

A percentile of percentiles is none, so what is carried is how many frames of a worker have each score. These counts are summed over
any set of workers, and the 90th percentile of that set comes from them exactly. Frames are reduced to at most one row per worker,
label and score before any shuffle; the levels are grouping sets over those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postura import tables as T
from postura.functions import scoring as S
from postura.functions.numeric import dbl, share

#: Grouping sets, from the finest, and the names of their levels.
LEVELS = {"worker": ["site", "video_id", "worker_id"], "video": ["site", "video_id"], "site": ["site"], "all": []}


def score_counts(scored: DataFrame, key: str = "worker_id") -> DataFrame:
    """Frames with ``label`` and ``final_score`` to counts: video_id, worker_id, label, final_score, n. Counts of parts of a
    table (days, cameras) may be united and summed again."""
    return scored.groupBy("video_id", F.col(key).alias("worker_id"), "label", "final_score").agg(F.count(F.lit(1)).alias("n"))


def p90_of_counts(scores: Column, total: Column, top: int) -> Column:
    """90th percentile, interpolated and truncated, of an ascending array of (score, n); there are few scores."""
    upto = F.transform(scores, lambda x, i: F.struct(
        x["final_score"].alias("s"), F.aggregate(F.slice(scores, 1, i + 1), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("upto")))
    pos = (total - 1) * dbl(0.9)
    low, frac = F.floor(pos), pos - F.floor(pos)
    at = lambda rank: F.element_at(F.filter(upto, lambda x: x["upto"] > F.least(rank, total - 1)), 1)["s"]
    first, second = at(low), at(low + 1)
    gap = second - first
    exact = F.when(frac >= 0.5, second - gap * (dbl(1) - frac)).otherwise(first + gap * frac)
    return F.greatest(F.lit(1), F.least(F.lit(top), F.floor(exact).cast("int")))


def rollup(counts: DataFrame, sites: DataFrame, top: int = 15) -> DataFrame:
    """Counts (``score_counts``) and ``sites`` (video_id, site) to one row per worker, video, site and all: level, site, video_id,
    worker_id (null above their level), n_workers, n_frames, the share of each label, max_score, p90_score and its risk level.

    A video that ``sites`` does not name has a null site, which is a site of its own. An empty table gives no rows, not even for all.
    """
    known = counts.join(sites.select("video_id", "site"), "video_id", "left")
    # one of a worker's rows stands for the worker
    mine = Window.partitionBy("video_id", "worker_id").orderBy("label", "final_score")
    marked = known.withColumn("_one", (F.row_number().over(mine) == 1).cast("long"))
    sets = [[F.col(c) for c in names] + [F.col("final_score")] for names in LEVELS.values()]
    keys = LEVELS["worker"]
    labels = [F.sum(F.when(F.col("label") == v, F.col("n")).otherwise(0)).alias(f"_{v}") for v in T.LABELS]
    per_score = marked.groupingSets(sets, *keys, "final_score").agg(
        F.grouping_id().alias("_set"), F.sum("n").alias("n"), F.sum("_one").alias("_one"), *labels)
    rows = per_score.groupBy("_set", *keys).agg(
        F.sum("_one").alias("n_workers"), F.sum("n").alias("n_frames"), F.max("final_score").alias("max_score"),
        F.array_sort(F.collect_list(F.struct("final_score", "n"))).alias("_scores"), *[F.sum(f"_{v}").alias(f"_{v}") for v in T.LABELS])
    level = F.lit(None).cast("string")
    for name, grouped in LEVELS.items():
        # a bit is set for each key that is summed over; the last bit is the score's, which never is
        bits = sum(2 << len(keys) - 1 - i for i, k in enumerate(keys) if k not in grouped)
        level = F.when(F.col("_set") == bits, name).otherwise(level)
    p90 = p90_of_counts(F.col("_scores"), F.col("n_frames"), top)
    out = rows.select(level.alias("level"), *keys, "n_workers", "n_frames", *[
        share(F.col(f"_{v}"), F.col("n_frames")).alias(f"{v}_pct") for v in T.LABELS], "max_score", p90.alias("p90_score"))
    return out.withColumn("risk_level", S.level_map(F.col("p90_score"), T.REBA_LEVELS, 2))
