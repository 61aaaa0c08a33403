"""Ordered operators over long series, split so that no series has to fit one task.

A series (one worker, one tracklet) may be a large part of all rows. Every ordered operator therefore works
on slices: rows are distributed by (series keys, ``chunk``), where ``chunk`` is a slice of the ordering column,
and only one summary row (or a few boundary rows) per slice is ordered across the whole series. Results are the
same for every slice width; a width only sets how many rows one task holds at a time.

* ``scan``       nearest earlier / later non-null values and running counts, over the whole series
* ``with_halo``  copies the few neighbouring rows that a bounded frame (ROWS -n..+m) needs into each slice
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

HALO = "_halo"


@dataclass(frozen=True)
class Series:
    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunk: str = "chunk"

    @property
    def slice(self) -> list[str]:
        return [*self.keys, self.chunk]

    def window(self) -> WindowSpec:
        """Rows of one slice in series order."""
        return Window.partitionBy(*self.slice).orderBy(*self.order)

    def across(self) -> WindowSpec:
        """Slices of one series in order; for slice summaries only."""
        return Window.partitionBy(*self.keys).orderBy(self.chunk)


def chunk_of(ts: Column, seconds: float) -> Column:
    return F.floor(ts / F.lit(float(seconds))).cast("long")


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate table once and go on from the written copy.

    For reduced tables that several branches read: the plan stays small, nothing is computed twice, and a lost
    executor costs only a re-read. The folder is the cluster's ``spark.checkpoint.dir``.
    """
    path = staging_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_together(**tables: Callable[[], DataFrame]) -> dict[str, DataFrame]:
    """Build and stage tables that do not depend on each other from concurrent driver threads.

    Their jobs share the executors, so small stages of one table fill the gaps of another.
    """
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(tables)) as pool:
        runs = {n: pool.submit(inherit(lambda make=make: stage(make()))) for n, make in tables.items()}
        return {n: run.result() for n, run in runs.items()}


def staging_path(spark: SparkSession) -> str:
    """A new place in the folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir, or SparkContext.setCheckpointDir, to a folder that the driver and "
                           "all executors share: intermediate tables are written there")
    path = f"{root.rstrip('/')}/postura-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


_staged: list[str] = []


def drop_staged(spark: SparkSession) -> int:
    """Delete all intermediate tables of this process; call it when no result that reads them is needed any more."""
    paths = [_staged.pop() for _ in range(len(_staged))]
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def _earlier(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _next_value(column: str, partition: list[str], order: list[str]) -> Column:
    """Nearest later non-null value (offset frame: linear, unlike an unbounded following frame)."""
    over = f"PARTITION BY {', '.join(f'`{c}`' for c in partition)} ORDER BY {', '.join(f'`{c}`' for c in order)}"
    return F.expr(f"lead(`{column}`, 1) IGNORE NULLS OVER ({over})")


def scan(df: DataFrame, s: Series, before: dict[str, Column] | None = None, after: dict[str, Column] | None = None,
         count: str | None = None) -> DataFrame:
    """Add, per row of a series:

    * ``before[name]``: the last non-null value of the expression over all strictly earlier rows,
    * ``after[name]``: the first non-null value over all strictly later rows,
    * ``count``: 1-based position in the series.

    ``df`` is read twice (rows, slice summary): pass a source or a ``stage``d table.
    """
    before, after = before or {}, after or {}
    names = [*(f"_b_{n}" for n in before), *(f"_a_{n}" for n in after)]
    marked = df.select("*", *[e.alias(c) for e, c in zip([*before.values(), *after.values()], names)])
    at = F.struct(*s.order)

    # one row per slice; partial aggregation runs before its shuffle
    picks = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in names if c.startswith("_b_")]
    picks += [F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in names if c.startswith("_a_")]
    summary = marked.groupBy(*s.slice).agg(F.count(F.lit(1)).alias("_n"), *picks)
    across = s.across()
    carried = [F.last(c, ignorenulls=True).over(_earlier(across)).alias(f"_c{c}") for c in names if c.startswith("_b_")]
    carried += [_next_value(c, list(s.keys), [s.chunk]).alias(f"_c{c}") for c in names if c.startswith("_a_")]
    carry = summary.select(*s.slice, F.coalesce(F.sum("_n").over(_earlier(across)), F.lit(0)).alias("_c_n"), *carried)

    w = s.window()
    local = marked
    for c in names:
        value = (F.last(c, ignorenulls=True).over(_earlier(w)) if c.startswith("_b_")
                 else _next_value(c, s.slice, list(s.order)))
        local = local.withColumn(f"_l{c}", value)
    if count:
        local = local.withColumn("_rn", F.row_number().over(w))
    joined = local.join(carry, s.slice)
    out = [F.col(c) for c in df.columns]
    out += [F.coalesce(f"_l_b_{n}", f"_c_b_{n}").alias(n) for n in before]
    out += [F.coalesce(f"_l_a_{n}", f"_c_a_{n}").alias(n) for n in after]
    if count:
        out.append((F.col("_rn") + F.col("_c_n")).cast("long").alias(count))
    return joined.select(*out)


def _boundary(df: DataFrame, s: Series, n: int, forward: bool) -> DataFrame:
    """The ``n`` nearest rows before (forward) or after each slice, addressed to that slice."""
    flip = (lambda c: F.col(c).desc()) if forward else (lambda c: F.col(c).asc())
    back = (lambda c: F.col(c).asc()) if forward else (lambda c: F.col(c).desc())
    # row_number() <= n is pushed below the shuffle by Spark's window group limit
    edge_w = Window.partitionBy(*s.slice).orderBy(*[flip(c) for c in s.order])
    edge = df.withColumn("_e", F.row_number().over(edge_w)).where(F.col("_e") <= n).drop("_e")
    whole = Window.partitionBy(*s.keys).orderBy(back(s.chunk), *[back(c) for c in s.order])
    body = F.struct(*[c for c in df.columns if c != s.chunk])
    addressed = edge.select(
        s.chunk,
        F.lag(s.chunk).over(whole).alias("_prev_chunk"),
        F.collect_list(body).over(whole.rowsBetween(-n, -1)).alias("_rows"),
    ).where(F.col("_prev_chunk") != F.col(s.chunk))
    lifted = addressed.select(s.chunk, F.explode("_rows").alias("_row")).select(s.chunk, "_row.*")
    return lifted.select(*df.columns)


def with_halo(df: DataFrame, s: Series, back: int = 0, ahead: int = 0, carry: list[str] | None = None,
              back_known: tuple[str, int] | None = None) -> DataFrame:
    """Rows plus copies of neighbouring rows, flagged ``_halo``; drop those after the window step.

    ``carry`` names the columns the copies need (all by default; the others are NULL in them), so that the boundary
    branch reads only those. ``back_known=(column, n)`` adds the last n earlier rows in which the column is known.
    """
    slim = df if carry is None else df.select(*s.slice, *s.order, *[c for c in carry if c not in s.order])
    copies = []
    if back:
        copies.append(_boundary(slim, s, back, True))
    if back_known:
        column, n = back_known
        copies.append(_boundary(slim.where(F.col(column).isNotNull()), s, n, True))
    if ahead:
        copies.append(_boundary(slim, s, ahead, False))
    halo = functools.reduce(DataFrame.unionByName, copies)
    if back and back_known:
        halo = halo.dropDuplicates([*s.slice, *s.order])
    return df.withColumn(HALO, F.lit(False)).unionByName(halo.withColumn(HALO, F.lit(True)), allowMissingColumns=True)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col(HALO)).drop(HALO)
