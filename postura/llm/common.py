"""Helpers that several operators share."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "_row"
#: Rows of one Arrow batch: a Python worker holds a batch of whole texts at a time.
BATCH_ROWS = 512


def by_value(module: str) -> None:
    """Functions of a module travel to the executors by value, so these need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def small_batches(spark: SparkSession) -> None:
    """Texts may be long: keep Arrow batches small for this session, unless it already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def as_row(df: DataFrame) -> Column:
    """The whole input row as one column, so that working columns can never clash with the input's names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW)


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def text_of(name: str) -> Column:
    """A text column, null as empty."""
    return F.coalesce(column(name).cast("string"), F.lit(""))


def salted_join(rows: DataFrame, table: DataFrame, key: str, spread: Column, salts: int = 16) -> DataFrame:
    """Left join of rows to a table with one row per key, where one key may hold a large part of the rows: those of a key are
    dealt to ``salts`` tasks by a hash of ``spread``, and the table's row goes to each of them. The key stays once."""
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", salt).join(copies, [key, "_salt"], "left").drop("_salt")


def drawn(df: DataFrame, key: Column, rows: int, total: int) -> DataFrame:
    """All of a table of at most ``rows`` rows; else a share drawn by a hash of the key, nine tenths of ``rows``, never more
    than ``rows``. Nothing is ordered and no task or driver sees more than the result."""
    if total <= rows:
        return df
    share = int(0.9 * rows / total * (1 << 40))
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < share).limit(rows)


by_value(__name__)
