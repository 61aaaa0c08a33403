"""A table played as a file stream: rows are delivered slice by slice and a query runs over the files until it has taken all."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from postura.operators.ordered import staging_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event time of the row that ends a replay: the year 2200, which pandas can still hold.
END = 7_258_118_400


@contextmanager
def settings(spark: SparkSession, **values: object):
    """Settings (dots as double underscores) for the time of a block."""
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def deliver(rows: DataFrame, at: Column, path: str, slices: int = 12, files: int = 4) -> None:
    """Write a table in slices of the delivery time, one after the other, so that a file stream takes them in this order.

    ``rows`` is read twice (its extent, its slices): pass a source or a staged table.
    """
    low, high = rows.agg(F.min(at), F.max(at)).first()
    if low is None:
        rows.limit(0).write.parquet(path)
        return
    width = (high - low) / slices or 1.0
    number = F.least(F.floor((at - F.lit(low)) / F.lit(width)), F.lit(slices - 1)).cast("int")
    # a folder for each slice first, so that no slice is looked for among all rows
    parted, spark = staging_path(rows.sparkSession), rows.sparkSession
    rows.withColumn("_slice", number).write.partitionBy("_slice").parquet(parted)
    dealt = spark.read.schema(StructType([*rows.schema, StructField("_slice", IntegerType())])).parquet(parted)
    for k in range(slices):
        dealt.where(F.col("_slice") == k).drop("_slice").coalesce(files).write.mode("append").parquet(path)


def slice_width(rows: DataFrame, at: Column, slices: int = 12) -> float:
    low, high = rows.agg(F.min(at), F.max(at)).first()
    return 0.0 if low is None else float(high - low) / slices


def play(spark: SparkSession, source: str, schema: StructType, work: str, query: Callable[[DataFrame], DataFrame], ts: str,
         files: int | None = None) -> tuple[DataFrame, int]:
    """Run a streaming query over the files of a folder and read back what it wrote; also the number of batches with rows.

    When all files are taken, a last row with nothing but the time of the year 2200 in ``ts`` (timestamp, or seconds) is
    delivered, which lets the watermark pass everything that is still held.
    """
    batches = 0

    def run() -> None:
        nonlocal batches
        reader = spark.readStream.schema(schema)
        frames = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)
        started = (query(frames).writeStream.outputMode("append").format("parquet").option("path", f"{work}/out")
                   .option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start())
        started.awaitTermination()
        batches += len({p["batchId"] for p in started.recentProgress if p["numInputRows"]})

    limit = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB, spark__sql__shuffle__partitions=limit,
                  spark__sql__streaming__numRecentProgressUpdates=100_000):
        run()
        taken = batches
        last = F.lit(END).cast("timestamp") if schema[ts].dataType.simpleString() == "timestamp" else F.lit(float(END))
        tick = spark.range(1).select(*[(last if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        tick.write.mode("append").parquet(source)
        run()
        kind = query(spark.readStream.schema(schema).parquet(source)).schema
    return spark.read.schema(kind).parquet(f"{work}/out"), taken
