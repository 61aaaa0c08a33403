"""Headline queries on the benchmark tables; prints one JSON line.

Every query starts from the raw parquet tables: tables shared between queries are dropped before each one.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postura import catalog  # noqa: E402
from postura.operators import bouts as B  # noqa: E402
from postura.operators import frames as Fr  # noqa: E402
from postura.operators import scoring as SC  # noqa: E402
from postura.operators import trips as TR  # noqa: E402
from postura.operators.ordered import stage  # noqa: E402
from postura.sources import adapters  # noqa: E402

HEADLINE = ["joint_angles", "win_smooth_vote", "segment", "agg_posture_time", "join_object_person", "reba_worker",
            "count_trips", "fold_stitch", "agg_peak_concurrency", "sig_repetition", "worker_report"]


def bulk_labels(spark: SparkSession, sf: str) -> DataFrame:
    return Fr.classify(stage(adapters.bulk_frames(spark, sf)), "worker_id").select("worker_id", "frame_idx", "label")


def bulk_segment(spark: SparkSession, sf: str) -> DataFrame:
    return B.segment(stage(Fr.classify(stage(adapters.bulk_frames(spark, sf)), "worker_id")))


def bulk_trips(spark: SparkSession, sf: str) -> DataFrame:
    return TR.count_trips(stage(adapters.bulk_frames(spark, sf)))


def bulk_reba(spark: SparkSession, sf: str) -> DataFrame:
    return SC.reba_worker(adapters.bulk_frames(spark, sf))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="postura-bench-"))  # one machine
    registered = catalog.queries()
    plan = {n: registered[n] for n in HEADLINE}
    plan.update(bulk_labels=bulk_labels, bulk_segment=bulk_segment, bulk_trips=bulk_trips, bulk_reba=bulk_reba)
    only = sys.argv[1:]
    registered["joint_angles"](spark, sf).write.format("noop").mode("overwrite").save()  # warm-up, not timed
    times: dict[str, float] = {}
    for name, fn in plan.items():
        if only and name not in only:
            continue
        catalog.forget()
        start = time.perf_counter()
        fn(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    frames = spark.read.parquet(f"{sf}/events.parquet").count()
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")),
                      "rows": {"events": frames, "lineitem": lines}}))
    spark.stop()


if __name__ == "__main__":
    main()
