"""Written results: one JSON document per video, CSV, and partitions that a rerun replaces."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from postura import catalog
from postura.operators import report_tables as R
from postura.operators import rollup as RU
from postura.plans.worker_report import report_series
from postura.sources import sinks

SF = "/root/testdata/sf0.001"


def files(path, video):
    return glob.glob(f"{path}/video_id={video}/part-*")


def test_nested_documents(spark, tmp_path):
    t = catalog.tables(spark, SF)
    path = str(tmp_path / "json")
    timeline = report_series(t.run)["activity_timeline"]
    known = t.videos.where("video_id <> 3")  # its workers are written all the same
    sinks.write_nested_json(t.report, known, timeline, path)
    workers = {(r.video_id, r.worker_id): json.loads(r.document) for r in R.json_documents(t.report, t.videos).collect()}
    bouts = {}
    for r in timeline.orderBy("start_time").collect():
        bouts.setdefault((r.video_id, r.worker_id), []).append((r.activity, r.start_time, r.end_time, r.duration, r.is_rest))
    for v in [r.video_id for r in t.videos.collect()]:
        (name,) = files(path, v)
        doc = json.load(open(name))
        mine = sorted(w for x, w in workers if x == v)
        assert [w["worker_id"] for w in doc["workers"]] == mine and doc["summary"]["total_workers_detected"] == len(mine)
        assert (doc["video_info"]["filename"] is None) == (v == 3)
        for w in doc["workers"]:
            line = [(b["activity"], b["start_time"], b["end_time"], b["duration"], b["is_rest"]) for b in w.pop("activity_timeline")]
            assert line == bouts.get((v, w["worker_id"]), [])
            whole = workers[v, w["worker_id"]]
            assert w == {k: x for k, x in whole.items() if k not in ("report_metadata", "video_info")}
    assert sinks.read_nested_json(spark, path).count() == len(workers) == t.report.count()
    none = str(tmp_path / "none")
    sinks.write_nested_json(t.report.where("false"), known.where("video_id < 2"), timeline, none)
    assert all(json.load(open(files(none, v)[0]))["workers"] == [] for v in (0, 1))


def test_csv_round_trip(spark, tmp_path):
    t = catalog.tables(spark, SF)
    table, path = R.csv_table(t.report, t.videos), str(tmp_path / "csv")
    sinks.write_csv(t.report, t.videos, path)
    assert sorted(map(repr, sinks.read_csv(spark, table, path).collect())) == sorted(map(repr, table.collect()))
    head = open(glob.glob(f"{path}/part-*")[0]).readline()
    assert head.startswith("Video File,Worker ID,Total Tracked Time (s)") and len(table.columns) == 25


def test_rerun_replaces_its_videos_only(spark, tmp_path):
    path = str(tmp_path / "out")
    first = spark.createDataFrame([(v, w, "old") for v in range(4) for w in range(3)], "video_id long, worker_id long, note string")
    sinks.write_partitioned(first, path)
    again = spark.createDataFrame([(2, 7, "new"), (2, 8, "new")], first.schema)
    run = sinks.write_partitioned(again, path)
    got = sorted(tuple(r) for r in sinks.read_partitioned(spark, path).select("video_id", "worker_id", "note").collect())
    assert got == sorted([tuple(r) for r in first.where("video_id <> 2").collect()] + [tuple(r) for r in again.collect()])
    assert {r.video_id: r.rows for r in sinks.manifest(spark, path).collect()} == {0: 3, 1: 3, 2: 2, 3: 3}
    assert sinks.manifest(spark, path).where("video_id = 2").first()[sinks.RUN] == run and sinks.unfinished(spark, path).count() == 0
    # a run that stopped before its manifest: the video shows no rows until it is run again
    (again.withColumn(sinks.RUN, F.lit("lost")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("video_id").parquet(path))
    assert {r.video_id for r in sinks.read_partitioned(spark, path).select("video_id").collect()} == {0, 1, 3}
    assert {r.video_id for r in sinks.unfinished(spark, path).collect()} == {2}
    sinks.write_partitioned(again, path)
    assert sinks.read_partitioned(spark, path).where("video_id = 2").count() == 2 and sinks.unfinished(spark, path).count() == 0


def plain_p90(scores):
    pos = (len(scores) - 1) * 0.9
    low, frac, scores = int(pos), pos - int(pos), sorted(scores)
    a, b = scores[low], scores[min(low + 1, len(scores) - 1)]
    exact = b - (b - a) * (1 - frac) if frac >= 0.5 else a + (b - a) * frac
    return max(1, min(15, int(exact)))


def test_rollup_is_exact_at_every_level(spark):
    rng = random.Random(8)
    rows = [(v, w, rng.choice(["sitting", "bending"]), rng.randint(1, rng.choice([3, 15]))) for v in range(6) for w in range(rng.randint(1, 4))
            for _ in range(rng.choice([1, 2, 40]))]
    rows += [(None, None, "walking", 4), (None, 1, "walking", 5)]
    df = spark.createDataFrame(rows, "video_id long, worker_id long, label string, final_score int").repartition(3)
    sites = spark.createDataFrame([(v, "ab"[v % 2]) for v in range(5)], "video_id long, site string")  # video 5 has none
    counts = RU.score_counts(df)
    halves = counts.unionByName(counts.limit(0)).groupBy("video_id", "worker_id", "label", "final_score").agg(F.sum("n").alias("n"))
    got = {(r.level, r.site, r.video_id, r.worker_id): r for r in RU.rollup(halves, sites).collect()}
    site = lambda v: None if v is None or v == 5 else "ab"[v % 2]
    want = {}
    for v, w, label, s in rows:
        for key in (("worker", site(v), v, w), ("video", site(v), v, None), ("site", site(v), None, None), ("all", None, None, None)):
            want.setdefault(key, []).append((v, w, label, s))
    assert got.keys() == want.keys()
    for key, some in want.items():
        r = got[key]
        assert (r.n_frames, r.max_score, r.p90_score) == (len(some), max(x[3] for x in some), plain_p90([x[3] for x in some])), key
        assert r.n_workers == len({x[:2] for x in some})
        assert r.bending_pct == pytest.approx(100 * sum(x[2] == "bending" for x in some) / len(some), abs=0.051)
    assert RU.rollup(counts.where("false"), sites).count() == 0
