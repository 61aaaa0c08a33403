"""Every registered query against its SQL on the smallest test tables."""

import os

import duckdb
import pytest

from postura import catalog
from tools.check import TABLES, rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    want = db.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_sinks_write_all_workers(spark, tmp_path):
    from postura.plans.worker_report import report_series
    from postura.sources import sinks

    t = catalog.tables(spark, SF)
    series = report_series(t.run)
    sinks.write_json(t.report, t.videos, str(tmp_path / "json"), series)
    sinks.write_csv(t.report, t.videos, str(tmp_path / "csv"))
    n = t.report.count()
    assert spark.read.text(str(tmp_path / "json/workers")).count() == n
    assert spark.read.text(str(tmp_path / "json/videos")).count() == 25
    for kind, rows in series.items():
        assert spark.read.json(str(tmp_path / "json" / kind)).count() == rows.count()
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == n
