"""Boilerplate lines against SQL and a plain count."""

import random

import duckdb
import pytest

from postura.llm import line_dedup as L


def plain(docs, ratio, least):
    """docs: (host, text); returns texts."""
    pages = {}
    for host, text in docs:
        pages.setdefault(host, set()).add(text or "")
    held = {}
    for host, bodies in pages.items():
        seen = {}
        for body in bodies:
            for line in {x.strip(" \t\r") for x in body.split("\n")} - {""}:
                seen[line] = seen.get(line, 0) + 1
        held[host] = {x for x, n in seen.items() if n >= least and n > ratio * len(bodies)}
    return [None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\r") not in held[h]) for h, t in docs]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(7)
    rows = []
    for host, n in (("a", 200), ("b", 9), ("", 30), (None, 40), ("single", 1)):
        for i in range(n):
            lines = [f"{host} own line {rng.random()}" for _ in range(rng.randint(0, 4))]
            if rng.random() < 0.4:
                lines.insert(rng.randint(0, len(lines)), rng.choice(["menu ", "\tmenu\r", f"footer {host}"]))
            rows.append((host, rng.choice(["\n", "\n\n"]).join(lines)))
    copied = ("a", "an article\nthat is copied\nmany times")
    return rows + [copied] * 90 + [("a", None), (None, None), ("b", ""), ("zero", None)] + [("é", " \n\nx\ny\r\n")] * 3


@pytest.mark.parametrize(("ratio", "least"), [(0.1, 5), (0.15, 2)])
def test_plain_count(spark, docs, ratio, least):
    df = spark.createDataFrame([(i, h, t, "k") for i, (h, t) in enumerate(docs)], "doc_id long, source string, text string, _host string")
    out = L.drop_boilerplate(df, ratio=ratio, min_pages=least)
    assert out.columns == df.columns
    got = [r.text for r in out.orderBy("doc_id").collect()]
    want = plain(docs, ratio, least)
    assert got == want
    assert any(g != d[1] for g, d in zip(got, docs)) and got[-8:-4] == [d[1] for d in docs[-8:-4]]
    assert got[docs.index(("a", "an article\nthat is copied\nmany times"))] == "an article\nthat is copied\nmany times"
    assert L.drop_boilerplate(df.where("false")).collect() == []


def test_sql(spark, docs, tmp_path):
    df = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(docs)], "doc_id long, source string, text string")
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = L.drop_boilerplate(df, counted=True).select("doc_id", "text", "n_lines", "n_dropped").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == con.sql(L.SQL + " ORDER BY doc_id").fetchall()
