"""Quality: held-out accuracy, the posterior against a plain computation, and odd input."""

import math
from collections import defaultdict

import numpy as np
import pytest

from postura.llm import quality as Q

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fitted = Q.fit_corpus(docs, labels.where("doc_id % 3 = 0"))
    got = Q.score(fitted).join(labels.where("doc_id % 3 <> 0"), "doc_id").select("doc_id", "keep", "quality").collect()
    wrong = [r for r in got if r.keep != (r.quality == 1)]
    clean = [r for r in got if r.quality == 1]
    assert len(got) > 2000 and len(wrong) / len(got) < 0.01
    assert sum(not r.keep for r in clean) / len(clean) < 0.003
    kept = Q.keep_good(docs, fitted)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in Q.score(fitted).where("keep").collect()}


def test_posterior_shrinks_sparse_sites(spark):
    rows = [(i, "word " * 3 if host == "bad" and i % 10 else "some other longer text here", host, path)
            for host, n in (("good", 300), ("bad", 300), ("tiny", 1)) for i in range(n) for path in ("p", None)]
    df = spark.createDataFrame([(k, t, h, p) for k, (_, t, h, p) in enumerate(rows)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(k, int("longer" in r[1])) for k, r in enumerate(rows)] + [(None, 1), (3, None), (10 ** 9, 1)],
                                   "doc_id long, quality int")
    fitted = Q.fit_corpus(df, labels)
    got = {r.doc_id: r for r in Q.score(fitted).collect()}
    p = {k: r.evidence for k, r in got.items()}
    mean = sum(p.values()) / len(p)
    groups, hosts = defaultdict(list), defaultdict(list)
    for k, (_, _, h, path) in enumerate(rows):
        groups[h, path].append(p[k])
        hosts[h].append(p[k])
    a, b = fitted.strength
    for k, (_, _, h, path) in enumerate(rows):
        host = (sum(hosts[h]) - p[k] + a * mean) / (len(hosts[h]) - 1 + a)
        site = (sum(groups[h, path]) - p[k] + b * host) / (len(groups[h, path]) - 1 + b)
        z = math.log(p[k] / (1 - p[k])) + math.log(site / (1 - site)) - math.log(mean / (1 - mean))
        assert got[k].host_mean == pytest.approx(host, abs=1e-9) and got[k].path_mean == pytest.approx(site, abs=1e-9)
        assert got[k].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)
    tiny, good, bad = (got[next(k for k, r in enumerate(rows) if r[2] == h)].path_mean for h in ("tiny", "good", "bad"))
    assert bad < tiny < good and abs(tiny - mean) < min(abs(good - mean), abs(bad - mean))


def test_odd_input(spark):
    schema = "doc_id long, text string, source string, lang string, _z double"
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    empty = spark.createDataFrame([], schema)
    assert Q.score(Q.fit_corpus(empty, labels.where("false"))).collect() == []
    df = spark.createDataFrame([(1, None, None, None, 1.0), (None, "", "a", "b", 2.0), (1, "x" * 300_000, "a", None, None)] * 2, schema)
    fitted = Q.fit_corpus(df, labels)
    assert [r.keep for r in Q.score(fitted).collect()] == [True] * 6
    assert sorted(map(str, Q.keep_good(df, fitted).collect())) == sorted(map(str, df.collect()))


def test_fit_separates():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, len(Q.FEATURES)))
    y = (x[:, 1] - x[:, 4] + 0.3 > 0).astype(float)
    w = np.array(Q.fit(x, y).weights)
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.98
