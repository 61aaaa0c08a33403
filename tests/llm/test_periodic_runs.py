"""Runs against plain definitions, agreements against plain comparison, the contract's digests against loops."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postura.llm import periodic_runs as P

SF = "/root/testdata/sf0.01"


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[:len(words) - q])


def plain_runs(words, least=P.LEAST):
    """Every maximal stretch of every period, kept if that is its smallest."""
    words, out = list(words), []
    n = len(words)
    for p in range(1, n // 2 + 1):
        x = 0
        while x + p < n:
            if words[x] != words[x + p]:
                x += 1
                continue
            y = x
            while y + p < n and words[y] == words[y + p]:
                y += 1
            if y + p - x >= max(least, 2 * p) and smallest_period(words[x:y + p]) == p:
                out.append((x, y + p - x, p))
            x = y
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_kept(words, found):
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def repetitive(rng, n):
    out = []
    while len(out) < n:
        block = [rng.randint(1, rng.choice([2, 3, 9])) for _ in range(rng.randint(1, 12))]
        out += (block * rng.randint(1, 6))[:rng.randint(1, 60)]
    return out[:n]


@given(st.one_of(st.lists(st.integers(1, 2), max_size=90), st.lists(st.integers(1, 4), max_size=120),
                 st.tuples(st.integers(0, 10**6), st.integers(0, 200)).map(lambda x: repetitive(random.Random(x[0]), x[1]))),
       st.sampled_from([7, 64, P.PIECE]), st.sampled_from([2, 5, P.LEAST]))
@settings(max_examples=250, deadline=None)
def test_runs(words, piece, least):
    found = P.runs(np.array(words, dtype=np.int64), least, piece)
    assert [tuple(r) for r in found.tolist()] == plain_runs(words, least)
    assert [w for w, k in zip(words, P.kept(len(words), found)) if k] == plain_kept(words, found.tolist())


def fibonacci(n):
    a, b = [1], [1, 2]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("words", [[1] * 500, [1, 2] * 300, [*range(1, 40)] * 9, fibonacci(400), [*range(1, 300)], repetitive(random.Random(1), 700)])
def test_agreement(words):
    rng = np.random.default_rng(3)
    a = P.Agreement(np.array(words, dtype=np.int64))
    i = rng.integers(0, len(words), 900)
    j = np.minimum(i + rng.integers(1, len(words), 900), len(words))
    some = i < j
    i, j = i[some], j[some]
    want = [next((d for d in range(len(words)) if y + d >= len(words) or words[x + d] != words[y + d]), 0) for x, y in zip(i, j)]
    assert a.reach(i, j).tolist() == want
    assert [tuple(r) for r in P.runs(np.array(words, dtype=np.int64)).tolist()] == plain_runs(words)


def test_cover():
    assert {(a - b) % P.MODULUS for a in P.COVER for b in P.COVER} == set(range(P.MODULUS)) and P.MEETING.max() < P.MODULUS


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_digest(doc, text):
    words = split(text)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    head = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc, len(found), *head, sha("".join(f"{s},{length},{p}\n" for s, length, p in found)), sha(" ".join(plain_kept(words, found))))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_odd_rows(spark):
    rng = random.Random(9)
    texts = [None, "", " \n\t ", "one", "a " * 13, "a\x0ba\x0c" * 9, "é😀\x1c  x " * 20, "Da da " * 30, "word\x00 " * 12]
    texts += [" ".join(map(str, repetitive(rng, rng.randint(1, 300)))) for _ in range(120)]
    rows = [(i, t, "r", 5) for i, t in enumerate(texts)] + [(7, texts[7], "r", 5), (None, "b b " * 9, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").repartition(5)
    got = P.digest(P.find(P.with_planted(df))).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain_digest(r[0], r[1]) for r in rows), key=repr)
    out = P.collapse(df)
    assert out.schema.names == df.columns
    want = [(i, t if not (found := plain_runs(split(t))) else " ".join(plain_kept(split(t), found)), *rest) for i, t, *rest in rows]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert P.find(df.where("false")).collect() == [] and P.collapse(df.where("false")).collect() == []


def test_very_long_text(spark):
    """A period of 999 words in a text of 400,000, behind words that never come again."""
    text = " ".join([f"w{i}" for i in range(1000)] + [f"r{i % 999}" for i in range(398_999)] + ["end"])
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = P.find(df).first()
    assert [tuple(r) for r in row.runs] == [(1000, 398_999, 999)] and row.n_words == 400_000 and len(row.collapsed.split()) == 2000


def test_whole_table(spark):
    from postura.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SF).select(*COLUMNS).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == rows.keys() and any(r[1] for r in got.values())
    for doc, text in rows.items():
        if len(text or "") < 8000:
            assert got[doc] == plain_digest(doc, text)


def test_plan_has_no_shuffle(spark):
    plan = P.digest(P.find(P.with_planted(spark.read.parquet(f"{SF}/documents.parquet"))))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and plan.split("== Physical Plan ==")[1].count("ArrowEvalPython") == 1
