"""Phrases against plain counting; the index against plain scans; shards that cut texts anywhere."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postura.llm import collocations as C

SF = "/root/testdata/sf0.01"


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def plain(rows, least=C.LEAST, share=C.SHARE):
    """(text, lang) rows to {lang: [(phrase, a, l, r, n, score)]} in order, by loops."""
    f, n, out = defaultdict(Counter), Counter(), {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    for lang, c in f.items():
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {q for p, a in some.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= share * c[q]}
        found = []
        for p, a in some.items():
            if p not in inside:
                cuts = [(int(Fraction(10**6 * a * a, c[p[:k]] * c[p[k:]])), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                found.append((" ".join(p), a, left, right, n[lang], score))
        out[lang] = sorted(found, key=lambda r: (-r[5], -r[1], r[0].encode()))
    return out


def ranked(rows, top):
    return [(lang, i + 1, *r) for lang, found in rows.items() for i, r in enumerate(found[:top])]


def rows_of(df):
    return [tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]


def prose(rng, n):
    words = ["The", "of", "a", "New", "York", "City", "é", "😀x", "AB", "x\x00", "\x1cy", " "]
    marks = [" ", "  ", "\t", ", ", ".", "\n", "\x0b", " ! ", "\r\n"]
    out = []
    for _ in range(n):
        out += rng.choice([["new", " ", "york", " ", "city"], [rng.choice(words)], [f"w{rng.randint(0, 40)}"]])
        out.append(rng.choice(marks) if rng.random() < 0.3 else " ")
    return "".join(out)


@pytest.mark.parametrize("size", [C.SHARD, 900, 41])
def test_phrases(spark, size):
    rng = random.Random(size)
    rows = [(prose(rng, rng.choice([0, 1, 5, 80, 300])), rng.choice(["en", "en", "de", None, "und"])) for _ in range(150)]
    rows += [(None, "en"), ("", None), (" \t\n.", "fr"), ("long words here " * 2000, "xx"), ("Same again. " * 9, "de"), ("Same again. " * 9, "de")]
    df = spark.createDataFrame([(i, t, lang, 1, 2, 3) for i, (t, lang) in enumerate(rows)],
                               "doc_id long, text string, lang string, n int, a int, shard int").repartition(6)
    want = plain(rows)
    found = C.collocations(df, size=size)
    assert sorted(rows_of(C.top(found))) == sorted(ranked(want, C.TOP))
    assert sorted(rows_of(C.top(found, 5))) == sorted(ranked(want, 5))
    assert {r.lang for r in found.collect()} >= {"en", "de", "und"}
    if size == 900:
        cut = C.shards(df, size=size).collect()
        assert max(len(np.frombuffer(__import__("zstandard").decompress(r.ids), "<i4")) for r in cut) <= size and any(r.twice for r in cut)


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert C.top(C.collocations(df)).collect() == []


def test_extensions(spark):
    """The most frequent word on either side of a pair."""
    rows = [("p q r", "en")] * 12 + [("p q s", "en")] * 14 + [("t p q", "en")] * 11 + [("p q", "en")] * 40
    df = spark.createDataFrame(rows, "text string, lang string")
    r = C.collocations(df).where("phrase = 'p q'").first()
    assert (r.a, r.left, r.right) == (77, 11, 14)


def test_wide_products(spark):
    """Counts whose products pass 64 bits."""
    big = 10**14 - 7
    df = spark.createDataFrame([(big, big + 3, big + 11), (7, 10**14, 9)], "a long, l long, r long")
    got = [r.s for r in df.select(C._score(df.a, df.l, df.r).alias("s")).collect()]
    assert got == [10**6 * big * big // ((big + 3) * (big + 11)), 0]


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
@settings(max_examples=200, deadline=None)
def test_index(seq):
    rows, n = C.counted(np.array([*seq, 0], dtype=np.int64))
    want = Counter()
    for k in (2, 3):
        want.update(tuple(seq[i:i + k]) + (0,) * (3 - k) for i in range(len(seq) - k + 1) if 0 not in seq[i:i + k])
    assert {tuple(r): c for r, c in zip(rows.tolist(), n.tolist())} == want


@given(st.lists(st.integers(1, 2), min_size=4, max_size=50))
@settings(max_examples=100, deadline=None)
def test_intervals_in_step(seq):
    """Extension to the left and to the right leads to the same intervals of both sides."""
    index = C.Index(np.array([*seq, 0], dtype=np.int64))
    base = (index.first, index.first, index.count)
    right, left = index.right(*base), index.left(*base)
    by_right = {(int(index.words[o]), int(w)): rest for o, w, *rest in zip(*right)}
    by_left = {(int(w), int(index.words[o])): rest for o, w, *rest in zip(*left)}
    assert by_right == by_left


def test_whole_table(spark):
    from postura.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").collect()
    assert sorted(rows_of(QUERIES["op13_collocations"](spark, SF))) == sorted(ranked(plain([tuple(r) for r in docs]), C.TOP))
