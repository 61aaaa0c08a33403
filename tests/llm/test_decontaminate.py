"""Decontamination against a plain edit-distance table."""

import random

from postura.llm import decontaminate as D


def table(item, text):
    """Least edit distance of an item to any part of a text, cell by cell."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        last, row[0] = row[0], 0
        for i, x in enumerate(item, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (x != c))
        best = min(best, row[-1])
    return best


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text) or 1)
        text = rng.choice([text[:i] + text[i + 1:], text[:i] + rng.choice("xyz") + text[i:], text[:i] + rng.choice("xyz") + text[i + 1:]])
    return text


def test_myers_distance():
    rng = random.Random(9)
    for _ in range(300):
        item = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 90)))
        text = rng.choice([edited(rng, item, rng.randint(0, 6)), ""]) + "".join(rng.choice("abc ") for _ in range(rng.randint(0, 50)))
        assert D.distance(item, text) == table(item, text)


def test_documents(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9)))
    items = [" ".join(word() for _ in range(rng.randint(4, 40))) for _ in range(30)]
    items += ["tiny", items[0], items[1].upper()]
    benchmark = [(i, t) for i, t in enumerate(items)] + [(None, items[2]), (99, None), (98, "  "), (97, "")]
    docs = [None, "", "tiny", "a Tiny\nthing"]
    for _ in range(150):
        body = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            item = rng.choice(items)
            body.insert(rng.randint(0, len(body)), edited(rng, item, rng.randint(0, int(0.09 * len(item)))).replace(" ", rng.choice([" ", "\n ", "  "])))
        docs.append(" ".join(body))
    docs += docs[4:10]
    df = spark.createDataFrame([(i if i % 40 else None, t, 1, 2) for i, t in enumerate(docs)], "doc_id long, text string, id int, found int").repartition(3)
    bench = spark.createDataFrame(benchmark, "item_id long, text string")
    want = []
    for i, t in enumerate(docs):
        hits = {}
        for k, item in benchmark:
            if k is not None and D.plain(item):
                d = table(D.plain(item), D.plain(t))
                if d <= int(D.RATE * len(D.plain(item))):
                    hits[k] = d
        want.append((i if i % 40 else None, bool(hits), len(hits), ",".join(map(str, sorted(hits))), min(hits.values(), default=None)))
    order = lambda r: tuple(map(str, r))
    for options in ({}, {"pass_chars": 1000}):
        got = [tuple(r) for r in D.report(df, bench, **options).collect()]
        assert sorted(got, key=order) == sorted(want, key=order)
    assert 20 < sum(w[1] for w in want) < 120
    kept = D.drop_leaks(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not w[1] for w in want)
    assert D.report(df.where("false"), bench).collect() == [] and D.drop_leaks(df, bench.where("false")).count() == len(docs)


def test_a_worker_holds_one_matcher():
    from postura.llm.tokens import worker_slot, worker_state

    made = []
    for k in [1, 1, 2, 2, 1, 3]:
        worker_slot("test_slot", k, lambda k=k: made.append(k) or [k])
        assert list(worker_state("test_slot", dict).values()) == [[k]]
    assert made == [1, 2, 1, 3]
