"""SimHash links and components against a plain pairwise computation."""

import random
import re

import numpy as np
import pytest
import xxhash

from postura.llm import simhash
from postura.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius=4):
    """(id, fingerprint) to the smallest id reachable, by row."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i][1] ^ values[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i, (key, _) in enumerate(values):
        groups.setdefault(find(i), []).append(key)
    return [min((k for k in groups[find(i)] if k is not None), default=None) for i in range(len(values))]


def texts(rng, n):
    vocabulary = ["".join(rng.choice("abcdÉé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    out = [None, "", " \n\t", "one", "One", "a b c", "A B C", "x\x0by z w v", "ſ K"]
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 80))]
        out.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 12])):
            some = [*words]
            some[rng.randrange(len(some))] = rng.choice(vocabulary)
            out.append(" ".join(some))
    return out


def test_components_and_fingerprints(spark):
    rng = random.Random(3)
    data = [(1000 - i if i % 50 else None, t, "x") for i, t in enumerate(texts(rng, 60))]
    data += data[20:30]
    got = simhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string, fp string").repartition(5)).collect()
    prints = [plain_fingerprint(t) for _, t, _ in data]
    roots = plain_components([(d[0], f) for d, f in zip(data, prints)])
    want = [(d[0], f"{f:016x}", r) for d, f, r in zip(data, prints, roots)]
    order = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)
    assert len({r for r in roots}) < len(data) - 30


@pytest.mark.parametrize("radius", [1, 3, 4, 6])
def test_links_are_complete(spark, radius):
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(25)]
    values = {c for c in centres}
    for c in centres:
        for _ in range(rng.choice([0, 2, 40])):
            v = c
            for b in rng.sample(range(64), rng.randint(1, 7)):
                v ^= 1 << b
            values.add(v)
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), radius)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= radius for r in edges.collect())
    got = {r.node: r.root for r in components(edges).collect()}
    want = plain_components([(v, v & (1 << 64) - 1) for v in values], radius)
    assert [got.get(v, v) for v in values] == want


def test_partitions_cover_all_bits():
    rng = np.random.default_rng(4)
    for rows, sample in ((10, np.zeros(0, np.int64)), (10 ** 6, rng.integers(-2 ** 63, 2 ** 63, 500)), (10 ** 9, np.zeros(300, np.int64))):
        chosen = simhash.allocate(sample.astype(np.int64), rows, 4)
        bits = [b for part, _ in chosen for b in part]
        assert len(set(bits)) == len(bits)
        for groups in range(2, 6):
            parts = simhash.bit_groups(sample if len(sample) > 1 else np.zeros(2, np.int64), groups)
            assert sorted(b for p in parts for b in p) == list(range(64)) and len(parts) == groups
    assert len(simhash.flips([0, 5, 63], 2)) == 7 == len(set(simhash.flips([0, 5, 63], 2)))


def test_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(400))
    data = [(3, "a b c d e", 1), (2, "a b c d e", 2), (2, "A b c d e", 3), (7, None, 4), (8, "", 5), (9, long, 6),
            (10, long + " end", 7), (None, "other text here now", 8), (2, "q r s t u v", 9)]
    df = spark.createDataFrame(data, "doc_id long, text string, _id int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id or -1, (r.text or "")[:3].lower()) for r in kept.collect())
    assert ids == [(-1, "oth"), (2, "a b"), (2, "q r"), (7, ""), (9, "w0 ")]
    assert simhash.keep_one(df.where("false")).collect() == []
    assert simhash.near_duplicates(df.where("false")).collect() == []


def test_chain_and_star_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1500)] + [(5, 5), (7, 8), (7, 8)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {i: 1000 for i in range(1001, 1500)}
