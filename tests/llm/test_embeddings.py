"""Embedding links against brute force."""

import itertools

import numpy as np

from postura.llm import embeddings as E


def brute(rows, threshold=0.98):
    """(id, vector, label) to links and smallest reachable id, by position."""
    def sound(v, label):
        return v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(x for x in v)

    ok = [i for i, (_, v, label) in enumerate(rows) if sound(v, label)]
    units = {i: E.unit(np.array([rows[i][1]]))[0] for i in ok}
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(ok, 2):
        if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and units[i] @ units[j] >= threshold:
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(find(i), []).append(r[0])
    return [(links[i], min(x for x in least[find(i)])) for i in range(len(rows))]


def vectors(rng, n, dim=64):
    out = []
    for _ in range(n):
        base = rng.normal(size=dim)
        out.append(base)
        for _ in range(int(rng.choice([0, 0, 1, 30]))):
            out.append(base * rng.uniform(0.5, 2) + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.14, 0.2]))
    return out


def test_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(12)
    vs = [v.astype(np.float32).astype(float).tolist() for v in vectors(rng, 120)]
    rows = [(i, v, int(rng.integers(3))) for i, v in enumerate(vs)]
    rows += [(len(rows) + i, rows[i][1], rows[i][2]) for i in range(40)]
    for v, label in (([0.0] * 64, 1), (None, 1), (vs[0], None), ([float("nan")] + vs[0][1:], 1), ([None] + vs[1][1:], 1), ([float("inf")] * 64, 1),
                     ([], 1), ([1.0, 2.0, 3.0], 1), ([2.0, 4.0, 6.0], 1), ([1e-30] * 64, 1), ([-1e-30] * 64, 1)):
        rows.append((len(rows), v, label))
    df = spark.createDataFrame([(i, v, k, 7) for i, v, k in rows], "vec_id long, embedding array<float>, label int, n int").repartition(5)
    got = {r.vec_id: r for r in E.link(df).collect()}
    assert len(got) == len(rows)
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows])
    total = sum(w[0] for w in want)
    assert all(got[i].n_links <= w[0] for i, w in enumerate(want))
    assert sum(got[i].n_links for i in got) >= 0.97 * total > 300
    same = sum(got[i].component_id == w[1] for i, w in enumerate(want))
    assert same >= 0.99 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert E.link(df.where("false")).collect() == []
    assert E.link(df.where("vec_id = 3")).collect()[0].n_links == 0


def test_traversal_is_sorted_and_whole():
    rng = np.random.default_rng(13)
    a, b = rng.normal(size=7), np.round(rng.normal(size=7))
    cells = list(E.traverse(a, b))
    sums = [a[i] + b[j] for i, j in cells]
    assert len(set(cells)) == 49 and all(x <= y + 1e-12 for x, y in zip(sums, sums[1:]))


def test_blocks_keep_connections():
    linked = np.zeros((5, 4), dtype=bool)
    for i, j in ((0, 1), (2, 1), (2, 3), (4, 0)):
        linked[i, j] = True
    rows, cols = E._forest(linked)
    assert rows.tolist() == [0, -1, 0, -1, 4] and cols.tolist() == [4, 0, -1, 0]


def test_fine_grid_finds_links_for_both_ends(spark, monkeypatch):
    """A grid of 45 x 45 cells over pairs just above the threshold: recall against brute force, and no link that one end lacks."""
    monkeypatch.setattr(E, "CELL", 2)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(2000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    turn = rng.normal(size=base.shape)
    turn -= (turn * base).sum(1, keepdims=True) * base
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    near = 0.9805 * base + np.sqrt(1 - 0.9805 ** 2) * turn
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, near]))] + [(4000 + i, base[7].tolist(), 1) for i in range(600)]
    x = np.array([v for _, v, _ in rows])
    linked = (x @ x.T >= E.THRESHOLD) & ~np.eye(len(x), dtype=bool)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(6)
    got = {r.vec_id: r for r in E.link(df).collect()}
    want = linked.sum(1)
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= want).all() and found[:4000].sum() >= 0.99 * want[:4000].sum()
    for i in range(2000):  # a pair and nothing else: both ends or none
        if i != 7:
            assert got[i].n_links == got[2000 + i].n_links == (got[2000 + i].component_id == i)
    assert all(got[i].n_links >= 600 and got[i].component_id == 7 for i in range(4000, 4600))
