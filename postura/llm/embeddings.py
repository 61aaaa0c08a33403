"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are cut into halves with a codebook each; the pair of nearest codewords is a vector's cell, so ``k`` codewords per
half make a grid of ``k * k`` cells. A vector visits cells in the order of their distance, by the multi-sequence traversal of the two
sorted codeword lists, and is compared exactly with the members of every visited cell that have its label. How many cells
are visited is calibrated: vectors turned from sampled ones by exactly the threshold must lie in a visited cell in
``recall`` of all cases. Nearer pairs are found more often than those.

The codebooks and the calibration come from a sample of at most ``SAMPLE`` vectors; every vector is indexed, and every
vector queries. Equal vectors of a label are one class. Cells are dealt out in blocks of about ``BLOCK`` members, so a hot cell is
many tasks; a pair of blocks is compared by one matrix product and returns link counts and a spanning forest
of its links, never the pairs.

Defined cases: a vector that is null, zero, or holds a null or non-finite component, and a vector without a label, links
with nothing; vectors of different length never link; repeated rows are other vectors with the same content; ties go to
the smaller id; a null id has a null component unless others are linked; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postura.llm.common import by_value, column, drawn, small_batches
from postura.llm.components import components
from postura.operators.ordered import stage

SAMPLE, BLOCK = 4096, 256
THRESHOLD, RECALL = 0.98, 0.995
#: Members that a cell of one label should have.
CELL = 64


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    x = np.asarray(x, dtype=np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly drawn rows."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = ((centres ** 2).sum(1) - 2 * x @ centres.T).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=k)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def traverse(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cells in ascending order of first[i] + second[j] (multi-sequence algorithm)."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    heap, pushed = [(x[0] + y[0], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        for u, v in ((i + 1, j), (i, j + 1)):
            if u < len(x) and v < len(y) and (u, v) not in pushed:
                pushed.add((u, v))
                heapq.heappush(heap, (x[u] + y[v], u, v))


class Grid:
    """Two codebooks and the number of cells that a query visits."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float, recall: float):
        self.dim = sample.shape[1]
        half = (self.dim + 1) // 2
        rng = np.random.default_rng(1)
        sample = sample[rng.permutation(len(sample))]
        # a quarter, at most 512, tells how many cells to visit; it takes no part in the codebooks unless there are few
        held = min(512, len(sample) // 4)
        some, rest = (sample[:held], sample[held:]) if len(sample) - held >= 2 * k else (sample[:512], sample)
        self.books = [fit_codebook(rest[:, :half], k), fit_codebook(rest[:, half:], k)]
        turn = rng.normal(size=some.shape)
        turn -= (turn * some).sum(1, keepdims=True) * some
        turn /= np.sqrt((turn * turn).sum(1, keepdims=True)) + 1e-300
        turned = threshold * some + math.sqrt(max(0.0, 1 - threshold ** 2)) * turn
        ranks = [next(rank for rank, cell in enumerate(walk, 1) if cell == home[0])
                 for walk, home in zip(self.walks(some), self.cells(turned, 1))]
        self.visits = int(np.sort(ranks)[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)])

    def fitted(self, x: np.ndarray) -> np.ndarray:
        """Vectors of another length are cut or filled with zeros, for their place in the grid only."""
        if x.shape[1] >= self.dim:
            return x[:, :self.dim]
        return np.pad(x, ((0, 0), (0, self.dim - x.shape[1])))

    def walks(self, x: np.ndarray) -> Iterator[Iterator[int]]:
        """For every row all cells, nearest first; what is not asked for is not made."""
        x = self.fitted(x)
        half = self.books[0].shape[1]
        far = [(b ** 2).sum(1) - 2 * part @ b.T for b, part in zip(self.books, (x[:, :half], x[:, half:]))]
        k = len(self.books[0])
        for d1, d2 in zip(*far):
            yield (i * k + j for i, j in traverse(d1, d2))

    def cells(self, x: np.ndarray, n: int) -> list[list[int]]:
        """The n nearest cells of every row."""
        return [[*itertools.islice(walk, n)] for walk in self.walks(x)]


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least row of each connected part of a two-sided link table, for its rows and its columns (no link: -1)."""
    n = len(linked)
    rows = np.where(linked.any(1), np.arange(n), n)
    while True:
        cols = np.where(linked, rows[:, None], n).min(0)
        new = np.minimum(rows, np.where(linked, cols[None, :], n).min(1))
        if (new == rows).all():
            return np.where(rows < n, rows, -1), np.where(cols < n, cols, -1)
        rows = new


def compare(queries: list[dict], members: list[dict], threshold: float) -> tuple[list[int], list[int], list[int]]:
    """Classes that take part in a link: class, links, root class among these queries.

    A link counts for the query, and for the member too if that does not visit the query's home cell and so never asks itself.
    """
    q, m = [np.array([r["cls"] for r in side], dtype=np.int64) for side in (queries, members)]
    x, y = [unit(np.array([r["v"] for r in side], dtype=np.float64)) for side in (queries, members)]
    asking, weight = [np.array([r["n"] for r in side], dtype=np.int64) for side in (queries, members)]
    linked = (x @ y.T >= threshold) & (q[:, None] != m[None, :])
    if not linked.any():
        return [], [], []
    rows, cols = _forest(linked)
    counts = linked @ weight
    homes, at = np.unique([r["cells"][0] for r in queries], return_inverse=True)
    asks = np.array([np.isin(homes, r["cells"]) for r in members]).T[at]
    back = (linked & ~asks).T @ asking
    keep, also = rows >= 0, cols >= 0
    return ([*q[keep], *m[also]], [*counts[keep], *back[also]], [*q[rows[keep]], *q[cols[also]]])


def link(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    small_batches(df.sparkSession)
    v = column(vector_col)
    peak = F.array_max(F.transform(v, lambda x: F.abs(x)))
    sound = v.isNotNull() & column(label_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & (peak > 0)
    rows = df.select(column(id_col).cast("long").alias("vec_id"), column(label_col).alias("label"), v.alias("v"),
                     F.coalesce(sound, F.lit(False)).alias("sound"))
    known = rows.where("sound")
    classes = stage(known.groupBy("label", "v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
                    .withColumn("cls", F.monotonically_increasing_id()))
    n, labels = classes.agg(F.count(F.lit(1)), F.approx_count_distinct("label")).first()
    sample = sorted(r.v for r in drawn(classes.select("v"), F.col("v"), SAMPLE, n).collect())
    counted = _links(classes, sample, max(2, min(256, round(math.sqrt(n / max(1, labels) / CELL)))), threshold, recall) if n > 1 else None

    if counted is None:
        found = classes.select("cls", "n", "label", "v", F.lit(0).cast("long").alias("links"), F.col("least").alias("component"))
    else:
        roots = components(counted.select(F.col("cls").alias("a"), F.col("root").alias("b")))
        links = counted.groupBy("cls").agg(F.sum("links").alias("links"))
        part = classes.join(links, "cls", "left").join(roots, F.col("cls") == F.col("node"), "left")
        part = stage(part.select("cls", "label", "v", "n", "least", F.coalesce("links", F.lit(0)).alias("links"),
                                 F.coalesce("root", "cls").alias("root")))
        least = part.groupBy("root").agg(F.min("least").alias("component"))
        found = part.join(least, "root").select("cls", "n", "label", "v", "links", "component")
    found = found.select("label", "v", (F.col("n") - 1 + F.col("links")).alias("links"), "component")
    linked = known.select("vec_id", "label", "v").join(found, ["label", "v"]).select("vec_id", "links", "component")
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    return linked.unionByName(alone).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"),
                                            F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


def _links(classes: DataFrame, some: list[list[float]], k: int, threshold: float, recall: float) -> DataFrame:
    """Staged: cls, links, root; several rows per class."""
    sizes = [len(v) for v in some]
    dim = max(set(sizes), key=sizes.count)
    sample = unit(np.array([v for v in some if len(v) == dim], dtype=np.float64))
    grid = Grid(sample, min(k, len(sample)), threshold, recall)

    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            out: list = [None] * len(vectors)
            lengths = np.array([len(x) for x in vectors])
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                some = unit(np.array([vectors.iloc[i] for i in at], dtype=np.float64))
                for i, cells in zip(at, grid.cells(some, grid.visits)):
                    out[i] = cells
            yield pd.Series(out)

    placed = stage(classes.select("cls", "n", "v", F.struct("label", F.size("v").alias("dim")).alias("site"),
                                  F.pandas_udf(place, "array<int>")("v").alias("cells")))
    row = F.struct("cls", "n", "v", "cells").alias("r")
    key = ["site", "cell"]

    def parts(cells: DataFrame, name: str) -> DataFrame:
        return cells.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(name))

    # rows of a cell in blocks of about BLOCK, dealt by a hash; every block of members has a key of its own, to which all blocks of
    # queries are sent, so the pairs of blocks of a hot cell come out of many tasks
    homes, visits = placed.withColumn("cell", F.col("cells")[0]), placed.withColumn("cell", F.explode("cells"))
    sizes = parts(homes, "mine").join(parts(visits, "theirs"), key)
    dealt = lambda cells, n: cells.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("cls"), F.col(n)))
    members = dealt(homes, "mine").groupBy(*key, "part").agg(F.collect_list(row).alias("members"))
    queries = dealt(visits, "theirs").groupBy(*key, "mine", "part").agg(F.collect_list(row).alias("queries")).drop("part")
    queries = queries.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mine") - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in range(batch.num_rows):  # a row is two whole blocks
                q, m = (batch.column(i)[one].as_py() for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in compare(q, m, threshold)], ["cls", "links", "root"])

    pairs = queries.join(members, [*key, "part"]).select("queries", "members")
    return stage(pairs.mapInArrow(run, "cls long, links long, root long"))


by_value(__name__)
