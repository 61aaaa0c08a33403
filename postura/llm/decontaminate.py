"""Benchmark decontamination by pigeonhole edit matching.

A test item may differ from a passage by ``rate`` edits per character, rounded down. Cut into one piece more than that
budget, at least one piece must stand in the passage unchanged. An Aho-Corasick automaton finds all exact pieces in a
text in one pass; around every hit the item is verified with Myers' bit-parallel edit distance against a window that
holds every alignment of that hit. Both sides are compared in lower case with single spaces.

The benchmark is handled in passes of at most ``PASS_CHARS`` characters (items are dealt to passes by a hash), so what a
worker holds is bounded for every benchmark; documents are only scanned, and just the ids of those with a hit are joined back.

Defined cases: null and empty documents hold nothing; null and empty items and items without an id are left out; items with
equal texts are all reported; an item is reported once per document with its least distance; repeated rows are reported
each; null document ids are kept; other columns are ignored by ``report`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postura.llm.common import ROW, as_row, by_value, column, small_batches, text_of
from postura.llm.tokens import worker_slot
from postura.operators.ordered import stage

#: Edits per character of an item; with it a piece has about 1 / RATE characters.
RATE = 0.05
PASS_CHARS = 4_000_000
FOUND = "array<struct<item_id:long,distance:long>>"


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of nearly equal length."""
    n = len(item)
    cuts = [n * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def distance(item: str, text: str) -> int:
    """Least edit distance between an item and any part of a text (Myers, one bit per character of the item)."""
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    m = len(item)
    whole, top = (1 << m) - 1, 1 << m - 1
    up, down, score = whole, 0, m
    best = m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | down
        xh = ((eq & up) + up ^ up) | eq
        ph = down | whole & ~(xh | up)
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & whole
        mh = mh << 1 & whole
        up = mh | whole & ~(xv | ph)
        down = ph & xv
    return best


class Matcher:
    """Finds items of one pass in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(text, int(rate * len(text))) for _, text in items]
        self.ids = [i for i, _ in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (text, budget) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                found.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def search(self, text: str) -> dict[int, int]:
        """Item id to least distance, for the items within their budget."""
        best: dict[int, int] = {}
        done: set[tuple[int, int]] = set()
        for end, (length, places) in self.automaton.iter(text):
            for k, offset in places:
                start = end + 1 - length - offset
                item, budget = self.items[k]
                if (k, start) in done or best.get(k) == 0:
                    continue
                done.add((k, start))
                lo, hi = max(0, start - budget), start + len(item) + budget
                d = 0 if text.find(item, lo, hi) >= 0 else distance(item, text[lo:hi]) if budget else 1
                if d <= budget and d < best.get(k, budget + 1):
                    best[k] = d
        return {self.ids[k]: d for k, d in best.items()}


def _passes(benchmark: DataFrame, item_col: str, text_col: str, pass_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in bounded portions, in a fixed order."""
    items = (benchmark.select(column(item_col).cast("long").alias("id"), text_of(text_col).alias("text"))
             .where("id is not null and trim(text) <> ''").distinct())
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // pass_chars))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()
        found = sorted((r.id, plain(r.text)) for r in rows)
        yield [(i, t) for i, t in found if t]


def found(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", rate: float = RATE, pass_chars: int = PASS_CHARS) -> DataFrame:
    """Staged: ``id``, ``h`` (hash of the text) and ``found`` of the documents with a hit, one row each."""
    small_batches(df.sparkSession)
    text = text_of(text_col)
    docs = df.select(column(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))

    def scan(items: list[tuple[int, str]], name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = worker_slot("matcher", name, lambda: Matcher(items, rate)) if items else None
            for batch in batches:
                ids, hashes, hits = [], [], []
                for i, h, t in zip(*[c.to_pylist() for c in batch.columns]):
                    if matcher and (got := matcher.search(plain(t))):
                        ids.append(i)
                        hashes.append(h)
                        hits.append([{"item_id": k, "distance": d} for k, d in sorted(got.items())])
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(hits, kind)],
                                                 ["id", "h", "found"])

        return stage(docs.mapInArrow(run, f"id long, h long, found {FOUND}"))

    run_id = uuid.uuid4().hex
    hits = [scan(items, f"matcher_{run_id}_{k}") for k, items in enumerate(_passes(benchmark, item_col, item_text_col, pass_chars))]
    one = hits[0] if len(hits) == 1 else reduce(DataFrame.unionByName, hits)
    merged = one.groupBy("id", "h").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    return stage(merged)


def report(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, items (ascending, comma-joined), distance (least; null: none)."""
    hits = found(df, benchmark, id_col, text_col, **options)
    docs = df.select(column(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("_h"))
    joined = docs.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_h") == F.col("h")), "left")
    items = F.array_sort(F.transform("found", lambda x: x["item_id"]))
    return joined.select("doc_id", F.col("found").isNotNull().alias("contaminated"),
                         F.when(F.col("found").isNull(), F.lit(0)).otherwise(F.size("found")).cast("long").alias("n_items"),
                         F.coalesce(F.array_join(items.cast("array<string>"), ","), F.lit("")).alias("items"),
                         F.array_min(F.transform("found", lambda x: x["distance"])).alias("distance"))


def drop_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All columns of the documents that hold no item."""
    hits = found(df, benchmark, id_col, text_col, **options).select("id", "h")
    rows = df.select(column(id_col).cast("long").alias("_id"), F.xxhash64(text_of(text_col)).alias("_h"), as_row(df))
    kept = rows.join(hits, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_h") == F.col("h")), "left_anti")
    return kept.select(f"{ROW}.*")


by_value(__name__)
