"""SimHash near-duplicates by the generalised pigeonhole principle.

A text gives a 64-bit fingerprint: a bit is set if it is set in over half of the hashes of its 4-word shingles. Two
fingerprints at ``radius`` or fewer differing bits are linked. The 64 bits are cut into partitions with thresholds ``t``
that sum to ``radius - partitions + 1``; linked fingerprints then differ by at most ``t`` bits in at least one partition.
So one side is indexed by the bits of each partition, the other probes all values within ``t`` flips of its own, and the
exact distance is part of the join condition.

* Correlated bits go to the same partition, so that partitions are as independent as the data allow.
* Partitions and thresholds come from dynamic programming over estimated costs: probe rows plus candidates, the
  latter from the share of close pairs per partition in a bounded sample of fingerprints. The sample sets the cost only;
  the found links are all links for every choice.
* Equal fingerprints are one row. Buckets of equal partition bits are first linked to their smallest member as stars;
  probing then skips pairs that are connected already, so a dense group does not give all its pairs.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other; fewer than four
words are one shingle; repeated rows and null ids keep their rows, a component takes the smallest non-null id; other
columns are ignored by ``fingerprints`` and kept by ``keep_one``; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postura.llm.common import ROW, as_row, by_value, column, drawn, small_batches, text_of
from postura.llm.components import components
from postura.operators.ordered import stage

#: Fingerprints that are drawn to estimate costs; never more reach the driver.
SAMPLE = 2000
WORDS, SEED, BITS = 4, 42, 64


def fingerprint(text: str, words: int = WORDS) -> int:
    """The fingerprint of one text as a signed 64-bit integer. Only A-Z are lowered; words end at ASCII white space."""
    from xxhash import xxh64_intdigest

    # split() without arguments cuts bytes at exactly the six ASCII white space characters
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(parts) - words + 1)
    last = ends[words - 1:].tolist() if len(parts) >= words else [len(joined)]
    total = np.zeros(BITS, dtype=np.int64)
    spans = list(zip(starts[:n].tolist(), last))
    for at in range(0, n, 1 << 16):
        some = spans[at:at + (1 << 16)]
        hashes = np.array([xxh64_intdigest(joined[i:j], SEED) for i, j in some], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id``, ``h`` (a hash of the text), ``fp``: one row per input row, without a shuffle."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], ["id", "h", "fp"])

    text = text_of(text_col)
    return (df.select(column(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
            .mapInArrow(run, "id long, h long, fp long"))


def bit_groups(sample: np.ndarray, groups: int) -> list[list[int]]:
    """Partitions of nearly equal size: the most correlated pairs of bits meet first."""
    bits = np.unpackbits(sample.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(0)
    norm = np.sqrt((bits ** 2).sum(0)) + 1e-9
    corr = np.abs(bits.T @ bits / np.outer(norm, norm))
    room = math.ceil(BITS / groups)
    parts = [[b] for b in range(BITS)]
    for a, b in sorted(((a, b) for a in range(BITS) for b in range(a)), key=lambda p: -corr[p]):
        x = next(p for p in parts if a in p)
        y = next(p for p in parts if b in p)
        if x is not y and len(x) + len(y) <= room:
            x += y
            parts.remove(y)
    while len(parts) > groups:  # what is left over fills the smallest parts
        parts.sort(key=len)
        for bit in parts.pop(0):
            min((p for p in parts if len(p) < room + 1), key=len).append(bit)
    return [sorted(p) for p in sorted(parts)]


def allocate(sample: np.ndarray, rows: int, radius: int) -> list[tuple[list[int], int]]:
    """The cheapest partitions and thresholds: (bits, threshold), thresholds of -1 left out."""
    best: tuple[float, list] = (math.inf, [])
    seen = sample if len(sample) > 1 else np.zeros(2, dtype=np.int64)
    for groups in range(2, radius + 2):
        parts = bit_groups(seen, groups)
        budget = radius - groups + 1  # sum of the thresholds
        cost: list[list[float]] = []  # [partition][threshold + 1]
        for part in parts:
            mask = np.int64(sum(1 << b if b < 63 else -(1 << 63) for b in part))
            masked = seen & mask
            near = np.zeros(BITS + 1)
            for at in range(0, len(masked), 256):
                apart = np.bitwise_count(masked[at:at + 256, None] ^ masked[None, :])
                near += np.bincount(apart.ravel(), minlength=BITS + 1)
            near[0] -= len(seen)
            share = np.cumsum(near) / (len(seen) * (len(seen) - 1)) + 2.0 ** -len(part)
            costs, probes = [0.0], 0.0
            for t in range(budget + groups):
                probes += math.comb(len(part), t)
                costs.append(probes * 4 + share[t] * rows if probes < 20_000 else math.inf)
            cost.append(costs)
        # best[i][s]: the first i partitions with thresholds that sum to s - i
        table = {0: (0.0, [])}
        for costs in cost:
            new: dict[int, tuple[float, list]] = {}
            for used, (total, chosen) in table.items():
                for t, c in enumerate(costs):
                    if total + c < new.get(used + t, (math.inf,))[0]:
                        new[used + t] = (total + c, [*chosen, t - 1])
            table = new
        total, chosen = table.get(budget + groups, (math.inf, []))
        if total < best[0]:
            best = (total, [(p, t) for p, t in zip(parts, chosen) if t >= 0])
    return best[1]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 & 1 else value


def flips(part: list[int], threshold: int) -> list[int]:
    """All masks of at most ``threshold`` bits of a partition."""
    masks = [0]
    level = [(0, 0)]
    for _ in range(threshold):
        level = [(m | 1 << b, i + 1) for m, at in level for i, b in enumerate(part) if i >= at]
        masks += [m for m, _ in level]
    return [_signed(m) for m in masks]


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _around(key: Column, masks: list[int]) -> Column:
    return F.transform(F.lit(masks), lambda mask: key.bitwiseXOR(mask))


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Edges ``a``, ``b`` between different fingerprints of a staged table with column ``fp``.

    Every pair within the radius is connected by edges, each of which is within the radius.
    """
    rows = distinct.count()
    sample = np.array(sorted(r.fp for r in drawn(distinct, F.col("fp"), SAMPLE, rows).collect()), dtype=np.int64)
    chosen = allocate(sample, rows, radius)
    masks = [_signed(sum(1 << b for b in part)) for part, _ in chosen]

    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("p", "key")
    keyed = distinct.select("fp", keys)
    centre = keyed.groupBy("p", "key").agg(F.min("fp").alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = (keyed.join(centre, ["p", "key"])
             .where((F.col("fp") != F.col("c")) & (_distance(F.col("fp"), F.col("c")) <= radius))
             .select(F.col("fp").alias("a"), F.col("c").alias("b")))
    stars = stage(stars.distinct())
    labels = components(stars)
    labelled = stage(distinct.join(labels, distinct.fp == labels.node, "left")
                     .select("fp", F.coalesce("root", "fp").alias("label")))
    index = labelled.select("fp", "label", keys)
    probes = [labelled.select(F.col("fp").alias("q"), F.col("label").alias("q_label"), F.lit(i).alias("p"),
                              F.explode(_around(F.col("fp").bitwiseAND(F.lit(masks[i])), flips(part, t))).alias("key"))
              for i, (part, t) in enumerate(chosen)]
    near = (_distance(F.col("q"), F.col("fp")) <= radius) & (F.col("q") < F.col("fp")) & (F.col("q_label") != F.col("label"))
    found = (reduce(DataFrame.unionByName, probes).join(index, ["p", "key"]).where(near)
             .select(F.col("q").alias("a"), F.col("fp").alias("b")))
    return stars.unionByName(found.distinct())


def classes(prints: DataFrame, radius: int = 4) -> DataFrame:
    """``fp``, ``first``: the first row, by (id, nulls last, hash of the text), of all that can be reached from it."""
    row = F.struct(F.col("id").isNull().alias("unknown"), "id", "h")
    known = stage(prints.groupBy("fp").agg(F.min(row).alias("first")))
    roots = components(links(known.select("fp"), radius))
    grouped = stage(known.join(roots, known.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = grouped.groupBy("root").agg(F.min("first").alias("first"))
    return grouped.select("fp", "root").join(least, "root").select("fp", "first")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """Columns ``doc_id``, ``fingerprint`` (16 hexadecimal digits), ``component_id``; one row per input row."""
    prints = stage(fingerprints(df, id_col, text_col))
    return (prints.join(classes(prints, radius), "fp")
            .select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    F.col("first.id").alias("component_id")))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """All columns of one row per component: its first by id (nulls last); of equal rows one stays."""
    prints = stage(fingerprints(df, id_col, text_col))
    kept = (classes(prints, radius).select(F.col("first.id").alias("_keep_id"), F.col("first.h").alias("_keep_h"))
            .distinct())
    rows = df.select(column(id_col).cast("long").alias("_id"), F.xxhash64(text_of(text_col)).alias("_h"), as_row(df))
    stays = rows.join(kept, F.col("_id").eqNullSafe(F.col("_keep_id")) & (F.col("_h") == F.col("_keep_h")), "left_semi")
    number = F.row_number().over(Window.partitionBy("_id", "_h").orderBy(F.xxhash64(ROW)))
    return stays.withColumn("_n", number).where("_n = 1").select(f"{ROW}.*")


by_value(__name__)
