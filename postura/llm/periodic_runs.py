"""Maximal periodic runs of the words of a text, and texts without the repetitions.

A run is a stretch of words with smallest period q and at least max(``LEAST``, 2 q) words that no neighbouring word extends
with that period.

Enumeration by a harmonic grid: for every period p up to half of the text, positions are taken in steps of max(p,
``LEAST`` - p). Every run of period p holds two grid positions' worth of matches, so some grid position i has word i equal to
word i + p; how far the two agree to the right and to the left gives the whole stretch. The grid has about n ln n pairs
for n words, whatever the text repeats; it is walked in bounded pieces.

How far two suffixes agree is found with a difference cover modulo ``MODULUS``: positions whose remainder lies in ``COVER`` are
sampled, and any two positions meet two sampled ones after the same few steps. These few words are compared directly; from
there on the suffixes are sampled ones, which are sorted (names of the next ``MODULUS`` words, then doubling), and the
least of the common prefixes between neighbours in that order comes from a sparse table. The samples of a text are
sorted only if some pair agrees so far. The same on the reversed words serves the left side.

Every text is worked on alone, so the job has no shuffle and its tasks hold one text's arrays. Defined cases: a null
or blank text has no words and no runs, and collapses to an empty text; rows may repeat; an empty table stays empty; white space is
the ASCII one only, and words are compared byte by byte; collapsed texts join their words by one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postura.llm.common import by_value, column, small_batches, text_of

LEAST = 12
#: A perfect difference cover: every remainder is a difference of two members.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: Grid pairs that are looked at together.
PIECE = 1 << 20
FOUND = "struct<n_words:long,runs:array<struct<start:long,length:long,period:long>>,collapsed:string>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _meeting() -> np.ndarray:
    """Steps after which two remainders are both in the cover."""
    steps = [[next(d for d in range(MODULUS) if (a + d) % MODULUS in COVER and (b + d) % MODULUS in COVER)
              for b in range(MODULUS)] for a in range(MODULUS)]
    return np.array(steps, dtype=np.int64)


MEETING = _meeting()


class Agreement:
    """How far suffixes of a sequence of positive numbers agree."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.words = np.concatenate([words, np.zeros(MODULUS + 1, dtype=words.dtype)])  # zero: behind the end
        self.table: list[np.ndarray] | None = None

    def _sort_samples(self) -> None:
        n, words = self.n, self.words
        at = np.flatnonzero(np.isin(np.arange(n) % MODULUS, COVER))
        slot = np.full(n + MODULUS, len(at), dtype=np.int64)  # sample number of a position; one more: behind the end
        slot[at] = np.arange(len(at))
        name = words[at].astype(np.int64)
        for step in range(1, MODULUS):  # names of the next MODULUS words, in their order
            name = np.unique(name * (int(words.max()) + 1) + words[at + step], return_inverse=True)[1]
        levels, width = [], MODULUS
        while True:
            levels.append(np.append(name + 1, 0))
            if name.max(initial=0) + 1 == len(at):
                break
            later = levels[-1][slot[np.minimum(at + width, n)]]
            name = np.unique((name + 1) * (len(at) + 1) + later, return_inverse=True)[1]
            width *= 2
        order = np.empty(len(at), dtype=np.int64)
        order[name] = at
        self.rank = np.zeros(n, dtype=np.int64)
        self.rank[at] = name
        a, b = order[:-1], order[1:]
        common = np.zeros(len(a), dtype=np.int64)
        for k in range(len(levels) - 2, -1, -1):
            x, y = slot[np.minimum(a + common, n)], slot[np.minimum(b + common, n)]
            common += np.where((levels[k][x] == levels[k][y]) & (x < len(at)), MODULUS << k, 0)
        open_ = np.arange(len(a))
        for _ in range(MODULUS):
            x, y = a[open_] + common[open_], b[open_] + common[open_]
            open_ = open_[(np.maximum(x, y) < n) & (words[np.minimum(x, n)] == words[np.minimum(y, n)])]
            common[open_] += 1
        self.table = [common]
        while (half := 1 << len(self.table) - 1) * 2 <= len(a):
            below = self.table[-1]
            self.table.append(np.minimum(below[:-half], below[half:]))

    def _sampled(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The same for sampled positions inside the sequence: least common prefix between their ranks."""
        if self.table is None:
            self._sort_samples()
        x, y = self.rank[i], self.rank[j]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), dtype=np.int64)
        for k in np.unique(level):
            some = level == k
            out[some] = np.minimum(self.table[k][low[some]], self.table[k][high[some] - (1 << k)])
        return out

    def reach(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For positions i < j (at most n): the number of words on which the suffixes from there agree."""
        out = np.zeros(len(i), dtype=np.int64)
        steps = MEETING[i % MODULUS, j % MODULUS]
        open_ = np.flatnonzero(j < self.n)
        for step in range(MODULUS):
            x, y = i[open_] + step, j[open_] + step
            met = steps[open_] == step
            inside = met & (y < self.n)
            if inside.any():
                out[open_[inside]] += self._sampled(x[inside], y[inside])
            goes_on = ~met & (self.words[x] == self.words[y])
            open_ = open_[goes_on]
            if not len(open_):
                break
            out[open_] += 1
        return out


def grid(n: int, least: int, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (position, period) for n words, ascending periods, in pieces."""
    period = np.arange(1, n // 2 + 1, dtype=np.int64)
    step = np.maximum(period, least - period)
    ends = np.cumsum((n - period - 1) // step + 1)
    at = 0
    while at < len(period):
        done = int(ends[at - 1]) if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + piece, side="right")))
        count = np.diff(ends[at:upto], prepend=done)
        k = np.arange(int(ends[upto - 1]) - done) - np.repeat(ends[at:upto] - count - done, count)
        yield k * np.repeat(step[at:upto], count), np.repeat(period[at:upto], count)
        at = upto


def runs(words: np.ndarray, least: int = LEAST, piece: int = PIECE) -> np.ndarray:
    """Rows (start, length, period), by start and period, of a sequence of positive numbers."""
    n = len(words)
    ahead, back = Agreement(words), Agreement(words[::-1])
    found = np.zeros((0, 3), dtype=np.int64)
    if n < least:
        return found
    for i, p in grid(n, least, piece):
        same = np.flatnonzero(words[i] == words[i + p])
        i, p = i[same], p[same]
        right, left = ahead.reach(i, i + p), back.reach(n - i - p, n - i)
        some = np.flatnonzero(right + left >= np.maximum(p, least - p))
        start = i[some] - left[some]
        new = np.stack([start, i[some] + p[some] + right[some] - start, p[some]], 1)
        both = np.concatenate([found, new])
        # one stretch under several periods, multiples of its smallest: that came first
        found = both[np.sort(np.unique(both[:, 0] * (n + 1) + both[:, 1], return_index=True)[1])]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run holds behind its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words by equal numbers from 1 on."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known) + 1) for w in words), np.int64, len(words))


def periodic(text: Column, least: int = LEAST) -> Column:
    """Of a text: ``n_words``, ``runs`` by start and period (positions are word numbers from 0), and the ``collapsed`` text."""
    def run(texts: pa.Array) -> pa.Array:
        counts, lists, texts_out = [], [], []
        for data in texts.to_pylist():
            words = (data or b"").split()
            found = runs(numbered(words), least)
            counts.append(len(words))
            lists.append(found)
            stay = compress(words, kept(len(words), found).tolist()) if len(found) else words
            texts_out.append(b" ".join(stay))
        ends = np.cumsum([0, *map(len, lists)], dtype=np.int64)
        flat = np.concatenate([np.zeros((0, 3), dtype=np.int64), *lists])
        each = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(_RUN))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each),
                                           pa.array(texts_out, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])

    return F.arrow_udf(run, FOUND)(text.cast("binary"))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``runs``, ``collapsed``."""
    small_batches(df.sparkSession)
    found = df.select(column(id_col).alias("doc_id"), periodic(text_of(text_col), least).alias("r"))
    return found.select("doc_id", "r.n_words", "r.runs", "r.collapsed")


def collapse(df: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The rows with all their columns, each text without the repetitions of its runs; a text without a run stays as it is."""
    small_batches(df.sparkSession)
    marked = df.select(F.struct(*[column(c) for c in df.columns]).alias("_row"), periodic(text_of(text_col), least).alias("_r"))
    text = F.when(F.size("_r.runs") > 0, F.col("_r.collapsed")).otherwise(F.col("_row").getField(text_col)).alias(text_col)
    return marked.select(*[text if c == text_col else F.col("_row").getField(c).alias(c) for c in df.columns])


def with_planted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text``: every tenth document by a hash of its id ends in a stretch that repeats, at a place and with
    a period that the hash gives. A null id keeps its text."""
    h = F.crc32(column(id_col).cast("string"))
    words = F.filter(F.split(text_of(text_col), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    some = df.select(column(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    some = some.selectExpr("doc_id", "text", "w", "h div 10 as g", "size(w) as n")
    some = some.withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)")))
    some = some.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)")
    planted = F.array_join(F.concat(F.expr("slice(w, 1, a)"), tail), " ")
    return some.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Per row of ``find``: number of runs, the longest run (ties: smallest start, then period), digests of runs and collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                                             r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.selectExpr("doc_id", "n_runs", "-b.s as start", "b.l as length", "-b.p as period",
                           "(1000 * b.l) div (-b.p) as exponent_milli", "runs_sha256", "collapsed_sha256")


by_value(__name__)
