"""Phrases whose words occur together more often than their parts suggest, counted over all texts.

Texts are dealt into shards of at most ``SHARD`` words of one language. Every shard is encoded by word numbers of its own and
stored. Words that are frequent over all shards come back to each shard; a phrase with another word cannot be frequent, so that
is where a piece ends for the next step. Each shard then gets a bidirectional FM-index: the text and its reversal are
sorted by their next ``LONGEST`` words, which gives both Burrows-Wheeler transforms and the step from a row to the row of
the word before. An interval of rows is a phrase and its width the count; it is extended by all words at once, to the
right through the transform of the reversed text and to the left through the other, and both intervals are kept in step.
Words become pairs by extension to the right and pairs become triples by extension to the left. Counts are summed across
shards by Spark, so every shard gives all its phrases: one that is rare there may be frequent over all.

A shard's arrays bound the memory of a task; what is shuffled are counts that each shard has summed. A piece that is longer than
a shard is cut so that two words stand in both parts, and what is counted twice is taken off again. Only ids travel after the
first step. Counts are exact, and scores are computed on decimals, since their products may pass 64 bits.

Defined cases: a null text has no words; a null language is ``und``; only A-Z are lowered; white space inside a piece is blank and
tab; repeated rows count each; an empty table gives no phrases; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postura.llm.common import by_value, column, small_batches, text_of
from postura.operators.ordered import stage
from postura.streaming.replay import settings

LONGEST = 3
#: Positions of a shard; a position and a word number take 21 bits each.
SHARD, BITS = 2_000_000, 21
LEAST, SHARE, TOP = 10, 50, 2000
#: Lower case for A-Z, blanks for tabs, line ends for marks that end a piece.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")


class Numbers(dict):
    """A new number for every new word, from 1 on; the end of a piece is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Shard:
    """Words of one language in the order in which they come."""

    def __init__(self, size: int):
        self.size, self.numbers, self.parts, self.n, self.twice = size, Numbers({b"\n": 0}), [], 0, []

    def room(self) -> int:
        return self.size - self.n - 1

    def add(self, words: list[bytes]) -> None:
        self.parts += [np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)]
        self.n += len(words) + 1

    def row(self, lang: str) -> dict:
        import zstandard

        words, ids = list(self.numbers)[1:], np.concatenate(self.parts)
        counts = np.bincount(ids, minlength=len(words) + 1)
        twice = np.array([[self.numbers[w] for w in pair] for pair in self.twice], dtype="<i4")
        np.subtract.at(counts, twice.ravel(), 1)
        return {"shard": uuid.uuid4().int >> 65, "lang": lang, "words": words, "counts": counts[1:].tolist(), "n": int(counts[1:].sum()),
                "ids": zstandard.compress(ids.astype("<i4").tobytes()), "twice": twice.tobytes()}


def shards_of(texts: Iterable[tuple[str, bytes]], size: int = SHARD) -> Iterator[dict]:
    """Texts by language to rows of shards; ``twice`` are pairs of words that stand in two shards.

    At most ``size`` words are held: then the fullest shard is given out.
    """
    shards: dict[str, Shard] = {}
    for lang, data in texts:
        words = [w for w in data.translate(_FOLD).replace(b"\n", b" \n ").split(b" ") if w]
        at = 0
        while at < len(words):
            shard = shards.pop(lang, None) or Shard(size)
            if len(words) - at <= shard.room():
                shard.add(words[at:])
                shards[lang] = shard
                break
            if shard.room() >= size // 2:  # too long for any shard: cut behind a piece, else two words stand in both parts
                end = at + shard.room()
                cut = next((i for i in range(end, end - size // 4, -1) if words[i - 1] == b"\n"), None)
                shard.add(words[at:cut or end])
                shard.twice += [] if cut else [words[end - 2:end]]
                at = cut or end - 2
            yield shard.row(lang)
        while sum(s.n for s in shards.values()) > size:
            fullest = max(shards, key=lambda k: shards[k].n)
            yield shards.pop(fullest).row(fullest)
    for lang, shard in shards.items():
        yield shard.row(lang)


class Side:
    """One direction of the index: rows are positions in the order of their next ``LONGEST`` words."""

    def __init__(self, seq: np.ndarray):
        n, at = len(seq), np.arange(len(seq), dtype=np.int64)
        ahead = np.concatenate([seq, np.zeros(LONGEST, dtype=np.int64)])
        name = seq
        for step in range(1, LONGEST):
            rows = np.sort((name << 2 * BITS) | (ahead[step:step + n] << BITS) | at)
            order, same = rows & (1 << BITS) - 1, rows >> BITS
            name = np.empty(n, dtype=np.int64)
            name[order] = np.cumsum(np.concatenate([[0], same[1:] != same[:-1]]))
        row = np.empty(n, dtype=np.int64)
        row[order] = at
        #: The transform: the word before each row's position; and the row of that position.
        self.before = np.where(order > 0, seq[order - 1], 0)
        self.step = np.where(order > 0, row[order - 1], -1)


class Index:
    """Bidirectional index of a sequence in which 0 ends a piece. ``first`` and ``other`` are the starts of a phrase's
    intervals among the rows of the sequence and of its reversal."""

    def __init__(self, seq: np.ndarray):
        self.ahead, self.back = Side(seq), Side(seq[::-1])
        count = np.bincount(seq)
        start = np.cumsum(count) - count
        self.words = np.flatnonzero(count[1:]) + 1
        self.first, self.count = start[self.words], count[self.words]

    @staticmethod
    def _extended(side: Side, first: np.ndarray, other: np.ndarray, count: np.ndarray):
        """Every interval by every word before it: owner, word, starts on this and the other side, count."""
        ends = np.cumsum(count)
        owner = np.repeat(np.arange(len(count)), count)
        rows = np.arange(int(count.sum())) - np.repeat(ends - count, count) + np.repeat(first, count)
        keys = np.sort((owner << 2 * BITS) | (side.before[rows] << BITS) | rows)
        group = keys >> BITS
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        width = np.diff(begin, append=len(group))
        owner, word = group[begin] >> BITS, group[begin] & (1 << BITS) - 1
        here = np.minimum.reduceat(side.step[keys & (1 << BITS) - 1], begin)
        there = other[owner] + begin - (ends - count)[owner]  # smaller words come before on the other side
        some = word > 0
        return owner[some], word[some], here[some], there[some], width[some]

    def right(self, first: np.ndarray, other: np.ndarray, count: np.ndarray):
        """Owner, word behind it, ``first``, ``other``, ``count``."""
        owner, word, here, there, width = self._extended(self.back, other, first, count)
        return owner, word, there, here, width

    def left(self, first: np.ndarray, other: np.ndarray, count: np.ndarray):
        """Owner, word before it, ``first``, ``other``, ``count``."""
        return self._extended(self.ahead, first, other, count)


def counted(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (words, 0 where the phrase is shorter) and counts of all pairs and triples."""
    if not seq.any():
        return np.zeros((0, LONGEST), dtype=np.int64), np.zeros(0, dtype=np.int64)
    index = Index(seq)
    owner, y, first, other, count = index.right(index.first, index.first, index.count)
    x = index.words[owner]
    if not len(x):
        return np.zeros((0, LONGEST), dtype=np.int64), count
    pair, w, _, _, triples = index.left(first, other, count)
    rows = np.concatenate([np.stack([x, y, np.zeros_like(x)], 1), np.stack([w, x[pair], y[pair]], 1)])
    return rows, np.concatenate([count, triples])


_SHARDS = "shard long, lang string, words array<binary>, counts array<long>, n long, ids binary, twice binary"
_COUNTS = "x long, y long, z long, n long"


def shards(df: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SHARD) -> DataFrame:
    """Shards of a table, staged."""
    kinds = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())),
                       ("n", pa.int64()), ("ids", pa.binary()), ("twice", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ((lang, data) for batch in batches for lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for row in shards_of(texts, size):
            yield pa.RecordBatch.from_pylist([row], kinds)

    small_batches(df.sparkSession)
    lang = F.coalesce(column(lang_col).cast("string"), F.lit("und"))
    return stage(df.select(lang.alias("lang"), text_of(text_col).cast("binary").alias("data")).mapInArrow(run, _SHARDS))


def _staged(df: DataFrame) -> DataFrame:
    """A staged table; the shuffles that made it are deleted when it is written, not some time later."""
    with settings(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        return stage(df)


def frequent_words(parts: DataFrame, least: int = LEAST) -> DataFrame:
    """``id``, ``lang``, ``word``, ``f`` of the words that occur often enough; ids are small and unique over languages. Staged."""
    words = parts.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", "w.words", "w.counts")
    total = words.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f")).where(F.col("f") >= least)
    found = _staged(total.select(F.monotonically_increasing_id().alias("at"), "lang", F.col("word").cast("string").alias("word"), "f"))
    # the task's number above 33 bits of the row's: dealt like cards the ids stay about as small as their number
    tasks = found.agg(F.coalesce(F.max(F.shiftright("at", 33)), F.lit(0)) + 1).first()[0]
    number = F.col("at").bitwiseAND((1 << 33) - 1) * F.lit(tasks) + F.shiftright("at", 33) + 1
    return found.select(number.alias("id"), "lang", "word", "f")


def phrase_counts(parts: DataFrame, words: DataFrame, least: int = LEAST) -> DataFrame:
    """``x``, ``y``, ``z`` (word ids; z is 0 for a pair), ``a``: phrases that occur often enough, counted in every shard. Staged."""
    local = parts.select("shard", "lang", F.posexplode("words").alias("at", "w"))
    known = local.join(words.select("lang", F.col("word").cast("binary").alias("w"), "id"), ["lang", "w"])
    given = _staged(known.groupBy("shard").agg(F.collect_list(F.struct("at", "id")).alias("known")))
    tasks = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts.count() // 2)  # a few shards each
    coded = parts.select("shard", "ids", "twice", F.size("words").alias("size")).repartition(tasks, "shard")
    ready = coded.join(given.repartition(tasks, "shard"), "shard").select("ids", "twice", "size", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.frombuffer(zstandard.decompress(batch.column(0)[k].as_py()), "<i4")
                known = batch.column(3)[k].values
                at, name = known.field("at").to_numpy(), known.field("id").to_numpy()
                number = np.zeros(batch.column(2)[k].as_py() + 1, dtype=np.int64)
                number[at + 1] = np.arange(1, len(at) + 1)
                name = np.concatenate([[0], name])
                rows, n = counted(number[ids])
                twice = number[np.frombuffer(batch.column(1)[k].as_py(), "<i4").reshape(-1, 2)]
                twice = twice[(twice > 0).all(1)]
                rows = np.concatenate([rows, np.pad(twice, [(0, 0), (0, 1)])])
                n = np.concatenate([n, np.full(len(twice), -1)])
                for low in range(0, len(n), 1 << 16):
                    some = name[rows[low:low + (1 << 16)]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(some[:, c])) for c in range(3)]
                                                     + [pa.array(n[low:low + (1 << 16)])], ["x", "y", "z", "n"])

    # a task's shards have few phrases in common: they go to their keys as they are, and are summed there
    found = ready.mapInArrow(run, _COUNTS).repartition("x", "y", "z")
    return _staged(found.groupBy("x", "y", "z").agg(F.sum("n").alias("a")).where(F.col("a") >= least))


def _named(rows: DataFrame, words: DataFrame, place: str) -> DataFrame:
    """Word and count of a place. A word that stands in very many phrases is split by adaptive execution."""
    kept = [c for c in words.columns if c not in ("id", "word", "f")]
    return rows.join(words.select(F.col("id").alias(place), F.col("word").alias(f"w{place}"), F.col("f").alias(f"f{place}"), *kept), place)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a^2 / (l r)) on whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide(a) * wide(a), wide(left) * wide(right))


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, share: int = SHARE,
                 size: int = SHARD) -> DataFrame:
    """All phrases of two and three words that occur ``least`` times or more in a language and are not mostly part of a longer
    one: lang, phrase, a (count), l, r (counts of the two parts of the weakest cut), n (words of the language), score, and
    ``left``, ``right``: how often the most frequent word before and behind a pair makes a candidate with it (0: none)."""
    parts = shards(df, text_col, lang_col, size)
    words = frequent_words(parts, least)
    counts = phrase_counts(parts, words, least)
    totals = parts.groupBy("lang").agg(F.sum("n").alias("n"))

    pairs, triples = counts.where("z = 0").select("x", "y", "a"), counts.where("z <> 0")
    left = triples.groupBy(F.col("y").alias("x"), F.col("z").alias("y")).agg(F.max("a").alias("left"))
    right = triples.groupBy("x", "y").agg(F.max("a").alias("right"))
    two = pairs.join(left, ["x", "y"], "left").join(right, ["x", "y"], "left").fillna(0, ["left", "right"])
    two = two.where(100 * F.greatest("left", "right") < share * F.col("a"))
    two = _named(_named(two, words.drop("lang"), "y"), words, "x")
    two = two.select("lang", "a", "left", "right", F.concat_ws(" ", "wx", "wy").alias("phrase"),
                     F.array(F.struct(_score(F.col("a"), F.col("fx"), F.col("fy")).alias("score"), F.lit(1).alias("k"),
                                      F.col("fx").alias("l"), F.col("fy").alias("r"))).alias("cuts"))
    three = triples.join(pairs.select("x", "y", F.col("a").alias("fxy")), ["x", "y"])
    three = three.join(pairs.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("a").alias("fyz")), ["y", "z"])
    three = _named(_named(_named(three, words.drop("lang"), "y"), words.drop("lang"), "z"), words, "x")
    cut = lambda k, one, rest: F.struct(_score(F.col("a"), F.col(one), F.col(rest)).alias("score"), F.lit(k).alias("k"),
                                        F.col(one).alias("l"), F.col(rest).alias("r"))
    three = three.select("lang", "a", F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("right"),
                         F.concat_ws(" ", "wx", "wy", "wz").alias("phrase"),
                         F.array(cut(1, "fx", "fyz"), cut(2, "fxy", "fz")).alias("cuts"))
    both = two.unionByName(three).select("*", F.array_min("cuts").alias("c"))
    return both.join(totals, "lang").select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score", "left", "right")


def top(found: DataFrame, rows: int = TOP) -> DataFrame:
    """The first phrases of each language by score, count and phrase, with their rank. Parts of a language are cut first, so that
    the last step sees a fixed number of rows, however many tasks there are."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(16))
    first = found.withColumn("_part", part).withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)))
    last = first.where(F.col("_n") <= rows).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return last.where(F.col("rank") <= rows).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


by_value(__name__)
