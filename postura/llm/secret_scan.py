"""Secrets in texts: candidates by pattern, false positives removed by a random forest. SQL functions and Spark ML only.

A candidate is a run of at least ``MIN_CHARS`` signs that occur in keys and tokens, or a run of any length that is assigned to a
secret's name; a sign '=' belongs to it only as padding at its end. Its features: length, changes between
character classes, different signs, shares of digits, capitals and vowels, the share that dictionary words cover, whether it is
hexadecimal, its path, and the words, assignment sign and quotes around it. The dictionary is the corpus' own: its ``DICTIONARY``
most frequent words, counted over all documents. The forest is trained on labelled findings (columns of ``FEATURES`` and
``label``); ``rule_labels`` gives such a table where no audited one exists: what is assigned to a secret's name and mixes
letters with digits is a secret; what has no such name and only letters, or only digits, is none, nor is an unquoted run of
dictionary words behind a name ("secret: nobody"), nor, far from any such name, hexadecimal signs behind a word for digests, a UUID or
a path; all else stays unlabelled.
At most ``TRAIN_ROWS`` of each label are used, drawn by a hash.

Candidates and features are written once and are small against the texts; words are counted before their shuffle.

Defined cases: null is an empty text; without findings of both labels nothing is removed as a false positive, and candidates that
mix letters with digits count; repeated rows are reported each; null ids and paths are kept; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postura.llm.common import column, drawn, text_of
from postura.llm.pii import matches
from postura.operators.ordered import stage

MIN_CHARS, DICTIONARY, TRAIN_ROWS, THRESHOLD = 20, 10_000, 5_000, 0.5
#: Signs of keys; '=' is one only as padding at the end, else it assigns.
SIGN = "[A-Za-z0-9+/_-]"
PADDING = "(?:={1,2}(?![A-Za-z0-9+/_=-]))?+"
PATTERN = rf"(?<!{SIGN}){SIGN}{{{MIN_CHARS},}}+{PADDING}"
#: Names that secrets are assigned to, words that speak of digests, and paths of examples. Fixed values.
NAMES = "token|secret|passw(?:or)?d|passwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credentials?"
#: A secret's name and its assignment, up to the value: what follows is a candidate at any length.
ASSIGNED = rf"(?i)(?:{NAMES})[\"'`]?\s{{0,4}}(?::=|=>|={{1,3}}|:)\s{{0,4}}[\"'`]?(?=[A-Za-z0-9+/_-])"
DIGESTS = "sha1|sha256|sha512|md5|commit|checksum|hash|digest|uuid|guid|revision|etag|integrity"
UUID = "^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$"
#: Names of letters, each with a short number at most, between slashes.
PATH = "^/?(?:[A-Za-z_-]{2,}+[0-9]{0,4}/)++[A-Za-z_-]*+[0-9]{0,4}$"
EXAMPLES = "test|example|sample|fixture|mock|docs?/"
FEATURES = ["length", "changes", "different", "digits", "capitals", "vowels", "words", "hexadecimal", "named", "near_name",
            "assigned", "quoted", "digest", "example_path"]
NEAR = 40


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.length("value")


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def _value(text: Column, start: Column) -> Column:
    """The run of signs at a position, as a match."""
    value = F.regexp_extract(F.substring(text, start + 1, F.length(text)), f"^{SIGN}++{PADDING}", 0)
    return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """Staged: one row per candidate with all features but ``words``, and ``mixed``."""
    text = F.col("text")
    path = F.lit(None).cast("string") if path_col is None else column(path_col).cast("string")
    docs = df.select(column(id_col).cast("long").alias("id"), F.xxhash64(text_of(text_col)).alias("h"), path.alias("path"),
                     text_of(text_col).alias("text"))
    assigned = F.transform(matches(text, ASSIGNED), lambda m: _value(text, m["end"]))
    spans = F.array_distinct(F.concat(matches(text, PATTERN), assigned))
    found = (docs.where(text.rlike(PATTERN) | text.rlike(ASSIGNED))
             .select("id", "h", "path", "text", F.explode(spans).alias("m")))
    before = F.substring(text, F.greatest(F.col("m.start") - NEAR, F.lit(0)) + 1, F.least(F.col("m.start"), F.lit(NEAR)))
    around = found.select("id", "h", "path", "m.start", "m.end", "m.value", before.alias("before"),
                          F.substring(text, F.col("m.end") + 1, F.lit(NEAR)).alias("after"))
    changes = "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"
    quotes = "[\"'`]"
    b, a, value = F.col("before"), F.col("after"), F.col("value")
    return stage(around.select(
        F.monotonically_increasing_id().alias("key"), "id", "h", "start", "end", "value",
        F.log1p(F.length("value")).alias("length"), _share(changes).alias("changes"),
        (F.size(F.array_distinct(F.split("value", ""))) / F.least(F.length("value"), F.lit(64))).alias("different"),
        _share("[0-9]").alias("digits"), _share("[A-Z]").alias("capitals"), _share("(?i)[aeiou]").alias("vowels"),
        _flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")).alias("hexadecimal"),
        _flag(b.rlike(rf"(?i)(?:{NAMES})[^A-Za-z0-9]{{0,6}}$")).alias("named"),
        _flag(F.concat(b, F.lit(" "), a).rlike(rf"(?i)(?<![a-z])(?:{NAMES})(?![a-z])")).alias("near_name"),
        _flag(b.rlike(rf"[:=]\s*{quotes}?$")).alias("assigned"),
        _flag(b.rlike(f"{quotes}$") & a.rlike(f"^{quotes}")).alias("quoted"),
        _flag(b.rlike(rf"(?i)(?<![a-z])(?:{DIGESTS})(?![a-z])")).alias("digest"),
        _flag(F.col("path").rlike(f"(?i)(?:{EXAMPLES})")).alias("example_path"),
        (value.rlike("[0-9]") & value.rlike("[A-Za-z]")).alias("mixed"),
    ))


def dictionary(df: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> DataFrame:
    """Staged: the most frequent words of three letters or more; ties by the word."""
    words = df.select(F.explode(F.split(F.lower(text_of(text_col)), r"[^\p{L}]+")).alias("word")).where(F.length("word") >= 3)
    return stage(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(size).select("word"))


def with_words(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds ``words``: the share of a candidate that dictionary words cover."""
    parts = F.explode(F.regexp_extract_all("value", F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0)))
    covered = (found.select("key", parts.alias("part")).select("key", F.lower("part").alias("word")).join(words, "word")
               .groupBy("key").agg(F.sum(F.length("word")).alias("covered")))
    share = F.coalesce(F.col("covered"), F.lit(0)) / F.length("value")
    return found.join(covered, "key", "left").withColumn("words", share).drop("covered")


def rule_labels(found: DataFrame) -> DataFrame:
    """Labelled findings where a plain rule is sure."""
    secret = F.col("mixed") & (F.col("named") == 1) & (F.col("assigned") == 1)
    prose = (F.col("words") == 1) & (F.col("quoted") == 0)
    unnamed = (F.col("named") == 0) & (F.col("near_name") == 0)
    digest = (F.col("digest") == 1) & (F.col("hexadecimal") == 1)
    look_alike = digest | F.col("value").rlike(UUID) | F.col("value").rlike(PATH)
    label = (F.when(secret, 1.0).when(~F.col("mixed") & ((F.col("named") == 0) | prose), 0.0)
             .when(F.col("mixed") & unnamed & look_alike, 0.0))
    return found.withColumn("label", label).where("label IS NOT NULL")


def train(findings: DataFrame, rows: int = TRAIN_ROWS):
    """A forest from labelled findings, or None without both labels."""
    counts = {r.label: r.n for r in findings.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(counts) != {0.0, 1.0}:
        return None
    key = F.struct(*FEATURES)
    sample = stage(reduce(DataFrame.unionByName, [
        drawn(findings.where(F.col("label") == label).select("label", *FEATURES), key, rows, n) for label, n in counts.items()]))
    forest = RandomForestClassifier(numTrees=20, maxDepth=6, seed=7, featuresCol="_x", labelCol="label",
                                    rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_label")
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(sample))


def score(found: DataFrame, forest) -> DataFrame:
    """Adds ``score``, the forest's probability."""
    if forest is None:
        return found.withColumn("score", F.col("mixed").cast("double"))
    judged = forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(found))
    return judged.withColumn("score", vector_to_array("_probability")[1]).drop("_x", "_raw", "_probability", "_label")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source",
         findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Staged candidates with ``score`` and ``secret``."""
    found = stage(with_words(candidates(df, id_col, text_col, path_col), dictionary(df, text_col)))
    forest = train(rule_labels(found) if findings is None else findings)
    return stage(score(found, forest).withColumn("secret", F.col("score") >= threshold))


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_candidates, n_secrets, secrets (start:end in code points, comma-joined)."""
    found = find(df, id_col, text_col, **options)
    spot = F.struct("start", "end")
    # a repeated row has its candidates once per repetition, hence sets
    per_doc = found.groupBy("id", "h").agg(F.collect_set(spot).alias("all"), F.collect_set(F.when(F.col("secret"), spot)).alias("some"))
    docs = df.select(column(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("_h"))
    joined = docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_h") == F.col("h")), "left")
    size = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c)).cast("long")
    spans = F.array_join(F.transform(F.array_sort("some"), lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return joined.select("doc_id", size("all").alias("n_candidates"), size("some").alias("n_secrets"),
                         F.coalesce(spans, F.lit("")).alias("secrets"))
