"""Document quality by hierarchical empirical Bayes.

A logistic model on shape features of the whole text gives every document its evidence. Means of that evidence are then
estimated per host and per path within the host, each shrunk towards the level above: a host towards all documents, a path
towards its host. The strength of the shrinkage is estimated from the spread between groups beyond what chance explains
(method of moments), so sparse sites stay near the global prior and large ones speak for themselves. A document's own
evidence is taken out of its site's mean before the two are combined, so nothing counts twice.

    logit(score) = evidence + logit(path mean without this document) - logit(global mean)

Group statistics are sums per (host, path), added up before the shuffle. The model is fitted on at most ``TRAIN_ROWS``
labelled rows, drawn by a hash of the id; all else covers all documents. The statistics table is written once and joined
by key; Spark broadcasts it or splits hot keys by itself.

Defined cases: a null or empty text has zero features; null hosts and paths are groups of their own; labels that are null
or have no document are left out, repeated labels of a document are averaged; without any label, or with one class only,
every score is the global mean 0.5 and all are kept; repeated rows are scored each; other columns are kept by ``keep_good``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postura.llm.common import ROW, as_row, by_value, column, drawn, small_batches, text_of
from postura.operators.ordered import stage

TRAIN_ROWS = 20_000
THRESHOLD = 0.5
FEATURES = ["log_chars", "symbols", "upper", "digits", "stops", "word_length", "distinct", "top_word", "lines", "bars", "stop_words"]
LEVELS = ["_host", "_path"]


def features(text: str) -> list[float]:
    """Shape of one text; every value is bounded or logarithmic."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits = int(count[65:91].sum()), int(count[97:123].sum()), int(count[48:58].sum())
    letters = upper + lower + int(count[128:].sum())
    space = int(count[9:14].sum() + count[32])
    stops = int(count[[44, 46]].sum())
    symbols = n - letters - digits - space - stops
    words = raw.split()
    m = len(words) or 1
    seen = Counter(words)
    top = max(seen.values(), default=0)
    closed = sum(w[-1] in b".," for w in words)
    return [math.log1p(n), symbols / n, upper / (upper + lower + 1), digits / n, stops / m, math.log1p((n - space) / m),
            math.log(len(seen) + 1) / math.log(m + 1), top / m, math.log1p(int(count[10])) / math.log1p(m + 1),
            int(count[124]) / m, closed / m]


def _shapes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([features(t) for t in texts])


def shape(text: Column) -> Column:
    return F.pandas_udf(_shapes, "array<double>")(text)


@dataclass(frozen=True)
class Model:
    """Weights on plain features; the intercept is last."""

    weights: tuple[float, ...]

    def logit(self, x: Column) -> Column:
        total = F.lit(self.weights[-1])
        for i, w in enumerate(self.weights[:-1]):
            total = total + x[i] * F.lit(w)
        return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> Model:
    """Ridge logistic regression by Newton's method on scaled features."""
    if len(y) == 0 or y.min() == y.max():
        return Model((0.0,) * (len(FEATURES) + 1))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    penalty = ridge * len(y) * np.append(np.ones(x.shape[1]), 0.0)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    plain = w[:-1] / scale
    return Model((*plain.tolist(), float(w[-1] - plain @ mean)))


def _level(name: str | None) -> Column:
    """A group key that keeps null apart from every text."""
    return F.lit("-") if name is None else F.coalesce(F.concat(F.lit("="), column(name).cast("string")), F.lit("-"))


@dataclass
class Fitted:
    """A model with the staged statistics of its corpus."""

    model: Model
    scored: DataFrame  # _id, _host, _path, _z
    groups: DataFrame  # _host, _path, path and host sums
    mean: float
    strength: tuple[float, float]


def train(scored: DataFrame, labels: DataFrame, id_col: str, label_col: str, rows: int) -> Model:
    known = (labels.select(column(id_col).cast("long").alias("_id"), column(label_col).cast("double").alias("_y"))
             .where("_id is not null and _y is not null").groupBy("_id").agg(F.avg("_y").alias("_y")))
    found = stage(scored.select("_id", "_x").join(known, "_id"))
    some = drawn(found, F.col("_id"), rows, found.count()).collect()
    some.sort(key=lambda r: (r._id, r._x))
    x = np.array([r._x for r in some]).reshape(len(some), len(FEATURES))
    return fit(x, np.array([float(r._y >= 0.5) for r in some]))


def strength(groups: DataFrame, n: str, s: str, centre: Column) -> float:
    """Prior strength in documents: from the spread of group means beyond chance."""
    mean = F.col(s) / F.col(n)
    row = groups.agg(F.sum(n).alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col(n) * (mean - centre) ** 2).alias("v"),
                     F.sum(F.col(n) * centre * (1 - centre)).alias("c"), F.sum(F.col(n) * F.col(n)).alias("nn")).first()
    if not row.n or row.k < 2 or not row.c:
        return 10.0
    chance = row.c / row.n  # variance of one document
    spread = (row.v - (row.k - 1) * chance) / max(row.n - row.nn / row.n, 1e-9)
    return float(min(max(chance / spread - 1 if spread > 0 else 1e4, 1.0), 1e4))


def fit_corpus(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
               path_col: str | None = "lang", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Fitted:
    """Fit the model and the statistics of hosts and paths over all documents."""
    small_batches(df.sparkSession)
    shaped = stage(df.select(column(id_col).cast("long").alias("_id"), _level(host_col).alias("_host"),
                             _level(path_col).alias("_path"), shape(text_of(text_col)).alias("_x")))
    model = train(shaped, labels, id_col, label_col, train_rows)
    scored = shaped.withColumn("_z", model.logit(F.col("_x"))).drop("_x")
    p = 1 / (1 + F.exp(-F.col("_z")))
    paths = stage(scored.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("_n"), F.sum(p).alias("_s")))
    hosts = paths.groupBy("_host").agg(F.sum("_n").alias("_hn"), F.sum("_s").alias("_hs"))
    total = paths.agg(F.sum("_s") / F.sum("_n")).first()[0]
    mean = min(max(total if total is not None else 0.5, 1e-6), 1 - 1e-6)
    groups = stage(paths.join(hosts, "_host"))
    of_host = strength(hosts, "_hn", "_hs", F.lit(mean))
    host_mean = (F.col("_hs") + of_host * mean) / (F.col("_hn") + of_host)
    of_path = strength(groups.withColumn("_c", host_mean), "_n", "_s", F.col("_c"))
    return Fitted(model, scored, groups, mean, (of_host, of_path))


def _posterior(rows: DataFrame, fitted: Fitted) -> DataFrame:
    """Adds _p, _host_mean, _path_mean, _score to rows with _host, _path, _z."""
    groups = fitted.groups.select(F.col("_host").alias("_gh"), F.col("_path").alias("_gp"), "_n", "_s", "_hn", "_hs")
    joined = rows.join(groups, (F.col("_host") == F.col("_gh")) & (F.col("_path") == F.col("_gp")), "left")
    of_host, of_path = fitted.strength
    p = 1 / (1 + F.exp(-F.col("_z")))
    zero = F.lit(0.0)
    own = F.when(F.col("_n").isNull(), zero).otherwise(F.col("_p"))  # a site that is new to the statistics holds no own part
    one = F.when(F.col("_n").isNull(), zero).otherwise(1.0)
    n, s, hn, hs = (F.coalesce(c, zero) for c in ("_n", "_s", "_hn", "_hs"))
    host = (hs - own + of_host * fitted.mean) / (hn - one + of_host)
    path = (s - own + of_path * F.col("_host_mean")) / (n - one + of_path)
    bound = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
    logit = lambda c: F.log(c / (1 - c))
    return (joined.withColumn("_p", p).withColumn("_host_mean", bound(host)).withColumn("_path_mean", bound(path))
            .withColumn("_score", 1 / (1 + F.exp(-(F.col("_z") + logit(F.col("_path_mean")) - math.log(fitted.mean / (1 - fitted.mean)))))))


def score(fitted: Fitted, threshold: float = THRESHOLD) -> DataFrame:
    """Per document of the corpus: doc_id, evidence, host_mean, path_mean, score, keep."""
    return _posterior(fitted.scored, fitted).select(
        F.col("_id").alias("doc_id"), F.col("_p").alias("evidence"), F.col("_host_mean").alias("host_mean"),
        F.col("_path_mean").alias("path_mean"), F.col("_score").alias("score"), (F.col("_score") >= threshold).alias("keep"))


def keep_good(df: DataFrame, fitted: Fitted, text_col: str = "text", host_col: str = "source", path_col: str | None = "lang",
              threshold: float = THRESHOLD) -> DataFrame:
    """All columns of the documents that score at least ``threshold``; texts are not shuffled."""
    small_batches(df.sparkSession)
    rows = df.select(as_row(df), _level(host_col).alias("_host"), _level(path_col).alias("_path"), shape(text_of(text_col)).alias("_x"))
    rows = rows.withColumn("_z", fitted.model.logit(F.col("_x"))).drop("_x")
    return _posterior(rows, fitted).where(F.col("_score") >= threshold).select(f"{ROW}.*")


by_value(__name__)
