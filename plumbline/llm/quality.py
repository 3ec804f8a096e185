"""Quality classification by Bradley-Terry ranking of preference pairs.

Every pair of a document of label 1 and one of label 0 says which of the two is preferred. A linear
score over features of the whole text is learnt by logistic loss on the pairs' differences of features. The cut
is a quantile of the training scores: the share of label 1 among them. Scores are then mapped to 0..1
so that the cut comes to lie at THRESHOLD.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh_name, held_out, small_batches
from plumbline.llm.fertility import SYMBOLS, find_words, repeated_words

THRESHOLD = 0.3
DIGITS = "0123456789"
MARKS = ".,;:?"
FEATURES = ("log_words", "word_length", "long_word", "distinct", "top_word", "symbols", "capitals", "digits", "marks", "loud", "repeats", "same_lines", "line_words", "short_words", "few_words")


def features(text: str | None) -> list[float]:
    """Of the whole text; a null text counts as empty. The longest word counts up to 40 characters and the words of a line up to 100 on average, so
    that neither stretches the scale; symbols and exclamation marks count up to one for each word."""
    t = text or ""
    words = find_words(t)
    n, chars = max(1, len(words)), max(1, len(t))
    lines = [x for x in t.split("\n") if x.strip()]
    sizes = np.fromiter(map(len, words), dtype=np.int32, count=len(words))
    return [
        np.log1p(len(words)),
        float(sizes.mean()) if len(words) else 0.0,
        float(np.minimum(sizes, 40).max()) if len(words) else 0.0,
        len(set(words)) / n,
        Counter(words).most_common(1)[0][1] / n if words else 0.0,
        min(1.0, sum(map(t.count, SYMBOLS)) / n),
        capitals(t) / chars,
        sum(map(t.count, DIGITS)) / chars,
        sum(map(t.count, MARKS)) / n,
        min(1.0, t.count("!") / n),
        repeated_words(words) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        min(100.0, len(words) / max(1, len(lines))),
        float((sizes <= 3).mean()) if len(words) else 0.0,
        1.0 if len(words) < 20 else 0.0,
    ]


def capitals(text: str) -> int:
    """Characters that lower-casing changes."""
    a, b = text.encode("utf-32-le"), text.lower().encode("utf-32-le")
    if len(a) != len(b):  # a few capitals become two characters
        return sum(map(str.isupper, text))
    return int((np.frombuffer(a, dtype="<u4") != np.frombuffer(b, dtype="<u4")).sum())


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def expanded(self, x: np.ndarray) -> np.ndarray:
        """Standardised features, their squares and hinges: bands can be preferred, not only ends."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, z * z, np.maximum(z - 1, 0), np.maximum(-z - 1, 0)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expanded(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.cut) / self.spread + at, -30, 30)))


def train(x: np.ndarray, labels: np.ndarray, steps: int = 600, pairs: int = 2048, decay: float = 1e-3, seed: int = 5) -> Ranker | None:
    """Adam on random preference pairs. None when a label is missing: there is no preference to learn."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return None
    out = Ranker(x.mean(axis=0), x.std(axis=0) + 1e-6, np.zeros(4 * x.shape[1]), 0.0, 1.0)
    z = out.expanded(x)
    rng, m, v = np.random.default_rng(seed), 0.0, 0.0
    for step in range(1, steps + 1):
        d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        miss = 1 / (1 + np.exp(np.clip(d @ out.weights, -30, 30)))
        g = -(d * miss[:, None]).mean(axis=0) + decay * out.weights
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        out.weights = out.weights - 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    raw = out.raw(x)
    # the quantile under which a share of rows falls that equals the share of label 0
    out.cut = float(np.quantile(raw, len(bad) / len(raw)))
    out.spread = max(1e-6, float(raw.std()) / 2)
    return out


def with_features(df: DataFrame, text: str, into: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([features(t) for t in batch])

    return df.withColumn(into, run(F.col(f"`{text}`")))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Ranker | None:
    """Learns from at most `sample` labelled documents that are not held out, those with the least hashes of their
    ids: a bounded sample, the same in every run. Null ids and labels are left out; of ids with several
    labels the least counts. Only features reach the driver."""
    known = labels.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{label}`").alias("q")).where("i is not null and q is not null").where(~held_out("i"))
    chosen = known.groupBy("i").agg(F.min("q").alias("q")).orderBy(F.xxhash64("i"), "i").limit(sample)
    rows = docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").alias("t")).join(F.broadcast(chosen), "i")
    # of repeated ids the least text
    rows = rows.groupBy("i").agg(F.min("q").alias("q"), F.min("t").alias("t"))
    got = with_features(rows, "t", "f").select("i", "q", "f").orderBy("i").collect()
    if not got:
        return None
    return train(np.array([r["f"] for r in got]), np.array([r["q"] for r in got]))


def with_quality(df: DataFrame, model: Ranker | None, text: str = "text", into: str = "quality_score") -> DataFrame:
    """df with a double column `into`, 0 to 1. Empty and null texts have a score too; without a model
    (nothing to learn from) every score is 0.5. A column named as `into` is replaced."""
    if model is None:
        return df.withColumn(into, F.lit(0.5))
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(shared.value.score(np.array([features(t) for t in batch])) if len(batch) else [], dtype="float64")

    return df.withColumn(into, run(F.col(f"`{text}`")))


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. Null and empty texts have a score; rows with repeated or null ids are scored each; equal texts
    have equal scores. Very long texts are read whole. Without labels of both kinds every score is 0.5. An empty table gives an empty result."""
    small_batches(docs.sparkSession)
    own = docs.select("doc_id", "text")
    into = fresh_name(own, "quality_score")
    out = with_quality(own, fit(docs, labels), into=into)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col(into).alias("score"), (F.col(into) >= THRESHOLD).cast("int").alias("predicted"))
