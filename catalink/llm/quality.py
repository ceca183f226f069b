"""Quality scores by Bradley-Terry ranking: of a good and a bad document, the probability that the good one is preferred is the logistic
function of the difference of their scores, which are linear in features of the whole text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalink.llm.common import text_bytes
from catalink.llm.samples import bounded_sample

PASS_MARK = 0.7  # score of a document at the threshold quantile
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
LETTER[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
POINT = np.isin(np.arange(256), list(b".,;:'\"()-"))
SHOUT = np.isin(np.arange(256), list(b"!?"))
SIGN = np.isin(np.arange(256), list(b"#$%&*+/<=>@[\\]^_`{|}~"))
GROUPS = np.stack([UPPER, LETTER, DIGIT, POINT, SHOUT, SIGN], 1).astype(float)
FEATURES = (
    "log_bytes", "log_words", "upper", "letters", "digits", "points", "shouts", "signs", "log_word_bytes", "distinct_words", "repeated_next",
    "top_word", "distinct_pairs", "distinct_lines", "upper_words", "signed_words",
)


def features(data: bytes) -> list[float]:
    """FEATURES of a whole text; an empty one has zeros."""
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, letters, digits, points, shouts, signs = (counts @ GROUPS / len(data)).tolist()
    n, distinct = len(words), Counter(words)
    pairs = list(zip(words, words[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        math.log1p(len(data)), math.log1p(n), math.sqrt(upper), letters, math.sqrt(digits), math.sqrt(points), math.sqrt(shouts),
        math.sqrt(signs), math.log(len(data) / n), len(distinct) / n ** 0.9,
        math.sqrt(sum(a == b for a, b in pairs) / n), max(distinct.values()) / n if n > 20 else 0.0,
        len(set(pairs)) / max(1, len(pairs)), len(set(lines)) / len(lines),
        sum(c for w, c in distinct.items() if w.isupper()) / n, sum(c for w, c in distinct.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,") / n,
    ]


@dataclass
class Model:
    """``score = logistic(weights @ (features - middle) / scale - cut + logit(PASS_MARK))``."""

    middle: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        raw = (np.array(rows, float).reshape(-1, len(FEATURES)) - self.middle) / self.scale @ self.weights
        return 1 / (1 + np.exp(-np.clip(raw - self.cut + math.log(PASS_MARK / (1 - PASS_MARK)), -500, 500)))


def _features_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([features(t) for t in text_bytes(texts)], pa.list_(pa.float64()))

    return made(text)


def rank_pairs(good: np.ndarray, bad: np.ndarray, pairs_per_row: int, penalty: float) -> np.ndarray:
    """Weights that minimise the logistic loss of the feature differences good - bad, by Newton's method.

    Every row meets ``pairs_per_row`` rows of the other kind, drawn with a fixed seed.
    """
    draw = np.random.default_rng(7)
    left = np.concatenate([np.repeat(np.arange(len(good)), pairs_per_row), draw.integers(0, len(good), len(bad) * pairs_per_row)])
    right = np.concatenate([draw.integers(0, len(bad), len(good) * pairs_per_row), np.repeat(np.arange(len(bad)), pairs_per_row)])
    gap = good[left] - bad[right]
    weights = np.zeros(gap.shape[1])
    for _ in range(25):
        miss = 1 / (1 + np.exp(np.clip(gap @ weights, -30, 30)))
        slope = gap.T @ miss / len(gap) - penalty * weights
        bend = (gap * (miss * (1 - miss))[:, None]).T @ gap / len(gap) + penalty * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    train_rows: int = 20_000, pairs_per_row: int = 8, penalty: float = 1e-4,
) -> Model | None:
    """A model from labelled documents (label 1 good, 0 bad); None unless both kinds occur.

    About ``train_rows`` labels are taken, chosen by a hash of key and label; only their documents' features, a few numbers each, come
    to the driver. Preference pairs join rows of different labels. The threshold is the quantile of the training scores at the share of
    bad documents, midway between the scores around it.
    """
    kept = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    kept = bounded_sample(kept.filter("key IS NOT NULL AND label IN (0, 1)"), train_rows, "key", "label")
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).join(F.broadcast(kept), "key")  # train_rows rows
    found = rows.select("label", _features_column(F.col("text")).alias("features")).toArrow()
    values = np.array(found["features"].to_pylist(), float).reshape(-1, len(FEATURES))
    marks = np.array(found["label"].to_pylist(), int)
    order = np.lexsort([*values.T, marks])  # whatever order the tasks ended in
    values, marks = values[order], marks[order]
    if not (marks == 1).any() or not (marks == 0).any():
        return None
    middle, scale = values.mean(0), values.std(0)
    scale[scale < 1e-9] = 1.0
    normal = (values - middle) / scale
    weights = rank_pairs(normal[marks == 1], normal[marks == 0], pairs_per_row, penalty)
    raw, below = np.sort(normal @ weights), int((marks == 0).sum())
    return Model(middle, scale, weights, float((raw[below - 1] + raw[below]) / 2))


def score_column(spark, model: Model | None, text: Column) -> Column:
    """The score of each whole text, 0 to 1, at least PASS_MARK from the threshold on; without a model every text has PASS_MARK."""
    if model is None:
        return F.lit(PASS_MARK)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores([features(t) for t in text_bytes(texts)]), pa.float64())

    return score(text)


def score(df: DataFrame, model: Model | None, text: str = "text", to: str = "score") -> DataFrame:
    """``df`` with its score; null and empty texts are scored as texts without words. Depends on the text alone."""
    return df.withColumn(to, score_column(df.sparkSession, model, F.col(text)))
