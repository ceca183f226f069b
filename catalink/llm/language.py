"""Language identification, words first: a known word is scored by its log frequency in each language, any other word by its longest
known character n-grams.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalink.llm.common import text_bytes
from catalink.llm.samples import bounded_sample
from catalink.session import cut

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
LONGEST_GRAM = 5
SMOOTHING = 0.5
FLUSH = 200_000  # distinct entries counted in a task's memory before they are passed on
CACHE_ENTRIES = 200_000


@dataclass
class Model:
    """Log frequencies by language; one row per word or n-gram, one column per language in code point order."""

    languages: list[str]
    priors: np.ndarray
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return LETTERS.findall(text.lower())


def has_letter(text: str) -> bool:
    return any(c.isalpha() for run in LETTERS.finditer(text) for c in run.group())


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word between borders; a single border is none."""
    framed = f"<{word}>"
    return [word[i] for i in range(len(word))] if n == 1 else [framed[i : i + n] for i in range(len(framed) - n + 1)]


def _counted(entries) -> Iterator[pa.RecordBatch]:
    """(lang, kind, entry, n) batches of (lang, kind, entry, n) items, summed in memory as far as it is bounded."""
    counts: Counter = Counter()

    def batch():
        keys = list(counts)
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([counts[k] for k in keys], pa.int64())], COUNT_NAMES)

    for lang, kind, items in entries:
        for entry, n in items.items():
            counts[lang, kind, entry] += n
        if len(counts) >= FLUSH:
            yield batch()
            counts.clear()
    yield batch()


COUNT_NAMES = ["lang", "kind", "entry", "n"]
COUNT_SCHEMA = "lang string, kind int, entry string, n bigint"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _counted(
        (lang, 0, Counter(words_of(text.decode("utf-8", "replace"))))
        for batch in batches
        for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)))
    )


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _counted(
        (lang, n, Counter({g: c * k for g, k in Counter(grams_of(word, n)).items()}))
        for batch in batches
        for lang, word, c in zip(*(x.to_pylist() for x in batch.columns))
        for n in range(1, LONGEST_GRAM + 1)
    )


def fit(
    df: DataFrame, text: str = "text", lang: str = "lang", keys: tuple[str, ...] = ("doc_id",),
    train_rows: int = 20_000, words_per_language: int = 30_000, grams_per_language: int = 30_000,
) -> Model | None:
    """A model from the rows with a language; None if there is none.

    The model is fitted on about ``train_rows`` rows, chosen by a hash of ``keys`` and the language, with their whole texts; it keeps
    the most frequent words of each language and the most frequent n-grams of each language and length (ties by code point). These
    parameters bound its size, which is what is collected and broadcast.
    """
    rows = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("text"), *[k for k in keys if k not in (text, lang)])
    rows = bounded_sample(rows.filter(F.col("lang").isNotNull()), train_rows, *[k for k in keys if k not in (text, lang)], "lang")
    sums = F.sum("n").alias("n")
    words = cut(rows.select("lang", "text").mapInArrow(_count_words, COUNT_SCHEMA).groupBy("lang", "kind", "entry").agg(sums), "words")
    grams = words.select("lang", "entry", "n").mapInArrow(_count_grams, COUNT_SCHEMA).groupBy("lang", "kind", "entry").agg(sums)
    order = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "entry")
    counted = []
    for table, most in ((words, words_per_language), (grams, grams_per_language)):
        ranked = table.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
        counted.append(ranked.select(*COUNT_NAMES).toArrow().to_pydict())
    totals = {r["lang"]: r["rows"] for r in rows.groupBy("lang").agg(F.count("*").alias("rows")).collect()}
    languages = sorted(totals)
    if not languages:
        return None
    place = {x: i for i, x in enumerate(languages)}
    tables = []
    for found in counted:
        index = {x: i for i, x in enumerate(sorted(set(found["entry"])))}
        kinds = np.zeros(len(index), np.int64)
        counts = np.zeros((len(index), len(languages)))
        for name, kind, entry, n in zip(*(found[c] for c in COUNT_NAMES)):
            counts[index[entry], place[name]] = n
            kinds[index[entry]] = kind
        logs = np.zeros_like(counts)
        for kind in np.unique(kinds):
            own = kinds == kind
            seen = counts[own] + SMOOTHING
            logs[own] = np.log(seen / seen.sum(0))
        tables.append((index, logs))
    priors = np.array([totals[x] for x in languages], float)
    return Model(languages, priors / priors.sum(), *tables[0], *tables[1])


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.index = dict(self.model.words)
        self.table = np.vstack([self.model.word_logs, np.zeros((CACHE_ENTRIES, len(self.model.languages)))])

    def unseen(self, word: str) -> np.ndarray:
        """Mean log frequencies of the longest n-grams of which any is known; zeros if none of any length is."""
        for n in range(LONGEST_GRAM, 0, -1):
            known = [i for g in grams_of(word, n) if (i := self.model.grams.get(g)) is not None]
            if known:
                return self.model.gram_logs[known].mean(0)
        return np.zeros(len(self.model.languages))

    def predict(self, text: str) -> tuple[str, float]:
        words = words_of(text)
        if not words or not has_letter(text):
            return UNKNOWN, 0.0
        if len(self.index) >= len(self.model.words) + CACHE_ENTRIES:
            self.reset()
        places = list(map(self.index.get, words))
        if None in places:
            for i, place in enumerate(places):
                if place is None:
                    word = words[i]
                    place = self.index.get(word)
                    if place is None:
                        place = self.index[word] = len(self.index)
                        if place == len(self.table):
                            self.table = np.vstack([self.table, np.zeros_like(self.table)])
                        self.table[place] = self.unseen(word)
                    places[i] = place
        total = self.table[places].sum(0)
        if not total.any():
            total = np.log(self.model.priors)
        weights = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.model.languages[best], float(weights[best] / weights.sum())


def predict(df: DataFrame, model: Model | None, text: str = "text", to: str = "language") -> DataFrame:
    """``df`` with a struct column (lang string, score double): the likeliest learned language of each whole text and its probability
    (0 to 1). ``und`` with 0 for a null text, one without letters, or without a model; ties go to the first language by code point.
    """
    return df.withColumn(to, predict_column(df.sparkSession, model, F.col(text)))


def predict_column(spark, model: Model | None, text: Column) -> Column:
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.predict(t.decode("utf-8", "replace")) for t in text_bytes(batch)]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.StructArray.from_arrays(columns, ["lang", "score"])

    return score(text)
