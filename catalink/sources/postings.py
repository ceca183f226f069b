"""A stored inverted index: postings in blocks, each with its largest gain, and a top-k that skips the blocks which cannot enter.

The units of a database are dealt into slots of about BLOCK units of like length. A row of ``postings`` is one term in one slot: the BM25
gains of the slot's units that hold the term, how many they are, and the largest. Gains depend on the average length in the database, so a
database is replaced as a whole. Its slots' bounds decide what a search reads: a slot whose best possible score is below the k-th score
found in the most promising slots holds none of the k best units.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalink.functions.ranking import top_k
from catalink.functions.scoring import B, DIGITS, K1
from catalink.functions.text import tokens
from catalink.operators.search import DEFAULT_LIMIT, VOCABULARY_BROADCAST, _tables_only
from catalink.session import cut, grown, sent
from catalink.sources.stores import BucketTable

BLOCK = 32  # units of a slot, on average
FIRST = 4  # slots of each question that are read first
SLACK = 1e-8  # scores are rounded to nine digits


@dataclass(frozen=True)
class PostingsIndex:
    """An index at ``path``, in the same kind of buckets as the other stores."""

    spark: SparkSession
    path: str
    buckets: int | None = None

    @property
    def postings(self) -> BucketTable:
        return BucketTable(self.spark, f"{self.path}/postings", "database_name", self.buckets, ("term", "slot"))

    @property
    def totals(self) -> BucketTable:
        return BucketTable(self.spark, f"{self.path}/totals", "database_name", self.buckets)

    # ---- upkeep

    def replace(self, units: DataFrame, databases: DataFrame | None = None, text: Column | None = None) -> None:
        """Everything of ``databases`` (database_name; by default those of ``units``) gives way to ``units``.

        ``units``: unit_id, database_name and the searched ``text``, by default the table name, schema name and content together.
        Only the buckets of these databases are rewritten.
        """
        body = text if text is not None else F.concat_ws(" ", "table_name", "schema_name", "content")
        words = F.coalesce(tokens(body), F.array().cast("array<string>"))
        held = _tables_only(units).select("unit_id", "database_name", words.alias("words")).withColumn("length", F.size("words"))
        # Slots of units of like length, so that their gains are alike; dealt by a hash, counted with partial sums.
        held = cut(held.withColumn("class", F.floor(F.log2(F.col("length") + 1.0) * 4).cast("long")), "held")
        if databases is None:
            databases = held.select("database_name")
        databases = cut(databases.select("database_name").distinct(), "databases")
        sizes = held.groupBy("database_name", "class").agg(F.ceil(F.count("*") / BLOCK).alias("slots"))
        totals = held.groupBy("database_name").agg(F.count("*").alias("units"), (F.sum("length") / F.count("*")).alias("mean_length"))
        totals = cut(totals, "totals")
        # Joined as one table by database and class: the units of a large database never meet in one task.
        places = cut(sizes.join(grown(totals), "database_name"), "places")
        slot = F.shiftleft("class", 32) + F.pmod(F.xxhash64("unit_id"), F.col("slots"))
        placed = held.join(sent(places), ["database_name", "class"])
        share = 1 - B + B * F.col("length") / F.when(F.col("mean_length") > 0, F.col("mean_length")).otherwise(1.0)
        terms = placed.select("database_name", "unit_id", slot.alias("slot"), share.alias("share"), F.explode("words").alias("term"))
        counted = terms.groupBy("database_name", "term", "slot", "unit_id", "share").agg(F.count("*").alias("times"))
        gain = F.col("times") * (K1 + 1) / (F.col("times") + K1 * F.col("share"))
        blocks = counted.select("database_name", "term", "slot", "unit_id", gain.alias("gain")).groupBy("database_name", "term", "slot").agg(
            F.max("gain").alias("largest"), F.count("*").cast("int").alias("n"), F.collect_list(F.struct("unit_id", "gain")).alias("entries")
        )
        self.postings.replace(blocks, databases)
        self.totals.replace(totals, databases)

    def delete(self, databases: DataFrame) -> None:
        self.postings.delete(databases)
        self.totals.delete(databases)

    # ---- search

    def _weights(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(question_id, database_name, term, idf) of the asked terms, and the headers of their blocks."""
        asked = questions.select("question_id", "database_name", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))
        asked = cut(asked, "asked")
        headers = self.postings.read_for(asked).select("database_name", "term", "slot", "largest", "n")
        vocabulary = cut(asked.select("database_name", "term").distinct(), "vocabulary")
        headers = headers.join(sent(vocabulary, VOCABULARY_BROADCAST), ["database_name", "term"], "left_semi")
        headers = cut(headers, "headers")
        frequencies = headers.groupBy("database_name", "term").agg(F.sum("n").alias("df"))
        totals = self.totals.read_for(asked).select("database_name", "units")
        idf = F.log(1 + (F.col("units") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = frequencies.join(grown(totals), "database_name").select("database_name", "term", idf.alias("idf"))
        return cut(asked.join(grown(weights), ["database_name", "term"]), "weights"), headers

    def _scores(self, weights: DataFrame, slots: DataFrame) -> DataFrame:
        """(question_id, unit_id, score) of the units in the (question_id, slot) rows."""
        wanted = slots.select("question_id", "slot").join(sent(weights, VOCABULARY_BROADCAST), "question_id")
        entries = self.postings.read_for(weights).select("database_name", "term", "slot", "entries")
        vocabulary = weights.select("database_name", "term").distinct()  # blocks of other terms are not shuffled
        entries = entries.join(sent(vocabulary, VOCABULARY_BROADCAST), ["database_name", "term"], "left_semi")
        met = wanted.join(grown(entries), ["database_name", "term", "slot"]).select("question_id", "idf", F.explode("entries").alias("e"))
        scored = met.groupBy("question_id", F.col("e.unit_id").alias("unit_id")).agg(F.sum(F.col("idf") * F.col("e.gain")).alias("score"))
        return scored.withColumn("score", F.round("score", DIGITS))

    def _stages(self, questions: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Bounds of all slots that hold any term, the slots read first, their scores, and the slots that could still enter."""
        weights, headers = self._weights(questions)
        bounds = headers.select("database_name", "term", "slot", "largest").join(sent(weights, VOCABULARY_BROADCAST), ["database_name", "term"])
        bounds = cut(bounds.groupBy("question_id", "slot").agg(F.sum(F.col("idf") * F.col("largest")).alias("bound")), "bounds")
        first = cut(top_k(bounds, ["question_id"], [F.col("bound").desc(), F.col("slot")], max(FIRST, -(-2 * k // BLOCK))), "first")
        found = cut(self._scores(weights, first), "found")
        last = top_k(found, ["question_id"], [F.col("score").desc(), F.col("unit_id")], k).filter(F.col("rank") == k)
        floors = last.select("question_id", F.col("score").alias("floor"))
        open_ = bounds.join(first.select("question_id", "slot"), ["question_id", "slot"], "left_anti").join(floors, "question_id", "left")
        open_ = cut(open_.filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK)), "open")
        return weights, bounds, found, open_

    def search(self, questions: DataFrame, k: int = DEFAULT_LIMIT) -> DataFrame:
        """BM25 top-k, equal to ``operators.search.keyword_search`` over the stored units: question_id, unit_id, score, rank.

        ``questions``: question_id, database_name, question.
        """
        weights, _, found, open_ = self._stages(questions, k)
        hits = found.unionByName(self._scores(weights, open_)).filter(F.col("score") > 0)
        return top_k(hits, ["question_id"], [F.col("score").desc(), F.col("unit_id")], k)

    def skipped(self, questions: DataFrame, k: int = DEFAULT_LIMIT) -> tuple[int, int]:
        """How many of all (question, slot) pairs with any term a search leaves unread, and how many there are."""
        _, bounds, _, open_ = self._stages(questions, k)
        first = max(FIRST, -(-2 * k // BLOCK))
        read = bounds.groupBy("question_id").agg(F.least(F.count("*"), F.lit(first)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        total = bounds.count()
        return total - read - open_.count(), total
