"""A stored approximate vector index: cells of k-means, product-quantised residual codes, calibrated once when it is built.

Tables below the index's folder: ``centroids`` and ``codebook`` (what was trained), ``settings`` (how many cells to visit and how many
candidates to score again), ``calibration`` (the units these were measured on), ``entries`` (unit, database, code and vector, partitioned
by a bucket of the database and by cell) and ``filled`` (units of each database in each cell). A search reads codes of the visited cells
only, scores them by distance tables, and reads vectors for the candidates only. New units take the trained tables as they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalink.functions.ranking import ranked, top_k
from catalink.functions.scoring import CELLS, DIGITS, list_matrix, normalised
from catalink.operators.search import block_top_k, vector_search
from catalink.plans.ann import with_cells
from catalink.session import cut
from catalink.sources.stores import BucketTable

RECALL = 0.95
POOL = 50  # candidates at least
TRAINING_UNITS = 50_000
CALIBRATION_UNITS = 256
ENTRIES = 256  # of a part's codebook: a code has one byte for each part
MOST_CELLS = 4_096
PROBES = 200_000  # question and cell pairs sent to every task at most, within the limit on their values
GRAIN = 1 << 30


def sampled(units: DataFrame, salt: str, rows: int, of: int) -> DataFrame:
    """About ``rows`` of ``of`` units, by a hash of their id."""
    return units.filter(F.pmod(F.xxhash64(F.lit(salt), "unit_id"), F.lit(GRAIN)) < F.lit(max(1, GRAIN * rows // max(1, of))))


def part_bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    return [(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]


def by_rows(pick: Callable[[np.ndarray], np.ndarray], x: np.ndarray, width: int) -> np.ndarray:
    """``pick`` of the rows of ``x``, on as many at a time as keep ``width`` numbers a row within CELLS."""
    step = max(1, CELLS // width)
    return np.concatenate([pick(x[at:at + step]) for at in range(0, max(1, len(x)), step)])


def nearest(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    squares = (entries * entries).sum(1)[None, :]
    return by_rows(lambda rows: (squares - 2 * (rows @ entries.T)).argmin(1), x, len(entries))


def residuals(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each unit vector, by the largest cosine, and what is left of it."""
    cells = by_rows(lambda rows: np.argmax(rows @ centroids.T, axis=1), x, len(centroids))
    return cells, x - centroids[cells]


def lloyd(vectors: DataFrame, start: np.ndarray, parts: int, rounds: int, prepare: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Lloyd's method on each of ``parts`` parts of the prepared unit vectors; row e of the result holds entry e of every part.

    A task hands on one sum for each entry and round; the driver holds the entries. Entries without points stay.
    """
    entries = start.copy()
    for _ in range(rounds):
        current = entries

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros(current.shape), np.zeros((len(current), parts), np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = prepare(normalised(list_matrix(pa.chunked_array([batch.column(0)]))))
                    for p, (a, b) in enumerate(part_bounds(current.shape[1], parts)):
                        own = nearest(x[:, a:b], current[:, a:b])
                        np.add.at(sums[:, a:b], own, x[:, a:b])
                        counts[:, p] += np.bincount(own, minlength=len(current))
            found = [(p, int(e), int(counts[e, p]), sums[e, a:b].tolist()) for p, (a, b) in enumerate(part_bounds(current.shape[1], parts)) for e in np.flatnonzero(counts[:, p])]
            columns, kinds = list(zip(*found)) or [[]] * 4, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "entry", "n", "total"])

        added = vectors.mapInArrow(add, "part int, entry int, n bigint, total array<double>").select("part", "entry", "n", F.posexplode("total").alias("at", "total"))
        added = added.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        entries = current.copy()
        starts = [a for a, _ in part_bounds(current.shape[1], parts)]
        for r in added.collect():  # one number for each component of each entry
            entries[r["entry"], starts[r["part"]] + r["at"]] = r["total"] / r["n"]
    return entries


@dataclass(frozen=True)
class CodeKernel:
    """Scores of codes by distance tables: a question's products with the cell's centroid and with each codebook entry are looked up."""

    centroids: np.ndarray
    codebook: np.ndarray
    parts: int

    def __call__(self, questions: pa.Table, units: pa.Table) -> Callable:
        cells = units["cell"].to_numpy()
        codes = np.frombuffer(b"".join(units["code"].to_pylist()), np.uint8).reshape(len(cells), self.parts)
        cuts = part_bounds(self.codebook.shape[1], self.parts)

        def blocks(qi: np.ndarray, ui: np.ndarray):
            step = max(1, CELLS // max(1, len(ui)))
            for start in range(0, len(qi), step):
                part = qi[start:start + step]
                q = normalised(list_matrix(questions["embedding"].take(pa.array(part))))
                scores = np.repeat((q @ self.centroids[cells[ui[0]]])[:, None], len(ui), 1)  # units of one key are of one cell
                for p, (a, b) in enumerate(cuts):
                    scores += (q[:, a:b] @ self.codebook[:, a:b].T)[:, codes[ui, p]]
                yield part, np.round(scores, DIGITS)

        return blocks


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.round(F.when(norms > 0, dot(a, b) / norms).otherwise(0.0), DIGITS)


@dataclass(frozen=True)
class VectorIndex:
    """An index at ``path``. Units are kept by database, like the other stores: replacing a database touches its own entries only."""

    spark: SparkSession
    path: str

    # ---- what was trained

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @cached_property
    def settings(self) -> dict:
        return self._table("settings").first().asDict()

    @cached_property
    def centroids(self) -> np.ndarray:
        return np.array([r["vector"] for r in self._table("centroids").orderBy("place").collect()])

    @cached_property
    def codebook(self) -> np.ndarray:
        return np.array([r["vector"] for r in self._table("codebook").orderBy("place").collect()])

    @classmethod
    def build(
        cls, units: DataFrame, path: str, cells: int | None = None, parts: int | None = None, buckets: int = 1, recall: float = RECALL, k: int = 20,
        training: int = TRAINING_UNITS, calibration: int = CALIBRATION_UNITS,
    ) -> VectorIndex:
        """An index over all ``units`` (unit_id, database_name, embedding) with a vector.

        Trained on about ``training`` units (all, if fewer): ``cells`` centroids, by default about the root of the number of units, and a
        codebook for each of ``parts`` parts, by default of four components. How many cells a search visits and how many candidates
        it scores again is measured once: on about ``calibration`` units asked as questions, against exact search over all units, both
        so that they alone lose no more than half of what the wanted ``recall`` allows for the ``k`` best.
        """
        spark = units.sparkSession
        index = cls(spark, path)
        offered = cut(units.filter(F.size("embedding") > 0).select("unit_id", "database_name", "embedding"), "offered")
        n = offered.count()
        if not n:
            raise ValueError("an index needs at least one vector to be trained on")
        cells = min(n, cells or max(1, min(MOST_CELLS, 2 ** round(math.log2(math.sqrt(n))))))
        sample = cut(sampled(offered, "train", training, n).select("embedding", "unit_id") if n > training else offered.select("embedding", "unit_id"), "training")
        lead = [r["embedding"] for r in sample.orderBy(F.xxhash64("unit_id"), "unit_id").limit(max(cells, ENTRIES)).collect()]  # as many as entries
        lead = normalised(np.array(lead, float))
        cells, vectors = min(cells, len(lead)), sample.select("embedding")
        centroids = normalised(lloyd(vectors, lead[:cells], 1, 10, lambda x: x))
        parts = parts or max(1, lead.shape[1] // 4)
        codebook = lloyd(vectors, residuals(lead[:ENTRIES], centroids)[1], parts, 8, lambda x: residuals(x, centroids)[1])

        def keep(name: str, rows: np.ndarray) -> None:
            spark.createDataFrame(list(enumerate(rows.tolist())), "place int, vector array<double>").write.parquet(f"{path}/{name}")

        keep("centroids", centroids)
        keep("codebook", codebook)
        asked = sampled(offered, "calibrate", calibration, n) if n > calibration else offered
        asked = cut(asked.select(F.col("unit_id").alias("question_id"), "database_name", "embedding"), "calibration")
        asked.select(F.col("question_id").alias("unit_id")).write.parquet(f"{path}/calibration")
        most = 4 * max(10 * k, POOL)
        settings = "dim int, parts int, buckets int, visits int, pool int, units bigint"
        trial = {"dim": lead.shape[1], "parts": parts, "buckets": buckets, "visits": len(centroids), "pool": most, "units": n}
        index.__dict__.update(settings=trial, centroids=centroids, codebook=codebook)
        index._write(index.coded(offered), None)
        index._filled.create(index._counts(index.entries()))

        # Where the exact hits lie: the place of their cell, and their rank by code.
        other = F.col("unit_id") != F.col("question_id")
        exact = vector_search(asked, offered, k + 1).filter(other).select("question_id", "unit_id")
        by_code = ranked(index.candidates(asked).filter(other), ["question_id"], [F.col("score").desc(), F.col("unit_id")], "place")
        exact = cut(exact.join(index.entries().select("unit_id", "cell"), "unit_id"), "exact")
        order = with_cells(asked.join(index._filled_lists(asked), "database_name"), centroids, len(centroids)).select("question_id", "cells")
        cell_place = exact.join(order, "question_id").select(F.array_position("cells", F.col("cell")).cast("int").alias("place"))
        code_place = exact.join(by_code.select("question_id", "unit_id", "place"), ["question_id", "unit_id"], "left").select(F.coalesce("place", F.lit(most)).alias("place"))

        def enough(places: DataFrame, least: int) -> int:
            counted = sorted((r["place"], r["n"]) for r in places.groupBy("place").agg(F.count("*").alias("n")).collect())
            total, held = sum(c for _, c in counted), 0
            for place, c in counted:
                held += c
                if held >= (1 + recall) / 2 * total:
                    return max(least, place)
            return least

        chosen = trial | {"visits": enough(cell_place, 1), "pool": enough(code_place, max(POOL, k))}
        spark.createDataFrame([tuple(chosen.values())], settings).write.parquet(f"{path}/settings")
        index.__dict__["settings"] = chosen
        return index

    # ---- entries

    def coded(self, units: DataFrame) -> DataFrame:
        """Rows of ``entries`` for units with a vector."""
        centroids, codebook, parts = self.centroids, self.codebook, self.settings["parts"]
        schema = T.StructType([units.schema["unit_id"], units.schema["database_name"], units.schema["embedding"]])
        schema.add("cell", T.IntegerType()).add("code", T.BinaryType())

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = normalised(list_matrix(pa.chunked_array([batch.column(2)])))
                    cells, rest = residuals(x, centroids)
                    codes = np.stack([nearest(rest[:, a:b], codebook[:, a:b]) for a, b in part_bounds(x.shape[1], parts)], 1).astype(np.uint8)
                    arrays = [*batch.columns, pa.array(cells.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, schema.names)

        rows = units.filter(F.size("embedding") == self.settings["dim"]).select("unit_id", "database_name", "embedding").mapInArrow(encode, schema)
        return rows.withColumn("bucket", self._bucket())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("database_name"), F.lit(self.settings["buckets"])).cast("int")

    def entries(self) -> DataFrame:
        return self._table("entries").filter(F.col("unit_id").isNotNull())

    @property
    def _filled(self) -> BucketTable:
        return BucketTable(self.spark, f"{self.path}/filled", "database_name", self.settings["buckets"])

    def _counts(self, entries: DataFrame) -> DataFrame:
        return entries.groupBy("database_name", "cell").agg(F.count("*").alias("n"))

    def _filled_lists(self, asked: DataFrame) -> DataFrame:
        """(database_name, filled) of the asked databases: at most a pair for each cell."""
        databases = asked.select("database_name").distinct()
        rows = self._filled.read_for(databases).join(databases, "database_name", "left_semi")
        return rows.groupBy("database_name").agg(F.collect_list(F.struct("cell", "n")).alias("filled"))

    def _write(self, rows: DataFrame, touched: DataFrame | None) -> None:
        """Overwrites the partitions that ``rows`` or ``touched`` (bucket, cell) name; a row without unit empties one."""
        if touched is not None:
            rows = rows.unionByName(touched.select("bucket", "cell").distinct(), allowMissingColumns=True)
        writer = rows.hint("rebalance", "bucket", "cell").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket", "cell").parquet(f"{self.path}/entries")

    def replace(self, fresh: DataFrame, databases: DataFrame) -> None:
        """Everything of ``databases`` (database_name) gives way to ``fresh`` units, without training. Only their cells are rewritten."""
        databases = databases.select("database_name").distinct()
        fresh = cut(self.coded(fresh), "coded")
        before = self._filled.read_for(databases).join(databases, "database_name", "left_semi")
        touched = before.select(self._bucket().alias("bucket"), "cell").unionByName(fresh.select("bucket", "cell")).distinct()
        touched = cut(touched, "touched")
        kept = self.entries().join(touched, ["bucket", "cell"], "left_semi").join(databases, "database_name", "left_anti")
        self._write(kept.unionByName(fresh), touched)
        self._filled.replace(self._counts(fresh), databases)

    # ---- search

    def _probes(self, asked: DataFrame) -> DataFrame:
        """One row for each question and cell to visit: the nearest ones, and more until they hold the pool."""
        near = with_cells(asked.join(self._filled_lists(asked), "database_name"), self.centroids, self.settings["visits"], self.settings["pool"])
        return cut(near.select("question_id", "database_name", "embedding", F.explode("cells").alias("cell")), "probes")

    def _opened(self, probes: DataFrame) -> DataFrame:
        """The entries of the visited partitions; no more than there are cells and buckets come to the driver."""
        visited = probes.select(self._bucket().alias("bucket"), "cell").distinct()
        cells = [r["cell"] for r in visited.select("cell").distinct().collect()]
        buckets = [r["bucket"] for r in visited.select("bucket").distinct().collect()]
        return self.entries().filter(F.col("cell").isin(cells) & F.col("bucket").isin(buckets))

    def candidates(self, questions: DataFrame, probes: DataFrame | None = None) -> DataFrame:
        """(question_id, unit_id, score, rank): the units to score again, by their codes."""
        probes = self._probes(questions) if probes is None else probes
        key = F.concat_ws("#", "database_name", F.col("cell").cast("string")).alias("key")
        kernel = CodeKernel(self.centroids, self.codebook, self.settings["parts"])
        codes = self._opened(probes).select("unit_id", key, "cell", "code")
        return block_top_k(probes.select("question_id", key, "embedding"), codes, kernel, self.settings["pool"], broadcast_questions=PROBES)

    def search(self, questions: DataFrame, k: int) -> DataFrame:
        """(question_id, unit_id, score, rank): about the ``k`` units of the question's database with the largest cosine.

        ``questions``: question_id, database_name, embedding. Scores are exact, ties go to the smaller unit id; questions without a
        vector of the index's length have no hits.
        """
        asked = questions.filter(F.size("embedding") == self.settings["dim"]).select("question_id", "database_name", "embedding")
        probes = self._probes(asked)
        pairs = self.candidates(asked, probes).select("question_id", "unit_id")
        vectors = self._opened(probes).select("unit_id", F.col("embedding").alias("own"))
        scored = pairs.join(asked.select("question_id", "embedding"), "question_id").join(vectors, "unit_id")
        hits = scored.select("question_id", "unit_id", cosine(F.col("embedding"), F.col("own")).alias("score"))
        return top_k(hits, ["question_id"], [F.col("score").desc(), F.col("unit_id")], k)
