"""Approximate vector search: k-means cells, as many of the nearest ones as a recall target asks for, then exact scoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalink.functions.ranking import top_k
from catalink.functions.scoring import CELLS as SCORES
from catalink.functions.scoring import list_matrix, normalised
from catalink.operators.search import vector_search
from catalink.session import cut

CELLS = 128
RECALL = 0.95
CALIBRATION_QUESTIONS = 400
SEED = 42


def train_cells(units: DataFrame, cells: int) -> np.ndarray:
    """Unit-length centroids, trained on all units; a single cell holds every unit and needs no training."""
    if cells == 1:
        return normalised(np.ones((1, len(units.first()["embedding"]))))
    points = units.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=SEED, maxIter=10, distanceMeasure="cosine").fit(points)
    return normalised(np.array(model.clusterCenters()))


def with_cells(df: DataFrame, centroids: np.ndarray, visits: int | None = None, k: int = 0) -> DataFrame:
    """``cells``: the nearest cell of each row's vector, or, given ``visits``, that many of the nearest, and more until they hold ``k``.

    For the latter the rows carry ``filled``, the (cell, n) pairs of their database; empty cells are not visited.
    """
    keep = [c for c in df.columns if c != "filled"]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("cells", T.ArrayType(T.IntegerType()))])
    sent = df.sparkSession.sparkContext.broadcast(centroids)
    step = max(1, SCORES // len(centroids))  # rows at a time

    def visited(batch: pa.RecordBatch, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        filled = batch.column(batch.schema.get_field_index("filled"))
        pairs, sizes = filled.flatten(), np.diff(filled.offsets.to_numpy())
        held = np.zeros(order.shape, dtype=np.int64)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        held[rows, pairs.field("cell").to_numpy()] = pairs.field("n").to_numpy()
        held = np.take_along_axis(held, order, axis=1)
        seen, found = np.cumsum(held > 0, axis=1), np.cumsum(held, axis=1)
        return np.nonzero((held > 0) & ((seen <= visits) | (found - held < k)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            matrix = normalised(list_matrix(pa.chunked_array([batch.column(batch.schema.get_field_index("embedding"))])))
            order = np.argsort(-(matrix @ sent.value.T), axis=1, kind="stable")
            if visits is None:
                rows, places = np.arange(len(order)), np.zeros(len(order), dtype=np.int64)
            else:
                rows, places = visited(batch, order)
            offsets = np.searchsorted(rows, np.arange(len(order) + 1)).astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(offsets), pa.array(order[rows, places].astype(np.int32)))
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, cells], names=[*keep, "cells"])

    return df.mapInArrow(assign, schema)


def needed_visits(asked: DataFrame, offered: DataFrame, placed: DataFrame, filled: DataFrame, centroids: np.ndarray, k: int, recall: float, sample: int) -> int:
    """The least number of nearest cells that hold the share ``recall`` of the exact hits of ``sample`` questions.

    The questions are those with the least hash of their id, so that all others are held out. What comes to the driver is one count per
    cell.
    """
    tried = cut(asked.orderBy(F.xxhash64("question_id"), "question_id").limit(sample), "calibration")
    hits = vector_search(tried, offered, k).join(placed.select("unit_id", "cell"), "unit_id").select("question_id", "cell")
    order = with_cells(tried.join(filled, "database_name"), centroids, len(centroids)).select("question_id", "cells")
    places = hits.join(order, "question_id").groupBy(F.array_position("cells", F.col("cell")).alias("place")).agg(F.count(F.lit(1)).alias("n"))
    counted = sorted((r["place"], r["n"]) for r in places.collect())
    total, held = sum(n for _, n in counted), 0
    for place, n in counted:
        held += n
        if held >= recall * total:
            return int(place)
    return 1


def approximate_search(
    questions: DataFrame, units: DataFrame, k: int, cells: int = CELLS, recall: float = RECALL, calibration: int = CALIBRATION_QUESTIONS
) -> DataFrame:
    """Cosine top-k of each question among the units of its nearest ``cells``; one cell is the exact search.

    The units are divided into ``cells`` cells by k-means over all of them; the centroids, ``cells`` vectors, go to every task, so choose
    about the root of the number of units as long as these fit. How many cells are visited follows from the ``recall`` wanted, measured
    against exact search on ``calibration`` questions. Empty cells do not count, and cells are visited until they hold ``k`` units. The
    units of the visited cells are scored with the same block kernel as the full search, keyed by database and cell.
    """
    has_vector = F.size("embedding") > 0
    offered = units.filter(has_vector).select("unit_id", "database_name", "embedding")
    asked = questions.filter(has_vector).select("question_id", "database_name", "embedding")
    if offered.isEmpty():
        return vector_search(questions, units, k)  # no unit, no cell and no hit
    centroids = train_cells(offered, cells)

    def key(cell: str):
        return F.concat_ws("#", "database_name", F.col(cell).cast("string"))

    placed = cut(with_cells(offered, centroids).withColumn("cell", F.col("cells")[0]).drop("cells"), "cells")
    # At most ``cells`` pairs per database.
    filled = (
        placed.groupBy("database_name", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("database_name")
        .agg(F.collect_list(F.struct("cell", "n")).alias("filled"))
    )
    filled = cut(filled, "filled")
    visits = needed_visits(asked, offered, placed, filled, centroids, k, recall, calibration)
    # One row per question and visited cell; its id names both, so that the block search ranks each cell on its own.
    probes = cut(
        with_cells(asked.join(filled, "database_name"), centroids, visits, k)
        .select("question_id", "database_name", "embedding", F.explode("cells").alias("cell"))
        .select(F.struct("question_id", "cell").alias("probe"), key("cell").alias("database_name"), "embedding"),
        "probes",
    )
    flat = probes.withColumn("question_id", F.to_json("probe"))
    hits = vector_search(
        flat, placed.select("unit_id", key("cell").alias("database_name"), "embedding"), k
    )
    kind = asked.schema["question_id"].dataType.simpleString()
    back = hits.select(
        F.from_json("question_id", f"question_id {kind}, cell int")["question_id"].alias("question_id"), "unit_id", "score"
    )
    return top_k(back, ["question_id"], [F.col("score").desc(), F.col("unit_id")], k)
