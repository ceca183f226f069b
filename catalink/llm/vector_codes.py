"""Vector code compression: product codebooks by Lloyd's method over cover trees.

Vectors are cut into parts, and each part position has a codebook. A block of a partition's vectors has a cover tree for each part, built
once, whose nodes hold the sum and number of the points below them. A round walks the trees: a node so near to one entry that by the
triangle inequality no other can be nearest to any point below it goes to that entry as a whole; only the other nodes are opened, and only
the points of open leaves are compared one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalink.llm.common import Scratch
from catalink.session import spread

UNITS = 1024  # integer steps in 1.0
LIMIT = 1 << 24  # of integer components, so that all sums of squares and errors are exact
ROWS, BYTES = 2048, 16 << 20  # of a block, at most
LEAF = 32  # distinct points of a node that has no children
SHRINK = 1.3  # from a node's radius to that of its children
EXACT = 1 << 53  # integers below it are exact as doubles


def bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    return [(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]


def integers(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(UNITS * np.clip(x, -LIMIT, LIMIT)), -LIMIT, LIMIT).astype(np.int64)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all ``entries``."""
    if not x.size or not entries.size:
        return np.zeros((len(x), len(entries)))
    most = int(np.abs(x).max()) + int(np.abs(entries).max())
    if x.shape[1] * most * most < EXACT // 2:
        a, b = x.astype(float), entries.astype(float)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)


@dataclass
class CoverTree:
    """Nodes as parallel arrays; the points below a node are ``order[first:last]`` of the distinct points.

    Children of a node have centres that are further apart than the radius they may have, the first one is its own centre, and together
    they hold all its points. ``total`` and ``weight`` are the sum and number of the points below, repeated ones included.
    """

    points: np.ndarray
    weights: np.ndarray
    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    children: list[list[int]]
    total: np.ndarray
    weight: np.ndarray


def cover_tree(points: np.ndarray, weights: np.ndarray) -> CoverTree:
    """The tree of distinct points, from the top down."""
    centres, radii, firsts, lasts, children = [], [], [], [], []
    order = np.zeros(len(points), np.int64)

    def node(members: np.ndarray, far: np.ndarray, at: int) -> int:
        """A node whose centre is the first member; far: the members' distances to it."""
        order[at : at + len(members)] = members
        centres.append(members[0])
        radii.append(far.max())
        firsts.append(at)
        lasts.append(at + len(members))
        children.append([])
        return len(centres) - 1

    def distances(centre: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(((points[members] - points[centre]) ** 2).sum(1).astype(float))

    everything = np.arange(len(points))
    open_ = [(node(everything, distances(0, everything), 0), everything, distances(0, everything))]
    while open_:
        parent, members, far = open_.pop()
        if len(members) <= LEAF:
            continue
        reach, at = radii[parent] / SHRINK, firsts[parent]
        while len(members):
            inside = far <= reach
            own, own_far = members[inside], far[inside]
            child = node(own, own_far, at)
            children[parent].append(child)
            open_.append((child, own, own_far))
            at += len(own)
            members = members[~inside]
            if len(members):
                far = distances(members[0], members)
    first, last = np.array(firsts), np.array(lasts)
    sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order] * weights[order, None], 0)])
    counts = np.concatenate([[0], np.cumsum(weights[order])])
    return CoverTree(
        points, weights, order, np.array(centres), np.array(radii), first, last, children, sums[last] - sums[first], counts[last] - counts[first]
    )


def assign(tree: CoverTree, entries: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray]]:
    """((nodes, their entry), ...) of whole subtrees and (points, their entry) of the others, exact with ties to the lower index."""
    whole: list[tuple[np.ndarray, np.ndarray]] = []
    left: list[np.ndarray] = []
    active = np.zeros(min(1, len(tree.points)), np.int64)
    while len(active):
        apart = squares(tree.points[tree.centre[active]], entries)
        best = apart.argmin(1)
        radius = tree.radius[active]
        if len(entries) > 1:
            two = np.sqrt(np.partition(apart, 1, axis=1)[:, :2].astype(float))
            sure = two[:, 1] - two[:, 0] - 2 * radius > 1e-6 + 1e-9 * two[:, 1]  # beyond any rounding
        else:
            sure = np.ones(len(active), bool)
        sure |= radius == 0  # one point, compared exactly
        whole.append((active[sure], best[sure]))
        following: list[int] = []
        for i in active[~sure].tolist():
            if tree.children[i]:
                following += tree.children[i]
            else:
                left.append(tree.order[tree.first[i] : tree.last[i]])
        active = np.array(following, np.int64)
    rest = np.concatenate([*left, np.zeros(0, np.int64)]).astype(np.int64)
    nearest = [squares(tree.points[rest[i : i + ROWS]], entries).argmin(1) for i in range(0, len(rest), ROWS)]
    return whole, (rest, np.concatenate([*nearest, np.zeros(0, np.int64)]).astype(np.int64))


def add_sums(tree: CoverTree, entries: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Adds the points of each entry: whole subtrees by their cumulative sums."""
    whole, (points, nearest) = assign(tree, entries)
    for nodes, entry in whole:
        np.add.at(sums, entry, tree.total[nodes])
        np.add.at(counts, entry, tree.weight[nodes])
    np.add.at(sums, nearest, tree.points[points] * tree.weights[points, None])
    np.add.at(counts, nearest, tree.weights[points])


def codes(tree: CoverTree, entries: np.ndarray) -> np.ndarray:
    """The entry of each distinct point."""
    out = np.zeros(len(tree.points), np.int64)
    whole, (points, nearest) = assign(tree, entries)
    for nodes, entry in whole:
        for i, e in zip(nodes.tolist(), entry.tolist()):
            out[tree.order[tree.first[i] : tree.last[i]]] = e
    out[points] = nearest
    return out


def _packed(tree: CoverTree, place: np.ndarray) -> list[bytes]:
    """The tree as byte strings, with the distinct point of each row of the block."""
    sizes = np.array([len(c) for c in tree.children], np.int64)
    flat = np.array([c for own in tree.children for c in own], np.int64)
    arrays = (tree.points, tree.weights, tree.order, tree.centre, tree.first, tree.last, sizes, flat, tree.total, tree.weight, place)
    return [tree.radius.astype(np.float64).tobytes(), *(np.ascontiguousarray(a, np.int64).tobytes() for a in arrays)]


def _unpacked(packed: list[bytes], width: int) -> tuple[CoverTree, np.ndarray]:
    points, weights, order, centre, first, last, sizes, flat, total, weight, place = (np.frombuffer(p, np.int64) for p in packed[1:])
    ends = np.cumsum(sizes).tolist()
    children = [flat[e - s : e].tolist() for s, e in zip(sizes.tolist(), ends)]
    n = len(weights)
    return CoverTree(
        points.reshape(n, width), weights, order, centre, np.frombuffer(packed[0], float), first, last, children,
        total.reshape(len(centre), width), weight,
    ), place


def _build(dim: int, parts: int, schema: T.StructType):
    """From rows (key, label, vector) to blocks (keys, labels, trees)."""
    most = max(1, min(ROWS, BYTES // (8 * max(1, dim))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                piece = batch.slice(at, most)
                x = integers(np.asarray(piece.column(2).flatten()).reshape(len(piece.column(2)), dim))
                trees = []
                for a, b in bounds(dim, parts):
                    distinct, place, weights = np.unique(x[:, a:b], axis=0, return_inverse=True, return_counts=True) if b > a else (
                        np.zeros((1, 0), np.int64), np.zeros(len(x), np.int64), np.array([len(x)]))
                    trees.append(_packed(cover_tree(distinct, weights), place.reshape(-1)))
                columns = [pa.array([piece.column(i).to_pylist()], pa.list_(piece.column(i).type)) for i in (0, 1)]
                columns.append(pa.array([trees], pa.list_(pa.list_(pa.binary()))))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return run


def _books(entries: np.ndarray, parts: int) -> list[np.ndarray]:
    return [entries[:, a:b] for a, b in bounds(entries.shape[1], parts)]


def _sums(entries: np.ndarray, parts: int):
    """From blocks to (part, entry, n, total): what a task's blocks add to each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _books(entries, parts)
        sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for trees in batch.column(0):
                for part, packed in enumerate(trees.as_py()):
                    tree, _ = _unpacked(packed, books[part].shape[1])
                    add_sums(tree, books[part], sums[part], counts[part])
        found = [(p, int(e), int(counts[p][e]), sums[p][e].tolist()) for p in range(parts) for e in np.flatnonzero(counts[p])]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        columns = list(zip(*found)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "entry", "n", "total"])

    return run


def _coded(entries: np.ndarray, parts: int, schema: T.StructType):
    """From blocks to (key, label, code, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _books(entries, parts)
        for batch in batches:
            for row in range(batch.num_rows):
                keys, labels = batch.column(0)[row].values, batch.column(1)[row].values
                found, error = [], np.zeros(len(keys), np.int64)
                for part, packed in enumerate(batch.column(2)[row].as_py()):
                    tree, place = _unpacked(packed, books[part].shape[1])
                    code = codes(tree, books[part])
                    error += (((tree.points - books[part][code]) ** 2).sum(1))[place]
                    found.append(code[place].tolist())
                text = ["".join(map("{:02x}".format, c)) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays([keys, labels, pa.array(text, pa.string()), pa.array(error)], schema.names)

    return run


@dataclass(frozen=True)
class Codebooks:
    """``entries``: row e holds entry e of every part, one behind the other."""

    entries: np.ndarray
    parts: int

    @property
    def sha256(self) -> str:
        numbers = ",".join(str(v) for book in _books(self.entries, self.parts) for entry in book.tolist() for v in entry)
        return hashlib.sha256(numbers.encode()).hexdigest()


def compress(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, size: int = 256, rounds: int = 4
) -> tuple[DataFrame, Codebooks]:
    """(key, label, code, error) of every usable row, and the codebooks.

    Rows whose vector is null or holds null or non-finite components are left out. A component x becomes the integer floor(1024 * x),
    beyond 2**24 that limit. The codebooks, ``size`` entries at most, start as the vectors of the smallest keys (null keys last, ties to the
    least vector, repeated keys as often as they are) and go through ``rounds`` rounds of Lloyd's method in integers: nearest entry by
    squared distance, ties to the lower index, then floor(sum / count); entries without points stay. ``code`` holds two hex digits for each
    part's entry, ``error`` is the sum of the squared distances.

    Vectors have the length of the one with the smallest key; others get a null code and error. A length that parts do not divide is
    cut as evenly as may be. An empty table gives an empty result; extra columns are ignored. Trees belong to blocks of at most ROWS rows
    and BYTES bytes; per round a task hands on one sum for each entry, and only the codebooks reach the driver.
    """
    if not 0 < size <= 256:
        raise ValueError("two hex digits name at most 256 entries")
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vector").isNotNull() & sound)
    order = [F.col("key").asc_nulls_last(), "vector"]
    lead = rows.orderBy(*order).select(F.size("vector").alias("dim")).first()
    dim = 0 if lead is None else lead["dim"]
    alike = rows.filter(F.size("vector") == dim)
    lowest = [r["vector"] for r in alike.orderBy(*order).limit(size).collect()]  # at most 256 vectors
    entries = integers(np.array(lowest, float).reshape(len(lowest), dim))

    kinds = {c: rows.schema[c].dataType for c in ("key", "label")}
    packed = T.StructType([T.StructField(f"{c}s", T.ArrayType(kinds[c])) for c in kinds])
    packed.add("trees", T.ArrayType(T.ArrayType(T.BinaryType())))
    blocks = scratch.write(spread(alike).mapInArrow(_build(dim, parts, packed), packed), "trees")
    for _ in range(rounds if len(entries) else 0):
        added = blocks.select("trees").mapInArrow(_sums(entries, parts), "part int, entry int, n bigint, total array<bigint>")
        added = added.select("part", "entry", "n", F.posexplode("total").alias("at", "total"))
        added = added.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        starts = [a for a, _ in bounds(dim, parts)]
        following = entries.copy()
        for r in added.collect():  # the codebooks: one number for each component of each entry
            following[r["entry"], starts[r["part"]] + r["at"]] = r["total"] // r["n"]
        entries = following
    coded = T.StructType([T.StructField("key", kinds["key"]), T.StructField("label", kinds["label"])])
    coded.add("code", T.StringType()).add("error", T.LongType())
    done = blocks.mapInArrow(_coded(entries, parts, coded), coded)
    unlike = rows.filter(F.size("vector") != dim).select("key", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    out = scratch.write(done.unionByName(unlike), "codes")
    scratch.drop(blocks)
    return out.select(F.col("key").alias(key), F.col("label").alias(label), "code", "error"), Codebooks(entries, parts)


def with_label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with ``label_error``, the error of all rows of the row's label; rows without label count together."""
    sums = coded.groupBy(F.col(label).alias("__label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col(label).eqNullSafe(F.col("__label")), "left").drop("__label")
