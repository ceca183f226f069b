import hashlib
import math

import numpy as np
import pytest

from catalink.llm import queries, vector_codes
from catalink.llm.vector_codes import assign, codes, cover_tree, squares
from tests.llm.helpers import clashing

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, parts=4, size=256, rounds=4):
    """rows: (id, vector, label) of one length; plain Python integers."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    out = [["", 0] for _ in kept]
    numbers = []
    for p in range(parts):
        x = np.array([v[p * width : (p + 1) * width] for _, v, _ in kept], object)
        book = [list(v) for v in x[:size]]

        def nearest():
            d = np.stack([((x - np.array(e, object)) ** 2).sum(1) for e in book], 1)
            return [min(range(len(book)), key=lambda j: (row[j], j)) for row in d], d

        for _ in range(rounds):
            found, _ = nearest()
            for e in range(len(book)):
                own = x[[i for i, f in enumerate(found) if f == e]]
                if len(own):
                    book[e] = [int(s) // len(own) for s in own.sum(0)]
        found, d = nearest()
        for i, f in enumerate(found):
            out[i][0] += f"{f:02x}"
            out[i][1] += int(d[i][f])
        numbers += [str(v) for e in book for v in e]
    labels = {}
    for (_, _, label), (_, error) in zip(kept, out):
        labels[label] = labels.get(label, 0) + error
    digest = hashlib.sha256(",".join(numbers).encode()).hexdigest()
    return sorted(((i, code, error, labels[label], digest) for (i, _, label), (code, error) in zip(kept, out)), key=repr)


def found(df, **parameters):
    coded, books = vector_codes.compress(df, **parameters)
    rows = vector_codes.with_label_errors(coded, parameters.get("label", "label")).collect()
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], books.sha256) for r in rows), key=repr)


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted((tuple(r)[:5] for r in queries.op12_vector_codes(spark, sf).collect()), key=repr)
    assert got == brute(rows)


def test_copies_ties_nulls_and_few_entries(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "ROWS", 50)
    draw = np.random.default_rng(2)
    rows = [(i, draw.integers(-2, 3, 8).tolist(), int(i) % 3 or None) for i in range(300)]  # many equal parts and equal distances
    rows += [(1000 + i, [0.25] * 8, 5) for i in range(200)]  # copies
    rows += [(2000, None, 1), (2001, [None] * 8, 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] * 8, 1), (5, [1.0] * 8, 2), (None, [2.0] * 8, None)]
    rows = [(i, v and [x if x is None else float(x) for x in v], label) for i, v, label in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for size in (1, 7, 256):
        assert found(df, size=size) == brute(rows, size=size)
    assert found(clashing(df.withColumnRenamed("label", "kind")).withColumnRenamed("kind", "of"), label="of", size=7) == brute(rows, size=7)


def test_large_components_and_other_lengths(spark):
    draw = np.random.default_rng(4)
    rows = [(i, (draw.standard_normal(4) * 10.0 ** float(draw.integers(0, 4))).tolist(), 0) for i in range(200)]
    got = found(spark.createDataFrame(rows + [(900, [1.0] * 3, 0), (901, [], 1)], SCHEMA), size=20)
    want = brute(rows, size=20)
    digest = want[0][4]
    assert got == sorted(want + [(900, None, None, want[0][3], digest), (901, None, None, None, digest)], key=repr)
    limit = found(spark.createDataFrame([(1, [3e38] * 4, 0), (2, [-3e38] * 4, 0)], SCHEMA), size=1)
    assert limit[0][2] == limit[1][2] == 4 * (1 << 24) ** 2
    assert len(found(spark.createDataFrame([(1, [1.0] * 5, 0)], SCHEMA))) == 1  # no multiple of the parts


def test_no_rows(spark):
    empty = hashlib.sha256(b"").hexdigest()
    coded, books = vector_codes.compress(spark.createDataFrame([], SCHEMA))
    assert coded.count() == 0 and books.sha256 == empty
    assert found(spark.createDataFrame([(1, None, 0)], SCHEMA)) == []
    assert [r[:4] for r in found(spark.createDataFrame([(1, [], 0)], SCHEMA))] == [(1, "00000000", 0, 0)]
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([], SCHEMA), size=300)


@pytest.mark.parametrize("kind", ["normal", "clusters", "line", "one"])
def test_trees_assign_like_an_exhaustive_search(kind):
    draw = np.random.default_rng(7)
    x = {
        "normal": draw.standard_normal((1500, 6)) * 300,
        "clusters": draw.standard_normal((30, 6))[draw.integers(0, 30, 1500)] * 3000 + draw.standard_normal((1500, 6)) * 5,
        "line": np.repeat(np.arange(1500)[:, None], 6, 1),
        "one": np.full((1500, 6), 9),
    }[kind].round().astype(np.int64)
    points, place, weights = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    tree = cover_tree(points, weights)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    for i in range(len(tree.centre)):  # radius, sums and separation of children
        own = tree.order[tree.first[i] : tree.last[i]]
        far = np.sqrt(((points[own] - points[tree.centre[i]]) ** 2).sum(1))
        assert far.max() <= tree.radius[i] + 1e-9 and tree.weight[i] == weights[own].sum()
        assert (tree.total[i] == (points[own] * weights[own, None]).sum(0)).all()
        centres = points[tree.centre[tree.children[i]]]
        if len(centres) > 1:
            assert tree.centre[tree.children[i][0]] == tree.centre[i]
            apart = np.sqrt(squares(centres, centres))
            assert apart[~np.eye(len(centres), dtype=bool)].min() > tree.radius[i] / vector_codes.SHRINK - 1e-9
    entries = x[draw.integers(0, len(x), 40)]
    want = squares(points, entries).argmin(1)
    assert (codes(tree, entries) == want).all()
    sums, counts = np.zeros((40, 6), np.int64), np.zeros(40, np.int64)
    vector_codes.add_sums(tree, entries, sums, counts)
    assert counts.tolist() == [int(weights[want == e].sum()) for e in range(40)]
    assert (sums == [(points[want == e] * weights[want == e, None]).sum(0) for e in range(40)]).all()
    if kind == "clusters":
        assert len(assign(tree, entries)[1][0]) < len(points) / 2  # most points go with their subtree
