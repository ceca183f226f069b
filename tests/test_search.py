import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalink.operators import search
from catalink.plans import ann
from catalink.plans.retrieval import retrieve
from catalink.operators import embedding as emb
from catalink.operators import documents as docs
from catalink.operators import graph
from tests.conftest import SMALL
from workload.search_queries import corpus_questions, corpus_texts, corpus_vectors

WORDS = "film actor rental store staff city payment customer category language".split()

# Tiny blocks: every key is split several times, and no question set is small enough to be sent along.
SPLIT = {"broadcast_questions": 0, "unit_block": 7, "question_block": 3}
PACKED = {"broadcast_questions": 0}


@pytest.fixture(scope="module")
def world():
    """A third of all units sit in one database, ties included."""
    rng = random.Random(7)
    units, questions = [], []
    for i in range(150):
        db = "hot" if i % 3 == 0 else f"db{i % 7}"
        text = " ".join(rng.choices(WORDS, k=rng.randint(1, 12)))
        units.append((f"u{i:03d}", db, text, [float(rng.randint(-2, 2)) + 0.5 for _ in range(4)]))
    for i in range(40):
        db = "hot" if i % 2 == 0 else f"db{i % 9}"
        questions.append((i, db, " ".join(rng.choices(WORDS, k=3)), [float(rng.randint(-2, 2)) + 0.5 for _ in range(4)]))
    return units, questions


@pytest.fixture(scope="module")
def frames(spark, world):
    units, questions = world
    return (
        spark.createDataFrame(units, "unit_id string, database_name string, text string, embedding array<float>"),
        spark.createDataFrame(questions, "question_id long, database_name string, question string, embedding array<float>"),
    )


def by_rank(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.question_id, []).append((r["rank"], r.unit_id))
    return {q: [u for _, u in sorted(hits)] for q, hits in out.items()}


def best(scores, k):
    return [u for u, _ in sorted(scores.items(), key=lambda kv: (-round(kv[1], 9), kv[0]))[:k]]


def brute_vector(units, questions, k):
    out = {}
    for q, db, _, qv in questions:
        scores = {u: float(np.dot(qv, v) / np.linalg.norm(qv) / np.linalg.norm(v)) for u, d, _, v in units if d == db}
        if scores:
            out[q] = best(scores, k)
    return out


def brute_bm25(units, questions, k):
    out = {}
    for q, db, text, _ in questions:
        docs_ = {u: re.findall(r"\w+", t) for u, d, t, _ in units if d == db}
        if not docs_:
            continue
        n, avgdl = len(docs_), sum(map(len, docs_.values())) / len(docs_)
        scores = {}
        for term in set(text.split()):
            df = sum(term in words for words in docs_.values())
            for u, words in docs_.items():
                tf = words.count(term)
                if tf:
                    gain = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avgdl))
                    scores[u] = scores.get(u, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * gain
        if scores:
            out[q] = best(scores, k)
    return out


@pytest.mark.parametrize("blocks", [{}, PACKED, SPLIT])
def test_vector_search_is_exact_on_every_path(frames, world, blocks):
    units, questions = frames
    assert by_rank(search.vector_search(questions, units, 6, **blocks)) == brute_vector(*world, 6)


@pytest.mark.parametrize("blocks", [{}, PACKED, SPLIT])
def test_keyword_search_is_exact_on_every_path(frames, world, blocks):
    units, questions = frames
    assert by_rank(search.keyword_search(questions, units, 6, F.col("text"), **blocks)) == brute_bm25(*world, 6)


def test_large_vocabulary_path_gives_the_same_terms(frames, monkeypatch):
    units, questions = frames
    want = by_rank(search.keyword_search(questions, units, 4, F.col("text")))
    monkeypatch.setattr(search, "VOCABULARY_BROADCAST", 0)
    assert by_rank(search.keyword_search(questions, units, 4, F.col("text"))) == want


def test_partitioning_does_not_change_hits(frames):
    units, questions = frames
    want = by_rank(search.vector_search(questions, units, 5))
    assert by_rank(search.vector_search(questions.repartition(5), units.repartition(13), 5)) == want


def test_rows_without_vectors_and_other_unit_types_take_no_part(spark, frames):
    units, questions = frames
    other = units.limit(40).withColumn("unit_id", F.concat(F.lit("x"), "unit_id")).withColumn("type", F.lit("column"))
    empty = units.limit(10).withColumn("unit_id", F.concat(F.lit("e"), "unit_id")).withColumn("embedding", F.array().cast("array<float>"))
    mixed = units.unionByName(empty).withColumn("type", F.lit("table")).unionByName(other)
    assert by_rank(search.vector_search(questions, mixed, 5)) == by_rank(search.vector_search(questions, units, 5))


@pytest.mark.parametrize("sf", [SMALL, "/root/testdata/sf0.01"])
def test_ann_recall(spark, sf):
    questions, vectors = corpus_questions(spark, sf), corpus_vectors(spark, sf)
    exact, near = by_rank(search.vector_search(questions, vectors, 10)), by_rank(ann.approximate_search(questions, vectors, 10))
    assert all(len(near[q]) == 10 for q in exact)
    recall = sum(len(set(exact[q]) & set(near[q])) for q in exact) / sum(map(len, exact.values()))
    assert recall >= 0.9


def test_ann_with_one_cell_is_exact(spark):
    questions, vectors = corpus_questions(spark, SMALL), corpus_vectors(spark, SMALL)
    assert by_rank(ann.approximate_search(questions, vectors, 5, cells=1)) == by_rank(search.vector_search(questions, vectors, 5))


def test_long_texts_are_searched_whole(spark):
    questions, texts = corpus_questions(spark, SMALL), corpus_texts(spark, SMALL)
    tail = spark.createDataFrame([(10**9, "corpus", "filler " * 30000 + "zyzzyva")], texts.schema)
    asked = questions.limit(1).withColumn("question", F.lit("zyzzyva"))
    hit = search.keyword_search(asked, texts.unionByName(tail), 5, F.col("text")).collect()
    assert [r.unit_id for r in hit] == [10**9]


def test_fusion_scores_and_tie_order(spark):
    schema = "question_id long, unit_id string, rank int"
    vector = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], schema)
    keyword = spark.createDataFrame([(1, "z", 1), (1, "c", 2), (1, "y", 3)], schema)
    fused = {r.unit_id: r for r in search.fuse(vector, keyword, 5).collect()}
    assert [u for u, r in sorted(fused.items(), key=lambda kv: kv[1].hybrid_rank)] == ["c", "a", "z", "b", "y"]
    assert fused["c"].rrf == 1 / 63 + 1 / 62 and fused["a"].rrf == fused["z"].rrf == 1 / 61


@pytest.mark.parametrize("value,expected", [(None, 5), (0.0, 5), (-3.0, 5), (float("nan"), 5), (float("inf"), 5), (7.9, 7), (50.0, 20)])
def test_limits(spark, value, expected):
    row = search.with_limits(spark.createDataFrame([(value,)], "limit double")).first()
    assert (row.final_limit, row.candidate_limit) == (expected, max(15, expected))


def hybrid_df(spark, rows):
    return spark.createDataFrame(
        rows, "question_id long, unit_id string, source_id string, database_name string, schema_name string, table_name string, "
        "vector_rank int, keyword_rank int, rrf double, hybrid_rank int")


EXPANSION = (
    "question_id long, node_id string, database_name string, schema_name string, table_name string, distance int, graph_rank int, "
    "seed_hybrid_score double"
)


def test_seeds_skip_incomplete_rows_and_repeats(spark):
    rows = [
        (1, "u1", None, "d", "s", "t1", 1, None, 0.9, 1),
        (1, "u2", "x", "d", None, "t2", 2, None, 0.8, 2),
        (1, "u3", "x", "d", "public", "t2", 3, None, 0.7, 3),
        (1, "u4", "x", "d", "s", None, 4, None, 0.6, 4),
        (1, "u5", "x", "d", "s", "t5", 5, None, 0.5, 5),
        (1, "u6", "x", "d", "s", "t6", 6, None, 0.4, 6),
        (1, "u7", "x", "d", "s", "t7", 7, None, 0.3, 7),
    ]
    seeds = sorted((r.hybrid_rank, r.schema_name, r.table_name, r.hybrid_score) for r in search.graph_seeds(hybrid_df(spark, rows)).collect())
    assert seeds == [(2, "public", "t2", 0.8), (5, "s", "t5", 0.5), (6, "s", "t6", 0.4)]


def test_boost_candidates_and_final_rank(spark):
    hybrid = hybrid_df(spark, [
        (1, "u1", "x", "d", None, "a", 1, 1, 2 / 61, 1),
        (1, "u2", "x", "d", "public", "b", 2, None, 1 / 62, 2),
        (1, "u3", "x", "d", "public", "c", 3, None, 1 / 63, 3),
    ])
    expansion = spark.createDataFrame([
        (1, "d.public.a", "d", "public", "a", 0, 1, 2 / 61),
        (1, "d.public.b", "d", "public", "b", 1, 2, 2 / 61),
        (1, "d.public.n", "d", "public", "n", 1, 3, 2 / 61),
        (1, "d.public.m", "d", "public", "m", 2, 4, 0.0001),
        (1, "d.public.unknown", "d", "public", "unknown", 2, 5, 2 / 61),
    ], EXPANSION)
    units = spark.createDataFrame(
        [("u1", "x", "d", None, "a"), ("u2", "x", "d", "public", "b"), ("u3", "x", "d", "public", "c"), ("u8", "x", "d", "public", "n"), ("u9", "x", "d", "other", "m"),
         ("u99", "x", "d", "zother", "m")], "unit_id string, source_id string, database_name string, schema_name string, table_name string")
    boosted = search.graph_boost(hybrid, expansion)
    scores = {r.unit_id: (r.final_score, r.graph_matched) for r in boosted.collect()}
    assert scores == {"u1": (2 / 61 + 0.005, True), "u2": (1 / 62 + 0.0025, True), "u3": (1 / 63, False)}
    candidates = search.graph_candidates(hybrid, expansion, search.unit_index(units))
    found = {r.unit_id: r.final_score for r in candidates.collect()}
    assert found == {"u8": 2 / 61 - 0.0005, "u9": 0.0}  # m falls back on the first table of that name
    limits = spark.createDataFrame([(1, 4)], "question_id long, final_limit int")
    final = sorted((r.final_rank, r.unit_id, r.retrieval_source) for r in search.final_rank(boosted, candidates, limits).collect())
    assert final == [(1, "u1", "hybrid"), (2, "u8", "graph"), (3, "u2", "hybrid"), (4, "u3", "hybrid")]


def test_find_units(spark):
    units = spark.createDataFrame([("1", "d", "s", "a"), ("2", "d", "t", "a"), ("3", "d", "s", "b"), ("4", "e", "s", "a")],
                                  "unit_id string, database_name string, schema_name string, table_name string")
    wanted = spark.createDataFrame([("d", "s", "a"), ("d", "s", "a"), ("d", None, "b"), ("e", "", "a")], "database_name string, schema_name string, table_name string")
    assert sorted(r.unit_id for r in search.find_units(units, wanted).collect()) == ["1", "3", "4"]


def test_retrieval_answers_repeated_questions_alike(spark, film):
    content = docs.unit_content(film).select(
        F.col("table_name").alias("unit_id"), graph.source_id().alias("source_id"), "database_name", "schema_name", "table_name", "content")
    units = emb.embed(content, "content")
    asked = spark.createDataFrame(
        [(1, "rental inventory", "rentals", None), (2, "rental inventory", "rentals", None), (3, "rental inventory", "rentals", 1), (4, "film title", "rentals", 2)],
        "question_id long, question string, database_name string, limit int")
    result = retrieve(emb.embed(asked, "question"), units, graph.nodes(film), graph.edges_from_nested(film))
    answers = {}
    for r in result.final.collect():
        answers.setdefault(r.question_id, {})[r.final_rank] = r.unit_id
    assert answers[1] == answers[2] and len(answers[1]) == 5
    assert answers[3] == {1: answers[1][1]} and len(answers[4]) == 2
    assert answers[1][1] == "rental" and answers[4][1] == "film"
    assert result.seeds.filter("question_id = 2").count() == 3


def test_the_words_of_a_unit_are_read_once(spark):
    """Document frequencies, units and lengths of a database come from one pass over the texts."""
    read = spark.sparkContext.accumulator(0)
    words = F.udf(lambda i: (read.add(1), ["total", f"w{i % 3}", "total"])[1], "array<string>").asNondeterministic()
    units = spark.range(30).select(F.lit("d").alias("key"), words("id").alias("tokens"))
    asked = spark.createDataFrame([(1, "d", "total w1"), (2, "e", "total"), (3, "d", "nowhere")], "question_id long, database_name string, question string")
    got = {r.question_id: r for r in search.question_terms(asked, units).collect()}
    assert read.value == 30 and set(got) == {1} and got[1].terms == ["total", "w1"] and got[1].avgdl == 3.0
    assert [round(x, 9) for x in got[1].idf] == [round(math.log(1 + (30 - n + 0.5) / (n + 0.5)), 9) for n in (30, 10)]
