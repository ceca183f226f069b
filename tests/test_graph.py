import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from catalink.operators import graph


def seeds_df(spark, rows):
    return spark.createDataFrame(rows, "question_id long, node_id string, hybrid_rank int, hybrid_score double")


def test_film_expansion(spark, film):
    nodes, edges = graph.nodes(film), graph.edges_from_nested(film)
    assert edges.filter("edge_id = 'rentals.public.rental::inventory_id::rentals.public.inventory::inventory_id'").count() == 1
    seeds = seeds_df(spark, [(1, "rentals.public.rental", 1, 0.03)])
    found = {r.node_id.split(".")[-1]: r for r in graph.traverse(seeds, graph.adjacency(nodes, edges)).collect()}
    assert {k: v.distance for k, v in found.items()} == {"rental": 0, "inventory": 1, "film": 2}
    assert [round(found[k].graph_score, 3) for k in ("rental", "inventory", "film")] == [1.0, 0.5, 0.333]
    deeper = graph.traverse(seeds, graph.adjacency(nodes, edges), 3).collect()
    assert {r.node_id.split(".")[-1] for r in deeper} == {"rental", "inventory", "film", "film_category"}


def test_adjacency_is_undirected_and_ignores_other_edges(spark):
    nodes = spark.createDataFrame([("s", "a", "table"), ("s", "b", "table"), ("s", "c", "column"), ("t", "d", "table")], "source_id string, node_id string, type string")
    edges = spark.createDataFrame(
        [("a", "b", "references"), ("a", "b", "belongs_to"), ("a", "c", "references"), ("b", "a", "contains"), ("a", "z", "references")],
        "src string, dst string, type string").withColumn("source_id", F.lit("s"))
    edges = edges.unionByName(edges.filter("src = 'a' AND dst = 'b'").withColumn("source_id", F.lit("t")))  # not among that source's nodes
    assert sorted((r.src, r.dst) for r in graph.adjacency(nodes, edges).collect()) == [("a", "b"), ("b", "a")]


def test_seed_resolution(spark, film):
    nodes = graph.nodes(film)
    source = nodes.first().source_id
    seeds = spark.createDataFrame(
        [(1, source, "rentals", None, "film", "rentals"), (1, source, "rentals", "public", "nothing", "rentals"),
         (2, source, "rentals", "public", "film", "elsewhere"), (3, "other", "rentals", "public", "film", "rentals")],
        "question_id long, source_id string, database_name string, schema_name string, table_name string, question_database string")
    assert [(r.question_id, r.node_id) for r in graph.resolve_seeds(seeds, nodes).collect()] == [(1, "rentals.public.film")]


@pytest.mark.parametrize("value,expected", [(None, 2), (-1, 2), (float("nan"), 2), (0, 0), (3.7, 3), (9, 5)])
def test_depth(value, expected):
    assert graph.resolve_depth(value) == expected


@pytest.mark.parametrize("value,expected", [(None, 20), (0, 20), (float("inf"), 20), (7.9, 7), (500, 50)])
def test_limit(value, expected):
    assert graph.resolve_limit(value) == expected


def reference_search(adjacency, seeds, depth, limit):
    """Plain queue search: seeds by rank, a node belongs to whoever reaches it first."""
    best = {}
    queue = deque()
    for rank, score, node in sorted(seeds):
        if node not in best:
            best[node] = (0, rank, -score, node)
            queue.append(node)
    while queue:
        node = queue.popleft()
        distance, rank, negated, seed = best[node]
        if distance == depth:
            continue
        for other in sorted(adjacency.get(node, ())):
            if other not in best:
                best[other] = (distance + 1, rank, negated, seed)
                queue.append(other)
    ordered = sorted(best.items(), key=lambda kv: (*kv[1][:3], kv[0]))[:limit]
    return [(node, d, rank, seed, place + 1) for place, (node, (d, rank, _, seed)) in enumerate(ordered)]


@pytest.mark.parametrize("depth,limit", [(0, 3), (1, 2), (2, 4), (2, 20), (3, 7), (5, 50)])
def test_random_graphs_with_hubs(spark, depth, limit):
    rng = random.Random(depth * 100 + limit)
    pairs, seed_rows, graphs, asked = set(), [], {}, {}
    for g in range(25):
        size = rng.randint(2, 40)
        names = [f"g{g:02d}n{i:02d}" for i in range(size)]
        edges = {tuple(rng.sample(names, 2)) for _ in range(rng.randint(1, size * 2))}
        hub = rng.choice(names)
        edges |= {(hub, n) for n in names if n != hub and rng.random() < 0.5}
        adjacency = {}
        for a, b in edges:
            adjacency.setdefault(a, set()).add(b)
            adjacency.setdefault(b, set()).add(a)
            pairs |= {(a, b), (b, a)}
        graphs[g] = adjacency
        ranks = rng.sample(range(1, 9), rng.randint(1, 3))
        asked[g] = [(rank, 1.0 / (60 + rank), rng.choice(names)) for rank in ranks]
        seed_rows += [(g, node, rank, score) for rank, score, node in asked[g]]
    adjacency_df = spark.createDataFrame(sorted(pairs), "src string, dst string")
    got = {}
    for r in graph.traverse(seeds_df(spark, seed_rows), adjacency_df, depth, limit).collect():
        got.setdefault(r.question_id, []).append((r.node_id, r.distance, r.seed_hybrid_rank, r.seed_node_id, r.graph_rank))
    for g in graphs:
        assert sorted(got[g], key=lambda x: x[-1]) == reference_search(graphs[g], asked[g], depth, limit)


def test_a_finished_question_is_not_carried_through_deeper_levels(spark, monkeypatch):
    pairs = [("a", f"n{i:02d}") for i in range(9)] + [("x", "y"), ("y", "z")]
    adjacency_df = spark.createDataFrame([*pairs, *((b, a) for a, b in pairs)], "src string, dst string")
    seeds = seeds_df(spark, [(1, "a", 1, 0.5), (2, "x", 1, 0.5)])
    written, cut = {}, graph.cut

    def counted(df, label):
        out = cut(df, label)
        written[label] = {r.question_id for r in out.select("question_id").distinct().collect()} if "question_id" in out.columns else None
        return out

    monkeypatch.setattr(graph, "cut", counted)
    found = sorted((r.question_id, r.node_id, r.distance, r.graph_rank) for r in graph.traverse(seeds, adjacency_df, 5, 5).collect())
    assert found == [(1, "a", 0, 1), *((1, f"n{i:02d}", 1, i + 2) for i in range(4)), (2, "x", 0, 1), (2, "y", 1, 2), (2, "z", 2, 3)]
    assert written["bfs-0"] == {1, 2} and written["bfs-1"] == {2}
    assert "bfs-3" not in written  # no frontier is left


def test_stats(film):
    row = graph.stats(graph.nodes(film), graph.edges_from_nested(film)).first()
    assert (row.nodes, row.edges) == (6, 4)


def test_an_undirected_pair_is_made_distinct_before_it_gets_two_directions(spark):
    nodes = spark.createDataFrame([("s", n, "table") for n in "abc"], "source_id string, node_id string, type string")
    pairs = [("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), ("c", "c"), ("b", "c"), ("a", "gone"), ("gone", "c")]
    edges = spark.createDataFrame([("s", "references", *p) for p in pairs], "source_id string, type string, src string, dst string")
    found = graph.adjacency(nodes, edges)
    assert sorted(map(tuple, found.collect())) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "c")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Generate") < plan.index("Aggregate"), plan
