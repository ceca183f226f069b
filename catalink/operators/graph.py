"""Foreign-key graphs: nodes, edges, adjacency and bounded multi-source breadth-first search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalink.functions.ranking import first_per, ranked, top_k
from catalink.session import cut, grown

DEFAULT_DEPTH, MAX_DEPTH = 2, 5
DEFAULT_LIMIT, MAX_LIMIT = 20, 50
DEFAULT_SCHEMA = "public"
TRAVERSED = ("references", "belongs_to")
LEVEL = 2**32  # priority = distance * LEVEL + place of the seed


def resolve_depth(depth: float | None = None) -> int:
    if depth is None or not math.isfinite(depth) or depth < 0:
        return DEFAULT_DEPTH
    return min(math.floor(depth), MAX_DEPTH)


def resolve_limit(limit: float | None = None) -> int:
    if limit is None or not math.isfinite(limit) or limit <= 0:
        return DEFAULT_LIMIT
    return min(math.floor(limit), MAX_LIMIT)


def source_id(database: Column | str = "database_name", dialect: Column | str = "dialect") -> Column:
    return F.sha2(F.concat_ws(":", database, dialect), 256)


def table_id(database, schema, table) -> Column:
    return F.concat_ws(".", database, schema, table)


def nodes(tables: DataFrame) -> DataFrame:
    return tables.select(
        table_id("database_name", "schema_name", "table_name").alias("node_id"),
        source_id().alias("source_id"),
        F.lit("table").alias("type"),
        "database_name",
        "schema_name",
        "table_name",
    )


def edges(foreign_keys: DataFrame) -> DataFrame:
    """One ``references`` edge per foreign-key column; rows as in ``information_schema.foreign_keys`` with ``dialect``."""
    src = table_id("database_name", "schema_name", "table_name")
    dst = table_id("database_name", "ref_schema", "ref_table")
    return foreign_keys.select(
        F.concat_ws("::", src, "column_name", dst, "ref_column").alias("edge_id"),
        source_id().alias("source_id"),
        F.lit("references").alias("type"),
        src.alias("src"),
        dst.alias("dst"),
        "column_name",
        F.col("ref_column").alias("referenced_column"),
        "database_name",
    )


def edges_from_nested(nested: DataFrame) -> DataFrame:
    return edges(nested.select("database_name", "dialect", "schema_name", "table_name", F.inline("foreign_keys")))


def stats(nodes_df: DataFrame, edges_df: DataFrame) -> DataFrame:
    """Node and edge counts per source from one grouped pass over both."""
    tagged = nodes_df.select("source_id", "database_name", F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(
        edges_df.select("source_id", "database_name", F.lit(0).alias("n"), F.lit(1).alias("e"))
    )
    return tagged.groupBy("source_id", "database_name").agg(F.sum("n").alias("nodes"), F.sum("e").alias("edges"))


def adjacency(nodes_df: DataFrame, edges_df: DataFrame) -> DataFrame:
    """Undirected ``(src, dst)`` pairs between existing table nodes of a source over the traversed edge types."""
    known = nodes_df.filter(F.col("type") == "table").select("source_id", "node_id")
    walked = edges_df.filter(F.col("type").isin(*TRAVERSED)).select("source_id", "src", "dst")
    walked = walked.join(grown(known.withColumnRenamed("node_id", "src")), ["source_id", "src"], "left_semi")
    walked = walked.join(grown(known.withColumnRenamed("node_id", "dst")), ["source_id", "dst"], "left_semi")
    # Each undirected pair is shuffled once, and its two directions are made afterwards; a node that references itself has only one.
    pairs = walked.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = F.array_distinct(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return pairs.select(F.explode(both).alias("p")).select("p.src", "p.dst")


def of_source(df: DataFrame, *ids: str) -> DataFrame:
    """Node ids preceded by their source, as sources of one name in two dialects share plain ids."""
    return df.withColumns({i: F.concat_ws("|", "source_id", i) for i in ids})


def resolve_seeds(seeds: DataFrame, nodes_df: DataFrame) -> DataFrame:
    """Seeds with their node; seeds of another database than the question's, or without a node, drop out.

    A missing schema name reads as ``public`` on both sides.
    """
    key = ["source_id", "database_name", "schema_name", "table_name"]
    schema = F.coalesce("schema_name", F.lit(DEFAULT_SCHEMA)).alias("schema_name")
    tables = nodes_df.filter((F.col("type") == "table") & F.col("table_name").isNotNull()).select(
        "source_id", "database_name", schema, "table_name", "node_id"
    )
    wanted = seeds
    if "question_database" in seeds.columns:
        wanted = seeds.filter(F.col("database_name") == F.col("question_database"))
    return wanted.withColumn("schema_name", schema).join(grown(tables), key)


def nearest_neighbours(adjacency_df: DataFrame, limit: int) -> DataFrame:
    """Each node with its first ``2 * limit`` neighbours in id order, as one bounded array.

    ``traverse`` never needs more: see there. The row_number filter becomes a partial group limit, so a hub that owns
    a third of all edges is cut down before the shuffle.
    """
    kept = top_k(adjacency_df, ["src"], [F.col("dst")], 2 * limit)
    return kept.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))


def traverse(
    seeds: DataFrame,
    adjacency_df: DataFrame,
    depth: float | None = None,
    limit: float | None = None,
) -> DataFrame:
    """Breadth-first search from several seeds per question, ranked and cut at ``limit`` nodes per question.

    ``seeds``: question_id, node_id, hybrid_rank (distinct per question), hybrid_score. A node takes its nearest seed, ties going to the
    better seed rank. Result: question_id, node_id, seed_node_id, distance, graph_score, seed_hybrid_rank,
    seed_hybrid_score, graph_rank.

    The cut is pushed into every level, which keeps the work per question bounded without changing the result.
    Results are ordered by distance first, so once a question holds ``limit`` nodes no farther node can enter, and
    until then no node of a nearer level has been cut. Within a level, order is (seed rank, seed score, node id), and
    every neighbour of a frontier node ranks no worse than the frontier node's own seed allows. A neighbour that
    makes the cut is therefore preceded, in its best parent's id-ordered list, only by nodes already held (fewer than
    ``limit``) and by nodes that rank before it (fewer than ``limit``): the first ``2 * limit`` neighbours suffice.
    """
    depth, limit = resolve_depth(depth), resolve_limit(limit)

    def reduce_level(candidates: DataFrame) -> DataFrame:
        # One exchange on the question serves the per-node minimum, the per-question cut and the size.
        nearest = candidates.repartition("question_id").groupBy("question_id", "node_id").agg(F.min("priority").alias("priority"))
        kept = top_k(nearest, ["question_id"], [F.col("priority"), F.col("node_id")], limit, "graph_rank")
        # A question that holds its limit is finished and is not expanded again.
        size = F.count(F.lit(1)).over(Window.partitionBy("question_id"))
        return kept.withColumn("unfinished", size < limit)

    # A seed is known by its place among its question's seeds; distance and place make one sortable number.
    distinct = first_per(seeds, ["question_id", "node_id"], [F.col("hybrid_rank"), F.col("hybrid_score").desc()])
    numbered = ranked(distinct, ["question_id"], [F.col("hybrid_rank"), F.col("hybrid_score").desc(), F.col("node_id")], "seed_no")
    numbered = cut(
        numbered.select("question_id", "seed_no", F.col("node_id").alias("seed_node_id"), "hybrid_rank", "hybrid_score"), "seeds"
    )
    held = reduce_level(
        numbered.select("question_id", F.col("seed_node_id").alias("node_id"), F.col("seed_no").cast("long").alias("priority"))
    )
    if depth > 0:
        held = cut(held, "bfs-seeds")
        near = nearest_neighbours(adjacency_df, limit)
        if depth > 1:
            near = cut(near, "neighbours")
    finished = []
    for level in range(depth):
        # Only the frontier of open questions meets the neighbours; finished questions keep their rows and ranks.
        going, itself = held.filter("unfinished"), ["question_id", "node_id", "priority"]
        frontier = going.filter(F.floor(F.col("priority") / LEVEL) == level)
        if level and frontier.isEmpty():
            break
        finished.append(held.filter("NOT unfinished"))
        reached = frontier.join(grown(near.withColumnRenamed("src", "node_id")), "node_id")
        onward = reached.select("question_id", F.explode("neighbours").alias("node_id"), (F.col("priority") + LEVEL).alias("priority"))
        held = reduce_level(going.select(*itself).unionByName(onward))
        if level + 1 < depth:
            held = cut(held, f"bfs-{level}")
    for done in finished:
        held = held.unionByName(done)
    distance = F.floor(F.col("priority") / LEVEL).cast("int")
    found = held.select(
        "question_id", "node_id", "graph_rank", distance.alias("distance"), (F.col("priority") % LEVEL).cast("int").alias("seed_no")
    )
    return found.join(grown(numbered), ["question_id", "seed_no"]).select(
        "question_id",
        "node_id",
        "seed_node_id",
        "distance",
        (1.0 / (1 + F.col("distance"))).alias("graph_score"),
        F.col("hybrid_rank").alias("seed_hybrid_rank"),
        F.col("hybrid_score").alias("seed_hybrid_score"),
        "graph_rank",
    )


def expand_from_seeds(
    seeds: DataFrame,
    nodes_df: DataFrame,
    edges_df: DataFrame,
    depth: float | None = None,
    limit: float | None = None,
) -> DataFrame:
    """Seed resolution, traversal and the node's names in one step."""
    own_nodes, own_edges = of_source(nodes_df, "node_id"), of_source(edges_df, "src", "dst")
    found = traverse(resolve_seeds(seeds, own_nodes), adjacency(own_nodes, own_edges), depth, limit)
    names = first_per(own_nodes, ["node_id"], [F.col("table_name")]).select(
        "node_id", "source_id", "database_name", "schema_name", "table_name"
    )
    plain = {i: F.expr(f"substring({i}, length(source_id) + 2)") for i in ("node_id", "seed_node_id")}
    return found.join(grown(names), "node_id").withColumns(plain)
