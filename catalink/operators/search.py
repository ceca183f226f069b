"""Search over many units for whole tables of questions, and the fusion of its results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from catalink.functions.ranking import first_per, top_k
from catalink.functions.scoring import local_hits, merge_hits
from catalink.functions.text import tokens
from catalink.operators.graph import DEFAULT_SCHEMA, table_id
from catalink.session import cut, grown

RRF_K = 60
DEFAULT_LIMIT, MAX_LIMIT = 5, 20
CANDIDATE_LIMIT = 15
SEED_LIMIT = 3
GRAPH_DEPTH = 2
GRAPH_BOOST = 0.005
HOP_PENALTY = 0.0005

BROADCAST_QUESTIONS = 2_000  # questions sent to every task; larger sets are shuffled in blocks instead
BROADCAST_VALUES = 8_000_000  # vector cells or terms sent to every task
UNIT_BLOCK = 8_192
SCAN_ROWS = 1_024  # units scored at a time where questions travel to them
QUESTION_BLOCK = 4_096
VOCABULARY_BROADCAST = 200_000
PLACES_BROADCAST = 20_000  # databases whose places are sent to every task; more of them are merged with their units and questions


def resolve_limit(limit: Column) -> Column:
    """Requested result count: missing, non-finite or non-positive gives the default, the rest is floored and capped."""
    value = limit.cast("double")
    bad = value.isNull() | F.isnan(value) | (value <= 0) | (value == float("inf"))
    return F.when(bad, DEFAULT_LIMIT).otherwise(F.least(F.floor(value), F.lit(MAX_LIMIT))).cast("int")


def with_limits(questions: DataFrame) -> DataFrame:
    final = resolve_limit(F.col("limit")) if "limit" in questions.columns else F.lit(DEFAULT_LIMIT)
    return questions.withColumn("final_limit", final).withColumn(
        "candidate_limit", F.greatest(F.lit(CANDIDATE_LIMIT), "final_limit")
    )


# ---- top-k over blocks ----------------------------------------------------------------------------------------


def _hit_schema(questions: DataFrame, units: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("question_id", questions.schema["question_id"].dataType),
            T.StructField("unit_id", units.schema["unit_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _scan_hits(questions: DataFrame, units: DataFrame, kernel: str, k: int) -> DataFrame:
    """Few questions: they travel to the units, which are scanned in place and never shuffled."""
    spark = questions.sparkSession
    sent = spark.sparkContext.broadcast(questions.toArrow())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, SCAN_ROWS):
                hits = local_hits(kernel, sent.value, pa.Table.from_batches([batch.slice(at, SCAN_ROWS)]), k)
                held = merge_hits(held, hits, k)
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return units.mapInArrow(scan, _hit_schema(questions, units))


def _block_hits(
    questions: DataFrame, units: DataFrame, kernel: str, k: int, unit_block: int, question_block: int
) -> DataFrame:
    """Many questions: units and questions of a key meet in blocks of bounded size.

    A key with many units or questions is split into several unit and question blocks, and every pair of blocks is one
    task-sized group; keys that fit one block are packed together by size. No group grows with the data.
    """
    sizes = (
        units.select("key", F.lit(1).alias("u"), F.lit(0).alias("q"))
        .unionAll(questions.select("key", F.lit(0).alias("u"), F.lit(1).alias("q")))
        .groupBy("key")
        .agg(F.sum("u").alias("u"), F.sum("q").alias("q"))
    )
    parts = lambda c, size: F.ceil(F.col(c) / size).cast("int")
    sizes = cut(sizes.select("key", "u", "q", parts("u", unit_block).alias("n_u"), parts("q", question_block).alias("n_q")), "sizes")
    # Small keys are packed by their running size within one of a number of lanes, so a pack holds at most two blocks.
    lanes = 2 * units.sparkSession.sparkContext.defaultParallelism
    small = ~((F.col("n_u") > 1) | (F.col("n_q") > 1))
    share = F.greatest(F.col("u") / unit_block, F.col("q") / question_block)
    running = Window.partitionBy("lane", "small").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    packed = sizes.withColumn("small", small).withColumn("lane", F.pmod(F.xxhash64("key"), F.lit(lanes)))
    pack = F.concat_ws(":", F.lit("p"), F.col("lane").cast("string"), F.floor(F.sum(share).over(running)).cast("string"))
    group = F.when(F.col("small"), pack).otherwise(F.concat(F.lit("k:"), "key"))
    places = cut(packed.select("key", "n_u", "n_q", group.alias("grp")), "places")
    # Left to Spark, a side of 10 MB of files would go to the driver: the places of about a million databases.
    few = places.limit(PLACES_BROADCAST + 1).count() <= PLACES_BROADCAST
    places = F.broadcast(places) if few else grown(places)

    def placed(df: DataFrame, own: str, own_id: str, other: str) -> DataFrame:
        one = F.lit(1)
        joined = df.join(places, "key")
        n_own, n_other = F.greatest(own, one), F.greatest(other, one).cast("int")
        own_block, other_block = ("ub", "qb") if own == "n_u" else ("qb", "ub")
        return (
            joined.withColumn(own_block, F.pmod(F.xxhash64(own_id), n_own).cast("int"))
            .withColumn(other_block, F.explode(F.sequence(F.lit(0), n_other - 1)))
            .select(F.concat("grp").alias("grp"), "ub", "qb", *df.columns)  # both sides come from ``places``
        )

    left = placed(questions, "n_q", "question_id", "n_u").groupBy("grp", "ub", "qb")
    right = placed(units, "n_u", "unit_id", "n_q").groupBy("grp", "ub", "qb")

    def score(asked: pa.Table, offered: pa.Table) -> pa.Table:
        return local_hits(kernel, asked, offered, k)

    return left.cogroup(right).applyInArrow(score, _hit_schema(questions, units))


def block_top_k(
    questions: DataFrame,
    units: DataFrame,
    kernel: str | Callable,
    k: int,
    broadcast_questions: int = BROADCAST_QUESTIONS,
    unit_block: int = UNIT_BLOCK,
    question_block: int = QUESTION_BLOCK,
) -> DataFrame:
    """Exact ``k`` best units of the same ``key`` per question: question_id, unit_id, score, rank."""
    payload = "terms" if kernel == "bm25" else "embedding"
    sent = questions.limit(broadcast_questions + 1).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size(payload)), F.lit(0)).alias("values")
    ).first()
    if sent["rows"] <= broadcast_questions and sent["values"] <= BROADCAST_VALUES:
        hits = _scan_hits(questions, units, kernel, k)
    else:
        hits = _block_hits(questions, units, kernel, k, unit_block, question_block)
    return top_k(hits, ["question_id"], [F.col("score").desc(), F.col("unit_id")], k)


def _tables_only(units: DataFrame) -> DataFrame:
    return units.filter(F.col("type") == "table") if "type" in units.columns else units


def vector_search(questions: DataFrame, units: DataFrame, k: int = DEFAULT_LIMIT, **blocks: int) -> DataFrame:
    """Cosine top-k among the units of the question's database.

    ``questions``: question_id, database_name, embedding. ``units``: unit_id, database_name, embedding. Rows without a
    vector take no part.
    """
    has_vector = F.size("embedding") > 0
    q = questions.filter(has_vector).select("question_id", F.col("database_name").alias("key"), "embedding")
    u = _tables_only(units).filter(has_vector).select("unit_id", F.col("database_name").alias("key"), "embedding")
    return block_top_k(q, u, "cosine", k, **blocks)


def question_terms(questions: DataFrame, units_tokens: DataFrame) -> DataFrame:
    """Questions as ``terms``, their ``idf`` within the question's database, and that database's ``avgdl``.

    Document frequencies are counted for asked terms only; a set of asked terms small enough to send along filters
    the postings before they are shuffled, a larger one is joined after the postings have been counted per task.
    """
    asked = questions.select(
        "question_id", F.col("database_name").alias("key"), F.explode(F.array_distinct(tokens(F.col("question")))).alias("term")
    )
    # Each unit also stands under the empty word, which no text holds: one pass over the texts counts words, units and lengths.
    whole = F.lit("").alias("term")
    vocabulary = asked.select("key", "term").unionByName(asked.select("key", whole)).distinct()
    words = F.explode(F.array_append(F.array_distinct("tokens"), whole)).alias("term")
    postings = units_tokens.select("key", F.size("tokens").alias("size"), words)
    counts = [F.count(F.lit(1)).alias("df"), F.sum("size").alias("size")]
    few = vocabulary.limit(VOCABULARY_BROADCAST + 1).count() <= VOCABULARY_BROADCAST
    if few:
        counted = postings.join(F.broadcast(vocabulary), ["key", "term"], "left_semi").groupBy("key", "term").agg(*counts)
    else:
        counted = postings.groupBy("key", "term").agg(*counts).join(grown(vocabulary), ["key", "term"], "left_semi")
    counted = cut(counted, "term-counts")
    frequencies = counted.filter("term <> ''").select("key", "term", "df")
    totals = counted.filter("term = ''").select("key", F.col("df").alias("n"), (F.col("size") / F.col("df")).alias("avgdl"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # The small per-term table is completed first; every question then holds no more rows than it has terms.
    weights = frequencies.join(grown(totals), "key").select("key", "term", idf.alias("idf"), "avgdl")
    pair = F.array_sort(F.collect_list(F.struct("term", "idf")))
    return (
        asked.join(F.broadcast(weights) if few else grown(weights), ["key", "term"])  # never the terms of all questions to the driver
        .groupBy("question_id", "key")
        .agg(pair.alias("pairs"), F.max("avgdl").alias("avgdl"))
        .select(
            "question_id",
            "key",
            F.transform("pairs", lambda p: p["term"]).alias("terms"),
            F.transform("pairs", lambda p: p["idf"]).alias("idf"),
            "avgdl",
        )
    )


def keyword_search(
    questions: DataFrame, units: DataFrame, k: int = DEFAULT_LIMIT, text: Column | None = None, **blocks: int
) -> DataFrame:
    """BM25 top-k (k1 = 1.2, b = 0.75) among the units of the question's database.

    ``questions``: question_id, database_name, question. ``units``: unit_id, database_name and the searched ``text``,
    by default the table name, schema name and content together.
    """
    body = text if text is not None else F.concat_ws(" ", "table_name", "schema_name", "content")
    u = _tables_only(units).select(
        "unit_id", F.col("database_name").alias("key"), F.coalesce(tokens(body), F.array().cast("array<string>")).alias("tokens")
    )
    return block_top_k(cut(question_terms(questions, u), "terms"), u, "bm25", k, **blocks)


# ---- fusion ---------------------------------------------------------------------------------------------------


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, limit: int | Column = CANDIDATE_LIMIT) -> DataFrame:
    """Reciprocal-rank fusion: question_id, unit_id, vector_rank, keyword_rank, rrf, hybrid_rank.

    Equal scores keep the order vector hits by rank, then keyword-only hits by rank. ``limit`` may be a column of the
    hits. One shuffle on the question serves the merge and the ranking.
    """
    none = F.lit(None).cast("int")
    extra = [c for c in vector_hits.columns if c not in ("question_id", "unit_id", "score", "rank")]
    v = vector_hits.select("question_id", "unit_id", *extra, F.col("rank").alias("vector_rank"), none.alias("keyword_rank"))
    t = keyword_hits.select("question_id", "unit_id", *extra, none.alias("vector_rank"), F.col("rank").alias("keyword_rank"))
    merged = (
        v.unionByName(t)
        .repartition("question_id")
        .groupBy("question_id", "unit_id", *extra)
        .agg(F.max("vector_rank").alias("vector_rank"), F.max("keyword_rank").alias("keyword_rank"))
    )

    def share(rank: str) -> Column:
        return F.coalesce(1.0 / (RRF_K + F.col(rank)), F.lit(0.0))

    scored = merged.withColumn("rrf", share("vector_rank") + share("keyword_rank"))
    order = [F.col("rrf").desc(), F.col("vector_rank").asc_nulls_last(), F.col("keyword_rank").asc_nulls_last()]
    return top_k(scored, ["question_id"], order, limit, "hybrid_rank")


def unit_node(database: str = "database_name") -> Column:
    return table_id(database, F.coalesce("schema_name", F.lit(DEFAULT_SCHEMA)), "table_name")


def graph_seeds(hybrid: DataFrame, limit: int = SEED_LIMIT) -> DataFrame:
    """The first ``limit`` distinct tables of each hybrid list; their rank is their place in that list."""
    usable = hybrid.filter(F.col("table_name").isNotNull() & F.col("source_id").isNotNull()).withColumn(
        "schema_name", F.coalesce("schema_name", F.lit(DEFAULT_SCHEMA))
    )
    key = ["question_id", "source_id", "database_name", "schema_name", "table_name"]
    distinct = usable.groupBy(*key).agg(F.min(F.struct("hybrid_rank", "rrf")).alias("m"))
    seeds = distinct.select(*key, F.col("m.hybrid_rank").alias("hybrid_rank"), F.col("m.rrf").alias("hybrid_score"))
    return top_k(seeds, ["question_id"], [F.col("hybrid_rank")], limit, "seed_no").drop("seed_no")


def graph_boost(hybrid: DataFrame, expansion: DataFrame) -> DataFrame:
    """Hybrid hits with the boost of the graph node they sit on, if it was reached."""
    reached = expansion.select(
        "question_id", "node_id", F.col("distance").alias("graph_distance"), "graph_rank",
        F.col("seed_hybrid_score").alias("graph_seed_hybrid_score"),
    )
    placed = hybrid.withColumn("node_id", F.when(F.col("table_name").isNotNull() & F.col("source_id").isNotNull(), unit_node()))
    boost = F.coalesce(F.lit(GRAPH_BOOST) / F.pow(F.lit(2.0), F.col("graph_distance")), F.lit(0.0))
    return (
        placed.join(grown(reached), ["question_id", "node_id"], "left")
        .withColumn("graph_matched", F.col("graph_distance").isNotNull())
        .withColumn("final_score", F.col("rrf") + boost)
        .withColumn("retrieval_source", F.lit("hybrid"))
    )


def unit_index(units: DataFrame) -> DataFrame:
    """One unit per node id; only names and ids, never text or vectors."""
    named = _tables_only(units).select("unit_id", "source_id", "database_name", "schema_name", "table_name", unit_node().alias("node_id"))
    return first_per(named, ["node_id"], [F.col("unit_id")])


def with_fallback_unit(nodes: DataFrame, index: DataFrame) -> DataFrame:
    """Nodes with their unit: the one of the same node id, else the first one of the same database and table name."""
    exact = index.select("node_id", F.col("unit_id").alias("exact_unit"))
    by_name = index.groupBy("database_name", "table_name").agg(F.min(F.struct("node_id", "unit_id")).alias("m"))
    by_name = by_name.select("database_name", "table_name", F.col("m.unit_id").alias("named_unit"))
    return (
        nodes.join(grown(exact), "node_id", "left")
        .join(grown(by_name), ["database_name", "table_name"], "left")
        .withColumn("unit_id", F.coalesce("exact_unit", "named_unit"))
        .drop("exact_unit", "named_unit")
        .filter(F.col("unit_id").isNotNull())
    )


def graph_candidates(hybrid: DataFrame, expansion: DataFrame, index: DataFrame) -> DataFrame:
    """Reached nodes that no hybrid hit sits on, scored by their seed less a penalty per hop; best one per node."""
    sat_on = hybrid.filter(F.col("table_name").isNotNull()).select("question_id", unit_node().alias("node_id"))
    # The key of the comparison is built from the names, as a node without a schema reads as the default one.
    fresh = expansion.filter(F.col("table_name").isNotNull()).withColumn("__key", unit_node())
    fresh = fresh.join(grown(sat_on.withColumnRenamed("node_id", "__key")), ["question_id", "__key"], "left_anti").drop("__key")
    scored = with_fallback_unit(fresh, index).withColumn(
        "final_score", F.greatest(F.lit(0.0), F.col("seed_hybrid_score") - F.lit(HOP_PENALTY) * F.col("distance"))
    )
    best = first_per(scored, ["question_id", "node_id"], [F.col("final_score").desc(), F.col("distance"), F.col("unit_id")])
    return best.select(
        "question_id",
        "unit_id",
        "node_id",
        F.lit(0.0).alias("rrf"),
        "final_score",
        F.lit(True).alias("graph_matched"),
        F.lit("graph").alias("retrieval_source"),
        F.col("distance").alias("graph_distance"),
        "graph_rank",
        F.col("seed_hybrid_score").alias("graph_seed_hybrid_score"),
    )


FINAL_COLUMNS = [
    "question_id", "unit_id", "rrf", "final_score", "graph_matched", "retrieval_source", "graph_distance", "graph_rank",
    "graph_seed_hybrid_score", "vector_rank", "keyword_rank",
]


def final_rank(boosted: DataFrame, candidates: DataFrame, limits: DataFrame) -> DataFrame:
    """Both candidate sets in their final order, cut at each question's ``final_limit``."""
    pool = boosted.select(*FINAL_COLUMNS).unionByName(candidates.drop("node_id"), allowMissingColumns=True)
    order = [
        F.col("final_score").desc(), F.col("rrf").desc(), F.col("graph_distance").asc_nulls_last(), F.col("unit_id"),
    ]
    cut_off = top_k(pool, ["question_id"], order, MAX_LIMIT, "final_rank")
    return cut_off.join(grown(limits.select("question_id", "final_limit")), "question_id").filter(
        F.col("final_rank") <= F.col("final_limit")
    ).drop("final_limit")


def find_units(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """Units of the listed tables; a listed table without a schema matches every schema.

    ``wanted``: database_name, schema_name (nullable), table_name. The two kinds of request are two equi-joins.
    """
    pool = _tables_only(units)
    blank = F.coalesce("schema_name", F.lit("")) == ""
    exact = wanted.filter(~blank).select("database_name", "schema_name", "table_name").distinct()
    any_schema = wanted.filter(blank).select("database_name", "table_name").distinct()
    by_schema = pool.join(grown(exact), ["database_name", "schema_name", "table_name"], "left_semi")
    rest = pool.join(grown(exact), ["database_name", "schema_name", "table_name"], "left_anti")
    return by_schema.unionByName(rest.join(grown(any_schema), ["database_name", "table_name"], "left_semi").select(*pool.columns))
