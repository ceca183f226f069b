"""Search (R1-R12): over the document corpus, and over the catalog units of one warehouse per nation.

A warehouse is the database of all customers of a nation: each customer's copy of the template is one of its schemas.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalink.operators import documents as docs
from catalink.operators import embedding as emb
from catalink.operators import graph, search
from catalink.plans.retrieval import Retrieval, retrieve
from catalink.session import cut, grown, scratch_path
from catalink.sources.postings import PostingsIndex
from catalink.sources.vector_index import VectorIndex
from workload.document_queries import nested, words
from workload.inputs import spread_table, table
from workload.sql_inputs import CTES, with_ctes

CORPUS = "corpus"


# ---- corpus: documents and vectors as units, benchmark passages as questions -----------------------------------


def corpus_questions(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    vectors = table(spark, sf, "embeddings").select((F.col("vec_id") / 5).cast("long").alias("question_id"), "vec_id", "embedding")
    vectors = vectors.filter("vec_id % 5 = 0").drop("vec_id")
    return items.join(vectors, "question_id").withColumn("database_name", F.lit(CORPUS))


def corpus_texts(spark: SparkSession, sf: str) -> DataFrame:
    return spread_table(spark, sf, "documents", "doc_id", "text").select(F.col("doc_id").alias("unit_id"), F.lit(CORPUS).alias("database_name"), "text")


def corpus_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("unit_id"), F.lit(CORPUS).alias("database_name"), "embedding")


def vector_hits(spark, sf, **blocks):
    return search.vector_search(corpus_questions(spark, sf), corpus_vectors(spark, sf), search.CANDIDATE_LIMIT, **blocks)


def keyword_hits(spark, sf, **blocks):
    return search.keyword_search(
        corpus_questions(spark, sf), corpus_texts(spark, sf), search.CANDIDATE_LIMIT, F.col("text"), **blocks
    )


def search_vector(spark, sf):
    return vector_hits(spark, sf).withColumn("score", F.round("score", 6))


@lru_cache(maxsize=4)
def corpus_index(spark: SparkSession, sf: str) -> VectorIndex:
    """The stored vector index of the corpus."""
    return VectorIndex.build(corpus_vectors(spark, sf), scratch_path(spark, "vector-index"), k=search.CANDIDATE_LIMIT)


@lru_cache(maxsize=4)
def corpus_postings(spark: SparkSession, sf: str) -> PostingsIndex:
    """The stored postings of the corpus."""
    index = PostingsIndex(spark, scratch_path(spark, "postings"), 1)
    index.replace(corpus_texts(spark, sf), text=F.col("text"))
    return index


def search_vector_ann(spark, sf):
    return corpus_index(spark, sf).search(corpus_questions(spark, sf), search.CANDIDATE_LIMIT)


def search_keyword_index(spark, sf):
    return corpus_postings(spark, sf).search(corpus_questions(spark, sf), search.CANDIDATE_LIMIT).withColumn("score", F.round("score", 6))


def search_ann_recall(spark, sf):
    """Hits per question, and whether the index finds 95 % of the exact hits of the questions that it was not calibrated on."""
    near = search_vector_ann(spark, sf).select("question_id", "unit_id")
    calibrated = spark.read.parquet(f"{corpus_index(spark, sf).path}/calibration").select((F.col("unit_id") / 5).alias("question_id"))
    held_out = vector_hits(spark, sf).join(calibrated, "question_id", "left_anti")
    both = held_out.select("question_id", "unit_id").join(near.withColumn("found", F.lit(1)), ["question_id", "unit_id"], "left")
    reached = both.agg((F.coalesce(F.sum("found"), F.lit(0)) >= 0.95 * F.count(F.lit(1))).alias("recall_reached"))  # one row
    return near.groupBy("question_id").agg(F.count(F.lit(1)).alias("hits")).join(F.broadcast(reached))


def search_keyword(spark, sf):
    return keyword_hits(spark, sf).withColumn("score", F.round("score", 6))


def search_rrf(spark, sf):
    fused = search.fuse(vector_hits(spark, sf), keyword_hits(spark, sf), search.CANDIDATE_LIMIT)
    return fused.withColumn("rrf", F.round("rrf", 9))


# ---- warehouses: catalog units, one question per order ---------------------------------------------------------

# What is asked about the order's own database, by o_orderkey % 6.
ASKED = [
    "total order price per customer market segment",
    "which supplier ships the most lineitem quantity by nation",
    "count events by user and event type",
    "part name brand and retail price",
    "documents by language and region",
    "orders with customer names and order returns",
]


def fleet_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every order asks about its customer's warehouse; one in fifty questions is blank."""
    key = F.col("o_orderkey")
    text = F.element_at(F.array(*(F.lit(a) for a in ASKED)), (key % 6 + 1).cast("int"))
    detail = F.concat(text, F.lit(" "), F.lower("o_orderstatus"), F.lit(" "), F.lower("o_orderpriority"))
    wanted = F.when(key % 4 == 1, 3).when(key % 4 == 2, 50).when(key % 4 == 3, -1)
    nations = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return table(spark, sf, "orders").join(grown(nations), "o_custkey").select(
        key.alias("question_id"),
        F.when(key % 50 == 7, F.lit("  ")).otherwise(detail).alias("question"),
        F.concat(F.lit("wh_"), F.col("c_nationkey").cast("string")).alias("database_name"),
        wanted.alias("limit"),
    )


@lru_cache(maxsize=4)
def warehouses(spark: SparkSession, sf: str) -> DataFrame:
    """The nested catalog of the warehouses."""
    owners = table(spark, sf, "customer").select(
        F.concat(F.lit("db_"), F.col("c_custkey").cast("string")).alias("database_name"),
        F.concat(F.lit("wh_"), F.col("c_nationkey").cast("string")).alias("warehouse"),
    )
    same_schema = F.transform("foreign_keys", lambda f: f.withField("ref_schema", F.col("schema_name")))
    moved = nested(spark, sf).join(grown(owners), "database_name").withColumn("schema_name", F.col("database_name"))
    moved = moved.withColumn("database_name", F.col("warehouse")).withColumn("foreign_keys", same_schema).drop("warehouse")
    return cut(moved, "warehouses")


def nodes_and_edges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return graph.nodes(warehouses(spark, sf)), graph.edges_from_nested(warehouses(spark, sf))


def build_units(nested_df: DataFrame) -> DataFrame:
    content = docs.with_token_count(docs.unit_content(nested_df))
    units = content.select(
        F.sha2(F.concat_ws(".", "database_name", "schema_name", "table_name"), 256).alias("unit_id"),
        graph.source_id().alias("source_id"), "database_name", "schema_name", "table_name", F.lit("table").alias("type"),
        "content", "token_count", "dialect",
    )
    return emb.embed(units, "content")


@lru_cache(maxsize=4)
def fleet_units(spark: SparkSession, sf: str) -> DataFrame:
    """The stored units of the warehouses."""
    return cut(build_units(warehouses(spark, sf)), "units")


@lru_cache(maxsize=4)
def asked_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The stored questions with their vectors."""
    return cut(emb.embed_questions(fleet_questions(spark, sf))[0], "questions")


@lru_cache(maxsize=4)
def fleet_retrieval(spark: SparkSession, sf: str) -> Retrieval:
    return retrieve(asked_questions(spark, sf), fleet_units(spark, sf), *nodes_and_edges(spark, sf))


def search_limit(spark, sf):
    return search.with_limits(fleet_questions(spark, sf)).select("question_id", "final_limit", "candidate_limit")


def fleet_hybrid(spark, sf):
    return fleet_retrieval(spark, sf).hybrid.select(
        "question_id", "database_name", "table_name", "vector_rank", "keyword_rank", F.round("rrf", 9).alias("rrf"), "hybrid_rank"
    )


def search_seeds(spark, sf):
    return fleet_retrieval(spark, sf).seeds.select("question_id", "table_name", "hybrid_rank", F.round("hybrid_score", 9).alias("hybrid_score"))


def search_graph(spark, sf):
    return fleet_retrieval(spark, sf).graph.select("question_id", "node_id", "seed_node_id", "distance", "graph_rank")


def search_graph_boost(spark, sf):
    return fleet_retrieval(spark, sf).boosted.select(
        "question_id", "node_id", "graph_matched", "graph_distance", F.round("final_score", 9).alias("final_score")
    )


def search_graph_only(spark, sf):
    return fleet_retrieval(spark, sf).candidates.select(
        "question_id", "node_id", "graph_distance", F.round("final_score", 9).alias("final_score")
    )


def search_unit_fallback(spark, sf):
    """Every foreign-key target looked up as a node; targets whose schema was lost fall back on the table name."""
    lost = graph.table_id("database_name", F.lit("public"), "table_name")
    targets = (
        nodes_and_edges(spark, sf)[1]
        .select("database_name", F.element_at(F.split("dst", r"\."), -1).alias("table_name"), "dst")
        .distinct()
        .withColumn("node_id", F.when(F.length("dst") % 2 == 0, lost).otherwise(F.col("dst")))
    )
    index = search.unit_index(fleet_units(spark, sf))
    return search.with_fallback_unit(targets.select("database_name", "table_name", "node_id", "dst"), index)


def search_final(spark, sf):
    return fleet_retrieval(spark, sf).final.select("question_id", "unit_id", "retrieval_source", "final_rank")


def search_retrieve(spark, sf):
    """The flagship: every question answered end to end, computed afresh."""
    found = retrieve(asked_questions(spark, sf), fleet_units(spark, sf), *nodes_and_edges(spark, sf)).final
    names = fleet_units(spark, sf).select("unit_id", "database_name", "schema_name", "table_name")
    return found.join(grown(names), "unit_id").select(
        "question_id", "final_rank", "database_name", "schema_name", "table_name", "retrieval_source",
        F.round("final_score", 9).alias("final_score"), F.round("rrf", 9).alias("rrf"), "graph_distance",
    )


def unit_lookup(spark, sf):
    key = F.col("c_custkey")
    customers = table(spark, sf, "customer").withColumn(
        "database_name", F.concat(F.lit("wh_"), F.col("c_nationkey").cast("string"))
    )
    exact = customers.filter(key % 2 == 0).select(
        "database_name",
        F.concat(F.lit("db_"), key.cast("string")).alias("schema_name"),
        F.explode(F.array(F.lit("orders"), F.lit("part"), F.lit("nowhere"))).alias("table_name"),
    )
    anywhere = customers.filter(key % 7 == 0).select(
        "database_name", F.lit(None).cast("string").alias("schema_name"), F.lit("order_returns").alias("table_name")
    )
    wanted = exact.unionByName(anywhere)
    found = search.find_units(fleet_units(spark, sf), wanted.unionByName(wanted))
    return found.select("unit_id", "database_name", "schema_name", "table_name")


QUERIES = {
    "search_vector": search_vector,
    "search_vector_ann": search_vector_ann,
    "search_ann_recall": search_ann_recall,
    "search_keyword": search_keyword,
    "search_keyword_index": search_keyword_index,
    "search_rrf": search_rrf,
    "search_limit": search_limit,
    "search_hybrid": fleet_hybrid,
    "search_seeds": search_seeds,
    "search_graph": search_graph,
    "search_graph_boost": search_graph_boost,
    "search_graph_only": search_graph_only,
    "search_unit_fallback": search_unit_fallback,
    "search_final": search_final,
    "search_retrieve": search_retrieve,
    "unit_lookup": unit_lookup,
}


def top(score: str, partition: str = "question_id", k: int | str = 15) -> str:
    return f"CAST(row_number() OVER (PARTITION BY {partition} ORDER BY round({score}, 9) DESC, unit_id) AS INTEGER) AS rank"


def bm25(questions: str, units: str, text: str) -> dict[str, str]:
    """Expressions for BM25 hits of ``questions`` in ``units`` within the same database."""
    p = questions
    return {
        f"{p}_tok": f"SELECT unit_id, database_name, {words(text)} AS toks FROM {units}",
        f"{p}_stat": f"SELECT database_name, count(*) AS n, sum(len(toks)) / count(*)::DOUBLE AS avgdl FROM {p}_tok GROUP BY ALL",
        f"{p}_tf": f"""
            SELECT unit_id, database_name, term, count(*) AS tf, any_value(dl) AS dl
            FROM (SELECT unit_id, database_name, len(toks) AS dl, unnest(toks) AS term FROM {p}_tok) GROUP BY unit_id, database_name, term""",
        f"{p}_df": f"SELECT database_name, term, count(*) AS df FROM {p}_tf GROUP BY ALL",
        f"{p}_terms": f"SELECT DISTINCT question_id, database_name, unnest({words('question')}) AS term FROM {questions}",
        f"{p}_scored": f"""
            SELECT q.question_id, t.unit_id,
                   sum(ln(1 + (s.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) * t.tf * 2.2::DOUBLE
                       / (t.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * t.dl / s.avgdl))) AS score
            FROM {p}_terms q JOIN {p}_tf t USING (database_name, term) JOIN {p}_df d USING (database_name, term)
            JOIN {p}_stat s USING (database_name) GROUP BY ALL""",
        f"{p}_keyword": f"SELECT question_id, unit_id, score, {top('score')} FROM {p}_scored",
    }


def vector_list(rows: str, key: str, text: str) -> str:
    """Hashed embedding of ``text`` per ``key`` as a FLOAT list."""
    return f"""
        SELECT {key}, list(CAST(n / sqrt(s) AS FLOAT) ORDER BY cell) AS embedding FROM (
            SELECT {key}, cell, count(*) FILTER (b = cell) AS n, any_value(s) AS s FROM (
                SELECT {key}, b, s2.s FROM (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b
                    FROM (SELECT {key}, unnest({words(text)}) AS t FROM {rows})) x
                JOIN (SELECT {key}, sum(n * n) AS s FROM (SELECT {key}, b, count(*) AS n FROM (
                    SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b
                    FROM (SELECT {key}, unnest({words(text)}) AS t FROM {rows})) GROUP BY ALL) GROUP BY ALL) s2 USING ({key})
            ) CROSS JOIN range(64) r(cell) GROUP BY {key}, cell) GROUP BY {key}"""


COSINE = "list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[])"

CTES["c_question"] = f"""
    SELECT b.item_id AS question_id, b.text AS question, '{CORPUS}' AS database_name, e.embedding
    FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id * 5"""
CTES["c_text"] = f"SELECT doc_id AS unit_id, '{CORPUS}' AS database_name, text FROM documents"
CTES["c_vector"] = f"""
    SELECT question_id, unit_id, score, {top('score')} FROM (
        SELECT q.question_id, e.vec_id AS unit_id, {COSINE.format('q.embedding', 'e.embedding')} AS score FROM c_question q CROSS JOIN embeddings e)"""
CTES.update(bm25("c_question", "c_text", "text"))
CTES["f_all_question"] = f"""
    SELECT o_orderkey AS question_id, 'wh_' || c_nationkey AS database_name,
           CASE WHEN o_orderkey % 50 = 7 THEN '  ' ELSE
           CASE o_orderkey % 6 {' '.join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(ASKED))} END
           || ' ' || lower(o_orderstatus) || ' ' || lower(o_orderpriority) END AS question,
           CASE o_orderkey % 4 WHEN 1 THEN 3 WHEN 2 THEN 20 ELSE 5 END AS final_limit
    FROM orders JOIN customer ON c_custkey = o_custkey"""
CTES["f_question"] = "SELECT *, greatest(15, final_limit) AS candidate_limit FROM f_all_question WHERE trim(question) <> ''"
CTES["f_unit"] = """
    SELECT sha256(database_name || '.' || schema_name || '.' || table_name) AS unit_id,
           sha256(database_name || ':' || dialect) AS source_id, database_name, dialect, schema_name, table_name, content,
           database_name || '.' || schema_name || '.' || table_name AS node_id FROM w_unit_text"""
CTES["w_edges"] = """
    SELECT 'wh_' || c_nationkey AS database_name, 'wh_' || c_nationkey || '.' || f.database_name || '.' || f.table_name AS src,
           'wh_' || c_nationkey || '.' || f.database_name || '.' || f.ref_table AS dst
    FROM fks f JOIN base_tables b USING (database_name, schema_name, table_name) JOIN customer ON c_custkey = f.c"""
CTES["w_adj"] = """
    SELECT src, dst FROM (SELECT src, dst FROM w_edges UNION SELECT dst, src FROM w_edges)
    WHERE src IN (SELECT node_id FROM f_unit) AND dst IN (SELECT node_id FROM f_unit)"""
CTES["f_unit_text"] = "SELECT unit_id, database_name, table_name || ' ' || schema_name || ' ' || content AS body FROM f_unit"
CTES.update(bm25("f_question", "f_unit_text", "body"))
CTES["f_unit_vec"] = vector_list("f_unit", "unit_id", "content")
CTES["f_question_vec"] = vector_list("f_question", "question_id", "question")
CTES["f_vector"] = f"""
    SELECT question_id, unit_id, score, {top('score')} FROM (
        SELECT q.question_id, u.unit_id, {COSINE.format('qv.embedding', 'uv.embedding')} AS score
        FROM f_question q JOIN f_question_vec qv USING (question_id) JOIN f_unit u USING (database_name) JOIN f_unit_vec uv USING (unit_id))"""


def rrf(p: str) -> str:
    return f"""
        SELECT question_id, unit_id, vector_rank, keyword_rank, rrf,
               CAST(row_number() OVER (PARTITION BY question_id ORDER BY rrf DESC, vector_rank NULLS LAST, keyword_rank NULLS LAST) AS INTEGER) AS hybrid_rank
        FROM (SELECT question_id, unit_id, v.rank AS vector_rank, k.rank AS keyword_rank,
                     coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + k.rank), 0) AS rrf
              FROM {p}_v v FULL JOIN {p}_k k USING (question_id, unit_id))"""


CTES["c_v"] = "SELECT * FROM c_vector WHERE rank <= 15"
CTES["c_k"] = "SELECT * FROM c_question_keyword WHERE rank <= 15"
CTES["c_hybrid"] = rrf("c")
CTES["f_v"] = "SELECT h.* FROM f_vector h JOIN f_question q USING (question_id) WHERE rank <= candidate_limit"
CTES["f_k"] = "SELECT h.* FROM f_question_keyword h JOIN f_question q USING (question_id) WHERE rank <= candidate_limit"
CTES["f_fused"] = rrf("f")
CTES["f_hybrid"] = """
    SELECT h.*, u.source_id, u.database_name, u.schema_name, u.table_name, u.node_id
    FROM f_fused h JOIN f_unit u USING (unit_id) JOIN f_question q USING (question_id) WHERE hybrid_rank <= candidate_limit"""
CTES["f_seed"] = "SELECT * FROM f_hybrid QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY hybrid_rank) <= 3"
CTES["f_walk"] = """
    SELECT question_id, node_id, node_id AS seed_node_id, 0 AS distance, hybrid_rank, rrf FROM f_seed
    UNION ALL SELECT s.question_id, a.dst, s.node_id, 1, s.hybrid_rank, s.rrf FROM f_seed s JOIN w_adj a ON a.src = s.node_id
    UNION ALL SELECT s.question_id, b.dst, s.node_id, 2, s.hybrid_rank, s.rrf FROM f_seed s JOIN w_adj a ON a.src = s.node_id
        JOIN w_adj b ON b.src = a.dst"""
CTES["f_ranked"] = """
    SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY distance, hybrid_rank, rrf DESC, node_id) AS INTEGER) AS graph_rank
    FROM (SELECT * FROM f_walk QUALIFY row_number() OVER (PARTITION BY question_id, node_id ORDER BY distance, hybrid_rank) = 1)"""
CTES["f_graph"] = "SELECT r.* FROM f_ranked r JOIN f_question q USING (question_id) WHERE graph_rank <= candidate_limit"
CTES["f_boost"] = """
    SELECT h.question_id, h.unit_id, h.node_id, h.rrf, g.distance IS NOT NULL AS graph_matched, g.distance AS graph_distance,
           h.rrf + coalesce(0.005::DOUBLE / pow(2, g.distance), 0) AS final_score
    FROM f_hybrid h LEFT JOIN f_graph g USING (question_id, node_id)"""
CTES["f_only"] = """
    SELECT g.question_id, u.unit_id, g.node_id, g.distance AS graph_distance, greatest(0, g.rrf - 0.0005::DOUBLE * g.distance) AS final_score
    FROM f_graph g JOIN f_unit u USING (node_id) ANTI JOIN f_hybrid h USING (question_id, node_id)"""
CTES["f_final"] = """
    SELECT f.*, CAST(row_number() OVER (PARTITION BY question_id ORDER BY final_score DESC, rrf DESC, graph_distance NULLS LAST, unit_id) AS INTEGER) AS final_rank
    FROM (SELECT question_id, unit_id, rrf, final_score, graph_distance, 'hybrid' AS retrieval_source FROM f_boost
          UNION ALL SELECT question_id, unit_id, 0, final_score, graph_distance, 'graph' FROM f_only) f"""
CTES["f_answer"] = "SELECT f.* FROM f_final f JOIN f_question q USING (question_id) WHERE final_rank <= final_limit"

ORACLES = {
    "search_ann_recall": with_ctes(f"""
        SELECT question_id, CAST(least({search.CANDIDATE_LIMIT}, (SELECT count(*) FROM embeddings WHERE len(embedding) > 0)) AS BIGINT) AS hits,
               TRUE AS recall_reached
        FROM c_question WHERE len(embedding) > 0"""),
    "search_vector": with_ctes("SELECT question_id, unit_id, round(round(score, 9), 6) AS score, rank FROM c_vector WHERE rank <= 15"),
    "search_keyword_index": with_ctes("SELECT question_id, unit_id, round(round(score, 9), 6) AS score, rank FROM c_question_keyword WHERE rank <= 15"),
    "search_keyword": with_ctes("SELECT question_id, unit_id, round(round(score, 9), 6) AS score, rank FROM c_question_keyword WHERE rank <= 15"),
    "search_rrf": with_ctes(
        "SELECT question_id, unit_id, vector_rank, keyword_rank, round(rrf, 9) AS rrf, hybrid_rank FROM c_hybrid WHERE hybrid_rank <= 15"
    ),
    "search_limit": with_ctes(
        "SELECT question_id, final_limit, CAST(greatest(15, final_limit) AS INTEGER) AS candidate_limit FROM f_all_question"
    ),
    "search_hybrid": with_ctes(
        "SELECT question_id, database_name, table_name, vector_rank, keyword_rank, round(rrf, 9) AS rrf, hybrid_rank FROM f_hybrid"
    ),
    "search_seeds": with_ctes("SELECT question_id, table_name, hybrid_rank, round(rrf, 9) AS hybrid_score FROM f_seed"),
    "search_graph": with_ctes("SELECT question_id, node_id, seed_node_id, distance, graph_rank FROM f_graph"),
    "search_graph_boost": with_ctes(
        "SELECT question_id, node_id, graph_matched, graph_distance, round(final_score, 9) AS final_score FROM f_boost"
    ),
    "search_graph_only": with_ctes("SELECT question_id, node_id, graph_distance, round(final_score, 9) AS final_score FROM f_only"),
    "search_unit_fallback": with_ctes("""
        SELECT DISTINCT e.database_name, u.table_name,
               CASE WHEN length(e.dst) % 2 = 0 THEN e.database_name || '.public.' || u.table_name ELSE e.dst END AS node_id,
               CASE WHEN length(e.dst) % 2 = 0 THEN m.unit_id ELSE u.unit_id END AS unit_id, e.dst
        FROM w_edges e JOIN f_unit u ON u.node_id = e.dst
        JOIN (SELECT database_name, table_name, min_by(unit_id, node_id) AS unit_id FROM f_unit GROUP BY ALL) m
             ON m.database_name = e.database_name AND m.table_name = u.table_name"""),
    "search_final": with_ctes("SELECT question_id, unit_id, retrieval_source, final_rank FROM f_answer"),
    "search_retrieve": with_ctes("""
        SELECT a.question_id, a.final_rank, u.database_name, u.schema_name, u.table_name, a.retrieval_source,
               round(a.final_score, 9) AS final_score, round(a.rrf, 9) AS rrf, a.graph_distance
        FROM f_answer a JOIN f_unit u USING (unit_id)"""),
    "unit_lookup": with_ctes("""
        SELECT DISTINCT u.unit_id, u.database_name, u.schema_name, u.table_name FROM f_unit u JOIN customer c ON u.database_name = 'wh_' || c.c_nationkey
        WHERE (u.table_name IN ('orders', 'part', 'nowhere') AND c.c_custkey % 2 = 0 AND u.schema_name = 'db_' || c.c_custkey)
           OR (u.table_name = 'order_returns' AND c.c_custkey % 7 = 0)"""),
}
