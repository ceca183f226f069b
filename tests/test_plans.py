"""Properties of physical plans that matter at scale."""

import re

from pyspark.sql import functions as F

from catalink.functions.ranking import top_k
from catalink.operators import audit, graph, search
from catalink.session import cut
from tests.conftest import SMALL
from workload.audit_queries import query_log
from workload.document_queries import nested
from workload.graph_queries import row_adjacency, row_edges, row_nodes
from workload.search_queries import corpus_questions, corpus_vectors


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def joins_all_pairs(text: str) -> bool:
    return "CartesianProduct" in text or "BroadcastNestedLoopJoin" in text


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(top_k(spark.range(100).withColumn("k", F.col("id") % 3), ["k"], [F.col("id")], 5))
    assert text.count("WindowGroupLimit") == 2 and text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_hub_neighbours_are_cut_before_the_shuffle(spark):
    text = plan(graph.nearest_neighbours(row_adjacency(spark, SMALL), 20))
    assert "WindowGroupLimit" in text and "Partial" in text and not joins_all_pairs(text)


def test_small_question_sets_leave_the_units_where_they_are(spark):
    text = plan(search.vector_search(corpus_questions(spark, SMALL), corpus_vectors(spark, SMALL), 5))
    assert not joins_all_pairs(text) and text.count("Exchange") == 1  # only the merge of local hits


def test_search_reads_only_what_it_needs(spark, tmp_path):
    units = corpus_vectors(spark, SMALL).select(
        "unit_id", F.lit("s").alias("source_id"), "database_name", F.lit("x").alias("schema_name"),
        F.col("unit_id").cast("string").alias("table_name"), F.lit("text").alias("content"), "embedding")
    units.write.parquet(f"{tmp_path}/units")
    text = plan(search.unit_index(spark.read.parquet(f"{tmp_path}/units")))
    schemas = " ".join(re.findall(r"ReadSchema: (.*)", text))
    assert "embedding" not in schemas and "content" not in schemas


def test_audit_never_shuffles(spark):
    log = spark.read.parquet(f"{SMALL}/orders.parquet").select(
        F.lit("select 1").alias("sql"), F.lit("Table: a").alias("schema_context"), F.lit("mysql").alias("dialect"))
    assert "Exchange" not in plan(audit.issues(audit.audit(log), "dialect"))
    assert plan(audit.rollup(audit.audit(query_log(spark, SMALL)))).count("Exchange") <= 2


def test_nesting_groups_once(spark):
    text = plan(nested(spark, SMALL))
    assert text.count("ObjectHashAggregate") + text.count("SortAggregate") <= 8 and not joins_all_pairs(text)


def test_adjacency_has_no_all_pairs_join(spark):
    assert not joins_all_pairs(plan(graph.adjacency(row_nodes(spark, SMALL), row_edges(spark, SMALL))))


def test_block_path_has_no_all_pairs_join(spark):
    questions, units = cut(corpus_questions(spark, SMALL), "q"), cut(corpus_vectors(spark, SMALL), "u")
    hits = search.vector_search(questions, units, 5, broadcast_questions=0, unit_block=64, question_block=8)
    assert not joins_all_pairs(plan(hits))
