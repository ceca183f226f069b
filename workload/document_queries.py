"""Documents, token counts and embeddings (D1-D9)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalink.operators import catalog as cat
from catalink.operators import documents as docs
from catalink.operators import embedding as emb
from catalink.session import cut
from catalink.sources import information_schema as info
from workload.inputs import catalog, spread_table, table
from workload.sql_inputs import CTES, with_ctes

K = "database_name, schema_name, table_name"


@lru_cache(maxsize=8)
def nested(spark: SparkSession, sf: str, snapshot: int = 1) -> DataFrame:
    return cat.nested(catalog(spark, sf, snapshot))


@lru_cache(maxsize=8)
def stored_nested(spark: SparkSession, sf: str, snapshot: int = 1) -> DataFrame:
    """The nested catalog written once, for a query that reads it more than once."""
    return cut(nested(spark, sf, snapshot), "nested")


def unit_content(spark, sf):
    return docs.unit_content(nested(spark, sf)).select("database_name", "schema_name", "table_name", "content")


def table_documents(spark, sf):
    return docs.table_documents(nested(spark, sf))


def relationship_documents(spark, sf):
    return docs.relationship_documents(nested(spark, sf))


def summary_documents(spark, sf):
    return docs.summary_documents(info.base_tables(catalog(spark, sf)))


def all_documents(spark, sf):
    return docs.all_documents(nested(spark, sf))


def document_tokens(spark, sf):
    counted = docs.with_token_count(spread_table(spark, sf, "documents", "doc_id", "text"), "text")
    return counted.select("doc_id", F.col("token_count"))


def token_totals(spark, sf):
    return docs.token_totals(spread_table(spark, sf, "documents", "source", "lang", "text"), ["source", "lang"])


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    """Vectors exploded to cells, so that both engines compare plain numbers."""
    return df.select(*keys, F.posexplode("embedding").alias("cell", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 5)
    )


def embed_documents(spark, sf):
    vectors = emb.embed(spread_table(spark, sf, "documents", "doc_id", "text"), "text")
    return _rounded(vectors, "doc_id")


def embed_questions(spark, sf):
    asked = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"))
    vectors, _ = emb.embed_questions(asked)
    return _rounded(vectors, "item_id")


def embed_gate(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "lang")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return emb.embedding_gate(documents.join(vectors, "doc_id", "left"), ["lang"])


QUERIES = {
    "docs_unit_content": unit_content,
    "docs_table": table_documents,
    "docs_relationship": relationship_documents,
    "docs_schema_summary": summary_documents,
    "docs_all": all_documents,
    "docs_token_count": document_tokens,
    "docs_token_totals": token_totals,
    "embed_documents": embed_documents,
    "embed_questions": embed_questions,
    "embed_gate": embed_gate,
}

COLUMN_LINE = (
    "'- ' || column_name || ': ' || data_type || CASE WHEN nullable THEN ', NULL' ELSE ', NOT NULL' END"
    " || CASE WHEN coalesce(default_value, '') <> '' THEN ', DEFAULT ' || default_value ELSE '' END"
)
INDEX_LINE = (
    "'- ' || index_name || ' (' || array_to_string(cols, ', ') || ')' || CASE WHEN is_unique AND is_primary THEN ' [UNIQUE, PRIMARY]'"
    " WHEN is_unique THEN ' [UNIQUE]' WHEN is_primary THEN ' [PRIMARY]' ELSE '' END"
)
WAREHOUSE_TARGET = "database_name || '.' || ref_table || '.' || ref_column"
TARGET = "ref_schema || '.' || ref_table || '.' || ref_column"


def _content(database: str, schema: str, fk_lines: str, source: str) -> str:
    nl = "chr(10)"
    return f"""
        SELECT {database} AS database_name, dialect, {schema} AS schema_name, table_name, c,
               'Database: ' || {database} || {nl} || {nl} || 'Schema: ' || {schema} || {nl} || {nl} || 'Table: ' || table_name
               || {nl} || {nl} || 'Columns:' || {nl} || coalesce(c_lines, '') || {nl} || {nl} || 'Primary Keys:' || {nl} || coalesce(p_lines, 'None')
               || {nl} || {nl} || 'Foreign Keys:' || {nl} || coalesce({fk_lines}, 'None') || {nl} || {nl} || 'Indexes:' || {nl}
               || coalesce(i_lines, 'None') AS content
        FROM {source}"""


def _parts(s: str) -> dict[str, str]:
    nl = "chr(10)"
    return {
        f"doc_parts{s}": f"""
            SELECT b.database_name, b.dialect, b.schema_name, b.table_name, b.c, c.lines AS c_lines, p.lines AS p_lines,
                   f.lines AS f_lines, f.ref_lines, f.w_lines, i.lines AS i_lines
            FROM base_tables{s} b
            LEFT JOIN (SELECT {K}, string_agg({COLUMN_LINE}, {nl} ORDER BY ordinal) AS lines FROM cat_columns{s} GROUP BY ALL) c USING ({K})
            LEFT JOIN (SELECT {K}, string_agg('- ' || column_name, {nl} ORDER BY position) AS lines FROM m_key_columns{s}
                       WHERE constraint_type = 'PRIMARY KEY' GROUP BY ALL) p USING ({K})
            LEFT JOIN (SELECT {K}, string_agg('- ' || column_name || ' → ' || {TARGET}, {nl} ORDER BY position, constraint_name) AS lines,
                       string_agg('- ' || column_name || ' references ' || {TARGET}, {nl} ORDER BY position, constraint_name) AS ref_lines,
                       string_agg('- ' || column_name || ' → ' || {WAREHOUSE_TARGET}, {nl} ORDER BY position, constraint_name) AS w_lines
                       FROM fks{s} GROUP BY ALL) f USING ({K})
            LEFT JOIN (SELECT {K}, string_agg({INDEX_LINE}, {nl} ORDER BY index_name) AS lines FROM idx_flagged{s} GROUP BY ALL) i USING ({K})""",
        f"unit_text{s}": _content("database_name", "schema_name", "f_lines", f"doc_parts{s}"),
    }


CTES.update(_parts(""))
CTES.update(_parts("_2"))
CTES["w_unit_text"] = _content("'wh_' || c_nationkey", "database_name", "w_lines", "doc_parts JOIN customer ON c_custkey = c")
CTES["doc_table"] = """
    SELECT 'table' AS doc_type, database_name, schema_name, table_name,
           'Database: ' || database_name || chr(10) || 'Schema: ' || schema_name || chr(10) || 'Table: ' || table_name || chr(10) || chr(10)
           || 'Columns:' || chr(10) || c_lines || coalesce(chr(10) || chr(10) || 'Primary Keys:' || chr(10) || p_lines, '')
           || coalesce(chr(10) || chr(10) || 'Foreign Keys:' || chr(10) || ref_lines, '')
           || coalesce(chr(10) || chr(10) || 'Indexes:' || chr(10) || i_lines, '') AS content
    FROM doc_parts"""
CTES["doc_relationship"] = f"""
    SELECT 'relationship' AS doc_type, database_name, schema_name, table_name, ref_table AS referenced_table_name,
           'Database: ' || database_name || chr(10) || 'Schema: ' || schema_name || chr(10) || chr(10) || 'Relationship:' || chr(10)
           || schema_name || '.' || table_name || '.' || column_name || chr(10) || 'references' || chr(10) || {TARGET} AS content
    FROM fks"""
CTES["doc_summary"] = """
    SELECT 'schema-summary' AS doc_type, database_name, schema_name,
           'Database: ' || database_name || chr(10) || 'Schema: ' || schema_name || chr(10) || chr(10) || 'Tables:' || chr(10)
           || string_agg('- ' || table_name, chr(10) ORDER BY table_name) AS content
    FROM base_tables GROUP BY database_name, schema_name"""

WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"


def words(text: str) -> str:
    return WORDS.format(text)


def vectors(rows: str, key: str, text: str) -> str:
    """Cells of the hashed embedding of ``text`` per ``key`` of the relation ``rows``."""
    return f"""
        SELECT {key}, CAST(cell AS INTEGER) AS cell, round(CAST(CAST(coalesce(n, 0) / sqrt(s) AS FLOAT) AS DOUBLE), 5) AS value
        FROM (SELECT {key}, sum(n * n) AS s FROM (SELECT {key}, b, count(*) AS n FROM (
                SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b
                FROM (SELECT {key}, unnest({words(text)}) AS t FROM {rows})) GROUP BY ALL) GROUP BY ALL) norms
        CROSS JOIN range(64) r(cell)
        LEFT JOIN (SELECT {key}, b AS cell, count(*) AS n FROM (
                SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b
                FROM (SELECT {key}, unnest({words(text)}) AS t FROM {rows})) GROUP BY ALL) counted USING ({key}, cell)"""


ORACLES = {
    "docs_unit_content": with_ctes(f"SELECT {K}, content FROM unit_text"),
    "docs_table": with_ctes("SELECT * FROM doc_table"),
    "docs_relationship": with_ctes("SELECT * FROM doc_relationship"),
    "docs_schema_summary": with_ctes("SELECT * FROM doc_summary"),
    "docs_all": with_ctes(f"""
        SELECT doc_type, {K}, NULL::VARCHAR AS referenced_table_name, content FROM doc_table
        UNION ALL SELECT doc_type, {K}, referenced_table_name, content FROM doc_relationship
        UNION ALL SELECT doc_type, database_name, schema_name, NULL, NULL, content FROM doc_summary"""),
    "docs_token_count": f"SELECT doc_id, CAST(len({words('text')}) AS INTEGER) AS token_count FROM documents",
    "docs_token_totals": f"""
        SELECT source, lang, count(*) AS documents, CAST(sum(len({words('text')})) AS BIGINT) AS tokens FROM documents GROUP BY ALL""",
    "embed_documents": vectors("documents", "doc_id", "text"),
    "embed_questions": vectors("benchmark", "item_id", "text"),
    "embed_gate": """
        SELECT lang, count(*) AS units, count(*) FILTER (embedding IS NULL OR len(embedding) = 0) AS missing,
               count(*) FILTER (embedding IS NULL OR len(embedding) = 0) = 0 AS complete
        FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY ALL""",
}
