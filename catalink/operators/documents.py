"""Text documents written from nested catalog rows; every format is a pure column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalink.functions.text import token_count

NEWLINE = "\n"


def _lines(items: Column) -> Column:
    return F.array_join(items, NEWLINE)


def _column_lines() -> Column:
    def line(c: Column) -> Column:
        default = F.when(F.coalesce(c["default_value"], F.lit("")) != "", F.concat(F.lit(", DEFAULT "), c["default_value"]))
        return F.concat(
            F.lit("- "), c["name"], F.lit(": "), c["data_type"],
            F.when(c["nullable"], ", NULL").otherwise(", NOT NULL"), F.coalesce(default, F.lit("")),
        )

    return _lines(F.transform("columns", line))


def _key_lines() -> Column:
    return _lines(F.transform("primary_keys", lambda k: F.concat(F.lit("- "), k)))


def _target(fk: Column) -> Column:
    return F.concat_ws(".", fk["ref_schema"], fk["ref_table"], fk["ref_column"])


def _fk_lines(word: str) -> Column:
    return _lines(
        F.transform("foreign_keys", lambda f: F.concat(F.lit("- "), f["column_name"], F.lit(f" {word} "), _target(f)))
    )


def _index_lines(legacy_suffix: bool) -> Column:
    def suffix(i: Column) -> Column:
        if legacy_suffix:
            opened = F.when(i["is_unique"], " [UNIQUE").otherwise(" [")
            return F.concat(opened, F.when(i["is_primary"], ", PRIMARY").otherwise(""), F.lit("]"))
        marks = F.concat_ws(", ", F.when(i["is_unique"], "UNIQUE"), F.when(i["is_primary"], "PRIMARY"))
        return F.when(marks != "", F.concat(F.lit(" ["), marks, F.lit("]"))).otherwise("")

    return _lines(
        F.transform(
            "indexes",
            lambda i: F.concat(F.lit("- "), i["name"], F.lit(" ("), F.array_join(i["columns"], ", "), F.lit(")"), suffix(i)),
        )
    )


def unit_content(nested: DataFrame, legacy_suffix: bool = False) -> DataFrame:
    """The indexed text of each table. ``Table: <name>`` on its own line is what the audit reads back."""

    def or_none(array: str, text: Column) -> Column:
        return F.when(F.size(array) > 0, text).otherwise("None")

    blank = F.lit("")
    content = F.concat_ws(
        NEWLINE,
        F.concat(F.lit("Database: "), "database_name"), blank,
        F.concat(F.lit("Schema: "), "schema_name"), blank,
        F.concat(F.lit("Table: "), "table_name"), blank,
        F.lit("Columns:"), _column_lines(), blank,
        F.lit("Primary Keys:"), or_none("primary_keys", _key_lines()), blank,
        F.lit("Foreign Keys:"), or_none("foreign_keys", _fk_lines("→")), blank,
        F.lit("Indexes:"), or_none("indexes", _index_lines(legacy_suffix)),
    )
    return nested.select("database_name", "dialect", "schema_name", "table_name", content.alias("content"))


DOCUMENT_COLUMNS = ["doc_type", "database_name", "schema_name", "table_name", "referenced_table_name", "content"]


def table_documents(nested: DataFrame) -> DataFrame:
    """One document per table; sections without entries are left out."""

    def section(array: str, title: str, text: Column) -> Column:
        return F.when(F.size(array) > 0, F.concat(F.lit(f"\n\n{title}:\n"), text)).otherwise("")

    content = F.concat(
        F.lit("Database: "), "database_name",
        F.lit("\nSchema: "), "schema_name",
        F.lit("\nTable: "), "table_name",
        F.lit("\n\nColumns:\n"), _column_lines(),
        section("primary_keys", "Primary Keys", _key_lines()),
        section("foreign_keys", "Foreign Keys", _fk_lines("references")),
        section("indexes", "Indexes", _index_lines(False)),
    )
    return nested.select(
        F.lit("table").alias("doc_type"), "database_name", "schema_name", "table_name", content.alias("content")
    )


def relationship_documents(nested: DataFrame) -> DataFrame:
    """One document per foreign-key column."""
    fk = F.col("fk")
    source = F.concat_ws(".", "schema_name", "table_name", fk["column_name"])
    content = F.concat(
        F.lit("Database: "), "database_name", F.lit("\nSchema: "), "schema_name",
        F.lit("\n\nRelationship:\n"), source, F.lit("\nreferences\n"), _target(fk),
    )
    return nested.select("database_name", "schema_name", "table_name", F.explode("foreign_keys").alias("fk")).select(
        F.lit("relationship").alias("doc_type"),
        "database_name",
        "schema_name",
        "table_name",
        fk["ref_table"].alias("referenced_table_name"),
        content.alias("content"),
    )


def summary_documents(tables: DataFrame) -> DataFrame:
    """One document per schema that lists its tables; the list is the document, so its size is the schema's size."""
    listed = F.transform(F.array_sort(F.collect_list("table_name")), lambda t: F.concat(F.lit("- "), t))
    by_schema = tables.groupBy("database_name", "dialect", "schema_name").agg(listed.alias("listed"))
    content = F.concat(
        F.lit("Database: "), "database_name", F.lit("\nSchema: "), "schema_name", F.lit("\n\nTables:\n"), _lines(F.col("listed"))
    )
    return by_schema.select(
        F.lit("schema-summary").alias("doc_type"), "database_name", "schema_name", content.alias("content")
    )


def all_documents(nested: DataFrame) -> DataFrame:
    parts = [summary_documents(nested), table_documents(nested), relationship_documents(nested)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select(*DOCUMENT_COLUMNS)


def with_token_count(df: DataFrame, text: str = "content") -> DataFrame:
    return df.withColumn("token_count", token_count(F.col(text)))


def token_totals(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Documents and tokens per key; the text is reduced to a number before anything is shuffled."""
    return (
        df.select(*keys, token_count(F.col(text)).alias("n"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"))
    )
