"""Catalog assembly: one row per table with its columns, keys and indexes nested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalink.session import grown
from catalink.sources import information_schema as info
from catalink.sources.information_schema import TABLE_KEY, Catalog


def _folded(df: DataFrame, order: list[str], fields: list[Column], name: str) -> DataFrame:
    """Child rows of each table as one ordered array. Its size is what one table definition can hold."""
    sort_key = F.struct(*order).alias("o")
    body = F.struct(*fields).alias("v")
    folded = F.array_sort(F.collect_list(F.struct(sort_key, body)))
    return df.groupBy(*TABLE_KEY).agg(F.transform(folded, lambda s: s["v"]).alias(name))


def column_arrays(catalog: Catalog) -> DataFrame:
    fields = [
        F.col("column_name").alias("name"),
        F.col("data_type"),
        F.col("nullable"),
        F.col("default_value"),
    ]
    return _folded(info.columns(catalog), ["ordinal", "column_name"], fields, "columns")


def primary_key_arrays(catalog: Catalog) -> DataFrame:
    folded = _folded(info.primary_keys(catalog), ["position", "column_name"], [F.col("column_name")], "pk")
    return folded.select(*TABLE_KEY, F.transform("pk", lambda s: s["column_name"]).alias("primary_keys"))


def foreign_key_arrays(catalog: Catalog) -> DataFrame:
    fields = [F.col("column_name"), F.col("ref_schema"), F.col("ref_table"), F.col("ref_column")]
    order = ["position", "constraint_name", "column_name", "ref_schema", "ref_table", "ref_column"]
    return _folded(info.foreign_keys(catalog), order, fields, "foreign_keys")


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def primary_flag(dialect: Column, index_name: Column, index_columns: Column, pk: Column, rule: str = "dialect") -> Column:
    """Whether an index is the primary one.

    ``set``   its column set is the primary key's column set (postgresql); an empty key has no primary index
    ``name``  it is called PRIMARY (mysql)
    ``first`` its first column belongs to the primary key (oracle)
    ``dialect`` picks the rule of the table's own dialect.
    """
    rules = {
        "set": same_set(index_columns, pk) & (F.size(pk) > 0),
        "name": index_name == "PRIMARY",
        "first": F.coalesce(F.array_contains(pk, F.get(index_columns, F.lit(0))), F.lit(False)),
    }
    if rule != "dialect":
        return rules[rule]
    return (
        F.when(dialect == "mysql", rules["name"]).when(dialect == "oracle", rules["first"]).otherwise(rules["set"])
    )


def flagged_indexes(catalog: Catalog, rule: str = "dialect") -> DataFrame:
    """Index rows of known tables with their ``is_primary`` flag."""
    tables = info.base_tables(catalog).join(grown(primary_key_arrays(catalog)), TABLE_KEY, "left")
    pk = F.coalesce("primary_keys", F.array().cast("array<string>"))
    flag = primary_flag(F.col("dialect"), F.col("index_name"), F.col("columns"), pk, rule)
    return (
        info.indexes(catalog)
        .join(grown(tables), TABLE_KEY)
        .select(*TABLE_KEY, "index_name", "columns", "is_unique", flag.alias("is_primary"))
    )


def index_arrays(catalog: Catalog, rule: str = "dialect") -> DataFrame:
    fields = [F.col("index_name").alias("name"), F.col("columns"), F.col("is_unique"), F.col("is_primary")]
    return _folded(flagged_indexes(catalog, rule), ["index_name"], fields, "indexes")


def nested(catalog: Catalog, rule: str = "dialect") -> DataFrame:
    """One row per base table, with empty arrays where it has no children; children of unknown tables drop out.

    Tables, columns, constraints, key columns and index columns are stacked and grouped once on the table key: keys are told apart and
    index columns are folded inside the group. Only foreign keys that name a constraint instead of a column are joined beforehand, with
    the columns of that constraint. What is collected is one table's own definition.
    """
    usage, fk_type = catalog.key_usage, "FOREIGN KEY"
    by_name = info.resolved(usage.filter("ref_table IS NULL AND ref_position IS NOT NULL"), catalog)
    by_column = usage.filter("ref_table IS NOT NULL").withColumn("ref_schema", F.coalesce("ref_schema", "database_name"))
    refers = F.struct("constraint_name", "position", "column_name", "ref_schema", "ref_table", "ref_column")
    kinds = [
        ("t", info.base_tables(catalog), F.lit(True)),
        ("c", catalog.columns, F.struct("ordinal", F.col("column_name").alias("name"), "data_type", "nullable", "default_value")),
        ("n", catalog.constraints, F.struct("constraint_name", "constraint_type")),
        ("k", usage, F.struct("constraint_name", "position", "column_name")),
        ("f", by_name, refers),
        ("f", by_column, refers),
        ("x", catalog.index_columns, F.struct("index_name", "seq", "column_name", "is_unique")),
        ("d", info.index_defs_to_arrays(catalog), F.struct(F.col("index_name").alias("name"), "columns", "is_unique")),
    ]
    stacked = None
    for kind, rows, body in kinds:
        part = rows.select(*TABLE_KEY, body.alias(kind))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    grouped = (
        stacked.repartition(*TABLE_KEY)
        .groupBy(*TABLE_KEY)
        .agg(F.max("t").alias("t"), *(F.array_sort(F.collect_list(k)).alias(k) for k in "cnkfxd"))
        .filter("t")
    )

    def of_type(name: str) -> Column:
        kept = F.filter("n", lambda n: n["constraint_type"] == name)
        return F.transform(kept, lambda n: n["constraint_name"])

    primary = F.filter("k", lambda k: F.array_contains(of_type("PRIMARY KEY"), k["constraint_name"]))
    ordered = F.array_sort(F.transform(primary, lambda k: F.struct(k["position"], k["column_name"])))
    foreign = F.filter("f", lambda f: F.array_contains(of_type(fk_type), f["constraint_name"]))
    body = ("position", "constraint_name", "column_name", "ref_schema", "ref_table", "ref_column")
    foreign = F.array_sort(F.transform(foreign, lambda f: F.struct(*(f[b].alias(b) for b in body))))

    def folded(name: Column) -> Column:
        own = F.filter("x", lambda x: x["index_name"] == name)  # sorted by name and place
        unique = F.exists(own, lambda x: x["is_unique"])
        return F.struct(name.alias("name"), F.transform(own, lambda x: x["column_name"]).alias("columns"), unique.alias("is_unique"))

    indexes = F.transform(F.array_distinct(F.transform("x", lambda x: x["index_name"])), folded)
    named = grouped.select(
        *TABLE_KEY,
        F.transform("c", lambda c: c.dropFields("ordinal")).alias("columns"),
        F.transform(ordered, lambda k: k["column_name"]).alias("primary_keys"),
        F.transform(foreign, lambda f: f.dropFields("position", "constraint_name")).alias("foreign_keys"),
        F.array_sort(F.concat(indexes, "d")).alias("i"),
    )
    flag = lambda i: primary_flag(F.col("dialect"), i["name"], i["columns"], F.col("primary_keys"), rule)
    return named.withColumn("indexes", F.transform("i", lambda i: i.withField("is_primary", flag(i)))).drop("i")


def counts(tables: DataFrame) -> DataFrame:
    """Schemas and tables per database: grouped by schema first, so that one huge database is counted in parallel."""
    by_schema = tables.groupBy("database_name", "dialect", "schema_name").agg(F.count(F.lit(1)).alias("n"))
    return by_schema.groupBy("database_name", "dialect").agg(
        F.count(F.lit(1)).alias("schema_count"), F.sum("n").alias("table_count")
    )
