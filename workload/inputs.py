"""Inputs derived by Spark from the given tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalink.session import cut, spread
from catalink.sources import information_schema as info
from workload import template as tpl
from workload.sql_inputs import literal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TASK_ROWS = 10_000  # rows of a task that is heavy per row


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The needed columns of a table, dealt out over the cores in tasks of bounded size, for work that is heavy per row."""
    return spread(table(spark, sf_dir, name).select(*columns), TASK_ROWS)


# ---- fleet catalog: one drifting copy of the template per customer ---------------------------------------------


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    dialect = F.when(c % 3 == 0, "postgresql").when(c % 3 == 1, "mysql").otherwise("oracle")
    database = F.concat(F.lit("db_"), c.cast("string"))
    schema = (
        F.when(c % 3 == 0, F.lower("c_mktsegment")).when(c % 3 == 1, database).otherwise(F.upper("c_mktsegment"))
    )
    return spread_table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").select(
        c.alias("c"), database.alias("database_name"), dialect.alias("dialect"), schema.alias("schema_name")
    )


def _templated(dbs: DataFrame, rows: list[tuple], schema: list[str]) -> DataFrame:
    """Each database row times the fixed template rows, held as a literal array in the plan."""
    names, kinds = zip(*(s.split(":") for s in schema))
    structs = (
        "struct(" + ", ".join(f"CAST({literal(v)} AS {k}) AS `{n}`" for v, k, n in zip(row, kinds, names)) + ")" for row in rows
    )
    return dbs.select("*", F.inline(F.expr(f"array({', '.join(structs)})")))


def _live(df: DataFrame, snapshot: int) -> DataFrame:
    """Template rows present in this database and snapshot, and whose table is present too."""
    out = df.filter(F.col("c") % F.col("only") == 0)
    dropped = [t for t in tpl.TABLES if t[3] > 1]
    if snapshot >= 2:
        for name, _, _, drop2, _ in dropped:
            out = out.filter(~((F.col("table_name") == name) & (F.col("c") % drop2 == 0)))
    return out


def raw_fleet(spark: SparkSession, sf_dir: str, snapshot: int = 1) -> dict[str, dict[str, DataFrame]]:
    """The fleet's metadata in the raw layout of each dialect."""
    dbs = fleet(spark, sf_dir)
    tables = _live(
        _templated(dbs, tpl.TABLES, ["table_name:string", "table_type:string", "only:int", "drop2:int", "sys:boolean"]),
        snapshot,
    )
    columns = _live(
        _templated(
            dbs,
            tpl.COLUMNS,
            [
                "table_name:string", "ordinal:int", "column_name:string", "data_type:string", "alt_type:string",
                "nullable:boolean", "dflt:string", "only:int", "skip:int", "since:int",
            ],
        ),
        snapshot,
    )
    columns = columns.filter(
        ((F.col("skip") == 1) | (F.col("c") % F.col("skip") != 0)) & (F.col("since") <= snapshot)
    ).withColumn("data_type", F.when(F.col("c") % 11 == 0, F.coalesce("alt_type", "data_type")).otherwise(F.col("data_type")))
    keys = _live(
        _templated(
            dbs,
            tpl.key_rows(),
            ["table_name:string", "cname:string", "ctype:string", "only:int", "rtable:string", "rname:string"],
        ),
        snapshot,
    )
    key_columns = _live(
        _templated(
            dbs,
            tpl.key_column_rows(),
            [
                "table_name:string", "cname:string", "ctype:string", "position:int", "column_name:string", "only:int",
                "rtable:string", "rname:string", "rcolumn:string",
            ],
        ),
        snapshot,
    )
    index_columns = _live(
        _templated(
            dbs,
            tpl.index_column_rows(),
            ["table_name:string", "index_name:string", "seq:int", "column_name:string", "uniq:boolean", "only:int"],
        ),
        snapshot,
    )
    index_defs = _live(
        _templated(
            dbs,
            tpl.index_def_rows(),
            ["table_name:string", "index_name:string", "listed:string", "uniq:boolean", "only:int"],
        ),
        snapshot,
    )

    def of(df: DataFrame, dialect: str) -> DataFrame:
        return df.filter(F.col("dialect") == dialect)

    def pg(df: DataFrame, *cols: Column | str) -> DataFrame:
        return of(df, "postgresql").select("database_name", F.col("schema_name").alias("table_schema"), "table_name", *cols)

    def my(df: DataFrame, *cols: Column | str) -> DataFrame:
        place = [F.col("schema_name").alias("TABLE_SCHEMA"), F.col("table_name").alias("TABLE_NAME")]
        return of(df, "mysql").select("database_name", *place, *cols)

    def ora(df: DataFrame, *cols: Column | str) -> DataFrame:
        place = [F.col("schema_name").alias("OWNER"), F.col("table_name").alias("TABLE_NAME")]
        return of(df, "oracle").select("database_name", *place, *cols)

    def as_(name: str, alias: str) -> Column:
        return F.col(name).alias(alias)

    yes_no = F.when(F.col("nullable"), "YES").otherwise("NO")
    user_tables = tables.filter(~F.col("sys"))
    pg_tables = tables.withColumn("schema_name", F.when(F.col("sys"), "pg_catalog").otherwise(F.col("schema_name")))
    my_key = F.when(F.col("ctype") == "PRIMARY KEY", "PRIMARY").otherwise(F.col("cname")).alias("CONSTRAINT_NAME")
    my_index = F.when(F.col("index_name").endswith("_pkey"), "PRIMARY").otherwise(F.col("index_name")).alias("INDEX_NAME")
    definition = F.concat(
        F.when(F.col("uniq"), "CREATE UNIQUE INDEX ").otherwise("CREATE INDEX "),
        "index_name", F.lit(" ON "), "schema_name", F.lit("."), "table_name", F.lit(" USING btree ("), "listed", F.lit(")"),
    )
    ora_type = F.when(F.col("ctype") == "PRIMARY KEY", "P").otherwise("R").alias("CONSTRAINT_TYPE")
    return {
        "postgresql": {
            "tables": pg(pg_tables, "table_type"),
            "columns": pg(
                columns, "column_name", "data_type", yes_no.alias("is_nullable"), as_("dflt", "column_default"),
                as_("ordinal", "ordinal_position"),
            ),
            "table_constraints": pg(keys, as_("cname", "constraint_name"), as_("ctype", "constraint_type")),
            "key_column_usage": pg(
                key_columns, as_("schema_name", "constraint_schema"), as_("cname", "constraint_name"), "column_name",
                as_("position", "ordinal_position"),
                F.when(F.col("ctype") == "FOREIGN KEY", F.col("position")).alias("position_in_unique_constraint"),
            ),
            "referential_constraints": of(keys.filter("ctype = 'FOREIGN KEY'"), "postgresql").select(
                "database_name", as_("schema_name", "constraint_schema"), as_("cname", "constraint_name"),
                as_("schema_name", "unique_constraint_schema"), as_("rname", "unique_constraint_name"),
            ),
            "pg_indexes": of(index_defs, "postgresql").select(
                "database_name", as_("schema_name", "schemaname"), as_("table_name", "tablename"),
                as_("index_name", "indexname"), definition.alias("indexdef"),
            ),
        },
        "mysql": {
            "tables": my(user_tables, as_("table_type", "TABLE_TYPE")),
            "columns": my(
                columns, as_("column_name", "COLUMN_NAME"), as_("data_type", "DATA_TYPE"), yes_no.alias("IS_NULLABLE"),
                as_("dflt", "COLUMN_DEFAULT"), as_("ordinal", "ORDINAL_POSITION"),
            ),
            "table_constraints": my(keys, my_key, as_("ctype", "CONSTRAINT_TYPE")),
            "key_column_usage": my(
                key_columns, my_key, as_("column_name", "COLUMN_NAME"), as_("position", "ORDINAL_POSITION"),
                # Half of the databases leave the referenced schema out.
                F.when((F.col("c") % 2 == 0) & F.col("rtable").isNotNull(), F.col("schema_name")).alias("REFERENCED_TABLE_SCHEMA"),
                as_("rtable", "REFERENCED_TABLE_NAME"), as_("rcolumn", "REFERENCED_COLUMN_NAME"),
            ),
            "statistics": my(
                index_columns, my_index, as_("column_name", "COLUMN_NAME"), as_("seq", "SEQ_IN_INDEX"),
                F.when(F.col("uniq"), 0).otherwise(1).alias("NON_UNIQUE"),
            ),
        },
        "oracle": {
            "all_tables": ora(user_tables.filter("table_type = 'BASE TABLE'")),
            "all_tab_columns": ora(
                columns, as_("column_name", "COLUMN_NAME"), as_("data_type", "DATA_TYPE"),
                F.when(F.col("nullable"), "Y").otherwise("N").alias("NULLABLE"),
                F.concat(F.col("dflt"), F.lit("  ")).alias("DATA_DEFAULT"), as_("ordinal", "COLUMN_ID"),
            ),
            "all_constraints": ora(
                keys, as_("cname", "CONSTRAINT_NAME"), ora_type,
                F.when(F.col("rname").isNotNull(), F.col("schema_name")).alias("R_OWNER"), as_("rname", "R_CONSTRAINT_NAME"),
            ),
            "all_cons_columns": ora(
                key_columns, as_("cname", "CONSTRAINT_NAME"), as_("column_name", "COLUMN_NAME"), as_("position", "POSITION")
            ),
            "all_indexes": of(index_defs, "oracle").select(
                "database_name", as_("schema_name", "OWNER"), as_("schema_name", "TABLE_OWNER"),
                as_("table_name", "TABLE_NAME"), as_("index_name", "INDEX_NAME"),
                F.when(F.col("uniq"), "UNIQUE").otherwise("NONUNIQUE").alias("UNIQUENESS"),
            ),
            "all_ind_columns": of(index_columns, "oracle").select(
                "database_name", as_("schema_name", "INDEX_OWNER"), as_("schema_name", "TABLE_OWNER"),
                as_("index_name", "INDEX_NAME"), as_("column_name", "COLUMN_NAME"), as_("seq", "COLUMN_POSITION"),
            ),
        },
    }


@lru_cache(maxsize=8)
def conformed(spark: SparkSession, sf_dir: str, snapshot: int = 1) -> info.Catalog:
    """The raw layouts of all dialects read into one catalog."""
    return info.conform(raw_fleet(spark, sf_dir, snapshot))


@lru_cache(maxsize=8)
def catalog(spark: SparkSession, sf_dir: str, snapshot: int = 1) -> info.Catalog:
    """The conformed catalog as stored tables, written once per session."""
    lazy = conformed(spark, sf_dir, snapshot)
    return info.Catalog(*(cut(getattr(lazy, member), f"meta-{member}") for member in info.Catalog.MEMBERS))
