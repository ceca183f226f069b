"""Readers for the metadata of many databases, conformed to one layout.

Three raw layouts are understood: lower-case ``information_schema`` rows with index definition text (postgresql),
upper-case ``information_schema`` rows (mysql), and owner-keyed dictionary views (oracle). A fleet reader adds the
``database_name`` column to every raw row; all conformed tables start with ``database_name, dialect, schema_name``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalink.functions.text import is_blank
from catalink.session import grown

# Schemas that belong to the database system itself.
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")

DIALECTS = ("postgresql", "mysql", "sqlite", "mssql", "oracle")


@dataclass(frozen=True)
class Catalog:
    """Conformed metadata of a fleet; every member is a DataFrame.

    tables            database_name, dialect, schema_name, table_name, table_type
    columns           ..., table_name, column_name, data_type, nullable, default_value, ordinal
    constraints       ..., table_name, constraint_name, constraint_type, ref_schema, ref_constraint
    key_usage         ..., table_name, constraint_name, column_name, position, ref_schema, ref_table, ref_column, ref_position
    constraint_usage  database_name, dialect, schema_name, constraint_name, ref_schema, ref_table, ref_column, position
                      (the referenced key's columns; ``key_usage.ref_position`` is the ``position`` a column references)
    index_columns     ..., table_name, index_name, column_name, seq, is_unique
    index_defs        ..., table_name, index_name, definition
    """

    tables: DataFrame
    columns: DataFrame
    constraints: DataFrame
    key_usage: DataFrame
    constraint_usage: DataFrame
    index_columns: DataFrame
    index_defs: DataFrame

    MEMBERS = ("tables", "columns", "constraints", "key_usage", "constraint_usage", "index_columns", "index_defs")

    def union(self, other: "Catalog") -> "Catalog":
        return Catalog(*(getattr(self, m).unionByName(getattr(other, m)) for m in self.MEMBERS))


def _null() -> Column:
    return F.lit(None).cast("string")


def _int(name: str) -> Column:
    return F.col(name).cast("int")


EMPTY_INDEX_COLUMNS = (
    "database_name string, dialect string, schema_name string, table_name string, index_name string, "
    "column_name string, seq int, is_unique boolean"
)
EMPTY_INDEX_DEFS = (
    "database_name string, dialect string, schema_name string, table_name string, index_name string, definition string"
)
EMPTY_CONSTRAINT_USAGE = (
    "database_name string, dialect string, schema_name string, constraint_name string, ref_schema string, "
    "ref_table string, ref_column string, position int"
)


def _lower(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.lower() for c in df.columns))


def conform_postgresql(raw: dict[str, DataFrame]) -> Catalog:
    """``raw``: tables, columns, table_constraints, key_column_usage, referential_constraints, pg_indexes, as the views are.

    A foreign key's referenced columns are those of the unique constraint that ``referential_constraints`` names; column i of the key
    references the one at its ``position_in_unique_constraint``. These views know a foreign key by schema and name only: where tables of
    one schema have foreign keys of one name to different tables, each gets the targets of all of them.
    """
    dialect = F.lit("postgresql").alias("dialect")
    place = ["database_name", dialect, F.col("table_schema").alias("schema_name"), "table_name"]
    spark = raw["tables"].sparkSession
    raw = {name: _lower(df) for name, df in raw.items()}
    raw["pg_indexes"] = raw["pg_indexes"].withColumnsRenamed({"schemaname": "table_schema", "tablename": "table_name"})
    visible = {
        name: df.filter(~F.col("table_schema").isin(*SYSTEM_SCHEMAS)) for name, df in raw.items() if name != "referential_constraints"
    }
    referenced = raw["referential_constraints"].alias("fk").join(
        grown(raw["key_column_usage"]).alias("rc"),
        (F.col("fk.database_name") == F.col("rc.database_name"))
        & (F.col("fk.unique_constraint_schema") == F.col("rc.constraint_schema"))
        & (F.col("fk.unique_constraint_name") == F.col("rc.constraint_name")),
    )
    return Catalog(
        tables=visible["tables"].select(*place, "table_type"),
        columns=visible["columns"].select(
            *place,
            "column_name",
            "data_type",
            (F.col("is_nullable") == "YES").alias("nullable"),
            F.col("column_default").alias("default_value"),
            _int("ordinal_position").alias("ordinal"),
        ),
        constraints=visible["table_constraints"].select(
            *place, "constraint_name", "constraint_type", _null().alias("ref_schema"), _null().alias("ref_constraint")
        ),
        key_usage=visible["key_column_usage"].select(
            *place,
            "constraint_name",
            "column_name",
            _int("ordinal_position").alias("position"),
            _null().alias("ref_schema"),
            _null().alias("ref_table"),
            _null().alias("ref_column"),
            _int("position_in_unique_constraint").alias("ref_position"),
        ),
        constraint_usage=referenced.select(
            F.col("fk.database_name").alias("database_name"),
            dialect,
            F.col("fk.constraint_schema").alias("schema_name"),
            F.col("fk.constraint_name").alias("constraint_name"),
            F.col("rc.table_schema").alias("ref_schema"),
            F.col("rc.table_name").alias("ref_table"),
            F.col("rc.column_name").alias("ref_column"),
            F.col("rc.ordinal_position").cast("int").alias("position"),
        ).distinct(),
        index_columns=spark.createDataFrame([], EMPTY_INDEX_COLUMNS),
        index_defs=visible["pg_indexes"].select(
            *place, F.col("indexname").alias("index_name"), F.col("indexdef").alias("definition")
        ),
    )


def conform_mysql(raw: dict[str, DataFrame]) -> Catalog:
    """``raw``: tables, columns, table_constraints, key_column_usage, statistics (upper-case columns)."""
    dialect = F.lit("mysql").alias("dialect")
    place = [
        "database_name",
        dialect,
        F.col("TABLE_SCHEMA").alias("schema_name"),
        F.col("TABLE_NAME").alias("table_name"),
    ]
    spark = raw["tables"].sparkSession
    name = F.col("CONSTRAINT_NAME").alias("constraint_name")
    return Catalog(
        tables=raw["tables"].select(*place, F.col("TABLE_TYPE").alias("table_type")),
        columns=raw["columns"].select(
            *place,
            F.col("COLUMN_NAME").alias("column_name"),
            F.col("DATA_TYPE").alias("data_type"),
            (F.col("IS_NULLABLE") == "YES").alias("nullable"),
            F.col("COLUMN_DEFAULT").alias("default_value"),
            _int("ORDINAL_POSITION").alias("ordinal"),
        ),
        constraints=raw["table_constraints"].select(
            *place,
            name,
            F.col("CONSTRAINT_TYPE").alias("constraint_type"),
            _null().alias("ref_schema"),
            _null().alias("ref_constraint"),
        ),
        key_usage=raw["key_column_usage"].select(
            *place,
            name,
            F.col("COLUMN_NAME").alias("column_name"),
            _int("ORDINAL_POSITION").alias("position"),
            F.col("REFERENCED_TABLE_SCHEMA").alias("ref_schema"),
            F.col("REFERENCED_TABLE_NAME").alias("ref_table"),
            F.col("REFERENCED_COLUMN_NAME").alias("ref_column"),
            _int("ORDINAL_POSITION").alias("ref_position"),
        ),
        constraint_usage=spark.createDataFrame([], EMPTY_CONSTRAINT_USAGE),
        index_columns=raw["statistics"].select(
            *place,
            F.col("INDEX_NAME").alias("index_name"),
            F.col("COLUMN_NAME").alias("column_name"),
            _int("SEQ_IN_INDEX").alias("seq"),
            (F.col("NON_UNIQUE") == 0).alias("is_unique"),
        ),
        index_defs=spark.createDataFrame([], EMPTY_INDEX_DEFS),
    )


def conform_oracle(raw: dict[str, DataFrame]) -> Catalog:
    """``raw``: all_tables, all_tab_columns, all_constraints, all_cons_columns, all_indexes, all_ind_columns."""
    dialect = F.lit("oracle").alias("dialect")
    place = [
        "database_name",
        dialect,
        F.col("OWNER").alias("schema_name"),
        F.col("TABLE_NAME").alias("table_name"),
    ]
    name = F.col("CONSTRAINT_NAME").alias("constraint_name")
    kind = (
        F.when(F.col("CONSTRAINT_TYPE") == "P", "PRIMARY KEY")
        .when(F.col("CONSTRAINT_TYPE") == "R", "FOREIGN KEY")
        .otherwise(F.col("CONSTRAINT_TYPE"))
    )
    spark = raw["all_tables"].sparkSession
    # The referenced constraint's own key columns, seen from the referencing constraint.
    referenced = raw["all_constraints"].filter("CONSTRAINT_TYPE = 'R'").alias("fk").join(
        grown(raw["all_cons_columns"]).alias("rc"),
        (F.col("fk.database_name") == F.col("rc.database_name"))
        & (F.col("fk.R_OWNER") == F.col("rc.OWNER"))
        & (F.col("fk.R_CONSTRAINT_NAME") == F.col("rc.CONSTRAINT_NAME")),
    )
    indexes = raw["all_indexes"].alias("i").join(
        grown(raw["all_ind_columns"]).alias("c"),
        (F.col("i.database_name") == F.col("c.database_name"))
        & (F.col("i.OWNER") == F.col("c.INDEX_OWNER"))
        & (F.col("i.INDEX_NAME") == F.col("c.INDEX_NAME")),
    )
    return Catalog(
        tables=raw["all_tables"].select(*place, F.lit("BASE TABLE").alias("table_type")),
        columns=raw["all_tab_columns"].select(
            *place,
            F.col("COLUMN_NAME").alias("column_name"),
            F.col("DATA_TYPE").alias("data_type"),
            (F.upper("NULLABLE") == "Y").alias("nullable"),
            F.trim("DATA_DEFAULT").alias("default_value"),
            _int("COLUMN_ID").alias("ordinal"),
        ),
        constraints=raw["all_constraints"].select(
            *place,
            name,
            kind.alias("constraint_type"),
            F.col("R_OWNER").alias("ref_schema"),
            F.col("R_CONSTRAINT_NAME").alias("ref_constraint"),
        ),
        key_usage=raw["all_cons_columns"].select(
            *place,
            name,
            F.col("COLUMN_NAME").alias("column_name"),
            _int("POSITION").alias("position"),
            _null().alias("ref_schema"),
            _null().alias("ref_table"),
            _null().alias("ref_column"),
            _int("POSITION").alias("ref_position"),
        ),
        constraint_usage=referenced.select(
            F.col("fk.database_name").alias("database_name"),
            dialect,
            F.col("fk.OWNER").alias("schema_name"),
            F.col("fk.CONSTRAINT_NAME").alias("constraint_name"),
            F.col("rc.OWNER").alias("ref_schema"),
            F.col("rc.TABLE_NAME").alias("ref_table"),
            F.col("rc.COLUMN_NAME").alias("ref_column"),
            F.col("rc.POSITION").cast("int").alias("position"),
        ),
        index_columns=indexes.select(
            F.col("i.database_name").alias("database_name"),
            dialect,
            F.col("i.TABLE_OWNER").alias("schema_name"),
            F.col("i.TABLE_NAME").alias("table_name"),
            F.col("i.INDEX_NAME").alias("index_name"),
            F.col("c.COLUMN_NAME").alias("column_name"),
            F.col("c.COLUMN_POSITION").cast("int").alias("seq"),
            (F.upper("i.UNIQUENESS") == "UNIQUE").alias("is_unique"),
        ),
        index_defs=spark.createDataFrame([], EMPTY_INDEX_DEFS),
    )


CONFORM = {"postgresql": conform_postgresql, "mysql": conform_mysql, "oracle": conform_oracle}


def conform(raw_by_dialect: dict[str, dict[str, DataFrame]]) -> Catalog:
    """One catalog from the raw layouts of any supported dialects."""
    unknown = set(raw_by_dialect) - set(CONFORM)
    if unknown:
        raise ValueError(f"no metadata reader for dialects: {sorted(unknown)}")
    return reduce(Catalog.union, (CONFORM[d](raw) for d, raw in raw_by_dialect.items()))


# The metadata relations each dialect offers, by the raw name used above.
SYSTEM_RELATIONS = {
    "postgresql": {
        "tables": "information_schema.tables",
        "columns": "information_schema.columns",
        "table_constraints": "information_schema.table_constraints",
        "key_column_usage": "information_schema.key_column_usage",
        "referential_constraints": "information_schema.referential_constraints",
        "pg_indexes": "pg_indexes",
    },
    "mysql": {
        "tables": "information_schema.TABLES",
        "columns": "information_schema.COLUMNS",
        "table_constraints": "information_schema.TABLE_CONSTRAINTS",
        "key_column_usage": "information_schema.KEY_COLUMN_USAGE",
        "statistics": "information_schema.STATISTICS",
    },
    "oracle": {
        "all_tables": "ALL_TABLES",
        "all_tab_columns": "ALL_TAB_COLUMNS",
        "all_constraints": "ALL_CONSTRAINTS",
        "all_cons_columns": "ALL_CONS_COLUMNS",
        "all_indexes": "ALL_INDEXES",
        "all_ind_columns": "ALL_IND_COLUMNS",
    },
}


def _one_owner(dialect: str, relation: str, df: DataFrame, database_name: str, owner: str | None) -> DataFrame:
    """Rows of the connected database only; the filter is pushed to the source."""
    if dialect == "mysql":
        return df.filter(F.col("TABLE_SCHEMA") == database_name)
    if dialect == "oracle":
        key = {"all_indexes": "TABLE_OWNER", "all_ind_columns": "TABLE_OWNER"}.get(relation, "OWNER")
        # Referenced keys may belong to another owner.
        return df if relation == "all_cons_columns" else df.filter(F.col(key) == (owner or "").upper())
    return df


def read_jdbc(
    spark: SparkSession,
    dialect: str,
    database_name: str,
    options: dict[str, str],
    owner: str | None = None,
) -> dict[str, DataFrame]:
    """Raw metadata of one database through the built-in JDBC source; ``options`` holds url, user, driver and so on."""
    if dialect not in SYSTEM_RELATIONS:
        raise ValueError(f"no metadata reader for dialect: {dialect}")
    raw = {}
    for name, relation in SYSTEM_RELATIONS[dialect].items():
        df = spark.read.format("jdbc").options(**options).option("dbtable", relation).load()
        df = _one_owner(dialect, name, df, database_name, owner)
        raw[name] = df.withColumn("database_name", F.lit(database_name))
    return raw


# Columns of these relations that may be null in every row, which a json or csv export then leaves out.
OPTIONAL_COLUMNS = {
    "columns": ["column_default"],
    "key_column_usage": [
        "position_in_unique_constraint", "referenced_table_schema", "referenced_table_name", "referenced_column_name",
    ],
    "referential_constraints": ["unique_constraint_schema", "unique_constraint_name"],
    "all_tab_columns": ["data_default"],
    "all_constraints": ["r_owner", "r_constraint_name"],
    "all_cons_columns": ["position"],
}


def read_files(spark: SparkSession, dialect: str, root: str, fmt: str = "parquet", **options: str) -> dict[str, DataFrame]:
    """Raw metadata exported to ``root/<relation>`` as parquet, csv or json, with the columns of the system views.

    Rows carry ``database_name`` besides; csv files need a header.
    """
    if dialect not in SYSTEM_RELATIONS:
        raise ValueError(f"no metadata reader for dialect: {dialect}")
    if fmt == "csv":
        options = {"header": "true", **options}
    raw = {}
    for name in SYSTEM_RELATIONS[dialect]:
        df = spark.read.format(fmt).options(**options).load(f"{root}/{name}")
        there = {c.lower() for c in df.columns}
        absent = [c for c in OPTIONAL_COLUMNS.get(name, ()) if c not in there]
        raw[name] = df.withColumns({c: _null() for c in absent})
    return raw


# ---- scans over the conformed catalog -------------------------------------------------------------------------

TABLE_KEY = ["database_name", "dialect", "schema_name", "table_name"]


def base_tables(catalog: Catalog) -> DataFrame:
    return catalog.tables.filter(
        (F.col("table_type") == "BASE TABLE") & ~F.col("schema_name").isin(*SYSTEM_SCHEMAS)
    ).select(*TABLE_KEY)


def columns(catalog: Catalog) -> DataFrame:
    """Columns of base tables; columns of views have no base table and drop out."""
    return catalog.columns.join(grown(base_tables(catalog)), TABLE_KEY, "left_semi")


def _constraint_keys(catalog: Catalog, kind: str) -> DataFrame:
    key = [*TABLE_KEY, "constraint_name"]
    named = catalog.constraints.filter(F.col("constraint_type") == kind).select(*key)
    return catalog.key_usage.join(grown(named), key)


def primary_keys(catalog: Catalog) -> DataFrame:
    return _constraint_keys(catalog, "PRIMARY KEY").select(*TABLE_KEY, "column_name", "position")


CONSTRAINT_KEY = ["database_name", "dialect", "schema_name", "constraint_name"]
FK_COLUMNS = [*TABLE_KEY, "constraint_name", "column_name", "ref_schema", "ref_table", "ref_column", "position"]


def foreign_keys_fanout(catalog: Catalog) -> DataFrame:
    """Joined on the constraint only: an n-column key gives n x n rows, as the plain usage views do."""
    keys = _constraint_keys(catalog, "FOREIGN KEY").drop("ref_schema", "ref_table", "ref_column")
    usage = catalog.constraint_usage.drop("position")
    return keys.join(grown(usage), CONSTRAINT_KEY).select(*FK_COLUMNS)


def foreign_keys_direct(catalog: Catalog) -> DataFrame:
    """The usage row itself names the referenced column; a missing schema is the database itself."""
    keys = _constraint_keys(catalog, "FOREIGN KEY")
    return keys.withColumn("ref_schema", F.coalesce("ref_schema", "database_name")).select(*FK_COLUMNS)


def resolved(keys: DataFrame, catalog: Catalog) -> DataFrame:
    """Key columns without a referenced column of their own, joined with the column they reference."""
    usage = catalog.constraint_usage.withColumnRenamed("position", "ref_position")
    return keys.drop("ref_schema", "ref_table", "ref_column").join(grown(usage), [*CONSTRAINT_KEY, "ref_position"])


def foreign_keys(catalog: Catalog) -> DataFrame:
    """Default semantics: each column of a key with the one column it references."""
    keys = _constraint_keys(catalog, "FOREIGN KEY")
    direct = keys.filter(F.col("ref_table").isNotNull()).withColumn("ref_schema", F.coalesce("ref_schema", "database_name"))
    return direct.select(*FK_COLUMNS).unionByName(resolved(keys.filter(F.col("ref_table").isNull()), catalog).select(*FK_COLUMNS))


def index_rows_to_arrays(catalog: Catalog) -> DataFrame:
    """Per-column index rows folded into ordered column arrays."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "column_name")))
    return (
        catalog.index_columns.groupBy(*TABLE_KEY, "index_name")
        .agg(F.transform(ordered, lambda s: s["column_name"]).alias("columns"), F.bool_or("is_unique").alias("is_unique"))
    )


def index_defs_to_arrays(catalog: Catalog) -> DataFrame:
    """Index definition text parsed into the same shape; only the first parenthesised group is read."""
    listed = F.regexp_extract("definition", r"\(([^)]+)\)", 1)
    parts = F.transform(
        F.split(listed, ","), lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), '^"', ""), '"$', "")
    )
    return catalog.index_defs.select(
        *TABLE_KEY,
        "index_name",
        F.when(is_blank(listed), F.array().cast("array<string>")).otherwise(parts).alias("columns"),
        F.col("definition").startswith("CREATE UNIQUE INDEX").alias("is_unique"),
    )


def indexes(catalog: Catalog) -> DataFrame:
    return index_rows_to_arrays(catalog).unionByName(index_defs_to_arrays(catalog))
