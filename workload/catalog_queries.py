"""Catalog scans and assembly (S1-S6, A1-A6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalink.operators import catalog as ops
from catalink.sources import information_schema as info
from workload.inputs import catalog, conformed
from workload.sql_inputs import with_ctes

KEY = ["database_name", "dialect", "schema_name", "table_name"]


def _joined(column: str):
    return F.array_join(column, ",")


def base_tables(spark, sf):
    return info.base_tables(catalog(spark, sf))


def columns(spark, sf):
    return info.columns(catalog(spark, sf)).select(*KEY, "column_name", "data_type", "nullable", "default_value", "ordinal")


def primary_keys(spark, sf):
    return info.primary_keys(catalog(spark, sf))


def fk_fanout(spark, sf):
    return info.foreign_keys_fanout(catalog(spark, sf))


def fk_direct(spark, sf):
    fks = info.foreign_keys_direct(catalog(spark, sf))
    return fks.filter(F.col("ref_table").isNotNull())


def foreign_keys(spark, sf):
    return info.foreign_keys(catalog(spark, sf))


def indexes(spark, sf):
    return info.index_rows_to_arrays(catalog(spark, sf)).select(*KEY, "index_name", _joined("columns").alias("index_columns"), "is_unique")


def index_defs(spark, sf):
    return info.index_defs_to_arrays(catalog(spark, sf)).select(*KEY, "index_name", _joined("columns").alias("index_columns"), "is_unique")


def conformed_columns(spark, sf):
    return conformed(spark, sf).columns


def column_arrays(spark, sf):
    described = F.transform(
        "columns",
        lambda c: F.concat_ws(
            ":", c["name"], c["data_type"], F.when(c["nullable"], "null").otherwise("not null"), F.coalesce(c["default_value"], F.lit("-"))
        ),
    )
    return ops.column_arrays(catalog(spark, sf)).select(*KEY, F.size("columns").alias("n"), F.array_join(described, "|").alias("described"))


def primary_index(spark, sf):
    return ops.flagged_indexes(catalog(spark, sf)).select(*KEY, "index_name", "is_primary")


def nested(spark, sf):
    fk = F.transform("foreign_keys", lambda f: F.concat_ws(".", f["column_name"], f["ref_schema"], f["ref_table"], f["ref_column"]))
    ix = F.transform("indexes", lambda i: F.concat(i["name"], F.lit("("), F.array_join(i["columns"], ","), F.lit(")")))
    return ops.nested(catalog(spark, sf)).select(
        *KEY,
        F.array_join(F.transform("columns", lambda c: c["name"]), ",").alias("column_names"),
        _joined("primary_keys").alias("pk"),
        F.array_join(fk, ",").alias("fks"),
        F.array_join(ix, ",").alias("idxs"),
    )


def counts(spark, sf):
    return ops.counts(info.base_tables(catalog(spark, sf)))


K = "database_name, dialect, schema_name, table_name"

QUERIES = {
    "catalog_base_tables": base_tables,
    "catalog_columns": columns,
    "catalog_primary_keys": primary_keys,
    "catalog_fk_fanout": fk_fanout,
    "catalog_fk_direct": fk_direct,
    "catalog_foreign_keys": foreign_keys,
    "catalog_indexes": indexes,
    "catalog_index_defs": index_defs,
    "catalog_conform": conformed_columns,
    "catalog_column_arrays": column_arrays,
    "catalog_primary_index": primary_index,
    "catalog_nested": nested,
    "catalog_counts": counts,
}

FK_OUT = f"{K}, constraint_name, column_name, ref_schema, ref_table, ref_column, position"

ORACLES = {
    "catalog_base_tables": with_ctes("SELECT database_name, dialect, schema_name, table_name FROM base_tables"),
    "catalog_columns": with_ctes(f"SELECT {K}, column_name, data_type, nullable, default_value, ordinal FROM cat_columns"),
    "catalog_primary_keys": with_ctes(
        f"SELECT {K}, column_name, position FROM m_key_columns WHERE constraint_type = 'PRIMARY KEY'"
    ),
    "catalog_fk_fanout": with_ctes(f"""
        SELECT a.database_name, a.dialect, a.schema_name, a.table_name, a.constraint_name, a.column_name, b.ref_schema, b.ref_table,
               b.ref_column, a.position
        FROM fks a JOIN fks b USING (database_name, dialect, schema_name, constraint_name) WHERE a.dialect <> 'mysql'"""),
    "catalog_fk_direct": with_ctes(f"SELECT {FK_OUT} FROM fks WHERE dialect = 'mysql'"),
    "catalog_foreign_keys": with_ctes(f"SELECT {FK_OUT} FROM fks"),
    "catalog_indexes": with_ctes(
        f"SELECT {K}, index_name, array_to_string(cols, ',') AS index_columns, is_unique FROM idx WHERE dialect <> 'postgresql'"
    ),
    "catalog_index_defs": with_ctes(f"""
        SELECT {K}, index_name, regexp_replace(replace(regexp_extract(definition, '\\(([^)]+)\\)', 1), '"', ''), ',\\s+', ',', 'g') AS index_columns,
               starts_with(definition, 'CREATE UNIQUE INDEX') AS is_unique
        FROM m_index_defs"""),
    "catalog_conform": with_ctes(
        "SELECT database_name, dialect, schema_name, table_name, column_name, data_type, nullable, default_value, ordinal FROM m_columns"
    ),
    "catalog_column_arrays": with_ctes(f"""
        SELECT {K}, CAST(count(*) AS INTEGER) AS n,
               string_agg(column_name || ':' || data_type || ':' || CASE WHEN nullable THEN 'null' ELSE 'not null' END || ':'
                          || coalesce(default_value, '-'), '|' ORDER BY ordinal) AS described
        FROM cat_columns GROUP BY ALL"""),
    "catalog_primary_index": with_ctes(f"SELECT {K}, index_name, is_primary FROM idx_flagged"),
    "catalog_nested": with_ctes(f"""
        SELECT {K},
               coalesce((SELECT string_agg(column_name, ',' ORDER BY ordinal) FROM cat_columns x
                WHERE (x.database_name, x.dialect, x.schema_name, x.table_name) = (b.database_name, b.dialect, b.schema_name, b.table_name)), '') AS column_names,
               coalesce(array_to_string(p.pk, ','), '') AS pk, coalesce(f.s, '') AS fks, coalesce(i.s, '') AS idxs
        FROM base_tables b LEFT JOIN pk_arrays p USING ({K})
        LEFT JOIN (SELECT {K}, string_agg(concat_ws('.', column_name, ref_schema, ref_table, ref_column), ','
                   ORDER BY position, constraint_name) AS s FROM fks GROUP BY ALL) f USING ({K})
        LEFT JOIN (SELECT {K}, string_agg(index_name || '(' || array_to_string(cols, ',') || ')', ',' ORDER BY index_name) AS s
                   FROM idx GROUP BY ALL) i USING ({K})"""),
    "catalog_counts": with_ctes("""
        SELECT database_name, dialect, count(DISTINCT schema_name) AS schema_count, CAST(count(*) AS BIGINT) AS table_count
        FROM base_tables GROUP BY ALL"""),
}
