"""A film rental database in the raw postgresql layout."""

from __future__ import annotations

from catalink.operators import catalog as cat
from catalink.sources import information_schema as info

COLUMNS = {
    "film": [("film_id", "integer", "NO", None), ("title", "varchar", "NO", "'untitled'"), ("note", "text", "YES", "")],
    "inventory": [("inventory_id", "integer", "NO", None), ("film_id", "integer", "NO", None)],
    "rental": [("rental_id", "integer", "NO", None), ("inventory_id", "integer", "NO", None)],
    "film_category": [("film_id", "integer", "NO", None), ("category_id", "integer", "NO", None)],
    "category": [("category_id", "integer", "NO", None), ("name", "varchar", "YES", None)],
    "scratch": [],
}
PKS = {
    "film": ["film_id"], "inventory": ["inventory_id"], "rental": ["rental_id"], "film_category": ["film_id", "category_id"],
    "category": ["category_id"],
}
FKS = [
    ("inventory", "film_id", "film", "film_id"),
    ("rental", "inventory_id", "inventory", "inventory_id"),
    ("film_category", "film_id", "film", "film_id"),
    ("film_category", "category_id", "category", "category_id"),
]
INDEXES = [
    ("film", "film_pkey", "CREATE UNIQUE INDEX film_pkey ON public.film USING btree (film_id)"),
    ("film", "film_title", 'CREATE INDEX film_title ON public.film USING btree ("title", note)'),
    ("film_category", "fc_pkey", "CREATE UNIQUE INDEX fc_pkey ON public.film_category USING btree (category_id, film_id)"),
    ("scratch", "scratch_expr", "CREATE INDEX scratch_expr ON public.scratch USING btree"),
]


def raw_film(spark, db="rentals", columns=None, fks=None, pks=None, indexes=None, reverse=False):
    columns, fks, pks, indexes = columns or COLUMNS, FKS if fks is None else fks, pks or PKS, INDEXES if indexes is None else indexes
    flip = (lambda rows: list(reversed(rows))) if reverse else list

    def frame(rows, schema):
        return spark.createDataFrame(flip(rows), schema)

    keys = [(db, "public", t, f"{t}_pkey", "PRIMARY KEY") for t in pks]
    keys += [(db, "public", t, f"{t}_{c}_fkey", "FOREIGN KEY") for t, c, _, _ in fks]
    usage = [(db, "public", t, "public", f"{t}_pkey", c, i + 1, None) for t, cols in pks.items() for i, c in enumerate(cols)]
    usage += [(db, "public", t, "public", f"{t}_{c}_fkey", c, 1, PKS[rt].index(rc) + 1) for t, c, rt, rc in fks]
    return {
        "tables": frame([(db, "public", t, "BASE TABLE") for t in columns] + [(db, "public", "report", "VIEW"), (db, "pg_catalog", "pg_class", "BASE TABLE")],
                        "database_name string, table_schema string, table_name string, table_type string"),
        "columns": frame([(db, "public", t, *c, i + 1) for t, cols in columns.items() for i, c in enumerate(cols)] + [(db, "public", "report", "x", "int", "YES", None, 1)],
                         "database_name string, table_schema string, table_name string, column_name string, data_type string, is_nullable string, column_default string, ordinal_position int"),
        "table_constraints": frame(keys, "database_name string, table_schema string, table_name string, constraint_name string, constraint_type string"),
        "key_column_usage": frame(usage, "database_name string, table_schema string, table_name string, constraint_schema string, constraint_name string, column_name string, ordinal_position int, position_in_unique_constraint int"),
        "referential_constraints": frame([(db, "public", f"{t}_{c}_fkey", "public", f"{rt}_pkey") for t, c, rt, _ in fks],
                                         "database_name string, constraint_schema string, constraint_name string, unique_constraint_schema string, unique_constraint_name string"),
        "pg_indexes": frame([(db, "public", *i) for i in indexes], "database_name string, schemaname string, tablename string, indexname string, indexdef string"),
    }


def film_catalog(spark, **changes):
    return info.conform({"postgresql": raw_film(spark, **changes)})


def nested_film(spark, **changes):
    return cat.nested(film_catalog(spark, **changes))
