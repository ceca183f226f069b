"""The same derived inputs as DuckDB common table expressions."""

from __future__ import annotations

import re

from workload import template as tpl


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    body = ",\n".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


_DROPPED = " OR ".join(f"(t.table_name = '{t[0]}' AND f.c % {t[3]} = 0)" for t in tpl.TABLES if t[3] > 1)
_PLACE = "f.database_name, f.dialect, f.schema_name, t.table_name"
_MY_KEY = "CASE WHEN f.dialect = 'mysql' AND t.ctype = 'PRIMARY KEY' THEN 'PRIMARY' ELSE t.cname END"
_MY_INDEX = "CASE WHEN f.dialect = 'mysql' AND t.index_name LIKE '%\\_pkey' ESCAPE '\\' THEN 'PRIMARY' ELSE t.index_name END"


def _fleet(snapshot: int, s: str) -> dict[str, str]:
    gone = f" AND NOT ({_DROPPED})" if snapshot >= 2 else ""
    live = f"f.c % t.only_mod = 0{gone}"
    return {
        f"m_tables{s}": f"""
            SELECT f.c, f.database_name, f.dialect, CASE WHEN t.sys THEN 'pg_catalog' ELSE f.schema_name END AS schema_name,
                   t.table_name, t.table_type
            FROM fleet f CROSS JOIN t_tables t
            WHERE {live} AND (NOT t.sys OR f.dialect = 'postgresql') AND (f.dialect <> 'oracle' OR t.table_type = 'BASE TABLE')""",
        f"m_columns{s}": f"""
            SELECT f.c, {_PLACE}, t.column_name,
                   CASE WHEN f.c % 11 = 0 THEN coalesce(t.alt_type, t.data_type) ELSE t.data_type END AS data_type,
                   t.nullable, t.dflt AS default_value, t.ordinal
            FROM fleet f CROSS JOIN t_columns t
            WHERE {live} AND (t.skip_mod = 1 OR f.c % t.skip_mod <> 0) AND t.since <= {snapshot}""",
        f"m_keys{s}": f"""
            SELECT f.c, {_PLACE}, {_MY_KEY} AS constraint_name, t.ctype AS constraint_type
            FROM fleet f CROSS JOIN t_keys t WHERE {live}""",
        f"m_key_columns{s}": f"""
            SELECT f.c, {_PLACE}, {_MY_KEY} AS constraint_name, t.ctype AS constraint_type, t.column_name, t.position,
                   CASE WHEN t.rtable IS NOT NULL THEN f.schema_name END AS ref_schema, t.rtable AS ref_table,
                   t.rcolumn AS ref_column
            FROM fleet f CROSS JOIN t_key_columns t WHERE {live}""",
        f"m_index_columns{s}": f"""
            SELECT f.c, {_PLACE}, {_MY_INDEX} AS index_name, t.seq, t.column_name, t.uniq
            FROM fleet f CROSS JOIN t_index_columns t WHERE {live}""",
        f"m_index_defs{s}": f"""
            SELECT f.c, {_PLACE}, t.index_name, t.uniq,
                   CASE WHEN t.uniq THEN 'CREATE UNIQUE INDEX ' ELSE 'CREATE INDEX ' END || t.index_name || ' ON '
                   || f.schema_name || '.' || t.table_name || ' USING btree (' || t.listed || ')' AS definition
            FROM fleet f CROSS JOIN t_index_defs t WHERE {live} AND f.dialect = 'postgresql'""",
        f"base_tables{s}": f"""
            SELECT c, database_name, dialect, schema_name, table_name FROM m_tables{s}
            WHERE table_type = 'BASE TABLE' AND schema_name NOT IN ('pg_catalog', 'information_schema')""",
        f"cat_columns{s}": f"""
            SELECT m.* FROM m_columns{s} m JOIN base_tables{s} b USING (database_name, dialect, schema_name, table_name)""",
        f"pk_arrays{s}": f"""
            SELECT database_name, dialect, schema_name, table_name, list(column_name ORDER BY position) AS pk
            FROM m_key_columns{s} WHERE constraint_type = 'PRIMARY KEY' GROUP BY ALL""",
        f"idx{s}": f"""
            SELECT database_name, dialect, schema_name, table_name, index_name, list(column_name ORDER BY seq) AS cols,
                   bool_or(uniq) AS is_unique
            FROM m_index_columns{s} GROUP BY ALL""",
        f"idx_flagged{s}": f"""
            SELECT i.*, CASE i.dialect WHEN 'mysql' THEN i.index_name = 'PRIMARY'
                   WHEN 'oracle' THEN list_contains(coalesce(p.pk, []), i.cols[1])
                   ELSE list_sort(list_distinct(i.cols)) = list_sort(list_distinct(coalesce(p.pk, []))) AND len(coalesce(p.pk, [])) > 0
                   END AS is_primary
            FROM idx{s} i JOIN base_tables{s} b USING (database_name, dialect, schema_name, table_name)
            LEFT JOIN pk_arrays{s} p USING (database_name, dialect, schema_name, table_name)""",
        f"fks{s}": f"""
            SELECT c, database_name, dialect, schema_name, table_name, constraint_name, column_name, ref_schema, ref_table,
                   ref_column, position
            FROM m_key_columns{s} WHERE constraint_type = 'FOREIGN KEY'""",
    }


CTES: dict[str, str] = {
    "fleet": """
        SELECT c_custkey AS c, 'db_' || c_custkey AS database_name,
               CASE c_custkey % 3 WHEN 0 THEN 'postgresql' WHEN 1 THEN 'mysql' ELSE 'oracle' END AS dialect,
               CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN 'db_' || c_custkey
                    ELSE upper(c_mktsegment) END AS schema_name
        FROM customer""",
    "t_tables": values(tpl.TABLES, "table_name, table_type, only_mod, drop2, sys"),
    "t_columns": values(
        tpl.COLUMNS,
        "table_name, ordinal, column_name, data_type, alt_type, nullable, dflt, only_mod, skip_mod, since",
    ),
    "t_keys": values(tpl.key_rows(), "table_name, cname, ctype, only_mod, rtable, rname"),
    "t_key_columns": values(
        tpl.key_column_rows(), "table_name, cname, ctype, position, column_name, only_mod, rtable, rname, rcolumn"
    ),
    "t_index_columns": values(tpl.index_column_rows(), "table_name, index_name, seq, column_name, uniq, only_mod"),
    "t_index_defs": values(tpl.index_def_rows(), "table_name, index_name, listed, uniq, only_mod"),
    **_fleet(1, ""),
    **_fleet(2, "_2"),
}


def with_ctes(query: str, extra: dict[str, str] | None = None) -> str:
    """``query`` preceded by exactly the common table expressions it uses, in dependency order."""
    available = {**CTES, **(extra or {})}
    order: list[str] = []

    def visit(text: str, trail: tuple[str, ...]) -> None:
        for name in dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text)):
            if name in available and name not in order and name not in trail:
                visit(available[name], (*trail, name))
                if name not in order:
                    order.append(name)

    visit(query, ())
    if not order:
        return query
    body = ",\n".join(f"{name} AS ({available[name]})" for name in order)
    return f"WITH {body}\n{query}"
