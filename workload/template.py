"""The database template that every customer of the test data owns one drifting copy of.

All values here are fixed inputs. ``only`` keeps a row where ``c_custkey % only = 0`` (1 = always), ``skip`` drops it
where ``c_custkey % skip = 0`` (1 = never), ``since`` is the first snapshot that has the row.
"""

from __future__ import annotations

# table, type, only, drop2 (dropped from snapshot 2 where c_custkey % drop2 = 0; 1 = never), system
TABLES = [
    ("region", "BASE TABLE", 1, 1, False),
    ("nation", "BASE TABLE", 1, 1, False),
    ("customer", "BASE TABLE", 1, 1, False),
    ("supplier", "BASE TABLE", 1, 1, False),
    ("part", "BASE TABLE", 1, 1, False),
    ("orders", "BASE TABLE", 1, 1, False),
    ("lineitem", "BASE TABLE", 1, 1, False),
    ("events", "BASE TABLE", 1, 10, False),
    ("documents", "BASE TABLE", 1, 1, False),
    ("order_returns", "BASE TABLE", 13, 1, False),
    ("order_summary", "VIEW", 17, 1, False),
    ("pg_class", "BASE TABLE", 1, 1, True),
]

# table, ordinal, column, type, type where c_custkey % 11 = 0, nullable, default, only, skip, since
COLUMNS = [
    ("region", 1, "r_regionkey", "integer", None, False, None, 1, 1, 1),
    ("region", 2, "r_name", "varchar", None, False, "'unknown'", 1, 1, 1),
    ("nation", 1, "n_nationkey", "integer", None, False, None, 1, 1, 1),
    ("nation", 2, "n_name", "varchar", None, False, None, 1, 1, 1),
    ("nation", 3, "n_regionkey", "integer", None, True, None, 1, 1, 1),
    ("customer", 1, "c_custkey", "bigint", None, False, None, 1, 1, 1),
    ("customer", 2, "c_name", "varchar", None, False, None, 1, 1, 1),
    ("customer", 3, "c_nationkey", "integer", None, True, None, 1, 1, 1),
    ("customer", 4, "c_acctbal", "double", None, True, "0.0", 1, 1, 1),
    ("customer", 5, "c_mktsegment", "varchar", None, True, "", 1, 1, 1),
    ("customer", 6, "c_loyalty_tier", "varchar", None, True, "'basic'", 5, 1, 2),
    ("supplier", 1, "s_suppkey", "bigint", None, False, None, 1, 1, 1),
    ("supplier", 2, "s_name", "varchar", None, False, None, 1, 1, 1),
    ("supplier", 3, "s_nationkey", "integer", None, True, None, 1, 1, 1),
    ("supplier", 4, "s_acctbal", "double", None, True, None, 1, 1, 1),
    ("part", 1, "p_partkey", "bigint", None, False, None, 1, 1, 1),
    ("part", 2, "p_name", "varchar", None, False, None, 1, 1, 1),
    ("part", 3, "p_brand", "varchar", None, True, None, 1, 1, 1),
    ("part", 4, "p_type", "varchar", None, True, None, 1, 1, 1),
    ("part", 5, "p_size", "integer", "bigint", True, None, 1, 1, 1),
    ("part", 6, "p_retailprice", "double", None, True, None, 1, 1, 1),
    ("orders", 1, "o_orderkey", "bigint", None, False, None, 1, 1, 1),
    ("orders", 2, "o_custkey", "bigint", None, False, None, 1, 1, 1),
    ("orders", 3, "o_orderstatus", "varchar", None, True, "'O'", 1, 1, 1),
    ("orders", 4, "o_totalprice", "double", None, True, None, 1, 1, 1),
    ("orders", 5, "o_orderdate", "timestamp", None, True, "now()", 1, 1, 1),
    ("orders", 6, "o_orderpriority", "varchar", None, True, None, 1, 7, 1),
    ("lineitem", 1, "l_orderkey", "bigint", None, False, None, 1, 1, 1),
    ("lineitem", 2, "l_partkey", "bigint", None, False, None, 1, 1, 1),
    ("lineitem", 3, "l_suppkey", "bigint", None, False, None, 1, 1, 1),
    ("lineitem", 4, "l_linenumber", "integer", None, False, None, 1, 1, 1),
    ("lineitem", 5, "l_quantity", "double", None, True, "1", 1, 1, 1),
    ("lineitem", 6, "l_extendedprice", "double", None, True, None, 1, 1, 1),
    ("lineitem", 7, "l_discount", "double", None, True, None, 1, 1, 1),
    ("lineitem", 8, "l_returnflag", "varchar", None, True, None, 1, 1, 1),
    ("lineitem", 9, "l_shipdate", "timestamp", None, True, None, 1, 1, 1),
    ("events", 1, "event_id", "bigint", None, False, None, 1, 1, 1),
    ("events", 2, "ts", "timestamp", None, False, None, 1, 1, 1),
    ("events", 3, "user_id", "bigint", None, True, None, 1, 1, 1),
    ("events", 4, "event_type", "varchar", None, True, None, 1, 1, 1),
    ("events", 5, "props", "json", None, True, "'{}'", 1, 1, 1),
    ("documents", 1, "doc_id", "bigint", None, False, None, 1, 1, 1),
    ("documents", 2, "text", "text", None, False, None, 1, 1, 1),
    ("documents", 3, "lang", "varchar", None, True, "'en'", 1, 1, 1),
    ("order_returns", 1, "r_orderkey", "bigint", None, False, None, 13, 1, 1),
    ("order_returns", 2, "r_linenumber", "integer", None, False, None, 13, 1, 1),
    ("order_returns", 3, "r_reason", "varchar", None, True, None, 13, 1, 1),
    ("order_summary", 1, "o_orderkey", "bigint", None, True, None, 17, 1, 1),
    ("order_summary", 2, "total", "double", None, True, None, 17, 1, 1),
]

# table, constraint, columns, only
PRIMARY_KEYS = [
    ("region", "region_pkey", ["r_regionkey"], 1),
    ("nation", "nation_pkey", ["n_nationkey"], 1),
    ("customer", "customer_pkey", ["c_custkey"], 1),
    ("supplier", "supplier_pkey", ["s_suppkey"], 1),
    ("part", "part_pkey", ["p_partkey"], 1),
    ("orders", "orders_pkey", ["o_orderkey"], 1),
    ("lineitem", "lineitem_pkey", ["l_orderkey", "l_linenumber"], 1),
    ("documents", "documents_pkey", ["doc_id"], 1),
    ("order_returns", "order_returns_pkey", ["r_linenumber", "r_orderkey"], 13),
]

# table, constraint, columns, referenced table, referenced constraint, referenced columns, only
FOREIGN_KEYS = [
    ("nation", "nation_region_fkey", ["n_regionkey"], "region", "region_pkey", ["r_regionkey"], 1),
    ("customer", "customer_nation_fkey", ["c_nationkey"], "nation", "nation_pkey", ["n_nationkey"], 1),
    ("supplier", "supplier_nation_fkey", ["s_nationkey"], "nation", "nation_pkey", ["n_nationkey"], 1),
    ("orders", "orders_customer_fkey", ["o_custkey"], "customer", "customer_pkey", ["c_custkey"], 1),
    ("lineitem", "lineitem_orders_fkey", ["l_orderkey"], "orders", "orders_pkey", ["o_orderkey"], 1),
    ("lineitem", "lineitem_part_fkey", ["l_partkey"], "part", "part_pkey", ["p_partkey"], 1),
    ("lineitem", "lineitem_supplier_fkey", ["l_suppkey"], "supplier", "supplier_pkey", ["s_suppkey"], 1),
    ("events", "events_customer_fkey", ["user_id"], "customer", "customer_pkey", ["c_custkey"], 1),
    (
        "order_returns", "order_returns_lineitem_fkey", ["r_orderkey", "r_linenumber"],
        "lineitem", "lineitem_pkey", ["l_orderkey", "l_linenumber"], 13,
    ),
]

# table, index, columns, unique, only; the index named *_pkey is called PRIMARY in mysql databases
INDEXES = [
    ("region", "region_pkey", ["r_regionkey"], True, 1),
    ("nation", "nation_pkey", ["n_nationkey"], True, 1),
    ("customer", "customer_pkey", ["c_custkey"], True, 1),
    ("customer", "customer_key_name", ["c_custkey", "c_name"], False, 1),
    ("customer", "customer_name", ["c_name"], True, 1),
    ("supplier", "supplier_pkey", ["s_suppkey"], True, 1),
    ("part", "part_pkey", ["p_partkey"], True, 1),
    ("orders", "orders_pkey", ["o_orderkey"], True, 1),
    ("orders", "orders_key_twin", ["o_orderkey"], False, 1),
    ("orders", "orders_customer", ["o_custkey", "o_orderdate"], False, 1),
    ("lineitem", "lineitem_pkey", ["l_orderkey", "l_linenumber"], True, 1),
    ("lineitem", "lineitem_part_supplier", ["l_suppkey", "l_partkey"], False, 1),
    ("events", "events_ts", ["ts"], False, 1),
    ("documents", "documents_pkey", ["doc_id"], True, 1),
    ("order_returns", "order_returns_pkey", ["r_linenumber", "r_orderkey"], True, 13),
]


def key_rows():
    """table, constraint, type, only, referenced table, referenced constraint"""
    rows = [(t, c, "PRIMARY KEY", only, None, None) for t, c, _, only in PRIMARY_KEYS]
    return rows + [(t, c, "FOREIGN KEY", only, rt, rc) for t, c, _, rt, rc, _, only in FOREIGN_KEYS]


def key_column_rows():
    """table, constraint, type, position, column, only, referenced table, referenced constraint, referenced column"""
    rows = [
        (t, c, "PRIMARY KEY", i + 1, col, only, None, None, None)
        for t, c, cols, only in PRIMARY_KEYS
        for i, col in enumerate(cols)
    ]
    return rows + [
        (t, c, "FOREIGN KEY", i + 1, col, only, rt, rc, rcols[i])
        for t, c, cols, rt, rc, rcols, only in FOREIGN_KEYS
        for i, col in enumerate(cols)
    ]


def index_column_rows():
    """table, index, seq, column, unique, only"""
    return [(t, x, i + 1, c, u, only) for t, x, cols, u, only in INDEXES for i, c in enumerate(cols)]


def index_def_rows():
    """table, index, quoted column list, unique, only"""
    return [
        (t, x, ", ".join(f'"{c}"' if c.endswith("name") else c for c in cols), u, only) for t, x, cols, u, only in INDEXES
    ]
