import pytest
from pyspark.sql import functions as F

from catalink.operators import catalog as cat
from catalink.sources import information_schema as info
from tests.conftest import SMALL
from tests.film import film_catalog, raw_film


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_views_and_system_tables_drop_out(spark, film):
    names = {r.table_name for r in film.collect()}
    assert names == {"film", "inventory", "rental", "film_category", "category", "scratch"}
    columns = info.columns(film_catalog(spark))
    assert columns.filter("table_name = 'report'").isEmpty()


def test_tables_without_children_keep_empty_arrays(film):
    row = film.filter("table_name = 'scratch'").first()
    assert (row.columns, row.primary_keys, row.foreign_keys) == ([], [], [])
    assert [(i.name, i.columns, i.is_primary) for i in row.indexes] == [("scratch_expr", [], False)]


def test_primary_index_rule_set_ignores_order_and_skips_empty_keys(film):
    flags = {i.name: (i.is_unique, i.is_primary) for r in film.collect() for i in r.indexes}
    assert flags == {
        "film_pkey": (True, True), "film_title": (False, False), "fc_pkey": (True, True), "scratch_expr": (False, False),
    }


@pytest.mark.parametrize(
    "dialect,name,columns,pk,expected",
    [
        ("mysql", "PRIMARY", ["x"], ["a"], True),
        ("mysql", "other", ["a"], ["a"], False),
        ("oracle", "other", ["a", "z"], ["a", "b"], True),
        ("oracle", "other", ["z", "a"], ["a", "b"], False),
        ("oracle", "other", [], ["a"], False),
        ("postgresql", "PRIMARY", ["a"], ["a", "b"], False),
        ("postgresql", "twin", ["b", "a"], ["a", "b"], True),
        ("postgresql", "none", [], [], False),
    ],
)
def test_primary_index_rules(spark, dialect, name, columns, pk, expected):
    df = spark.createDataFrame([(dialect, name, columns, pk)], "d string, n string, c array<string>, p array<string>")
    assert df.select(cat.primary_flag(F.col("d"), F.col("n"), F.col("c"), F.col("p"))).first()[0] is expected


def test_quoted_index_columns(spark):
    arrays = {r.index_name: r.columns for r in info.index_defs_to_arrays(film_catalog(spark)).collect()}
    assert arrays["film_title"] == ["title", "note"]
    assert arrays["scratch_expr"] == []


def test_unknown_dialect_is_refused(spark):
    with pytest.raises(ValueError):
        info.conform({"sqlite": {}})
    with pytest.raises(ValueError):
        info.read_files(spark, "sqlite", "/nowhere")


def test_exported_views_are_read_again(spark, tmp_path):
    raw = raw_film(spark)
    for fmt in ("parquet", "json", "csv"):
        for name, df in raw.items():
            writer = df.write.format(fmt)
            (writer.option("header", "true") if fmt == "csv" else writer).save(f"{tmp_path}/{fmt}/{name}")
        again = info.conform({"postgresql": info.read_files(spark, "postgresql", f"{tmp_path}/{fmt}", fmt)})
        assert rows(info.primary_keys(again)) == rows(info.primary_keys(film_catalog(spark)))
        assert rows(info.foreign_keys(again)) == rows(info.foreign_keys(film_catalog(spark)))
        assert rows(info.index_defs_to_arrays(again)) == rows(info.index_defs_to_arrays(film_catalog(spark)))


def test_raw_exports_of_the_other_dialects_are_read_again(spark, tmp_path):
    from workload.inputs import raw_fleet

    fleet = raw_fleet(spark, SMALL)
    for dialect, fmt in (("mysql", "json"), ("oracle", "csv"), ("mysql", "csv"), ("oracle", "json")):
        for name, df in fleet[dialect].items():
            writer = df.write.format(fmt)
            (writer.option("header", "true") if fmt == "csv" else writer).save(f"{tmp_path}/{dialect}-{fmt}/{name}")
        want = info.conform({dialect: fleet[dialect]})
        again = info.conform({dialect: info.read_files(spark, dialect, f"{tmp_path}/{dialect}-{fmt}", fmt)})
        for scan in (info.primary_keys, info.foreign_keys, info.base_tables):
            assert rows(scan(again)) == rows(scan(want)) != []


def test_composite_key_fans_out_only_in_the_unordered_variant(spark):
    raw = raw_film(spark)
    place = ("rentals", "public")

    def more(name, *added):
        raw[name] = raw[name].union(spark.createDataFrame([(*place, *r) for r in added], raw[name].schema))

    # The key names the referenced columns in another order than the unique constraint has them.
    more("table_constraints", ("rental", "two", "FOREIGN KEY"), ("film", "film_xy", "UNIQUE"))
    more("key_column_usage", ("rental", "public", "two", "a", 1, 2), ("rental", "public", "two", "b", 2, 1),
         ("film", "public", "film_xy", "x", 1, None), ("film", "public", "film_xy", "y", 2, None))
    more("referential_constraints", ("two", "public", "film_xy"))
    meta = info.conform({"postgresql": raw})
    pairs = lambda df: rows(df.filter("constraint_name = 'two'").select("column_name", "ref_column"))
    assert pairs(info.foreign_keys_fanout(meta)) == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]
    assert pairs(info.foreign_keys(meta)) == [("a", "y"), ("b", "x")]
    nested = {r.table_name: r for r in cat.nested(meta).collect()}
    assert [(f.column_name, f.ref_column) for f in nested["rental"].foreign_keys if f.ref_table == "film"] == [("a", "y"), ("b", "x")]


def test_constraints_of_one_name_on_two_tables(spark):
    raw = raw_film(spark)
    place = ("rentals", "public")

    def more(name, *added):
        raw[name] = raw[name].union(spark.createDataFrame([(*place, *r) for r in added], raw[name].schema))

    more("table_constraints", ("scratch", "same", "FOREIGN KEY"), ("category", "same", "FOREIGN KEY"))
    more("key_column_usage", ("scratch", "public", "same", "f", 1, 1), ("category", "public", "same", "g", 1, 1))
    more("referential_constraints", ("same", "public", "film_pkey"), ("same", "public", "film_pkey"))
    found = info.foreign_keys(info.conform({"postgresql": raw})).filter("constraint_name = 'same'")
    assert rows(found.select("table_name", "column_name", "ref_table", "ref_column")) == [("category", "g", "film", "film_id"), ("scratch", "f", "film", "film_id")]


def test_sources_of_one_name_stay_apart(spark):
    from catalink.operators import graph
    from workload.inputs import raw_fleet

    mysql = {n: df.withColumn("database_name", F.lit("shop")).withColumn("TABLE_SCHEMA", F.lit("public")) for n, df in raw_fleet(spark, SMALL)["mysql"].items()}
    mysql["key_column_usage"] = mysql["key_column_usage"].withColumn("REFERENCED_TABLE_SCHEMA", F.lit("public"))
    mysql = {n: df.filter("TABLE_NAME = 'nation'").distinct() for n, df in mysql.items()}
    postgresql = {n: df.withColumn("database_name", F.lit("shop")) for n, df in raw_film(spark, columns={"nation": [("only_here", "integer", "NO", None)]}, fks=[], pks={"nation": ["only_here"]}).items()}
    meta = info.conform({"postgresql": postgresql, "mysql": mysql})
    found = {r.dialect: r for r in cat.nested(meta).filter("table_name = 'nation'").collect()}
    assert {c.name for c in found["postgresql"].columns} == {"only_here"} and found["postgresql"].primary_keys == ["only_here"]
    assert "n_name" in {c.name for c in found["mysql"].columns} and found["mysql"].primary_keys == ["n_nationkey"]
    nested = cat.nested(meta)
    sizes = graph.stats(graph.nodes(nested), graph.edges_from_nested(nested)).collect()
    assert sorted((r.nodes, r.edges) for r in sizes) == [(1, 0), (1, 1)]


def test_nesting_groups_once(spark):
    """Beside the one grouping, only the joins that find a named constraint's columns shuffle."""
    plan = cat.nested(film_catalog(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") <= 3 and plan.count("Join") <= 2


def test_counts(film):
    row = cat.counts(film).first()
    assert (row.schema_count, row.table_count) == (1, 6)
