import pytest

from catalink.operators import bounded
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("orders", "customer")}


def test_outer_bound_wins_over_the_inner_limit(spark, tables):
    result = bounded.run(spark, " SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 100000 ; ", tables, 7)
    assert result.columns == ["o_orderkey"] and result.row_count == 7
    top = [r.o_orderkey for r in tables["orders"].orderBy("o_orderkey", ascending=False).limit(7).collect()]
    assert sorted(r.o_orderkey for r in result.rows.collect()) == sorted(top)


def test_inner_sort_and_limit_become_a_top_k(spark, tables):
    rows = bounded.run(spark, "SELECT o_orderkey FROM orders ORDER BY o_totalprice LIMIT 5", tables).rows
    assert "TakeOrderedAndProject" in rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("value,expected", [(None, 100), (0, 1), (-5, 1), (2.9, 2)])
def test_row_bound(value, expected):
    assert bounded.resolve_rows(value) == expected


@pytest.mark.parametrize(
    "sql,why",
    [
        ("DROP TABLE orders", "DROP"),
        ("SELECT 1 FROM orders; SELECT 2 FROM orders", "Multiple"),
        ("SHOW TABLES", "Non-SELECT"),
        ("SELECT * FROM secrets", "secrets"),
        ("SELECT * FROM parquet.`/root/testdata/sf0.001/part.parquet`", "not in retrieved"),
        ("", "empty"),
    ],
)
def test_rejected_statements_never_run(spark, tables, sql, why):
    with pytest.raises(bounded.RejectedQuery, match=why):
        bounded.run(spark, sql, tables)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM (secret)",
        "SELECT * FROM (TABLE secret)",
        "SELECT * FROM (SELECT 1 AS a) x, secret",
        "SELECT * FROM orders AS `o`, secret",
        "SELECT * FROM orders TABLESAMPLE (10 PERCENT), secret",
        "SELECT 1 FROM orders CROSS JOIN (secret)",
        "SELECT a, rank() OVER w FROM secret WINDOW w AS (ORDER BY a), secret AS (ORDER BY b)",
        "SELECT (SELECT max(x) FROM (secret)) AS m FROM orders",
        "SELECT * FROM (parquet.`/root/testdata/sf0.001/part.parquet`)",
        "WITH secret AS (SELECT * FROM (secret)) SELECT * FROM secret",
    ],
)
def test_sources_in_any_place_are_seen(spark, tables, sql):
    spark.range(1).createOrReplaceTempView("secret")
    try:
        assert bounded.foreign_sources(spark, sql, list(tables))
        with pytest.raises(bounded.RejectedQuery):
            bounded.run(spark, sql, tables)
    finally:
        spark.catalog.dropTempView("secret")


def test_given_tables_are_no_foreign_source(spark, tables):
    for sql in (
        "SELECT * FROM (orders)", "SELECT * FROM ORDERS o, (SELECT * FROM customer) c", "WITH a AS (TABLE orders) SELECT * FROM a CROSS JOIN range(3)",
        "SELECT x FROM orders LATERAL VIEW explode(array(1, 2)) t AS x", "SELECT 'FROM secret' AS a FROM orders -- FROM secret",
    ):
        assert bounded.foreign_sources(spark, sql, list(tables)) == []


def test_trailing_comment_and_cte(spark, tables):
    rows = bounded.run(spark, "WITH big AS (SELECT * FROM orders) SELECT count(*) AS n FROM big -- all", tables).rows.collect()
    assert rows[0].n == tables["orders"].count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("t_")]


@pytest.mark.parametrize(
    "call",
    [
        "reflect('java.lang.System', 'getProperty', 'user.home')", "java_method('java.lang.System', 'getenv', 'HOME')", "try_reflect('java.lang.System', 'getenv', 'HOME')",
        "`reflect`('java.lang.System', 'getProperty', 'user.home')", "input_file_name()", "own_function(1)", "some.catalog.f(1)", "nowhere(1)", "current_user()",
        "transform(array(1), x -> reflect /* a */ ('java.lang.System', 'getenv', 'HOME'))", "uuid()", "ABS(raise_error('x'))",
        "array(" + ", ".join(["1"] * 60) + ", Reflect('java.lang.System', 'getenv', 'HOME'))", "(SELECT max(java_method('a', 'b')) FROM orders)",
    ],
)
def test_functions_that_leave_the_row_never_run(spark, tables, call):
    spark.udf.register("own_function", lambda x: x, "int")
    for sql in (f"SELECT {call} AS x", f"SELECT 1 FROM orders WHERE {call} IS NULL", f"WITH a AS (SELECT {call} AS x FROM orders) SELECT * FROM a"):
        with pytest.raises(bounded.RejectedQuery, match="not allowed|not in retrieved"):
            bounded.run(spark, sql, tables)


def test_built_in_functions_are_allowed(spark, tables):
    sql = """
        SELECT upper(o_orderstatus) AS s, typeof(1) AS t, 'reflect(1)' AS r, sum(CAST(o_totalprice AS decimal(20, 2))) FILTER (WHERE o_orderkey IN (1, 2)) AS v,
               rank() OVER (ORDER BY count(*)) AS p, transform(collect_list(o_orderkey), x -> coalesce(x, 0)) AS l, date_trunc('year', max(o_orderdate)) AS d
        FROM orders WHERE exists (SELECT 1 FROM customer WHERE c_custkey = o_custkey) GROUP BY upper(o_orderstatus)"""
    assert bounded.foreign_functions(spark, sql) == []
    assert bounded.run(spark, sql, tables).row_count > 0


def test_the_envelope_has_rows_and_time(spark, tables):
    done = bounded.execute(spark, "SELECT o_orderkey FROM orders ORDER BY o_orderkey", tables, 3)
    assert done.columns == ["o_orderkey"] and done.row_count == 3 and done.error is None and done.execution_ms > 0
    failed = bounded.execute(spark, "SELECT CAST(o_orderstatus AS int) AS x FROM orders", tables)
    assert failed.rows == [] and failed.error and "longer" not in failed.error


def test_a_long_statement_is_interrupted(spark, tables):
    # Many short tasks: a task that runs ends by itself, the others are not begun.
    many = {"orders": tables["orders"].repartition(400), "customer": tables["customer"]}
    slow = "SELECT count(*) AS n FROM orders a CROSS JOIN customer b CROSS JOIN customer c WHERE sha2(concat(a.o_orderkey, b.c_name, c.c_name), 512) = 'x'"
    done = bounded.execute(spark, slow, many, time_limit=2)
    assert done.rows == [] and done.error == "Statement ran longer than 2 s" and 2_000 <= done.execution_ms < 20_000
    assert bounded.execute(spark, "SELECT 1 AS one", tables).row_count == 1
