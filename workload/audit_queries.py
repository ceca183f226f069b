"""Query-log audit (Q1-Q13): one logged statement per order."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalink.functions import sqltext
from catalink.operators import audit, rollups
from catalink.session import cut, scratch_path
from workload.inputs import spread_table
from workload.sql_inputs import CTES, literal, with_ctes

# The logged statements, by o_orderkey % 32; {k} stands for the order key.
STATEMENTS = [
    "SELECT o_orderkey FROM orders WHERE o_orderkey = {k}",
    "SELECT c.c_name, count(*) FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_name",
    "DROP TABLE orders",
    "DELETE FROM orders WHERE o_orderkey = {k}",
    "update orders SET o_orderstatus = 'F' WHERE o_orderkey = {k}",
    "INSERT INTO orders VALUES ({k})",
    "ALTER TABLE orders ADD COLUMN note int",
    "TRUNCATE TABLE orders",
    "GRANT SELECT ON orders TO app",
    "REVOKE SELECT ON orders FROM app",
    "CREATE TABLE copy AS SELECT * FROM orders",
    "EXECUTE refresh_orders",
    "CALL refresh_orders({k})",
    "LOCK TABLES orders",
    "SELECT o_orderkey FROM orders /* all of them; from elsewhere */",
    "SELECT o_orderkey FROM orders -- where o_orderkey = {k}",
    "SELECT 1 FROM orders; SELECT 2 FROM customer ;",
    "WITH recent AS (SELECT o_custkey FROM orders), top_c (k) AS (SELECT c_custkey FROM customer) SELECT * FROM recent JOIN top_c ON k = o_custkey",
    "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey = {k})",
    "SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders",
    'SELECT o_orderkey, row_number() over(PARTITION BY o_custkey ORDER BY o_totalprice) FROM "public"."orders" --',
    "SELECT extract(year FROM o_orderdate) FROM `shop`.`orders` o, part AS p WHERE o.note = 'from nowhere; -- it''s fine' GROUP BY 1",
    "SELECT a.x FROM Phantom_{k} a JOIN orders ON true JOIN (SELECT 1 FROM region UNION SELECT window FROM events) w ON true GROUP BY a.x",
    "SHOW TABLES",
    "SELECT * FROM (secret)",
    "SELECT * FROM (TABLE secret)",
    "SELECT * FROM (SELECT 1 AS a) x, secret",
    "SELECT o_orderkey FROM orders AS `o`, secret WHERE o_orderkey = {k}",
    "SELECT * FROM orders TABLESAMPLE (10 PERCENT), secret",
    "SELECT 1 FROM orders CROSS JOIN (secret)",
    "SELECT a, rank() OVER w FROM secret WINDOW w AS (ORDER BY a), secret AS (ORDER BY b)",
    "SELECT 'it\\'s' FROM orders, z WHERE x = ' from q'",
]

# What is to be read from each of them: kinds of statements, names of WITH lists, tables, what cannot be read.
READ = [
    (["select"], [], ["orders"], []),
    (["select"], [], ["customer", "orders"], []),
    (["drop"], [], [], []),
    (["delete"], [], ["orders"], []),
    (["update"], [], [], []),
    (["insert"], [], [], []),
    (["alter"], [], [], []),
    (["truncate"], [], [], []),
    (["grant"], [], [], []),
    (["revoke"], [], ["app"], []),
    (["create"], [], ["orders"], []),
    (["execute"], [], [], []),
    (["call"], [], [], []),
    (["lock"], [], [], []),
    (["select"], [], ["orders"], []),
    (["select"], [], ["orders"], []),
    (["select", "select"], [], ["orders", "customer"], []),
    (["select"], ["recent", "top_c"], ["customer", "orders"], []),
    (["select"], [], ["nation", "customer"], []),
    (["select"], [], ["customer", "orders"], []),
    (["select"], [], ["orders"], []),
    (["select"], [], ["orders", "part"], []),
    (["select"], [], ["Phantom_{k}", "orders", "region", "events"], []),
    (["show"], [], [], []),
    (["select"], [], ["secret"], []),
    (["select"], [], ["secret"], []),
    (["select"], [], ["secret"], []),
    (["select"], [], ["orders", "secret"], []),
    (["select"], [], ["orders", "secret"], []),
    (["select"], [], ["orders", "secret"], []),
    (["select"], [], ["secret"], []),
    (["select"], [], ["q"], ["a backslash before a quote"]),
]
KNOWN = [["customer", "lineitem", "nation", "orders"], ["customer", "events", "nation", "orders", "part", "region"]]

# Stored judge answers, by o_orderkey % 5.
ANSWERS = [
    '{"score": 90, "passed": true, "reasoning": "answers the question", "issues": []}',
    '{"score": 41.5, "passed": false, "reasoning": "wrong join", "issues": [{"severity": "error", "message": "joins on the name"}, {"severity": "warning", "message": "no limit"}]}',
    "{}",
    None,
    '{"score": 77}',
]

# Retrieved schema context, by o_orderkey % 2.
CONTEXTS = [
    'Database: shop\n\nTable: "public"."Orders"\n\nColumns:\n- o_orderkey: bigint\n\n---\n\nTable: customer\n---\nTable: nation, Table: lineitem',
    "Table: orders\nTable: customer\nTable: nation\nTable: part\nTable: region\nTable: shop.events",
]
DIALECTS = ["postgresql", "mysql", "oracle", "mssql", "duck"]


def _pick(values: list, key: Column) -> Column:
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), (key % len(values)).cast("int"))


@lru_cache(maxsize=4)
def query_log(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    key = F.col("o_orderkey")
    return spread_table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate").select(
        *map(F.expr, more),
        key.alias("query_id"),
        F.replace(_pick(STATEMENTS, key), F.lit("{k}"), key.cast("string")).alias("sql"),
        _pick(DIALECTS, F.col("o_custkey")).alias("dialect"),
        _pick(CONTEXTS, key).alias("schema_context"),
        F.when(key % 3 == 0, True).when(key % 3 == 1, False).alias("deep_evaluation"),
        _pick(ANSWERS, key).alias("judge_response"),
    )


def _joined(column: str) -> Column:
    return F.array_join(column, "|")


def safety(spark, sf):
    checked = audit.with_safety(query_log(spark, sf))
    return checked.select("query_id", "safety.passed", "safety.score", _joined("safety.details").alias("details"))


def comments(spark, sf):
    return query_log(spark, sf).select("query_id", sqltext.has_comment(F.col("sql")).alias("has_comment"))


def _structure(spark, sf) -> DataFrame:
    return audit.with_structure(query_log(spark, sf))


def statements(spark, sf):
    return _structure(spark, sf).select("query_id", F.size("statement_kinds").alias("n"), _joined("statement_kinds").alias("kinds"))


def tables(spark, sf):
    return _structure(spark, sf).select("query_id", _joined("referenced_tables").alias("tables"))


def ctes(spark, sf):
    read = sqltext.levels(sqltext.blanked(F.col("sql")))
    return query_log(spark, sf).select("query_id", read.alias("read")).select("query_id", F.array_join(sqltext.cte_names(F.col("read")), "|").alias("ctes"))


def context_tables(spark, sf):
    return _structure(spark, sf).select("query_id", F.array_join(F.array_sort("context_tables"), "|").alias("tables"))


def ungrounded(spark, sf):
    return _structure(spark, sf).select("query_id", F.explode("ungrounded_tables").alias("table_name"))


def complexity(spark, sf):
    return query_log(spark, sf).select("query_id", sqltext.complexity(F.col("sql")).alias("complexity"))


def score(spark, sf):
    return audit.audit(query_log(spark, sf)).select(
        "query_id", "passed", "overall_score", F.col("structural.passed").alias("structural_passed"), F.col("semantic.passed").alias("semantic_passed"),
        F.col("semantic.score").alias("semantic_score"), "sql_length", "parser_dialect",
    )


def issues(spark, sf):
    return audit.issues(audit.audit(query_log(spark, sf)), "query_id")


def judge_json(spark, sf):
    checked = query_log(spark, sf).select("query_id", audit.judged(F.col("judge_response")).alias("j"))
    return checked.select("query_id", "j.passed", "j.score", _joined("j.details").alias("details"))


def rollup(spark, sf):
    return audit.rollup(audit.audit(query_log(spark, sf))).withColumn("mean_score", F.round("mean_score", 6))


QUANTILES = (0.1, 0.5, 0.9)


def span_rollup(spark, sf):
    """Years put together from kept days, their exact sums, and whether the sketches keep their error bounds against exact values."""
    log = query_log(spark, sf, "CAST(o_orderdate AS date) AS day")
    audited = cut(audit.audit(log).select("day", "dialect", "complexity", "sql", "passed", "overall_score", "referenced_tables"), "audited")
    path, year = scratch_path(spark, "audit-days"), F.year("day").alias("year")
    rollups.write(rollups.daily(audited), path)
    years = rollups.merge(rollups.span(spark, path), year, "dialect")
    told = rollups.summary(years, "year", "dialect", "score_sum", quantiles=QUANTILES)

    exact = audited.select(year, "dialect", "sql", F.explode_outer("referenced_tables").alias("t")).groupBy("year", "dialect").agg(
        F.count_distinct("sql").alias("exact_statements"), F.count_distinct("t").alias("exact_tables")
    ).withColumnsRenamed({"year": "e_year", "dialect": "e_dialect"})
    scores = audited.groupBy(year.alias("s_year"), F.col("dialect").alias("s_dialect"), F.col("overall_score").alias("s")).agg(F.count("*").alias("n"))

    def same(side: str) -> Column:
        return (F.col("year") == F.col(f"{side}_year")) & F.col("dialect").eqNullSafe(F.col(f"{side}_dialect"))

    def share(i: int, counted: Callable[[Column], Column]) -> Column:
        return F.sum(F.when(counted(F.col("score_quantiles")[i]), F.col("n")).otherwise(0)) / F.sum("n")

    ranked = told.join(scores, same("s")).groupBy(F.col("s_year").alias("r_year"), F.col("s_dialect").alias("r_dialect")).agg(*(
        ((share(i, lambda v: F.col("s") < v) <= q + rollups.RANK_ERROR) & (share(i, lambda v: F.col("s") <= v) >= q - rollups.RANK_ERROR)).alias(f"q{i}")
        for i, q in enumerate(QUANTILES)
    ))

    def near(told_count: str, exact_count: str) -> Column:
        return F.abs(F.col(told_count) - F.col(exact_count)) <= F.col(exact_count) * rollups.DISTINCT_ERROR

    return told.join(exact, same("e")).join(ranked, same("r")).select(
        "year", "dialect", "queries", "passed", "score_sum", F.col("exact_statements").alias("statements"), F.col("exact_tables").alias("tables"),
        near("statements", "exact_statements").alias("statements_close"), near("tables", "exact_tables").alias("tables_close"),
        (F.col("q0") & F.col("q1") & F.col("q2")).alias("quantiles_close"),
    )


QUERIES = {
    "audit_span_rollup": span_rollup,
    "audit_safety": safety,
    "audit_comments": comments,
    "audit_statements": statements,
    "audit_tables": tables,
    "audit_cte": ctes,
    "audit_context_tables": context_tables,
    "audit_ungrounded": ungrounded,
    "audit_complexity": complexity,
    "audit_score": score,
    "audit_issues": issues,
    "audit_judge_json": judge_json,
    "audit_rollup": rollup,
}


def _case(key: str, values: list) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {literal(v)}" for i, v in enumerate(values)) + " END"


CTES["q_log"] = f"""
    SELECT o_orderkey AS query_id, replace({_case('o_orderkey', STATEMENTS)}, '{{k}}', CAST(o_orderkey AS VARCHAR)) AS sql,
           {_case('o_custkey', DIALECTS)} AS dialect, {_case('o_orderkey', CONTEXTS)} AS schema_context,
           CASE o_orderkey % 3 WHEN 0 THEN TRUE ELSE FALSE END AS deep, {_case('o_orderkey', ANSWERS)} AS answer
    FROM orders"""
HITS = "[" + ", ".join(f"CASE WHEN regexp_matches(sql, {literal('(?i)' + p)}) THEN {literal(audit.FORBIDDEN_TEXT + p)} END" for p in sqltext.FORBIDDEN) + "]"
CTES["q_safe"] = f"""
    SELECT *, len(hits) = 0 AS safe, CAST(CASE WHEN len(hits) > 0 THEN 0 WHEN has_comment THEN 90 ELSE 100 END AS DOUBLE) AS safe_score,
           list_concat(hits, CASE WHEN has_comment THEN ['{audit.COMMENT_TEXT}'] ELSE [] END) AS safe_details
    FROM (SELECT *, [h FOR h IN {HITS} IF h IS NOT NULL] AS hits,
                 contains(sql, '/*') OR regexp_matches(sql, '--\\s*\\S') AS has_comment FROM q_log)"""


def _lists(key: str, values: list[list[str]]) -> str:
    cases = " ".join(f"WHEN {i} THEN CAST([{', '.join(literal(x) for x in v)}] AS VARCHAR[])" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {cases} END"


CTES["q_read"] = f"""
    SELECT *, {_lists("query_id", [r[0] for r in READ])} AS kinds, {_lists("query_id", [r[1] for r in READ])} AS ctes,
           [replace(t, '{{k}}', CAST(query_id AS VARCHAR)) FOR t IN {_lists("query_id", [r[2] for r in READ])}] AS tables,
           {_lists("query_id", [r[3] for r in READ])} AS unread, {_lists("query_id", KNOWN)} AS known
    FROM q_safe"""
CTES["q_struct"] = "SELECT *, [t FOR t IN tables IF NOT list_contains(known, lower(t))] AS ghosts FROM q_read"
CTES["q_judge"] = f"""
    SELECT *, coalesce(CAST(json_extract_string(a, '$.passed') AS BOOLEAN), FALSE) AS j_passed,
           coalesce(CAST(json_extract_string(a, '$.score') AS DOUBLE), 0) AS j_score,
           list_concat([coalesce(json_extract_string(a, '$.reasoning'), '{audit.NO_REASON_TEXT}')],
               [concat_ws(': ', json_extract_string(i, '$.severity'), json_extract_string(i, '$.message')) FOR i IN coalesce(CAST(json_extract(a, '$.issues') AS JSON[]), [])]) AS j_details
    FROM (SELECT *, CAST(coalesce(answer, '{{}}') AS JSON) AS a FROM q_struct)"""
CTES["q_details"] = f"""
    SELECT *, list_concat(CASE WHEN len(kinds) > 1 THEN ['{audit.MULTIPLE_TEXT}'] ELSE [] END,
           ['{audit.NON_SELECT_TEXT}' || k FOR k IN kinds IF k <> 'select'],
           ['{audit.UNREADABLE_TEXT}' || u FOR u IN unread], ['Table ''' || t || ''' not in retrieved schema context' FOR t IN ghosts]) AS s_details
    FROM q_judge"""
CTES["q_verdict"] = f"""
    SELECT *, len(s_details) = 0 AS s_passed, CASE WHEN len(s_details) = 0 THEN 100 ELSE 0 END AS s_score,
           CASE WHEN NOT deep THEN TRUE WHEN len(s_details) = 0 THEN j_passed ELSE FALSE END AS m_passed,
           CAST(CASE WHEN NOT deep THEN 100 WHEN len(s_details) = 0 THEN j_score ELSE 0 END AS DOUBLE) AS m_score,
           CASE WHEN NOT deep THEN ['{audit.BYPASSED_TEXT}'] WHEN len(s_details) = 0 THEN j_details ELSE ['{audit.SKIPPED_TEXT}'] END AS m_details
    FROM q_details"""
LOWER = "lower(sql)"
CTES["q_scored"] = f"""
    SELECT *, s_passed AND m_passed AND safe AS passed,
           CAST(round(round(CASE WHEN deep THEN s_score * 0.3::DOUBLE + m_score * 0.5::DOUBLE + safe_score * 0.2::DOUBLE
                ELSE s_score * 0.6::DOUBLE + safe_score * 0.4::DOUBLE END, 9)) AS INTEGER) AS overall_score,
           CASE WHEN points <= 1 THEN 'simple' WHEN points <= 3 THEN 'moderate' ELSE 'complex' END AS complexity
    FROM (SELECT *, contains({LOWER}, 'join')::INT + contains({LOWER}, 'group by')::INT + (len(regexp_extract_all({LOWER}, 'select')) > 1)::INT
                 + contains({LOWER}, 'union')::INT + (contains({LOWER}, 'window') OR contains({LOWER}, 'over('))::INT AS points FROM q_verdict)"""
CTES["q_issue"] = """
    SELECT query_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS position, unnest(l, recursive := true) FROM (
        SELECT query_id, list_concat(
            [{'severity': CASE WHEN s_passed THEN 'warning' ELSE 'error' END, 'category': 'structural', 'message': d} FOR d IN s_details],
            [{'severity': CASE WHEN m_passed THEN 'warning' ELSE 'error' END, 'category': 'semantic', 'message': d} FOR d IN m_details],
            [{'severity': CASE WHEN safe THEN 'warning' ELSE 'error' END, 'category': 'safety', 'message': d} FOR d IN safe_details]) AS l
        FROM q_verdict)"""

ORACLES = {
    "audit_span_rollup": with_ctes("""
        SELECT CAST(year(o_orderdate) AS INTEGER) AS year, dialect, count(*) AS queries, count(*) FILTER (passed) AS passed,
               CAST(sum(overall_score) AS BIGINT) AS score_sum, count(DISTINCT sql) AS statements,
               len(list_distinct(flatten(list(tables)))) AS tables, TRUE AS statements_close, TRUE AS tables_close, TRUE AS quantiles_close
        FROM q_scored JOIN orders ON o_orderkey = query_id GROUP BY ALL"""),
    "audit_safety": with_ctes("SELECT query_id, safe AS passed, safe_score AS score, array_to_string(safe_details, '|') AS details FROM q_safe"),
    "audit_comments": with_ctes("SELECT query_id, has_comment FROM q_safe"),
    "audit_statements": with_ctes("SELECT query_id, CAST(len(kinds) AS INTEGER) AS n, array_to_string(kinds, '|') AS kinds FROM q_struct"),
    "audit_tables": with_ctes("SELECT query_id, array_to_string(tables, '|') AS tables FROM q_struct"),
    "audit_cte": with_ctes("SELECT query_id, array_to_string(ctes, '|') AS ctes FROM q_struct"),
    "audit_context_tables": with_ctes("SELECT query_id, array_to_string(list_sort(known), '|') AS tables FROM q_struct"),
    "audit_ungrounded": with_ctes("SELECT query_id, unnest(ghosts) AS table_name FROM q_struct"),
    "audit_complexity": with_ctes("SELECT query_id, complexity FROM q_scored"),
    "audit_score": with_ctes("""
        SELECT query_id, passed, overall_score, s_passed AS structural_passed, m_passed AS semantic_passed, m_score AS semantic_score,
               CAST(length(sql) AS INTEGER) AS sql_length, CASE dialect WHEN 'mssql' THEN 'transactsql' WHEN 'duck' THEN 'postgresql' ELSE dialect END AS parser_dialect
        FROM q_scored"""),
    "audit_issues": with_ctes("SELECT query_id, position, severity, category, message FROM q_issue"),
    "audit_judge_json": with_ctes("SELECT query_id, j_passed AS passed, j_score AS score, array_to_string(j_details, '|') AS details FROM q_judge"),
    "audit_rollup": with_ctes("""
        SELECT dialect, complexity, count(*) AS queries, count(*) FILTER (passed) AS passed, round(avg(overall_score), 6) AS mean_score,
               CAST(grouping(dialect, complexity) AS INTEGER) AS level FROM q_scored GROUP BY CUBE (dialect, complexity)"""),
}
