import pytest
from pyspark.sql import functions as F

from catalink.functions import sqltext
from catalink.operators import audit, prompts

CONTEXT = "Table: orders\nColumns:\n---\nTable: customer\nTable: \"shop\".\"Part\"\nTable: a\nTable: b"


def run(spark, sql, deep=None, answer=None, dialect="mysql", context=CONTEXT):
    df = spark.createDataFrame([(sql, context, dialect, deep, answer)], "sql string, schema_context string, dialect string, deep_evaluation boolean, judge_response string")
    return audit.audit(df).first()


FORBIDDEN = [
    "drop table orders", "DELETE FROM orders", "Update orders set x = 1", "insert into orders values (1)", "ALTER TABLE orders add x int",
    "TRUNCATE orders", "grant all on orders to x", "revoke all on orders from x", "create table x as select 1", "exec proc", "EXECUTE proc",
    "call proc()", "LOCK TABLES orders", "lock table orders",
]


def test_every_pattern_fires(spark):
    df = spark.createDataFrame([(s, CONTEXT) for s in FORBIDDEN], "sql string, schema_context string")
    rows = audit.with_safety(df).select("sql", "safety.*").collect()
    assert all((not r.passed) and r.score == 0 and r.details for r in rows)
    fired = {d for r in rows for d in r.details}
    assert fired == {audit.FORBIDDEN_TEXT + p for p in sqltext.FORBIDDEN}


def test_patterns_fire_inside_literals_and_not_inside_words(spark):
    assert run(spark, "select 'please DROP it' from orders").safety.score == 0
    assert run(spark, "select dropped, updates from orders").safety.score == 100


@pytest.mark.parametrize(
    "sql,comment", [("select 1 -- x", True), ("select 1 --", False), ("select 1 --  \n ", False), ("select 1 --\nfrom orders", True), ("select /* x */ 1", True)]
)
def test_comments(spark, sql, comment):
    row = run(spark, sql)
    assert row.safety.score == (90 if comment else 100) and row.safety.passed


@pytest.mark.parametrize(
    "sql,deep,answer,score,passed",
    [
        ("select * from orders", None, None, 100, True),
        ("select * from orders -- x", None, None, 96, True),
        ("drop table orders", None, None, 0, False),
        ("select 'DROP x' from orders", None, None, 60, False),
        ("select * from ghost", None, None, 40, False),
        ("select * from ghost -- x", None, None, 36, False),
        ("select * from orders", True, '{"score": 80, "passed": true, "reasoning": "fine"}', 90, True),
        ("select * from orders", True, "{}", 50, False),
        ("select * from orders", True, None, 50, False),
        ("select * from ghost", True, '{"score": 80, "passed": true}', 20, False),
        ("select * from orders -- x", True, '{"score": 75, "passed": true}', 86, True),
    ],
)
def test_scores(spark, sql, deep, answer, score, passed):
    row = run(spark, sql, deep, answer)
    assert (row.overall_score, row.passed) == (score, passed)


@pytest.mark.parametrize(
    "sql,tables",
    [
        ("select * from orders o join customer c on o.x = c.x", ["orders", "customer"]),
        ("select * from orders, customer c, part as p where 1 = 1", ["orders", "customer", "part"]),
        ('select * from "shop"."orders" join `shop`.`customer` on true', ["orders", "customer"]),
        ("with x as (select * from orders), y (k) as (select 1 from x) select * from y join X on true", ["orders"]),
        ("select * from (orders)", ["orders"]),
        ("select * from ((orders o join (customer) on true))", ["orders", "customer"]),
        ("table orders", ["orders"]),
        ("select 1 union all table orders", ["orders"]),
        ("select * from (select 1 as a) x, orders tablesample bernoulli (5) repeatable (3) o, lateral (select * from customer) c", ["orders", "customer"]),
        ("select * from orders as `o`, \"customer\" \"c\" left outer join part using (k) where a in (table x)", ["orders", "customer", "part", "x"]),
        ("select extract(year from cast(d as date)), trim(both 'x' from coalesce(a, (select max(b) from part))) from orders", ["orders", "part"]),
        ("select a, rank() over w from orders window w as (order by a), x as (order by b)", ["orders"]),
        ("select * from orders lateral view explode(array(1, 2)) t as q, customer", ["orders"]),
        ("with a as materialized (table orders), b as (select * from a) select * from b natural join customer", ["customer", "orders"]),
        ("select * from orders o where exists (select 1 from (select * from customer) i where i.k = o.k) order by a, b", ["orders", "customer"]),
        ("select * from orders where k in (select k from customer)", ["orders", "customer"]),
        ("select * from (select * from orders) s", ["orders"]),
        ("select extract(year from d) from orders where a is distinct from b", ["orders"]),
        ("select 'from nowhere' from orders -- from elsewhere\n/* join gone */", ["orders"]),
        ("select * from generate_series(1, 3) g join orders on true", ["orders"]),
        ("select 1 from orders union select 2 from orders", ["orders"]),
        ("select * from orders/*x*/join customer on true", ["orders", "customer"]),
        ("select * from orders join customer using (k)", ["orders", "customer"]),
        ("select 'it''s from x' from orders", ["orders"]),
    ],
)
def test_referenced_tables(spark, sql, tables):
    assert run(spark, sql).referenced_tables == tables


@pytest.mark.parametrize(
    "sql",
    [
        "select * from (secret)", "select * from (table secret)", "select * from (select 1 as a) x, secret", "select * from orders as `o`, secret",
        "select * from orders tablesample (10 percent), secret", "select * from orders cross join (secret)",
        "select a from secret window w as (order by a), secret as (order by b)", "select 'it\\'s' from orders, z where x = ' from q'",
        "select * from orders, (secret)", "select * from orders straight_join secret", "select * from orders o cross apply secret s",
        "select * from (orders", "select * from orders where a = (1))", "select * from orders, (a, secret)",
        "select * from " + "(" * 60 + "select 1 from secret" + ")" * 60, "select * from orders as o (a, b) x, customer", "select * from ((secret))", "select 1 from",
        "select * from orders lateral view explode(a) t as x join secret on true",
    ],
)
def test_what_is_not_seen_does_not_pass(spark, sql):
    assert not run(spark, sql).structural.passed


def test_very_long_literals_and_comments(spark):
    sql = "select '" + "x" * 200_000 + "', /* " + "y" * 200_000 + " */ 1 from orders"
    assert run(spark, sql).referenced_tables == ["orders"]


def test_grounding_is_case_insensitive_and_unqualified(spark):
    row = run(spark, "select * from Orders join PART on true join Ghost g on true")
    assert row.ungrounded_tables == ["Ghost"]
    assert row.structural.details == ["Table 'Ghost' not in retrieved schema context"]


@pytest.mark.parametrize(
    "sql,details",
    [
        ("select 1; select 2", [audit.MULTIPLE_TEXT]),
        ("select 1;", []),
        ("select ';' from orders", []),
        ("show tables", [audit.NON_SELECT_TEXT + "show"]),
        ("(select 1) union (select 2)", []),
        ("select 1; delete from orders", [audit.MULTIPLE_TEXT, audit.NON_SELECT_TEXT + "delete"]),
        (" ", ["Syntax error: empty statement"]),
    ],
)
def test_statements(spark, sql, details):
    assert run(spark, sql).structural.details == details


@pytest.mark.parametrize(
    "sql,expected",
    [
        ("select 1", "simple"), ("select 1 from a join b on true", "simple"), ("select 1 from a join b on true group by x", "moderate"),
        ("select row_number() over(order by x) from (select 1) a join b on true", "moderate"),
        ("select over( from a join b group by union select", "complex"),
    ],
)
def test_complexity(spark, sql, expected):
    assert run(spark, sql).complexity == expected


def test_judge_details_and_issue_order(spark):
    answer = '{"score": 10, "passed": false, "reasoning": "wrong", "issues": [{"severity": "error", "message": "join"}]}'
    df = spark.createDataFrame([(1, "select 1 from orders -- x", CONTEXT, "oracle", True, answer)],
                               "query_id int, sql string, schema_context string, dialect string, deep_evaluation boolean, judge_response string")
    audited = audit.audit(df)
    found = [(r.position, r.severity, r.category, r.message) for r in audit.issues(audited, "query_id").orderBy("position").collect()]
    assert found == [(0, "error", "semantic", "wrong"), (1, "error", "semantic", "error: join"), (2, "warning", "safety", audit.COMMENT_TEXT)]
    assert audit.repair_reason(audited, "query_id").first().reason == f"semantic: wrong; semantic: error: join; safety: {audit.COMMENT_TEXT}"
    fast = run(spark, "select 1 from orders")
    assert fast.semantic.details == [audit.BYPASSED_TEXT] and fast.parser_dialect == "mysql"
    assert run(spark, "select 1", dialect="mssql").parser_dialect == "transactsql"
    assert run(spark, "select 1", dialect="what").parser_dialect == "postgresql"


def test_rollup_totals(spark):
    df = spark.createDataFrame([("select 1 from orders", CONTEXT, "mysql"), ("drop table x", CONTEXT, "oracle")], "sql string, schema_context string, dialect string")
    total = audit.rollup(audit.audit(df)).filter("level = 3").first()
    assert (total.queries, total.passed, total.mean_score) == (2, 1, 50.0)


@pytest.mark.parametrize(
    "text,sql",
    [("```sql\nselect 1\n```", "select 1"), ("```SQL select 1```", "select 1"), ("```\nselect 1", "select 1"), ("  select 1 \n", "select 1"),
     ("select '```' from t", "select '```' from t"), ("```sql\n```", "")],
)
def test_clean_response(spark, text, sql):
    good, bad = prompts.clean_responses(spark.createDataFrame([(text,)], "response string"))
    assert good.first().sql == sql and bad.isEmpty()


def test_empty_responses_are_errors(spark):
    good, bad = prompts.clean_responses(spark.createDataFrame([(None,), (" \n\t",)], "response string"))
    assert good.isEmpty() and [r.error for r in bad.collect()] == ["empty response"] * 2


@pytest.mark.parametrize(
    "attempts,expected",
    [
        ([(0, True, None)], ("answered", "s0", False, None)),
        ([(0, False, None)], ("audit_failed", "s0", False, None)),
        ([(0, False, None), (1, True, None)], ("answered", "s1", True, None)),
        ([(0, False, None), (1, False, None)], ("audit_failed", "s0", False, None)),
        ([(0, True, "boom")], ("execution_failed", "s0", False, "Execution failed: boom")),
        ([(0, True, "boom"), (2, True, None)], ("answered", "s2", True, None)),
        ([(0, True, "boom"), (2, False, None)], ("execution_failed", "s0", False, "Execution failed: boom")),
        ([(0, True, "boom"), (2, True, "bang")], ("execution_failed", "s0", False, "Execution failed: boom")),
        ([(0, False, None), (1, True, "boom"), (2, True, None)], ("answered", "s2", True, None)),
        ([(0, False, None), (1, True, "boom")], ("execution_failed", "s1", False, "Execution failed: boom")),
        ([(0, True, None), (1, True, None)], ("answered", "s0", False, None)),
    ],
)
def test_attempts(spark, attempts, expected):
    df = spark.createDataFrame([(1, a, f"s{a}", ok, err) for a, ok, err in attempts], "question_id long, attempt int, sql string, audit_passed boolean, exec_error string")
    row = prompts.resolve_attempts(df).first()
    assert (row.outcome, row.sql, row.self_healed, row.error) == expected


def test_context_prompt_and_rejects(spark):
    final = spark.createDataFrame([(1, "u2", 1), (1, "u1", 2)], "question_id long, unit_id string, final_rank int")
    units = spark.createDataFrame([("u1", "Table: a", "mysql"), ("u2", "Table: b", None)], "unit_id string, content string, dialect string")
    contexts = prompts.context(final, units)
    row = contexts.first()
    assert row.schema_context == "Table: b\n\n---\n\nTable: a" and row.units == 2
    questions = spark.createDataFrame([(1, "top?", "d"), (2, "other?", "d"), (3, " ", "d"), (4, "x", "")], "question_id long, question string, database_name string")
    good, bad = prompts.validate_questions(questions)
    assert sorted((r.question_id, r.error) for r in bad.collect()) == [(3, "question is required"), (4, "databaseName is required")]
    ready, missing = prompts.prompt_table(good, contexts)
    assert "Table: b" in ready.first().prompt and [r.question_id for r in missing.collect()] == [2]
    texts = ready.select(
        prompts.repair_prompt(F.col("dialect"), F.col("question"), F.col("schema_context"), F.lit("select 1"), F.lit("no table")).alias("r"),
        prompts.judge_prompt(F.col("dialect"), F.col("question"), F.col("schema_context"), F.lit("select 1")).alias("j")).first()
    assert "no table" in texts.r and '"passed"' in texts.j


def test_a_list_of_units_is_put_together_once(spark):
    """Questions with the same units at the same ranks share a list; the texts meet it once, the prompts are the same as from whole contexts."""
    units = spark.createDataFrame([(f"u{i}", f"text {i}", "mysql" if i % 2 else "oracle") for i in range(6)] + [("u5", "twin", "oracle")], "unit_id string, content string, dialect string")
    lists = {1: ["u1", "u2"], 2: ["u1", "u2"], 3: ["u2", "u1"], 4: ["u1", "u2"], 5: ["u5", "gone"], 6: ["gone"], None: ["u0"], 8: ["u1", "u1", "u2"]}
    final = spark.createDataFrame([(q, u, i + 1) for q, us in lists.items() for i, u in enumerate(us)], "question_id long, unit_id string, final_rank int")
    named, texts = prompts.context_lists(final, units)
    assert named.count() == 8 and texts.count() == 5  # the list of question 6 holds no known unit
    found = {r.question_id: (r.schema_context.split(prompts.SEPARATOR), r.dialect, r.units) for r in prompts.context(final, units).collect()}
    one = (["text 1", "text 2"], "mysql", 2)
    assert found == {
        1: one, 2: one, 4: one, 3: (["text 2", "text 1"], "oracle", 2), 8: (["text 1", "text 1", "text 2"], "mysql", 3),
        5: (["text 5", "twin"], found[5][1], 2), None: (["text 0"], "oracle", 1),
    }
    questions = spark.createDataFrame([(q, f"question {q}", "d") for q in (1, 2, 3, 6, 7, None)], "question_id long, question string, database_name string")
    whole = prompts.prompt_table(questions, prompts.context(final, units))
    apart = prompts.prompt_table(questions, named, texts)
    for a, b in zip(whole, apart):
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(b.columns)).collect()))
    assert apart[0].count() == 3 and apart[1].count() == 3
