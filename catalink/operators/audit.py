"""Audit of a log of SQL strings: safety, grounding, a weighted verdict and its issues. One pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalink.functions import sqltext

PASS_MARK = 80
COMMENT_PENALTY = 10

# The words of the findings.
FORBIDDEN_TEXT = "Forbidden modifying pattern detected: "
COMMENT_TEXT = "Comments detected in query"
MULTIPLE_TEXT = "Multiple statements detected"
NON_SELECT_TEXT = "Non-SELECT statement detected: "
BYPASSED_TEXT = "Bypassed (Fast path: Structural + Safety guardrails active)"
SKIPPED_TEXT = "Skipped — structural validation failed"
UNREADABLE_TEXT = "Source cannot be read: "
NO_REASON_TEXT = "No reasoning provided"

# The parser dialect behind each dialect name.
PARSER_DIALECTS = {
    "postgresql": "postgresql",
    "mysql": "mysql",
    "sqlite": "sqlite",
    "mssql": "transactsql",
    "oracle": "oracle",
}

JUDGE_SCHEMA = "score double, passed boolean, reasoning string, issues array<struct<severity:string,message:string>>"


def _strings(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _check(passed: Column, score: Column, details: Column) -> Column:
    return F.struct(passed.alias("passed"), score.cast("double").alias("score"), details.alias("details"))


def with_safety(log: DataFrame, sql: str = "sql") -> DataFrame:
    """``safety``: any forbidden pattern scores 0; comments take ten points and pass on their own."""
    out = log.withColumn("__hits", sqltext.forbidden_hits(F.col(sql))).withColumn("__comment", sqltext.has_comment(F.col(sql)))
    hit = F.size("__hits") > 0
    score = F.when(hit, 0).otherwise(100 - F.when(F.col("__comment"), COMMENT_PENALTY).otherwise(0))
    details = F.concat(
        F.transform("__hits", lambda p: F.concat(F.lit(FORBIDDEN_TEXT), p)), _strings(F.when(F.col("__comment"), F.lit(COMMENT_TEXT)))
    )
    return out.withColumn("safety", _check(~hit & (score >= PASS_MARK), score, details)).drop("__hits", "__comment")


def with_structure(log: DataFrame, sql: str = "sql", context: str = "schema_context") -> DataFrame:
    """``structural``: one SELECT statement over tables of the given context scores 100, anything else 0.

    Adds what it read: statement_kinds, referenced_tables, context_tables, ungrounded_tables. A source that cannot be read to its end is a
    finding of its own, so a statement never passes for what was not seen in it.
    """
    out = (
        log.withColumn("__clean", sqltext.blanked(F.col(sql)))
        .withColumn("statement_kinds", F.transform(sqltext.statements(F.col("__clean")), sqltext.statement_kind))
        .withColumn("__read", sqltext.levels(F.col("__clean")))
        .withColumn("referenced_tables", sqltext.referenced_tables(F.col("__read")))
        .withColumn("context_tables", sqltext.context_tables(F.coalesce(context, F.lit(""))))
        .withColumn("ungrounded_tables", sqltext.ungrounded(F.col("referenced_tables"), F.col("context_tables")))
        .withColumn("__unreadable", sqltext.unreadable(F.col("__read"), F.col(sql)))
        .drop("__clean", "__read")
    )
    other = F.filter("statement_kinds", lambda k: k != "select")
    empty = F.when(F.size("statement_kinds") == 0, F.lit("Syntax error: empty statement"))
    details = F.concat(
        _strings(empty, F.when(F.size("statement_kinds") > 1, F.lit(MULTIPLE_TEXT))),
        F.transform(other, lambda k: F.concat(F.lit(NON_SELECT_TEXT), k)),
        F.transform("__unreadable", lambda t: F.concat(F.lit(UNREADABLE_TEXT), t)),
        F.transform("ungrounded_tables", lambda t: F.concat(F.lit("Table '"), t, F.lit("' not in retrieved schema context"))),
    )
    passed = F.size(details) == 0
    return out.withColumn("structural", _check(passed, F.when(passed, 100).otherwise(0), details)).drop("__unreadable")


def judged(response: Column) -> Column:
    """A stored judge response as a check; missing fields default to failed, 0 and a fixed text."""
    parsed = F.from_json(F.when(F.coalesce(F.trim(response), F.lit("")) == "", "{}").otherwise(response), JUDGE_SCHEMA)
    reason = parsed["reasoning"]
    no_issues = F.array().cast("array<struct<severity:string,message:string>>")
    listed = F.transform(F.coalesce(parsed["issues"], no_issues), lambda i: F.concat_ws(": ", i["severity"], i["message"]))
    details = F.concat(F.array(F.when(F.coalesce(reason, F.lit("")) == "", F.lit(NO_REASON_TEXT)).otherwise(reason)), listed)
    return _check(F.coalesce(parsed["passed"], F.lit(False)), F.coalesce(parsed["score"], F.lit(0.0)), details)


def with_verdict(log: DataFrame, deep: str = "deep_evaluation", response: str = "judge_response") -> DataFrame:
    """``semantic``, ``passed`` and ``overall_score`` from the checks; without ``deep`` the semantic check is bypassed."""
    is_deep = F.coalesce(deep, F.lit(False)) if deep in log.columns else F.lit(False)
    answer = F.col(response) if response in log.columns else F.lit(None).cast("string")
    bypassed = _check(F.lit(True), F.lit(100), F.array(F.lit(BYPASSED_TEXT)))
    skipped = _check(F.lit(False), F.lit(0), F.array(F.lit(SKIPPED_TEXT)))
    semantic = F.when(~is_deep, bypassed).when(F.col("structural.passed"), judged(answer)).otherwise(skipped)
    structural, safety = F.col("structural.score"), F.col("safety.score")
    score = F.when(is_deep, structural * 0.3 + F.col("semantic.score") * 0.5 + safety * 0.2).otherwise(structural * 0.6 + safety * 0.4)
    return (
        log.withColumn("semantic", semantic)
        .withColumn("overall_score", F.round(F.round(score, 9)).cast("int"))
        .withColumn("passed", F.col("structural.passed") & F.col("safety.passed") & F.col("semantic.passed"))
    )


def parser_dialect(dialect: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in PARSER_DIALECTS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, dialect), F.lit("postgresql"))


def audit(log: DataFrame) -> DataFrame:
    """The whole audit of each row of the log, with its metadata.

    ``log``: sql, schema_context, dialect and optionally deep_evaluation and judge_response.
    """
    checked = with_verdict(with_structure(with_safety(log)))
    return checked.select(
        "*",
        F.length("sql").alias("sql_length"),
        sqltext.complexity(F.col("sql")).alias("complexity"),
        parser_dialect(F.col("dialect")).alias("parser_dialect"),
        F.current_timestamp().alias("evaluated_at"),
    )


def listed_issues() -> Column:
    """All findings of an audited row: structural, then semantic, then safety; warnings if their check passed."""

    def of(check: str) -> Column:
        severity = F.when(F.col(f"{check}.passed"), "warning").otherwise("error")
        return F.transform(
            f"{check}.details", lambda d: F.struct(severity.alias("severity"), F.lit(check).alias("category"), d.alias("message"))
        )

    return F.concat(of("structural"), of("semantic"), of("safety"))


def issues(audited: DataFrame, *keys: str) -> DataFrame:
    """One row per finding."""
    return audited.select(*keys, F.posexplode(listed_issues()).alias("position", "issue")).select(
        *keys, "position", "issue.severity", "issue.category", "issue.message"
    )


def failed(audited: DataFrame) -> DataFrame:
    """Audited rows that did not pass. A plain filter would be moved below the audit with a copy of all that ``passed`` is made of, many
    times over; Spark moves no condition below a generator."""
    kept = F.filter(F.array(F.struct("passed")), lambda r: ~r["passed"])
    return audited.select(*(c for c in audited.columns if c != "passed"), F.inline(kept))


def repair_reason(audited: DataFrame, *keys: str) -> DataFrame:
    """``category: message`` of all findings in issue order, as the repair prompt quotes them."""
    lines = F.transform(listed_issues(), lambda i: F.concat_ws(": ", i["category"], i["message"]))
    return audited.select(*keys, F.array_join(lines, "; ").alias("reason"))


def rollup(audited: DataFrame) -> DataFrame:
    """Counts and pass rate by dialect and complexity, with totals."""
    return audited.cube("dialect", "complexity").agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if("passed").alias("passed"),
        F.avg("overall_score").alias("mean_score"),
        F.grouping_id().cast("int").alias("level"),
    )
