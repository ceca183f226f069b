"""Bounded execution: only audited, read-only statements, never more rows than asked for."""

from __future__ import annotations

import json
import math
import re
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

from catalink.functions.sqltext import QUOTED_OR_SKIPPED
from catalink.operators.audit import with_safety, with_structure

DEFAULT_ROWS = 100
TIME_LIMIT = 10.0  # seconds


class RejectedQuery(ValueError):
    """The statement did not pass the audit and was not run."""


@dataclass(frozen=True)
class Result:
    """The rows stay distributed until they are read; the columns are known at once."""

    rows: DataFrame

    @property
    def columns(self) -> list[str]:
        return self.rows.columns

    @property
    def row_count(self) -> int:
        return self.rows.count()


@dataclass(frozen=True)
class Execution:
    """A statement that ran to its end: its rows, at most as many as the bound, or none and what went wrong."""

    columns: list[str]
    rows: list[Row]
    execution_ms: float
    error: str | None = None

    @property
    def row_count(self) -> int:
        return len(self.rows)


def resolve_rows(max_rows: float | None = None) -> int:
    return max(1, math.floor(DEFAULT_ROWS if max_rows is None else max_rows))


def clean_statement(sql: str) -> str:
    stripped = sql.strip()
    return stripped[:-1].rstrip() if stripped.endswith(";") else stripped


# Kinds of built-in functions that work on nothing but the values of their row, group or window, and harmless ones of other kinds.
KINDS = {
    f"{kind}_funcs"
    for kind in (
        "agg", "array", "bitwise", "collection", "conditional", "conversion", "csv", "datetime", "generator", "hash", "json", "lambda", "map", "math",
        "predicate", "string", "struct", "url", "variant", "window", "xml",
    )
}
HARMLESS = {"typeof", "version"}
# Generators over the statement's own values; any other table function is a source of its own.
GENERATORS = {"explode", "explode_outer", "inline", "inline_outer", "posexplode", "posexplode_outer", "stack", "range"}


def sources(spark: SparkSession, sql: str) -> tuple[set[str], set[str], set[str]]:
    """Relations, common table expressions and table functions of a statement, as Spark's own parser reads them.

    The printed tree shows every relation before it is resolved, those of sub-queries and nested statements included.
    """
    tree = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).treeString()
    relations = {", ".join(p.strip() for p in m.split(",")) for m in re.findall(r"'UnresolvedRelation \[(.*?)\](?:, \[|$)", tree, re.M)}
    defined = {name.strip() for m in re.findall(r"(?:^|[\s:+|-])CTE \[(.*?)\]$", tree, re.M) for name in m.split(",")}
    functions = {m.strip() for m in re.findall(r"'UnresolvedTableValuedFunction \[(.*?)\]", tree)}
    return {r.lower() for r in relations}, {d.lower() for d in defined}, {f.lower() for f in functions}


def foreign_sources(spark: SparkSession, sql: str, tables: list[str]) -> list[str]:
    """What the statement reads beside ``tables``; a qualified name, a file path too, is never one of them."""
    relations, defined, functions = sources(spark, sql)
    known = {t.lower() for t in tables}
    other = {r for r in relations - known if r not in defined or spark.catalog.tableExists(r)}
    return sorted(other | (functions - GENERATORS))


def _nodes(tree) -> Iterator[dict]:
    if isinstance(tree, dict):
        yield tree
    for child in tree.values() if isinstance(tree, dict) else tree if isinstance(tree, list) else ():
        yield from _nodes(child)


def foreign_functions(spark: SparkSession, sql: str) -> list[str]:
    """Functions of the statement that are not built in or are of a kind that reads outside the row, runs code or has effects.

    Two lists are joined: the unresolved functions in the tree of Spark's parser, and every registered name that stands before a bracket.
    The tree knows what is a function, also one that no registry has; the text hides nothing, however the tree is printed.
    """
    state = spark._jsparkSession.sessionState()
    tree = json.loads(state.sqlParser().parsePlan(sql).toJSON())
    called = {n["nameParts"].strip("[]").lower() for n in _nodes(tree) if n.get("class", "").endswith(".UnresolvedFunction")}
    plain = re.sub(QUOTED_OR_SKIPPED, lambda m: m[1] or " ", sql)
    written = {w.strip("`").lower() for w in re.findall(r"(`[^`]+`|\w+)\s*\(", plain)}
    registry, identifier = state.functionRegistry(), spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier

    def allowed(name: str) -> bool:
        found = registry.lookupFunction(identifier(name))
        if not found.isDefined():
            return name not in called
        info = found.get()
        return info.getSource() == "built-in" and (info.getGroup() in KINDS or name in HARMLESS)

    return sorted(name for name in called | written if not allowed(name))


def findings(spark: SparkSession, sql: str, tables: list[str]) -> list[str]:
    """Why the statement may not run; the same expressions audit whole logs."""
    context = "\n".join(f"Table: {t}" for t in tables)
    # A one-row local relation: Catalyst evaluates the audit while planning, without starting a job.
    one = spark.sql(
        "SELECT * FROM VALUES (:sql, :context) AS t(sql, schema_context)", args={"sql": sql, "context": context}
    )
    row = with_structure(with_safety(one)).select("safety", "structural").first()
    return [] if row.safety.passed and row.structural.passed else [*row.structural.details, *row.safety.details]


def run(spark: SparkSession, sql: str, tables: dict[str, DataFrame], max_rows: float | None = None) -> Result:
    """Run one audited SELECT over the given tables with an outer row bound.

    The bound is an outer limit, so Catalyst stops the query early or turns an inner ORDER BY ... LIMIT into a top-k.
    The statement sees exactly ``tables``, as common table expressions over uniquely named views.
    """
    problems = findings(spark, sql, list(tables))
    if not problems:
        problems = [f"Unknown source: {name}" for name in foreign_sources(spark, clean_statement(sql), list(tables))]
        problems += [f"Function not allowed: {name}" for name in foreign_functions(spark, clean_statement(sql))]
    if problems:
        raise RejectedQuery("; ".join(problems))
    prefix = uuid.uuid4().hex
    names = {name: f"t_{prefix}_{name}" for name in tables}
    for name, df in tables.items():
        df.createOrReplaceTempView(names[name])
    try:
        shown = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in names.items())
        rows = spark.sql(f"WITH {shown} SELECT * FROM (\n{clean_statement(sql)}\n) LIMIT {resolve_rows(max_rows)}")
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)
    return Result(rows)


def execute(
    spark: SparkSession, sql: str, tables: dict[str, DataFrame], max_rows: float | None = None, time_limit: float = TIME_LIMIT
) -> Execution:
    """Run a statement like ``run`` and fetch its rows, within ``time_limit`` seconds; rejected statements raise, failing ones say so.

    The statement's jobs carry a tag of their own, by which they are interrupted when the time is over; no other job is touched.
    """
    rows = run(spark, sql, tables, max_rows).rows
    context, tag, started, over = spark.sparkContext, f"bounded-{uuid.uuid4().hex}", time.monotonic(), threading.Event()

    def watch() -> None:
        wait = time_limit
        while not over.wait(wait):  # a statement may begin further jobs
            context.cancelJobsWithTag(tag)
            wait = 0.5

    context.addJobTag(tag)
    context.setLocalProperty("spark.job.interruptOnCancel", "true")
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        found, error = rows.collect(), None
    except Exception as failure:
        found, error = [], str(failure).strip().split("\n")[0]
    finally:
        over.set()
        watcher.join()
        context.removeJobTag(tag)
        context.setLocalProperty("spark.job.interruptOnCancel", None)
    elapsed = time.monotonic() - started
    if error is not None and elapsed >= time_limit:
        error = f"Statement ran longer than {time_limit:g} s"
    return Execution(rows.columns, found, 1000 * elapsed, error)
