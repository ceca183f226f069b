"""Expressions over the text of SQL statements.

Statements are not parsed. Once string literals and comments are blanked, brackets are opened from the inside out, so that each level is a
text without brackets, and the sources after FROM and JOIN are read level by level. Every source counts, wherever it stands; names that a
WITH list defines do not. What cannot be read to its end is reported as such, never passed over.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statements that modify data or the schema, in report order.
FORBIDDEN = [
    r"\bDROP\s+",
    r"\bDELETE\s+",
    r"\bUPDATE\s+",
    r"\bINSERT\s+",
    r"\bALTER\s+",
    r"\bTRUNCATE\s+",
    r"\bGRANT\s+",
    r"\bREVOKE\s+",
    r"\bCREATE\s+",
    r"\bEXEC(UTE)?\s+",
    r"\bCALL\s+",
    r"\bLOCK\s+TABLES?\b",
]

MARK = "\u0001"
QUERY, BRACKETS = "\u0002", "\u0003"  # a bracketed query, and anything else that stood in brackets
DEPTH = 40  # levels of brackets; deeper statements are unreadable
NAME = r"""(?:\w++|"[^"]+"|`[^`]+`)"""
IDENT = rf"{NAME}(?:\s*\.\s*{NAME})*+"
QUOTED_OR_SKIPPED = r"""("[^"]*"|`[^`]*`)|'[^']*'|--[^\n]*|/\*(?s:.*?)\*/"""
DOUBTFUL_LITERAL = r"""\\['"`]"""  # dialects differ on whether the literal ends here
FROM_WORDS = r"(?i)\b(?:extract|substring|trim|overlay|position)\s*\([^()]*\)"
DISTINCT_FROM = r"(?i)\bdistinct\s+from\b"
DOUBLED = r"\(\s*\(([^()]*)\)\s*\)"
QUERY_START = r"(?i)\(\s*(?:select|with|values)\b[^()]*\)"
LONE_SOURCE = rf"(?i)\b(from|join)\s*\(\s*+(?!(?:select|with|values)\b)([^()]*[\w`\"{QUERY}][^()]*)\)"
# What ends the sources of a level.
CLAUSE = (
    r"where|group|having|order|limit|window|union|intersect|except|minus|qualify|fetch|offset|for|connect|start|cluster|distribute|sort|from"
)
SOURCES = rf"(?is)\bfrom\b(.*?)(?=\b(?:{CLAUSE})\b|;|$)"
LATERAL_VIEW = rf"(?i)\blateral\s+view\s+(?:outer\s+)?{IDENT}\s*{BRACKETS}\s*{NAME}(?:\s+as\s+{NAME}(?:\s*,\s*{NAME})*)?"  # of no table
SEPARATOR = r"(?i),|(?:\b(?:natural|inner|cross|left|right|full|outer|semi|anti|asof)\s+)*\bjoin\b"
TAIL = rf"(?:\s+(?:as\s+)?(?!on\b|using\b|tablesample\b){NAME})?(?:\s*{BRACKETS})?"
SAMPLE = rf"(?:\s+tablesample\s+(?:\w+\s*)?{BRACKETS}(?:\s*repeatable\s*{BRACKETS})?)?"
CONDITION = rf"(?:\s+(?:on\b.*|using\s*{BRACKETS}))?"
READABLE = rf"(?is)^\s*(?:lateral\s+|only\s+)?+(?:table\s+)?+(?:{IDENT}(?:\s*{BRACKETS})?|{QUERY}){SAMPLE}{TAIL}{SAMPLE}{CONDITION}\s*$"
SOURCE_NAME = rf"(?is)^\s*(?:lateral\s+|only\s+)?+(?:table\s+)?+({IDENT})(?!\s*{BRACKETS})"
TABLE_QUERY = rf"(?i)(?:^|;|\b(?:union|intersect|except|minus|all|distinct|as))\s*\btable\s+({IDENT})"
_DEFINED = rf"{NAME}\s*{BRACKETS}?\s*as\s*(?:(?:not\s+)?materialized\s*)?[{QUERY}{BRACKETS}]"
WITH_LIST = rf"(?is)(?:^|;)\s*(?:explain\s+)?with\s+(?:recursive\s+)?({_DEFINED}(?:\s*,\s*{_DEFINED})*)"
DEFINED_NAME = rf"(?is)({NAME})\s*{BRACKETS}?\s*as\s*(?:(?:not\s+)?materialized\s*)?[{QUERY}{BRACKETS}]"
CONTEXT_TABLE = r"Table:\s*([^\s,]+)"


def blanked(sql: Column) -> Column:
    """The statement with string literals and comments replaced by a blank; quoted names stay."""
    marked = F.regexp_replace(sql, QUOTED_OR_SKIPPED, f"$1{MARK}")
    return F.regexp_replace(F.regexp_replace(marked, f'(["`]){MARK}', "$1"), MARK, " ")


def forbidden_hits(sql: Column) -> Column:
    """The matching patterns, in report order; they also fire inside string literals."""
    return F.filter(F.array(*(F.when(sql.rlike("(?i)" + p), F.lit(p)) for p in FORBIDDEN)), lambda p: p.isNotNull())


def has_comment(sql: Column) -> Column:
    """A block comment, or two dashes with anything but blanks after them."""
    return sql.contains("/*") | sql.rlike(r"--\s*\S")


def statements(clean: Column) -> Column:
    return F.filter(F.transform(F.split(clean, ";"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def statement_kind(statement: Column) -> Column:
    """``select`` for SELECT and WITH statements, else the leading word."""
    word = F.lower(F.regexp_extract(statement, r"^[\s(]*(\w+)", 1))
    return F.when(word == "with", "select").otherwise(word)


def bare_name(identifier: Column) -> Column:
    """The last part of a possibly quoted and qualified name."""
    return F.element_at(F.split(F.trim(F.translate(identifier, '"`', "")), r"\."), -1)


def levels(clean: Column) -> Column:
    """struct<text, inner>: the statement with its brackets replaced by QUERY or BRACKETS, and what stood in them, from the inside out.

    Brackets around a lone source or join are dropped. Brackets are left in ``text`` if they do not match or lie deeper than DEPTH.
    """

    def unwrapped(text: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(text, FROM_WORDS, f" {BRACKETS} "), LONE_SOURCE, "$1 $2 ")
        return F.regexp_replace(F.regexp_replace(plain, DOUBLED, "($1)"), LONE_SOURCE, "$1 $2 ")

    def step(acc: Column, _: Column) -> Column:
        # The array of one element makes the text be computed once.
        opened = F.transform(
            F.array(unwrapped(acc["text"])),
            lambda t: F.struct(
                F.regexp_replace(F.regexp_replace(t, QUERY_START, f" {QUERY} "), r"\([^()]*\)", f" {BRACKETS} ").alias("text"),
                F.concat(acc["inner"], F.regexp_extract_all(t, F.lit(r"\(([^()]*)\)"), F.lit(1))).alias("inner"),
            ),
        )
        return F.when(F.contains(acc["text"], F.lit("(")), opened[0]).otherwise(acc)

    start = F.struct(F.regexp_replace(clean, DISTINCT_FROM, " ").alias("text"), F.array().cast("array<string>").alias("inner"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), start, step)


def _scopes(read: Column) -> Column:
    return F.concat(F.array(read["text"]), F.reverse(read["inner"]))


def _listed(scope: Column) -> Column:
    """The items of all FROM lists of a level; a part that begins a join is an item, too."""
    lists = F.regexp_extract_all(scope, F.lit(SOURCES), F.lit(1))
    return F.flatten(F.transform(lists, lambda s: F.split(F.regexp_replace(s, LATERAL_VIEW, " "), SEPARATOR)))


def cte_names(read: Column) -> Column:
    """Names that WITH lists define, outermost first. ``read`` comes from ``levels``."""
    lists = F.flatten(F.transform(_scopes(read), lambda s: F.regexp_extract_all(s, F.lit(WITH_LIST), F.lit(1))))
    names = F.flatten(F.transform(lists, lambda s: F.regexp_extract_all(s, F.lit(DEFINED_NAME), F.lit(1))))
    return F.transform(names, lambda n: F.lower(F.translate(n, '"`', "")))


def referenced_tables(read: Column) -> Column:
    """Distinct names of the sources, outermost level first, without table functions and names of WITH lists."""

    def named(scope: Column) -> Column:
        sources = F.transform(_listed(scope), lambda i: F.regexp_extract(i, SOURCE_NAME, 1))
        return F.concat(sources, F.regexp_extract_all(scope, F.lit(TABLE_QUERY), F.lit(1)))

    names = F.transform(F.filter(F.flatten(F.transform(_scopes(read), named)), lambda n: n != ""), bare_name)
    ctes = cte_names(read)
    return F.filter(F.array_distinct(names), lambda n: ~F.array_contains(ctes, F.lower(n)))


def unreadable(read: Column, sql: Column) -> Column:
    """What keeps the sources of a statement from being read to their end, as texts; empty if nothing does."""
    items = F.flatten(F.transform(_scopes(read), _listed))
    hidden = F.filter(items, lambda i: ~i.rlike(READABLE))
    shown = F.transform(hidden, lambda i: F.trim(F.regexp_replace(F.translate(i, QUERY + BRACKETS, "()"), r"\s+", " ")))
    doubts = F.filter(
        F.array(
            F.when(read["text"].rlike("[()]"), F.lit("brackets that do not match")),
            F.when(sql.rlike(DOUBTFUL_LITERAL), F.lit("a backslash before a quote")),
        ),
        lambda d: d.isNotNull(),
    )
    return F.when(F.size(doubts) > 0, doubts).otherwise(shown)


def context_tables(context: Column) -> Column:
    found = F.regexp_extract_all(context, F.lit(CONTEXT_TABLE), F.lit(1))
    return F.array_distinct(F.transform(found, lambda t: F.lower(bare_name(t))))


def ungrounded(tables: Column, known: Column) -> Column:
    return F.filter(tables, lambda t: ~F.array_contains(known, F.lower(t)))


def complexity(sql: Column) -> Column:
    lower = F.lower(sql)
    points = sum(
        c.cast("int")
        for c in (
            lower.contains("join"),
            lower.contains("group by"),
            F.regexp_count(lower, F.lit("select")) > 1,
            lower.contains("union"),
            lower.contains("window") | lower.contains("over("),
        )
    )
    return F.when(points <= 1, "simple").when(points <= 3, "moderate").otherwise("complex")
