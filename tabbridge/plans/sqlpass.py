"""SQL text in, rows or an affected-row count out."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabbridge.functions.text import rows_as_text
from tabbridge.session import forget_tables, isolated
from tabbridge.sources.managed import rewrite_where, sql_literal, write_table

_PLACEHOLDER = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|\?|\$(\d+)", re.DOTALL)


class SqlResult(NamedTuple):
    rows: DataFrame | None  # for statements that return rows
    affected: int | None  # rows written; 0 for definitions, None where unknown


def bind_sql(text: str, args: Sequence[Any]) -> tuple[str, list[Any]]:
    """``?`` and ``$n`` placeholders to positional ones with their values in order.

    Placeholders inside quotes and comments are text. Too few or too many values is an error.
    """
    values: list[Any] = []
    used: set[int] = set()

    def take(match: re.Match) -> str:
        if match.group(0) != "?" and match.group(1) is None:
            return match.group(0)
        index = int(match.group(1)) - 1 if match.group(1) else len(values)
        if not 0 <= index < len(args):
            raise ValueError("fewer values than placeholders")
        used.add(index)
        values.append(args[index])
        return "?"

    bound = _PLACEHOLDER.sub(take, text)
    if len(used) < len(args):
        raise ValueError("more values than placeholders")
    return bound, values


def fill_sql(bound: str, values: Sequence[Any]) -> str:
    """The bound statement with its values written as literals."""
    left = iter(values)
    return _PLACEHOLDER.sub(lambda m: sql_literal(next(left)) if m.group(0) == "?" else m.group(0), bound)


def _name(plan: Any) -> str:
    """Class of one of Spark's plans, which tells the kind of statement."""
    return plan.getClass().getSimpleName()


def _identifier(parts: Any) -> str:
    return ".".join(f"`{parts.apply(i).replace('`', '``')}`" for i in range(parts.size()))


def _text_of(expression: Any, text: str) -> str:
    """The part of the statement an expression was parsed from."""
    origin = expression.origin()
    return text[origin.startIndex().get() : origin.stopIndex().get() + 1]


def _written(plan: Any) -> int | None:
    """Rows written by the commands of a finished statement; None without such a command."""
    kind = _name(plan)
    if kind == "AdaptiveSparkPlanExec":
        return _written(plan.executedPlan())
    if kind == "ResultQueryStageExec":
        return _written(plan.plan())
    if kind == "CommandResultExec":
        return _written(plan.commandPhysicalPlan())
    if kind == "DataWritingCommandExec":
        return plan.metrics().apply("numOutputRows").value()
    children = plan.children()
    found = [_written(children.apply(i)) for i in range(children.size())]
    known = [n for n in found if n is not None]
    return sum(known) if known else None


def _target(table: Any) -> tuple[str, str | None]:
    """Name of the table of an UPDATE or DELETE, and its alias in the statement."""
    alias = None
    if _name(table) == "SubqueryAlias":
        alias, table = table.alias(), table.child()
    return _identifier(table.multipartIdentifier()), alias


def _rewrite(spark: SparkSession, plan: Any, text: str) -> int:
    """UPDATE or DELETE of a table of files."""
    (table, alias), condition, changes = _target(plan.table()), plan.condition(), None
    if _name(plan) == "UpdateTable":
        condition = condition.get() if condition.isDefined() else None
        names = {c.lower(): c for c in spark.table(table).columns}
        given, changes = plan.assignments(), {}
        for i in range(given.size()):
            parts = given.apply(i).key().nameParts()
            name = parts.apply(parts.size() - 1)
            changes[names.get(name.lower(), name)] = F.expr(_text_of(given.apply(i).value(), text))
    elif condition.sql() == "true":  # none was given
        condition = None
    held = F.lit(True) if condition is None else F.expr(_text_of(condition, text))
    return rewrite_where(spark, table, held, changes, alias)


def execute_sql(
    spark: SparkSession, text: str, args: Sequence[Any] = (), database: str | None = None
) -> SqlResult:
    """Run one statement, in a database if one is given.

    Spark's parser tells what the statement is. What has columns once analysed is a row
    result, a lazy DataFrame for queries. Statements that write report the rows they wrote, by
    the write command's own metrics; CREATE TABLE AS the rows of the new table. UPDATE and
    DELETE are carried out by ``rewrite_where``; their conditions may not hold subqueries.
    Definitions report 0; None stands for a write that Spark does not count.

    A database is entered in a session of its own, so other threads are not moved.
    """
    bound, values = bind_sql(text.strip().rstrip(";"), args)
    own = spark
    if database is not None:
        own = isolated(spark)
        own.catalog.setCurrentDatabase(database)
    parser = own._jsparkSession.sessionState().sqlParser()
    plan = parser.parsePlan(bound)
    kind = _name(plan)
    try:
        if kind in ("UpdateTable", "DeleteFromTable"):
            literal_text = fill_sql(bound, values)
            return SqlResult(None, _rewrite(own, parser.parsePlan(literal_text), literal_text))
        if kind == "CreateTableAsSelect":
            table = _identifier(plan.name().nameParts())
            new = not own.catalog.tableExists(table)
            own.sql(bound, args=values or None)
            return SqlResult(None, own.table(table).count() if new else 0)
        done = own.sql(bound, args=values or None)
        if done.columns:
            rows = done if own is spark else _hand_over(done, spark)
            return SqlResult(rows, None)
        affected = _written(done._jdf.queryExecution().commandExecuted().commandPhysicalPlan())
        uncounted = kind in ("InsertIntoStatement", "InsertIntoDir", "MergeIntoTable", "LoadData")
        return SqlResult(None, affected if affected is not None or uncounted else 0)
    finally:
        if own is not spark:
            forget_tables(spark)


def _hand_over(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """The analysed rows as a DataFrame of another session."""
    dataset = spark._jvm.org.apache.spark.sql.classic.Dataset
    return DataFrame(dataset.ofRows(spark._jsparkSession, rows._jdf.queryExecution().analyzed()), spark)


def execute_sql_into(
    spark: SparkSession,
    text: str,
    table: str,
    args: Sequence[Any] = (),
    database: str | None = None,
    key: str | None = "dense",
    key_name: str | None = None,
) -> int:
    """Write a query's result into a table with a surrogate key; returns the rows written."""
    result = execute_sql(spark, text, args, database)
    if result.rows is None:
        raise ValueError("only a query can be written into a table")
    return write_table(result.rows, table, key=key, key_name=key_name)


def sql_rows_as_text(
    spark: SparkSession, text: str, args: Sequence[Any] = (), database: str | None = None
) -> DataFrame:
    """Query result with every cell as text, NULL as ''."""
    rows = execute_sql(spark, text, args, database).rows
    if rows is None:
        raise ValueError("only a query returns rows")
    return rows_as_text(rows)
