"""`sql` rules: one question that a user writes in SQL, answered from the tables under validation and nothing else.

A question is accepted by what it means, not by how it reads: the plan that Catalyst has analysed is walked, and every
relation must be a registered table, every operator and function one of a list of deterministic ones. The tables stand as
common table expressions over views with private names, so no view of the session is replaced or seen.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Seconds after which an answer that is not there is cancelled.
BUDGET_S = 300.0

# fixed values: names of Catalyst's plan nodes and expressions that only read what is below them, and always alike
NODES = frozenset(
    "Aggregate CTERelationDef CTERelationRef Deduplicate Distinct Except Expand Filter GlobalLimit Intersect Join LocalLimit LocalRelation "
    "Offset OneRowRelation Project Sort SubqueryAlias Union Window WithCTE".split()
)
EXPRESSIONS = frozenset(
    # columns, literals, subqueries, windows
    "Alias AttributeReference OuterReference Literal Cast SortOrder ScalarSubquery Exists ListQuery InSubquery AggregateExpression "
    "WindowExpression WindowSpecDefinition SpecifiedWindowFrame UnboundedPreceding UnboundedFollowing CurrentRow "
    # logic
    "And Or Not In InSet EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual Between IsNull IsNotNull IsNaN If "
    "With CommonExpressionDef CommonExpressionRef CaseWhen Coalesce NullIf Nvl Nvl2 Like RLike StartsWith EndsWith Contains "
    # numbers
    "Add Subtract Multiply Divide IntegralDivide Remainder Pmod TryAdd TrySubtract TryMultiply TryDivide UnaryMinus UnaryPositive Abs Round BRound "
    "Ceil Floor RoundCeil RoundFloor Sqrt Exp Log Log10 Log2 Pow Greatest Least Signum "
    # texts
    "Upper Lower Length Substring Left Right StringTrim StringTrimLeft StringTrimRight StringReplace Concat ConcatWs StringLPad StringRPad "
    "StringInstr RegExpReplace RegExpExtract "
    # dates
    "Year Quarter Month DayOfMonth DayOfWeek DayOfYear DateAdd DateSub DateDiff AddMonths MonthsBetween LastDay TruncDate MakeDate "
    "DateAddYMInterval DateAddInterval SubtractDates ParseToDate "
    # aggregates and ranks
    "Count CountIf Sum TrySum Average TryAverage Min Max BoolAnd BoolOr StddevSamp StddevPop VarianceSamp VariancePop Percentile PercentileDisc PercentileCont "
    "Median RowNumber Rank DenseRank Lag Lead".split()
)


class SqlRuleError(ValueError):
    """A `sql` rule that is not one answerable question about the registered tables."""


def _items(seq) -> Iterator:
    for i in range(seq.size()):
        yield seq.apply(i)


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _check_expression(e) -> None:
    name = _name(e)
    if name not in EXPRESSIONS:
        raise SqlRuleError(f"a sql rule may not use {e.prettyName()}")
    if not e.deterministic():
        raise SqlRuleError(f"{e.prettyName()} does not always give the same answer")
    for x in _items(e.children()):
        _check_expression(x)


def _check_plan(plan, private: set[str]) -> None:
    name = _name(plan)
    if name == "SubqueryAlias" and plan.identifier().name() in private:
        return
    if name not in NODES:
        raise SqlRuleError(f"a sql rule may read only the registered tables, by joining, filtering and counting; it has {plan.nodeName()}")
    for e in _items(plan.expressions()):
        _check_expression(e)
    for below in (plan.children(), plan.subqueries()):
        for x in _items(below):
            _check_plan(x, private)


def question(tables: Mapping[str, DataFrame], text: str, private: Mapping[str, str]) -> DataFrame:
    """The checked question as a DataFrame of one column; `private` names a view for each table."""
    spark = next(iter(tables.values())).sparkSession
    try:
        spark._jsparkSession.sessionState().sqlParser().parsePlan(text)  # it is one statement by itself
        named = ", ".join(f"`{name}` AS (SELECT * FROM `{view}`)" for name, view in private.items())
        asked = spark.sql(f"WITH {named} SELECT * FROM (\n{text}\n)")  # a statement that is no query has no place here
        _check_plan(asked._jdf.queryExecution().analyzed(), set(private.values()))
    except PySparkException as e:
        raise SqlRuleError(str(e).splitlines()[0]) from e
    except Exception as e:
        if isinstance(e, SqlRuleError):
            raise
        raise SqlRuleError("a sql rule must be one SELECT") from e
    if len(asked.schema) != 1:
        raise SqlRuleError("a sql rule must return one value")
    kind = asked.schema[0].dataType
    whole = isinstance(kind, T.IntegralType) or (isinstance(kind, T.DecimalType) and kind.scale == 0)
    if not whole and not isinstance(kind, T.BooleanType):
        raise SqlRuleError(f"a sql rule must return a count or a boolean, not {kind.simpleString()}")
    return asked


def answer(tables: Mapping[str, DataFrame], text: str, budget_s: float = BUDGET_S) -> int:
    """How many rows violate: the count that the question returns, or 1 for a boolean that does not hold."""
    spark = next(iter(tables.values())).sparkSession
    mark = uuid.uuid4().hex
    private = {name: f"premia_{mark}_{k}" for k, name in enumerate(tables)}
    for name, df in tables.items():
        df.createTempView(private[name])
    context, over = spark.sparkContext, threading.Event()

    def stop() -> None:
        over.set()
        context.cancelJobGroup(mark)

    timer = threading.Timer(budget_s, stop)
    before = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    try:
        asked = question(tables, text, private)
        context.setJobGroup(mark, "a sql rule", interruptOnCancel=True)
        timer.start()
        rows = asked.limit(2).collect()
    except SqlRuleError:
        raise
    except Exception as e:
        raise SqlRuleError(f"no answer within the budget of {budget_s} seconds" if over.is_set() else str(e).splitlines()[0]) from e
    finally:
        timer.cancel()
        for key, value in before.items():
            context.setLocalProperty(key, value)
        for view in private.values():
            spark.catalog.dropTempView(view)
    if len(rows) != 1:
        raise SqlRuleError("a sql rule must return one value")
    value = rows[0][0]
    if isinstance(value, bool) or (value is None and isinstance(asked.schema[0].dataType, T.BooleanType)):
        return int(not value)
    if value is None or value < 0:
        raise SqlRuleError(f"{value} is no number of rows")
    return int(value)
