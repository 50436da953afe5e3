"""Which columns expressions, recipe steps and factors read, from the trees that Catalyst has resolved."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.operators import prepare


def _items(seq):
    for i in range(seq.size()):
        yield seq.apply(i)


def columns_of(df: DataFrame, expression: Column | str) -> list[str]:
    """Columns of `df` that an expression reads, in the order of `df`.

    Names are what Catalyst resolved, so a function called like a column, a lambda's variable or a literal is none, and a
    column is found whatever its case or quoting; windows and subqueries that refer to `df` count.
    """
    value = expression if isinstance(expression, Column) else F.expr(expression)
    base = df._jdf.queryExecution().analyzed()
    own = {a.exprId().id(): a.name() for a in _items(base.output())}
    read: set[str] = set()

    def walk(plan) -> None:
        if plan.fastEquals(base):
            return
        for e in _items(plan.expressions()):
            tree(e)
        for below in _items(plan.children()):
            walk(below)

    def tree(e) -> None:
        """Attributes below an expression; subqueries name the outer columns they read among their children."""
        for a in _items(e.references().toSeq()):
            if a.exprId().id() in own:
                read.add(own[a.exprId().id()])
        for x in _items(e.children()):
            tree(x)

    walk(df.select(value.alias("__value"))._jdf.queryExecution().analyzed())
    return [c for c in df.columns if c in read]


@dataclass(frozen=True)
class StepColumns:
    """What one recipe step reads and writes."""

    index: int
    kind: str
    table: str
    reads: tuple[str, ...]
    writes: tuple[str, ...]


def _step_columns(kind: str, df: DataFrame, params: Mapping) -> tuple[list[str], list[str]]:
    """(columns read, columns written) of a step on a table as it stands before it."""
    visible = [c for c in df.columns if c not in prepare._HIDDEN]
    if kind == "rename":
        return list(params["columns"]), list(params["columns"].values())
    if kind == "cast":
        return list(params["columns"]), list(params["columns"])
    if kind in ("parse_date", "map_values", "fill_null", "pseudonymise"):
        return [params["column"]], [params["column"]]
    if kind in ("trim_whitespace", "normalise_case"):
        return list(params["columns"]), list(params["columns"])
    if kind == "derive_expression":
        return columns_of(df, prepare._expression(params["expression"])), [params["column"]]
    if kind == "filter_rows":
        return columns_of(df, prepare._expression(params["expression"])), []
    if kind == "deduplicate":
        return list(params.get("columns") or visible), []
    if kind == "join_table":
        return list(params["on"]), []
    if kind == "derive_exposure":
        return [params["start"], params["end"]], [params.get("column", "exposure_years")]
    if kind == "explode_period":
        ends = [params.get("start", "exposure_start"), params.get("end", "exposure_end")]
        return ends, [c for c in (*ends, params.get("exposure", "exposure_years")) if c in visible]
    return [], []


def recipe_columns(tables: Mapping[str, DataFrame], steps: Sequence[Mapping]) -> list[StepColumns]:
    """Reads and writes of every step. Steps are applied one by one, unexecuted, so names are resolved where they are used."""
    out, working = [], {name: prepare._carry(name, df, None) for name, df in tables.items()}
    for i, step in enumerate(steps):
        kind, name, params = step["step"], step.get("table", next(iter(working))), step.get("params", {})
        df = working[name]
        reads, writes = _step_columns(kind, df, params)
        if kind == "attach_claims":
            raise prepare.RecipeError("attach_claims makes new tables; ask for the steps before and after it")
        after = prepare._step(kind, df, params, working, False)
        before = {c for c in df.columns}
        # what a step adds without naming it (a joined table's columns) is written by it
        writes = list(dict.fromkeys([*writes, *(c for c in after.columns if c not in before and c not in prepare._HIDDEN)]))
        out.append(StepColumns(i, kind, name, tuple(reads), tuple(writes)))
        working[name] = after
    return out


def recipe_lineage(tables: Mapping[str, DataFrame], steps: Sequence[Mapping]) -> dict[tuple[str, str], set[tuple[str, str]]]:
    """(table, column) at the end -> the (table, column)s of the sources that its values come from."""
    found: dict[str, dict[str, set]] = {name: {c: {(name, c)} for c in df.columns} for name, df in tables.items()}
    for said, step in zip(recipe_columns(tables, steps), steps, strict=True):
        mine, params = found[said.table], step.get("params", {})
        if said.kind == "rename":
            found[said.table] = {params["columns"].get(c, c): v for c, v in mine.items()}
        elif said.kind == "join_table":
            other = found[params["other"]]
            mine.update({c: set(other[c]) for c in other if c not in params["on"] and c not in mine})
        elif said.kind in ("deduplicate", "filter_rows"):
            continue
        elif said.kind in ("derive_expression", "derive_exposure", "explode_period"):
            source = set().union(*[mine[c] for c in said.reads]) if said.reads else set()
            mine.update({c: set(source) for c in said.writes})
    return {(name, c): v for name, columns in found.items() for c, v in columns.items()}
