"""Resolving declared factors to model columns, and what a fit has not seen."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.operators.banding import Banding, band_label
from premia.operators.columns_read import columns_of
from premia.operators.grouping import Grouping, apply_grouping
from premia.session import small

KINDS = ("identity", "banding", "grouping", "expression", "interaction")
REFUSED_INTENTS = ("control", "diagnostic", "prohibited")
PAIR = " | "


class FactorError(ValueError):
    """A factor that may not or cannot be resolved."""


@dataclass(frozen=True)
class Factor:
    """One model term. `continuous` marks a numeric term that is not turned into levels."""

    slug: str
    kind: str
    column: str | None = None
    banding: Banding | None = None
    grouping: Grouping | None = None
    expression: Column | str | None = None
    operands: tuple[str, ...] = ()
    continuous: bool = False
    intent: str = "rating"


@dataclass(frozen=True)
class Resolved:
    """The table with model columns, and slug -> column for the terms a model gets."""

    df: DataFrame
    terms: Mapping[str, str] = field(default_factory=dict)


def rateable(factors: Sequence[Factor]) -> list[Factor]:
    return [f for f in factors if f.intent not in REFUSED_INTENTS]


def needed_columns(factors: Sequence[Factor], offsets: Sequence[str] = (), df: DataFrame | None = None) -> list[str]:
    """Source columns a fit reads, each once: offsets, then every factor's.

    An expression's are those its resolved tree refers to; that takes the table, `df`.
    """
    out = dict.fromkeys(offsets)
    for f in factors:
        if f.kind == "expression" and df is not None:
            out.update(dict.fromkeys(factor_columns(df, f)))
            continue
        banded = f.banding.column if f.banding and f.kind == "banding" else None
        for c in (f.column, banded, f.grouping and f.grouping.column):
            if c:
                out[c] = None
    return list(out)


def factor_columns(df: DataFrame, factor: Factor) -> list[str]:
    """Columns of `df` that one factor reads; an interaction reads its operands' through them."""
    if factor.kind != "expression":
        return needed_columns([factor])
    try:
        return columns_of(df, factor.expression)
    except AnalysisException as e:
        raise FactorError(f"factor {factor.slug!r}: {str(e).splitlines()[0]}") from e


def resolve_factors(df: DataFrame, factors: Sequence[Factor]) -> Resolved:
    """Add `<slug>__resolved` for every transformed factor; an identity keeps its column.

    An interaction pairs its operands' levels; its operands then give no term of their own.
    """
    refused = [f.slug for f in factors if f.intent in REFUSED_INTENTS]
    if refused:
        raise FactorError(f"factor(s) {refused} may not enter a fit")
    by_slug = {f.slug: f for f in factors}
    if len(by_slug) != len(factors):
        raise FactorError("factor slugs repeat")
    missing = [c for c in needed_columns(factors, df=df) if c not in df.columns]
    if missing:
        raise FactorError(f"column(s) {missing} are absent")
    terms: dict[str, str] = {}
    for f in factors:
        if f.kind == "interaction":
            continue
        df, terms[f.slug] = _resolve_one(df, f)
    used: set[str] = set()
    for f in factors:
        if f.kind != "interaction":
            continue
        for o in f.operands:
            if o not in by_slug:
                raise FactorError(f"interaction {f.slug!r} names unknown operand {o!r}")
            if by_slug[o].kind == "interaction":
                raise FactorError(f"interaction {f.slug!r} nests another")
            if by_slug[o].continuous:
                raise FactorError(f"interaction {f.slug!r} has a continuous operand {o!r}")
        name = f"{f.slug}__resolved"
        parts: list[Column] = []
        for o in f.operands:
            parts += [F.lit(PAIR), F.col(terms[o]).cast("string")] if parts else [F.col(terms[o]).cast("string")]
        df = df.withColumn(name, F.concat(*parts))
        terms[f.slug] = name
        used.update(f.operands)
    return Resolved(df, {s: c for s, c in terms.items() if s not in used})


def _resolve_one(df: DataFrame, f: Factor) -> tuple[DataFrame, str]:
    name = f"{f.slug}__resolved"
    if f.kind == "identity":
        return df, f.column
    if f.kind == "banding":
        if f.column and f.banding.column != f.column:
            raise FactorError(f"factor {f.slug!r} bands {f.banding.column!r}, not {f.column!r}")
        return df.withColumn(name, band_label(f.banding.column, f.banding)), name
    if f.kind == "grouping":
        if f.column and f.grouping.column != f.column:
            raise FactorError(f"factor {f.slug!r} groups {f.grouping.column!r}, not {f.column!r}")
        return apply_grouping(df, f.grouping, name), name
    if f.kind == "expression":
        value = f.expression if isinstance(f.expression, Column) else F.expr(f.expression)
        kind = df.select(value.alias("x")).schema["x"].dataType.typeName()
        if kind == "string":
            return df.withColumn(name, value), name
        if f.banding is None:
            raise FactorError(f"factor {f.slug!r}: a numeric expression must be banded")
        return df.withColumn(name, band_label(value, f.banding)), name
    raise FactorError(f"unknown factor kind {f.kind!r}")


def cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct level combinations."""
    return df.select(*columns).distinct()


def unseen_rows(df: DataFrame, columns: Sequence[str], fitted: DataFrame) -> DataFrame:
    """`df` plus `unseen`: some column holds a level the fit never saw.

    Per column the fitted levels are a small counted list.
    """
    flag = F.lit(False)
    for i, c in enumerate(columns):
        known = small(fitted.select(F.col(c).alias(f"__l{i}")).distinct().withColumn(f"__k{i}", F.lit(1)))
        df = df.join(known, F.col(c).eqNullSafe(F.col(f"__l{i}")), "left")
        flag = flag | F.col(f"__k{i}").isNull()
    return df.withColumn("unseen", flag).drop(*[x for i in range(len(columns)) for x in (f"__l{i}", f"__k{i}")])


def unseen_counts(df: DataFrame, columns: Sequence[str], fitted: DataFrame, exposure: str = "exposure_years") -> DataFrame:
    """Rows and exposure by whether the fit has seen their levels."""
    return unseen_rows(df, columns, fitted).groupBy("unseen").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(exposure), 6).alias("exposure_years")
    )


def key_grid(spark: SparkSession, levels: Mapping[str, Sequence[str]], first: int | None = None) -> DataFrame:
    """Level combinations in lexicographic order, all or the first few.

    Combination number `i` is decoded into one level per column, so nothing is joined.
    """
    lists = {c: sorted(set(v)) for c, v in levels.items()}
    total = math.prod(len(v) for v in lists.values())
    rows = spark.range(total if first is None else min(total, first))
    left = F.col("id")
    out: dict[str, Column] = {}
    for c, v in reversed(lists.items()):
        out[c] = F.element_at(F.array(*[F.lit(x) for x in v]), (F.pmod(left, F.lit(len(v))) + 1).cast("int"))
        left = F.floor(left / len(v))
    return rows.select(*[out[c].alias(c) for c in lists])


def unseen_cells(levels: Mapping[str, Sequence[str]], fitted: DataFrame, columns: Sequence[str], names: int = 20) -> tuple[int, list[tuple]]:
    """Producible level combinations the fit has no cell for: their exact number, and the first few.

    `levels` are closed domains declared by the factors. With m fitted cells, the first m + `names`
    combinations must hold the first `names` unseen ones, so the whole grid is never made.
    """
    inside = F.lit(True)
    for c in columns:
        inside = inside & F.col(c).isin(list(levels[c]))
    seen = fitted.where(inside).select(*columns).distinct()
    total = math.prod(len(set(levels[c])) for c in columns)
    fitted_cells = seen.count()
    count = total - fitted_cells
    if not count:
        return 0, []
    grid = key_grid(fitted.sparkSession, {c: levels[c] for c in columns}, fitted_cells + names)
    examples = grid.join(seen, list(columns), "left_anti").orderBy(*columns).limit(names).collect()
    return count, [tuple(r) for r in examples]
