"""Rate tables as DataFrames of cells: seeding, validation, diffs, weights and bulk operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premia.operators.factors import key_grid

VALUE = "decimal(28,12)"
KEY_TYPES = ("int", "bool", "date", "string")
CROSS = " x "


class RateTableError(ValueError):
    """A table or an operation that is not applicable."""


def finite_decimal(value) -> Decimal:
    """A parameter as an exact decimal; floats, NaN and infinities are refused."""
    if isinstance(value, float):
        raise RateTableError("rate-table parameters are decimal text, not floats")
    try:
        number = Decimal(value)
    except InvalidOperation as e:
        raise RateTableError(f"{value!r} is not a decimal") from e
    if not number.is_finite():
        raise RateTableError("a rate-table value must be finite")
    return number


def _lit(value: Decimal) -> Column:
    return F.lit(str(value)).cast(VALUE)


def seed_cells(relativities: DataFrame, factor: str, *, approved: bool) -> DataFrame:
    """One table of a model's factor: its levels and relativities. A level without one is skipped.

    `relativities` has columns factor, level, relativity.
    """
    if not approved:
        raise RateTableError("only an approved model seeds a rate table")
    return relativities.where((F.col("factor") == factor) & F.col("relativity").isNotNull()).select(
        F.col("level").alias(factor), F.col("relativity").cast(VALUE).alias("relativity")
    )


def validate_cells(
    cells: DataFrame,
    domains: Mapping[str, DataFrame],
    *,
    value: str = "relativity",
    low: str | None = None,
    high: str | None = None,
    has_default: bool = False,
) -> DataFrame:
    """Named issues of a table whose cells may still be text: (issue, key, detail).

    Every combination of the declared key levels must be there unless a default row covers the
    rest; values must be there, finite and within bounds; keys must be unique. `domains` maps each
    key to a one-column table of its levels.
    """
    keys = list(domains)
    text_key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    number = F.col(value).try_cast(VALUE) if isinstance(cells.schema[value].dataType, T.StringType) else F.col(value).cast(VALUE)
    shown = F.col(value).cast("string")
    bounds = F.lit(False)
    if low is not None:
        bounds = bounds | (number < _lit(finite_decimal(low)))
    if high is not None:
        bounds = bounds | (number > _lit(finite_decimal(high)))
    problem = (
        F.when(shown.isNull(), "null_value").when(number.isNull(), "non_finite_value").when(bounds, "out_of_bounds")
    )
    rows = cells.select(problem.alias("issue"), text_key.alias("key"), shown.alias("detail")).where("issue is not null")
    twice = (
        cells.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.lit("duplicate_key").alias("issue"), text_key.alias("key"), F.col("n").cast("string").alias("detail"))
    )
    out = rows.unionAll(twice)
    if not has_default:
        # The levels of a table's keys are part of its definition, so they are few.
        levels = {k: [r[0] for r in domains[k].select(F.col(domains[k].columns[0]).cast("string")).distinct().collect()] for k in keys}
        grid = key_grid(cells.sparkSession, levels)
        missing = grid.join(cells.select(*[F.col(k).cast("string").alias(k) for k in keys]), keys, "left_anti").select(
            F.lit("missing_key").alias("issue"), text_key.alias("key"), F.lit(None).cast("string").alias("detail")
        )
        out = out.unionAll(missing)
    return out


def diff_cells(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str = "relativity") -> DataFrame:
    """Changed cells: keys, change (added, removed, changed), old, new, absolute and percent change.

    Percent is null without an old value or on an old value of zero. Order by the keys' text.
    """
    a = before.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(value).cast(VALUE).alias("old_value"))
    b = after.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(value).cast(VALUE).alias("new_value"))
    both = a.join(b, list(keys), "full")
    change = (
        F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").when(F.col("old_value") != F.col("new_value"), "changed")
    )
    step = (F.col("new_value") - F.col("old_value")).cast(VALUE)
    return both.withColumn("change", change).where("change is not null").withColumns(
        {
            "abs_change": step,
            "pct_change": F.when(F.col("old_value") != 0, step.cast("double") / F.col("old_value").cast("double") * 100),
        }
    )


def diff_summary(diff: DataFrame, keys: Sequence[str], weights: DataFrame | None = None, weight: str = "exposure_years") -> DataFrame:
    """Changed cells, largest absolute percent change, exposure-weighted mean percent change.

    Cells without weight or percent are left out of the mean, which is null if none remain.
    """
    if weights is not None:
        side = weights.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(weight).cast("double").alias("__w"))
        diff = diff.join(side, list(keys), "left")
    else:
        diff = diff.withColumn("__w", F.lit(None).cast("double"))
    used = F.col("pct_change").isNotNull() & (F.col("__w") != 0)
    return diff.agg(
        F.count(F.lit(1)).alias("changed_cells"),
        F.max(F.abs("pct_change")).alias("max_abs_change_pct"),
        F.try_divide(F.sum(F.when(used, F.col("pct_change") * F.col("__w"))), F.sum(F.when(used, F.col("__w")))).alias(
            "exposure_weighted_mean_change_pct"
        ),
    )


def typed_key(df: DataFrame, column: str, key_type: str) -> Column:
    """A portfolio column in a key's declared type; what does not fit is null and matches nothing."""
    value, dtype = F.col(column), df.schema[column].dataType
    if key_type == "int":
        if isinstance(dtype, T.IntegralType):
            return value.cast("long")
        number = value.try_cast("double")
        return F.when(number == F.floor(number), number.try_cast("long"))
    if key_type == "bool":
        if isinstance(dtype, T.BooleanType):
            return value
        if isinstance(dtype, T.StringType):
            return F.when(F.lower(value) == "true", True).when(F.lower(value) == "false", False)
        return value.cast("boolean")
    if key_type == "date":
        return F.to_date(value) if not isinstance(dtype, T.StringType) else F.try_to_date(value, "yyyy-MM-dd")
    if key_type == "string":
        return value.cast("string")
    raise RateTableError(f"{key_type!r} is not a key type; expected one of {KEY_TYPES}")


def cell_key(column: str, key_type: str) -> Column:
    """A stored key text in its declared type."""
    value = F.col(column).cast("string")
    if key_type == "bool":
        return F.when(F.lower(value) == "true", True).when(F.lower(value) == "false", False)
    return value.try_cast({"int": "long", "date": "date", "string": "string"}[key_type])


def exposure_weights(portfolio: DataFrame, cells: DataFrame, keys: Mapping[str, tuple[str, str]], exposure: str = "exposure_years") -> tuple[DataFrame, DataFrame]:
    """(exposure per cell that has any, one row of matched and total exposure).

    `keys` maps a cell key to (portfolio column, key type). The portfolio is first summed per key
    combination, so what is joined has the size of the table.
    """
    typed = {k: typed_key(portfolio, c, t).alias(k) for k, (c, t) in keys.items()}
    summed = portfolio.groupBy(*typed.values()).agg(F.sum(F.col(exposure).cast("decimal(38,6)")).alias("exposure_years"))
    side = cells.select(*[cell_key(k, t).alias(k) for k, (_, t) in keys.items()]).distinct().withColumn("__cell", F.lit(1))
    matched = summed.join(side, list(keys), "left")
    weights = matched.where("__cell = 1 and exposure_years <> 0").drop("__cell")
    totals = matched.agg(
        F.coalesce(F.sum(F.when(F.col("__cell") == 1, F.col("exposure_years"))), F.lit(0)).alias("matched_exposure"),
        F.coalesce(F.sum("exposure_years"), F.lit(0)).alias("portfolio_exposure"),
    )
    return weights, totals


# -- bulk operations -------------------------------------------------------------------------


def _selected(filters: Mapping[str, Sequence[str]] | None) -> Column:
    chosen = F.lit(True)
    for key, values in (filters or {}).items():
        chosen = chosen & F.col(key).cast("string").isin([str(v) for v in values])
    return chosen


def uplift(cells: DataFrame, percentage: str, *, filters: Mapping[str, Sequence[str]] | None = None, value: str = "relativity") -> DataFrame:
    """Raise all cells, or those whose keys match exactly, by a percentage (decimal text)."""
    if value == "count":
        raise RateTableError("an uplift does not apply to a count")
    factor = Decimal(1) + finite_decimal(percentage) / 100
    raised = (F.col(value).cast("decimal(19,9)") * F.lit(str(factor)).cast("decimal(12,6)")).cast(VALUE)
    return cells.withColumn(value, F.when(_selected(filters), raised).otherwise(F.col(value).cast(VALUE)))


def floor_and_cap(cells: DataFrame, floor: str, cap: str, value: str = "relativity") -> DataFrame:
    low, high = finite_decimal(floor), finite_decimal(cap)
    if low > high:
        raise RateTableError("the floor is above the cap")
    held = F.greatest(F.least(F.col(value).cast(VALUE), _lit(high)), _lit(low))
    return cells.withColumn(value, F.when(F.col(value).isNotNull(), held))


def rebase(cells: DataFrame, base_level: Mapping[str, Sequence[str]], value: str = "relativity") -> DataFrame:
    """Rescale so that the base level becomes 1. Only a relativity can be rebased."""
    if value != "relativity":
        raise RateTableError("only a relativity can be rebased")
    base = cells.where(_selected(base_level)).select(F.col(value).cast(VALUE).alias("__b")).limit(2).collect()
    if len(base) != 1 or not base[0]["__b"]:
        raise RateTableError("the base level must select one cell with a non-zero value")
    scaled = F.col(value).cast("decimal(19,9)") / F.lit(str(base[0]["__b"])).cast("decimal(19,9)")
    return cells.withColumn(value, scaled.cast(VALUE))


def apply_edits(cells: DataFrame, edits: DataFrame, keys: Sequence[str], value: str = "relativity") -> tuple[DataFrame, DataFrame]:
    """(edited cells, issues): edits replace values by key; an edit that is not a finite number,
    names no cell or shares its key with another edit is an issue and changes nothing."""
    parsed = edits.select(*keys, F.col(value).cast("string").alias("__t"), F.col(value).cast("string").try_cast(VALUE).alias("__v"))
    known = cells.select(*keys).withColumn("__cell", F.lit(1))
    repeated = parsed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    checked = parsed.join(known, list(keys), "left").join(repeated, list(keys), "left")
    issues = checked.select(
        F.when(F.col("__v").isNull(), "non_finite_value").when(F.col("__cell").isNull(), "unknown_key")
        .when(F.col("__n").isNotNull(), "repeated_key").alias("issue"), *keys, F.col("__t").alias("detail")
    ).where("issue is not null")
    good = checked.where("__v is not null and __cell is not null and __n is null").select(*keys, "__v")
    out = cells.join(good, list(keys), "left").withColumn(value, F.coalesce("__v", F.col(value).cast(VALUE))).drop("__v")
    return out, issues


def pair_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tables of two rating versions by slug: (slug, old_version, new_version, change)."""
    both = old.select("slug", F.col("version").alias("old_version")).join(new.select("slug", F.col("version").alias("new_version")), "slug", "full")
    change = (
        F.when(F.col("old_version").isNull(), "added").when(F.col("new_version").isNull(), "removed")
        .when(F.col("old_version") != F.col("new_version"), "changed").otherwise("same")
    )
    return both.withColumn("change", change)


