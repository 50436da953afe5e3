"""Reference tables with half-open validity `[effective_from, effective_to)`; an open end is null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from premia.operators.ordering import running_totals
from premia.session import BROADCAST_ROWS

FAR = "9999-12-31"


class ReferenceError(LookupError):
    """Rows of one key overlap, so a lookup would depend on row order."""


def overlaps(
    df: DataFrame, keys: Sequence[str], start: str = "effective_from", end: str = "effective_to"
) -> DataFrame:
    """Per key and start: rows that begin before an earlier row of the key has ended.

    The latest end so far is a running maximum, so intervals are never paired with each other.
    An interval that holds no date (its end is not after its start) overlaps nothing.
    """
    closed = F.coalesce(F.col(end).cast("date"), F.lit(FAR).cast("date"))
    usable = df.where(F.col(start) < closed)
    steps = running_totals(usable, start, {"n": F.lit(1)}, within=list(keys), maxima={"latest": closed})
    inside = F.coalesce(F.col("latest_before") > F.col(start), F.lit(False))
    return steps.select(
        *keys, start, F.when(inside, F.col("n")).otherwise(F.col("n") - 1).alias("overlapping_rows")
    ).where("overlapping_rows > 0")


def _counted_overlaps(df: DataFrame, keys: Sequence[str], start: str, end: str) -> tuple[int, list]:
    """(rows, a few overlapping keys) by the rule of `overlaps`. A table counted to be small is checked in the same job."""
    closed = F.coalesce(F.col(end).cast("date"), F.lit(FAR).cast("date"))
    head = df.select(*keys, start, closed.alias("__end")).limit(BROADCAST_ROWS + 1)
    before = Window.partitionBy(*keys).orderBy(start, "__end").rowsBetween(Window.unboundedPreceding, -1)
    usable = F.col(start) < F.col("__end")
    inside = usable & F.coalesce(F.max(F.when(usable, F.col("__end"))).over(before) > F.col(start), F.lit(False))
    row = head.withColumn("__in", inside).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("__in"), F.struct(*keys))).alias("bad")
    ).first()
    if row["n"] <= BROADCAST_ROWS:
        return row["n"], [row["bad"]] if row["bad"] is not None else []
    return row["n"], overlaps(df, keys, start, end).limit(5).collect()


def refuse_overlaps(df: DataFrame, keys: Sequence[str], start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    checked_side(df, keys, start, end)
    return df


def checked_side(df: DataFrame, keys: Sequence[str], start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """`df` with a broadcast hint if it is small, after refusing overlapping rows of one key."""
    n, bad = _counted_overlaps(df, keys, start, end)
    if bad:
        raise ReferenceError(f"validity intervals overlap, for example {[tuple(r[k] for k in keys) for r in bad]}")
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def lookup_as_at(
    df: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    as_at: str,
    *,
    start: str = "effective_from",
    end: str = "effective_to",
    checked: bool = False,
) -> DataFrame:
    """`df` plus the columns of the row in force for its key at its `as_at` date, or nulls.

    An equality join on the key with the date range as a residual condition. Overlapping rows are
    refused before the join, so each input row has at most one match.
    """
    side = (rows if checked else checked_side(rows, keys, start, end)).withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = (F.col(start) <= F.col(as_at)) & (F.col(end).isNull() | (F.col(as_at) < F.col(end)))
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"__{k}"))
    return df.join(side, condition, "left").drop(*[f"__{k}" for k in keys])


def resolve_all(
    keys: DataFrame, rows: DataFrame, key: str, as_at: str, *, start: str = "effective_from", end: str = "effective_to"
) -> tuple[DataFrame, DataFrame]:
    """(resolved keys with their row, keys without one)."""
    found = lookup_as_at(keys, rows, [key], as_at, start=start, end=end)
    return found.where(F.col(start).isNotNull()), found.where(F.col(start).isNull()).select(*keys.columns)


def in_force(rows: DataFrame, day: str, keys: Sequence[str], start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """The rows in force on a date."""
    at = F.lit(day).cast("date")
    return rows.where((F.col(start) <= at) & (F.col(end).isNull() | (at < F.col(end))))


def version_stats(rows: DataFrame, start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Rows and covered period; the period has no end if any row has none."""
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(start).alias("covers_from"),
        F.when(~F.coalesce(F.bool_or(F.col(end).isNull()), F.lit(False)), F.max(end)).alias("covers_to"),
    )


def route_by_date(df: DataFrame, versions: DataFrame, as_at: str, start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """`df` plus the version whose period holds its date. Versions must not overlap; their table is
    broadcast after its size has been counted."""
    side = checked_side(versions.withColumn("__all", F.lit(1)), ["__all"], start, end).drop("__all")
    condition = (F.col(start) <= F.col(as_at)) & (F.col(end).isNull() | (F.col(as_at) < F.col(end)))
    return df.join(side, condition, "left")


def load_version(rows: DataFrame, keys: Sequence[str], path: str) -> str:
    """Write a whole reference version at once, refusing overlapping validity."""
    from premia.sources.sinks import write_table

    return write_table(refuse_overlaps(rows, keys), path)
