"""The effect of a rate change on a portfolio, policy by policy and in total."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.functions.scalar import ceiling_change_pct
from premia.operators.ordering import nearest_rank_quantiles
from premia.operators.rating import Algorithm, score

#: Quantiles of the absolute change (fixed values).
QUANTILE_KEYS = ("0.5", "0.9", "0.95", "0.99", "0.999", "1")
MAX_GROUPS = 6


class DislocationError(ValueError):
    """A comparison that cannot be made as asked."""


def dislocation_frame(df: DataFrame, baseline: Algorithm, candidate: Algorithm, *, quote: str = "quote_id", keep: Sequence[str] = ()) -> DataFrame:
    """Per quote: both outcomes, both premiums, the change, error codes and ladders.

    Both versions are column sets of one scan. Quote ids must be unique and not null.
    """
    bad = df.groupBy(quote).count().where(F.col(quote).isNull() | (F.col("count") > 1)).limit(1).count()
    if bad:
        raise DislocationError(f"{quote!r} must be unique and not null")
    both = score(score(df, baseline, "a__"), candidate, "b__")
    change = F.col("b__premium_minor") - F.col("a__premium_minor")
    return both.select(
        quote,
        *keep,
        F.col("a__outcome").alias("baseline_outcome"),
        F.col("b__outcome").alias("candidate_outcome"),
        F.col("a__premium_minor").alias("baseline_minor"),
        F.col("b__premium_minor").alias("candidate_minor"),
        change.alias("change_minor"),
        F.when(F.col("a__premium_minor") != 0, change / F.col("a__premium_minor") * 100).alias("change_pct"),
        F.coalesce(F.get("a__error_codes", F.lit(0)), F.get("b__error_codes", F.lit(0))).alias("error_code"),
        F.col("a__ladder").alias("baseline_ladder"),
        F.col("b__ladder").alias("candidate_ladder"),
    )


def _pair() -> Column:
    a, b = F.col("baseline_outcome"), F.col("candidate_outcome")
    return (
        F.when((a == "error") | (b == "error"), "error")
        .when((a == "quoted") & (b == "quoted"), "quoted_both")
        .when((a == "quoted") & (b == "declined"), "quoted_to_declined")
        .when((a == "declined") & (b == "quoted"), "declined_to_quoted")
        .otherwise("declined_both")
    )


def banded(frame: DataFrame) -> DataFrame:
    """Quotes priced by both versions on a positive baseline."""
    return frame.where((_pair() == "quoted_both") & (F.col("baseline_minor") > 0))


def outcomes(frame: DataFrame) -> DataFrame:
    """Counts of the five exclusive outcome pairs, and of zero and negative baselines."""
    pair = _pair()
    both = pair == "quoted_both"
    names = ("quoted_both", "quoted_to_declined", "declined_to_quoted", "declined_both", "error")
    return frame.agg(
        F.count(F.lit(1)).alias("policy_count"),
        *[F.count(F.when(pair == n, 1)).alias(n) for n in names],
        F.count(F.when(both & (F.col("baseline_minor") == 0), 1)).alias("zero_baseline"),
        F.count(F.when(both & (F.col("baseline_minor") < 0), 1)).alias("negative_baseline"),
    )


def totals(frame: DataFrame) -> DataFrame:
    """Both premium totals over quotes priced twice, and the change in percent."""
    sums = frame.where(_pair() == "quoted_both").agg(
        F.coalesce(F.sum("baseline_minor"), F.lit(0)).alias("baseline_premium_minor"),
        F.coalesce(F.sum("candidate_minor"), F.lit(0)).alias("candidate_premium_minor"),
    )
    a, b = F.col("baseline_premium_minor"), F.col("candidate_premium_minor")
    return sums.withColumn("change_pct", F.when(a != 0, (b - a) / a * 100))


def band_names(edges: Sequence[str]) -> list[str]:
    return [f"below {edges[0]}", *[f"{a} to {b}" for a, b in zip(edges, edges[1:])], f"{edges[-1]} and above"]


def change_bands(frame: DataFrame, edges: Sequence[str], exposure: str | None = None) -> DataFrame:
    """Quotes by size of change: (position, band, policies, exposure_share, mean_change_pct).

    A band holds its lower edge. Shares are of the banded set's exposure.
    """
    numbers = [float(e) for e in edges]
    if any(b <= a for a, b in zip(numbers, numbers[1:])):
        raise DislocationError("band edges must increase")
    position = F.lit(0)
    for i, e in enumerate(edges, start=1):
        # change * 100 >= edge * baseline, without a division
        above = F.col("change_minor") * F.lit(100).cast("decimal(3,0)") >= F.lit(e).cast("decimal(12,4)") * F.col("baseline_minor")
        position = F.when(above, F.lit(i)).otherwise(position)
    weight = F.sum(F.col(exposure).cast("decimal(38,6)")) if exposure else F.lit(None).cast("decimal(38,6)")
    grouped = banded(frame).groupBy(position.alias("position")).agg(
        F.count(F.lit(1)).alias("policies"), weight.alias("__e"), F.avg("change_pct").alias("mean_change_pct")
    )
    names = F.create_map(*[F.lit(x) for i, n in enumerate(band_names(edges)) for x in (i, n)])
    whole = Window.partitionBy(F.lit(1))  # over one row per band
    return grouped.withColumn("__t", F.sum("__e").over(whole)).select(
        "position", names[F.col("position")].alias("band"), "policies",
        F.try_divide(F.col("__e").cast("double"), F.col("__t").cast("double")).alias("exposure_share"), "mean_change_pct",
    )


def segment_slices(frame: DataFrame, segments: Sequence[str], exposure: str | None = None) -> DataFrame:
    """All segments in one pass: (factor, level, policies, mean_change_pct, exposure_share); null is a level."""
    entries = F.array(*[F.struct(F.lit(s).alias("factor"), F.col(s).cast("string").alias("level")) for s in segments])
    weight = F.col(exposure).cast("decimal(38,6)") if exposure else F.lit(None).cast("decimal(38,6)")
    melted = banded(frame).select("change_pct", weight.alias("__e"), F.inline(entries))
    grouped = melted.groupBy("factor", "level").agg(
        F.count(F.lit(1)).alias("policies"), F.avg("change_pct").alias("mean_change_pct"), F.sum("__e").alias("__e")
    )
    total = grouped.groupBy("factor").agg(F.sum("__e").alias("__t"))
    return grouped.join(total, "factor").select(
        "factor", "level", "policies", "mean_change_pct", F.try_divide(F.col("__e").cast("double"), F.col("__t").cast("double")).alias("exposure_share")
    )


def rung_contributions(frame: DataFrame) -> DataFrame:
    """How much of the total change arose at each rung, in percent of the total change."""
    def exploded(column: str, sign: int) -> DataFrame:
        return banded(frame).select(F.inline(column)).select("rung", (F.col("contribution") * sign).cast("decimal(38,8)").alias("x"))

    parts = exploded("candidate_ladder", 1).unionAll(exploded("baseline_ladder", -1)).groupBy("rung").agg(F.sum("x").alias("x"))
    whole = Window.partitionBy(F.lit(1))  # over one row per rung
    return parts.withColumn("t", F.sum("x").over(whole)).select(
        "rung", F.col("x").cast("double").alias("change"), F.when(F.col("t") != 0, F.col("x").cast("double") / F.col("t").cast("double") * 100).alias("contribution_pct")
    )


def abs_change_quantiles(frame: DataFrame) -> dict[str, str | None]:
    """Nearest-rank quantiles of |change| in percent, rounded up at six places; exact, as text.

    Rounding up keeps order, so the quantile of the rounded values is the rounded quantile.
    """
    text = banded(frame).select(ceiling_change_pct("change_minor", "baseline_minor").cast("decimal(28,6)").alias("x"))
    text = text.persist()  # one column, kept so that the portfolio is rated once
    found = nearest_rank_quantiles(text, "x", QUANTILE_KEYS)
    text.unpersist()
    return {k: None if v is None else f"{v:.6f}" for k, v in found.items()}


def movers(frame: DataFrame, threshold_pct: str, *, quote: str = "quote_id") -> DataFrame:
    """Banded quotes that moved by at least a threshold, without any portfolio column.

    Order by |change| descending, then by quote id.
    """
    moved = F.abs("change_minor") * F.lit(100).cast("decimal(3,0)") >= F.lit(threshold_pct).cast("decimal(12,4)") * F.col("baseline_minor")
    return banded(frame).where(moved).select(quote, "baseline_minor", "candidate_minor", "change_minor", "change_pct")


def movers_with_portfolio(moved: DataFrame, portfolio: DataFrame, quote: str = "quote_id") -> DataFrame:
    return moved.join(portfolio, quote, "left")


def check_groups(groups: Mapping[str, Sequence[str]], changes: Sequence[str]) -> dict[str, list[str]]:
    """Changes left out, placed twice, or unknown; all empty when the groups partition them."""
    placed = [c for members in groups.values() for c in members]
    return {
        "left_out": sorted(set(changes) - set(placed)),
        "placed_twice": sorted({c for c in placed if placed.count(c) > 1}),
        "unknown": sorted(set(placed) - set(changes)),
    }


def attribute_change(
    df: DataFrame,
    groups: Mapping[str, Mapping[str, tuple[str, str]]],
    premium: Callable[[Mapping[str, Column]], Column],
) -> dict:
    """Shapley parts of the total change over up to six groups of changed inputs.

    A group maps each changed name to its (old column, new column). The portfolio is rated once
    for every subset of groups, as columns of one projection, and reduced to one total each; the
    shares follow from those totals.
    """
    names = list(groups)
    if len(names) > MAX_GROUPS:
        raise DislocationError(f"at most {MAX_GROUPS} change groups can be attributed")
    subsets = [frozenset(c) for n in range(len(names) + 1) for c in itertools.combinations(names, n)]

    def rated(subset: frozenset) -> Column:
        chosen = {what: F.col(new if g in subset else old) for g in names for what, (old, new) in groups[g].items()}
        return premium(chosen)

    row = df.agg(*[F.coalesce(F.sum(rated(s)), F.lit(0)).alias(f"s{i}") for i, s in enumerate(subsets)]).first()
    value = {s: int(row[f"s{i}"]) for i, s in enumerate(subsets)}
    empty, everything = frozenset(), frozenset(names)
    total = value[everything] - value[empty]
    items, upto, k = [], empty, len(names)
    for g in names:
        others = [s for s in subsets if g not in s]
        part = sum(
            math.factorial(len(s)) * math.factorial(k - len(s) - 1) * (value[s | {g}] - value[s]) for s in others
        ) / math.factorial(k)
        items.append(
            {
                "group": g,
                "shapley_minor": round(part),
                "isolated_minor": value[frozenset([g])] - value[empty],
                "cumulative_minor": value[upto | {g}] - value[upto],
            }
        )
        upto = upto | {g}
    return {"total_change_minor": total, "residual_minor": total - sum(i["shapley_minor"] for i in items), "subsets": len(subsets), "items": items}
