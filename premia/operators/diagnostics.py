"""Diagnostics of predictions held as columns: `actual`, `predicted` totals and `exposure` per row."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.functions import losses
from premia.functions.hashing import hash_unit
from premia.functions.special import poisson_interval
from premia.operators.ordering import equal_count_bins, linear_quantiles, running_totals

BINS = 10


class DiagnosticsError(ValueError):
    """Models or data that cannot be compared."""


def actual_expected(df: DataFrame, factors: Sequence[str], *, actual: str, predicted: str, exposure: str, confidence: float | None = 0.95) -> DataFrame:
    """A/E overall (factor null) and by level of each factor, with an exact interval on the ratio."""
    entries = [F.struct(F.lit(None).cast("string").alias("factor"), F.lit(None).cast("string").alias("level"))]
    entries += [F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors]
    cells = df.select(F.col(actual).alias("a"), F.col(predicted).alias("p"), F.col(exposure).alias("e"), F.inline(F.array(*entries)))
    out = cells.groupBy("factor", "level").agg(
        F.sum("a").cast("double").alias("actual"), F.sum("p").alias("expected"), F.round(F.sum("e"), 6).alias("exposure_years"), F.count(F.lit(1)).alias("n_rows")
    )
    out = out.withColumn("ratio", F.when(F.col("expected") > 0, F.col("actual") / F.col("expected")))
    if confidence is not None:
        out = out.withColumn("__ci", poisson_interval(confidence)("actual", "expected"))
        out = out.withColumns({"ratio_low": F.col("__ci.low"), "ratio_high": F.col("__ci.high")}).drop("__ci")
    return out


def lift(df: DataFrame, *, actual: str, predicted: str, exposure: str, tie: str, bins: int = BINS) -> DataFrame:
    """Ten equal-count bins by predicted rate: mean actual and predicted per unit of exposure."""
    rated = df.withColumn("__rate", F.col(predicted) / F.col(exposure))
    return bin_means(equal_count_bins(rated, "__rate", tie, bins, "bin"), {"actual": actual, "predicted": predicted}, exposure)


def bin_means(df: DataFrame, measures: Mapping[str, str], exposure: str) -> DataFrame:
    basis = F.when(F.col("e") > 0, F.col("e")).otherwise(F.col("n_rows").cast("double"))
    sums = df.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(exposure).alias("e"), *[F.sum(c).cast("double").alias(n) for n, c in measures.items()]
    )
    return sums.select("bin", "n_rows", F.round("e", 6).alias("exposure_years"), *[(F.col(n) / basis).alias(n) for n in measures])


def calibration(df: DataFrame, *, actual: str, predicted: str, exposure: str, tie: str, bins: int = BINS) -> DataFrame:
    """The lift bins with the ratio of actual to predicted and its gap."""
    return lift(df, actual=actual, predicted=predicted, exposure=exposure, tie=tie, bins=bins).withColumns(
        {"ratio": F.try_divide(F.col("actual"), F.col("predicted")), "gap": F.col("actual") - F.col("predicted")}
    )


def gini(df: DataFrame, *, actual: str, order: str, exposure: str) -> float | None:
    """1 - 2 x the area under the exposure-weighted Lorenz curve, rows in ascending `order`.

    Rows of equal order are one step of the curve.
    """
    usable = df.where(F.col(exposure) > 0)
    steps = running_totals(usable, order, {"y": F.col(actual).cast("double"), "e": F.col(exposure).cast("double")})
    row = steps.agg(F.sum(F.col("e") * (F.col("y_before") + F.col("y") / 2)).alias("area"), F.sum("e").alias("e"), F.sum("y").alias("y")).first()
    if not row["e"] or not row["y"]:
        return None
    return 1 - 2 * row["area"] / (row["e"] * row["y"])


def normalised_gini(df: DataFrame, *, actual: str, predicted: str, exposure: str) -> tuple[float | None, float | None]:
    """(Gini by predicted rate, the same over the Gini of a perfect order)."""
    rated = df.where(F.col(exposure) > 0).withColumns({"__p": F.col(predicted) / F.col(exposure), "__a": F.col(actual) / F.col(exposure)})
    own = gini(rated, actual=actual, order="__p", exposure=exposure)
    best = gini(rated, actual=actual, order="__a", exposure=exposure)
    return own, own / best if own is not None and best else None


def residual_summary(df: DataFrame, *, actual: str, predicted: str) -> DataFrame:
    """Mean, deviation, range and 1 % / 99 % points of the raw residuals."""
    rows = df.withColumn("__r", F.col(actual) - F.col(predicted))
    low, high = linear_quantiles(rows, ["__r"], [0.01, 0.99])["__r"]
    return rows.agg(
        F.avg("__r").alias("mean"), F.coalesce(F.stddev_samp("__r"), F.lit(0.0)).alias("std"), F.min("__r").alias("minimum"), F.max("__r").alias("maximum"),
    ).withColumns({"p01": F.lit(low), "p99": F.lit(high)})


def complexity(df: DataFrame, parameters: int, *, exposure: str = "exposure_years", claims: str = "claim_count") -> DataFrame:
    row = df.agg(F.round(F.sum(exposure), 6).alias("exposure_years"), F.sum(claims).alias("claim_count"))
    return row.select(F.lit(parameters).alias("parameters"), (F.col("exposure_years") / parameters).alias("exposure_per_parameter"), (F.col("claim_count") / parameters).alias("claims_per_parameter"))


def monotonicity(df: DataFrame, *, group: Sequence[str], order: str, value: str, increasing: bool = True) -> DataFrame:
    """Per group of fitted levels: steps against the declared direction and the worst one."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(order))
    step = (F.col(value) - before) if increasing else (before - F.col(value))
    return df.withColumn("__s", step).groupBy(*group).agg(
        F.count(F.when(F.col("__s") < 0, 1)).alias("violations"), F.coalesce(F.max(F.when(F.col("__s") < 0, -F.col("__s"))), F.lit(0.0)).alias("worst")
    )


def partial_dependence(df: DataFrame, model, factor: str, exposure: str = "exposure_years") -> DataFrame:
    """Mean prediction with the factor set to each level, and each level's exposure share.

    With a log link, changing a level scales a row's mean by the ratio of two relativities, so the rows reduce to one sum.
    Other links need the mean of the inverse link per level: one aggregate with a column a level. Rows are never crossed
    with levels.
    """
    from premia.operators.glm import level_text

    scored = model.linear_predictor(df, "__eta", with_offset=False).where("__eta is not null")
    beta = [(level, model.coefficient(factor, level)) for level in model.levels[factor]]
    scored, own = model._term(scored, factor)
    rest = F.col("__eta") - own
    if model.spec.link == "log":
        base = scored.agg(F.avg(F.exp(rest)).alias("bare"), F.sum(exposure).alias("e")).first()
        means = [(level, math.exp(b) * base["bare"]) for level, b in beta]
    else:
        base = scored.agg(
            F.sum(exposure).alias("e"), *[F.avg(losses.inverse_link(rest + F.lit(b), model.spec.link)).alias(f"m{i}") for i, (_, b) in enumerate(beta)]
        ).first()
        means = [(level, base[f"m{i}"]) for i, (level, _) in enumerate(beta)]
    shares = scored.groupBy(level_text(factor).alias("level")).agg(F.sum(exposure).alias("x"))
    effect = df.sparkSession.createDataFrame(means, "level string, mean_prediction double")
    return effect.join(shares, "level", "left").select(
        F.lit(factor).alias("factor"), "level", "mean_prediction", (F.coalesce("x", F.lit(0.0)) / base["e"]).alias("exposure_share")
    )


def permuted(df: DataFrame, column: str, key: str, seed: int, rows_per_block: int = 10_000) -> DataFrame:
    """`df` with one column's values moved between rows by a seeded permutation.

    Rows are dealt into random blocks by a hash of their key and each block is rotated in the order
    of another hash, so no task holds more than a block.
    """
    n = df.count()
    blocks = max(1, n // rows_per_block)
    w = Window.partitionBy("__block").orderBy("__h", key)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = df.withColumns({"__block": F.floor(hash_unit(key, seed) * blocks), "__h": hash_unit(key, seed + 1)})
    moved = F.coalesce(F.lead(F.struct(F.col(column).alias("v"))).over(w), F.first(F.struct(F.col(column).alias("v"))).over(full))
    return dealt.withColumn(column, moved["v"]).drop("__block", "__h")


def permutation_importance(
    df: DataFrame, columns: Sequence[str], score: Callable[[DataFrame], DataFrame], metric: Column, *, key: str, seed: int, repeats: int = 1
) -> DataFrame:
    """Mean rise of a loss when one column is shuffled: (feature, importance)."""
    base = score(df).agg(metric.alias("m")).first()["m"]
    rows = []
    for i, c in enumerate(columns):
        rises = [score(permuted(df, c, key, seed + 1000 * r + 10 * i)).agg(metric.alias("m")).first()["m"] - base for r in range(repeats)]
        rows.append((c, sum(rises) / len(rises)))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def quantile_crossing(df: DataFrame, low: str, high: str) -> DataFrame:
    """Rows checked, rows where the lower quantile is above the upper one, and the worst gap."""
    gap = F.col(low) - F.col(high)
    return df.agg(
        F.count(F.when(gap.isNotNull(), 1)).alias("rows_checked"), F.count(F.when(gap > 0, 1)).alias("rows_crossing"), F.coalesce(F.max(F.when(gap > 0, gap)), F.lit(0.0)).alias("worst_gap")
    )


# -- comparing models ------------------------------------------------------------------------

#: Which way each comparison metric is better (fixed values).
DIRECTIONS = {"ae_overall": "closer_to_one", "gini": "higher", "gini_normalised": "higher", "holdout_deviance": "lower", "rows": "none"}


def leader(values: Mapping[str, float | None], direction: str) -> str | None:
    """The best model, or None for a tie, no values, or a metric without an order."""
    known = {k: v for k, v in values.items() if v is not None}
    if direction == "none" or not known:
        return None
    rank = {"higher": lambda v: -v, "lower": lambda v: v, "closer_to_one": lambda v: abs(v - 1)}[direction]
    best = min(rank(v) for v in known.values())
    winners = [k for k, v in known.items() if rank(v) == best]
    return winners[0] if len(winners) == 1 else None


def compare_models(
    df: DataFrame, predictions: Mapping[str, str], *, actual: str, exposure: str, family: str = "poisson", power: float = 1.5, theta: float = 1.0
) -> DataFrame:
    """All metrics of several models on one holdout: (metric, model, value, leader).

    Rows that any model cannot price (null prediction) are out of every model's metrics.
    """
    if len(predictions) < 2:
        raise DiagnosticsError("a comparison needs at least two models")
    shared = df
    for c in predictions.values():
        shared = shared.where(F.col(c).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(actual).cast("double").alias("a")]
    for i, c in enumerate(predictions.values()):
        aggs += [F.sum(c).alias(f"p{i}"), F.sum(losses.unit_deviance(actual, c, family, power=power, theta=theta)).alias(f"d{i}")]
    row = shared.agg(*aggs).first()
    if not row["n"]:
        raise DiagnosticsError("no row can be priced by every model")
    table: dict[str, dict[str, float | None]] = {m: {} for m in DIRECTIONS}
    for i, (name, c) in enumerate(predictions.items()):
        own, normal = normalised_gini(shared, actual=actual, predicted=c, exposure=exposure)
        table["ae_overall"][name] = row["a"] / row[f"p{i}"] if row[f"p{i}"] > 0 else None
        table["gini"][name], table["gini_normalised"][name] = own, normal
        table["holdout_deviance"][name] = row[f"d{i}"]
        table["rows"][name] = float(row["n"])
    rows = [(m, name, v, leader(values, DIRECTIONS[m])) for m, values in table.items() for name, v in values.items()]
    return df.sparkSession.createDataFrame(rows, "metric string, model string, value double, leader string")


def double_lift(df: DataFrame, *, actual: str, baseline: str, challenger: str, exposure: str, tie: str, bins: int = BINS) -> DataFrame:
    """Bins by the ratio of challenger to baseline: which model do the disagreements support?"""
    ratio = F.when(F.col(baseline) > 0, F.col(challenger) / F.col(baseline)).otherwise(0.0)
    binned = equal_count_bins(df.withColumn("__ratio", ratio), "__ratio", tie, bins, "bin")
    return bin_means(binned, {"actual": actual, "baseline_predicted": baseline, "challenger_predicted": challenger}, exposure)


def relativity_differences(relativities: DataFrame, models: Sequence[str]) -> DataFrame:
    """(factor, level, one column per model, max_abs_difference); a level a model lacks is null.

    `relativities` has columns model, factor, level, relativity.
    """
    wide = relativities.groupBy("factor", "level").pivot("model", list(models)).agg(F.first("relativity"))
    present = F.array_compact(F.array(*[F.col(f"`{m}`") for m in models]))
    gap = F.when(F.size(present) >= 2, F.array_max(present) - F.array_min(present))
    return wide.withColumn("max_abs_difference", gap)


def backtest(df: DataFrame, model, *, actual: str, exposure: str, factors: Sequence[str], trained_on: str, version: str, tie: str) -> dict[str, DataFrame]:
    """The diagnostics of a fitted model on a later version of the data."""
    if version == trained_on:
        raise DiagnosticsError("a backtest needs data the model was not trained on")
    missing = [c for c in [actual, exposure, *model.spec.factors, *model.spec.numerics] if c not in df.columns]
    if missing:
        raise DiagnosticsError(f"column(s) {missing} are absent from the later version")
    scored = model.predict(df, "__expected").where("__expected is not null")
    return {
        "actual_expected": actual_expected(scored, factors, actual=actual, predicted="__expected", exposure=exposure),
        "lift": lift(scored, actual=actual, predicted="__expected", exposure=exposure, tie=tie),
        "residuals": residual_summary(scored, actual=actual, predicted="__expected"),
    }


def worst_regions(df: DataFrame, factors: Sequence[str], *, target: str, approximation: str, exposure: str, k: int = 10) -> DataFrame:
    """Levels where an approximation misses a model most: (factor, level, exposure_share, mean_abs_pct_error)."""
    miss = F.abs(F.col(approximation) - F.col(target)) / F.abs(F.col(target)) * 100
    entries = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors])
    rows = df.where(F.col(target) != 0).select(F.col(exposure).alias("e"), miss.alias("m"), F.inline(entries))
    levels = rows.groupBy("factor", "level").agg(F.sum("e").alias("e"), F.avg("m").alias("mean_abs_pct_error"))
    total = levels.groupBy("factor").agg(F.sum("e").alias("t"))
    return levels.join(total, "factor").select("factor", "level", (F.col("e") / F.col("t")).alias("exposure_share"), "mean_abs_pct_error").orderBy(F.col("mean_abs_pct_error").desc(), "factor", "level").limit(k)


def contributions(df: DataFrame, model) -> DataFrame:
    """Mean absolute contribution of each term to the linear predictor, around its mean."""
    terms = []
    rows = df
    for f in model.spec.factors:
        rows, term = model._term(rows, f)
        rows = rows.withColumn(f"__t_{f}", term)
        terms.append(f)
    for n in model.spec.numerics:
        rows = rows.withColumn(f"__t_{n}", F.lit(model.coefficient(n)) * F.col(n))
        terms.append(n)
    means = rows.agg(*[F.avg(f"__t_{t}").alias(t) for t in terms]).first()
    row = rows.agg(*[F.avg(F.abs(F.col(f"__t_{t}") - means[t])).alias(t) for t in terms])
    return row.select(F.inline(F.array(*[F.struct(F.lit(t).alias("factor"), F.col(t).alias("mean_abs_contribution")) for t in terms])))


def surrogate_quality(df: DataFrame, *, target: str, approximation: str) -> dict[str, float]:
    """R-squared and share of Gamma deviance a surrogate explains of another model's predictions."""
    mean = df.agg(F.avg(target).alias("m")).first()["m"]
    t, a = F.col(target), F.col(approximation)
    row = df.agg(
        F.sum((t - a) * (t - a)).alias("sse"), F.sum((t - mean) * (t - mean)).alias("sst"),
        F.sum(losses.unit_deviance(t, a, "gamma")).alias("d"), F.sum(losses.unit_deviance(t, F.lit(mean), "gamma")).alias("d0"),
    ).first()
    return {"r_squared": 1 - row["sse"] / row["sst"], "deviance_explained": 1 - row["d"] / row["d0"]}


def fit_surrogate(df: DataFrame, target: str, factors: Sequence[str], numerics: Sequence[str] = ()):
    """A Gamma log-link GLM of another model's positive predictions."""
    from premia.operators.glm import Spec, fit_glm

    if df.where((F.col(target) <= 0) | F.col(target).isNull()).limit(1).count():
        raise DiagnosticsError("a surrogate needs positive predictions")
    return fit_glm(df, Spec(target, "gamma", tuple(factors), tuple(numerics)))
