"""Monitoring kernels. The batch functions here are what the streams in `premia.streaming` call."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.functions.special import poisson_interval
from premia.operators.ingest import level_counts
from premia.operators.ordering import running_totals
from premia.operators.profile import psi, psi_by

PSI_WARN, PSI_BREACH = 0.10, 0.25


def status(value: Column, warn: float, breach: float) -> Column:
    return F.when(value > breach, "breach").when(value > warn, "warn").when(value.isNotNull(), "ok")


def period_levels(df: DataFrame, period: Column, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """(period, column, level, n, weight) of several columns in one shuffle."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.select(period.alias("period"), w.alias("__w"), F.inline(entries)).groupBy("period", "column", "level").agg(
        F.count(F.lit(1)).alias("n"), F.sum("__w").alias("weight")
    )


def drift(current: DataFrame, baseline: DataFrame, weight: str = "n") -> DataFrame:
    """PSI of every (period, column) of period levels against a baseline's (column, level) levels."""
    periods = current.select("period", "column").distinct()
    return psi(current, periods.join(baseline, "column"), keys=["period", "column"], weight=weight)


def drift_against_prior(levels: DataFrame, following: Column, weight: str = "n") -> DataFrame:
    """PSI of every period against the one before; `following` maps a period to the next one."""
    return psi(levels, levels.withColumn("period", following), keys=["period", "column"], weight=weight).where("psi is not null")


def input_drift(df: DataFrame, period: Column, columns: Sequence[str], baseline: DataFrame, weight: str) -> DataFrame:
    """Count- and weight-based PSI per period and factor, with the status of the worse one."""
    now = period_levels(df, period, columns, weight)
    before = level_counts(baseline, columns, weight)
    expected = now.select("period", "column").distinct().join(before, "column")
    both = psi_by(now, expected, ["period", "column"], {"psi_count": "n", "psi_weight": "weight"})
    return both.withColumn("status", status(F.greatest("psi_count", "psi_weight"), PSI_WARN, PSI_BREACH))


def drift_with_importance(drifted: DataFrame, importance: DataFrame) -> DataFrame:
    """Drift ordered by importance times PSI, so that a shift in a strong factor comes first."""
    return drifted.join(importance, "column").withColumn("priority", F.col("psi_count") * F.col("importance"))


def cohort_ae(
    df: DataFrame, cohort: Column, by: Sequence[str], *, actual: str, expected: str, exposure: str, mature_before: str, confidence: float = 0.95
) -> DataFrame:
    """A/E by cohort and segment with an exact interval; only mature cohorts are judged."""
    cells = df.groupBy(cohort.alias("cohort"), *by).agg(
        F.sum(actual).cast("double").alias("actual"), F.sum(expected).alias("expected"), F.round(F.sum(exposure), 6).alias("exposure_years")
    )
    out = cells.withColumn("ratio", F.when(F.col("expected") > 0, F.col("actual") / F.col("expected")))
    out = out.withColumn("__ci", poisson_interval(confidence)("actual", "expected"))
    mature = F.col("cohort") < F.lit(mature_before)
    outside = (F.col("__ci.low") > 1) | (F.col("__ci.high") < 1)
    return out.select(
        "*", F.col("__ci.low").alias("low"), F.col("__ci.high").alias("high"), mature.alias("mature"),
        F.when(mature, F.when(outside, "breach").otherwise("ok")).alias("status"),
    ).drop("__ci")


def gini_by_cohort(df: DataFrame, cohort: Column, *, actual: str, order: str, exposure: str, fitted: float, mature_before: str) -> DataFrame:
    """Gini of every mature cohort and its change since the fit."""
    rows = df.withColumn("cohort", cohort).where((F.col("cohort") < F.lit(mature_before)) & (F.col(exposure) > 0))
    steps = running_totals(rows, order, {"y": F.col(actual).cast("double"), "e": F.col(exposure).cast("double")}, within=["cohort"])
    sums = steps.groupBy("cohort").agg(
        F.sum(F.col("e") * (F.col("y_before") + F.col("y") / 2)).alias("a"), F.sum("e").alias("e"), F.sum("y").alias("y")
    )
    gini = 1 - 2 * F.col("a") / (F.col("e") * F.col("y"))
    return sums.select("cohort", gini.alias("gini"), (gini - F.lit(float(fitted))).alias("change"))


def conversion(quotes: DataFrame, outcomes: DataFrame, by: Sequence[str], *, quote: str = "quote_id", expected: str = "expected") -> DataFrame:
    """Realised against expected conversion by segment; a quote converts once however often its
    outcome arrives."""
    won = outcomes.select(quote).distinct().withColumn("__won", F.lit(1))
    joined = quotes.join(won, quote, "left")
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("quotes"), F.count("__won").alias("converted"), F.avg(expected).alias("expected_rate")
    ).withColumn("realised_rate", F.col("converted") / F.col("quotes")).withColumn("gap", F.col("realised_rate") - F.col("expected_rate"))


def rate_achieved(intended: DataFrame, achieved: DataFrame, segment: str) -> DataFrame:
    """One row: intended and achieved mean change, and the gap split into pure rate and mix.

    Both tables have one row per segment with `premium` (weight) and `change_pct`. A segment absent
    from a side has no weight there and takes the other side's change.
    """
    a = intended.select(segment, F.col("premium").cast("double").alias("p0"), F.col("change_pct").alias("r0"))
    b = achieved.select(segment, F.col("premium").cast("double").alias("p1"), F.col("change_pct").alias("r1"))
    whole = Window.partitionBy(F.lit(1))  # over one row per segment
    both = a.join(b, segment, "full").select(
        F.coalesce("p0", F.lit(0.0)).alias("p0"), F.coalesce("p1", F.lit(0.0)).alias("p1"), F.coalesce("r0", "r1").alias("r0"), F.coalesce("r1", "r0").alias("r1")
    )
    shares = both.select("r0", "r1", (F.col("p0") / F.sum("p0").over(whole)).alias("w0"), (F.col("p1") / F.sum("p1").over(whole)).alias("w1"))
    return shares.agg(
        F.sum(F.col("w0") * F.col("r0")).alias("rate_intended_pct"), F.sum(F.col("w1") * F.col("r1")).alias("rate_achieved_pct"),
        F.sum(F.col("w0") * (F.col("r1") - F.col("r0"))).alias("pure_rate_pct"), F.sum((F.col("w1") - F.col("w0")) * F.col("r1")).alias("mix_pct"),
    ).withColumn("gap_pct", F.col("rate_achieved_pct") - F.col("rate_intended_pct"))


def premium_by_period(df: DataFrame, period: Column, by: Sequence[str], premium: str = "premium_minor") -> DataFrame:
    """Policies, premium, mean premium and mix per period and segment."""
    cells = df.groupBy(period.alias("period"), *by).agg(F.count(F.lit(1)).alias("policies"), F.sum(premium).alias("premium"), F.avg(premium).alias("mean_premium"))
    return cells.withColumn("mix", F.col("policies") / F.sum("policies").over(Window.partitionBy("period")))


def loss_ratio(written: DataFrame, earned: DataFrame, claims: DataFrame, development: Mapping[str, float], cohort: str = "cohort") -> DataFrame:
    """Loss ratio per cohort on both bases, with the development factor applied and shown.

    A cohort without a factor is fully developed.
    """
    factors = F.create_map(*[F.lit(x) for kv in development.items() for x in kv]) if development else None
    factor = F.coalesce(F.try_element_at(factors, F.col(cohort).cast("string")), F.lit(1.0)) if development else F.lit(1.0)
    joined = written.join(earned, cohort, "left").join(claims, cohort, "left").withColumn("development_factor", factor)
    cost = F.coalesce(F.col("claim_amount"), F.lit(0)) * F.col("development_factor")
    return joined.withColumns(
        {
            "mature": F.col("development_factor") == 1.0,
            "written_loss_ratio": F.try_divide(cost.cast("double"), F.col("written_premium").cast("double")),
            "earned_loss_ratio": F.try_divide(cost.cast("double"), F.col("earned_premium").cast("double")),
        }
    )


def activation_rates(scored: DataFrame, period: Column, reasons: str = "reasons") -> DataFrame:
    """Share of quotes per period on which each constraint fired."""
    totals = scored.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("quotes"))
    fired = scored.select(period.alias("period"), F.explode(F.array_distinct(F.col(reasons))).alias("reason")).groupBy("period", "reason").agg(F.count(F.lit(1)).alias("n"))
    return fired.join(totals, "period").withColumn("rate", F.col("n") / F.col("quotes"))


def ranked_value(column: str, percent: int) -> Column:
    """The smallest value that at least `percent` of the values do not exceed."""
    return F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY `{column}`)")


def operational(df: DataFrame, period: Column, by: Sequence[str], *, latency: str, outcome: str) -> DataFrame:
    """Throughput, error and decline rates and exact latency percentiles per period and version.

    A percentile keeps a count per distinct latency of a cell, so latencies are best given in whole milliseconds.
    """
    return df.groupBy(period.alias("period"), *by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg((F.col(outcome) == "error").cast("double")).alias("error_rate"),
        F.avg((F.col(outcome) == "declined").cast("double")).alias("decline_rate"),
        *[ranked_value(latency, p).alias(f"p{p}") for p in (50, 95, 99)],
    )


def miss_rates(scored: DataFrame, period: Column, codes: str = "error_codes") -> DataFrame:
    """Share of quotes per period with a lookup or table miss, by what was missed."""
    missed = F.filter(F.col(codes), lambda c: c.startswith("lookup_miss:") | c.startswith("table_miss:"))
    return activation_rates(scored.withColumn("__m", missed), period, "__m")


def replica_divergence(df: DataFrame, period: Column, bundle: str, by: Sequence[str]) -> DataFrame:
    """More than one bundle hash serving in a period is a breach."""
    return df.groupBy(period.alias("period"), *by).agg(F.count_distinct(bundle).alias("bundles")).withColumn(
        "status", F.when(F.col("bundles") > 1, "breach").otherwise("ok")
    )


def consecutive(df: DataFrame, keys: Sequence[str], order: str, needed: int, state: str = "status") -> DataFrame:
    """`df` plus `run` (breaches in a row up to this period) and `alert` (the run reached `needed`).

    A series has one row per period, so a window over a series is short.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    hit = F.col(state) == "breach"
    island = F.row_number().over(w) - F.sum(hit.cast("int")).over(w)
    marked = df.withColumn("__island", island)
    run = F.when(hit, F.row_number().over(Window.partitionBy(*keys, "__island", state).orderBy(order))).otherwise(0)
    return marked.withColumn("run", run).withColumn("alert", F.col("run") >= needed).drop("__island")


def open_alerts(results: DataFrame, keys: Sequence[str], order: str, always: int = 10) -> DataFrame:
    """One alert per (monitor, metric, segment): first and last firing, its level now, and whether it
    has fired on each of at least `always` periods."""
    cells = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("periods"), F.count(F.when(F.col("status") != "ok", 1)).alias("fired"),
        F.min(F.when(F.col("status") != "ok", F.col(order))).alias("first_fired"), F.max(F.when(F.col("status") != "ok", F.col(order))).alias("last_fired"),
        F.max(F.when(F.col("status") == "breach", 2).when(F.col("status") == "warn", 1)).alias("__level"),
    )
    return cells.where("fired > 0").withColumn("level", F.when(F.col("__level") == 2, "breach").otherwise("warn")).withColumn(
        "always_firing", (F.col("fired") == F.col("periods")) & (F.col("periods") >= always)
    ).drop("__level")


def backfill(df: DataFrame, day: Column, missing: Sequence[str], compute) -> DataFrame:
    """Recompute missed periods only: the filter reaches the scan, `compute` is the batch kernel."""
    return compute(df.where(day.isin([F.lit(m).cast("date") for m in missing])))


def approximation_error(exact: DataFrame, approximate: DataFrame, quote: str = "quote_id") -> DataFrame:
    """Realised error of an approximation against the exact model, over quotes both price."""
    a = exact.where("outcome = 'quoted'").select(quote, F.col("premium_minor").alias("x"))
    b = approximate.where("outcome = 'quoted'").select(quote, F.col("premium_minor").alias("y"))
    miss = F.abs(F.col("y") - F.col("x")) / F.col("x") * 100
    return a.join(b, quote).agg(F.count(F.lit(1)).alias("quotes"), F.avg(miss).alias("mean_abs_pct"), F.max(miss).alias("max_abs_pct"))
