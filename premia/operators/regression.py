"""Regression suites over rated quotes: golden expectations, properties, sweeps, replay."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.operators.rating import ladder_reconciles
from premia.session import shuffle_buckets

GRID_POINTS = 21
SAMPLED_POINTS = 10
#: Swept rows of one part of the contexts.
SWEPT_ROWS = 4_000_000


class SuiteError(ValueError):
    """A suite that does not apply to the run it is checked against."""


def golden(expected: DataFrame, scored: DataFrame, quote: str = "quote_id") -> DataFrame:
    """Per golden quote: pass when the outcome is as expected and, if quoted, the premium is within
    its tolerance in minor units. A quote that was not scored fails; nothing aborts.

    `expected` has columns quote, expected_outcome, expected_minor, tolerance_minor.
    """
    actual = scored.select(quote, F.col("outcome").alias("actual_outcome"), F.col("premium_minor").alias("actual_minor"))
    joined = expected.join(actual, quote, "left")
    difference = F.col("actual_minor") - F.col("expected_minor")
    close = F.coalesce(F.abs(difference) <= F.col("tolerance_minor"), F.lit(False))
    same = F.col("actual_outcome").eqNullSafe(F.col("expected_outcome"))
    passed = same & ((F.col("expected_outcome") != "quoted") | close)
    return joined.select(
        quote, F.when(passed, "pass").otherwise("fail").alias("status"), "expected_minor", "actual_minor", difference.alias("difference_minor")
    )


def properties(scored: DataFrame, *, outputs: Sequence[str] = (), low: int | None = None, high: int | None = None) -> DataFrame:
    """One row per property: quotes it was checked on and quotes that break it.

    Declined and failed quotes hold every premium property vacuously.
    """
    quoted = F.col("outcome") == "quoted"
    premium = F.col("premium_minor")
    missing = F.lit(False)
    for o in outputs:
        missing = missing | F.col(o).isNull()
    checks: dict[str, tuple[Column, Column]] = {
        "premium_positive": (quoted, ~(premium > 0)),
        "no_null_output": (quoted, missing | premium.isNull()),
        "ladder_reconciles": (quoted & F.col("ladder").isNotNull(), ~ladder_reconciles("ladder", "premium_minor")),
    }
    if low is not None or high is not None:
        outside = F.lit(False)
        if low is not None:
            outside = outside | (premium < low)
        if high is not None:
            outside = outside | (premium > high)
        checks["premium_bounded"] = (quoted, outside)
    row = scored.agg(
        *[x for n, (on, bad) in checks.items() for x in (F.count(F.when(on, 1)).alias(f"{n}_c"), F.count(F.when(on & bad, 1)).alias(f"{n}_b"))]
    )
    entries = [F.struct(F.lit(n).alias("property"), F.col(f"{n}_c").alias("checked"), F.col(f"{n}_b").alias("broken")) for n in checks]
    return row.select(F.inline(F.array(*entries)))


def monotone_grid(low, high, *, integer: bool, seed: int, name: str) -> list:
    """Points from `low` to `high` in whole units (cents where not integer): both bounds, a regular grid, and some drawn
    by hashing (name, seed, number), so that every run has the same. Ordered levels need no grid; they are swept as given."""
    unit = Decimal(1 if integer else "0.01")
    start = Decimal(low)
    units = int((Decimal(high) - start) / unit)
    regular = {units * k // (GRID_POINTS - 1) for k in range(GRID_POINTS)}
    drawn = {int(hashlib.sha256(f"{name}/{seed}/{k}".encode()).hexdigest(), 16) % (units + 1) for k in range(SAMPLED_POINTS)}
    values = [start + k * unit for k in sorted(regular | drawn)]
    return [int(v) for v in values] if integer else values


def monotone_sweep(
    contexts: DataFrame,
    name: str,
    points: Sequence,
    rate: Callable[[DataFrame], DataFrame],
    *,
    increasing: bool = True,
    strict: bool = False,
    quote: str = "quote_id",
) -> DataFrame:
    """Sweep one input of every context over `points` and compare adjacent quoted premiums, across
    declined gaps: (quote, quoted_points, breaks, broken_from, broken_to).

    Each context becomes a fixed number of rows, so work grows with contexts times grid. Contexts are dealt out by quote
    before they are swept, into parts of at most SWEPT_ROWS swept rows or so: where `rate` joins small tables only, all
    rows of a quote are then together already, and the swept rows are not shuffled.
    """
    parts = max(shuffle_buckets(contexts.sparkSession), -(-contexts.count() * len(points) // SWEPT_ROWS))
    grid = F.array(*[F.struct(F.lit(i).alias("__i"), F.lit(str(p)).cast(contexts.schema[name].dataType).alias(name)) for i, p in enumerate(points)])
    swept = contexts.drop(name).repartition(parts, quote).select("*", F.inline(grid))
    scored = rate(swept)
    w = Window.partitionBy(quote).orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    last_premium = F.last(F.when(F.col("outcome") == "quoted", F.col("premium_minor")), ignorenulls=True).over(w)
    last_value = F.last(F.when(F.col("outcome") == "quoted", F.col(name)), ignorenulls=True).over(w)
    stepped = scored.withColumns({"__before": last_premium, "__from": last_value}).where("outcome = 'quoted'")
    rise = F.col("premium_minor") - F.col("__before")
    ok = (rise > 0 if strict else rise >= 0) if increasing else (rise < 0 if strict else rise <= 0)
    broken = F.col("__before").isNotNull() & ~ok
    return stepped.groupBy(quote).agg(
        F.count(F.lit(1)).alias("quoted_points"),
        F.count(F.when(broken, 1)).alias("breaks"),
        F.min(F.when(broken, F.struct("__i", F.col("__from").cast("string").alias("a"), F.col(name).cast("string").alias("b")))).alias("__first"),
    ).select(quote, "quoted_points", "breaks", F.col("__first.a").alias("broken_from"), F.col("__first.b").alias("broken_to"))


def monotone_verdict(swept: DataFrame) -> DataFrame:
    """Pass needs a comparison: with no context quoted twice the property was not checked."""
    row = swept.agg(
        F.count(F.when(F.col("quoted_points") >= 2, 1)).alias("comparable_contexts"), F.count(F.when(F.col("breaks") > 0, 1)).alias("broken_contexts")
    )
    verdict = F.when(F.col("broken_contexts") > 0, "fail").when(F.col("comparable_contexts") == 0, "not_checked").otherwise("pass")
    return row.withColumn("verdict", verdict)


def suite_hash(cases: DataFrame) -> str:
    """A digest of the suite's cases, the same for any order."""
    from premia.sources.files import content_fingerprint

    return content_fingerprint(cases).first()["fingerprint"]


def replay(recorded: DataFrame, again: DataFrame, *, recorded_hash: str, current_hash: str, case: str = "case") -> DataFrame:
    """The same cases on a new version: (case, before, after, change). The suite must be unchanged."""
    if recorded_hash != current_hash:
        raise SuiteError("the suite has changed since the recorded run")
    both = recorded.select(case, F.col("status").alias("before")).join(again.select(case, F.col("status").alias("after")), case, "full")
    change = (
        F.when(F.col("before") == F.col("after"), "same").when(F.col("after") == "pass", "fixed").when(F.col("before") == "pass", "broken").otherwise("other")
    )
    return both.withColumn("change", change)


def golden_delta(before: DataFrame, after: DataFrame, name: str = "quote_id") -> DataFrame:
    """Golden quotes added, removed or changed between two suites."""
    fields = [c for c in before.columns if c != name]
    a = before.select(name, F.struct(*fields).alias("a"))
    b = after.select(name, F.struct(*fields).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, name, "full").select(name, change.alias("change")).where("change is not null")
