"""Price optimisation as data work: demand curves, elasticities, segment search, fairness checks."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from premia.operators import partials

LOW_VARIATION = 0.02
EXTRAPOLATION = 0.20
#: Numbers that one step over risks and draws works on, and sums that a task holds before it sends them on.
_BLOCK, _HELD = 1 << 18, 1 << 22


class OptimiseError(ValueError):
    """A search that has no admissible answer."""


@dataclass(frozen=True)
class Demand:
    """A logistic demand model with a log-price term: the rest of the predictor is a column."""

    base: str
    price_coefficient: float
    standard_error: float = 0.0

    def probability(self, price: Column) -> Column:
        eta = F.col(self.base) + F.lit(float(self.price_coefficient)) * F.ln(price)
        return 1 / (1 + F.exp(-eta))


def _points(name: str, values: Sequence[float]) -> Column:
    return F.inline(F.from_json(F.lit(json.dumps([{name: float(v)} for v in values])), f"array<struct<{name}:double>>"))


def price_variation(df: DataFrame, segments: Sequence[str], price: str, low: float = LOW_VARIATION) -> DataFrame:
    """Coefficient of variation of the price per segment, and whether it is too low to learn from."""
    out = df.groupBy(*segments).agg(F.count(F.lit(1)).alias("n"), F.avg(price).alias("mean_price"), F.stddev_samp(price).alias("__s"))
    cv = F.try_divide(F.coalesce("__s", F.lit(0.0)), F.col("mean_price"))
    return out.withColumn("variation", cv).withColumn("too_low", F.col("variation") < low).drop("__s")


def demand_curve(df: DataFrame, demand: Demand, price: str, factors: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Mean purchase probability of each segment at multiples of the current price.

    A risk becomes one row per price point and is summed at once, before any shuffle.
    """
    rows = df.select("*", _points("price_factor", factors))
    p = demand.probability(F.col(price) * F.col("price_factor"))
    return rows.groupBy(*by, "price_factor").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("probability"))


def elasticity(df: DataFrame, demand: Demand, price: str, by: Sequence[str], *, method: str = "analytic", step: float = 0.01, z: float = 1.959963984540054) -> DataFrame:
    """Mean own-price elasticity per segment with its interval; a positive one is a defect."""
    p = demand.probability(F.col(price))
    if method == "analytic":
        e = F.lit(float(demand.price_coefficient)) * (1 - p)
    elif method == "finite_difference":
        up, down = demand.probability(F.col(price) * (1 + step)), demand.probability(F.col(price) * (1 - step))
        e = F.ln(up / down) / F.lit(float(np.log((1 + step) / (1 - step))))
    else:
        raise OptimiseError(f"unknown method {method!r}")
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("elasticity"), F.avg(F.lit(z * demand.standard_error) * (1 - p)).alias("__h"))
    return out.select(
        *by, "n", "elasticity", (F.col("elasticity") - F.col("__h")).alias("low"), (F.col("elasticity") + F.col("__h")).alias("high"), (F.col("elasticity") > 0).alias("defect"), F.lit(method).alias("method")
    )


def extrapolation_guard(df: DataFrame, proposed: DataFrame, segment: str, price: str, limit: float = EXTRAPOLATION) -> DataFrame:
    """Per segment: observed price range, proposed price, and whether it lies too far outside."""
    seen = df.groupBy(segment).agg(F.min(price).alias("lowest"), F.max(price).alias("highest"))
    slack = (F.col("highest") - F.col("lowest")) * limit
    outside = (F.col("proposed_price") < F.col("lowest") - slack) | (F.col("proposed_price") > F.col("highest") + slack)
    return proposed.join(seen, segment, "left").withColumn("refused", F.coalesce(outside, F.lit(True)))


def outcomes(df: DataFrame, demand: Demand, *, segment: str, price: str, cost: str, factors: Sequence[float]) -> DataFrame:
    """Expected volume, premium and profit of every segment at every factor: the search space."""
    rows = df.select("*", _points("factor", factors))
    p = demand.probability(F.col(price) * F.col("factor"))
    paid = F.col(price) * F.col("factor")
    return rows.groupBy(segment, "factor").agg(
        F.sum(p).alias("volume"), F.sum(p * paid).alias("premium"), F.sum(p * (paid - F.col(cost))).alias("profit"), F.sum(F.lit(1.0)).alias("risks")
    )


def best_factors(space: DataFrame, segment: str, multipliers: Sequence[float]) -> DataFrame:
    """For each weight on volume, every segment's best factor (ties: the smallest)."""
    rows = space.select("*", _points("multiplier", multipliers))
    score = F.col("profit") + F.col("multiplier") * F.col("volume")
    best = F.max(F.struct(score.alias("score"), (-F.col("factor")).alias("minus"), "volume", "premium", "profit")).alias("b")
    return rows.groupBy("multiplier", segment).agg(best).select(
        "multiplier", segment, (-F.col("b.minus")).alias("factor"), "b.volume", "b.premium", "b.profit"
    )


def search(
    df: DataFrame, demand: Demand, *, segment: str, price: str, cost: str, factors: Sequence[float], min_volume_share: float, multipliers: Sequence[float]
) -> tuple[DataFrame, dict]:
    """Segment factors with the highest expected profit that keep a share of today's volume.

    The portfolio constraint enters through a weight on volume; the smallest weight whose answer is
    feasible wins. Returns the proposals and whether the constraint binds.
    """
    space = outcomes(df, demand, segment=segment, price=price, cost=cost, factors=sorted({*factors, 1.0}))
    today = space.where(F.col("factor") == 1.0).agg(F.sum("volume").alias("v")).first()["v"]
    allowed = [f for f in factors]
    answers = best_factors(space.where(F.col("factor").isin(allowed)), segment, multipliers)
    totals = sorted(answers.groupBy("multiplier").agg(F.sum("volume").alias("v"), F.sum("profit").alias("p")).collect(), key=lambda r: r["multiplier"])
    feasible = [r for r in totals if r["v"] >= min_volume_share * today]
    if not feasible:
        raise OptimiseError("no multiplier meets the volume constraint; widen the factors or multipliers")
    chosen = feasible[0]
    proposals = answers.where(F.col("multiplier") == F.lit(chosen["multiplier"])).drop("multiplier")
    at_bound = F.col("factor").isin([min(allowed), max(allowed)])
    return proposals.withColumn("at_bound", at_bound), {
        "multiplier": chosen["multiplier"], "volume": chosen["v"], "profit": chosen["p"], "baseline_volume": today, "volume_binding": chosen["multiplier"] > min(multipliers),
    }


def efficient_frontier(space: DataFrame, segment: str, multipliers: Sequence[float]) -> DataFrame:
    """Portfolio volume and profit per weight; dominated points are marked."""
    points = best_factors(space, segment, multipliers).groupBy("multiplier").agg(F.sum("volume").alias("volume"), F.sum("profit").alias("profit"))
    # One row per weight.
    better = F.max("profit").over(Window.partitionBy(F.lit(1)).orderBy(F.col("volume").desc(), F.col("profit").desc(), "multiplier").rowsBetween(Window.unboundedPreceding, -1))
    return points.withColumn("dominated", F.coalesce(better >= F.col("profit"), F.lit(False)))


def _draw_sums(sampled: np.ndarray, schema: pa.Schema):
    """Of each partition: (segment, volume, profit) with one sum for each draw, and how many risks the sums are of."""

    def flush(held: dict):
        names = pa.array([k for k, _ in held.values()], schema.field("segment").type)
        columns = [pa.array([v[i].tolist() for _, v in held.values()], schema.field(c).type) for i, c in enumerate(("volume", "profit"))]
        counts = [pa.array([int(v[i]) for _, v in held.values()], pa.int64()) for i in (2, 3)]
        return pa.RecordBatch.from_arrays([names, *columns, *counts], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        step = max(1, _BLOCK // len(sampled))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                coded = rows.column(0).dictionary_encode(null_encoding="encode")
                base, price, cost = (rows.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2, 3))
                with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                    p = 1 / (1 + np.exp(-(base[:, None] + sampled * np.log(np.where(price > 0, price, np.nan))[:, None])))
                    profit = p * (price - cost)[:, None]
                code = np.asarray(coded.indices)
                for k, name in enumerate(coded.dictionary.to_pylist()):
                    own = code == k
                    known, paid = own & ~np.isnan(p[:, 0]), own & ~np.isnan(profit[:, 0])
                    _, total = held.setdefault((name is None, name), (name, [np.zeros(len(sampled)), np.zeros(len(sampled)), 0, 0]))
                    total[0] += p[known].sum(axis=0)
                    total[1] += profit[paid].sum(axis=0)
                    total[2] += known.sum()
                    total[3] += paid.sum()
            if len(held) * len(sampled) > _HELD:
                yield flush(held)
                held = {}
        if held:
            yield flush(held)

    return run


def _added(table: pa.Table) -> tuple[list[np.ndarray], list[int]]:
    sums = []
    for c in ("volume", "profit"):
        column = table[c].combine_chunks()
        sums.append(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).sum(axis=0))
    return sums, [int(table[c].to_numpy().sum()) for c in ("volumes", "profits")]


def outcome_ranges(space_rows: DataFrame, demand: Demand, *, segment: str, price: str, cost: str, draws: int, seed: int, probs: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Ranges of each segment's volume and profit over seeded draws of the price coefficient.

    A risk meets all draws inside its task, as numbers and not as rows. What is shuffled is one row of sums for each
    partition and segment, added up in two steps, so that no task gets the sums of all partitions. A risk without predictor or
    positive price counts in neither range, one without cost not in the profit; a range of no risks is null.
    """
    if draws < 1:
        raise OptimiseError("a range needs one draw at least")
    sampled = np.random.default_rng(seed).normal(demand.price_coefficient, demand.standard_error, draws)
    own = space_rows.select(F.col(segment).alias("segment"), *[F.col(c).cast("double") for c in (demand.base, price, cost)])
    kind = own.schema["segment"].dataType.simpleString()
    sums = f"segment {kind}, volume array<double>, profit array<double>, volumes long, profits long"
    array = pa.list_(pa.float64())
    schema = pa.schema([to_arrow_schema(own.select("segment").schema).field(0).with_nullable(True), ("volume", array), ("profit", array), ("volumes", pa.int64()), ("profits", pa.int64())])
    parts = own.mapInArrow(_draw_sums(sampled, schema), sums)
    picks = [100 * q for q in probs]

    def add(table: pa.Table) -> pa.Table:
        (volume, profit), (volumes, profits) = _added(table)
        return pa.table([table["segment"][:1], [volume.tolist()], [profit.tolist()], [volumes], [profits]], schema=schema)

    def ranges(table: pa.Table) -> pa.Table:
        found = [np.percentile(x, picks).tolist() if n else None for x, n in zip(*_added(table), strict=True)]
        return pa.table({"segment": table["segment"][:1], **{c: pa.array([x], array) for c, x in zip(("volume", "profit"), found, strict=True)}})

    salted = parts.withColumn("salt", F.spark_partition_id() % max(1, math.isqrt(partials.partitions(own))))
    some = salted.groupBy("segment", "salt").applyInArrow(add, sums)
    out = some.groupBy("segment").applyInArrow(ranges, f"segment {kind}, volume array<double>, profit array<double>")
    return out.withColumnRenamed("segment", segment)


def compare_runs(a: DataFrame, b: DataFrame, segment: str) -> DataFrame:
    """Two runs' proposals side by side with the difference in factor."""
    x = a.select(segment, F.col("factor").alias("factor_a"), F.col("profit").alias("profit_a"))
    y = b.select(segment, F.col("factor").alias("factor_b"), F.col("profit").alias("profit_b"))
    return x.join(y, segment, "full").withColumns({"factor_change": F.col("factor_b") - F.col("factor_a"), "profit_change": F.col("profit_b") - F.col("profit_a")})


def fallback_channel(new_business: DataFrame, channel: str) -> str:
    """The channel most new business comes through (ties: the first by name)."""
    row = new_business.where(F.col(channel).isNotNull()).groupBy(channel).count().orderBy(F.col("count").desc(), channel).first()
    if row is None:
        raise OptimiseError("no new business has a channel")
    return row[channel]


def renewal_check(priced: DataFrame, *, tolerance: float = 0.0, renewal: str = "renewal_minor", equivalent: str = "equivalent_minor", exposure: str | None = None) -> DataFrame:
    """Renewal prices against the equivalent new-business price: verdict and failing population."""
    both = F.col(renewal).isNotNull() & (F.col(equivalent) > 0)
    ratio = F.when(both, F.col(renewal) / F.col(equivalent))
    fails = ratio > 1 + tolerance
    return priced.agg(
        F.count(F.when(both, 1)).alias("checked"), F.count(F.when(fails, 1)).alias("failing"), F.max(ratio).alias("worst_ratio"), F.avg(ratio).alias("mean_ratio"),
        (F.sum(F.when(fails, F.col(exposure))) if exposure else F.lit(None).cast("double")).alias("failing_exposure"),
    ).withColumn("verdict", F.when(F.col("failing") == 0, "pass").otherwise("fail"))


def price_walking(df: DataFrame, *, tenure: str, price: str, technical: str) -> tuple[DataFrame, DataFrame]:
    """(mean price over technical premium by tenure, one row with its slope over risks and verdict)."""
    margin = F.col(price) / F.col(technical)
    by_tenure = df.groupBy(tenure).agg(F.count(F.lit(1)).alias("n"), F.avg(margin).alias("mean_margin"))
    slope = df.agg(F.regr_slope(margin, F.col(tenure).cast("double")).alias("slope")).withColumn("rising", F.col("slope") > 0)
    return by_tenure, slope


def adjacency(proposals: DataFrame, order: str, *, max_step: float | None = None, increasing: bool | None = None) -> DataFrame:
    """Neighbouring proposals that differ too much or go the wrong way. One row per segment."""
    before = F.lag("factor").over(Window.partitionBy(F.lit(1)).orderBy(order))
    step = F.col("factor") - before
    out = proposals.withColumn("step", step)
    rough = (F.abs("step") > max_step) if max_step is not None else F.lit(False)
    wrong = ((F.col("step") < 0) if increasing else (F.col("step") > 0)) if increasing is not None else F.lit(False)
    return out.withColumns({"too_rough": F.coalesce(rough, F.lit(False)), "wrong_way": F.coalesce(wrong, F.lit(False))})


def proposals_to_edits(cells: DataFrame, proposals: DataFrame, segment: str, accepted: Sequence[str], value: str = "relativity") -> DataFrame:
    """Accepted proposals as new cell values; the caller previews them with a cell diff."""
    taken = proposals.where(F.col(segment).isin(list(accepted))).select(segment, F.col("factor").cast("decimal(10,4)").alias("__f"))
    return cells.join(taken, segment).select(*[c for c in cells.columns if c != value], (F.col(value) * F.col("__f")).cast("decimal(28,12)").cast("string").alias(value))


def check_bounds(factors: Sequence[float], bounds: Mapping[str, float]) -> list[float]:
    """Factors within the declared adjustment bounds."""
    return [f for f in factors if bounds.get("min", 0.0) <= f <= bounds.get("max", float("inf"))]
