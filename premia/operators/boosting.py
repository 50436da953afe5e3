"""Additive shape-function models: cyclic boosting on binned features, scoring and export.

Each boosting round is one `groupBy` per job over the pooled cells of all features' bins, so
training cost after pooling does not depend on the number of rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.operators.ordering import first_reaching
from premia.operators.partials import partitions
from premia.session import cut_lineage


#: Rows of one part of the table that boosted trees keep and read in every pass.
ROWS_PER_PART = 500_000


class BoostingError(ValueError):
    """A model that cannot be fitted or applied."""


@dataclass(frozen=True)
class Feature:
    """A categorical feature (its levels) or a numeric one (its inner cuts)."""

    name: str
    levels: tuple[str, ...] = ()
    cuts: tuple[float, ...] = ()

    @property
    def size(self) -> int:
        return len(self.levels) if self.levels else len(self.cuts) + 1

    def position(self) -> Column:
        """0-based bin; null for an unseen level or a null number."""
        if self.levels:
            pairs = [x for i, level in enumerate(self.levels) for x in (F.lit(level), F.lit(i))]
            return F.try_element_at(F.create_map(*pairs), F.col(self.name).cast("string"))
        out = F.lit(0)
        for i, c in enumerate(self.cuts, start=1):
            out = F.when(F.col(self.name) >= c, F.lit(i)).otherwise(out)
        return F.when(F.col(self.name).isNotNull(), out)

    def labels(self) -> list[str]:
        if self.levels:
            return list(self.levels)
        edges = ["-inf", *[f"{c:g}" for c in self.cuts], "inf"]
        return [f"[{a}, {b})" for a, b in zip(edges, edges[1:])]


@dataclass
class ShapeModel:
    """A score on the log scale: intercept, one table per feature, one grid per pair of features."""

    features: Mapping[str, Feature]
    intercept: float
    shapes: dict[str, list[float]]
    pairs: dict[tuple[str, str], list[list[float]]] = field(default_factory=dict)
    curve: list[float] = field(default_factory=list)

    def score(self, df: DataFrame, name: str, *, strict: bool = True) -> DataFrame:
        """`df` plus the sum of table values; an unseen level is an error, or null when not strict."""
        value: Column = F.lit(float(self.intercept))
        for n, f in self.features.items():
            if n in self.shapes:
                value = value + F.element_at(_numbers(self.shapes[n]), f.position() + 1)
        for (a, b), grid in self.pairs.items():
            row = F.element_at(_numbers(grid, "array<array<double>>"), self.features[a].position() + 1)
            value = value + F.element_at(row, self.features[b].position() + 1)
        if strict:
            value = F.when(value.isNull(), F.raise_error(F.lit("a level the model has not seen")).cast("double")).otherwise(value)
        return df.withColumn(name, value)

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        df = self.score(df, name, strict=False)
        return df.withColumn(name, F.exp(name))

    def export(self, spark) -> DataFrame:
        """The tables as rows: (feature, position, label, value)."""
        rows = [(n, i, label, float(v)) for n, shape in self.shapes.items() for i, (label, v) in enumerate(zip(self.features[n].labels(), shape))]
        return spark.createDataFrame(rows, "feature string, position int, label string, value double")


def _numbers(values, kind: str = "array<double>") -> Column:
    """A table of numbers as one literal."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def make_features(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], bins: int = 16) -> dict[str, Feature]:
    """Levels and quantile cuts of the features, from one small aggregate and one selection."""
    out: dict[str, Feature] = {}
    if categorical:
        from premia.operators.ingest import level_counts

        rows = level_counts(df, list(categorical)).where("level is not null").select("column", "level").collect()
        for c in categorical:
            out[c] = Feature(c, levels=tuple(sorted(r["level"] for r in rows if r["column"] == c)))
    if numeric:
        values, _ = first_reaching(df, {c: (lambda total: [total * k / bins for k in range(1, bins)]) for c in numeric})
        low = df.agg(*[F.min(c).alias(c) for c in numeric]).first()
        for c in numeric:
            out[c] = Feature(c, cuts=tuple(sorted({float(v) for v in values[c] if v is not None and v > low[c]})))
    return out


#: First and second derivative of a loss by its score on the log scale, given y and mu.
GRADIENTS: dict[str, Callable[[Column, Column], tuple[Column, Column]]] = {
    "poisson": lambda y, mu: (mu - y, mu),
    "gamma": lambda y, mu: (1 - y / mu, y / mu),
    "squared_log": lambda y, mu: (mu * (mu - y), mu * mu),
}


def fit_shapes(
    df: DataFrame,
    features: Mapping[str, Feature],
    *,
    response: str,
    exposure: str | None = None,
    weight: str | None = None,
    family: str = "poisson",
    gradient: Callable[[Column, Column], tuple[Column, Column]] | None = None,
    rounds: int = 10,
    rate: float = 0.5,
    cap: float | None = None,
    pairs: Sequence[tuple[str, str]] = (),
) -> ShapeModel:
    """Cyclic boosting: every round moves every feature's bins by a damped Newton step.

    A Poisson fit pools rows to (bins, exposure, response total) cells first. `gradient` gives a
    user loss as (first, second derivative) of y and the current mean. The first round visits
    features one after another; the loss after every round is the evaluation curve.
    """
    if family not in GRADIENTS and gradient is None:
        raise BoostingError(f"unknown family {family!r}")
    step = gradient or GRADIENTS[family]
    y = F.col(response).cast("double")
    if cap is not None:
        y = F.when(y > float(cap), F.lit(float(cap))).otherwise(y)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = F.col(exposure).cast("double") if exposure else F.lit(1.0)
    keys = {f"__b{i}": f.position() for i, f in enumerate(features.values())}
    rows = df.select(*[p.cast("int").alias(k) for k, p in keys.items()], w.alias("w"), y.alias("y"), e.alias("e"))
    unseen = rows.where(" or ".join(f"{k} is null" for k in keys)).limit(1).count()
    if unseen:
        raise BoostingError("a row has a null or unseen feature value")
    if family == "poisson" and gradient is None:
        pooled = rows.groupBy(*keys).agg(F.sum(F.col("w") * F.col("e")).alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"))
        cells = pooled.select(*keys, "w", (F.col("wy") / F.col("w")).alias("y"), F.lit(1.0).alias("e"))
    else:
        cells = rows.groupBy(*keys, "y", "e").agg(F.sum("w").alias("w"))
    cells = cut_lineage(cells)
    names = list(features)
    start = cells.agg((F.sum(F.col("w") * F.col("y")) / F.sum(F.col("w") * F.col("e"))).alias("m")).first()["m"]
    if not start or start <= 0:
        raise BoostingError("the response carries nothing to fit")
    model = ShapeModel(features, math.log(start), {n: [0.0] * features[n].size for n in names})
    grids = {p: [[0.0] * features[p[1]].size for _ in range(features[p[0]].size)] for p in pairs}
    model.pairs = grids

    def mean() -> Column:
        s: Column = F.lit(model.intercept)
        for i, n in enumerate(names):
            s = s + F.element_at(_numbers(model.shapes[n]), F.col(f"__b{i}") + 1)
        for (a, b), grid in grids.items():
            row = F.element_at(_numbers(grid, "array<array<double>>"), F.col(f"__b{names.index(a)}") + 1)
            s = s + F.element_at(row, F.col(f"__b{names.index(b)}") + 1)
        return F.col("e") * F.exp(s)

    def totals(targets: Sequence) -> list:
        g, h = step(F.col("y"), F.col("__mu"))
        entries = []
        for t, target in enumerate(targets):
            if isinstance(target, tuple):
                a, b = (F.col(f"__b{names.index(x)}") for x in target)
            else:
                a, b = F.col(f"__b{names.index(target)}"), F.lit(0)
            entries.append(F.struct(F.lit(t).alias("t"), a.alias("a"), b.alias("b")))
        scored = cells.withColumn("__mu", mean())
        return (
            scored.select((F.col("w") * g).alias("g"), (F.col("w") * h).alias("h"), F.inline(F.array(*entries)))
            .groupBy("t", "a", "b")
            .agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            .collect()  # one row per bin
        )

    def move(targets: Sequence, damping: float) -> None:
        for r in totals(targets):
            if r["h"] <= 0:
                continue
            change = max(-1.0, min(1.0, -damping * r["g"] / r["h"]))
            target = targets[r["t"]]
            if isinstance(target, tuple):
                grids[target][r["a"]][r["b"]] += change
            else:
                model.shapes[target][r["a"]] += change

    loss = {"poisson": F.col("__mu") - F.col("y") * F.ln("__mu"), "gamma": F.col("y") / F.col("__mu") + F.ln("__mu")}.get(
        family, (F.col("y") - F.col("__mu")) * (F.col("y") - F.col("__mu"))
    )
    for r in range(rounds):
        if r == 0:
            for n in names:
                move([n], 1.0)
        else:
            move(names, rate / max(1, math.sqrt(len(names))))
        if pairs and r >= rounds // 2:
            move(list(pairs), rate / max(1, len(pairs)))
        model.curve.append(cells.withColumn("__mu", mean()).agg((F.sum(F.col("w") * loss) / F.sum("w")).alias("l")).first()["l"])
    return model


def interaction_strength(model: ShapeModel, df: DataFrame, exposure: str = "exposure_years") -> list[dict]:
    """Exposure-weighted standard deviation of every pair grid, strongest first."""
    out = []
    for (a, b), grid in model.pairs.items():
        row = F.element_at(_numbers(grid, "array<array<double>>"), model.features[a].position() + 1)
        value = F.element_at(row, model.features[b].position() + 1)
        r = df.select(value.alias("v"), F.col(exposure).alias("e")).agg(
            (F.sum(F.col("e") * F.col("v")) / F.sum("e")).alias("m"), (F.sum(F.col("e") * F.col("v") * F.col("v")) / F.sum("e")).alias("m2")
        ).first()
        out.append({"pair": (a, b), "strength": math.sqrt(max(0.0, r["m2"] - r["m"] ** 2))})
    return sorted(out, key=lambda x: (-x["strength"], x["pair"]))


def boosted_trees(df: DataFrame, *, response: str, features: Sequence[str], depth: int = 3, rounds: int = 10, seed: int = 0):
    """Gradient-boosted trees of Spark ML with the loss after every round and feature importance.

    Spark ML keeps the rows as they are parted, so a larger table is dealt out into more parts first.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    n = df.count()
    if n > ROWS_PER_PART * partitions(df):
        df = df.select(*dict.fromkeys([*features, response])).repartition(-(-n // ROWS_PER_PART))
    rows = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error").transform(df).select(
        "features", F.col(response).cast("double").alias("label")
    )
    model = GBTRegressor(maxDepth=depth, maxIter=rounds, seed=seed, subsamplingRate=1.0).fit(rows)
    curve = model.evaluateEachIteration(rows, "squared")
    importance = sorted(zip(features, model.featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))
    return model, list(curve), importance
