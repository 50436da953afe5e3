"""Generalised linear models on categorical and numeric terms.

Rows of a model of levels alone are first pooled to the level combinations it can tell apart, with
their weight and mean response, which is all its likelihood depends on; numerics and offsets leave
nothing to pool. Every iteration is then one pass that adds up `X'WX` and `X'Wz` as one array for
each partition, merged as a tree, and any number of variants of a model (folds, penalties, powers,
dropped factors) iterate together in the same pass.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.functions import losses
from premia.functions.special import chi2_tail, normal_ppf
from premia.operators.partials import partitions, tree_sum
from premia.session import cut_lineage, stored

MAX_ITERATIONS = 50
TOLERANCE = 1e-8
LITERAL_LEVELS = 200
#: Columns of a model, and sums of all variants that iterate together: what a partition's array may hold.
MAX_COLUMNS, MAX_SUMS = 2_000, 8_000_000
NULL_LEVEL = "(null)"


class GlmError(ValueError):
    """Data or a specification a model cannot be fitted on."""


@dataclass(frozen=True)
class Spec:
    """What to fit. `exposure` enters as a log offset; `offset` is on the link scale (for example
    another model's linear predictor)."""

    response: str
    family: str
    factors: tuple[str, ...] = ()
    numerics: tuple[str, ...] = ()
    exposure: str | None = None
    weight: str | None = None
    offset: str | None = None
    link: str = "log"
    power: float = 1.5
    theta: float = 1.0


@dataclass(frozen=True)
class Variant:
    """One member of a family of fits: a ridge penalty, rows left out, a factor dropped, a power."""

    name: str
    penalty: float = 0.0
    leave_out_fold: int | None = None
    drop: str | None = None
    power: float | None = None


@dataclass
class Glm:
    spec: Spec
    levels: Mapping[str, Sequence[str]]  # first is the base level
    beta: np.ndarray
    gram: np.ndarray  # X'WX at the solution
    iterations: int
    converged: bool
    dropped: str | None = None
    dispersion: float = 1.0
    stats: dict = field(default_factory=dict)

    @property
    def index(self) -> dict[tuple[str, str], int]:
        out, i = {}, 1
        for f in self.spec.factors:
            for level in list(self.levels[f])[1:]:
                out[(f, level)] = i
                i += 1
        for n in self.spec.numerics:
            out[(n, "")] = i
            i += 1
        return out

    def coefficient(self, factor: str, level: str = "") -> float | None:
        if factor in self.levels and level == self.levels[factor][0]:
            return 0.0
        i = self.index.get((factor, level))
        return None if i is None else float(self.beta[i])

    def covariance(self) -> np.ndarray:
        used = independent(self.gram)
        out = np.zeros_like(self.gram)
        out[np.ix_(used, used)] = np.linalg.inv(self.gram[np.ix_(used, used)]) * self.dispersion
        return out

    def relativities(self, spark) -> DataFrame:
        """(factor, level, estimate, standard_error, relativity); the base level is 1."""
        se = np.sqrt(np.maximum(np.diag(self.covariance()), 0))
        rows = []
        for f in self.spec.factors:
            for k, level in enumerate(self.levels[f]):
                i = self.index.get((f, level))
                b = 0.0 if k == 0 else float(self.beta[i])
                rows.append((f, level, b, 0.0 if k == 0 else float(se[i]), math.exp(b)))
        return spark.createDataFrame(rows, "factor string, level string, estimate double, standard_error double, relativity double")

    def _term(self, df: DataFrame, f: str) -> tuple[DataFrame, Column]:
        """A factor's coefficient per row, null for a level the fit has not seen."""
        pairs = [(level, self.coefficient(f, level)) for level in self.levels[f]]
        value = level_text(f)
        if len(pairs) <= LITERAL_LEVELS:
            return df, F.try_element_at(F.create_map(*[F.lit(x) for p in pairs for x in p]), value)
        side = df.sparkSession.createDataFrame(pairs, f"`__l_{f}` string, `__b_{f}` double")
        return df.join(F.broadcast(side), value == F.col(f"__l_{f}"), "left").drop(f"__l_{f}"), F.col(f"__b_{f}")

    def linear_predictor(self, df: DataFrame, name: str, *, with_offset: bool = True) -> DataFrame:
        eta: Column = F.lit(float(self.beta[0]))
        added = []
        for f in self.spec.factors:
            before = set(df.columns)
            df, term = self._term(df, f)
            added += [c for c in df.columns if c not in before]
            eta = eta + term
        for n in self.spec.numerics:
            eta = eta + F.lit(self.coefficient(n)) * F.col(n).cast("double")
        if with_offset:
            eta = eta + offset_of(self.spec)
        return df.withColumn(name, eta).drop(*added)

    def predict(self, df: DataFrame, name: str = "prediction", *, with_offset: bool = True) -> DataFrame:
        """`df` plus the fitted mean: with the offset, of the row; without, per unit of exposure."""
        df = self.linear_predictor(df, name, with_offset=with_offset)
        return df.withColumn(name, losses.inverse_link(F.col(name), self.spec.link))

    def predict_interval(self, df: DataFrame, confidence: float = 0.95, name: str = "prediction") -> DataFrame:
        """Mean with its confidence interval from the full covariance, or the reason there is none."""
        spec, index = self.spec, self.index
        v = self.covariance()
        z = normal_ppf(0.5 + confidence / 2)
        slots = [F.lit(0)]
        for f in spec.factors:
            pairs = [(level, index.get((f, level), -1)) for level in self.levels[f]]
            slots.append(F.try_element_at(F.create_map(*[F.lit(x) for p in pairs for x in p]), level_text(f)))
        positions = [index[(n, "")] for n in spec.numerics]

        @F.pandas_udf("double")
        def spread(idx: pd.Series, values: pd.Series) -> pd.Series:
            n = len(idx)
            x = np.zeros((n, v.shape[0]))
            ids = np.stack(idx.to_numpy()) if n else np.zeros((0, 1), int)
            for s in range(ids.shape[1]):
                ok = ids[:, s] >= 0
                x[np.nonzero(ok)[0], ids[ok, s]] = 1.0
            if positions and n:
                x[:, positions] = np.stack(values.to_numpy())
            return pd.Series(np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, v, x), 0)))

        df = self.linear_predictor(df, "__eta")
        ids = F.array(*[F.coalesce(s, F.lit(-1)).cast("int") for s in slots])
        nums = F.array(*[F.col(n).cast("double") for n in spec.numerics]) if positions else F.array(F.lit(0.0))
        df = df.withColumn("__s", spread(ids, nums))
        mean = lambda e: losses.inverse_link(e, spec.link)
        unseen = F.col("__eta").isNull()
        return df.withColumns(
            {
                name: mean(F.col("__eta")),
                f"{name}_low": F.when(~unseen, mean(F.col("__eta") - z * F.col("__s"))),
                f"{name}_high": F.when(~unseen, mean(F.col("__eta") + z * F.col("__s"))),
                f"{name}_reason": F.when(unseen, "a level the fit has not seen"),
            }
        ).drop("__eta", "__s")


def level_text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NULL_LEVEL))


def offset_of(spec: Spec) -> Column:
    out = F.lit(0.0)
    if spec.exposure:
        out = out + F.ln(F.col(spec.exposure).cast("double"))
    if spec.offset:
        out = out + F.col(spec.offset).cast("double")
    return out


# -- population ------------------------------------------------------------------------------


def check_weights(df: DataFrame, weight: str | None) -> tuple[DataFrame, dict[str, int]]:
    """Rows to fit on. A weight of exactly zero leaves a row out and is counted; a negative, null
    or non-finite weight refuses the fit."""
    if weight is None:
        return df, {"zero_weight": 0}
    w = F.col(weight).cast("double")
    bad = w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")) | (w < 0)
    row = df.agg(F.count(F.when(bad, 1)).alias("bad"), F.count(F.when(w == 0, 1)).alias("zero"), F.count(F.lit(1)).alias("n")).first()
    if row["bad"]:
        raise GlmError(f"weight column {weight!r} holds {row['bad']} negative, null or non-finite value(s)")
    if row["n"] == row["zero"]:
        raise GlmError(f"weight column {weight!r} leaves no row to fit on")
    return df.where(w != 0), {"zero_weight": row["zero"]}


def severity_population(df: DataFrame, claims: str = "claim_count", amount: str = "claim_amount_minor") -> tuple[DataFrame, DataFrame]:
    """(claims with a known amount, one row of counts). Rows without claims or amount are counted."""
    counts = df.agg(
        F.count(F.when(F.col(claims) == 0, 1)).alias("no_claims"),
        F.count(F.when((F.col(claims) > 0) & F.col(amount).isNull(), 1)).alias("unknown_amount"),
        F.count(F.when((F.col(claims) > 0) & F.col(amount).isNotNull(), 1)).alias("fitted_rows"),
    )
    return df.where((F.col(claims) > 0) & F.col(amount).isNotNull()), counts


def cap_losses(df: DataFrame, column: str, cap: float) -> DataFrame:
    """Large-loss treatment `capped`: a loss above the cap counts as the cap; an unknown one stays unknown."""
    limit = F.lit(cap).cast(df.schema[column].dataType)
    return df.withColumn(column, F.when(F.col(column) > limit, limit).otherwise(F.col(column)))


def degenerate_levels(df: DataFrame, factors: Sequence[str], *, min_claims: int = 1, min_exposure: float = 0.0) -> DataFrame:
    """Levels with too little data to estimate, by name: (factor, level, claims, exposure)."""
    entries = F.array(*[F.struct(F.lit(f).alias("factor"), level_text(f).alias("level")) for f in factors])
    sums = df.select("claim_count", "exposure_years", F.inline(entries)).groupBy("factor", "level").agg(
        F.sum("claim_count").alias("claim_count"), F.round(F.sum("exposure_years"), 6).alias("exposure_years")
    )
    return sums.where((F.col("claim_count") < min_claims) | (F.col("exposure_years") <= min_exposure))


# -- fitting ---------------------------------------------------------------------------------


def _pools(spec: Spec) -> bool:
    """Whether rows pool to level combinations."""
    return not spec.numerics and ((spec.family == "poisson" and spec.link == "log") or (spec.exposure is None and spec.offset is None))


def _cells(df: DataFrame, spec: Spec, fold: str | None) -> DataFrame:
    """Cells with weight `w`, mean response `y` and offset `o`: distinct ones, or rows where a number or offset tells most apart.

    A Poisson offset is a weight on a rate, so it needs no cell of its own.
    """
    weight = F.col(spec.weight).cast("double") if spec.weight else F.lit(1.0)
    y = F.col(spec.response).cast("double")
    offset = offset_of(spec)
    keys = [level_text(f).alias(f) for f in spec.factors] + [F.col(n).cast("double").alias(n) for n in spec.numerics]
    if fold:
        keys.append(F.col(fold).alias("__fold"))
    if spec.family == "poisson" and spec.link == "log":
        rows = df.select(*keys, (weight * F.exp(offset)).alias("w"), (weight * y).alias("wy"), F.lit(0.0).alias("o"))
    else:
        rows = df.select(*keys, weight.alias("w"), (weight * y).alias("wy"), offset.alias("o"))
    if not _pools(spec):
        return rows.where("w > 0").withColumn("y", F.col("wy") / F.col("w")).drop("wy")
    names = [*spec.factors, *spec.numerics, *(["__fold"] if fold else []), "o"]
    grouped = rows.where("w > 0").groupBy(*names).agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))
    return grouped.withColumn("y", F.col("wy") / F.col("w")).drop("wy")


def _levels(cells: DataFrame, factors: Sequence[str]) -> dict[str, list[str]]:
    """Levels of each factor, the base (most weight, then name) first."""
    if not factors:
        return {}
    entries = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("l")) for f in factors])
    rows = cells.select("w", F.inline(entries)).groupBy("f", "l").agg(F.sum("w").alias("w")).limit(MAX_COLUMNS + 1).collect()
    if len(rows) > MAX_COLUMNS:
        raise GlmError(f"the factors have more than {MAX_COLUMNS} levels; group them first")
    out: dict[str, list[str]] = {}
    for f in factors:
        mine = sorted((r for r in rows if r["f"] == f), key=lambda r: (-round(r["w"], 9), r["l"]))
        out[f] = [mine[0]["l"], *sorted(r["l"] for r in mine[1:])]
    return out


def _encode(cells: DataFrame, spec: Spec, levels: Mapping[str, Sequence[str]]) -> tuple[DataFrame, list[tuple[Column | int, Column | None]], int]:
    """Cells with one index column per factor, the (index, value) slots, and the number of columns.

    A slot of one column has its number as index; a slot that is 1 where it applies has no value.
    """
    slots = [(0, None)]
    p = 1
    for f in spec.factors:
        pairs = [(levels[f][0], -1)] + [(level, p + k) for k, level in enumerate(levels[f][1:])]
        p += len(levels[f]) - 1
        if len(pairs) <= LITERAL_LEVELS:
            cells = cells.withColumn(f"__i_{f}", F.try_element_at(F.create_map(*[F.lit(x) for q in pairs for x in q]), F.col(f)))
        else:
            side = cells.sparkSession.createDataFrame(pairs, f"`{f}` string, `__i_{f}` int")
            cells = cells.join(F.broadcast(side), f)
        slots.append((F.col(f"__i_{f}"), None))
    for n in spec.numerics:
        slots.append((p, F.col(n)))
        p += 1
    return cells, slots, p


def fit_variants(df: DataFrame, spec: Spec, variants: Sequence[Variant], *, fold: str | None = None) -> list[Glm]:
    """Fit all variants together: one job per iteration, whatever their number."""
    if spec.family not in losses.FAMILIES:
        raise GlmError(f"unknown family {spec.family!r}")
    df, _ = check_weights(df, spec.weight)
    cells = _cells(df, spec, fold)
    cells = cut_lineage(cells) if _pools(spec) else stored(cells)
    levels = _levels(cells, spec.factors)
    parts = partitions(cells)
    cells, slots, p = _encode(cells, spec, levels)
    if len(variants) * p * p > MAX_SUMS:
        raise GlmError(f"{len(variants)} fits of {p} columns are more than {MAX_SUMS} sums; fit fewer together")
    base = F.sum(F.col("w") * F.exp("o")) if spec.link == "log" else F.sum("w")
    start = cells.agg((F.sum(F.col("w") * F.col("y")) / base).alias("m")).first()["m"]
    if start is None or (spec.link != "identity" and start <= 0):
        raise GlmError("the response carries nothing to fit")
    owner = _owners(spec, levels, p)
    active = {v.name: np.array([o != v.drop for o in owner]) for v in variants}
    beta = {v.name: np.zeros(p) for v in variants}
    for v in variants:
        beta[v.name][0] = losses.link_value(start, spec.link)
    gram = {v.name: np.zeros((p, p)) for v in variants}
    columns = _sums(slots, p, spec)
    done: dict[str, int] = {}
    last: dict[str, tuple[float, np.ndarray]] = {}
    for iteration in range(1, MAX_ITERATIONS + 1):
        todo = [v for v in variants if v.name not in done]
        if not todo:
            break
        sums = _iteration(cells, columns, slots, parts, p, spec, todo, beta, bool(fold))
        for k, v in enumerate(todo):
            a, b, deviance = sums[k]
            before = last.get(v.name)
            # what a step must lower is the deviance with the penalty on all coefficients but the intercept
            now = deviance + v.penalty * float((beta[v.name][1:] ** 2).sum())
            least = None if before is None else before[0] + v.penalty * float((before[1][1:] ** 2).sum())
            if before is not None and not now <= least + 1e-9 * (1 + abs(least)):
                # The step went too far: go half way back and look again.
                beta[v.name] = (beta[v.name] + before[1]) / 2
                continue
            last[v.name] = (deviance, beta[v.name])
            gram[v.name] = a
            use = active[v.name] & independent(np.where(active[v.name][:, None] & active[v.name][None, :], a, 0.0))
            ridge = np.diag(np.where(np.arange(p) == 0, 0.0, v.penalty))[np.ix_(use, use)]
            new = np.zeros(p)
            size = np.sqrt(np.diag(a)[use])  # columns are brought to one scale before solving
            scaled = (a[np.ix_(use, use)] + ridge) / np.outer(size, size)
            new[use] = np.linalg.solve(scaled, b[use] / size) / size
            # A step is measured by what it does to a typical linear predictor.
            move = np.max(np.abs(new - beta[v.name]) * np.sqrt(np.diag(a) / a[0, 0]))
            beta[v.name] = new
            if not np.all(np.isfinite(new)):
                raise GlmError(f"variant {v.name!r} did not converge")
            if move < TOLERANCE:
                done[v.name] = iteration
    late = [v.name for v in variants if v.name not in done]
    if late:
        raise GlmError(f"no convergence within {MAX_ITERATIONS} iterations: {late}")
    out = []
    for v in variants:
        own = replace(spec, power=v.power) if v.power is not None else spec
        out.append(Glm(own, levels, beta[v.name], gram[v.name], done[v.name], True, v.drop))
    return out


def independent(gram: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Which columns are no combination of the columns before them (sweep with a pivot floor)."""
    left = gram.astype(float).copy()
    start = np.diag(gram).copy()
    keep = np.zeros(len(gram), dtype=bool)
    for i in range(len(gram)):
        if start[i] <= 0 or left[i, i] <= tolerance * start[i]:
            continue
        keep[i] = True
        left -= np.outer(left[:, i], left[i, :]) / left[i, i]
    return keep


def _owners(spec: Spec, levels, p: int) -> list[str]:
    owner = [""]
    for f in spec.factors:
        owner += [f] * (len(levels[f]) - 1)
    return owner + list(spec.numerics)


def _sums(slots, p: int, spec: Spec) -> dict[str, Column]:
    """The columns every iteration adds: they name the coefficients (`b`), not their values."""
    eta = F.col("o")
    for i, x in slots:
        term = F.get("__b", F.lit(i) if isinstance(i, int) else i)
        term = term if x is None else term * x
        eta = eta + (term if isinstance(i, int) else F.when(i >= 0, term).otherwise(F.lit(0.0)))
    mu = F.col("__mu")
    slope = losses.mean_slope(mu, spec.link)
    power = F.col("__power") if spec.family == "tweedie" else spec.power
    weight = F.col("w") * slope * slope / losses.variance(mu, spec.family, power=power, theta=spec.theta)
    return {
        "__eta": eta,
        "__mu": losses.inverse_link(F.col("__eta"), spec.link),
        "__wt": weight,
        "__z": F.col("__eta") - F.col("o") + (F.col("y") - mu) / slope,
        "__loss": F.col("w") * losses.unit_deviance("y", "__mu", spec.family, power=power, theta=spec.theta),
    }


def _iteration(cells, sums, slots, parts, p, spec, variants, beta, folded) -> list[list]:
    """`X'WX`, `X'Wz` and the deviance of every variant at its current coefficients, in one pass.

    Spark works out each row's mean, weight and working response; a partition adds them up in one array.
    """
    table = json.dumps(
        [
            {"__m": k, "__b": beta[v.name].tolist(), "__power": float(v.power if v.power is not None else spec.power), "__out": v.leave_out_fold if v.leave_out_fold is not None else -1}
            for k, v in enumerate(variants)
        ]
    )
    rows = cells.select("*", F.inline(F.from_json(F.lit(table), "array<struct<__m:int,__b:array<double>,__power:double,__out:int>>")))
    if folded:
        rows = rows.where("__fold <> __out")
    rows = rows.withColumn("__eta", sums["__eta"]).withColumn("__mu", sums["__mu"]).withColumns({"__wt": sums["__wt"], "__z": sums["__z"], "__loss": sums["__loss"]})
    n, many = len(slots), len(variants)
    indexed = [k for k, (i, _) in enumerate(slots) if not isinstance(i, int)]
    valued = [k for k, (_, x) in enumerate(slots) if x is not None]
    fixed = {k: i for k, (i, _) in enumerate(slots) if isinstance(i, int)}
    picked = rows.select("__m", "__wt", "__z", "__loss", *[slots[k][0].cast("int").alias(f"__c{k}") for k in indexed], *[slots[k][1].cast("double").alias(f"__x{k}") for k in valued])

    def part(batch):
        # a null level, number or loss adds nothing, as in a SQL sum
        of = lambda c, kind: batch.column(c).fill_null(kind).to_numpy(zero_copy_only=False)
        m, wt, z, loss = of(0, 0).astype(np.int64), of(1, 0.0), of(2, 0.0), of(3, 0.0)
        column = {k: of(4 + j, -1).astype(np.int64) for j, k in enumerate(indexed)}
        there = {k: c >= 0 for k, c in column.items()}
        x = {k: of(4 + len(indexed) + j, 0.0) for j, k in enumerate(valued)}
        out = np.zeros((many, size))

        def add(values, offset, a, step=1, b=None):
            """Adds `values` at offset + step * (column of slot a) + (column of slot b)."""
            at, on = np.full(1, offset), None
            for k, by in ((a, step), (b, 1)):
                if k in fixed:
                    at = at + by * fixed[k]
                elif k is not None:
                    at, on = at + by * column[k], there[k] if on is None else on & there[k]
            if on is None:
                out[:, at[0]] += np.bincount(m, weights=values, minlength=many)
            else:
                out.ravel()[:] += np.bincount((m * size + at)[on], weights=values[on], minlength=many * size)

        out[:, -1] += np.bincount(m, weights=loss, minlength=many)
        for a in range(n):
            wx = wt * x[a] if a in x else wt
            for b in range(a, n):
                add(wx * x[b] if b in x else wx, 0, a, p, b)
            add(wx * z, p * p, a)
        return out.ravel()

    size = p * p + p + 1
    total = tree_sum(picked, part, parts=parts, size=8 * many * size)
    total = np.zeros((many, size)) if total is None else total.reshape(many, size)
    out = []
    for sums_of in total:
        half = sums_of[: p * p].reshape(p, p)
        upper = half + half.T - np.diag(np.diag(half))  # each pair of terms was added once, on either side
        out.append([upper, sums_of[p * p : p * p + p], float(sums_of[-1])])
    return out


def fit_glm(df: DataFrame, spec: Spec, *, penalty: float = 0.0) -> Glm:
    """Fit one model; its dispersion is Pearson's for families that have one."""
    model = fit_variants(df, spec, [Variant("fit", penalty)])[0]
    if spec.family in ("gaussian", "gamma", "tweedie"):
        rows, _ = check_weights(df, spec.weight)
        scored = model.predict(rows, "__mu")
        w = F.col(spec.weight).cast("double") if spec.weight else F.lit(1.0)
        error = F.col(spec.response) - F.col("__mu")
        row = scored.agg(F.sum(w * error * error / losses.variance(F.col("__mu"), spec.family, power=spec.power)).alias("x"), F.count(F.lit(1)).alias("n")).first()
        model.dispersion = row["x"] / max(1, row["n"] - rank(model))
    return model


def rank(model: Glm) -> int:
    return int(independent(model.gram).sum())


def aliased(model: Glm) -> list[tuple[str, str]]:
    """Terms that are a combination of earlier ones: they are fitted as zero."""
    keep = independent(model.gram)
    return [k for k, i in model.index.items() if not keep[i]]


def variance_inflation(model: Glm) -> dict[tuple[str, str], float]:
    """Variance inflation of every column: how far the others explain it, intercept aside."""
    g = model.gram
    centred = g[1:, 1:] - np.outer(g[1:, 0], g[0, 1:]) / g[0, 0]
    d = np.sqrt(np.maximum(np.diag(centred), 1e-300))
    inverse = np.linalg.pinv(centred / np.outer(d, d))
    names = {i: k for k, i in model.index.items()}
    return {names[i + 1]: float(inverse[i, i]) for i in range(len(inverse))}


# -- fit statistics --------------------------------------------------------------------------


def deviance_of(df: DataFrame, spec: Spec, predictions: Mapping[str, str], powers: Mapping[str, float] | None = None) -> dict[str, float]:
    """Total weighted deviance of several prediction columns in one pass."""
    w = F.col(spec.weight).cast("double") if spec.weight else F.lit(1.0)
    row = df.agg(
        *[
            F.sum(w * losses.unit_deviance(spec.response, c, spec.family, power=(powers or {}).get(n, spec.power), theta=spec.theta)).alias(n)
            for n, c in predictions.items()
        ]
    ).first()
    return {n: row[n] for n in predictions}


def fit_statistics(df: DataFrame, model: Glm) -> dict:
    """Deviance, null deviance, dispersion, degrees of freedom, AIC and BIC where a likelihood is closed."""
    spec = model.spec
    rows, excluded = check_weights(df, spec.weight)
    null = fit_variants(df, replace(spec, factors=(), numerics=()), [Variant("null")])[0]
    scored = null.predict(model.predict(rows, "__mu"), "__m0")
    w = F.col(spec.weight).cast("double") if spec.weight else F.lit(1.0)
    y, mu = F.col(spec.response).cast("double"), F.col("__mu")
    error = y - mu
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.sum(w * losses.unit_deviance(y, mu, spec.family, power=spec.power, theta=spec.theta)).alias("deviance"),
        F.sum(w * losses.unit_deviance(y, F.col("__m0"), spec.family, power=spec.power, theta=spec.theta)).alias("null_deviance"),
        F.sum(w * error * error / losses.variance(mu, spec.family, power=spec.power, theta=spec.theta)).alias("pearson"),
    ]
    if spec.family == "poisson":
        aggs.append(F.sum(w * (y * F.ln(mu) - mu - losses.ln_factorial(y))).alias("loglik"))
    elif spec.family == "binomial":
        aggs.append(F.sum(w * (y * F.ln(mu) + (1 - y) * F.ln(1 - mu))).alias("loglik"))
    else:
        aggs.append(F.lit(None).cast("double").alias("loglik"))
    r = scored.agg(*aggs).first()
    k = rank(model)
    out = {
        "n": r["n"], "parameters": k, "df_residual": r["n"] - k, "deviance": r["deviance"], "null_deviance": r["null_deviance"],
        "dispersion": r["pearson"] / max(1, r["n"] - k), "excluded_zero_weight": excluded["zero_weight"], "aic": None, "bic": None,
    }
    loglik = r["loglik"]
    if spec.family == "gaussian" and r["deviance"] > 0:
        loglik, k = -0.5 * r["n"] * (math.log(2 * math.pi * r["deviance"] / r["n"]) + 1), k + 1
    if loglik is not None:
        out["aic"], out["bic"] = 2 * k - 2 * loglik, math.log(r["n"]) * k - 2 * loglik
    return out


def type_three(df: DataFrame, spec: Spec) -> list[dict]:
    """Each factor's likelihood-ratio test: refitted without it, all refits together."""
    terms = [*spec.factors, *spec.numerics]
    fits = fit_variants(df, spec, [Variant("full"), *[Variant(f"-{t}", drop=t) for t in terms]])
    rows, _ = check_weights(df, spec.weight)
    columns = {}
    for i, m in enumerate(fits):
        rows = m.predict(rows, f"__p{i}")
        columns["full" if i == 0 else terms[i - 1]] = f"__p{i}"
    d = deviance_of(rows, spec, columns)
    full = fits[0]
    scale = 1.0
    if spec.family in ("gaussian", "gamma", "tweedie"):
        scale = fit_glm(df, spec).dispersion
    owner = _owners(spec, full.levels, len(full.beta))
    rank = int(independent(full.gram).sum())
    out = []
    for t, m in zip(terms, fits[1:]):
        # Columns that others already explain are no degree of freedom.
        kept = np.array([o != t for o in owner])
        df_term = rank - int(independent(full.gram[np.ix_(kept, kept)]).sum())
        statistic = max(0.0, (d[t] - d["full"]) / scale)
        out.append({"term": t, "df": df_term, "statistic": statistic, "p_value": chi2_tail(statistic, df_term) if df_term else None})
    return out


def cross_validate(df: DataFrame, spec: Spec, penalties: Sequence[float], fold: str, folds: int) -> list[dict]:
    """Held-out mean deviance of every penalty and fold; all fits iterate together."""
    variants = [Variant(f"{a}|{k}", penalty=a, leave_out_fold=k) for a in penalties for k in range(folds)]
    fits = fit_variants(df, spec, variants, fold=fold)
    rows, _ = check_weights(df, spec.weight)
    for i, m in enumerate(fits):
        rows = m.predict(rows, f"__p{i}")
    w = F.col(spec.weight).cast("double") if spec.weight else F.lit(1.0)
    aggs = []
    for i, v in enumerate(variants):
        held = F.col(fold) == v.leave_out_fold
        loss = losses.unit_deviance(spec.response, f"__p{i}", spec.family, power=spec.power, theta=spec.theta)
        aggs.append(F.try_divide(F.sum(F.when(held, w * loss)), F.sum(F.when(held, w))).alias(f"s{i}"))
    r = rows.agg(*aggs).first()
    return [{"penalty": v.penalty, "fold": v.leave_out_fold, "score": r[f"s{i}"]} for i, v in enumerate(variants)]


@dataclass
class Theta:
    """A negative binomial's shape at its highest likelihood, its error, and the model fitted at it.

    The variance is mu + mu^2 / value; the model's specification holds the reciprocal, 1 / value.
    """

    value: float
    standard_error: float
    model: Glm
    rounds: int


#: Counts of one row up to which a shape can be estimated, and shapes beyond which a response counts as Poisson.
MAX_COUNT, MAX_THETA = 1_000_000, 1e7


def estimate_theta(df: DataFrame, spec: Spec, *, tolerance: float = 1e-8) -> Theta:
    """Shape and coefficients of a negative binomial, estimated in turns until the shape stays.

    For whole responses the digamma terms of the score are sums of 1 / (theta + k) over k below the response, so the
    table's counts, pooled by value once, are all that is needed of them; the other terms are sums over rows at each
    trial shape. Refused are responses that are no counts, and data without overdispersion, whose likelihood has no
    highest point.
    """
    rows, _ = check_weights(df, spec.weight)
    y = F.col(spec.response).cast("double")
    w = F.col(spec.weight).cast("double") if spec.weight else F.lit(1.0)
    rows = rows.where((w > 0) & y.isNotNull())
    pooled = rows.groupBy(y.alias("y")).agg(F.sum(w).alias("w")).orderBy("y").limit(MAX_COLUMNS * 50 + 1).collect()
    values, weights = np.array([r["y"] for r in pooled]), np.array([r["w"] for r in pooled])
    if not len(values) or (values < 0).any() or (values != np.floor(values)).any() or values.max() > MAX_COUNT or len(values) > MAX_COLUMNS * 50:
        raise GlmError(f"{spec.response!r} is no count of 0 to {MAX_COUNT}")
    above = np.zeros(int(values.max()))  # weight of the rows whose count is over k
    for value, weight in zip(values, weights, strict=True):
        above[: int(value)] += weight
    k, total = np.arange(len(above)), float(weights.sum())
    mean = float((values * weights).sum() / total)
    spread = float((weights * (values - mean) ** 2).sum() / total) - mean
    theta = mean * mean / spread if spread > 0 else 10.0
    for turn in range(1, MAX_ITERATIONS + 1):
        model = fit_variants(rows, replace(spec, family="negative_binomial", theta=1 / theta), [Variant("fit")])[0]
        scored = cut_lineage(model.predict(rows, "__mu").select(y.alias("y"), w.alias("w"), "__mu"))
        before, low, high = theta, 0.0, math.inf
        for _ in range(MAX_ITERATIONS):
            t = F.lit(float(theta))
            both = t + F.col("__mu")
            row = scored.agg(
                F.sum(F.col("w") * (1 - F.log(both / t) - (F.col("y") + t) / both)).alias("s"),
                F.sum(F.col("w") * (1 / t - 2 / both + (F.col("y") + t) / (both * both))).alias("h"),
            ).first()
            score = float((above / (theta + k)).sum()) + row["s"]
            slope = row["h"] - float((above / (theta + k) ** 2).sum())
            low, high = (theta, high) if score > 0 else (low, theta)
            # Newton on the logarithm; outside of what is known to hold the root, the middle of it
            step = score * theta / -(slope * theta * theta + score * theta) if slope * theta + score < 0 else math.copysign(1.0, score)
            new = theta * math.exp(max(-2.0, min(2.0, step)))
            if not low < new < high:
                new = math.sqrt(low * high) if low and math.isfinite(high) else theta * (2.0 if score > 0 else 0.5)
            done = abs(new - theta) <= tolerance * theta
            theta = new
            if theta > MAX_THETA:
                raise GlmError("no overdispersion: the likelihood grows with the shape; fit a Poisson model")
            if done:
                break
        if abs(theta - before) <= tolerance * theta * 10:
            return Theta(theta, float(1 / math.sqrt(-slope)) if slope < 0 else math.inf, model, turn)
    raise GlmError(f"the shape did not settle within {MAX_ITERATIONS} turns")


def tweedie_power(df: DataFrame, spec: Spec, grid: Sequence[float]) -> tuple[float, list[dict]]:
    """The power with the highest profile likelihood on a grid; a best value at the edge is refused."""
    fits = fit_variants(df, spec, [Variant(str(p), power=p) for p in grid])
    rows, _ = check_weights(df, spec.weight)
    for i, m in enumerate(fits):
        rows = m.predict(rows, f"__p{i}")
    y = F.col(spec.response).cast("double")
    w = F.col(spec.weight).cast("double") if spec.weight else F.lit(1.0)
    phis = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(w * (y - F.col(f"__p{i}")) * (y - F.col(f"__p{i}")) / F.pow(F.col(f"__p{i}"), F.lit(float(p)))).alias(f"x{i}") for i, p in enumerate(grid)],
    ).first()
    profile = []
    aggs = []
    for i, p in enumerate(grid):
        phi = phis[f"x{i}"] / max(1, phis["n"] - len(fits[i].beta))
        profile.append({"power": p, "phi": phi})
        aggs.append(F.sum(losses.tweedie_log_density(phi, p)(y, F.col(f"__p{i}"))).alias(f"l{i}"))
    likelihood = rows.agg(*aggs).first()
    for i, entry in enumerate(profile):
        entry["loglik"] = likelihood[f"l{i}"]
    best = max(range(len(grid)), key=lambda i: profile[i]["loglik"])
    if best in (0, len(grid) - 1):
        raise GlmError(f"the best power {grid[best]} is at the edge of the grid; widen it")
    return grid[best], profile
