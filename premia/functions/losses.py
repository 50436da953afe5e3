"""Losses, deviances and links as column expressions."""

from __future__ import annotations

import math
import sys
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column
from pyspark.sql import functions as F

from premia.functions.special import _lgamma

register_pickle_by_value(sys.modules[__name__])

FAMILIES = ("gaussian", "poisson", "gamma", "tweedie", "binomial", "negative_binomial")
LINKS = ("log", "identity", "logit")


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def inverse_link(eta: Column, link: str) -> Column:
    if link == "log":
        return F.exp(eta)
    if link == "identity":
        return eta
    if link == "logit":
        return 1 / (1 + F.exp(-eta))
    raise ValueError(f"unknown link {link!r}; expected one of {LINKS}")


def link_value(mean: float, link: str) -> float:
    return {"log": math.log, "identity": float, "logit": lambda m: math.log(m / (1 - m))}[link](mean)


def mean_slope(mu: Column, link: str) -> Column:
    """d mean / d linear predictor."""
    return {"log": mu, "identity": F.lit(1.0), "logit": mu * (1 - mu)}[link]


def variance(mu: Column, family: str, *, power: Column | float = 1.5, theta: float = 1.0) -> Column:
    if family == "gaussian":
        return F.lit(1.0)
    if family == "poisson":
        return mu
    if family == "gamma":
        return mu * mu
    if family == "tweedie":
        return F.pow(mu, power if isinstance(power, Column) else F.lit(float(power)))
    if family == "binomial":
        return mu * (1 - mu)
    if family == "negative_binomial":
        return mu + F.lit(float(theta)) * mu * mu
    raise ValueError(f"unknown family {family!r}; expected one of {FAMILIES}")


def _y_log(y: Column, ratio: Column) -> Column:
    """`y ln(ratio)`, 0 where y is 0."""
    return F.when(y > 0, y * F.ln(ratio)).otherwise(F.lit(0.0))


def unit_deviance(y, mu, family: str, *, power: Column | float = 1.5, theta: float = 1.0) -> Column:
    """A row's deviance for weight 1."""
    y, mu = col(y).cast("double"), col(mu).cast("double")
    if family == "gaussian":
        return (y - mu) * (y - mu)
    if family == "poisson":
        return 2 * (_y_log(y, y / mu) - (y - mu))
    if family == "gamma":
        return 2 * ((y - mu) / mu - F.ln(y / mu))
    if family == "tweedie":
        p = power if isinstance(power, Column) else F.lit(float(power))
        own = F.when(y > 0, F.pow(y, 2 - p)).otherwise(F.lit(0.0)) / ((1 - p) * (2 - p))
        return 2 * (own - y * F.pow(mu, 1 - p) / (1 - p) + F.pow(mu, 2 - p) / (2 - p))
    if family == "binomial":
        return 2 * (_y_log(y, y / mu) + _y_log(1 - y, (1 - y) / (1 - mu)))
    if family == "negative_binomial":
        t = float(theta)
        return 2 * (_y_log(y, y / mu) - (y + 1 / t) * F.ln((1 + t * y) / (1 + t * mu)))
    raise ValueError(f"unknown family {family!r}; expected one of {FAMILIES}")


def ln_factorial(n) -> Column:
    """ln(n!) of a whole number: from the factorial up to 20, from Stirling's series above."""
    n = col(n).cast("double")
    x = n + 1
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n <= 20, F.ln(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


#: Parameters of each loss template and their defaults; None must be given (fixed values).
LOSS_PARAMETERS: dict[str, dict[str, float | None]] = {
    "squared": {},
    "poisson": {},
    "gamma": {},
    "tweedie": {"power": None},
    "capped_gamma": {"cap": None},
    "huber": {"delta": None},
    "pseudo_huber": {"delta": None},
    "quantile": {"tau": None},
    "asymmetric_squared": {"w_over": 1.0, "w_under": 1.0},
    "asymmetric_poisson": {"w_over": 1.0, "w_under": 1.0},
    "focal_binomial": {"gamma": 2.0},
    "zero_inflated_poisson": {"pi": None},
}


def template_loss(name: str, y, f, params: Mapping[str, float] | None = None) -> Column:
    """A named loss of a response `y` and a score `f`.

    The score is on the log scale for the count and cost losses, the logit scale for
    `focal_binomial`, and the scale of the response for the others.
    """
    if name not in LOSS_PARAMETERS:
        raise ValueError(f"unknown loss {name!r}; expected one of {sorted(LOSS_PARAMETERS)}")
    given = {**LOSS_PARAMETERS[name], **(params or {})}
    unknown = set(given) - set(LOSS_PARAMETERS[name])
    missing = [k for k, v in given.items() if v is None]
    if unknown or missing:
        raise ValueError(f"loss {name!r}: unknown parameter(s) {sorted(unknown)}, missing {missing}")
    y, f = col(y).cast("double"), col(f).cast("double")
    error = y - f
    mu = F.exp(f)
    if name == "squared":
        return 0.5 * error * error
    if name == "poisson":
        return mu - y * f
    if name == "gamma":
        return y / mu + f
    if name == "tweedie":
        p = given["power"]
        return -y * F.exp((1 - p) * f) / (1 - p) + F.exp((2 - p) * f) / (2 - p)
    if name == "capped_gamma":
        cap = float(given["cap"])
        return F.when(y > cap, F.lit(cap)).otherwise(y) / mu + f
    if name == "huber":
        d = given["delta"]
        return F.when(F.abs(error) <= d, 0.5 * error * error).otherwise(d * (F.abs(error) - 0.5 * d))
    if name == "pseudo_huber":
        d = given["delta"]
        return d * d * (F.sqrt(1 + (error / d) * (error / d)) - 1)
    if name == "quantile":
        t = given["tau"]
        return F.when(error >= 0, t * error).otherwise((t - 1) * error)
    if name == "asymmetric_squared":
        return F.when(error < 0, given["w_over"] * error * error).otherwise(given["w_under"] * error * error) * 0.5
    if name == "asymmetric_poisson":
        return F.when(mu > y, F.lit(float(given["w_over"]))).otherwise(F.lit(float(given["w_under"]))) * (mu - y * f)
    if name == "focal_binomial":
        p = 1 / (1 + F.exp(-f))
        g = F.lit(float(given["gamma"]))
        return -(y * F.pow(1 - p, g) * F.ln(p) + (1 - y) * F.pow(p, g) * F.ln(1 - p))
    pi = given["pi"]
    return F.when(y == 0, -F.ln(pi + (1 - pi) * F.exp(-mu))).otherwise(-math.log(1 - pi) + mu - y * f + ln_factorial(y))


def weighted_metric(loss: Column, weight=None) -> Column:
    """A custom metric: the weighted mean of a loss, as an aggregate."""
    if weight is None:
        return F.avg(loss)
    w = col(weight).cast("double")
    return F.try_divide(F.sum(w * loss), F.sum(w))


def tweedie_log_density(phi: float, power: float):
    """UDF (y, mu) -> log density of the Tweedie family, 1 < power < 2.

    The series is summed in logs over a window around its largest term, at centre; d terms from there the logarithm is
    lower by (1 + shape) * d^2 / 2 / (centre + d / 3) at least, and terms that are lower by 45 are left out.
    """
    if not (phi > 0 and 1 < power < 2):
        raise ValueError("the Tweedie density needs phi > 0 and a power strictly between 1 and 2")
    shape = (2 - power) / (power - 1)
    near = 45 / (1 + shape)

    def series(y: np.ndarray) -> np.ndarray:
        centre = np.maximum(1.0, np.round(y ** (2 - power) / (phi * (2 - power))))
        out = np.empty_like(y)
        step = shape * np.log(y / (power - 1)) - (1 + shape) * np.log(phi) - np.log(2 - power)
        order = np.argsort(centre)
        for block in np.array_split(order, max(1, len(y) // 2048)):
            if not len(block):
                continue
            reach = int(near / 3 + math.sqrt(near * near / 9 + 2 * near * centre[block].max())) + 4
            j = centre[block][:, None] + np.arange(-reach, reach + 1)[None, :]
            valid = j >= 1
            safe = np.where(valid, j, 1.0)
            low, high = safe.min(), safe.max()
            if high - low < safe.size:
                # terms are numbered alike in all rows: their gammas are worked out once for a block
                number = np.arange(low, high + 1)
                gammas = (_lgamma(number + 1) + _lgamma(shape * number))[(safe - low).astype(np.int64)]
            else:
                gammas = _lgamma(safe + 1) + _lgamma(shape * safe)
            terms = np.where(valid, step[block][:, None] * safe - gammas, -np.inf)
            top = terms.max(axis=1)
            out[block] = top + np.log(np.exp(terms - top[:, None]).sum(axis=1))
        return out

    @F.pandas_udf("double")
    def density(y: pd.Series, mu: pd.Series) -> pd.Series:
        yv, m = y.to_numpy(float), mu.to_numpy(float)
        if (yv < 0).any() or (m <= 0).any():
            raise ValueError("the Tweedie density needs y >= 0 and mu > 0")
        out = -(m ** (2 - power)) / (phi * (2 - power))
        positive = yv > 0
        if positive.any():
            yp, mp = yv[positive], m[positive]
            out[positive] += -yp / (phi * (power - 1) * mp ** (power - 1)) - np.log(yp) + series(yp)
        return pd.Series(out)

    return density
