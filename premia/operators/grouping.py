"""Groupings: merging the levels of a categorical column.

Spark reduces the rows to one row per level; the merge itself works on those level rows, whose
mapping is the artifact that comes back.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.functions.special import chi2_tail, normal_ppf
from premia.operators.profile import one_way

METHODS = ("manual", "credibility_weighted", "hierarchical_clustering", "tree", "reference_hierarchy")
UNSEEN = ("error", "map_to_default", "map_to_base")
MERGE_TOLERANCE = 0.05


class GroupingError(ValueError):
    """A grouping that cannot be proposed or applied."""


@dataclass(frozen=True)
class Grouping:
    slug: str
    column: str
    mapping: Mapping[str, str]
    unseen: str = "error"
    default: str | None = None
    base: str | None = None


@dataclass(frozen=True)
class Level:
    name: str
    exposure: float
    claims: int

    @property
    def rate(self) -> float | None:
        return self.claims / self.exposure if self.exposure > 0 else None


def full_credibility_claims(p: float, k: float) -> float:
    """Claims at which a Poisson rate is within a share `k` with probability `p`."""
    return (normal_ppf((1 + p) / 2) / k) ** 2


def buhlmann_straub(levels: Sequence[Level]) -> dict[str, float]:
    """Expected process variance, variance of hypothetical means and their ratio `k`.

    One observed frequency per level; a Poisson count makes the process variance the mean rate.
    A variance between levels that is not positive is refused, not clamped.
    """
    rated = [x for x in levels if x.exposure > 0]
    if len(rated) < 2:
        raise GroupingError("at least two levels with exposure are needed to separate the variances")
    total = math.fsum(x.exposure for x in rated)
    mean = math.fsum(x.claims for x in rated) / total
    if mean <= 0:
        raise GroupingError("no claims: the process variance is zero")
    spread = math.fsum(x.exposure * (x.rate - mean) ** 2 for x in rated)
    scale = total - math.fsum(x.exposure**2 for x in rated) / total
    if scale <= 0:
        raise GroupingError("one level holds all exposure: nothing lies between levels")
    between = (spread - (len(rated) - 1) * mean) / scale
    if between <= 0:
        raise GroupingError("levels differ no more than Poisson noise: the credibility constant is unbounded")
    return {"evpv": mean, "vhm": between, "k": mean / between}


def shrunk_rates(levels: Sequence[Level], model: str, *, p: float = 0.90, k: float = 0.05, standard: float | None = None) -> dict[str, float]:
    """Each level's frequency pulled towards the portfolio's by its credibility."""
    if model == "buhlmann_straub":
        parts = buhlmann_straub(levels)
        mean = parts["evpv"]
        weight = {x.name: x.exposure / (x.exposure + parts["k"]) for x in levels}
    elif model == "limited_fluctuation":
        full = full_credibility_claims(p, k) if standard is None else standard
        exposure = math.fsum(x.exposure for x in levels)
        mean = sum(x.claims for x in levels) / exposure if exposure > 0 else 0.0
        weight = {x.name: math.sqrt(min(x.claims / full, 1.0)) if full > 0 else 1.0 for x in levels}
    else:
        raise GroupingError(f"unknown credibility model {model!r}")
    return {x.name: mean if x.rate is None else weight[x.name] * x.rate + (1 - weight[x.name]) * mean for x in levels}


def _sweep(levels: Sequence[Level], rates: Mapping[str, float], tolerance: float) -> list[list[Level]]:
    clusters: list[list[Level]] = []
    anchor = 0.0
    for level in sorted(levels, key=lambda x: rates[x.name]):
        rate = rates[level.name]
        near = clusters and anchor > 0 and abs(rate - anchor) <= tolerance * anchor
        if near:
            clusters[-1].append(level)
        else:
            clusters.append([level])
            anchor = rate
    return clusters


def _rated(levels: Sequence[Level]) -> tuple[list[Level], list[Level]]:
    rated = sorted((x for x in levels if x.rate is not None), key=lambda x: x.rate)
    if not rated:
        raise GroupingError("no level carries exposure, so there are no rates to group on")
    return rated, [x for x in levels if x.rate is None]


def _ward(levels: Sequence[Level], groups: int) -> list[list[Level]]:
    """Ward clustering of rates weighted by exposure share, in whole percents of at least one.

    On a line, Ward's cheapest merge is always between neighbours.
    """
    rated, idle = _rated(levels)
    total = math.fsum(x.exposure for x in rated) or 1.0
    centres = [x.rate for x in rated]
    sizes = [float(max(1, round(100 * x.exposure / total))) for x in rated]
    members = [[x] for x in rated]

    def cost(i: int) -> float:
        return sizes[i] * sizes[i + 1] / (sizes[i] + sizes[i + 1]) * (centres[i] - centres[i + 1]) ** 2

    costs = [cost(i) for i in range(len(members) - 1)]
    while len(members) > max(1, groups):
        i = costs.index(min(costs))
        joint = sizes[i] + sizes[i + 1]
        centres[i] = (centres[i] * sizes[i] + centres[i + 1] * sizes[i + 1]) / joint
        sizes[i] = joint
        members[i] += members[i + 1]
        del centres[i + 1], sizes[i + 1], members[i + 1], costs[i]
        if i > 0:
            costs[i - 1] = cost(i - 1)
        if i < len(costs):
            costs[i] = cost(i)
    return _with_idle(members, idle)


def _tree(levels: Sequence[Level], groups: int, min_levels: int) -> list[list[Level]]:
    """Best-first splits of the sorted rates by exposure-weighted squared error."""
    rated, idle = _rated(levels)
    w = [x.exposure for x in rated]
    wy = [x.exposure * x.rate for x in rated]
    pw, py = [0.0], [0.0]
    for a, b in zip(w, wy):
        pw.append(pw[-1] + a)
        py.append(py[-1] + b)

    def best(a: int, b: int):
        whole = (py[b] - py[a]) ** 2 / (pw[b] - pw[a])
        found = None
        for m in range(a + min_levels, b - min_levels + 1):
            if m <= a or m >= b or rated[m - 1].rate == rated[m].rate:
                continue
            gain = (py[m] - py[a]) ** 2 / (pw[m] - pw[a]) + (py[b] - py[m]) ** 2 / (pw[b] - pw[m]) - whole
            if found is None or gain > found[0]:
                found = (gain, m)
        return found

    leaves = [(0, len(rated))]
    options = {(0, len(rated)): best(0, len(rated))}
    while len(leaves) < groups:
        ready = [(options[x][0], x) for x in leaves if options[x] and options[x][0] > 0]
        if not ready:
            break
        _, leaf = max(ready, key=lambda t: (t[0], -t[1][0]))
        m = options[leaf][1]
        leaves.remove(leaf)
        for child in ((leaf[0], m), (m, leaf[1])):
            leaves.append(child)
            options[child] = best(*child)
    return _with_idle([rated[a:b] for a, b in sorted(leaves)], idle)


def _with_idle(clusters: list[list[Level]], idle: Sequence[Level]) -> list[list[Level]]:
    """Levels without exposure have no rate: they join the cluster with the most exposure."""
    if idle:
        clusters[largest(clusters)].extend(idle)
    return clusters


def largest(clusters: Sequence[Sequence[Level]]) -> int:
    return max(range(len(clusters)), key=lambda i: math.fsum(x.exposure for x in clusters[i]))


def level_rows(df: DataFrame, column: str) -> list[Level]:
    """One row per level: the size of the factor, not of the table."""
    rows = one_way(df, column).select(F.col("level").cast("string").alias("level"), "exposure_years", "claim_count").collect()
    return sorted((Level(str(r["level"]), r["exposure_years"], r["claim_count"]) for r in rows), key=lambda x: x.name)


def propose_grouping(
    df: DataFrame,
    column: str,
    method: str,
    *,
    slug: str | None = None,
    n_groups: int = 5,
    credibility: str = "limited_fluctuation",
    p: float = 0.90,
    k: float = 0.05,
    tolerance: float = MERGE_TOLERANCE,
    min_levels: int = 1,
    unseen: str = "error",
) -> Grouping:
    """An editable mapping of levels to groups `G1`, `G2`, ... in rate order."""
    if method not in METHODS or method in ("manual", "reference_hierarchy"):
        raise GroupingError(f"{method!r} proposes nothing from the data")
    if column not in df.columns:
        raise GroupingError(f"cannot group {column!r}: no such column")
    levels = level_rows(df, column)
    if not levels:
        raise GroupingError(f"{column!r} has no observed levels")
    if method == "credibility_weighted":
        clusters = _sweep(levels, shrunk_rates(levels, credibility, p=p, k=k), tolerance)
    elif method == "hierarchical_clustering":
        clusters = _ward(levels, n_groups)
    else:
        clusters = _tree(levels, n_groups, min_levels)
    mapping = {x.name: f"G{i + 1}" for i, cluster in enumerate(clusters) for x in cluster}
    default = f"G{largest(clusters) + 1}" if unseen == "map_to_default" else None
    return Grouping(slug or column, column, mapping, unseen, default)


def group_by_hierarchy(df: DataFrame, column: str, hierarchy: DataFrame, *, level: str, parent: str, name: str) -> DataFrame:
    """Roll levels up through a reference hierarchy given as a table (level -> parent); a level has one parent."""
    up = hierarchy.select(F.col(level).alias(column), F.col(parent).alias(name)).distinct()
    torn = up.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
    if torn:
        raise GroupingError(f"levels with more than one parent, for example {[r[column] for r in torn]}")
    return df.join(up, column, "left")


def mapping_frame(df: DataFrame, grouping: Grouping) -> DataFrame:
    return df.sparkSession.createDataFrame(sorted(grouping.mapping.items()), "__level string, __group string")


def apply_grouping(df: DataFrame, grouping: Grouping, name: str | None = None) -> DataFrame:
    """`df` plus the group of each row's level.

    A null level is an error; an unseen level follows the declared behaviour. The mapping is a
    driver-side artifact, so it is broadcast.
    """
    name = name or f"{grouping.slug}_group"
    lookup = F.broadcast(mapping_frame(df, grouping))
    value = F.col(grouping.column).cast("string")
    joined = df.join(lookup, value == F.col("__level"), "left")
    missing = F.raise_error(F.lit(f"grouping {grouping.slug}: null value in {grouping.column}"))
    if grouping.unseen == "error":
        other: Column = F.raise_error(F.concat(F.lit(f"grouping {grouping.slug}: unseen level "), value))
    else:
        target = grouping.default if grouping.unseen == "map_to_default" else grouping.base
        if target is None:
            raise GroupingError(f"{grouping.unseen!r} names no group")
        other = F.lit(target)
    group = F.when(value.isNull(), missing).when(F.col("__group").isNull(), other).otherwise(F.col("__group"))
    return joined.withColumn(name, group).drop("__level", "__group")


def poisson_deviance_by(df: DataFrame, column: str, *, exposure: str = "exposure_years", claims: str = "claim_count") -> DataFrame:
    """Row-level Poisson deviance against the mean rate of each row's level: (levels, deviance).

    The rate is constant within a level, so each level's rows reduce to four sums and no rate is
    joined back to the rows.
    """
    e, y = F.col(exposure).cast("double"), F.col(claims).cast("double")
    counts = e > 0
    cells = df.groupBy(column).agg(
        F.sum(e).alias("E"),
        F.sum(y).alias("Y"),
        F.sum(F.when(counts, e)).alias("ep"),
        F.sum(F.when(counts, y)).alias("yp"),
        F.sum(F.when(counts & (y > 0), y * F.ln(y / e))).alias("s"),
    )
    rate = F.when(F.col("E") > 0, F.col("Y") / F.col("E"))
    term = F.coalesce("s", F.lit(0.0)) - F.col("yp") * F.ln(rate) - F.col("yp") + rate * F.col("ep")
    return cells.agg(
        F.count(F.lit(1)).alias("levels"), (2 * F.sum(F.when(rate > 0, term))).alias("deviance")
    )


def grouping_evidence(df: DataFrame, grouping: Grouping, credibility: str | None = None) -> dict:
    """What the merge costs: deviance before and after, degrees of freedom saved, p-value."""
    before = poisson_deviance_by(df, grouping.column).first()
    after = poisson_deviance_by(apply_grouping(df, grouping, "__g"), "__g").first()
    saved = max(before["levels"] - after["levels"], 0)
    change = None if None in (before["deviance"], after["deviance"]) else after["deviance"] - before["deviance"]
    return {
        "source_levels": before["levels"],
        "target_levels": after["levels"],
        "deviance_before": before["deviance"],
        "deviance_after": after["deviance"],
        "df_saved": saved,
        "p_value": chi2_tail(change, saved) if change is not None and change >= 0 and saved > 0 else None,
        "credibility": buhlmann_straub(level_rows(df, grouping.column)) if credibility == "buhlmann_straub" else None,
    }
