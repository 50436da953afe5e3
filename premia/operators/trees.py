"""Leaf-limited regression tree on one numeric column, grown best split first.

The rows are pooled once per distinct value with running totals; every split search is then one
aggregate over the pooled table, for both new leaves together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.operators.ordering import running_totals
from premia.session import cut_lineage


def tree_cuts(
    df: DataFrame, column: str, *, weight: str, target_total: str, leaves: int, min_rows: int = 1
) -> list[float]:
    """Split points, ascending, of a tree with at most `leaves` leaves.

    Each row weighs `weight` and its response is `target_total / weight` (for example claims over
    exposure). A split halves the gap between two neighbouring values.
    """
    usable = df.where(F.col(column).isNotNull() & F.col(target_total).isNotNull() & (F.col(weight) > 0)).select(
        F.col(column).cast("double").alias("v"), F.col(weight).cast("double").alias("w"), F.col(target_total).cast("double").alias("y")
    )
    usable = usable.where(~F.isnan("v") & ~F.isnan("y"))
    pooled = running_totals(usable, "v", {"w": F.col("w"), "y": F.col("y"), "n": F.lit(1)})
    pooled = cut_lineage(
        pooled.select(
            "v",
            (F.col("w") + F.col("w_before")).alias("w"),
            (F.col("y") + F.col("y_before")).alias("y"),
            (F.col("n") + F.col("n_before")).alias("n"),
        )
    )
    end = pooled.agg(F.max("w").alias("w"), F.max_by("y", "v").alias("y"), F.max("n").alias("n"), F.max("v").alias("v"), F.min("v").alias("a")).first()
    if end["n"] is None:
        return []
    # A leaf: totals before it and at its end, and its value range (after, upto].
    whole = {"after": None, "upto": end["v"], "w0": 0.0, "y0": 0.0, "n0": 0, "w1": end["w"], "y1": end["y"], "n1": end["n"]}
    open_leaves, cuts = [], []

    def search(candidates: list[dict]) -> None:
        aggs = []
        for i, leaf in enumerate(candidates):
            wl, yl, nl = F.col("w") - leaf["w0"], F.col("y") - leaf["y0"], F.col("n") - leaf["n0"]
            wr, yr, nr = F.lit(leaf["w1"]) - F.col("w"), F.lit(leaf["y1"]) - F.col("y"), F.lit(leaf["n1"]) - F.col("n")
            base = (leaf["y1"] - leaf["y0"]) ** 2 / (leaf["w1"] - leaf["w0"])
            gain = yl * yl / wl + yr * yr / wr - F.lit(base)
            inside = (F.col("v") < leaf["upto"]) & (nl >= min_rows) & (nr >= min_rows) & (wl > 0) & (wr > 0)
            if leaf["after"] is not None:
                inside = inside & (F.col("v") > leaf["after"])
            # Among equal gains the smallest value wins.
            aggs.append(F.max(F.when(inside, F.struct(gain.alias("gain"), (-F.col("v")).alias("minus_v"), "w", "y", "n"))).alias(f"s{i}"))
        row = pooled.agg(*aggs).first()
        for i, leaf in enumerate(candidates):
            best = row[f"s{i}"]
            if best is not None and best["gain"] > 1e-12 * max(1.0, abs(leaf["y1"])):
                open_leaves.append((best["gain"], leaf, {"v": -best["minus_v"], "w": best["w"], "y": best["y"], "n": best["n"]}))

    search([whole])
    while open_leaves and len(cuts) < leaves - 1:
        open_leaves.sort(key=lambda x: x[0])
        _, leaf, split = open_leaves.pop()
        cuts.append(split["v"])
        left = {**leaf, "upto": split["v"], "w1": split["w"], "y1": split["y"], "n1": split["n"]}
        right = {**leaf, "after": split["v"], "w0": split["w"], "y0": split["y"], "n0": split["n"]}
        if len(cuts) < leaves - 1:
            search([left, right])
    if not cuts:
        return []
    following = pooled.agg(*[F.min(F.when(F.col("v") > c, F.col("v"))).alias(f"f{i}") for i, c in enumerate(cuts)]).first()
    return sorted((c + following[f"f{i}"]) / 2 for i, c in enumerate(cuts))
