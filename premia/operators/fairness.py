"""How far rating factors stand in for protected classes, from class shares of a reference table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premia.operators.ordering import running_totals
from premia.session import cut_lineage, small

SHARE_TOLERANCE = 1e-6


class ProxyError(ValueError):
    """Shares or exposures an assessment cannot use."""


def check_reference(reference: DataFrame, key: str, classes: Sequence[str]) -> None:
    """Shares must be numbers in [0, 1] adding up to 1 per key, and keys unique."""
    if not classes or len(set(classes)) != len(classes):
        raise ProxyError("classes must be given, each once")
    missing = [c for c in [key, *classes] if c not in reference.columns]
    if missing:
        raise ProxyError(f"reference has no column {missing}")
    if any(not isinstance(reference.schema[c].dataType, T.NumericType) for c in classes):
        raise ProxyError("share columns must be numeric")
    total, bad = F.lit(0.0), F.lit(False)
    for c in classes:
        x = F.col(c).cast("double")
        total = total + x
        bad = bad | x.isNull() | F.isnan(x) | (x < 0) | (x > 1)
    row = reference.agg(F.count(F.when(bad, 1)).alias("bad"), F.count(F.when(F.abs(total - 1) > SHARE_TOLERANCE, 1)).alias("off")).first()
    if row["bad"] or row["off"]:
        raise ProxyError(f"{row['bad']} row(s) with a share outside [0, 1], {row['off']} not adding up to 1")
    if reference.groupBy(key).count().where("count > 1").limit(1).count():
        raise ProxyError("the reference key repeats")


def assess_proxies(
    df: DataFrame, factors: Sequence[str], reference: DataFrame, *, key: str, reference_key: str, classes: Sequence[str], exposure: str = "exposure_years"
) -> tuple[DataFrame, DataFrame]:
    """(per factor: mutual information in bits, normalised; per factor and class: AUC) and coverage.

    Returns (measures, coverage): measures has one row per factor and class. Rows whose key is not
    in the reference count in the coverage only. The book is read once, into one table of totals by
    key, factor and level, from whose margins all measures come; that table is written, and its
    size does not depend on the rows.
    """
    check_reference(reference, reference_key, classes)
    weight = F.col(exposure).cast("double")
    bad = weight.isNull() | F.isnan(weight) | (weight < 0) | (weight == float("inf"))
    melted = F.array(*[F.struct(F.lit(f).alias("factor"), F.coalesce(F.col(f).cast("string"), F.lit("(null)")).alias("level")) for f in factors])
    totals = df.select(F.col(key).alias("__key"), weight.alias("__w"), bad.alias("__bad"), F.inline(melted)).groupBy("__key", "factor", "level")
    totals = cut_lineage(totals.agg(F.sum("__w").alias("__w"), F.count(F.lit(1)).alias("__n"), F.max("__bad").alias("__bad")))
    if totals.where("__bad").limit(1).count():
        raise ProxyError("exposures must be finite, not null and not negative")
    shares = small(reference.select(F.col(reference_key).alias("__key"), *[F.col(c).cast("double").alias(c) for c in classes]))
    joined = totals.join(shares, "__key", "left")
    matched = F.col(classes[0]).isNotNull()
    coverage = joined.where(F.col("factor") == factors[0]).agg(
        F.sum(F.when(matched, F.col("__n"))).alias("matched_rows"), F.sum(F.when(matched, F.col("__w"))).alias("matched_exposure"), F.sum("__w").alias("total_exposure")
    ).withColumn("coverage", F.when(F.col("total_exposure") > 0, F.coalesce("matched_exposure", F.lit(0.0)) / F.col("total_exposure")).otherwise(0.0))

    entries = F.array(*[F.struct(F.lit(c).alias("class"), (F.col("__w") * F.col(c)).alias("x")) for c in classes])
    cells = cut_lineage(joined.where(matched).select("factor", "level", F.inline(entries)).groupBy("factor", "level", "class").agg(F.sum("x").alias("x")))
    by = lambda *c: Window.partitionBy(*c)
    level_total = cells.groupBy("factor", "level").agg(F.sum("x").alias("lt"))
    class_total = cells.groupBy("factor", "class").agg(F.sum("x").alias("ct"))
    class_total = class_total.withColumn("t", F.sum("ct").over(by("factor")))
    joint = cells.join(level_total, ["factor", "level"]).join(class_total, ["factor", "class"])
    p, outer = F.col("x") / F.col("t"), (F.col("lt") / F.col("t")) * (F.col("ct") / F.col("t"))
    information = joint.groupBy("factor").agg(F.sum(F.when(F.col("x") > 0, p * F.log2(p / outer))).alias("mi"))
    q = F.col("ct") / F.col("t")
    entropy = class_total.groupBy("factor").agg((-F.sum(F.when(F.col("ct") > 0, q * F.log2(q)))).alias("entropy"))
    information = information.join(entropy, "factor").select(
        "factor", F.greatest("mi", F.lit(0.0)).alias("mutual_information_bits"), F.when(F.col("entropy") > 0, F.greatest("mi", F.lit(0.0)) / F.col("entropy")).alias("normalised_mutual_information")
    )
    scored = joint.where("lt > 0").select("factor", "class", (F.col("x") / F.col("lt")).alias("score"), F.col("x").alias("pos"), (F.col("lt") - F.col("x")).alias("neg"))
    steps = running_totals(scored, "score", {"pos": F.col("pos"), "neg": F.col("neg")}, within=["factor", "class"])
    area = steps.groupBy("factor", "class").agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("a"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    auc = area.select(
        "factor", "class", F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.least(F.greatest(F.col("a") / (F.col("pos") * F.col("neg")), F.lit(0.0)), F.lit(1.0))).alias("auc")
    )
    return information.join(auc, "factor"), coverage


def outcome_disparity(df: DataFrame, groups: DataFrame, *, key: str, group: str, change: str, exposure: str) -> DataFrame:
    """Mean proposed change by group against the portfolio's: (group, policies, mean, gap)."""
    joined = df.join(small(groups), key, "left")
    by_group = joined.groupBy(F.col(group).alias("group")).agg(
        F.count(F.lit(1)).alias("policies"), F.sum(F.col(change) * F.col(exposure)).alias("x"), F.sum(exposure).alias("e")
    )
    whole = Window.partitionBy(F.lit(1))  # over one row per group
    mean = F.col("x") / F.col("e")
    return by_group.select("group", "policies", mean.alias("mean_change_pct"), (mean - F.sum("x").over(whole) / F.sum("e").over(whole)).alias("gap_pct"))
