"""Profiles of a table and its one-way summaries, and comparison of two profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premia.functions.special import gamma_mean_interval, poisson_interval
from premia.operators.ingest import level_counts
from premia.operators.ordering import linear_quantiles, range_cuts, selection_ranges

QUANTILES = (0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99)
HISTOGRAM_BINS = 20
TOP_LEVELS = 20
MAX_ONE_WAY_LEVELS = 200
IDENTIFIER_ROWS = 200
IDENTIFIER_SHARE = 0.98
ORDINAL_LEVELS = 20
PSI_FLOOR = 1e-6
RATEABLE = ("categorical", "ordinal", "boolean")
MEASURES = ("exposure_years", "claim_count", "claim_amount_minor")


def semantic_type(name: str, dtype: T.DataType, distinct: int, rows: int) -> str:
    """What a column means, from its name, type and number of distinct values."""
    if name.lower().endswith("_minor"):
        return "money"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if rows >= IDENTIFIER_ROWS and distinct > 20 and distinct / rows >= IDENTIFIER_SHARE:
        return "identifier"
    if isinstance(dtype, T.NumericType):
        is_float = isinstance(dtype, (T.DoubleType, T.FloatType))
        return "ordinal" if not is_float and distinct <= ORDINAL_LEVELS else "continuous"
    return "categorical"


def _counts(c: str, i: int) -> list:
    return [F.count(c).alias(f"known_{i}"), F.count_distinct(c).alias(f"distinct_{i}")]


def _describe(df: DataFrame, columns: Sequence[str], row) -> list[dict]:
    return [
        {
            "column": c,
            "rows": row["n_rows"],
            "nulls": row["n_rows"] - row[f"known_{i}"],
            "distinct": row[f"distinct_{i}"],
            "semantic": semantic_type(c, df.schema[c].dataType, row[f"distinct_{i}"], row["n_rows"]),
        }
        for i, c in enumerate(columns)
    ]


def column_counts(df: DataFrame, columns: Sequence[str]) -> list[dict]:
    """Rows, nulls, distinct non-null values and semantic type per column, from one shuffle."""
    row = df.agg(F.count(F.lit(1)).alias("n_rows"), *[a for i, c in enumerate(columns) for a in _counts(c, i)]).first()
    return _describe(df, columns, row)


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: counts, semantic type, range, mean, deviation and seven exact quantiles.

    One aggregate gives the distinct counts and one the moments and approximate cuts (kept apart,
    since distinct counting expands rows); the exact quantiles order only the ranges they fall in.
    """
    columns = list(columns or df.columns)
    counts = column_counts(df, columns)
    numeric = [
        c["column"]
        for c in counts
        if isinstance(df.schema[c["column"]].dataType, T.NumericType) and c["semantic"] != "identifier" and c["rows"] > c["nulls"]
    ]
    moments = []
    for c, cuts in range_cuts(df, numeric, selection_ranges(df.sparkSession)).items():
        i, x = columns.index(c), F.col(c).cast("double")
        moments += [F.min(x).alias(f"min_{i}"), F.max(x).alias(f"max_{i}"), F.avg(x).alias(f"mean_{i}"), F.stddev_samp(x).alias(f"std_{i}"), cuts.alias(f"cuts_{i}")]
    row = df.agg(*moments).first() if moments else None
    quantiles = linear_quantiles(df, numeric, QUANTILES, {c: row[f"cuts_{columns.index(c)}"] for c in numeric}) if numeric else {}
    rows = []
    for i, c in enumerate(counts):
        name = c["column"]
        low, high, mean, std = ([row[f"{x}_{i}"] for x in ("min", "max", "mean", "std")]) if name in numeric else [None] * 4
        rows.append(
            (
                name,
                df.schema[name].dataType.simpleString(),
                c["semantic"],
                c["rows"],
                c["nulls"],
                c["nulls"] / c["rows"] if c["rows"] else 0.0,
                c["distinct"],
                low,
                high,
                mean,
                0.0 if std is None and name in numeric else std,
                *quantiles.get(name, [None] * len(QUANTILES)),
            )
        )
    schema = "column string, dtype string, semantic_type string, n_rows long, null_count long, null_rate double, distinct_count long"
    schema += ", minimum double, maximum double, mean double, std double"
    schema += "".join(f", p{round(q * 100)} double" for q in QUANTILES)
    return df.sparkSession.createDataFrame(rows, schema)


def candidate_rating_columns(counts: Sequence[Mapping], measures: Sequence[str] = MEASURES) -> list[str]:
    """Columns worth a one-way: level-like, not a measure, not too many levels."""
    return [
        c["column"]
        for c in counts
        if c["semantic"] in RATEABLE and c["column"] not in measures and c["distinct"] <= MAX_ONE_WAY_LEVELS
    ]


def histograms(df: DataFrame, columns: Sequence[str], exposure: str | None = None) -> DataFrame:
    """Equal-width bins of several columns in two passes: (column, bin, low, high, n, exposure).

    The last bin is closed, empty bins are kept, and a constant column is one bin of width one.
    """
    ranges = df.agg(
        *[f(F.col(c).cast("double")).alias(f"{x}{i}") for i, c in enumerate(columns) for x, f in (("a", F.min), ("b", F.max))]
    ).first()
    entries, frame = [], []
    for i, c in enumerate(columns):
        low, high = ranges[f"a{i}"], ranges[f"b{i}"]
        if low is None:
            continue
        bins = HISTOGRAM_BINS if high > low else 1
        width = (high - low) / bins if high > low else 1.0
        position = F.least(F.greatest(F.floor((F.col(c).cast("double") - low) / width), F.lit(0)), F.lit(bins - 1))
        # `least` skips nulls, so a null value is kept out of the bins by hand.
        entries.append(F.struct(F.lit(c).alias("column"), F.when(F.col(c).isNotNull(), position.cast("int")).alias("bin")))
        for b in range(bins):
            frame.append((c, b, low + width * b, high if b == bins - 1 and high > low else low + width * (b + 1)))
    weight = F.col(exposure).cast("double") if exposure else F.lit(None).cast("double")
    counted = (
        df.select(weight.alias("w"), F.inline(F.array(*entries)))
        .where("bin is not null")
        .groupBy("column", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    )
    edges = df.sparkSession.createDataFrame(frame, "column string, bin int, low double, high double")
    joined = edges.join(F.broadcast(counted) if len(frame) < 50_000 else counted, ["column", "bin"], "left")
    out = joined.select("column", "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w", F.lit(0.0)).alias("exposure"))
    return out if exposure else out.drop("exposure")


def top_levels(df: DataFrame, columns: Sequence[str], exposure: str | None = None, k: int = TOP_LEVELS) -> DataFrame:
    """The `k` most frequent levels of each column: ties by level, null last and a level of its own.

    Levels order as text. Levels are pooled first; per column only the best `k` of each shuffle
    partition move on, so a column with very many levels is not ranked in one task.
    """
    from pyspark.sql import Window

    counts = level_counts(df, columns, exposure)
    best = [F.col("n").desc(), F.col("level").asc_nulls_last()]
    spread = counts.withColumn("__part", F.pmod(F.xxhash64("level"), F.lit(64)))
    local = spread.withColumn("__r", F.row_number().over(Window.partitionBy("column", "__part").orderBy(*best))).where(F.col("__r") <= k)
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*best))).where(F.col("rank") <= k)
    out = ranked.select("column", "rank", "level", "n", *([F.round("weight", 6).alias("exposure_years")] if exposure else []))
    return out


def _one_way_ratios(df: DataFrame, confidence: float | None) -> DataFrame:
    exposure, claims, amount = F.col("exposure_years"), F.col("claim_count"), F.col("claim_amount_minor")
    out = df.withColumns(
        {
            "frequency": F.when(exposure > 0, claims / exposure),
            "mean_severity": F.when(claims != 0, amount / claims),
            "mean_burning_cost": F.when(exposure > 0, amount / exposure),
        }
    )
    if confidence is not None:
        out = out.withColumn("__f", poisson_interval(confidence)("claim_count", "exposure_years"))
        out = out.withColumn("__s", gamma_mean_interval(confidence)("claim_amount_minor", "claim_count"))
        out = out.withColumns(
            {
                "frequency_low": F.when(exposure > 0, F.col("__f.low")),
                "frequency_high": F.when(exposure > 0, F.col("__f.high")),
                "severity_low": F.nanvl("__s.low", F.lit(None).cast("double")),
                "severity_high": F.nanvl("__s.high", F.lit(None).cast("double")),
            }
        ).drop("__f", "__s")
    return out


def _measures(exposure: str | None, claims: str | None, amount: str | None):
    return [
        (F.coalesce(F.round(F.sum(F.col(exposure).cast("double")), 6), F.lit(0.0)) if exposure else F.lit(0.0)).alias("exposure_years"),
        (F.coalesce(F.sum(F.col(claims).cast("long")), F.lit(0)) if claims else F.lit(0).cast("long")).alias("claim_count"),
        (F.coalesce(F.sum(F.col(amount).cast("long")), F.lit(0)) if amount else F.lit(0).cast("long")).alias("claim_amount_minor"),
    ]


def one_way(
    df: DataFrame,
    column: str,
    *,
    exposure: str = "exposure_years",
    claims: str = "claim_count",
    amount: str = "claim_amount_minor",
    confidence: float | None = None,
) -> DataFrame:
    """Exposure, claims, amount, frequency, severity and burning cost by level (null is a level).

    With `confidence`, the exact Poisson and Gamma intervals are added; they are computed on the
    level rows, after the aggregation. Ratios use the exposure as stored, at six places.
    """
    have = lambda c: c if c in df.columns else None
    grouped = df.groupBy(F.col(column).alias("level")).agg(*_measures(have(exposure), have(claims), have(amount)))
    return _one_way_ratios(grouped, confidence)


def one_ways(df: DataFrame, columns: Sequence[str], confidence: float | None = None) -> DataFrame:
    """One-ways of several columns in one shuffle: (factor, level, ...)."""
    entries = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("string").alias("level")) for c in columns])
    melted = df.select(*MEASURES, F.inline(entries))
    return _one_way_ratios(melted.groupBy("factor", "level").agg(*_measures(*MEASURES)), confidence)


def psi(current: DataFrame, reference: DataFrame, keys: Sequence[str] = ("column",), weight: str = "n") -> DataFrame:
    """Population stability index per `keys` of two (keys, level, weight) tables.

    Shares are floored at 1e-6; the null level is left out; null where either side has no weight.
    """
    return psi_by(current, reference, keys, {"psi": weight})


def psi_by(current: DataFrame, reference: DataFrame, keys: Sequence[str], weights: Mapping[str, str]) -> DataFrame:
    """`psi` for several weights at once: (keys, every name in `weights`).

    Both sides meet in one aggregate. Totals are an aggregate joined back, so a column with very many levels stays
    spread out.
    """

    def side(df: DataFrame, own: str, other: str) -> DataFrame:
        mine = [F.col(w).cast("double").alias(f"{own}_{n}") for n, w in weights.items()]
        return df.where(F.col("level").isNotNull()).select(*keys, "level", *mine, *[F.lit(0.0).alias(f"{other}_{n}") for n in weights])

    sums = [f"{s}_{n}" for n in weights for s in ("a", "b")]
    both = side(current, "a", "b").unionByName(side(reference, "b", "a")).groupBy(*keys, "level").agg(*[F.sum(c).alias(c) for c in sums])
    totals = both.groupBy(*keys).agg(*[F.sum(c).alias(f"t_{c}") for c in sums])
    return both.join(totals, list(keys)).groupBy(*keys).agg(*[_psi_sum(f"a_{n}", f"b_{n}").alias(n) for n in weights])


def _psi_sum(a: str, b: str) -> Column:
    """The index over level weights `a` and `b` with their totals in `t_a` and `t_b`."""
    x, y = [F.greatest(F.coalesce(F.try_divide(c, f"t_{c}"), F.lit(0.0)), F.lit(PSI_FLOOR)) for c in (a, b)]
    return F.sum(F.when((F.col(f"t_{a}") != 0) & (F.col(f"t_{b}") != 0), (x - y) * F.ln(x / y)))


def level_changes(current: DataFrame, reference: DataFrame) -> DataFrame:
    """(column, level, change): levels on one side only; the null level is neither new nor vanished."""
    a = current.where("level is not null").select("column", "level")
    b = reference.where("level is not null").select("column", "level")
    new = a.join(b, ["column", "level"], "left_anti").withColumn("change", F.lit("new"))
    gone = b.join(a, ["column", "level"], "left_anti").withColumn("change", F.lit("vanished"))
    return new.unionAll(gone)


def compare_profiles(current: DataFrame, reference: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: PSI over all levels, mean and null-rate shift, level changes, row-count ratio.

    Both versions are pooled to (column, level) in one aggregate; everything else follows from its rows.
    """

    def melted(df: DataFrame, now: bool) -> DataFrame:
        entries = [
            F.struct(
                F.lit(c).alias("column"),
                F.col(c).cast("string").alias("level"),
                (F.col(c) if isinstance(df.schema[c].dataType, T.NumericType) else F.lit(None)).cast("double").alias("x"),
            )
            for c in columns
        ]
        return df.select(F.lit(now).alias("now"), F.inline(F.array(*entries)))

    now, known = F.col("now"), F.col("level").isNotNull()
    levels = melted(current, True).unionAll(melted(reference, False)).groupBy("column", "level").agg(
        F.count(F.when(now, 1)).alias("a"), F.count(F.when(~now, 1)).alias("b"),
        F.sum(F.when(now, F.col("x"))).alias("x_a"), F.sum(F.when(~now, F.col("x"))).alias("x_b"),
    )
    totals = levels.groupBy("column").agg(
        *[F.sum(s).alias(f"rows_{s}") for s in ("a", "b")],
        *[F.coalesce(F.sum(F.when(known, F.col(s))), F.lit(0)).alias(f"t_{s}") for s in ("a", "b")],
        *[F.sum(f"x_{s}").alias(f"sum_{s}") for s in ("a", "b")],
    )
    # One row a column, so its size is that of the list of columns. The null level weighs nothing on both sides.
    pooled = levels.withColumns({s: F.when(known, F.col(s)) for s in ("a", "b")}).join(F.broadcast(totals), "column")
    kept = [c for c in totals.columns if c != "column"]
    out = pooled.groupBy("column").agg(
        _psi_sum("a", "b").alias("psi"),
        F.count(F.when(F.col("b") == 0, 1)).alias("new_levels"),
        F.count(F.when(F.col("a") == 0, 1)).alias("vanished_levels"),
        *[F.max(c).alias(c) for c in kept],
    )
    shift = lambda of: F.try_divide(*of("a")) - F.try_divide(*of("b"))
    return out.select(
        "column",
        "psi",
        shift(lambda s: (F.col(f"sum_{s}"), F.col(f"t_{s}"))).alias("mean_shift"),
        shift(lambda s: (F.col(f"rows_{s}") - F.col(f"t_{s}"), F.col(f"rows_{s}"))).alias("null_rate_shift"),
        "new_levels",
        "vanished_levels",
        F.try_divide("rows_a", "rows_b").alias("row_count_ratio"),
    )
