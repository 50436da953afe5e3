"""Global order without a global sort.

Ranks, quantiles and running totals over a whole table would need one task to see every row.
Here a column is first cut into many value ranges with approximate quantiles, ranges are
totalled (a map-side aggregate), and only what is needed inside a range is ordered. Equal
values are pooled before they are ordered, so a value held by a third of all rows is one row.
All results are exact: the approximate cuts only decide where the work is split.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premia.session import shuffle_buckets


def numeric_key(df: DataFrame, name: str) -> Column:
    """A double that orders as the column does (ties allowed)."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.DateType):
        return F.unix_date(F.col(name)).cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(F.col(name)).cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return F.col(name).cast("double")
    raise TypeError(f"column {name!r} of type {dtype.simpleString()} has no numeric order")


def selection_ranges(spark) -> int:
    """Ranges for picking values: more of them mean fewer rows to order, at the price of small totals."""
    return max(256, shuffle_buckets(spark))


def range_cuts(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> dict[str, Column]:
    """One aggregate per column that finds approximate cuts of its values into equal shares."""
    n = buckets or shuffle_buckets(df.sparkSession)
    probs = F.array(*[F.lit(i / n) for i in range(1, n)])
    return {c: F.percentile_approx(numeric_key(df, c), probs, F.lit(max(100, 10 * n))) for c in columns}


def with_ranges(
    df: DataFrame, columns: Sequence[str], buckets: int | None = None, cuts: Mapping[str, Sequence[float]] | None = None
) -> tuple[DataFrame, dict[str, str]]:
    """`df` plus one range number per column; the mapping names the added columns.

    One small aggregate finds the cuts unless they are given. Nulls get a null range.
    """
    keys = {c: f"__key_{i}" for i, c in enumerate(columns)}
    names = {c: f"__range_{i}" for i, c in enumerate(columns)}
    if cuts is None:
        row = df.agg(*[e.alias(keys[c]) for c, e in range_cuts(df, columns, buckets).items()]).first()
        cuts = {c: row[keys[c]] or [] for c in columns}
    keyed = df.withColumns({keys[c]: numeric_key(df, c) for c in columns})
    out = keyed
    for c in columns:
        inner = sorted({float(v) for v in cuts[c] or [] if v is not None and math.isfinite(v)})
        splits = [-math.inf, *inner, math.inf]
        if len(splits) < 3:
            out = out.withColumn(names[c], F.when(F.col(keys[c]).isNotNull(), F.lit(0)))
            continue
        known = Bucketizer(splits=splits, inputCol=keys[c], outputCol=names[c], handleInvalid="keep")
        out = known.transform(out)
        out = out.withColumn(names[c], F.when(F.col(keys[c]).isNotNull(), F.col(names[c]).cast("int")))
    return out.drop(*keys.values()), names


def running_totals(
    df: DataFrame,
    order: str,
    sums: Mapping[str, Column],
    *,
    within: Sequence[str] = (),
    maxima: Mapping[str, Column] | None = None,
    xors: Mapping[str, Column] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """One row per distinct (`within`, `order`) value with its totals and the totals before it.

    Result columns: `within`, `order`, every name in `sums`, `maxima` and `xors`, and
    `<name>_before` (sum and xor: 0 where nothing precedes; max: null). Null order values come
    first, as their own pool.
    """
    maxima, xors = dict(maxima or {}), dict(xors or {})
    zeroed = {**{n: F.sum for n in sums}, **{n: F.bit_xor for n in xors}}
    ranged, names = with_ranges(df, [order], buckets)
    rng, head = "__range", "__head"
    ranged = ranged.withColumn(rng, F.coalesce(F.col(names[order]), F.lit(-1))).drop(names[order])
    aggs = [f(e).alias(n) for f, group in ((F.sum, sums), (F.bit_xor, xors), (F.max, maxima)) for n, e in group.items()]
    pooled = ranged.groupBy(*within, rng, order).agg(*aggs)

    # One extra row per range carries the totals of all ranges before it and is ordered first, so
    # a single window gives totals over the whole group and nothing is joined back.
    merge = {**zeroed, **{n: F.max for n in maxima}}
    across = Window.partitionBy(*within).orderBy(rng).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        pooled.groupBy(*within, rng)
        .agg(*[f(n).alias(n) for n, f in merge.items()])
        .select(*within, rng, F.lit(None).cast(df.schema[order].dataType).alias(order), *[f(n).over(across).alias(n) for n, f in merge.items()], F.lit(True).alias(head))
    )
    both = pooled.select(*within, rng, order, *merge, F.lit(False).alias(head)).unionAll(carried)
    inside = (
        Window.partitionBy(*within, rng).orderBy(F.col(head).desc(), F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    )
    before = {n: F.coalesce(f(n).over(inside), F.lit(0)) for n, f in zeroed.items()} | {n: F.max(n).over(inside) for n in maxima}
    stepped = both.select(*within, order, *merge, *[e.alias(f"{n}_before") for n, e in before.items()], head)
    return stepped.where(~F.col(head)).drop(head)


def first_reaching(
    df: DataFrame,
    targets: Mapping[str, Callable[[Decimal], Sequence]],
    *,
    weight: Column | None = None,
    buckets: int | None = None,
) -> tuple[dict[str, list], dict[str, Decimal]]:
    """Per column, the first values whose cumulative weight reaches each target, and the total weight.

    `targets[column](total)` lists cumulative weights. Three jobs for all columns together: the
    cuts, one total per range, and the rows of the few ranges that hold a target. Only ranges'
    totals and the selected values reach the driver. `weight` defaults to one per row and must be
    exact (integer or decimal).
    """
    found, totals = _reach(df, targets, weight, buckets)
    return {c: [f and f[0] for f in values] for c, values in found.items()}, totals


def _reach(df, targets, weight=None, buckets=None, cuts=None) -> tuple[dict[str, list], dict[str, Decimal]]:
    """Per column and target: (value, weight before the value, weight of the value)."""
    columns = list(targets)
    buckets = buckets or selection_ranges(df.sparkSession)
    # Counts stay whole numbers; weights are decimals small enough to be held in a long.
    w = F.lit(1).cast("long") if weight is None else weight.cast("decimal(18,6)")
    ranged, names = with_ranges(df.withColumn("__w", w), columns, buckets, cuts)

    pieces = F.array(*[F.struct(F.lit(i).alias("c"), F.col(names[c]).alias("r")) for i, c in enumerate(columns)])
    totals = (
        ranged.where(F.col("__w") > 0)
        .select("__w", F.explode(pieces).alias("p"))
        .where("p.r is not null")
        .groupBy("p.c", "p.r")
        .agg(F.sum("__w").alias("w"))
        .collect()
    )
    by_column: dict[int, list[tuple[int, Decimal]]] = {}
    for row in totals:
        by_column.setdefault(row["c"], []).append((row["r"], Decimal(row["w"])))

    wanted: list[tuple[int, int, int, Decimal]] = []  # column, target index, range, target inside it
    ahead: dict[tuple[int, int], Decimal] = {}  # weight of the ranges before
    total_of: dict[str, Decimal] = {}
    for i, c in enumerate(columns):
        ranges = sorted(by_column.get(i, []))
        total = sum((x for _, x in ranges), Decimal(0))
        total_of[c] = total
        if total <= 0:
            continue
        for k, target in enumerate(targets[c](total)):
            target = min(Decimal(target), total)
            running = Decimal(0)
            for r, amount in ranges:
                if running + amount >= target:
                    wanted.append((i, k, r, target - running))
                    ahead[i, k] = running
                    break
                running += amount
    result: dict[str, list] = {c: [None] * len(targets[c](total_of[c])) if total_of[c] > 0 else [] for c in columns}
    if not wanted:
        return result, total_of

    # One pass over the rows of the chosen ranges. Each column keeps its own typed value slot, so
    # dates and decimals order and come back exactly.
    slots = [f"v{i}" for i in range(len(columns))]
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("c"),
                F.col(names[c]).alias("r"),
                *[
                    (F.col(c) if i == j else F.lit(None).cast(df.schema[other].dataType)).alias(slots[j])
                    for j, other in enumerate(columns)
                ],
            )
            for i, c in enumerate(columns)
        ]
    )
    chosen = F.lit(False)
    for i in range(len(columns)):
        mine = sorted({r for j, _, r, _ in wanted if j == i})
        if mine:
            chosen = chosen | ((F.col("c") == i) & F.col("r").isin(mine))
    pooled = (
        ranged.where(F.col("__w") > 0)
        .select("__w", F.inline(entries))
        .where(chosen)
        .groupBy("c", "r", *slots)
        .agg(F.sum("__w").alias("w"))
    )
    inside = Window.partitionBy("c", "r").orderBy(*slots)
    stepped = pooled.withColumn("upto", F.sum("w").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    asked = json.dumps([{"c2": i, "k": k, "r2": r, "t": str(t)} for i, k, r, t in wanted])
    targets_df = df.sparkSession.range(1).select(
        F.inline(F.from_json(F.lit(asked), "array<struct<c2:int,k:int,r2:int,t:decimal(38,6)>>"))
    )
    hit = (F.col("c") == F.col("c2")) & (F.col("r") == F.col("r2")) & (F.col("t") <= F.col("upto")) & (F.col("t") > F.col("upto") - F.col("w"))
    picked = stepped.join(F.broadcast(targets_df), hit)
    text = F.coalesce(*[F.col(x).cast("string") for x in slots])
    for row in picked.select("c", "k", text.alias("v"), "w", "upto").collect():
        c = columns[row["c"]]
        result[c][row["k"]] = (_typed(df, c, row["v"]), ahead[row["c"], row["k"]] + Decimal(row["upto"]) - Decimal(row["w"]), Decimal(row["w"]))
    return result, total_of


def _typed(df: DataFrame, column: str, text):
    if text is None:
        return None
    dtype = df.schema[column].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return float(text)
    if isinstance(dtype, T.DecimalType):
        return Decimal(text)
    if isinstance(dtype, T.IntegralType):
        return int(text)
    return text


def linear_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], cuts: Mapping[str, Sequence[float]] | None = None
) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of several columns, from the same jobs."""

    def ranks(total):
        n = int(total)
        out = []
        for p in probs:
            position = p * (n - 1)
            low = math.floor(position)
            out += [low + 1, min(low + 2, n)]
        return out

    reached, totals = _reach(df, {c: ranks for c in columns}, cuts=cuts)
    values = {c: [f[0] for f in found] for c, found in reached.items()}
    result: dict[str, list[float | None]] = {}
    for c in columns:
        n = int(totals[c])
        row = []
        for i, p in enumerate(probs):
            if n == 0:
                row.append(None)
                continue
            position = p * (n - 1)
            low, high = float(values[c][2 * i]), float(values[c][2 * i + 1])
            row.append(low + (high - low) * (position - math.floor(position)))
        result[c] = row
    return result


def nearest_rank_quantiles(df: DataFrame, column: str, probs: Sequence[str]) -> dict[str, object]:
    """The value at rank `ceil(q * n)` for every q, exactly; null for an empty set."""

    def ranks(total):
        n = int(total)
        return [max(1, math.ceil(Decimal(q) * n)) for q in probs]

    values, totals = first_reaching(df, {column: ranks})
    found = values[column] if totals[column] > 0 else [None] * len(probs)
    return dict(zip(probs, found))


def rank_cuts(df: DataFrame, order: str, tie: str, ends: Callable[[int], Sequence[int]]) -> tuple[int, list[tuple]]:
    """The (order, tie) values of the rows at the 1-based ranks `ends(n)`, without ranking rows.

    `tie` must be unique and numeric; rows with a null `order` are left out. The tie is None where
    the cut includes every row of its order value.
    """
    rows = df.where(F.col(order).isNotNull()).select(order, tie).persist()
    try:
        found, totals = _reach(rows, {order: lambda total: ends(int(total))})
        n = int(totals[order])
        if n == 0:
            return 0, []
        edges = found[order]
        needs = [min(r, n) - int(before) for r, (_, before, _) in zip(ends(n), edges)]
        # A tie matters only where a cut falls between rows of one value.
        open_ties = [b for b, (_, _, w) in enumerate(edges) if needs[b] < int(w)]
        ties: dict[int, object] = {}
        if open_ties:
            distinct = list(dict.fromkeys(edges[b][0] for b in open_ties))
            literal = {v: _literal(df, order, v) for v in distinct}
            tied = rows.where(F.col(order).isin(list(literal.values())))
            tied = tied.select(*[F.when(F.col(order) == literal[v], F.col(tie)).alias(f"t{i}") for i, v in enumerate(distinct)])
            of = {v: [b for b in open_ties if edges[b][0] == v] for v in distinct}
            values, _ = first_reaching(tied, {f"t{i}": (lambda total, bs=of[v]: [needs[b] for b in bs]) for i, v in enumerate(distinct)})
            ties = {b: values[f"t{i}"][j] for i, v in enumerate(distinct) for j, b in enumerate(of[v])}
        return n, [(edges[b][0], ties.get(b)) for b in range(len(edges))]
    finally:
        rows.unpersist()


def past_cut(df: DataFrame, order: str, tie: str, cut: tuple) -> Column:
    """Whether a row comes after the cut in (order, tie) order."""
    value = _literal(df, order, cut[0])
    if cut[1] is None:
        return F.col(order) > value
    return (F.col(order) > value) | ((F.col(order) == value) & (F.col(tie) > _literal(df, tie, cut[1])))


def equal_count_bins(
    df: DataFrame, order: str, tie: str, bins: int, name: str = "bin", ends: Callable[[int], Sequence[int]] | None = None
) -> DataFrame:
    """`df` plus its 1-based bin when rows are ordered by (`order`, `tie`) and cut into `bins`
    equal counts, the first bins one row larger where the count does not divide.

    `tie` must be unique and numeric. The cut points are found exactly; no row is ranked.
    `ends(n)` overrides the last rank of each bin but the last.
    """

    def even(n: int) -> list[int]:
        base, extra = divmod(n, bins)
        return [base * b + min(b, extra) for b in range(1, bins)]

    wanted = ends or even

    def kept(n: int) -> list[int]:
        return [r for r in wanted(n) if r >= 1] or [n]

    n, cuts = rank_cuts(df, order, tie, kept)
    if n == 0:
        return df.withColumn(name, F.lit(None).cast("int"))
    empty_first = len([r for r in wanted(n) if r < 1])
    position = F.lit(1 + empty_first)
    if [r for r in wanted(n) if r >= 1]:
        for cut in cuts:
            position = position + F.when(past_cut(df, order, tie, cut), 1).otherwise(0)
    return df.withColumn(name, F.when(F.col(order).isNotNull(), position).cast("int"))


def first_rows(df: DataFrame, order: str, tie: str, n: int) -> DataFrame:
    """The first `n` rows in (order, tie) order, as a filter rather than a sort."""
    if n <= 0:
        return df.limit(0)
    total, cuts = rank_cuts(df, order, tie, lambda _total: [n])
    if total == 0:
        return df.limit(0)
    return df.where(F.col(order).isNotNull() & ~past_cut(df, order, tie, cuts[0]))


def _literal(df: DataFrame, column: str, value) -> Column:
    return F.lit(value).cast(df.schema[column].dataType)
