"""Preparation recipes: an ordered fold of declared steps over DataFrames.

A cell that does not parse quarantines its whole source row as the input's text. The original
text and the reason travel with the row as two struct columns, so quarantine needs no join
back and Catalyst prunes them from the clean result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from premia.functions import scalar
from premia.functions.hashing import hmac_sha256
from premia.operators.ingest import COLUMN, REASON, STEP, exact_sum
from premia.operators.ordering import running_totals
from premia.session import cut_lineage

ROW, SOURCE, REJECT = "_source_row", "_source_text", "_reject"
_HIDDEN = (ROW, SOURCE, REJECT)
_REJECT_TYPE = "struct<reason:string,column:string,step:string>"

STEPS = (
    "rename",
    "cast",
    "parse_date",
    "trim_whitespace",
    "normalise_case",
    "map_values",
    "fill_null",
    "derive_expression",
    "filter_rows",
    "deduplicate",
    "join_table",
    "derive_exposure",
    "explode_period",
    "attach_claims",
    "pseudonymise",
)


class RecipeError(ValueError):
    """A step is malformed or not in the declared vocabulary."""


@dataclass
class Prepared:
    """Clean tables, the quarantined rows (text), and per-step row counts on request."""

    tables: dict[str, DataFrame]
    rejected: dict[str, DataFrame]
    observations: list[tuple[str, str, Observation, Observation]] = field(default_factory=list)
    _observed: dict[str, DataFrame] = field(default_factory=dict)

    def step_counts(self) -> list[dict]:
        """Runs every table once, without keeping the result, and returns each step's balance."""
        for df in self._observed.values():
            df.write.format("noop").mode("overwrite").save()
        out = []
        for kind, name, before_obs, after_obs in self.observations:
            before, after = before_obs.get, after_obs.get
            live_before, live_after = before["live"], after["live"]
            rejected_rows = after["rejected"] - before["rejected"]
            delta = live_after - (live_before - rejected_rows)
            out.append(
                {
                    "step": kind,
                    "table": name,
                    "rows_before": live_before,
                    "rows_after": live_after,
                    "rows_rejected": rejected_rows,
                    "rows_removed": max(-delta, 0),
                    "rows_added": max(delta, 0),
                }
            )
        return out


def apply_recipe(
    tables: Mapping[str, DataFrame],
    steps: Sequence[Mapping],
    *,
    row_keys: Mapping[str, str] | None = None,
    observe: bool = False,
) -> Prepared:
    """Apply the steps in order. A step is `{"step": kind, "table": name, "params": {...}}`.

    `row_keys` names, per table, a unique column that gives rows their identity and order (needed
    where "first" must mean the same thing on every run); without one an identity is assigned.
    `attach_claims` leaves the linked claims in its table and adds `<table>_unlinked` and `<table>_multi_linked`.
    """
    working = {name: _carry(name, df, (row_keys or {}).get(name)) for name, df in tables.items()}
    fanned: set[str] = set()
    observations = []
    for index, step in enumerate(steps):
        kind = step.get("step")
        if kind not in STEPS:
            raise RecipeError(f"step {index} is {kind!r}, not one of the declared steps {sorted(STEPS)}")
        name = step.get("table", next(iter(working)))
        if name not in working:
            raise RecipeError(f"step {index} targets table {name!r}, which is not present")
        df = working[name]
        before = Observation()
        if observe:
            df = df.observe(before, *_balance())
        keyed = name in (row_keys or {}) and name not in fanned
        if kind == "attach_claims":
            # Claims in no period or in several become tables of their own; rejected ones stay where they are.
            live = df.where(F.col(REJECT).isNull())
            exposure = working[step["params"]["exposure"]].where(F.col(REJECT).isNull()).drop(*_HIDDEN)
            done = attach_claims(exposure, live)
            working[f"{name}_unlinked"], working[f"{name}_multi_linked"] = done.unlinked, done.multi_linked
            df = done.linked.unionByName(df.where(F.col(REJECT).isNotNull()), allowMissingColumns=True)
        else:
            df = _step(kind, df, step.get("params", {}), working, keyed)
        if kind in ("join_table", "explode_period", "attach_claims"):
            fanned.add(name)
        if kind in ("cast", "parse_date") and name in fanned:
            # A source row may be several rows by now; all of them leave together.
            from pyspark.sql import Window

            df = df.withColumn(REJECT, F.max(REJECT).over(Window.partitionBy(ROW)))
        if observe:
            after = Observation()
            df = df.observe(after, *_balance())
            observations.append((kind, name, before, after))
        working[name] = df
    clean = {n: df.where(F.col(REJECT).isNull()).drop(*_HIDDEN) for n, df in working.items()}
    rejected = {}
    for n, df in working.items():
        bad = df.where(F.col(REJECT).isNotNull()).select(ROW, SOURCE, REJECT)
        if n in fanned:
            bad = bad.groupBy(ROW).agg(F.first(SOURCE).alias(SOURCE), F.first(REJECT).alias(REJECT))
        rejected[n] = bad.select(
            f"{SOURCE}.*",
            F.col(f"{REJECT}.reason").alias(REASON),
            F.col(f"{REJECT}.column").alias(COLUMN),
            F.col(f"{REJECT}.step").alias(STEP),
        )
    return Prepared(clean, rejected, observations, working if observe else {})


def _balance() -> list[Column]:
    return [
        F.count(F.when(F.col(REJECT).isNull(), 1)).alias("live"),
        F.count(F.when(F.col(REJECT).isNotNull(), 1)).alias("rejected"),
    ]


def _carry(name: str, df: DataFrame, row_key: str | None) -> DataFrame:
    clash = [c for c in _HIDDEN if c in df.columns]
    if clash:
        raise RecipeError(f"table {name!r} already has column(s) {clash}")
    identity = F.col(row_key) if row_key else F.monotonically_increasing_id()
    text = F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    return df.withColumns({ROW: identity, SOURCE: text, REJECT: F.lit(None).cast(_REJECT_TYPE)})


def _parse(df: DataFrame, kind: str, parsed: Sequence[tuple[str, Column, str]]) -> DataFrame:
    """Replace columns by their parsed form; mark rows where a value was lost."""
    lost = []
    for name, value, target in parsed:
        failed = F.col(name).isNotNull() & value.isNull()
        reason = F.concat(
            F.lit(f"{name}: {kind} could not parse '"), F.col(name).cast("string"), F.lit(f"' as {target}")
        )
        lost.append(F.when(failed, F.struct(reason.alias("reason"), F.lit(name).alias("column"), F.lit(kind).alias("step"))))
    first = F.coalesce(F.col(REJECT), *lost)
    return df.withColumns({REJECT: first, **{name: value for name, value, _ in parsed}})


def _step(kind: str, df: DataFrame, params: Mapping, tables: Mapping[str, DataFrame], keyed: bool) -> DataFrame:
    if kind == "rename":
        return df.withColumnsRenamed(dict(params["columns"]))
    if kind == "cast":
        return _parse(df, kind, [(c, scalar.cast_to(c, t), t) for c, t in params["columns"].items()])
    if kind == "parse_date":
        c, fmt = params["column"], params["format"]
        return _parse(df, kind, [(c, scalar.parse_date(c, fmt), fmt)])
    if kind == "trim_whitespace":
        return df.withColumns({c: scalar.strip(c) for c in params["columns"]})
    if kind == "normalise_case":
        change = F.upper if params.get("case", "lower") == "upper" else F.lower
        return df.withColumns({c: change(F.col(c)) for c in params["columns"]})
    if kind == "map_values":
        c = params["column"]
        return df.withColumn(c, scalar.map_levels(c, params["mapping"]))
    if kind == "fill_null":
        c = params["column"]
        return df.withColumn(c, F.coalesce(F.col(c), F.lit(params["value"]).cast(df.schema[c].dataType)))
    if kind == "derive_expression":
        return df.withColumn(params["column"], _expression(params["expression"]))
    if kind == "filter_rows":
        return df.where(F.col(REJECT).isNotNull() | _expression(params["expression"]))
    if kind == "deduplicate":
        return deduplicate(df, params.get("columns"), unique_order=keyed)
    if kind == "join_table":
        other = tables[params["other"]]
        other = other.where(F.col(REJECT).isNull()).drop(*_HIDDEN)
        return df.join(other, list(params["on"]), params.get("how", "left"))
    if kind == "derive_exposure":
        return df.withColumn(
            params.get("column", "exposure_years"), scalar.year_fraction(params["start"], params["end"])
        )
    if kind == "explode_period":
        return explode_period(df, params["boundaries"], **{k: v for k, v in params.items() if k != "boundaries"})
    if kind == "pseudonymise":
        return pseudonymise(df, params["column"], params["key"])
    raise RecipeError(f"{kind!r} has no implementation")


def _expression(value) -> Column:
    """A `Column`, or Spark SQL expression text."""
    return value if isinstance(value, Column) else F.expr(value)


def map_from_table(df: DataFrame, column: str, mapping: DataFrame, *, source: str, target: str) -> DataFrame:
    """`map_values` with a mapping held as a table of any size; unmapped values stay."""
    lookup = mapping.select(F.col(source).alias(column), F.col(target).alias("__to"))
    return df.join(lookup, column, "left").withColumn(column, F.coalesce("__to", column)).drop("__to")


def deduplicate(
    df: DataFrame, columns: Sequence[str] | None = None, *, order_by: str = ROW, unique_order: bool = False
) -> DataFrame:
    """Keep the first row of each key in row order. Quarantined rows neither count nor leave.

    The first position per key is an aggregate that starts on the map side, so a key held by a third
    of all rows never sits in one task. With `unique_order` the positions select the rows through a
    join; otherwise the whole row travels with its position, because positions that were only
    assigned may differ when they are computed again.
    """
    hidden = [c for c in _HIDDEN if c in df.columns and c != order_by]
    data = [c for c in df.columns if c not in hidden and c != order_by]
    keys = list(columns) if columns else data
    live = df.where(F.col(REJECT).isNull()) if REJECT in df.columns else df
    if unique_order:
        first = live.groupBy(*keys).agg(F.min(order_by).alias(order_by)).select(order_by)
        kept = live.join(first, order_by, "left_semi").select(*df.columns)
    else:
        rest = [c for c in df.columns if c not in keys]
        best = live.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order_by)).alias("__first"))
        kept = best.select(*[F.col(c) if c in keys else F.col(f"__first.{c}").alias(c) for c in df.columns])
    if REJECT in df.columns:
        return kept.unionByName(df.where(F.col(REJECT).isNotNull()))
    return kept


def explode_period(
    df: DataFrame,
    boundaries: Sequence[date | str],
    *,
    start: str = "exposure_start",
    end: str = "exposure_end",
    exposure: str = "exposure_years",
) -> DataFrame:
    """Split `[start, end)` at each boundary inside it, sharing the exposure by days.

    Shares are decimals at six places, half even; the last fragment takes the remainder, so each
    row's exposure is kept exactly. A row with no boundary inside is unchanged.
    """
    if not boundaries:
        return df
    cuts = [F.lit(b).cast("date") for b in sorted({str(b) for b in boundaries})]
    a, z = F.col(start), F.col(end)
    whole = F.col(exposure).cast("string").cast("decimal(20,17)")
    span = F.datediff(z, a).cast("decimal(6,0)")

    def share(since: Column, until: Column) -> Column:
        days = F.datediff(until, since).cast("decimal(6,0)")
        return F.bround(F.try_divide(whole * days, span), 6).cast("decimal(20,17)")

    # Fragment i lies between cut i - 1 and cut i; a row covers fragments first..last.
    first, last, edge_before, edge_after = F.lit(0), F.lit(0), F.lit(None).cast("date"), F.lit(None).cast("date")
    before_last = F.lit(0).cast("decimal(20,17)")
    i = F.col("__i")
    for k, cut in enumerate(cuts):
        first = first + F.when(cut <= a, 1).otherwise(0)
        last = last + F.when(cut < z, 1).otherwise(0)
        edge_before = F.when(i == k + 1, cut).otherwise(edge_before)
        edge_after = F.when(i == k, cut).otherwise(edge_after)
        inside = (cut > a) & (cut < z)
        since = F.greatest(a, cuts[k - 1]) if k else a
        before_last = (before_last + F.when(inside, share(since, cut)).otherwise(F.lit(0))).cast("decimal(20,17)")
    pieces = df.withColumns({"__first": first, "__last": F.greatest(first, last)}).select(
        "*", F.explode(F.sequence("__first", "__last")).alias("__i")
    )
    since = F.when(i == F.col("__first"), a).otherwise(edge_before)
    until = F.when(i == F.col("__last"), z).otherwise(edge_after)
    kept = (
        F.when(F.col("__first") == F.col("__last"), F.col(exposure))
        .when(i == F.col("__last"), (whole - before_last).cast("double"))
        .otherwise(share(since, until).cast("double"))
    )
    return pieces.withColumns({"__since": since, "__until": until, "__kept": kept}).select(
        *[F.col({start: "__since", end: "__until", exposure: "__kept"}.get(c, c)).alias(c) for c in df.columns]
    )


def exposure_balance(before: DataFrame, after: DataFrame, exposure: str = "exposure_years") -> DataFrame:
    """One row with both totals at six places and whether they are equal."""
    none = F.lit(None).cast("decimal(38,6)")
    total = F.bround(exact_sum(exposure, 17), 6).cast("decimal(38,6)")
    both = before.agg(total.alias("a"), none.alias("b")).unionAll(after.agg(none, total))
    return both.agg(F.max("a").alias("a"), F.max("b").alias("b")).select(
        F.col("a").cast("string").alias("exposure_before"),
        F.col("b").cast("string").alias("exposure_after"),
        F.col("a").eqNullSafe(F.col("b")).alias("preserved"),
    )


@dataclass(frozen=True)
class Attached:
    """Claims by how many exposure periods cover the loss date."""

    linked: DataFrame
    unlinked: DataFrame
    multi_linked: DataFrame


def cover_counts(
    exposure: DataFrame, claims: DataFrame, *, key: str, loss_date: str, start: str, end: str, period: str
) -> DataFrame:
    """Claims plus `n_periods` covering the loss date and, where that is one, `__period` (a hash).

    Period starts and ends are +1 and -1 in a running total per key. A period's hashed identity is
    also folded in at both with exclusive or, so it cancels once the period is over: where one
    period is open, what remains is that period's. No claim meets a period it does not fall in, and
    a key with very many rows is cut by date.
    """
    identity = F.xxhash64(F.col(period))
    usable = exposure.where(F.col(start) < F.col(end))
    starts = usable.select(key, F.col(start).alias("__d"), F.lit(1).alias("__open"), identity.alias("__id"))
    ends = usable.select(key, F.col(end).alias("__d"), F.lit(-1).alias("__open"), identity.alias("__id"))
    probes = claims.where(F.col(loss_date).isNotNull() & F.col(key).isNotNull()).select(
        key, F.col(loss_date).alias("__d"), F.lit(0).alias("__open"), F.lit(0).cast("long").alias("__id"), F.lit(1).alias("__probe")
    )
    none = F.lit(0).alias("__probe")
    events = starts.select("*", none).unionAll(ends.select("*", none)).unionAll(probes)
    totals = running_totals(
        events, "__d", {"o": F.col("__open")}, within=[key], xors={"i": F.col("__id")}, maxima={"probed": F.col("__probe")}
    )
    state = totals.where("probed = 1").select(
        key,
        F.col("__d").alias(loss_date),
        (F.col("o") + F.col("o_before")).alias("n_periods"),
        F.when(F.col("o") + F.col("o_before") == 1, F.col("i").bitwiseXOR(F.col("i_before"))).alias("__period"),
    )
    # Three outputs and several rules read the state of the probed dates: it is written once.
    state = cut_lineage(state)
    return claims.join(state, [key, loss_date], "left").withColumn("n_periods", F.coalesce("n_periods", F.lit(0)))


def attach_claims(
    exposure: DataFrame,
    claims: DataFrame,
    *,
    key: str = "policy_id",
    loss_date: str = "date_of_loss",
    start: str = "exposure_start",
    end: str = "exposure_end",
    period: str = "period_id",
) -> Attached:
    """Link claims to the one period `[start, end)` that covers the loss date.

    Nothing is dropped: a claim is linked (with its period's columns), unlinked, or multi-linked
    (with the number of periods; `covering_pairs` lists them).
    """
    counted = cover_counts(exposure, claims, key=key, loss_date=loss_date, start=start, end=end, period=period)
    one = counted.where("n_periods = 1").drop("n_periods")
    others = exposure.withColumn("__period", F.xxhash64(F.col(period)))
    clash = [c for c in claims.columns if c in exposure.columns and c != key]
    others = others.withColumnsRenamed({c: f"{c}_exposure" for c in clash})
    linked = (
        one.join(others, [key, "__period"])
        .where((F.col(loss_date) >= F.col(start)) & (F.col(loss_date) < F.col(end)))
        .drop("__period")
    )
    return Attached(
        linked,
        counted.where("n_periods = 0").select(*claims.columns),
        counted.where("n_periods > 1").select(*claims.columns, "n_periods"),
    )


def covering_pairs(
    exposure: DataFrame,
    claims: DataFrame,
    *,
    key: str = "policy_id",
    loss_date: str = "date_of_loss",
    start: str = "exposure_start",
    end: str = "exposure_end",
) -> DataFrame:
    """Every (claim, covering period) pair, joined on key and month so that a claim meets only
    periods touching its month; AQE splits what is still uneven."""
    month = lambda c: F.trunc(c, "month")
    usable = exposure.where(F.col(start) < F.col(end))
    spread = usable.withColumn(
        "__m", F.explode(F.sequence(month(F.col(start)), month(F.date_sub(F.col(end), 1)), F.expr("interval 1 month")))
    )
    clash = [c for c in claims.columns if c in exposure.columns and c != key]
    spread = spread.withColumnsRenamed({c: f"{c}_exposure" for c in clash})
    return (
        claims.withColumn("__m", month(F.col(loss_date)))
        .join(spread, [key, "__m"])
        .where((F.col(loss_date) >= F.col(start)) & (F.col(loss_date) < F.col(end)))
        .drop("__m")
    )


def pseudonymise(df: DataFrame, column: str, key: str) -> DataFrame:
    """Replace an identifier by 32 hex digits of its keyed hash; null stays null."""
    if column not in df.columns:
        raise RecipeError(f"pseudonymise targets {column!r}, which is not present")
    if not key:
        raise RecipeError("pseudonymise needs a key; an unkeyed hash can be reversed by guessing")
    return df.withColumn(column, F.substring(hmac_sha256(column, key), 1, 32))


def refuse_identifiers(df: DataFrame, classes: Mapping[str, str], pseudonymised: Sequence[str] = ()) -> DataFrame:
    """`df` itself, unless a direct identifier or special-category column is still in the clear."""
    open_columns = [
        c
        for c, k in classes.items()
        if k in ("direct_identifier", "special_category") and c in df.columns and c not in set(pseudonymised)
    ]
    if open_columns:
        raise RecipeError(f"columns {open_columns} identify a person and must be pseudonymised or dropped")
    return df


def correct_schema(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """A draft version's columns re-cast; a value that does not fit becomes null and is countable."""
    return df.withColumns({c: scalar.cast_to(c, t) for c, t in types.items()})


def claims_to_policy(
    policies: DataFrame, amounts: DataFrame, *, key: str = "policy_id", amount: str = "claim_amount_minor", count: str = "claim_count"
) -> DataFrame:
    """Claim amounts summed to policies. A claimant with no amount record keeps a null amount, a
    policy without claims has zero; mean severity is null without a claim."""
    rolled = amounts.groupBy(key).agg(F.sum(amount).alias("__sum"))
    joined = policies.join(rolled, key, "left")
    total = F.when(F.col("__sum").isNotNull(), F.col("__sum")).when(F.col(count) == 0, F.lit(0))
    return joined.withColumn(amount, total).withColumn(
        "mean_severity", F.when(F.col(count) > 0, F.col(amount) / F.col(count))
    ).drop("__sum")


def derive_version(parent: DataFrame, operation: str, **params) -> DataFrame:
    """A derived version: `sample`, `split`, `filter` or `union` of a parent."""
    if operation == "filter":
        return parent.where(_expression(params["expression"]))
    if operation == "union":
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), params["others"], parent)
    if operation == "sample":
        from premia.operators.splits import seeded_sample

        return seeded_sample(parent, params["key"], params["n"], params["seed"])
    if operation == "split":
        from premia.operators.splits import assign_parts

        return assign_parts(parent, **{k: v for k, v in params.items() if k != "part"}).where(
            F.col("part") == params["part"]
        ).drop("part")
    raise RecipeError(f"{operation!r} is not a derivation")
