"""Rating a whole portfolio: an ordered list of typed steps as one projection over every row.

A bad row gets an error code and the rest go on. Everything a version adds to a row carries that
version's prefix, so several versions can be rated over one scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.functions.hashing import hash_unit
from premia.functions.scalar import round_exact
from premia.operators import reference
from premia.session import BROADCAST_ROWS, small

#: Unrounded money inside the ladder.
AMOUNT = "decimal(28,8)"
OPERAND = "decimal(10,6)"
MAX_DIGITS = 15
PURPOSES = ("new_business", "renewal", "mid_term_adjustment", "cancellation", "what_if")

#: The ladder's rungs, in order (fixed values).
RUNGS = (
    "risk_premium",
    "expense_loading",
    "commission",
    "profit_loading",
    "office_premium",
    "optimisation_adjustment",
    "constraints",
    "instalment_loading",
    "ipt_and_fees",
    "payable_premium",
)

#: Looks a name up among a version's outputs, else among the portfolio's columns.
Names = Callable[[str], Column]


class RatingError(ValueError):
    """An algorithm that cannot be run, or a batch that must stop."""


@dataclass(frozen=True)
class Field:
    """One declared input."""

    name: str
    kind: str = "decimal"  # int, decimal, string, enum
    required: bool = True
    minimum: str | None = None
    maximum: str | None = None
    domain: tuple[str, ...] = ()


@dataclass(frozen=True)
class Lookup:
    """Reference payload in force at a date. `keys` maps reference keys to portfolio columns."""

    output: str
    rows: DataFrame
    keys: Mapping[str, str]
    as_at: str
    payload: str
    on_miss: str = "error"


@dataclass(frozen=True)
class Table:
    """The value of the cell whose keys all match."""

    output: str
    cells: DataFrame
    keys: Mapping[str, str]
    value: str = "relativity"
    on_miss: str = "error"
    default: str | None = None


@dataclass(frozen=True)
class Expression:
    output: str
    value: Callable[[Names], Column]
    purposes: tuple[str, ...] = ()


@dataclass(frozen=True)
class ModelCall:
    """A fitted model's prediction: `model.predict(df, name)` adds the column."""

    output: str
    model: object


@dataclass(frozen=True)
class Decline:
    reason: str
    when: Callable[[Names], Column]
    purposes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rung:
    """One rung: how it changes the running amount. `start` takes the value of a name."""

    name: str
    kind: str  # start, multiply, add, clamp, none
    operand: Callable[[Names], Column] | str | None = None
    minimum: str | None = None
    maximum: str | None = None
    reason: str | None = None
    rounding: str = "half_even"
    purposes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Algorithm:
    ref: str
    fields: tuple[Field, ...]
    steps: tuple
    rungs: tuple[Rung, ...]
    purpose: str | None = None  # the portfolio's purpose column


def decimal_lit(value) -> Column:
    return F.lit(str(Decimal(value))).cast(OPERAND)


def input_errors(df: DataFrame, fields: Sequence[Field]) -> list[tuple[Column, str]]:
    """(condition, code) of every declared rule; a code names the field, never its value."""
    out = []
    for f in fields:
        if f.name not in df.columns:
            out.append((F.lit(True), f"input_missing:{f.name}"))
            continue
        value = F.col(f.name)
        if f.required:
            out.append((value.isNull(), f"input_null:{f.name}"))
        if f.kind in ("int", "decimal"):
            number = value.try_cast("decimal(38,10)") if dict(df.dtypes)[f.name] == "string" else value.cast("decimal(38,10)")
            out.append((value.isNotNull() & number.isNull(), f"input_type:{f.name}"))
            if f.kind == "int":
                out.append((number != F.floor(number), f"input_type:{f.name}"))
            # Significant digits: all digits without the zeros at either end.
            digits = F.regexp_replace(F.regexp_replace(number.cast("string"), "[^0-9]", ""), "^0+|0+$", "")
            if dict(df.dtypes)[f.name] in ("string", "double", "float") or dict(df.dtypes)[f.name].startswith("decimal"):
                out.append((F.length(digits) > MAX_DIGITS, f"input_digits:{f.name}"))
            if f.minimum is not None:
                out.append((number < F.lit(f.minimum).cast("decimal(38,10)"), f"input_below_minimum:{f.name}"))
            if f.maximum is not None:
                out.append((number > F.lit(f.maximum).cast("decimal(38,10)"), f"input_above_maximum:{f.name}"))
        if f.domain:
            out.append((value.isNotNull() & ~value.isin(*f.domain), f"input_domain:{f.name}"))
    return out


def unique_side(cells: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """`cells`, refused if a key repeats (a row could match twice), broadcast if counted small."""
    row = cells.groupBy(*keys).count().agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()
    if (row["most"] or 0) > 1:
        raise RatingError(f"{what} has a repeated key; a row could match twice")
    return F.broadcast(cells) if (row["n"] or 0) <= BROADCAST_ROWS else cells


def score(df: DataFrame, algorithm: Algorithm, prefix: str = "") -> DataFrame:
    """Every row with `{prefix}outcome`, `{prefix}premium_minor`, `{prefix}error_codes`,
    `{prefix}reasons` and `{prefix}ladder`, plus one column per step output.

    Tables and lookups are joined by key to the row; each key holds at most one cell, so rows are
    neither lost nor repeated.
    """
    made: dict[str, str] = {}

    def names(name: str) -> Column:
        return F.col(made.get(name, name))

    def applies(purposes: Sequence[str]) -> Column:
        return F.col(algorithm.purpose).isin(*purposes) if purposes and algorithm.purpose else F.lit(True)

    errors = input_errors(df, algorithm.fields)
    declines: list[tuple[Column, str]] = []
    for step in algorithm.steps:
        if isinstance(step, Table):
            name = f"{prefix}{step.output}"
            side = unique_side(step.cells, list(step.keys), f"table for {step.output!r}").select(*[F.col(k).alias(f"__k_{k}") for k in step.keys], F.col(step.value).alias(name))
            condition = F.lit(True)
            for k, c in step.keys.items():
                condition = condition & (names(c) == F.col(f"__k_{k}"))
            df = df.join(side, condition, "left").drop(*[f"__k_{k}" for k in step.keys])
            made[step.output] = name
            if step.on_miss == "error":
                errors.append((F.col(name).isNull(), f"table_miss:{step.output}"))
            else:
                df = df.withColumn(name, F.coalesce(name, decimal_lit(step.default)))
        elif isinstance(step, Lookup):
            name = f"{prefix}{step.output}"
            rows = step.rows.select(
                *[F.col(k).alias(f"__k_{k}") for k in step.keys], F.col("effective_from").alias("__from"), F.col("effective_to").alias("__to"), F.col(step.payload).alias(name)
            )
            side = reference.checked_side(rows, [f"__k_{k}" for k in step.keys], "__from", "__to")
            condition = (F.col("__from") <= F.col(step.as_at)) & (F.col("__to").isNull() | (F.col(step.as_at) < F.col("__to")))
            for k, c in step.keys.items():
                condition = condition & (F.col(c) == F.col(f"__k_{k}"))
            df = df.join(side, condition, "left").drop("__from", "__to", *[f"__k_{k}" for k in step.keys])
            made[step.output] = name
            if step.on_miss == "error":
                errors.append((F.col(name).isNull(), f"lookup_miss:{step.output}"))
        elif isinstance(step, Expression):
            value = step.value(names)
            if step.purposes:
                value = F.when(applies(step.purposes), value)
            df = df.withColumn(f"{prefix}{step.output}", value)
            made[step.output] = f"{prefix}{step.output}"
        elif isinstance(step, ModelCall):
            df = step.model.predict(df, f"{prefix}{step.output}")
            made[step.output] = f"{prefix}{step.output}"
            errors.append((F.col(made[step.output]).isNull(), f"model_miss:{step.output}"))
        elif isinstance(step, Decline):
            declines.append((step.when(names) & applies(step.purposes), step.reason))
        else:
            raise RatingError(f"unknown step {type(step).__name__}")

    df, rungs, clamps = _ladder(df, algorithm, names, applies, prefix)
    codes = F.array_distinct(F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in errors] or [F.lit(None).cast("string")]), lambda x: x.isNotNull()))
    reasons = [F.when(c, F.lit(r)) for c, r in declines] + [F.when(c, F.lit(r)) for c, r in clamps]
    fired = F.filter(F.array(*reasons or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    declined = F.lit(False)
    for c, _ in declines:
        declined = declined | F.coalesce(c, F.lit(False))
    last = rungs[-1]
    df = df.withColumns({f"{prefix}error_codes": codes, f"{prefix}reasons": fired})
    failed = F.lit(False)
    for c, _ in errors:
        failed = failed | F.coalesce(c, F.lit(False))
    outcome = (
        F.when(failed, "error").when(declined, "declined").when(F.col(last["value"]).isNull(), "error").otherwise("quoted")
    )
    df = df.withColumn(f"{prefix}outcome", outcome)
    quoted = F.col(f"{prefix}outcome") == "quoted"
    entries = []
    before = None
    for r in rungs:
        value = F.col(r["value"])
        entries.append(
            F.struct(
                F.lit(r["name"]).alias("rung"),
                F.lit(r["kind"]).alias("kind"),
                F.col(r["operand"]).alias("operand"),
                value.alias("unrounded"),
                round_exact(value, r["rounding"]).cast("long").alias("rounded_minor"),
                (value if before is None else (value - before).cast(AMOUNT)).alias("contribution"),
            )
        )
        before = value
    df = df.withColumns(
        {
            f"{prefix}premium_minor": F.when(quoted, round_exact(F.col(last["value"]), last["rounding"]).cast("long")),
            f"{prefix}ladder": F.when(quoted, F.array(*entries)),
        }
    )
    return df.drop(*[r[x] for r in rungs for x in ("value", "operand")])


def _ladder(df, algorithm, names, applies, prefix):
    rungs, clamps, running = [], [], None
    for r in algorithm.rungs:
        if r.name not in RUNGS:
            raise RatingError(f"{r.name!r} is not a rung")
        value, operand = f"{prefix}__v_{r.name}", f"{prefix}__o_{r.name}"
        given = r.operand(names) if callable(r.operand) else decimal_lit(r.operand) if r.operand else None
        on = applies(r.purposes)
        if r.kind == "start":
            amount, taken = given.cast(AMOUNT), given.cast(AMOUNT)
        elif r.kind == "multiply":
            factor = F.when(on, given.cast(OPERAND)).otherwise(decimal_lit(1))
            amount, taken = (running * factor).cast(AMOUNT), factor.cast(AMOUNT)
        elif r.kind == "add":
            extra = F.when(on, given.cast(AMOUNT)).otherwise(F.lit(0).cast(AMOUNT))
            amount, taken = (running + extra).cast(AMOUNT), extra
        elif r.kind == "clamp":
            amount = running
            if r.minimum is not None:
                low = F.lit(r.minimum).cast(AMOUNT)
                clamps.append((on & (running < low), r.reason or f"{r.name}_minimum"))
                amount = F.greatest(amount, low)
            if r.maximum is not None:
                high = F.lit(r.maximum).cast(AMOUNT)
                clamps.append((on & (running > high), r.reason or f"{r.name}_maximum"))
                amount = F.least(amount, high)
            amount = F.when(running.isNull(), running).when(on, amount).otherwise(running).cast(AMOUNT)
            taken = amount
        elif r.kind == "none":
            amount, taken = running, F.lit(None).cast(AMOUNT)
        else:
            raise RatingError(f"{r.kind!r} is not a rung operation")
        df = df.withColumns({value: amount, operand: taken})
        running = F.col(value)
        rungs.append({"name": r.name, "kind": r.kind, "value": value, "operand": operand, "rounding": r.rounding})
    return df, rungs, clamps


def ladder_reconciles(ladder, premium) -> Column:
    """Replaying the recorded operations gives every rung's amount and the payable premium.

    A clamp replays to its bound. Null (nothing to reconcile) without a ladder.
    """
    ladder = F.col(ladder) if isinstance(ladder, str) else ladder
    premium = F.col(premium) if isinstance(premium, str) else premium
    start = F.struct(F.lit(0).cast(AMOUNT).alias("x"), F.lit(True).alias("ok"))

    def step(state: Column, r: Column) -> Column:
        x = (
            F.when(r["kind"].isin("start", "clamp"), r["operand"])
            .when(r["kind"] == "multiply", (state["x"] * r["operand"].cast(OPERAND)).cast(AMOUNT))
            .when(r["kind"] == "add", (state["x"] + r["operand"]).cast(AMOUNT))
            .otherwise(state["x"])
        )
        ok = state["ok"] & (F.abs(x - r["unrounded"]) <= F.lit("0.00000001").cast("decimal(10,8)"))
        return F.struct(x.cast(AMOUNT).alias("x"), F.coalesce(ok, F.lit(False)).alias("ok"))

    replayed = F.aggregate(ladder, start, step)
    last = F.element_at(ladder, -1)
    return F.when(ladder.isNotNull(), replayed["ok"] & (last["rounded_minor"] == premium))


def score_versions(df: DataFrame, algorithms: Sequence[Algorithm]) -> DataFrame:
    """One result set per version over the same rows, from one scan: (row columns, version, results)."""
    keep = df.columns
    for i, a in enumerate(algorithms):
        df = score(df, a, f"v{i}__")
    parts = ("outcome", "premium_minor", "error_codes", "reasons", "ladder")
    entries = [F.struct(F.lit(a.ref).alias("version"), *[F.col(f"v{i}__{p}").alias(p) for p in parts]) for i, a in enumerate(algorithms)]
    return df.select(*keep, F.inline(F.array(*entries)))


def outcome_summary(scored: DataFrame, prefix: str = "") -> DataFrame:
    return scored.groupBy(F.col(f"{prefix}outcome").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def error_tallies(scored: DataFrame, quote: str = "quote_id", prefix: str = "", samples: int = 5) -> DataFrame:
    """Rows per first error code with the first few quote ids.

    Counting is a plain aggregate. Sampling keeps the best few ids per code and shuffle piece
    first, so a code carried by most rows is not collected anywhere.
    """
    errors = scored.where(F.col(f"{prefix}outcome") == "error").select(F.element_at(f"{prefix}error_codes", 1).alias("code"), F.col(quote).alias("q"))
    counts = errors.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    piece = errors.withColumn("__p", F.pmod(F.xxhash64("q"), F.lit(256)))
    few = piece.withColumn("__r", F.row_number().over(Window.partitionBy("code", "__p").orderBy("q"))).where(F.col("__r") <= samples)
    best = few.withColumn("__r", F.row_number().over(Window.partitionBy("code").orderBy("q"))).where(F.col("__r") <= samples)
    lists = best.groupBy("code").agg(F.array_join(F.sort_array(F.collect_list("q")), ",").alias("sample"))
    return counts.join(lists, "code")


def refuse_failures(scored: DataFrame, threshold: float, prefix: str = "") -> DataFrame:
    """`scored` itself, unless the share of error rows is above the threshold."""
    row = scored.agg(F.avg((F.col(f"{prefix}outcome") == "error").cast("double")).alias("rate")).first()
    if row["rate"] is not None and row["rate"] > threshold:
        raise RatingError(f"batch aborted: failure rate {row['rate']:.4f} is above {threshold:.4f}")
    return scored


def trace(scored: DataFrame, outputs: Mapping[str, Sequence[str]], quote: str = "quote_id") -> DataFrame:
    """Long form, one row per quote and step: (quote, position, step, consumed, produced).

    `outputs` lists, per step in order, its output column followed by the columns it read.
    """
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(step).alias("step"),
            F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in read])).alias("consumed") if read else F.lit("{}").alias("consumed"),
            F.col(produced).cast("string").alias("produced"),
        )
        for i, (step, (produced, *read)) in enumerate(outputs.items())
    ]
    return scored.select(quote, F.inline(F.array(*entries)))


def trace_diff(base: DataFrame, other: DataFrame, edited: Sequence[str] = (), quote: str = "quote_id") -> DataFrame:
    """Steps that differ between two traces: (quote, step, change, changed_fields, own_change).

    A step that changed only through what it consumed has `own_change` false.
    """
    a = base.select(quote, "step", F.col("consumed").alias("c1"), F.col("produced").alias("p1"), F.lit(1).alias("in1"))
    b = other.select(quote, "step", F.col("consumed").alias("c2"), F.col("produced").alias("p2"), F.lit(1).alias("in2"))
    both = a.join(b, [quote, "step"], "full")
    fields = F.concat_ws(",", F.when(~F.col("c1").eqNullSafe(F.col("c2")), "consumed"), F.when(~F.col("p1").eqNullSafe(F.col("p2")), "produced"))
    change = F.when(F.col("in2").isNull(), "removed").when(F.col("in1").isNull(), "added").when(fields != "", "changed")
    return both.select(
        quote, "step", change.alias("change"), F.when(change == "changed", fields).alias("changed_fields"),
        (F.col("in1").isNull() | F.col("in2").isNull() | F.col("step").isin(list(edited))).alias("own_change"),
    ).where("change is not null")


def sample_traces(scored: DataFrame, rate: float, seed: int, quote: str = "quote_id", prefix: str = "") -> DataFrame:
    """Every declined and failed quote, and quoted ones at a rate, with the reason for keeping it."""
    outcome = F.col(f"{prefix}outcome")
    reason = F.when(outcome == "declined", "decline").when(outcome == "error", "error").when(hash_unit(quote, seed) < rate, "rate")
    return scored.withColumn("sample_reason", reason).where("sample_reason is not null")


def query_traces(traces: DataFrame, *, version: str, since: str, until: str, time: str = "scored_on") -> DataFrame:
    """Production traces of a version in `[since, until)`.

    Of a trace store only the folders of that version and those months are read: the months follow from the dates.
    """
    if "scored_month" in traces.columns:
        month = F.col("scored_month")
        traces = traces.where((month >= F.date_format(F.lit(since).cast("date"), "yyyy-MM")) & (month <= F.date_format(F.lit(until).cast("date"), "yyyy-MM")))
    return traces.where(
        (F.col("version") == version) & (F.col(time) >= F.lit(since).cast("date")) & (F.col(time) < F.lit(until).cast("date")) & (F.col("environment") == "production")
    )


def traces_of_releases(store: DataFrame, releases: DataFrame, time: str = "scored_on") -> DataFrame:
    """Traces of many releases (version, environment, since, until) at once, `until` excluded, with the release's `release`.

    Releases become rows of (environment, version, month), which meet the store on its folders' columns: once they are
    known, Spark reads only the folders that some release names. A trace in two releases' periods comes with each.
    """
    months = F.sequence(F.trunc("since", "month"), F.trunc(F.date_sub("until", 1), "month"), F.expr("interval 1 month"))
    spans = releases.where("since < until").select("release", "version", "environment", "since", "until", F.explode(F.transform(months, lambda m: F.date_format(m, "yyyy-MM"))).alias("scored_month"))
    met = store.join(small(spans), ["environment", "version", "scored_month"])
    return met.where((F.col(time) >= F.col("since")) & (F.col(time) < F.col("until"))).drop("since", "until")


def reproduce(stored: DataFrame, again: DataFrame, quote: str = "quote_id") -> DataFrame:
    """Stored quotes against a re-score: whether each compared field is exactly the same."""
    fields = ("outcome", "reasons", "premium_minor", "ladder")
    a = stored.select(quote, *[F.col(f).alias(f"a_{f}") for f in fields])
    b = again.select(quote, *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(1).alias("found"))
    same = [F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")) for f in fields]
    joined = a.join(b, quote, "left")
    verdict = F.col("found").isNotNull()
    for s in same:
        verdict = verdict & s
    return joined.select(quote, *[s.alias(f"same_{f}") for s, f in zip(same, fields)], verdict.alias("reproduced"))


def shadow(live: DataFrame, candidate: DataFrame, quote: str = "quote_id") -> DataFrame:
    """Live and candidate results side by side, without any quote input, and their price ratio."""
    a = live.select(quote, F.col("outcome").alias("live_outcome"), F.col("premium_minor").alias("live_minor"))
    b = candidate.select(quote, F.col("outcome").alias("candidate_outcome"), F.col("premium_minor").alias("candidate_minor"))
    return a.join(b, quote).withColumn(
        "ratio", F.try_divide(F.col("candidate_minor").cast("double"), F.col("live_minor").cast("double"))
    )
