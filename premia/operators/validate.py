"""Validation rules over prepared tables.

Rules are compiled before anything runs. Rules of single rows and of totals become columns of one
aggregate for each table; rules that group a table by a key share one table of groups, whatever
table they are on; rules that join tables are one-row frames. All of these are one union, answered
by one action. Rules that need an answer to ask the next question (quantiles, versions, `sql`) run
by themselves. A rule that cannot run is an error of that rule and of no other.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premia.functions.scalar import CAST_TYPES
from premia.operators import ingest
from premia.operators import profile as prof
from premia.operators import reference as ref
from premia.operators import sql_rules
from premia.operators.ordering import linear_quantiles
from premia.operators.prepare import cover_counts

SAMPLE = 100
LAYERS = ("structural", "referential", "actuarial", "distributional")
SEVERITIES = ("info", "warn", "fail")


@dataclass(frozen=True)
class Rule:
    """One check on one table. `params` are the check's own; `max_violating_rows` is a tolerance."""

    slug: str
    check: str
    table: str = ""
    column: str | None = None
    params: Mapping = field(default_factory=dict)
    severity: str = "fail"
    layer: str = "structural"
    max_violating_rows: int = 0

    def raised(self, severity: str) -> "Rule":
        """The rule with a higher severity; an override may never lower it."""
        if SEVERITIES.index(severity) < SEVERITIES.index(self.severity):
            raise ValueError(f"rule {self.slug!r} is {self.severity!r}; an override may only raise it")
        return Rule(self.slug, self.check, self.table, self.column, self.params, severity, self.layer, self.max_violating_rows)


@dataclass(frozen=True)
class Context:
    """The tables to check, and what they are compared with."""

    tables: Mapping[str, DataFrame]
    reference_tables: Mapping[str, DataFrame] = field(default_factory=dict)
    reference_frames: Mapping[str, DataFrame] = field(default_factory=dict)
    reference_profile: Mapping[str, Mapping] = field(default_factory=dict)
    exposure: str = "exposure_years"
    memo: dict = field(default_factory=dict, repr=False, compare=False)


@dataclass(frozen=True)
class Finding:
    """How many rows (or columns, levels, keys) violate, and what was measured."""

    violating: int | None
    measured: Mapping[str, object] = field(default_factory=dict)
    exposure_fraction: float | None = None
    skipped: str | None = None


@dataclass(frozen=True)
class Totals:
    """Aggregates of a rule's table, and what they say."""

    aggregates: Mapping[str, Column]
    finish: Callable[[Mapping], Finding]


@dataclass(frozen=True)
class Groups:
    """Groups of a rule's table by `keys`, with sums of `top` and `bottom`; `bad` is a predicate of `n`, `top`, `bottom`.

    What is said of them: groups, bad_groups, beyond (rows after the first of each group), least and most of top / bottom.
    """

    keys: Sequence[Column]
    bad: Column
    finish: Callable[[Mapping], Finding]
    top: Column = field(default_factory=lambda: F.lit(0.0))
    bottom: Column = field(default_factory=lambda: F.lit(1.0))


@dataclass(frozen=True)
class Later:
    """A frame of one row, and what it says. Rules with the same frame share its answer."""

    frame: DataFrame
    finish: Callable[[Mapping], Finding]


@dataclass(frozen=True)
class Result:
    rule: Rule
    outcome: str
    violating: int | None
    measured: Mapping[str, object]
    exposure_fraction: float | None
    detail: str = ""
    threshold: Mapping[str, object] = field(default_factory=dict)


#: Checks of a single row: rule -> violated predicate.
ROW_CHECKS: dict[str, Callable[[Rule, Context], Column]] = {}
#: All other checks: (rule, context) -> a finding, or a question whose answer is one.
CHECKS: dict[str, Callable[[Rule, Context], Finding | Totals | Groups | Later]] = {}


def row_check(name: str):
    return _register(ROW_CHECKS, name)


def check(name: str):
    """Register a check under a name; a name can be used once."""
    return _register(CHECKS, name)


def _register(into: dict, name: str):
    def wrap(fn):
        if name in CHECKS or name in ROW_CHECKS:
            raise ValueError(f"check {name!r} is already registered")
        into[name] = fn
        return fn

    return wrap


# -- one row at a time -----------------------------------------------------------------------


@row_check("not_null")
def _not_null(rule, ctx):
    return F.col(rule.column).isNull()


@row_check("allowed_values")
def _allowed(rule, ctx):
    return F.col(rule.column).isNotNull() & ~F.col(rule.column).isin(list(rule.params["values"]))


@row_check("range")
def _range(rule, ctx):
    """Outside the bounds; a null is not out of range (that is `not_null`'s finding)."""
    value, p = F.col(rule.column), rule.params
    bad = F.lit(False)
    if "min_inclusive" in p:
        bad = bad | (value < p["min_inclusive"])
    if "min_exclusive" in p:
        bad = bad | (value <= p["min_exclusive"])
    if "max_inclusive" in p:
        bad = bad | (value > p["max_inclusive"])
    if "max_exclusive" in p:
        bad = bad | (value >= p["max_exclusive"])
    if p.get("integer"):
        bad = bad | (value != F.floor(value))
    return bad


@row_check("encoding")
def _encoding(rule, ctx):
    """Text that was decoded with the wrong character set, or holds the replacement character."""
    return F.col(rule.column).rlike("Ã.|Â.|â€|�")


@row_check("period_consistent")
def _period(rule, ctx):
    start, end = F.col(rule.params["start"]), F.col(rule.params["end"])
    bad = end <= start
    if "exposure" in rule.params:
        tolerance = rule.params.get("tolerance", 0.01)
        bad = bad | (F.abs(F.col(rule.params["exposure"]) - F.datediff(end, start) / 365.25) > tolerance)
    return bad


@row_check("effective_date_in_range")
def _effective(rule, ctx):
    rows = ctx.reference_tables[rule.params["reference"]]
    span = ref.version_stats(rows).first()
    day = F.col(rule.column)
    bad = day < F.lit(span["covers_from"])
    if span["covers_to"] is not None:
        bad = bad | (day >= F.lit(span["covers_to"]))
    return bad


@row_check("expression")
def _expression(rule, ctx):
    """Rows where the predicate does not hold."""
    predicate = rule.params["predicate"]
    return ~(predicate if isinstance(predicate, Column) else F.expr(predicate))


# -- structure -------------------------------------------------------------------------------


@check("column_presence")
def _presence(rule, ctx):
    missing = [c for c in rule.params["columns"] if c not in ctx.tables[rule.table].columns]
    return Finding(len(missing), {"missing": missing})


@check("no_unexpected_columns")
def _unexpected(rule, ctx):
    extra = [c for c in ctx.tables[rule.table].columns if c not in rule.params["columns"]]
    return Finding(len(extra), {"unexpected": extra})


def _coerced(ctx: Context, columns: Sequence[str], steps: Sequence[str]) -> dict[str, int]:
    if "_rejected" not in ctx.tables:
        return {}
    rows = (
        ctx.tables["_rejected"]
        .where(F.col(ingest.STEP).isin(list(steps)) & F.col(ingest.COLUMN).isin(list(columns)))
        .groupBy(ingest.COLUMN)
        .count()
        .collect()
    )
    return {r[0]: r[1] for r in rows}


@check("dtype_match")
def _dtypes(rule, ctx):
    df, wanted = ctx.tables[rule.table], rule.params["columns"]
    wrong = [c for c, t in wanted.items() if c in df.columns and df.schema[c].dataType != CAST_TYPES[t]]
    coerced = _coerced(ctx, list(wanted), ("cast", "parse_date"))
    return Finding(len(wrong) + sum(coerced.values()), {"mismatched": wrong, "coerced_cells": coerced})


@check("date_parsed")
def _dates(rule, ctx):
    df, columns = ctx.tables[rule.table], rule.params["columns"]
    wrong = [c for c in columns if c in df.columns and not isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    coerced = _coerced(ctx, columns, ("cast", "parse_date"))
    return Finding(len(wrong) + sum(coerced.values()), {"not_dates": wrong, "coerced_cells": coerced})


@check("unique_key")
def _unique(rule, ctx):
    """Rows beyond the first of their key; a key with a null part counts as a key."""
    return Groups([F.col(c) for c in rule.params["columns"]], F.col("n") > 1, lambda r: Finding(r["beyond"], {"duplicated_keys": r["bad_groups"]}))


@check("reject_rate")
def _reject_rate(rule, ctx):
    row = ingest.reject_rate(ctx.tables[rule.table], ctx.tables["_rejected"]).first()
    over = row["reject_rate"] > rule.params.get("max_rate", 0.001)
    return Finding(row["rejected_rows"] if over else 0, {"reject_rate": row["reject_rate"]})


# -- references ------------------------------------------------------------------------------


def _counted(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


@check("reference_lookup")
def _lookup(rule, ctx):
    """Rows whose key has no reference row in force at the row's date."""
    found = ref.lookup_as_at(
        ctx.tables[rule.table].select(F.col(rule.column).alias("key"), F.col(rule.params["as_at"]).alias("as_at")),
        ctx.reference_tables[rule.params["reference"]].select("key", "effective_from", "effective_to"),
        ["key"],
        "as_at",
    )
    frame = found.agg(F.count(F.when(F.col("effective_from").isNull(), 1)).alias("n"))
    return Later(frame, lambda r: Finding(r["n"], {"unresolved_rows": r["n"]}))


@check("reference_coverage")
def _coverage(rule, ctx):
    keys = ctx.reference_tables[rule.params["reference"]].select("key").distinct()
    used = ctx.tables[rule.table].select(F.col(rule.column).alias("key")).distinct()
    frame = keys.join(used.withColumn("used", F.lit(1)), "key", "left").agg(F.count(F.lit(1)).alias("n"), F.count("used").alias("u"))

    def finish(r):
        share = r["u"] / r["n"] if r["n"] else None
        low = share is not None and share < rule.params.get("min_coverage", 0.5)
        return Finding(r["n"] - r["u"] if low else 0, {"coverage": share})

    return Later(frame, finish)


@check("cross_table_key")
def _cross(rule, ctx):
    other = ctx.tables[rule.params["references_table"]].select(F.col(rule.params["references_column"]).alias("__k")).distinct()
    df = ctx.tables[rule.table].where(F.col(rule.column).isNotNull())
    return Later(_counted(df.join(other, F.col(rule.column) == F.col("__k"), "left_anti")), lambda r: Finding(r["n"]))


@check("code_list_drift")
def _drift(rule, ctx):
    codes = ctx.reference_tables[rule.params["reference"]].select(F.col("key").cast("string").alias("level")).distinct()
    levels = ctx.tables[rule.table].where(F.col(rule.column).isNotNull()).select(F.col(rule.column).cast("string").alias("level")).distinct()
    return Later(_counted(levels.join(codes, "level", "left_anti")), lambda r: Finding(r["n"]))


# -- actuarial sense -------------------------------------------------------------------------


@check("no_overlap")
def _no_overlap(rule, ctx):
    p = rule.params
    found = ref.overlaps(ctx.tables[rule.table], [p["key"]], p["start"], p["end"])
    return Later(found.agg(F.coalesce(F.sum("overlapping_rows"), F.lit(0)).alias("n")), lambda r: Finding(r["n"]))


def _links(rule, ctx):
    """Unlinked and multi-linked claims, computed once for all rules on the same pair of tables."""
    p = rule.params
    key = p.get("key", "policy_id")
    memo = (rule.table, *sorted((k, str(v)) for k, v in p.items()))
    if memo not in ctx.memo:
        exposure = ctx.tables[p["exposure"]]
        counted = cover_counts(
            exposure, ctx.tables[rule.table], key=key, loss_date=p.get("loss_date", "date_of_loss"),
            start=p.get("start", "exposure_start"), end=p.get("end", "exposure_end"), period=p.get("period", "period_id"),
        )
        known = exposure.select(key).distinct().withColumn("__known", F.lit(1))
        none = F.col("n_periods") == 0
        ctx.memo[memo] = (
            counted.join(known, key, "left")
            .agg(
                F.count(F.when(none, 1)).alias("unlinked"),
                F.count(F.when(none & F.col("__known").isNotNull(), 1)).alias("outside"),
                F.count(F.when(F.col("n_periods") > 1, 1)).alias("multi"),
            )
        )
    return ctx.memo[memo]


@check("claim_date_in_exposure")
def _claim_dates(rule, ctx):
    """Claims on a known policy whose loss date is outside every period of it."""
    return Later(_links(rule, ctx), lambda r: Finding(r["outside"]))


@check("claim_linkage_complete")
def _linked(rule, ctx):
    return Later(_links(rule, ctx), lambda r: Finding(r["unlinked"]))


@check("claim_not_multi_linked")
def _multi(rule, ctx):
    return Later(_links(rule, ctx), lambda r: Finding(r["multi"]))


@check("policy_year_exposure")
def _policy_year(rule, ctx):
    """Policies with more exposure in a calendar year than allowed."""
    p = rule.params
    keys = [F.col(p["key"]), F.year(p["start"])]
    return Groups(keys, F.col("top") > p.get("max", 1.05), lambda r: Finding(r["bad_groups"]), top=F.col(ctx.exposure).cast("double"))


@check("claim_amount_sign")
def _sign(rule, ctx):

    def finish(r):
        share = r["n"] / r["t"] if r["t"] else 0.0
        return Finding(r["n"] if share > rule.params.get("max_negative_share", 0.01) else 0, {"negative_share": share})

    return Totals({"n": F.count(F.when(F.col(rule.column) < 0, 1)), "t": F.count(rule.column)}, finish)


@check("severity_outlier")
def _outlier(rule, ctx):
    """Claims above an amount, or above a percentile of the positive claims; flagged, not removed."""
    df = ctx.tables[rule.table].where(F.col(rule.column) > 0)
    limit = rule.params.get("threshold")
    if limit is None:
        limit = linear_quantiles(df, [rule.column], [rule.params.get("percentile", 0.995)])[rule.column][0]
    return Finding(df.where(F.col(rule.column) > limit).count() if limit is not None else 0, {"threshold": limit})


def _band(rule, top: Column, bottom: Column, low: float, high: float, what: str) -> Groups:
    by = rule.params.get("by")
    x = F.try_divide(F.col("top"), F.col("bottom"))
    said = lambda r: Finding(r["bad_groups"], {f"min_{what}": r["least"], f"max_{what}": r["most"]})
    return Groups([F.col(by)] if by else [], (x < low) | (x > high), said, top.cast("double"), bottom.cast("double"))


@check("frequency_plausible")
def _frequency(rule, ctx):
    p = rule.params
    return _band(rule, F.col("claim_count"), F.col(ctx.exposure), p.get("min_frequency", 0.0), p.get("max_frequency", 1.0), "frequency")


@check("severity_plausible")
def _severity(rule, ctx):
    p = rule.params
    return _band(rule, F.col("claim_amount_minor"), F.col("claim_count"), p.get("min_severity", 0), p.get("max_severity", 10**12), "severity")


@check("zero_claim_cohort")
def _zero_cohort(rule, ctx):
    """Levels with material exposure and no claims now that had claims in the reference version."""
    if rule.table not in ctx.reference_frames:
        return Finding(None, skipped="no reference version")
    now = prof.one_way(ctx.tables[rule.table], rule.column)
    before = prof.one_way(ctx.reference_frames[rule.table], rule.column).select("level", F.col("claim_count").alias("before"))
    total = ctx.tables[rule.table].agg(F.sum(ctx.exposure)).first()[0] or 0.0
    cold = now.join(before, "level").where(
        (F.col("claim_count") == 0) & (F.col("before") > 0) & (F.col("exposure_years") > total * rule.params.get("min_exposure_share", 0.01))
    )
    return Finding(cold.count())


@check("development_maturity")
def _maturity(rule, ctx):
    """Share of exposure in the last months before the latest date (claims there are immature)."""
    by_date = ctx.tables[rule.table].groupBy(F.col(rule.column).alias("d")).agg(F.sum(ctx.exposure).alias("e"), F.count(F.lit(1)).alias("k"))
    # over one row per date
    late = F.col("d") > F.add_months(F.max("d").over(Window.partitionBy(F.lit(1))), -rule.params.get("months", 3))
    frame = by_date.select("e", "k", late.alias("late")).agg(F.sum(F.when(F.col("late"), F.col("e"))).alias("a"), F.sum("e").alias("t"), F.count_if("late").alias("dates"), F.sum(F.when(F.col("late"), F.col("k"))).alias("n"))

    def finish(r):
        share = (r.get("a") or 0.0) / r["t"] if r.get("t") else 0.0
        return Finding((r.get("n") or 0) if share > rule.params.get("max_share", 0.05) else 0, {"immature_share": share}, share)

    return Later(frame, finish)


@check("currency_consistency")
def _currency(rule, ctx):
    return Groups([F.col(rule.column)], F.lit(False), lambda r: Finding(max(0, r["groups"] - 1), {"currencies": r["groups"]}))


@check("duplicate_claim")
def _duplicate(rule, ctx):
    keys = rule.params.get("columns", ["policy_id", "date_of_loss", "peril", "claim_amount_minor"])
    return _unique(Rule(rule.slug, "unique_key", rule.table, params={"columns": keys}), ctx)


# -- against another version -----------------------------------------------------------------


def _levels(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    return ingest.level_counts(df, [column], weight)


def _needs_frame(fn):
    def run(rule, ctx):
        if rule.table not in ctx.reference_frames:
            return Finding(None, skipped="no reference version to compare with")
        return fn(rule, ctx, ctx.tables[rule.table], ctx.reference_frames[rule.table])

    return run


def _psi_finding(rule, value) -> Finding:
    over = value is not None and value > rule.params.get("max_psi", 0.10)
    return Finding(int(over), {"psi": value})


@check("psi_column")
@_needs_frame
def _psi_column(rule, ctx, now, before):
    row = prof.psi(_levels(now, rule.column), _levels(before, rule.column)).first()
    return _psi_finding(rule, row["psi"] if row else None)


@check("mix_shift_exposure")
@_needs_frame
def _mix(rule, ctx, now, before):
    row = prof.psi(_levels(now, rule.column, ctx.exposure), _levels(before, rule.column, ctx.exposure), weight="weight").first()
    return _psi_finding(rule, row["psi"] if row else None)


@check("new_level")
@_needs_frame
def _new_level(rule, ctx, now, before):
    return Finding(prof.level_changes(_levels(now, rule.column), _levels(before, rule.column)).where("change = 'new'").count())


@check("vanished_level")
@_needs_frame
def _vanished(rule, ctx, now, before):
    """Levels gone that held a material share of the reference exposure."""
    old = _levels(before, rule.column, ctx.exposure)
    total = old.agg(F.sum("weight")).first()[0] or 0.0
    gone = prof.level_changes(_levels(now, rule.column), old).where("change = 'vanished'")
    heavy = old.where(F.col("weight") >= total * rule.params.get("min_exposure_share", 0.01))
    return Finding(gone.join(heavy, ["column", "level"], "left_semi").count())


def _stats(df: DataFrame, column: str) -> dict:
    row = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(column).isNull().cast("double")).alias("null_rate"),
    ).first()
    return row.asDict()


@check("null_rate_shift")
def _null_shift(rule, ctx):
    """Answers from a stored profile where one is given; the reference rows are not read again."""
    known = ctx.reference_profile.get(rule.column)
    if known is None and rule.table not in ctx.reference_frames:
        return Finding(None, skipped="no reference version to compare with")
    before = known["null_rate"] if known is not None else _stats(ctx.reference_frames[rule.table], rule.column)["null_rate"]
    now = _stats(ctx.tables[rule.table], rule.column)["null_rate"]
    shift = abs(now - before) * 100
    return Finding(int(shift > rule.params.get("max_shift_pp", 5.0)), {"null_rate": now, "reference_null_rate": before})


@check("volume_shift")
def _volume(rule, ctx):
    known = next(iter(ctx.reference_profile.values()), None)
    if known is None and rule.table not in ctx.reference_frames:
        return Finding(None, skipped="no reference version to compare with")
    before = known["n_rows"] if known is not None else ctx.reference_frames[rule.table].count()
    now = ctx.tables[rule.table].count()
    ratio = now / before if before else None
    over = ratio is not None and abs(ratio - 1) > rule.params.get("max_shift_fraction", 0.2)
    return Finding(int(over), {"ratio": ratio, "reference_rows": before})


@check("mean_shift")
@_needs_frame
def _mean_shift(rule, ctx, now, before):
    a = now.agg(F.avg(rule.column).alias("m")).first()["m"]
    b = before.agg(F.avg(rule.column).alias("m"), F.stddev_samp(rule.column).alias("s"), F.count(rule.column).alias("n")).first()
    if a is None or not b["n"] or not b["s"]:
        return Finding(0, {"standard_errors": None})
    errors = abs(a - b["m"]) / (b["s"] / b["n"] ** 0.5)
    return Finding(int(errors > rule.params.get("max_standard_errors", 5.0)), {"standard_errors": errors})


@check("target_rate_shift")
@_needs_frame
def _target(rule, ctx, now, before):
    """Frequency, severity and burning cost against the reference version."""
    sums = [F.sum(ctx.exposure).alias("e"), F.sum("claim_count").cast("double").alias("c"), F.sum("claim_amount_minor").cast("double").alias("a")]

    def rates(df):
        r = df.agg(*sums).first()
        ratio = lambda x, y: x / y if y else None
        return {"frequency": ratio(r["c"], r["e"]), "severity": ratio(r["a"], r["c"]), "burning_cost": ratio(r["a"], r["e"])}

    a, b = rates(now), rates(before)
    shifts = {k: (a[k] / b[k] - 1) if a[k] is not None and b[k] else None for k in a}
    limit = rule.params.get("max_shift_fraction", 0.15)
    return Finding(sum(1 for s in shifts.values() if s is not None and abs(s) > limit), shifts)


# -- user rules ------------------------------------------------------------------------------


@check("sql")
def _sql(rule, ctx):
    """One SELECT that returns a count of violating rows, or a boolean that must hold."""
    n = sql_rules.answer(ctx.tables, rule.params["query"], rule.params.get("timeout_s", sql_rules.BUDGET_S))
    return Finding(n, {"violating_rows": n})


# -- running ---------------------------------------------------------------------------------


def run_validation(ctx: Context, rules: Sequence[Rule]) -> list[Result]:
    """Every rule's result, in order."""
    findings: dict[int, Finding | Exception] = {}
    asked: dict[int, Totals | Groups | Later] = {}
    for i, rule in enumerate(rules):
        try:
            if rule.check in ROW_CHECKS:
                made = _row_totals(ctx, rule, ROW_CHECKS[rule.check](rule, ctx))
            elif rule.check in CHECKS:
                made = CHECKS[rule.check](rule, ctx)
            else:
                raise KeyError(f"no check named {rule.check!r}")
            if isinstance(made, Finding):
                findings[i] = made
            else:
                _analysed(ctx, rule, made)
                asked[i] = made
        except Exception as e:  # noqa: BLE001 - a broken rule must not stop the others
            findings[i] = e
    findings.update(_answers(ctx, rules, asked))
    return [_judge(rule, findings[i]) for i, rule in enumerate(rules)]


def _analysed(ctx: Context, rule: Rule, made) -> None:
    """Spark resolves the columns of a question, so that a wrong name is its rule's error alone."""
    if isinstance(made, Totals):
        ctx.tables[rule.table].agg(*[c.alias(k) for k, c in made.aggregates.items()])
    elif isinstance(made, Groups):
        _melted(ctx, [(0, rule, made)])


def _row_totals(ctx: Context, rule: Rule, predicate: Column) -> Totals:
    weight = F.col(ctx.exposure) if ctx.exposure in ctx.tables[rule.table].columns else F.lit(None).cast("double")

    def finish(r):
        total = r.get("total_exposure")
        return Finding(r["v"], {"violating_rows": r["v"]}, (r.get("e") or 0.0) / total if total else None)

    return Totals({"v": F.count(F.when(predicate, 1)), "e": F.sum(F.when(predicate, weight))}, finish)


def _melted(ctx: Context, members) -> DataFrame:
    """(rule, key, n, top, bottom, e) of every group of rules that group, in one table; a table is read once."""
    out = None
    for table in dict.fromkeys(rule.table for _, rule, _ in members):
        df = ctx.tables[table]
        weight = F.col(ctx.exposure).cast("double") if ctx.exposure in df.columns else F.lit(None).cast("double")
        entries = [
            F.struct(
                F.lit(i).alias("rule"), (F.to_json(F.struct(*[k.alias(f"k{j}") for j, k in enumerate(g.keys)]), {"ignoreNullFields": "false"}) if g.keys else F.lit("{}")).alias("key"),
                g.top.cast("double").alias("top"), g.bottom.cast("double").alias("bottom"), weight.alias("e"),
            )
            for i, rule, g in members
            if rule.table == table
        ]
        rows = df.select(F.inline(F.array(*entries)))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("top").alias("top"), F.sum("bottom").alias("bottom"), F.sum("e").alias("e"))


def _bad_groups(members) -> Column:
    bad = F.lit(False)
    for i, _, g in members:
        bad = F.when(F.col("rule") == i, g.bad).otherwise(bad)
    return F.coalesce(bad, F.lit(False))


def _union(ctx: Context, rules: Sequence[Rule], asked: Mapping[int, Totals | Groups | Later]) -> DataFrame:
    """(question, answer): one row of JSON for each table's totals, each grouping rule and each frame."""
    parts = []
    for table in dict.fromkeys(rules[i].table for i, q in asked.items() if not isinstance(q, Later)):
        df = ctx.tables[table]
        columns = [F.sum(F.col(ctx.exposure) if ctx.exposure in df.columns else F.lit(None).cast("double")).alias("total_exposure")]
        columns += [c.alias(f"{k}{i}") for i, q in asked.items() if isinstance(q, Totals) and rules[i].table == table for k, c in q.aggregates.items()]
        parts.append(df.agg(*columns).select(F.lit(f"table {table}").alias("question"), F.to_json(F.struct("*")).alias("answer")))
    members = [(i, rules[i], q) for i, q in asked.items() if isinstance(q, Groups)]
    if members:
        bad, x = _bad_groups(members), F.try_divide(F.col("top"), F.col("bottom"))
        judged = _melted(ctx, members).withColumns({"bad": bad, "x": x}).groupBy("rule").agg(
            F.count(F.lit(1)).alias("groups"), F.count_if("bad").alias("bad_groups"), F.sum(F.col("n") - 1).alias("beyond"), F.min("x").alias("least"),
            F.max("x").alias("most"), F.sum(F.when(F.col("bad"), F.col("e"))).alias("e"),
        )
        parts.append(judged.select(F.concat(F.lit("groups "), F.col("rule").cast("string")).alias("question"), F.to_json(F.struct("*")).alias("answer")))
    frames = {id(q.frame): q.frame for q in asked.values() if isinstance(q, Later)}
    parts += [frame.select(F.lit(f"frame {k}").alias("question"), F.to_json(F.struct("*")).alias("answer")) for k, frame in frames.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _answers(ctx: Context, rules: Sequence[Rule], asked: Mapping[int, Totals | Groups | Later]) -> dict[int, Finding | Exception]:
    """What each question's answer says; when the one action fails, halves of the questions are tried until the culprits are alone."""
    if not asked:
        return {}
    try:
        said = {r["question"]: json.loads(r["answer"]) for r in _union(ctx, rules, asked).collect()}
        out: dict[int, Finding | Exception] = {}
        for i, q in asked.items():
            total = said.get(f"table {rules[i].table}", {}).get("total_exposure")
            if isinstance(q, Totals):
                mine = said[f"table {rules[i].table}"]
                out[i] = q.finish({"total_exposure": total} | {k: mine.get(f"{k}{i}") for k in q.aggregates})
            elif isinstance(q, Groups):
                mine = {"groups": 0, "bad_groups": 0, "beyond": 0, "least": None, "most": None} | said.get(f"groups {i}", {})
                found = q.finish(mine)
                out[i] = Finding(found.violating, found.measured, (mine.get("e") or 0.0) / total if total else None)
            else:
                out[i] = q.finish(said[f"frame {id(q.frame)}"])
        return out
    except Exception as e:  # noqa: BLE001 - one rule fails at run time: find it, keep the rest
        if len(asked) == 1:
            return dict.fromkeys(asked, e)
        order = list(asked)
        half = len(order) // 2
        return _answers(ctx, rules, {i: asked[i] for i in order[:half]}) | _answers(ctx, rules, {i: asked[i] for i in order[half:]})


def offending_samples(ctx: Context, rules: Sequence[Rule], keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """(rule, place, key): the SAMPLE smallest offending keys of all row and grouping rules, as JSON, in one pass for each table.

    `keys` names the key columns of each table; a grouping rule's keys are those it groups by. Each task keeps SAMPLE keys
    of a rule before they meet, so a rule that all rows break moves no more than that.
    """
    members, parts = [], []
    for i, rule in enumerate(rules):
        if rule.check not in ROW_CHECKS:
            made = CHECKS[rule.check](rule, ctx)
            if isinstance(made, Groups):
                members.append((i, rule, made))
    for table in dict.fromkeys(r.table for r in rules if r.check in ROW_CHECKS):
        key = F.to_json(F.struct(*[F.col(c) for c in keys[table]]), {"ignoreNullFields": "false"})
        broken = [F.when(ROW_CHECKS[r.check](r, ctx), F.lit(i)) for i, r in enumerate(rules) if r.check in ROW_CHECKS and r.table == table]
        parts.append(ctx.tables[table].select(F.explode(F.array_compact(F.array(*broken))).alias("i"), F.struct(*[F.col(c) for c in keys[table]]).alias("order"), key.alias("key")))
    if members:
        parts.append(_melted(ctx, members).where(_bad_groups(members)).select(F.col("rule").alias("i"), F.col("key").alias("order"), "key"))
    found = None
    for part in parts:
        w = Window.partitionBy("i").orderBy("order", "key")
        part = part.withColumn("place", F.row_number().over(w)).where(F.col("place") <= SAMPLE).select("i", "place", "key")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return next(iter(ctx.tables.values())).sparkSession.createDataFrame([], "rule string, place int, key string")
    name = F.element_at(F.array(*[F.lit(r.slug) for r in rules]), F.col("i") + 1)
    return found.select(name.alias("rule"), "place", "key")


def row_violations(ctx: Context, rules: Sequence[Rule]) -> DataFrame:
    """One row of counts (`v<i>`), affected exposure (`e<i>`) and totals for row rules of a table."""
    df = ctx.tables[rules[0].table]
    return _fused_frame(ctx, df, [(i, r, ROW_CHECKS[r.check](r, ctx)) for i, r in enumerate(rules)])


def _fused_frame(ctx: Context, df: DataFrame, members) -> DataFrame:
    weight = F.col(ctx.exposure) if ctx.exposure in df.columns else F.lit(None).cast("double")
    aggs = [F.sum(weight).alias("total_exposure")]
    for i, _, predicate in members:
        aggs.append(F.count(F.when(predicate, 1)).alias(f"v{i}"))
        aggs.append(F.sum(F.when(predicate, weight)).alias(f"e{i}"))
    return df.agg(*aggs)


def _judge(rule: Rule, finding: Finding | Exception) -> Result:
    if isinstance(finding, Exception):
        return Result(rule, "error", None, {}, None, str(finding).splitlines()[0] if str(finding) else type(finding).__name__, _threshold(rule))
    if finding.skipped:
        return Result(rule, "skipped", None, finding.measured, None, finding.skipped, _threshold(rule))
    bad = finding.violating > rule.max_violating_rows
    outcome = {"info": "pass", "warn": "warn", "fail": "fail"}[rule.severity] if bad else "pass"
    return Result(rule, outcome, finding.violating, finding.measured, finding.exposure_fraction, threshold=_threshold(rule))


def _threshold(rule: Rule) -> dict[str, object]:
    """What a rule was held against: its numbers and value lists, and the rows it lets pass."""
    mine = {k: v for k, v in rule.params.items() if isinstance(v, (int, float)) or k == "values"}
    return mine | {"max_violating_rows": rule.max_violating_rows}


def overall(results: Sequence[Result]) -> str:
    """The worst outcome: fail, error, warn, then pass."""
    seen = {r.outcome for r in results}
    return next((o for o in ("fail", "error", "warn") if o in seen), "pass")


def empty_layers(rules: Sequence[Rule]) -> list[str]:
    return [layer for layer in LAYERS if not any(r.layer == layer for r in rules)]


def offending_sample(ctx: Context, rule: Rule, keys: Sequence[str]) -> DataFrame:
    """Keys of up to 100 rows that violate a row rule, smallest keys first."""
    predicate = ROW_CHECKS[rule.check](rule, ctx)
    return ctx.tables[rule.table].where(predicate).select(*keys).orderBy(*keys).limit(SAMPLE)


def detailed_frame(spark, results: Sequence[Result]) -> DataFrame:
    """Outcome, threshold as JSON, and affected rows and share of the exposure, of every rule."""
    rows = [(r.rule.slug, r.outcome, json.dumps(r.threshold, sort_keys=True, default=str), r.violating, r.exposure_fraction) for r in results]
    return spark.createDataFrame(rows, "rule string, outcome string, threshold string, violating_rows long, exposure_fraction double")


def report_frame(spark, results: Sequence[Result]) -> DataFrame:
    rows = [(r.rule.slug, r.rule.layer, r.rule.severity, r.outcome, r.violating) for r in results]
    return spark.createDataFrame(rows, "rule string, layer string, severity string, outcome string, violating_rows long")
