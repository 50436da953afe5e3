"""Scalar building blocks for recipes, checks, factors and rating steps.

Every function takes and returns `Column`s, so the work stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cast targets a recipe may name (fixed values).
CAST_TYPES: dict[str, T.DataType] = {
    "int": T.LongType(),
    "int64": T.LongType(),
    "int32": T.IntegerType(),
    "float": T.DoubleType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
    "str": T.StringType(),
    "bool": T.BooleanType(),
    "date": T.DateType(),
}


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def divide(a, b) -> Column:
    """`a / b` in double; null where `b` is zero (never an ANSI error, never infinity)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def floor_mod(a, b) -> Column:
    """Remainder with the sign of the divisor, null on a zero divisor."""
    a, b = col(a), col(b)
    remainder = F.try_mod(a, b)
    return F.when((remainder != 0) & ((remainder < 0) != (b < 0)), remainder + b).otherwise(remainder)


def where(condition: Column, then, otherwise) -> Column:
    return F.when(condition, then).otherwise(otherwise)


def horizontal_min(*values) -> Column:
    """Smallest of the values in a row, nulls skipped."""
    return F.least(*[col(v) for v in values])


def horizontal_max(*values) -> Column:
    return F.greatest(*[col(v) for v in values])


def clip(value, low, high) -> Column:
    """`value` held in `[low, high]`; a null value stays null."""
    value = col(value)
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(value, F.lit(high))))


def strip(value) -> Column:
    """Whitespace removed from both ends (Spark's `trim` removes spaces only)."""
    return F.regexp_replace(col(value), r"^\s+|\s+$", "")


def map_levels(value, mapping: Mapping[str, str]) -> Column:
    """Mapped where the mapping names the value, unchanged elsewhere.

    The mapping is a declared recipe parameter, so it is held as a literal; use
    `premia.operators.prepare.map_from_table` for a mapping that is itself a table.
    """
    value = col(value)
    if not mapping:
        return value
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.when(value.isNotNull(), F.coalesce(F.try_element_at(pairs, value), value))


def cast_to(value, target: str) -> Column:
    """Non-strict cast: a value that does not parse becomes null."""
    if target not in CAST_TYPES:
        raise ValueError(f"{target!r} is not a supported cast target")
    return col(value).try_cast(CAST_TYPES[target])


#: strptime directive -> Java datetime pattern (fixed values).
STRPTIME_TO_JAVA = {
    "%Y": "yyyy",
    "%m": "MM",
    "%d": "dd",
    "%b": "MMM",
    "%B": "MMMM",
    "%y": "yy",
    "%H": "HH",
    "%M": "mm",
    "%S": "ss",
}


def java_pattern(fmt: str) -> str:
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%":
            directive = fmt[i : i + 2]
            if directive not in STRPTIME_TO_JAVA:
                raise ValueError(f"{directive!r} is not a supported date directive")
            out.append(STRPTIME_TO_JAVA[directive])
            i += 2
        else:
            out.append(f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i])
            i += 1
    return "".join(out)


def parse_date(value, fmt: str) -> Column:
    """A date read by a strptime format, null where it does not parse."""
    return F.to_date(F.try_to_timestamp(col(value), F.lit(java_pattern(fmt))))


def year_fraction(start, end, days_per_year: str = "365.25") -> Column:
    """Days between two dates as years."""
    return F.datediff(col(end), col(start)) / F.lit(float(days_per_year))


def stored_exposure(total: Column) -> Column:
    """An exposure total as it is stored: six decimal places."""
    return F.round(total, 6)


ROUNDING_MODES = ("half_even", "half_up", "ceiling", "floor", "down")


def round_exact(value, mode: str = "half_even", dp: int = 0) -> Column:
    """One explicit rounding of a decimal; the result is a decimal with `dp` places."""
    value = col(value)
    if mode not in ROUNDING_MODES:
        raise ValueError(f"{mode!r} is not a rounding mode; expected one of {ROUNDING_MODES}")
    unit = F.lit(10**dp).cast("decimal(20,0)")
    target = f"decimal(38,{dp})"
    if mode == "half_even":
        return F.bround(value, dp).cast(target)
    if mode == "half_up":
        return F.round(value, dp).cast(target)
    scaled = value * unit
    if mode == "ceiling":
        whole = F.ceil(scaled)
    elif mode == "floor":
        whole = F.floor(scaled)
    else:
        whole = F.when(scaled >= 0, F.floor(scaled)).otherwise(F.ceil(scaled))
    return (whole.cast("decimal(38,0)") / unit).cast(target) if dp else whole.cast(target)


def to_minor(value, mode: str = "half_even") -> Column:
    """Money rounded once to whole minor units."""
    return round_exact(value, mode).cast("long")


def ceiling_change_pct(change_minor, baseline_minor) -> Column:
    """`|change| / baseline` in percent, rounded once towards +infinity at six places.

    Exact: the ratio is never formed as a float. The result is text, as money figures travel.
    """
    unit = 1_000_000
    top = F.abs(col(change_minor)).cast("decimal(28,0)") * F.lit(100 * unit).cast("decimal(10,0)")
    base = col(baseline_minor).cast("decimal(28,0)")
    quotient = (top - F.pmod(top, base)) / base
    scaled = quotient.cast("decimal(38,0)") + F.when(F.pmod(top, base) > 0, 1).otherwise(0).cast("decimal(1,0)")
    whole = F.floor(scaled / F.lit(unit).cast("decimal(10,0)")).cast("decimal(30,0)")
    part = (scaled - whole * F.lit(unit).cast("decimal(7,0)")).cast("decimal(20,0)")
    return F.concat(whole.cast("string"), F.lit("."), F.lpad(part.cast("string"), 6, "0"))


def flatten_json(text, depth: int = 3) -> Column:
    """Nested JSON objects as one map of dotted paths to values, down to `depth` levels."""

    def level(column: Column, prefix: Column, left: int) -> Column:
        as_map = F.from_json(column, "map<string,string>")
        entries = F.map_entries(as_map)

        def expand(entry: Column) -> Column:
            path = F.concat(prefix, entry["key"])
            leaf = F.array(F.struct(path.alias("path"), entry["value"].alias("value")))
            if left <= 1:
                return leaf
            nested = level(entry["value"], F.concat(path, F.lit(".")), left - 1)
            is_object = entry["value"].startswith("{") & (F.size(nested) > 0)
            return F.when(is_object, nested).otherwise(leaf)

        return F.coalesce(
            F.flatten(F.transform(entries, expand)), F.array().cast("array<struct<path:string,value:string>>")
        )

    return F.map_from_entries(level(col(text), F.lit(""), depth))


def any_null(columns: Sequence[str]) -> Column:
    condition = F.lit(False)
    for name in columns:
        condition = condition | F.col(name).isNull()
    return condition
