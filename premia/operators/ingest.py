"""Ingestion: column names, candidate schema, quarantine and version totals."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premia.functions.scalar import java_pattern

REASON, COLUMN, STEP = "_reject_reason", "_reject_column", "_reject_step"

#: Date formats tried in order (fixed values).
DATE_FORMATS = (
    "%Y-%m-%d",
    "%d/%m/%Y",
    "%m/%d/%Y",
    "%d-%m-%Y",
    "%Y/%m/%d",
    "%d %b %Y",
    "%Y-%m-%dT%H:%M:%S",
)


class ColumnNameCollision(ValueError):
    """Two source columns get the same normalised name."""


def normalise_name(name: str) -> str:
    """A column name in snake_case ASCII: accents folded, camel case split, digits prefixed."""
    letters = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    spaced = ""
    for i, c in enumerate(letters):
        before, after = letters[i - 1 : i], letters[i + 1 : i + 2]
        starts_word = before.islower() or before.isdigit() or (before.isupper() and after.islower())
        spaced += f" {c}" if c.isupper() and starts_word else c
    joined = "_".join(re.findall(r"[a-z0-9]+", spaced.lower()))
    if not joined:
        raise ValueError(f"column name {name!r} normalises to nothing")
    return f"col_{joined}" if joined[0].isdigit() else joined


def normalise_columns(names: Sequence[str]) -> dict[str, str]:
    """`{normalised: source}`; two sources with one normalised name are refused."""
    out: dict[str, str] = {}
    for name in names:
        short = normalise_name(name)
        if short in out:
            raise ColumnNameCollision(f"{out[short]!r} and {name!r} both normalise to {short!r}")
        out[short] = name
    return out


def with_normalised_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*normalise_columns(df.columns))


def level_counts(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """(column, level text, rows[, weight]) for several columns in one shuffle.

    Counting starts on the map side, so a level held by most rows moves as a few partial counts.
    """
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("level")) for c in columns]))
    if weight:
        melted = df.select(F.col(weight).cast("double").alias("__w"), entries.alias("e"))
        aggs = [F.count(F.lit(1)).alias("n"), F.sum("__w").alias("weight")]
    else:
        melted = df.select(entries.alias("e"))
        aggs = [F.count(F.lit(1)).alias("n")]
    return melted.groupBy(F.col("e.column").alias("column"), F.col("e.level").alias("level")).agg(*aggs)


def infer_schema(df: DataFrame, *, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: type, null count, distinct count (null is a value), candidate key.

    A candidate key has more than one row, no null and only distinct values.
    """
    columns = list(columns or df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[a for i, c in enumerate(columns) for a in (F.count(f"`{c}`").alias(f"k{i}"), F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}"))],
    )
    entries = []
    for i, c in enumerate(columns):
        nulls = F.col("n") - F.col(f"k{i}")
        distinct = F.col(f"d{i}") + F.when(nulls > 0, 1).otherwise(0)
        entries.append(
            F.struct(
                F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), nulls.alias("null_count"), distinct.alias("distinct_count"), (nulls > 0).alias("nullable"),
                ((F.col("n") > 1) & (nulls == 0) & (distinct == F.col("n"))).alias("is_candidate_key"),
            )
        )
    return row.select(F.inline(F.array(*entries)))


def sample_values(df: DataFrame, column: str, order_by: str, n: int = 3) -> DataFrame:
    """The first `n` non-null values in row order, as text."""
    return df.where(F.col(column).isNotNull()).orderBy(order_by).limit(n).select(F.col(column).cast("string").alias("value"))


def sniff_date_format(df: DataFrame, column: str) -> str | None:
    """The first declared format that parses every non-null text of the column, in one pass."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return None
    values = df.where(F.col(column).isNotNull())
    row = values.agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.count(F.try_to_timestamp(F.col(column), F.lit(java_pattern(f)))).alias(f"f{i}")
            for i, f in enumerate(DATE_FORMATS)
        ],
    ).first()
    if row["n"] == 0:
        return None
    return next((f for i, f in enumerate(DATE_FORMATS) if row[f"f{i}"] == row["n"]), None)


def partition_rejects(df: DataFrame, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected): rows with a null in a required column are set aside with the reason.

    The reason names the first failing column in the declared order.
    """
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"required columns absent from the table: {missing}")
    failing = (
        F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]) if required else F.lit(None).cast("string")
    )
    marked = df.withColumn(COLUMN, failing)
    rejected = marked.where(F.col(COLUMN).isNotNull()).select(
        *df.columns,
        F.concat(F.col(COLUMN), F.lit(" is null")).alias(REASON),
        F.col(COLUMN),
        F.lit("required_non_null").alias(STEP),
    )
    return marked.where(F.col(COLUMN).isNull()).drop(COLUMN), rejected


def reject_rate(clean: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: clean rows, rejected rows, and their share (0 for nothing read)."""
    none = F.lit(0).cast("long")
    both = clean.agg(F.count(F.lit(1)).alias("c"), none.alias("r")).unionAll(rejected.agg(none, F.count(F.lit(1))))
    counts = both.agg(F.sum("c").alias("clean_rows"), F.sum("r").alias("rejected_rows"))
    total = F.col("clean_rows") + F.col("rejected_rows")
    return counts.withColumn("reject_rate", F.when(total == 0, F.lit(0.0)).otherwise(F.col("rejected_rows") / total))


def reject_sample(rejected: DataFrame, order_by: str, n: int = 10) -> DataFrame:
    """The first `n` rejects in source order, as text."""
    return rejected.orderBy(order_by).limit(n).select(*[F.col(c).cast("string").alias(c) for c in rejected.columns])


def exact_sum(name: str, scale: int = 12):
    """Sum of a column through its text, in decimal: no float error accumulates."""
    return F.sum(F.col(name).cast("string").cast(f"decimal(38,{scale})"))


def version_totals(df: DataFrame) -> DataFrame:
    """Exposure (six places), claim count and claim amount; null where the column is absent."""
    aggs = [
        F.coalesce(F.bround(exact_sum("exposure_years"), 6).cast("string"), F.lit("0.000000")).alias("exposure_years")
        if "exposure_years" in df.columns
        else F.lit(None).cast("string").alias("exposure_years")
    ]
    for name in ("claim_count", "claim_amount_minor"):
        if name in df.columns and "exposure_years" in df.columns:
            aggs.append(F.coalesce(F.sum(F.col(name).cast("long")), F.lit(0)).alias(name))
        else:
            aggs.append(F.lit(None).cast("long").alias(name))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *aggs).select("exposure_years", "claim_count", "claim_amount_minor")
