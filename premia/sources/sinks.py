"""Writers. A version of a table is a folder that is written once and never changed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.session import checkpoint_dir


def version_path(root: str, dataset: str, version: int, table: str) -> str:
    return f"{root.rstrip('/')}/{dataset}/v={version}/{table}.parquet"


def write_table(df: DataFrame, path: str) -> str:
    """Parquet with zstd. Fails if the path exists: a version is immutable."""
    df.write.mode("error").option("compression", "zstd").parquet(path)
    return path


def write_rejected(parts: list[DataFrame], path: str) -> str:
    """All quarantined rows of a version as one text table; absent columns are null."""
    return write_table(union_by_name(parts), path)


def union_by_name(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts, columns matched by name, absent ones null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def write_scores(df: DataFrame, path: str, *, partition_by: str | None = None) -> str:
    """Batch-score output: one row per quote. A failed task is retried by Spark; the job commits
    whole or not at all."""
    writer = df.write.mode("error").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return path


#: Columns that a trace store has folders for, from the coarsest on; a month keeps folders few and their files large.
TRACE_FOLDERS = ("environment", "version", "scored_month")


def write_traces(traces: DataFrame, path: str, *, time: str = "scored_on", quote: str = "quote_id", pieces: int = 8, append: bool = False) -> str:
    """Traces in folders by environment, version and month of `time`, so that a question about some of them reads no others.

    The rows of a folder are dealt to up to `pieces` tasks by a hash of the quote: a folder gets few files, and none is
    written by one task alone however many traces a month has.
    """
    months = traces.withColumn("scored_month", F.date_format(time, "yyyy-MM"))
    dealt = months.repartition(*TRACE_FOLDERS, F.pmod(F.xxhash64(quote), F.lit(pieces)))
    dealt.write.mode("append" if append else "error").option("compression", "zstd").partitionBy(*TRACE_FOLDERS).parquet(path)
    return path


def write_rate_table_csv(cells: DataFrame, path: str) -> str:
    """Rate-table cells as text rows of keys and value."""
    cells.select(*[F.col(c).cast("string") for c in cells.columns]).write.mode("error").option("header", True).csv(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
