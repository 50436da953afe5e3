"""Readers. Text is read as text; types come later, from a declared recipe."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that mean "no value" in delimited files (fixed values).
NULL_TEXTS = ("", "NA", "N/A", "NULL", "null")

SOURCE_KINDS = ("upload", "object_store", "sql", "pipeline")


def read_delimited(spark: SparkSession, paths: str | Sequence[str], *, sep: str = ",") -> DataFrame:
    """Delimited text with a header, every column a string; a ragged row is an error.

    `.gz` and `.zst` files are read through Spark's codecs.
    """
    df = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("inferSchema", False)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("multiLine", False)
        .csv(paths if isinstance(paths, str) else list(paths))
    )
    return df.select(
        *[F.when(~F.col(f"`{c}`").isin(*NULL_TEXTS), F.col(f"`{c}`")).alias(c) for c in df.columns]
    )


def read_tabs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The `.tsv` / `.txt` form: the same, tab separated."""
    return read_delimited(spark, paths, sep="\t")


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """One logical table over any number of parquet paths."""
    return spark.read.parquet(*paths)


#: A split with more rows than this is dealt out when cores would otherwise be idle.
ROWS_PER_SPLIT = 100_000
#: Rows of one part of a table that is dealt out: a larger table has more parts, not larger ones.
ROWS_PER_PART = 500_000


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt out evenly if its files give fewer splits than there are cores.

    A parquet file with one row group is one task whatever its size. A table of many files, which
    is how a large one is stored, comes back as it is. Rows are counted from the footers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= cores:
        return df
    rows = df.count()
    if rows < ROWS_PER_SPLIT * splits:
        return df
    return df.repartition(max(cores, -(-rows // ROWS_PER_PART)))


def footer_schema(spark: SparkSession, path: str) -> T.StructType:
    """Column types from file footers; no row is read."""
    return spark.read.parquet(path).schema


def read_source(spark: SparkSession, kind: str, options: Mapping[str, object]) -> DataFrame:
    """A table from one of the declared source kinds.

    `sql` passes `options` to the JDBC reader, which splits the read over `numPartitions` when
    `partitionColumn` and its bounds are given. `pipeline` names a catalogue table.
    """
    if kind not in SOURCE_KINDS:
        raise ValueError(f"{kind!r} is not a source kind; expected one of {SOURCE_KINDS}")
    if kind == "sql":
        return spark.read.format("jdbc").options(**{k: str(v) for k, v in options.items()}).load()
    if kind == "pipeline":
        return spark.table(str(options["table"]))
    path = str(options["path"])
    name = path.lower().removesuffix(".gz").removesuffix(".zst")
    if name.endswith(".csv"):
        return read_delimited(spark, path)
    if name.endswith((".tsv", ".txt")):
        return read_tabs(spark, path)
    if name.endswith(".parquet"):
        return read_parquet(spark, path)
    raise ValueError("unsupported file type; expected .csv, .tsv, .txt or .parquet")


def content_fingerprint(df: DataFrame) -> DataFrame:
    """One row: `n_rows` and a digest of all rows, the same for any row order or file layout.

    Rows are hashed where they lie and the hashes are summed, so no file passes through a task.
    """
    row_text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    digest = F.sha2(row_text, 256)
    parts = [
        F.sum(F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)
    ]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *parts).select(
        "n_rows", F.sha2(F.concat_ws(":", "n_rows", *[f"s{i}" for i in range(4)]), 256).alias("fingerprint")
    )


def new_arrivals(candidates: DataFrame, run_log: DataFrame) -> DataFrame:
    """Arrivals whose key and fingerprint are not in the run log yet (idempotent re-ingest)."""
    return candidates.join(run_log.select("idempotency_key", "fingerprint"), ["idempotency_key", "fingerprint"], "left_anti")


def read_code_set(
    spark: SparkSession, path: str, *, keys: Sequence[str], payload: Mapping[str, str]
) -> DataFrame:
    """A reference code set (postcodes, bank holidays, vehicle groups, occupations): declared key
    columns and typed payload columns, checked to be there."""
    df = read_delimited(spark, path)
    missing = [c for c in [*keys, *payload] if c not in df.columns]
    if missing:
        raise ValueError(f"code set lacks column(s) {missing}")
    from premia.functions.scalar import cast_to

    return df.select(*keys, *[cast_to(c, t).alias(c) for c, t in payload.items()])
