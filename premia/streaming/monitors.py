"""Monitors on streams: the batch kernels over event-time windows, with bounded state.

Results go to parquet tables through the file sink, whose commit log makes each batch count once;
stream checkpoints live in the shared checkpoint folder, so a lost driver or executor resumes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from premia.functions.hashing import hash_unit
from premia.operators.monitor import ranked_value
from premia.sources.sinks import scratch_path


def read_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """A parquet table of a folder, stored as one file or as a folder of files, as a stream of its files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.getFileStatus(path).isDirectory():
        return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def write_results(df: DataFrame, name: str, *, mode: str = "append") -> str:
    """Process everything available into a results table and return its path."""
    spark = df.sparkSession
    out = scratch_path(spark, f"stream-{name}")
    query = (
        df.writeStream.outputMode(mode).format("parquet").option("path", out)
        .option("checkpointLocation", scratch_path(spark, f"offsets-{name}")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return out


def read_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A results table as a stream, for the monitors that follow it."""
    return spark.readStream.schema(schema).parquet(path)


def run_to_table(df: DataFrame, name: str, *, mode: str = "append") -> DataFrame:
    """Process everything available, then return what was written."""
    return df.sparkSession.read.schema(df.schema).parquet(write_results(df, name, mode=mode))


def run_batches(df: DataFrame, name: str, each: Callable[[DataFrame], DataFrame], schema: str, *, mode: str = "append") -> DataFrame:
    """Apply a batch kernel to every micro-batch and append its rows, one folder per batch.

    A batch that is replayed writes its own folder again, so nothing is counted twice.
    """
    spark = df.sparkSession
    out = scratch_path(spark, f"stream-{name}")

    def write(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        df.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", scratch_path(spark, f"offsets-{name}")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(schema + ", batch int").parquet(out).drop("batch")


def windowed_levels(events: DataFrame, columns: Sequence[str], *, time: str, width: str, late: str, weight: str | None = None) -> DataFrame:
    """(period, column, level, n, weight) per closed window; rows later than `late` are left to backfill."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return (
        events.withWatermark(time, late)
        .select(time, w.alias("__w"), F.inline(entries))
        .groupBy(F.window(time, width), "column", "level")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("__w").alias("weight"))
        .select(F.col("window.start").alias("period"), F.col("window.end").alias("period_end"), "column", "level", "n", "weight")
    )


def windowed_operations(events: DataFrame, *, time: str, width: str, late: str, error: str, latency: str, by: Sequence[str] = ()) -> DataFrame:
    """Throughput, error rate and latency percentiles per closed window."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, width), *by)
        .agg(
            F.count(F.lit(1)).alias("requests"), F.avg(F.col(error).cast("double")).alias("error_rate"),
            *[ranked_value(latency, p).alias(f"p{p}") for p in (50, 95, 99)],
        )
        .select(
            F.col("window.start").alias("period"), F.col("window.end").alias("period_end"), *by, "requests", "error_rate", "p50", "p95", "p99",
        )
    )


def converted_quotes(quotes: DataFrame, outcomes: DataFrame, *, key: str, quote_time: str, outcome_time: str, within: str, late: str) -> DataFrame:
    """Stream-stream join of quotes with the outcomes that follow within a time, state bounded by both watermarks."""
    q = quotes.withWatermark(quote_time, late).alias("q")
    o = outcomes.withWatermark(outcome_time, late).alias("o")
    later = (F.col(f"o.{outcome_time}") >= F.col(f"q.{quote_time}")) & (
        F.col(f"o.{outcome_time}") <= F.col(f"q.{quote_time}") + F.expr(f"interval {within}")
    )
    return q.join(o, (F.col(f"q.{key}") == F.col(f"o.{key}")) & later, "inner")


def sampled_stream(events: DataFrame, keep: str, rate: float, seed: int, key: str) -> DataFrame:
    """Every event matching a condition and a seeded share of the others; no state."""
    reason = F.when(F.expr(keep), "always").when(hash_unit(key, seed) < rate, "rate")
    return events.withColumn("sample_reason", reason).where("sample_reason is not null")


def first_alerts(alerts: DataFrame, *, time: str, keys: Sequence[str], quiet: str) -> DataFrame:
    """One alert per key within a quiet period, by event time."""
    return alerts.withWatermark(time, quiet).dropDuplicatesWithinWatermark(list(keys))


def consecutive_breaches(
    results: DataFrame, *, key: str, time: str, value: str, limit: float, needed: int
) -> DataFrame:
    """Alerts of a key after `needed` breaches in a row: (key, since, at, run).

    `results` are metric values, one per key and closed window, so a key has few rows in a batch;
    they are put in time order first. The state of a key is its run length; it escalates once per
    run instead of repeating.
    """
    out = T.StructType(
        [T.StructField("key", T.StringType()), T.StructField("since", T.TimestampType()), T.StructField("at", T.TimestampType()), T.StructField("run", T.LongType())]
    )
    state = T.StructType([T.StructField("run", T.LongType()), T.StructField("since", T.TimestampType())])

    def step(name: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        run, since = held.get if held.exists else (0, None)
        rows = pd.concat(list(batches), ignore_index=True).sort_values("t")
        fired = []
        for t, v in zip(rows["t"], rows["v"]):
            if v > limit:
                since = t if run == 0 else since
                run += 1
                if run == needed:
                    fired.append((name[0], since, t, run))
            else:
                run, since = 0, None
        held.update((run, since.to_pydatetime() if since is not None and hasattr(since, "to_pydatetime") else since))
        if fired:
            yield pd.DataFrame(fired, columns=["key", "since", "at", "run"])

    rows = results.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("t"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("key").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)
