"""Session defaults, reliable lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup DataFrame is broadcast on purpose. Wider lookups are left to
#: Spark's own byte-based choice and to AQE.
BROADCAST_ROWS = 50_000


def local_session(cores: int | str = "*", *, shuffle_partitions: int = 8, app: str = "premia") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir.

    Only a session whose executors are threads of the driver (a local master) gets a temporary folder of its own; on a
    cluster a missing setting is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="premia-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder, so later jobs read it instead of recomputing it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *columns: str) -> DataFrame:
    """`df`, or these columns of it, written once as Parquet into the checkpoint folder and read back.

    For tables of as many rows as the input that are passed over again and again: a join behind them runs once, and a
    pass reads the columns it needs from encoded files, not whole serialised rows. Removed when the application ends.
    """
    spark = df.sparkSession
    kept = df.select(*columns) if columns else df
    path = f"{checkpoint_dir(spark).rstrip('/')}/premia-{uuid.uuid4().hex}"
    kept.write.option("compression", "zstd").parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(kept.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it is counted to hold at most `limit` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def shuffle_buckets(spark: SparkSession) -> int:
    """How many pieces an ordered computation is split into: as many as a shuffle has."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
