"""Pricing views over the given tables, as DataFrames and as the same SQL text.

A Spark view joins only the dimensions a query asks for, so unused ones are never scanned.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.session import stored
from premia.sources.files import spread


_TABLES: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its footer is read once per application, its rows whenever a query runs."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{name}.parquet")
    if key not in _TABLES:
        _TABLES[key] = spread(spark.read.parquet(key[1]))
    return _TABLES[key]


def policy_exposure(spark, sf) -> DataFrame:
    """One row per order, as an exposure period of 182 days."""
    o = table(spark, sf, "orders")
    start = F.col("o_orderdate").cast("date")
    return o.select(
        F.col("o_orderkey").alias("period_id"),
        F.col("o_custkey").alias("policy_id"),
        start.alias("exposure_start"),
        F.date_add(start, 182).alias("exposure_end"),
        F.lit(182 / 365.25).alias("exposure_years"),
        F.col("o_orderpriority").alias("rating_level"),
    )


POLICY_EXPOSURE = """policy_exposure AS (
  SELECT o_orderkey AS period_id, o_custkey AS policy_id, CAST(o_orderdate AS DATE) AS exposure_start,
         CAST(o_orderdate AS DATE) + 182 AS exposure_end, 182/365.25::DOUBLE AS exposure_years,
         o_orderpriority AS rating_level
  FROM orders)"""


def claim_id():
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def claim(spark, sf) -> DataFrame:
    """One row per returned line, as a claim on the order's customer."""
    li = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        claim_id().alias("claim_id"),
        F.col("o_custkey").alias("policy_id"),
        F.col("l_shipdate").cast("date").alias("date_of_loss"),
        amount_minor().alias("claim_amount_minor"),
        F.col("l_linestatus").alias("peril"),
    )


CLAIM = """claim AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS claim_id, o_custkey AS policy_id,
         CAST(l_shipdate AS DATE) AS date_of_loss,
         CAST(round(l_extendedprice*l_discount*100) AS BIGINT) AS claim_amount_minor, l_linestatus AS peril
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')"""


def amount_minor():
    return F.round(F.col("l_extendedprice") * F.col("l_discount") * 100).cast("long")


def row_key():
    """One exact number that orders rows as (order, line, part, supplier) do."""
    wide = "decimal(38,0)"

    def shifted(name: str, digits: int):
        return F.col(name).cast("decimal(14,0)") * F.lit(Decimal(10**digits)).cast(f"decimal({digits + 1},0)")

    return (
        shifted("l_orderkey", 22).cast(wide)
        + shifted("l_linenumber", 20).cast(wide)
        + shifted("l_partkey", 10).cast(wide)
        + F.col("l_suppkey").cast(wide)
    ).cast(wide)


def book(spark, sf, *dimensions: str) -> DataFrame:
    """One row per line: exposure, claims and the levels of the asked dimensions.

    `dimensions` names any of "orders", "part", "customer", "nation". Customers and nations are joined to the orders, of
    which there are fewer, so lines are dealt out once by order and once by part.
    """
    wanted = set(dimensions)
    if "nation" in wanted:
        wanted.add("customer")
    if "customer" in wanted:
        wanted.add("orders")
    df = table(spark, sf, "lineitem")
    if "orders" in wanted:
        o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
        if "customer" in wanted:
            c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
            o = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        if "nation" in wanted:
            n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
            o = o.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        df = df.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    if "part" in wanted:
        p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
        df = df.join(p, F.col("l_partkey") == F.col("p_partkey"))
    is_claim = F.col("l_returnflag") == "R"
    columns = {
        "row_key": row_key(),
        "exposure_years": F.col("l_quantity") / 50,
        "claim_count": F.when(is_claim, 1).otherwise(0).cast("long"),
        "claim_amount_minor": F.when(is_claim, amount_minor()).otherwise(0).cast("long"),
    }
    if "orders" in wanted:
        columns["policy_id"] = F.col("o_custkey")
        columns["start_date"] = F.col("o_orderdate").cast("date")
    return df.withColumns(columns)


BOOK = """book AS (
  SELECT l.*, o.o_custkey AS policy_id, CAST(o_orderdate AS DATE) AS start_date, o_orderpriority,
         p_brand, p_type, p_size, c_mktsegment, n_name, n_regionkey,
         l_quantity/50 AS exposure_years, CAST(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS BIGINT) AS claim_count,
         CAST(CASE WHEN l_returnflag='R' THEN round(l_extendedprice*l_discount*100) ELSE 0 END AS BIGINT) AS claim_amount_minor
  FROM lineitem l JOIN orders o ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey
  JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey)"""

#: The date that parts the book into a reference and a current version.
VERSION_CUT = "1998-04-01"

ROW_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def versions(spark, sf, *dimensions, keep=()) -> tuple[DataFrame, DataFrame]:
    """(current, reference): the book split at the version cut. With `keep`, both are read from one stored book of these columns."""
    b = book(spark, sf, "orders", *dimensions)
    if keep:
        b = stored(b, "start_date", *keep)
    cut = F.lit(VERSION_CUT).cast("date")
    return b.where(F.col("start_date") >= cut), b.where(F.col("start_date") < cut)


def with_sql(*parts: str) -> str:
    """`WITH a AS (...), b AS (...)`."""
    return "WITH " + ",\n".join(parts) + "\n"
